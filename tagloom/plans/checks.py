"""What a plan should look like, as numbers for tests."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def count_nodes(df: DataFrame, name: str) -> int:
    """Number of physical operators with this name, e.g. ArrowEvalPython, Exchange, Window."""
    return len(re.findall(rf"(?m)(?:^|[ :+\-*|()\d]){re.escape(name)}\b", plan_text(df).split("Initial Plan")[0]))


def pushed_filters(df: DataFrame) -> str:
    found = re.search(r"PushedFilters: (\[[^\]]*\])", plan_text(df))
    return found[1] if found else "[]"


def columns_read(df: DataFrame) -> str:
    found = re.search(r"ReadSchema: (struct<[^\n]*>)", plan_text(df))
    return found[1] if found else ""
