"""Token filters: DataFrame to DataFrame, built-in functions only.

All take and return the `tokens` relation.  Neighbours are looked up before rows are dropped, so
each filter sees the tokens of its input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions import tables as T
from tagloom.operators.parse import ATTR, is_html

SPACE_KEPT = sorted({"pre", "textarea"} | T.RAW_TEXT)
_FLOW = "address article aside blockquote datagrid dialog dir div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr menu nav ol p pre section table ul".split()


def in_order():
    """Window over a document's tokens in order.  (Not a constant: windows need a session.)"""
    return Window.partitionBy("doc_id").orderBy("seq", "sub")


def whole_document():
    return Window.partitionBy("doc_id")


def alphabetical_attributes(stream: DataFrame) -> DataFrame:
    """Attributes by namespace (none first) and name."""
    key = lambda a: F.struct(F.coalesce(a["ns"], F.lit("")).alias("ns"), a["name"].alias("name"))
    ordered = F.array_sort("attrs", lambda x, y: F.when(key(x) < key(y), -1).when(key(x) > key(y), 1).otherwise(0))
    return stream.withColumn("attrs", ordered)


def collapse_whitespace(stream: DataFrame) -> DataFrame:
    """Runs of white space become one space, except within elements that keep it."""
    name, kind = F.col("name"), F.col("type")
    keeps = name.isin(*SPACE_KEPT)
    step = F.when((kind == "StartTag") & keeps, 1).when((kind == "EndTag") & keeps, -1).otherwise(0)
    kept = F.sum(step).over(in_order()) > 0
    new = F.when(kind == "SpaceCharacters", F.lit(" ")).when(kind == "Characters", F.regexp_replace("data", r"[\t\n\f\r ]+", " "))
    plain = ~F.col("kept") & kind.isin("SpaceCharacters", "Characters") & (F.col("data") != "")
    return stream.withColumn("kept", kept).withColumn("data", F.when(plain, new).otherwise(F.col("data"))).drop("kept")


def optional_start(compat: bool = True) -> Column:
    """Whether a start tag without attributes may go, from `before` and `after` (type, name).

    With `compat` each string that is a part of "html" counts as that name.
    """
    name, kind, of = F.col("name"), F.col("after.type"), F.col("after.name")
    root = F.lit("html").contains(name) if compat else name == "html"
    plain = ~F.coalesce(kind.isin("Comment", "SpaceCharacters"), F.lit(False))
    tag = F.coalesce(kind.isin("StartTag", "EmptyTag"), F.lit(False))
    start = F.coalesce(kind == "StartTag", F.lit(False))
    group_before = F.coalesce((F.col("before.type") == "EndTag") & F.col("before.name").isin("tbody", "thead", "tfoot"), F.lit(False))
    return (
        F.when(root, plain)
        .when(name == "head", tag | F.coalesce((kind == "EndTag") & (of == "head"), F.lit(False)))
        .when(name == "body", plain & ~(start & of.isin("script", "style")))
        .when(name == "colgroup", tag & (of == "col"))
        .when(name == "tbody", start & ~group_before & (of == "tr"))
        .otherwise(False)
    )


def optional_end() -> Column:
    """Whether an end tag may go, from `after`."""
    name, kind, of = F.col("name"), F.col("after.type"), F.col("after.name")
    plain = ~F.coalesce(kind.isin("Comment", "SpaceCharacters"), F.lit(False))
    start = F.coalesce(kind == "StartTag", F.lit(False))
    tag = F.coalesce(kind.isin("StartTag", "EmptyTag"), F.lit(False))
    last = kind.isNull() | (kind == "EndTag")

    def followed(*names: str, or_last: bool = True, tags=start) -> Column:
        return F.when(tags, of.isin(*names)).otherwise(last if or_last else F.lit(False))

    return (
        F.when(name.isin("html", "head", "body"), plain)
        .when(name.isin("li", "optgroup", "tr"), F.when(start, of == name).otherwise(last))
        .when(name == "dt", followed("dt", "dd", or_last=False))
        .when(name == "dd", followed("dt", "dd"))
        .when(name == "p", followed(*_FLOW, tags=tag))
        .when(name == "option", followed("option", "optgroup"))
        .when(name.isin("rt", "rp"), followed("rt", "rp"))
        .when(name == "colgroup", plain & ~(start & (of == "colgroup")))
        .when(name == "thead", followed("tbody", "tfoot", or_last=False))
        .when(name == "tbody", followed("tbody", "tfoot"))
        .when(name == "tfoot", followed("tbody"))
        .when(name.isin("td", "th"), followed("td", "th"))
        .otherwise(False)
    )


def optional_tags(stream: DataFrame, compat: bool = True) -> DataFrame:
    """Without the tags that a parser would imply."""
    pair = F.struct("type", "name")
    seen = stream.withColumn("before", F.lag(pair).over(in_order())).withColumn("after", F.lead(pair).over(in_order()))
    gone = F.when((F.col("type") == "StartTag") & (F.size("attrs") == 0), optional_start(compat)).when(F.col("type") == "EndTag", optional_end()).otherwise(False)
    return seen.filter(~gone).drop("before", "after")


def inject_meta_charset(stream: DataFrame, encoding: str) -> DataFrame:
    """Encodings in `<meta>` say `encoding`; one is put after the head's start tag if there is none."""
    kind, name, attrs = F.col("type"), F.lower("name"), F.col("attrs")
    meta = (kind == "EmptyTag") & (name == "meta")
    is_charset = lambda a: a["ns"].isNull() & (F.lower(a["name"]) == "charset")
    is_content = lambda a: a["ns"].isNull() & (a["name"] == "content")
    set_to = lambda a, v: F.struct(a["ns"].alias("ns"), a["prefix"].alias("prefix"), a["name"].alias("name"), F.lit(v).alias("value"))
    has_charset = F.exists(attrs, is_charset)
    typed = F.exists(attrs, lambda a: a["ns"].isNull() & (a["name"] == "http-equiv") & (F.lower(a["value"]) == "content-type")) & F.exists(attrs, is_content)
    new = (
        F.when(meta & has_charset, F.transform(attrs, lambda a: F.when(is_charset(a), set_to(a, encoding)).otherwise(a)))
        .when(meta & typed, F.transform(attrs, lambda a: F.when(is_content(a), set_to(a, f"text/html; charset={encoding}")).otherwise(a)))
        .otherwise(attrs)
    )
    at = F.struct("seq", "sub")
    head = F.when((kind == "StartTag") & (name == "head"), at)
    end = F.when((kind == "EndTag") & (name == "head") | (kind == "EmptyTag") & (name == "head"), at)
    marked = stream.withColumn("named", meta & (has_charset | typed)).withColumn("head_end", F.min(end).over(whole_document())).withColumn("head_at", F.min(head).over(whole_document()))
    marked = marked.withColumn("known", F.coalesce(F.max(F.when(F.col("named") & (at < F.col("head_end")), True)).over(whole_document()), F.lit(False))).withColumn("attrs", new)
    charset = F.array(F.struct(F.lit(None).cast("string").alias("ns"), F.lit(None).cast("string").alias("prefix"), F.lit("charset").alias("name"), F.lit(encoding).alias("value"))).cast(f"array<{ATTR}>")
    none = F.array().cast(f"array<{ATTR}>")
    row = lambda sub, kind, name, attrs: F.struct(F.lit(sub).alias("sub"), kind.alias("type"), name.alias("name"), attrs.alias("attrs"))
    own = F.struct(F.col("sub").alias("sub"), kind.alias("type"), F.col("name").alias("name"), F.col("attrs").alias("attrs"))
    after_head = ~F.col("known") & (at == F.col("head_at")) & F.col("head_end").isNotNull()
    empty_head = ~F.col("known") & (kind == "EmptyTag") & (name == "head") & (at == F.col("head_end"))
    tag = F.lit("EmptyTag")
    rows = F.when(after_head, F.array(own, row(1, tag, F.lit("meta"), charset))).when(
        empty_head, F.array(row(0, F.lit("StartTag"), F.lit("head"), F.col("attrs")), row(1, tag, F.lit("meta"), charset), row(2, F.lit("EndTag"), F.lit("head"), none))
    ).otherwise(F.array(own))
    out = marked.withColumn("row", F.explode(rows))
    return out.select("doc_id", "seq", "row.sub", "row.type", "ns", "row.name", "data", "public_id", "system_id", "row.attrs")


def lint(stream: DataFrame, require_matching_tags: bool = True) -> DataFrame:
    """Violations (doc_id, seq, sub, problem) of the rules of a token stream; none for a walk of a tree."""
    kind, ns, name, data = F.col("type"), F.col("ns"), F.col("name"), F.col("data")
    void = is_html(ns) & name.isin(*sorted(T.VOID))
    tag = kind.isin("StartTag", "EndTag", "EmptyTag")
    text = kind.isin("Characters", "SpaceCharacters")
    known = kind.isin("StartTag", "EndTag", "EmptyTag", "Comment", "Characters", "SpaceCharacters", "Doctype", "Entity")
    depth = F.sum(F.when(kind == "StartTag", 1).when(kind == "EndTag", -1).otherwise(0)).over(in_order())
    level = F.when(kind == "EndTag", F.col("depth") + 1).otherwise(F.col("depth"))
    pairs = Window.partitionBy("doc_id", "level").orderBy("seq", "sub")
    seen = stream.withColumn("depth", depth).withColumn("level", F.when(kind.isin("StartTag", "EndTag"), level))
    seen = seen.withColumn("opener", F.lag(F.struct("type", "ns", "name")).over(pairs))
    unmatched = (kind == "EndTag") & ~F.coalesce((F.col("opener.type") == "StartTag") & F.col("opener.ns").eqNullSafe(ns) & (F.col("opener.name") == name), F.lit(False))
    problem = (
        F.when(~known, F.lit("unknown token type"))
        .when(tag & (F.coalesce(name, F.lit("")) == ""), F.lit("tag without a name"))
        .when(tag & (ns == ""), F.lit("empty namespace"))
        .when((kind == "StartTag") & void, F.lit("void element as a start tag"))
        .when((kind == "EmptyTag") & ~void, F.lit("empty tag of an element with content"))
        .when((kind == "EndTag") & void, F.lit("end tag of a void element"))
        .when(tag & F.exists("attrs", lambda a: (F.coalesce(a["name"], F.lit("")) == "") | a["value"].isNull() | F.coalesce(a["ns"] == "", F.lit(False))), F.lit("bad attribute"))
        .when((kind == "Comment") & data.isNull(), F.lit("comment without data"))
        .when(text & (F.coalesce(data, F.lit("")) == ""), F.lit("empty text"))
        .when((kind == "SpaceCharacters") & data.rlike(r"[^\t\n\f\r ]"), F.lit("space token with other characters"))
        .when((kind == "Entity") & name.isNull(), F.lit("entity without a name"))
        .when(F.lit(require_matching_tags) & unmatched, F.lit("end tag without its start tag"))
    )
    return seen.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select("doc_id", "seq", "sub", "problem")
