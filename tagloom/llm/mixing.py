"""Mixing sources to target weights by entropy balancing.

Each document d of source s gets a rate r(d), the one nearest to 1 in Kullback-Leibler distance
with sum over s of r(d) * size(d) equal to the target of s, and r(d) at most `max_copies`.  The
dual is convex in one multiplier a source, and its optimum tilts exponentially:
r(d) = min(max_copies, exp(lambda(s) * size(d) / mean size of s)).  The multipliers come from
distributed Newton steps, kept inside a bracket, over the histogram (source, size, count), which
is exact because a rate depends on source and size alone.  Rates are then rounded to copies:
the fraction is compared with a hash of the document, and the cut of each source is moved, by
histograms of the comparison that are refined thrice, to where the words taken come nearest to
the target.

Defined cases: a null text has size 0; a null source is a source of its own, last in order;
sources without words have target 0; rows that repeat id and text are numbered, and the numbers
drawn for apart, so a large group of them is split at the cut like other rows; null ids are ids
like others; ties in the comparison fall to one side; long texts are counted whole; other columns
are ignored, or kept if `keep` names them; an empty table gives no rows.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import WORD_PATTERN, forget, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2
NEWTON_STEPS = 40
TOLERANCE = 1e-9
BINS = 1024


def word_count(column: Column) -> Column:
    return F.coalesce(F.regexp_count(column, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MAX_COPIES) -> DataFrame:
    """(source, total) to (source, total, target): water-filling by weight under the cap most * total.

    Reads one row a source.  Raising the level until no source is above its cap gives what
    resharing the excess again and again gives; the level is found from prefix sums over the
    sources in the order in which they reach their caps.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    up = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    with_weight = sizes.withColumn("weight", weight).withColumn("cap", F.col("total") * float(most))
    ordered = (
        with_weight.withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("all_words", F.sum("total").over(everything) * float(share))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("full_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("all_words") - F.col("full_before")) / (F.col("all_weight") - F.col("weight_before")))
    )
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(everything)["level"]
    return ordered.withColumn("at", level).select("source", "total", F.least("cap", F.coalesce(F.col("at") * F.col("weight"), F.col("cap"))).alias("target"))


def solve(histogram: DataFrame, wanted: DataFrame, most: float = MAX_COPIES, steps: int = NEWTON_STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """(source, target, lam, mean): Newton on the dual of each source, all sources in one job a step.

    `lam` is null where the target is the cap itself: every rate is then `most`.
    """
    mean = histogram.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    sign = F.col("target") - F.col("total")
    state = wanted.join(mean, wanted["source"].eqNullSafe(mean["source"])).select(wanted["source"], "total", "target", "mean")
    state = state.withColumn("lam", F.when((F.col("target") >= F.col("total") * most * (1 - 1e-12)) & (F.col("total") > 0), F.lit(None)).otherwise(F.lit(0.0)))
    state = state.withColumn("low", F.when(sign >= 0, 0.0).otherwise(F.lit(-745.0) * F.col("mean"))).withColumn("high", F.when(sign <= 0, 0.0).otherwise(F.lit(745.0) * F.col("mean")))
    state = state.withColumn("left", F.abs(sign))
    old = None
    for step in range(steps + 1):
        state = stored(state)
        if old is not None:
            forget(old)
        old = state
        if state.filter(F.col("lam").isNotNull() & (F.col("left") > F.greatest(F.col("target") * tolerance, F.lit(1e-6)))).isEmpty():
            break
        if step == steps:
            warnings.warn(f"the mix's multipliers are not exact after {steps} steps", stacklevel=2)
            break
        x = F.col("size") / F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0)
        rate = F.least(F.exp(F.least(F.col("lam") * x, F.lit(700.0))), F.lit(float(most)))
        words = F.col("n") * F.col("size") * rate
        both = histogram.join(state.filter(F.col("lam").isNotNull()), histogram["source"].eqNullSafe(state["source"])).select(state["source"], "n", "size", "lam", "mean")
        sums = both.groupBy("source").agg(F.sum(words).alias("got"), F.sum(F.when(rate < most, words * x).otherwise(0.0)).alias("slope"))
        moved = state.join(sums.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left")
        gap = F.col("got") - F.col("target")
        low, high = F.when(gap < 0, F.col("lam")).otherwise(F.col("low")), F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        moved_to = F.col("lam") - F.try_divide(gap, F.col("slope"))
        moved = moved.withColumn("left", F.abs(gap)).withColumn("low", low).withColumn("high", high)
        new = F.when(F.col("left") == 0, F.col("lam")).when((moved_to > F.col("low")) & (moved_to < F.col("high")), moved_to).otherwise((F.col("low") + F.col("high")) / 2)
        state = moved.withColumn("lam", F.when(F.col("lam").isNotNull() & F.col("got").isNotNull(), new).otherwise(F.col("lam"))).withColumn("left", F.coalesce("left", F.lit(0.0))).drop("of", "got", "slope")
    return stored(state.withColumn("lam", F.round("lam", 9)))


def _numbered(rows: DataFrame) -> DataFrame:
    """`rows` with draws of their own for rows that repeat id and draw.

    Repeats get the numbers 0, 1, ... in parts of a group, by offsets from the parts' counts, so
    that no group has to fit one task.  Which of them gets which number makes no difference.
    """
    part = F.pmod(F.xxhash64("row"), F.lit(64)).cast("int")
    again = stored(rows.groupBy("id", "draw").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("id").alias("__id"), F.col("draw").alias("__draw")))
    if again.isEmpty():
        return rows
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("draw") == F.col("__draw"))
    repeated = stored(rows.select("id", "draw", "row").join(again, same, "left_semi").withColumn("part", part))
    counts = repeated.groupBy("id", "draw", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("id", "draw").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("id").alias("__id"), F.col("draw").alias("__draw"), F.col("part").alias("__part"), before.alias("before"))
    nth = F.row_number().over(Window.partitionBy("id", "draw", "part").orderBy("row"))
    placed = repeated.withColumn("nth", nth).join(offsets, same & (F.col("part") == F.col("__part"))).select(F.col("row").alias("__row"), (F.col("before") + F.col("nth") - 1).alias("nth"))
    draw = F.when(F.coalesce("nth", F.lit(0)) == 0, F.col("draw")).otherwise((F.pmod(F.xxhash64("draw", "nth"), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52))
    return stored(rows.join(placed, F.col("row") == F.col("__row"), "left").withColumn("draw", draw).drop("__row", "nth"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MAX_COPIES, seed: int = 17, keep: list[str] | None = None) -> DataFrame:
    """One row a document: id, source, size, source_size, target, rate, copies, taken.

    With `keep`, the struct column `kept` holds those columns of the document.
    """
    measured = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.md5(F.coalesce(F.col(text_col), F.lit("")))), F.lit(1 << 52)).cast("double").alias("draw"),
        F.monotonically_increasing_id().alias("row"),
        *([F.struct(*keep).alias("kept")] if keep else []),
    ).withColumn("draw", (F.col("draw") + 0.5) / float(1 << 52))
    measured = _numbered(stored(measured))
    histogram = stored(measured.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    wanted = stored(targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("total")), weights, share, most))
    solved = solve(histogram, wanted, most)
    rates = solved.select(F.col("source").alias("of"), F.col("total").alias("source_size"), "target", "lam", "mean")
    rated = measured.join(rates, F.col("source").eqNullSafe(F.col("of")))
    tilt = F.when(F.col("lam").isNull(), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(F.least(F.lit(700.0), F.col("lam") * F.col("size") / F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0)))))
    rated = rated.withColumn("rate", tilt).withColumn("base", F.floor("rate")).withColumn("z", F.when(F.col("base") >= most, F.lit(2.0)).otherwise(F.col("draw") - (F.col("rate") - F.col("base"))))
    rated = rated.select("id", "source", "size", "source_size", "target", "rate", "base", "z", *(["kept"] if keep else []))
    cuts = _cuts(rated.drop("kept"), wanted)
    final = rated.join(cuts, F.col("source").eqNullSafe(F.col("of")), "left")
    copies = (F.col("base") + F.when(F.col("z") < F.coalesce(F.col("cut"), F.lit(0.0)), 1).otherwise(0)).cast("long")
    final = final.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return final.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "rate", "copies", "taken", *(["kept"] if keep else []))


def _cuts(rated: DataFrame, wanted: DataFrame, levels: int = 4) -> DataFrame:
    """(of, cut): the value of z below which a document of the source gets one copy more.

    z lies in (-1, 1) and 0 would be plain randomised rounding.  Each level splits the bin of z
    in which the target is reached into `BINS` bins and adds up words a source and bin.
    """
    width = 2.0
    base = rated.groupBy("source").agg(F.sum(F.col("base") * F.col("size")).alias("have"))
    state = base.join(wanted.select(F.col("source").alias("of"), "target"), F.col("source").eqNullSafe(F.col("of"))).select("of", (F.col("target") - F.col("have")).alias("need"), F.lit(-1.0).alias("low"))
    state = stored(state)
    for _ in range(levels):
        width /= BINS
        inside = rated.filter(F.col("z") < 2.0).join(state, F.col("source").eqNullSafe(F.col("of"))).filter((F.col("z") >= F.col("low")) & (F.col("z") < F.col("low") + width * BINS))
        bins = inside.groupBy("of", F.least(F.floor((F.col("z") - F.col("low")) / width), F.lit(BINS - 1)).alias("bin")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("at").orderBy("bin")
        sums = bins.withColumnRenamed("of", "at").withColumn("until", F.sum("words").over(run))
        passed = state.join(sums, F.col("of").eqNullSafe(F.col("at")), "left").groupBy("of", "need", "low").agg(
            F.min(F.when(F.col("until") > F.col("need"), F.col("bin"))).alias("bin"),
            F.min(F.when(F.col("until") > F.col("need"), F.struct("bin", (F.col("until") - F.col("words")).alias("before")))).alias("first"),
            F.max("until").alias("all"),
        )
        old, state = state, stored(
            passed.select(
                "of",
                (F.col("need") - F.when(F.col("bin").isNull(), F.coalesce("all", F.lit(0))).otherwise(F.col("first.before"))).alias("need"),
                F.when(F.col("bin").isNull(), F.col("low") + width * BINS).otherwise(F.col("low") + F.col("bin") * width).alias("low"),
                F.when(F.col("bin").isNull(), 0).otherwise(1).alias("open"),
            ).drop("open")
        )
        forget(old)
    # What is left in the last bin is one document as a rule; it goes in if that comes nearer.
    last = rated.filter(F.col("z") < 2.0).join(state, F.col("source").eqNullSafe(F.col("of"))).filter((F.col("z") >= F.col("low")) & (F.col("z") < F.col("low") + width)).groupBy("of", "need", "low").agg(F.sum("size").alias("words"))
    last = last.select(F.col("of").alias("at"), F.when(F.abs(F.col("words") - F.col("need")) < F.abs("need"), F.col("low") + width).otherwise(F.col("low")).alias("edge"))
    return stored(state.join(last, F.col("of").eqNullSafe(F.col("at")), "left").select("of", F.coalesce("edge", "low").alias("cut")))
