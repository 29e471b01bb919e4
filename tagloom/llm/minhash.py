"""Near-duplicate classes by DartMinHash.

A text is a weighted set: its shingles of five words (lower-cased A-Z; a text of one to four
words is one shingle) with the number of times each occurs.  DartMinHash throws random darts
into the plane weight x rank of every element, each dart assigned to one of K coordinates by its
hash; a text owns the darts below its weights, and its signature keeps the earliest rank a
coordinate.  Two texts agree on a coordinate with the probability of their weighted Jaccard
similarity.  Darts come from hashes of (element, unit of weight, unit of rank), a Poisson number
each, so a text only looks at the few cells with ranks below t / weight, where t darts fill all
coordinates as a rule; where one stays empty, t is doubled.

Signatures are joined in BANDS bands of ROWS coordinates.  Exact copies are one row from the
start.  In each bucket all members are compared with its hub, the member with most company over
all bands; what is not yet in one component with the rest of its bucket is then compared with
every other member of that bucket: pairwise in small buckets, block against block in large ones.
Each link is checked on the full weighted sets, so no link comes from chance, and one is lost only
if no band agrees (3 in a million at similarity 0.8).  Components of links are classes.

Inside, a text is named by a 64-bit hash, not by an id; ids only name classes at the end.

Defined cases: null texts are classes of their own; equal texts, empty ones included, are one
class; texts without words have no other link; the class id is the smallest id in the class, null
if all its ids are; texts of one id are told apart; rows that repeat id and text give repeated
results; ties of ids are broken by the text's hash; long texts are compared whole; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import VALUES_LOWER, forget, mix64, sieve, span_hashes, split_join, stored, text_slices, words

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
K = BANDS * ROWS
DARTS = K * np.log(K) + 2 * K
#: Buckets of at most so many members emit their open pairs, larger ones compare blocks.
SMALL_BUCKET = 16
BLOCK = 256

_U = np.uint64
#: Poisson(1) distribution function at 0, 1, 2, ...; the last entry is 1 within 64 bits.
_POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1.0, i + 1)) for i in range(18)])
_FRACTION = 32


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes of each row, repeats included, and each row's bounds."""
    starts, ends, bounds = words(data, offsets)
    h = span_hashes(data, starts, ends, VALUES_LOWER)
    n = np.diff(bounds)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    out_bounds = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    at = bounds[:-1][row] + np.arange(len(row)) - out_bounds[:-1][row]
    total = np.zeros(len(row), _U)
    padded = np.concatenate([h, np.zeros(SHINGLE, _U)])
    with np.errstate(over="ignore"):
        for j in range(SHINGLE):
            inside = j < n[row]
            total = total * _U(0x9E3779B97F4A7C15) + np.where(inside, padded[at + j], _U(j + 1))
        out = mix64(total)
    for a, b in zip(out_bounds[:-1].tolist(), out_bounds[1:].tolist(), strict=True):
        out[a:b].sort()
    return out, out_bounds


def cells(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One hash for each element and unit of its weight: the weighted set as a plain one."""
    s, bounds = shingles(data, offsets)
    if len(s) == 0:
        return s, bounds
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    new[bounds[:-1][bounds[:-1] < len(s)]] = True
    at = np.arange(len(s))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    with np.errstate(over="ignore"):
        return mix64(s + nth.astype(_U) * _U(0xD6E8FEB86659FD93)), bounds


def _throw(cell: np.ndarray, row: np.ndarray, theta: np.ndarray, n: int) -> np.ndarray:
    """Earliest rank a row and coordinate among the darts of rank below theta (fixed point)."""
    none = np.iinfo(np.int64).max
    signature = np.full(n * K, none, np.int64)
    steps = np.ceil(theta).astype(np.int64)[row]
    which = np.repeat(np.arange(len(cell)), steps)
    step = np.arange(len(which)) - np.repeat(np.cumsum(steps) - steps, steps)
    with np.errstate(over="ignore"):
        h = mix64(cell[which] + (step.astype(_U) + _U(1)) * _U(0xA0761D6478BD642F))
        darts = np.searchsorted(_POISSON, (h >> _U(11)).astype(np.float64) / float(1 << 53), "right")
        of = np.repeat(np.arange(len(h)), darts)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(darts) - darts, darts)
        g = mix64(h[of] + (nth.astype(_U) + _U(1)) * _U(0xE7037ED1A0B428DB))
    rank = (step[of] << _FRACTION) + (g >> _U(32)).astype(np.int64)
    owner = row[which[of]]
    keep = rank < (theta[owner] * float(1 << _FRACTION)).astype(np.int64)
    place = owner[keep] * K + ((g[keep] & _U(0xFFFFFFFF)) % _U(K)).astype(np.int64)
    np.minimum.at(signature, place, rank[keep])
    return signature.reshape(n, K)


def signatures(cell: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(rows, K) earliest ranks.  Rows without cells keep the largest number everywhere."""
    n = len(bounds) - 1
    weight = np.diff(bounds)
    out = np.full((n, K), np.iinfo(np.int64).max, np.int64)
    todo, t = np.flatnonzero(weight > 0), DARTS
    while len(todo):
        pick = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in todo])
        row = np.repeat(np.arange(len(todo)), weight[todo])
        found = _throw(cell[pick], row, t / weight[todo], len(todo))
        full = (found < np.iinfo(np.int64).max).all(axis=1)
        out[todo[full]] = found[full]
        todo, t = todo[~full], t * 2
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(rows, BANDS) keys; equal where all coordinates of a band are."""
    x = signature.view(_U).reshape(len(signature), BANDS, ROWS)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U) * _U(0x8EBC6AF09C88C6E3), x.shape[:2]).copy()
        for j in range(ROWS):
            key = mix64(key * _U(0x589965CC75374CC3) + x[:, :, j])
    return key.view(np.int64)


def text_node(text) -> F.Column:
    """The number of a text: equal for equal texts, null for null."""
    return F.when(text.isNotNull(), F.xxhash64(text))


def _sketches(rows: DataFrame) -> DataFrame:
    """id, node, weight, bands (empty for texts without words) of rows (id, node, text)."""

    def sketch(batches):
        for batch in batches:
            weights, keys = [np.zeros(0, np.int64)], [np.zeros((0, BANDS), np.int64)]
            for _, data, offsets in text_slices(batch.column(2)):
                c, bounds = cells(data, offsets)
                weights.append(np.diff(bounds))
                keys.append(band_keys(signatures(c, bounds)))
            weight, key = np.concatenate(weights), np.concatenate(keys)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(weight > 0, BANDS, 0))]).astype(np.int32)), pa.array(key[weight > 0].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(weight), lists], names=["id", "node", "weight", "bands"])

    return rows.mapInArrow(sketch, "id long, node long, weight long, bands array<bigint>")


def _full_sets(rows: DataFrame) -> DataFrame:
    """id, cells (sorted 32-bit hashes) of rows (id, text)."""

    def sets(batches):
        for batch in batches:
            out = []
            for _, data, offsets in text_slices(batch.column(1)):
                c, bounds = cells(data, offsets)
                short = (c >> _U(32)).astype(np.uint32)
                out += [np.sort(short[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "cells"])

    return rows.mapInArrow(sets, "id long, cells binary")


def likeness(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two full sets."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    both = len(np.intersect1d(x, y))
    return both / max(1, len(x) + len(y) - both)


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of distinct pairs (a, b, weights fit already), those with the similarity.

    The set of `a` travels with the pair to the set of `b`; a hub with many pairs stands at `b`,
    where a skewed join is split.
    """

    def check(batches):
        for batch in batches:
            keep = [likeness(x, y) >= least for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = pairs.join(sets.select(F.col("id").alias("a"), F.col("cells").alias("x")), "a")
    both = first.join(sets.select(F.col("id").alias("b"), F.col("cells").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, component): smallest id reachable over links (a, b), by large-star and small-star steps.

    Each step is two joins or aggregates by id; nothing is gathered on the driver.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stored(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        old, edges = edges, stored(small.filter("u <> v").distinct())
        forget(old, large)
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))


def text_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(classes, rows) of the texts that aren't null.

    classes: one row a distinct text: node, copy_of (smallest id with the text), n (rows with it),
    links (texts it was found alike with), class_id (smallest id of the class), first (whether it
    stands for its class: the text of the smallest id).  rows: id and node of each row.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull()).withColumn("node", text_node(F.col("text")))
    sketches = stored(_sketches(rows.select("id", "node", "text")))
    texts = stored(sketches.groupBy("node").agg(F.min("id").alias("copy_of"), F.count(F.lit(1)).alias("n"), F.first("weight").alias("weight"), F.first("bands").alias("bands")))
    buckets = stored(_buckets(texts.select(F.col("node").alias("rep"), "weight", "bands")))
    hubs = buckets.filter("rep <> hub").filter(_fits("weight", "hub_weight", least)).select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    sets = _candidate_sets(rows, texts, buckets)
    links = stored(_verified(hubs, sets, least))
    links = stored(links.union(_open_links(buckets, components(links), sets, least)))
    found = components(links).withColumnRenamed("id", "node")
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    named = texts.select("node", "copy_of", "n").join(found, "node", "left").join(degree, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = stored(named.withColumn("links", F.coalesce("links", F.lit(0))))
    # one row a class; ids that are null come last
    top = named.groupBy("component").agg(F.min(F.struct(F.col("copy_of").isNull(), "copy_of", "node")).alias("top")).select("component", F.col("top.copy_of").alias("class_id"), F.col("top.node").alias("top"))
    return named.join(top, "component").select("node", "copy_of", "n", "links", "class_id", (F.col("node") == F.col("top")).alias("first")), sketches.select("id", "node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row a row of `docs`: id, class_id (smallest id of the class), copy_of (smallest id with the same text), links (other texts it was found alike with)."""
    classes, rows = text_classes(docs, id_col, text_col, least)
    texts = split_join(rows, stored(classes), "node", "id").select(F.col("id").alias(id_col), "class_id", "copy_of", "links")
    nulls = docs.filter(F.col(text_col).isNull()).select(F.col(id_col).cast("long").alias(id_col)).select(id_col, F.col(id_col).alias("class_id"), F.col(id_col).alias("copy_of"), F.lit(0).cast("long").alias("links"))
    return texts.unionByName(nulls)


def first_of_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each class one row, that of its smallest id; rows with null texts stay."""
    classes, _ = text_classes(docs, id_col, text_col, least)
    stay = classes.filter("first").select(F.col("node").alias("__stay"), F.col("copy_of").alias("__low"))
    named = docs.withColumn("__node", text_node(F.col(text_col).cast("string")))
    same = (F.col("__node") == F.col("__stay")) & F.col(id_col).cast("long").eqNullSafe(F.col("__low"))
    kept = named.join(stay, same, "left_semi").dropDuplicates([id_col, "__node"]).drop("__node")
    return kept.union(docs.filter(F.col(text_col).isNull()))


def _fits(x: str, y: str, least: float):
    """The similarity is at most the quotient of the weights."""
    return F.least(x, y) >= F.greatest(x, y) * least


def _buckets(classes: DataFrame) -> DataFrame:
    """(key, rep, weight, m, hub, hub_weight) for each member of each bucket with company."""
    member = classes.select("rep", "weight", F.explode("bands").alias("key"))
    size = member.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    member = stored(member.join(size, "key"))
    company = member.groupBy("rep").agg(F.sum("m").alias("company"))
    ranked = member.join(company, "rep")
    hub = ranked.groupBy("key").agg(F.max(F.struct("company", F.bitwise_not("rep").alias("other"), "weight")).alias("top"))
    hub = hub.select("key", F.bitwise_not("top.other").alias("hub"), F.col("top.weight").alias("hub_weight"))
    return member.join(hub, "key")


def _candidate_sets(rows: DataFrame, texts: DataFrame, buckets: DataFrame) -> DataFrame:
    """Full sets of the texts that share a bucket, written once; read from the row of the smallest id.

    Rows pass a sieve where they are read, so texts are never dealt out, however many ids there are;
    sets of rows that passed by chance go at the end.
    """
    ids = stored(buckets.select("rep").distinct().join(texts.select(F.col("node").alias("rep"), "copy_of"), "rep"))
    some = sieve(rows, F.xxhash64("node", "id"), ids, F.xxhash64("rep", "copy_of"))
    sets = _full_sets(some.select(F.col("node").alias("id"), "text")).dropDuplicates(["id"])
    return stored(sets.join(ids.select(F.col("rep").alias("id")), "id", "left_semi"))


def _open_links(buckets: DataFrame, found: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links between members of one bucket that the hubs left in different components."""
    labelled = buckets.select("key", "rep", "weight", "m").join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    labelled = stored(labelled)
    parts = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    top = parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", F.bitwise_not("component").alias("other"))).alias("top"), F.sum("n").alias("all")).filter("parts > 1")
    top = top.select("key", F.bitwise_not("top.other").alias("main"), (F.col("all") - F.col("top.n")).alias("n_open"))
    mixed = stored(labelled.join(top, "key").withColumn("open", F.col("component") != F.col("main")))
    small = mixed.filter(F.col("m") <= SMALL_BUCKET)
    x, y = small.filter("open").alias("x"), small.alias("y")
    differ = (F.col("x.component") != F.col("y.component")) & (~F.col("y.open") | (F.col("x.rep") < F.col("y.rep")))
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & differ & _fits("x.weight", "y.weight", least))
    pairs = pairs.select(F.greatest("x.rep", "y.rep").alias("a"), F.least("x.rep", "y.rep").alias("b")).distinct()
    large = mixed.filter(F.col("m") > SMALL_BUCKET)
    return _verified(pairs, sets, least).union(_block_links(large, sets, least))


def _block_links(large: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Open members of large buckets against all members: a group is BLOCK members and BLOCK open ones.

    Members are copied to each block of open ones of their bucket and the other way round; pairs
    are never written out, only links are.
    """
    cut = lambda n: F.ceil(F.col(n) / F.lit(BLOCK)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    row = large.withColumn("rows", cut("m")).withColumn("columns", cut("n_open"))
    full = row.join(sets.select(F.col("id").alias("rep"), "cells"), "rep")
    members = full.select("key", F.pmod(F.xxhash64("rep", "key"), F.col("rows")).cast("int").alias("i"), each("columns").alias("j"), "rep", "component", "cells")
    again = full.filter("open").select(*[F.col(c).alias(c) for c in full.columns])  # own columns, as cogroup needs
    opens = again.select("key", each("rows").alias("i"), F.pmod(F.xxhash64("key", "rep"), F.col("columns")).cast("int").alias("j"), "rep", "component", "cells")

    def compare(key, left, right):
        ours = [(r, c, np.frombuffer(x, np.uint32)) for r, c, x in zip(left["rep"].to_pylist(), left["component"].to_pylist(), left["cells"].to_pylist(), strict=True)]
        sizes = np.array([len(x) for _, _, x in ours])
        parts = np.array([c for _, c, _ in ours])
        flat = np.concatenate([x for _, _, x in ours]) if ours else np.zeros(0, np.uint32)
        of = np.repeat(np.arange(len(ours)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, of = flat[order], of[order]
        a, b = [], []
        for rep, component, x in zip(right["rep"].to_pylist(), right["component"].to_pylist(), right["cells"].to_pylist(), strict=True):
            own = np.frombuffer(x, np.uint32)
            lo, hi = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
            n = hi - lo
            hit = of[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            both = np.bincount(hit, minlength=len(ours))
            like = both / np.maximum(1, sizes + len(own) - both)
            for i in np.flatnonzero((like >= least) & (parts != component)):
                a.append(rep)
                b.append(ours[i][0])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return members.groupBy("key", "i", "j").cogroup(opens.groupBy("key", "i", "j")).applyInArrow(compare, "a long, b long")


def dedup_report(docs: DataFrame) -> DataFrame:
    """The query: the class of every document."""
    return near_duplicates(docs).select("doc_id", "class_id", "copy_of", "links")
