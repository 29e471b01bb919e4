"""Document fingerprints by locally consistent parsing.

A text is a row of symbols (its UTF-8 bytes).  At each level runs of one symbol become one
symbol; deterministic coin tossing gives each symbol a small label from itself and its left
neighbour (twice the lowest bit in which they differ, plus that bit), repeated until labels are
below 8; a phrase begins at each local maximum of the labels; and a phrase's name is a hash of
its symbols.  Names are the next level's symbols.  Where a phrase begins depends on a few
neighbours only, so equal substrings get equal names in their interior, wherever they stand.

The fingerprint keeps the KEEP smallest 32-bit hashes of the distinct names from level LEVEL up
(of the last level, if the text ends before); likeness of two fingerprints is the share of
common hashes among the smallest of their union, an estimate of the resemblance of name sets.

Defined cases: null counts as empty, which has the empty fingerprint; two empty ones have
likeness 1, an empty and another one 0; rows with one id are ordered by a hash of their text (and
by the text); null ids come first; one row alone is its own next; texts are read whole; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import mix64, stored, string_buffers

KEEP = 64
LEVEL = 2
#: Text of about so many bytes is parsed at a time.
BYTES = 1 << 19
#: Range pieces the documents are dealt into hold about so many bytes of text.
PIECE_BYTES = 8 << 20
#: There are at most so many pieces; larger ones are sorted with spilling and read as a stream.
MAX_PIECES = 20_000
#: Keys sampled for the edges, a piece.
SAMPLE = 32

_U = np.uint64
_SYMBOLS = mix64(np.arange(1, 257, dtype=_U))
_LOW = np.full(256, 8, np.uint8)
for _i in range(255, 0, -1):
    _LOW[_i] = (_i & -_i).bit_length() - 1


def _lowest_bit(x: np.ndarray) -> np.ndarray:
    """Place of the lowest set bit of uint64 numbers above 0."""
    return np.bitwise_count(~x & (x - _U(1)))


def _label(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Coin tossing labels below 8, of symbols that differ from their left neighbours.

    A row's first symbol has an invented neighbour that differs from it in the lowest bit.
    """
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[first] = x[first] ^ _U(1)
    bit = _lowest_bit(x ^ left)
    label = (bit << 1) | ((x >> bit.astype(_U)) & _U(1)).astype(np.uint8)
    for _ in range(2):  # below 128, then 14, then 8
        left8 = np.empty_like(label)
        left8[1:] = label[:-1]
        left8[first] = label[first] ^ 1
        bit8 = _LOW[label ^ left8]
        label = (bit8 << 1) | ((label >> bit8) & 1)
    return label


def next_level(x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names of each row and the new bounds.  Rows keep at least one name."""
    n = len(x)
    head = np.zeros(n + 1, bool)
    head[bounds] = True
    new = np.ones(n, bool)
    new[1:] = (x[1:] != x[:-1]) | head[1:n]
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, n))
    with np.errstate(over="ignore"):
        x = np.where(run > 1, mix64(x[at] + run.astype(_U) * _U(0x2545F4914F6CDD1D)), x[at])
    bounds = np.searchsorted(at, bounds)
    m = len(x)
    head = np.zeros(m + 1, bool)
    head[bounds] = True
    # two neighbours can have become equal only by a collision of 64-bit hashes
    x[1:][(x[1:] == x[:-1]) & ~head[1:m]] ^= _U(1)
    first = bounds[:-1][bounds[1:] > bounds[:-1]]
    label = _label(x, first)
    before = np.empty_like(label)
    before[1:] = label[:-1]
    before[first] = 0
    after = np.zeros_like(label)
    after[:-1] = label[1:]
    after[head[1:]] = 0
    begin = (label > before) & (label >= after)
    begin[1:] &= ~begin[:-1] | head[1:m]
    begin[first] = True
    second = first[first + 1 < m] + 1
    second = second[~head[second]]
    begin[second] = False  # the first phrase has two symbols at least
    start = np.flatnonzero(begin)
    place = np.arange(m) - start[np.cumsum(begin) - 1]
    with np.errstate(over="ignore"):
        part = mix64(x + place.astype(_U) * _U(0x9E3779B97F4A7C15))
        total = np.concatenate([np.zeros(1, _U), np.cumsum(part, dtype=_U)])
        end = np.append(start[1:], m)
        name = mix64(total[end] - total[start] + (end - start).astype(_U))
    return name, np.searchsorted(start, bounds)


def sketches(data: np.ndarray, offsets: np.ndarray, keep: int = KEEP, level: int = LEVEL) -> list[np.ndarray]:
    """The smallest distinct hashes of each row's names, in order."""
    n = len(offsets) - 1
    x, bounds = _SYMBOLS[data], offsets
    rows, names = [], []
    alive = np.diff(bounds) > 0
    k = 0
    while len(x):
        last = np.diff(bounds) <= 1
        y, new = next_level(x, bounds)
        k += 1
        done = np.diff(new) <= 1
        of = np.repeat(np.arange(n), np.diff(new))
        take = np.ones(len(y), bool) if k >= level else (done & alive)[of]
        with np.errstate(over="ignore"):
            names.append(mix64(y[take] + _U(k)) >> _U(32) if k >= level else mix64(y[take]) >> _U(32))
        rows.append(of[take])
        stay = (~done & alive & ~last)[of]
        x, sizes = y[stay], np.where(~done & alive & ~last, np.diff(new), 0)
        alive = sizes > 0
        bounds = np.concatenate([[0], np.cumsum(sizes)])
    if not rows:
        return [np.zeros(0, np.uint32)] * n
    key = np.concatenate(rows).astype(_U) << _U(32) | np.concatenate(names)
    key.sort()  # `np.unique` hashes such numbers, which takes several times as long
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    of = (key >> _U(32)).astype(np.int64)
    low = (key & _U(0xFFFFFFFF)).astype(np.uint32)
    edge = np.searchsorted(of, np.arange(n + 1))
    return [low[a : min(b, a + keep)] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def likeness(a: np.ndarray, b: np.ndarray, keep: int = KEEP) -> float:
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:keep]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(both, union[-1], "right")) / len(union)


def to_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row: id and fingerprint (hexadecimal)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches):
        for batch in batches:
            data, offsets = string_buffers(batch.column(1))
            out, lo = [], 0
            while lo < len(offsets) - 1:
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BYTES, "right")) - 1)
                out += [to_text(s) for s in sketches(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])]
                lo = hi
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def _cut(raw: bytes, n: int) -> int:
    """Bytes of the first n code points."""
    return len(raw.decode("utf-8", "replace")[:n].encode()) if n else 0


def _rank(rows, edges) -> np.ndarray:
    """For each row the number of edges that don't lie behind it; both are (known, id, tie), edges in order."""
    n = len(edges[0])
    known, ids, tie = (np.concatenate([e, r]) for e, r in zip(edges, rows, strict=True))
    is_row = np.arange(len(known)) >= n
    order = np.lexsort((is_row, tie, ids, known))
    out = np.empty(len(known), np.int64)
    out[order] = np.cumsum(~is_row[order])
    return out[n:]


def _keys(ids, tie) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known, id, tie) of Arrow columns; null ids are not known and come first."""
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    return known, ids.fill_null(0).to_numpy(zero_copy_only=False), tie.to_numpy(zero_copy_only=False)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece_bytes: int = PIECE_BYTES) -> tuple[DataFrame, str]:
    """Rows (piece, place, id, text), dealt into range pieces of ids, each with what follows it.

    place 0 are the piece's own rows; 1 are the rows that begin the next piece that has any (after
    the last piece: the first one), of which the first follows the piece's last row.

    Edges between pieces are taken from a sample of the keys (id, hash of the text), so one id with
    many texts is split too.  They needn't be exact: what follows a piece is the smallest key that
    really fell into the next one.  The driver gets SAMPLE keys and one first key a piece.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    keys = stored(rows.select("id", "tie", F.octet_length("text").alias("n")))
    size, count = keys.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    pieces = max(1, min(MAX_PIECES, -(-int(size) // piece_bytes)))
    edges = tuple(np.zeros(0, t) for t in (bool, np.int64, np.int64))
    if pieces > 1:
        share = min(1.0, pieces * SAMPLE / count)
        drawn = F.pmod(F.xxhash64(F.lit(5), "id", "tie"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
        found = keys.filter(drawn).select("id", "tie").distinct().toArrow().combine_chunks()
        some = _keys(*(found.column(c).combine_chunks() for c in ("id", "tie")))
        order = np.lexsort((some[2], some[1], some[0]))
        at = order[np.unique(np.arange(1, pieces) * len(order) // pieces)] if len(order) else order
        edges = tuple(x[at] for x in some)

    @F.arrow_udf("int")
    def piece_of(ids: pa.Array, tie: pa.Array) -> pa.Array:
        return pa.array(_rank(_keys(ids, tie), edges), pa.int32())

    first = keys.groupBy(piece_of("id", "tie").alias("piece")).agg(F.min(F.struct("id", "tie")).alias("key")).select("piece", "key.id", "key.tie").toArrow().combine_chunks()
    order = np.argsort(first.column("piece").to_numpy())
    there = first.column("piece").to_numpy()[order]
    heads = tuple(np.zeros(len(edges[0]) + 1, t) for t in (bool, np.int64, np.int64))
    for head, x in zip(heads, _keys(*(first.column(c).combine_chunks() for c in ("id", "tie"))), strict=True):
        head[there] = x[order]
    before = np.zeros(len(edges[0]) + 1, np.int32)
    before[there] = np.roll(there, 1)

    @F.arrow_udf("struct<piece:int,also:int>")
    def places(ids: pa.Array, tie: pa.Array) -> pa.Array:
        own = _keys(ids, tie)
        piece = _rank(own, edges)
        begins = np.logical_and.reduce([x == head[piece] for x, head in zip(own, heads, strict=True)])
        return pa.StructArray.from_arrays([pa.array(piece, pa.int32()), pa.array(before[piece], pa.int32(), mask=~begins)], ["piece", "also"])

    placed = rows.withColumn("at", places("id", "tie"))
    own = F.struct(F.col("at.piece").alias("piece"), F.lit(0).alias("place"))
    more = F.array_compact(F.array(own, F.when(F.col("at.also").isNotNull(), F.struct(F.col("at.also").alias("piece"), F.lit(1).alias("place")))))
    dealt = placed.withColumn("at", F.explode(more)).select("at.piece", "at.place", "id", "tie", "text")
    dealt = dealt.repartitionById(len(edges[0]) + 1, "piece").sortWithinPartitions("piece", "place", F.col("id").asc_nulls_first(), "tie", "text")
    return dealt.select("piece", "place", F.col("id").cast(kind).alias("id"), "text"), kind


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """The query: fingerprints of every text and its edited text, and their likeness.

    A task holds the rows of one stretch of BYTES and the row after it.
    """
    dealt, kind = with_next(docs)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def stretch(ids, raws, follower):
        """Output of the rows, `follower` being the text after the last."""
        n = len(raws)
        every = [*raws, follower]
        counts = [len(r.decode("utf-8", "replace")) for r in every]
        edited = []
        for i in range(n):
            half = counts[i] // 2
            if every[i].isascii() and every[i + 1].isascii():
                edited.append(every[i][: counts[i] - half] + every[i + 1][:half])
            else:
                edited.append((every[i].decode("utf-8", "replace")[: counts[i] - half] + every[i + 1].decode("utf-8", "replace")[:half]).encode())
        joined = [*every, *edited]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in joined])]).astype(np.int64)
        found = sketches(np.frombuffer(b"".join(joined), np.uint8), offsets)
        own, new = found[: n + 1], found[n + 1 :]
        columns = [
            ids,
            pa.array(counts[:n], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
            pa.array([to_text(s) for s in own[:n]], pa.string()),
            pa.array([to_text(s) for s in new], pa.string()),
            pa.array([likeness(own[i], new[i]) for i in range(n)], pa.float64()),
            pa.array([likeness(own[i], own[i + 1]) for i in range(n)], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def work(batches):
        ids, raws, held, piece = [], [], 0, None
        for batch in batches:
            id_column = batch.column(2)
            for j, (p, place, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True)):
                if place == 1:
                    if raws:
                        yield stretch(pa.array(ids, id_column.type), raws, text.as_buffer().to_pybytes())
                        ids, raws, held = [], [], 0
                    continue
                raw = text.as_buffer().to_pybytes()
                if p != piece and raws:
                    raise RuntimeError(f"nothing follows the last row of piece {piece}")
                piece = p
                if held > BYTES:
                    yield stretch(pa.array(ids, id_column.type), raws, raw)
                    ids, raws, held = [], [], 0
                ids.append(id_column[j].as_py())
                raws.append(raw)
                held += len(raw)
        if raws:
            raise RuntimeError(f"nothing follows the last row of piece {piece}")

    return dealt.mapInArrow(work, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
