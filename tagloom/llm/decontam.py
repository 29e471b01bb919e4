"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of WINDOW words, STRIDE apart, as TF-IDF vectors over hashed words; inverse
document frequencies come from all documents.  A randomised singular value decomposition of the
benchmark's passages, by subspace iteration with sums over partitions, gives a latent space of RANK to MAX_RANK dimensions.  Every window of
every document is projected; its cosine with each benchmark passage in that space makes
candidates.  A candidate is then read word by word: the longest common
subsequence of the benchmark text and the document around the window must hold most of the text
(or of one of its passages), or, for a paraphrase, a good part of the text and nearly all of its
answer, its last sentence.

The benchmark is the query set; it is searched in blocks of BLOCK passages or BLOCK_WORDS words,
one scan of the documents each.  Words are compared in lower case (A-Z) without outer punctuation.
A candidate around which too few of the item's words occur at all, or in order, is dropped before it is
read: first by signatures of the words in each stretch, then by the words, then by the longest
common subsequence of many candidates side by side.  That changes no result.

Defined cases: null and empty texts match nothing on either side; null ids are ids like others;
an empty table on either side gives no rows; of windows that tie for an item, the first counts;
other columns are ignored; benchmark texts of fewer than
LEAST words count as too short to tell and match nothing; repeated rows give repeated results
for documents and one for benchmark rows of one id and text; long texts are searched whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import VALUES_LOWER, boundaries, mix64, span_hashes, stored, summed_blocks, text_slices, words

BITS = 18
WINDOW, STRIDE = 24, 12
#: The latent space has a dimension for 16 passages, within these bounds.
RANK, MAX_RANK = 128, 512
EXTRA, POWER = 10, 2
COSINE = 0.5
LEAST = 6
#: Shares of the text, of one passage, and of text and answer of a paraphrase, that must be found.
COPIED, PASSAGE, PARAPHRASED, ANSWER = 0.6, 0.75, 0.45, 0.8
#: Passages, and words of their items, that one scan of the documents looks for.
BLOCK, BLOCK_WORDS = 16384, 1 << 20
SLICE = 1 << 18
#: Cosines held at a time, and words of candidates looked at at a time.
DENSE, FLAT = 1 << 21, 1 << 20
#: Bits of a signature, and the stretches on each side of a window that it is made for.
SIGNATURE, REACH = 512, 8

_WORDLIKE = np.zeros(256, bool)
_WORDLIKE[48:58] = _WORDLIKE[65:91] = _WORDLIKE[97:123] = _WORDLIKE[128:] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word without its outer ASCII punctuation (whole if it is nothing else), and row bounds."""
    starts, ends, bounds = words(data, offsets)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), bounds
    like = np.flatnonzero(_WORDLIKE[data])
    a, b = starts.copy(), ends.copy()
    left, right = np.flatnonzero(~_WORDLIKE[data[starts]]), np.flatnonzero(~_WORDLIKE[data[ends - 1]])
    a[left] = np.append(like, len(data))[np.searchsorted(like, starts[left])]
    b[right] = np.append(-1, like)[np.searchsorted(like, ends[right])] + 1
    none = left[a[left] >= ends[left]]
    a[none], b[none] = starts[none], ends[none]
    return span_hashes(data, a, b, VALUES_LOWER), bounds


def buckets_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _marks(mine: list[int]) -> dict[int, int]:
    """The places of each word as bits."""
    marks: dict[int, int] = {}
    for i, w in enumerate(mine):
        marks[w] = marks.get(w, 0) | 1 << i
    return marks


def _lcs(marks: dict[int, int], n: int, other: list[int]) -> int:
    full = (1 << n) - 1
    s = full
    for w in other:
        if u := s & marks.get(w, 0):
            s = (s + u | s - u) & full
    return n - s.bit_count()


def lcs(mine: list[int], other: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over `mine`."""
    return _lcs(_marks(mine), len(mine), other)


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Number of documents with a word of each bucket, and of documents.  2**BITS sums."""
    slots = 8

    def count(batches):
        total, n = np.zeros(1 << BITS), 0
        for batch in batches:
            for _, data, offsets in text_slices(batch.column(0), SLICE):
                h, bounds = word_hashes(data, offsets)
                kind = np.uint32 if len(offsets) <= 1 << 32 - BITS else np.uint64  # short numbers sort faster
                key = np.repeat(np.arange(len(offsets) - 1, dtype=kind) << kind(BITS), np.diff(bounds)) | buckets_of(h).astype(kind)
                key.sort()
                new = np.ones(len(key), bool)
                new[1:] = key[1:] != key[:-1]
                total += np.bincount((key[new] & kind((1 << BITS) - 1)).astype(np.int64), minlength=1 << BITS)
                n += len(offsets) - 1
        parts = [np.append(p, n / slots).tobytes() for p in np.split(total, slots)]
        yield pa.RecordBatch.from_arrays([pa.array(range(slots), pa.int32()), pa.array([int(total.sum()) % 9973] * slots, pa.int32()), pa.array(parts, pa.binary())], names=["slot", "part", "data"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "slot int, part int, data binary")
    found = sorted((r["slot"], np.frombuffer(r["data"], np.float64)) for r in summed_blocks(rows).collect())
    if not found:
        return np.zeros(1 << BITS), 0
    return np.concatenate([v[:-1] for _, v in found]), int(round(sum(v[-1] for _, v in found)))


def windows_of(n: int) -> list[tuple[int, int]]:
    """Word ranges of a benchmark text's passages; the last one ends with the text."""
    if n <= WINDOW:
        return [(0, n)]
    starts = list(range(0, n - WINDOW, STRIDE)) + [n - WINDOW]
    return [(s, s + WINDOW) for s in starts]


def benchmark_items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item, words binary (hashes of the whole text), answer (where it begins), one row a distinct item and text."""
    kind = benchmark.schema[id_col].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            out: list[tuple] = []
            for lo, data, offsets in text_slices(batch.column(1)):
                h, bounds = word_hashes(data, offsets)
                _, ends, _ = words(data, offsets)
                for i in range(len(offsets) - 1):
                    a, b = bounds[i], bounds[i + 1]
                    if b - a < LEAST:
                        continue
                    stops = np.flatnonzero(np.isin(data[ends[a : b - 1] - 1], [46, 33, 63])) + 1  # words after . ! ?
                    answer = int(stops[-1]) if len(stops) else int((b - a) * 3 // 4)
                    out.append((batch.column(0)[lo + i].as_py(), h[a:b].tobytes(), answer))
            columns = list(zip(*out, strict=True)) if out else [()] * 3
            types = [batch.schema.field(0).type, pa.binary(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["item", "words", "answer"])

    rows = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text")).distinct()
    return rows.mapInArrow(cut, f"item {kind}, words binary, answer int")


def passages_of(items: DataFrame) -> DataFrame:
    """words binary: the words of each passage, one row a passage."""

    def cut(batches):
        for batch in batches:
            out = []
            for w in batch.column(0).to_pylist():
                out += [w[8 * s : 8 * e] for s, e in windows_of(len(w) // 8)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["words"])

    return items.select("words").mapInArrow(cut, "words binary")


def passage_vector(h: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and TF-IDF values of a passage."""
    key, n = np.unique(buckets_of(h), return_counts=True)
    return key, n * idf[key]


def latent_space(passages: DataFrame, idf: np.ndarray, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """(column of each bucket or -1, right singular vectors): randomised SVD by subspace iteration.

    The matrix stays in partitions of `passages`; each step adds up one product of it.  The
    driver holds (buckets the benchmark uses, at most 2**BITS) x (rank + EXTRA) numbers.
    """
    context = passages.sparkSession.sparkContext
    sent_idf = context.broadcast(idf)

    def used(batches):
        mark = np.zeros(1 << BITS, bool)
        for batch in batches:
            for w in batch.column(0).to_pylist():
                mark[buckets_of(np.frombuffer(w, np.uint64))] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(mark).astype(np.int32))], names=["bucket"])

    ids = np.array(sorted(r["bucket"] for r in passages.mapInArrow(used, "bucket int").distinct().collect()), np.int64)
    column = np.full(1 << BITS, -1, np.int32)
    column[ids] = np.arange(len(ids))
    width = min(rank + EXTRA, max(1, len(ids)))
    sent_column = context.broadcast(column)

    def rows_of(batch):
        for w in batch.column(0).to_pylist():
            key, value = passage_vector(np.frombuffer(w, np.uint64), sent_idf.value)
            yield sent_column.value[key], value / max(np.linalg.norm(value), 1e-12)

    step = max(1, (1 << 20) // width)

    def product(q: np.ndarray, inner: bool) -> np.ndarray:
        """A'A q, or the width x width matrix (A q)'(A q)."""
        sent = context.broadcast(q)

        def add(batches):
            total = np.zeros((width, width) if inner else q.shape)
            for batch in batches:
                for at, value in rows_of(batch):
                    y = value @ sent.value[at]
                    if inner:
                        total += np.outer(y, y)
                    else:
                        total[at] += np.outer(value, y)
            for slot, a in enumerate(range(0, len(total), step)):
                block = total[a : a + step]
                if block.any():
                    yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([int(abs(block).sum() * 1e3) % 9973], pa.int32()), pa.array([block.tobytes()], pa.binary())], names=["slot", "part", "data"])

        out = np.zeros((width, width) if inner else q.shape)
        for r in summed_blocks(passages.mapInArrow(add, "slot int, part int, data binary")).toLocalIterator():
            block = np.frombuffer(r["data"], np.float64).reshape(-1, width)
            out[r["slot"] * step : r["slot"] * step + len(block)] = block
        sent.destroy()
        return out

    q = np.linalg.qr(np.random.default_rng(11).standard_normal((len(ids), width)))[0] if len(ids) else np.zeros((0, width))
    for _ in range(POWER if len(ids) else 0):
        q = np.linalg.qr(product(q, False))[0]
    if len(ids) == 0:
        return column, q
    value, vector = np.linalg.eigh(product(q, True))
    keep = np.argsort(-value)[:rank]
    keep = keep[value[keep] > 1e-9]
    return column, q @ vector[:, keep]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rank: int | None = None, cosine: float = COSINE) -> DataFrame:
    """One row a document and benchmark item found in it: ids, cosine, lcs, passage and answer shares, start and stop (words)."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {kind}, item {item_kind}, cosine double, lcs double, passage double, answer double, start long, stop long"
    items = stored(benchmark_items(benchmark, item_col, item_text_col))
    passages = stored(passages_of(items))
    n_passages = passages.count()
    frequency, n_docs = document_frequencies(docs, text_col)
    idf = np.log((1.0 + n_docs) / (1.0 + frequency)) + 1e-3
    column, space = latent_space(passages, idf, rank or min(MAX_RANK, max(RANK, n_passages // 16)))
    context = docs.sparkSession.sparkContext
    # a row of zeros at the end takes the words that the benchmark doesn't use
    used = np.flatnonzero(column >= 0)
    weighted = np.vstack([space * idf[used][:, None], np.zeros((1, space.shape[1]))]).astype(np.float32)
    model = context.broadcast((np.where(column >= 0, column, len(used)).astype(np.int32), weighted))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    n_words = items.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0] // 8
    blocks = max(1, -(-n_passages // BLOCK), -(-n_words // BLOCK_WORDS))
    found = None
    for b in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == b) if blocks > 1 else items
        queries = []
        for r in own.orderBy("item", "words").collect():
            w = np.frombuffer(r["words"], np.uint64).tolist()
            queries += [(r["item"], s, e, w, r["answer"]) for s, e in windows_of(len(w))]  # the passages share one list
        part = rows.mapInArrow(_searcher(context.broadcast(queries), model, cosine), schema)
        found = part if found is None else found.unionByName(part)
    return found.withColumnRenamed("id", id_col).withColumnRenamed("item", item_col)


class _Passages:
    """What a task needs of a block of passages: latent vectors, words, and which words an item has."""

    def __init__(self, listed, column: np.ndarray, weighted: np.ndarray):
        self.listed, self.column, self.weighted = listed, column, weighted
        self.none = len(weighted) - 1
        kinds = [column[buckets_of(np.array(w, np.uint64))] for _, _, _, w, _ in listed]
        latent = np.array([weighted[k[s:e]].sum(axis=0) for k, (_, s, e, _, _) in zip(kinds, listed, strict=True)])
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
        self.latent = np.ascontiguousarray(latent.T)
        self.length = np.array([len(w) for _, _, _, w, _ in listed], np.int64)
        # as many words must be found, in order, for any of the three rules
        whole = np.ceil(self.length * min(COPIED, PARAPHRASED) - 1e-9).astype(np.int64)
        part = np.array([int(np.ceil((e - s) * PASSAGE - 1e-9)) if e - s >= WINDOW else 1 << 40 for _, s, e, _, _ in listed], np.int64)
        self.need = np.minimum(whole, part)
        numbers: dict = {}
        self.item = np.array([numbers.setdefault(id(x[3]), len(numbers)) for x in listed], np.int64)
        texts = {i: np.array(w, np.uint64) for i, (_, _, _, w, _) in zip(self.item.tolist(), listed, strict=True)}
        self.words = np.unique(np.concatenate(list(texts.values())))
        # the number of a word by its class; several words of a class are told apart by their hashes
        self.guess = np.zeros(self.none + 1, np.int64)
        self.guess[column[buckets_of(self.words)]] = np.arange(len(self.words))
        self.item_need = np.full(len(numbers), 1 << 40, np.int64)
        np.minimum.at(self.item_need, self.item, self.need)
        self.item_length = np.array([len(texts[i]) for i in range(len(numbers))], np.int64)
        keys, times, marks = [], [], []
        for i in range(len(numbers)):
            word, at, n = np.unique(np.searchsorted(self.words, texts[i]), return_inverse=True, return_counts=True)
            keys.append(i * np.int64(len(self.words)) + word)
            times.append(n)
            bits = np.zeros(len(word), np.uint64)
            if len(at) <= 64:
                np.bitwise_or.at(bits, at, np.uint64(1) << np.arange(len(at), dtype=np.uint64))
            marks.append(bits)
        self.keys, self.times, self.places = np.concatenate(keys), np.concatenate(times), np.concatenate(marks)
        # a filter before the search in `keys`: most words of a text are not the item's
        bits = max(16, int(len(self.keys) * 32).bit_length())
        self.mask = np.uint32((1 << bits) - 1)
        rng = np.random.default_rng(5)
        self.word_mix = rng.integers(0, 1 << 32, len(self.words), np.uint32)
        self.item_mix = rng.integers(0, 1 << 32, len(numbers), np.uint32)
        item, word = np.divmod(self.keys, len(self.words))
        self.filter = np.zeros(1 << bits, bool)
        self.filter[(self.word_mix[word] ^ self.item_mix[item]) & self.mask] = True
        self.signatures = signed(item, self.word_mix[word], len(numbers))
        # words of an item that its signature doesn't show, and stretches that they may lie beside a window
        self.hidden = self.item_length - np.bitwise_count(self.signatures).sum(axis=1, dtype=np.int64)
        self.reach = -(-self.item_length // STRIDE)
        self.marks = [(_marks(w), _marks(w[s:e]), _marks(w[a:])) for _, s, e, w, a in listed]

    def numbered(self, h: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The number of each word of the block's items, -1 for others."""
        out = self.guess[kind]
        other = np.flatnonzero(self.words[out] != h)
        at = np.minimum(np.searchsorted(self.words, h[other]), len(self.words) - 1)
        out[other] = np.where(self.words[at] == h[other], at, -1)
        return out

    def likely(self, stretches: np.ndarray, window: np.ndarray, pair: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Of pairs of a window (its number in `window`, stretches of words) and an item, those whose signatures share enough."""
        keep = self.reach[item] > REACH  # too long for a signature
        around = None
        for r in range(REACH + 1):
            for at in (window - r, window + 1 + r):
                more = stretches[np.clip(at, 0, len(stretches) - 1)]
                around = more if around is None else around | more
            some = np.flatnonzero(self.reach[item] == r)
            if len(some):
                i = item[some]
                common = np.bitwise_count(around[pair[some]] & self.signatures[i]).sum(axis=1, dtype=np.int64)
                keep[some] = common + self.hidden[i] >= self.item_need[i]
        return np.flatnonzero(keep)

    def enough(self, word: np.ndarray, mixed: np.ndarray, item: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of pairs of an item and words a..b, those in which enough of the item's words occur, in order if it has 64 at most."""
        out = []
        ends = np.cumsum(b - a)
        lo = 0
        while lo < len(item):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + FLAT, "right")))
            x, size, own = a[lo:hi], (b - a)[lo:hi], item[lo:hi]
            before = np.cumsum(size) - size
            at = np.repeat(x - before, size) + np.arange(size.sum())
            maybe = np.flatnonzero(self.filter[(mixed[at] ^ np.repeat(self.item_mix[own], size)) & self.mask])
            pair = np.searchsorted(before, maybe, "right") - 1
            key = own[pair] * np.int64(len(self.words)) + word[at[maybe]]
            slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[slot] == key)
            pair, slot = pair[hit], slot[hit]
            each, n = np.unique(pair * np.int64(len(self.keys)) + slot, return_counts=True)
            found = np.bincount(each // len(self.keys), np.minimum(n, self.times[each % len(self.keys)]), hi - lo)
            keep = found >= self.item_need[own]
            short = np.flatnonzero(keep & (self.item_length[own] <= 64))
            first, last = np.searchsorted(pair, short), np.searchsorted(pair, short, "right")
            keep[short] = lcs_many(self.places[slot], first, last - first, self.item_length[own[short]]) >= self.item_need[own[short]]
            out.append(lo + np.flatnonzero(keep))
            lo = hi
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def signed(row: np.ndarray, mix: np.ndarray, rows: int) -> np.ndarray:
    """SIGNATURE bits a row, in which each of its words sets one."""
    bit = mix.astype(np.int64) % SIGNATURE
    out = np.zeros(rows * (SIGNATURE // 64), np.uint64)
    np.bitwise_or.at(out, row * (SIGNATURE // 64) + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return out.reshape(rows, -1)


def lcs_many(marks: np.ndarray, first: np.ndarray, n: np.ndarray, length: np.ndarray) -> np.ndarray:
    """`lcs` of many pairs side by side: the marks of a pair's words are marks[first:first + n]; length is 64 at most."""
    order = np.argsort(-n, kind="stable")
    first, n = first[order], n[order]
    full = ~np.uint64(0) >> (64 - length[order]).astype(np.uint64)
    s = full.copy()
    for i, k in enumerate(np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), "left").tolist()):
        u = s[:k] & marks[first[:k] + i]
        s[:k] = (s[:k] + u) | (s[:k] - u)  # bits past the length never come back down
    out = np.empty(len(order), np.int64)
    out[order] = length[order] - np.bitwise_count(s & full)
    return out


def _searcher(queries, model, cosine: float):
    def search(batches):
        if not queries.value:
            return
        block = _Passages(queries.value, *model.value)
        names = ["id", "item", "cosine", "lcs", "passage", "answer", "start", "stop"]
        for batch in batches:
            out: list[tuple] = []
            for lo, data, offsets in text_slices(batch.column(1), SLICE):
                h, bounds = word_hashes(data, offsets)
                for i, hits in _candidates(h, bounds, block, cosine):
                    text = h[bounds[i] : bounds[i + 1]]
                    for item, *values in _checked(text, hits, block):
                        out.append((lo + i, item, *values))
            ids = batch.column(0).take(pa.array([r[0] for r in out], pa.int64()))
            rest = list(zip(*(r[1:] for r in out), strict=True)) if out else [()] * 7
            types = [pa.float64()] * 4 + [pa.int64()] * 2
            items = pa.array(list(rest[0])) if out else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, items, *(pa.array(list(c), t) for c, t in zip(rest[1:], types, strict=True))], names=names)

    return search


def _candidates(h, bounds, block: _Passages, cosine):
    """(row, [(first word of the window, passage, cosine)]) of rows with candidates.

    Candidates are windows whose cosine with a passage is high enough; of these the ones are left
    out around which too few of the item's words occur, or occur in order.
    """
    n = np.diff(bounds)
    per = -(-n // STRIDE)
    if per.sum() == 0:
        return
    row = np.repeat(np.arange(len(n)), per)
    first = np.concatenate([[0], np.cumsum(per)])
    nth = np.arange(len(row)) - first[:-1][row]
    start = bounds[:-1][row] + nth * STRIDE
    kind = block.column[buckets_of(h)]
    # sums of STRIDE words each: the first used word of each, then the second, and so on
    used = np.flatnonzero(kind != block.none)
    of = np.searchsorted(start, used, "right") - 1
    place = np.arange(len(used)) - np.searchsorted(of, of)
    sums = np.zeros((len(row), block.weighted.shape[1]), np.float32)
    for k in range(int(place.max(initial=-1)) + 1):
        some = np.flatnonzero(place == k)
        sums[of[some]] += block.weighted[kind[used[some]]]
    last = nth == per[row] - 1
    inner = np.flatnonzero(~last)
    two = sums.copy()
    two[inner] += sums[inner + 1]
    use = ~last | (per[row] == 1)
    length = np.sqrt(np.einsum("ij,ij->i", two, two))
    at = np.flatnonzero(use & (length > 1e-6))
    two = two[at] / length[at, None]
    number = block.numbered(h[used], kind[used])
    mine = np.flatnonzero(number >= 0)
    number, of, used = number[mine], of[mine], used[mine]
    mixed = block.word_mix[number]
    before = np.zeros(len(h) + 1, np.int64)
    before[used + 1] = 1
    before = np.cumsum(before)
    stretches = signed(of, mixed, len(row))
    step = max(64, DENSE // max(1, len(block.listed)))
    hits: dict[int, list[tuple[int, int, float]]] = {}
    for lo in range(0, len(at), step):
        value = two[lo : lo + step] @ block.latent
        flat = np.flatnonzero(value.ravel() >= cosine)
        i, j = np.divmod(flat, value.shape[1])
        # passages of an item follow each other, so pairs of window and item do too
        code = i * np.int64(len(block.item_need)) + block.item[j]
        new = np.ones(len(code), bool)
        new[1:] = code[1:] != code[:-1]
        x, item = i[new], block.item[j[new]]
        w = at[lo + x]
        a, b = np.maximum(bounds[:-1][row[w]], start[w] - block.item_length[item]), np.minimum(bounds[1:][row[w]], start[w] + WINDOW + block.item_length[item])
        a, b = before[a], before[b]
        some = np.flatnonzero(b - a >= block.item_need[item])
        some = some[block.likely(stretches, at[lo : lo + step], x[some], item[some])]
        some = some[block.enough(number, mixed, item[some], a[some], b[some])]
        keep = np.zeros(len(x), bool)
        keep[some] = True
        for f in np.flatnonzero(keep[np.cumsum(new) - 1]).tolist():
            x = at[lo + i[f]]
            hits.setdefault(int(row[x]), []).append((int(nth[x]) * STRIDE, int(j[f]), float(value.ravel()[flat[f]])))
    yield from hits.items()


def _checked(text: np.ndarray, hits, block: _Passages):
    """(item, cosine, lcs, passage, answer, start, stop) of the items that are there, best window each."""
    best: dict = {}
    for at, passage, value in hits:
        item, s, e, w, answer = block.listed[passage]
        whole, piece, end = block.marks[passage]
        around = [x for x in text[max(0, at - len(w)) : at + WINDOW + len(w)].tolist() if x in whole]
        share = _lcs(whole, len(w), around) / len(w)
        if share < PARAPHRASED and (e - s < WINDOW or share * len(w) < PASSAGE * (e - s)):
            continue
        part = _lcs(piece, e - s, around) / (e - s)
        last = _lcs(end, len(w) - answer, around) / max(1, len(w) - answer)
        if not (share >= COPIED or (e - s >= WINDOW and part >= PASSAGE) or (share >= PARAPHRASED and last >= ANSWER)):
            continue
        new = (value, share, part, last, at, min(len(text), at + WINDOW))
        if item not in best or (share, value) > (best[item][1], best[item][0]):
            best[item] = new
    for item in sorted(best):
        yield (item, *best[item])


def leaks_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The query: pairs of documents and benchmark items."""
    found = find_leaks(docs, benchmark)
    return found.select("doc_id", "item_id", *[F.round(c, 6).alias(c) for c in ("cosine", "lcs", "passage", "answer")], "start", "stop")
