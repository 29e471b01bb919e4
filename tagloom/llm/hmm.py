"""Language model scoring with a hidden Markov model over words.

Tokens are lower-cased (A-Z) words and one end a text.  The model has STATES states.  A state
emits a class: each of the HEAD most frequent words is a class, as is the end; other words
share TAIL classes by hash.  Within a class a word has its share of the class's counts, all
counts raised by 1, and one further share for words never seen:
P(text) = sum over state paths of prod T * E(class) * P(word | class), times the end's.
Baum-Welch counts of every training text are added up across partitions, ROUNDS times.  Training
works off a text in chains of CHAIN tokens side by side; what each hands to its neighbours is
computed first, so the counts are those of whole texts.  Scoring runs the scaled forward
recursion over whole texts, so the likelihood is exact.

The word counts grow with the corpus and never meet in one place: texts are dealt into blocks
by a hash, each block asks for the counts of its own words by a join, and gets them back beside
its texts.  Only the head (HEAD words) goes to every executor.

Defined cases: a null text counts as empty, which has one token, its end; without training rows
every count is 0 and all words are equally unknown; repeated rows count each; words of equal count
enter the head by their hash; long texts are scored whole; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import VALUES_LOWER, remainder, span_hashes, stored, summed_blocks, text_slices, words

STATES = 6
HEAD = 2048
TAIL = 256
CHAIN = 64
ROUNDS = 5
#: The hash that stands for the end.
END = np.int64(1)
#: Rows of the score's blocks: about so many bytes of text each.
BLOCK_BYTES = 8 << 20
#: Bytes of text hashed at a time.
PIECE = 1 << 18


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signed 64-bit hash of each word and each row's bounds, worked off in pieces that stay in a processor's cache."""
    found, bounds, lo, n = [np.zeros(0, np.int64)], np.zeros(len(offsets), np.int64), 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PIECE, "right")) - 1)
        piece = data[offsets[lo] : offsets[hi]]
        starts, ends, own = words(piece, offsets[lo : hi + 1] - offsets[lo])
        found.append(span_hashes(piece, starts, ends, VALUES_LOWER).view(np.int64))
        bounds[lo + 1 : hi + 1] = bounds[lo] + own[1:]
        lo = hi
    h = np.concatenate(found)
    h[h == END] = END + 1
    return h, bounds


class Classes:
    """Hash of a word to its class: 0 is the end, then the head, then the tail."""

    def __init__(self, head: np.ndarray, tail: int = TAIL):
        self.sorted = np.sort(head)
        self.tail, self.n = tail, 1 + len(head) + tail
        bits = 16
        self.shift = np.uint64(64 - bits)
        self.filter = np.zeros(1 << bits, bool)
        self.filter[(self.sorted.view(np.uint64) >> self.shift).astype(np.int64)] = True

    def of(self, h: np.ndarray) -> np.ndarray:
        u = h.view(np.uint64)
        out = (1 + len(self.sorted) + (u % np.uint64(self.tail))).astype(np.int32)
        maybe = np.flatnonzero(self.filter[(u >> self.shift).astype(np.int64)]) if len(self.sorted) else np.zeros(0, np.int64)
        if len(maybe):
            some = h[maybe]
            at = np.minimum(np.searchsorted(self.sorted, some), len(self.sorted) - 1)
            hit = self.sorted[at] == some
            out[maybe[hit]] = 1 + at[hit]
        out[h == END] = 0
        return out


def with_ends(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The end after each row's words, and the new bounds."""
    return np.insert(h, bounds[1:], END), bounds + np.arange(len(bounds))


def start_model(n_classes: int, frequencies: np.ndarray, states: int = STATES, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, transitions, emissions): frequencies, jolted for each state; states like to stay."""
    rng = np.random.default_rng(seed)
    e = frequencies[None, :] * np.exp(rng.normal(0.0, 1.0, (states, n_classes)))
    t = rng.uniform(0.5, 1.5, (states, states)) + np.eye(states) * 9.0 * states
    return np.full(states, 1.0 / states), t / t.sum(1, keepdims=True), e / e.sum(1, keepdims=True)


def carried(classes: np.ndarray, first: np.ndarray, n: np.ndarray, text: np.ndarray, nth: np.ndarray, model) -> tuple[np.ndarray, np.ndarray]:
    """For chains of texts that have several: the state mix before each, and what follows it (beta at its end).

    The chains' transfer matrices are built side by side; then each text's are applied one after
    the other, forth and back.  Chains come in order of falling length n.
    """
    start, t, e = model
    s, m = len(start), len(first)
    # a chain's matrix is one row, so that all are multiplied by t at once and no step goes over short axes
    each, t32 = np.tile(e.T.astype(np.float32), (1, s)), t.astype(np.float32)
    ones = np.ones(s * s, np.float32)
    over = np.where((nth == 0)[:, None], np.eye(s, dtype=np.float32).ravel(), t32.ravel())
    for i in range(int(n[0]) if m else 0):
        k = int(np.searchsorted(-n, -i, "left"))
        now = (over[:k].reshape(-1, s) @ t32).reshape(k, -1) if i else over[:k]
        now = now * each[classes[first[:k] + i]]
        np.divide(now, np.maximum(now @ ones, 1e-30)[:, None], out=over[:k])
    over = over.reshape(m, s, s)
    # chain number by chain number; in one number each text has one chain at most
    order = np.lexsort((text, nth))
    cuts = np.searchsorted(nth[order], np.arange(int(nth.max(initial=-1)) + 2))
    before, after = np.tile(start.astype(np.float64), (m, 1)), np.ones((m, s))
    steps = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for old, new in zip(steps[:-1], steps[1:], strict=True):
        old = old[np.searchsorted(text[old], text[new])]
        x = np.einsum("ij,ijk->ik", before[old], over[old])
        before[new] = x / np.maximum(x.sum(1, keepdims=True), 1e-300)
    for old, new in zip(steps[-2::-1], steps[:0:-1], strict=True):
        old = old[np.searchsorted(text[old], text[new])]
        x = np.einsum("ijk,ik->ij", over[new], after[new])
        after[old] = x / np.maximum((before[new] * x).sum(1, keepdims=True), 1e-300)
    return before.astype(np.float32), after.astype(np.float32)


def chain_counts(classes: np.ndarray, bounds: np.ndarray, model, length: int = CHAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, transitions and emissions of whole texts.

    Texts are worked off in chains side by side; a chain begins with the state mix that the ones
    before it leave, and ends with what follows it.
    """
    start, t, e = model
    s = len(start)
    sizes = np.diff(bounds)
    per = np.maximum(1, -(-sizes // length))
    text = np.repeat(np.arange(len(sizes)), per)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    first = bounds[:-1][text] + nth * length
    n = np.minimum(length, bounds[1:][text] - first)
    order = np.argsort(-n, kind="stable")
    first, n, text, nth = first[order], n[order], text[order], nth[order]
    m = len(first)
    before, beta = np.tile(start.astype(np.float32), (m, 1)), np.ones((m, s), np.float32)
    several = np.flatnonzero(per[text] > 1)
    before[several], beta[several] = carried(classes, first[several], n[several], text[several], nth[several], model)
    goes_on = np.flatnonzero((nth > 0) & (n > 0))
    running = [int(np.searchsorted(-n, -i, "left")) for i in range(length)]  # chains longer than i
    alpha = np.zeros((length, m, s), np.float32)
    scale = np.ones((length, m), np.float32)
    e32, t32 = e.T.astype(np.float32), t.astype(np.float32)
    arrives = before.copy()
    arrives[goes_on] = before[goes_on] @ t32
    out: list[np.ndarray] = []
    ones = np.ones(s, np.float32)
    for i in range(length):
        k = running[i]
        if k == 0:
            break
        b = e32[classes[first[:k] + i]]
        out.append(b)
        a = (arrives[:k] if i == 0 else alpha[i - 1, :k] @ t32) * b
        c = np.maximum(a @ ones, 1e-30)
        alpha[i, :k] = a / c[:, None]
        scale[i, :k] = c
    trans = np.zeros((s, s))
    emit = np.zeros((e.shape[1], s))
    starts = np.zeros(s)
    for i in range(len(out) - 1, -1, -1):
        k = running[i]
        gamma = alpha[i, :k] * beta[:k]
        kind = classes[first[:k] + i]
        for j in range(s):
            emit[:, j] += np.bincount(kind, gamma[:, j], minlength=len(emit))
        weighted = out[i] * beta[:k] / scale[i, :k, None]
        if i == 0:
            starts += gamma[nth[:k] == 0].sum(0, dtype=np.float64)
            trans += before[goes_on].T.astype(np.float64) @ weighted[goes_on]
            break
        trans += alpha[i - 1, :k].T.astype(np.float64) @ weighted
        beta[:k] = weighted @ t32.T
    return starts, trans * t, emit.T, float(np.log(scale).sum())


def reestimate(starts: np.ndarray, trans: np.ndarray, emit: np.ndarray, frequencies: np.ndarray):
    """The next model; a little of the overall frequencies keeps every class possible."""
    starts = starts + 1.0
    trans = trans + 1.0
    emit = emit + frequencies[None, :] * 10.0 + 1e-9
    return starts / starts.sum(), trans / trans.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True)


def forward_log10(classes: np.ndarray, bounds: np.ndarray, model) -> np.ndarray:
    """log10 probability of each row's classes, by the scaled forward recursion.

    Rows advance together, longest first, so that one step handles all rows still running.
    """
    start, t, e = model
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    first, n = bounds[:-1][order], sizes[order]
    total = np.zeros(len(order))
    emit, ones = np.ascontiguousarray(e.T), np.ones(len(start))
    ends = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), "left")
    alpha = None
    for i, k in enumerate(ends):
        b = emit[classes[first[:k] + i]]
        alpha = (start[None] if i == 0 else alpha[:k] @ t) * b
        c = alpha @ ones
        alpha /= c[:, None]
        total[:k] += np.log10(c)
    out = np.zeros(len(order))
    out[order] = total
    return out


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n): hash and count of every token of `texts`, ends included, added up first in each task."""

    def count(batches):
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def merged():
            key = np.concatenate([k for k, _ in kept])
            n = np.concatenate([c for _, c in kept])
            key, at = np.unique(key, return_inverse=True)
            return key, np.bincount(at, n).astype(np.int64)

        for batch in batches:
            for _, data, offsets in text_slices(batch.column(0), 4 << 20):
                h, bounds = word_hashes(data, offsets)
                key, n = np.unique(h, return_counts=True)
                kept.append((np.append(key, END), np.append(n, len(offsets) - 1)))
                held += len(key) + 1
                if held > 1_500_000:
                    key, n = merged()
                    kept, held = [(key, n)], len(key)
                    if held > 1_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["word", "n"])
                        kept, held = [], 0
        if kept:
            key, n = merged()
            for a in range(0, len(key), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[a : a + 200_000]), pa.array(n[a : a + 200_000])], names=["word", "n"])

    return texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def train_hmm(texts: DataFrame, counts: DataFrame, rounds: int = ROUNDS, states: int = STATES, head: int = HEAD):
    """The model over classes, the classes, and each class's (count, distinct words).

    The driver gets HEAD words, and sums of fixed size: a few numbers a class and state.
    """
    top = [r["word"] for r in counts.filter(F.col("word") != int(END)).orderBy(F.desc("n"), "word").limit(head).collect()]
    classes = Classes(np.array(top, np.int64))

    def by_class(batches):
        for batch in batches:
            kind = classes.of(batch.column(0).to_numpy())
            n = np.bincount(kind, batch.column(1).to_numpy(), minlength=classes.n)
            v = np.bincount(kind, minlength=classes.n).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([int(kind[0]) if len(kind) else 0], pa.int32()), pa.array([np.concatenate([n, v]).tobytes()], pa.binary())], names=["slot", "part", "data"])

    rows = summed_blocks(counts.mapInArrow(by_class, "slot int, part int, data binary")).collect()
    sums = np.frombuffer(rows[0]["data"], np.float64).reshape(2, -1) if rows else np.zeros((2, classes.n))
    frequencies = (sums[0] + 1.0) / (sums[0] + 1.0).sum()
    model = start_model(classes.n, frequencies, states)
    s, context = states, counts.sparkSession.sparkContext
    for _ in range(rounds if rows else 0):
        sent = context.broadcast((model, classes))

        def expect(batches):
            now, kinds = sent.value
            total = None
            for batch in batches:
                for _, data, offsets in text_slices(batch.column(0), 2 << 20):
                    h, bounds = with_ends(*word_hashes(data, offsets))
                    a, b, c, _ = chain_counts(kinds.of(h), bounds, now)
                    one = np.concatenate([a, b.ravel(), c.ravel()])
                    total = one if total is None else total + one
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([int(total[0] * 1e3) % 97], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slot", "part", "data"])

        rows = summed_blocks(texts.mapInArrow(expect, "slot int, part int, data binary")).collect()
        flat = np.frombuffer(rows[0]["data"], np.float64)
        model = reestimate(flat[:s], flat[s : s + s * s].reshape(s, s), flat[s + s * s :].reshape(s, -1), frequencies)
        model = tuple(np.round(x, 12) for x in model)
        sent.destroy()
    return model, classes, sums


def lm_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The query: learns from the rows that aren't held out and scores every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), (remainder(id_col, modulus) == held).alias("held_out"))
    texts = rows.filter(~F.col("held_out")).select("text")
    counts = stored(count_words(texts))
    n_tokens, n_words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    model, classes, sums = train_hmm(texts, counts)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // block_bytes))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")).repartitionById(blocks, "block")
    context = docs.sparkSession.sparkContext
    sent = context.broadcast((model, classes, sums))

    def asks(batches):
        """Each block's distinct words beyond the head, once a batch."""
        kinds = sent.value[1]
        for batch in batches:
            block = batch.column(3).to_numpy()
            found, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for lo, data, offsets in text_slices(batch.column(1), 4 << 20):
                h, bounds = word_hashes(data, offsets)
                rare = kinds.of(h) > len(kinds.sorted)
                of.append(np.repeat(block[lo : lo + len(offsets) - 1], np.diff(bounds))[rare])
                found.append(h[rare])
            h, b = np.concatenate(found), np.concatenate(of)
            order = np.lexsort((h, b))
            h, b = h[order], b[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (b[1:] != b[:-1])
            h, b = h[new], b[new]
            for a in range(0, len(h), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(b[a : a + 200_000]), pa.array(h[a : a + 200_000])], names=["block", "word"])

    # All columns go in, so that both uses of `dealt` share one exchange.
    asked = dealt.mapInArrow(asks, "block int, word long")
    answered = asked.join(counts.filter(F.col("word") != int(END)), "word").select("block", "word", "n")
    head = {r["word"]: r["n"] for r in counts.filter(F.col("word").isin([int(END)])).collect()}
    n_end = head.get(int(END), 0)
    top = np.zeros(len(classes.sorted))
    top[:] = sums[0][1 : 1 + len(top)]
    unseen = np.log10(n_tokens + n_words + 1) if n_tokens + n_words else 0.0

    def score(key, left, right):
        model, kinds, sums = sent.value
        word, n = right.column("word").to_numpy(), right.column("n").to_numpy()
        order = np.argsort(word)
        word, n = word[order], n[order]
        # within a class: its counts, each raised by 1, and 1 for all words unseen
        share = np.log10(sums[0] + sums[1] + 1.0)
        out = []
        text = left.column("text").combine_chunks()
        for _, data, offsets in text_slices(text, 8 << 20):
            h, bounds = with_ends(*word_hashes(data, offsets))
            kind = kinds.of(h)
            c = np.zeros(len(h))
            common = (kind > 0) & (kind <= len(top))
            c[common] = top[kind[common] - 1]
            c[kind == 0] = n_end
            rare = np.flatnonzero(kind > len(top))
            if len(word) and len(rare):
                at = np.minimum(np.searchsorted(word, h[rare]), len(word) - 1)
                c[rare] = np.where(word[at] == h[rare], n[at], 0)
            raised = np.log10(c + 1.0)
            known = np.add.reduceat((c > 0).astype(np.int64), bounds[:-1])
            base = np.add.reduceat(raised, bounds[:-1]) - np.diff(bounds) * unseen
            own = np.where(common | (kind == 0), np.log10(np.maximum(c, 1) / np.maximum(sums[0][kind], 1)), raised - share[kind])
            value = forward_log10(kind, bounds, model) + np.add.reduceat(own, bounds[:-1])
            out.append((np.diff(bounds), known, base, value))
        n_all, known, base, value = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0),) * 4
        return pa.table({"id": left.column("id"), "held_out": left.column("held_out"), "n_tokens": pa.array(n_all.astype(np.int64)), "n_known": pa.array(known.astype(np.int64)), "base_score": pa.array(base), "score": pa.array(value)})

    scored = dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(score, f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
