"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Tokens are runs of letters, of digits, or of other signs between white space, case kept.
Features are hashed unigrams and bigrams; the bigram of a token with itself has one feature of
its own, so that repetition of any word counts.  A text's vector holds, a feature, `SCALE` times
its share of the text's tokens.  FTRL-proximal runs on `SHARDS` shards of a bounded sample of
the labelled rows; after each epoch the shards' states are averaged and go out again.
Scoring is a sparse dot product over every whole text.

Defined cases: null and empty texts have the bias alone; null labels don't train; rows without
labels are scored alike; with no labelled row every score is 0.5; of clashing labels of one id the
larger counts; rows that repeat an id each train, in order of id; repeated rows get equal scores;
long texts are read whole; other columns, whatever their names, don't matter; an empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import VALUES, boundaries, mix64, remainder, segment_sums, span_hashes, stored, summed_blocks, text_slices

BITS = 18
SCALE = 20.0
SHARDS = 8
EPOCHS = 3
#: At most so many labelled rows train, the first by a hash of their id.
MAX_TRAINING_ROWS = 20_000
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5
THRESHOLD = 0.3

_CLASS = np.full(256, 3, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token, and for each row the number of tokens before it."""
    kind = _CLASS[data]
    n = len(kind)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    edge = np.ones(n + 1, bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    real = kind[starts] != 0
    starts, ends = starts[real], ends[real]
    return span_hashes(data, starts, ends, VALUES), np.searchsorted(starts, offsets)


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed unigrams and bigrams (one each a token), and each row's bounds in both."""
    token, bounds = tokens(data, offsets)
    before = np.empty_like(token)
    before[:1] = 0
    before[1:] = token[:-1]
    before[bounds[:-1][bounds[:-1] < len(token)]] = 0
    with np.errstate(over="ignore"):
        pair = mix64(before * np.uint64(3) + token)
    pair[before == token] = np.uint64(12345) << np.uint64(64 - bits)
    shift = np.uint64(64 - bits)
    return (token >> shift).astype(np.int64), (pair >> shift).astype(np.int64), bounds


def margins(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    one, two, bounds = features(data, offsets)
    n = np.maximum(1, np.diff(bounds))
    return bias + SCALE * segment_sums(weights[one] + weights[two], bounds) / n


def ftrl_pass(rows: list[tuple[int, np.ndarray, np.ndarray]], z: np.ndarray, s: np.ndarray, balance: tuple[float, float]) -> None:
    """One pass over (label, feature ids, values); the last slot is the bias.  Changes z and s."""
    for label, ids, x in rows:
        zi, si = z[ids], s[ids]
        shrink = np.where(ids == len(z) - 1, 0.0, L1)
        w = np.where(np.abs(zi) <= shrink, 0.0, (np.sign(zi) * shrink - zi) / ((BETA + np.sqrt(si)) / ALPHA + L2))
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * x * balance[label]
        root = (np.sqrt(si + g * g) - np.sqrt(si)) / ALPHA
        z[ids] = zi + g - root * w
        s[ids] = si + g * g


def weights_of(z: np.ndarray, s: np.ndarray) -> np.ndarray:
    shrink = np.full(len(z), L1)
    shrink[-1] = 0.0
    return np.where(np.abs(z) <= shrink, 0.0, (np.sign(z) * shrink - z) / ((BETA + np.sqrt(s)) / ALPHA + L2))


def training_sample(labelled: DataFrame, label_col: str, most: int) -> DataFrame:
    """(id, label) of at most `most` rows, the first by a hash of the id; one row an id."""
    rows = labelled.filter(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    return rows.orderBy(F.xxhash64(F.col("doc_id"), F.lit(3)), "doc_id").limit(most)


def train_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = MAX_TRAINING_ROWS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias.  docs: doc_id, text; labels: doc_id and the label column."""
    schema = "doc_id long, label int, ids binary, x binary"

    def vectors(batches):
        for batch in batches:
            ids, xs = [], []
            for lo, data, offsets in text_slices(batch.column(2)):
                one, two, bounds = features(data, offsets)
                for i in range(len(offsets) - 1):
                    own = slice(bounds[i], bounds[i + 1])
                    key, n = np.unique(np.concatenate([one[own], two[own]]), return_counts=True)
                    ids.append(np.append(key, 1 << BITS).astype(np.int32).tobytes())
                    xs.append(np.append(SCALE * n / max(1, bounds[i + 1] - bounds[i]), 1.0).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array(xs, pa.binary())], names=["doc_id", "label", "ids", "x"])

    sample = F.broadcast(stored(training_sample(labels, label_col, most)))
    one_text = docs.join(sample, "doc_id").select("doc_id", "label", "text")
    rows = stored(one_text.mapInArrow(vectors, schema))
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not n:
        return np.zeros(1 << BITS), 0.0
    total = sum(n.values())
    balance = tuple(min(10.0, total / (2.0 * n[k])) if n.get(k) else 1.0 for k in (0, 1))
    state = (np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1))
    context = docs.sparkSession.sparkContext
    for _ in range(epochs):
        sent = context.broadcast(state)

        def learn(batches):
            z, s = (v.copy() for v in sent.value)
            shard = None
            for batch in batches:  # one at a time, as texts have any length
                for i in range(batch.num_rows):
                    shard = batch.column(4)[i].as_py()
                    ids, x = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in ((2, np.int32), (3, np.float32)))
                    ftrl_pass([(batch.column(1)[i].as_py(), ids, x.astype(np.float64))], z, s, balance)
            if shard is not None:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([shard], pa.int32()), pa.array([np.concatenate([z, s, [1.0]]).tobytes()], pa.binary())], names=["slot", "part", "data"])

        shard = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(9)), F.lit(SHARDS)).cast("int")
        dealt = rows.select("doc_id", "label", "ids", "x", shard.alias("shard")).repartitionById(SHARDS, "shard").sortWithinPartitions("doc_id", "label", "ids")
        states = dealt.mapInArrow(learn, "slot int, part int, data binary")
        total = np.frombuffer(summed_blocks(states, 2).collect()[0]["data"], np.float64)
        mean = total[:-1] / total[-1]
        state = (mean[: len(state[0])], mean[len(state[0]) :])
        sent.destroy()
    w = weights_of(*state)
    return w[:-1], float(w[-1])


def score_quality(docs: DataFrame, weights: np.ndarray, bias: float, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """`id_cols` of each row and score.  The weights (2**18 numbers) are sent to every executor."""
    sent = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def score(batches):
        w, b = sent.value
        for batch in batches:
            found = [np.zeros(0)] + [margins(data, offsets, w, b) for _, data, offsets in text_slices(batch.column(batch.num_columns - 1))]
            p = 1.0 / (1.0 + np.exp(-np.clip(np.concatenate(found), -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p)], names=[*batch.schema.names[:-1], "score"])

    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(id_cols)], F.col(text_col).cast("string").alias("text"))
    kinds = ", ".join(f"c{i} {rows.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(id_cols)))
    return rows.mapInArrow(score, f"{kinds}, score double").toDF(*id_cols, "score")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query: learns from labelled rows that aren't held out and scores every row."""
    rows = docs.select("doc_id", "text", (remainder("doc_id", 5) == 0).alias("held_out"))
    weights, bias = train_quality(rows.filter(~F.col("held_out")).select("doc_id", "text"), labels.filter(remainder("doc_id", 5) != 0))
    scored = score_quality(rows, weights, bias, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
