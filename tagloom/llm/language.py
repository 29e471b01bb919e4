"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1.  An n-gram's vector binds the permuted
vectors of its letters (elementwise product, the letter at place i rolled by n-1-i).  A text
is the bundle (sum) of its n-grams, a language the bundle of its training texts, each text with
weight 1 in all.  A text goes to the language with the highest cosine, after the mean of all
prototypes is taken from both sides: what all languages share doesn't tell them apart.

Letters are a-z in either case, and the code points of other letters modulo 37, so that those of
one alphabet keep apart; anything else is one gap symbol, and runs of it count once.  Bundling is linear, so training adds up
n-gram weights a language (in the JVM) and binds each n-gram once.

Defined cases: a null text, or one without a letter, is `und` with score 0; null languages don't
train; without training rows everything is `und`; ties go to the first language by name; repeated
rows get equal results; long texts are read whole; other columns, whatever their names, don't
matter; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import remainder, text_slices

DIMENSIONS = 1024
ORDER = 3
SYMBOLS = 64
UNKNOWN = "und"
SLICE = 1 << 21


#: a-z in either case are 1 to 26, all else below 128 is the gap, 0.
SYMBOL = np.zeros(256, np.uint8)
SYMBOL[65:91] = SYMBOL[97:123] = np.arange(1, 27)
OTHERS = SYMBOLS - 27


def letter_symbols(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Symbols of the characters beyond ASCII that begin at `at`: 27 up by code point, 0 for signs.

    Capitals of the Latin, Greek and Cyrillic blocks go with their small letters.  Neighbours in
    an alphabet get different symbols, as one holds no more than `OTHERS` of them as a rule.
    """
    padded = np.append(data, np.zeros(3, np.uint8))
    a, b, c, d = (padded[at + i].astype(np.int32) for i in range(4))
    b, c, d = b & 63, c & 63, d & 63
    point = np.where(a < 0xE0, (a & 31) << 6 | b, np.where(a < 0xF0, (a & 15) << 12 | b << 6 | c, (a & 7) << 18 | b << 12 | c << 6 | d))
    sign = (point < 0xC0) | (point == 0xD7) | (point == 0xF7) | (point >= 0x2000) & (point < 0x2C00) | (point >= 0x3000) & (point < 0x3041) | (point >= 0x1F000) & (point < 0x20000)
    for low, high, step in ((0xC0, 0xDF, 0x20), (0x391, 0x3AC, 0x20), (0x410, 0x430, 0x20), (0x400, 0x410, 0x50), (0x386, 0x387, 0x26), (0x388, 0x38B, 0x25), (0x38C, 0x38D, 0x40), (0x38E, 0x390, 0x3F)):
        point = np.where((point >= low) & (point < high), point + step, point)
    point = np.where((point >= 0x100) & (point < 0x180), point | 1, point)
    return np.where(sign, 0, 27 + point % OTHERS).astype(np.uint8)


ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True


def letter_vectors(dimensions: int, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (SYMBOLS, dimensions))


def gram_vectors(grams: np.ndarray, dimensions: int, order: int = ORDER) -> np.ndarray:
    """The bound vectors of n-gram ids (base-64 numbers of symbols)."""
    letters, out = letter_vectors(dimensions), None
    for i in range(order):
        symbol = (grams >> (6 * (order - 1 - i))) & 63
        part = np.roll(letters, order - 1 - i, axis=1)[symbol]
        out = part if out is None else np.multiply(out, part, out=out)
    return out if out is not None else np.zeros((0, dimensions), np.float32)


def grams_of(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(row, n-gram id) of every n-gram; none crosses rows."""
    symbol = SYMBOL[data]
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    if len(wide := np.flatnonzero(data >= 0xC0)):
        symbol[wide] = letter_symbols(data, wide)
        begins = (data & 0xC0) != 0x80
        symbol, row = symbol[begins], row[begins]
    keep = np.ones(len(symbol), bool)
    keep[1:] = (symbol[1:] != 0) | (symbol[:-1] != 0) | (row[1:] != row[:-1])
    symbol, row = symbol[keep].astype(np.int32), row[keep]
    n = len(symbol) - order + 1
    if n <= 0:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    gram = np.zeros(n, np.int32)
    for i in range(order):
        gram = gram * 64 + symbol[i : i + n]
    same = row[:n] == row[order - 1 :]
    return row[:n][same], gram[same]


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    count = np.concatenate([[0], np.cumsum(ASCII_LETTER[data])])
    found = count[offsets[1:]] > count[offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return found


def train_profiles(docs: DataFrame, lang_col: str, text_col: str, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Names and prototypes (one row a language), from all rows with a language and a text.

    The driver gets one vector a language.
    """

    def count(batches):
        for batch in batches:
            lang = batch.column(0)
            for lo, data, offsets in text_slices(batch.column(1), SLICE):
                row, gram = grams_of(data, offsets)
                if len(row) == 0:
                    continue
                names = lang.slice(lo, len(offsets) - 1).dictionary_encode()
                code = names.indices.to_numpy(zero_copy_only=False)
                each = 1.0 / np.maximum(1, np.bincount(row, minlength=len(offsets) - 1))
                key, at = np.unique(code[row].astype(np.int64) << 32 | gram, return_inverse=True)
                weight = np.bincount(at, each[row])
                yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(key >> 32)), pa.array((key & 0xFFFFFFFF).astype(np.int32)), pa.array(weight)], names=["lang", "gram", "weight"])

    def bind(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            lang, gram, weight = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for name in sorted(set(lang)):
                own = lang == name
                vector = weight[own] @ gram_vectors(gram[own], dimensions).astype(np.float64)
                sums[name] = sums.get(name, 0) + vector
        for name, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([v.tobytes()], pa.binary())], names=["lang", "vector"])

    def add(key, table):
        total = sum(np.frombuffer(x, np.float64) for x in table.column("vector").to_pylist())
        return pa.table({"lang": [key[0].as_py()], "vector": pa.array([total.tobytes()], pa.binary())})

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    weights = rows.mapInArrow(count, "lang string, gram int, weight double").groupBy("lang", "gram").agg(F.round(F.sum("weight"), 9).alias("weight"))
    bound = weights.mapInArrow(bind, "lang string, vector binary").groupBy("lang").applyInArrow(add, "lang string, vector binary")
    found = sorted((r["lang"], np.frombuffer(r["vector"], np.float64)) for r in bound.collect())
    names = [x[0] for x in found]
    profiles = np.array([x[1] / max(np.linalg.norm(x[1]), 1e-12) for x in found]).reshape(len(names), dimensions)
    return names, profiles


def detect_language(docs: DataFrame, names: list[str], profiles: np.ndarray, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """`id_cols` of each row, lang_pred and score (the cosine, at least 0)."""
    dimensions = profiles.shape[1]
    centre = profiles.mean(axis=0) if len(names) > 1 else np.zeros(dimensions)
    against = profiles - centre
    against = (against / np.maximum(np.linalg.norm(against, axis=1, keepdims=True), 1e-12)).astype(np.float32).T
    centre_unit = centre / max(np.linalg.norm(centre), 1e-12)

    def predict(batches):
        for batch in batches:
            best, score, known = [], [], []
            for lo, data, offsets in text_slices(batch.column(batch.num_columns - 1), SLICE):
                n = len(offsets) - 1
                row, gram = grams_of(data, offsets)
                used = np.zeros(1 << (6 * ORDER), bool)
                used[gram] = True
                ids = np.flatnonzero(used)
                place = np.zeros(len(used), np.int32)
                place[ids] = np.arange(len(ids))
                bundle = np.zeros((n, dimensions), np.float32)
                step = max(1, (1 << 23) // max(1, len(ids)))
                vectors, ends = gram_vectors(ids, dimensions), np.searchsorted(row, np.arange(n + 1))
                for a in range(0, n, step):
                    b = min(n, a + step)
                    own = slice(ends[a], ends[b])
                    counts = np.bincount((row[own] - a).astype(np.int64) * len(ids) + place[gram[own]], minlength=(b - a) * len(ids)).reshape(b - a, -1)
                    bundle[a:b] = counts.astype(np.float32) @ vectors
                bundle -= (bundle @ centre_unit.astype(np.float32))[:, None] * centre_unit.astype(np.float32)
                norm = np.maximum(np.linalg.norm(bundle, axis=1), 1e-9)
                cosine = bundle @ against / norm[:, None] if names else np.zeros((n, 1), np.float32)
                best.append(cosine.argmax(axis=1))
                score.append(cosine.max(axis=1))
                known.append(has_letter(data, offsets))
            best, score, known = (np.concatenate([np.zeros(0), *x]) for x in (best, score, known))
            known = known.astype(bool) & bool(names)
            label = np.where(known, np.array([*names, UNKNOWN], object)[best.astype(int)], UNKNOWN)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(label, pa.string()), pa.array(np.where(known, np.clip(score, 0.0, 1.0), 0.0), pa.float64())],
                names=[*batch.schema.names[:-1], "lang_pred", "score"],
            )

    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(id_cols)], F.col(text_col).cast("string").alias("text"))
    kinds = ", ".join(f"c{i} {rows.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(id_cols)))
    return rows.mapInArrow(predict, f"{kinds}, lang_pred string, score double").toDF(*id_cols, "lang_pred", "score")


def language_report(docs: DataFrame) -> DataFrame:
    """The query: learns from the rows that aren't held out and predicts every row."""
    rows = docs.select("doc_id", "text", "lang", (remainder("doc_id", 3) == 1).alias("held_out"))
    names, profiles = train_profiles(rows.filter(~F.col("held_out")), "lang", "text")
    return detect_language(rows.select("doc_id", "text", "held_out"), names, profiles, ["doc_id", "held_out"])
