"""Toxicity by a subsequence string kernel, Nystroem landmarks and a linear support vector machine.

Kernel: k(u, v) adds up DECAY ** (span in u + span in v) over all common subsequences of ORDER
characters, gaps included, divided by sqrt(k(u, u) k(v, v)); letters inserted into an insult or
left out of it lower the value and don't end the match.  A unit is a word (outer punctuation
removed, lower case, long ones in overlapping windows; with and without inner punctuation) or a
run of single characters joined.

A sign before each unit makes beginnings count for more.

Landmarks are words of labelled training sentences and beginnings of them, the ones whose presence
best tells toxic from clean ones and that are not near each other in the kernel (found by counts of
presence: sentences themselves, as landmarks, drown an insult in ordinary words).  A text's feature for a landmark
is the highest kernel value of its units; K(landmarks, landmarks) ** -1/2 maps features to the
Nystroem space, in which a squared-hinge support vector machine and a logistic calibration are
fitted.  The value at the nearest landmark is one feature more: one insult is enough, however
little the rest of a text resembles any.  Every pair of a unit and a landmark has its exact value.

Defined cases: null and empty texts have no unit and so the features 0; null labels don't train;
with no toxic or no clean training row every score is 0; repeated rows get equal scores; words of
equal worth go by length and then in order; texts are read whole, long tokens in windows; other
columns, whatever their names, don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import give_back, remainder, stored, text_slices, words
from tagloom.llm.quality import training_sample

ORDER = 3
DECAY = 0.7
#: Bits of a character's number, and the sign put before each unit, so that beginnings count for more.
BITS, BEGIN = 6, "\x02"
WINDOW, STRIDE = 24, 12
LANDMARKS = 64
#: A landmark is at most so near to those before it.
APART = 0.75
#: Words weighed as landmarks; the driver gets at most so many.
CANDIDATES = 600
#: At most so many labelled rows train, the first by a hash of their id.
MAX_TRAINING_ROWS = 20_000
THRESHOLD = 0.7
#: A landmark word has so many letters (shorter ones, being common, thin out what a single insult weighs); a spelled-out unit ORDER or more.
MIN_LETTERS, MAX_LETTERS = 4, 20
#: Beginnings of words are weighed too, of so many letters.
STEMS = range(4, 9)
#: Of two candidates of which one begins the other, the worthier stands for both if their toxic rows are so nearly as many.
ALIKE = 0.8
#: Words a task remembers before it forgets those that are rare; 0.4 KB each.
REMEMBERED = 200_000
#: Bytes of text whose units are held at once.
SLICE = 1 << 18


def codes(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of characters as numbers below 1 << BITS (hashed beyond a-z), 0 after the end, and lengths."""
    n = np.array([len(u) for u in units], np.int64)
    if len(units) == 0:
        return np.zeros((0, 1), np.uint8), n
    flat = np.frombuffer("".join(units).encode("utf-32-le", "replace"), np.uint32)
    symbol = np.where((flat >= 97) & (flat <= 122), flat - 96, np.where(flat == ord(BEGIN), 27, 28 + flat % ((1 << BITS) - 28))).astype(np.uint8)
    out = np.zeros((len(units), max(1, int(n.max()))), np.uint8)
    out[np.arange(out.shape[1])[None, :] < n[:, None]] = symbol
    return out, n


def raw_kernel(a: np.ndarray, b: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """The kernel before it is normalised, of the rows of a and b (characters, 0 after the end).

    Dynamic programme over both texts, vectorised over the pairs.
    """
    pairs, la, lb = len(a), a.shape[1], b.shape[1]
    x, y = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)  # pairs last: each step runs over memory in order
    match = ((x[:, None] == y[None]) & (x[:, None] > 0)).astype(np.float32)
    match *= np.float32(decay * decay)
    got, decay = match, np.float32(decay)
    for _ in range(order - 1):
        # inner[i, j]: subsequences that end before (i, j), with their gap up to there
        inner = np.zeros((la, lb, pairs), np.float32)
        for i in range(1, la):
            along = np.zeros(pairs, np.float32)
            for j in range(1, lb):
                along *= decay
                along += got[i - 1, j - 1]
                np.multiply(inner[i - 1, j], decay, out=inner[i, j])
                inner[i, j] += along
        got = match * inner
    return got.sum(axis=(0, 1), dtype=np.float64)


@lru_cache(None)
def places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of all subsequences of ORDER of n characters, and DECAY ** span of each."""
    at = np.array(list(combinations(range(n), ORDER)), np.int64).reshape(-1, ORDER)
    return at, (DECAY ** (at[:, -1] - at[:, 0] + 1.0)).astype(np.float32)


def subsequences(matrix: np.ndarray, lengths: np.ndarray, at_once: int = 1 << 14):
    """(rows, a number for each row's subsequences, their DECAY ** span) of rows of one length."""
    for n in np.unique(lengths):
        at, weight = places(int(n))
        rows = np.flatnonzero(lengths == n)
        if len(at) == 0:
            continue
        step = max(1, at_once // len(at))
        for a in range(0, len(rows), step):
            some = rows[a : a + step]
            text = matrix[some].astype(np.int32)
            key = text[:, at[:, 0]]
            for j in range(1, ORDER):
                key = key << BITS | text[:, at[:, j]]
            yield some, key, weight


def self_kernel(matrix: np.ndarray, lengths: np.ndarray, at_once: int = 1 << 17) -> np.ndarray:
    """The kernel of each row with itself before it is normalised.

    The steps of `raw_kernel` over rows of one length, one text after the other and a whole plane a step.
    Sums run in one order, so that a row's value doesn't depend on the rows beside it.
    """
    out, decay = np.full(len(matrix), 1e-12), np.float32(DECAY)
    for n in np.unique(lengths[lengths >= ORDER]).tolist():
        every = np.flatnonzero(lengths == n)
        step = max(1, at_once // n**2)
        for a in range(0, len(every), step):
            x = np.ascontiguousarray(matrix[every[a : a + step], :n].T)  # rows last, as in `raw_kernel`
            match = (x[:, None] == x[None]).astype(np.float32)
            match *= decay * decay
            got = match
            for _ in range(ORDER - 1):
                inner = np.zeros_like(got)
                for i in range(1, n):
                    np.multiply(inner[i - 1], decay, out=inner[i])
                    inner[i] += got[i - 1]
                got = np.zeros_like(inner)
                for j in range(1, n):
                    np.multiply(got[:, j - 1], decay, out=got[:, j])
                    got[:, j] += inner[:, j - 1]
                got *= match
            out[every[a : a + step]] = sum(sum(got), np.zeros(x.shape[1]))
    return out


class Landmarks:
    """Kernel values of units against fixed landmark words.

    The kernel is a dot product over all subsequences of ORDER characters; of a unit's, those
    that no landmark has add nothing and are left out.  `begin` stands before each unit and landmark.
    """

    def __init__(self, names: list[str], begin: str = ""):
        self.names, self.begin = names, begin
        matrix, lengths = codes([begin + n for n in names])
        marks, keys, weights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for rows, key, weight in subsequences(matrix, lengths):
            marks.append(np.repeat(rows, key.shape[1]))
            keys.append(key.ravel().astype(np.int64))
            weights.append(np.tile(weight, len(rows)))
        marks, keys, weights = np.concatenate(marks), np.concatenate(keys), np.concatenate(weights)
        used, at = np.unique(keys, return_inverse=True)
        self.row = np.full(1 << BITS * ORDER, -1, np.int32)
        self.row[used] = np.arange(len(used))
        table = np.bincount(at * len(names) + marks, weights, minlength=len(used) * len(names)).reshape(len(used), len(names))
        self.table = (table / np.sqrt(np.maximum((table**2).sum(axis=0), 1e-12))).astype(np.float32)
        # a subsequence is in few landmarks: those of the k-th are mark[start[k] : start[k] + count[k]]
        k, self.mark = np.nonzero(self.table)
        self.share = self.table[k, self.mark]
        self.count = np.bincount(k, minlength=len(used))
        self.start = np.cumsum(self.count) - self.count

    def rows(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The units with a value that isn't 0, and their values at all landmarks.  A unit's best window and reading count."""
        of, parts = [], []
        for i, whole in enumerate(units):
            for u in (whole,) if whole.isalnum() else (whole, "".join(filter(str.isalnum, whole))):
                if len(u) < ORDER:
                    continue
                for at in range(0, max(1, len(u) - STRIDE), STRIDE) if len(u) > WINDOW else (0,):
                    of.append(i)
                    parts.append(u[at : at + WINDOW] if at else self.begin + u[:WINDOW])
        of = np.array(of, np.int64)
        which, values = [np.zeros(0, np.int64)], [np.zeros((0, len(self.names)), np.float32)]
        for a in range(0, len(parts), 4096):
            matrix, lengths = codes(parts[a : a + 4096])
            found = np.zeros((len(matrix), len(self.names)), np.float32)
            for rows, key, weight in subsequences(matrix, lengths):
                at = self.row[key].ravel()
                hit = np.flatnonzero(at >= 0)
                at, r = at[hit], hit // len(weight)
                n, w = self.count[at], weight[hit - r * len(weight)]
                ends = np.cumsum(n)
                one = np.arange(n.sum()) + np.repeat(self.start[at] - ends + n, n)
                cell = np.repeat(r * len(self.names), n) + self.mark[one]
                found[rows] = np.bincount(cell, np.repeat(w, n) * self.share[one], len(rows) * len(self.names)).reshape(len(rows), len(self.names))
            any_ = np.flatnonzero(found.any(axis=1))
            found = found[any_] / np.sqrt(self_kernel(matrix[any_], lengths[any_]))[:, None].astype(np.float32)
            unit = of[a + any_]
            if len(unit):  # the parts of a unit follow each other
                first = np.flatnonzero(np.append(True, np.diff(unit) > 0))
                which.append(unit[first])
                values.append(np.maximum.reduceat(found, first, axis=0))
        return np.concatenate(which), np.concatenate(values)

    def values(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, landmark, value) of the pairs that aren't 0."""
        unit, found = self.rows(units)
        pairs: dict[int, np.ndarray] = {}
        for u, x in zip(unit.tolist(), found, strict=True):
            pairs[u] = np.maximum(pairs[u], x) if u in pairs else x
        if not pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        unit, found = np.array(list(pairs)), np.array(list(pairs.values()))
        i, mark = np.nonzero(found)
        return unit[i], mark, found[i, mark]

    def gram(self) -> np.ndarray:
        return self.table.T.astype(np.float64) @ self.table


class Known:
    """The values of the words a task has met, and in how many rows since others were forgotten."""

    def __init__(self, marks: Landmarks):
        self.marks, self.at, self.n = marks, {}, 0
        self.clear_table()

    def clear_table(self) -> None:
        # as large as it gets as a rule, so that it need not be copied; memory is taken when it is written
        self.table, self.met = np.zeros((REMEMBERED, len(self.marks.names)), np.float32), np.zeros(REMEMBERED, np.int32)

    def forget(self) -> None:
        """Keeps the words met in two rows or more, of too many the half of REMEMBERED met most."""
        kept = np.flatnonzero(self.met[: self.n] > 1)
        if len(kept) > REMEMBERED // 2:
            kept = np.sort(kept[np.argsort(-self.met[kept], kind="stable")[: REMEMBERED // 2]])
        place = np.full(self.n + 1, -1, np.int64)  # the last one is that of words without a value
        place[kept] = np.arange(len(kept))
        place = place.tolist()
        self.at = {w: place[a] for w, a in self.at.items() if place[a] >= 0}
        old = self.table
        if len(old) > REMEMBERED:
            self.clear_table()
        for a in range(0, len(kept), 4096):  # a kept row never moves up
            self.table[a : a + 4096][: len(kept) - a] = old[kept[a : a + 4096]]
        self.n = len(kept)
        self.met[:] = 0

    def learn(self, new: list[str]) -> None:
        self.at.update(dict.fromkeys(new, -1))
        unit, found = self.marks.rows([unit_of(w) for w in new])
        if self.n + len(found) > len(self.table):
            more = max(len(found), self.n // 2)
            self.table = np.concatenate([self.table[: self.n], np.zeros((more, found.shape[1]), np.float32)])
            self.met = np.concatenate([self.met[: self.n], np.zeros(more, np.int32)])
        if len(unit) == 0:
            return
        first = np.flatnonzero(np.append(True, np.diff(unit) > 0))  # a unit's values follow each other
        self.table[self.n : self.n + len(first)] = np.maximum.reduceat(found, first, axis=0)
        self.at.update(zip([new[u] for u in unit[first].tolist()], range(self.n, self.n + len(first)), strict=True))
        self.n += len(first)


_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»“”‘’…–—"


def unit_of(word: str) -> str:
    return word.strip(_EDGE)


def units_by_row(data: np.ndarray, offsets: np.ndarray) -> list[set[str]]:
    """The distinct units of each row, outer punctuation not yet removed."""
    raw = data.tobytes()
    rows = [set(raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace").lower().split()) for i in range(len(offsets) - 1)]
    starts, ends, bounds = words(data, offsets)
    letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    single = np.concatenate([[False], letters[ends] - letters[starts] == 1, [False]])
    if single.any():
        step = np.diff(single.astype(np.int8))
        firsts, lasts = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        long = lasts - firsts >= ORDER
        for a, b in zip(firsts[long].tolist(), lasts[long].tolist(), strict=True):
            cut = [a, *bounds[np.searchsorted(bounds, a, "right") : np.searchsorted(bounds, b, "left")].tolist(), b]
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                if y - x >= ORDER:
                    rows[int(np.searchsorted(bounds, x, "right")) - 1].add(b"".join(raw[starts[k] : ends[k]] for k in range(x, y)).decode("utf-8", "replace").lower())
    return rows


def pooled(rows: list[set[str]], known: Known) -> np.ndarray:
    """Highest kernel value of each row's units against each landmark.  `known` is filled."""
    new = set().union(*rows).difference(known.at) if rows else set()
    if new and len(known.at) + len(new) > REMEMBERED:
        known.forget()
        new = set().union(*rows).difference(known.at)
    if new:
        known.learn(list(new))
    out = np.zeros((len(rows), len(known.marks.names)))
    for i, row in enumerate(rows):
        at = np.fromiter(map(known.at.__getitem__, row), np.int64, len(row))
        at = at[at >= 0]
        if len(at):
            out[i] = known.table[at].max(axis=0)
            known.met[at] += 1
    return out


def choose_landmarks(training: DataFrame, most: int = LANDMARKS) -> list[str]:
    """training: label, text.  Words and their beginnings by how far presence tells labels apart, near ones once."""

    def count(batches):
        for batch in batches:
            labels, seen = batch.column(0).to_pylist(), {}
            row = 0
            for lo, data, offsets in text_slices(batch.column(1), SLICE):
                for units in units_by_row(data, offsets):
                    plain = {w for u in units if MIN_LETTERS <= len(w := unit_of(u)) <= MAX_LETTERS and w.isalpha()}
                    for w in plain.union(w[:n] for w in plain for n in STEMS if n < len(w)):
                        seen.setdefault(w, [0, 0])[labels[row]] += 1
                    row += 1
            yield pa.RecordBatch.from_pydict({"word": pa.array(seen.keys(), pa.string()), "clean": pa.array([v[0] for v in seen.values()], pa.int64()), "toxic": pa.array([v[1] for v in seen.values()], pa.int64())})
        give_back()

    n = {r["label"]: r["count"] for r in training.groupBy("label").count().collect()}
    if not (n.get(0) and n.get(1)):
        return []
    counts = training.select("label", "text").mapInArrow(count, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    worth = F.col("toxic") * F.log((F.col("toxic") + 0.1) * (n[0] + 1.0) / ((F.col("clean") + 0.5) * (n[1] + 1.0)))
    rows = counts.filter(F.col("toxic") >= 2).withColumn("worth", worth).filter(F.col("toxic") * n[0] > 4 * F.col("clean") * n[1]).orderBy(F.desc("worth"), F.desc(F.length("word")), "word").limit(CANDIDATES).collect()
    names, toxic = [r["word"] for r in rows], [r["toxic"] for r in rows]
    if not names:
        return []
    near, chosen = Landmarks(names, BEGIN).gram(), []
    for i in range(len(names)):
        if len(chosen) == most:
            break
        if any((names[i].startswith(names[j]) or names[j].startswith(names[i])) and min(toxic[i], toxic[j]) >= ALIKE * max(toxic[i], toxic[j]) for j in chosen):
            continue
        if not chosen or near[i, chosen].max() < APART:
            chosen.append(i)
    return [names[i] for i in chosen]


def fit_machine(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float, float, float]:
    """Squared-hinge machine by Newton steps, and slope and offset of its logistic calibration."""
    sign = np.where(y > 0, 1.0, -1.0)
    cost = np.where(y > 0, len(y) / (2.0 * max(1, (y > 0).sum())), len(y) / (2.0 * max(1, (y <= 0).sum())))
    full = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(full.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-6
    for _ in range(50):
        gap = 1.0 - sign * (full @ w)
        on = gap > 0
        a = full[on] * cost[on, None]
        gradient = keep * w - a.T @ (sign[on] * gap[on])
        step = np.linalg.solve(a.T @ full[on] + np.diag(keep), gradient)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    m = full @ w
    ab = np.array([1.0, 0.0])
    prior = (y + 1.0 / 50) / (1 + 2.0 / 50)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(ab[0] * m + ab[1], -30, 30)))
        h = np.maximum(p * (1 - p), 1e-6) * cost
        g = (p - prior) * cost
        hessian = np.array([[(h * m * m).sum(), (h * m).sum()], [(h * m).sum(), h.sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, [(g * m).sum(), g.sum()])
        ab = ab - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1]), float(ab[0]), float(ab[1])


def train_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", most: int = MAX_TRAINING_ROWS, landmarks: int = LANDMARKS) -> dict | None:
    """The model: landmark words, one weight each, bias and calibration; None without both labels.

    The driver gets `landmarks` numbers for each of at most `most` training rows.
    """
    sample = F.broadcast(stored(training_sample(labels, label_col, most)))
    training = stored(docs.join(sample, "doc_id").select("doc_id", "label", "text"))
    names = choose_landmarks(training, landmarks)
    if not names:
        return None
    marks = Landmarks(names, BEGIN)

    def describe(batches):
        known = Known(marks)
        for batch in batches:
            x = [np.zeros((0, len(names)))] + [pooled(units_by_row(data, offsets), known) for _, data, offsets in text_slices(batch.column(2), SLICE)]
            x = np.concatenate(x).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"])
        del known
        give_back()

    rows = sorted(training.mapInArrow(describe, "doc_id long, label int, x binary").collect(), key=lambda r: (r["doc_id"], r["label"]))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], np.float64)
    y = np.array([r["label"] for r in rows], np.float64)
    value, vector = np.linalg.eigh(marks.gram())
    root = vector / np.sqrt(np.maximum(value, 1e-3)) @ vector.T
    w, bias, slope, offset = fit_machine(np.hstack([x @ root, x.max(axis=1, keepdims=True)]), y)
    return {"names": names, "weights": root @ w[:-1], "nearest": w[-1], "bias": bias, "slope": slope, "offset": offset}


def score_toxicity(docs: DataFrame, model: dict | None, id_cols: list[str], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`id_cols` of each row and, last, `score_col`."""
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(id_cols)])
    if model is None:
        return rows.withColumn("score", F.lit(0.0)).toDF(*id_cols, score_col)
    # a text that is kept is sent to the workers once
    kept, text = len(id_cols), id_cols.index(text_col) if text_col in id_cols and docs.schema[text_col].dataType.simpleString() == "string" else len(id_cols)
    if text == kept:
        rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(id_cols)], F.col(text_col).cast("string").alias("text"))

    def score(batches):
        known = Known(Landmarks(model["names"], BEGIN))
        for batch in batches:
            found = [np.zeros(0)]
            for _, data, offsets in text_slices(batch.column(text), SLICE):
                x = pooled(units_by_row(data, offsets), known)
                found.append(x @ model["weights"] + model["nearest"] * x.max(axis=1) + model["bias"])
            p = 1 / (1 + np.exp(-np.clip(model["slope"] * np.concatenate(found) + model["offset"], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(p)], names=[*batch.schema.names[:kept], "score"])
        del known
        give_back()

    kinds = ", ".join(f"c{i} {rows.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(id_cols)))
    return rows.mapInArrow(score, f"{kinds}, score double").toDF(*id_cols, score_col)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query: learns from labelled rows that aren't held out and scores every row."""
    rows = docs.select("doc_id", "text", (remainder("doc_id", 3) == 1).alias("held_out"))
    model = train_toxicity(rows.filter(~F.col("held_out")).select("doc_id", "text"), labels.filter(remainder("doc_id", 3) != 1))
    return score_toxicity(rows, model, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
