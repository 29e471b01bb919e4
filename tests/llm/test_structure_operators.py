"""Leaks, near-duplicates, mixing, chat trees, fingerprints and the pipeline."""

import collections
import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagloom.llm import chat, decontam, fingerprint, minhash, mixing
from tagloom.llm.common import sieve, text_slices

from .conftest import LONG, SF

ODD = (None, None, "", "", "  ", "a", "a", "A", LONG, LONG)


def sentence(rng, n, words=5000):
    return " ".join(f"w{x}" for x in rng.integers(0, words, n))


# -- leaks --------------------------------------------------------------------------------------


def test_leaks_are_found_and_others_left_alone(spark, docs):
    rng = np.random.default_rng(0)
    items = [sentence(rng, 30) + ". " + sentence(rng, 8) + "." for _ in range(20)] + [None, "", "too short", sentence(rng, 12)]
    swap = items[3].split()
    for i in range(2, 28, 5):
        swap[i] = "other"
    texts = [
        sentence(rng, 100) + " " + items[0] + " " + sentence(rng, 57),
        items[1].upper(),
        sentence(rng, 33) + " " + " ".join(swap) + " " + sentence(rng, 20),
        sentence(rng, 50) + " " + items[23] + " " + sentence(rng, 50),
        *[sentence(rng, 200) for _ in range(20)],
        *ODD,
    ]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.leaks_report(docs(*texts, extra=True), bench).collect()}
    assert found == {(0, 0), (1, 1), (2, 3), (3, 23)}
    assert decontam.leaks_report(docs("a").limit(0), bench).count() == 0
    assert decontam.leaks_report(docs("a b c d e f g"), bench.limit(0)).count() == 0


def test_longest_common_subsequence():
    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 4, rng.integers(1, 90)).tolist(), rng.integers(0, 4, rng.integers(0, 90)).tolist()
        assert decontam.lcs(a, b) == plain(a, b)


def test_latent_space_spans_the_leading_directions(spark):
    rng = np.random.default_rng(3)
    bench = spark.createDataFrame([(i, sentence(rng, 24, 60)) for i in range(30)], "item_id long, text string").repartition(3)
    passages = decontam.passages_of(decontam.benchmark_items(bench, "item_id", "text")).cache()
    idf = np.ones(1 << decontam.BITS)
    column, space = decontam.latent_space(passages, idf, 10)
    a = np.zeros((30, (column >= 0).sum()))
    for i, r in enumerate(passages.collect()):
        key, v = decontam.passage_vector(np.frombuffer(r["words"], np.uint64), idf)
        a[i, column[key]] = v / np.linalg.norm(v)
    best = np.linalg.svd(a)[1][:10]
    assert np.allclose(space.T @ space, np.eye(10), atol=1e-6)
    assert np.linalg.norm(a @ space) ** 2 > 0.97 * (best**2).sum()


def test_every_planted_passage_of_the_tables(spark, table):
    bench = {r[0]: r[1] for r in table("benchmark").collect()}
    found = {(r.doc_id, r.item_id) for r in decontam.leaks_report(table("documents"), table("benchmark")).collect()}
    whole = {(d, i) for d, t in table("documents").select("doc_id", "text").collect() for i, b in bench.items() if b in (t or "") and len(b.split()) >= 10}
    assert whole <= found


def plain_leaks(texts, items):
    """Pairs that the rules accept around any window, found without candidates."""
    found = set()

    def hashes(t):
        ((_, data, offsets),) = text_slices(pa.array([t]))
        return decontam.word_hashes(data, offsets)[0].tolist()

    for i, item in items.items():
        w = hashes(item)
        stops = [k + 1 for k, x in enumerate(item.split()[:-1]) if x[-1] in ".!?"]
        answer = stops[-1] if stops else len(w) * 3 // 4
        if len(w) < decontam.LEAST:
            continue
        for d, text in texts.items():
            h = hashes(text)
            for at in range(0, max(1, len(h) - decontam.STRIDE), decontam.STRIDE):
                around = h[max(0, at - len(w)) : at + decontam.WINDOW + len(w)]
                share = decontam.lcs(w, around) / len(w)
                part = max((decontam.lcs(w[s:e], around) / (e - s) for s, e in decontam.windows_of(len(w)) if e - s >= decontam.WINDOW), default=0)
                last = decontam.lcs(w[answer:], around) / max(1, len(w) - answer)
                if share >= decontam.COPIED or part >= decontam.PASSAGE or share >= decontam.PARAPHRASED and last >= decontam.ANSWER:
                    found.add((d, i))
                    break
    return found


def test_leaks_against_brute_force(spark, docs):
    rng = np.random.default_rng(9)
    items = {i: sentence(rng, int(rng.integers(8, 60)), 400) + ". " + sentence(rng, 6, 400) + "." for i in range(25)}
    texts = []
    for k in range(60):
        w = items[int(rng.integers(25))].split()
        w = [f"x{rng.integers(300)}" if rng.random() < (k % 6) / 10 else x for x in w]
        texts.append(" ".join([sentence(rng, int(rng.integers(1, 90)), 400), *w, sentence(rng, int(rng.integers(1, 90)), 400)]))
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = decontam.leaks_report(docs(*texts), bench).collect()
    found, plain = {(r.doc_id, r.item_id) for r in rows}, plain_leaks(dict(enumerate(texts)), items)
    assert found <= plain and len(found) >= 0.97 * len(plain) > 30
    assert sorted(rows) == sorted(decontam.leaks_report(docs(*texts), bench).collect())


def test_benchmark_of_odd_items(spark, docs):
    rng = np.random.default_rng(4)
    long = sentence(rng, 3000)
    items = [(None, "one two three four five six seven eight"), (1, long), (1, long), (1, sentence(rng, 20)), (2, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [sentence(rng, 40) + " " + long + " " + sentence(rng, 40), "a b one two three four five six seven eight c", long[:300]]
    df = docs(*texts)
    rows = decontam.leaks_report(df.union(df.selectExpr("null", "text", "lang", "source", "n_chars")), bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} >= {(0, 1), (1, None), (None, 1), (None, None)}


# -- near-duplicates ----------------------------------------------------------------------------


def plain_classes(texts, least=0.8):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(fold))
        return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()

    up = {i: i for i in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = {i: shingles(t) for i, t in texts.items() if t is not None}
    for a, b in itertools.combinations(sorted(sets), 2):
        either = sum((sets[a] | sets[b]).values())
        if texts[a] == texts[b] or either and sum((sets[a] & sets[b]).values()) >= least * either:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: root(i) for i in texts}


@pytest.mark.parametrize("seed", [0, 1])
def test_classes_equal_brute_force(spark, docs, seed, monkeypatch):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 4)  # so that block comparison has work too
    monkeypatch.setattr(minhash, "BLOCK", 8)
    texts = [*ODD]
    for _ in range(6):
        base = sentence(rng, int(rng.integers(40, 200))).split()
        for _ in range(25):
            copy = list(base)
            for at in rng.choice(len(copy), int(rng.integers(0, 4)), replace=False):
                copy[at] = f"n{rng.integers(1 << 30)}"
            texts.append(" ".join(copy))
    texts += [sentence(rng, n) for n in (1, 2, 3, 4, 5, 6, 50)]
    rows = minhash.dedup_report(docs(*texts, extra=True)).collect()
    assert {r.doc_id: r.class_id for r in rows} == plain_classes(dict(enumerate(texts)))
    assert len(rows) == len(texts)


def test_ids_do_not_name_texts(spark):
    """Null ids and one id with two texts; the links of a text are counted."""
    rng = np.random.default_rng(3)
    a, b = sentence(rng, 60), sentence(rng, 60)
    near = a.split()
    near[0] = "other"
    df = spark.createDataFrame([(None, a), (None, a), (5, a), (5, b), (None, b), (6, " ".join(near)), (None, "alone here"), (-4, b)], "doc_id long, text string")
    rows = sorted(minhash.dedup_report(df).collect(), key=str)
    assert len(rows) == 8
    assert {(r.doc_id, r.class_id, r.copy_of, r.links) for r in rows} == {(None, 5, 5, 1), (5, 5, 5, 1), (6, 5, 6, 1), (5, -4, -4, 0), (None, -4, -4, 0), (-4, -4, -4, 0), (None, None, None, 0)}
    kept = minhash.first_of_classes(df).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(5, a), (0, "alone here"), (-4, b)])


def test_repeated_rows_and_empty_tables(spark, docs):
    df = docs("a b c d e f", "a b c d e f")
    rows = minhash.dedup_report(df.union(df)).collect()
    assert len(rows) == 4 and {r.class_id for r in rows} == {0}
    assert minhash.dedup_report(df.limit(0)).count() == 0


def test_texts_are_not_dealt_out(spark, docs, monkeypatch):
    """No exchange carries texts, also where the planner finds the table of candidate ids large."""
    plans, keep = [], minhash.stored

    def stored(df):
        plans.append(df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
        return keep(df)

    monkeypatch.setattr(minhash, "stored", stored)
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rng = np.random.default_rng(11)
        base = sentence(rng, 60)
        rows = minhash.dedup_report(docs(base, base + " more", sentence(rng, 60), base)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert [r.class_id for r in sorted(rows)] == [0, 0, 2, 0]
    carried = [m for plan in plans for m in re.findall(r"\) Exchange\b[^\n]*\nInput \[\d+\]: \[([^\n]*)\]", plan)]
    assert len(carried) > 10 and not [x for x in carried if re.search(r"\btext#", x)]


@pytest.mark.parametrize("words", [1, 1 << 10])
def test_a_sieve_loses_no_row(spark, words):
    rows = spark.range(-500, 4500).selectExpr("id", "if(id % 7 = 0, null, id) AS other", "'t' AS text")
    found = rows.filter("id % 50 = 0").selectExpr("id AS a", "other AS b")
    kept = sieve(rows, F.xxhash64("id", "other"), found, F.xxhash64("a", "b"), words)
    ids = {r.id for r in kept.collect()}
    assert kept.columns == rows.columns and kept.count() == len(ids)
    assert {x for x in range(-500, 4500) if x % 50 == 0} <= ids and len(ids) < (4500 if words == 1 else 150)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 900, 3000)]
    other = base[:2400] + [f"v{x}" for x in range(600)]
    ((_, data, offsets),) = text_slices(pa.array([" ".join(base), " ".join(other)]))
    c, bounds = minhash.cells(data, offsets)
    s = minhash.signatures(c, bounds)
    a, b = set(c[: bounds[1]].tolist()), set(c[bounds[1] :].tolist())
    assert abs((s[0] == s[1]).mean() - len(a & b) / len(a | b)) < 0.15
    assert (s < np.iinfo(np.int64).max).all()


# -- mixing -------------------------------------------------------------------------------------


def plain_targets(total, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(total, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(total.values()), set(names), {}
    while open_:
        each = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * each > most * total[s] + 1e-9}
        if not full:
            return out | {s: w[s] * each for s in open_}
        for s in full:
            out[s] = most * total[s]
            left -= out[s]
        open_ -= full
    return out


def test_mixing(spark):
    rng = np.random.default_rng(0)
    rows = [(i, sentence(rng, int(rng.integers(0, 60))), [None, "a", "b", "é", "z"][int(rng.integers(0, 5))]) for i in range(900)]
    rows += [(900, None, "a"), (901, "", "only empty"), (902, LONG, "long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as target", "3 as id")
    got = mixing.mix(df).collect()
    total = collections.Counter()
    for _, t, s in rows:
        total[s] += len((t or "").split())
    want = plain_targets(total)
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        assert r.taken == r.copies * r["size"] <= 2 * r["size"] and r.source_size == total[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    assert len(got) == len(rows)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in total)
    again = {(r.doc_id, r.taken) for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    assert mixing.mix(df.limit(0)).count() == 0


def test_a_large_group_of_equal_rows_is_split(spark):
    """A third of all rows repeat one id and text; the source still meets its target."""
    rows = [(7, "a b c d", "x")] * 300 + [(i, "one two three", "x") for i in range(100, 500)] + [(i, "w " * 50, "y") for i in range(600, 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    taken, want = collections.Counter(), {r.source: r.target for r in got}
    for r in got:
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 50 for s in want)
    once = sorted((r.doc_id, r.taken) for r in got)
    assert once == sorted((r.doc_id, r.taken) for r in mixing.mix(df.repartition(3)).collect())


# -- chat ---------------------------------------------------------------------------------------


def test_escapes_are_reversible():
    for text in ("", "<|im_end|>", r"<\|x", r"<\\||", "<<|a|>", "a<", "|"):
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role("a%\n<|b")) == "a%\n<|b"


def test_chat_round_trip_and_tree(spark, table):
    odd = [(900, 1, None, None), (900, 0, "user", "hi\n"), (901, 0, "assistant", ""), (902, 0, "assistant", "x" * 50_000), (903, 0, "user", "hi\n"), (903, 1, "assistant", "<|im_end|>\n"), (903, 1, "assistant", "<|im_end|>\n")]
    extra = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string")
    df = table("conversations").unionByName(extra).selectExpr("*", "1 as node", "2 as tokens")
    turns = collections.defaultdict(list)
    for r in df.collect():
        turns[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    trick = "<|im_end|><|im_start|>assistant ok"
    turns[-1] = [(0, "user", trick), (1, "assistant", trick)]
    rows = {r.conv_id: r for r in chat.chat_report(df).collect()}
    assert set(rows) == set(turns)
    for c, listed in turns.items():
        listed.sort()
        mine = "".join(t for _, role, t in listed if role == "assistant")
        r = rows[c]
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in listed).encode()).hexdigest()
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(listed), len(mine), hashlib.sha256(mine.encode()).hexdigest())
        plain = "".join(f"<|im_start|>{chat.escape_role(a)}\n{chat.escape(t)}<|im_end|>\n" for _, a, t in listed)
        assert r.formatted_chars == len(plain)
    nodes, members = chat.prefix_trees(df)
    listed = sorted(nodes.collect(), key=lambda r: r.enter)
    at, stack = 0, []
    for r in listed:
        n = len(r.tokens) // 4
        assert r.enter == at and r.exit >= at + n
        at += n
        while stack and stack[-1].node != r.parent:
            stack.pop()
        assert bool(stack) == (r.parent != "")
        if stack:
            assert r.exit <= stack[-1].exit and r.position == stack[-1].position + len(stack[-1].tokens) // 4
        stack.append(r)
    shared = {(tuple(x[1:] for x in sorted(v)[: i + 1])) for c, v in turns.items() if c != -1 for i in range(len(v))}
    assert len(listed) == len(shared)
    assert chat.prefix_trees(df.limit(0))[0].count() == 0
    one = chat.token_ids(nodes).filter("depth = 1").first()
    assert one.position_ids == list(range(one.position, one.position + len(one.tokens)))


def test_many_subsequences_at_once_equal_single_ones():
    rng = np.random.default_rng(4)
    pairs = [(rng.integers(0, 9, n).tolist(), rng.integers(0, 12, m).tolist()) for n, m in [*rng.integers(1, 65, (60, 2)).tolist(), (64, 200), (64, 0), (1, 1)]]
    marks = [[decontam._marks(mine).get(w, 0) for w in other] for mine, other in pairs]
    n = np.array([len(x) for x in marks])
    got = decontam.lcs_many(np.array([y for x in marks for y in x], np.uint64), np.cumsum(n) - n, n, np.array([len(mine) for mine, _ in pairs]))
    assert got.tolist() == [decontam.lcs(mine, other) for mine, other in pairs]


def made_block(items):
    """A block of `items`, lists of word hashes, with a latent dimension for each word."""
    known = np.unique(np.concatenate([np.array(w, np.uint64) for w in items]))
    column = np.full(1 << decontam.BITS, -1, np.int32)
    kinds = np.unique(decontam.buckets_of(known))
    column[kinds] = np.arange(len(kinds))
    weighted = np.vstack([np.eye(len(kinds)), np.zeros((1, len(kinds)))]).astype(np.float32)
    listed = [(i, s, e, w, len(w) * 3 // 4) for i, w in enumerate(items) for s, e in decontam.windows_of(len(w))]
    return decontam._Passages(listed, np.where(column >= 0, column, len(kinds)).astype(np.int32), weighted)


def test_candidates_whose_words_come_in_another_order_are_not_read():
    rng = np.random.default_rng(6)
    item = rng.integers(0, 1 << 63, 40, np.uint64).tolist()
    other = rng.integers(0, 1 << 63, 200, np.uint64).tolist()
    texts = [other[:50] + item + other[50:], other[:50] + item[::-1] + other[50:], other]
    h, bounds = np.array(sum(texts, []), np.uint64), np.cumsum([0, *map(len, texts)])
    assert {row for row, _ in decontam._candidates(h, bounds, made_block([item]), 0.3)} == {0}


def test_no_candidate_that_holds_an_item_is_lost():
    """Items of all lengths, words that share a class, repeated words: what reading them all finds is found."""
    rng = np.random.default_rng(8)
    words = rng.integers(0, 1 << 63, 60, np.uint64)
    words[30:] = words[:30] ^ np.uint64(1)  # other words of the same class
    items = [rng.choice(words, n).tolist() for n in (6, 14, 30, 63, 64, 65, 90, 130, 400)]
    texts = [rng.choice(words, 300).tolist() for _ in range(20)]
    for i, w in enumerate(items):
        texts[i] = texts[i][:100] + [x for x in w if rng.random() < 0.85] + texts[i][100:]
    block = made_block(items)
    h, bounds = np.array(sum(texts, []), np.uint64), np.cumsum([0, *map(len, texts)])
    got = {(row, found[0]) for row, hits in decontam._candidates(h, bounds, block, 0.2) for found in decontam._checked(np.array(texts[row], np.uint64), hits, block)}
    column, plain = block.column[decontam.buckets_of(h)], set()
    for row, text in enumerate(texts):
        kind = column[bounds[row] : bounds[row + 1]]
        starts = range(0, max(1, len(text) - decontam.STRIDE), decontam.STRIDE)
        vectors = np.array([block.weighted[kind[a : a + decontam.WINDOW]].sum(axis=0) for a in starts])
        cosine = vectors @ block.latent / np.linalg.norm(vectors, axis=1, keepdims=True)
        hits = [(starts[a], int(j), float(cosine[a, j])) for a, j in zip(*np.nonzero(cosine >= 0.2), strict=True)]
        plain |= {(row, found[0]) for found in decontam._checked(np.array(text, np.uint64), hits, block)}
    assert got == plain and {(i, i) for i in range(1, len(items))} <= got


def test_words_lose_outer_punctuation():
    raw = ['a "b" (c)... --- x-y', "", "\u00e9! ,z", "--- ... a"]
    data = np.frombuffer("".join(raw).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in raw)])
    plain = ["a", "b", "c", "---", "x-y", "\u00e9", "z", "---", "...", "a"]
    flat = np.frombuffer("".join(plain).encode(), np.uint8)
    ends = np.cumsum([len(t.encode()) for t in plain])
    h, bounds = decontam.word_hashes(data, offsets)
    assert bounds.tolist() == [0, 5, 5, 7, 10]
    assert h.tolist() == decontam.span_hashes(flat, np.append(0, ends[:-1]), ends, decontam.VALUES_LOWER).tolist()


def test_document_frequencies(spark, docs):
    texts = ["a b a", "b", None, "", *["c a"] * 20_000]
    got, n = decontam.document_frequencies(docs(*texts).coalesce(1), "text")
    at = {w: int(decontam.buckets_of(decontam.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, 1]))[0])[0]) for w in "abc"}
    assert n == len(texts) and [got[at[w]] for w in "abc"] == [20_001, 2, 20_000] and got.sum() == 40_003


# -- fingerprints -------------------------------------------------------------------------------


def test_fingerprints(spark, docs):
    rng = np.random.default_rng(0)
    texts = [sentence(rng, 300), *ODD, sentence(rng, 5), "é" * 501, sentence(rng, 200)]
    texts.append(texts[-1])
    df = docs(*texts, extra=True)
    listed = [t or "" for t in texts]
    rows = {r.doc_id: r for r in fingerprint.fingerprint_report(df.repartition(5)).collect()}
    for i, t in enumerate(listed):
        after = listed[(i + 1) % len(listed)]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = rows[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.near_next == 1.0) >= (t == after) and 0 <= r.near_edited <= 1
        assert (edited == t) <= (r.near_edited == 1.0)
    by_text = collections.defaultdict(set)
    for i, t in enumerate(listed):
        by_text[t].add(rows[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert rows[0].near_edited > 0.15 > rows[0].near_next
    assert fingerprint.fingerprint_report(df.limit(0)).count() == 0
    assert fingerprint.fingerprint_report(docs("abc")).first().near_next == 1.0


def test_pieces_agree_with_one_piece(spark, table):
    df = table("documents")
    whole = {tuple(r) for r in fingerprint.fingerprint_report(df).collect()}
    old, fingerprint.with_next.__defaults__ = fingerprint.with_next.__defaults__, ("doc_id", "text", 20_000)
    try:
        assert {tuple(r) for r in fingerprint.fingerprint_report(df.repartition(3)).collect()} == whole
    finally:
        fingerprint.with_next.__defaults__ = old


@pytest.mark.parametrize("piece_bytes", [4000, 1 << 30])
def test_neighbours_of_any_ids(spark, piece_bytes, monkeypatch):
    """Large, null and repeated ids lose no row, and each row's next is the one that follows."""
    rng = np.random.default_rng(6)
    monkeypatch.setattr(fingerprint.with_next, "__defaults__", ("doc_id", "text", piece_bytes))
    rows = [((1 << 60) + 3 * i, sentence(rng, int(rng.integers(0, 60)))) for i in range(300)]
    rows += [(-(1 << 63), "lowest"), (None, sentence(rng, 30)), ((1 << 63) - 1, "highest"), (None, None)]
    rows += [((1 << 60) + 1, sentence(rng, 40)) for _ in range(100)]  # one id, many texts
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = fingerprint.fingerprint_report(df.repartition(5)).collect()
    assert len(out) == len(rows)
    plain = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")).collect()
    plain.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.tie))
    want = set()
    for r, after in zip(plain, plain[1:] + plain[:1], strict=True):
        half = len(r.text) // 2
        want.add((r.doc_id, len(r.text), hashlib.sha256((r.text[: len(r.text) - half] + after.text[:half]).encode()).hexdigest()))
    assert {(r.doc_id, r.n_chars, r.edited_sha256) for r in out} == want
    for r in out[:20]:
        assert len(r.fingerprint) % 8 == 0


def test_names_are_told_apart_without_hashing(monkeypatch):
    """`np.unique` of many 64-bit numbers took two fifths of the time."""
    rng = np.random.default_rng(3)
    data = rng.integers(97, 123, 200_000, np.uint8)
    data[100_000:] = np.tile(data[:50], 2000)
    offsets = np.array([0, 0, 60_000, 100_000, 200_000])
    seen, unique = [0], np.unique
    monkeypatch.setattr(np, "unique", lambda x, *a, **k: (seen.append(len(x)), unique(x, *a, **k))[1])
    got = fingerprint.sketches(data, offsets)
    assert max(seen) < 1000
    assert [len(x) for x in got][:3] == [0, 64, 64] and all((np.diff(x.astype(np.int64)) > 0).all() for x in got)


def test_lowest_bit():
    x = np.array([(1 << i) | (rest << i + 1) & (1 << 64) - 1 for i in range(64) for rest in (0, 1, 0x9E3779B97F4A7C15)], np.uint64)
    assert fingerprint._lowest_bit(x).tolist() == [i for i in range(64) for _ in range(3)]


def plain_sketch(text, keep=fingerprint.KEEP, level=fingerprint.LEVEL):
    """The fingerprint symbol by symbol."""
    full = (1 << 64) - 1

    def mix(v):
        return int(fingerprint.mix64(np.array([v & full], np.uint64))[0])

    def coin(own, left):
        bit = ((own ^ left) & -(own ^ left)).bit_length() - 1
        return bit << 1 | own >> bit & 1

    x, k, names = [int(fingerprint._SYMBOLS[c]) for c in text.encode()], 0, set()
    while x:
        single = len(x) == 1
        k += 1
        runs = [(v, len(list(g))) for v, g in itertools.groupby(x)]
        x = [mix(v + n * 0x2545F4914F6CDD1D) if n > 1 else v for v, n in runs]
        label = [coin(v, x[i - 1] if i else v ^ 1) for i, v in enumerate(x)]
        for _ in range(2):
            label = [coin(v, label[i - 1] if i else v ^ 1) for i, v in enumerate(label)]
        begin = [i > 0 and label[i] > label[i - 1] and label[i] >= (label[i + 1] if i + 1 < len(label) else 0) for i in range(len(label))]
        begin = [i == 0 or i > 1 and b and not begin[i - 1] for i, b in enumerate(begin)]
        starts = [i for i, b in enumerate(begin) if b] + [len(x)]
        y = [mix(sum(mix(x[i] + (i - a) * 0x9E3779B97F4A7C15) for i in range(a, b)) + b - a) for a, b in itertools.pairwise(starts)]
        if k >= level:
            names |= {mix(v + k) >> 32 for v in y}
        elif len(y) == 1:
            names |= {mix(v) >> 32 for v in y}
        if single or len(y) == 1:
            break
        x = y
    return sorted(names)[:keep]


def test_fingerprints_equal_those_made_symbol_by_symbol(spark, docs):
    rng = np.random.default_rng(8)
    texts = ["", "a", "aa", "ab", "abc", "aaaaabbbbb", "é" * 9 + "x", *[sentence(rng, int(n), 40) for n in rng.integers(1, 300, 25)]]
    rows = fingerprint.fingerprint_report(docs(*texts)).collect()
    for r in rows:
        own, after = texts[r.doc_id], texts[(r.doc_id + 1) % len(texts)]
        a, b = plain_sketch(own), plain_sketch(after)
        assert r.fingerprint == "".join(f"{v:08x}" for v in a)
        either = sorted(set(a) | set(b))[: fingerprint.KEEP]
        like = len(set(a) & set(b) & set(either)) / len(either) if a and b else float(len(a) == len(b))
        assert abs(r.near_next - like) < 1e-12


def test_interior_names_do_not_depend_on_offset():
    rng = np.random.default_rng(2)
    text = sentence(rng, 800)
    column = pa.array(["prefix of some length " + text, text])
    ((_, data, offsets),) = text_slices(column)
    a, b = fingerprint.sketches(data, offsets, keep=100_000)
    assert len(np.intersect1d(a, b)) > 0.9 * len(b)


# -- pipeline -----------------------------------------------------------------------------------


def test_pipeline_rows_and_names(spark, table, tmp_path):
    """Null ids, one id with two texts, repeated rows and columns of every clashing name."""
    import corpus_pipeline as P

    rng = np.random.default_rng(12)
    leak = table("benchmark").first()["text"]
    base = table("documents").limit(60)
    texts = [sentence(rng, 30) for _ in range(4)]
    held = [(None, texts[0], "en", "s", 3), (None, texts[0], "en", "s", 3), (None, texts[1], "en", "s", 3), (None, leak, "en", "s", 3)]
    held += [(70_000, texts[2], "en", "s", 3), (70_000, leak, "en", "s", 3), (70_001, texts[3], "en", "s", 3), (70_001, texts[3], "fr", "s", 3), (70_002, None, None, None, None)]
    names = ("size", "target", "copies", "taken", "score", "rate", "kept", "id", "node", "row", "draw", "source_size", "held_out", "c0", "rep")
    docs = base.unionByName(spark.createDataFrame(held, base.schema)).selectExpr("*", *[f"{i} as {c}" for i, c in enumerate(names)])
    now = docs
    for name, stage in P.STAGES:
        out = stage(spark, now, SF)
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        now = spark.read.parquet(path)
        mine = now.filter("doc_id is null or doc_id >= 70000").collect()
        kept = sorted((r.doc_id or 0, r.text or "") for r in mine)
        if name == "near_dedup":
            assert kept == sorted([(0, texts[0]), (0, texts[1]), (70_000, texts[2]), (70_001, texts[3]), (70_002, ""), *[k for k in kept if k[1] == leak]])
        if name == "decontamination":
            assert kept == sorted([(0, texts[0]), (0, texts[1]), (70_000, texts[2]), (70_001, texts[3]), (70_002, "")])
    assert now.columns == [*docs.columns, "mix_size", "mix_target", "mix_copies", "mix_taken"]
    assert now.filter("doc_id is null").count() <= 2 and now.filter("doc_id = 70000").count() <= 1
    assert {tuple(r[c] for c in names) for r in now.collect()} == {tuple(range(len(names)))}


def test_pipeline_stages(spark, table, tmp_path):
    import corpus_pipeline as P

    docs = table("documents")
    extra = docs.limit(3).select((F.col("doc_id") + 10_000).alias("doc_id"), *docs.columns[1:])
    held = spark.createDataFrame([(None, "no id at all", "en", "s", 3), (20_000, None, "en", None, 0)], docs.schema)
    now = docs.union(extra).union(held)
    for name, stage in P.STAGES:
        out = stage(spark, now, SF)
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        now = spark.read.parquet(path)
        if name == "near_dedup":
            texts = now.filter("doc_id is not null and text is not null")
            assert texts.select("text").distinct().count() == texts.count()
    assert now.filter("copies < 1 or taken > 2 * size").isEmpty() and now.count() > 0
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "mixing"]
