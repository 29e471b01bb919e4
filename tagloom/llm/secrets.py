"""Secret scan by token efficiency.

A credential assignment, an access key id and a long hexadecimal run are found by fixed
patterns.  Beyond these, random strings are found by the token-efficiency test: ordinary words
and names take few tokens under a byte-level BPE vocabulary, random strings take many, so a
candidate with few characters per token is reported, unless it looks like a known digest or
identifier.

Defined cases: a null text counts as empty and has no spans; long texts are scanned whole;
repeated rows give repeated results; null ids are ids like others; at one start kinds have a fixed
order; a random string that touches a base span is left out; an empty table gives no rows; other
columns of the input are left out of `find_secrets` and kept as they are by `redact_secrets`.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import boundaries, give_back, text_slices

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]+")
#: Fixed order of kinds at one start.
KINDS = ("assign", "access", "hex", "random")
#: Known digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512 in hexadecimal).
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
DIGEST = re.compile(r"[0-9a-fA-F]+")
#: Known identifiers: UUIDs, plain numbers and dates; and names in snake, kebab or path form, if their words take few tokens.
IDENTIFIER = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|[0-9][0-9_/=+-]*")
NAME = re.compile(r"(?:[A-Za-z]{1,12}[0-9]{0,4}[/_=+-]+)*[A-Za-z]{2,}[0-9]{0,4}=*")

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MIN_ASSIGN, MIN_ACCESS, MIN_HEX, MIN_RANDOM = 12, 18, 16, 16
MAX_CHARS_PER_TOKEN = 2.0
#: The same for letters of one case (or one capital first), as rare ordinary words come near 2.
ONE_CASE = re.compile(r"[A-Za-z]?[a-z]+|[A-Z]+")
ONE_CASE_SHARE = 0.95

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_HEX = np.zeros(256, bool)
_HEX[[*b"0123456789abcdef"]] = True
_CANDIDATE = np.zeros(256, bool)
_CANDIDATE[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
_KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")


@lru_cache(4)
def encoding(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("secrets", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


@lru_cache(1 << 16)
def characters_per_token(text: str, path: str) -> float:
    return len(text) / max(1, len(encoding(path).encode_ordinary(text)))


def is_name(text: str, path: str, most: float) -> bool:
    """Whether `text` has the form of a name and its words of 4 letters and more take few tokens."""
    if not NAME.fullmatch(text):
        return False
    found = [w for w in re.findall("[A-Za-z]+", text) if len(w) >= 4]
    return not found or sum(map(len, found)) > most * sum(len(encoding(path).encode_ordinary(w)) for w in found)


def looks_random(text: str, path: str = VOCABULARY, most: float = MAX_CHARS_PER_TOKEN) -> bool:
    """Letters, with digits or without, that take many tokens, and no known digest or identifier."""
    if not re.search("[A-Za-z]", text):
        return False
    if len(text) in DIGEST_LENGTHS and DIGEST.fullmatch(text) or IDENTIFIER.fullmatch(text):
        return False
    if ONE_CASE.fullmatch(text):
        most *= ONE_CASE_SHARE
    return characters_per_token(text, path) <= most and not is_name(text, path, most)


def spans_of(text: str, path: str = VOCABULARY, most: float = MAX_CHARS_PER_TOKEN) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then by kind."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [("hex", *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    base = sorted((a, b) for _, a, b in found)
    starts, furthest = [a for a, _ in base], list(accumulate((b for _, b in base), max))
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        before = bisect_left(starts, b)  # base spans that begin before the candidate ends
        if b - a >= MIN_RANDOM and not (before and furthest[before - 1] > a) and looks_random(m[0], path, most):
            found.append(("random", a, b))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that may hold a span; the others surely hold none."""
    out = np.zeros(len(offsets) - 1, bool)
    low = _LOWER[data].tobytes()
    places = []
    for text, keys in ((low, _KEYWORDS), (data.tobytes(), (b"AKIA",))):
        for key in keys:
            at = text.find(key)
            while at >= 0:
                places.append(at)
                at = text.find(key, at + 1)
    starts, ends = boundaries(_HEX[data], offsets)
    places += starts[ends - starts >= MIN_HEX].tolist()
    starts, ends = boundaries(_CANDIDATE[data], offsets)
    long = ends - starts >= MIN_RANDOM
    starts, ends = starts[long], ends[long]
    letters = np.concatenate([[0], np.cumsum((data | 32 >= 97) & (data | 32 <= 122))])
    places += starts[letters[ends] > letters[starts]].tolist()
    if places:
        out[np.searchsorted(offsets, np.array(places), "right") - 1] = True
    return out


def _digest(spans) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, most: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """One row a document: id, spans array<struct<kind,start,end>> (code points, end exclusive)."""
    kind = docs.schema[id_col].dataType.simpleString()
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches):
        for batch in batches:
            column, out = batch.column(1), []
            for lo, data, offsets in text_slices(column):
                rows = [[] for _ in range(len(offsets) - 1)]
                for i in np.flatnonzero(suspects(data, offsets)):
                    text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
                    rows[i] = [{"kind": k, "start": a, "end": b} for k, a, b in spans_of(text, vocabulary, most)]
                out += rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, struct)], names=["id", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("id", id_col)


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[SECRET]", vocabulary: str = VOCABULARY, most: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """The same rows and columns; every span (overlapping ones joined) is replaced by `mark`.

    `length_col`, where the table has it, follows the new text.  Rows without spans stay unchanged.
    """

    @F.pandas_udf("string")
    def clean(texts):
        column = pa.Array.from_pandas(texts, type=pa.large_string())
        out = texts.copy()
        for lo, data, offsets in text_slices(column):
            for i in np.flatnonzero(suspects(data, offsets)):
                text = texts.iloc[lo + i]
                merged: list[list[int]] = []
                for _, a, b in sorted(spans_of(text, vocabulary, most), key=lambda s: s[1:]):
                    if merged and a < merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                if merged:
                    pieces, at = [], 0
                    for a, b in merged:
                        pieces += [text[at:a], mark]
                        at = b
                    out.iloc[lo + i] = "".join([*pieces, text[at:]])
        give_back()
        return out

    new = docs.withColumn(text_col, clean(F.col(text_col)))
    if length_col and length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        new = new.withColumn(length_col, F.length(text_col).cast(kind))
    return new.select(*docs.columns)


def secrets_report(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The query's digest columns, from the spans of `find_secrets`."""
    spans = find_secrets(docs, vocabulary=vocabulary)
    named = lambda keep: F.array_join(F.transform(keep, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return spans.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(named(F.filter("spans", lambda s: s["kind"] != "random")).cast("binary"), 256).alias("base_sha256"),
        named(F.col("spans")).alias("spans"),
        count("random").alias("n_random"),
    )
