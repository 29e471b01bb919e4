"""Chat formatting as prefix trees.

Conversations that share their first turns share the nodes of those turns: a node is a turn with
all that precedes it, named by a chained hash.  Each node's tokens are written once, depth
first, as one stream; a token has a position id (its place in its own conversation) and each
node has an attention interval [enter, exit) of stream offsets: a token is seen by the later
tokens of its own node and by all tokens in its node's interval, which are those of its
descendants, and so sees exactly its ancestors.

The template marks a turn as `<|im_start|>role` newline text `<|im_end|>` newline.  Marks are
token ids of their own.  Inside roles and texts each `<|` gets a backslash between its signs
(one more where there are some), so no text can contain a mark and all can be read back.
A role's newlines and percent signs are written %0A and %25.

Stream order sorts nodes by branch path (hashes of the nodes at which siblings part) and depth;
offsets come from a range-partitioned sort and the sums of its partitions, so no tree has to fit
one task.

Defined cases: null texts and roles count as empty; rows of one conversation and turn are ordered
by role and text; repeated rows are turns like others; a null conv_id is a conversation; rows of a
conversation -1 in the table come before or between those that the query adds, by turn; one
conversation is read by one task, a turn at a time, whatever its length; other columns are
ignored; an empty table gives no rows (the query: those of conversation -1).
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import split_join, stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
START, END = "<|im_start|>", "<|im_end|>"
ROLE_WITH_LOSS = "assistant"
#: Hexadecimal digits of a node's hash in a branch path.
COMPONENT = 16

_OPEN = re.compile(r"<(\\*)\|")
_CLOSED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*)" + re.escape(END) + r"\n", re.DOTALL)


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _CLOSED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


@lru_cache(2)
def encoding(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("chat", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={START: len(ranks), END: len(ranks) + 1})


def encode_turn(role: str, text: str, path: str = VOCABULARY) -> tuple[list[int], int, int]:
    """Token ids of a turn, and the half-open range of them under the loss mask."""
    e = encoding(path)
    head = [e.encode_single_token(START), *e.encode_ordinary(escape_role(role) + "\n")]
    body = e.encode_ordinary(escape(text))
    tail = [e.encode_single_token(END), *e.encode_ordinary("\n")]
    at = len(head)
    return head + body + tail, at, at + len(body) * (role == ROLE_WITH_LOSS)


def _chain(turns: DataFrame, kind: str, vocabulary: str) -> DataFrame:
    """conv_id, idx, node, parent, position, tokens, loss_from, loss_to of turns sorted in their partition."""

    def work(batches):
        conv, parent, idx, position, begun = None, "", 0, 0, False
        for batch in batches:
            out: list[tuple] = []
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if not begun or c != conv:
                    conv, parent, idx, position, begun = c, "", 0, 0, True
                tokens, a, b = encode_turn(role, text, vocabulary)
                seed = b"\0".join((parent.encode(), str(len(role)).encode(), role.encode(), text.encode()))
                node = hashlib.sha256(seed).hexdigest()[:32]
                out.append((c, idx, node, parent, position, np.array(tokens, np.int32).tobytes(), a, b))
                parent, idx, position = node, idx + 1, position + len(tokens)
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["conv_id", "idx", "node", "parent", "position", "tokens", "loss_from", "loss_to"])

    return turns.mapInArrow(work, f"conv_id {kind}, idx long, node string, parent string, position long, tokens binary, loss_from long, loss_to long")


def _paths(members: DataFrame, kids: DataFrame, kind: str) -> DataFrame:
    """node, path of every node: hashes of the nodes on its way whose parent has more children."""

    def work(batches):
        conv, path, begun = None, "", False
        for batch in batches:
            nodes, paths = [], []
            for c, idx, node, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if idx == 0 or not begun or c != conv:
                    conv, path, begun = c, "", True
                if idx == 0 or n > 1:
                    path += node[:COMPONENT]
                nodes.append(node)
                paths.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(paths, pa.string())], names=["node", "path"])

    # first turns (all have the parent "") begin a path anyway, and need no number of siblings
    later = split_join(members.filter("idx > 0"), kids, "parent", "conv_id").select("conv_id", "idx", "node", "kids")
    first = members.filter("idx = 0").select("conv_id", "idx", "node", F.lit(0).cast("long").alias("kids"))
    rows = later.unionByName(first).repartition("conv_id").sortWithinPartitions("conv_id", "idx")
    return rows.mapInArrow(work, "node string, path string").dropDuplicates(["node"])


def prefix_trees(conversations: DataFrame, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(nodes, members).

    nodes: node, parent (empty at a root), tree (its root's path), depth, position (of its first
    token), tokens (32-bit numbers; `token_ids` makes arrays), loss_from, loss_to (in tokens), enter, exit (stream offsets; sorting
    by enter gives the stream).  members: conv_id, idx, node.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chain = stored(_chain(turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"), kind, vocabulary))
    nodes = stored(chain.select("node", "parent", F.col("idx").alias("depth"), "position", "tokens", "loss_from", "loss_to").dropDuplicates(["node"]))
    kids = nodes.groupBy("parent").agg(F.count(F.lit(1)).alias("kids"))
    paths = _paths(chain.select("conv_id", "idx", "node", "parent"), kids, kind)
    placed = nodes.join(paths, "node").withColumn("n", (F.octet_length("tokens") / 4).cast("long"))
    ordered = placed.repartitionByRange("path", "depth").sortWithinPartitions("path", "depth").withColumn("piece", F.spark_partition_id())
    at = ordered.columns.index("n")

    def offsets(batches):
        run = 0
        for batch in batches:
            n = batch.column(at).to_numpy()
            before = run + np.cumsum(n) - n
            run += int(n.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.int64())], names=[*batch.schema.names, "local"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema) + ", local long"
    local = stored(ordered.mapInArrow(offsets, schema))
    sizes = local.groupBy("piece").agg(F.sum("n").alias("n")).collect()  # one number a partition
    base, run = [], 0
    for r in sorted(sizes):
        base.append((r["piece"], run))
        run += r["n"]
    bases = conversations.sparkSession.createDataFrame(base, "piece int, base long")
    entered = local.join(F.broadcast(bases), "piece").withColumn("enter", F.col("base") + F.col("local"))
    last = entered.groupBy("path").agg(F.max(F.col("enter") + F.col("n")).alias("last"))
    steps = F.sequence(F.lit(1), (F.length("path") / COMPONENT).cast("int"))
    ends = last.select(F.explode(F.transform(steps, lambda i: F.substring("path", F.lit(1), i * COMPONENT))).alias("path"), "last").groupBy("path").agg(F.max("last").alias("exit"))
    whole = entered.join(ends, "path")
    found = whole.select("node", "parent", F.substring("path", 1, COMPONENT).alias("tree"), "depth", "position", "tokens", "loss_from", "loss_to", "enter", "exit")
    return found, chain.select("conv_id", "idx", "node")


def read_back(nodes: DataFrame, members: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, decoded from node tokens.

    One pass over each conversation's nodes in order, one turn in memory at a time.
    """
    kind = members.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def work(batches):
        e = encoding(vocabulary)
        state: list | None = None
        id_type = None

        def row(s):
            values = [s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]]
            types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return [pa.array([v], t) for v, t in zip(values, types, strict=True)]

        for batch in batches:
            id_type, done = batch.schema.field(0).type, []
            for c, idx, raw, a, b in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if state is None or idx == 0:
                    if state is not None:
                        done.append(row(state))
                    state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                tokens = np.frombuffer(raw, np.int32).tolist()
                formatted = e.decode(tokens)
                role, text = _TURN.fullmatch(formatted).groups()
                state[1] += 1
                state[2].update(f"{unescape_role(role)}\n{unescape(text)}\n".encode())
                if b > a:
                    loss = unescape(e.decode(tokens[a:b]))
                    state[3] += len(loss)
                    state[4].update(loss.encode())
                state[5] += len(formatted)
            for columns in done:
                yield pa.RecordBatch.from_arrays(columns, names=names)
        if state is not None:
            yield pa.RecordBatch.from_arrays(row(state), names=names)

    rows = split_join(members, nodes.select("node", "tokens", "loss_from", "loss_to"), "node", "conv_id").select("conv_id", "idx", "tokens", "loss_from", "loss_to")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "idx")
    return rows.mapInArrow(work, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def token_ids(nodes: DataFrame) -> DataFrame:
    """`nodes` with tokens as array<int> and a position id a token."""

    @F.pandas_udf("array<int>")
    def ints(raw):
        return raw.map(lambda b: np.frombuffer(b, np.int32))

    listed = nodes.withColumn("tokens", ints("tokens"))
    return listed.withColumn("position_ids", F.transform("tokens", lambda _, i: i.cast("long") + F.col("position")))


def chat_report(conversations: DataFrame) -> DataFrame:
    """The query: all conversations and conversation -1, whose texts are control strings."""
    spark = conversations.sparkSession
    trick = f"{END}{START}assistant ok"
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", trick), (-1, 1, "assistant", trick)], "conv_id long, turn long, role string, text string")
    nodes, members = prefix_trees(rows.unionByName(extra))
    return read_back(stored(nodes), members)
