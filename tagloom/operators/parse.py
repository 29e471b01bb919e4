"""Parsing as columns and relations.

`parse_html(column)` is one scalar Arrow UDF (the kernel); everything else here is DataFrame
code over its result.  Relations: `documents` (one row a document), `nodes`, `errors`, `tokens`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import charsets, tables as T
from tagloom.functions.lexer import _INVALID
from tagloom.functions.treebuilder import Reparse, TreeBuilder

ATTR = "struct<ns:string,prefix:string,name:string,value:string>"
NODE = (
    "struct<node_id:int,parent_id:int,enter_seq:int,exit_seq:int,depth:int,child_idx:int,kind:string,ns:string,name:string,value:string,"
    f"public_id:string,system_id:string,attrs:array<{ATTR}>>"
)
ERROR = "struct<line:int,col:int,code:string,vars:map<string,string>>"
LOG = "struct<content_model:string,mode:string,used_mode:string,token:string,name:string>"
DOCUMENT = f"encoding string, confidence string, compat_mode string, nodes array<{NODE}>, errors array<{ERROR}>, log array<{LOG}>"

_ATTR_TYPE = pa.struct([(n, pa.string()) for n in ("ns", "prefix", "name", "value")])
_NODE_TYPE = pa.struct(
    [(n, pa.int32()) for n in ("node_id", "parent_id", "enter_seq", "exit_seq", "depth", "child_idx")]
    + [(n, pa.string()) for n in ("kind", "ns", "name", "value", "public_id", "system_id")]
    + [("attrs", pa.list_(_ATTR_TYPE))]
)
_ERROR_TYPE = pa.struct([("line", pa.int32()), ("col", pa.int32()), ("code", pa.string()), ("vars", pa.map_(pa.string(), pa.string()))])
_LOG_TYPE = pa.struct([(n, pa.string()) for n in ("content_model", "mode", "used_mode", "token", "name")])
_DOC_TYPE = pa.struct([("encoding", pa.string()), ("confidence", pa.string()), ("compat_mode", pa.string()), ("nodes", pa.list_(_NODE_TYPE)), ("errors", pa.list_(_ERROR_TYPE)), ("log", pa.list_(_LOG_TYPE))])
_KINDS = ("Doctype", "Characters", "SpaceCharacters", "StartTag", "EndTag", "Comment")
_SURROGATE = re.compile("[\ud800-\udfff]")
_NEWLINE = re.compile("\r\n?")


def build(source: str | bytes, fragment=None, scripting=False, want=("nodes", "errors"), **hints) -> tuple:
    """(finished tree builder, its text, encoding, confidence, invalid characters); `hints` are the arguments of `charsets.determine`."""
    encoding = confidence = None
    text = source
    if isinstance(source, bytes):
        encoding, confidence, skip = charsets.determine(source, **hints)
        text = charsets.decode(source[skip:], encoding)
    while True:
        text = _NEWLINE.sub("\n", text)
        invalid = [(m.start(), "invalid-codepoint", {}) for m in _INVALID.finditer(text)] if "errors" in want else []
        text = _SURROGATE.sub("�", text)

        def late(charset, content):
            nonlocal confidence
            if confidence != "tentative":
                return
            name = charsets.lookup(charset if charset is not None else charsets.charset_in_content(content))
            if name is None or name.startswith("utf-16"):
                return
            confidence = "certain"
            if name != encoding:
                raise Reparse(name)

        builder = TreeBuilder(text, fragment, scripting, late if isinstance(source, bytes) else None, "log" in want)
        try:
            builder.run()
            break
        except Reparse as again:
            encoding = again.encoding
            text = charsets.decode(source, encoding)
    return builder, text, encoding, confidence, invalid


def parse_one(source: str | bytes, fragment=None, scripting=False, want=("nodes", "errors"), namespace_html=True, **hints) -> dict:
    """The kernel on one document; without `namespace_html` elements of HTML have no namespace."""
    builder, text, encoding, confidence, invalid = build(source, fragment, scripting, want, **hints)
    out = {"encoding": encoding, "confidence": confidence, "compat_mode": builder.quirks, "nodes": None, "errors": None, "log": None}
    if "nodes" in want:
        names = ("kind", "parent_id", "enter_seq", "exit_seq", "depth", "child_idx", "ns", "name", "value", "public_id", "system_id", "attrs")
        out["nodes"] = [dict(zip(names, r, strict=True)) | {"node_id": i, "attrs": [dict(zip(("ns", "prefix", "name", "value"), a, strict=True)) for a in r[-1]]} for i, r in enumerate(builder.rows())]
        if not namespace_html:
            for node in out["nodes"]:
                node["ns"] = None if node["ns"] == T.HTML else node["ns"]
    if "errors" in want:
        found = sorted(invalid + builder.errors, key=lambda e: e[0]) if invalid else builder.errors
        out["errors"] = []
        line, last, start = 1, 0, 0
        for at, code, values in found:
            at = min(at, len(text))
            if at < last:
                line, last, start = 1, 0, 0
            n = text.count("\n", last, at)
            if n:
                line, start = line + n, text.rfind("\n", last, at) + 1
            last = at
            out["errors"].append({"line": line, "col": at - start, "code": code, "vars": [(k, str(v)) for k, v in values.items()]})
    if "log" in want:
        out["log"] = [dict(zip(("content_model", "mode", "used_mode", "token", "name"), (a, b, c, _KINDS[k], n), strict=True)) for a, b, c, k, n in builder.log]
    return out


def slices(column: pa.Array, size: int = 1 << 18) -> Iterator[pa.Array]:
    """A column of texts or bytes in slices of `size` bytes at most, or of one page."""
    first = held = 0
    for i, n in enumerate(pc.binary_length(column).to_pylist()):
        n = (n or 0) + 256  # empty pages have nodes too
        if held and held + n > size:
            yield column.slice(first, i - first)
            first, held = i, 0
        held += n
    yield column.slice(first)


def each_page(start: Callable[[], Callable], spark_type: str, arrow_type: pa.DataType):
    """Arrow UDF of a function of one page (null for null), which `start` makes once a task.

    Spark hands over 10,000 pages at once; results leave slice by slice, so that what a worker holds as
    Python objects grows with the largest page, not with the table.
    """

    @F.arrow_udf(spark_type)
    def kernel(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = start()
        for column in columns:
            for some in slices(column):
                yield pa.array([None if x is None else one(x) for x in some.to_pylist()], arrow_type)

    return kernel


def _kernel(fragment=None, scripting=False, want=("nodes", "errors"), **hints):
    kind = f"struct<{DOCUMENT.replace(' array', ':array').replace(' string', ':string')}>"
    return each_page(lambda: lambda x: parse_one(x, fragment, scripting, want, **hints), kind, _DOC_TYPE)


def parse_html(html: Column | str, fragment: str | None = None, scripting: bool = False, want=("nodes", "errors"), **hints) -> Column:
    """Struct of a parsed document (null for null).  STRING columns are text, BINARY ones bytes with encoding discovery.

    `fragment` parses as children of that element; `want` names the arrays to fill; `hints` are
    literal encoding hints: override, transport, same_origin_parent, likely, default.  With
    `namespace_html=False` HTML elements have a null namespace (filters and serializer take it for HTML's).
    """

    return _kernel(fragment, scripting, want, **hints)(F.col(html) if isinstance(html, str) else html)


def parse_fragment(html: Column | str, container: str = "div", **options) -> Column:
    return parse_html(html, fragment=container, **options)


def documents(pages: DataFrame, id_col: str, html_col: str, **options) -> DataFrame:
    """id, doc."""
    return pages.select(F.col(id_col).alias("doc_id"), parse_html(html_col, **options).alias("doc"))


def _expanded(docs: DataFrame, array: str, proof: str) -> DataFrame:
    # An outer expansion keeps the optimiser from asking for the array's size, which would run the kernel twice.
    return docs.select("doc_id", F.inline_outer(f"doc.{array}")).filter(F.col(proof).isNotNull())


def nodes(pages: DataFrame, id_col: str, html_col: str, **options) -> DataFrame:
    return _expanded(documents(pages, id_col, html_col, want=("nodes",), **options), "nodes", "node_id")


def errors(pages: DataFrame, id_col: str, html_col: str, strict: bool = False, **options) -> DataFrame:
    """doc_id, line, col, code, vars; with `strict` the first error fails the query."""
    found = _expanded(documents(pages, id_col, html_col, want=("errors",), **options), "errors", "code")
    if strict:
        return found.filter(F.raise_error(F.concat(F.lit("parse error: "), F.col("code"))).isNull())
    return found


def debug_log(pages: DataFrame, id_col: str, html_col: str, **options) -> DataFrame:
    return _expanded(documents(pages, id_col, html_col, want=("log",), **options), "log", "token")


TOKEN_COLUMNS = ["doc_id", "seq", "sub", "type", "ns", "name", "data", "public_id", "system_id", "attrs"]


def is_html(ns: Column) -> Column:
    return F.coalesce(ns, F.lit(T.HTML)) == T.HTML


def tokens(tree: DataFrame) -> DataFrame:
    """The walk of a `nodes` relation as token rows ordered by (seq, sub).

    Void HTML elements are one EmptyTag (with a SerializeError after it if they have children);
    texts are cut into leading spaces, the rest and trailing spaces.
    """
    none, empty = F.lit(None).cast("string"), F.array().cast(f"array<{ATTR}>")

    def token(seq, sub, kind, ns=none, name=none, data=none, attrs=empty, when=None):
        row = F.struct(F.col(seq).alias("seq"), F.lit(sub).alias("sub"), F.lit(kind).alias("type"), ns.alias("ns"), name.alias("name"), data.alias("data"), attrs.alias("attrs"))
        return F.when(when, row)

    ns, name, value, kind = F.col("ns"), F.col("name"), F.col("value"), F.col("kind")
    element = kind == "element"
    void = element & is_html(ns) & name.isin(*sorted(T.VOID))
    text = kind == "text"
    left = F.regexp_extract(value, r"^([\t\n\f\r ]*)", 1)
    rest = F.regexp_replace(value, r"^[\t\n\f\r ]+", "")
    right = F.regexp_extract(rest, r"([\t\n\f\r ]*)\z", 1)
    middle = F.substring(rest, F.lit(1), F.length(rest) - F.length(right))
    parts = F.array(
        token("enter_seq", 0, "Doctype", name=name, when=kind == "doctype"),
        token("enter_seq", 0, "StartTag", ns, name, attrs=F.col("attrs"), when=element & ~void),
        token("enter_seq", 0, "EmptyTag", ns, name, attrs=F.col("attrs"), when=void),
        token("enter_seq", 1, "SerializeError", data=F.lit("Void element has children"), when=void & (F.col("exit_seq") > F.col("enter_seq") + 1)),
        token("enter_seq", 0, "SpaceCharacters", data=left, when=text & (left != "")),
        token("enter_seq", 1, "Characters", data=middle, when=text & (middle != "")),
        token("enter_seq", 2, "SpaceCharacters", data=right, when=text & (right != "")),
        token("enter_seq", 0, "Comment", data=value, when=kind == "comment"),
        token("enter_seq", 0, "Entity", name=name, when=kind == "entity"),
        token("exit_seq", 0, "EndTag", ns, name, when=element & ~void),
    )
    rows = tree.select("doc_id", "public_id", "system_id", F.explode(F.array_compact(parts)).alias("t"))
    return rows.select("doc_id", "t.seq", "t.sub", "t.type", "t.ns", "t.name", "t.data", "public_id", "system_id", "t.attrs")


def concatenate_text(stream: DataFrame) -> DataFrame:
    """Adjacent text tokens as one Characters token."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("seq", "sub")
    text = F.col("type").isin("Characters", "SpaceCharacters")
    marked = stream.withColumn("is_text", text).withColumn("joins", F.col("is_text") & F.coalesce(F.lag("is_text").over(order), F.lit(False)))
    marked = marked.withColumn("island", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(order))
    first = [F.min_by(c, F.struct("seq", "sub")).alias(c) for c in ("ns", "name", "public_id", "system_id", "attrs")]
    at = F.min(F.struct("seq", "sub"))
    pieces = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "sub", F.coalesce("data", F.lit("")).alias("data")))), lambda p: p["data"]), "")
    data = F.when(F.bool_or("is_text"), pieces).otherwise(F.first("data"))
    kind = F.when(F.bool_or("is_text"), F.lit("Characters")).otherwise(F.first("type"))
    merged = marked.groupBy("doc_id", "island").agg(at.alias("at"), kind.alias("type"), data.alias("data"), *first)
    return merged.select("doc_id", "at.seq", "at.sub", "type", "ns", "name", "data", "public_id", "system_id", "attrs")


def register(spark) -> None:
    """SQL names: `html_nodes(html)`, a table function for LATERAL joins, and `parse_html(html)`."""
    columns = "node_id int, parent_id int, enter_seq int, exit_seq int, depth int, child_idx int, kind string, ns string, name string, value string"

    @F.udtf(returnType=columns)
    class HtmlNodes:
        def eval(self, html: str):
            if html is not None:
                names = [c.split()[0] for c in columns.split(", ")]
                for node in parse_one(html, want=("nodes",))["nodes"]:
                    yield tuple(node[n] for n in names)

    spark.udtf.register("html_nodes", HtmlNodes)
    spark.udf.register("parse_html", _kernel())
