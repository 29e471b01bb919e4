"""Serializer, dumps, adapters and XML-safe names over token and node relations."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions import tables as T, writer
from tagloom.operators import filters
from tagloom.operators.parse import ATTR, build, concatenate_text, each_page, is_html
from tagloom.operators.sanitize import SafeLists, safe_css, sanitize

# Characters that make quotes necessary, by the two readings of the rules.
_SPEC = "[\\t\\n\\x0c \\r\"'=<>`]"
_LEGACY = "[\\x00-\\x20\"'=<>`/\\u00a0\\u1680\\u180e\\u180f\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


@dataclass(frozen=True)
class Options:
    """Serializer options; unknown names are refused by the constructor."""

    quote_attr_values: str = "legacy"
    quote_char: str | None = None
    use_best_quote_char: bool | None = None
    omit_optional_tags: bool = True
    minimize_boolean_attributes: bool = True
    use_trailing_solidus: bool = False
    space_before_trailing_solidus: bool = True
    escape_lt_in_attrs: bool = False
    escape_rcdata: bool = False
    resolve_entities: bool = True
    alphabetical_attributes: bool = False
    inject_meta_charset: bool = True
    strip_whitespace: bool = False
    sanitize: bool = False

    def __post_init__(self):
        if self.quote_attr_values not in ("always", "spec", "legacy"):
            raise ValueError("quote_attr_values must be one of: always, spec, legacy")

    @property
    def best_quote(self) -> bool:
        """A given quote sign switches the choice of signs off, unless that is asked for too."""
        return self.quote_char is None if self.use_best_quote_char is None else self.use_best_quote_char


def _reverse_entities() -> dict[int, str]:
    out: dict[int, str] = {}
    for name, text in sorted(T.ENTITIES.items(), key=lambda x: (len(x[0]), x[0])):
        if len(text) == 1 and text != "&" and name.endswith(";") and (ord(text) not in out or name.islower() and not out[ord(text)].islower()):
            out[ord(text)] = name
    return out


def _fallback(encoding: str):
    """Characters that the encoding lacks become references."""

    @F.pandas_udf("string")
    def references(texts, strictly):
        names = _reverse_entities()
        "".join(strictly[strictly.notna()]).encode(encoding)  # names can't be written as references

        def one(text):
            if text is None or text.isascii():
                return text
            out = []
            for c in text:
                try:
                    c.encode(encoding)
                    out.append(c)
                except UnicodeEncodeError:
                    name = names.get(ord(c))
                    out.append(f"&{name}" if name else f"&#x{ord(c):x};")
            return "".join(out)

        return texts.map(one)

    return references


def _text(value: Column) -> Column:
    return F.replace(F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit(">"), F.lit("&gt;")), F.lit("<"), F.lit("&lt;"))


def _attribute(a: Column, o: Options) -> Column:
    booleans = sorted(f"{element}/{name}" for element, names in T.BOOLEAN_ATTRIBUTES.items() for name in names.split())
    value = F.replace(a["value"], F.lit("&"), F.lit("&amp;"))
    if o.escape_lt_in_attrs:
        value = F.replace(value, F.lit("<"), F.lit("&lt;"))
    if o.quote_attr_values == "always":
        quoted = F.lit(True)
    else:
        quoted = (a["value"] == "") | a["value"].rlike(_SPEC if o.quote_attr_values == "spec" else _LEGACY)
    sign = F.lit(o.quote_char or '"')
    if o.best_quote:
        one, two = F.contains(value, F.lit("'")), F.contains(value, F.lit('"'))
        sign = F.when(one & ~two, F.lit('"')).when(two & ~one, F.lit("'")).otherwise(sign)
    inside = F.when(sign == "'", F.replace(value, F.lit("'"), F.lit("&#39;"))).otherwise(F.replace(value, F.lit('"'), F.lit("&quot;")))
    whole = F.concat(F.lit("="), F.when(quoted, F.concat(sign, inside, sign)).otherwise(value))
    if o.minimize_boolean_attributes:
        small = F.concat(F.col("name"), F.lit("/"), a["name"]).isin(*booleans) | F.concat(F.lit("/"), a["name"]).isin(*booleans)
        whole = F.when(small, F.lit("")).otherwise(whole)
    return F.concat(F.lit(" "), a["name"], whole)


def filtered(stream: DataFrame, o: Options, encoding: str | None = None, lists: SafeLists = SafeLists()) -> DataFrame:
    """The filters that the options ask for, in their fixed order."""
    if encoding and o.inject_meta_charset:
        stream = filters.inject_meta_charset(stream, encoding)
    if o.alphabetical_attributes:
        stream = filters.alphabetical_attributes(stream)
    if o.strip_whitespace:
        stream = filters.collapse_whitespace(stream)
    if o.sanitize:
        stream = sanitize(stream, lists)
    if o.omit_optional_tags:
        stream = filters.optional_tags(stream)
    return stream


def pieces(stream: DataFrame, o: Options = Options(), encoding: str | None = None, lists: SafeLists = SafeLists()) -> DataFrame:
    """doc_id, seq, sub, piece, problem: the markup of each token."""
    stream = filtered(stream, o, encoding, lists)
    kind, name, data = F.col("type"), F.col("name"), F.col("data")
    raw = name.isin(*sorted(T.RAW_TEXT))
    if encoding:
        fallback = _fallback(encoding)
    turn = F.when(F.lit(not o.escape_rcdata) & kind.isin("StartTag", "EmptyTag") & raw, True).when((kind == "EndTag") & raw, False)
    seen = stream.withColumn("turn", turn)
    seen = seen.withColumn("in_raw", F.coalesce(F.last("turn", ignorenulls=True).over(filters.in_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    in_raw, end = F.col("in_raw"), F.col("system_id")
    quote = F.when(F.contains(end, F.lit('"')), F.lit("'")).otherwise(F.lit('"'))
    ids = F.when(F.coalesce("public_id", F.lit("")) != "", F.concat(F.lit(' PUBLIC "'), F.col("public_id"), F.lit('"'))).when(F.coalesce(end, F.lit("")) != "", F.lit(" SYSTEM")).otherwise("")
    system = F.when(F.coalesce(end, F.lit("")) != "", F.concat(F.lit(" "), quote, end, quote)).otherwise("")
    solidus = F.when(F.lit(o.use_trailing_solidus) & name.isin(*sorted(T.VOID)), " /" if o.space_before_trailing_solidus else "/").otherwise("")
    known = sorted(n[:-1] for n in T.ENTITIES if n.endswith(";") and n[:-1] not in ("lt", "gt", "amp", "apos", "quot"))
    entity = F.concat(F.lit("&"), name, F.lit(";"))
    if o.resolve_entities:
        table = F.create_map(*[F.lit(x) for n in known for x in (n, T.ENTITIES[n + ";"])])
        entity = F.when(kind == "Entity", F.coalesce(F.try_element_at(table, name), entity))
    piece = (
        F.when(kind == "Doctype", F.concat(F.lit("<!DOCTYPE "), F.coalesce(name, F.lit("")), ids, system, F.lit(">")))
        .when(kind.isin("Characters", "SpaceCharacters"), F.when((kind == "SpaceCharacters") | in_raw, data).otherwise(_text(data)))
        .when(kind.isin("StartTag", "EmptyTag"), F.concat(F.lit("<"), name, F.array_join(F.transform("attrs", lambda a: _attribute(a, o)), ""), solidus, F.lit(">")))
        .when(kind == "EndTag", F.concat(F.lit("</"), name, F.lit(">")))
        .when(kind == "Comment", F.concat(F.lit("<!--"), data, F.lit("-->")))
        .when(kind == "Entity", entity)
    )
    problem = (
        F.when((kind == "Doctype") & F.contains(end, F.lit('"')) & F.contains(end, F.lit("'")), "System identifier contains both single and double quote characters")
        .when(kind.isin("Characters", "SpaceCharacters") & in_raw & F.contains(data, F.lit("</")), "Unexpected </ in CDATA")
        .when(kind.isin("StartTag", "EmptyTag", "EndTag") & in_raw & ~raw, "Unexpected child element of a CDATA element")
        .when((kind == "Comment") & F.contains(data, F.lit("--")), "Comment contains --")
        .when((kind == "Entity") & ~name.isin("lt", "gt", "amp", "apos", "quot", *known), F.concat(F.lit("Entity "), name, F.lit(" not recognized")))
        .when(kind == "SerializeError", data)
    )
    strictly = F.when(kind.isin("StartTag", "EmptyTag"), F.concat(name, F.array_join(F.transform("attrs", lambda a: a["name"]), "")))
    out = seen.select("doc_id", "seq", "sub", kind.alias("type"), piece.alias("piece"), problem.alias("problem"), strictly.alias("strictly"))
    if encoding:
        loose = F.col("type").isin("Characters", "SpaceCharacters", "StartTag", "EmptyTag")
        out = out.withColumn("piece", F.when(loose, fallback("piece", "strictly")).otherwise(F.col("piece")))
    return out.select("doc_id", "seq", "sub", "piece", "problem")


def serialize(stream: DataFrame, o: Options = Options(), encoding: str | None = None, strict: bool = False, lists: SafeLists = SafeLists(), extra: Sequence[Callable[[DataFrame], DataFrame]] = ()) -> DataFrame:
    """doc_id, html (STRING, or BINARY where an encoding is given), problems.

    `extra` are filters of the caller's own, from token stream to token stream, that run before
    those of the options.
    """
    for own in extra:
        stream = own(stream)
    parts = pieces(stream, o, encoding, lists)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "sub", F.coalesce("piece", F.lit("")).alias("piece")))), lambda p: p["piece"]), "")
    out = parts.groupBy("doc_id").agg(joined.alias("html"), F.array_compact(F.collect_list("problem")).alias("problems"))
    if strict:
        out = out.filter(F.when(F.size("problems") > 0, F.raise_error(F.col("problems")[0]).isNull()).otherwise(True))
    if encoding:

        @F.pandas_udf("binary")
        def encoded(texts):
            return texts.map(lambda t: t.encode(encoding))

        out = out.withColumn("html", encoded("html"))
    return out


def serialize_html(html: Column | str, o: Options = Options(), encoding: str | None = None, strict: bool = False, lists: SafeLists = SafeLists(), **parsing) -> Column:
    """Struct (html, problems) of a page's markup: parsed, filtered and written in one kernel call.

    The result is that of `serialize` over the page's tokens (and empty for a page without any); no row
    is expanded, so no exchange is needed.  `parsing` are options of `parse_html`; with `strict` the first problem is an error.
    """
    kept, flow = frozenset(filters.SPACE_KEPT), frozenset(filters._FLOW)

    def one(source, markup: writer.Markup):
        tokens = writer.tokens_of(build(source, want=(), **parsing)[0].rows())
        if encoding and o.inject_meta_charset:
            tokens = writer.with_charset(tokens, encoding)
        if o.alphabetical_attributes:
            tokens = writer.in_alphabet(tokens)
        if o.strip_whitespace:
            tokens = writer.one_space(tokens, kept)
        if o.sanitize:
            tokens = writer.sanitized(tokens, lists, safe_css)
        if o.omit_optional_tags:
            tokens = writer.without_optional_tags(tokens, writer.start_tag_goes, lambda name, after: writer.end_tag_goes(name, after, flow))
        text, problems = markup.write(tokens)
        if strict and problems:
            raise ValueError(problems[0])
        return {"html": text.encode(encoding) if encoding else text, "problems": problems}

    def start():
        markup = writer.Markup(o, _SPEC if o.quote_attr_values == "spec" else _LEGACY, encoding, _reverse_entities() if encoding else None)
        return lambda source: one(source, markup)

    kind = pa.struct([("html", pa.binary() if encoding else pa.string()), ("problems", pa.list_(pa.string()))])
    kernel = each_page(start, f"struct<html:{'binary' if encoding else 'string'},problems:array<string>>", kind)
    return kernel(F.col(html) if isinstance(html, str) else html)


def tree_dump(tree: DataFrame) -> DataFrame:
    """doc_id, dump: one line a node, indented by depth, attributes sorted, foreign names with a prefix."""
    prefixes = F.create_map(*[F.lit(x) for pair in T.PREFIXES.items() for x in pair])
    indent = lambda extra: F.concat(F.lit("| "), F.repeat(F.lit(" "), (2 * (F.col("depth") - 1 + extra)).cast("int")))
    foreign = F.col("ns").isNotNull() & (F.col("ns") != T.HTML)
    tag = F.concat(F.lit("<"), F.when(foreign, F.concat(prefixes[F.col("ns")], F.lit(" "))).otherwise(""), F.col("name"), F.lit(">"))
    shown = F.array_sort(F.transform("attrs", lambda a: F.concat(F.when(a["ns"].isNotNull(), F.concat(prefixes[a["ns"]], F.lit(" "))).otherwise(""), a["name"], F.lit('="'), a["value"], F.lit('"'))))
    lines = F.concat(F.lit("\n"), indent(1))
    attrs = F.when(F.size("attrs") > 0, F.array_join(F.transform(shown, lambda s: F.concat(lines, s)), "")).otherwise("")
    ids = F.when(F.col("public_id").isNotNull() | F.col("system_id").isNotNull(), F.concat(F.lit(' "'), F.coalesce("public_id", F.lit("")), F.lit('" "'), F.coalesce("system_id", F.lit("")), F.lit('"'))).otherwise("")
    line = (
        F.when(F.col("kind") == "element", F.concat(indent(0), tag, attrs))
        .when(F.col("kind") == "text", F.concat(indent(0), F.lit('"'), F.col("value"), F.lit('"')))
        .when(F.col("kind") == "comment", F.concat(indent(0), F.lit("<!-- "), F.col("value"), F.lit(" -->")))
        .when(F.col("kind") == "doctype", F.concat(indent(0), F.lit("<!DOCTYPE "), F.coalesce("name", F.lit("")), ids, F.lit(">")))
    )
    rows = tree.select("doc_id", "enter_seq", line.alias("line")).filter(F.col("line").isNotNull())
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("enter_seq", "line"))), lambda x: x["line"]), "\n").alias("dump"))


def sax_events(stream: DataFrame) -> DataFrame:
    """doc_id, seq, sub, part, event, ns, name, data, attrs: the calls a SAX handler would get, without comments and doctypes."""
    kind = F.col("type")
    start, end = F.lit("startElementNS"), F.lit("endElementNS")
    calls = F.when(kind == "StartTag", F.array(start)).when(kind == "EndTag", F.array(end)).when(kind == "EmptyTag", F.array(start, end)).when(kind.isin("Characters", "SpaceCharacters"), F.array(F.lit("characters")))
    return stream.select("doc_id", "seq", "sub", F.posexplode(calls).alias("part", "event"), "ns", "name", "data", "attrs")


def sax_calls(stream: DataFrame) -> DataFrame:
    """`sax_events` with what surrounds them in each document: startDocument, prefix mappings, and their ends.

    Adds columns prefix and uri; the order is (doc_id, seq, sub, part).
    """
    inner = sax_events(stream)
    none = F.lit(None).cast("string")
    mapping = lambda event, step: [F.struct(F.lit(event).alias("event"), F.lit(step + i).alias("part"), F.lit(p).alias("prefix"), F.lit(uri).alias("uri")) for i, (uri, p) in enumerate(T.PREFIXES.items())]
    outer = lambda event, part: F.struct(F.lit(event).alias("event"), F.lit(part).alias("part"), none.alias("prefix"), none.alias("uri"))
    before = F.array(outer("startDocument", 0), *mapping("startPrefixMapping", 1))
    after = F.array(*mapping("endPrefixMapping", 0), outer("endDocument", len(T.PREFIXES)))
    docs = stream.select("doc_id").distinct()
    empty = F.array().cast(f"array<{ATTR}>")

    def rows(calls, seq):
        out = docs.select("doc_id", F.explode(calls).alias("c"))
        return out.select("doc_id", F.lit(seq).alias("seq"), F.lit(0).alias("sub"), "c.part", "c.event", none.alias("ns"), none.alias("name"), none.alias("data"), empty.alias("attrs"), "c.prefix", "c.uri")

    inside = inner.withColumn("prefix", none).withColumn("uri", none)
    return rows(before, -1).unionByName(inside).unionByName(rows(after, (1 << 31) - 1))


def token_lines(stream: DataFrame) -> DataFrame:
    """doc_id, seq, sub, line: each token in a readable form, attributes sorted."""
    prefixes = F.create_map(*[F.lit(x) for pair in T.PREFIXES.items() for x in pair])
    spaced = lambda ns: F.when(ns.isNull() | (ns == T.HTML), F.lit("")).otherwise(F.concat(F.coalesce(prefixes[ns], ns), F.lit(" ")))
    shown = F.array_sort(F.transform("attrs", lambda a: F.concat(F.lit(" "), F.when(a["ns"].isNull(), F.lit("")).otherwise(F.concat(F.coalesce(prefixes[a["ns"]], a["ns"]), F.lit(" "))), a["name"], F.lit('="'), a["value"], F.lit('"'))))
    kind, named = F.col("type"), F.concat(spaced(F.col("ns")), F.col("name"))
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    line = (
        F.when(kind.isin("StartTag", "EmptyTag"), F.concat(F.lit("<"), named, F.array_join(shown, ""), F.lit(">")))
        .when(kind == "EndTag", F.concat(F.lit("</"), named, F.lit(">")))
        .when(kind.isin("Characters", "SpaceCharacters"), quote(F.col("data")))
        .when(kind == "Comment", F.concat(F.lit("<!-- "), F.col("data"), F.lit(" -->")))
        .when(kind == "Doctype", F.concat(F.lit("<!DOCTYPE "), F.coalesce("name", F.lit("")), F.when(F.col("public_id").isNull() & F.col("system_id").isNull(), "").otherwise(F.concat(F.lit(" "), quote(F.coalesce("public_id", F.lit(""))), F.lit(" "), quote(F.coalesce("system_id", F.lit(""))))), F.lit(">")))
        .otherwise(F.concat(kind, F.lit(" "), F.coalesce("name", "data", F.lit(""))))
    )
    return stream.select("doc_id", "seq", "sub", line.alias("line"))


def genshi_events(stream: DataFrame) -> DataFrame:
    """doc_id, seq, sub, part, event: START, END, TEXT (merged), COMMENT, DOCTYPE."""
    kind = F.col("type")
    events = (
        F.when(kind == "StartTag", F.array(F.lit("START"))).when(kind == "EndTag", F.array(F.lit("END"))).when(kind == "EmptyTag", F.array(F.lit("START"), F.lit("END")))
        .when(kind == "Characters", F.array(F.lit("TEXT"))).when(kind == "Comment", F.array(F.lit("COMMENT"))).when(kind == "Doctype", F.array(F.lit("DOCTYPE")))
    )
    return concatenate_text(stream).select("doc_id", "seq", "sub", F.posexplode(events).alias("part", "event"), "ns", "name", "data", "public_id", "system_id", "attrs")


def tokens_from_events(events: DataFrame) -> DataFrame:
    """Tokens of a stream of START, END, TEXT, COMMENT and DOCTYPE events, as `genshi_events` makes them.

    A void HTML element's START is an EmptyTag and its END goes; texts are cut into leading spaces, the
    rest and trailing spaces; other events are left out.
    """
    event, data = F.col("event"), F.col("data")
    void = is_html(F.col("ns")) & F.col("name").isin(*sorted(T.VOID))
    left = F.regexp_extract(data, r"^([\t\n\f\r ]*)", 1)
    rest = F.regexp_replace(data, r"^[\t\n\f\r ]+", "")
    right = F.regexp_extract(rest, r"([\t\n\f\r ]*)\z", 1)
    middle = F.substring(rest, F.lit(1), F.length(rest) - F.length(right))
    one = lambda sub, kind, text, when: F.when(when, F.struct(F.lit(sub).alias("cut"), F.lit(kind).alias("type"), text.alias("text")))
    text = event == "TEXT"
    made = F.array(
        one(0, "StartTag", data, (event == "START") & ~void),
        one(0, "EmptyTag", data, (event == "START") & void),
        one(0, "EndTag", data, (event == "END") & ~void),
        one(0, "Comment", data, event == "COMMENT"),
        one(0, "Doctype", data, event == "DOCTYPE"),
        one(0, "SpaceCharacters", left, text & (left != "")),
        one(1, "Characters", middle, text & (middle != "")),
        one(2, "SpaceCharacters", right, text & (right != "")),
    )
    rows = events.withColumn("t", F.explode(F.array_compact(made)))
    return rows.select("doc_id", "seq", (F.col("sub") * 3 + F.col("t.cut")).alias("sub"), "t.type", "ns", "name", F.col("t.text").alias("data"), "public_id", "system_id", "attrs")


# -- XML-safe names and data -------------------------------------------------------------------

_NAME_START = re.compile(r"[A-Za-z_À-ÖØ-öø-˿Ͱ-ͽͿ-῿‌-‍⁰-↏Ⰰ-⿯、-퟿豈-﷏ﷰ-�]")
_NAME_CHAR = re.compile(r"[-.0-9A-Za-z_·À-ÖØ-öø-ͽͿ-῿‌-‍‿-⁀⁰-↏Ⰰ-⿯、-퟿豈-﷏ﷰ-�]")
_ESCAPED = re.compile(r"U([0-9A-F]{5})")


def xml_name(name: str) -> str:
    """Characters that XML names lack as U and five hexadecimal digits."""
    code = lambda c: f"U{ord(c):05X}"
    return "".join(c if (_NAME_CHAR if i else _NAME_START).match(c) else code(c) for i, c in enumerate(name))


def from_xml_name(name: str) -> str:
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), name)


_NO_PUBLIC_ID = re.compile(r"[^ \r\na-zA-Z0-9\-'()+,./:=?;!*#@$_%]")


def xml_public_id(value: str) -> str:
    """Characters that public identifiers lack, written as in `xml_name`."""
    return _NO_PUBLIC_ID.sub(lambda m: f"U{ord(m[0]):05X}", value)


def restore_names(tree: DataFrame) -> DataFrame:
    """`coerce_names` undone for the names of elements and attributes."""
    # The digits stand for one code point, so built-in functions would need a pass a code point.

    @F.pandas_udf("string")
    def plain(names):
        return names.map(lambda n: None if n is None else from_xml_name(n))

    @F.pandas_udf("array<string>")
    def plain_all(lists):
        return lists.map(lambda x: [from_xml_name(n) for n in x])

    renamed = F.transform(F.arrays_zip("attrs", "names"), lambda p: F.struct(p["attrs"]["ns"].alias("ns"), p["attrs"]["prefix"].alias("prefix"), p["names"].alias("name"), p["attrs"]["value"].alias("value")))
    out = tree.withColumn("names", plain_all(F.transform("attrs", lambda a: a["name"])))
    return out.withColumn("attrs", renamed).withColumn("name", F.when(F.col("kind") == "element", plain("name")).otherwise(F.col("name"))).drop("names")


def coerce_names(tree: DataFrame) -> DataFrame:
    """A `nodes` relation with XML-safe element and attribute names, comments, texts and public ids."""

    @F.pandas_udf("string")
    def public(values):
        return values.map(lambda v: None if v is None else xml_public_id(v))

    @F.pandas_udf("string")
    def safe(names):
        return names.map(lambda n: None if n is None else xml_name(n))

    @F.pandas_udf("array<string>")
    def safe_all(lists):
        return lists.map(lambda x: [xml_name(n) for n in x])

    comment = F.regexp_replace(F.col("value"), "-(?=-)", "- ")
    comment = F.when(comment.endswith("-"), F.concat(comment, F.lit(" "))).otherwise(comment)
    value = F.when(F.col("kind") == "comment", comment).when(F.col("kind") == "text", F.translate("value", "\f", " ")).otherwise(F.col("value"))
    renamed = F.transform(F.arrays_zip("attrs", "names"), lambda p: F.struct(p["attrs"]["ns"].alias("ns"), p["attrs"]["prefix"].alias("prefix"), p["names"].alias("name"), p["attrs"]["value"].alias("value")))
    out = tree.withColumn("names", safe_all(F.transform("attrs", lambda a: a["name"])))
    out = out.withColumn("public_id", public("public_id"))
    return out.withColumn("attrs", renamed).withColumn("name", F.when(F.col("kind") == "element", safe("name")).otherwise(F.col("name"))).withColumn("value", value).drop("names")


def coercion_losses(tree: DataFrame) -> DataFrame:
    """(doc_id, node_id, problem) of what `coerce_names` has to change in a `nodes` relation."""
    safe = coerce_names(tree).select(F.col("doc_id").alias("d"), F.col("node_id").alias("i"), F.col("name").alias("n"), F.col("value").alias("v"), F.col("public_id").alias("p"), F.transform("attrs", lambda a: a["name"]).alias("a"))
    both = tree.join(safe, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("node_id") == F.col("i")))
    differ = lambda x, y: ~F.col(x).eqNullSafe(F.col(y))
    problems = F.array(
        F.when((F.col("kind") == "element") & differ("name", "n"), "element name"),
        F.when((F.col("kind") == "element") & ~F.transform("attrs", lambda a: a["name"]).eqNullSafe(F.col("a")), "attribute name"),
        F.when((F.col("kind") == "comment") & differ("value", "v"), "comment"),
        F.when((F.col("kind") == "text") & differ("value", "v"), "text"),
        F.when((F.col("kind") == "doctype") & differ("public_id", "p"), "public identifier"),
    )
    return both.select("doc_id", "node_id", F.explode(F.array_compact(problems)).alias("problem"))
