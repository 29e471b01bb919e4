"""Sanitizer: allow-lists over the token stream, built-in functions but for style values."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import tables as T
from tagloom.operators.parse import ATTR


def _key(ns: str | None, name: str) -> str:
    return f"{ns or ''} {name}"


@dataclass(frozen=True)
class SafeLists:
    """Allow-lists; keys are "namespace name", with an empty namespace for attributes without one."""

    elements: frozenset = frozenset(_key(T.HTML, n) for n in T.SAFE_HTML) | frozenset(_key(T.MATHML, n) for n in T.SAFE_MATHML) | frozenset(_key(T.SVG, n) for n in T.SAFE_SVG)
    attributes: frozenset = (
        frozenset(_key(None, n) for n in (*T.SAFE_HTML_ATTRIBUTES, *T.SAFE_MATHML_ATTRIBUTES, *T.SAFE_SVG_ATTRIBUTES))
        | frozenset(_key(T.XLINK, n) for n in T.SAFE_XLINK_ATTRIBUTES)
        | frozenset(_key(T.XML, n) for n in T.SAFE_XML_ATTRIBUTES)
    )
    uris: frozenset = frozenset(_key(None, n) for n in T.URI_ATTRIBUTES) | {_key(T.XLINK, "href"), _key(T.XML, "base")}
    svg_references: frozenset = frozenset(_key(None, n) for n in T.SVG_REF_ATTRIBUTES)
    svg_local_href: frozenset = frozenset(T.SVG_LOCAL_HREF)
    css_properties: frozenset = T.SAFE_CSS
    css_keywords: frozenset = T.SAFE_CSS_KEYWORDS
    svg_properties: frozenset = T.SAFE_SVG_CSS
    schemes: frozenset = frozenset(T.SAFE_SCHEMES)
    content_types: frozenset = frozenset(T.SAFE_CONTENT_TYPES)


# Patterns that style values have to pass, and those of single values.
_CSS_URL = re.compile(r"url\s*\(\s*[^\s)]+?\s*\)\s*")
_CSS_SAFE = re.compile(r"""^([:,;#%.\sa-zA-Z0-9!]|\w-\w|'[\s\w]+'|"[\s\w]+"|\([\d,\s]+\))*$""")
_CSS_SHAPE = re.compile(r"^\s*([-\w]+\s*:[^:;]*(;\s*|$))*$")
_CSS_PAIR = re.compile(r"([-\w]+)\s*:\s*([^:;]*)")
_CSS_VALUE = re.compile(r"^(#[0-9a-fA-F]+|rgb\(\d+%?,\d*%?,?\d*%?\)?|\d{0,2}\.?\d{0,2}(cm|em|ex|in|mm|pc|pt|px|%|,|\))?)$")
_SHORTHANDS = ("background", "border", "margin", "padding")


def safe_css(style: str, lists: SafeLists = SafeLists()) -> str:
    """The declarations of a style value that are allowed; nothing if its form is in doubt."""
    style = _CSS_URL.sub(" ", style)
    if not (_CSS_SAFE.match(style) and _CSS_SHAPE.match(style)):
        return ""
    kept = []
    for name, value in _CSS_PAIR.findall(style):
        plain = name.lower()
        shorthand = plain.split("-")[0] in _SHORTHANDS and all(w in lists.css_keywords or _CSS_VALUE.match(w) for w in value.split())
        if value and (plain in lists.css_properties or shorthand or plain in lists.svg_properties and plain.split("-")[0] not in _SHORTHANDS):
            kept.append(f"{name}: {value};")
    return " ".join(kept)


def _unescaped(value: Column) -> Column:
    return F.replace(F.replace(F.replace(value, F.lit("&gt;"), F.lit(">")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _escaped(value: Column) -> Column:
    return F.replace(F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit(">"), F.lit("&gt;")), F.lit("<"), F.lit("&lt;"))


def safe_uri(value: Column, lists: SafeLists) -> Column:
    """Whether a URI has no scheme or a known one, after noise that browsers skip is taken out."""
    plain = F.replace(F.lower(F.regexp_replace(_unescaped(value), "(?U)[`\\x00-\\x20\\x7f-\\xa0\\s]+", "")), F.lit("�"), F.lit(""))
    scheme = F.regexp_extract(plain, r"^([a-z][a-z0-9+.\-]*):", 1)
    host = F.regexp_extract(plain, r"^(?:[a-z][a-z0-9+.\-]*:)?//([^/?#]*)", 1)
    broken = F.contains(host, F.lit("[")) != F.contains(host, F.lit("]"))
    kind = F.regexp_extract(plain, r"^data:([-a-z0-9.]+/[-a-z0-9.]+)(?:;charset=[-a-z0-9]+(?:;(?:base64)?)?|(?:;base64)?(?:;charset=[-a-z0-9]+)?),", 1)
    data = F.when(scheme == "data", kind.isin(*sorted(lists.content_types))).otherwise(True)
    return ~broken & ((scheme == "") | scheme.isin(*sorted(lists.schemes)) & data)


def sanitize(stream: DataFrame, lists: SafeLists = SafeLists()) -> DataFrame:
    """Comments go, tags of unknown elements become text, unsafe attributes go."""

    @F.pandas_udf("string")
    def css(values):
        return values.map(lambda v: None if v is None else safe_css(v, lists))

    key = lambda a: F.concat(F.coalesce(a["ns"], F.lit("")), F.lit(" "), a["name"])
    with_value = lambda a, v: F.struct(a["ns"].alias("ns"), a["prefix"].alias("prefix"), a["name"].alias("name"), v.alias("value"))
    is_style = lambda a: key(a) == " style"
    style = css(F.try_element_at(F.filter("attrs", is_style), F.lit(1))["value"])
    local = F.col("name").isin(*sorted(lists.svg_local_href))
    kept = F.filter("attrs", lambda a: key(a).isin(*sorted(lists.attributes)) & (~key(a).isin(*sorted(lists.uris)) | safe_uri(a["value"], lists)) & ~(local & (key(a) == _key(T.XLINK, "href")) & a["value"].rlike(r"(?U)^\s*[^#\s]")))
    referenced = F.transform(kept, lambda a: F.when(key(a).isin(*sorted(lists.svg_references)), with_value(a, F.regexp_replace(_unescaped(a["value"]), r"(?U)url\s*\(\s*[^#\s][^)]+?\)", " "))).otherwise(a))
    clean = F.transform(referenced, lambda a: F.when(is_style(a), with_value(a, F.col("style"))).otherwise(a))
    tag = F.col("type").isin("StartTag", "EndTag", "EmptyTag")
    allowed = F.concat(F.coalesce("ns", F.lit(T.HTML)), F.lit(" "), F.col("name")).isin(*sorted(lists.elements))
    prefixes = F.create_map(*[F.lit(x) for pair in T.PREFIXES.items() for x in pair])
    shown = F.transform("attrs", lambda a: F.concat(F.lit(" "), F.when(a["ns"].isNull(), a["name"]).otherwise(F.concat(prefixes[a["ns"]], F.lit(":"), a["name"])), F.lit('="'), _escaped(a["value"]), F.lit('"')))
    as_text = F.when(F.col("type") == "EndTag", F.concat(F.lit("</"), F.col("name"), F.lit(">"))).otherwise(F.concat(F.lit("<"), F.col("name"), F.array_join(shown, ""), F.lit(">")))
    bad = tag & ~allowed
    none = F.array().cast(f"array<{ATTR}>")
    return (
        stream.filter(F.col("type") != "Comment")
        .withColumn("style", style)
        .withColumn("new_type", F.when(bad, "Characters").otherwise(F.col("type")))
        .withColumn("new_data", F.when(bad, as_text).otherwise(F.col("data")))
        .withColumn("new_attrs", F.when(bad, none).when(tag, clean).otherwise(F.col("attrs")))
        .select("doc_id", "seq", "sub", F.col("new_type").alias("type"), "ns", F.when(bad, F.lit(None)).otherwise(F.col("name")).alias("name"), F.col("new_data").alias("data"), "public_id", "system_id", F.col("new_attrs").alias("attrs"))
    )
