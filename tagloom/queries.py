"""Queries over `pages` and over literal HTML, and the SQL of those that SQL can express.

Oracles over `pages` are regular expressions on the raw text, or rebuild each page's markup from
its raw tags by window functions; those over literal HTML restate expected rows that were worked
out by hand and are no independent evidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators import filters, relations as R
from tagloom.operators.parse import errors, nodes, parse_html, tokens
from tagloom.operators.serialize import Options, coerce_names, genshi_events, sax_events, serialize, serialize_html, tree_dump


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(_pages(spark, sf_dir), "page_id", "html")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and the array of its nodes."""
    return _pages(spark, sf_dir).select("page_id", parse_html("html", want=("nodes",)).alias("doc")).select("page_id", F.col("doc.nodes").alias("nodes"))


def _literal(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "case_id long, html string")


def page_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, title, links: from one pass over each page's nodes."""
    doc = _pages(spark, sf_dir).select("page_id", parse_html("html", want=("nodes",)).alias("doc"))
    named = lambda *names: F.filter("doc.nodes", lambda n: (n["kind"] == "element") & n["name"].isin(*names))
    title = F.try_element_at(named("title"), F.lit(1))["node_id"]
    text = F.filter("doc.nodes", lambda n: (n["kind"] == "text") & (n["parent_id"] == F.col("title_id")))
    links = F.size(F.filter(named("a"), lambda n: F.exists(n["attrs"], lambda a: a["name"] == "href")))
    return doc.withColumn("title_id", title).select("page_id", F.array_join(F.transform(text, lambda n: n["value"]), "").alias("title"), links.cast("long").alias("links"))


def _texts(spark, sf_dir, tag, name):
    """The text of each element of a tag, made within each page's array."""
    doc = _documents(spark, sf_dir)
    found = F.transform(R.array_elements(F.col("nodes"), tag), lambda n: R.array_text(F.col("nodes"), n))
    return doc.select("page_id", F.explode_outer(found).alias(name)).filter(F.col(name).isNotNull())


def _counts(spark, sf_dir, array):
    """page_id and the size of an array over its nodes, where it isn't empty."""
    size = F.size(array(F.col("nodes"))).cast("long")
    # expanded from an array of one, as the filter would otherwise be put below and run the kernel again
    return _documents(spark, sf_dir).select("page_id", F.explode_outer(F.array(size)).alias("n")).filter("n > 0")


def q01_title_text(spark, sf_dir):
    return _texts(spark, sf_dir, "title", "title")


def q02_link_hrefs(spark, sf_dir):
    return R.links(_tree(spark, sf_dir)).select(F.col("doc_id").alias("page_id"), "href")


def q03_comments(spark, sf_dir):
    return _tree(spark, sf_dir).filter("kind = 'comment'").select(F.col("doc_id").alias("page_id"), F.col("value").alias("comment"))


def q04_script_text(spark, sf_dir):
    return _texts(spark, sf_dir, "script", "text")


def q05_style_text(spark, sf_dir):
    return _texts(spark, sf_dir, "style", "text")


def q06_start_tag_counts(spark, sf_dir):
    tags = F.array(*map(F.lit, ("a", "article", "footer", "h1", "li", "ul", "script", "style", "nav")))
    each = lambda t: F.struct(t.alias("tag"), F.size(F.filter("nodes", lambda n: (n["kind"] == "element") & (n["name"] == t))).cast("long").alias("n"))
    return _documents(spark, sf_dir).select("page_id", F.inline_outer(F.transform(tags, each))).filter("n > 0")


#: Doctypes put in place of a page's own by its number, and the mode the standard gives them.
DOCTYPES = (
    ("<!DOCTYPE html>", "no quirks"),
    ("", "quirks"),
    ('<!DOCTYPE html PUBLIC "-//W3C//DTD HTML 3.2 Final//EN">', "quirks"),
    ('<!DOCTYPE html PUBLIC "-//W3C//DTD HTML 4.01 Transitional//EN" "http://www.w3.org/TR/html4/loose.dtd">', "limited quirks"),
    ('<!DOCTYPE html PUBLIC "-//W3C//DTD HTML 4.01 Transitional//EN">', "quirks"),
    ('<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Strict//EN" "http://www.w3.org/TR/xhtml1/DTD/xhtml1-strict.dtd">', "no quirks"),
    ('<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Transitional//EN" "http://www.w3.org/TR/xhtml1/DTD/xhtml1-transitional.dtd">', "limited quirks"),
    ("<!DOCTYPE svg>", "quirks"),
)


def q07_doctype_mode(spark, sf_dir):
    own = F.element_at(F.array(*[F.lit(d) for d, _ in DOCTYPES]), (F.col("page_id") % len(DOCTYPES) + 1).cast("int"))
    html = F.replace("html", F.lit("<!DOCTYPE html>"), own)
    return _pages(spark, sf_dir).select("page_id", parse_html(html, want=()).getField("compat_mode").alias("compat_mode"))


def q08_html_lang(spark, sf_dir):
    return R.elements(_tree(spark, sf_dir), "html").select(F.col("doc_id").alias("page_id"), R.attribute("lang").alias("lang"))


def q09_meta_charset(spark, sf_dir):
    return R.elements(_tree(spark, sf_dir), "meta").select(F.col("doc_id").alias("page_id"), R.attribute("charset").alias("charset")).filter("charset is not null")


def q10_void_elements(spark, sf_dir):
    return _counts(spark, sf_dir, lambda nodes: R.array_elements(nodes, "br", "meta", "img", "hr", "link", "input"))


def q11_li_children_of_ul(spark, sf_dir):
    return _counts(spark, sf_dir, lambda nodes: F.filter(R.array_elements(nodes, "li"), lambda n: R.array_parent(nodes, n)["name"] == "ul"))


def q12_nested_bold(spark, sf_dir):
    return R.nested(_tree(spark, sf_dir), "b").groupBy(F.col("doc_id").alias("page_id")).agg(F.count(F.lit(1)).alias("n"))


def q13_bold_elements(spark, sf_dir):
    return R.elements(_tree(spark, sf_dir), "b").groupBy(F.col("doc_id").alias("page_id")).agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("deepest"))


def _serialized(spark, sf_dir, encoding=None, **options):
    doc = _pages(spark, sf_dir).select("page_id", serialize_html("html", Options(**options), encoding).alias("out"))
    return doc.select("page_id", F.col("out.html").cast("string").alias("html"))


def q14_whitespace(spark, sf_dir):
    return _serialized(spark, sf_dir, strip_whitespace=True, omit_optional_tags=False)


def q15_optional_tags(spark, sf_dir):
    return _serialized(spark, sf_dir)


def q16_alphabetical(spark, sf_dir):
    return _serialized(spark, sf_dir, alphabetical_attributes=True, omit_optional_tags=False, quote_attr_values="always")


def q17_inject_meta(spark, sf_dir):
    return _serialized(spark, sf_dir, encoding="ascii", omit_optional_tags=False)


def q18_sanitized(spark, sf_dir):
    return _serialized(spark, sf_dir, sanitize=True, omit_optional_tags=False)


def q19_serialized_twice(spark, sf_dir):
    o = Options(omit_optional_tags=False, quote_attr_values="always")
    once = _serialized(spark, sf_dir, omit_optional_tags=False, quote_attr_values="always")
    return once.select("page_id", serialize_html("html", o)["html"].alias("html"))


def _streamed(spark, sf_dir, encoding=None, **options):
    """The same markup by way of the token relation and its filters."""
    out = serialize(tokens(_tree(spark, sf_dir)), Options(**options), encoding)
    return out.select(F.col("doc_id").alias("page_id"), F.col("html").cast("string").alias("html"))


def q30_stream_whitespace(spark, sf_dir):
    return _streamed(spark, sf_dir, strip_whitespace=True, omit_optional_tags=False)


def q31_stream_optional_tags(spark, sf_dir):
    return _streamed(spark, sf_dir)


def q32_stream_alphabetical(spark, sf_dir):
    return _streamed(spark, sf_dir, alphabetical_attributes=True, omit_optional_tags=False, quote_attr_values="always")


def q33_stream_inject_meta(spark, sf_dir):
    return _streamed(spark, sf_dir, encoding="ascii", omit_optional_tags=False)


def q34_stream_sanitized(spark, sf_dir):
    return _streamed(spark, sf_dir, sanitize=True, omit_optional_tags=False)


def q20_errors_by_code(spark, sf_dir):
    return errors(_pages(spark, sf_dir), "page_id", "html").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


BYTES = (
    (b"\xef\xbb\xbfcaf\xc3\xa9", "utf-8", "certain", "café"),
    (b"<meta charset=iso-8859-2>\xb1", "iso-8859-2", "certain", "ą"),
    (b"\xff\xfea\x00b\x00", "utf-16le", "certain", "ab"),
    (b"caf\xe9 \x80", "windows-1252", "tentative", "café €"),
    (b'<meta http-equiv=content-type content="text/html; charset=koi8-r">\xc1', "koi8-r", "certain", "а"),
)


def q21_decode(spark, sf_dir):
    rows = spark.createDataFrame([(i, bytearray(b[0])) for i, b in enumerate(BYTES)], "case_id long, content binary")
    doc = rows.select("case_id", parse_html("content", want=("nodes",)).alias("doc"))
    text = F.array_join(F.transform(F.filter("doc.nodes", lambda n: n["kind"] == "text"), lambda n: n["value"]), "")
    return doc.select("case_id", "doc.encoding", "doc.confidence", text.alias("text"))


def q22_article_heading(spark, sf_dir):
    inside = lambda nodes: F.flatten(F.transform(R.array_elements(nodes, "article"), lambda n: R.array_elements(R.array_descendants(nodes, n), "h1")))
    return _counts(spark, sf_dir, inside)


#: Hand-worked trees, one a rule: misnested formatting, foster parents, implied ends, foreign content, select, frames.
TREES = (
    ("<p>1<b>2<p>3</b>4", '| <html>\n|   <head>\n|   <body>\n|     <p>\n|       "1"\n|       <b>\n|         "2"\n|     <p>\n|       <b>\n|         "3"\n|       "4"'),
    ("<table>x<tr><td>y", '| <html>\n|   <head>\n|   <body>\n|     "x"\n|     <table>\n|       <tbody>\n|         <tr>\n|           <td>\n|             "y"'),
    ("<ul><li>a<li>b", '| <html>\n|   <head>\n|   <body>\n|     <ul>\n|       <li>\n|         "a"\n|       <li>\n|         "b"'),
    ("<svg viewbox=1><foreignobject><p>q", '| <html>\n|   <head>\n|   <body>\n|     <svg svg>\n|       viewBox="1"\n|       <svg foreignObject>\n|         <p>\n|           "q"'),
    ("<select><option>a<optgroup><option>b<input>", '| <html>\n|   <head>\n|   <body>\n|     <select>\n|       <option>\n|         "a"\n|       <optgroup>\n|         <option>\n|           "b"\n|     <input>'),
    ("<frameset><frame></frameset><p>", "| <html>\n|   <head>\n|   <frameset>\n|     <frame>"),
    ("<a>1<div>2</a>3</div>", '| <html>\n|   <head>\n|   <body>\n|     <a>\n|       "1"\n|     <div>\n|       <a>\n|         "2"\n|       "3"'),
    ("<pre>\n\nx</pre><textarea>\ny", '| <html>\n|   <head>\n|   <body>\n|     <pre>\n|       "\nx"\n|     <textarea>\n|       "y"'),
    ("<!doctype html><title>&lt;&notit;&#x80;</title>&copy", '| <!DOCTYPE html>\n| <html>\n|   <head>\n|     <title>\n|       "<¬it;€"\n|   <body>\n|     "©"'),
    ("<!--a--><math><mi>x<b>y</b></math>", '| <!-- a -->\n| <html>\n|   <head>\n|   <body>\n|     <math math>\n|       <math mi>\n|         "x"\n|         <b>\n|           "y"'),
)


def q23_tree_dumps(spark, sf_dir):
    cases = _literal(spark, *(t[0] for t in TREES))
    return tree_dump(nodes(cases, "case_id", "html")).select(F.col("doc_id").alias("case_id"), "dump")


FRAGMENTS = (("<td>a<td>b", "tr", '| <td>\n|   "a"\n| <td>\n|   "b"'), ("a<b>c", "div", '| "a"\n| <b>\n|   "c"'), ("<p>&amp;", "textarea", '| "<p>&"'))


def q24_fragments(spark, sf_dir):
    out = None
    for i, (html, container, _) in enumerate(FRAGMENTS):
        one = tree_dump(nodes(_literal(spark, html), "case_id", "html", fragment=container)).select(F.lit(i).cast("long").alias("case_id"), "dump")
        out = one if out is None else out.union(one)
    return out


def q25_sax_events(spark, sf_dir):
    return sax_events(tokens(_tree(spark, sf_dir))).groupBy("event").agg(F.count(F.lit(1)).alias("n"))


def q26_genshi_events(spark, sf_dir):
    return genshi_events(tokens(_tree(spark, sf_dir))).groupBy("event").agg(F.count(F.lit(1)).alias("n"))


def q27_lint(spark, sf_dir):
    """Violations in streams with faults: `br` as a start tag, comments without data, texts of footers emptied, `li` without a name."""
    stream = tokens(_tree(spark, sf_dir))
    kind, name = F.col("type"), F.col("name")
    faulty = stream.withColumn("data", F.when(kind == "Comment", F.lit(None)).when(F.contains("data", F.lit("©")), F.lit("")).otherwise(F.col("data")))
    faulty = faulty.withColumn("type", F.when(name == "br", "StartTag").otherwise(kind)).withColumn("name", F.when((name == "li") & (kind == "EndTag"), "").otherwise(name))
    return filters.lint(faulty, require_matching_tags=False).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def q28_text_escaping(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id"), F.lit(0).alias("seq"), F.lit(0).alias("sub"), F.lit("Characters").alias("type"), F.lit(None).cast("string").alias("ns"), F.lit(None).cast("string").alias("name"), F.col("text").alias("data"), F.lit(None).cast("string").alias("public_id"), F.lit(None).cast("string").alias("system_id"), F.array().cast("array<struct<ns:string,prefix:string,name:string,value:string>>").alias("attrs"))
    return serialize(docs, Options(omit_optional_tags=False)).select("doc_id", F.col("html").alias("escaped"))


def q29_xml_names(spark, sf_dir):
    tree = coerce_names(nodes(_literal(spark, "<a:b c<d=1><!--x--y-->"), "case_id", "html"))
    return tree.filter("kind in ('element', 'comment') and depth > 2").select("kind", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("value", F.lit("")).alias("value"), F.array_join(F.transform("attrs", lambda a: a["name"]), ",").alias("attrs"))


def _values(names, rows):
    lit = lambda v: "true" if v is True else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({', '.join(names)})"


QUERIES = {f.__name__: f for k, f in sorted(globals().items()) if k[0] == "q" and k[1:3].isdigit()} | {"page_overview": page_overview}

# -- SQL over the raw text of the pages
#
# The pages are regular but for `<b>` elements that are never closed: those go on in each following
# paragraph and in the footer, three at most, and one more right where a new one begins.

_SPLIT = r"(?s)<script>.*?</script>|<style>.*?</style>|<!--.*?-->|<[^>]*>|[^<]+"
_DECODED = "regexp_replace(replace(replace(replace(replace(replace(t, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&gt;', '>'), '&lt;', '<'), '&amp;?', '&', 'g')"
_WALK = f"""
raw AS (SELECT page_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '{_SPLIT}') AS ts FROM pages)),
seen AS (SELECT *, CAST(coalesce(sum(CASE WHEN t = '<b>' THEN 1 END) OVER (PARTITION BY page_id ORDER BY i), 0) AS INT) AS n,
  coalesce(lead(t) OVER (PARTITION BY page_id ORDER BY i), '') AS after, coalesce(lag(t) OVER (PARTITION BY page_id ORDER BY i), '') AS before,
  coalesce(last_value(CASE WHEN t IN ('<p>', '</p>') THEN t END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') = '<p>' AS in_p FROM raw),
bold AS (SELECT *, least(3, n) AS b, least(3, n - 1) + 1 AS own, t NOT LIKE '<%' AS is_text, after NOT LIKE '<%' AND after <> '' AS text_after, before NOT LIKE '<%' AS text_before FROM seen),
walk AS (SELECT *, in_p AND t IN ('<p>', '</article>') AS ends_p,
  CASE WHEN in_p AND t IN ('<p>', '</article>') THEN own WHEN t IN ('</p>', '</footer>') AND text_before THEN b ELSE 0 END AS closed,
  CASE WHEN t = '<b>' THEN own WHEN t IN ('<p>', '<footer>') AND text_after THEN b ELSE 0 END AS opened,
  CASE WHEN is_text THEN {_DECODED} END AS text FROM bold)"""
_ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '>', '&gt;'), '<', '&lt;')"


def _markup(text: str = "text", tag: str = "t", end_p: str = "</p>", tail: str = "</body></html>") -> str:
    """SQL of each page's markup; `text` and `tag` are expressions over a text and a tag, `tail` follows pages that end early."""
    piece = f"CASE WHEN t = '<b>' THEN '' WHEN is_text THEN {_ESCAPED.format(text)} ELSE {tag} END"
    parts = f"repeat('</b>', closed) || CASE WHEN ends_p THEN '{end_p}' ELSE '' END || {piece} || repeat('<b>', opened)"
    ended = "max(CASE WHEN t = '</html>' THEN 1 ELSE 0 END) = 1"
    return f"WITH {_WALK} SELECT page_id, string_agg({parts}, '' ORDER BY i) || CASE WHEN {ended} THEN '' ELSE '{tail}' END AS html FROM walk GROUP BY page_id"


def _unquoted(tag: str = "t") -> str:
    """SQL of a tag whose attributes go without quotes where they can."""
    return f"CASE WHEN t LIKE '<!%' OR t LIKE '<s%>%<%' THEN {tag} ELSE regexp_replace({tag}, '=\"([^\\x00-\\x20\"''=<>`/]+)\"', '=\\1', 'g') END"


def _references(text: str) -> str:
    """SQL of a text whose letters beyond ASCII are references."""
    # Names of the letters and signs that the pages use.
    names = "ä auml ö ouml ü uuml ß szlig é eacute è egrave ê ecirc ç ccedil à agrave ñ ntilde í iacute ó oacute á aacute ú uacute Ä Auml Ö Ouml Ü Uuml É Eacute È Egrave Ê Ecirc Ç Ccedil À Agrave Ñ Ntilde Í Iacute Ó Oacute Á Aacute Ú Uacute © copy · middot".split()
    for letter, name in zip(names[::2], names[1::2], strict=True):
        text = f"replace({text}, '{letter}', '&{name};')"
    return text


_UNWANTED = "('<html', '<head', '<meta', '<title', '<style', '<script', '<body', '</html', '</head', '</title', '</body')"
_KIND = "CASE WHEN t LIKE '<!--%' THEN 'COMMENT' WHEN t LIKE '<!%' THEN 'DOCTYPE' WHEN t LIKE '<script%' OR t LIKE '<style%' THEN 'RAW' WHEN regexp_matches(t, '^<(br|meta)[ >]') THEN 'VOID' WHEN t LIKE '</%' THEN 'END' WHEN t LIKE '<%' THEN 'START' ELSE 'TEXT' END"
_PIECES = f"SELECT t, {_KIND} AS k FROM (SELECT unnest(regexp_extract_all(html, '{_SPLIT}')) AS t FROM ({_markup()}))"
#: Text tokens of a text: leading spaces, the rest, trailing spaces.
_CUT = "CAST(regexp_matches(t, '^[\\t\\n\\f\\r ]') AS INT) + CAST(regexp_matches(t, '[\\t\\n\\f\\r ]$') AND regexp_matches(t, '[^\\t\\n\\f\\r ]') AS INT) + CAST(regexp_matches(t, '[^\\t\\n\\f\\r ]') AS INT)"
_MARKUP_SQL = {
    "whitespace": _markup("regexp_replace(text, '[\\t\\n\\f\\r ]+', ' ', 'g')", _unquoted()),
    "optional_tags": _markup(tag=f"CASE WHEN t IN ('<head>', '</head>', '<body>', '</body>', '</html>', '</li>', '</p>') THEN '' ELSE {_unquoted()} END", end_p="", tail=""),
    "alphabetical": _markup(),
    "inject_meta": f"SELECT page_id, {_references('html')} AS html FROM ({_markup(tag=_unquoted("replace(t, 'charset=\"utf-8\"', 'charset=\"ascii\"')"))})",
    "sanitized": _markup(tag=f"CASE WHEN t LIKE '<!--%' THEN '' WHEN regexp_extract(t, '^</?[a-z]+') IN {_UNWANTED} THEN {_ESCAPED.format('t')} ELSE {_unquoted()} END", tail="&lt;/body&gt;&lt;/html&gt;"),
}

_UNESCAPE = "regexp_replace(replace(replace(replace({}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g')"
_WITHOUT_SCRIPT = "regexp_replace(html, '<script>.*?</script>', '<script></script>', 'gs')"
SQL: dict[str, str] = {
    "q01_title_text": f"SELECT page_id, {_UNESCAPE.format("t")} AS title FROM (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS t FROM pages)",
    "q02_link_hrefs": "SELECT page_id, " + _UNESCAPE.format("h") + " AS href FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS h FROM pages)",
    "q03_comments": "SELECT page_id, unnest(regexp_extract_all(html, '<!--(.*?)-->', 1, 's')) AS comment FROM pages",
    "q04_script_text": "SELECT page_id, unnest(regexp_extract_all(html, '<script>(.*?)</script>', 1, 's')) AS text FROM pages",
    "q05_style_text": "SELECT page_id, unnest(regexp_extract_all(html, '<style>(.*?)</style>', 1, 's')) AS text FROM pages",
    "q06_start_tag_counts": f"SELECT page_id, tag, CAST(len(regexp_extract_all(h, '<' || tag || '[ >]')) AS BIGINT) AS n FROM (SELECT page_id, {_WITHOUT_SCRIPT} AS h FROM pages), (SELECT unnest(['a','article','footer','h1','li','ul','script','style','nav']) AS tag) WHERE len(regexp_extract_all(h, '<' || tag || '[ >]')) > 0",
    "q07_doctype_mode": "SELECT page_id, CASE page_id % " + str(len(DOCTYPES)) + "".join(f" WHEN {i} THEN '{mode}'" for i, (_, mode) in enumerate(DOCTYPES)) + " END AS compat_mode FROM pages",
    "q08_html_lang": "SELECT page_id, nullif(regexp_extract(html, '<html lang=\"([^\"]*)\"', 1), '') AS lang FROM pages",
    "q09_meta_charset": "SELECT page_id, unnest(regexp_extract_all(html, '<meta charset=\"?([a-zA-Z0-9-]+)\"?', 1)) AS charset FROM pages",
    "q10_void_elements": f"SELECT page_id, CAST(n AS BIGINT) AS n FROM (SELECT page_id, len(regexp_extract_all({_WITHOUT_SCRIPT}, '<(br|meta|img|hr|link|input)[ />]')) AS n FROM pages) WHERE n > 0",
    "q11_li_children_of_ul": f"SELECT page_id, CAST(n AS BIGINT) AS n FROM (SELECT page_id, len(regexp_extract_all({_WITHOUT_SCRIPT}, '<li[ >]')) AS n FROM pages) WHERE n > 0",
    "q12_nested_bold": f"WITH {_WALK} SELECT page_id, CAST(sum(opened - 1) AS BIGINT) AS n FROM walk WHERE opened > 1 GROUP BY page_id",
    "q13_bold_elements": f"WITH {_WALK} SELECT page_id, CAST(sum(opened) AS BIGINT) AS n, max(opened + CASE WHEN t = '<footer>' THEN 3 ELSE 4 END) AS deepest FROM walk WHERE opened > 0 GROUP BY page_id",
    "q14_whitespace": _MARKUP_SQL["whitespace"],
    "q15_optional_tags": _MARKUP_SQL["optional_tags"],
    "q16_alphabetical": _MARKUP_SQL["alphabetical"],
    "q17_inject_meta": _MARKUP_SQL["inject_meta"],
    "q18_sanitized": _MARKUP_SQL["sanitized"],
    "q19_serialized_twice": _markup(),
    "q20_errors_by_code": f"WITH {_WALK} SELECT code, count(*) AS n FROM (SELECT CASE WHEN t IN ('<p>', '</p>') THEN 'unexpected-end-tag' ELSE 'end-tag-too-early' END AS code FROM walk WHERE closed > 0 UNION ALL SELECT CASE WHEN regexp_matches(e, '^&(amp|quot|copy|middot)') THEN 'named-entity-without-semicolon' ELSE 'expected-named-entity' END FROM (SELECT unnest(regexp_extract_all(t, '&[a-zA-Z]+;?')) AS e FROM walk WHERE is_text) WHERE NOT regexp_matches(e, '^&(amp|quot|copy|middot);$')) GROUP BY code",
    "q21_decode": _values(("case_id", "encoding", "confidence", "text"), [(i, *b[1:]) for i, b in enumerate(BYTES)]),
    "q22_article_heading": "SELECT page_id, CAST(n AS BIGINT) AS n FROM (SELECT page_id, len(regexp_extract_all(html, '<h1[ >]')) AS n FROM pages) WHERE n > 0",
    "q23_tree_dumps": _values(("case_id", "dump"), [(i, t[1]) for i, t in enumerate(TREES)]),
    "q24_fragments": _values(("case_id", "dump"), [(i, t[2]) for i, t in enumerate(FRAGMENTS)]),
    "q25_sax_events": f"SELECT event, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unnest(CASE k WHEN 'RAW' THEN ['startElementNS', 'characters', 'endElementNS'] WHEN 'VOID' THEN ['startElementNS', 'endElementNS'] WHEN 'START' THEN ['startElementNS'] WHEN 'END' THEN ['endElementNS'] WHEN 'TEXT' THEN ['characters'] ELSE [] END) AS event, CASE WHEN k = 'TEXT' THEN {_CUT} ELSE 1 END AS n FROM ({_PIECES})) GROUP BY event",
    "q26_genshi_events": f"SELECT event, count(*) AS n FROM (SELECT unnest(CASE k WHEN 'RAW' THEN ['START', 'TEXT', 'END'] WHEN 'VOID' THEN ['START', 'END'] ELSE [k] END) AS event FROM ({_PIECES})) GROUP BY event",
    "q27_lint": f"SELECT problem, count(*) AS n FROM (SELECT CASE WHEN t = '<br>' THEN 'void element as a start tag' WHEN k = 'COMMENT' THEN 'comment without data' WHEN t = '</li>' THEN 'tag without a name' WHEN k = 'TEXT' AND t LIKE '%©%' THEN 'empty text' END AS problem FROM ({_PIECES})) WHERE problem IS NOT NULL GROUP BY problem",
    **{f"q{30 + i}_stream_{name}": sql for i, (name, sql) in enumerate(_MARKUP_SQL.items())},
    "q28_text_escaping": "SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '>', '&gt;'), '<', '&lt;') AS escaped FROM documents",
    "q29_xml_names": _values(("kind", "name", "value", "attrs"), [("element", "aU0003Ab", "", "cU0003Cd"), ("comment", "", "x- -y", "")]),
    "page_overview": f"SELECT page_id, {_UNESCAPE.format('t')} AS title, CAST(len(regexp_extract_all(html, '<a href=')) AS BIGINT) AS links FROM (SELECT page_id, html, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS t FROM pages)",
}
for _k in ("q23_tree_dumps", "q24_fragments", "q21_decode"):
    SQL[_k] = SQL[_k].replace("SELECT *", "SELECT CAST(case_id AS BIGINT) AS case_id, * EXCLUDE (case_id)")
