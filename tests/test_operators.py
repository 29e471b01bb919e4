"""Relations, filters, serializer, sanitizer and adapters on Spark."""

import pytest
from pyspark.sql import functions as F

from tagloom.operators import filters, relations as R, serialize as S
from tagloom.operators.parse import concatenate_text, debug_log, errors, nodes, parse_html, tokens
from tagloom.operators.sanitize import safe_css
from tagloom.plans.checks import columns_read, count_nodes, pushed_filters

from .conftest import SF


def pages(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "page_id long, html string")


def tree(spark, *texts, **options):
    return nodes(pages(spark, *texts), "page_id", "html", **options)


def render(spark, html, encoding=None, fragment="div", **options):
    (row,) = S.serialize(tokens(tree(spark, html, fragment=fragment)), S.Options(**options), encoding).collect()
    return row["html"]


def test_nulls_and_empty_pages(spark):
    found = nodes(pages(spark, None, "", "x"), "page_id", "html").groupBy("doc_id").count().collect()
    assert {r[0]: r[1] for r in found} == {1: 4, 2: 5}
    assert nodes(pages(spark, "x").limit(0), "page_id", "html").count() == 0


def test_token_stream_splits_texts(spark):
    rows = tokens(tree(spark, "<p>  a b \n</p><br>", fragment="div")).orderBy("seq", "sub").collect()
    assert [(r["type"], r["data"] or r["name"]) for r in rows] == [("StartTag", "p"), ("SpaceCharacters", "  "), ("Characters", "a b"), ("SpaceCharacters", " \n"), ("EndTag", "p"), ("EmptyTag", "br")]
    joined = concatenate_text(tokens(tree(spark, " a "))).filter("type = 'Characters'").collect()
    assert [r["data"] for r in joined] == ["a "]


@pytest.mark.parametrize(
    ("html", "options", "want"),
    [
        ("<p title='a\"b'>", {}, "<p title='a\"b'>"),
        ("<p title=\"a'b\">", {"quote_char": "'"}, "<p title='a&#39;b'>"),
        ("<p title=a>", {"quote_attr_values": "always"}, '<p title="a">'),
        ("<p title=''>", {}, '<p title="">'),
        ("<input disabled=x>", {}, "<input disabled>"),
        ("<input disabled=x>", {"minimize_boolean_attributes": False}, "<input disabled=x>"),
        ("a<br>", {"use_trailing_solidus": True}, "a<br />"),
        ("<p a='<'>", {"escape_lt_in_attrs": True}, '<p a="&lt;">'),
        ("a&amp;&lt;b", {}, "a&amp;&lt;b"),
        ("<script>a<b</script>", {}, "<script>a<b</script>"),
        ("<script>a<b</script>", {"escape_rcdata": True}, "<script>a&lt;b</script>"),
        ("<ul><li>a</li><li>b</li></ul>", {}, "<ul><li>a<li>b</ul>"),
        ("<ul><li>a</li></ul>", {"omit_optional_tags": False}, "<ul><li>a</li></ul>"),
        ("<p> a \n b <pre> a \n b </pre>", {"strip_whitespace": True, "omit_optional_tags": False}, "<p> a b </p><pre> a \n b </pre>"),
        ("<p c=1 a=2 b=3>", {"alphabetical_attributes": True}, "<p a=2 b=3 c=1>"),
        ("<script>x</script><b onclick=y href='javascript:z'>", {"sanitize": True, "omit_optional_tags": False}, "&lt;script&gt;x&lt;/script&gt;<b></b>"),
    ],
)
def test_serializer(spark, html, options, want):
    assert render(spark, html, **options) == want


def test_encoding_falls_back_to_references(spark):
    assert bytes(render(spark, "é☃𝄞", "ascii")) == b"&eacute;&#x2603;&#x1d11e;"


def test_inject_meta(spark):
    assert bytes(render(spark, "<title>x</title>", "utf-8", fragment=None)) == b"<meta charset=utf-8><title>x</title>"
    assert bytes(render(spark, "<meta charset=koi8-r>", "utf-8", fragment=None)) == b"<meta charset=utf-8>"


def test_unknown_options_are_refused():
    with pytest.raises(TypeError):
        S.Options(foo=1)
    with pytest.raises(ValueError):
        S.Options(quote_attr_values="never")


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<a href='java\tscript:x'>a</a>", "<a>a</a>"),
        ("<a href='http://x/?a=1'>a</a>", '<a href="http://x/?a=1">a</a>'),
        ("<img src='data:image/png,x'><img src='data:text/html,x'>", '<img src="data:image/png,x"><img>'),
        ("<a href='h://]'>a</a>", "<a>a</a>"),
        ("<!--x-->y", "y"),
        ("<svg><rect fill='url(http://x)'/></svg>", '<svg><rect fill=" "></rect></svg>'),
        ("<b style='color: red; x: url(y)'>a</b>", '<b style="color: red;">a</b>'),
    ],
)
def test_sanitizer(spark, html, want):
    assert render(spark, html, sanitize=True, omit_optional_tags=False, quote_attr_values="always") == want


def test_style_values():
    assert safe_css("color: red; position: fixed; border: 1px solid blue") == "color: red; border: 1px solid blue;"
    assert safe_css("width: expression(alert())") == ""


def test_lint_finds_what_is_wrong(spark):
    good = tokens(tree(spark, "<p>a<br>b<svg><a/></svg>"))
    assert filters.lint(good).count() == 0
    bad = good.withColumn("name", F.when(F.col("type") == "EndTag", "x").otherwise(F.col("name")))
    assert filters.lint(bad).filter("problem = 'end tag without its start tag'").count() > 0


def test_adapters(spark):
    stream = tokens(tree(spark, "<!doctype html><p>a<br><!--c-->"))
    sax = [r["event"] for r in S.sax_events(stream).orderBy("seq", "sub", "part").collect()]
    assert sax == ["startElementNS"] * 2 + ["endElementNS"] + ["startElementNS"] * 2 + ["characters", "startElementNS", "endElementNS"] + ["endElementNS"] * 3
    genshi = [r["event"] for r in S.genshi_events(stream).orderBy("seq", "sub", "part").collect()]
    assert genshi[0] == "DOCTYPE" and genshi.count("COMMENT") == 1


def test_xml_names_round_trip():
    for name in ("a", "1a", "a:b", "é☃", "-x"):
        assert S.from_xml_name(S.xml_name(name)) == name
    assert S.xml_name("a:b") == "aU0003Ab"


def test_relations(spark):
    t = tree(spark, "<article><h1>a<b>b</b></h1><p><a href=x>c</a><a>d</a></article>").cache()
    assert [r["text"] for r in R.text_content(t, R.elements(t, "h1")).collect()] == ["ab"]
    assert [r["href"] for r in R.links(t).collect()] == ["x"]
    assert R.descendants(R.elements(t, "b"), R.elements(t, "article")).count() == 1
    assert R.nested(t, "p").count() == 0
    assert R.main_tree(t).count() == t.count() - 1


def test_strict_mode_raises(spark):
    with pytest.raises(Exception, match="parse error"):
        errors(pages(spark, "<p></b>"), "page_id", "html", strict=True).collect()


def test_debug_log(spark):
    rows = debug_log(pages(spark, "a"), "page_id", "html").collect()
    assert [(r["mode"], r["token"]) for r in rows][0] == ("initial", "Characters")


def test_plans(spark):
    table = spark.read.parquet(f"{SF}/pages.parquet")
    found = nodes(table.filter("url is not null"), "page_id", "html").filter("kind = 'comment'")
    assert count_nodes(found, "ArrowEvalPython") == 1
    assert "IsNotNull(url)" in pushed_filters(found)
    only = table.select("page_id", parse_html("html", want=()).getField("compat_mode"))
    assert "url" not in columns_read(only)


def test_any_partitioning_gives_the_same(spark):
    table = spark.read.parquet(f"{SF}/pages.parquet")
    mark = lambda df: df.agg(F.sum(F.xxhash64(*[c for c in df.columns if c != "attrs"]).cast("decimal(38,0)"))).first()[0]
    assert mark(nodes(table.repartition(1), "page_id", "html")) == mark(nodes(table.repartition(7), "page_id", "html"))


def test_streams(spark, tmp_path):
    from tagloom.streaming.pages import read_pages, stream_filtered, stream_nodes, stream_serialized

    folder = tmp_path / "in"
    spark.read.parquet(f"{SF}/pages.parquet").limit(5).repartition(2).write.parquet(str(folder))
    stream_nodes(read_pages(spark, str(folder), 1), str(tmp_path / "nodes"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "nodes")).select("doc_id").distinct().count() == 5
    stream_serialized(read_pages(spark, str(folder), 1), str(tmp_path / "html"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "html")).count() == 5
    upper = lambda stream: stream.withColumn("data", F.upper("data"))
    stream_filtered(read_pages(spark, str(folder), 1), str(tmp_path / "upper"), str(tmp_path / "c3"), extra=[upper]).awaitTermination()
    both = spark.read.parquet(str(tmp_path / "html")).alias("x").join(spark.read.parquet(str(tmp_path / "upper")).alias("y"), "doc_id")
    assert both.count() == 5 and both.filter(F.col("x.html") == F.col("y.html")).isEmpty()


def test_readers(spark, tmp_path):
    from tagloom.sources.pages import from_files, from_text

    (tmp_path / "a.html").write_bytes("<title>é</title>".encode("latin-1"))
    doc = from_files(spark, str(tmp_path)).select(parse_html("content").alias("doc")).first()["doc"]
    assert doc["encoding"] == "windows-1252" and any(n["value"] == "é" for n in doc["nodes"])
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "b.html").write_text("<p>x")
    assert from_text(spark, str(tmp_path / "b")).count() == 1


def test_sql_functions(spark):
    from tagloom.operators.parse import register

    register(spark)
    pages(spark, "<p>a", None).createOrReplaceTempView("some_pages")
    rows = spark.sql("SELECT page_id, n.name FROM some_pages, LATERAL html_nodes(html) AS n WHERE n.kind = 'element' ORDER BY enter_seq").collect()
    assert [r["name"] for r in rows] == ["html", "head", "body", "p"]
    assert spark.sql("SELECT parse_html(html).compat_mode AS m FROM some_pages").collect()[0]["m"] == "quirks"


def test_flavours(spark):
    t = tree(spark, '<!DOCTYPE html PUBLIC "a{b" ""><!--a--b--><x:y>')
    assert R.flavour(t, "etree").filter("kind <> 'element'").count() == 0
    assert R.flavour(t, "DOM").count() == t.count()
    safe = R.flavour(t, "lxml").collect()
    assert [r["public_id"] for r in safe if r["kind"] == "doctype"] == ["aU0007Bb"]
    assert [r["value"] for r in safe if r["kind"] == "comment"] == ["a- -b"]
    with pytest.raises(ValueError):
        R.flavour(t, "other")


#: Pages in which neighbours, raw texts, foreign parts, attributes and encodings matter.
ODD_PAGES = (
    "", " ", "<p> a <pre> b  c </pre> <textarea> d  e</textarea>", "<!--a--b--><!DOCTYPE html PUBLIC 'x' \"y'z\"><title>t</title>",
    "<table><colgroup><col><tbody><tr><td>a<td>b<tr><th>c</table><table><thead><tr><td>x<tfoot><tr><td>y<tbody>z</table>",
    "<dl><dt>a<dd>b<dt>c</dl><ruby>a<rt>b<rp>c</ruby><select><optgroup><option>a<option>b<optgroup></select>",
    "<svg viewbox='0 0'><a xlink:href='javascript:x' fill='url(http://x)'><animate xlink:href=' #a'/><animate xlink:href='b'/></a></svg>",
    "<math><mi definitionurl=x>é</mi></math><script>if (a<b) x='</scr'+'ipt>'</script><style>a > b</style>",
    "<a href=\"data:image/png,x\" onclick=y style='color: red; x: y' title='a\"b'>1</a><a href='java&#10;script:a' title=\"it's\">2</a>",
    "<meta charset=koi8-r><meta http-equiv=Content-Type content='text/html; charset=x'><p title='é☃'>é☃𝄞&nbsp;<input disabled checked=x>",
    "<body><!--x--><script></script><p>a<div>b</div><p>c<br><hr>d<noscript><p>e</noscript><xmp><b></xmp>", "<frameset><frame></frameset>",
    "<html> <head> <title>a  b</title> </head> <body> <ul> <li> a </li> <li> b </ul> </body> </html>", "<p a='' b=x/y c=\"`\" d='=' e=　>&lt;&amp;&gt;</p>",
)
MANY_OPTIONS = (
    {}, {"omit_optional_tags": False}, {"strip_whitespace": True}, {"sanitize": True}, {"sanitize": True, "omit_optional_tags": False, "alphabetical_attributes": True},
    {"quote_attr_values": "always", "quote_char": "'"}, {"quote_attr_values": "spec", "minimize_boolean_attributes": False, "use_trailing_solidus": True},
    {"use_trailing_solidus": True, "space_before_trailing_solidus": False, "escape_lt_in_attrs": True, "escape_rcdata": True}, {"use_best_quote_char": True, "quote_char": "'"},
)


@pytest.mark.parametrize("encoding", [None, "ascii", "utf-8"])
def test_kernel_markup_equals_that_of_the_stream(spark, encoding):
    table = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").limit(12)
    some = table.union(pages(spark, *ODD_PAGES).selectExpr("page_id + 1000", "html"))
    stream = tokens(nodes(some, "page_id", "html")).cache()
    for options in MANY_OPTIONS if encoding is None else MANY_OPTIONS[:4]:
        o = S.Options(**options)
        plain = {r["doc_id"]: (r["html"], sorted(r["problems"])) for r in S.serialize(stream, o, encoding).collect()}
        rows = some.select("page_id", S.serialize_html("html", o, encoding).alias("out")).collect()
        found = {r["page_id"]: (r["out"]["html"], sorted(r["out"]["problems"])) for r in rows}
        assert plain.keys() | {k for k, v in found.items() if not v[0]} == found.keys()  # a page without tokens has no row in a stream
        assert {k: found[k] for k in plain} == plain, options
    stream.unpersist()


def test_kernel_markup_of_nulls_fragments_and_strict_mode(spark):
    rows = pages(spark, None, "<td>a").select(S.serialize_html("html", fragment="tr").alias("out")).collect()
    assert rows[0]["out"] is None and rows[1]["out"]["html"] == "<td>a"
    with pytest.raises(Exception, match="Comment contains"):
        pages(spark, "<!--a--b-->").select(S.serialize_html("html", strict=True)).collect()


def test_names_are_encoded_strictly(spark):
    for html in ("<aé>", "<p é=1>"):
        with pytest.raises(Exception, match="ascii"):
            render(spark, html, "ascii")
        with pytest.raises(Exception, match="ascii"):
            pages(spark, html).select(S.serialize_html("html", encoding="ascii")).collect()
    assert bytes(render(spark, "<p a=é>", "ascii")) == b"<p a=&eacute;>"


def test_page_local_queries_run_the_kernel_once_and_move_nothing(spark):
    from tagloom.queries import QUERIES

    for name, query in QUERIES.items():
        number = int(name[1:3]) if name[0] == "q" else 0
        if number <= 18 and number not in (12, 13) or number in (22,):
            plan = query(spark, SF)
            assert (name, count_nodes(plan, "ArrowEvalPython"), count_nodes(plan, "Exchange")) == (name, 1, 0)


def test_arrays_agree_with_relations(spark):
    table = pages(spark, *ODD_PAGES)
    doc = table.select("page_id", parse_html("html", want=("nodes",)).alias("doc"))
    n = F.col("doc.nodes")
    t = nodes(table, "page_id", "html")
    texts = doc.select("page_id", F.inline(F.transform(R.array_elements(n, "p", "td", "body"), lambda x: F.struct(x["node_id"].alias("root_id"), R.array_text(n, x).alias("text")))))
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(texts) == key(R.text_content(t, R.elements(t, "p", "td", "body")))
    inner = doc.select("page_id", F.inline(F.flatten(F.transform(R.array_elements(n, "table", "body"), lambda x: F.transform(R.array_descendants(n, x), lambda y: F.struct(x["node_id"].alias("root_id"), y["node_id"].alias("node_id")))))))
    assert key(inner) == key(R.descendants(t, R.elements(t, "table", "body"), ()))
    rows = doc.select("page_id", F.inline(F.transform(F.filter(R.array_elements(n, "td"), lambda x: R.array_parent(n, x)["name"] == "tr"), lambda x: F.struct(x["node_id"].alias("id")))))
    assert key(rows) == key(R.children(t, "tr", "td").select("doc_id", "node_id"))


def test_style_values_take_no_time():
    import time

    began = time.perf_counter()
    for value in ("a" * 4000, "a-" * 2000, "'" + "a " * 2000, "a:" * 2000, "color: " + "1px " * 1000, "(" + "1," * 2000, "url(" * 1000, "-" * 4000 + ":", "a:b;" * 1000 + "'"):
        safe_css(value)
    assert time.perf_counter() - began < 5


def test_namespace_of_html_is_optional(spark):
    page = "<p>a<svg><b/></svg><math><mi>x"
    rows = tree(spark, page, namespace_html=False).filter("kind = 'element'").collect()
    assert {(r["name"], r["ns"]) for r in rows} >= {("p", None), ("body", None), ("svg", "http://www.w3.org/2000/svg"), ("mi", "http://www.w3.org/1998/Math/MathML")}
    (with_ns,), (without,) = (S.serialize(tokens(tree(spark, page, namespace_html=n))).collect() for n in (True, False))
    assert with_ns["html"] == without["html"]


def test_sax_calls_and_token_lines(spark):
    stream = tokens(tree(spark, "<!DOCTYPE html><p b=1 a=2>x<!--c--><svg xlink:href=y>"))
    calls = [r["event"] for r in S.sax_calls(stream).orderBy("seq", "sub", "part").collect()]
    assert calls[0] == "startDocument" and calls[-1] == "endDocument"
    assert calls.count("startPrefixMapping") == calls.count("endPrefixMapping") == 6 and calls[1:7] == ["startPrefixMapping"] * 6
    assert calls[7:-7] == [r["event"] for r in S.sax_events(stream).orderBy("seq", "sub", "part").collect()]
    lines = [r["line"] for r in S.token_lines(stream).orderBy("seq", "sub").collect()]
    assert lines[0] == "<!DOCTYPE html>" and '<p a="2" b="1">' in lines and '"x"' in lines and "<!-- c -->" in lines and '<svg svg xlink href="y">' in lines and "</svg svg>" in lines


def test_own_filters_run_first(spark):
    upper = lambda stream: stream.withColumn("data", F.upper("data"))
    (row,) = S.serialize(tokens(tree(spark, "<p>a", fragment="div")), extra=[upper]).collect()
    assert row["html"] == "<p>A"


def test_names_are_restored(spark):
    t = tree(spark, "<a:b c<d=1>")
    key = lambda df: sorted((r["node_id"], r["name"] or "", tuple(a["name"] for a in r["attrs"])) for r in df.filter("kind = 'element'").collect())
    assert key(S.restore_names(S.coerce_names(t))) == key(t)


def test_tokens_come_back_from_events(spark):
    stream = tokens(tree(spark, "<!DOCTYPE html><p a=1> x <br>y<!--c--> <svg><br/></svg>", fragment=None))
    again = S.tokens_from_events(S.genshi_events(stream))
    key = lambda df: [(r["type"], r["name"], r["data"]) for r in df.orderBy("seq", "sub").collect()]
    assert key(again) == key(stream)
    assert S.serialize(again).first()["html"] == S.serialize(stream).first()["html"]


def test_losses_are_named(spark):
    t = tree(spark, '<!DOCTYPE html PUBLIC "a{b" ""><!--a--b--><x:y c<d=1>ok<b>fine')
    assert sorted(r["problem"] for r in S.coercion_losses(t).collect()) == ["attribute name", "comment", "element name", "public identifier"]


def test_what_a_worker_holds_does_not_grow_with_spark_batches(spark):
    import tracemalloc

    import pyarrow as pa

    from tagloom.operators.parse import _kernel

    page = spark.read.parquet(f"{SF}/pages.parquet").first()["html"]

    def peak(count):
        batch, rows = pa.array([page, None] * (count // 2)), 0
        tracemalloc.start()
        try:
            for part in _kernel(want=("nodes",)).func(iter([batch])):
                rows += len(part)
                assert part.nbytes < 4 << 20
            return rows, tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    (few, least), (many, most) = peak(400), peak(1600)
    assert (few, many) == (400, 1600) and most < 1.5 * least


def test_slices_hold_each_row_once(spark):
    import pyarrow as pa

    from tagloom.operators.parse import slices

    for rows in ([], [None] * 3, ["a" * 3000, "", None, "é" * 300], [b"x" * 10, None], ["a" * 100] * 50):
        column = pa.array(rows, pa.binary() if rows and isinstance(rows[0], bytes) else pa.string())
        parts = list(slices(column, 1000))
        assert [x for p in parts for x in p.to_pylist()] == rows
        assert all(len(p) == 1 or sum(len(x) for x in p.to_pylist() if x) <= 1000 for p in parts)


def test_kernels_of_kernels_and_of_several_columns(spark):
    table = pages(spark, "<p>a", None, "", "<b>b")
    once = table.select("page_id", S.serialize_html("html")["html"].alias("html"), parse_html("html", want=()).getField("compat_mode").alias("mode"))
    rows = once.select("page_id", "mode", "html", S.serialize_html("html")["html"].alias("again")).orderBy("page_id").collect()
    assert [tuple(r)[1:] for r in rows] == [("quirks", "<p>a", "<p>a"), (None, None, None), ("quirks", "", ""), ("quirks", "<b>b</b>", "<b>b</b>")]
