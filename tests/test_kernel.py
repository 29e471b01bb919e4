"""The parsing kernel without Spark: hand-worked trees, references, errors, encodings."""

import pytest

from tagloom.functions import charsets
from tagloom.functions.treebuilder import TreeBuilder
from tagloom.operators.parse import parse_one


def shape(html, fragment=None, **options):
    """Nested tuples of names and texts below the root."""
    rows = TreeBuilder(html, fragment, **options).run().rows()
    items = [(r[1], r[7] or r[8] if r[0] != "comment" else f"<!--{r[8]}-->") for r in rows]
    made = [[name] for _, name in items]
    for i, (parent, _) in enumerate(items):
        if parent is not None:
            made[parent].append(made[i])
    fold = lambda x: (x[0], *map(fold, x[1:])) if len(x) > 1 else x[0]
    return tuple(map(fold, made[0][1:]))


def body(html, **options):
    found = shape("<!doctype html><body>" + html, **options)[1][2]
    return found[1:] if isinstance(found, tuple) else ()


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>a<p>b", (("p", "a"), ("p", "b"))),
        ("<b><p>x</b>y", (("b",), ("p", ("b", "x"), "y"))),
        ("<a>1<a>2", (("a", "1"), ("a", "2"))),
        ("<table><tr>x<td>y</table>z", ("x", ("table", ("tbody", ("tr", ("td", "y")))), "z")),
        ("<table><caption>c<tr><td>d", (("table", ("caption", "c"), ("tbody", ("tr", ("td", "d")))),)),
        ("<table><col><tr>", (("table", ("colgroup", "col"), ("tbody", "tr")),)),
        ("<dl><dt>a<dd>b<dt>c", (("dl", ("dt", "a"), ("dd", "b"), ("dt", "c")),)),
        ("<h1>a<h2>b", (("h1", "a"), ("h2", "b"))),
        ("a</br>b</p>c", ("a", "br", "b", "p", "c")),
        ("<button>a<button>b", (("button", "a"), ("button", "b"))),
        ("<form>a<form>b</form>c", (("form", "ab"), "c")),
        ("<image>", ("img",)),
        ("<xmp><b></xmp>", (("xmp", "<b>"),)),
        ("<select><b>a<table>", (("select", "a"),)),
        ("<table><select><tr><td>x", (("select",), ("table", ("tbody", ("tr", ("td", "x")))))),
        ("<svg><b>x", (("svg",), ("b", "x"))),
        ("<math><annotation-xml encoding=text/html><b>x", (("math", ("annotation-xml", ("b", "x"))),)),
        ("<svg><![CDATA[a<b]]></svg>", (("svg", "a<b"),)),
        ("<![CDATA[a]]>", ("<!--[CDATA[a]]-->",)),
        ("<ruby>a<rp>b<rt>c", (("ruby", "a", ("rp", "b"), ("rt", "c")),)),
        ("<nobr>a<nobr>b", (("nobr", "a"), ("nobr", "b"))),
        ("<script><!--<script></script>--></script>x", (("script", "<!--<script></script>-->"), "x")),
        ("<script><!--></script>x", (("script", "<!-->"), "x")),
        ("<plaintext></p>x", (("plaintext", "</p>x"),)),
        ("<p><table></p>", (("p",), "p", "table")),
    ],
)
def test_trees(html, want):
    unnest = lambda t: t if isinstance(t, str) else unnest(t[0]) if len(t) == 1 else tuple(map(unnest, t))
    assert tuple(map(unnest, body(html))) == tuple(map(unnest, want))


def test_adoption_agency_clones_at_most_three_levels():
    assert body("<b><i><u><s><p>x</b>y")[0][0] == "b"


def test_noahs_ark_keeps_three_equal_formatting_elements():
    found = body("<p>" + "<b>" * 5 + "</p>x")
    depth, node = 0, found[1]
    while isinstance(node, tuple):
        depth, node = depth + 1, node[1]
    assert depth == 3


def test_document_level_parts():
    assert shape("<!--a--><!doctype html><!--b--><p>x</p></body></html><!--c-->")[0] == "<!--a-->"
    assert shape("<frameset><frame></frameset>") == (("html", "head", ("frameset", "frame")),)


@pytest.mark.parametrize(("html", "container", "want"), [("<td>x", "tr", (("td", "x"),)), ("<tr><td>x", "table", (("tbody", ("tr", ("td", "x"))),)), ("<td>x", "div", ("x",)), ("<b>&lt;", "textarea", ("<b><",)), ("<b>&lt;", "script", ("<b>&lt;",))])
def test_fragments(html, container, want):
    assert shape(html, container) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("&amp;&lt&gt;", "&<>"), ("&notit;", "¬it;"), ("&notin;", "∉"), ("&#65;&#x42;&#128;", "AB€"), ("&#0;&#xD800;&#x110000;", "\ufffd\ufffd\ufffd"), ("&x;&", "&x;&"), ("&#;&#x;", "&#;&#x;")],
)
def test_references_in_text(text, want):
    assert "".join(body(text)) == want


def test_references_in_attributes():
    rows = TreeBuilder("<a href='?a=1&copy=2&amp;b&lt'>").run().rows()
    assert next(r for r in rows if r[7] == "a")[11] == [(None, None, "href", "?a=1&copy=2&b<")]


def test_attributes_keep_order_and_first_value():
    rows = TreeBuilder("<p b=1 a=2 B=3 c>").run().rows()
    assert [(a[2], a[3]) for a in next(r for r in rows if r[7] == "p")[11]] == [("b", "1"), ("a", "2"), ("c", "")]


def test_quirks_modes():
    mode = lambda html: TreeBuilder(html).run().quirks
    assert mode("<!doctype html>") == "no quirks"
    assert mode("<p>") == "quirks"
    assert mode('<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Transitional//EN" "x">') == "limited quirks"
    assert mode('<!DOCTYPE html PUBLIC "-//W3C//DTD HTML 4.01 Transitional//EN">') == "quirks"
    assert mode('<!DOCTYPE html PUBLIC "-//W3C//DTD HTML 3.2//EN">') == "quirks"


def test_nul_and_surrogates():
    assert body("a\0b") == ("ab",)
    assert body("<svg>a\0b") == (("svg", "a\ufffdb"),)
    assert parse_one("a\ud800b")["nodes"][-1]["value"] == "a\ufffdb"


def test_error_codes_and_places():
    found = parse_one("<!doctype html>\n<p a a>\n</b>")["errors"]
    assert [(e["line"], e["code"]) for e in found] == [(2, "duplicate-attribute"), (3, "unexpected-end-tag")]


def test_enter_and_exit_are_nested():
    rows = TreeBuilder("<div><p>a<b>c</p>d<!--e--></div>").run().rows()
    for r in rows:
        if r[1] is not None:
            assert rows[r[1]][2] < r[2] < r[3] < rows[r[1]][3]


def test_deep_nesting_needs_no_recursion():
    assert len(TreeBuilder("<div>" * 5000).run().rows()) == 5004


@pytest.mark.parametrize(
    ("content", "hints", "want"),
    [
        (b"\xef\xbb\xbfx", {"override": "koi8-r"}, ("utf-8", "certain")),
        (b"x", {"override": "koi8-r", "transport": "utf-8"}, ("koi8-r", "certain")),
        (b"x", {"transport": "utf-8"}, ("utf-8", "certain")),
        (b"<meta charset=utf-8>", {"likely": "koi8-r"}, ("utf-8", "tentative")),
        (b"<meta charset=utf-16>", {}, ("utf-8", "tentative")),
        (b"x", {"same_origin_parent": "utf-16", "likely": "koi8-r"}, ("koi8-r", "tentative")),
        (b"x", {"default": "shift_jis"}, ("shift_jis", "tentative")),
        (b"x", {}, ("windows-1252", "tentative")),
        (b" " * 1010 + b"<meta charset=utf-8>", {}, ("windows-1252", "tentative")),
        (b"<!--<meta charset=koi8-r>--><meta charset=utf-8>", {}, ("utf-8", "tentative")),
        (b'<meta content="a; charset=koi8-r" http-equiv=content-type>', {}, ("koi8-r", "tentative")),
    ],
)
def test_encoding_precedence(content, hints, want):
    assert charsets.determine(content, **hints)[:2] == want


def test_late_meta_restarts():
    content = b"\xe9<!--" + b"x" * 2000 + b"--><meta charset=iso-8859-2>\xb1"
    found = parse_one(content)
    assert (found["encoding"], found["confidence"]) == ("iso-8859-2", "certain")
    assert found["nodes"][-1]["value"].endswith("ą")


def test_every_kind_of_decoder():
    assert charsets.decode(b"\x80\x81", "windows-1252") == "€\x81"
    assert charsets.decode(b"a\xff", "x-user-defined") == "a\uf7ff"
    assert charsets.decode(b"abc", "replacement") == "\ufffd"
    for name in charsets.LABELS:
        assert isinstance(charsets.decode(b"abc\x80", name), str)


def test_hostile_pages_take_little_time():
    import time

    from tagloom.operators.parse import parse_one

    pages = ("&#" + "9" * 5000 + ";x", "&#x" + "f" * 5000, "<div>" * 8000 + "<p>x" * 200, "<b>" * 4000 + "<p>x" * 300, "<table>" * 3000, "<a><div>" * 2000, "<p><i><b><u>" * 1000, "<!--" * 5000, "<" * 20000)
    for page in pages:
        began = time.perf_counter()
        assert parse_one(page)["nodes"]
        assert time.perf_counter() - began < 8, page[:20]
    text = lambda page: "".join(n["value"] for n in parse_one(page)["nodes"] if n["kind"] == "text")
    assert text("&#" + "0" * 5000 + "65;x") == "Ax" and text("&#" + "9" * 5000 + ";x") == "�x"


@pytest.mark.parametrize(
    ("html", "codes"),
    [
        ("<a", "eof-in-tag-name"), ("<a ", "expected-attribute-name-but-got-eof"), ("<a b", "eof-in-attribute-name"), ("<a b ", "expected-end-of-tag-but-got-eof"),
        ("<a b=", "expected-attribute-value-but-got-eof"), ("<a b=c", "eof-in-attribute-value-no-quotes"), ('<a b="c"', "unexpected-EOF-after-attribute-value"),
        ("<a/", "unexpected-EOF-after-solidus-in-tag"), ('<p a"b>', "invalid-character-in-attribute-name"), ('<p a "b>', "invalid-character-after-attribute-name"),
        ("<p a==x>", "equals-in-unquoted-attribute-value"), ('<p a=x"y>', "unexpected-character-in-unquoted-attribute-value"), ("<p a = x b>", ""), ("<p a b=c>", ""),
        ("<!-->", "incorrect-comment"), ("<!--a", "eof-in-comment"), ("<!--a-", "eof-in-comment-end-dash"), ("<!--a--", "eof-in-comment-double-dash"),
        ("<!--a--!", "unexpected-bang-after-double-dash-in-comment eof-in-comment-end-bang-state"), ("<!--a--->", "unexpected-dash-after-double-dash-in-comment"),
        ("<!--a--b-->", "unexpected-char-in-comment"), ("<!--a-b-->", ""),
    ],
)
def test_error_codes_of_tags_and_comments(html, codes):
    found = parse_one("<!DOCTYPE html>" + html)["errors"]
    assert [e["code"] for e in found if e["code"] != "expected-closing-tag-but-got-eof"] == codes.split()


@pytest.mark.parametrize(
    ("html", "code"),
    [
        ("<!DOCTYPE h", "eof-in-doctype-name"), ("<!DOCTYPE h ", "eof-in-doctype"), ("<!DOCTYPE html SYSTEM>", "unexpected-char-in-doctype"),
        ("<!DOCTYPE html PUBLIC>", "unexpected-end-of-doctype"), ("<!DOCTYPE html SYSTEM'a'>", "unexpected-char-in-doctype"), ("<!DOCTYPEhtml>", "need-space-after-doctype"),
    ],
)
def test_error_codes_of_doctypes(html, code):
    assert parse_one(html)["errors"][0]["code"] == code
