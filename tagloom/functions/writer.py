"""A parsed page as markup, one page at a time: tokens, filters and markup without leaving the kernel.

The same rules as the relations of `operators` (filters, sanitize, serialize), for the common case
that a whole page goes in and its markup comes out: nothing is expanded, shuffled or collected.
A token is a list: type, ns, name, data, public id, system id, attributes (ns, prefix, name, value).
"""

from __future__ import annotations

import re

from tagloom.functions import tables as T

TYPE, NS, NAME, DATA, PUBLIC, SYSTEM, ATTRS = range(7)
_EDGES = re.compile(r"([\t\n\f\r ]*)(.*?)([\t\n\f\r ]*)\Z", re.DOTALL)
_SPACES = re.compile(r"[\t\n\f\r ]+")
_TAGS = ("StartTag", "EmptyTag")


def tokens_of(rows: list[tuple]) -> list[list]:
    """The walk of a tree whose rows come in document order (see `TreeBuilder.rows`)."""
    out: list[list] = []
    open_: list[tuple[int, list]] = []  # elements with an end tag to come, by the number at which they end
    for kind, _, enter, leave, _, _, ns, name, value, public, system, attrs in rows:
        while open_ and open_[-1][0] < enter:
            out.append(open_.pop()[1])
        if kind == "element":
            if (ns or T.HTML) == T.HTML and name in T.VOID:
                out.append(["EmptyTag", ns, name, None, None, None, attrs])
                if leave > enter + 1:
                    out.append(["SerializeError", None, None, "Void element has children", None, None, []])
            else:
                out.append(["StartTag", ns, name, None, None, None, attrs])
                open_.append((leave, ["EndTag", ns, name, None, None, None, []]))
        elif kind == "text":
            parts = _EDGES.match(value).groups()
            out += [[k, None, None, x, None, None, []] for k, x in zip(("SpaceCharacters", "Characters", "SpaceCharacters"), parts, strict=True) if x]
        elif kind == "comment":
            out.append(["Comment", None, None, value, None, None, []])
        elif kind == "doctype":
            out.append(["Doctype", None, name, None, public, system, []])
    out += [token for _, token in reversed(open_)]
    return out


# -- filters -------------------------------------------------------------------------------------


def with_charset(tokens: list[list], encoding: str) -> list[list]:
    """Encodings in `<meta>` say `encoding`; one follows the head's start tag if the head names none."""
    head_end = next((i for i, t in enumerate(tokens) if t[TYPE] == "EndTag" and t[NAME].lower() == "head"), None)
    known, out = False, []
    for i, t in enumerate(tokens):
        if t[TYPE] == "EmptyTag" and t[NAME].lower() == "meta":
            plain = {n: v for ns, _, n, v in t[ATTRS] if ns is None}
            if any(n.lower() == "charset" for n in plain):
                name, value = "charset", encoding
            elif plain.get("http-equiv", "").lower() == "content-type" and "content" in plain:
                name, value = "content", f"text/html; charset={encoding}"
            else:
                name = value = None
            if name:
                known |= head_end is not None and i < head_end
                t = [*t[:ATTRS], [(ns, p, n, value if ns is None and (n.lower() if name == "charset" else n) == name else v) for ns, p, n, v in t[ATTRS]]]
        out.append(t)
    if head_end is None or known:
        return out
    start = next((i for i, t in enumerate(out) if t[TYPE] == "StartTag" and t[NAME].lower() == "head"), None)
    if start is not None:
        out.insert(start + 1, ["EmptyTag", None, "meta", None, None, None, [(None, None, "charset", encoding)]])
    return out


def in_alphabet(tokens: list[list]) -> list[list]:
    return [[*t[:ATTRS], sorted(t[ATTRS], key=lambda a: (a[0] or "", a[2]))] if len(t[ATTRS]) > 1 else t for t in tokens]


def one_space(tokens: list[list], kept: frozenset) -> list[list]:
    """Runs of white space as one, but within elements of `kept`."""
    depth, out = 0, []
    for t in tokens:
        if t[NAME] in kept:
            depth += (t[TYPE] == "StartTag") - (t[TYPE] == "EndTag")
        if depth <= 0 and t[TYPE] in ("Characters", "SpaceCharacters"):
            t = [*t[:DATA], _SPACES.sub(" ", t[DATA]), None, None, []]
        out.append(t)
    return out


_NOISE = re.compile(r"[`\x00-\x20\x7f-\xa0\s]+")
_SCHEME = re.compile(r"([a-z][a-z0-9+.\-]*):")
_HOST = re.compile(r"(?:[a-z][a-z0-9+.\-]*:)?//([^/?#]*)")
_DATA_TYPE = re.compile(r"data:([-a-z0-9.]+/[-a-z0-9.]+)(?:;charset=[-a-z0-9]+(?:;(?:base64)?)?|(?:;base64)?(?:;charset=[-a-z0-9]+)?),")
_NOT_LOCAL = re.compile(r"\s*[^#\s]")
_FAR_URL = re.compile(r"url\s*\(\s*[^#\s][^)]+?\)")


def _raw(value: str) -> str:
    return value.replace("&gt;", ">").replace("&lt;", "<").replace("&amp;", "&")


def _safe(value: str) -> str:
    return value.replace("&", "&amp;").replace(">", "&gt;").replace("<", "&lt;")


def uri_is_safe(value: str, lists) -> bool:
    plain = _NOISE.sub("", _raw(value)).lower().replace("�", "")
    host = _HOST.match(plain)
    if host and ("[" in host[1]) != ("]" in host[1]):
        return False
    scheme = _SCHEME.match(plain)
    if scheme is None:
        return True
    if scheme[1] == "data" and not ((kind := _DATA_TYPE.match(plain)) and kind[1] in lists.content_types):
        return False
    return scheme[1] in lists.schemes


def sanitized(tokens: list[list], lists, safe_css) -> list[list]:
    """Comments go, tags of unknown elements become text, unsafe attributes go."""
    out = []
    for t in tokens:
        kind, ns, name = t[TYPE], t[NS], t[NAME]
        if kind == "Comment":
            continue
        if kind == "EndTag" or kind in _TAGS:
            if f"{T.HTML if ns is None else ns} {name}" not in lists.elements:
                shown = "".join(f' {n if space is None else T.PREFIXES[space] + ":" + n}="{_safe(v)}"' for space, _, n, v in t[ATTRS] if space is None or space in T.PREFIXES)
                out.append(["Characters", ns, None, f"</{name}>" if kind == "EndTag" else f"<{name}{shown}>", None, None, []])
                continue
            if t[ATTRS]:
                t = [*t[:ATTRS], [a for a in (_safe_attribute(name, a, lists, safe_css) for a in t[ATTRS]) if a]]
        out.append(t)
    return out


def _safe_attribute(element: str, a: tuple, lists, safe_css) -> tuple | None:
    ns, prefix, name, value = a
    key = f"{ns or ''} {name}"
    if key not in lists.attributes or key in lists.uris and not uri_is_safe(value, lists):
        return None
    if key == f"{T.XLINK} href" and element in lists.svg_local_href and _NOT_LOCAL.match(value):
        return None
    if key in lists.svg_references:
        value = _FAR_URL.sub(" ", _raw(value))
    if key == " style":
        value = safe_css(value, lists)
    return ns, prefix, name, value


def without_optional_tags(tokens: list[list], start_goes, end_goes) -> list[list]:
    """`start_goes(name, before, after)` and `end_goes(name, after)` judge by the neighbours' (type, name)."""
    near = [None, *((t[TYPE], t[NAME]) for t in tokens), None]
    out = []
    for i, t in enumerate(tokens):
        if t[TYPE] == "StartTag" and not t[ATTRS] and start_goes(t[NAME], near[i], near[i + 2]):
            continue
        if t[TYPE] == "EndTag" and end_goes(t[NAME], near[i + 2]):
            continue
        out.append(t)
    return out


#: What may follow the end tag of an element that is left out: names of start tags, and whether an end tag or the end may.
_FOLLOWERS = {
    "li": ("li", True), "optgroup": ("optgroup", True), "tr": ("tr", True), "dt": ("dt dd", False), "dd": ("dt dd", True),
    "option": ("option optgroup", True), "rt": ("rt rp", True), "rp": ("rt rp", True), "thead": ("tbody tfoot", False),
    "tbody": ("tbody tfoot", True), "tfoot": ("tbody", True), "td": ("td th", True), "th": ("td th", True),
}
_FOLLOWERS = {k: (frozenset(names.split()), last) for k, (names, last) in _FOLLOWERS.items()}


def start_tag_goes(name: str, before, after, compat: bool = True) -> bool:
    kind, of = after or (None, None)
    plain = kind not in ("Comment", "SpaceCharacters")
    if name in "html" if compat else name == "html":
        return plain
    match name:
        case "head":
            return kind in _TAGS or (kind, of) == ("EndTag", "head")
        case "body":
            return plain and not (kind == "StartTag" and of in ("script", "style"))
        case "colgroup":
            return kind in _TAGS and of == "col"
        case "tbody":
            return (kind, of) == ("StartTag", "tr") and not (before and before[0] == "EndTag" and before[1] in ("tbody", "thead", "tfoot"))
    return False


def end_tag_goes(name: str, after, flow: frozenset) -> bool:
    kind, of = after or (None, None)
    plain = kind not in ("Comment", "SpaceCharacters")
    if name in ("html", "head", "body"):
        return plain
    if name == "colgroup":
        return plain and (kind, of) != ("StartTag", "colgroup")
    if name == "p":
        return of in flow if kind in _TAGS else kind in (None, "EndTag")
    if name in _FOLLOWERS:
        names, last = _FOLLOWERS[name]
        return of in names if kind == "StartTag" else last and kind in (None, "EndTag")
    return False


# -- markup --------------------------------------------------------------------------------------


class Markup:
    """The markup of tokens under serializer options (see `operators.serialize.Options`)."""

    def __init__(self, o, quoted: str, encoding: str | None = None, names: dict[int, str] | None = None):
        self.o, self.encoding, self.names = o, encoding, names or {}
        self.quoted = re.compile(quoted)
        self.booleans = frozenset(f"{element}/{name}" for element, listed in T.BOOLEAN_ATTRIBUTES.items() for name in listed.split())

    def loose(self, text: str) -> str:
        """With references for characters that the encoding lacks."""
        if self.encoding is None or text.isascii():
            return text
        out = []
        for c in text:
            try:
                c.encode(self.encoding)
                out.append(c)
            except UnicodeEncodeError:
                name = self.names.get(ord(c))
                out.append(f"&{name}" if name else f"&#x{ord(c):x};")
        return "".join(out)

    def attribute(self, element: str, name: str, raw: str) -> str:
        o = self.o
        if o.minimize_boolean_attributes and (f"{element}/{name}" in self.booleans or f"/{name}" in self.booleans):
            return " " + name
        value = raw.replace("&", "&amp;")
        if o.escape_lt_in_attrs:
            value = value.replace("<", "&lt;")
        if o.quote_attr_values == "always" or not raw or self.quoted.search(raw):
            sign = o.quote_char or '"'
            if o.best_quote and ("'" in value) != ('"' in value):
                sign = '"' if "'" in value else "'"
            value = sign + value.replace(sign, "&#39;" if sign == "'" else "&quot;") + sign
        return f" {name}={self.loose(value)}"

    def write(self, tokens: list[list]) -> tuple[str, list[str]]:
        """The markup, and what is wrong with it."""
        o, out, problems, in_raw = self.o, [], [], False
        for kind, _, name, data, public, system, attrs in tokens:
            if kind in ("Characters", "SpaceCharacters"):
                if in_raw and "</" in data:
                    problems.append("Unexpected </ in CDATA")
                out.append(self.loose(data if in_raw or kind == "SpaceCharacters" else _safe(data)))
            elif kind in _TAGS or kind == "EndTag":
                raw = name in T.RAW_TEXT
                if in_raw and not raw:
                    problems.append("Unexpected child element of a CDATA element")
                if kind == "EndTag":
                    out.append(f"</{name}>")
                    in_raw = in_raw and not raw
                    continue
                solidus = ("", "/", " /")[1 + o.space_before_trailing_solidus if o.use_trailing_solidus and name in T.VOID else 0]
                out.append(f"<{name}{''.join(self.attribute(name, n, v) for _, _, n, v in attrs)}{solidus}>")
                in_raw = in_raw or raw and not o.escape_rcdata
            elif kind == "Comment":
                if "--" in data:
                    problems.append("Comment contains --")
                out.append(f"<!--{data}-->")
            elif kind == "Doctype":
                if system and '"' in system and "'" in system:
                    problems.append("System identifier contains both single and double quote characters")
                sign = "'" if system and '"' in system else '"'
                ids = f' PUBLIC "{public}"' if public else " SYSTEM" if system else ""
                out.append(f"<!DOCTYPE {name or ''}{ids}{f' {sign}{system}{sign}' if system else ''}>")
            elif kind == "SerializeError":
                problems.append(data)
        return "".join(out), problems
