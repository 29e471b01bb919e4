"""Tree construction of the parsing kernel.

Nodes are integers into parallel lists; children are lists of integers; no recursion and no state
outside the instance.  An insertion mode is a method that takes a token and returns True if the
token must be processed again in the mode that is then current.
"""

from __future__ import annotations

from tagloom.functions import tables as T
from tagloom.functions.lexer import CHARS, COMMENT, DOCTYPE, END, SPACE, START, Lexer, Token, lower

HTML, SVG, MATHML = T.HTML, T.SVG, T.MATHML
MARKER = -1
_TABLE_PARTS = frozenset(("table", "tbody", "tfoot", "thead", "tr"))
_IMPLIED = frozenset(("dd", "dt", "li", "option", "optgroup", "p", "rp", "rt"))
_HEAD_VOID = frozenset(("base", "basefont", "bgsound", "command", "link"))
_MAY_STAY_OPEN = frozenset(("dd", "dt", "li", "p", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "html"))
_TABLE_TAGS = frozenset(("caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr"))
_IN_BODY_FROM_HEAD = frozenset(("base", "basefont", "bgsound", "command", "link", "meta", "script", "style", "title"))
_SCOPE_EXTRA = {"": frozenset(), "button": frozenset([(HTML, "button")]), "list": frozenset([(HTML, "ol"), (HTML, "ul")])}
_TABLE_SCOPE = frozenset([(HTML, "html"), (HTML, "table")])
_SELECT_SCOPE = frozenset([(HTML, "optgroup"), (HTML, "option")])
_RESET = {
    "select": "in_select", "td": "in_cell", "th": "in_cell", "tr": "in_row", "tbody": "in_table_body", "thead": "in_table_body", "tfoot": "in_table_body", "caption": "in_caption",
    "colgroup": "in_column_group", "table": "in_table", "head": "in_body", "body": "in_body", "frameset": "in_frameset", "html": "before_head",
}


class Reparse(Exception):
    """A late `<meta>` names another encoding."""

    def __init__(self, encoding: str):
        self.encoding = encoding


class OpenElements(list):
    """The stack of open elements; it knows how many of a tag it holds, and which nodes.

    A node is on it once at most.  Deep trees ask for elements that aren't open at every tag.
    """

    def __init__(self, builder: TreeBuilder):
        super().__init__()
        self.tag, self.tags, self.nodes = builder.tag, {}, set()

    def _came(self, node: int):
        tag = self.tag(node)
        self.tags[tag] = self.tags.get(tag, 0) + 1
        self.nodes.add(node)

    def _went(self, node: int):
        self.tags[self.tag(node)] -= 1
        self.nodes.discard(node)

    def __contains__(self, node) -> bool:
        return node in self.nodes

    def append(self, node: int):
        self._came(node)
        super().append(node)

    def insert(self, at: int, node: int):
        self._came(node)
        super().insert(at, node)

    def pop(self, at: int = -1) -> int:
        node = super().pop(at)
        self._went(node)
        return node

    def remove(self, node: int):
        super().remove(node)
        self._went(node)

    def __setitem__(self, at: int, node: int):
        self._went(self[at])
        self._came(node)
        super().__setitem__(at, node)

    def __delitem__(self, at):
        gone = self[at]
        for node in gone if isinstance(at, slice) else (gone,):
            self._went(node)
        super().__delitem__(at)


class TreeBuilder:
    def __init__(self, text: str, fragment: str | None = None, scripting: bool = False, meta=None, debug: bool = False):
        """fragment: name of the context element; meta(label): called for encodings in `<meta>`."""
        self.errors: list[tuple[int, str, dict]] = []
        self.lexer = Lexer(text, self._lex_error, self._foreign_node)
        self.kind, self.ns, self.name, self.attrs = ["document"], [None], [None], [None]
        self.value, self.parent, self.children = [None], [None], [[]]
        self.public, self.system = {}, {}
        self.open = OpenElements(self)
        self.formatting: list[int] = []
        self.head = self.form = None
        self.mode, self.original = "initial", "initial"
        self.frameset_ok, self.quirks = True, "no quirks"
        self.fostering, self.drop_newline = False, False
        self.pending: list[str] = []
        self.first_start = False
        self.scripting, self.meta = scripting, meta
        self.log = [] if debug else None
        self.fragment = lower(fragment) if fragment else None
        if self.fragment:
            self._start_fragment()

    def _start_fragment(self):
        name = self.fragment
        if name in T.ESCAPABLE_TEXT:
            self.lexer.mode = "rcdata"
        elif name in T.RAW_TEXT:
            self.lexer.mode = "rawtext"
        elif name == "plaintext":
            self.lexer.mode = "plaintext"
        self.lexer.last_start = name
        self._insert_root({})
        self._reset_mode()

    # -- small helpers --------------------------------------------------------------------------

    def _lex_error(self, code, at, **values):
        self.errors.append((at, code, values))

    def error(self, code="XXX-undefined-error", **values):
        self.errors.append((self.lexer.i, code, values))

    def _foreign_node(self) -> bool:
        return bool(self.open) and self.ns[self.open[-1]] != HTML

    def new(self, kind, ns=None, name=None, attrs=None, value=None) -> int:
        for column, x in ((self.kind, kind), (self.ns, ns), (self.name, name), (self.attrs, attrs), (self.value, value), (self.parent, None), (self.children, [])):
            column.append(x)
        return len(self.kind) - 1

    def append(self, parent: int, node: int, before: int | None = None):
        own = self.children[parent]
        if before is None:
            own.append(node)
        else:
            own.insert(own.index(before), node)
        self.parent[node] = parent

    def detach(self, node: int):
        if (p := self.parent[node]) is not None:
            self.children[p].remove(node)
            self.parent[node] = None

    @property
    def top(self) -> str:
        return self.name[self.open[-1]]

    def tag(self, node: int) -> tuple:
        return self.ns[node], self.name[node]

    def element(self, name: str, attrs: dict, ns: str = HTML) -> int:
        return self.new("element", ns, name, {(None, None, k) if isinstance(k, str) else k: v for k, v in attrs.items()})

    def insert(self, name: str, attrs: dict | None = None, ns: str = HTML) -> int:
        node = self.element(name, attrs or {}, ns)
        if self.fostering and self.name[self.open[-1]] in _TABLE_PARTS:
            parent, before = self._foster()
            self.append(parent, node, before)
        else:
            self.append(self.open[-1], node)
        self.open.append(node)
        return node

    def insert_void(self, token: Token):
        self.insert(token.name, token.attrs)
        self.open.pop()
        token.acknowledged = True

    def text(self, data: str, parent: int | None = None):
        before = None
        if parent is None:
            parent = self.open[-1]
            if self.fostering and self.name[parent] in _TABLE_PARTS:
                parent, before = self._foster()
        own = self.children[parent]
        at = len(own) if before is None else own.index(before)
        if at and self.kind[own[at - 1]] == "text":
            self.value[own[at - 1]].append(data)
        else:
            self.append(parent, self.new("text", value=[data]), before)

    def comment(self, token: Token, parent: int | None = None):
        self.append(self.open[-1] if parent is None else parent, self.new("comment", value=token.data))

    def _foster(self) -> tuple[int, int | None]:
        for i in range(len(self.open) - 1, -1, -1):
            if self.name[self.open[i]] == "table":
                table = self.open[i]
                if self.parent[table] is not None:
                    return self.parent[table], table
                return self.open[i - 1], None
        return self.open[0], None

    def in_scope(self, target, kind: str = "") -> bool:
        """target: the name of an HTML element, or a node."""
        name = (HTML, target) if isinstance(target, str) else None
        if target not in self.open if name is None else not self.open.tags.get(name):
            return False
        for node in reversed(self.open):
            own = self.tag(node)
            if node == target if name is None else own == name:
                return True
            if kind == "table":
                if own in _TABLE_SCOPE:
                    return False
            elif kind == "select":
                if own not in _SELECT_SCOPE:
                    return False
            elif own in T.SCOPING or own in _SCOPE_EXTRA[kind]:
                return False
        return False

    def implied_ends(self, but: str | None = None):
        while self.top in _IMPLIED and self.top != but:
            self.open.pop()

    def pop_to(self, *names: str):
        while self.name[self.open.pop()] not in names:
            pass

    def close_p(self):
        if self.in_scope("p", "button"):
            self._end_p()

    def _end_p(self):
        if not self.in_scope("p", "button"):
            self.insert("p")
            self.error("unexpected-end-tag", name="p")
        self.implied_ends("p")
        if self.top != "p":
            self.error("unexpected-end-tag", name="p")
        self.pop_to("p")

    def reconstruct(self):
        f = self.formatting
        i = len(f)
        while i and f[i - 1] != MARKER and f[i - 1] not in self.open:
            i -= 1
        for j in range(i, len(f)):
            f[j] = self.insert(self.name[f[j]], dict(self.attrs[f[j]]), self.ns[f[j]])

    def clear_formatting(self):
        while self.formatting and self.formatting.pop() != MARKER:
            pass

    def formatting_named(self, name: str) -> int | None:
        for node in reversed(self.formatting):
            if node == MARKER:
                return None
            if self.name[node] == name:
                return node
        return None

    def add_formatting(self, token: Token):
        node = self.insert(token.name, token.attrs)
        same = []
        for other in reversed(self.formatting):
            if other == MARKER:
                break
            if self.tag(other) == self.tag(node) and self.attrs[other] == self.attrs[node]:
                same.append(other)
        if len(same) == 3:
            self.formatting.remove(same[-1])
        self.formatting.append(node)

    def raw_text(self, token: Token, mode: str):
        self.insert(token.name, token.attrs)
        self.lexer.mode = mode
        self.original, self.mode = self.mode, "text_mode"

    def _insert_root(self, attrs: dict):
        root = self.element("html", attrs)
        self.append(0, root)
        self.open.append(root)
        if self.mode != "before_head":
            self.mode = "before_head"

    def _merge_html(self, token: Token):
        if not self.first_start and token.name == "html":
            self.error("non-html-root")
        own = self.attrs[self.open[0]]
        for k, v in token.attrs.items():
            own.setdefault((None, None, k), v)
        self.first_start = False

    def _reset_mode(self):
        for i in range(len(self.open) - 1, -1, -1):
            node, last = self.open[i], i == 0
            name = self.fragment if last and self.fragment else self.name[node]
            if not last and self.ns[node] != HTML:
                continue
            if name in _RESET:
                self.mode = _RESET[name]
                return
            if last:
                self.mode = "in_body"

    def _html_point(self, node: int) -> bool:
        if self.tag(node) == (MATHML, "annotation-xml"):
            return lower(self.attrs[node].get((None, None, "encoding"), "")) in ("text/html", "application/xhtml+xml")
        return self.tag(node) in T.SVG_HTML_POINTS

    # -- main loop ------------------------------------------------------------------------------

    def run(self) -> TreeBuilder:
        for token in self.lexer:
            self.process(token)
            if token.kind == START and token.self_closing and not token.acknowledged:
                self.error("non-void-element-with-trailing-solidus", name=token.name)
        while self.eof():
            pass
        return self

    def process(self, token: Token):
        while True:
            mode = self.mode
            if self.open and self.ns[self.open[-1]] != HTML and self._stays_foreign(token):
                mode = "in_foreign"
            if self.log is not None:
                self.log.append((self.lexer.mode, self.mode, mode, token.kind, token.name))
            if token.kind == COMMENT:
                again = self._comment(token)
            elif token.kind == DOCTYPE and mode != "initial":
                again = self._doctype_late()
            else:
                again = getattr(self, mode)(token)
            if not again:
                return

    def _stays_foreign(self, token: Token) -> bool:
        node, k = self.open[-1], token.kind
        text = k in (CHARS, SPACE)
        if self.tag(node) in T.MATHML_TEXT_POINTS and (text or k == START and token.name not in ("mglyph", "malignmark")):
            return False
        if self.tag(node) == (MATHML, "annotation-xml") and k == START and token.name == "svg":
            return False
        return not (self._html_point(node) and (text or k == START))

    def _flush(self):
        data, self.pending = "".join(self.pending), []
        if data.strip(T.SPACES):
            self.fostering = True
            self._body_text(data)
            self.fostering = False
        elif data:
            self.text(data)
        self.mode = self.original

    def _comment(self, token: Token) -> bool:
        if self.mode == "in_table_text":
            self._flush()
            return True
        if self.mode in ("initial", "before_html", "after_after_body", "after_after_frameset"):
            self.comment(token, 0)
        elif self.mode == "after_body":
            self.comment(token, self.open[0])
        else:
            self.comment(token)
        return False

    def _doctype_late(self) -> bool:
        if self.mode == "in_table_text":
            self._flush()
            return True
        self.error("unexpected-doctype")
        return False

    def eof(self) -> bool:
        """What the end does in the current mode; True if another mode must see it."""
        mode = self.mode
        if mode == "initial":
            self.error("expected-doctype-but-got-eof")
            self.quirks, self.mode = "quirks", "before_html"
        elif mode == "before_html":
            self._insert_root({})
        elif mode == "before_head":
            self._imply_head()
        elif mode == "in_head":
            self._close_head()
        elif mode == "in_head_noscript":
            self.error("eof-in-head-noscript")
            self._close_noscript()
        elif mode == "after_head":
            self._imply_body()
        elif mode == "text_mode":
            self.error("expected-named-closing-tag-but-got-eof", name=self.top)
            self.open.pop()
            self.mode = self.original
        elif mode == "in_table_text":
            self._flush()
        elif mode == "in_column_group" and self.top != "html":
            self._end_colgroup()
        else:
            if mode in ("in_table", "in_table_body", "in_row") and self.top != "html":
                self.error("eof-in-table")
            elif mode in ("in_select", "in_select_in_table") and self.top != "html":
                self.error("eof-in-select")
            elif mode == "in_frameset" and self.top != "html":
                self.error("eof-in-frameset")
            elif mode in ("in_body", "in_caption", "in_cell") and any(self.name[n] not in _MAY_STAY_OPEN for n in self.open):
                self.error("expected-closing-tag-but-got-eof")
            return False
        return True

    # -- before the body ------------------------------------------------------------------------

    def initial(self, t: Token) -> bool:
        if t.kind == SPACE:
            return False
        if t.kind == DOCTYPE:
            self._doctype(t)
            return False
        code = {CHARS: "expected-doctype-but-got-chars", START: "expected-doctype-but-got-start-tag", END: "expected-doctype-but-got-end-tag"}[t.kind]
        self.error(code, **({"name": t.name} if t.name else {}))
        self.quirks, self.mode = "quirks", "before_html"
        return True

    def _doctype(self, t: Token):
        if t.name != "html" or t.public is not None or t.system is not None and t.system != "about:legacy-compat":
            self.error("unknown-doctype")
        node = self.new("doctype", name=t.name)
        self.public[node], self.system[node] = t.public, t.system
        self.append(0, node)
        public, system = lower(t.public or ""), t.system
        loose = public.startswith(T.HTML401_PREFIXES)
        if not t.correct or t.name != "html" or public.startswith(T.QUIRKS_PREFIXES) or public in T.QUIRKS_IDS or loose and system is None or system and system.lower() == T.QUIRKS_SYSTEM:
            self.quirks = "quirks"
        elif public.startswith(T.LIMITED_PREFIXES) or loose:
            self.quirks = "limited quirks"
        self.mode = "before_html"

    def before_html(self, t: Token) -> bool:
        if t.kind == SPACE:
            return False
        if t.kind == END and t.name not in ("head", "body", "html", "br"):
            self.error("unexpected-end-tag-before-html", name=t.name)
            return False
        if t.kind == START and t.name == "html":
            self.first_start = True
        self._insert_root({})
        return True

    def _imply_head(self, attrs: dict | None = None):
        self.head = self.insert("head", attrs)
        self.mode = "in_head"

    def before_head(self, t: Token) -> bool:
        if t.kind == SPACE:
            return False
        if t.kind == START and t.name == "html":
            self._merge_html(t)
            return False
        if t.kind == START and t.name == "head":
            self._imply_head(t.attrs)
            return False
        if t.kind == END and t.name not in ("head", "body", "html", "br"):
            self.error("end-tag-after-implied-root", name=t.name)
            return False
        self._imply_head()
        return True

    def _close_head(self):
        self.open.pop()
        self.mode = "after_head"

    def in_head(self, t: Token) -> bool:
        name = t.name
        if t.kind == SPACE:
            self.text(t.data)
            return False
        if t.kind == START:
            if name == "html":
                self._merge_html(t)
                return False
            if name == "head":
                self.error("two-heads-are-not-better-than-one")
                return False
            if self._head_start(t):
                return False
        elif t.kind == END:
            if name == "head":
                self._close_head()
                return False
            if name not in ("body", "html", "br"):
                self.error("unexpected-end-tag", name=name)
                return False
        self._close_head()
        return True

    def _head_start(self, t: Token) -> bool:
        """Handles start tags that belong to the head; False for others."""
        name = t.name
        if name in _HEAD_VOID:
            self.insert_void(t)
        elif name == "meta":
            self.insert_void(t)
            if self.meta:
                if "charset" in t.attrs:
                    self.meta(t.attrs["charset"], None)
                elif "content" in t.attrs and lower(t.attrs.get("http-equiv", "")) == "content-type":
                    self.meta(None, t.attrs["content"])
        elif name == "title":
            self.raw_text(t, "rcdata")
        elif name in ("noframes", "style"):
            self.raw_text(t, "rawtext")
        elif name == "noscript":
            if self.scripting:
                self.raw_text(t, "rawtext")
            else:
                self.insert(name, t.attrs)
                self.mode = "in_head_noscript"
        elif name == "script":
            self.insert(name, t.attrs)
            self.lexer.mode = "script"
            self.original, self.mode = self.mode, "text_mode"
        else:
            return False
        return True

    def _close_noscript(self):
        self.open.pop()
        self.mode = "in_head"

    def in_head_noscript(self, t: Token) -> bool:
        name = t.name
        if t.kind == SPACE:
            self.text(t.data)
            return False
        if t.kind == START:
            if name == "html":
                self._merge_html(t)
                return False
            if name in ("basefont", "bgsound", "link", "meta", "noframes", "style"):
                self._head_start(t)
                return False
            if name in ("head", "noscript"):
                self.error("unexpected-start-tag", name=name)
                return False
        elif t.kind == END:
            if name == "noscript":
                self._close_noscript()
                return False
            if name != "br":
                self.error("unexpected-end-tag", name=name)
                return False
        self.error("char-in-head-noscript" if t.kind == CHARS else "unexpected-inhead-noscript-tag", **({"name": name} if name else {}))
        self._close_noscript()
        return True

    def _imply_body(self, attrs: dict | None = None):
        self.insert("body", attrs)
        self.mode = "in_body"

    def after_head(self, t: Token) -> bool:
        name = t.name
        if t.kind == SPACE:
            self.text(t.data)
            return False
        if t.kind == START:
            if name == "html":
                self._merge_html(t)
                return False
            if name == "body":
                self.frameset_ok = False
                self._imply_body(t.attrs)
                return False
            if name == "frameset":
                self.insert(name, t.attrs)
                self.mode = "in_frameset"
                return False
            if name in ("base", "basefont", "bgsound", "link", "meta", "noframes", "script", "style", "title"):
                self.error("unexpected-start-tag-out-of-my-head", name=name)
                self.open.append(self.head)
                self._head_start(t)
                for i in range(len(self.open) - 1, -1, -1):
                    if self.name[self.open[i]] == "head":
                        del self.open[i]
                        break
                return False
            if name == "head":
                self.error("unexpected-start-tag", name=name)
                return False
        elif t.kind == END and name not in ("body", "html", "br"):
            self.error("unexpected-end-tag", name=name)
            return False
        self._imply_body()
        self.frameset_ok = True
        return True

    # -- body -----------------------------------------------------------------------------------

    def _body_text(self, data: str):
        if data == "\0":
            return
        self.reconstruct()
        self.text(data)
        if self.frameset_ok and data.strip(T.SPACES):
            self.frameset_ok = False

    def _body_space(self, data: str):
        if self.drop_newline:
            self.drop_newline = False
            if data.startswith("\n") and self.top in ("pre", "listing", "textarea") and not self.children[self.open[-1]]:
                data = data[1:]
        if data:
            self.reconstruct()
            self.text(data)

    def in_body(self, t: Token) -> bool:
        if t.kind == CHARS:
            self._body_text(t.data)
            return False
        if t.kind == SPACE:
            self._body_space(t.data)
            return False
        return bool((self._body_start if t.kind == START else self._body_end)(t))

    def _end_here(self, name: str):
        """An end tag that a start tag implies, seen by the current mode."""
        getattr(self, self.mode)(Token(END, name))

    def _body_start(self, t: Token):
        name, attrs = t.name, t.attrs
        if name in T.CLOSES_P:
            self.close_p()
            self.insert(name, attrs)
        elif name in T.FORMATTING:
            if name == "a" and (old := self.formatting_named("a")) is not None:
                self.error("unexpected-start-tag-implies-end-tag", startName="a", endName="a")
                self._adopt(Token(END, "a"))
                if old in self.open:
                    self.open.remove(old)
                if old in self.formatting:
                    self.formatting.remove(old)
            self.reconstruct()
            if name == "nobr" and self.in_scope("nobr"):
                self.error("unexpected-start-tag-implies-end-tag", startName="nobr", endName="nobr")
                self._body_end(Token(END, "nobr"))
                self.reconstruct()
            self.add_formatting(t)
        elif name in ("li", "dd", "dt"):
            self.frameset_ok = False
            stops = ("li",) if name == "li" else ("dt", "dd")
            for node in reversed(self.open):
                if self.name[node] in stops:
                    self._end_here(self.name[node])
                    break
                if self.tag(node) in T.SPECIAL and self.name[node] not in ("address", "div", "p"):
                    break
            if self.in_scope("p", "button"):
                self._end_here("p")
            self.insert(name, attrs)
        elif name in T.HEADINGS:
            self.close_p()
            if self.top in T.HEADINGS:
                self.error("unexpected-start-tag", name=name)
                self.open.pop()
            self.insert(name, attrs)
        elif name in ("area", "br", "embed", "img", "keygen", "wbr", "input"):
            ok = self.frameset_ok and name == "input" and lower(attrs.get("type", "")) == "hidden"
            self.reconstruct()
            self.insert_void(t)
            self.frameset_ok = ok
        elif name in _IN_BODY_FROM_HEAD:
            self._head_start(t)
        elif name == "table":
            if self.quirks != "quirks":
                self.close_p()
            self.insert(name, attrs)
            self.frameset_ok = False
            self.mode = "in_table"
        elif name in ("pre", "listing"):
            self.close_p()
            self.insert(name, attrs)
            self.frameset_ok = False
            self.drop_newline = True
        elif name == "form":
            if self.form is not None:
                self.error("unexpected-start-tag", name=name)
            else:
                self.close_p()
                self.form = self.insert(name, attrs)
        elif name == "button":
            if self.in_scope("button"):
                self.error("unexpected-start-tag-implies-end-tag", startName=name, endName=name)
                self._body_end(Token(END, "button"))
                return True
            self.reconstruct()
            self.insert(name, attrs)
            self.frameset_ok = False
        elif name in ("applet", "marquee", "object"):
            self.reconstruct()
            self.insert(name, attrs)
            self.formatting.append(MARKER)
            self.frameset_ok = False
        elif name in ("param", "source", "track"):
            self.insert_void(t)
        elif name == "hr":
            self.close_p()
            self.insert_void(t)
            self.frameset_ok = False
        elif name == "select":
            self.reconstruct()
            self.insert(name, attrs)
            self.frameset_ok = False
            in_table = self.mode in ("in_table", "in_caption", "in_column_group", "in_table_body", "in_row", "in_cell")
            self.mode = "in_select_in_table" if in_table else "in_select"
        elif name in ("option", "optgroup"):
            if self.top == "option":
                self._end_here("option")
            self.reconstruct()
            self.insert(name, attrs)
        elif name == "textarea":
            self.insert(name, attrs)
            self.lexer.mode = "rcdata"
            self.drop_newline = True
            self.frameset_ok = False
        elif name in ("iframe", "noembed", "noframes", "xmp") or name == "noscript" and self.scripting:
            if name == "xmp":
                self.close_p()
                self.reconstruct()
            if name in ("xmp", "iframe"):
                self.frameset_ok = False
            self.raw_text(t, "rawtext")
        elif name in ("svg", "math"):
            self.reconstruct()
            self._insert_foreign(t, SVG if name == "svg" else MATHML)
        elif name in ("rp", "rt"):
            if self.in_scope("ruby"):
                self.implied_ends()
                if self.top != "ruby":
                    self.error()
            self.insert(name, attrs)
        elif name == "plaintext":
            self.close_p()
            self.insert(name, attrs)
            self.lexer.mode = "plaintext"
        elif name == "html":
            self._merge_html(t)
        elif name == "body":
            self.error("unexpected-start-tag", name=name)
            if len(self.open) > 1 and self.name[self.open[1]] == "body":
                self.frameset_ok = False
                for k, v in attrs.items():
                    self.attrs[self.open[1]].setdefault((None, None, k), v)
        elif name == "frameset":
            self.error("unexpected-start-tag", name=name)
            if len(self.open) > 1 and self.name[self.open[1]] == "body" and self.frameset_ok:
                self.detach(self.open[1])
                while self.top != "html":
                    self.open.pop()
                self.insert(name, attrs)
                self.mode = "in_frameset"
        elif name == "image":
            self.error("unexpected-start-tag-treated-as", originalName="image", newName="img")
            t.name = "img"
            return self._body_start(t)
        elif name == "isindex":
            self._isindex(t)
        elif name in _TABLE_TAGS or name in ("frame", "head"):
            self.error("unexpected-start-tag-ignored", name=name)
        else:
            self.reconstruct()
            self.insert(name, attrs)
        return False

    def _isindex(self, t: Token):
        self.error("deprecated-tag", name="isindex")
        if self.form is not None:
            return

        def start(name, attrs=None):
            token = Token(START, name)
            token.attrs = attrs or {}
            self._body_start(token)

        rest = {k: v for k, v in t.attrs.items() if k not in ("action", "prompt")}
        start("form", {k: v for k, v in t.attrs.items() if k == "action"})
        start("hr")
        start("label")
        self._body_text(t.attrs.get("prompt", "This is a searchable index. Enter search keywords: "))
        start("input", rest | {"name": "isindex"})
        self._body_end(Token(END, "label"))
        start("hr")
        self._body_end(Token(END, "form"))

    def _insert_foreign(self, t: Token, ns: str):
        renamed = T.SVG_ATTRIBUTES if ns == SVG else T.MATHML_ATTRIBUTES
        attrs = {}
        for k, v in t.attrs.items():
            attrs[T.FOREIGN_ATTRIBUTES.get(k) or (None, None, renamed.get(k, k))] = v
        self.insert(t.name, attrs, ns)
        if t.self_closing:
            self.open.pop()
            t.acknowledged = True

    def _body_end(self, t: Token):
        name = t.name
        if name == "p":
            self._end_p()
        elif name in T.FORMATTING:
            self._adopt(t)
        elif name in T.BLOCK_ENDS:
            if name == "pre":
                self.drop_newline = False
            found = self.in_scope(name)
            if found:
                self.implied_ends()
            if self.top != name:
                self.error("end-tag-too-early", name=name)
            if found:
                self.pop_to(name)
        elif name in ("dd", "dt", "li"):
            if not self.in_scope(name, "list" if name == "li" else ""):
                self.error("unexpected-end-tag", name=name)
            else:
                self.implied_ends(name)
                if self.top != name:
                    self.error("end-tag-too-early", name=name)
                self.pop_to(name)
        elif name in T.HEADINGS:
            found = any(self.in_scope(h) for h in T.HEADINGS)
            if found:
                self.implied_ends()
            if self.top != name:
                self.error("end-tag-too-early", name=name)
            if found:
                self.pop_to(*T.HEADINGS)
        elif name == "body" or name == "html":
            if not self.in_scope("body"):
                if name == "body":
                    self.error()
                return False
            if self.top != "body":
                for node in self.open[2:]:
                    if self.name[node] not in _MAY_STAY_OPEN | {"optgroup", "option", "rp", "rt"}:
                        self.error("expected-one-end-tag-but-got-another", gotName="body", expectedName=self.name[node])
                        break
            self.mode = "after_body"
            return name == "html"
        elif name == "form":
            node, self.form = self.form, None
            if node is None or not self.in_scope(node):
                self.error("unexpected-end-tag", name=name)
            else:
                self.implied_ends()
                if self.open[-1] != node:
                    self.error("end-tag-too-early-ignored", name=name)
                self.open.remove(node)
        elif name in ("applet", "marquee", "object"):
            if self.in_scope(name):
                self.implied_ends()
            if self.top != name:
                self.error("end-tag-too-early", name=name)
            if self.in_scope(name):
                self.pop_to(name)
                self.clear_formatting()
        elif name == "br":
            self.error("unexpected-end-tag-treated-as", originalName="br", newName="br element")
            self.reconstruct()
            self.insert("br")
            self.open.pop()
        else:
            self._any_end(t)
        return False

    def _any_end(self, t: Token):
        for node in reversed(self.open):
            if self.name[node] == t.name:
                self.implied_ends(t.name)
                if self.top != t.name:
                    self.error("unexpected-end-tag", name=t.name)
                while self.open.pop() != node:
                    pass
                return
            if self.tag(node) in T.SPECIAL:
                self.error("unexpected-end-tag", name=t.name)
                return

    def _adopt(self, t: Token):
        """The adoption agency: puts misnested formatting elements in order."""
        for _ in range(8):
            if not self._adopt_once(t):
                return

    def _adopt_once(self, t: Token) -> bool:
        """One round of it; whether another may follow."""
        owner = self.formatting_named(t.name)
        is_open = owner is not None and owner in self.open
        if owner is None or is_open and not self.in_scope(self.name[owner]):
            self._any_end(t)
            return False
        if not is_open:
            self.error("adoption-agency-1.2", name=t.name)
            self.formatting.remove(owner)
            return False
        if owner != self.open[-1]:
            self.error("adoption-agency-1.3", name=t.name)
        depth = self.open.index(owner)
        furthest = next((i for i in range(depth, len(self.open)) if self.tag(self.open[i]) in T.SPECIAL), None)
        if furthest is None:
            del self.open[depth:]
            self.formatting.remove(owner)
            return False
        block, above = self.open[furthest], self.open[depth - 1]
        subtree, bookmark = self._copy_chain(owner, furthest)
        self._move_under(above, subtree)
        heir = self._copy(owner)
        self._give_children(block, heir)
        self.append(block, heir)
        if bookmark is None:
            bookmark = self.formatting.index(owner)
        self.formatting.remove(owner)
        self.formatting.insert(bookmark, heir)
        self.open.remove(owner)
        self.open.insert(self.open.index(block) + 1, heir)
        return True

    def _copy_chain(self, owner: int, furthest: int) -> tuple[int, int | None]:
        """Copies the formatting elements right above the block, three steps at most, each around what is below it.

        Elements that don't format leave the stack.  Returns the root of what was built and the place
        in the list of formatting elements after the innermost copy, if there is one.
        """
        below, bookmark = self.open[furthest], None
        for at in range(furthest - 1, furthest - 4, -1):
            node = self.open[at]
            if node == owner:
                break
            if node not in self.formatting:
                del self.open[at]
                continue
            place = self.formatting.index(node)
            if bookmark is None:
                bookmark = place + 1
            self.formatting[place] = self.open[at] = outer = self._copy(node)
            self.detach(below)
            self.append(outer, below)
            below = outer
        return below, bookmark

    def _move_under(self, parent: int, node: int):
        self.detach(node)
        before = None
        if self.name[parent] in _TABLE_PARTS:
            parent, before = self._foster()
        self.append(parent, node, before)

    def _copy(self, node: int) -> int:
        return self.new("element", self.ns[node], self.name[node], dict(self.attrs[node]))

    def _give_children(self, giver: int, taker: int):
        for child in self.children[giver]:
            self.parent[child] = taker
        self.children[taker], self.children[giver] = self.children[giver], []

    def text_mode(self, t: Token) -> bool:
        if t.kind in (CHARS, SPACE):
            self.text(t.data)
        elif t.kind == END:
            self.open.pop()
            self.mode = self.original
        return False

    # -- tables ---------------------------------------------------------------------------------

    def _clear_to(self, *names: str):
        while self.top not in names and self.top != "html":
            self.open.pop()

    def in_table(self, t: Token) -> bool:
        name = t.name
        if t.kind in (CHARS, SPACE):
            self.original, self.mode = self.mode, "in_table_text"
            return self.in_table_text(t)
        if t.kind == START:
            if name == "html":
                self._merge_html(t)
            elif name == "caption":
                self._clear_to("table")
                self.formatting.append(MARKER)
                self.insert(name, t.attrs)
                self.mode = "in_caption"
            elif name in ("colgroup", "col"):
                self._clear_to("table")
                self.insert("colgroup", t.attrs if name == "colgroup" else None)
                self.mode = "in_column_group"
                return name == "col"
            elif name in ("tbody", "tfoot", "thead", "td", "th", "tr"):
                group = name[0] == "t" and name in ("tbody", "tfoot", "thead")
                self._clear_to("table")
                self.insert(name if group else "tbody", t.attrs if group else None)
                self.mode = "in_table_body"
                return not group
            elif name == "table":
                self.error("unexpected-start-tag-implies-end-tag", startName="table", endName="table")
                self._end_here("table")
                return not self.fragment
            elif name in ("style", "script"):
                self._head_start(t)
            elif name == "input" and lower(t.attrs.get("type", "")) == "hidden":
                self.error("unexpected-hidden-input-in-table")
                self.insert(name, t.attrs)
                self.open.pop()
            elif name == "form":
                self.error("unexpected-form-in-table")
                if self.form is None:
                    self.form = self.insert(name, t.attrs)
                    self.open.pop()
            else:
                self.error("unexpected-start-tag-implies-table-voodoo", name=name)
                return self._fostered(t)
            return False
        if name == "table":
            self._end_table()
        elif name in _TABLE_TAGS or name in ("body", "html"):
            self.error("unexpected-end-tag", name=name)
        else:
            self.error("unexpected-end-tag-implies-table-voodoo", name=name)
            return self._fostered(t)
        return False

    def _fostered(self, t: Token) -> bool:
        self.fostering = True
        (self._body_start if t.kind == START else self._body_end)(t)
        self.fostering = False
        return False

    def _end_table(self):
        if not self.in_scope("table", "table"):
            self.error()
            return
        self.implied_ends()
        if self.top != "table":
            self.error("end-tag-too-early-named", gotName="table", expectedName=self.top)
        self.pop_to("table")
        self._reset_mode()

    def in_table_text(self, t: Token) -> bool:
        if t.kind in (CHARS, SPACE):
            if t.data != "\0":
                self.pending.append(t.data)
            return False
        self._flush()
        return True

    def in_caption(self, t: Token) -> bool:
        name = t.name
        if t.kind == START and name in _TABLE_TAGS or t.kind == END and name == "table":
            self.error()
            known = self.in_scope("caption", "table")
            self._end_here("caption")
            return known
        if t.kind == END and name == "caption":
            if not self.in_scope("caption", "table"):
                self.error()
                return False
            self.implied_ends()
            if self.top != "caption":
                self.error("expected-one-end-tag-but-got-another", gotName="caption", expectedName=self.top)
            self.pop_to("caption")
            self.clear_formatting()
            self.mode = "in_table"
            return False
        if t.kind == END and (name in _TABLE_TAGS or name in ("body", "html")):
            self.error("unexpected-end-tag", name=name)
            return False
        return self.in_body(t)

    def _end_colgroup(self):
        if self.top == "html":
            self.error()
        else:
            self.open.pop()
            self.mode = "in_table"

    def in_column_group(self, t: Token) -> bool:
        if t.kind == SPACE:
            self.text(t.data)
            return False
        if t.kind == START and t.name == "html":
            self._merge_html(t)
            return False
        if t.kind == START and t.name == "col":
            self.insert_void(t)
            return False
        if t.kind == END and t.name == "col":
            self.error("no-end-tag", name="col")
            return False
        ignored = self.top == "html"
        self._end_colgroup()
        return not ignored and not (t.kind == END and t.name == "colgroup")

    def in_table_body(self, t: Token) -> bool:
        name = t.name
        if t.kind == START:
            if name == "tr":
                self._clear_to("tbody", "tfoot", "thead")
                self.insert(name, t.attrs)
                self.mode = "in_row"
                return False
            if name in ("td", "th"):
                self.error("unexpected-cell-in-table-body", name=name)
                self._clear_to("tbody", "tfoot", "thead")
                self.insert("tr")
                self.mode = "in_row"
                return True
        closes = t.kind == START and name in ("caption", "col", "colgroup", "tbody", "tfoot", "thead") or t.kind == END and name == "table"
        if closes:
            if any(self.in_scope(g, "table") for g in ("tbody", "thead", "tfoot")):
                self._clear_to("tbody", "tfoot", "thead")
                self._end_here(self.top)
                return True
            self.error()
            return False
        if t.kind == END and name in ("tbody", "tfoot", "thead"):
            if self.in_scope(name, "table"):
                self._clear_to("tbody", "tfoot", "thead")
                self.open.pop()
                self.mode = "in_table"
            else:
                self.error("unexpected-end-tag-in-table-body", name=name)
            return False
        if t.kind == END and name in ("body", "caption", "col", "colgroup", "html", "td", "th", "tr"):
            self.error("unexpected-end-tag-in-table-body", name=name)
            return False
        return self.in_table(t)

    def in_row(self, t: Token) -> bool:
        name = t.name
        if t.kind == START and name in ("td", "th"):
            self._clear_to("tr")
            self.insert(name, t.attrs)
            self.mode = "in_cell"
            self.formatting.append(MARKER)
            return False
        if t.kind == START and name in ("caption", "col", "colgroup", "tbody", "tfoot", "thead", "tr") or t.kind == END and name == "table":
            known = self.in_scope("tr", "table")
            self._end_tr()
            return known
        if t.kind == END:
            if name == "tr":
                self._end_tr()
                return False
            if name in ("tbody", "tfoot", "thead"):
                if self.in_scope(name, "table"):
                    self._end_tr()
                    return True
                self.error()
                return False
            if name in ("body", "caption", "col", "colgroup", "html", "td", "th"):
                self.error("unexpected-end-tag-in-table-row", name=name)
                return False
        return self.in_table(t)

    def _end_tr(self):
        if self.in_scope("tr", "table"):
            self._clear_to("tr")
            self.open.pop()
            self.mode = "in_table_body"
        else:
            self.error()

    def in_cell(self, t: Token) -> bool:
        name = t.name
        if t.kind == START and name in _TABLE_TAGS:
            if self.in_scope("td", "table") or self.in_scope("th", "table"):
                self._close_cell()
                return True
            self.error()
            return False
        if t.kind == END:
            if name in ("td", "th"):
                if not self.in_scope(name, "table"):
                    self.error("unexpected-end-tag", name=name)
                    return False
                self.implied_ends(name)
                if self.top != name:
                    self.error("unexpected-cell-end-tag", name=name)
                self.pop_to(name)
                self.clear_formatting()
                self.mode = "in_row"
                return False
            if name in ("body", "caption", "col", "colgroup", "html"):
                self.error("unexpected-end-tag", name=name)
                return False
            if name in ("table", "tbody", "tfoot", "thead", "tr"):
                if self.in_scope(name, "table"):
                    self._close_cell()
                    return True
                self.error()
                return False
        return self.in_body(t)

    def _close_cell(self):
        self.in_cell(Token(END, "td" if self.in_scope("td", "table") else "th"))

    # -- select, frames, after ------------------------------------------------------------------

    def in_select(self, t: Token) -> bool:
        name = t.name
        if t.kind in (CHARS, SPACE):
            if t.data != "\0":
                self.text(t.data)
            return False
        if t.kind == START:
            if name == "html":
                self._merge_html(t)
            elif name in ("option", "optgroup"):
                if self.top == "option":
                    self.open.pop()
                if name == "optgroup" and self.top == "optgroup":
                    self.open.pop()
                self.insert(name, t.attrs)
            elif name == "select":
                self.error("unexpected-select-in-select")
                self._end_select()
            elif name in ("input", "keygen", "textarea"):
                self.error("unexpected-input-in-select")
                if self.in_scope("select", "select"):
                    self._end_select()
                    return True
            elif name == "script":
                self._head_start(t)
            else:
                self.error("unexpected-start-tag-in-select", name=name)
        elif name == "option":
            if self.top == "option":
                self.open.pop()
            else:
                self.error("unexpected-end-tag-in-select", name=name)
        elif name == "optgroup":
            if self.top == "option" and self.name[self.open[-2]] == "optgroup":
                self.open.pop()
            if self.top == "optgroup":
                self.open.pop()
            else:
                self.error("unexpected-end-tag-in-select", name=name)
        elif name == "select":
            self._end_select()
        else:
            self.error("unexpected-end-tag-in-select", name=name)
        return False

    def _end_select(self):
        if self.in_scope("select", "select"):
            self.pop_to("select")
            self._reset_mode()
        else:
            self.error()

    def in_select_in_table(self, t: Token) -> bool:
        if t.name in ("caption", "table", "tbody", "tfoot", "thead", "tr", "td", "th"):
            if t.kind == START:
                self.error("unexpected-table-element-start-tag-in-select-in-table", name=t.name)
                self._end_select()
                return True
            if t.kind == END:
                self.error("unexpected-table-element-end-tag-in-select-in-table", name=t.name)
                if self.in_scope(t.name, "table"):
                    self._end_select()
                    return True
                return False
        return self.in_select(t)

    def in_foreign(self, t: Token) -> bool:
        name = t.name
        if t.kind in (CHARS, SPACE):
            data = t.data
            if data == "\0":
                data = "�"
            elif self.frameset_ok and data.strip(T.SPACES):
                self.frameset_ok = False
            self.text(data)
            return False
        if t.kind == START:
            if name in T.BREAKOUT or name == "font" and t.attrs.keys() & {"color", "face", "size"}:
                self.error("unexpected-html-element-in-foreign-content", name=name)
                while self.ns[self.open[-1]] != HTML and not self._html_point(self.open[-1]) and self.tag(self.open[-1]) not in T.MATHML_TEXT_POINTS:
                    self.open.pop()
                return True
            ns = self.ns[self.open[-1]]
            if ns == SVG:
                t.name = T.SVG_TAGS.get(name, name)
            self._insert_foreign(t, ns)
            return False
        i = len(self.open) - 1
        if lower(self.top) != name:
            self.error("unexpected-end-tag", name=name)
        while True:
            if lower(self.name[self.open[i]]) == name:
                if self.mode == "in_table_text":
                    self._flush()
                del self.open[i:]
                return False
            i -= 1
            if self.ns[self.open[i]] == HTML:
                return getattr(self, self.mode)(t)

    def after_body(self, t: Token) -> bool:
        if t.kind == SPACE:
            return self.in_body(t)
        if t.kind == START and t.name == "html":
            self._merge_html(t)
            return False
        if t.kind == END and t.name == "html":
            if self.fragment:
                self.error("unexpected-end-tag-after-body-innerhtml")
            else:
                self.mode = "after_after_body"
            return False
        self.error("unexpected-char-after-body" if t.kind == CHARS else "unexpected-start-tag-after-body" if t.kind == START else "unexpected-end-tag-after-body", **({"name": t.name} if t.name else {}))
        self.mode = "in_body"
        return True

    def after_after_body(self, t: Token) -> bool:
        if t.kind == SPACE:
            return self.in_body(t)
        if t.kind == START and t.name == "html":
            self._merge_html(t)
            return False
        self.error("expected-eof-but-got-char" if t.kind == CHARS else "expected-eof-but-got-start-tag" if t.kind == START else "expected-eof-but-got-end-tag", **({"name": t.name} if t.name else {}))
        self.mode = "in_body"
        return True

    def in_frameset(self, t: Token) -> bool:
        name = t.name
        if t.kind == SPACE:
            self.text(t.data)
        elif t.kind == CHARS:
            self.error("unexpected-char-in-frameset")
        elif t.kind == START:
            if name == "html":
                self._merge_html(t)
            elif name == "frameset":
                self.insert(name, t.attrs)
            elif name == "frame":
                self.insert(name, t.attrs)
                self.open.pop()
            elif name == "noframes":
                self._body_start(t)
            else:
                self.error("unexpected-start-tag-in-frameset", name=name)
        elif name == "frameset":
            if self.top == "html":
                self.error("unexpected-frameset-in-frameset-innerhtml")
            else:
                self.open.pop()
            if not self.fragment and self.top != "frameset":
                self.mode = "after_frameset"
        else:
            self.error("unexpected-end-tag-in-frameset", name=name)
        return False

    def after_frameset(self, t: Token) -> bool:
        if t.kind == SPACE:
            self.text(t.data)
        elif t.kind == CHARS:
            self.error("unexpected-char-after-frameset")
        elif t.kind == START and t.name == "html":
            self._merge_html(t)
        elif t.kind == START and t.name == "noframes":
            self._head_start(t)
        elif t.kind == END and t.name == "html":
            self.mode = "after_after_frameset"
        else:
            self.error("unexpected-start-tag-after-frameset" if t.kind == START else "unexpected-end-tag-after-frameset", name=t.name)
        return False

    def after_after_frameset(self, t: Token) -> bool:
        if t.kind == SPACE:
            return self.in_body(t)
        if t.kind == START and t.name == "html":
            self._merge_html(t)
        elif t.kind == START and t.name == "noframes":
            self._head_start(t)
        else:
            self.error("expected-eof-but-got-char" if t.kind == CHARS else "expected-eof-but-got-start-tag" if t.kind == START else "expected-eof-but-got-end-tag", **({"name": t.name} if t.name else {}))
        return False

    # -- result ---------------------------------------------------------------------------------

    def rows(self) -> list[tuple]:
        """Nodes in document order: kind, parent, enter, exit, depth, child index, ns, name, value, ids, attributes."""
        root, first = 0, "document"
        if self.fragment:
            root, first = self.open[0] if self.open else self.children[0][0], "fragment"
        out: list[list] = []
        place: dict[int, int] = {}
        seq = 0
        stack = [(root, 0, 0, False)]
        while stack:
            node, depth, at, leaving = stack.pop()
            if leaving:
                out[place[node]][3] = seq
                seq += 1
                continue
            kind = first if node == root else self.kind[node]
            value = "".join(self.value[node]) if kind == "text" else self.value[node]
            attrs = [(k[0], k[1], k[2], v) for k, v in self.attrs[node].items()] if kind == "element" else []
            place[node] = len(out)
            parent = None if node == root else place[self.parent[node]]
            named = kind in ("element", "doctype")
            out.append([kind, parent, seq, None, depth, at, self.ns[node] if kind == "element" else None, self.name[node] if named else None, value, self.public.get(node), self.system.get(node), attrs])
            seq += 1
            stack.append((node, depth, at, True))
            own = self.children[node]
            for i in range(len(own) - 1, -1, -1):
                stack.append((own[i], depth + 1, i, False))
        return out
