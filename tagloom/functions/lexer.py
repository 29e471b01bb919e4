"""Tokenizer of the parsing kernel.

Works on one decoded document with compiled patterns that swallow whole runs, so that a
token costs a few pattern calls whatever its length.  `mode` is the content model and is set by
the tree builder between tokens.
"""

from __future__ import annotations

import re

from tagloom.functions.tables import ENTITIES, NUMERIC, SPACES

DOCTYPE, CHARS, SPACE, START, END, COMMENT = range(6)

_LOWER = {c: c + 32 for c in range(65, 91)}
_RUN = {
    "data": re.compile(r"[^&<\0]+"),
    "rcdata": re.compile(r"[^&<\0]+"),
}
_SPACE_RUN = re.compile(r"[\t\n\f\r ]+")
_TAG_NAME = re.compile(r"[^\t\n\f\r />]*")
_TAG_SKIP = re.compile(r"[\t\n\f\r ]*")
_ATTR_NAME = re.compile(r"=?[^\t\n\f\r />=]*")
_UNQUOTED = re.compile(r"[^\t\n\f\r >]+")
_DASHES = re.compile("--+")
#: Errors of comments that never end, by their last characters.
_EOF_IN_COMMENT = {"-": "eof-in-comment-end-dash", "--": "eof-in-comment-double-dash", "--!": "eof-in-comment-end-bang-state"}
_WRONG_IN_NAME = re.compile("['\"<]")
_WRONG_IN_VALUE = re.compile("[\"'=<`]")
_COMMENT_END = re.compile(r"--!?>")
_COMMENT_TAIL = re.compile(r"(?:--!|--|-)\Z")
_REFERENCE = re.compile(r"&(?:#(?:[xX]([0-9a-fA-F]*)|([0-9]*))|([0-9A-Za-z]+;?))")
_SCRIPT = re.compile(r"<!--|--+>|<(/?)script(?=[\t\n\f\r />])", re.IGNORECASE)
_DOCTYPE_SPACE = _TAG_SKIP
_INVALID = re.compile("[\x01-\x08\x0b\x0e-\x1f\x7f-\x9f﷐-﷯￾￿" + "".join(chr(p << 16 | 0xFFFE) + chr(p << 16 | 0xFFFF) for p in range(1, 17)) + "\ud800-\udfff]")
_LONGEST = max(map(len, ENTITIES))


def lower(s: str) -> str:
    return s.lower() if s.isascii() else s.translate(_LOWER)


class Token:
    __slots__ = ("kind", "name", "attrs", "data", "self_closing", "acknowledged", "public", "system", "correct", "ns")

    def __init__(self, kind, name=None, data=None):
        self.kind, self.name, self.data = kind, name, data
        self.attrs: dict = {}
        self.self_closing = self.acknowledged = False
        self.public = self.system = None
        self.correct = True
        self.ns = None


class Lexer:
    def __init__(self, text: str, report, foreign=lambda: False):
        """`report(code, position, **vars)` takes parse errors; `foreign()` tells if CDATA is open to use."""
        self.s, self.n, self.i = text, len(text), 0
        self.mode = "data"
        self.last_start = ""
        self.report, self.foreign = report, foreign

    # -- references ---------------------------------------------------------------------------

    def reference(self, i: int, in_attribute: bool, extra: str = "") -> tuple[str, int]:
        """Text of the reference at `&` and the position after it; a bare `&` stands for itself."""
        s = self.s
        m = _REFERENCE.match(s, i)
        if m is None:
            return "&", i + 1
        if m[3] is None:
            digits = m[1] if m[1] is not None else m[2]
            if not digits:
                self.report("expected-numeric-entity", m.end())
                return s[i : m.end()], m.end()
            # beyond the last code point one number is as good as another, and long ones are slow to read
            digits = digits.lstrip("0") or "0"
            code = int(digits, 16 if m[1] is not None else 10) if len(digits) < 10 else 0x110000
            if code in NUMERIC:
                self.report("illegal-codepoint-for-numeric-entity", m.end())
                text = NUMERIC[code]
            elif 0xD800 <= code <= 0xDFFF or code > 0x10FFFF:
                self.report("illegal-codepoint-for-numeric-entity", m.end())
                text = "�"
            else:
                text = chr(code)
                if code in (0xB,) or _INVALID.match(text):
                    self.report("illegal-codepoint-for-numeric-entity", m.end())
            end = m.end()
            if s.startswith(";", end):
                end += 1
            else:
                self.report("numeric-entity-without-semicolon", end)
            return text, end
        name = m[3][:_LONGEST]
        while name and name not in ENTITIES:
            name = name[:-1]
        if not name:
            if extra != m[3][:1]:
                self.report("expected-named-entity", i + 1)
            return "&", i + 1
        end = i + 1 + len(name)
        if not name.endswith(";"):
            after = s[end : end + 1]
            if in_attribute and (after == "=" or after.isascii() and after.isalnum()):
                return s[i:end], end
            self.report("named-entity-without-semicolon", end)
        return ENTITIES[name], end

    def attribute_value(self, raw: str, at: int) -> str:
        """References and NUL in a value that begins at position `at`."""
        if "\0" in raw:
            self.report("invalid-codepoint", at)
        if "&" not in raw:
            return raw.replace("\0", "�")
        out, i, end = [], at, at + len(raw)
        while i < end:
            amp = self.s.find("&", i, end)
            if amp < 0:
                out.append(self.s[i:end])
                break
            out.append(self.s[i:amp])
            text, i = self.reference(amp, True)
            out.append(text)
        return "".join(out).replace("\0", "�")

    # -- tokens -------------------------------------------------------------------------------

    def __iter__(self):
        while self.i < self.n:
            mode = self.mode
            if mode == "data":
                yield from self._data()
            elif mode == "script":
                yield from self._raw(self._script_end())
            elif mode == "plaintext":
                text, self.i = self.s[self.i :], self.n
                yield Token(CHARS, data=text.replace("\0", "�"))
            else:
                yield from self._raw(self._text_end(), mode == "rcdata")

    def _text(self, text: str):
        m = _SPACE_RUN.match(text)
        if m:
            yield Token(SPACE, data=m[0])
            text = text[m.end() :]
        if text:
            yield Token(CHARS, data=text)

    def _data(self):
        s, i = self.s, self.i
        c = s[i]
        if c == "<":
            yield from self._markup()
        elif c == "&":
            text, self.i = self.reference(i, False)
            yield Token(SPACE if text in SPACES else CHARS, data=text)
        elif c == "\0":
            self.report("invalid-codepoint", i)
            self.i = i + 1
            yield Token(CHARS, data="\0")
        else:
            self.i = _RUN["data"].match(s, i).end()
            yield from self._text(s[i : self.i])

    def _text_end(self) -> int:
        """Where the end tag of the element that holds the text begins, or the end."""
        m = re.compile(r"</" + re.escape(self.last_start) + r"(?=[\t\n\f\r />])", re.IGNORECASE | re.ASCII).search(self.s, self.i)
        return m.start() if m else self.n

    def _script_end(self) -> int:
        """Comments in scripts hide end tags between `<script` and `</script`."""
        level, i = 0, self.i
        while m := _SCRIPT.search(self.s, i):
            found = m[0]
            i = m.end()
            if found == "<!--":
                if level == 0:
                    level = 1
                i = m.start() + 2  # its dashes may end it too
            elif found[0] == "-":
                level = 0
            elif m[1]:
                if level < 2:
                    return m.start()
                level = 1
            elif level == 1:
                level = 2
        return self.n

    def _raw(self, end: int, references: bool = False):
        s, i = self.s, self.i
        while i < end:
            stop = end
            if references:
                amp = s.find("&", i, end)
                if amp == i:
                    text, i = self.reference(amp, False)
                    yield Token(SPACE if text in SPACES else CHARS, data=text)
                    continue
                stop = amp if amp >= 0 else end
            text, i = s[i:stop], stop
            if "\0" in text:
                self.report("invalid-codepoint", stop)
                text = text.replace("\0", "�")
            self.i = i
            yield from self._text(text)
        self.i = end
        if end < self.n:
            self.mode = "data"
            yield from self._tag(end + 2, END)

    def _markup(self):
        s, i = self.s, self.i
        c = s[i + 1 : i + 2]
        if c.isascii() and c.isalpha():
            yield from self._tag(i + 1, START)
        elif c == "/":
            d = s[i + 2 : i + 3]
            if d.isascii() and d.isalpha():
                yield from self._tag(i + 2, END)
            elif d == ">":
                self.report("expected-closing-tag-but-got-right-bracket", i + 3)
                self.i = i + 3
            elif d == "":
                self.report("expected-closing-tag-but-got-eof", i + 2)
                self.i = i + 2
                yield Token(CHARS, data="</")
            else:
                self.report("expected-closing-tag-but-got-char", i + 2, data=d)
                yield self._bogus(i + 2)
        elif c == "!":
            yield from self._declaration(i + 2)
        elif c == "?":
            self.report("expected-tag-name-but-got-question-mark", i + 2)
            yield self._bogus(i + 1)
        elif c == ">":
            self.report("expected-tag-name-but-got-right-bracket", i + 2)
            self.i = i + 2
            yield Token(CHARS, data="<>")
        else:
            self.report("expected-tag-name", i + 1)
            self.i = i + 1
            yield Token(CHARS, data="<")

    def _bogus(self, at: int) -> Token:
        end = self.s.find(">", at)
        text = self.s[at : end if end >= 0 else self.n]
        self.i = end + 1 if end >= 0 else self.n
        return Token(COMMENT, data=text.replace("\0", "�"))

    def _dashes(self, at: int, end: int):
        """Reports what follows two dashes in a comment and doesn't end it."""
        for m in _DASHES.finditer(self.s, at, end):
            for k in range(m.start() + 2, m.end()):
                self.report("unexpected-dash-after-double-dash-in-comment", k + 1)
            after = self.s[m.end() : min(end, m.end() + 1)]
            if after == "!":
                self.report("unexpected-bang-after-double-dash-in-comment", m.end() + 1)
            elif after and after != ">":
                self.report("unexpected-char-in-comment", m.end() + 1)

    def _declaration(self, at: int):
        s = self.s
        if s.startswith("--", at):
            at += 2
            if s.startswith(">", at) or s.startswith("->", at):
                self.report("incorrect-comment", at + 1)
                self.i = s.index(">", at) + 1
                yield Token(COMMENT, data="")
                return
            m = _COMMENT_END.search(s, at)
            self._dashes(at, m.end() if m else self.n)
            if m:
                text, self.i = s[at : m.start()], m.end()
            else:
                tail = _COMMENT_TAIL.search(s, at)
                kind = _EOF_IN_COMMENT.get(tail[0] if tail else "", "eof-in-comment")
                self.report(kind if self.n - at > 1 else "eof-in-comment", self.n)
                text, self.i = _COMMENT_TAIL.sub("", s[at:]), self.n
            yield Token(COMMENT, data=text.replace("\0", "�"))
        elif s[at : at + 7].upper() == "DOCTYPE" and s[at : at + 7].isascii():
            yield self._doctype(at + 7)
        elif s.startswith("[CDATA[", at) and self.foreign():
            end = s.find("]]>", at + 7)
            text = s[at + 7 : end if end >= 0 else self.n]
            self.i = end + 3 if end >= 0 else self.n
            if "\0" in text:
                self.report("invalid-codepoint", self.i)
            if text:
                yield Token(CHARS, data=text.replace("\0", "�"))
        else:
            self.report("expected-dashes-or-doctype", at)
            yield self._bogus(at)

    def _tag(self, at: int, kind: int):
        s = self.s
        m = _TAG_NAME.match(s, at)
        token, i = Token(kind, lower(m[0]).replace("\0", "�")), m.end()
        ended = "eof-in-tag-name"  # the error, should the input end here
        named = False  # whether an attribute's name without a value comes before
        while True:
            start, i = i, _TAG_SKIP.match(s, i).end()
            if i > start:
                ended = "expected-end-of-tag-but-got-eof" if named else "expected-attribute-name-but-got-eof"
            if i >= self.n:
                self.report(ended, self.n)
                self.i = self.n
                return
            c = s[i]
            if c == ">":
                i += 1
                break
            if c == "/":
                if s.startswith(">", i + 1):
                    token.self_closing = True
                    i += 2
                    break
                if i + 1 >= self.n:
                    self.report("unexpected-EOF-after-solidus-in-tag", self.n)
                    self.i = self.n
                    return
                self.report("unexpected-character-after-solidus-in-tag", i + 1)
                i += 1
                ended, named = "expected-attribute-name-but-got-eof", False
                continue
            if c in "'\"<" or c == "=" and not named:
                self.report("invalid-character-after-attribute-name" if named else "invalid-character-in-attribute-name", i)
            m = _ATTR_NAME.match(s, i)
            for wrong in _WRONG_IN_NAME.finditer(s, i + 1, m.end()):
                self.report("invalid-character-in-attribute-name", wrong.start())
            name, i = lower(m[0]).replace("\0", "�"), m.end()
            ended, named = "eof-in-attribute-name", True
            value, before = "", i
            i = _TAG_SKIP.match(s, i).end()
            if not s.startswith("=", i):
                i = before
            else:
                named = False
                ended = "expected-attribute-value-but-got-eof"
                i = _TAG_SKIP.match(s, i + 1).end()
                quote = s[i : i + 1]
                if quote in ("'", '"') and quote:
                    end = s.find(quote, i + 1)
                    if end < 0:
                        self.report("eof-in-attribute-value-double-quote" if quote == '"' else "eof-in-attribute-value-single-quote", self.n)
                        self.i = self.n
                        return
                    value = self.attribute_value(s[i + 1 : end], i + 1)
                    i = end + 1
                    ended = "unexpected-EOF-after-attribute-value"
                    if i < self.n and s[i] not in "\t\n\f\r />":
                        self.report("unexpected-character-after-attribute-value", i)
                elif quote == ">":
                    self.report("expected-attribute-value-but-got-right-bracket", i)
                elif quote:
                    m = _UNQUOTED.match(s, i)
                    if quote in "=<`":
                        self.report("equals-in-unquoted-attribute-value", i)
                    for wrong in _WRONG_IN_VALUE.finditer(s, i + 1, m.end()):
                        self.report("unexpected-character-in-unquoted-attribute-value", wrong.start())
                    value = self.attribute_value(m[0], i)
                    i = m.end()
                    ended = "eof-in-attribute-value-no-quotes"
            if name in token.attrs:
                self.report("duplicate-attribute", i)
            else:
                token.attrs[name] = value
        self.i = i
        if kind == START:
            self.last_start = token.name
        else:
            if token.attrs:
                self.report("attributes-in-end-tag", i)
            if token.self_closing:
                self.report("this-closing-flag-on-end-tag", i)
            token.attrs, token.self_closing = {}, False
        yield token

    def _doctype(self, i: int) -> Token:
        s, token = self.s, Token(DOCTYPE)

        def give_up(code: str, at: int, broken: bool = True) -> Token:
            """Skips to `>`; `broken` marks the doctype as incorrect."""
            self.report(code, at)
            if broken:
                token.correct = False
            end = s.find(">", at)
            self.i = end + 1 if end >= 0 else self.n
            if end < 0:
                token.correct = False
            return token

        if i < self.n and s[i] not in SPACES:
            self.report("need-space-after-doctype", i)
        i = _DOCTYPE_SPACE.match(s, i).end()
        if i >= self.n or s[i] == ">":
            return give_up("expected-doctype-name-but-got-right-bracket" if i < self.n else "expected-doctype-name-but-got-eof", i)
        end = i
        while end < self.n and s[end] not in "\t\n\f\r >":
            end += 1
        token.name = lower(s[i:end]).replace("\0", "�")
        i = _DOCTYPE_SPACE.match(s, end).end()
        if i >= self.n:
            return give_up("eof-in-doctype" if i > end else "eof-in-doctype-name", i)
        if s[i] == ">":
            self.i = i + 1
            return token
        word = s[i : i + 6].upper()
        if word not in ("PUBLIC", "SYSTEM") or not s[i : i + 6].isascii():
            return give_up("expected-space-or-right-bracket-in-doctype", i)
        before = i + 6
        for field in ("public", "system") if word == "PUBLIC" else ("system",):
            i = _DOCTYPE_SPACE.match(s, before).end()
            if i >= self.n:
                return give_up("eof-in-doctype", i)
            quote = s[i]
            if quote not in "'\"":
                if quote == ">" and (field == "system" and word == "PUBLIC"):
                    self.i = i + 1
                    return token
                return give_up("unexpected-end-of-doctype" if quote == ">" and field == "public" else "unexpected-char-in-doctype", i)
            if i == before:
                self.report("unexpected-char-in-doctype", i)  # no space before the quote
            stop = min((x for x in (s.find(quote, i + 1), s.find(">", i + 1)) if x >= 0), default=self.n)
            setattr(token, field, s[i + 1 : stop].replace("\0", "�"))
            if stop >= self.n or s[stop] == ">":
                return give_up("unexpected-end-of-doctype" if stop < self.n else "eof-in-doctype", stop)
            before = stop + 1
        i = _DOCTYPE_SPACE.match(s, before).end()
        if i >= self.n:
            return give_up("eof-in-doctype", i)
        if s[i] == ">":
            self.i = i + 1
            return token
        return give_up("unexpected-char-in-doctype", i, broken=False)


def invalid_codepoints(text: str) -> int:
    return len(_INVALID.findall(text))
