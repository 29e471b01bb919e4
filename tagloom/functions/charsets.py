"""Encoding discovery and decoding for documents that come as bytes."""

from __future__ import annotations

import codecs
import re

# Byte-order marks in the order in which they are tried.
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be"))
PRESCAN = 1024
FALLBACK = "windows-1252"

# Encoding names of the web with their labels, where these aren't the name.
LABELS = {
    "utf-8": "utf8 unicode-1-1-utf-8", "ibm866": "866 cp866 csibm866",
    "iso-8859-2": "latin2 l2 csisolatin2 iso8859-2 iso88592 iso_8859-2 iso_8859-2:1987 iso-ir-101", "iso-8859-3": "latin3 l3 csisolatin3 iso8859-3 iso88593 iso_8859-3 iso-ir-109",
    "iso-8859-4": "latin4 l4 csisolatin4 iso8859-4 iso88594 iso_8859-4 iso-ir-110", "iso-8859-5": "cyrillic csisolatincyrillic iso8859-5 iso88595 iso_8859-5 iso-ir-144",
    "iso-8859-6": "arabic asmo-708 csisolatinarabic ecma-114 iso8859-6 iso88596 iso_8859-6 iso-ir-127", "iso-8859-7": "greek greek8 ecma-118 elot_928 csisolatingreek iso8859-7 iso88597 iso_8859-7 iso-ir-126 sun_eu_greek",
    "iso-8859-8": "hebrew visual csisolatinhebrew iso8859-8 iso88598 iso_8859-8 iso-ir-138 csiso88598e iso-8859-8-e", "iso-8859-8-i": "logical csiso88598i", "iso-8859-10": "latin6 l6 csisolatin6 iso8859-10 iso885910 iso-ir-157",
    "iso-8859-13": "iso8859-13 iso885913", "iso-8859-14": "iso8859-14 iso885914", "iso-8859-15": "l9 csisolatin9 iso8859-15 iso885915 iso_8859-15", "iso-8859-16": "",
    "koi8-r": "koi koi8 koi8_r cskoi8r", "koi8-u": "", "macintosh": "mac x-mac-roman csmacintosh", "windows-874": "dos-874 tis-620 iso-8859-11 iso8859-11 iso885911",
    "windows-1250": "cp1250 x-cp1250", "windows-1251": "cp1251 x-cp1251",
    "windows-1252": "ascii us-ascii iso-8859-1 iso8859-1 iso88591 iso_8859-1 iso_8859-1:1987 iso-ir-100 latin1 l1 cp1252 x-cp1252 cp819 ibm819 csisolatin1 ansi_x3.4-1968",
    "windows-1253": "cp1253 x-cp1253", "windows-1254": "iso-8859-9 iso8859-9 iso88599 iso_8859-9 iso_8859-9:1989 iso-ir-148 latin5 l5 cp1254 x-cp1254 csisolatin5",
    "windows-1255": "cp1255 x-cp1255", "windows-1256": "cp1256 x-cp1256", "windows-1257": "cp1257 x-cp1257", "windows-1258": "cp1258 x-cp1258", "x-mac-cyrillic": "x-mac-ukrainian",
    "gbk": "gb2312 chinese csgb2312 csiso58gb231280 gb_2312 gb_2312-80 iso-ir-58 x-gbk", "gb18030": "", "hz-gb-2312": "", "big5": "big5-hkscs cn-big5 csbig5 x-x-big5", "euc-jp": "cseucpkdfmtjapanese x-euc-jp",
    "iso-2022-jp": "csiso2022jp", "shift_jis": "shift-jis sjis ms_kanji csshiftjis windows-31j x-sjis", "euc-kr": "korean cseuckr ks_c_5601-1987 ks_c_5601-1989 ksc5601 ksc_5601 iso-ir-149 windows-949 csksc56011987",
    "utf-16be": "", "utf-16le": "utf-16", "x-user-defined": "", "replacement": "iso-2022-kr csiso2022kr iso-2022-cn iso-2022-cn-ext",
}
#: Names that Python's codecs call otherwise.
CODECS = {"windows-874": "cp874", "x-mac-cyrillic": "mac_cyrillic", "macintosh": "mac_roman", "iso-8859-8-i": "iso-8859-8", "hz-gb-2312": "hz", "gbk": "gb18030", "big5": "big5hkscs", "shift_jis": "cp932", "euc-kr": "cp949"}
_BY_LABEL = {label: name for name, labels in LABELS.items() for label in (name, *labels.split())}

_SPACES = "\t\n\x0c\r "
_ATTRIBUTE = re.compile(rb"""[\t\n\f\r /]*([^\t\n\f\r />=]*|=[^\t\n\f\r />=]*)[\t\n\f\r ]*(?:=[\t\n\f\r ]*(?:"([^"]*)"|'([^']*)'|([^\t\n\f\r >]*)))?""")
_CONTENT = re.compile(r"""charset[\t\n\f\r ]*=[\t\n\f\r ]*(?:"([^"]*)"|'([^']*)'|([^\t\n\f\r "'][^\t\n\f\r ]*))""", re.IGNORECASE)


def lookup(label: str | bytes | None) -> str | None:
    """Encoding of a label; None for unknown ones and for labels that aren't ASCII."""
    if label is None:
        return None
    if isinstance(label, bytes):
        label = label.decode("latin-1")
    if not label.isascii():
        return None
    return _BY_LABEL.get(label.strip(_SPACES).lower())


def charset_in_content(content: str) -> str | None:
    """The `charset=` of a content type; None where the first one has no value in order."""
    m = _CONTENT.search(content)
    return next((g for g in m.groups() if g is not None), None) if m else None


def prescan(content: bytes) -> str | None:
    """Encoding that a `<meta>` in the first bytes names; utf-16 there means utf-8."""
    data = content[:PRESCAN].lower()
    i = 0
    while (i := data.find(b"<", i)) >= 0:
        if data.startswith(b"<!--", i):
            end = data.find(b"-->", i + 2)
            if end < 0:
                return None
            i = end + 3
        elif re.match(rb"<meta[\t\n\f\r /]", data[i : i + 6]):
            found, i = _attributes(data, i + 5)
            name = None
            if "charset" in found:
                name = lookup(found["charset"])
            elif found.get("http-equiv") == "content-type" and "content" in found:
                name = lookup(charset_in_content(found["content"]))
            if name:
                return "utf-8" if name.startswith("utf-16") else name
        elif re.match(rb"</?[a-z]", data[i : i + 3]):
            m = re.compile(rb"[\t\n\f\r />]").search(data, i)
            if not m:
                return None
            _, i = _attributes(data, m.start())
        elif data[i + 1 : i + 2] in (b"!", b"/", b"?"):
            i = data.find(b">", i)
            if i < 0:
                return None
        else:
            i += 1
    return None


def _attributes(data: bytes, i: int) -> tuple[dict[str, str], int]:
    out: dict[str, str] = {}
    while i < len(data) and data[i : i + 1] != b">":
        m = _ATTRIBUTE.match(data, i)
        if m.end() == i:
            break
        if m[1]:
            value = next((g for g in m.groups()[1:] if g is not None), b"")
            out.setdefault(m[1].decode("latin-1"), value.decode("latin-1"))
        i = m.end()
    return out, i


def determine(content: bytes, override=None, transport=None, same_origin_parent=None, likely=None, default=FALLBACK, guess=None) -> tuple[str, str, int]:
    """(encoding, certain or tentative, bytes of the mark)."""
    for mark, name in MARKS:
        if content.startswith(mark):
            return name, "certain", len(mark)
    for label in (override, transport):
        if name := lookup(label):
            return name, "certain", 0
    if name := prescan(content):
        return name, "tentative", 0
    parent = lookup(same_origin_parent)
    if parent and not parent.startswith("utf-16"):
        return parent, "tentative", 0
    if name := lookup(likely):
        return name, "tentative", 0
    if guess and (name := lookup(guess(content))):
        return name, "tentative", 0
    return lookup(default) or FALLBACK, "tentative", 0


def decode(content: bytes, name: str) -> str:
    if name == "x-user-defined":
        return "".join(chr(b if b < 0x80 else 0xF700 + b) for b in content)
    if name == "replacement":
        return "�" if content else ""
    if name == "windows-1252":
        return content.decode("cp1252", "special-c1")
    return content.decode(CODECS.get(name, name), "replace")


def _c1(e):
    """windows-1252 of the web has a character for every byte."""
    return "".join(chr(b) for b in e.object[e.start : e.end]), e.end


codecs.register_error("special-c1", _c1)
