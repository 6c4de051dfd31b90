"""From bytes to text: byte order mark, declared encoding, <meta> prescan; strict, nothing is replaced."""

from __future__ import annotations

import codecs
import re

from leafloom.errors import EncodingError, InputError, LimitError

# Fixed values of the Encoding Standard: names with the labels that no rule below makes.
_NAMES = {
    "UTF-8": "unicode-1-1-utf-8 unicode11utf8 unicode20utf8 utf-8 utf8 x-unicode20utf8",
    "IBM866": "866 cp866 csibm866 ibm866",
    "ISO-8859-2": "csisolatin2 iso-ir-101 iso_8859-2:1987 l2 latin2",
    "ISO-8859-3": "csisolatin3 iso-ir-109 iso_8859-3:1988 l3 latin3",
    "ISO-8859-4": "csisolatin4 iso-ir-110 iso_8859-4:1988 l4 latin4",
    "ISO-8859-5": "csisolatincyrillic cyrillic iso-ir-144 iso_8859-5:1988",
    "ISO-8859-6": "arabic asmo-708 csiso88596e csiso88596i csisolatinarabic ecma-114 iso-8859-6-e iso-8859-6-i iso-ir-127 iso_8859-6:1987",
    "ISO-8859-7": "csisolatingreek ecma-118 elot_928 greek greek8 iso-ir-126 iso_8859-7:1987 sun_eu_greek",
    "ISO-8859-8": "csiso88598e csisolatinhebrew hebrew iso-8859-8-e iso-ir-138 iso_8859-8:1988 visual",
    "ISO-8859-8-I": "csiso88598i iso-8859-8-i logical",
    "ISO-8859-10": "csisolatin6 iso-ir-157 l6 latin6",
    "ISO-8859-13": "",
    "ISO-8859-14": "",
    "ISO-8859-15": "csisolatin9 iso_8859-15 l9",
    "ISO-8859-16": "iso-8859-16",
    "KOI8-R": "cskoi8r koi koi8 koi8-r koi8_r",
    "KOI8-U": "koi8-ru koi8-u",
    "macintosh": "csmacintosh mac macintosh x-mac-roman",
    "windows-874": "dos-874 iso-8859-11 iso8859-11 iso885911 tis-620 windows-874",
    "windows-1252": "ansi_x3.4-1968 ascii cp819 csisolatin1 ibm819 iso-8859-1 iso-ir-100 iso8859-1 iso88591 iso_8859-1 iso_8859-1:1987 l1 latin1 us-ascii",
    "windows-1254": "csisolatin5 iso-8859-9 iso-ir-148 iso8859-9 iso88599 iso_8859-9 iso_8859-9:1989 l5 latin5",
    "x-mac-cyrillic": "x-mac-cyrillic x-mac-ukrainian",
    "GBK": "chinese csgb2312 csiso58gb231280 gb2312 gb_2312 gb_2312-80 gbk iso-ir-58 x-gbk",
    "gb18030": "gb18030",
    "Big5": "big5 big5-hkscs cn-big5 csbig5 x-x-big5",
    "EUC-JP": "cseucpkdfmtjapanese euc-jp x-euc-jp",
    "ISO-2022-JP": "csiso2022jp iso-2022-jp",
    "Shift_JIS": "csshiftjis ms932 ms_kanji shift-jis shift_jis sjis windows-31j x-sjis",
    "EUC-KR": "cseuckr csksc56011987 euc-kr iso-ir-149 korean ks_c_5601-1987 ks_c_5601-1989 ksc5601 ksc_5601 windows-949",
    "replacement": "csiso2022kr hz-gb-2312 iso-2022-cn iso-2022-cn-ext iso-2022-kr replacement",
    "UTF-16BE": "unicodefffe utf-16be",
    "UTF-16LE": "csunicode iso-10646-ucs-2 ucs-2 unicode unicodefeff utf-16 utf-16le",
    "x-user-defined": "x-user-defined",
}
LABELS = {label: name for name, labels in _NAMES.items() for label in labels.split()}
for _n in (2, 3, 4, 5, 6, 7, 8, 10, 13, 14, 15):
    LABELS |= dict.fromkeys((f"iso-8859-{_n}", f"iso8859-{_n}", f"iso8859{_n}"), f"ISO-8859-{_n}")
    if _n < 10:
        LABELS[f"iso_8859-{_n}"] = f"ISO-8859-{_n}"
for _n in range(1250, 1259):
    LABELS |= dict.fromkeys((f"cp{_n}", f"windows-{_n}", f"x-cp{_n}"), f"windows-{_n}")
# Python's names where they differ.
_CODEC = {"ISO-8859-8-I": "iso8859-8", "windows-874": "cp874", "x-mac-cyrillic": "mac-cyrillic", "macintosh": "mac-roman", "Shift_JIS": "cp932", "EUC-KR": "cp949", "IBM866": "cp866"}
# Bytes that the standard's indexes map and Python's codecs do not.
_MORE = {"windows-1255": {b: chr(b) for b in (0x81, 0x8A, 0x8C, 0x8D, 0x8E, 0x8F, 0x90, 0x9A, 0x9C, 0x9D, 0x9E, 0x9F)} | {0xCA: "ֺ"}, "windows-1258": {b: chr(b) for b in (0x81, 0x8A, 0x8D, 0x8E, 0x8F, 0x90, 0x9A, 0x9D, 0x9E)}}
_BOMS = ((b"\xef\xbb\xbf", "UTF-8"), (b"\xfe\xff", "UTF-16BE"), (b"\xff\xfe", "UTF-16LE"))
_PROBE = bytes(range(0x20, 0x7F)).replace(b"\\", b"").replace(b"~", b"") + b"\t\n\r"
PRESCAN = 1024


def label(name: str) -> str | None:
    """The encoding that a label names."""
    return LABELS.get(name.strip("\t\n\f\r ").lower())


def _attribute(s: bytes, p: int) -> tuple[bytes, bytes, int] | None:
    """The next attribute of a tag: name, value, the place after; None at the tag's end."""
    while p < len(s) and s[p] in b"\t\n\f\r /":
        p += 1
    if p >= len(s) or s[p] == 0x3E:
        return None
    start = p
    while p < len(s) and s[p] not in b"\t\n\f\r />" and not (s[p] == 0x3D and p > start):
        p += 1
    name = s[start:p].lower()
    q = p
    while q < len(s) and s[q] in b"\t\n\f\r ":
        q += 1
    if q >= len(s) or s[q] != 0x3D:
        return name, b"", p
    p = q + 1
    while p < len(s) and s[p] in b"\t\n\f\r ":
        p += 1
    if p < len(s) and s[p] in b"\"'":
        end = s.find(s[p : p + 1], p + 1)
        if end < 0:
            return None
        return name, s[p + 1 : end].lower(), end + 1
    start = p
    while p < len(s) and s[p] not in b"\t\n\f\r >":
        p += 1
    return name, s[start:p].lower(), p


def prescan(data: bytes) -> str | None:
    """The encoding that the first PRESCAN bytes declare in a <meta>."""
    s, p = data[:PRESCAN], 0
    while (p := s.find(b"<", p)) >= 0:
        if s.startswith(b"<!--", p):
            end = s.find(b"-->", p + 2)
            if end < 0:
                return None
            p = end + 3
        elif s[p : p + 5].lower() == b"<meta" and s[p + 5 : p + 6] in (b"\t", b"\n", b"\f", b"\r", b" ", b"/"):
            p += 5
            seen: set[bytes] = set()
            pragma, need, charset = False, None, None
            while (a := _attribute(s, p)) is not None:
                name, value, p = a
                if name in seen:
                    continue
                seen.add(name)
                if name == b"http-equiv":
                    pragma |= value == b"content-type"
                elif name == b"content" and charset is None:
                    m = re.search(rb"charset[\t\n\f\r ]*=[\t\n\f\r ]*(?:\"([^\"]*)\"|'([^']*)'|([^\"'\t\n\f\r ;][^\t\n\f\r ;]*))", value)
                    if m and (found := label(next(x for x in m.groups() if x is not None).decode("latin1"))):
                        charset, need = found, True
                elif name == b"charset":
                    charset, need = label(value.decode("latin1")), False
            if need is not None and charset is not None and (not need or pragma):
                if charset.startswith("UTF-16"):
                    return "UTF-8"
                return "windows-1252" if charset == "x-user-defined" else charset
        elif re.match(rb"</?[A-Za-z]", s[p:]):
            m = re.compile(rb"[\t\n\f\r >]").search(s, p)
            if not m:
                return None
            p = m.start()
            while (a := _attribute(s, p)) is not None:
                p = a[2]
        elif s[p + 1 : p + 2] in (b"!", b"/", b"?"):
            end = s.find(b">", p)
            if end < 0:
                return None
            p = end + 1
        else:
            p += 1
    return None


def _strict(data: bytes, name: str) -> str:
    more = _MORE.get(name.lower())
    codec = _CODEC.get(name, name)
    try:
        if more:
            table = [more.get(b) or bytes([b]).decode(name.lower(), "ignore") or None for b in range(256)]
            if any(table[b] is None for b in set(data)):
                raise EncodingError(f"the input has bytes that {name} does not have", name)
            return "".join(table[b] for b in data)
        return data.decode(codec, "strict")
    except UnicodeDecodeError as e:
        raise EncodingError(f"the input is not valid {name}: byte {e.start}", name) from None


def decode(data: str | bytes | None, encoding: str | None = None, max_input: int = 16 << 20) -> tuple[str, str, str]:
    """Text, encoding, and what told it: "string", "bom", "argument", "meta" or "default"."""
    if data is None:
        raise InputError("the input is null", "x")
    if isinstance(data, str):
        if encoding is not None and label(encoding) != "UTF-8":
            raise EncodingError(f"a string is UTF-8, not {encoding}", encoding)
        text, name, source = data.removeprefix("﻿"), "UTF-8", "string"
    else:
        if len(data) > 4 * max_input:
            raise LimitError("max_input", max_input, len(data))
        bom = next(((b, n) for b, n in _BOMS if data.startswith(b)), None)
        if bom:
            name, source = bom[1], "bom"
            if encoding is not None and (label(encoding) or encoding).upper()[:8] not in (name, "UTF-16" if name != "UTF-8" else name):
                raise EncodingError(f"the byte order mark says {name}, not {encoding}", encoding)
            text = _wide(data[len(bom[0]) :], name) if name != "UTF-8" else _strict(data[3:], name)
        elif encoding is not None:
            name, source = encoding, "argument"
            text = _argument(data, encoding)
        elif (found := prescan(data)) is not None:
            name, source = found, "meta"
            if found == "replacement":
                raise EncodingError("the page declares an encoding that cannot be read safely", found)
            text = _strict(data, found)
        else:
            name, source = "UTF-8", "default"
            text = _strict(data, name)
    if "\0" in text and not isinstance(data, str):
        raise EncodingError("the input has a NUL character", name)
    size = len(text.encode("utf-8", "surrogatepass"))
    if size > max_input:
        raise LimitError("max_input", max_input, size)
    return text, name, source


def _wide(data: bytes, name: str) -> str:
    if len(data) % 2:
        raise EncodingError(f"the input is not valid {name}: its length is odd", name)
    return _strict(data, name)


def _argument(data: bytes, encoding: str) -> str:
    """An encoding given by name is taken as it is written, where <meta> labels go by the standard's table."""
    key = encoding.strip().lower()
    if key in ("utf-16", "utf16"):
        return _wide(data, "UTF-16BE")
    if key in ("utf-16be", "utf-16le"):
        return _wide(data, encoding.upper())
    if key in ("utf8", "utf-8"):
        return _strict(data, "UTF-8")
    name = encoding if key in ("latin1", "iso-8859-1") else _CODEC.get(LABELS.get(key, ""), encoding)
    if key in _MORE:
        return _strict(data, key)
    try:
        codecs.lookup(name)
        if _PROBE.decode(name) != _PROBE.decode("ascii"):
            raise EncodingError(f"{encoding} is not supported: it does not contain ASCII", encoding)
    except (LookupError, UnicodeDecodeError):
        raise EncodingError(f"{encoding} is not supported", encoding) from None
    try:
        return data.decode(name, "strict")
    except UnicodeDecodeError as e:
        raise EncodingError(f"the input is not valid {encoding}: byte {e.start}", encoding) from None
