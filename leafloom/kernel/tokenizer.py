"""The tokenizer of the HTML standard over a str, in strides of regular expressions.

`Tokenizer.run(builder)` calls the builder for each token: start_tag, end_tag, text, comment, instruction, doctype, eof. The
builder sets `state` for elements whose content is not markup, and `foreign` tells whether CDATA sections are text.
"""

from __future__ import annotations

import re
from html.entities import html5 as NAMED

SPACE = "\t\n\f\r "
_MARK = re.compile(r"[<&\0]")
_NAME = re.compile(r"[^\t\n\f />]+")
_WS = re.compile(r"[\t\n\f ]*")
_SEP = re.compile(r"[\t\n\f /]*")
_ATTR = re.compile(r"=?[^\t\n\f />=]*")
_BARE = re.compile(r"[^\t\n\f >]+")
_REF = re.compile(r"&(?:#[xX]([0-9a-fA-F]+);?|#([0-9]+);?|([a-zA-Z0-9]+;?)|#)")
_COMMENT_END = re.compile(r"--!?>")
_PI = re.compile(r"\?([A-Za-z_][A-Za-z0-9_-]*)(?=[\t\n\f >?])")
_SCRIPT = re.compile(r"<!--|-->|<(/?)script(?=[\t\n\f />])", re.I)
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_LONGEST = max(map(len, NAMED))
#: What numbers from 0x80 to 0x9F in character references stand for.
_C1 = {b: c for b in range(0x80, 0xA0) if (c := bytes([b]).decode("cp1252", "ignore"))}
_CONTROL = re.compile("[\x80-\x9f﷐-﷯￾￿" + "".join(chr((p << 16) | x) for p in range(1, 17) for x in (0xFFFE, 0xFFFF)) + "]")


def preprocess(text: str) -> str:
    """Line ends become LF; control characters U+0080 to U+009F and noncharacters become U+FFFD."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return text if text.isascii() else _CONTROL.sub("�", text)


def lower(s: str) -> str:
    return s.lower() if s.isascii() else s.translate(_UPPER)


class Tokenizer:
    def __init__(self, text: str, problem):
        self.s = text
        self.n = len(text)
        self.problem = problem  # problem(code, position)
        self.state, self.last_start = "data", ""
        self.at = 0  # where the current token starts

    # -- character references ------------------------------------------------------------------------------------------

    def refs(self, s: str, at: int, attribute: bool = False) -> str:
        """`s`, which begins at `at` of the input, with its references resolved."""
        if "&" not in s:
            return s

        def one(m: re.Match) -> str:
            hexa, dec, name = m.groups()
            where = at + m.start()
            if name is None:
                if hexa is None and dec is None:
                    self.problem("numeric-char-ref-no-digits", where)
                    return m[0]
                if m[0][-1] != ";":
                    self.problem("numeric-char-ref-without-semicolon", where)
                return self._number(int(hexa, 16) if hexa else int(dec), where)
            for k in range(min(len(name), _LONGEST), 1, -1):
                if (found := NAMED.get(name[:k])) is not None:
                    after = name[k : k + 1] or s[m.end() : m.end() + 1]
                    if name[k - 1] != ";":
                        if attribute and (after == "=" or (after.isascii() and after.isalnum())):
                            return m[0]
                        self.problem("named-char-ref-without-semicolon", where)
                    return found + name[k:]
            if name[-1] == ";":
                self.problem("named-char-ref-invalid", where)
            return m[0]

        return _REF.sub(one, s)

    def _number(self, n: int, where: int) -> str:
        if n == 0 or n > 0x10FFFF or 0xD800 <= n < 0xE000:
            self.problem("numeric-char-ref-invalid", where)
            return "�"
        if n < 0x20 and n not in (9, 10, 12) or 0x7F <= n < 0xA0 or n & 0xFFFE == 0xFFFE or 0xFDD0 <= n <= 0xFDEF:
            self.problem("numeric-char-ref-invalid", where)
        return _C1.get(n) or chr(n)

    # -- the loop ------------------------------------------------------------------------------------------------------

    def run(self, b) -> None:
        s, n, p = self.s, self.n, 0
        while p < n:
            if self.state != "data":
                p = self._raw(b, p)
                continue
            m = _MARK.search(s, p)
            end = m.start() if m else n
            if end > p:
                self.at = p
                b.text(s[p:end])
                p = end
                continue
            c = s[p]
            self.at = p
            if c == "<":
                p = self._markup(b, p)
            elif c == "&":
                r = _REF.match(s, p)
                if r:
                    b.text(self.refs(r[0], p))
                    p = r.end()
                else:
                    b.text("&")
                    p += 1
            else:
                self.problem("utf8-null", p)
                b.text("\0")
                p += 1
        self.at = n
        b.eof()

    def _markup(self, b, p: int) -> int:
        """Reads what begins with '<' at p; the place after it."""
        s, n = self.s, self.n
        c = s[p + 1 : p + 2]
        if c.isascii() and c.isalpha():
            return self._tag(b, p, p + 1, False)
        if c == "/":
            d = s[p + 2 : p + 3]
            if d.isascii() and d.isalpha():
                return self._tag(b, p, p + 2, True)
            if d == ">":
                self.problem("close-tag-empty", p)
                return p + 3
            if not d:
                self.problem("close-tag-eof", p)
                b.text("</")
                return n
            self.problem("close-tag-invalid", p)
            return self._bogus(b, p + 2)
        if c == "!":
            return self._declaration(b, p)
        if c == "?":
            if p + 2 >= n:
                return n
            m = _PI.match(s, p + 1)
            if m and m[1].lower() not in ("xml", "xml-stylesheet"):
                end = s.find(">", m.end())
                if end < 0:
                    return n
                data = s[m.end() : end].lstrip("\t\n\f ")
                b.instruction(m[1] + " " + (data[:-1] if data.endswith("?") else data).replace("\0", "�"))
                return end + 1
            self.problem("tag-starts-with-question", p)
            if not m and re.fullmatch(r"[A-Za-z_][A-Za-z0-9_-]*", s[p + 2 :]) and s[p + 2 :].lower() not in ("xml", "xml-stylesheet"):
                return n  # the target of an instruction that never ends
            return self._bogus(b, p + 1)
        self.problem("tag-invalid" if c else "tag-eof", p)
        b.text("<")
        return p + 1

    def _bogus(self, b, p: int) -> int:
        end = self.s.find(">", p)
        stop = self.n if end < 0 else end
        b.comment(self.s[p:stop].replace("\0", "�"))
        return self.n if end < 0 else end + 1

    def _declaration(self, b, p: int) -> int:
        s, n = self.s, self.n
        if s.startswith("--", p + 2):
            q = p + 4
            if s.startswith(">", q) or s.startswith("->", q):
                self.problem("comment-invalid", p)
                b.comment("")
                return q + (1 if s[q] == ">" else 2)
            m = _COMMENT_END.search(s, q)
            if m:
                if m[0] == "--!>":
                    self.problem("comment-bang-after-double-dash", m.start())
                b.comment(s[q : m.start()].replace("\0", "�"))
                return m.end()
            self.problem("comment-eof", p)
            rest = s[q:]
            for tail in ("--!", "--", "-"):
                if rest.endswith(tail):
                    rest = rest[: -len(tail)]
                    break
            b.comment(rest.replace("\0", "�"))
            return n
        if s[p + 2 : p + 9].lower() == "doctype":
            return self._doctype(b, p + 9)
        if s.startswith("[CDATA[", p + 2) and b.foreign():
            end = s.find("]]>", p + 9)
            stop = n if end < 0 else end
            if stop > p + 9:
                b.text(s[p + 9 : stop])
            return n if end < 0 else end + 3
        self.problem("dashes-or-doctype", p)
        return self._bogus(b, p + 2)

    def _doctype(self, b, p: int) -> int:
        s, n = self.s, self.n
        at = p - 9
        # quoted identifiers end at '>' too, so the first one ends the token
        end = s.find(">", p)
        stop, after = (n, n) if end < 0 else (end, end + 1)
        body, quirks = s[p:stop], end < 0
        if quirks:
            self.problem("doctype-eof", at)
        m = re.match(r"[\t\n\f ]*([^\t\n\f >]*)[\t\n\f ]*", body)
        name, rest = lower(m[1]).replace("\0", "�"), body[m.end() :]
        public = system = None
        if not name:
            self.problem("doctype-right-bracket", at)
            quirks = True
        if rest:
            key = rest[:6].lower()
            if key not in ("public", "system"):
                self.problem("doctype-space-or-right-bracket", at)
                quirks = True
            else:
                ids = re.match(r"""[\t\n\f ]*(?:"([^"]*)("?)|'([^']*)('?))""", rest[6:])
                if not ids:
                    self.problem("doctype-invalid", at)
                    quirks = True
                else:
                    first = ids[1] if ids[1] is not None else ids[3]
                    closed = bool(ids[2] or ids[4])
                    quirks |= not closed
                    tail = rest[6 + ids.end() :]
                    if key == "system":
                        system = first
                    else:
                        public = first
                        more = re.match(r"""[\t\n\f ]*(?:"([^"]*)("?)|'([^']*)('?))""", tail) if closed else None
                        if more:
                            system = more[1] if more[1] is not None else more[3]
                            quirks |= not (more[2] or more[4])
                            tail = tail[more.end() :]
                        elif tail.strip(SPACE):
                            self.problem("doctype-invalid", at)
                            quirks = True
                            tail = ""
                    if tail.strip(SPACE):
                        self.problem("doctype-invalid", at)
        fix = lambda x: x if x is None else x.replace("\0", "�")
        b.doctype(name, fix(public), fix(system), quirks)
        return after

    def _tag(self, b, start: int, p: int, closing: bool) -> int:
        """A tag whose name begins at p."""
        s, n = self.s, self.n
        m = _NAME.match(s, p)
        name, p = lower(m[0]), m.end()
        if "\0" in name:
            name = name.replace("\0", "�")
        attrs: list[tuple[str, str]] = []
        seen: set[str] = set()
        void = False
        while True:
            p = _WS.match(s, p).end()
            if p >= n:
                self.problem("tag-eof", start)
                return n
            c = s[p]
            if c == ">":
                p += 1
                break
            if c == "/":
                if s.startswith("/>", p):
                    void, p = True, p + 2
                    break
                self.problem("solidus-invalid" if p + 1 < n else "solidus-eof", p)
                p += 1
                continue
            m = _ATTR.match(s, p)
            key, where, p = lower(m[0]), p, m.end()
            if "\0" in key:
                key = key.replace("\0", "�")
            if c == "=" or '"' in key or "'" in key or "<" in key:
                self.problem("attr-name-invalid", where)
            p = _WS.match(s, p).end()
            value = ""
            if p < n and s[p] == "=":
                p = _WS.match(s, p + 1).end()
                if p >= n:
                    self.problem("attr-name-eof", where)
                    return n
                q = s[p]
                if q in "\"'":
                    end = s.find(q, p + 1)
                    if end < 0:
                        self.problem("attr-double-quote-eof" if q == '"' else "attr-single-quote-eof", p)
                        return n
                    value = self.refs(s[p + 1 : end], p + 1, True)
                    p = end + 1
                    if p < n and s[p] not in "\t\n\f />":
                        self.problem("attr-after-invalid", p)
                elif q == ">":
                    self.problem("attr-unquoted-right-bracket", p)
                else:
                    m = _BARE.match(s, p)
                    if any(x in m[0] for x in "\"'<=`"):
                        self.problem("attr-unquoted-equals", p)
                    value = self.refs(m[0], p, True)
                    p = m.end()
            if key in seen:
                self.problem("duplicate-attr", where)
            else:
                seen.add(key)
                attrs.append((key, value.replace("\0", "�") if "\0" in value else value))
        if closing:
            b.end_tag(name)
        else:
            self.last_start = name
            b.start_tag(name, attrs, void)
        return p

    # -- content that is not markup --------------------------------------------------------------------------------------

    def _raw(self, b, p: int) -> int:
        """Text up to the end tag of the element that was opened last; the place where markup goes on."""
        s, n, kind = self.s, self.n, self.state
        if kind == "plaintext":
            self._raw_text(b, p, n, False)
            return n
        if not self.last_start:  # in a fragment nothing has been opened that could be closed
            end = n
        elif kind == "script":
            end = self._script_end(p)
        else:
            m = re.compile(rf"</{re.escape(self.last_start)}(?=[\t\n\f />])", re.I).search(s, p)
            end = m.start() if m else n
        self._raw_text(b, p, end, kind == "rcdata")
        self.state = "data"
        if end < n:
            self.at = end
            return self._tag(b, end, end + 2, True)
        if kind == "script":
            self.problem("script-eof", n)
        return n

    def _raw_text(self, b, p: int, end: int, refs: bool) -> None:
        if end > p:
            self.at = p
            text = self.s[p:end].replace("\0", "�")
            b.text(self.refs(text, p) if refs else text)

    def _script_end(self, p: int) -> int:
        state = "data"
        while m := _SCRIPT.search(self.s, p):
            found = m[0].lower()
            p = m.end()
            if found == "<!--":
                if state == "data":
                    state, p = "escaped", m.start() + 2  # its dashes may end the comment too
            elif found == "-->":
                state = "data"
            elif m[1]:
                if state != "double":
                    return m.start()
                state = "escaped"
            elif state == "escaped":
                state = "double"
        return self.n
