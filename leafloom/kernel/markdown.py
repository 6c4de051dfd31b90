"""Markdown (CommonMark with pipe tables) of nodes.

A walk over the tree collects blocks: paragraphs, headings, code, rules, quotes, lists, tables. What stands inline is kept as
events until its block ends; then white space is settled, emphasis that CommonMark would not read back is dropped, and text is
escaped for the place where it ends up.
"""

from __future__ import annotations

import re
import unicodedata

from leafloom.kernel.flat import Tree
from leafloom.kernel.tables import grid
from leafloom.kernel.text import WS, text
from leafloom.kernel.urls import document_base, resolve

# Elements that stand as paragraphs; elements that leave nothing.
BLOCKS = frozenset("""address article aside body center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup
html legend main nav optgroup option p section summary""".split())
SKIP = frozenset("head iframe noembed noframes script style template".split())
EMPHASIS = {"em": "*", "i": "*", "strong": "**", "b": "**"}
CODE = frozenset("code kbd samp tt".split())
PRE = frozenset("pre listing plaintext xmp".split())
HEADINGS = {f"h{n}": n for n in range(1, 7)}
_RUN = re.compile(r"[ \t\n\r\f\xa0]+|[^ \t\n\r\f\xa0]+")
_ENTITY = re.compile(r"&(?=[A-Za-z0-9#])")
_ALWAYS = re.compile(r"[\\`*\[\]<>~]")


def _punct(c: str) -> bool:
    return bool(c) and unicodedata.category(c)[0] in "PS"


def _space(c: str) -> bool:
    return not c or c.isspace()


class Inline:
    """Events of one block: text, code, image, break, and the openers and closers of emphasis and links."""

    def __init__(self):
        self.items: list[list] = []
        self.space, self.breaks, self.waiting = False, 0, []
        self.kind: dict[int, tuple] = {}
        self.same: dict[int, int] = {}
        self.seen = False

    def empty(self) -> bool:
        return not self.seen

    def _show(self, item: list) -> None:
        if self.seen:
            if self.breaks:
                self.items += [["br"]] * self.breaks
            elif self.space:
                self._add_text(" ")
        glued = not (self.space or self.breaks)
        for n in self.waiting:
            last = self.items[-1] if self.items else None
            if glued and last and last[0] == "c" and self.kind[last[1]] == self.kind[n] and self.kind[n][0] != "a":
                self.items.pop()
                self.same[n] = last[1]
            else:
                self.items.append(["o", n])
        self.waiting, self.space, self.breaks, self.seen = [], False, 0, True
        if item[0] == "s":
            self._add_text(item[1])
        elif item[0] == "code" and glued and self.items and self.items[-1][0] == "code":
            self.items[-1][1] += item[1]
        else:
            self.items.append(item)

    def _add_text(self, s: str) -> None:
        if self.items and self.items[-1][0] == "s":
            self.items[-1][1] += s
        else:
            self.items.append(["s", s])

    def text(self, s: str) -> None:
        for run in _RUN.findall(s):
            if run[0] in WS or run[0] == "\xa0":
                self.space = True
            else:
                self._show(["s", run])

    def code(self, s: str) -> None:
        body = re.sub(r"[ \t\n\r\f\xa0]+", " ", s)
        if not body.strip(" "):
            self.space = self.space or bool(body)
            return
        self._show(["code", body])

    def image(self, alt: str, url: str) -> None:
        self._show(["img", alt, url])

    def br(self) -> None:
        self.space = False
        self.breaks += 1

    def open(self, n: int, kind: tuple) -> None:
        self.kind[n] = kind
        self.waiting.append(n)

    def close(self, n: int) -> None:
        if n in self.waiting:
            self.waiting.remove(n)
        elif n in self.kind:
            self.items.append(["c", self.same.get(n, n)])

    # -- writing -------------------------------------------------------------------------------------------------------

    def write(self, oneline: bool = False, cell: bool = False) -> str:
        items = [["s", " "] if oneline and x[0] == "br" else x for x in self.items]
        off = self._unreadable(items)
        out: list[str] = []
        start, first = True, True  # of a line; of the block
        after_bracket = False
        links: list[int] = []
        for x in items:
            what = x[0]
            if what in "oc" and len(what) == 1 and x[1] in off:
                continue
            if what == "s":
                out.append(self._escaped(x[1], start, first, oneline, cell, after_bracket))
                if x[1].strip(" "):
                    start = False
            elif what == "code":
                out.append(self._code(x[1], cell))
                start = False
            elif what == "img":
                alt = re.sub(r"[ \t\n\r\f\xa0]+", " ", x[1]).strip(" ")
                out.append(f"![{self._escaped(alt, False, first, oneline, cell, True)}]({self._url(x[2], cell)})")
                start = False
            elif what == "br":
                out.append("\\\n")
                start, first = True, False
            elif self.kind[x[1]][0] != "a":
                out.append(self.kind[x[1]][0])
                start = False
            elif what == "o":
                if out and out[-1].endswith("!") and not out[-1].endswith("\\!"):
                    out[-1] = out[-1][:-1] + "\\!"
                links.append(len(out))
                out.append("[")
                start = False
                after_bracket = True
                continue
            else:
                at = links.pop() if links else 0
                inner = "".join(out[at + 1 :])
                out.append(f"]({self._url(self.kind[x[1]][1], cell)}{' ' if ']:' in inner.replace(chr(92) + ']', '') else ''})")
            after_bracket = False
        return "".join(out).rstrip(" ")

    def _unreadable(self, items: list[list]) -> set[int]:
        """Emphasis that would touch other emphasis or could not open or close where it stands."""
        off: set[int] = set()
        closes = {x[1] for x in items if x[0] == "c"}
        off |= {x[1] for x in items if x[0] == "o" and x[1] not in closes and self.kind[x[1]][0] != "a"}

        def edges(x: list) -> tuple[str, str]:
            if x[0] == "s":
                return x[1][:1], x[1][-1:]
            if x[0] == "code":
                return "`", "`"
            if x[0] == "img":
                return "!", ")"
            if x[0] == "br":
                return "\n", "\n"
            return ("[", "[") if x[0] == "o" else ("]", ")")

        def one() -> int | None:
            live = [x for x in items if not (x[0] in ("o", "c") and x[1] in off)]
            mark = lambda x: x[0] in ("o", "c") and self.kind[x[1]][0] != "a"
            for i, x in enumerate(live):
                if not mark(x):
                    continue
                before, after = live[i - 1] if i else None, live[i + 1] if i + 1 < len(live) else None
                if before is not None and mark(before):
                    return before[1] if x[0] == "c" and before[0] == "c" else x[1]
                if after is not None and mark(after):
                    continue  # seen from there
                p = edges(before)[1] if before is not None else ""
                n = edges(after)[0] if after is not None else ""
                if x[0] == "o" and (_space(n) or (_punct(n) and not _space(p) and not _punct(p))):
                    return x[1]
                if x[0] == "c" and (_space(p) or (_punct(p) and not _space(n) and not _punct(n))):
                    return x[1]
            return None

        while (n := one()) is not None:
            off.add(n)
        return off

    @staticmethod
    def _escaped(s: str, start: bool, first: bool, oneline: bool, cell: bool, bracket: bool) -> str:
        lead = ""
        if start:
            if m := re.match(r"(\d{1,9})([.)])(?=\s|$)", s):
                lead, s = f"{m[1]}\\{m[2]}", s[m.end() :]
            elif s[:1] in ("#", "-", "+", "=") or (s[:1] in (":", "|") and not first and not cell):
                lead, s = "\\" + s[0], s[1:]
        if bracket and s.startswith("^"):
            lead, s = "\\^", s[1:]
        s = _ALWAYS.sub(r"\\\g<0>", s)
        s = _ENTITY.sub(r"\\&", s)
        if "_" in s:
            s = re.sub(r"(?<![^\W_])_+|_+(?![^\W_])", lambda m: "\\_" * len(m[0]), s)
        if oneline and not cell:
            s = s.replace("#", "\\#")
        if cell:
            s = s.replace("|", "\\|")
        return lead + s

    @staticmethod
    def _code(s: str, cell: bool) -> str:
        longest = max((len(r) for r in re.findall("`+", s)), default=0)
        fence = "`" * (longest + 1)
        if not longest:
            s = s.strip(" ")
        pad = " " if s.startswith("`") or s.endswith("`") else ""
        return f"{fence}{pad}{s.replace('|', chr(92) + '|') if cell else s}{pad}{fence}"

    @staticmethod
    def _url(url: str, cell: bool) -> str:
        url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        url = url.replace("(", "\\(").replace(")", "\\)").replace("<", "%3C").replace(">", "%3E")
        return url.replace("|", "%7C") if cell else url


class Writer:
    def __init__(self, t: Tree, base: str | None):
        self.t, self.base = t, base
        self.blocks: list = []
        self.outer: list[list] = []
        self.inline = Inline()
        self.active: list[tuple[int, tuple]] = []  # emphasis and links around what comes
        self.number = 0
        self.heading = 0
        self.in_cell = False

    # -- inline --------------------------------------------------------------------------------------------------------

    def begin(self, kind: tuple) -> int:
        if kind[0] != "a" and any(k == kind for _, k in self.active) or kind[0] == "a" and any(k[0] == "a" for _, k in self.active):
            return 0
        self.number += 1
        self.active.append((self.number, kind))
        self.inline.open(self.number, kind)
        return self.number

    def finish(self, n: int) -> None:
        if n:
            self.inline.close(n)
            self.active = [(m, k) for m, k in self.active if m != n]

    def flush(self) -> None:
        """Ends the paragraph; what is active goes on in the next one."""
        if self.heading:
            self.inline.space = True
            return
        for n, _ in reversed(self.active):
            self.inline.close(n)
        if not self.inline.empty():
            s = self.inline.write()
            if s:
                self.blocks.append(("p", s))
        self.inline = Inline()
        for n, kind in self.active:
            self.inline.open(n, kind)

    def url(self, i: int, name: str) -> str | None:
        v = self.t.attr(i, name)
        return None if v is None else (resolve(v, self.base) or v.strip(WS))

    # -- the walk ------------------------------------------------------------------------------------------------------

    def node(self, i: int) -> None:
        """Writes node i: an explicit stack of nodes and of what ends after them."""
        todo: list = [i]
        while todo:
            k = todo.pop()
            if callable(k):
                k()
                continue
            kind = self.t.type[k]
            if kind == "text":
                self.inline.text(self.t.value[k])
            elif kind in ("document", "fragment"):
                todo.extend(reversed(self.t.kids[k]))
            elif kind == "element":
                end = self.enter(k)
                if end is not None:
                    todo.append(end)
                    todo.extend(reversed(self.t.kids[k]))

    def enter(self, k: int):
        """Starts an element: what to do after its children, or None if they are not to be written by the walk."""
        t = self.t
        name = t.name[k]
        if t.ns[k] == "svg":
            self.inline.space = True
            return None
        if t.ns[k] != "html":
            return lambda: None
        if name in SKIP:
            return None
        if name == "br":
            self.inline.br()
            return None
        if name == "img":
            if (u := self.url(k, "src")) is not None:
                self.inline.image(t.attr(k, "alt") or "", u)
            return None
        if name in EMPHASIS or (name == "a" and t.attr(k, "href") is not None):
            n = self.begin(("a", self.url(k, "href")) if name == "a" else (EMPHASIS[name],))
            return lambda: self.finish(n)
        if name in CODE:
            self.inline.code(text(t, k) or "")
            return None
        if name in ("td", "th", "caption") and not self.in_cell:
            self.inline.space = True
            return lambda: setattr(self.inline, "space", True)
        if name in HEADINGS:
            return self._heading(k)
        if self.heading:
            if name in BLOCKS or name in ("ul", "ol", "menu", "li", "blockquote", "table", "tr", "hr", *PRE):
                self.inline.space = True
                return lambda: setattr(self.inline, "space", True)
            return lambda: None
        if name in BLOCKS or name in ("tr", "tbody", "thead", "tfoot"):
            self.flush()
            return self.flush
        if name == "hr":
            self.flush()
            self.blocks.append(("hr",))
            return None
        if name in PRE or name == "textarea":
            self.flush()
            self.blocks.append(("pre", self._pre_text(k), self._language(k)))
            return None
        if name == "blockquote":
            return self._container(lambda inner: ("quote", inner))
        if name in ("ul", "ol", "menu"):
            return self._list(k)
        if name == "li":
            return self._item(k)
        if name == "table":
            self._table(k)
            return None
        return lambda: None

    def _container(self, make):
        self.flush()
        self.outer.append(self.blocks)
        self.blocks = []

        def end() -> None:
            self.flush()
            inner, self.blocks = self.blocks, self.outer.pop()
            if inner:
                self.blocks.append(make(inner))

        return end

    def _heading(self, k: int):
        if self.heading:
            self.inline.space = True
            return lambda: setattr(self.inline, "space", True)
        self.flush()
        self.heading = HEADINGS[self.t.name[k]]

        def end() -> None:
            level, self.heading = self.heading, 0
            for n, _ in reversed(self.active):
                self.inline.close(n)
            s = "" if self.inline.empty() else self.inline.write(oneline=True)
            if s:
                self.blocks.append(("p", "#" * level + " " + s))
            self.inline = Inline()
            for n, kind in self.active:
                self.inline.open(n, kind)

        return end

    def _list(self, k: int):
        t, ordered = self.t, self.t.name[k] == "ol"
        step = 1
        start = 1
        if ordered:
            start = _whole(t.attr(k, "start"))
            if t.attr(k, "reversed") is not None:
                step = -1
                start = sum(t.is_html(c, "li") for c in t.kids[k]) if start is None else start
            start = 1 if start is None else start

        def make(inner: list):
            items, n = [], start
            for b in inner:
                if b[0] == "item":
                    if ordered and b[2] is not None:
                        n = b[2]
                    if b[1]:
                        items.append((n, b[1]))
                    n += step
                elif items:
                    items[-1][1].append(b)
                else:
                    items.append((n, [b]))
            return ("list", ordered, items) if items else ("none",)

        return self._container(make)

    def _item(self, k: int):
        value, lone = _whole(self.t.attr(k, "value")), not self.t.is_html(self.t.parent[k], "ul", "ol", "menu") if self.t.parent[k] >= 0 else True
        top = not self.outer
        self.flush()
        self.outer.append(self.blocks)
        self.blocks = []

        def end() -> None:
            self.flush()
            inner, self.blocks = self.blocks, self.outer.pop()
            if lone or top:
                if inner:
                    self.blocks.append(("list", False, [(1, inner)]))
            else:
                self.blocks.append(("item", inner, value))

        return end

    def _pre_text(self, k: int) -> str:
        t, out = self.t, []
        todo: list = list(reversed(t.kids[k]))
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                if out and not "".join(out[-1:]).endswith("\n"):
                    out.append("\n")
            elif t.type[n] == "text":
                out.append(t.value[n])
            elif t.is_html(n, "br"):
                out.append("\n")
            elif t.type[n] == "element" and not (t.ns[n] == "html" and t.name[n] in SKIP):
                if t.is_html(n, *BLOCKS):
                    todo.append("end")
                    if out and not out[-1].endswith("\n"):
                        out.append("\n")
                todo.extend(reversed(t.kids[n]))
        s = "".join(out)
        return s[:-1] if s.endswith("\n") else s

    def _language(self, k: int) -> str:
        inside = [k] + [c for c in self.t.kids[k] if self.t.is_html(c, "code")]
        for n in inside:
            for c in re.split(r"[ \t\n\r\f]+", self.t.attr(n, "class") or ""):
                if m := re.fullmatch(r"(?:language|lang)-([^`\s]+)", c):
                    return m[1]
        return ""

    def _table(self, k: int) -> None:
        t = self.t
        self.flush()
        for c in (c for c in t.kids[k] if t.is_html(c, "caption")):
            self._sub(c)
        try:
            g = grid(t, k)
        except ValueError:
            g = None
        spans = g is None or any(c.colspan > 1 or t.attr(c.node, "rowspan") not in (None, "1") for c in g.cells)
        blocky = g is not None and any(t.type[n] == "element" and t.ns[n] == "html" and (t.name[n] in BLOCKS or t.name[n] in HEADINGS or t.name[n] in PRE or t.name[n] in ("ul", "ol", "menu", "li", "blockquote", "table", "hr", "textarea")) for c in g.cells for n in t.below(c.node))
        if g is not None and not spans and not blocky:
            rows = [[self._cell(g.cells[c].node) if c >= 0 else "" for c in line] for line in g.slots]
            if any(any(r) for r in rows):
                lines = ["| " + " | ".join(r) + " |" for r in rows]
                self.blocks.append(("table", "\n".join([lines[0], "| " + " | ".join(["---"] * g.width) + " |", *lines[1:]])))
            return
        if g is None:
            for c in t.kids[k]:
                if not t.is_html(c, "caption"):
                    self._sub(c)
            return
        for n, (row, _) in enumerate(g.rows):
            del row
            for c in (c for c in g.cells if c.row == n):
                self.inline.space = True
                for kid in t.kids[c.node]:
                    self.node(kid)
                self.inline.space = True
            self.flush()

    def _sub(self, c: int) -> None:
        self.flush()
        for kid in self.t.kids[c]:
            self.node(kid)
        self.flush()

    def _cell(self, c: int) -> str:
        keep, self.inline, was = self.inline, Inline(), self.in_cell
        for n, kind in self.active:
            self.inline.open(n, kind)
        self.in_cell = True
        for kid in self.t.kids[c]:
            self.node(kid)
        for n, _ in reversed(self.active):
            self.inline.close(n)
        s = "" if self.inline.empty() else self.inline.write(oneline=True, cell=True)
        self.inline, self.in_cell = keep, was
        return s


def _whole(s: str | None) -> int | None:
    m = re.match(r"[ \t\n\r\f]*([+-]?\d+)", s or "")
    return int(m[1]) if m else None


def render(blocks: list, dash: bool = False) -> list[str]:
    """Lines of blocks. dash: the first line is already begun with '-'."""
    out: list[str] = []
    last = None  # the list before: (ordered, marker)
    for b in (b for b in blocks if b[0] != "none"):
        first = not out
        if b[0] == "list":
            mark = ")" if b[1] else "*"
            mark = mark if last and last == (b[1], "." if b[1] else "-") else ("." if b[1] else "-")
            lines = _list_lines(b, mark, dash and first)
            last = (b[1], mark)
        else:
            last = None
            if b[0] in ("p", "table"):
                lines = b[1].split("\n")
            elif b[0] == "hr":
                lines = ["***" if dash and first else "---"]
            elif b[0] == "pre":
                fence = "`" * max(3, 1 + max((len(r) for r in re.findall("`+", b[1])), default=0))
                lines = [fence + b[2], *(b[1].split("\n") if b[1] else []), fence]
            else:
                lines = [f"> {x}".rstrip() if x else ">" for x in render(b[1])]
        out += ([""] if out else []) + lines
    return out


def _list_lines(b: tuple, mark: str, dash: bool) -> list[str]:
    out: list[str] = []
    for n, (no, blocks) in enumerate(b[2]):
        lead = f"{no}{mark} " if b[1] else f"{mark} "
        lines = _tight(blocks, mark == "-" or (dash and not n))
        pad = " " * len(lead)
        out += [lead + lines[0]] + [pad + x if x else "" for x in lines[1:]] if lines else []
    return out


def _tight(blocks: list, dash: bool) -> list[str]:
    """As render, but a list directly under the item's text follows without a blank line where Markdown allows it."""
    if len(blocks) > 1 and blocks[0][0] == "p" and blocks[1][0] == "list" and (not blocks[1][1] or blocks[1][2][0][0] == 1):
        rest = render(blocks[1:])
        return blocks[0][1].split("\n") + rest
    return render(blocks, dash)


def markdown(t: Tree, i: int, base_url: str | None = None) -> str | None:
    """Markdown of a document, fragment, element or text; None of other nodes."""
    if t.type[i] not in ("document", "fragment", "element", "text"):
        return None
    w = Writer(t, document_base(t, base_url) if base_url else t.base)
    w.node(i)
    w.flush()
    return "\n".join(render(w.blocks))
