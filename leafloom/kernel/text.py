"""Text of nodes: as it stands, in pieces, and as a reader sees it."""

from __future__ import annotations

import re

from leafloom.kernel.flat import Tree

# Elements with a line break before and after.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre section summary table
tbody tfoot thead title tr ul xmp""".split())
# Elements that keep their white space.
PRE = frozenset("pre textarea listing plaintext".split())
_RUNS = re.compile(r"[ \t\n\r\f]+|[^ \t\n\r\f]+")
_RUNS_NBSP = re.compile(r"[ \t\n\r\f\xa0]+|[^ \t\n\r\f\xa0]+")
_WORDS, _WORDS_NBSP = re.compile(r"[^ \t\n\r\f]+"), re.compile(r"[^ \t\n\r\f\xa0]+")
WS = " \t\n\r\f"


def skipped(t: Tree, i: int) -> bool:
    """Elements that readers do not see: scripts, styles, templates."""
    return t.type[i] == "element" and (t.name[i] in ("script", "style", "template") if t.ns[i] == "html" else t.ns[i] == "svg" and t.name[i] in ("script", "style"))


def text(t: Tree, i: int, recursive: bool = True) -> str | None:
    """All text below, without separators; a template's is empty, a text's, comment's or instruction's its own."""
    if t.type[i] in ("text", "comment", "processing_instruction"):
        return t.value[i]
    if t.type[i] == "doctype":
        return None
    if t.is_html(i, "template"):
        return ""
    if not recursive:
        return "".join(t.value[k] for k in t.kids[i] if t.type[k] == "text")
    out, k, end = [], i + 1, t.end[i]
    while k <= end:
        if t.is_html(k, "template"):
            k = t.end[k] + 1
            continue
        if t.type[k] == "text":
            out.append(t.value[k])
        k += 1
    return "".join(out)


def strings(t: Tree, i: int, trim: bool = True, drop_empty: bool = True) -> list[str]:
    """The pieces of text below that a reader may see."""
    out: list[str] = []
    if t.type[i] == "text":
        out = [t.value[i]]
    elif t.type[i] in ("element", "document", "fragment") and not skipped(t, i):
        k, end = i + 1, t.end[i]
        while k <= end:
            if skipped(t, k):
                k = t.end[k] + 1
                continue
            if t.type[k] == "text":
                out.append(t.value[k])
            k += 1
    out = [s.strip(WS) for s in out] if trim else out
    return [s for s in out if s] if drop_empty else out


class _Writer:
    def __init__(self, nbsp: bool):
        self.out: list[str] = []
        self.space = self.block = False
        self.hard = 0
        self.seen = False
        self.runs = _RUNS_NBSP if nbsp else _RUNS
        self.nbsp = nbsp

    def visible(self, s: str) -> None:
        if self.seen:
            if self.hard:
                self.out.append("\n" * self.hard)
            elif self.block:
                self.out.append("\n")
            elif self.space:
                self.out.append(" ")
        elif self.space:
            self.out.append(" ")
        self.hard, self.block, self.space, self.seen = 0, False, False, True
        self.out.append(s)

    def text(self, s: str, pre: bool) -> None:
        if pre:
            if s:
                self.visible(s.replace("\xa0", " ") if self.nbsp else s)
            return
        for run in self.runs.findall(s):
            if run[0] in WS or (self.nbsp and run[0] == "\xa0"):
                self.space = True
            else:
                self.visible(run)

    def boundary(self) -> None:
        self.block = True

    def br(self) -> None:
        self.space = False
        if self.seen:
            self.hard += 1


def clean(t: Tree, i: int, trim: bool = True, nbsp: bool = True, skip_lists: bool = False, skip_tables: bool = False) -> str | None:
    """Text as a reader sees it: white space collapsed, blocks and <br> as line breaks, cells apart by a space.

    skip_lists and skip_tables leave out nested lists or tables, each of which remains a block boundary."""
    if t.type[i] not in ("element", "document", "fragment", "text"):
        return None
    if trim and t.end[i] == i + 1 and t.type[i + 1] == "text" and t.type[i] == "element" and t.name[i] not in PRE and not skipped(t, i):
        return " ".join((_WORDS_NBSP if nbsp else _WORDS).findall(t.value[i + 1]))
    w = _Writer(nbsp)
    if t.type[i] == "text":
        pre = any(t.is_html(a) and t.name[a] in PRE for a in t.ancestors(i))
        w.text(t.value[i], pre)
    elif not skipped(t, i):
        pre = 0
        first = int(t.is_html(i) and t.name[i] in PRE)
        pre += first
        ends: list[tuple[int, bool, bool]] = []  # end, whether a block, whether preformatted
        k, end = i + 1, t.end[i]
        while k <= end:
            while ends and ends[-1][0] < k:
                _, block, p = ends.pop()
                pre -= p
                if block:
                    w.boundary()
                else:
                    w.space = True
            if t.type[k] == "text":
                w.text(t.value[k], pre > 0)
            elif t.type[k] == "element":
                if skipped(t, k):
                    k = t.end[k] + 1
                    continue
                if t.ns[k] == "html":
                    name = t.name[k]
                    if skip_lists and name in ("ul", "ol") or skip_tables and name == "table":
                        w.boundary()
                        k = t.end[k] + 1
                        continue
                    if name == "br":
                        w.br()
                    elif name in BLOCKS or name in PRE:
                        w.boundary()
                        p = name in PRE
                        pre += p
                        ends.append((t.end[k], True, p))
                    elif name in ("td", "th"):
                        w.space = True
                        ends.append((t.end[k], False, False))
            k += 1
    s = "".join(w.out)
    if trim:
        return s.strip(WS)
    return s + " " if w.space and w.seen and not w.hard else s
