"""Trees of pages that share a shape: pages that differ in their text and in values of attributes alone have the same nodes, so that the tree
builder reads one of them and the others fill in their own text and values.

What is left of a page without its text and values is its outline. It keeps every name, the white space around text, which values are equal
(formatting elements are told apart by them), and the values of `type` and `encoding`, as these are all that the tree builder looks at. A page
whose markup is not plain (references, NUL, stray < or >, odd attributes) has no outline, and an outline whose text does not come out whole has
no shape: such pages are parsed as they are. An outline gets its shape when it is seen for the second time.
"""

from __future__ import annotations

import re

from leafloom.errors import LimitError
from leafloom.kernel.flat import Tree, freeze
from leafloom.kernel.tokenizer import preprocess
from leafloom.kernel.tree import parse_tree
from leafloom.limits import Limits

#: Characters of a page that may have an outline, and of all outlines that a process keeps with their shapes.
LONGEST, ROOM = 4_096, 1 << 18
#: Outlines seen once, and tags, that a process remembers.
SEEN, TAGS = 8_192, 4_096
_PIECES = re.compile(r"(<[^<>]*>)")
_VALUE = r"""(?:"[^"]*"|'[^']*'|[^\t\n\f >"'=<`]+)"""
_TAG = re.compile(rf"""</?[A-Za-z][^\t\n\f />"'=<`]*(?:[\t\n\f ]+[^\t\n\f />"'=<`]+(?:={_VALUE})?)*[\t\n\f ]*/?>""")
_OTHER = re.compile(r"<!--[^<>]*-->|<![Dd][Oo][Cc][Tt][Yy][Pp][Ee] [Hh][Tt][Mm][Ll]>")
_GIVEN = re.compile(r"""([^\t\n\f />"'=<`]+)=(?:"([^"]*)"|'([^']*)'|([^\t\n\f >"'=<`]+))""")
OPEN, SHUT = "\ue000", "\ue001"
_MARK = re.compile(f"{OPEN}([0-9]+){SHUT}")
_WS = "\t\n\f "

_tags: dict[str, tuple[list[str], list[str]] | None] = {}


def _tag(s: str) -> tuple[list[str], list[str]] | None:
    """What stands around and between the values of a plain tag, and the values; None for another tag."""
    if s in _tags:
        return _tags[s]
    out = None
    if _OTHER.fullmatch(s):
        out = [s], []
    elif _TAG.fullmatch(s):
        around, values, last = [], [], 0
        for m in _GIVEN.finditer(s):
            if m[1].lower() not in ("type", "encoding"):
                k = m.lastindex
                around.append(s[last : m.start(k)])
                values.append(m[k])
                last = m.end(k)
        out = [*around, s[last:]], values
    if len(_tags) >= TAGS:
        _tags.clear()
    _tags[s] = out
    return out


def outline(s: str) -> tuple[list[str | int], list[str]] | None:
    """A page's outline, in which numbers from 0 stand for values and those below 0 (-1 - number) for text, and what they stand for."""
    if "&" in s or "\0" in s or OPEN in s:
        return None
    pieces = _PIECES.split(s)
    n = len(pieces) >> 1
    if s.count("<") != n or s.count(">") != n:
        return None
    out: list[str | int] = []
    held: list[str] = []
    numbers: dict[str, int] = {}
    markup = False
    for x in pieces:
        if markup:
            parts = _tag(x)
            if parts is None:
                return None
            if parts[1]:
                for around, v in zip(*parts, strict=False):
                    k = numbers.get(v)
                    if k is None:
                        k = numbers[v] = len(held)
                        held.append(v)
                    out += around, k
                out.append(parts[0][-1])
            else:
                out.append(x)
        elif x:
            text = x.strip(_WS)
            if len(text) == len(x):
                out.append(-1 - len(held))
                held.append(x)
            elif text:
                at = x.index(text)
                out += x[:at], -1 - len(held), x[at + len(text) :]
                held.append(text)
            else:
                out.append(x)
        markup = not markup
    return out, held


def _parts(s: str) -> list[str | int] | None:
    """`s` with numbers where marks are; None without any."""
    if OPEN not in s:
        return None
    found = _MARK.split(s)
    return [int(x) if i & 1 else x for i, x in enumerate(found) if i & 1 or x]


def _fill(parts: list[str | int], held: list[str]) -> str:
    return held[parts[0]] if len(parts) == 1 else "".join([held[x] if type(x) is int else x for x in parts])


class Shape:
    """A tree without its text and values."""

    __slots__ = ("attrs", "given", "texts", "tree")

    def __init__(self, t: Tree):
        self.tree = t
        self.texts = [(i, p) for i, v in enumerate(t.value) if v and (p := _parts(v))]
        self.given = [(i, [(ns, name, _parts(v) or [v]) for ns, name, v in a]) for i, a in enumerate(t.attrs) if any(OPEN in v for _, _, v in a)]

    def slots(self) -> set[int]:
        return {x for _, parts in self.texts for x in parts if type(x) is int}

    def filled(self, held: list[str]) -> Tree:
        t, own = self.tree, Tree.__new__(Tree)
        value, attrs = t.value.copy(), t.attrs.copy()
        for i, p in self.texts:
            value[i] = _fill(p, held)
        for i, a in self.given:
            attrs[i] = [(ns, name, "".join([held[x] if type(x) is int else x for x in p])) for ns, name, p in a]
        own.type, own.ns, own.name, own.parent, own.end, own.kids, own.value, own.attrs = t.type, t.ns, t.name, t.parent, t.end, t.kids, value, attrs
        own.is_fragment, own.doctype, own._base, own._columns, own._ids, own._like = t.is_fragment, t.doctype, None, None, None, t
        return own


class Shapes:
    """The shapes of pages that are parsed alike."""

    def __init__(self, limits: Limits, context: tuple[str, str] | None, comments: bool):
        self.how = limits, context, comments
        self.known: dict[tuple, Shape | None] = {}
        self.seen: set[int] = set()
        self.size = 0

    def tree(self, text: str) -> Tree:
        """The tree of `text`, as the tree builder has it."""
        s = preprocess(text)
        told = outline(s) if len(s) <= LONGEST else None
        if told is None:
            return freeze(parse_tree(s, *self.how))
        key = tuple(told[0])
        if key not in self.known:
            mark = hash(key)
            if mark not in self.seen:
                if len(self.seen) >= SEEN:
                    self.seen.clear()
                self.seen.add(mark)
                return freeze(parse_tree(s, *self.how))
            self.size += len(s)
            if self.size > ROOM:
                self.known.clear()
                self.size = len(s)
            self.known[key] = self._shape(told[0])
        shape = self.known[key]
        return freeze(parse_tree(s, *self.how)) if shape is None else shape.filled(told[1])

    def _shape(self, parts: list[str | int]) -> Shape | None:
        marked = "".join([x if type(x) is str else f"{OPEN}{x if x >= 0 else -1 - x}{SHUT}" for x in parts])
        try:
            shape = Shape(freeze(parse_tree(marked, *self.how)))
        except LimitError:
            return None
        return shape if shape.slots() >= {-1 - x for x in parts if type(x) is int and x < 0} else None


_kept: dict[tuple, Shapes] = {}


def shapes(limits: Limits, context: tuple[str, str] | None = None, comments: bool = True) -> Shapes:
    """What this process knows of pages that are parsed so."""
    how = limits, context, comments
    if how not in _kept:
        if len(_kept) >= 4:
            _kept.clear()
        _kept[how] = Shapes(*how)
    return _kept[how]
