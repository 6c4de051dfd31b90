"""Sets of nodes that are told by steps from each page's tree, and found where the page is parsed.

`find(pages, css)` starts a set; further steps lead from node to node. Nothing runs until `rows`, or an operator of `extract` that
gets the set, makes one pass over the pages: no node leaves its page's task, and nothing is joined or shuffled. Nodes that are
rows already (a table of nodes) are searched by joins instead, see `nodes`.

A set keeps its order. Steps are aligned (one answer a node, missing where there is none) or give sets (no duplicates, document order).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from itertools import filterfalse

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from leafloom.errors import InputError
from leafloom.kernel.flat import Tree
from leafloom.kernel.selectors import Matcher, parse_selector
from leafloom.kernel.tables import outermost
from leafloom.schema import NODE
from leafloom.sources.pages import Pages

Ids = list  # of node numbers; None where a node is missing
Step = Callable[[Matcher, Ids], Ids]
#: Columns of nodes that `rows` gives unless others are named. The others need a walk over the whole page.
PLAIN = ("id", "parent", "subtree_end", "type", "ns", "name", "value", "attrs")


def _fields() -> dict[str, T.StructField]:
    return {f.name: f for f in T._parse_datatype_string(f"n {NODE}")["n"].dataType.fields}


def _set(ids: Iterable[int | None]) -> Ids:
    return sorted({i for i in ids if i is not None})


def _each(fn: Callable[[Tree, int], int | None]) -> Step:
    return lambda m, ids: [None if i is None else fn(m.t, i) for i in ids]


def walk(steps: tuple[Step, ...], m: Matcher, ids: Ids | None = None) -> Ids:
    """Where the steps lead on one page, from the document node unless other nodes are given."""
    ids = [0] if ids is None else ids
    for s in steps:
        ids = s(m, ids)
    return ids


@dataclass(frozen=True)
class Nodes:
    pages: Pages
    steps: tuple[Step, ...] = ()

    def then(self, step: Step) -> Nodes:
        return replace(self, steps=(*self.steps, step))

    # -- searches ------------------------------------------------------------------------------------------------------------

    def elements(self, css: str) -> Nodes:
        """Set: matches below any node; the node itself where the subject has :scope."""
        selector = parse_selector(css)
        return self.then(lambda m, ids: m.select(selector) if ids == [0] else _set(x for i in dict.fromkeys(ids) if i is not None for x in m.select(selector, i)))

    def element(self, css: str) -> Nodes:
        """Aligned: the first match below each node."""
        selector = parse_selector(css)
        return self.then(lambda m, ids: [None if i is None else next(iter(m.select(selector, i)), None) for i in ids])

    def including(self, css: str) -> Nodes:
        """Set: matches among the nodes and below them."""
        selector = parse_selector(css)
        return self.then(lambda m, ids: m.including(selector, ids))

    def where(self, css: str) -> Nodes:
        """The nodes that match, in their order, duplicates too."""
        selector = parse_selector(css)
        return self.then(lambda m, ids: [i for i in ids if i is not None and m.matches(selector, i, i)])

    def closest(self, css: str) -> Nodes:
        """Aligned: the nearest match among each node and its ancestors."""
        selector = parse_selector(css)
        return self.then(lambda m, ids: [m.closest(selector, i) for i in ids])

    # -- navigation ----------------------------------------------------------------------------------------------------------

    def parent(self) -> Nodes:
        return self.then(_each(lambda t, i: t.parent[i] if i else None))

    def children(self, elements_only: bool = True) -> Nodes:
        """Set: children; a template's contents are not its children."""
        return self.then(lambda m, ids: _set(k for i in ids if i is not None and not m.t.is_html(i, "template") for k in m.t.kids[i] if not elements_only or m.t.type[k] == "element"))

    def template_content(self, elements_only: bool = True) -> Nodes:
        """Set: what templates hold."""
        return self.then(lambda m, ids: _set(k for i in ids if i is not None and m.t.is_html(i, "template") for k in m.t.kids[i] if not elements_only or m.t.type[k] == "element"))

    def ancestors(self) -> Nodes:
        """Set: all elements around, without the document node."""
        return self.then(lambda m, ids: _set(a for i in ids if i is not None for a in m.t.ancestors(i)))

    def sibling(self, forward: bool = True, elements_only: bool = True) -> Nodes:
        """Aligned: the next or the previous sibling."""
        name = ("next" if forward else "prev") + ("_elem" if elements_only else "_sib")
        return self.then(_each(lambda t, i: t.columns()[name][i]))

    def root(self) -> Nodes:
        """The html element of each page; missing in a fragment."""
        return replace(self, steps=(lambda m, ids: [m.t.root],))

    def document(self) -> Nodes:
        return replace(self, steps=())

    # -- order and sets --------------------------------------------------------------------------------------------------------

    def outermost(self) -> Nodes:
        """Set: nodes that lie in no other one of the set."""
        return self.then(lambda m, ids: outermost(m.t, [i for i in ids if i is not None]))

    def at(self, *places: int) -> Nodes:
        """Aligned to `places`, from 1: the node there, missing beyond the end. Places below 0 leave nodes out."""
        if any(isinstance(p, bool) or not isinstance(p, int) or p == 0 for p in places) or (any(p < 0 for p in places) and any(p > 0 for p in places)):
            raise InputError("places are whole numbers, all from 1 on or all below 0", "places")
        if places and places[0] < 0:
            return self.then(lambda m, ids: [i for n, i in enumerate(ids, 1) if -n not in places])
        return self.then(lambda m, ids: [ids[p - 1] if p <= len(ids) else None for p in places])

    def length(self, n: int) -> Nodes:
        """The first `n` nodes, filled up with missing ones."""
        return self.then(lambda m, ids: [*ids[:n], *[None] * (n - len(ids))])

    def put(self, place: int, other: Nodes | None) -> Nodes:
        """With the node at `place` (from 1) replaced by the first of `other`, or by a missing one; filled up in between."""
        if isinstance(place, bool) or not isinstance(place, int) or place < 1:
            raise InputError("a place is a whole number from 1 on", "place")
        if other is not None and other.pages is not self.pages:
            raise InputError("both sets must be of the same pages", "other")
        steps = None if other is None else other.steps

        def step(m: Matcher, ids: Ids) -> Ids:
            out = [*ids, *[None] * (place - len(ids))]
            out[place - 1] = None if steps is None else next(iter(walk(steps, m)), None)
            return out

        return self.then(step)

    def unique(self) -> Nodes:
        return self.then(lambda m, ids: list(dict.fromkeys(ids)))

    def rep(self, times: int) -> Nodes:
        return self.then(lambda m, ids: list(ids) * times)

    def rev(self) -> Nodes:
        return self.then(lambda m, ids: ids[::-1])

    def sort(self) -> Nodes:
        """In document order, missing nodes last."""
        return self.then(lambda m, ids: sorted(ids, key=lambda i: (i is None, i or 0)))

    def _with(self, other: Nodes, fn: Callable[[Ids, Ids], Ids]) -> Nodes:
        if other.pages is not self.pages:
            raise InputError("both sets must be of the same pages", "other")
        steps = other.steps
        return self.then(lambda m, ids: fn(ids, walk(steps, m)))

    def concat(self, other: Nodes) -> Nodes:
        """Both one after the other, duplicates too."""
        return self._with(other, lambda a, b: [*a, *b])

    def union(self, other: Nodes) -> Nodes:
        return self._with(other, lambda a, b: list(dict.fromkeys([*a, *b])))

    def intersect(self, other: Nodes) -> Nodes:
        return self._with(other, lambda a, b: list(filter(set(b).__contains__, dict.fromkeys(a))))

    def difference(self, other: Nodes) -> Nodes:
        return self._with(other, lambda a, b: list(filterfalse(set(b).__contains__, dict.fromkeys(a))))

    # -- rows ------------------------------------------------------------------------------------------------------------------

    def rows(self, *columns: str, matches: dict[str, str] | None = None, **aligned: Nodes) -> DataFrame:
        """A row for each node: the page's key and kept columns, n (its place in the set, from 1) and its `columns` (PLAIN by default), null where
        it is missing.

        matches: a boolean column for each name, whether the node matches the selector. aligned: sets whose steps begin with this set's; each
        becomes a struct of the same columns, of the node at the same place."""
        names = columns or PLAIN
        known = _fields()
        if unknown := [c for c in names if c not in known]:
            raise InputError(f"nodes have no column {unknown[0]}", "columns")
        for other in aligned.values():
            if other.pages is not self.pages or other.steps[: len(self.steps)] != self.steps:
                raise InputError("an aligned set begins with the steps of this one", "aligned")
        fields = [T.StructField(c, known[c].dataType) for c in names]
        tests = {k: parse_selector(css) for k, css in (matches or {}).items()}
        schema = T.StructType([T.StructField("n", T.IntegerType()), *fields, *(T.StructField(k, T.BooleanType()) for k in tests), *(T.StructField(k, T.StructType(fields)) for k in aligned)])
        derived = any(c not in PLAIN for c in names)
        steps = self.steps
        rest = {k: other.steps[len(self.steps) :] for k, other in aligned.items()}

        def columns_of(t: Tree) -> list:
            if derived:
                all_columns = t.columns()
                return [all_columns[c] for c in names]
            plain = {"id": range(len(t.type)), "parent": [None, *t.parent[1:]], "subtree_end": t.end, "type": t.type, "ns": t.ns, "name": t.name, "value": t.value, "attrs": t.attrs}
            return [plain[c] for c in names]

        def run(t: Tree) -> Iterable[tuple]:
            m = Matcher(t)
            ids = walk(steps, m)
            if not ids:
                return
            held = columns_of(t)
            show = lambda i: [None] * len(held) if i is None else [c[i] for c in held]
            others = []
            for k, further in rest.items():
                got = walk(further, m, ids)
                if len(got) != len(ids):
                    raise InputError(f"{k} is not aligned with its set", "aligned")
                others.append(got)
            for n, i in enumerate(ids):
                hit = [None if i is None else m.matches(s, i, i) for s in tests.values()]
                yield (n + 1, *show(i), *hit, *(None if o[n] is None else tuple(show(o[n])) for o in others))

        return self.pages.each(run, schema)


def find(pages: Pages, css: str | None = None) -> Nodes:
    """The elements of each page that match; the document node without a selector."""
    return Nodes(pages) if css is None else Nodes(pages).elements(css)
