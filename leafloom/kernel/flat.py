"""A parsed page as flat columns: nodes in document order, numbered from 0, the descendants of n being n + 1 to end[n]."""

from __future__ import annotations

from leafloom.kernel.tree import Builder, Node, parse_tree
from leafloom.kernel.urls import document_base
from leafloom.limits import Limits

URI = {"html": "http://www.w3.org/1999/xhtml", "svg": "http://www.w3.org/2000/svg", "math": "http://www.w3.org/1998/Math/MathML"}


class Tree:
    """Columns over nodes: type, ns, name, value, parent, end, attrs (list of (ns, name, value)); kids are found once."""

    __slots__ = ("_base", "_columns", "_ids", "_like", "_templates", "attrs", "base_url", "doctype", "end", "is_fragment", "kids", "max_selector_tests", "name", "ns", "parent", "type", "value")

    def __init__(self, types, ns, name, value, parent, end, attrs, is_fragment: bool = False, base_url: str | None = None):
        self.type, self.ns, self.name, self.value, self.parent, self.end, self.attrs = types, ns, name, value, parent, end, attrs
        self.is_fragment, self.base_url = is_fragment, base_url
        self.doctype: tuple[str | None, str | None] = (None, None)
        self.max_selector_tests = Limits.max_selector_tests
        self._base: list | None = None
        self._columns: dict | None = None
        self._ids: dict[str, int] | None = None
        self._like: Tree | None = None  # a tree of the same shape, with other text and values
        self._templates: list[int] | None = None
        self.kids: list[list[int]] = [[] for _ in types]
        for i in range(1, len(types)):
            self.kids[parent[i]].append(i)

    @property
    def base(self) -> str | None:
        """What references resolve against: the first HTML <base href>, resolved against the page's own URL; else that URL."""
        if self._base is None:
            plain = self._like is not None and "base" not in self.name
            self._base = [self.base_url if plain else document_base(self, self.base_url)]
        return self._base[0]

    @property
    def root(self) -> int | None:
        """The html element; none in a fragment."""
        return None if self.is_fragment else next((k for k in self.kids[0] if self.type[k] == "element"), None)

    def by_id(self, name: str) -> int | None:
        """The first element outside templates with exactly that id."""
        if self._ids is None:
            self._ids = {}
            for k in self.visible(0):
                if self.type[k] == "element" and (v := self.attr(k, "id")) is not None:
                    self._ids.setdefault(v, k)
        return self._ids.get(name) if name else None

    def visible(self, i: int):
        """Nodes below i that are in no template below it; of a template itself, none."""
        if i and self.is_html(i, "template"):
            return
        k = i + 1
        while k <= self.end[i]:
            yield k
            k = self.end[k] + 1 if self.is_html(k, "template") else k + 1

    def reach(self, at: list[int | None]) -> list[int]:
        """The nodes of `at` and what is visible below them, in document order."""
        if at == [0]:
            return [0, *self.visible(0)]
        out: set[int] = set()
        for i in at:
            if i is not None and i not in out:
                out.add(i)
                out.update(self.visible(i))
        return sorted(out)

    def is_html(self, i: int, *names: str) -> bool:
        return self.type[i] == "element" and self.ns[i] == "html" and (not names or self.name[i] in names)

    def attr(self, i: int, name: str, ns: str = "") -> str | None:
        return next((v for n, k, v in self.attrs[i] if k == name and n == ns), None)

    def below(self, i: int) -> range:
        return range(i + 1, self.end[i] + 1)

    def ancestors(self, i: int):
        while (i := self.parent[i]) > 0:
            yield i

    def templates(self) -> list[int]:
        """For each node its nearest ancestor <template>, -1 if there is none."""
        if self._like is not None:
            return self._like.templates()
        if self._templates is None:
            self._templates = self._inside()
        return self._templates

    def _inside(self) -> list[int]:
        out = [-1] * len(self.type)
        for i in range(1, len(out)):
            p = self.parent[i]
            out[i] = p if self.is_html(p, "template") else out[p]
        return out

    def columns(self) -> dict[str, list]:
        """The fields of NODE (see leafloom.schema), a list over nodes each."""
        if self._columns is None:
            self._columns = self._filled() if self._like is None else {**self._like.columns(), "value": self.value, "attrs": self.attrs}
        return self._columns

    def _filled(self) -> dict[str, list]:
        n, inside = len(self.type), self.templates()
        none = lambda: [None] * n
        depth, first, next_sib, prev_sib, next_elem, prev_elem, pos, count, elems, texts = [0] * n, none(), none(), none(), none(), none(), none(), none(), [0] * n, [0] * n
        kind = self.type
        for i in range(n):
            kids = self.kids[i]
            if not kids:
                continue
            first[i] = kids[0]
            d, before, last, e = depth[i] + 1, None, None, []
            for k in kids:
                depth[k], prev_elem[k], prev_sib[k] = d, last, before
                if before is not None:
                    next_sib[before] = k
                before = k
                if kind[k] == "element":
                    last = k
                    e.append(k)
                elif kind[k] == "text":
                    texts[i] += 1
            elems[i] = len(e)
            for p, k in enumerate(e, 1):
                pos[k], count[k] = p, len(e)
            last = None
            for k in reversed(kids):
                next_elem[k] = last
                if kind[k] == "element":
                    last = k
        return {
            "id": list(range(n)), "parent": [None, *self.parent[1:]], "subtree_end": self.end, "depth": depth, "first_child": first, "next_sib": next_sib, "prev_sib": prev_sib, "next_elem": next_elem, "prev_elem": prev_elem, "elem_pos": pos, "elem_count": count,
            "n_elem_children": elems, "n_text_children": texts, "type": kind, "ns": self.ns, "name": self.name, "value": self.value, "is_template": [self.is_html(i, "template") for i in range(n)], "in_template_of": [t if t >= 0 else None for t in inside], "attrs": self.attrs,
        }

    def rows(self) -> list[dict]:
        """The nodes as structs of NODE."""
        c = dict(self.columns())
        c["attrs"] = [[{"ns": a, "name": b, "value": v} for a, b, v in x] for x in self.attrs]
        return [dict(zip(c, r, strict=True)) for r in zip(*c.values(), strict=True)]


def freeze(b: Builder) -> Tree:
    """The builder's tree; a fragment's root is its document node."""
    root = b.doc
    if b.context is not None:
        html = b.doc.children[0]
        root = Node("fragment")
        root.children = html.children
    types, ns, name, value, parent, end, attrs = [], [], [], [], [], [], []
    todo: list = [(root, -1)]
    while todo:
        node, up = todo.pop()
        if node is None:
            end[up] = len(types) - 1
            continue
        i = len(types)
        types.append(node.kind)
        ns.append(node.ns)
        name.append(node.name)
        value.append(node.value)
        parent.append(up)
        end.append(i)
        attrs.append(node.attrs)
        if node.children:
            todo.append((None, i))
            todo.extend((c, i) for c in reversed(node.children) if c.kind != "gap")
    t = Tree(types, ns, name, value, parent, end, attrs, b.context is not None)
    t.doctype = b.public, b.system
    return t


def parse_html(text: str, limits: Limits | None = None, context: str | None = None, comments: bool = True, base_url: str | None = None) -> Tree:
    """The tree of a page, or of a fragment in a context element such as "div" or "svg path"."""
    where = None
    if context is not None:
        parts = context.split()
        where = (parts[0], parts[1]) if len(parts) == 2 else ("html", parts[0])
    t = freeze(parse_tree(text, limits, where, comments))
    t.base_url, t.max_selector_tests = base_url, (limits or Limits()).max_selector_tests
    return t
