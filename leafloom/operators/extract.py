"""Extraction: what pages hold, as rows. Rules that walk a page's tree run in Arrow batches; the rest is native.

Every operator takes pages that are still to be parsed, or a set of their nodes, and then parses and reads each page in one pass; it
takes parsed pages too. Extraction starts from nodes: links, tables and so on among the given nodes and below them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafloom.errors import InputError
from leafloom.functions.columns import raw_attr, resolve
from leafloom.kernel import structure
from leafloom.kernel.flat import Tree
from leafloom.kernel.markdown import markdown as _markdown
from leafloom.kernel.selectors import Matcher, parse_selector
from leafloom.kernel.serialize import dump
from leafloom.kernel.serialize import serialize as _serialize
from leafloom.kernel.tables import cells, convert, outermost, table
from leafloom.kernel.text import clean
from leafloom.kernel.text import strings as _strings
from leafloom.kernel.text import text as _text
from leafloom.limits import Limits
from leafloom.operators import nodes as N
from leafloom.operators.sets import Nodes, walk
from leafloom.sources.pages import Gather, Pages

KEY = N.KEY
_NEEDED = ("parent", "subtree_end", "type", "ns", "name", "value", "attrs")
#: What operators take: parsed pages (a DataFrame), pages still to be parsed, or a set of nodes of these.
Source = DataFrame | Pages | Nodes


def trees(pages: pa.ListArray, fragments: list[bool], bases: list[str | None]) -> Iterator[Tree]:
    """The trees of pages' nodes, read column by column."""
    flat, starts = pages.flatten(), [0]
    for n in pages.value_lengths().to_pylist():
        starts.append(starts[-1] + (n or 0))
    column = {f.name: flat.field(f.name).to_pylist() for f in flat.type if f.name != "attrs"}
    attrs = flat.field("attrs")
    inner, ends = attrs.flatten(), [0]
    for n in attrs.value_lengths().to_pylist():
        ends.append(ends[-1] + (n or 0))
    parts = list(zip(*(inner.field(i).to_pylist() for i in range(3)), strict=True))
    for a, b, f, base in zip(starts, starts[1:], fragments, bases, strict=False):
        get = lambda c, a=a, b=b: column[c][a:b]
        yield Tree(get("type"), get("ns"), get("name"), get("value"), [-1 if p is None else p for p in get("parent")], get("subtree_end"), [parts[ends[i] : ends[i + 1]] for i in range(a, b)], f, base)


def over_pages(docs: Source, fn: Callable[[Tree, list[int | None]], Iterable[tuple]], schema: str, key: str = KEY, at: DataFrame | None = None) -> DataFrame:
    """The page's key and the rows that `fn` yields for its tree and nodes: those of a set, else the document node. Pages with an error
    yield none. schema: of the rows.

    Pages that are to be parsed, and sets of their nodes, are parsed and read in one pass. at: of parsed pages, nodes (key, id) to
    start from, which are gathered by page and joined to it; pages without any are left out."""
    kinds = T._parse_datatype_string(schema)
    if isinstance(docs, Nodes):
        steps = docs.steps
        return docs.pages.each(lambda t: fn(t, walk(steps, Matcher(t))), kinds)
    if isinstance(docs, Pages):
        return docs.each(lambda t: fn(t, [0]), kinds)
    kept = F.transform("nodes", lambda n: F.struct(*(n[c].alias(c) for c in _NEEDED)))
    slim = docs.where("nodes IS NOT NULL").select(key, (F.col("type") == "fragment").alias("f"), F.col("base_url").alias("b"), kept.alias("n"))
    if at is not None:
        ids = at.where(F.col("id").isNotNull()).groupBy(F.col(key).alias("at_key")).agg(F.array_sort(F.collect_set("id")).alias("at"))
        slim = slim.join(ids, F.col(key) == F.col("at_key")).drop("at_key")
    out = T.StructType([docs.schema[key], *kinds.fields])
    given = at is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = Gather(out)
        for b in batches:
            starts = b.column("at").to_pylist() if given else [[0]] * b.num_rows
            for k, t, ids in zip(b.column(key).to_pylist(), trees(b.column("n"), b.column("f").to_pylist(), b.column("b").to_pylist()), starts, strict=True):
                yield from gather.add((k,), fn(t, ids))
        yield from gather.rest()

    return slim.mapInArrow(run, out)


def values(docs: Source, fn: Callable[[Tree, int], object], kind: str, css: str | None = None, key: str = KEY, into: str = "value", at: DataFrame | None = None) -> DataFrame:
    """key, id and fn(tree, node) of the nodes that match `css` below the given ones; of the given ones without a selector, in their order, null
    for a missing one."""
    selector = parse_selector(css) if css else None

    def run(t: Tree, ids: list[int | None]) -> Iterable[tuple]:
        if selector:
            m = Matcher(t)
            ids = m.select(selector) if ids == [0] else sorted({x for i in ids if i is not None for x in m.select(selector, i)})
        for i in ids:
            yield i, None if i is None else fn(t, i)

    return over_pages(docs, run, f"id int, {into} {kind}", key, at)


def text(docs: Source, css: str | None = None, recursive: bool = True, key: str = KEY, at: DataFrame | None = None) -> DataFrame:
    """All text in each node, without separators."""
    return values(docs, lambda t, i: _text(t, i, recursive), "string", css, key, "text", at)


def text_clean(docs: Source, css: str | None = None, trim: bool = True, nbsp: bool = True, key: str = KEY, at: DataFrame | None = None) -> DataFrame:
    """Text as readers see it."""
    if not isinstance(trim, bool) or not isinstance(nbsp, bool):
        raise InputError("trim and nbsp must be true or false", "trim")
    return values(docs, lambda t, i: clean(t, i, trim, nbsp), "string", css, key, "text", at)


def strings(docs: Source, css: str | None = None, trim: bool = True, drop_empty: bool = True, key: str = KEY, at: DataFrame | None = None) -> DataFrame:
    """The pieces of text in each node."""
    return values(docs, lambda t, i: _strings(t, i, trim, drop_empty), "array<string>", css, key, "strings", at)


def markdown(docs: Source, css: str | None = None, key: str = KEY, at: DataFrame | None = None) -> DataFrame:
    """Markdown of each page or of the nodes that match."""
    return values(docs, lambda t, i: _markdown(t, i), "string", css, key, "markdown", at)


def serialize(docs: Source, css: str | None = None, outer: bool = True, pretty: bool = False, key: str = KEY, at: DataFrame | None = None) -> DataFrame:
    """Markup of each page or of the nodes that match."""
    return values(docs, lambda t, i: _serialize(t, i, outer, pretty), "string", css, key, "markup", at)


def tree_dump(docs: Source, key: str = KEY, at: DataFrame | None = None) -> DataFrame:
    """The tree below each page or node, a line a node, in the notation of the public tree-construction tests."""
    return values(docs, dump, "string", None, key, "tree", at)


# -- tables ----------------------------------------------------------------------------------------------------------------------


def _tables(t: Tree, selector, ids: list[int | None]) -> list[int]:
    return outermost(t, [i for i in Matcher(t).including(selector, ids) if t.is_html(i, "table")])


def tables(docs: Source, css: str = "table", match: str | None = None, header="auto", trim: bool = True, na: tuple[str, ...] = (), convert_types: bool = False, decimal: str = ".", thousands: str | None = None, limits: Limits | None = None, key: str = KEY, at: DataFrame | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Outermost tables in long form: table_no and row_no from 1, col_no, name, value, col_type. match: a regular expression on the
    table's text. columns: only those of these names are converted and leave the page's task. A table whose cells overlap, or that has
    too many, gives one row with `error`."""
    import re

    try:
        want = re.compile(match) if match is not None else None
    except (re.error, TypeError):
        raise InputError("match must be a regular expression", "match") from None
    convert(["1"], decimal, thousands)  # checks the marks
    selector, most, missing = parse_selector(css), (limits or Limits()).max_table_cells, frozenset(na)

    def run(t: Tree, ids: list[int | None]) -> Iterable[tuple]:
        no = 0
        for i in _tables(t, selector, ids):
            if want and not want.search(clean(t, i) or ""):
                continue
            no += 1
            try:
                names, body = table(t, i, header, trim, most)
            except ValueError as e:
                yield (no, i, None, None, None, None, None, None, None, str(e))
                continue
            if missing:
                body = [[None if v in missing else v for v in row] for row in body]
            held = []
            for x, name in enumerate(names):
                if columns is not None and name not in columns:
                    continue
                column = [row[x] for row in body]
                kind, v = convert(column, decimal, thousands) if convert_types else ("character", column)
                numbers = [None if n is None else float(n) for n in v] if kind in ("integer", "double") else [None] * len(v)
                held.append((x + 1, name, kind, column, numbers, v if kind == "logical" else [None] * len(v)))
            for r in range(len(body)):
                for x, name, kind, column, numbers, flags in held:
                    yield (no, i, r + 1, x, name, column[r], kind, numbers[r], flags[r], None)

    return over_pages(docs, run, "table_no int, id int, row_no int, col_no int, name string, value string, col_type string, number double, flag boolean, error string", key, at)


def table_cells(docs: Source, css: str = "table", trim: bool = True, absolute: bool = False, limits: Limits | None = None, key: str = KEY, at: DataFrame | None = None) -> DataFrame:
    """A row for each cell of the outermost tables, with spans, section, header, text and links."""
    selector, most = parse_selector(css), (limits or Limits()).max_table_cells
    names = ("row", "column", "rowspan", "colspan", "section", "header", "text", "links")

    def run(t: Tree, ids: list[int | None]) -> Iterable[tuple]:
        for no, i in enumerate(_tables(t, selector, ids), 1):
            try:
                for c in cells(t, i, trim, absolute, most):
                    yield (no, *(c[n] for n in names), None)
            except ValueError as e:
                yield (no, *[None] * len(names), str(e))

    return over_pages(docs, run, "table_no int, row int, `column` int, rowspan int, colspan int, section string, header boolean, text string, links array<string>, error string", key, at)


# -- lists, forms, metadata ----------------------------------------------------------------------------------------------------------


def lists(docs: Source, css: str = "ul, ol", mode: str = "text", key: str = KEY, at: DataFrame | None = None) -> DataFrame:
    """Items of outermost lists. mode text: direct items without nested lists; tree: items of nested lists too, by path."""
    if mode not in ("text", "tree"):
        raise InputError("mode must be text or tree", "mode")
    selector = parse_selector(css)
    names = ("path", "depth", "item_no", "type", "text")

    def run(t: Tree, ids: list[int | None]) -> Iterable[tuple]:
        for no, i in enumerate(outermost(t, [i for i in Matcher(t).including(selector, ids) if t.is_html(i, "ul", "ol")]), 1):
            for r in structure.list_rows(t, i):
                if mode == "tree" or not r["depth"]:
                    yield (no, i, *(r[n] for n in names))

    return over_pages(docs, run, "list_no int, id int, path string, depth int, item_no int, type string, text string", key, at)


_OPTIONS = "array<struct<value: string, label: string, selected: boolean, disabled: boolean>>"
_FIELD = ("name", "type", "value", "checked", "disabled", "options")
_FIELD_TYPES = f"name: string, type: string, value: string, checked: boolean, disabled: boolean, options: {_OPTIONS}"


def forms(docs: Source, key: str = KEY, at: DataFrame | None = None) -> DataFrame:
    """A row for each form, with its fields."""
    names = ("form", "node", "action", "method", "enctype", "id", "name", "fields")

    def run(t: Tree, ids: list[int | None]) -> Iterable[tuple]:
        for f in structure.forms(t, ids):
            yield tuple(f[n] for n in names)

    return over_pages(docs, run, f"form int, node int, action string, method string, enctype string, id string, name string, fields array<struct<{_FIELD_TYPES}>>", key, at)


def form_fields(docs: Source, key: str = KEY, at: DataFrame | None = None) -> DataFrame:
    """A row for each field of each form."""

    def run(t: Tree, ids: list[int | None]) -> Iterable[tuple]:
        for f in structure.forms(t, ids):
            for n, x in enumerate(f["fields"], 1):
                yield (f["form"], n, *(x[c] for c in _FIELD))

    return over_pages(docs, run, f"form int, field int, {_FIELD_TYPES.replace(': string', ' string').replace(': boolean', ' boolean').replace('options: ', 'options ')}", key, at)


def microdata(docs: Source, key: str = KEY, at: DataFrame | None = None) -> DataFrame:
    """A row for each value of each property of each item."""
    names = ("item", "type", "id", "property", "ord", "value", "child")

    def run(t: Tree, ids: list[int | None]) -> Iterable[tuple]:
        for r in structure.microdata(t, ids):
            yield tuple(r[n] for n in names)

    return over_pages(docs, run, "item string, type array<string>, id string, property string, ord int, value string, child string", key, at)


def json_ld(docs: Source, key: str = KEY, at: DataFrame | None = None) -> DataFrame:
    """The text of each JSON-LD script, and what it parses to as VARIANT (null where it is no JSON)."""

    def run(t: Tree, ids: list[int | None]) -> Iterable[tuple]:
        for n, s in enumerate(structure.json_ld(t, ids), 1):
            yield n, s, structure.unwrap_json(s)

    return over_pages(docs, run, "n int, text string, inner string", key, at).withColumn("json", F.try_parse_json("inner")).drop("inner")


def title(docs: Source, key: str = KEY) -> DataFrame:
    """The first HTML title of each page, squeezed; null without one."""
    return over_pages(docs, lambda t, ids: [(structure.title(t),)], "title string", key)


def meta(docs: Source, key: str = KEY, at: DataFrame | None = None) -> DataFrame:
    """A row for each <meta>: name, property, http_equiv, charset, content. Elements of that name count in any namespace."""
    selector, names = parse_selector("meta"), ("name", "property", "http-equiv", "charset", "content")

    def run(t: Tree, ids: list[int | None]) -> Iterable[tuple]:
        for i in Matcher(t).including(selector, ids):
            yield (i, *(t.attr(i, n) for n in names))

    return over_pages(docs, run, "id int, name string, property string, http_equiv string, charset string, content string", key, at)


def links(docs: Source, absolute: bool = False, key: str = KEY, at: DataFrame | None = None) -> DataFrame:
    """Every a[href] and area[href] among the nodes and below, with its text, href and resolved URL."""
    selector = parse_selector("a[href], area[href]")

    def run(t: Tree, ids: list[int | None]) -> Iterable[tuple]:
        for i in Matcher(t).including(selector, ids):
            yield i, clean(t, i), t.attr(i, "href"), t.base

    found = over_pages(docs, run, "id int, text string, href string, b string", key, at)
    url = resolve(F.col("href"), F.col("b"))
    out = found.withColumn("url", url).drop("b")
    return out.withColumn("href", F.coalesce("url", "href")) if absolute else out


def urls(docs: Nodes, name: str = "href", base_url: str | None = None) -> DataFrame:
    """Aligned: id and the URL that an attribute of each node resolves to."""
    found = over_pages(docs, lambda t, ids: [(i, None if i is None else t.attr(i, name), base_url or t.base) for i in ids], "id int, value string, b string")
    return found.withColumn("url", resolve(F.col("value"), F.col("b"))).drop("value", "b")


def url(some: DataFrame, docs: DataFrame, name: str = "href", base_url: str | None = None, key: str = KEY) -> DataFrame:
    """Aligned: nodes with the URL that their attribute resolves to."""
    bases = docs.select(F.col(key).alias("b_key"), F.col("resolved_base").alias("_b"))
    joined = some.join(bases, F.col(key) == F.col("b_key"), "left").drop("b_key")
    return joined.withColumn("url", resolve(raw_attr(name), F.lit(base_url) if base_url else F.col("_b"))).drop("_b")


def problems(docs: DataFrame, key: str = KEY) -> DataFrame:
    """A row for each problem that the parser repaired."""
    return docs.select(key, "problems_truncated", F.explode("problems").alias("p")).select(key, "p.*", "problems_truncated")


def info(docs: DataFrame, key: str = KEY) -> DataFrame:
    """What a page's parse found, without its nodes."""
    return docs.select(key, "type", "context", "n_nodes", "n_attrs", "input_bytes", "encoding", "encoding_source", "base_url", "quirks_mode", "n_problems", "problems_truncated", "error")


def engine_info() -> dict:
    """The library's version and two self-tests."""
    from leafloom import __version__
    from leafloom.kernel.flat import parse_html

    t = parse_html("<p>a<p>b")
    return {"version": __version__, "parses": [t.name[k] for k in t.below(0) if t.type[k] == "element"] == ["html", "head", "body", "p", "p"], "selects": len(Matcher(t).select(parse_selector("p + p"))) == 1}


def wide(long: DataFrame, names: list[str], key: str = KEY) -> DataFrame:
    """A table in long form with a column for each of `names`."""
    return long.groupBy(key, "table_no", "row_no").agg(*(F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names))

