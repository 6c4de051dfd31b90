"""Pages as a source: parse a column of HTML once into nodes; read files of HTML.

A page that cannot be parsed (bytes that are not valid in its encoding, a limit reached, a null) follows Spark's reader modes:
PERMISSIVE keeps the row with `error` set and no nodes, DROPMALFORMED drops it, FAILFAST raises.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from leafloom.errors import InputError, PageError
from leafloom.kernel.decode import decode
from leafloom.kernel.flat import Tree, freeze
from leafloom.kernel.shapes import shapes
from leafloom.kernel.text import clean, text
from leafloom.kernel.tree import Builder, parse_tree
from leafloom.limits import Limits
from leafloom.schema import NODE, PAGE

DEFAULT = Limits()
MODES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")
#: Pages that a worker turns into one Arrow batch: nodes take many times the room of their markup.
BATCH_PAGES = 64
#: Pages that are read at once where no nodes are handed on, and rows that a worker gathers before it hands them on.
PLAIN_PAGES, BATCH_ROWS = 512, 4_000
#: Pages that one task parses, about: some seconds' work for small ones.
PAGES_A_TASK = 8_192
CONTEXT = re.compile(r"(?:(?:html|svg|math) )?[A-Za-z][A-Za-z0-9-]*")


def tree(data: str | bytes | None, encoding: str | None = None, base_url: str | None = None, context: str | None = None, comments: bool = True, limits: Limits | None = None) -> tuple[Tree, Builder, tuple[str, str, str]]:
    """The tree of one page, what the parser noted, and the page's text, encoding and where that was told."""
    limits = limits or Limits()
    decoded = decode(data, encoding, limits.max_input)
    b = parse_tree(decoded[0], limits, _where(context), comments)
    t = freeze(b)
    t.base_url, t.max_selector_tests = base_url, limits.max_selector_tests
    return t, b, decoded


def _where(context: str | None) -> tuple[str, str] | None:
    return None if context is None else (tuple(context.split()) if " " in context else ("html", context))


def nodes_of(data: str | bytes | None, encoding: str | None = None, base_url: str | None = None, context: str | None = None, comments: bool = True, limits: Limits | None = None) -> Tree:
    """The tree of one page alone, by way of other pages of its shape."""
    limits = limits or DEFAULT
    t = shapes(limits, _where(context), comments).tree(decode(data, encoding, limits.max_input)[0])
    t.base_url, t.max_selector_tests = base_url, limits.max_selector_tests
    return t


def page(data: str | bytes | None, encoding: str | None = None, base_url: str | None = None, context: str | None = None, comments: bool = True, limits: Limits | None = None) -> dict:
    """The columns of PAGE for one page; `nodes` is its tree."""
    out: dict = {"type": "document" if context is None else "fragment", "context": context, "root_id": None, "base_url": base_url, "error": None, "nodes": None}
    try:
        t, b, (text, out["encoding"], out["encoding_source"]) = tree(data, encoding, base_url, context, comments, limits)
    except PageError as e:
        f = e.fields()
        return out | {"error": {k: f.get(k) for k in ("kind", "message", "arg", "encoding", "limit", "maximum", "observed")}}
    out["root_id"] = t.root
    places = _places(text, b.problems)
    return out | {
        "resolved_base": t.base, "quirks_mode": b.quirks, "n_nodes": len(t.type), "n_attrs": sum(map(len, t.attrs)), "input_bytes": len(text.encode("utf-8", "surrogatepass")),
        "n_problems": len(b.problems), "problems_truncated": b.truncated, "problems": [{"stage": s, "code": c, "line": line, "column": col, "byte_offset": at} for (s, c, _), (line, col, at) in zip(b.problems, places, strict=True)], "nodes": t,
    }


def _places(text: str, problems: list[tuple[str, str, int]]) -> list[tuple[int, int, int]]:
    """Line and column from 1, and bytes from 0, of each problem."""
    if not problems:
        return []
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    out: dict[int, tuple[int, int, int]] = {}
    line, begin, size, last = 1, 0, 0, 0
    for at in sorted({p for _, _, p in problems}):
        piece = text[last:at]
        line += piece.count("\n")
        begin = last + piece.rindex("\n") + 1 if "\n" in piece else begin
        size += len(piece.encode("utf-8", "surrogatepass"))
        last = at
        out[at] = (line, at - begin + 1, size)
    return [out[p] for _, _, p in problems]


def _nodes(trees: list[Tree | None], kind: pa.ListType) -> pa.Array:
    """The pages' nodes as one Arrow array, made column by column."""
    columns = [t.columns() if t else None for t in trees]
    flat = {f.name: [v for c in columns if c for v in c[f.name]] for f in kind.value_type if f.name != "attrs"}
    attrs = [x for c in columns if c for x in c["attrs"]]
    held = [a for x in attrs for a in x]
    field = kind.value_type.field("attrs").type
    parts = pa.StructArray.from_arrays([pa.array([a[i] for a in held], pa.string()) for i in range(3)], fields=list(field.value_type))
    offsets = pa.array([0, *accumulate(map(len, attrs))], pa.int32())
    arrays = [pa.array(flat[f.name], f.type) if f.name != "attrs" else pa.ListArray.from_arrays(offsets, parts, type=field) for f in kind.value_type]
    sizes = [len(c["id"]) if c else 0 for c in columns]
    starts = [0, *accumulate(sizes)]
    mask = pa.array([c is None for c in columns])
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays(arrays, fields=list(kind.value_type)), type=kind, mask=mask)


@dataclass(frozen=True)
class Wanted:
    """Which nodes a question needs: elements of these names or with one of these attributes, and text below elements of `text_in`."""

    names: frozenset[str] = frozenset()
    attrs: frozenset[str] = frozenset()
    text_in: frozenset[str] = frozenset()

    def of(self, t: Tree) -> list[int]:
        out, reach = [], -1
        for i, kind in enumerate(t.type):
            if kind == "element":
                if t.name[i] in self.names or (self.attrs and any(a[1] in self.attrs for a in t.attrs[i])):
                    out.append(i)
                if t.name[i] in self.text_in and t.end[i] > reach:
                    reach = t.end[i]
            elif kind == "text" and i <= reach:
                out.append(i)
        return out


@dataclass(frozen=True)
class Cleaned:
    """Which elements' cleaned text goes along with their rows: those of these names or with one of these attributes."""

    names: frozenset[str] = frozenset()
    attrs: frozenset[str] = frozenset()
    trim: bool = True
    skip_tables: bool = False

    def asks(self, t: Tree, i: int) -> bool:
        return t.type[i] == "element" and (t.name[i] in self.names or any(a[1] in self.attrs and not a[0] for a in t.attrs[i]))

    def text(self, t: Tree, i: int) -> str | None:
        return clean(t, i, self.trim, skip_tables=self.skip_tables)


@dataclass(frozen=True)
class Below:
    """Which elements' text, as it stands below them, goes along with their rows: those of these names."""

    names: frozenset[str]

    def asks(self, t: Tree, i: int) -> bool:
        return t.type[i] == "element" and t.name[i] in self.names

    def text(self, t: Tree, i: int) -> str | None:
        return text(t, i)


#: Layouts of shapes that a question keeps in a process.
LAYOUTS = 1_024


class Layout:
    """What the wanted nodes of a tree have in common with those of every tree of its shape: all but values, values of attributes and text."""

    __slots__ = ("asked", "attrs", "held", "marked", "root", "sizes", "some", "tree")

    def __init__(self, t: Tree, names: tuple[str, ...], wanted: Wanted | None, texts: Cleaned | Below | None):
        n = len(t.type)
        self.tree, self.root, self.some = t, t.root, list(range(n)) if wanted is None else wanted.of(t)
        if set(names) <= {"id", "parent", "subtree_end", "type", "ns", "name", "value", "attrs", "is_template", "in_template_of"}:
            inside = t.templates() if "in_template_of" in names else ()
            held = {"id": range(n), "parent": [None, *t.parent[1:]], "subtree_end": t.end, "type": t.type, "ns": t.ns, "name": t.name, "in_template_of": [i if i >= 0 else None for i in inside]}
            held["is_template"] = [t.is_html(i, "template") for i in range(n)] if "is_template" in names else ()
        else:
            held = t.columns()
        self.held = {c: [held[c][i] for i in self.some] for c in names if c not in ("value", "attrs")}
        self.sizes = [len(t.attrs[i]) for i in self.some]
        self.marked = [i for i in self.some if t.attrs[i]]
        self.attrs = [a[:2] for i in self.marked for a in t.attrs[i]]
        self.asked = [texts is not None and texts.asks(t, i) for i in self.some]


@dataclass(frozen=True)
class Pages:
    """Markup that is to be parsed, and how. Operators that get it parse and extract in one pass over each page."""

    df: DataFrame
    content: str = "html"
    key: str = "page_id"
    keep: tuple[str, ...] = ()
    base_url: str | None = None
    encoding: str | None = None
    context: str | None = None
    comments: bool = True
    limits: Limits | None = None
    mode: str = "PERMISSIVE"
    dealt: int | None = None  # of how many partitions `df` is, if by repartition(dealt, key)

    def __post_init__(self):
        if self.mode not in MODES:
            raise InputError(f"mode must be one of {', '.join(MODES)}", "mode")
        if self.context is not None and not CONTEXT.fullmatch(self.context):
            raise InputError("context must name an element, such as 'div' or 'svg path'", "context")
        if not isinstance(self.comments, bool):
            raise InputError("comments must be true or false", "comments")

    def _source(self) -> DataFrame:
        return self.df.select(*dict.fromkeys([self.key, *self.keep, self.content, *([self.base_url] if self.base_url else [])]))

    def parsed(self) -> DataFrame:
        """key, keep and the columns of PAGE. Write the result, or persist it, to query it more than once."""
        p = self
        names = [p.key, *p.keep]
        schema = T.StructType([p.df.schema[c] for c in names] + T._parse_datatype_string(PAGE).fields)
        arrow = to_arrow_schema(schema)
        options, content, base, mode = p.options(), p.content, p.base_url, p.mode

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _slices(batches):
                pages = [page(x, base_url=u, **options) for x, u in _inputs(part, content, base)]
                if mode == "FAILFAST" and (bad := next((x["error"] for x in pages if x["error"]), None)):
                    raise ValueError(f"{bad['kind']}: {bad['message']}")
                held = [_nodes([x["nodes"] for x in pages], f.type) if f.name == "nodes" else pa.array([x.get(f.name) for x in pages], f.type) for f in list(arrow)[len(names) :]]
                out = pa.RecordBatch.from_arrays([*(part.column(c).cast(arrow.field(c).type) for c in names), *held], schema=arrow)
                yield out.filter(out.column("error").is_null()) if mode == "DROPMALFORMED" else out

        return p._source().mapInArrow(run, schema)

    def node_rows(self, *columns: str, wanted: Wanted | None = None, texts: Cleaned | Below | None = None) -> DataFrame:
        """The nodes of all pages as rows, one pass: key, keep, root_id, base (what references resolve against), and `columns` of NODE, by default
        all. wanted: which nodes; the others never leave the parser. texts: if given, a column `text` has the text of these
        elements. Pages with an error have no rows, or raise in FAILFAST."""
        known = {f.name: f for f in T._parse_datatype_string(f"n {NODE}")["n"].dataType.fields}
        names = columns or tuple(known)
        if unknown := [c for c in names if c not in known]:
            raise InputError(f"nodes have no column {unknown[0]}", "columns")
        kept: dict[int, Layout] = {}

        def run(t: Tree) -> tuple:
            own = kept.get(id(t._like)) if t._like is not None else None
            if own is None:
                own = Layout(t._like or t, names, wanted, texts)
                if t._like is not None:
                    if len(kept) >= LAYOUTS:
                        kept.clear()
                    kept[id(t._like)] = own  # which holds the tree, so that the number stays its own
            values = [t.value[i] for i in own.some] if "value" in names else []
            given = [a[2] for i in own.marked for a in t.attrs[i]] if "attrs" in names else []
            return own, t.base, values, given, [texts.text(t, i) if asked else None for i, asked in zip(own.some, own.asked, strict=True)] if texts else []

        more = [T.StructField("text", T.StringType())] if texts else []
        return self.each(run, T.StructType([T.StructField("root_id", T.IntegerType()), T.StructField("base", T.StringType()), *(known[c] for c in names), *more]), LaidOut)

    def options(self) -> dict:
        return {"encoding": self.encoding, "context": self.context, "comments": self.comments, "limits": self.limits}

    def each(self, fn: Callable[[Tree], Iterable[tuple]], schema: T.StructType, gatherer: type[Gather] | None = None) -> DataFrame:
        """The key, `keep` and the rows that `fn` yields for each page's tree; schema: of what `fn` yields. Pages with an error, or on
        which `fn` reaches a limit, yield none, or raise in FAILFAST. gatherer: what makes batches of what `fn` yields."""
        p = self
        names = [p.key, *p.keep]
        out = T.StructType([p.df.schema[c] for c in names] + schema.fields)
        options, content, base, key, strict = p.options(), p.content, p.base_url, names, p.mode == "FAILFAST"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gather = (gatherer or Gather)(out)
            for part in _slices(batches, PLAIN_PAGES):
                for k, (x, u) in zip(zip(*(part.column(c).to_pylist() for c in key), strict=True), _inputs(part, content, base), strict=True):
                    try:
                        t = nodes_of(x, base_url=u, **options)
                        try:
                            rows = list(fn(t))
                        except InputError as e:  # of the question, not of the page
                            raise ValueError(f"{e.kind}: {e}") from None
                    except PageError as e:
                        if strict:
                            raise ValueError(f"{e.kind}: {e}") from None
                        continue
                    yield from gather.add(k, rows)
            yield from gather.rest()

        return p._source().mapInArrow(run, out)


def _slices(batches: Iterator[pa.RecordBatch], size: int = BATCH_PAGES) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, size):
            yield b.slice(at, size)


def _inputs(part: pa.RecordBatch, content: str, base_url: str | None) -> list[tuple]:
    bases = part.column(base_url).to_pylist() if base_url else [None] * part.num_rows
    return list(zip(part.column(content).to_pylist(), bases, strict=True))


class Gather:
    """Rows of tuples into Arrow batches, column by column."""

    def __init__(self, schema: T.StructType):
        self.schema, self.rows, self.count = to_arrow_schema(schema), [], 0

    def add(self, head: tuple, rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
        self.rows += [(*head, *r) for r in rows]
        if len(self.rows) >= BATCH_ROWS:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = zip(*self.rows, strict=True)
            yield pa.RecordBatch.from_arrays([_array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
            self.rows = []


class LaidOut(Gather):
    """Rows of nodes, page by page, into Arrow batches: layouts go in once a batch, and are taken as often as there are pages of them."""

    def add(self, head: tuple, rows: list) -> Iterator[pa.RecordBatch]:
        if rows[0].some:
            self.rows.append((head, *rows))
            self.count += len(rows[0].some)
        if self.count >= BATCH_ROWS:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        heads, own, bases, values, given, texts = zip(*self.rows, strict=True)
        pool = list({id(x): x for x in own}.values())
        number = {id(x): i for i, x in enumerate(pool)}
        which = np.array([number[id(x)] for x in own])
        page, node = _taken(which, [len(x.some) for x in pool])
        _, mark = _taken(which, [len(x.attrs) for x in pool])
        flat = lambda lists: [v for x in lists for v in x]
        out = []
        for i, f in enumerate(self.schema):
            if f.name == "attrs":
                sizes = np.array(flat(x.sizes for x in pool), np.int32)[node]
                of = f.type.value_type
                names = [pa.array(flat([a[k] for a in x.attrs] for x in pool), of.field(k).type).take(mark) for k in (0, 1)]
                parts = pa.StructArray.from_arrays([*names, pa.array(flat(given), of.field(2).type)], fields=list(of))
                out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), parts, type=f.type))
            elif i < len(heads[0]):
                out.append(pa.array([h[i] for h in heads], f.type).take(page))
            elif f.name == "root_id":
                out.append(pa.array([x.root for x in own], f.type).take(page))
            elif f.name == "base":
                out.append(pa.array(bases, f.type).take(page))
            elif f.name in ("value", "text"):
                out.append(pa.array(flat(values if f.name == "value" else texts), f.type))
            else:
                out.append(pa.array(flat(x.held[f.name] for x in pool), f.type).take(node))
        yield pa.RecordBatch.from_arrays(out, schema=self.schema)
        self.rows, self.count = [], 0


def _taken(which: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of lists that lie behind each other, of these sizes: the place in `which` of each element of the lists `which`, and where it is."""
    sizes = np.array(sizes, np.int64)
    starts, counts = np.cumsum(sizes) - sizes, sizes[which]
    place = np.repeat(np.arange(len(which)), counts)
    return place, np.repeat(starts[which] - (np.cumsum(counts) - counts), counts) + np.arange(len(place))


def _array(values: tuple, kind: pa.DataType) -> pa.Array:
    """An Arrow array. Lists of tuples (attributes) are made field by field, which is far faster than tuple by tuple."""
    if not (pa.types.is_list(kind) and pa.types.is_struct(kind.value_type)) or any(v is None or (v and not isinstance(v[0], tuple)) for v in values):
        return pa.array(list(values), kind)
    held = [x for v in values for x in v]
    fields = list(kind.value_type)
    inner = pa.StructArray.from_arrays([pa.array([x[i] for x in held], f.type) for i, f in enumerate(fields)], fields=fields)
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, values))], pa.int32()), inner, type=kind)


def parse(df: DataFrame, content: str = "html", key: str = "page_id", keep: tuple[str, ...] = (), **options) -> DataFrame:
    """`key`, `keep` and the columns of PAGE for each row of `df`; `content` holds strings or bytes, base_url names a column of URLs.
    Options: see `Pages`.

    One pass in Arrow batches, without a shuffle. Write the result, or persist it, to query it more than once."""
    return Pages(df, content, key, tuple(keep), **options).parsed()


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores, dealt to all of them: parsing takes far longer than moving pages. Others stay."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def tasks_for(df: DataFrame, rows: int = PAGES_A_TASK) -> int:
    """How many tasks `df` is dealt to, so that its growth makes more of them, not longer ones: of about `rows` rows, but as many as there are
    cores. Counting a scan reads no columns."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def dealt(df: DataFrame) -> DataFrame:
    """A scan that makes markup, dealt by rows: its splits follow the bytes of the columns and lie at groups of rows, which says little about the
    work of parsing what is made of them."""
    return df.repartition(tasks_for(df))


def fragment(df: DataFrame, content: str = "html", context: str = "div", **options) -> DataFrame:
    """As `parse`, of markup inside an element."""
    return parse(df, content, context=context, **options)


def read(spark: SparkSession, path: str, limits: Limits | None = None, tasks: int | None = None, **options) -> DataFrame:
    """Files of HTML below `path`, parsed: the key is the file's path, in a column `page_id`. Where `path` is an http, https, ftp, ftps
    or file URL, each file's URL is also its base URL, with the scheme in lower case; other paths give none.

    Files of over four times max_input bytes are not read: their length alone makes them limit errors, handled as `mode` says.

    tasks: how many tasks at most read files within the limit, and how many list those beyond it. This is for many small files, of which Spark
    deals some 32 to a task, as if each had 4 MB."""
    limits = limits or Limits()
    most = 4 * limits.max_input
    files = spark.read.format("binaryFile").load(path)
    is_url = re.match(r"(?i)(https?|ftps?|file):", path)
    base = F.concat(F.lower(F.substring_index("path", ":", 1)), F.expr("substring(path, instr(path, ':'))")) if is_url else F.lit(None).cast("string")
    small = files.where(F.col("length") <= most).select(F.col("path").alias("page_id"), "content", base.alias("of_url"))
    docs = parse(small.coalesce(tasks) if tasks else small, "content", "page_id", base_url="of_url", limits=limits, **options)
    mode = options.get("mode", "PERMISSIVE")
    if mode == "DROPMALFORMED":
        return docs
    error = F.struct(F.lit("limit").alias("kind"), F.concat(F.lit(f"max_input is {limits.max_input}, and a file has "), F.col("length").cast("string"), F.lit(" bytes")).alias("message"), F.lit(None).cast("string").alias("arg"), F.lit(None).cast("string").alias("encoding"), F.lit("max_input").alias("limit"), F.lit(limits.max_input).cast("long").alias("maximum"), F.col("length").alias("observed"))
    known = {"page_id": F.col("path"), "type": F.lit("document"), "error": error, "base_url": base}
    large = files.where(F.col("length") > most).select("path", "length")
    large = large.coalesce(tasks) if tasks else large
    if mode == "FAILFAST":
        known["page_id"] = F.coalesce(F.raise_error(error["message"]).cast("string"), F.col("path"))
    return docs.unionByName(large.select(*(known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in docs.schema)))


def too_large(spark: SparkSession, path: str, limits: Limits | None = None) -> DataFrame:
    """page_id and length of the files that `read` does not open."""
    limits = limits or Limits()
    return spark.read.format("binaryFile").load(path).where(F.col("length") > 4 * limits.max_input).select(F.col("path").alias("page_id"), "length")
