"""The selector compiler: selectors become filters and windows over nodes, which Catalyst plans. Any number of them takes one scan.

A compound is a predicate on one row, and only rows that match some compound go on. A state is a beginning of a selector that a row
has matched. Combinators lead from state to state by running values, without a join: over a page in document order for descendants, and over
the children of a parent, with the parent before them, for children and siblings. All selectors take a step together, so that there
are at most two windows a step, and beginnings that selectors share are matched once. Rows are never multiplied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom.functions.columns import attr, fold, raw_attr, tokens
from leafloom.kernel.selectors import ANY_CASE, SPACE, Complex, Simple, parse_selector
from leafloom.plans.intervals import within


def _nth(a: int, b: int, n: Column) -> Column:
    if a == 0:
        return n == b
    return ((n - b) % a == 0) & ((n - b) / a >= 0)


def _attribute(s: Simple) -> Column:
    v = attr(s.name)
    if not s.op:
        return v.isNotNull()

    def test(v: Column, want: str) -> Column:
        if s.op == "=":
            return v == want
        if s.op == "~=":
            return F.array_contains(tokens(v), want) if want and not any(c in SPACE for c in want) else F.lit(False)
        if s.op == "|=":
            return (v == want) | v.startswith(want + "-")
        if not want:
            return F.lit(False)
        return {"^=": v.startswith, "$=": v.endswith, "*=": v.contains}[s.op](want)

    low = "".join(c.lower() if c.isascii() else c for c in s.value)
    if s.flag == "i":
        out = test(fold(v), low)
    elif s.flag != "s" and s.name.lower() in ANY_CASE:
        out = F.when(F.col("ns") == "html", test(fold(v), low)).otherwise(test(v, s.value))
    else:
        out = test(v, s.value)
    return F.coalesce(out, F.lit(False))


def simple(s: Simple, scope: Column | None) -> Column:
    c = F.col
    if s.kind == "type":
        if s.name == "*":
            return F.lit(True)
        low = s.name.lower() if s.name.isascii() else s.name
        return c("name") == s.name if low == s.name else F.when(c("ns") == "html", c("name") == low).otherwise(c("name") == s.name)
    if s.kind == "id":
        return F.coalesce(raw_attr("id") == s.name, F.lit(False))
    if s.kind == "class":
        return F.coalesce(F.array_contains(tokens(raw_attr("class")), s.name), F.lit(False))
    if s.kind == "attr":
        return _attribute(s)
    if s.kind == "not":
        return ~compound(s.inner, scope)
    if s.kind == "nth-child":
        return F.coalesce(_nth(s.a, s.b, c("elem_pos")), F.lit(False))
    if s.kind == "nth-of-type":
        return F.coalesce(_nth(s.a, s.b, c("typed_pos")), F.lit(False))
    if s.name == "scope":
        return F.coalesce(c("id") == (scope if scope is not None else c("root_id")), F.lit(False))
    if s.name == "root":
        return (c("parent") == 0) & c("root_id").isNotNull()
    if s.name == "empty":
        return (c("n_elem_children") == 0) & (c("n_text_children") == 0)
    return {"first-child": c("elem_pos") == 1, "last-child": c("elem_pos") == c("elem_count"), "only-child": c("elem_count") == 1}[s.name]


def compound(parts: tuple[Simple, ...], scope: Column | None = None) -> Column:
    out = F.col("type") == "element"
    for s in parts:
        if s != Simple("type", "*"):
            out = out & simple(s, scope)
    return out


def kinds(selector: tuple[Complex, ...]) -> set[str]:
    """The kinds of simple selectors in use, pseudo-classes by name, inside :not() too."""
    out: set[str] = set()
    todo = [s for c in selector for parts in c.compounds for s in parts]
    while todo:
        s = todo.pop()
        out.add(s.name if s.kind == "pseudo" else s.kind)
        todo.extend(s.inner)
    return out


def prepared(nodes: DataFrame, key: str, selector: tuple[Complex, ...]) -> DataFrame:
    """`nodes` with typed_pos where the selector counts siblings of a type."""
    if "nth-of-type" not in kinds(selector) or "typed_pos" in nodes.columns:
        return nodes
    w = Window.partitionBy(key, "parent", "type", "ns", "name").orderBy("id")
    return nodes.withColumn("typed_pos", F.when(F.col("type") == "element", F.row_number().over(w)))


Chain = tuple  # a beginning of a selector: compounds with the joints between them


def _beginnings(c: Complex) -> list[Chain]:
    out: list[Chain] = [(c.compounds[0],)]
    for joint, parts in zip(c.joints, c.compounds[1:], strict=True):
        out.append((*out[-1], joint, parts))
    return out


def flagged(nodes: DataFrame, selectors: dict[str, tuple[Complex, ...]], by: list[str], scope: Column | None = None, stored: bool = False) -> DataFrame:
    """The rows of `nodes` that match any of `selectors`, with a boolean column for each of their names. by: the page's key, and further columns
    (the context's) in which rows that meet must agree. stored: the rows of a page lie in one partition (see `within`)."""
    ends = {n: [_beginnings(c)[-1] for c in s] for n, s in selectors.items()}
    chains = list(dict.fromkeys(b for s in selectors.values() for c in s for b in _beginnings(c)))
    name = {b: f"_s{i}" for i, b in enumerate(chains)}
    compounds = list(dict.fromkeys(b[-1] for b in chains))
    ready = prepared(nodes, by[0], tuple(c for s in selectors.values() for c in s))
    tests = [compound(p, scope) for p in compounds]
    words = [tests[i : i + 62] for i in range(0, len(tests), 62)]  # bits of numbers, so that rows stay narrow
    bits = {f"_c{k}": sum((t.cast("long") * (1 << i) for i, t in enumerate(some)), F.lit(0).cast("long")) for k, some in enumerate(words)}
    hit = lambda b: F.col(f"_c{compounds.index(b[-1]) // 62}").bitwiseAND(1 << compounds.index(b[-1]) % 62) != 0
    any_test = tests[0]
    for t in tests[1:]:
        any_test = any_test | t
    rows = ready.where(any_test)
    if any(len(b) > 1 for b in chains):
        rows = rows.select("*", *(v.alias(c) for c, v in bits.items()))
        rows = rows.select("*", *(hit(b).alias(name[b]) for b in chains if len(b) == 1))
    else:
        rows = rows.select("*", *(tests[compounds.index(b[0])].alias(name[b]) for b in chains))
    for step in range(1, max(len(b) for b in chains) // 2 + 1):
        now = [b for b in chains if len(b) == 2 * step + 1]
        rows = _step(rows, now, name, hit, by, stored)
    told = []
    for n, s in ends.items():
        flag = F.col(name[s[0]])
        for b in s[1:]:
            flag = flag | F.col(name[b])
        told.append(flag.alias(n))
    out = rows.select(*nodes.columns, *told)
    some = F.col(next(iter(ends)))
    for n in list(ends)[1:]:
        some = some | F.col(n)
    return out.where(some)


def _step(rows: DataFrame, now: list[Chain], name: dict[Chain, str], hit, by: list[str], stored: bool) -> DataFrame:
    """The states `now`, each from the one without its last compound."""
    below = {f"_w{name[b]}": F.col(name[b[:-2]]) for b in now if b[-2] == " "}
    if below:
        rows = within(rows, below, by, stored)
        rows = rows.select(*(c for c in rows.columns if c not in below), *((hit(b) & F.col(f"_w{name[b]}")).alias(name[b]) for b in now if b[-2] == " "))
    others = [b for b in now if b[-2] != " "]
    if not others:
        return rows
    kept = rows.columns
    as_child = F.struct(F.col("parent").alias("group"), F.col("elem_pos").alias("pos"))
    grouped = rows.withColumn("_g", as_child)
    if any(b[-2] == ">" for b in others):
        is_parent = F.lit(False)
        for b in others:
            is_parent = is_parent | F.col(name[b[:-2]]) if b[-2] == ">" else is_parent
        as_parent = F.struct(F.col("id").alias("group"), F.lit(0).alias("pos"))
        grouped = rows.withColumn("_g", F.explode(F.when(is_parent, F.array(as_child, as_parent)).otherwise(F.array(as_child))))
    grouped = grouped.select(*kept, F.col("_g.group").alias("_group"), F.col("_g.pos").alias("_pos"))
    before = Window.partitionBy(*by, "_group").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    reached = {}
    for b in others:
        held, mine = F.col(name[b[:-2]]), F.col("_pos") > 0
        last = F.max(F.when(held & (~mine if b[-2] == ">" else mine), F.col("_pos"))).over(before)
        reached[name[b]] = {">": last == 0, "~": last > 0, "+": last == F.col("_pos") - 1}[b[-2]]
    out = grouped.select(*kept, "_pos", *(F.coalesce(c, F.lit(False)).alias(f"_r{n}") for n, c in reached.items())).where("_pos > 0")
    return out.select(*kept, *((hit(b) & F.col(f"_r{name[b]}")).alias(name[b]) for b in others))


def visible(nodes: DataFrame) -> DataFrame:
    """Nodes that a search of the whole page sees: none in a template."""
    return nodes.where(F.col("in_template_of").isNull())


def select(nodes: DataFrame, css: str, key: str = "page_id", max_length: int = 16 << 10, stored: bool = False) -> DataFrame:
    """The elements of each page that match, as rows of `nodes`. An ancestor part may match anywhere in the page."""
    return visible(flagged(nodes, {"_hit": parse_selector(css, max_length)}, [key], stored=stored)).select(*nodes.columns)


def select_many(nodes: DataFrame, selectors: dict[str, str], key: str = "page_id", max_length: int = 16 << 10, stored: bool = False) -> DataFrame:
    """The elements that match any of `selectors`, with a boolean column for each: one scan of `nodes`, however many there are."""
    return visible(flagged(nodes, {n: parse_selector(c, max_length) for n, c in selectors.items()}, [key], stored=stored))
