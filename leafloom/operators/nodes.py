"""Nodes as rows, and the relations between them: navigation, searches in contexts, sets of nodes.

A set of nodes is a DataFrame with the page's key and `id`. Operators are aligned (a row for each row of the input, nulls where
there is no answer) or return sets (no duplicates; order by key and id is document order).
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafloom.errors import InputError
from leafloom.kernel.selectors import Complex, Simple, parse_selector
from leafloom.plans import selectors as S
from leafloom.plans.intervals import holding, nearest, pairs

KEY = "page_id"
ANY = Simple("type", "*")
#: Columns of nodes, beside the key.
COLUMNS = "root_id base id parent subtree_end depth first_child next_sib prev_sib next_elem prev_elem elem_pos elem_count n_elem_children n_text_children type ns name value is_template in_template_of attrs".split()


def nodes(docs: DataFrame, key: str = KEY) -> DataFrame:
    """All nodes of parsed pages, a row each, with `base`: what references of the page resolve against."""
    return docs.select(key, "root_id", F.col("resolved_base").alias("base"), F.explode("nodes").alias("n")).select(key, "root_id", "base", "n.*")


def elements(all_nodes: DataFrame, css: str, contexts: DataFrame | None = None, key: str = KEY, stored: bool = False) -> DataFrame:
    """Set: matches in each page, or below any of `contexts`; a context itself where the subject has :scope. stored: the rows of a page lie
    in one partition, as in a table of `sources.stored`; then a search of whole pages exchanges nothing."""
    if contexts is None:
        return S.select(all_nodes, css, key, stored=stored)
    return _below(all_nodes, css, contexts, key).select(*all_nodes.columns).dropDuplicates([key, "id"])


def _below(all_nodes: DataFrame, css: str, contexts: DataFrame, key: str) -> DataFrame:
    """Matches with the column `context` (the context's id): one row for each pair."""
    selector = parse_selector(css)
    mine = contexts.where(F.col("id").isNotNull()).select(F.col(key).alias("c_key"), F.col("id").alias("context")).distinct()
    ends = all_nodes.select(key, "id", "subtree_end", F.col("is_template").alias("template"), F.col("type").alias("c_type"), F.col("root_id").alias("c_root"))
    mine = ends.join(mine, (F.col("c_key") == F.col(key)) & (F.col("context") == F.col("id"))).drop("c_key", "context")
    seen = F.col("in_template_of").isNull() | (F.col("in_template_of") < F.col("context"))
    if "scope" not in S.kinds(selector):
        found = pairs(mine.where(~F.col("template")).select(key, "id", "subtree_end"), S.flagged(all_nodes, {"_hit": selector}, [key]).drop("_hit"), [key])
        return found.withColumnRenamed("o_id", "context").where(seen).select(*all_nodes.columns, "context")
    # :scope differs from context to context: rows carry theirs along
    scope = F.when(F.col("c_type").isin("document", "fragment"), F.col("c_root")).otherwise(F.col("context"))
    asked = mine.select(F.col(key).alias("c_key"), F.col("id").alias("context"), F.col("subtree_end").alias("c_end"), F.col("template").alias("c_template"), "c_type", "c_root")
    found = S.flagged(all_nodes.join(asked, F.col(key) == F.col("c_key")), {f"_hit{i}": (c,) for i, c in enumerate(selector)}, [key, "context"], scope)
    inside = (F.col("id") > F.col("context")) & (F.col("id") <= F.col("c_end")) & ~F.col("c_template") & seen
    good = F.lit(False)
    for i, c in enumerate(selector):
        good = good | (F.col(f"_hit{i}") & (inside | (F.col("id") == F.col("context")) if Simple("pseudo", "scope") in c.compounds[-1] else inside))
    return found.where(good).select(*all_nodes.columns, "context")


def element(all_nodes: DataFrame, css: str, contexts: DataFrame, key: str = KEY, into: str = "match_id") -> DataFrame:
    """Aligned: `contexts` with the id of the first match below each, null where there is none."""
    first = _below(all_nodes, css, contexts, key).groupBy(F.col(key).alias("m_key"), "context").agg(F.min("id").alias(into))
    return contexts.join(first, (F.col(key) == F.col("m_key")) & (F.col("id") == F.col("context")), "left").drop("m_key", "context")


def matches(all_nodes: DataFrame, css: str, some: DataFrame, key: str = KEY, into: str = "matches") -> DataFrame:
    """Aligned: whether each node of `some` matches, itself being :scope; null for a missing node, false for what is no element."""
    return matches_all(all_nodes, {into: css}, some, key)


def matches_all(all_nodes: DataFrame, tests: dict[str, str], some: DataFrame, key: str = KEY) -> DataFrame:
    """As `matches`, a column for each of `tests`, all in one pass."""
    parsed = {n: tuple(map(_of_itself, parse_selector(css))) for n, css in tests.items()}
    found = S.flagged(all_nodes, parsed, [key]).select(F.col(key).alias("m_key"), F.col("id").alias("m_id"), *(F.col(n).alias(f"m_{n}") for n in parsed))
    out = some.join(found, (F.col(key) == F.col("m_key")) & (F.col("id") == F.col("m_id")), "left")
    return out.select(*(some[c] for c in some.columns), *(F.when(some["id"].isNotNull(), F.coalesce(f"m_{n}", F.lit(False))).alias(n) for n in tests))


def _of_itself(c: Complex) -> Complex:
    """The selector without :scope, which is the tested node: true of the subject, and of no node before it."""

    def pin(s: Simple, itself: bool) -> Simple:
        if s == Simple("pseudo", "scope"):
            return ANY if itself else Simple("not", inner=(ANY,))
        return replace(s, inner=tuple(pin(x, itself) for x in s.inner))

    last = len(c.compounds) - 1
    return replace(c, compounds=tuple(tuple(pin(s, k == last) for s in parts) for k, parts in enumerate(c.compounds)))


def where(all_nodes: DataFrame, css: str, some: DataFrame, key: str = KEY) -> DataFrame:
    """The rows of `some` that match; their order and duplicates stay."""
    return matches(all_nodes, css, some, key, "_m").where("_m").drop("_m")


def closest(all_nodes: DataFrame, css: str, some: DataFrame, key: str = KEY, into: str = "match_id") -> DataFrame:
    """Aligned: the nearest match among each node and its ancestors; null for the document node. :scope is the node itself."""
    selector = parse_selector(css)
    asked = some.where("id > 0").select(key, "id").distinct()
    if "scope" in S.kinds(selector):
        carried = all_nodes.join(asked.select(F.col(key).alias("c_key"), F.col("id").alias("context")), F.col(key) == F.col("c_key"))
        hit = S.flagged(carried, {"_hit": selector}, [key, "context"], F.col("context"))
        over = (F.col("context") >= F.col("id")) & (F.col("context") <= F.col("subtree_end"))
        best = hit.where(over).groupBy(F.col(key).alias("m_key"), "context").agg(F.max("id").alias(into))  # ancestors nest: the largest id is the nearest
    else:
        hit = S.flagged(all_nodes, {"_hit": selector}, [key]).select(key, "id", "subtree_end")
        best = nearest(hit, asked, [key], into, itself=True).select(F.col(key).alias("m_key"), F.col("id").alias("context"), into)
    return some.join(best, (F.col(key) == F.col("m_key")) & (F.col("id") == F.col("context")), "left").drop("m_key", "context")


def including(all_nodes: DataFrame, css: str, some: DataFrame, key: str = KEY) -> DataFrame:
    """Set: matches among `some` and below them, as rows of nodes."""
    below = _below(all_nodes, css, some, key).drop("context")
    ids = some.where(F.col("id").isNotNull()).select(F.col(key).alias("s_key"), F.col("id").alias("s_id"))
    own = S.flagged(all_nodes, {"_hit": parse_selector(css)}, [key]).drop("_hit").join(ids, (F.col(key) == F.col("s_key")) & (F.col("id") == F.col("s_id")), "left_semi")
    return below.unionByName(own).dropDuplicates([key, "id"])


# -- navigation --------------------------------------------------------------------------------------------------------------


def fetch(all_nodes: DataFrame, some: DataFrame, key: str = KEY, by: str = "id") -> DataFrame:
    """Aligned: the key and `by` of `some` with the other columns of the nodes so named."""
    want = some.select(F.col(key).alias("w_key"), F.col(by).alias("w_id"))
    return want.join(all_nodes, (F.col("w_key") == F.col(key)) & (F.col("w_id") == F.col("id")), "left").drop(key).withColumnRenamed("w_key", key).drop("w_id")


def parent(some: DataFrame, key: str = KEY) -> DataFrame:
    """Aligned: key and parent of nodes with all their columns."""
    return some.select(key, F.col("parent").alias("id"))


def sibling(some: DataFrame, forward: bool = True, elements_only: bool = True, key: str = KEY) -> DataFrame:
    """Aligned: the next or the previous sibling."""
    return some.select(key, F.col(("next" if forward else "prev") + ("_elem" if elements_only else "_sib")).alias("id"))


def children(all_nodes: DataFrame, some: DataFrame, elements_only: bool = True, key: str = KEY) -> DataFrame:
    """Set: the children of `some`; a template's contents are not its children."""
    up = some.where(~F.coalesce(F.col("is_template"), F.lit(False))).select(F.col(key).alias("p_key"), F.col("id").alias("p_id"))
    kids = all_nodes.where("type = 'element'") if elements_only else all_nodes
    return kids.join(up, (F.col(key) == F.col("p_key")) & (F.col("parent") == F.col("p_id")), "left_semi")


def template_content(all_nodes: DataFrame, some: DataFrame, elements_only: bool = True, key: str = KEY) -> DataFrame:
    """Set: what templates among `some` hold."""
    up = some.where("is_template").select(F.col(key).alias("p_key"), F.col("id").alias("p_id"))
    kids = all_nodes.where("type = 'element'") if elements_only else all_nodes
    return kids.join(up, (F.col(key) == F.col("p_key")) & (F.col("parent") == F.col("p_id")), "left_semi")


def ancestors(all_nodes: DataFrame, some: DataFrame, key: str = KEY) -> DataFrame:
    """Set: all elements around `some`, without the document node."""
    low = some.where(F.col("id").isNotNull()).select(F.col(key).alias("d_key"), F.col("id").alias("d_id")).distinct()
    marked = all_nodes.where("id > 0").join(low, (F.col(key) == F.col("d_key")) & (F.col("id") == F.col("d_id")), "left")
    return holding(marked, {"_around": F.col("d_id").isNotNull()}, [key]).where("_around").select(*all_nodes.columns)


def root(docs: DataFrame, key: str = KEY) -> DataFrame:
    """Aligned: the html element of each page, null for a fragment."""
    return docs.select(key, F.col("root_id").alias("id"))


def outermost(some: DataFrame, key: str = KEY) -> DataFrame:
    """Set: nodes that lie in no other node of `some` (with subtree_end)."""
    before = F.max("subtree_end").over(Window.partitionBy(key).orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    return some.dropDuplicates([key, "id"]).withColumn("_b", before).where(F.col("_b").isNull() | (F.col("id") > F.col("_b"))).drop("_b")


# -- sets of nodes -------------------------------------------------------------------------------------------------------------


def combine(a: DataFrame, b: DataFrame, how: str = "union", key: str = KEY) -> DataFrame:
    """Union, intersection or difference by identity (key and id), without duplicates."""
    if how == "union":
        return a.unionByName(b).dropDuplicates([key, "id"])
    kind = {"intersect": "left_semi", "difference": "left_anti"}.get(how)
    if kind is None:
        raise InputError("how must be union, intersect or difference", "how")
    ids = b.select(F.col(key).alias("o_key"), F.col("id").alias("o_id"))
    return a.dropDuplicates([key, "id"]).join(ids, (F.col(key) == F.col("o_key")) & (F.col("id") == F.col("o_id")), kind)


def describe(some: DataFrame, width: int = 60) -> DataFrame:
    """Nodes with a short text for reading, cut at `width` characters."""
    attrs = F.array_join(F.transform("attrs", lambda a: F.concat(F.lit(" "), a["name"], F.lit('="'), a["value"], F.lit('"'))), "")
    s = F.when(F.col("type") == "element", F.concat(F.lit("<"), F.col("name"), attrs, F.lit(">"))).when(F.col("type") == "doctype", F.concat(F.lit("<!DOCTYPE "), F.col("name"), F.lit(">"))).otherwise(F.concat(F.lit("#"), F.col("type"), F.lit(" "), F.coalesce("value", F.lit(""))))
    return some.withColumn("described", F.when(F.length(s) > width, F.concat(F.left(s, F.lit(width - 3)), F.lit("..."))).otherwise(s))


# -- text by joins ---------------------------------------------------------------------------------------------------------------


def text(all_nodes: DataFrame, some: DataFrame, key: str = KEY, recursive: bool = True, into: str = "text") -> DataFrame:
    """Aligned: `some` (with all columns of nodes) with the text below, concatenated without separators."""
    own = F.col("type").isin("text", "comment", "processing_instruction")
    wide = some.where(F.col("type").isin("element", "document", "fragment") & ~F.col("is_template")).select(F.col(key).alias("x_key"), F.col("id").alias("x_id"), F.col("subtree_end").alias("x_end")).distinct()
    pieces = all_nodes.where("type = 'text'")
    if recursive:
        seen = F.col("in_template_of").isNull() | (F.col("in_template_of") < F.col("o_id"))
        met = pairs(wide.select(F.col("x_key").alias(key), F.col("x_id").alias("id"), F.col("x_end").alias("subtree_end")), pieces.select(key, "id", "value", "in_template_of"), [key]).where(seen).select(F.col(key).alias("x_key"), F.col("o_id").alias("x_id"), "id", "value")
    else:
        met = pieces.join(wide, (F.col(key) == F.col("x_key")) & (F.col("parent") == F.col("x_id")))
    found = met.groupBy("x_key", "x_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "value"))), lambda p: p["value"]), "").alias("_t"))
    joined = some.join(found, (F.col(key) == F.col("x_key")) & (F.col("id") == F.col("x_id")), "left")
    return joined.withColumn(into, F.when(own, F.col("value")).when(F.col("type") != "doctype", F.coalesce("_t", F.lit("")))).drop("x_key", "x_id", "_t")
