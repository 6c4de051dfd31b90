"""Intervals of nodes: a node's descendants are the numbers after its own up to its end. Nothing here compares a page's nodes with each other.

Whether some interval holds a node is told by a running maximum over document order, and whether a node holds others by a running
minimum: linear, without a join. Pages are split into blocks of numbers, each a window of its own, and what earlier (later) blocks hand over is
a row a block; so a large page is spread over tasks. Where the rows of a page lie together already (`stored`), the page is the window, and
nothing is exchanged.

What lies around a node is told by sums over document order too, in which an interval opens and closes: how many are around, and by that number,
which one is the innermost. Nothing is joined.

Pairs come from an equality join: an interval is laid out in blocks of 64, 4,096 and 262,144 numbers, at most 126 of each size, and a node looks
itself up once a size. Only blocks at an interval's edges hold nodes that are no answer, fewer than 64 each. Keys of pages are not null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of a window's block, and the sizes of blocks in joins, all as powers of two.
WINDOW_BITS = 14
JOIN_BITS = (6, 12, 18)


def within(rows: DataFrame, flags: dict[str, Column], by: list[str], stored: bool = False) -> DataFrame:
    """`rows` (with id and subtree_end) and for each of `flags` a boolean column: whether the node lies below a row for which the flag holds."""
    first = (Window.unboundedPreceding, -1)
    ends = {n: F.when(f, F.col("subtree_end")) for n, f in flags.items()}
    return _running(rows, ends, F.max, first, by, stored, {n: lambda reach: F.coalesce(reach >= F.col("id"), F.lit(False)) for n in flags})


def holding(rows: DataFrame, flags: dict[str, Column], by: list[str], stored: bool = False) -> DataFrame:
    """`rows` and for each of `flags` a boolean column: whether a row for which the flag holds lies below the node."""
    ids = {n: F.when(f, F.col("id")) for n, f in flags.items()}
    return _running(rows, ids, F.min, (1, Window.unboundedFollowing), by, stored, {n: lambda at: F.coalesce(at <= F.col("subtree_end"), F.lit(False)) for n in flags})


def _running(rows: DataFrame, values: dict[str, Column], best, frame: tuple[int, int], by: list[str], stored: bool, told: dict) -> DataFrame:
    """Adds for each name told[name](best of values[name] over the rows before, or behind, in the page)."""
    kept = rows.columns
    if stored:
        w = Window.partitionBy(*by).orderBy("id").rowsBetween(*frame)
        return rows.select(*kept, *(told[n](best(v).over(w)).alias(n) for n, v in values.items()))
    dealt = rows.withColumn("_block", F.shiftright("id", WINDOW_BITS)).repartition(*by, "_block")  # read twice, exchanged once
    w = Window.partitionBy(*by, "_block").orderBy("id").rowsBetween(*frame)
    near = dealt.select(*kept, "_block", *(best(v).over(w).alias(f"_n_{n}") for n, v in values.items()))
    far = Window.partitionBy(*by).orderBy("_block").rowsBetween(*frame)  # rows: blocks
    blocks = dealt.groupBy(*by, "_block").agg(*(best(v).alias(f"_b_{n}") for n, v in values.items()))
    blocks = blocks.select(*(F.col(b).alias(f"_k_{b}") for b in by), F.col("_block").alias("_k"), *(best(f"_b_{n}").over(far).alias(f"_f_{n}") for n in values))
    on = F.col("_block") == F.col("_k")
    for b in by:
        on = on & (F.col(b) == F.col(f"_k_{b}"))
    pick = F.greatest if best is F.max else F.least
    return near.join(blocks, on).select(*kept, *(told[n](pick(F.col(f"_n_{n}"), F.col(f"_f_{n}"))).alias(n) for n in values))


def around(rows: DataFrame, sums: dict[str, Column], by: list[str]) -> DataFrame:
    """`rows` (with id and subtree_end) and for each of `sums` the sum of its values (numbers, not null) over the rows around."""
    counts = F.lit(False)
    for v in sums.values():
        counts = counts | (v != 0)
    told = rows.select("*", F.explode(F.when(counts, F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(1)))).alias("_sign"))
    opens = F.col("_sign") == 1
    told = told.withColumn("_at", F.when(opens, F.col("id").cast("long") * 2).otherwise(F.col("subtree_end").cast("long") * 2 + 1))
    before = Window.partitionBy(*by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return told.select("*", *(F.coalesce(F.sum(v * F.col("_sign")).over(before), F.lit(0)).cast("int").alias(n) for n, v in sums.items())).where(opens).drop("_sign", "_at")


def innermost(rows: DataFrame, flag: Column, depth: str, value: Column, by: list[str], into: str, every: Column | None = None) -> DataFrame:
    """`rows` with `value` (one that grows with id) of the innermost row around each for which `flag` holds, null without one and for such rows themselves.
    depth: the column with the number of such rows around, as `around` tells it. Rows for which `every` holds come once for each such row around."""
    # around a node at depth d lies, of those at depth d - 1, the last one before it
    level = F.col(depth) + flag.cast("int")
    if every is not None:
        level = F.explode(F.when(every & (F.col(depth) > 1), F.sequence(F.lit(1), F.col(depth))).otherwise(F.array(level)))
    before = Window.partitionBy(*by, "_level").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_level", level).withColumn(into, F.when((F.col(depth) > 0) & ~flag, F.max(F.when(flag, value)).over(before))).drop("_level")


def _range(low: Column, high: Column) -> Column:
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def _codes(blocks: Column, level: int) -> Column:
    return F.transform(blocks, lambda b: (b * len(JOIN_BITS) + level).cast("int"))


def blocks_of_interval(low: Column, high: Column) -> Column:
    """The blocks that make up the numbers from `low` (1 at least) to `high`, each as block * sizes + size."""
    parts, inner = [], None
    for level, bits in reversed(list(enumerate(JOIN_BITS))):
        first = F.shiftright(low, bits) if level == 0 else F.shiftright(low + ((1 << bits) - 1), bits)
        last = F.shiftright(high, bits) if level == 0 else F.shiftright(high + 1, bits) - 1
        if inner is None:
            here = _range(first, last)
        else:
            step = JOIN_BITS[level + 1] - bits
            held = inner[0] <= inner[1]  # else the larger size has no block in the interval
            here = F.when(held, F.concat(_range(first, F.shiftleft(inner[0], step) - 1), _range(F.shiftleft(inner[1] + 1, step), last))).otherwise(_range(first, last))
            first, last = F.when(held, F.least(first, F.shiftleft(inner[0], step))).otherwise(first), F.when(held, F.greatest(last, F.shiftleft(inner[1] + 1, step) - 1)).otherwise(last)
        parts.append(_codes(here, level))
        inner = (first, last)
    first, sizes = F.shiftright(low, JOIN_BITS[0]), len(JOIN_BITS)
    return F.when(low > high, F.array().cast("array<int>")).when(first == F.shiftright(high, JOIN_BITS[0]), F.array((first * sizes).cast("int"))).otherwise(F.concat(*parts))


def blocks_of_node(node: Column) -> Column:
    """The blocks under which a node is looked up. The first block of a size is never inside an interval, which begins behind 0."""
    sizes = len(JOIN_BITS)
    every = [(F.shiftright(node, bits) * sizes + level).cast("int") for level, bits in enumerate(JOIN_BITS)]
    out = F.array(*every)
    for level in range(len(every) - 1, 0, -1):
        out = F.when(F.shiftright(node, JOIN_BITS[level]) == 0, F.array(*every[:level])).otherwise(out)
    return F.when(F.shiftright(node, JOIN_BITS[1]) == 0, F.array(every[0])).otherwise(out)


def pairs(outer: DataFrame, inner: DataFrame, by: list[str], itself: bool = False) -> DataFrame:
    """One row for each node of `inner` (with id) below one of `outer` (with id and subtree_end), or `itself`: the columns of `by`, those of
    `outer` with o_ before their name, and those of `inner`."""
    mine = [c for c in outer.columns if c not in by]
    low = F.greatest(F.col("id") + (0 if itself else 1), F.lit(1))
    left = outer.select(*(F.col(b).alias(f"_o_{b}") for b in by), *(F.col(c).alias(f"o_{c}") for c in mine), low.alias("_low"), F.explode(blocks_of_interval(low, F.col("subtree_end"))).alias("_o"))
    right = inner.select("*", F.explode(blocks_of_node(F.col("id"))).alias("_i"))
    on = (F.col("_o") == F.col("_i")) & (F.col("id") >= F.col("_low")) & (F.col("id") <= F.col("o_subtree_end"))
    for b in by:
        on = (F.col(b) == F.col(f"_o_{b}")) & on
    return right.join(left, on).select(*by, *(f"o_{c}" for c in mine), *(c for c in inner.columns if c not in by))


def nearest(outer: DataFrame, inner: DataFrame, by: list[str], into: str, itself: bool = False) -> DataFrame:
    """Aligned: `inner` with the id of the innermost row of `outer` around each, null without one. Rows of `inner` differ in `by` and id."""
    found = pairs(outer.select(*by, "id", "subtree_end"), inner.select(*by, "id"), by, itself).groupBy(*(F.col(b).alias(f"_k_{b}") for b in by), F.col("id").alias("_k")).agg(F.max("o_id").alias(into))
    on = F.col("id") == F.col("_k")
    for b in by:
        on = (F.col(b) == F.col(f"_k_{b}")) & on
    return inner.join(found, on, "left").drop("_k", *(f"_k_{b}" for b in by))
