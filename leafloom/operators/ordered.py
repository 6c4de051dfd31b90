"""Sets of nodes with places, as tables: rows hold the page's key, `n` (the place in the set, from 1), `id` (null for a missing node) and
further columns of nodes. Every operator is a window over a page's places or an equality join on (key, n); where an answer has rows
for pages whose set is empty, `pages` (a row a page) says which pages there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom.errors import InputError
from leafloom.operators.nodes import KEY


def numbered(some: DataFrame, key: str = KEY) -> DataFrame:
    """Nodes in document order, missing ones last."""
    return _renumbered(some, [F.col("id").asc_nulls_last()], key)


def _renumbered(some: DataFrame, order: list[Column], key: str) -> DataFrame:
    rest = [c for c in some.columns if c not in (key, "n")]
    return some.select(key, F.row_number().over(Window.partitionBy(key).orderBy(*order)).alias("n"), *rest)


def sort(a: DataFrame, key: str = KEY) -> DataFrame:
    return _renumbered(a, [F.col("id").asc_nulls_last(), F.col("n")], key)


def rev(a: DataFrame, key: str = KEY) -> DataFrame:
    return a.withColumn("n", F.count("*").over(Window.partitionBy(key)).cast("int") + 1 - F.col("n"))


def rep(a: DataFrame, times: int, key: str = KEY) -> DataFrame:
    """The whole set so many times over."""
    if isinstance(times, bool) or not isinstance(times, int) or times < 0:
        raise InputError("times is a whole number from 0 on", "times")
    size = F.count("*").over(Window.partitionBy(key)).cast("int")
    again = a.withColumn("_size", size).withColumn("_k", F.explode(F.array(*map(F.lit, range(times))).cast("array<int>")))
    return again.withColumn("n", F.col("n") + F.col("_k") * F.col("_size")).drop("_k", "_size")


def unique(a: DataFrame, key: str = KEY) -> DataFrame:
    """Each node where it comes first; one missing node at most."""
    first = F.row_number().over(Window.partitionBy(key, "id").orderBy("n"))
    return _renumbered(a.withColumn("_f", first).where("_f = 1").drop("_f"), [F.col("n")], key)


def concat(a: DataFrame, b: DataFrame, key: str = KEY) -> DataFrame:
    """`b` behind `a`, duplicates too."""
    both = a.withColumn("_part", F.lit(0)).unionByName(b.withColumn("_part", F.lit(1)))
    return _renumbered(both, [F.col("_part"), F.col("n")], key).drop("_part")


def union(a: DataFrame, b: DataFrame, key: str = KEY) -> DataFrame:
    return unique(concat(a, b, key), key)


def _among(a: DataFrame, b: DataFrame, how: str, key: str) -> DataFrame:
    ids = b.select(F.col(key).alias("o_key"), F.col("id").alias("o_id"))
    return unique(a.join(ids, (F.col(key) == F.col("o_key")) & F.col("id").eqNullSafe(F.col("o_id")), how), key)


def intersect(a: DataFrame, b: DataFrame, key: str = KEY) -> DataFrame:
    return _among(a, b, "left_semi", key)


def difference(a: DataFrame, b: DataFrame, key: str = KEY) -> DataFrame:
    return _among(a, b, "left_anti", key)


def _places(pages: DataFrame, places: Column, key: str) -> DataFrame:
    return pages.select(F.col(key).alias("p_key"), F.posexplode(places).alias("p_at", "p_n"))


def at(a: DataFrame, places: list[int], pages: DataFrame, key: str = KEY) -> DataFrame:
    """Aligned to `places`, from 1: the node there, missing beyond the end. Places below 0 leave nodes out."""
    if any(isinstance(p, bool) or not isinstance(p, int) or p == 0 for p in places) or (any(p < 0 for p in places) and any(p > 0 for p in places)):
        raise InputError("places are whole numbers, all from 1 on or all below 0", "places")
    if places and places[0] < 0:
        return _renumbered(a.where(~F.col("n").isin(*(-p for p in places))), [F.col("n")], key)
    asked = _places(pages, F.array(*map(F.lit, places)).cast("array<int>"), key)
    found = asked.join(a, (F.col("p_key") == F.col(key)) & (F.col("p_n") == F.col("n")), "left")
    return found.select(F.col("p_key").alias(key), (F.col("p_at") + 1).alias("n"), *(c for c in a.columns if c not in (key, "n")))


def length(a: DataFrame, n: int, pages: DataFrame, key: str = KEY) -> DataFrame:
    """The first `n` nodes, filled up with missing ones."""
    return at(a, list(range(1, n + 1)), pages, key)


def put(a: DataFrame, place: int, b: DataFrame | None, pages: DataFrame, key: str = KEY) -> DataFrame:
    """With the node at `place` replaced by the first of `b`, or by a missing one; filled up in between."""
    if isinstance(place, bool) or not isinstance(place, int) or place < 1:
        raise InputError("a place is a whole number from 1 on", "place")
    rest = [c for c in a.columns if c not in (key, "n")]
    sizes = a.groupBy(F.col(key).alias("c_key")).agg(F.count("*").cast("int").alias("size"))
    wide = pages.join(sizes, F.col(key) == F.col("c_key"), "left").select(F.col(key).alias("p_key"), F.explode(F.sequence(F.lit(1), F.greatest(F.coalesce("size", F.lit(0)), F.lit(place)))).alias("p_n"))
    kept = a.where(F.col("n") != place)
    new = kept.limit(0) if b is None else b.where("n = 1").withColumn("n", F.lit(place)).select(*a.columns)
    return wide.join(kept.unionByName(new), (F.col("p_key") == F.col(key)) & (F.col("p_n") == F.col("n")), "left").select(F.col("p_key").alias(key), F.col("p_n").alias("n"), *rest)
