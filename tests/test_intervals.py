"""Interval plans against plain loops, on trees of many shapes and with small blocks."""

import random

import pytest
from pyspark.sql import functions as F

from leafloom.plans import intervals
from leafloom.plans.intervals import around, holding, innermost, nearest, pairs, within


def tree(seed, n, wide):
    """(id, subtree_end) of a random tree in document order."""
    r = random.Random(seed)
    parent = [None] + [r.randrange(max(0, i - wide), i) for i in range(1, n)]
    for i in range(1, n):  # document order: a parent must be on the path to the node before
        p = i - 1
        for _ in range(r.randrange(4)):
            p = parent[p] if parent[p] is not None else p
        parent[i] = p
    end = list(range(n))
    for i in range(n - 1, 0, -1):
        end[parent[i]] = max(end[parent[i]], end[i])
    return [(i, end[i]) for i in range(n)]


@pytest.fixture(params=[(14, (6, 12, 18)), (3, (2, 4, 6))], ids=["as used", "small blocks"])
def sizes(request, monkeypatch):
    monkeypatch.setattr(intervals, "WINDOW_BITS", request.param[0])
    monkeypatch.setattr(intervals, "JOIN_BITS", request.param[1])


@pytest.fixture(scope="module")
def rows():
    return [(k, i, e, random.Random(i * 7 + k).random() < 0.2) for k, n in ((1, 300), (2, 40), (3, 1), (4, 130)) for i, e in tree(k, n, 5)]


def test_running_values(spark, rows, sizes):
    df = spark.createDataFrame(rows, "page_id long, id int, subtree_end int, f boolean")
    for stored in (False, True):
        got = {(r[0], r["id"]): r["in"] for r in within(df, {"in": F.col("f")}, ["page_id"], stored).collect()}
        assert got == {(k, i): any(f and p == k and a < i <= e for p, a, e, f in rows) for k, i, _, _ in rows}
        got = {(r[0], r["id"]): r["has"] for r in holding(df, {"has": F.col("f")}, ["page_id"], stored).collect()}
        assert got == {(k, i): any(f and p == k and i < a <= e for p, a, _, f in rows) for k, i, e, _ in rows}


@pytest.mark.parametrize("itself", [False, True])
def test_pairs_and_the_nearest(spark, rows, sizes, itself):
    df = spark.createDataFrame(rows, "page_id long, id int, subtree_end int, f boolean")
    around = df.where("f AND id > 0").select("page_id", "id", "subtree_end")
    got = sorted((str(r["page_id"]), r["o_id"], r["id"]) for r in pairs(around, df.select("page_id", "id"), ["page_id"], itself).collect())
    want = sorted((str(k), a, i) for k, a, e, f in rows if f and a for p, i, _, _ in rows if p == k and a + (not itself) <= i <= e)
    assert got == want and len(set(got)) == len(got)
    best = {}
    for k, a, i in want:
        best[k, i] = max(a, best.get((k, i), -1))
    assert {(str(r["page_id"]), r["id"]): r["n"] for r in nearest(around, df.select("page_id", "id"), ["page_id"], "n", itself).collect()} == {(str(k), i): best.get((str(k), i)) for k, i, _, _ in rows}


def test_blocks_of_an_interval_are_few_and_exact(spark):
    r = random.Random(5)
    some = [(a, a + r.choice([0, 3, 100, 5000, 70_000, 1_000_000, 3_900_000])) for a in [1, 2, 63, 64, 65, 4095, 4096, 262_143, 262_144, *(r.randrange(1, 200_000) for _ in range(40))]] + [(5, 4)]
    df = spark.createDataFrame(some, "a int, b int").select("a", "b", intervals.blocks_of_interval(F.col("a"), F.col("b")).alias("x"))
    for row in df.collect():
        a, b, blocks = row["a"], row["b"], [(x // 3, x % 3) for x in row["x"]]
        cut = sorted((n << intervals.JOIN_BITS[size], (n + 1 << intervals.JOIN_BITS[size]) - 1, size) for n, size in blocks)
        if a > b:
            assert not cut
            continue
        assert len(cut) <= 126 * 3 and cut[0][0] <= a <= cut[0][1] and cut[-1][0] <= b <= cut[-1][1]
        assert all(p[1] + 1 == q[0] for p, q in zip(cut, cut[1:], strict=False))
        assert all(p[2] == 0 or (p[0] >= a and p[1] <= b and p[0] > 0) for p in cut)


def test_a_large_page_is_split_over_tasks(spark):
    """A page of 400,000 nodes: windows are dealt by blocks, and what is joined grows with the answers, not with the square of the page."""
    n = 400_000
    page = spark.range(n).select(F.lit(1).cast("long").alias("page_id"), F.col("id").cast("int").alias("id"), F.when(F.col("id") % 100 == 0, F.least(F.col("id") + 99, F.lit(n - 1))).otherwise(F.col("id")).cast("int").alias("subtree_end"))
    flag = F.col("id") % 1000 == 0
    found = within(page, {"in": flag}, ["page_id"])
    assert found.where("in").count() == 99 * n // 1000
    held = [r["count"] for r in page.withColumn("b", F.shiftright("id", intervals.WINDOW_BITS)).groupBy("b").count().collect()]
    assert len(held) > 20 and max(held) <= 1 << intervals.WINDOW_BITS
    met = pairs(page.where(flag).select("page_id", "id", "subtree_end"), page.select("page_id", "id"), ["page_id"])
    assert met.count() == 99 * n // 1000
    left = page.where(flag).select(F.explode(intervals.blocks_of_interval(F.col("id") + 1, F.col("subtree_end"))).alias("b")).count()
    right = page.select(F.explode(intervals.blocks_of_node(F.col("id"))).alias("b")).count()
    assert left <= 3 * n // 1000 and right < 3 * n


def test_what_is_around(spark, rows):
    df = around(spark.createDataFrame(rows, "page_id long, id int, subtree_end int, f boolean"), {"d": F.col("f").cast("int"), "s": F.col("id") % 3 - 1}, ["page_id"])
    value = F.struct("id", "subtree_end")
    one = {(r[0], r["id"]): (r["d"], r["s"], r["o"] and tuple(r["o"])) for r in innermost(df, F.col("f"), "d", value, ["page_id"], "o").collect()}
    every = {(r[0], r["id"], r["o"] and r["o"]["id"]) for r in innermost(df, F.col("f"), "d", value, ["page_id"], "o", ~F.col("f")).where("not f").collect()}
    assert len(one) == len(rows)
    for k, i, e, f in rows:
        out = [(a, b, g) for p, a, b, g in rows if p == k and a < i <= b]
        flagged = [(a, b) for a, b, g in out if g]
        assert one[k, i] == (len(flagged), sum(a % 3 - 1 for a, _, _ in out), flagged[-1] if flagged and not f else None)
        assert f or {o for p, j, o in every if (p, j) == (k, i)} == ({a for a, _ in flagged} or {None})
