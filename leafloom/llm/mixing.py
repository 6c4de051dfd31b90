"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations.

The weight of a source is its token share to the power of an exponent, normalised. The exponent lies between 0 (equal
weights) and 1 (the shares themselves) and is bisected to the smallest one that keeps every source within `max_repeats`
passes over its documents or, where `entropy` is given, to the one whose weights have that entropy (as a share of the entropy
of equal weights); the repetition limit then still holds. The budget is the least at which each source is used at least
once in full, so that no document is left out: the source of the smallest ratio of weight to share has exactly one pass.

A source's budget is met by whole passes, each a permutation of its blocks and of the documents in a block, and by a last
pass that stops where the budget is spent. Documents fall to blocks by hash, about BLOCK_ROWS to a block. Each pass orders blocks
and documents by hashes of its own; a document's place in a pass is the number of rows before it. Rows and tokens are summed by
block and by groups of blocks first, so that no source is ordered in one task.

Sums by source and by block are DataFrame aggregations; the driver receives only sums over sources, never sources.

Edge cases: a null source is a source of its own. Null and empty texts have no tokens and are used in every whole pass. With one
source, or with sources that have no tokens, every document is used once. Rows with repeated keys count each, ties in the order
go by the text's hash; rows without a key are dealt to blocks by it. An empty table gives an empty result. Further columns are
kept by `realise`, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafloom.llm.common import cut, free_names, table, text_of

MAX_REPEATS = 4.0
BLOCK_ROWS = 512
#: Digits of a hash in hex that name a group of blocks.
GROUP = 3
#: Halvings of the exponent's interval; four of them cost one job.
HALVINGS, A_JOB = 40, 4
SEED = 1


def tokens(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def exponent(sources: DataFrame, total: int, max_repeats: float, entropy: float | None) -> float:
    """The exponent for `sources` (a row each with n, its tokens > 0)."""
    share = F.log(F.col("n") / F.lit(float(total)))
    s = sources.select(share.alias("lp")).agg(F.count("*").alias("k"), F.max("lp").alias("high"), F.min("lp").alias("low")).first()
    if not s["k"] or s["k"] == 1 or s["high"] == s["low"]:
        return 1.0
    # passes of a source: (share / largest share) ^ (a - 1), at most max_repeats for the rarest one
    limit = lambda a: (s["low"] - s["high"]) * (a - 1) <= math.log(max_repeats)

    def halve(good) -> float:
        """The least a in [0, 1] for which good(a) holds; it holds at 1."""
        low, high = 0.0, 1.0
        if good([0.0])[0]:
            return 0.0
        for _ in range(HALVINGS // A_JOB):
            grid = [low + (high - low) * i / (1 << A_JOB) for i in range(1, 1 << A_JOB)]
            ok = good(grid)
            at = next((i for i, x in enumerate(ok) if x), len(grid))
            low, high = ([low, *grid][at], [*grid, high][at])
        return high

    a = halve(lambda grid: list(map(limit, grid)))
    if entropy is None:
        return a

    def flat_enough(grid: list[float]) -> list[bool]:
        lp = F.col("lp") - F.lit(s["high"])
        sums = sources.select(share.alias("lp")).agg(*(F.sum(F.exp(lp * x)).alias(f"z{i}") for i, x in enumerate(grid)), *(F.sum(F.exp(lp * x) * lp * x).alias(f"e{i}") for i, x in enumerate(grid))).first()
        return [(math.log(sums[f"z{i}"]) - sums[f"e{i}"] / sums[f"z{i}"]) / math.log(s["k"]) <= entropy for i in range(len(grid))]

    return max(a, halve(flat_enough) if flat_enough([1.0])[0] else 1.0)


def _mark(n: int, *parts: Column) -> Column:
    """A hash that orders what `parts` name, in the n-th way."""
    return F.md5(F.concat_ws(":", F.lit(str(n)), *parts))


def _before(sums: DataFrame, by: list[str], order: Column, *what: str) -> DataFrame:
    """`sums` (rows of blocks) with before_ of each of `what`: its sum over the blocks of `by` that come earlier in `order`, a hash in
    hex. First by its GROUP digits, then within those."""
    one = sums.withColumn("o", order).withColumn("g", F.substring("o", 1, GROUP))
    earlier = lambda keys, last: Window.partitionBy(*keys).orderBy(last).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    groups = one.groupBy(*by, "g").agg(*(F.sum(w).alias(f"g_{w}") for w in what))
    groups = groups.select(*(F.col(b).alias(f"of_{b}") for b in by), F.col("g").alias("of_g"), *((F.sum(f"g_{w}").over(earlier(by, "g")) - F.col(f"g_{w}")).alias(f"g_{w}") for w in what))
    inside = one.select("*", *((F.sum(w).over(earlier([*by, "g"], "o")) - F.col(w)).alias(f"in_{w}") for w in what))
    on = [F.col(b).eqNullSafe(F.col(f"of_{b}")) for b in [*by, "g"]]
    for more in on[1:]:
        on[0] = on[0] & more
    return inside.join(groups, on[0]).select(*sums.columns, *((F.col(f"in_{w}") + F.col(f"g_{w}")).alias(f"before_{w}") for w in what))


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", max_repeats: float = MAX_REPEATS, entropy: float | None = None) -> DataFrame:
    """A row for each row of docs: key, source, n_tokens, weight, block, passes (how often the document is used, 1 at least), tie (the
    text's hash)."""
    text_hash = F.md5(F.encode(text_of(text), "UTF-8"))
    order = _mark(SEED, F.coalesce(F.col(key).cast("string"), text_hash))
    rows = cut(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), tokens(text).alias("t"), order.alias("order"), F.xxhash64(text_of(text)).alias("tie")))
    sources = rows.groupBy("source").agg(F.sum("t").alias("n"), F.count("*").alias("rows"))
    sources = cut(sources)
    used = sources.where("n > 0")
    s = used.agg(F.sum("n").alias("total"), F.max("n").alias("most")).first()
    total, most = s["total"] or 1, s["most"] or 1
    a = exponent(used, total, max_repeats, entropy)
    z = used.agg(F.sum(F.pow(F.col("n") / F.lit(float(total)), F.lit(a))).alias("z")).first()["z"] or 1.0
    weight = F.when(F.col("n") > 0, F.pow(F.col("n") / F.lit(float(total)), F.lit(a)) / F.lit(z)).otherwise(0.0)
    passes = F.when(F.col("n") > 0, F.least(F.lit(float(max_repeats)), F.pow(F.col("n") / F.lit(float(most)), F.lit(a - 1)))).otherwise(1.0)
    budget = F.floor(passes * F.col("n") + F.lit(1e-6)).cast("long")
    shares = sources.select(F.col("source").alias("s"), weight.alias("weight"), F.when(F.col("n") > 0, F.floor(budget / F.col("n"))).otherwise(1).cast("long").alias("whole"), F.when(F.col("n") > 0, budget % F.col("n")).otherwise(0).alias("rest"), F.ceil(F.col("rows") / BLOCK_ROWS).cast("long").alias("blocks"))
    number = F.conv(F.substring("order", 1, 8), 16, 10).cast("long")
    dealt = rows.join(shares, rows["source"].eqNullSafe(shares["s"])).drop("s").withColumn("block", number % F.col("blocks"))
    # the last pass's own order decides whom the rest of the budget reaches
    sums = dealt.groupBy("source", "block").agg(F.sum("t").alias("bt"), F.first("whole").alias("whole"))
    last = F.col("whole") + 1
    before = _before(sums, ["source"], _mark(SEED + 1, last.cast("string"), F.col("block").cast("string")), "bt")
    before = before.select(F.col("source").alias("s"), F.col("block").alias("b"), F.col("before_bt").alias("before"))
    turn = _mark(SEED + 2, last.cast("string"), F.col("order"))
    inside = Window.partitionBy("source", "block").orderBy(turn, "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spent = dealt.withColumn("so_far", F.sum("t").over(inside)).join(before, dealt["source"].eqNullSafe(before["s"]) & (dealt["block"] == before["b"])).drop("s", "b")
    more = (F.col("before") + F.col("so_far") <= F.col("rest")) & (F.col("rest") > 0)
    return spent.select(F.col("key").alias(key), F.col("source").alias(source), F.col("t").alias("n_tokens"), "weight", "block", (F.col("whole") + more.cast("long")).alias("passes"), "tie", "order")


def ordered(planned: DataFrame, key: str = "doc_id", source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each use of a row of `plan`: key, source, tie, pass_no from 1, and place from 0: how many uses of the source come before
    it in the pass. keep: further columns of `plan` to hand on."""
    uses = planned.select(F.col(key).alias("key"), F.col(source).alias("source"), "block", "tie", "order", *(F.col(c).alias(f"keep_{c}") for c in keep), F.explode(F.sequence(F.lit(1).cast("long"), F.col("passes"))).alias("pass_no"))
    n = F.col("pass_no").cast("string")
    sums = uses.groupBy("source", "pass_no", "block").agg(F.count("*").alias("uses"))
    before = _before(sums, ["source", "pass_no"], _mark(SEED + 1, n, F.col("block").cast("string")), "uses")
    before = before.select(F.col("source").alias("s"), F.col("pass_no").alias("p"), F.col("block").alias("b"), "before_uses")
    inside = F.row_number().over(Window.partitionBy("source", "pass_no", "block").orderBy(_mark(SEED + 2, n, F.col("order")), "tie")) - 1
    placed = uses.withColumn("inside", inside).join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("pass_no") == F.col("p")) & (F.col("block") == F.col("b")))
    return placed.select(F.col("key").alias(key), F.col("source").alias(source), "tie", "pass_no", (F.col("before_uses") + F.col("inside")).alias("place"), *(F.col(f"keep_{c}").alias(c) for c in keep))


def realise(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", max_repeats: float = MAX_REPEATS, entropy: float | None = None, order: tuple[str, str] | None = None) -> DataFrame:
    """The rows of `docs`, each as often as the plan uses it. order: names of two columns to add, the pass and the place in it; reading
    a source by pass and place gives the permutations."""
    k, s, t, n, mine = free_names(docs, "use_key", "use_source", "use_tie", "use_pass", "use_mine")
    planned = plan(docs, key, text, source, max_repeats, entropy)
    rows = docs.withColumn(mine, F.xxhash64(text_of(text)))
    on = F.col(key).eqNullSafe(F.col(k)) & F.col(source).eqNullSafe(F.col(s)) & (F.col(mine) == F.col(t))
    if order is None:
        uses = planned.groupBy(F.col(key).alias(k), F.col(source).alias(s), F.col("tie").alias(t)).agg(F.max("passes").alias(n))
        return rows.join(uses, on).withColumn(t, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*docs.columns)
    if set(order) & set(docs.columns):
        raise ValueError("the columns of the order must be new ones")
    # rows alike in key, source and text share their uses: each of these takes one of them
    uses = ordered(planned, key, source).select(F.col(key).alias(k), F.col(source).alias(s), F.col("tie").alias(t), F.col("pass_no").alias(order[0]), F.col("place").alias(order[1]))
    one = rows.withColumn(n, F.row_number().over(Window.partitionBy(key, source, mine).orderBy(mine))).where(F.col(n) == 1)
    return one.join(uses, on).select(*docs.columns, *order)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its source's weight, its block, how often the mix uses it, for at most MAX_REPEATS passes, and its place in
    the first pass. All passes are realised: `passes` counts the uses that have a place."""
    uses = ordered(cut(plan(table(spark, sf_dir, "documents"))), keep=("n_tokens", "weight", "block"))
    # rows alike in all share their uses: `rows` of them, each used so often or once less; any place of theirs will do
    alike = uses.groupBy("doc_id", "source", "tie", "n_tokens", "weight", "block").agg(F.count("place").alias("uses"), F.count_if(F.col("pass_no") == 1).alias("rows"), F.min(F.when(F.col("pass_no") == 1, F.col("place"))).alias("place"))
    out = alike.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    passes = F.floor(F.col("uses") / F.col("rows")) + (F.col("row") <= F.col("uses") % F.col("rows")).cast("long")
    return out.select("doc_id", "source", "n_tokens", F.round("weight", 6).alias("weight"), "block", passes.alias("passes"), "place")


OP5_SQL = rf"""
WITH RECURSIVE r AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS t, md5('{SEED}:' || doc_id) AS o FROM documents),
s AS (SELECT source, sum(t)::BIGINT AS n, count(*) AS c FROM r GROUP BY source),
g AS (SELECT sum(n)::DOUBLE AS total, max(n) AS most, ln(max(n) / sum(n)::DOUBLE) AS high, ln(min(n) / sum(n)::DOUBLE) AS low FROM s WHERE n > 0),
b(i, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN b.low ELSE mid END, CASE WHEN ok THEN mid ELSE b.high END
  FROM (SELECT b.*, (b.low + b.high) / 2 AS mid, (g.low - g.high) * ((b.low + b.high) / 2 - 1) <= ln({MAX_REPEATS}) AS ok FROM b, g WHERE i < {HALVINGS}) AS b),
x AS (SELECT CASE WHEN g.low = g.high THEN 1.0 WHEN (g.low - g.high) * -1 <= ln({MAX_REPEATS}) THEN 0.0 ELSE b.high END AS a FROM b, g WHERE i = {HALVINGS}),
w AS (SELECT source, n, c, pow(n / total, a) AS p, least({MAX_REPEATS}, pow(n / most::DOUBLE, a - 1)) AS passes FROM s, g, x),
y AS (SELECT source, n, p / (SELECT sum(p) FROM w WHERE n > 0) AS weight, floor(passes * n + 1e-6)::BIGINT AS budget, ceil(c / {BLOCK_ROWS}.0)::BIGINT AS blocks FROM w),
d AS (SELECT r.*, n, weight, budget // n AS whole, budget % n AS rest, ('0x' || substr(o, 1, 8))::BIGINT % blocks AS block FROM r JOIN y USING (source)),
k AS (
  SELECT source, block, sum(bt) OVER (PARTITION BY source ORDER BY md5('{SEED + 1}:' || whole + 1 || ':' || block)) - bt AS before,
         sum(c) OVER (PARTITION BY source ORDER BY md5('{SEED + 1}:1:' || block)) - c AS before_rows
  FROM (SELECT source, block, whole, sum(t) AS bt, count(*) AS c FROM d GROUP BY source, block, whole)),
e AS (
  SELECT d.*, sum(t) OVER (PARTITION BY d.source, d.block ORDER BY md5('{SEED + 2}:' || whole + 1 || ':' || o) ROWS UNBOUNDED PRECEDING) AS so_far,
         row_number() OVER (PARTITION BY d.source, d.block ORDER BY md5('{SEED + 2}:1:' || o)) - 1 AS inside
  FROM d)
SELECT doc_id, source, t AS n_tokens, round(weight, 6) AS weight, block, whole + (before + so_far <= rest AND rest > 0)::BIGINT AS passes, (before_rows + inside)::BIGINT AS place
FROM e JOIN k USING (source, block)
"""
