"""Filter interaction audit: what each of five filters removes, alone, in every order, and by its Shapley value.

A document's failures are a mask of five bits, and only the counts of masks of each part matter (32 at most). They give the part's
removal polynomial: the multilinear extension of "how many documents do the filters of S remove", one variable a filter. At a
corner of the cube it is that number, so that corners along an order give what is kept, removed and redundant at each step.
A filter's Shapley value is the integral of its partial derivative along the cube's diagonal, taken with exact rationals, and
scaled by the number of orders it is whole. Documents that are good or toxic have polynomials of their own.

Conditions A to D depend on the text alone. E (a text that a smaller doc_id has too) needs each text's smallest doc_id: texts are
compared by SHA-256, rows are counted by document first and by text and part next, so that a hot text is met as few rows.

Edge cases: a null text is empty, a null lang is the part ''. A row with a null doc_id is never a copy, makes none, and has no labels.
Rows alike in doc_id and text are no copies of each other. A document is good (toxic) if any of its labels says 1. An empty table gives
an empty result. Only the named columns are read, so further ones cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafloom.llm.common import table, text_of

FILTERS = "ABCDE"
COUNTS = ("n", "good", "toxic")
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


# -- polynomials ---------------------------------------------------------------------------------------------------------


def removal_polynomial(counts: dict[int, int], n: int) -> dict[int, int]:
    """Coefficients, by the set of variables (a mask), of the sum over masks m of counts[m] * (1 - product of (1 - x_i) over i in m)."""
    out: dict[int, int] = {}
    for m, c in counts.items():
        inner = m
        while inner:  # each subset of m but the empty one, whose terms cancel
            out[inner] = out.get(inner, 0) + (c if bin(inner).count("1") % 2 else -c)
            inner = (inner - 1) & m
    return {k: v for k, v in out.items() if v and k < 1 << n}


def at_corner(polynomial: dict[int, int], corner: int) -> int:
    """The value where the variables of `corner` are 1 and the others 0."""
    return sum(v for k, v in polynomial.items() if k & corner == k)


def shapley(polynomial: dict[int, int], i: int) -> Fraction:
    """The partial derivative by variable `i`, integrated along the diagonal from 0 to 1."""
    bit, diagonal = 1 << i, {}
    for k, v in polynomial.items():
        if k & bit:
            degree = bin(k).count("1") - 1
            diagonal[degree] = diagonal.get(degree, 0) + v
    return sum((Fraction(v, d + 1) for d, v in diagonal.items()), Fraction(0))


def audited(counts: dict[str, dict[int, int]], filters: str = FILTERS) -> Iterator[tuple]:
    """The rows of one part (without its name), of all orders and steps. counts: of each kind of documents, by mask."""
    size = len(filters)
    total, everything = sum(counts["n"].values()), (1 << size) - 1
    removal = {k: removal_polynomial(c, size) for k, c in counts.items()}
    corner = {k: [at_corner(p, c) for c in range(1 << size)] for k, p in removal.items()}
    values = [shapley(removal["n"], i) * factorial(size) for i in range(size)]
    if any(v.denominator != 1 for v in values):
        raise ArithmeticError("a scaled Shapley value is not whole")
    gone = corner["n"]
    for order in permutations(range(size)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = gone[after] - gone[before]
            lost = {k: corner[k][after] - corner[k][before] for k in ("good", "toxic")}
            yield ("".join(filters[j] for j in order), step, total - gone[after], removed, gone[1 << i] - removed, gone[everything] - gone[everything ^ 1 << i], lost["good"], lost["toxic"], int(values[i]))
            before = after


# -- counts of masks -----------------------------------------------------------------------------------------------------


def conditions(t: Column, words: Column) -> list[Column]:
    """Failure of A to D, of a text without nulls and its words."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(t, "[^A-Z]+", ""))
    return [n < 200, 100 * distinct < 50 * n, 100 * capitals > 3 * F.length(t), t.rlike("[#$%&*|]")]


def masks(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, mask (bit 0: A fails, to bit 4: E fails), n, good, toxic: 32 rows a part at most."""
    one = docs.select(F.col(key).alias("k"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_of(text).alias("t"))
    one = one.withColumn("words", F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda w: w != ""))  # a step of its own, so that words are found once
    bits = sum((c.cast("int") * (1 << i) for i, c in enumerate(conditions(F.col("t"), F.col("words")))), F.lit(0))
    told = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("l")).agg(*(F.coalesce(F.max((F.col(c) == 1).cast("long")), F.lit(0).cast("long")).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))))
    seen = one.where("k IS NOT NULL").select("k", "part", F.unhex(F.sha2("t", 256)).alias("text"), bits.alias("mask"))
    flag = lambda c: F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c)  # noqa: E731  alike in all rows of a document
    documents = seen.join(told, F.col("k") == F.col("l"), "left").groupBy("k", "part", "text", "mask").agg(F.count("*").alias("n"), flag("good"), flag("toxic"))
    first = F.min(F.struct("k", "n", (F.col("n") * F.col("good")).alias("good"), (F.col("n") * F.col("toxic")).alias("toxic"))).alias("first")
    texts = documents.groupBy("text", "part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"), first)
    own = F.col("first.k") == F.min("first.k").over(Window.partitionBy("text"))  # one row for each part that the text is in
    kept = {c: F.when(F.col("own"), F.col(f"first.{c}")).otherwise(F.lit(0).cast("long")) for c in COUNTS}
    split = texts.withColumn("own", own).select("part", "mask", *(v.alias(c) for c, v in kept.items()), *((F.col(c) - v).alias(f"copy_{c}") for c, v in kept.items()))
    few = split.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in (*COUNTS, *(f"copy_{c}" for c in COUNTS))))
    both = few.select("part", F.explode(F.array(F.struct("mask", *COUNTS), F.struct((F.col("mask") + 16).alias("mask"), *(F.col(f"copy_{c}").alias(c) for c in COUNTS)))).alias("x")).select("part", "x.*")
    nameless = one.where("k IS NULL").select("part", bits.alias("mask")).groupBy("part", "mask").agg(F.count("*").alias("n")).select("part", "mask", "n", *(F.lit(0).cast("long").alias(c) for c in COUNTS[1:]))
    return both.unionByName(nameless).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in COUNTS)).where("n > 0")


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """A row for each part, order and step (see SCHEMA). labels: key, quality, toxic."""
    parts = masks(docs, labels, key, text, part).groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("m"))  # 32 a part at most

    def run(batches):
        for b in batches:
            for name, held in zip(b.column("part").to_pylist(), b.column("m").to_pylist(), strict=True):
                rows = list(zip(*audited({c: {x["mask"]: x[c] for x in held} for c in COUNTS}), strict=True))
                kinds = [pa.string(), pa.int32(), *[pa.int64()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows[0]), pa.string()), *(pa.array(c, k) for c, k in zip(rows, kinds, strict=True))], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return parts.mapInArrow(run, SCHEMA)


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by lang, under the filters A to E in all 120 orders."""
    return audit(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


#: From the definitions, order by order, without polynomials.
OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'),
   coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)] AS fails FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
i AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT part, o, i AS step, o[i] AS f, fails[o[i]] AS failing, list_bool_or(list_transform(o[1:i - 1], lambda x: fails[x])) IS TRUE AS gone,
  len(list_filter(fails, lambda x: x)) = 1 AS alone, n, good, toxic FROM g, o, i),
r AS (SELECT part, list_reduce(list_transform(o, lambda x: 'ABCDE'[x]), lambda x, y: x || y) AS filter_order, step::INT AS step, f,
  sum(CASE WHEN gone OR failing THEN 0 ELSE n END)::BIGINT AS kept, sum(CASE WHEN failing AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN failing AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN failing AND alone THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN failing AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN failing AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM s GROUP BY part, o, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r
"""
