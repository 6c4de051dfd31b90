"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph (a line, without the words' spacing) hashes to a wide vector, and a document is the sum of its paragraphs'
vectors, lane by lane, modulo a power of two. The order of paragraphs does not matter, a paragraph can be added or taken away
by adding or subtracting its vector (`combine`), and the neutral element is the document without paragraphs. The vector has two
parts:

* EXACT lanes modulo 2^32, two from each of EXACT / 2 seeded hashes of the paragraph. Equality of these is equality of the
  multisets of paragraphs, but for chance of about 2^-(32 EXACT).
* SKETCH lanes modulo 2^16: each run of SHINGLE words in the paragraph adds +1 or -1 to one lane. This part is a sum over the
  paragraph's runs, thus over the document's; the cosine of two documents' sketches estimates the cosine of their counts of
  runs, with an error of about 1 / sqrt(SKETCH), and is the likeness (0 where negative, or where one side has no words).

An edited text is not hashed from nothing: its fingerprint is the text's own, less the paragraphs from the cut on, plus those that
take their place. The next document's sketch is that document's own.

To stand beside the next one in ascending order of key, documents are dealt to ranges of keys of about RANGE_ROWS rows, the
only time that texts are shuffled; the last of a range takes the first of the next range. Rows without a key, and those of a key
that holds many rows, are dealt to ranges of the text's hash. The steps are DataFrame expressions.

Edge cases: a null or empty text has no paragraphs: its fingerprint is all zeros, its likeness to another such text is 1 and
to any other 0. Paragraphs shorter than SHINGLE words count as one run. Among repeated keys the order is by hash of the text;
rows alike in all count each. Rows with a null key come first in the order. A single document is its own next one. An empty
table gives an empty result. Only the named columns are read, so further ones cannot clash.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafloom.llm.common import table, text_of

EXACT, SKETCH, SHINGLE = 8, 128, 3
EXACT_MOD, SKETCH_MOD = 1 << 32, 1 << 16
#: Documents of a range in which each finds the next one, and the most cuts between ranges that are held as literals;
#: further ranges divide those evenly.
RANGE_ROWS, CUTS = 1_000, 1_024
#: Ranges of hashes within a range of keys, at most; ranges whose order is told in one task.
SUB, TOGETHER = 1 << 20, 1 << 12
SPACE = r"[\x20\x09-\x0D]+"


def paragraphs(text: Column) -> Column:
    """The words of each paragraph; lines without words are none."""
    words = F.transform(F.split(text, "\n"), lambda line: F.filter(F.split(line, SPACE), lambda w: w != ""))
    return F.filter(words, lambda w: F.size(w) > 0)


def exact(joined: Column) -> Column:
    """The EXACT lanes of paragraphs, whose words are joined by a space: an array of numbers."""
    total = lambda i, part: F.aggregate(F.transform(joined, lambda p: part(F.xxhash64(F.lit(i), p))), F.lit(0).cast("long"), lambda acc, x: acc + x)
    halves = (lambda h: h.bitwiseAND(F.lit(EXACT_MOD - 1)), lambda h: F.shiftrightunsigned(h, 32))
    return F.array(*(total(i, part) % EXACT_MOD for i in range(EXACT // 2) for part in halves))


def _hex(lanes: Column, digits: int) -> Column:
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), digits, "0")), "")


def runs(words: Column) -> Column:
    """The runs of SHINGLE words of a paragraph as structs; a shorter paragraph is one run."""
    n = F.size(words)
    short = F.array(F.struct(*(F.get(words, F.lit(k)).alias(str(k)) for k in range(SHINGLE))))
    return F.when(n < SHINGLE, short).otherwise(F.arrays_zip(*(F.slice(words, k + 1, n - SHINGLE + 1).alias(str(k)) for k in range(SHINGLE))))


def _signed(c: Column) -> Column:
    """A sum modulo SKETCH_MOD, as the number around 0."""
    return F.pmod(c + SKETCH_MOD // 2, F.lit(SKETCH_MOD)) - SKETCH_MOD // 2


def sketches(rows: DataFrame, keys: list[str], parts: dict[str, str]) -> DataFrame:
    """`keys` and an array of all SKETCH lanes in order, as structs of a sum for each name in `parts`, which names columns of paragraphs.

    Where `keys` hold the columns by which `rows` is partitioned, nothing is shuffled."""
    # one paragraph more, of the lanes' numbers, which weighs nothing: so that every lane of every row is there
    every = F.struct(F.lit(-1).alias("of"), F.array(F.array(*(F.lit(str(i)) for i in range(SKETCH)))).alias("p"))
    each = rows.select(*keys, F.explode(F.array(every, *(F.struct(F.lit(i).alias("of"), F.col(c).alias("p")) for i, c in enumerate(parts.values())))).alias("x"))
    lines = each.select(*keys, "x.of", F.explode("x.p").alias("w"))
    alone = F.arrays_zip(F.col("w").alias("0"), *(F.array().cast("array<string>").alias(str(k)) for k in range(1, SHINGLE)))
    found = lines.select(*keys, "of", F.explode(F.when(F.col("of") < 0, alone).otherwise(runs(F.col("w")))).alias("s"))
    hashed = found.select(*keys, "of", F.when(F.col("of") < 0, F.col("s.0").cast("long")).otherwise(F.xxhash64(*(f"s.{k}" for k in range(SHINGLE)))).alias("h"))
    sign = F.when(F.shiftright("h", 32).bitwiseAND(F.lit(1)) == 0, 1).otherwise(-1)
    sums = hashed.groupBy(*keys, F.pmod("h", F.lit(SKETCH)).cast("int").alias("lane")).agg(*(F.sum(F.when(F.col("of") == i, sign).otherwise(0)).alias(name) for i, name in enumerate(parts)))
    return sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("lane", *parts))).alias("lanes"))


def sketch_text(lanes: Column) -> Column:
    """An array of lanes, those that are not 0: two hex digits of the lane, four of the sum."""
    digits = F.transform(lanes, lambda n, i: F.when(n != 0, F.concat(F.lpad(F.lower(F.hex(i)), 2, "0"), F.lpad(F.lower(F.hex(F.pmod(n, F.lit(SKETCH_MOD)))), 4, "0"))))
    return F.array_join(digits, "")  # nulls are left out


def likeness(a: Column, b: Column) -> Column:
    """The cosine of two sketches (arrays of lanes), from 0 to 1; two empty ones are alike."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0).cast("long"), lambda acc, v: acc + v)
    aa, bb = dot(a, a), dot(b, b)
    both = F.when((aa == 0) & (bb == 0), 1.0).when((aa == 0) | (bb == 0), 0.0).otherwise(dot(a, b) / F.sqrt(aa.cast("double") * bb))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), both))


def combine(a: Column, b: Column, take_away: bool = False) -> Column:
    """The fingerprint of the paragraphs of two fingerprinted texts together, or of those of `a` without those of `b`."""
    number = lambda s: F.conv(s, 16, 10).cast("long")
    sign = -1 if take_away else 1

    def numbers(c: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(EXACT - 1)), lambda i: number(F.substring(c, i * 8 + 1, F.lit(8))))

    def lanes(c: Column) -> Column:
        sketch = F.substring_index(c, ":", -1)
        places = F.when(F.length(sketch) > 0, F.sequence(F.lit(0), F.floor(F.length(sketch) / 6).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
        at = lambda i, n: i * 6 + n
        return F.map_from_entries(F.transform(places, lambda i: F.struct(number(F.substring(sketch, at(i, 1), F.lit(2))), number(F.substring(sketch, at(i, 3), F.lit(4))))))

    first = F.zip_with(numbers(a), numbers(b), lambda x, y: F.pmod(x + sign * y, F.lit(EXACT_MOD)))
    of = lambda m, i: F.coalesce(F.try_element_at(m, i), F.lit(0))
    p, q = lanes(a), lanes(b)
    second = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(SKETCH - 1).cast("long")), lambda i: _signed(of(p, i) + sign * of(q, i)))
    return F.concat(_hex(first, 8), F.lit(":"), sketch_text(second))


def successors(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """bucket, at (from 1 in the bucket), key, text, next_text, the text of the row with the next key (the last row's next one is the first),
    and last, whether that is a row of another bucket.

    The result is partitioned by bucket."""
    rows = docs.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text"))
    shape = rows.agg(F.count("*").alias("n"), F.count("key").alias("keys"), F.min("key").alias("low"), F.max("key").alias("high")).first()
    rows = rows.withColumn("bucket", _range(rows, shape["n"], shape["keys"], shape["low"], shape["high"]))
    inside = Window.partitionBy("bucket").orderBy("key", F.xxhash64("text"), "text")
    dealt = rows.repartition("bucket")
    held = dealt.select("bucket", F.row_number().over(inside).alias("at"), "key", "text", F.lead("text").over(inside).alias("inner"))
    first = held.where("at = 1").select(F.col("bucket").alias("of"), F.col("text").alias("outer"))
    outer = _following(rows.groupBy("bucket").agg(F.count("*").alias("n"))).join(first, F.col("to") == F.col("of")).select("bucket", "outer")
    return held.join(outer, "bucket", "left").select("bucket", "at", "key", "text", F.coalesce("inner", "outer").alias("next_text"), F.col("inner").isNull().alias("last"))


def _following(buckets: DataFrame) -> DataFrame:
    """bucket and `to`, the next one in order; the last one's is the first. One task orders the buckets of a group, and one the groups."""
    grouped = buckets.select("bucket", F.floor(F.col("bucket") / (SUB * TOGETHER)).alias("g"))
    groups = grouped.groupBy("g").agg(F.min("bucket").alias("first"))
    order = Window.orderBy("g")
    turn = F.coalesce(F.lead("first").over(order), F.first("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ends = groups.select(F.col("g").alias("of_g"), turn.alias("after"))
    near = grouped.withColumn("near", F.lead("bucket").over(Window.partitionBy("g").orderBy("bucket")))
    return near.join(ends, F.col("g") == F.col("of_g")).select("bucket", F.coalesce("near", "after").alias("to"))


def _range(rows: DataFrame, n: int, keys: int, low: int | None, high: int | None) -> Column:
    """A number that does not fall in the order of rows, of about n / RANGE_ROWS values of equal counts; below 0 for null keys."""
    share = F.xxhash64("text") / F.lit(2.0**64) + 0.5  # grows with the hash
    part_of = lambda parts: F.least(F.lit(parts - 1), F.floor(share * parts)).cast("long")
    nulls = min(SUB, max(1, (n - keys) // RANGE_ROWS))
    without = part_of(nulls) - nulls
    ranges = max(1, keys // RANGE_ROWS)
    if ranges == 1:
        return F.when(F.col("key").isNull(), without).otherwise(0).cast("long")
    cuts = min(CUTS, ranges)
    found = Counter(rows.agg(F.percentile_approx("key", [i / cuts for i in range(1, cuts)], 100 * cuts).alias("c")).first()["c"])
    bounds, parts = F.array(*map(F.lit, sorted(found))).cast("array<bigint>"), -(-ranges // cuts)
    k = F.size(F.filter(bounds, lambda b: b <= F.col("key")))
    a, b = F.coalesce(F.get(bounds, k - 1), F.lit(low)), F.coalesce(F.get(bounds, k), F.lit(high + 1))
    part = F.least(F.lit(parts - 1), F.floor((F.col("key") - a) / F.greatest(F.lit(1), b - a) * parts)) if parts > 1 else F.lit(0)
    sub = F.lit(SUB - 1).cast("long")  # after the hot key that begins the range, if there is one
    for hot, times in sorted(found.items()):
        if times > 1:  # a key that fills whole ranges
            sub = F.when(F.col("key") == hot, part_of(min(SUB - 1, times * parts))).otherwise(sub)
    return F.when(F.col("key").isNull(), without).otherwise((k * parts + part) * SUB + sub).cast("long")


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, n_chars, edited (the text whose last quarter is the next one's beginning), fingerprints of both, and likenesses."""
    n, k = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    cut = F.substring_index(F.left("text", n - k), "\n", -1)  # what stands before the cut in its paragraph
    pairs = successors(docs, key, text)
    at = ["bucket", "at"]
    nothing = F.array().cast("array<array<string>>")
    split = pairs.select(
        *at, "key", n.cast("long").alias("n_chars"), F.sha2(F.concat(F.left("text", n - k), F.left("next_text", k)), 256).alias("edited_sha256"), paragraphs(F.col("text")).alias("own"), paragraphs(F.concat(cut, F.right("text", k))).alias("gone"),
        paragraphs(F.concat(cut, F.left("next_text", k))).alias("come"), F.when(F.col("last"), paragraphs(F.col("next_text"))).otherwise(nothing).alias("after"),
    )
    joined = split.select(*at, "key", "n_chars", "edited_sha256", *(F.transform(c, lambda w: F.array_join(w, " ")).alias(c) for c in ("own", "gone", "come")))
    lanes = joined.select(*at, "key", "n_chars", "edited_sha256", *(exact(F.col(c)).alias(f"e{i}") for i, c in enumerate(("own", "gone", "come"))))
    edited = F.zip_with("e0", F.zip_with("e2", "e1", lambda x, y: x - y), lambda x, y: F.pmod(x + y, F.lit(EXACT_MOD)))
    plain = lanes.select(*at, "key", "n_chars", "edited_sha256", _hex(F.col("e0"), 8).alias("f0"), _hex(edited, 8).alias("f1"))
    sums = sketches(split, at, {"own": "own", "gone": "gone", "come": "come", "after": "after"})
    one = lambda n: F.transform("lanes", lambda x: _signed(n(x)))
    sketch = sums.select(*at, one(lambda x: x["own"]).alias("s0"), one(lambda x: x["own"] - x["gone"] + x["come"]).alias("s1"), one(lambda x: x["after"]).alias("s2"))
    order = Window.partitionBy("bucket").orderBy("at")
    both = plain.join(sketch, at).withColumn("s2", F.coalesce(F.lead("s0").over(order), "s2"))
    return both.select(
        F.col("key").alias(key), "n_chars", "edited_sha256", F.concat("f0", F.lit(":"), sketch_text(F.col("s0"))).alias("fingerprint"), F.concat("f1", F.lit(":"), sketch_text(F.col("s1"))).alias("edited_fingerprint"),
        likeness(F.col("s0"), F.col("s1")).alias("near_edited"), likeness(F.col("s0"), F.col("s2")).alias("near_next"),
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint, its edited text's, and the likenesses to the edited and to the next text."""
    return fingerprint(table(spark, sf_dir, "documents").select("doc_id", "text"))
