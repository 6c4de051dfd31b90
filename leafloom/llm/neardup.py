"""MinHash near-dedup with DartMinHash signatures of weighted word shingles.

A text is the weighted set of its runs of SHINGLE words, each weighing as often as it occurs; two texts are near copies if
the weighted Jaccard similarity is THRESHOLD or more. Classes are the connected components of near copies.

1. Texts are told apart by digest, so that copies cost one row each and no comparison. 2. Each different text gets a signature
of BANDS * ROWS darts and a number for each band; a pair at the threshold misses every band with a probability of
(1 - THRESHOLD^ROWS)^BANDS, 7e-5. Buckets that hold the same texts are one bucket. 3. In each bucket, every text is compared
with one leader, never with all others, and the comparison is exact, on whole texts. The leader is the text that meets most
others over all its buckets. Links become classes. Among the texts outside a bucket's largest class this is repeated with
other leaders, as long as WORTH of a turn's comparisons are links; these turns only save work. 4. The rest is exact: every two
texts of different classes in a bucket are compared, unless their sizes or sketches (bounds, not estimates) rule it out. The
bounds are tested between the texts outside a bucket's largest class and the bucket, in squares of BLOCK rows a side, and few
pairs that are no links pass them. Where many remain, each text is compared with FEW others in a turn and pairs that links
have joined meanwhile are left out, until none remains.

Links, classes and signatures stay distributed. Buckets and hot texts are joined, so that Spark may split them.

Edge cases: a null text is an empty one; texts without words form one class per distinct text. Fewer than SHINGLE words are one
run. Repeated rows and repeated or null doc_ids get the class of their text; a class is named by its smallest doc_id (null if
all are null). An empty table gives an empty result. Only the named columns are read, so others cannot clash; `deduplicate`
keeps all columns of its input, whatever their names. Of rows with equal key and text it keeps one.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafloom.llm.common import cut, discard, free_names, table, text_of, work_path
from leafloom.llm.dartminhash import Darts, bands, jaccard, shingles

SHINGLE, THRESHOLD, ROWS, BANDS = 5, 0.8, 7, 40
#: Turns of leaders go on while this share of a turn's comparisons are links. The rest is settled pair by pair.
WORTH = 0.05
#: Texts whose darts are thrown together, at most, and their bytes; digests that a worker remembers as signed.
TOGETHER, TOGETHER_BYTES, REMEMBERED = 64, 1 << 19, 1 << 16
#: Shingle sets that a worker keeps while it compares.
KEPT_SETS = 256
#: Sketches of texts of up to 2^LEVEL - 1 runs have 2^(LEVEL + 1) slots, which fill WIDTH longs; those of longer ones grow with the text.
LEVEL, WIDTH = 8, 16
#: Rows of a bucket that meet each other in one group; larger buckets are cut into squares of this side.
BLOCK = 2048
#: Pairs of a text that are compared in a turn of the rest, if there are more than that for each text; else all are.
FEW = 4


def signed(texts: DataFrame, threshold_rows: int = ROWS, n_bands: int = BANDS) -> DataFrame:
    """(key, digest, text) to (key, digest, bands): the bands' numbers, null for texts without words.

    A text that a worker remembers gets null: copies are signed once for each task, or seldom more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        darts, met = Darts(threshold_rows * n_bands), OrderedDict()

        def flush(group: list[tuple[int, bytes]], out: list) -> None:
            ids, weights, of = shingles([t for _, t in group], SHINGLE)
            found = bands(darts.signatures(ids, weights, of, len(group)), threshold_rows)
            full = np.bincount(of, minlength=len(group)) > 0
            for (i, _), row, there in zip(group, found, full, strict=True):
                if there:
                    out[i] = row.view(np.int64)

        for b in batches:
            out: list = [None] * b.num_rows
            group, size = [], 0
            for i, (digest, text) in enumerate(zip(b.column("digest").to_pylist(), b.column("text"), strict=True)):
                if digest in met:
                    met.move_to_end(digest)
                    continue
                met[digest] = None
                if len(met) > REMEMBERED:
                    met.popitem(last=False)
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                group.append((i, raw))
                size += len(raw)
                if len(group) >= TOGETHER or size >= TOGETHER_BYTES:
                    flush(group, out)
                    group, size = [], 0
            if group:
                flush(group, out)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("digest"), pa.array(out, pa.list_(pa.int64()))], names=["key", "digest", "bands"])

    return texts.mapInArrow(run, "key long, digest binary, bands array<long>")


def compared(pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, ta, tb) to the (a, b) whose texts are near copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict = OrderedDict()

        def of(node: int, text: pa.Scalar):
            if node not in kept:
                kept[node] = shingles([text.as_buffer().to_pybytes()], SHINGLE)[:2]
                if len(kept) > KEPT_SETS:
                    kept.popitem(last=False)
            else:
                kept.move_to_end(node)
            return kept[node]

        for b in batches:
            near = [jaccard(of(x, t), of(y, u)) >= threshold for x, y, t, u in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), b.column("ta"), b.column("tb"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def sketched(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, text) to (node, level, own, size, over, sketch): the number of runs, how many of them the sketch does not show, and the sketch.

    Runs fall into 2^(level + 1) slots by hash; the first half of the sketch's bits tells which slots hold a run, the second which
    hold two. Two texts share no more runs than their sketches of one level share bits, plus the lesser `over`. A text has a row
    for its own level and, where its near copies may have the next one, a row for that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for node, text in zip(b.column("node").to_pylist(), b.column("text"), strict=True):
                ids, counts, _ = shingles([text.as_buffer().to_pybytes()], SHINGLE)
                size = int(counts.sum())
                own = max(LEVEL, size.bit_length())
                for level in (own, own + 1) if size >= threshold * (1 << own) else (own,):
                    slots = 2 << level
                    held = np.bincount((ids % np.uint64(slots)).astype(np.int64), counts, slots)
                    rows.append((node, level, level == own, size, int(np.maximum(held - 2, 0).sum()), np.packbits(np.concatenate([held >= 1, held >= 2])).view(np.int64)))
            kinds = pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["node", "level", "own", "size", "over", "sketch"])

    return texts.mapInArrow(run, "node long, level int, own boolean, size long, over long, sketch array<long>")


def classed(shared: DataFrame, at: DataFrame) -> DataFrame:
    """Rows of buckets (bucket, node, weight) that hold several classes, with class, main (the bucket's largest class), n and others
    (the bucket's rows, and those outside main). at: classes (v, class)."""
    rows = shared.join(at, shared["node"] == at["v"], "left").select("bucket", "node", "weight", F.coalesce("class", "node").alias("class"))
    counts = rows.groupBy("bucket", "class").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.sum("c").alias("n"), F.max(F.struct("c", "class")).alias("m"))
    mixed = counts.select("bucket", "n", (F.col("n") - F.col("m.c")).alias("others"), F.col("m.class").alias("main")).where("others > 0")
    return rows.join(mixed, "bucket")


def remaining(rows: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """All (a, b), a < b, that meet in a bucket, are of different classes and may be near copies by their sizes and sketches.

    rows: see `classed`. held: texts (node, text). The rows outside the largest class meet the bucket's rows in squares of
    BLOCK x BLOCK, so that no task gets a large bucket whole."""
    met = rows.join(sketched(held.join(rows.select("node").distinct(), "node", "left_semi"), threshold), "node")
    deal = lambda n: F.pmod(F.xxhash64("node"), F.ceil(F.col(n) / BLOCK)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.ceil(F.col(n) / BLOCK) - 1).cast("int")))
    c = lambda side, name: F.col(f"{side}.{name}")
    least = (c("l", "size") + c("r", "size")) * F.lit(threshold / (1 + threshold) - 1e-9)  # of common runs
    sizes = F.least(c("l", "size"), c("r", "size")) >= least
    # the largest class is on the right alone; of two rows outside it, each stands on both sides
    pair = (c("l", "class") != c("r", "class")) & (c("l", "own") | c("r", "own")) & ((c("r", "class") == c("r", "main")) | (c("l", "node") < c("r", "node")))
    cell = [c("l", k) == c("r", k) for k in ("bucket", "level", "part", "other")]

    def joined(some: DataFrame, common: Column) -> DataFrame:
        l = some.where("class <> main").withColumn("part", deal("others")).withColumn("other", every("n")).alias("l")
        r = some.withColumn("other", deal("n")).withColumn("part", every("others")).alias("r")
        both = l.join(r, cell[0] & cell[1] & cell[2] & cell[3] & pair & sizes & (F.least(c("l", "over"), c("r", "over")) + common >= least))
        return both.select(F.least(c("l", "node"), c("r", "node")).alias("a"), F.greatest(c("l", "node"), c("r", "node")).alias("b"))

    short = met.where(F.col("level") == LEVEL).select("*", *(F.col("sketch")[i].alias(f"s{i}") for i in range(WIDTH))).drop("sketch")
    columns = sum((F.bit_count(c("l", f"s{i}").bitwiseAND(c("r", f"s{i}"))) for i in range(WIDTH)), F.lit(0))
    shared = F.zip_with(c("l", "sketch"), c("r", "sketch"), lambda x, y: F.bit_count(x.bitwiseAND(y)))
    long = F.aggregate(shared, F.lit(0), lambda total, n: total + n)
    return joined(short, columns).union(joined(met.where(F.col("level") > LEVEL), long)).distinct()


def components(links: DataFrame) -> DataFrame:
    """(v, class) for each end of `links` (a, b): the smallest end of its component.

    Each step takes the least class of a node and its neighbours, then twice that class's own class; steps go on until nothing
    changes."""
    both = links.select(F.col("a").alias("v"), F.col("b").alias("u")).union(links.select("b", "a"))
    at = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("class"))
    while True:
        near = both.join(at.toDF("u", "c"), "u").groupBy("v").agg(F.min("c").alias("m"))
        new = at.join(near, "v").select("v", F.col("class").alias("old"), F.least("class", "m").alias("class"))
        for _ in range(2):
            new = new.join(at.toDF("w", "up"), F.col("class") == F.col("w")).select("v", "old", F.least("class", "up").alias("class"))
        new = cut(new)
        at = new.select("v", "class")
        if new.where("class <> old").isEmpty():
            return at


def candidates(rows: DataFrame, turn: int) -> DataFrame:
    """From rows of buckets (bucket, node, weight, and class from the second turn on): each node with its bucket's leader, where they
    are of different classes, as (a, b) with a < b. In the first two turns the heaviest node leads, later chance decides."""
    order = F.struct((-F.col("weight") if turn < 2 else F.xxhash64("node", "bucket", F.lit(turn))).alias("order"), "node", *(["class"] if turn else []))
    lead = rows.groupBy("bucket").agg(F.min(order).alias("l")).select("bucket", F.col("l.node").alias("head"), *([F.col("l.class").alias("head_class")] if turn else []))
    met = rows.join(lead, "bucket").where("class <> head_class" if turn else "node <> head")
    return met.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of `docs`: key, digest of the text, class_id (the class's smallest key), keep (one key and digest a class)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text"))
    docs = docs.withColumn("digest", F.unhex(F.md5(F.encode("text", "UTF-8"))))
    texts = docs.select("key", "digest").groupBy("digest").agg(F.min("key").alias("first"))
    nodes = cut(texts.select("digest", "first", F.monotonically_increasing_id().alias("node")))
    numbers = signed(docs).where(F.col("bands").isNotNull()).groupBy(F.col("digest").alias("d")).agg(F.first("bands").alias("bands"))
    rows = numbers.join(nodes, F.col("d") == F.col("digest")).select("node", F.explode("bands").alias("bucket"))
    alike = [F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"x{i}") for i in range(2)]  # equal for buckets of the same texts
    several = rows.groupBy("bucket").agg(F.count("*").alias("n"), *alike).where("n > 1").groupBy("n", "x0", "x1").agg(F.min("bucket").alias("bucket"))
    shared = cut(rows.join(several.select("bucket", "n"), "bucket").select("bucket", "node", "n"))
    # what a text was copied from meets more of the copies than they meet each other
    weights = shared.groupBy(F.col("node").alias("v")).agg(F.sum("n").alias("weight"))
    shared = shared.join(weights, shared["node"] == weights["v"]).select("bucket", "node", "weight")
    path = work_path(spark, "texts")
    need = shared.select("node").distinct().join(nodes, "node")
    # one row a digest: the limit of one also holds before the exchange
    one = docs.select(F.col("digest").alias("d"), "text").withColumn("turn", F.row_number().over(Window.partitionBy("d").orderBy("d"))).where("turn = 1")
    need.join(one, F.col("d") == F.col("digest")).select("node", "text").write.option("compression", "zstd").parquet(path)
    held = spark.read.parquet(path)

    def links(pairs: DataFrame) -> DataFrame:
        return cut(compared(pairs.join(held.toDF("a", "ta"), "a").join(held.toDF("b", "tb"), "b").select("a", "b", "ta", "tb"), threshold))

    def joined(found: DataFrame) -> DataFrame:
        # the classes so far are stars, which new links join
        return components(at.where("v <> class").select(F.col("v").alias("a"), F.col("class").alias("b")).union(found))

    tested = cut(candidates(shared, 0))
    at = components(links(tested))
    turn = 1
    while True:
        rows = cut(classed(shared, at))
        pairs = cut(candidates(rows.where("class <> main"), turn).join(tested, ["a", "b"], "left_anti"))
        tested = tested.union(pairs)
        found = links(pairs)
        if n_new := found.count():
            at = joined(found)
        if n_new <= WORTH * pairs.count():
            break
        turn += 1
    if n_new:
        rows = cut(classed(shared, at))
    left = cut(remaining(rows, held, threshold).join(tested, ["a", "b"], "left_anti"))
    few = FEW * held.count()
    while n_left := left.count():
        pairs = left
        if n_left > few:  # by chance, the same for all turns
            pairs = left.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("a", "b"), "b"))).where(F.col("n") <= FEW).select("a", "b")
        at = joined(links(pairs))
        if n_left <= few:
            break
        ends = [at.toDF(end, f"class_{end}") for end in "ab"]
        rest = left.join(pairs, ["a", "b"], "left_anti").join(ends[0], "a", "left").join(ends[1], "b", "left")
        left = cut(rest.where(F.coalesce("class_a", "a") != F.coalesce("class_b", "b")).select("a", "b"))
    discard(spark, path)
    named = nodes.join(at, nodes["node"] == at["v"], "left").select("digest", "first", F.coalesce("class", "node").alias("class"))
    # the smallest key of the class, and the digest that has it
    heads = named.groupBy("class").agg(F.min(F.struct(F.col("first").isNull(), "first", "digest")).alias("h")).select("class", F.col("h.first").alias("class_id"), F.col("h.digest").alias("head"))
    by = named.join(heads, "class").select(F.col("digest").alias("d"), "class_id", "head")
    rows = docs.select("key", "digest")
    return rows.join(by, rows["digest"] == by["d"]).select(F.col("key").alias(key), "digest", "class_id", (F.col("key").eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("head"))).alias("keep"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, one of each class of near copies: that with the smallest key."""
    mine, kept_id, turn = free_names(docs, "mine", "kept", "turn")
    name = lambda k, digest: F.unhex(F.md5(F.concat_ws(":", F.coalesce(k.cast("long").cast("string"), F.lit("null")), F.hex(digest))))
    kept = classes(docs, key, text, threshold).where("keep").select(name(F.col(key), F.col("digest")).alias(kept_id)).distinct()
    rows = docs.withColumn(mine, name(F.col(key), F.unhex(F.md5(F.encode(text_of(text), "UTF-8")))))
    # rows of equal key and text: the limit of one also holds before the exchange
    one = rows.withColumn(turn, F.row_number().over(Window.partitionBy(mine).orderBy(mine))).where(F.col(turn) == 1)
    return one.join(kept, F.col(mine) == F.col(kept_id), "left_semi").select(*docs.columns)


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the class of its near copies: doc_id, class_id, keep."""
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "keep")
