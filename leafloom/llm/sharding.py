"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Equal texts form a group. Groups are packed in falling order of their largest share: each goes to the shard where the dot
product of its demand with the shard's residual capacity is highest. Groups that hold over 1 / PARCELS of a shard in any
dimension (there are at most three times SHARDS * PARCELS of them) are packed first, by the driver; one that outweighs half a
shard is split by doc_id into pieces of a sixteenth of a shard. All other groups fall into tiers by weight, each a TIER-th of the one
before, and a tier's groups are dealt by hash to parcels of PARCEL_GROUPS. A parcel is packed by a task of its own, group by group, into its
part of the capacity that is left. As its heaviest group weighs TIER times its lightest at most, no group outweighs what a shard gets
of it, and the last groups even out what the first have left; a tier of few groups is packed in one parcel, and its groups are
small against a shard. So every parcel is balanced, and their sum is. Slots come from counts: rows are dealt to small blocks, offsets of blocks are summed, and rows are
numbered only within a block.

Edge cases: a null text has the size 1, the checksum of the empty text, and belongs to the group of empty texts. Rows with
null or repeated doc_ids are placed like others, each with a slot of its own; rows alike in doc_id and text are numbered
in one block. An empty table gives an empty result. Other columns of the input are not read and cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafloom.llm.common import cut, table, text_of

SHARDS = 16
#: Groups of over a shard's PARCELS-th part are packed by the driver; the others in parcels of about this many groups.
PARCELS, PARCEL_GROUPS = 256, 8192
#: Groups of a parcel differ by this factor in weight at most, but for those of the last of TIERS, of which each is next to nothing.
TIER, TIERS = 8, 16
#: Rows of a block in which slots are numbered.
BLOCK_ROWS = 4096
DIMENSIONS = ("size", "tokens", "rows")
#: What each dimension counts for in the dot product: bytes come first, as the law `bytes` promises near equal sizes.
WEIGHTS = (8.0, 1.0, 1.0)


def pack(demands: np.ndarray, shards: int, fair: np.ndarray | None = None, capacity: np.ndarray | None = None, first: int = 0) -> np.ndarray:
    """The shard of each row of `demands` (units x dimensions), by the highest dot product with residual capacity.

    fair: a shard's fair part in each dimension, by default of the units; demands are measured in shares of it and weighted by
    WEIGHTS. capacity: of each shard and dimension in such shares, by default 1. Ties go to the lowest shard from `first` on."""
    share = demands / (np.maximum(demands.sum(axis=0), 1) / shards if fair is None else fair)
    residual = np.roll(np.ones((shards, demands.shape[1])) if capacity is None else capacity, -first, axis=0)
    out, weighted = np.zeros(len(demands), dtype=int), share * np.array(WEIGHTS[: demands.shape[1]])
    for i in np.lexsort((np.arange(len(share)), -share.max(axis=1, initial=0))).tolist():
        out[i] = at = int((residual @ weighted[i]).argmax())
        residual[at] -= share[i]
    return (out + first) % shards


def packing(shards: int, capacity: np.ndarray):
    """Of a parcel's groups (group, size, tokens, rows) the shard of each."""

    def run(parcel: pa.Table) -> pa.Table:
        ordered = parcel.sort_by("group")  # ties do not depend on how rows arrive
        demands = np.column_stack([ordered.column(d).to_numpy().astype(float) for d in DIMENSIONS])
        found = pack(demands, shards, None, capacity, int((parcel.column("parcel")[0].as_py() * 7 + parcel.column("tier")[0].as_py() * 5) % shards))
        return pa.table({"group": ordered.column("group"), "shard": pa.array(found, pa.int32())})

    return run


def by_parcels(groups: DataFrame, shards: int, capacity: np.ndarray) -> DataFrame:
    """group and shard of the groups (group, size, tokens, rows, and weight: the largest share of a shard, 1 / PARCELS at most). It is read twice."""
    tier = F.least(F.lit(TIERS - 1), F.floor(-F.log(float(TIER), F.col("weight") * PARCELS))).cast("int")
    tiered = groups.withColumn("tier", tier)
    counts = {r["tier"]: r["count"] for r in tiered.groupBy("tier").count().collect()}  # TIERS at most
    parcels = F.lit(1)
    for t, n in counts.items():
        parcels = F.when(F.col("tier") == t, -(-n // PARCEL_GROUPS)).otherwise(parcels)
    dealt = tiered.withColumn("parcel", F.pmod(F.xxhash64("group"), parcels))
    return dealt.groupBy("tier", "parcel").applyInArrow(packing(shards, capacity), "group binary, shard int")


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """A row for each row of `docs`: key, size, tokens, text_crc32, shard, slot. Equal texts share a shard unless their group is split."""
    spark, t = docs.sparkSession, text_of(text)
    rows = cut(
        docs.select(
            F.col(key).alias("key"), (F.octet_length(t) + 1).cast("long").alias("size"), F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
            F.lit(1).cast("long").alias("rows"), F.crc32(F.encode(t, "UTF-8")).alias("crc"), F.unhex(F.md5(F.encode(t, "UTF-8"))).alias("group"),
        )
    )
    groups = cut(rows.groupBy("group").agg(*(F.sum(d).alias(d) for d in DIMENSIONS)))
    total = groups.agg(*(F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in DIMENSIONS), F.count("*").alias("groups")).first()
    fair = np.array([max(total[d], 1) / shards for d in DIMENSIONS])
    weight = F.greatest(*(F.col(d) / F.lit(float(f)) for d, f in zip(DIMENSIONS, fair, strict=True)))  # in shares of a shard
    # at most 3 * shards * PARCELS groups: each holds over 1 / (shards * PARCELS) of the bytes, the tokens or the rows
    heavy = groups.where(weight > 1 / PARCELS).select("group", F.when(weight > 0.5, F.ceil(weight * 16)).otherwise(1).cast("int").alias("pieces"))
    piece = F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("key", F.lit(1)), F.col("pieces")).cast("int"))
    marked = rows.join(F.broadcast(heavy), "group", "left").withColumn("piece", piece).drop("pieces")
    units = marked.where("piece IS NOT NULL").groupBy("group", "piece").agg(*(F.sum(d).alias(d) for d in DIMENSIONS)).orderBy("group", "piece").collect()
    demands = np.array([[u[d] for d in DIMENSIONS] for u in units], dtype=float).reshape(-1, len(DIMENSIONS))
    where = pack(demands, shards, fair)
    load = np.zeros((shards, len(DIMENSIONS)))
    np.add.at(load, where, demands)
    left = np.maximum(fair - load, 1e-6)  # where the parcels' groups go, shard by shard
    capacity = left / left.mean(axis=0)
    placed = spark.createDataFrame([(u["group"], u["piece"], int(s)) for u, s in zip(units, where, strict=True)], "group binary, piece int, shard int")
    packed = by_parcels(groups.where(weight <= 1 / PARCELS).withColumn("weight", weight), shards, capacity)
    known = marked.where("piece IS NOT NULL").join(F.broadcast(placed), ["group", "piece"])
    others = marked.where("piece IS NULL").join(packed, "group")
    blocks = max(1, total["rows"] // (shards * BLOCK_ROWS))
    both = known.select(*(columns := ["key", "size", "tokens", "crc", "shard"])).union(others.select(*columns))
    dealt = cut(both.withColumn("block", F.pmod(F.xxhash64("key", "crc", F.lit(2)), F.lit(blocks))))
    counts = dealt.groupBy("shard", "block").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("c")
    at = F.row_number().over(Window.partitionBy("shard", "block").orderBy("key", "crc")) - 1
    numbered = dealt.withColumn("at", at).join(counts.select("shard", "block", before.alias("before")), ["shard", "block"])
    return numbered.select(F.col("key").alias(key), "size", "tokens", F.col("crc").alias("text_crc32"), "shard", (F.col("before") + F.col("at")).cast("long").alias("slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 under the law `bytes`: doc_id, size, text_crc32, law, shard, slot, grown_shard (null), tokens."""
    out = assign(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")
