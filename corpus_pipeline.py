"""From raw documents to token ids in five stages: quality rules, near-dedup, dedup of repeated strings, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on every row that the one before has kept. All but the last return the
columns of documents. SQL cannot express the second and third stage, so there is no ORACLE_SQL; tests run the stages against
brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm import bpe, mixing, neardup, quality, repeats
from leafloom.llm.common import discard, table, text_of, work_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Passes over the rarest source, at most, where sources are evened out.
MAX_REPEATS = 2.0


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and what their host's verdict allows."""
    return quality.filtered(docs.select(COLUMNS))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest id."""
    return neardup.deduplicate(docs.select(COLUMNS))


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 50 bytes that smaller ones hold; n_chars follows the text."""
    left = repeats.remove(docs.select(COLUMNS))
    return left.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))).select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of rarer sources as often as the mix uses them."""
    return mixing.realise(docs.select(COLUMNS), max_repeats=MAX_REPEATS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each use of a document, with the number of its tokens and digests of ids and decoded bytes."""
    return bpe.round_trip(docs.select("doc_id", "lang", "source", "n_chars", text_of().alias("text")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("quality", good), ("near_duplicates", distinct), ("repeats", unrepeated), ("mixing", mixed), ("encoding", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and read again, and deleted when the next
    one is written. The last of these is what the result reads; it stays."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = work_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            discard(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
