"""Tables of nodes that are stored by page: written once, in buckets of the page's key, and read without an exchange by whatever stays in a page.

Windows and groups by page use the buckets as they are. Joins on the page and something else do so too in the session that `store` reads
the table with: it is like the given one, but for spark.sql.requireAllClusterKeysForCoPartition, which is off, and for broadcasts, which are
left to hints: sides that lie in buckets need no exchange, and one that is taken for small would pass the driver whole. A page is
bounded by `Limits.max_nodes`, and so is what a bucket's largest page brings to a task.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from leafloom.operators import nodes as N
from leafloom.plans import selectors as S
from leafloom.sources.pages import Below, Cleaned, Pages, Wanted, tasks_for
from leafloom.sources.work import shared_dir


def page_session(spark: SparkSession) -> SparkSession:
    """A session like `spark` in which joins may use a partitioning by page alone, and no side of a join is broadcast unasked."""
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if spark.conf.isModifiable(k):
            own.conf.set(k, v)
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    own.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    own.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    own.conf.set("spark.sql.execution.replaceHashWithSortAgg", "true")  # where rows lie in order already
    return own


@dataclass(frozen=True)
class Stored:
    """A stored table: `df` reads it, `table` is its name in the catalog, `path` its folder."""

    df: DataFrame
    table: str
    path: str
    key: str = N.KEY

    def elements(self, css: str) -> DataFrame:
        """Matches in each page, without an exchange."""
        return S.select(self.df, css, self.key, stored=True)

    def select_many(self, selectors: dict[str, str]) -> DataFrame:
        """The elements that match any of `selectors`, a boolean column each: one scan, without an exchange."""
        return S.select_many(self.df, selectors, self.key, stored=True)

    def drop(self) -> None:
        """Takes the table out of the catalog and deletes its files. Nothing that is still to be computed may read it."""
        spark = self.df.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def default_buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def store_nodes(pages: Pages, *columns: str, wanted: Wanted | None = None, texts: Cleaned | Below | None = None, table: str | None = None, path: str | None = None, buckets: int | None = None) -> Stored:
    """Parses pages and stores their nodes (see `Pages.node_rows`). Pages are dealt to buckets before they are parsed: markup takes less room
    than nodes. By default there are as many buckets as a shuffle has partitions, and more where a bucket would have over PAGES_A_TASK pages; pages
    that are dealt by their key lie in buckets as they are."""
    if pages.dealt and buckets in (None, pages.dealt):
        dealt, buckets = pages, pages.dealt
    else:
        buckets = buckets or max(default_buckets(pages.df.sparkSession), tasks_for(pages.df))
        dealt = replace(pages, df=pages.df.repartition(buckets, pages.key))
    return store(dealt.node_rows(*columns, wanted=wanted, texts=texts), pages.key, table, path, buckets, dealt=True)


def store(rows: DataFrame, key: str = N.KEY, table: str | None = None, path: str | None = None, buckets: int | None = None, dealt: bool = False) -> Stored:
    """Writes nodes, or other rows of pages, in `buckets` (by default as many as a shuffle has partitions) by `key`, in order of `id` if they have one.

    Without a `path` the folder is a new one below spark.checkpoint.dir; without a `table` the name is a new one. dealt: the rows come from
    repartition(buckets, key) and lie there still."""
    spark = rows.sparkSession
    buckets = buckets or default_buckets(spark)
    table = table or f"leafloom_{uuid.uuid4().hex}"
    path = path or f"{shared_dir(spark).rstrip('/')}/{table}"
    order = [key, "id"] if "id" in rows.columns else [key]
    # rows come to a task as they belong to its bucket, so that a bucket is one file
    (rows if dealt else rows.repartition(buckets, key)).write.format("parquet").bucketBy(buckets, key).sortBy(*order).option("path", path).mode("errorifexists").saveAsTable(table)
    return Stored(page_session(spark).table(table), table, path, key)


def open_stored(spark: SparkSession, table: str, path: str, key: str = N.KEY) -> Stored:
    """A stored table of the session's catalog."""
    return Stored(page_session(spark).table(table), table, path, key)
