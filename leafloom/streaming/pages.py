"""Pages as a stream. Parsing and extraction are local to a page, so the batch operators run unchanged on streams of files or rows;
what compares pages keeps state, bounded by a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from leafloom.operators import extract as E
from leafloom.sources.pages import Pages, parse


def read_stream(spark: SparkSession, path: str, schema: str = "page_id long, url string, html string", files_per_trigger: int = 1) -> DataFrame:
    """New Parquet files of pages below `path`."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def link_stream(pages: DataFrame) -> DataFrame:
    """The links of each page as it arrives."""
    return E.links(Pages(pages, base_url="url")).select("page_id", "text", "href", "url")


def link_counts(pages: DataFrame, time: str = "seen", delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Links by host and window of `time`; what comes later than `delay` is left out, which bounds the state."""
    docs = parse(pages, "html", "page_id", (time,), base_url="url")
    flat = docs.select(time, F.explode(F.filter("nodes", lambda n: (n["type"] == "element") & (n["name"] == "a"))).alias("n"), "resolved_base")
    host = F.regexp_extract("resolved_base", r"^[a-z]+://([^/:]+)", 1)
    return flat.withWatermark(time, delay).groupBy(F.window(time, window), host.alias("host")).agg(F.count("*").alias("links"))


def write_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything that there is now, to Parquet, once."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


class FirstSighting(StatefulProcessor):
    """Of the rows of a URL the one of the least (seen, page_id) when the URL is new. A timer, put off by each further sighting, forgets it."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.until = handle, handle.getValueState("until", "until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        met = pd.concat(list(rows))
        until = int(met["seen"].max().value // 1_000_000) + self.keep_ms
        if self.until.exists():
            before = self.until.get()[0]
            if before >= until:
                return
            self.handle.deleteTimer(before)
        else:
            first = met.sort_values(["seen", "page_id"]).iloc[0]
            yield pd.DataFrame({"url": [key[0]], "page_id": [first["page_id"]], "seen": [first["seen"]]})
        self.until.update((until,))
        self.handle.registerTimer(until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.until.clear()
        yield pd.DataFrame({"url": [], "page_id": [], "seen": []}).astype({"url": "str", "page_id": "int64", "seen": "datetime64[ns]"})

    def close(self) -> None:
        pass


def first_sightings(pages: DataFrame, time: str = "seen", delay: str = "10 minutes", forget_after_minutes: int = 60) -> DataFrame:
    """url, page_id and time of the first link to each resolved URL. The state is an entry a URL, kept by the state store, until the watermark is
    `forget_after_minutes` past its last sighting; then it is new again. Needs the RocksDB state store, which is set in the session."""
    spark = pages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    links = E.links(Pages(pages, base_url="url", keep=(time,))).where(F.col("url").isNotNull()).select("url", "page_id", F.col(time).alias("seen")).withWatermark("seen", delay)
    processor = FirstSighting(forget_after_minutes * 60_000)
    return links.groupBy("url").transformWithStateInPandas(processor, "url string, page_id long, seen timestamp", "Append", "EventTime")
