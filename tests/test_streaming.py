"""State across pages: the first sighting of each URL, over restarts, and forgetting it."""

import datetime as dt

from leafloom.streaming.pages import first_sightings


def at(minute):
    return dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=minute)


def test_first_sightings_over_restarts(spark, tmp_path):
    schema = "page_id long, url string, html string, seen timestamp"
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def arrive(*rows):
        spark.createDataFrame([(k, "https://h/d/", html, at(m)) for k, html, m in rows], schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        pages = spark.readStream.schema(schema).parquet(source)
        q = first_sightings(pages, delay="5 minutes", forget_after_minutes=30).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted((r["url"], r["page_id"], (r["seen"] - at(0)).seconds // 60) for r in spark.read.parquet(out).collect())

    arrive((2, "<a href=x>1</a><a href=../y>2</a>", 1), (1, "<a href=x>1</a><a href='./x'>1</a>", 0))
    first = [("https://h/d/x", 1, 0), ("https://h/y", 2, 1)]
    assert run() == first
    arrive((3, "<a href=x>again</a><a href=z>new</a>", 10))
    assert run() == sorted([*first, ("https://h/d/z", 3, 10)])  # a restarted query knows what it has seen
    arrive((4, "<p>nothing</p><a href=w>late</a>", 200))
    run()
    arrive((5, "<a href=x>after it was forgotten</a>", 201))
    assert ("https://h/d/x", 5, 201) in run()
