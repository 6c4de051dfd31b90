import base64
import gzip
import hashlib
import io
from collections import Counter

import pytest

from leafloom.llm import warc
from leafloom.llm.common import work_path


def pages(spark):
    body = "<p>same</p>"
    rows = [(1, "http://a/1", body), (2, "http://a/2", None), (3, "http://a/3", ""), (4, None, body), (5, "http://a/é", "<p>café \x1f\x8b\x08</p>"), (6, "http://a/6", "x" * 300_000), (7, "http://a/7", "WARC/1.1 not a record"), (None, "http://a/n", "lone")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS sha", "2 AS first")


def trip(spark, df, **options):
    path = "file://" + work_path(spark, "warc")
    return warc.read(spark, path, warc.write(df, path), **options)


@pytest.mark.parametrize("split", [97, 8 << 20])
def test_round_trip(spark, split):
    df = pages(spark)
    got = {r["page_id"]: r for r in trip(spark, df, split=split).collect()}
    assert len(got) == 8
    for r in df.collect():
        raw, g = (r["html"] or "").encode(), got[r["page_id"]]
        assert g["payload_bytes"] == len(raw) and g["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (bytes(g["payload"]) if g["payload"] is not None else None) == (raw if g["record_type"] == "response" else None)
    assert got[4]["record_type"] == "revisit" and got[4]["refers_to"] == 1
    assert got[3]["record_type"] == "revisit" and got[3]["refers_to"] == 2
    assert got[1]["refers_to"] is None and got[None]["record_type"] == "response"


def test_small_payloads_are_not_revisits(spark):
    path = "file://" + work_path(spark, "warc")
    files = warc.write(pages(spark), path, min_revisit=5)
    got = {r["page_id"]: r["record_type"] for r in warc.read(spark, path, files).collect()}
    assert got[3] == "response" and got[4] == "revisit"


@pytest.mark.parametrize("broadcast", ["-1", "100m"])
def test_repeated_rows_over_many_partitions(spark, broadcast):
    """Three times the rows in 12 partitions: one response for each payload, whatever joins Spark chooses and splits."""
    one = pages(spark)
    df = one.union(one).union(one).repartition(12)
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "1k")
        got = trip(spark, df).collect()
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(got) == 24
    by = Counter((r["payload_digest"], r["record_type"]) for r in got)
    assert {n for (_, kind), n in by.items() if kind == "response"} == {1}
    assert len([1 for _, kind in by if kind == "response"]) == len({r["html"] or "" for r in one.collect()})


def test_empty_table(spark):
    assert trip(spark, pages(spark).limit(0)).count() == 0


def test_a_damaged_record_is_an_error():
    data = warc.record(1, "http://x/1", warc.digest32(hashlib.sha1(b"abc" * 9000).hexdigest()), bytes(range(256)) * 90, None, 23040)
    for bad in (data[:-40], data[:300] + b"\x00" * 60 + data[360:]):
        with pytest.raises(ValueError):
            list(warc.members(lambda at, n, bad=bad: bad[at : at + n], len(bad), 0, len(bad)))


def test_members_are_ordinary_gzip_and_ranges_own_each_once():
    parts = [warc.record(i, f"http://x/{i}", warc.digest32(hashlib.sha1(b).hexdigest()), b, None, len(b)) for i, b in enumerate([b"a" * 50, b"\x1f\x8b\x08" * 40, b""])]
    junk = b"\x1f\x8b\x08junk"
    data = junk.join([b"", *parts])
    assert gzip.GzipFile(fileobj=io.BytesIO(parts[0])).read().startswith(b"WARC/1.1\r\n")
    read = lambda at, n: data[at : at + n]
    for step in (1, 13, 50, len(data)):
        found = [warc.parse(m)["page_id"] for s in range(0, len(data), step) for m in warc.members(read, len(data), s, min(s + step, len(data)))]
        assert found == [0, 1, 2]


def test_a_wrong_payload_is_an_error():
    bad = warc.record(1, "u", "A" * 32, b"x", None, 1)
    with pytest.raises(ValueError):
        warc.parse(gzip.decompress(bad))
