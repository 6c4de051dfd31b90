import pytest
from pyspark.sql import functions as F

from leafloom.errors import EncodingError, InputError, LimitError
from leafloom.kernel.decode import decode, prescan
from leafloom.limits import Limits
from leafloom.operators import extract as E
from leafloom.operators import nodes as N
from leafloom.sources.pages import fragment, page, parse, read, too_large


@pytest.mark.parametrize(
    ("data", "want"),
    [
        ("<p>x", ("<p>x", "UTF-8", "string")), ("﻿x", ("x", "UTF-8", "string")), (b"<p>x", ("<p>x", "UTF-8", "default")), (b"\xef\xbb\xbfx", ("x", "UTF-8", "bom")), (b"\xff\xfex\x00", ("x", "UTF-16LE", "bom")), (b"\xfe\xff\x00x", ("x", "UTF-16BE", "bom")),
        (b"<meta charset=latin1>\x93", ("<meta charset=latin1>“", "windows-1252", "meta")), (b"<meta charset=utf-16>x", ("<meta charset=utf-16>x", "UTF-8", "meta")), (b"<meta charset=windows-1255>\xca", ("<meta charset=windows-1255>ֺ", "windows-1255", "meta")),
    ],
)
def test_decoding(data, want):
    assert decode(data) == want


def test_an_encoding_given_by_name_is_taken_as_written():
    assert decode(b"\x93", "latin1") == ("\x93", "latin1", "argument")
    assert decode(b"\x93\xfa", "shift_jis")[0] == "日"


@pytest.mark.parametrize(("data", "encoding"), [(b"\xe9", None), (b"a\x00", None), (b"x", "no-such"), ("x", "latin1"), (b"\xef\xbb\xbfx", "UTF-16LE"), (b"\xff\xfex", None), (b"\xff\xfe\x3d\xd8", None), (b"<meta charset=iso-2022-kr>", None), (b"<meta charset=windows-1255>\xd9", None), (b"x", "utf-7"), (b"x", "cp500")])
def test_decoding_is_strict(data, encoding):
    with pytest.raises(EncodingError):
        decode(data, encoding)


def test_prescan():
    assert prescan(b"<!-- <meta charset=gbk> --><a title='<meta charset=gbk>'><META/Charset=' Latin2 '>") == "ISO-8859-2"
    assert prescan(b"<meta http-equiv=content-type content='text/html; charset=\"koi8-r\"'>") == "KOI8-R"
    assert prescan(b"<meta content='charset=gbk'>") is None and prescan(b" " * 1024 + b"<meta charset=gbk>") is None
    assert prescan(b"<meta charset=bogus><meta charset=gb2312>") == "GBK"
    with pytest.raises(InputError):
        decode(None)
    with pytest.raises(LimitError):
        decode("x" * 11, max_input=10)


def test_modes(spark):
    df = spark.createDataFrame([(1, bytearray(b"<p>a")), (2, bytearray(b"\xe9")), (3, None)], "page_id long, html binary")
    rows = {r["page_id"]: r for r in parse(df).collect()}
    assert rows[1]["error"] is None and rows[2]["error"]["kind"] == "encoding" and rows[3]["error"]["kind"] == "input" and rows[2]["nodes"] is None
    assert parse(df, mode="DROPMALFORMED").count() == 1
    with pytest.raises(Exception, match="encoding|input"):
        parse(df, mode="FAILFAST").collect()
    for bad in ({"mode": "X"}, {"context": "a b c"}, {"comments": 1}):
        with pytest.raises(InputError):
            parse(df, **bad)


def test_limits_are_errors_of_their_page(spark):
    df = spark.createDataFrame([(1, "<div>" * 30), (2, "<p>x")], "page_id long, html string")
    rows = {r["page_id"]: r["error"] for r in parse(df, limits=Limits(max_depth=10)).collect()}
    assert (rows[1]["limit"], rows[1]["maximum"], rows[1]["observed"]) == ("max_depth", 10, 11) and rows[2] is None


def test_problems_have_places():
    p = page("<!DOCTYPE html>\n<p>é\n  </div><p id=a id=b>")["problems"]
    assert [(x["code"], x["line"], x["column"], x["byte_offset"]) for x in p] == [("unexpected-end-tag", 3, 3, 24), ("duplicate-attr", 3, 17, 38)]
    many = page("<!DOCTYPE html>" + "</x>" * 20, limits=Limits(max_errors=0))
    assert many["problems"] == [] and many["problems_truncated"]


def test_info_and_fragments(spark):
    df = spark.createDataFrame([(1, "<td>x<td>y", "https://h/")], "page_id long, html string, url string")
    docs = fragment(df, context="tr", base_url="url")
    r = E.info(docs).first()
    assert (r["type"], r["context"], r["n_nodes"], r["base_url"], r["quirks_mode"]) == ("fragment", "tr", 5, "https://h/", "no-quirks")
    assert N.elements(N.nodes(docs), "td").count() == 2 and N.elements(N.nodes(docs), ":root").count() == 0
    assert N.root(docs).first()["id"] is None


def test_files(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"<meta charset=latin1><p>caf\xe9 <a href=b>x</a>")
    (tmp_path / "big.html").write_bytes(b"x" * 500)
    docs = read(spark, str(tmp_path / "*.html"), limits=Limits(max_input=100))
    assert N.text(N.nodes(docs), N.elements(N.nodes(docs), "p")).first()["text"] == "café x"
    rows = {r["page_id"].rsplit("/", 1)[1]: r for r in docs.collect()}
    assert rows["a.html"]["error"] is None and rows["a.html"]["base_url"] is None
    e = rows["big.html"]["error"]
    assert (e["kind"], e["limit"], e["maximum"], e["observed"]) == ("limit", "max_input", 100, 500) and rows["big.html"]["nodes"] is None
    assert too_large(spark, str(tmp_path / "*.html"), Limits(max_input=100)).count() == 1
    assert read(spark, str(tmp_path / "*.html"), limits=Limits(max_input=100), mode="DROPMALFORMED").count() == 1
    with pytest.raises(Exception, match="max_input"):
        read(spark, str(tmp_path / "*.html"), limits=Limits(max_input=100), mode="FAILFAST").collect()
    assert E.links(read(spark, f"FILE://{tmp_path}/a.html".replace("FILE", "file"))).first()["url"] == f"file:{tmp_path}/b"


@pytest.mark.parametrize("name", "links title closest nth_child selector_list matches ancestors element_aligned child_combinator descendant_combinator sibling_combinator base_and_url table_converted microdata meta".split())
def test_each_page_is_parsed_once_and_nothing_of_it_is_shuffled(spark, sf, name):
    from leafloom.plans.catalog import queries

    plan = queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_joins_of_a_node_table_parse_nothing(spark, sf):
    from leafloom.plans.catalog import docs_of, node_table

    plan = N.elements(node_table(docs_of(spark, sf)), "article > h1 ~ p")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "NestedLoop" not in plan


def test_plans_push_columns_down_and_parse_once(spark, sf):
    docs = parse(spark.read.parquet(f"{sf}/pages.parquet"), keep=("url",), base_url="url")
    plan = N.elements(N.nodes(docs), "a[href]")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,url:string,html:string>" in plan and plan.count("MapInArrow") == 1 and "Exchange" not in plan


def test_streams_give_what_batches_give(spark, sf, tmp_path):
    from leafloom.streaming import pages as P

    src = spark.read.parquet(f"{sf}/pages.parquet")
    src.repartition(2).write.parquet(str(tmp_path / "in"))
    P.write_stream(P.link_stream(P.read_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, P.link_stream(src).collect()))
    timed = spark.readStream.schema("page_id long, url string, html string").parquet(str(tmp_path / "in")).withColumn("seen", F.timestamp_seconds(F.lit(1_700_000_000)))
    q = P.link_counts(timed).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(links) FROM counts").first()[0] == len(got)


def test_engine_info():
    assert E.engine_info()["parses"] and E.engine_info()["selects"]
