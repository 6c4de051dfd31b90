import math

import pytest
from pyspark.sql import functions as F

from leafloom.llm import mixing


def sources(spark, sizes):
    return spark.createDataFrame([(k, n) for k, n in sizes.items()], "source string, n long")


@pytest.mark.parametrize("limit", [1.5, 2.0, 4.0, 100.0])
def test_exponent_meets_the_limit(spark, limit):
    sizes = {"a": 10_000, "b": 500, "c": 900}
    a = mixing.exponent(sources(spark, sizes), sum(sizes.values()), limit, None)
    passes = (500 / 10_000) ** (a - 1)
    assert passes <= limit * (1 + 1e-9)
    assert a == 0.0 or passes == pytest.approx(limit, rel=1e-6)


def test_exponent_meets_the_entropy(spark):
    sizes = {"a": 10_000, "b": 500, "c": 900}
    a = mixing.exponent(sources(spark, sizes), sum(sizes.values()), 1e9, 0.9)
    p = [n**a for n in sizes.values()]
    p = [x / sum(p) for x in p]
    assert -sum(x * math.log(x) for x in p) / math.log(3) == pytest.approx(0.9, abs=1e-6)


def corpus(spark, prose):
    rows = [(i, prose(i, 30 + i % 7), "big" if i % 10 else ("small" if i % 20 else "tiny")) for i in range(900)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_budgets_are_met_and_no_document_is_left_out(spark, prose, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 16)
    got = mixing.plan(corpus(spark, prose), max_repeats=3.0).groupBy("source").agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") * F.col("passes")).alias("used"), F.min("passes").alias("low"), F.max("passes").alias("high"), F.first("weight").alias("w")).collect()
    by = {r["source"]: r for r in got}
    budget = by["big"]["n"] / by["big"]["w"]
    for r in got:
        assert r["low"] >= 1 and r["high"] <= 3 and r["high"] - r["low"] <= 1
        assert r["used"] <= r["w"] * budget + 1e-3 and r["used"] > r["w"] * budget - 200
    assert by["big"]["used"] == by["big"]["n"] and sum(r["w"] for r in got) == pytest.approx(1)


def test_realised_rows_are_those_of_the_plan(spark, prose, odd_docs):
    docs = corpus(spark, prose)
    want = mixing.plan(docs).agg(F.sum("passes")).first()[0]
    assert mixing.realise(docs).count() == want
    out = mixing.realise(odd_docs)
    assert out.columns == odd_docs.columns
    assert out.select("doc_id").distinct().count() == odd_docs.select("doc_id").distinct().count()


def test_each_pass_is_a_permutation(spark, prose, odd_docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 16)
    docs = corpus(spark, prose)
    got = mixing.realise(docs, max_repeats=3.0, order=("pass_no", "place")).collect()
    assert len(got) == mixing.plan(docs, max_repeats=3.0).agg(F.sum("passes")).first()[0]
    by = {}
    for r in got:
        by.setdefault((r["source"], r["pass_no"]), []).append((r["place"], r["doc_id"]))
    assert all(sorted(p for p, _ in v) == list(range(len(v))) for v in by.values())
    assert all(len({k for _, k in v}) == len(v) for v in by.values())
    small = [[k for _, k in sorted(by["small", n])] for n in (1, 2)]
    assert small[0] != sorted(small[0]) and small[0] != small[1] and set(small[1]) <= set(small[0])
    odd = mixing.realise(odd_docs, order=("pass_no", "place"))
    assert odd.columns == [*odd_docs.columns, "pass_no", "place"] and odd.count() == mixing.plan(odd_docs).agg(F.sum("passes")).first()[0]
    with pytest.raises(ValueError):
        mixing.realise(docs, order=("doc_id", "place"))


def test_rows_without_a_key_fall_to_many_blocks_and_names_may_clash(spark, prose, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 16)
    rows = [(None, prose(i, 20), "a", i, i, i) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _k int, block int, use_key int")
    assert mixing.plan(docs).select("block").distinct().count() > 5
    out = mixing.realise(docs)
    assert out.columns == docs.columns and out.count() == 200


def test_few_and_no_rows(spark, no_docs):
    one = spark.createDataFrame([(1, "a b", None), (2, None, None)], "doc_id long, text string, source string")
    assert [r["passes"] for r in mixing.plan(one).collect()] == [1, 1]
    assert mixing.plan(no_docs).count() == 0 and mixing.realise(no_docs).count() == 0


def test_the_query_places_every_use_of_every_pass(spark, prose, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 16)
    docs = corpus(spark, prose)
    docs.unionByName(docs.where("source <> 'big'").limit(3)).toPandas().to_parquet(tmp_path / "documents.parquet")
    placed = []
    real = mixing.ordered
    monkeypatch.setattr(mixing, "ordered", lambda *a, **k: placed.append(real(*a, **k)) or placed[-1])
    got = mixing.op5_mixing(spark, str(tmp_path)).collect()
    want = mixing.plan(spark.read.parquet(str(tmp_path / "documents.parquet"))).select("doc_id", "passes").collect()
    assert sorted((r["doc_id"], r["passes"]) for r in got) == sorted(map(tuple, want))
    assert len(placed) == 1 and placed[0].count() == sum(r["passes"] for r in want) > len(want)
