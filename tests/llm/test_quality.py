import re
from collections import Counter

from leafloom.llm.quality import filtered, judge, measures, op7_quality, prior


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def test_counts_as_by_brute_force(spark, odd_docs, prose):
    line = prose(1, 9)
    more = spark.createDataFrame([(20, "\n".join([line] * 4)), (21, "a b c d e " * 3), (22, "a " * 40), (23, prose(4, 20) + " " + prose(4, 20)), (24, "　x y\x0bz")], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").union(more)
    got = sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in measures(docs, keep=("doc_id",)).collect())
    assert got == sorted((str(r["doc_id"]), *brute(r["text"])) for r in docs.collect())


def test_host_verdicts_forgive_and_reject(spark, prose):
    noisy, marginal = "# $ % & " + prose(5, 30), "# $ % & " + prose(6, 60)
    rows = [(i, prose(i, 40), "good") for i in range(300)] + [(900, noisy, "good"), (901, marginal, "good")]
    rows += [(1000 + i, noisy if i % 2 else prose(i, 40), "bad") for i in range(60)] + [(1900, marginal, "bad")]
    out = {r["doc_id"]: r for r in judge(measures(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()}
    assert out[900]["host_verdict"] == "trusted" and out[900]["kept"] and out[900]["host_rate"] < 0.1 and out[901]["kept"]
    assert out[1001]["host_verdict"] == "poor" and not out[1001]["kept"] and out[1000]["kept"] and not out[1900]["kept"]


def test_hosts_move_verdicts_both_ways_on_the_test_table(spark):
    out = op7_quality(spark, "/root/testdata/sf0.01").collect()
    alone = lambda r: not r["base_failed"] and r["n_failed"] == 0  # noqa: E731  the verdict without hosts
    assert any(r["kept"] and not alone(r) for r in out) and any(alone(r) and not r["kept"] for r in out)
    assert {r["host_verdict"] for r in out} == {"trusted", "plain", "poor"}


def test_names_that_operators_use_inside(spark, prose):
    docs = spark.createDataFrame([(1, prose(1, 40), "a", 7, 8, 9), (2, "x", "a", 7, 8, 9)], "doc_id long, text string, source string, the_key int, _host int, kept int")
    out = filtered(docs)
    assert out.columns == docs.columns and [tuple(r)[3:] for r in out.collect()] == [(7, 8, 9)]


def test_prior():
    a, b = prior(3, 300, 60, 0.6, 0.18)
    assert 0.15 < a / (a + b) < 0.25
    assert prior(0, 0, 0, 0.0, 0.0)[0] == 0.0


def test_filter_keeps_columns_and_repeated_rows(odd_docs, no_docs):
    out = filtered(odd_docs)
    assert out.columns == odd_docs.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert kept.count(5) == 2 and 2 not in kept and 3 not in kept and 10 not in kept
    assert filtered(no_docs).count() == 0 and judge(measures(no_docs)).count() == 0
