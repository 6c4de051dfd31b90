import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafloom.llm import toxicity as tox


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=7), st.lists(st.text("abc", min_size=1, max_size=7), max_size=6, unique=True))
def test_automaton_and_trie_find_what_is_near(word, terms):
    want = sorted(((t, d) for t in terms if (d := edits(word, t)) <= 1), key=lambda x: (x[1], x[0]))
    assert tox.intersect(word, tox.trie(terms)) == want


def test_halves_lose_nothing():
    lex = tox.Lexicon({"moron": 2.0, "worthless": 3.0, "fool": 1.0}, {"réeux": 1.5})
    for term in ("moron", "worthless"):
        for i in range(len(term) + 1):
            for w in (term[:i] + "q" + term[i:], term[:i] + "q" + term[i + 1 :], term[:i] + term[i + 1 :]):
                assert lex.kind(w)[0] == lex.words[term], w
    assert lex.kind("foolz") is None and lex.kind("réeuxpa") == (1.5, False) and lex.kind("other") is None


def test_context_tells_quotation_from_abuse():
    s = tox.Scorer(tox.Lexicon({"moron": 2.0}))
    plain, quoted, aimed = (s.features(f"one two three {x} four five six")[0] for x in ("moron", 'said "moron" and', "you moron"))
    assert quoted < plain < aimed


def train_rows(prose):
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        docs.append((i, prose(i, 60) + (" you idiot, you worthless idiot" if bad else "")))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_rows_are_told_apart(spark, prose):
    docs, labels = train_rows(prose)
    d, l = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = tox.train(d, l)
    assert "idiot" in model.lexicon.words
    got = tox.score(d.withColumn("held_out", tox.held_out(F.col("doc_id"))), model).collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert (r["score"] >= 0.5) == (r["doc_id"] % 4 == 0)


def test_held_out_labels_are_not_read(spark, prose):
    docs, labels = train_rows(prose)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    flipped = [(k, 1 - v if zlib.crc32(str(k).encode()) % 5 == 0 else v) for k, v in labels]
    a, b = (tox.train(d, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert a == b


def test_odd_rows_and_no_labels(spark, odd_docs, no_docs):
    none = spark.createDataFrame([(1, None), (99, 1)], "doc_id long, toxic int")
    model = tox.train(odd_docs, none)
    got = tox.score(odd_docs, model, ("doc_id",)).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert tox.score(no_docs, model, ("doc_id",)).count() == 0


def test_accuracy_on_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = tox.train(docs, labels)
    out = tox.score(docs.withColumn("held_out", tox.held_out(F.col("doc_id"))).where("held_out"), model, ("doc_id",)).join(labels, "doc_id").toPandas()
    hit = (out.score >= 0.5) & (out.toxic == 1)
    assert hit.sum() / (out.toxic == 1).sum() > 0.85
    assert hit.sum() / (out.score >= 0.5).sum() == pytest.approx(1, abs=0.05)
