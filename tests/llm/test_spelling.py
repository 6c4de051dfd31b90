import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafloom.llm import spelling
from leafloom.llm.spelling import OP12_SQL, Trie, grouped, op12_spelling, roots, words


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(docs):
    out = Counter()
    for k, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
            out[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def brute(docs):
    n = counted(docs)
    forms, out = {}, {}
    for w in n:
        others = sorted((o for o in n if near(w, o)), key=lambda o: (-n[o], o))
        forms[w] = others[0] if others and n[others[0]] >= 5 * n[w] else None
        out[w] = len(others)
    def root(w):
        return w if forms[w] is None else root(forms[w])
    return {w: (forms[w], root(w), n[w], out[w], n[forms[w]] if forms[w] else None) for w in n}


def rows_of(df):
    got = [(r["word"], (r["form"], r["root"], r["n"], r["n_near"], r["form_n"])) for r in df.collect()]
    assert len(got) == len(dict(got))
    return dict(got)


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abé", min_size=1, max_size=6), min_size=1, max_size=60), st.text("abéz", min_size=1, max_size=6))
def test_the_trie_finds_what_comparing_finds(some, other):
    held = sorted(some)
    t = Trie.load(Trie.of(held, list(range(1, len(held) + 1))).dump())
    for w in [*held, other]:
        got = [(t.word(x), t.counts[x]) for x in t.near(w)]
        assert sorted(got) == [(x, n) for n, x in enumerate(held, 1) if near(w, x)]


def docs_of(spark):
    line = "colour colours Colour cölour coloour colourful coloru kolours " * 6 + "ÀÉÎõ÷× Straßen strassen Strassen " * 5
    texts = [(i, line if i % 2 else line + "colours coloure couloure " * i) for i in range(1, 260)] + [(None, line), (3, line), (4, None), (5, ""), (6, "abcdefg" * 3000 + " " + "abcdefg " * 9 + "abcdefgh " * 46 + "abcdefghi " * 900)]
    return texts, spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS word", "2 AS form")


def test_as_by_brute_force(spark):
    texts, docs = docs_of(spark)
    want = brute(texts)
    assert rows_of(grouped(docs)) == want
    assert want["abcdefg"][:2] == ("abcdefgh", "abcdefghi") and any(v[3] > 2 for v in want.values())
    assert {r["word"]: r["n"] for r in words(docs).collect()} == counted(texts) and len(counted(texts)) > 10


@pytest.mark.parametrize("wave", [1, 400])
def test_many_shards_and_waves(spark, monkeypatch, wave):
    monkeypatch.setattr(spelling, "SHARD_BYTES", 20)
    monkeypatch.setattr(spelling, "WAVE_BYTES", wave)
    texts, docs = docs_of(spark)
    assert rows_of(grouped(docs.where("doc_id < 40"))) == brute([t for t in texts if t[0] is not None and t[0] < 40])


def test_chains(spark):
    some = [(f"w{i}", f"w{i + 1}") for i in range(11)] + [("x", "w5"), ("y", "z")]
    got = {r["word"]: r["root"] for r in roots(spark.createDataFrame(some, "word string, form string")).collect()}
    assert got == {**{f"w{i}": "w11" for i in range(11)}, "x": "w11", "y": "z"}


def test_empty_tables(spark, no_docs):
    assert grouped(no_docs).count() == 0
    assert rows_of(grouped(spark.createDataFrame([(1, "lonely " * 7)], "doc_id long, text string"))) in ({"lonely": (None, "lonely", 7, 0, None)}, {})


def test_as_its_sql(spark, sf, duck, same):
    got, want = op12_spelling(spark, sf).toPandas(), duck.execute(OP12_SQL).df()
    assert sorted(got.columns) == sorted(want.columns) and same(got) == same(want)
