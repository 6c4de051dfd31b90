import random
import zlib
from array import array
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from leafloom.llm import packing
from leafloom.llm.packing import LENGTH, SLACK, VOCABULARY, Encoder, Packer, laid_out, op13_packing, packed, powers

PATH = public_tokenizers.path(VOCABULARY)


@pytest.fixture(scope="module")
def plain():
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


def check(rows, docs, plain, length=LENGTH):
    """Every id once, right checksums, no gaps, nothing too long. docs: (doc_id, text). Returns the fill of each sequence."""
    want = defaultdict(list)
    for k, t in docs:
        want[k].append([*plain(t), 1])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(want)
    for k, held in pieces.items():
        assert sum(r["length"] for r in held) == sum(map(len, want[k]))
        for r in held:
            parts = [w[r["start"] : r["start"] + r["length"]] for w in want[k] if len(w) == r["doc_tokens"]]
            assert r["ids_crc32"] in [zlib.crc32(array("I", p).tobytes()) for p in parts] and r["length"] > 0
        if len(want[k]) == 1:
            at = 0
            for r in sorted(held, key=lambda r: r["start"]):
                assert r["start"] == at
                at += r["length"]
            assert at == len(want[k][0])
    fills = []
    for held in sequences.values():
        at = 0
        for offset, size in sorted(held):
            assert offset == at
            at += size
        assert at <= length
        fills.append(at)
    return fills


def padding(fills, length=LENGTH):
    return sum(length - f for f in fills if f & (f - 1)) / sum(fills)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(), st.sampled_from(" \n\t.,'!sdt́ßΣİéſ \x85\x1c<>|")), max_size=40) | st.just("<|endoftext|> don't we'LL x.'s 'S") | st.just("word" * 40 + '."'), max_size=8))
def test_words_have_the_ids_of_whole_texts(texts):
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    got = [list(array("H", x)) for x in Encoder(PATH).encode(texts)]
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_forgetting_words_changes_nothing(monkeypatch, prose, plain):
    monkeypatch.setattr(packing, "MOST_WORDS", 20)
    e, texts = Encoder(PATH), [prose(i, 60) + " end. and!" for i in range(9)]
    for t in [*texts, *texts]:
        assert list(array("H", next(e.encode([t])))) == plain(t)


def test_a_piece_goes_where_the_sum_of_squares_is_least():
    rng = random.Random(3)
    p, length = Packer(64, 2), 64
    counts = lambda: np.array([0, *(len(p.at[h]) for h in range(1, length + 1))])
    for _ in range(600):
        size, before = rng.randrange(1, 64), counts()
        sums = {}
        for h in range(length - size + 1):
            if h and not before[h]:
                continue
            n = before.copy()
            n[h] -= h > 0
            if h + size < length - 2:
                n[h + size] += 1
            sums[h] = int((n**2).sum())
        _, level = p.place(size)
        assert level == max(h for h, s in sums.items() if s == min(sums.values()))
        assert int((counts() ** 2).sum()) == min(sums.values())


def test_all_documents(spark, prose, plain):
    docs = [(i, prose(i, random.Random(i).randrange(1, 900))) for i in range(700)] + [(1000, prose(5, 9000)), (1001, "a " * (LENGTH - 1)), (1002, None), (1003, ""), (None, "x y"), (None, None), (7, prose(7, 50)), (7, prose(7, 50))]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS task").repartition(5)
    rows = packed(df).collect()
    fills = check(rows, docs, plain)
    assert padding(fills) <= SLACK / LENGTH
    whole = {r["doc_id"] for r in rows if r["start"] == 0 and r["length"] == r["doc_tokens"]}
    assert len(whole) > 600  # few documents are cut
    assert sum(f == LENGTH for f in fills) >= 10 and any(r["doc_id"] == 1001 and r["length"] == LENGTH and r["offset"] == 0 for r in rows)


def test_several_groups_and_the_odd_rows(spark, odd_docs, no_docs, plain, monkeypatch, prose):
    monkeypatch.setattr(packing, "GROUP_TOKENS", 3000)
    docs = [(i, prose(i, 40 + i % 200)) for i in range(200)]
    fills = check(packed(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs, plain)
    assert padding(fills) <= SLACK / LENGTH
    check(packed(odd_docs).collect(), [(r["doc_id"], r["text"]) for r in odd_docs.collect()], plain)
    assert packed(no_docs).count() == 0


def test_the_query(spark, sf, plain):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = op13_packing(spark, sf)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and all(t == "bigint" for _, t in out.dtypes)
    assert padding(check(out.collect(), docs, plain)) < 0.002


def test_laying_out_end_to_end():
    pieces = [(k, 0, np.arange(n, dtype="<u2").tobytes(), n) for k, n in enumerate([5, 1, 20, 9])]
    out = list(laid_out(pieces, 16, 3))
    sizes = defaultdict(int)
    for _, _, ids, _, s, offset in out:
        assert offset == sizes[s]
        sizes[s] += len(ids) // 2
    assert dict(sizes) == {3: 16, 4: 16, 5: 2, 6: 1} and list(powers(2047)) == [1 << i for i in range(10, -1, -1)] and list(laid_out([], 16, 0)) == []
