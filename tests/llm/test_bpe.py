import hashlib

import public_tokenizers
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from leafloom.llm import bpe

RANKS = bpe.read_ranks(public_tokenizers.path(bpe.RANKS))
PLAIN = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_odd_rows(odd_docs):
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(odd_docs).collect())
    want = []
    for r in odd_docs.collect():
        ids = PLAIN.encode_ordinary(r["text"] or "")
        want.append((str(r["doc_id"]), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert got == sorted(want)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_are_those_of_the_rank_library(text):
    tok, by_id = bpe.codec(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    ids = next(bpe.encode_texts(tok, [text]))
    assert ids == PLAIN.encode_ordinary(text)
    assert bpe.decode_ids(by_id, ids) == text.encode()


def test_encode_and_decode_with_places(spark):
    text = "A café \U0001f469‍\U0001f680 here"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in bpe.decode(bpe.encode(df, offsets="places")).collect()}
    assert bytes(rows[1]["decoded"]).decode() == text
    assert rows[2]["ids"] == [] and rows[3]["ids"] == [] and bytes(rows[2]["decoded"]) == b""
    places = [(p["start"], p["end"]) for p in rows[1]["places"]]
    assert len(places) == len(rows[1]["ids"])
    assert all(0 <= a <= b <= len(text) for a, b in places)
    assert {i for a, b in places for i in range(a, b)} == set(range(len(text)))


def test_clashing_names_and_empty_table(spark, no_docs):
    import pytest

    with pytest.raises(ValueError):
        bpe.encode(no_docs, ids="lang")
    with pytest.raises(ValueError):
        bpe.decode_ids({0: b"a"}, [5])
    assert bpe.round_trip(no_docs).count() == 0


def by_words(words, texts):
    return [ids for part in bpe.parts_of(pa.array(texts, pa.string())) for ids in words.encode(part).to_pylist()]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\u00a0\u3000'sl.,_1aé中"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=6))
def test_ids_by_words_are_those_of_whole_texts(texts):
    words = bpe.words_of(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    want = [PLAIN.encode_ordinary(t) for t in texts]
    assert by_words(words, texts) == want
    assert by_words(words, texts) == want


def test_odd_texts_by_words(monkeypatch):
    texts = ["", " ", "  ", "\n", " a", "a ", "a  b", "a\n b", "a \n\n  b\n\n\nc. d", "don't. I'll 's", "中" * 500, "x" * 300 + " " + "y" * 300 + "." + "z" * 300, None, "if a:\n    return b\n\n\tc = 1"]
    texts += [f"{t} {u}" for t in texts if t for u in texts if u]
    want = [PLAIN.encode_ordinary(t or "") for t in texts]
    for held, step in ((1 << 20, 1 << 22), (3, 50)):
        monkeypatch.setattr(bpe, "MOST_WORDS", held)
        monkeypatch.setattr(bpe, "WORDS_BYTES", step)
        words = bpe.Words(*bpe.codec(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN))
        assert by_words(words, texts) == want
        assert by_words(words, [""]) == [[]] and by_words(words, []) == []
        assert all(len(w) <= bpe.LONGEST_WORD for w in [*words.known, *words.bare])


def test_the_library_gets_each_word_once(prose, monkeypatch):
    got = []
    whole = bpe.encode_texts
    monkeypatch.setattr(bpe, "encode_texts", lambda tok, texts, *a: whole(tok, got.extend(texts) or texts, *a))
    texts = [prose(i, 2000) for i in range(20)]
    path = public_tokenizers.path(bpe.RANKS)
    bpe.words_of.cache_clear()
    ids = [x for part in bpe.parts_of(pa.array(texts)) for x in bpe.ids_of(path, public_tokenizers.PATTERN, part).to_pylist()]
    assert ids == [PLAIN.encode_ordinary(t) for t in texts]
    assert sum(map(len, got)) < sum(map(len, texts)) / 3


def test_other_patterns_encode_whole_texts(spark):
    pattern = r"\S+ \S+|\s+|\S+"
    plain = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=RANKS, special_tokens={})
    df = spark.createDataFrame([(1, "one two three four"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r["ids"] for r in bpe.encode(df, pattern=pattern).collect()}
    assert rows == {1: plain.encode_ordinary("one two three four"), 2: []}
    counts = {r["doc_id"]: r["n_tokens"] for r in bpe.round_trip(df, pattern=pattern).collect()}
    assert counts == {k: len(v) for k, v in rows.items()}
