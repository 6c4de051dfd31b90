import hashlib
import math
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from leafloom.llm import fingerprints as fp


def lines_of(text):
    return [w for line in (text or "").split("\n") if (w := [x for x in re.split(r"[\x20\x09-\x0D]+", line) if x])]


def by_hand(text):
    """The exact part by plain Python: sums of the halves of seeded hashes of paragraphs."""
    lanes = [0] * fp.EXACT
    for w in lines_of(text):
        for i in range(fp.EXACT // 2):
            h = xxhash.xxh64(" ".join(w).encode(), xxhash.xxh64(i.to_bytes(4, "little", signed=True), 42).intdigest()).intdigest()
            for j, x in enumerate((h % fp.EXACT_MOD, h >> 32)):
                lanes[2 * i + j] = (lanes[2 * i + j] + x) % fp.EXACT_MOD
    return "".join(f"{x:08x}" for x in lanes)


def sketch_by_hand(text):
    lanes = Counter()
    for w in lines_of(text):
        for i in range(max(1, len(w) - 2)):
            h = 42
            for x in w[i : i + 3]:
                h = xxhash.xxh64(x.encode(), h).intdigest()
            lanes[h % fp.SKETCH] += -1 if h >> 32 & 1 else 1
    return {k: n for k, n in lanes.items() if n}


def cosine(a, b):
    if not a or not b:
        return 1.0 if not a and not b else 0.0
    dot = sum(n * b.get(k, 0) for k, n in a.items())
    return max(0.0, dot / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values())))


def rows_of(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))


@pytest.mark.parametrize("rows", [2, 1000])
def test_every_column_as_by_hand(spark, prose, monkeypatch, rows):
    """Fingerprints of edited texts come from the own ones by adding and taking away; here they are made from nothing."""
    monkeypatch.setattr(fp, "RANGE_ROWS", rows)
    texts = {i * 7: prose(i, 5 + 4 * i) for i in range(20)} | {500: None, 501: "", 502: "é\U0001f600ab", 503: "x", 504: "a b\n\n c d e f\n", 505: prose(9, 300).replace("\n", " ")}
    got = rows_of(fp.fingerprint(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    keys = sorted(texts)
    assert [r["doc_id"] for r in got] == keys
    for n, r in enumerate(got):
        t, nxt = texts[keys[n]] or "", texts[keys[(n + 1) % len(keys)]] or ""
        k = len(t) // 4
        edited = t[: len(t) - k] + nxt[:k]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, new, after = map(sketch_by_hand, (t, edited, nxt))
        show = lambda text, x: by_hand(text) + ":" + "".join(f"{i:02x}{x[i] % fp.SKETCH_MOD:04x}" for i in sorted(x))
        assert r["fingerprint"] == show(t, own) and r["edited_fingerprint"] == show(edited, new)
        assert r["near_edited"] == pytest.approx(cosine(own, new)) and r["near_next"] == pytest.approx(cosine(own, after))


@pytest.mark.parametrize("rows", [2, 1000])
def test_null_and_repeated_keys_keep_their_order(spark, prose, monkeypatch, rows):
    """A third of the rows without a key, a third with one key: by hash of the text, as one order over all rows."""
    monkeypatch.setattr(fp, "RANGE_ROWS", rows)
    docs = [(None, prose(i, 12)) for i in range(15)] + [(40, prose(50 + i, 12)) for i in range(15)] + [(30 + i, prose(90 + i, 12)) for i in range(15)]
    signed = lambda t: (h := xxhash.xxh64(t.encode(), 42).intdigest()) - (1 << 64) * (h >> 63)
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, signed(d[1])))
    want = {}
    for n, (_, t) in enumerate(order):
        nxt, k = order[(n + 1) % len(order)][1], len(t) // 4
        want[by_hand(t)] = hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()
    got = fp.fingerprint(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == len(docs) and {r["fingerprint"].split(":")[0]: r["edited_sha256"] for r in got} == want


def test_order_does_not_matter_and_likeness_is_graded(spark, prose):
    a = prose(1, 240)
    lines = a.split("\n")
    rows = [(1, a), (2, "\n".join(reversed(lines))), (3, "\n".join(lines[:10]) + "\n" + prose(2, 120)), (4, prose(3, 240))]
    got = {r["doc_id"]: r for r in rows_of(fp.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got[1]["fingerprint"] == got[2]["fingerprint"] != got[3]["fingerprint"]
    assert got[1]["near_next"] == pytest.approx(1) and 0.25 < got[2]["near_next"] < 0.75 and got[3]["near_next"] < 0.3
    assert all(0.5 < got[k]["near_edited"] < 0.95 for k in (3, 4))  # what 1 and 2 take from the next one they hold already


def test_paragraphs_are_added_and_taken_away(spark, prose):
    a, b = prose(1, 60), prose(2, 40)
    rows = [(1, a), (2, b), (3, a + "\n" + b), (4, "")]
    f = {r["doc_id"]: r["fingerprint"] for r in fp.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    got = spark.createDataFrame([(f[1], f[2], f[3], f[4])], "a string, b string, ab string, none string").select(fp.combine(F.col("a"), F.col("b")), fp.combine(F.col("ab"), F.col("b"), True), fp.combine(F.col("a"), F.col("none")), fp.combine(F.col("a"), F.col("a"), True)).first()
    assert list(got) == [f[3], f[1], f[1], f[4]]


def test_odd_rows(odd_docs, no_docs):
    got = fp.fingerprint(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (1, 5)}) == 1
    assert fp.fingerprint(no_docs).count() == 0
