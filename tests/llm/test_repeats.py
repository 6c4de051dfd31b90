import hashlib
import random

import numpy as np
import pytest

from leafloom.llm import repeats
from leafloom.llm.suffixes import WIDTH, common, decoded, front_code, merge, prefix, sort, unpack, Run


def brute(rows):
    """(id, bytes, removed, spans, sha256) by a dictionary of all 50-byte strings."""
    first = {}
    for k, t in rows:
        b = (t or "").encode()
        key = float("inf") if k is None else k
        for j in range(len(b) - 49):
            first[b[j : j + 50]] = min(first.get(b[j : j + 50], key), key)
    out = []
    for k, t in rows:
        b, key = (t or "").encode(), float("inf") if k is None else k
        gone = np.zeros(len(b), dtype=bool)
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < key:
                gone[j : j + 50] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((str(k), len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(prose):
    r = random.Random(9)
    passage, line = prose(50, 30), "x" * 49 + "\n"
    rows = [(i * 3, prose(300 + i, 40) + (" " + passage if i % 3 == 0 else "") + prose(400 + i, 20)) for i in range(30)]
    rows += [(200 + i, line + "y" + line) for i in range(3)]  # 49 and 50 equal bytes
    rows += [(300, passage[:50]), (301, passage[1:50]), (302, "a" * 300), (303, "a" * 120), (304, "ab" * 90), (305, "é" * 60), (306, "qé" * 10 + "é" * 45)]
    rows += [(400 + i, "".join(r.choice("ab") for _ in range(400))) for i in range(4)]
    return rows


@pytest.mark.parametrize("size", [4 << 20, 700])
def test_as_by_brute_force(spark, prose, size, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP_BYTES", size)
    monkeypatch.setattr(repeats, "PART_BYTES", 3 * size)
    rows = corpus(prose)
    got = repeats.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == brute(rows)


def test_odd_rows(odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = repeats.digests(odd_docs).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == brute(rows)


def test_texts_stay_whole_characters_and_other_columns_stay(odd_docs):
    out = repeats.remove(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    by = {r["doc_id"]: r["text"] for r in out.collect()}
    assert by[2] is None and by[3] == "" and by[7] == " end"[-len(by[7]) :]
    assert repeats.whole_characters("aéb".encode(), [(0, 2)]) == [(0, 1)]
    assert repeats.whole_characters("aéb".encode(), [(2, 4)]) == [(3, 4)]


def test_empty_table(no_docs):
    assert repeats.digests(no_docs).count() == 0


def test_merge_is_a_sort_and_knows_common_prefixes():
    rng = np.random.default_rng(1)
    runs = []
    for n in (0, 1, 7, 300, 299):
        rows = rng.integers(0, 3, (n, WIDTH)).astype(np.uint8)
        rows[:, :30] = rows[:, :30] // 2
        runs.append(sort(Run(rows, *(np.zeros(n, dtype=np.int64) for _ in range(5)))))
    which, shared, texts = merge([decoded(*unpack(front_code(r))[:2]) for r in runs])
    want = sorted(x.tobytes() for r in runs for x in r.rows)
    assert texts == want and len(which) == len(want)
    assert np.array_equal(common(np.frombuffer(b"".join(texts), np.uint8).reshape(-1, WIDTH))[1:], shared[1:])


def test_prefix():
    a = bytes(WIDTH)
    for n in (0, 5, 8, 40, WIDTH - 1):
        b = bytearray(a)
        b[n] = 1
        assert prefix(a, bytes(b), 0) == n and prefix(a, bytes(b), min(n, 3)) == n
    assert prefix(a, a, 7) == WIDTH


def test_names_that_operators_use_inside(spark, prose):
    rows = [(k, t, 7, 8, 9) for k, t in corpus(prose)[:12]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _k int, row_hash int, group_number int")
    out = repeats.remove(docs)
    assert out.columns == docs.columns and {tuple(r)[2:] for r in out.collect()} == {(7, 8, 9)} and out.count() == 12
