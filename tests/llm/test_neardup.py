import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafloom.llm import neardup
from leafloom.llm.dartminhash import Darts, jaccard, shingles
from leafloom.llm.neardup import THRESHOLD, classes, deduplicate


def grams(text):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    both = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


def brute(rows):
    """Class of each (id, text): connected by equality or by similarity."""
    sets, up = [grams(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or similarity(sets[i], sets[j]) >= THRESHOLD:
                up[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[top(i)] = min(least.get(top(i), k), k)
    return sorted((str(k), str(least.get(top(i)))) for i, (k, _) in enumerate(rows))


def corpus(prose):
    r, rows = random.Random(5), []
    for base in range(12):
        words = prose(100 + base, 120).split(" ")
        rows.append((len(rows), " ".join(words)))
        for rate in (0.0, 0.005, 0.01, 0.02, 0.05):
            rows.append((len(rows), " ".join(w if r.random() > rate else "zz" for w in words)))
    shared = prose(999, 60)
    rows += [(len(rows) + i, shared + " " + prose(2000 + i, 80)) for i in range(20)]  # a passage that many hold
    hot = prose(77, 200).split(" ")
    rows += [(len(rows) + i, " ".join([*hot[:-1], f"n{i}"])) for i in range(40)]  # many near copies of each other
    return rows


def test_classes_as_by_brute_force(spark, prose):
    rows = corpus(prose)
    got = classes(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id").collect()
    assert sorted((str(a), str(b)) for a, b in got) == brute(rows)


def test_odd_rows(odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = classes(odd_docs).select("doc_id", "class_id").collect()
    assert sorted((str(a), str(b)) for a, b in got) == brute(rows)
    kept = deduplicate(odd_docs.drop("class_id", "digest")).collect()
    assert len(kept) == len({b for _, b in brute(rows)})
    assert len({r["doc_id"] for r in kept}) == len(kept)


@pytest.mark.parametrize("block, few", [(2048, 4), (64, 1)])
def test_pairs_of_outsiders_in_a_hot_bucket(spark, prose, monkeypatch, block, few):
    """All texts in one bucket: a third near copies of a base, the others at 0.5 to 0.8 to it, in pairs or threes of near copies."""
    r, base, rows = random.Random(8), prose(501, 200).split(" "), []
    for i in range(60):
        rows.append((len(rows), " ".join([*base[:-1], f"n{i}"])))
    for i in range(50):
        words = list(base)
        for at in r.sample(range(5, len(words) - 5), r.choice([6, 8, 10])):
            words[at] = f"o{i}x{at}"
        rows += [(len(rows) + j, " ".join([*words, *[f"t{i}y{j}"] * (2 * j)])) for j in range(2 + i % 2)]
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "FEW", few)
    monkeypatch.setattr(neardup, "signed", lambda docs: docs.select("key", "digest", F.array(F.lit(1).cast("long")).alias("bands")))
    got = classes(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id").collect()
    assert sorted((str(a), str(b)) for a, b in got) == brute(rows)


def test_a_hot_cluster_as_by_brute_force(spark, prose):
    """500 texts at 0.3 to 1 to one base, with real bands: most pairs meet in a bucket, and few of those outside the core are links."""
    r, base = random.Random(11), prose(900, 150).split()
    rows = []
    for i in range(500):
        words = list(base)
        for at in r.sample(range(len(words)), r.choice([0, 1, 2, 3, 4, 6, 9, 14])):
            words[at] = f"e{r.randint(0, 40)}"
        rows.append((i, " ".join(words)))
    ids, counts, of = shingles([t.encode() for _, t in rows])
    kinds, place = np.unique(ids, return_inverse=True)
    held = np.zeros((len(rows), len(kinds)), dtype=np.float32)
    held[of, place] = counts
    common = sum((held >= n).astype(np.float32) @ (held >= n).astype(np.float32).T for n in range(1, int(held.max()) + 1))
    size = held.sum(axis=1)
    near = np.argwhere(np.triu(common / (size[:, None] + size[None, :] - common) >= THRESHOLD - 1e-6, 1)).tolist()
    class_of = {a: c for a, c in classes(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id").collect()}
    assert len(near) > 5000 and all(class_of[a] == class_of[b] for a, b in near)
    up = list(range(len(rows)))
    top = lambda i: i if up[i] == i else top(up[i])
    for a, b in near:
        up[max(top(a), top(b))] = min(top(a), top(b))
    assert len(set(class_of.values())) == len({top(i) for i in range(len(rows))}) > 20


def test_empty_table(no_docs):
    assert classes(no_docs).count() == 0 and deduplicate(no_docs).count() == 0


@pytest.mark.parametrize("weights", [(1, 1), (1, 4), (2.5, 7)])
def test_signatures_agree_as_often_as_weights_overlap(weights):
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = weights
    w = np.concatenate([np.full(200, float(a)), np.full(200, float(b))])
    elements = np.concatenate([ids[:200], ids[100:]])
    sets = np.repeat([0, 1], 200)
    s = Darts(2000).signatures(elements, w, sets, 2)
    want = 100 * min(a, b) / (200 * a + 200 * b - 100 * min(a, b))
    assert abs((s[0] == s[1]).mean() - want) < 0.04


def test_exact_similarity_is_that_of_counts(prose):
    a, b = prose(1, 90), prose(1, 60) + " tail of it"
    h, c, of = shingles([a.encode(), b.encode()])
    assert jaccard((h[of == 0], c[of == 0]), (h[of == 1], c[of == 1])) == pytest.approx(similarity(grams(a), grams(b)))
