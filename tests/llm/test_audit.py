import random
import re
from fractions import Fraction
from itertools import permutations

import pytest

from leafloom.llm.audit import OP11_SQL, at_corner, audit, audited, op11_audit, removal_polynomial, shapley


def fails(rows):
    """Masks by the definitions; rows: (doc_id, text, lang)."""
    out = []
    for k, t, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = k is not None and any(o is not None and o < k and (u or "") == t for o, u, _ in rows)
        out.append([len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), copy])
    return out


def brute(rows, labels):
    """Every order applied to every document."""
    out, masks = {}, fails(rows)
    good, toxic = {k for k, q, _ in labels if q == 1 and k is not None}, {k for k, _, t in labels if t == 1 and k is not None}
    for part in {lang or "" for _, _, lang in rows}:
        mine = [(k, m) for (k, _, lang), m in zip(rows, masks, strict=True) if (lang or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                i = "ABCDE".index(f)
                removed, kept = [x for x in left if x[1][i]], [x for x in left if not x[1][i]]
                redundant = sum(m[i] for _, m in mine) - len(removed)
                unique = sum(m[i] and sum(m) == 1 for _, m in mine)
                out[part, "".join(order), step] = [len(kept), len(removed), redundant, unique, sum(k in good for k, _ in removed), sum(k in toxic for k, _ in removed)]
                total[f] += len(removed)
                left = kept
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def rows_of(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in df.collect()}


def test_every_order_as_by_brute_force(spark, odd_docs, prose):
    rng = random.Random(4)
    long = [prose(i, 260) for i in range(6)] + [("a b c " * 90), prose(9, 210).upper(), prose(8, 230) + " 100%"]
    rows = [(i, rng.choice(long), rng.choice(["en", "de", None])) for i in range(60)] + [(None, long[0], "en"), (None, long[0], "en"), (7, long[0], "en"), (7, long[0], "de")]
    rows += [(r["doc_id"], r["text"], r["lang"]) for r in odd_docs.collect()]
    labels = [(i, i % 2, i % 5 == 0) for i in range(0, 60, 3)] + [(3, 0, 0), (3, 1, 1), (None, 1, 1), (9, None, None)]
    labels = [(k, q, None if t is None else int(t)) for k, q, t in labels]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS mask", "'x' AS part", "2 AS n")
    got = rows_of(audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == brute(rows, labels)
    assert len(got) == 600 * 4  # en, de, fr and the nameless part


def test_empty_tables(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(no_docs, labels).count() == 0
    one = rows_of(audit(spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string"), labels))
    assert len(one) == 600 and one["", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120] and one["", "ABCDE", 2] == [0, 0, 0, 0, 0, 0, 0]


def test_as_its_sql(spark, sf, duck, same):
    got, want = op11_audit(spark, sf).toPandas(), duck.execute(OP11_SQL).df()
    assert sorted(got.columns) == sorted(want.columns) and same(got) == same(want)


@pytest.mark.parametrize("seed", range(5))
def test_polynomials(seed):
    rng = random.Random(seed)
    counts = {m: rng.randrange(50) for m in rng.sample(range(32), 20)}
    p = removal_polynomial(counts, 5)
    for corner in range(32):
        assert at_corner(p, corner) == sum(c for m, c in counts.items() if m & corner)
    for i in range(5):
        marginal = [at_corner(p, sum(1 << j for j in o[: o.index(i) + 1])) - at_corner(p, sum(1 << j for j in o[: o.index(i)])) for o in permutations(range(5))]
        assert shapley(p, i) == Fraction(sum(marginal), 120)
    assert sum(shapley(p, i) for i in range(5)) == at_corner(p, 31)  # nothing is left over
    assert len(list(audited({"n": counts, "good": {}, "toxic": {}}))) == 600
