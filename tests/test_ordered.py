"""Places of nodes as tables, against the same steps on lists."""

import pytest

from leafloom.errors import InputError
from leafloom.operators import ordered as O

A, B = {1: [5, 3, 3, None], 2: [7], 3: []}, {1: [3, 9], 2: [], 3: [4]}


@pytest.fixture(scope="module")
def frames(spark):
    make = lambda d: spark.createDataFrame([(k, n, i, f"t{i}") for k, ids in d.items() for n, i in enumerate(ids, 1)], "page_id long, n int, id int, name string")
    return make(A), make(B), spark.createDataFrame([(k,) for k in A], "page_id long")


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["page_id"], r["n"])):
        out.setdefault(r["page_id"], []).append(r["id"])
        assert len(out[r["page_id"]]) == r["n"] and (r["name"] is None or r["id"] is None or r["name"] == f"t{r['id']}")
    return {k: out.get(k, []) for k in A}


def test_as_on_lists(frames):
    a, b, pages = frames
    last = lambda x: (x is None, x or 0)
    once = lambda x: list(dict.fromkeys(x))
    each = lambda fn: {k: fn(A[k], B[k]) for k in A}
    assert lists(O.sort(a)) == lists(O.numbered(a.drop("n"))) == each(lambda x, y: sorted(x, key=last))
    assert lists(O.rev(a)) == each(lambda x, y: x[::-1]) and lists(O.rep(a, 3)) == each(lambda x, y: x * 3) and lists(O.rep(a, 0)) == each(lambda x, y: [])
    assert lists(O.unique(a)) == each(lambda x, y: once(x)) and lists(O.concat(a, b)) == each(lambda x, y: x + y) and lists(O.union(a, b)) == each(lambda x, y: once(x + y))
    assert lists(O.intersect(a, b)) == each(lambda x, y: [i for i in once(x) if i in y]) and lists(O.difference(a, b)) == each(lambda x, y: [i for i in once(x) if i not in y])
    pick = lambda x, p: x[p - 1] if p <= len(x) else None
    assert lists(O.at(a, [2, 9, 1, 2], pages)) == each(lambda x, y: [pick(x, 2), None, pick(x, 1), pick(x, 2)]) and lists(O.at(a, [-1, -3], pages)) == each(lambda x, y: [i for n, i in enumerate(x, 1) if n not in (1, 3)])
    assert lists(O.length(a, 2, pages)) == each(lambda x, y: (x + [None] * 2)[:2])
    filled = lambda x, p, v: [*(x + [None] * p)[: p - 1], v, *x[p:]]
    assert lists(O.put(a, 2, b, pages)) == each(lambda x, y: filled(x, 2, y[0] if y else None)) and lists(O.put(a, 6, None, pages)) == each(lambda x, y: filled(x, 6, None))


def test_wrong_places(frames):
    a, b, pages = frames
    for bad in ([0], [1, -1], [True]):
        with pytest.raises(InputError):
            O.at(a, bad, pages)
    for call in (lambda: O.put(a, 0, b, pages), lambda: O.rep(a, -1)):
        with pytest.raises(InputError):
            call()
