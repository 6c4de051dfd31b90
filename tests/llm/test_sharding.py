import zlib

import numpy as np
import pyarrow as pa
import pytest

from leafloom.llm import sharding
from leafloom.llm.sharding import DIMENSIONS, SHARDS, WEIGHTS, assign, op10_sharding, pack


def check(rows, texts):
    for s in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    want = sorted((str(k), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in texts)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == want


def test_balance_groups_and_slots(spark, prose):
    texts = [(i, prose(i, 20 + i % 50)) for i in range(3000)] + [(5000 + i, "the same text") for i in range(40)]
    rows = assign(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    check(rows, texts)
    sizes = np.bincount([r["shard"] for r in rows], [r["size"] for r in rows], SHARDS)
    assert sizes.max() / sizes.min() < 1.03
    assert len({r["shard"] for r in rows if r["doc_id"] >= 5000}) == 1


def test_a_hot_group_is_split(spark, prose):
    texts = [(i, prose(i, 30)) for i in range(400)] + [(1000 + i, prose(7, 30)) for i in range(400)]
    rows = assign(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    check(rows, texts)
    sizes = np.bincount([r["shard"] for r in rows], [r["size"] for r in rows], SHARDS)
    assert sizes.max() / sizes.min() < 1.5


@pytest.mark.parametrize("groups", [40, 8192])
def test_groups_in_parcels(spark, prose, monkeypatch, groups):
    """Groups of two to nine copies, in many parcels or in one: none is split, and all dimensions are balanced."""
    monkeypatch.setattr(sharding, "PARCEL_GROUPS", groups)
    texts = [(i * 10 + j, prose(i, 20 + i % 60)) for i in range(900) for j in range(2 + i % 8)]
    rows = assign(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    check(rows, texts)
    of = {}
    for r in rows:
        of.setdefault((r["doc_id"] // 10), set()).add(r["shard"])
    assert all(len(v) == 1 for v in of.values())
    for what in ("size", "tokens"):
        sums = np.bincount([r["shard"] for r in rows], [r[what] for r in rows], SHARDS)
        assert sums.max() / sums.min() < (1.05 if groups > 100 else 1.25)


@pytest.mark.parametrize("uneven", [0.0, 0.001, 0.03])
def test_long_tails_over_many_parcels(spark, monkeypatch, uneven):
    """Some 500 parcels, sizes with a long tail and a heavy group for each parcel, capacities alike or not: each shard gets its part."""
    monkeypatch.setattr(sharding, "PARCEL_GROUPS", 512)
    rng, n = np.random.default_rng(7), 256_000
    sizes = np.minimum(rng.pareto(1.1, n) * 400 + 30, 5e4)
    sizes[:: n // 500] = 50_000
    data = pa.table({"group": pa.array([i.to_bytes(16, "big") for i in range(n)], pa.binary()), "size": sizes.astype(np.int64), "tokens": (sizes / rng.uniform(3, 9, n)).astype(np.int64) + 1, "rows": rng.integers(1, 9, n)})
    demands = np.column_stack([data.column(d).to_numpy().astype(float) for d in DIMENSIONS])
    fair = demands.sum(axis=0) / SHARDS
    weight = (demands / fair).max(axis=1)
    assert weight.max() < 1 / sharding.PARCELS and (weight > 1 / 4096).sum() > 300
    capacity = 1 + uneven * np.linspace(-1, 1, SHARDS)[:, None] * np.ones((1, 3))
    groups = spark.createDataFrame(data.append_column("weight", pa.array(weight)))
    out = sharding.by_parcels(groups, SHARDS, capacity).toArrow().sort_by("group")
    assert out.column("group").to_pylist() == data.column("group").to_pylist()
    loads = np.array([demands[out.column("shard").to_numpy() == s].sum(axis=0) for s in range(SHARDS)])
    off = np.abs(loads / (fair * capacity) - 1).max(axis=0)
    assert off[0] < 0.01 and off.max() < 0.02, off


def test_odd_rows_and_empty_table(odd_docs, no_docs, spark, sf):
    check(assign(odd_docs).collect(), [(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert assign(no_docs).count() == 0
    r = op10_sharding(spark, sf).first()
    assert r["law"] == "bytes" and r["grown_shard"] is None


def test_pack_takes_the_highest_dot_product():
    rng = np.random.default_rng(2)
    d = rng.integers(1, 50, (200, 3)).astype(float)
    got = pack(d, 4)
    share, residual = d / (d.sum(axis=0) / 4), np.ones((4, 3))
    for i in sorted(range(len(d)), key=lambda i: (-share[i].max(), i)):
        scores = [float(residual[s] @ (share[i] * WEIGHTS)) for s in range(4)]
        assert scores[got[i]] == max(scores)
        residual[got[i]] -= share[i]
    loads = np.array([d[got == s].sum(axis=0) for s in range(4)])
    assert (loads.max(axis=0) / loads.min(axis=0) < 1.1).all()
    assert len(pack(np.empty((0, 3)), 4)) == 0
