import hashlib
import math
import re
from collections import Counter, defaultdict

import corpus_pipeline as cp
import public_tokenizers
import pytest
import tiktoken
from test_neardup import brute as classes_by_hand
from test_quality import brute as measures_by_hand

from leafloom.llm import bpe, mixing, neardup, quality, repeats
from leafloom.llm.mixing import BLOCK_ROWS, SEED
from leafloom.llm.queries import oracle_sql, queries


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, f in cp.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        f(spark, docs, sf).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_stages_keep_the_columns_of_documents(stages):
    for _, after in stages[:-1]:
        assert after.columns == cp.COLUMNS


def test_each_stage_is_its_operator(stages):
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    (d0, d1), (_, d2), (_, d3), (_, d4), (_, d5) = stages
    kept = quality.judge(quality.measures(d0)).where("kept")
    assert ids(d1) == ids(kept)
    assert ids(d2) == sorted({r[0] for r in neardup.classes(d1).select("class_id").collect()})
    removed = {r["doc_id"]: r["n_removed"] for r in repeats.digests(d2).collect()}
    before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (d2, d3))
    assert ids(d3) == ids(d2)
    for k, t in before.items():
        gone = len(t.encode()) - len(after[k].encode())
        assert removed[k] - 6 * (removed[k] > 0) * 50 <= gone <= removed[k]
    assert d4.count() == mixing.plan(d3, max_repeats=cp.MAX_REPEATS).selectExpr("sum(passes)").first()[0]
    assert set(ids(d4)) == set(ids(d3))
    assert d5.count() == d4.count() and d5.where("round_trip").count() == d5.count()
    assert bpe.RANKS


def test_run_and_the_registered_queries(spark, sf, stages):
    assert cp.run(spark, sf).count() == stages[-1][1].count()
    names = queries()
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)}
    assert set(oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_as_their_sql(spark, sf, duck, same, name):
    got, want = queries()[name](spark, sf).toPandas(), duck.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and same(got) == same(want)


@pytest.mark.parametrize("name", sorted(n for n in queries() if n not in oracle_sql()))
def test_other_queries_give_a_row_a_document(spark, sf, name):
    assert queries()[name](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


# -- the whole pipeline by plain Python ----------------------------------------------------------------------------------------------


def kept_by_hand(rows):
    """Stage 1: rows (id, text, source) that are kept."""
    judged, hosts = [], defaultdict(lambda: [0, 0])
    for k, t, host in rows:
        words, chars, symbols, dups, repeated = measures_by_hand(t)
        upper, lines = len(re.findall(r"[A-ZÄÖÜÉÀÈÁÍÓÚÑ]", t or "")), len([x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
        base = words < 10 or 100 * repeated > 20 * words
        hard = [10 * symbols > words, 2 * upper > chars, chars < 2 * words or chars > 14 * words, 10 * dups > 6 * lines]
        near = [20 * symbols > words, 4 * upper > chars, chars < 3 * words or chars > 10 * words, 10 * dups > 3 * lines, 10 * repeated > words]
        judged.append((k, t, host, base, sum(hard), sum(near)))
        hosts[host][0] += 1
        hosts[host][1] += base or any(hard)
    n, f = sum(a for a, _ in hosts.values()), sum(b for _, b in hosts.values())
    p = [b / a for a, b in hosts.values()]
    a, b = quality.prior(len(hosts), n, f, sum(p), sum(x * x for x in p))
    out = []
    for k, t, host, base, hard, near in judged:
        rate = (hosts[host][1] + a) / (hosts[host][0] + a + b)
        far = math.sqrt(rate * (1 - rate) / (hosts[host][0] + a + b + 1))
        allowed = hard <= 1 if rate + far < f / n else hard + near == 0 if rate - far > f / n else hard == 0
        if allowed and not base:
            out.append((k, t, host))
    return out


def cleared_by_hand(rows):
    """Stage 3: texts without the 50-byte strings that smaller documents hold; characters that repeat in part stay."""
    first = {}
    for k, t, _ in rows:
        b = t.encode()
        for j in range(len(b) - 49):
            first[b[j : j + 50]] = min(first.get(b[j : j + 50], k), k)
    out = []
    for k, t, host in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < k:
                gone[j : j + 50] = b"\1" * 50
        left, at = [], 0
        for c in t:
            size = len(c.encode())
            if not all(gone[at : at + size]):
                left.append(c)
            at += size
        out.append((k, "".join(left), host))
    return out


def passes_by_hand(rows, most):
    """Stage 4: how often each document is used."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for _, t, _ in rows]
    mark = lambda *parts: hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()
    total, count = Counter(), Counter()
    for (_, _, host), n in zip(rows, size):
        total[host] += n
        count[host] += 1
    high, low = (math.log(f(total.values()) / sum(total.values())) for f in (max, min))
    a = max(0.0, 1 - math.log(most) / (high - low))
    blocks, tokens = defaultdict(list), Counter()
    for (k, _, host), n in zip(rows, size):
        o = mark(SEED, k)
        block = int(o[:8], 16) % -(-count[host] // BLOCK_ROWS)
        blocks[host, block].append((o, k, n))
        tokens[host, block] += n
    used = {}
    for host in total:
        n = total[host]
        budget = math.floor(min(most, (n / max(total.values())) ** (a - 1)) * n + 1e-6)
        whole, rest, spent = budget // n, budget % n, 0
        for b in sorted((b for h, b in blocks if h == host), key=lambda b: mark(SEED + 1, whole + 1, b)):
            so_far = spent
            for o, k, m in sorted(blocks[host, b], key=lambda x: mark(SEED + 2, whole + 1, x[0])):
                so_far += m
                used[k] = whole + (so_far <= rest and rest > 0)
            spent += tokens[host, b]
    return used


def test_run_by_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = kept_by_hand(rows)
    heads = {a for a, b in classes_by_hand([(k, t) for k, t, _ in rows]) if a == b}
    rows = cleared_by_hand([r for r in rows if str(r[0]) in heads])
    used = passes_by_hand(rows, cp.MAX_REPEATS)
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.RANKS)), special_tokens={})
    want = []
    for k, t, _ in rows:
        ids = plain.encode_ordinary(t)
        want += [(k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())] * used[k]
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in cp.run(spark, sf).collect()]
    assert sorted(got) == sorted(want)


def test_odd_rows_and_an_empty_table(spark, odd_docs, no_docs, tmp_path):
    """Nulls, ties, rows repeated in full, empty and long texts go through all stages."""
    for name, docs in (("odd", odd_docs.select(cp.COLUMNS)), ("none", no_docs)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
    got = cp.run(spark, str(tmp_path / "odd")).collect()
    assert {r["doc_id"] for r in got} == {1, 6, None} and all(r["round_trip"] for r in got)
    assert cp.run(spark, str(tmp_path / "none")).count() == 0
