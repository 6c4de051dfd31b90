"""Suffix-array dedup: strings of 50 bytes that a smaller document holds too, found by a distributed merge sort of suffixes.

Texts are dealt to groups of about GROUP_BYTES by hash of their rows, in which each row has a number; that one exchange of texts serves all steps.

1. ask: each group sends the hashes of its anchors (see suffixes.py) to buckets of hashes, once each, and learns which of them
   other groups hold too. Anchors that no other text holds are dropped: a window that two texts share has an anchor in both.
2. sort: each group sorts the remaining suffixes. Of equal ones it keeps the smallest document's, and has decided the others.
   It sends the sorted run, cut at bounds of the hash that leads each suffix and front-coded, to the parts.
3. merge: each part merges its runs with a loser tree that compares no prefix twice. The common prefixes of neighbours, which
   come with the merge, show which windows are equal; those of larger documents go back to their texts as spans.
4. finish: each group joins the spans of each text.

Every comparison that decides is of bytes; hashes only select what is compared. A string that a third of all texts hold costs
each group one suffix, not one for each text.

Edge cases: null and empty texts, and texts of under 50 bytes, lose nothing. Rows with a null key count as larger than all
others. Rows with equal keys never shadow each other, so repeated rows keep what only they hold. An empty table gives an empty
result. Other columns are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafloom.llm.common import bounded_parts, free_names, give_back, table, text_of
from leafloom.llm.suffixes import LENGTH, REACH, WIDTH, Run, anchors, common, covered, decoded, front_code, merge, sort, suffixes, unpack

#: Texts of a group, and texts whose hashes or suffixes meet in a part: parts are fewer than groups, so that what a group sends to each
#: of them is not a handful of hashes in a row of its own.
GROUP_BYTES, PART_BYTES = 8 << 20, 16 << 20
#: In place of a document of the group: several hold the hash, and none of them has to be told.
SEVERAL = 0xFFFFFFFF
LAST = (1 << 63) - 1


def _blob(*arrays: np.ndarray) -> bytes:
    return struct.pack("<I", len(arrays[0])) + zlib.compress(b"".join(a.tobytes() for a in arrays), 1)


def _arrays(data: bytes, *kinds: str) -> list[np.ndarray]:
    (n,), body, at, out = struct.unpack_from("<I", data), zlib.decompress(memoryview(data)[4:]), 0, []
    for k in kinds:
        out.append(np.frombuffer(body, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def _ordered(group: pa.Table, key: str, text: str, row: str, number: str) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """The rows' order by hash, and in that order texts, documents and row keys: the group's number and the row's in it.

    row, number: columns of the rows' hashes and of the group's number."""
    keys = group.column(row).to_numpy()
    order = np.argsort(keys, kind="stable")
    docs = group.column(key).cast(pa.int64()).fill_null(LAST).to_numpy()
    raw = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in group.column(text)]
    return order, [raw[i] for i in order.tolist()], docs[order], (group.column(number)[0].as_py() << 32) + np.arange(len(order))


def _several(of: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different hashes, one document of each, and whether several documents hold it."""
    if not len(h):
        return h, of, np.empty(0, dtype=bool)
    order = np.lexsort((of, h))
    h, of = h[order], of[order]
    starts = np.flatnonzero(np.diff(h, prepend=h[:1] + np.uint64(1)))
    ends = np.append(starts[1:], len(h)) - 1
    return h[starts], of[starts], of[starts] != of[ends]


def _part(h: np.ndarray, n: int) -> np.ndarray:
    """The part of [0, n) for a hash of 40 bits, growing with it."""
    return ((h * np.uint64(n)) >> np.uint64(40)).astype(np.int32)


def _split(part: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, first, end) of a sorted array."""
    if not len(part):
        return []
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    return [(int(part[a]), int(a), int(b)) for a, b in zip(starts, np.append(starts[1:], len(part)), strict=True)]


def _spans(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[int, bytes]]:
    """Blobs of spans by group."""
    g = key >> 32
    order = np.lexsort((start, key))
    g = g[order]
    return [(p, _blob(*(x[order[a:b]].astype(k) for x, k in ((key, "<i8"), (start, "<i4"), (end, "<i4"))))) for p, a, b in _split(g)]


def asking(key: str, text: str, row: str, number: str, n: int) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        give_back()
        _, texts, _, _ = _ordered(group, key, text, row, number)
        of, _, h = anchors(texts)
        h, of, several = _several(of, h)
        who = np.where(several, SEVERAL, of).astype("<u4")
        rows = [(p, _blob(np.diff(h[a:b], prepend=np.uint64(0)).astype("<u8"), who[a:b])) for p, a, b in _split(_part(h, n))]
        g = group.column(number)[0].as_py()
        return pa.table({"part": pa.array([p for p, _ in rows], pa.int32()), "g": pa.array([g] * len(rows), pa.int64()), "data": pa.array([d for _, d in rows], pa.binary())})

    return run


def answering(asked: pa.Table) -> pa.Table:
    h, who, g = [], [], []
    for group, data in zip(asked.column("g").to_pylist(), asked.column("data").to_pylist(), strict=True):
        step, w = _arrays(data, "<u8", "<u4")
        h.append(np.cumsum(step, dtype=np.uint64))
        who.append(w)
        g.append(np.full(len(w), group))
    h, who, g = np.concatenate(h), np.concatenate(who), np.concatenate(g)
    order = np.argsort(h, kind="stable")
    h, who, g = h[order], who[order], g[order]
    same = np.zeros(len(h), dtype=bool)
    same[1:] = h[1:] == h[:-1]
    same[:-1] |= same[1:]
    tell = np.flatnonzero(same & (who != SEVERAL))
    tell = tell[np.argsort(g[tell], kind="stable")]
    rows = [(p, _blob(h[tell[a:b]].astype("<u8"), who[tell[a:b]])) for p, a, b in _split(g[tell])]
    return pa.table({"g": pa.array([p for p, _ in rows], pa.int64()), "data": pa.array([d for _, d in rows], pa.binary())})


def sorting(key: str, text: str, row: str, number: str, n: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(group: pa.Table, told: pa.Table) -> pa.Table:
        give_back()
        out: list[tuple[int, int | None, bytes]] = []
        if group.num_rows:
            _, texts, docs, keys = _ordered(group, key, text, row, number)
            of, place, h = anchors(texts)
            here, _, several = _several(of, h)
            answers = [_arrays(d, "<u8", "<u4") for d in told.column("data").to_pylist()]
            code = lambda h, of: h | (of.astype(np.uint64) << np.uint64(40))
            known = np.concatenate([code(a, b) for a, b in answers]) if answers else np.empty(0, np.uint64)
            keep = np.isin(h, here[several]) | np.isin(code(h, of), known)
            of, place, h = of[keep], place[keep], h[keep]
            if len(of):
                out = _sorted_runs(texts, docs, keys, of, place, h, n)
        return pa.table({"part": pa.array([p for p, _, _ in out], pa.int32()), "g": pa.array([g for _, g, _ in out], pa.int64()), "data": pa.array([d for _, _, d in out], pa.binary())})

    return run


def _sorted_runs(texts: list[bytes], docs: np.ndarray, keys: np.ndarray, of: np.ndarray, place: np.ndarray, h: np.ndarray, n: int) -> list[tuple[int, int | None, bytes]]:
    """Front-coded runs (part, None, run) and spans that the group has decided by itself (part, group, spans)."""
    rows = np.concatenate([suffixes(texts[i], place[a:b], h[a:b]) for i, a, b in _split(of)])
    size = np.array([len(t) for t in texts])[of]
    run = sort(Run(rows, docs[of], keys[of], place, np.maximum(0, LENGTH - (size - place)), np.minimum(REACH, place)))
    shared = common(run.rows)
    first = np.flatnonzero(shared < WIDTH)
    smallest = np.repeat(run.doc[first], np.diff(np.append(first, len(shared))))
    gone = (run.doc > smallest) & (run.low <= run.high)
    spans = _spans(run.key[gone], run.place[gone] - run.high[gone], run.place[gone] - run.low[gone] + LENGTH) if gone.any() else []
    out = [(g, g, data) for g, data in spans]
    run = run.take(np.flatnonzero(run.doc == smallest))
    lead = (run.rows[:, :5].astype(np.uint64) << np.arange(32, -1, -8, dtype=np.uint64)[None, :]).sum(axis=1, dtype=np.uint64)
    return out + [(p, None, front_code(run.take(np.arange(a, b)))) for p, a, b in _split(_part(lead, n))]


def merging(part: pa.Table) -> pa.Table:
    give_back()
    rows = list(zip(part.column("g").to_pylist(), part.column("data").to_pylist(), strict=True))
    out = [(g, d) for g, d in rows if g is not None]
    runs = [unpack(d) for g, d in rows if g is None]
    if runs:
        which, shared, texts = merge([decoded(s, t) for s, t, _ in runs])
        which = np.array(which)
        first = np.cumsum([0] + [len(s) for s, _, _ in runs])
        # the suffixes of a run come out in its order
        order = np.argsort(which, kind="stable")
        at = np.empty(len(which), dtype=np.int64)
        at[order] = np.arange(len(which)) - np.searchsorted(which[order], which[order]) + first[which[order]]
        doc, key, place, low, high = (np.concatenate([r[2][i] for r in runs])[at] for i in range(5))
        width = np.frombuffer(b"".join(texts), np.uint8).reshape(-1, WIDTH)
        least, greatest = covered(width, np.array(shared), doc.astype(np.int64), low, high)
        gone = np.flatnonzero(greatest >= 0)
        place = place.astype(np.int64)
        out += _spans(key[gone], place[gone] - greatest[gone], place[gone] - least[gone] + LENGTH) if len(gone) else []
    return pa.table({"g": pa.array([g for g, _ in out], pa.int64()), "data": pa.array([d for _, d in out], pa.binary())})



def joined(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans."""
    out: list[list[int]] = []
    for i in np.lexsort((end, start)).tolist():
        a, b = int(start[i]), int(end[i])
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    return b"".join(text[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(text)], strict=True))


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans less the bytes of characters that are not covered in full."""
    out = []
    inside = lambda i: i < len(text) and text[i] & 0xC0 == 0x80
    for a, b in spans:
        while inside(a):
            a += 1
        while inside(b):
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def repeated(docs: DataFrame, make: Callable, schema: T.StructType, key: str = "doc_id", text: str = "text") -> DataFrame:
    """make(rows, texts, spans) of each group of rows: an Arrow table of `schema`. rows: `docs`' columns; spans: what repeats in each text."""
    _, groups = bounded_parts(docs, F.octet_length(text), GROUP_BYTES)
    groups = max(8, groups)
    n = max(8, -(-groups * GROUP_BYTES // PART_BYTES))
    names = docs.columns
    row, number = free_names(docs, "row_hash", "group_number")
    dealt = docs.withColumn(row, F.xxhash64(F.col(key), text_of(text))).withColumn(number, F.pmod(F.col(row), F.lit(groups)))
    asked = dealt.groupBy(number).applyInArrow(asking(key, text, row, number, n), "part int, g long, data binary")
    told = asked.groupBy("part").applyInArrow(answering, "g long, data binary")
    runs = dealt.groupBy(number).cogroup(told.groupBy("g")).applyInArrow(sorting(key, text, row, number, n), "part int, g long, data binary")
    found = runs.groupBy("part").applyInArrow(merging, "g long, data binary")

    def finish(group: pa.Table, spans: pa.Table) -> pa.Table:
        give_back()
        order, texts, _, keys = _ordered(group, key, text, row, number)
        got = [_arrays(d, "<i8", "<i4", "<i4") for d in spans.column("data").to_pylist()]
        k, start, end = (np.concatenate([x[i] for x in got]) for i in range(3)) if got else (np.empty(0, np.int64),) * 3
        by = np.argsort(k, kind="stable")
        k, start, end = k[by], start[by], end[by]
        out: list = [[] for _ in texts]
        a, b = np.searchsorted(k, keys), np.searchsorted(k, keys, side="right")
        for i in np.flatnonzero(b > a).tolist():
            out[int(order[i])] = joined(start[a[i] : b[i]], end[a[i] : b[i]])
        raw: list = [b""] * len(texts)
        for i, t in zip(order.tolist(), texts, strict=True):
            raw[i] = t
        return make(group.select(names), raw, out)

    return dealt.groupBy(number).cogroup(found.groupBy("g")).applyInArrow(finish, schema)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    docs = docs.select(F.col(key).cast("long").alias(key), text)

    def make(rows: pa.Table, texts: list[bytes], spans: list[list[tuple[int, int]]]) -> pa.Table:
        removed = [sum(b - a for a, b in s) for s in spans]
        kept = [hashlib.sha256(without(t, s)).hexdigest() for t, s in zip(texts, spans, strict=True)]
        return pa.table({key: rows.column(key), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array([len(s) for s in spans], pa.int64()), "kept_sha256": pa.array(kept, pa.string())})

    return repeated(docs, make, f"{key} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", key, text)


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with the repeated strings gone from `text`; characters that repeat only in part stay. Null texts stay null."""
    at = docs.columns.index(text)

    def make(rows: pa.Table, texts: list[bytes], spans: list[list[tuple[int, int]]]) -> pa.Table:
        left = [without(t, whole_characters(t, s)).decode("utf-8", "replace") if s else None for t, s in zip(texts, spans, strict=True)]
        old = rows.column(text)
        new = pa.array([x if s else o.as_py() for x, s, o in zip(left, spans, old, strict=True)], old.type)
        return rows.set_column(at, text, new)

    return repeated(docs, make, docs.schema, key, text)


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the 50-byte strings that start in a smaller one too: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return digests(table(spark, sf_dir, "documents"))
