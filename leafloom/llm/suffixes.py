"""Sorting suffixes in parts: anchors, front-coded runs, and merging by loser trees that never compare a known prefix again.

To find strings of LENGTH bytes that occur in several texts, not every suffix must be sorted. In each window of LENGTH bytes
the anchor is the place of the least hash among its strings of K bytes (the leftmost, where several are least). Equal windows
have equal anchors at equal distances, so a window that two texts share shows as an anchor in both, and every window holds
its anchor. Around its anchor a window reaches at most REACH = LENGTH - K bytes to the left and LENGTH bytes to the right.

A suffix is therefore the string of WIDTH bytes made of: 5 bytes of the anchor's hash (which deals suffixes evenly to parts),
the LENGTH bytes from the anchor on, and the REACH bytes before it, read backwards. Beyond a text's ends stands PAD, which no
UTF-8 text contains.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

LENGTH, K = 50, 20
REACH = LENGTH - K
HASH = 5
WIDTH = HASH + LENGTH + REACH
PAD = 0xFF
_U = np.uint64
_PLACE = 24
#: Bytes of texts whose anchors are sought at once.
TOGETHER = 1 << 18
_P = 0x5851F42D4C957F2D


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def string_hashes(a: np.ndarray) -> np.ndarray:
    """40-bit hashes of all strings of K bytes in `a`."""
    x = a.astype(_U) + _U(1)
    done, h = 1, x
    # the hash of 2n bytes from those of n bytes, then the rest
    power = _P
    parts = {1: (h, power)}
    while done * 2 <= K:
        h = h[: len(h) - done] * _U(power) + h[done:]
        done, power = done * 2, power * power % (1 << 64)
        parts[done] = (h, power)
    at = done
    for n in sorted(parts, reverse=True):
        while at + n <= K:
            part, p = parts[n]
            m = len(a) - at - n + 1
            h = h[:m] * _U(p) + part[at : at + m]
            at += n
    return _mix(h[: len(a) - K + 1]) >> _U(24)


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text's windows the anchors: text, place in the text, hash; ordered by text and place."""
    found = []
    first, size, group = 0, 0, []
    for i, t in enumerate([*texts, None]):
        if t is None or (group and size + len(t) > TOGETHER):
            if group:
                found.append(_anchors(group, first))
            first, size, group = i, 0, []
        if t is not None:
            group.append(t)
            size += len(t)
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, _U)
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def _anchors(texts: list[bytes], first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    if len(a) >= 1 << _PLACE and len(texts) == 1:  # a text that fills the places is cut into overlapping pieces
        step = (1 << _PLACE) - LENGTH
        parts = [_anchors([texts[0][i : i + step + LENGTH - 1]], first) for i in range(0, len(a) - LENGTH + 1, step)]
        place = np.concatenate([p[1] + i * step for i, p in enumerate(parts)])
        place, keep = np.unique(place, return_index=True)
        return np.full(len(place), first), place, np.concatenate([p[2] for p in parts])[keep]
    if len(a) < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, _U)
    h = string_hashes(a)
    m = (h << _U(_PLACE)) | np.arange(len(h), dtype=_U)
    span, want = 1, REACH + 1
    while span * 2 <= want:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < want:
        m = np.minimum(m[: len(m) - (want - span)], m[want - span :])
    inside = np.ones(len(m), dtype=bool)  # windows that do not cross a text's end
    for e in ends[:-1]:
        inside[max(0, e - LENGTH + 1) : e] = False
    mark = np.zeros(len(a), dtype=bool)
    mark[(m[inside] & _U((1 << _PLACE) - 1)).astype(np.int64)] = True
    at = np.flatnonzero(mark)
    of = np.searchsorted(ends, at, side="right")
    # anchors have the least hashes of their windows; hashed once more, they are even
    return of + first, at - (ends - sizes)[of], _mix(h[at]) >> _U(24)


def suffixes(text: bytes, places: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A row of WIDTH bytes for each anchor of `text`."""
    padded = np.full(len(text) + REACH + LENGTH, PAD, dtype=np.uint8)
    padded[REACH : REACH + len(text)] = np.frombuffer(text, np.uint8)
    at = places[:, None] + REACH
    head = (hashes[:, None] >> _U(8) * np.arange(HASH - 1, -1, -1, dtype=_U)[None, :]).astype(np.uint8)
    return np.concatenate([head, padded[at + np.arange(LENGTH)[None, :]], padded[at - np.arange(1, REACH + 1)[None, :]]], axis=1)


@dataclass
class Run:
    """Sorted suffixes and what belongs to each: document, row key, place, and the distances `low` to `high` from a window's
    start to the anchor for which the window lies inside the text."""

    rows: np.ndarray
    doc: np.ndarray
    key: np.ndarray
    place: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def take(self, i: np.ndarray) -> Run:
        return Run(self.rows[i], self.doc[i], self.key[i], self.place[i], self.low[i], self.high[i])


def sort(run: Run) -> Run:
    """By suffix, then document."""
    by_doc = np.argsort(run.doc, kind="stable")
    text = np.ascontiguousarray(run.rows[by_doc]).view(f"S{WIDTH}").ravel()
    return run.take(by_doc[np.argsort(text, kind="stable")])


def common(rows: np.ndarray) -> np.ndarray:
    """The length of the common prefix of each row and the row before; 0 for the first."""
    out = np.zeros(len(rows), dtype=np.uint8)
    if len(rows) > 1:
        same = rows[1:] == rows[:-1]
        out[1:] = np.where(same.all(axis=1), WIDTH, same.argmin(axis=1))
    return out


def front_code(run: Run) -> bytes:
    """A sorted run: of each suffix the length of the prefix it shares with the one before, and the rest."""
    shared = common(run.rows)
    tails = run.rows[np.arange(WIDTH)[None, :] >= shared[:, None]]
    body = b"".join(x.tobytes() for x in (shared, tails, run.doc.astype("<i8"), run.key.astype("<i8"), run.place.astype("<i4"), run.low.astype("u1"), run.high.astype("u1")))
    return struct.pack("<II", len(run.doc), len(tails)) + zlib.compress(body, 3)


def unpack(data: bytes) -> tuple[np.ndarray, bytes, tuple[np.ndarray, ...]]:
    """Of a front-coded run the shared lengths, the tails, and document, key, place, low, high."""
    n, t = struct.unpack_from("<II", data)
    body = zlib.decompress(memoryview(data)[8:])
    shared, at, out = np.frombuffer(body, np.uint8, n), n + t, []
    for kind in ("<i8", "<i8", "<i4", "u1", "u1"):
        out.append(np.frombuffer(body, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return shared, body[n : n + t], tuple(out)


def decoded(shared: np.ndarray, tails: bytes):
    """(common prefix with the suffix before, suffix), one after the other."""
    before, at = b"", 0
    for n in shared.tolist():
        end = at + WIDTH - n
        before = before[:n] + tails[at:end]
        at = end
        yield n, before


def prefix(a: bytes, b: bytes, known: int) -> int:
    """The length of the common prefix of two suffixes that share `known` bytes for sure."""
    if a == b:
        return WIDTH
    while a[known : known + 8] == b[known : known + 8]:
        known += 8
    while a[known] == b[known]:
        known += 1
    return known


def merge(runs: list) -> tuple[list[int], list[int], list[bytes]]:
    """Merges iterators of (common prefix with the one before, suffix): of each suffix in order its run, the length of the
    prefix it shares with the one before, and itself.

    Each node of the loser tree holds the run that lost there and the length of the prefix that its suffix shares with the
    winner's. A suffix that comes up has the prefix it shares with the last winner from the front coding. Where the two
    lengths differ, the longer one wins unread; where they are equal, bytes are compared from there on. Equal suffixes keep the
    order of runs."""
    size = 1
    while size < len(runs):
        size *= 2
    heads: list = [next(r, None) for r in runs] + [None] * (size - len(runs))
    text: list = [h and h[1] for h in heads]
    known = [0 if h else -1 for h in heads]  # with the last suffix that came out; -1: the run has ended
    losers = [0] * size

    def play(x: int, y: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes that with the winner."""
        p, q = known[x], known[y]
        if p > q:
            return x, y
        if q > p:
            return y, x
        if p < 0:
            return x, y
        n = prefix(text[x], text[y], p)
        won = x if (x < y if n == WIDTH else text[x][n] < text[y][n]) else y
        lost = y if won == x else x
        known[lost] = n
        return won, lost

    winners = [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1]
    runs_out, shared_out, texts_out = [], [], []
    while known[top] >= 0:
        runs_out.append(top)
        shared_out.append(known[top])
        texts_out.append(text[top])
        head = next(runs[top], None)
        known[top], text[top] = head if head else (-1, None)
        node = (top + size) >> 1
        while node:
            rival = losers[node]
            p, q = known[top], known[rival]
            if p < q:
                losers[node], top = top, rival
            elif p == q and p >= 0:
                n = prefix(text[top], text[rival], p)
                if rival < top if n == WIDTH else text[rival][n] < text[top][n]:
                    losers[node], top = top, rival
                known[losers[node]] = n
            node >>= 1
    return runs_out, shared_out, texts_out


def covered(rows: np.ndarray, shared: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted suffixes the least and the greatest distance from a window's start to the anchor at which the window also
    stands in a smaller document; greatest -1 where there is none.

    At distance d, windows are equal where the suffixes share LENGTH - d bytes from the anchor on, which neighbours' common
    prefixes tell, and the d bytes before it."""
    n = len(doc)
    least, greatest = np.full(n, 255, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    before = np.zeros(n, dtype=np.int64)  # a number for the d bytes before the anchor
    for d in range(REACH + 1):
        if d:
            before = np.unique(before * 256 + rows[:, HASH + LENGTH + d - 1], return_inverse=True)[1]
        ok = np.flatnonzero((low <= d) & (d <= high))
        if len(ok) < 2:
            continue
        after = np.cumsum(shared < HASH + LENGTH - d)
        same = after[ok] * n + before[ok]
        order = np.argsort(same, kind="stable")
        starts = np.flatnonzero(np.diff(same[order], prepend=-1))
        smallest = np.minimum.reduceat(doc[ok][order], starts)
        mine = ok[order]
        gone = mine[doc[mine] > np.repeat(smallest, np.diff(np.append(starts, len(mine))))]
        least[gone] = np.minimum(least[gone], d)
        greatest[gone] = d
    return least, greatest
