"""DartMinHash: signatures of weighted sets by thrown darts (T. Christiani, 2020), over NumPy arrays of many sets at once.

Every element owns a plane of weight x rank, in which darts lie at a density of one for each unit of area. Which darts lie
in a cell of the plane follows from a hash of element and cell alone, so equal elements of different sets share darts. A set
of weights w takes the darts of each element below weight w. Each dart is bound for one of K coordinates, and the dart of
least rank in a coordinate is the signature there: two sets agree in a coordinate with the probability of their weighted
Jaccard similarity. Ranks are searched from 0 up to where some K (ln K + 2) darts are expected, whatever the number of
elements, and further, level by level, for sets that still have an empty coordinate.

Cells: weights [2^v - 1, 2^(v+1) - 1) for v = 0, 1, ...; ranks [0, 2^BASE), then levels that end at 2^(BASE + l / 2), l = 1, 2, ...
"""

from __future__ import annotations

import math

import numpy as np

BASE = -8
_U = np.uint64
_GOLD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from the high bits."""
    return (x >> _U(11)).astype(np.float64) * 2.0**-53


def poisson(u: np.ndarray, mean: float) -> np.ndarray:
    """Counts of mean `mean` (1 at most) by inversion of the distribution."""
    p, total, bounds = math.exp(-mean), 0.0, []
    for i in range(1, 32):
        total += p
        bounds.append(total)
        p *= mean / i
        if total >= 1 - 2.0**-53:
            break
    return np.searchsorted(np.array(bounds), u, side="right")


class Darts:
    def __init__(self, k: int, seed: int = 1):
        self.k, self.seed = k, seed
        self.expected = k * (math.log(k) + 2)

    def _throw(self, ids: np.ndarray, weights: np.ndarray, sets: np.ndarray, low: float, length: float, tag: int, best: np.ndarray, win: np.ndarray) -> None:
        """The darts of elements with ranks in [low, low + length); best and win (rank and dart by set and coordinate) are updated."""
        v = 0
        while len(ids):
            width = float(1 << v)
            area = width * length
            parts = max(1, math.ceil(area))  # cells of an area of 1 at most, cut along the ranks
            cell = mix(ids ^ mix(np.array([(self.seed * _GOLD + tag * 0x100000001B3 + v) % (1 << 64)], dtype=_U)))
            if parts > 1:
                cell = mix((cell[:, None] + np.arange(1, parts + 1, dtype=_U)[None, :] * _U(_GOLD)).ravel())
            n = poisson(unit(cell), area / parts)
            hit = np.flatnonzero(n)
            times = n[hit]
            which = np.repeat(hit, times)
            turn = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
            dart = mix(cell[which] + (turn.astype(_U) + _U(1)) * _U(0xD6E8FEB86659FD93))
            owner, part = (which // parts, which % parts) if parts > 1 else (which, 0)
            second = mix(dart ^ _U(0xA5A5A5A5A5A5A5A5))
            rank = low + (part + unit(second)) * (length / parts)
            if v or not np.all(weights >= 1):
                inside = (width - 1) + unit(mix(second)) * width < weights[owner]
                dart, rank, owner = dart[inside], rank[inside], owner[inside]
            slot = sets[owner] * self.k + ((dart >> _U(32)) % _U(self.k)).astype(np.int64)
            np.minimum.at(best, slot, rank)
            won = rank == best[slot]
            win[slot[won]] = dart[won]
            v += 1
            more = weights > 2.0**v - 1
            ids, weights, sets = ids[more], weights[more], sets[more]

    def signatures(self, ids: np.ndarray, weights: np.ndarray, sets: np.ndarray, n: int) -> np.ndarray:
        """An n x K array of darts; ids (uint64), weights (over 0) and sets (0 to n - 1) tell the elements. Empty sets get zeros."""
        total = np.bincount(sets, weights, n)
        best, win = np.full(n * self.k, np.inf), np.zeros(n * self.k, dtype=_U)
        bound = lambda level: 2.0 ** (BASE + level / 2)
        top = np.zeros(n, dtype=np.int64)
        has = total > 0
        top[has] = np.maximum(0, np.ceil(2 * (np.log2(self.expected / total[has]) - BASE))).astype(np.int64)
        self._throw(ids, weights, sets, 0.0, bound(0), 0, best, win)

        def throw(level: int, which: np.ndarray) -> None:
            mine = which[sets]
            self._throw(ids[mine], weights[mine], sets[mine], bound(level - 1), bound(level) - bound(level - 1), level, best, win)

        for level in range(1, int(top.max(initial=0)) + 1):
            throw(level, has & (top >= level))
        while (short := has & np.isinf(best.reshape(n, self.k)).any(axis=1)).any():
            for level in np.unique(top[short]):
                throw(int(level) + 1, short & (top == level))
            top[short] += 1
        return win.reshape(n, self.k)


def bands(signatures: np.ndarray, rows: int) -> np.ndarray:
    """A number for each band of `rows` coordinates; the band's place is part of it."""
    n, k = signatures.shape
    parts = signatures.reshape(n, k // rows, rows)
    out = np.zeros((n, k // rows), dtype=_U) + np.arange(1, k // rows + 1, dtype=_U) * _U(_GOLD)
    for i in range(rows):
        out = mix(out * _U(0x9FB21C651E98DF25) + parts[:, :, i])
    return out


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_P = 0x5851F42D4C957F2D
_CLASS = np.zeros(256, dtype=np.uint8)
for _b in range(256):
    _c = chr(_b).lower().encode()[0] if _b < 128 else _b
    _CLASS[_b] = _c if _b >= 128 or chr(_c).isalnum() else 0


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        up, down = np.full(size, _P, dtype=_U), np.full(size, pow(_P, -1, 1 << 64), dtype=_U)
        up[0] = down[0] = 1
        _POWERS[size] = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
    return _POWERS[size]


def shingles(texts: list[bytes], size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts' runs of `size` words: hashes, counts, texts, ordered by text and hash. A text of fewer words is one run.

    Words are runs of ASCII letters and digits in lower case and of all other characters from U+0080."""
    empty = np.empty(0, _U), np.empty(0), np.empty(0, np.int64)
    joined = b" ".join(texts) + b" "
    low = _CLASS[np.frombuffer(joined, np.uint8)]
    inside = low > 0
    edge = np.diff(inside.astype(np.int8), prepend=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return empty
    ends = np.cumsum([len(t) + 1 for t in texts])
    of = np.searchsorted(ends, start, side="right")
    up, down = _powers(len(low))
    terms = np.concatenate([[_U(0)], np.cumsum(low.astype(_U) * up[: len(low)], dtype=_U)])
    words = mix((terms[stop] - terms[start]) * down[start] + (stop - start).astype(_U))
    count = np.bincount(of, minlength=len(texts))
    first = np.cumsum(count) - count
    place = np.arange(len(words)) - first[of]
    left = count[of] - place  # words from here to the text's end
    begins = np.flatnonzero((left >= size) | (place == 0))
    h = np.zeros(len(begins), dtype=_U)
    for i in range(size):
        ok = left[begins] > i
        h = np.where(ok, mix(h * _U(0x9FB21C651E98DF25) + words[np.minimum(begins + i, len(words) - 1)] + _U(i + 1)), h)
    of = of[begins]
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])]))
    return h[new], np.diff(np.append(new, len(h))).astype(np.float64), of[new]


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets given as sorted hashes and counts; 0 where both are empty."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), dtype=bool)
    common = np.minimum(a[1][same], b[1][at[same]]).sum()
    total = a[1].sum() + b[1].sum() - common
    return float(common / total) if total else 0.0
