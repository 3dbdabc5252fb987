"""SetSketch of word shingles, vectorised over batches of texts.

A register holds the truncated logarithm, to a base ``BASE`` near 1, of the smallest of the exponentially distributed
values that its own hash gives the elements of the set. Registers of a union are the maxima of the registers, and two
registers are equal with a probability that grows with the Jaccard similarity, so bands of registers are keys for
candidate search.
"""

from __future__ import annotations

import numpy as np

BASE, RATE, TOP = 1.001, 20.0, 65535
_LOG_BASE = float(np.log(BASE))
_U = np.uint64
_ODD = (np.random.default_rng(20240).integers(1, 2**63, 4096, dtype=np.uint64) << _U(1)) | _U(1)
_STEP, _BACK = int(_ODD[0]), pow(int(_ODD[0]), -1, 2**64)
#: Characters hashed at once; bounds memory whatever the batch.
SLICE = 1_000_000

_alnum = np.array([chr(c).isalnum() for c in range(0x3000)])
_powers = _inverse = None


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if _powers is None or len(_powers) < n:
        size = max(n, SLICE + 65536)
        up, down = np.full(size, _STEP, np.uint64), np.full(size, _BACK, np.uint64)
        up[0] = down[0] = 1
        _powers, _inverse = np.cumprod(up), np.cumprod(down)
    return _powers, _inverse


def _is_alnum(codes: np.ndarray) -> np.ndarray:
    out = _alnum[np.minimum(codes, len(_alnum) - 1)]
    if len(high := np.flatnonzero(codes >= len(_alnum))):
        kinds, back = np.unique(codes[high], return_inverse=True)
        out[high] = np.array([chr(c).isalnum() for c in kinds.tolist()])[back]
    return out


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the lower-cased texts in order, and the number of words of each text."""
    lowered = [t.lower() for t in texts]
    joined = "\n".join(lowered) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(codes) + 1, np.int8)
    inside[1:] = _is_alnum(codes)
    edge = np.diff(inside, append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power_tables(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + _U(0x9E37)) * up[: len(codes)], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in lowered])
    return hashes, np.diff(np.searchsorted(start, ends), prepend=0)


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words that stay within a text, and the number of them in each text."""
    n = np.maximum(counts - width + 1, 0)
    first = np.repeat(np.cumsum(counts) - counts - (np.cumsum(n) - n), n) + np.arange(n.sum())
    out = np.zeros(len(first), np.uint64)
    for k in range(width):
        out = mix(out * _ODD[1] + hashes[first + k])
    return out, n


def distinct(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The number of different elements of each text."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((elements, owner))
    e, o = elements[order], owner[order]
    fresh = np.ones(len(e), bool)
    fresh[1:] = (e[1:] != e[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[fresh], minlength=len(counts))


def sequence_keys(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 64-bit key for each text that has words: equal for texts of the same words in the same order."""
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
    v = mix(hashes + (place.astype(np.uint64) + _U(1)) * _ODD[2])
    have = counts > 0
    out = np.zeros(len(counts), np.uint64)
    if have.any():
        out[have] = np.add.reduceat(v, (np.cumsum(counts) - counts)[have])
    return mix(out)


def registers(elements: np.ndarray, counts: np.ndarray, m: int) -> np.ndarray:
    """SetSketch registers, uint16 of shape (texts, m); every text must have elements."""
    at = np.cumsum(counts) - counts
    lows = np.empty((m, len(counts)), np.uint64)
    for k in range(m):
        v = (elements ^ _ODD[8 + 2 * k]) * _ODD[9 + 2 * k]
        v ^= v >> _U(32)
        v *= _ODD[4]
        lows[k] = np.minimum.reduceat(v, at)
    u = (lows.astype(np.float64) + 1.0) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1.0 - np.log(x) / _LOG_BASE), 0, TOP).astype(np.uint16).T.copy()


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of the sets."""
    return np.maximum(a, b)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / _LOG_BASE


def joint_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, steps: int = 101) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of each pair of register rows, given the sizes of the sets.

    The registers are compared one by one; the counts of greater, smaller and equal ones are multinomial with
    probabilities that depend on the similarity and the sizes only.
    """
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    top = np.minimum(u / v, v / u)
    best, at = np.full(len(a), -np.inf), np.zeros(len(a))
    for s in np.linspace(0, 1, steps):
        j = top * s
        pu, pv = np.maximum(_p(u - v * j), 1e-12), np.maximum(_p(v - u * j), 1e-12)
        like = more * np.log(pu) + less * np.log(pv) + same * np.log(np.maximum(1 - pu - pv, 1e-12))
        better = like > best
        best[better], at[better] = like[better], j[better]
    return at


def slices(lengths: list[int]) -> list[tuple[int, int]]:
    """Ranges of a batch with about ``SLICE`` characters each."""
    out, start, total = [], 0, 0
    for k, n in enumerate(lengths):
        if total and total + n > SLICE:
            out.append((start, k))
            start, total = k, 0
        total += n
    if start < len(lengths):
        out.append((start, len(lengths)))
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Exact similarity of two arrays of distinct elements."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 0.0
