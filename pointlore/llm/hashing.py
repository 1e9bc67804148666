"""Whole-array hashing of words and word windows."""

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(0x9E3779B97F4A7C15) | 1
INVERSE = pow(BASE, -1, 1 << 64)
PIECE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_up, _down = _powers(BASE, 2 * PIECE), _powers(INVERSE, 2 * PIECE)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word (stretch without ASCII white space) of lower-cased ``data``. Long data goes piece by piece."""
    x = np.frombuffer(data.translate(LOWER), np.uint8)
    space = SPACE[x]
    edge = np.diff(np.concatenate(([True], space, [True])).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    out, at = np.empty(len(start), np.uint64), 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(end, start[at] + PIECE, "right")))
        a, b = int(start[at]), int(end[stop - 1])
        n = b - a
        up, down = (_up, _down) if n <= len(_up) else (_powers(BASE, n), _powers(INVERSE, n))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE[x[a:b]] * up[:n], dtype=np.uint64)))
        s, e = start[at:stop] - a, end[at:stop] - a
        out[at:stop] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        at = stop
    return out, start


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` words; of fewer words, one window of them all; none without words."""
    size = min(size, len(words))
    if not size:
        return np.empty(0, np.uint64)
    h = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        h = mix(h * np.uint64(BASE) + words[k : k + len(h)] + np.uint64(k + 1))
    return h
