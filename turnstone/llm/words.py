"""Words of UTF-8 buffers as NumPy arrays: places, hashes, hashes of word runs."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
P1, P2, P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x + P1
    x = (x ^ (x >> np.uint64(30))) * P2
    x = (x ^ (x >> np.uint64(27))) * P3
    return x ^ (x >> np.uint64(31))


def spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ in buf."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], SPACE[buf], [True])).view(np.int8)))
    return edge[::2], edge[1::2]


def _powers(n: int, base: np.uint64) -> np.ndarray:
    p = np.full(max(n, 1), base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    at = np.cumsum(lens) - lens
    body = buf[~SPACE[buf]].astype(np.uint64) + np.uint64(1)
    local = np.arange(len(body)) - np.repeat(at, lens)
    return mix(np.add.reduceat(body * _powers(int(lens.max()), P1)[local], at) ^ (lens.astype(np.uint64) << np.uint64(56)))


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive entries of h (len(h) - k + 1 of them)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    have, n, out, done = h, 1, None, 0  # have: of n entries; out: of the first `done`
    while True:
        if k & n:
            if out is None:
                out, done = have, n
            else:
                m = len(h) - (done + n) + 1
                out = out[:m] * _powers(n + 1, P2)[n] + have[done : done + m]
                done += n
        if done == k:
            return mix(out)
        m = len(have) - n
        have = have[:m] * _powers(n + 1, P2)[n] + have[n : n + m]
        n *= 2


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all texts, a newline after each, and where each begins."""
    buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return buf, np.cumsum(lens) - lens
