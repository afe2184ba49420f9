"""Word boundaries and word hashes of a batch of texts, in numpy.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r.
"""

from __future__ import annotations

import numpy as np
import xxhash

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(texts: list[bytes], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text where its words begin (one more entry at the end).

    Another seed gives hashes in which other words collide.
    """
    raw = b" ".join(texts) + b" " * 9
    data = np.frombuffer(raw, np.uint8)
    gap = _SPACE[data]
    turn = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(turn) and not gap[0]:
        turn = np.concatenate([[0], turn])
    starts, ends = turn[0::2], turn[1::2]
    at = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    first = np.searchsorted(starts, np.concatenate([[0], at]))
    n = ends - starts
    lanes = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
    h = n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    if seed:
        h = mix(h + np.uint64(seed))
    live, at8 = np.flatnonzero(n <= _LONG), 0
    while len(live):
        left = n[live] - at8
        lane = lanes[starts[live] + at8]
        short = left < 8
        lane[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        h[live] = mix((h[live] ^ lane) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(at8 + 1))
        at8 += 8
        live = live[n[live] > at8]
    for i in np.flatnonzero(n > _LONG):
        h[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]], 7 + seed)
    return h, first


def rolling(h: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of the `size` words from each position on (positions too near the end are left out)."""
    out, have, power, lift, ring = None, 0, base | 1, 1, (1 << 64) - 1
    block, span = h, 1  # block[i]: hash of `span` words from i; power: base ** span
    rest = size
    while rest:
        if rest & 1:
            if out is None:
                out = block
            else:
                m = min(len(out), len(block) - have)
                out = out[: max(m, 0)] + np.uint64(lift) * block[have : have + max(m, 0)]
            have += span
            lift = lift * power & ring
        rest >>= 1
        if rest:
            block = block[:-span] + np.uint64(power) * block[span:] if len(block) > span else block[:0]
            power, span = power * power & ring, 2 * span
    return mix(out[: max(len(h) - size + 1, 0)])
