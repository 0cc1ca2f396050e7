"""Word shingles as 64-bit codes, computed with numpy per document.

A text is lower-cased (A-Z only) and split at space and \\t..\\r on its UTF-8
bytes, so words are joined by single spaces. A running sum of per-byte codes
times powers of an odd base gives every span's code from two places of the sum;
a final mix spreads the bits.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
_BYTE = np.random.default_rng(20_240_501).integers(0, 2 ** 63, 256).astype(np.uint64) * 2 + 1
_BASE = 0x9E3779B97F4A7C15
_LOWER = bytes((b | 0x20) if 0x41 <= b <= 0x5A else b for b in range(256))

_POWERS = {_BASE: np.ones(1, np.uint64), pow(_BASE, -1, 2 ** 64): np.ones(1, np.uint64)}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS[base]) < n:
        steps = np.full(max(n, 2 * len(_POWERS[base])), base, np.uint64)
        steps[0] = 1
        _POWERS[base] = np.multiply.accumulate(steps)
    return _POWERS[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit codes that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct codes of the text's ``words``-word shingles; of the whole
    sequence when it has fewer words; empty without words."""
    s = b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split())
    if not s:
        return np.empty(0, np.uint64)
    b = np.frombuffer(s, np.uint8)
    upto = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * _powers(_BASE, len(b)), out=upto[1:])
    gaps = np.flatnonzero(b == 0x20)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(b)]])
    if len(starts) >= words:
        starts, ends = starts[:len(starts) - words + 1], ends[words - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    undo = _powers(pow(_BASE, -1, 2 ** 64), len(b) + 1)
    return np.unique(mix((upto[ends] - upto[starts]) * undo[starts]
                         + (ends - starts).astype(np.uint64)))


def set_id(codes: np.ndarray) -> int:
    """A 63-bit id of a set of codes."""
    with np.errstate(over="ignore"):
        x = mix(codes ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64)
        y = mix(codes + np.uint64(len(codes))).sum(dtype=np.uint64)
        return int(mix(np.array([x ^ (y << np.uint64(1))], np.uint64))[0] >> np.uint64(1))
