"""Three-wise binary fuse filters over 64-bit keys (Graf and Lemire, 2022), built and probed with numpy.

One filter belongs to one bucket of one snapshot; it never changes once built. Construction peels keys round by round:
all slots that hold a single key are removed together, and fingerprints are assigned in the opposite order.
"""

from __future__ import annotations

import math
import struct

import numpy as np

_HEAD = struct.Struct("<QIII")
_ROUNDS = 100


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64) + np.uint64(seed)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def _slots(h: np.ndarray, segment: int, count: int) -> list[np.ndarray]:
    """Three slots in adjacent segments: the first by the high half, the others by low bits of the hash."""
    first = ((h >> np.uint64(32)) * np.uint64(segment * count)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (h & mask)
    return [x.astype(np.int64) for x in (first, second, third)]


def _prints(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(32))).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """A filter for distinct uint64 keys: no false negatives, about 1 in 256 false positives."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    segment = min(1 << 18, 1 << int(math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    count = max(1, math.ceil(n * factor / segment) - 2)
    for attempt in range(_ROUNDS):
        if attempt and attempt % 10 == 0:
            count += 1 + count // 10
        seed = (attempt + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
        h = _mix(keys, seed)
        slots = _slots(h, segment, count)
        if (peeled := _peel(slots, n, (count + 2) * segment)) is not None:
            break
    else:
        raise ValueError(f"no binary fuse filter for {n} keys after {_ROUNDS} seeds")
    cells = np.zeros((count + 2) * segment, dtype=np.uint8)
    prints = _prints(h)
    for which, at in reversed(peeled):
        value = prints[which]
        for s in slots:
            value = value ^ np.where(s[which] == at, np.uint8(0), cells[s[which]])
        cells[at] = value
    return _HEAD.pack(seed, segment, count, n) + cells.tobytes()


def _peel(slots: list[np.ndarray], n: int, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, their own slots), or None if some keys can't be peeled."""
    held, index = np.zeros(size, np.int64), np.zeros(size, np.int64)
    number = np.arange(n, dtype=np.int64)
    for s in slots:
        np.add.at(held, s, 1)
        np.add.at(index, s, number)
    rounds, left = [], n
    while left:
        single = np.flatnonzero(held == 1)
        if not len(single):
            return None
        which, first = np.unique(index[single], return_index=True)
        rounds.append((which, single[first]))
        for s in slots:
            np.subtract.at(held, s[which], 1)
            np.subtract.at(index, s[which], which)
        left -= len(which)
    return rounds


def probe(filter_bytes: bytes, keys: np.ndarray) -> np.ndarray:
    """Whether each uint64 key may be in the filter."""
    seed, segment, count, n = _HEAD.unpack_from(filter_bytes)
    if not n:
        return np.zeros(len(keys), dtype=bool)
    cells = np.frombuffer(filter_bytes, dtype=np.uint8, offset=_HEAD.size)
    h = _mix(keys, seed)
    a, b, c = _slots(h, segment, count)
    return (_prints(h) ^ cells[a] ^ cells[b] ^ cells[c]) == 0
