"""Words and word shingles of many texts at once, as 64-bit hashes in numpy.

Words are runs of bytes other than the ASCII white space, after A-Z are lower-cased.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_MIX_A, _MIX_B = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_BYTES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, np.uint64) * _U(2) + _U(1)
_PLACES = np.random.default_rng(7).integers(1, 1 << 63, 64, np.uint64) * _U(2) + _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARKS = _SPACE.copy()
_MARKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_CHUNK = 1 << 20
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _MIX_A
    h = (h ^ (h >> _U(27))) * _MIX_B
    return h ^ (h >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_CHUNK + 1, n)
    if size not in _POWERS:
        pair = []
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(size, base)
            steps[0] = 1
            pair.append(np.multiply.accumulate(steps))
        if size > _CHUNK + 1:
            return tuple(pair)
        _POWERS[size] = tuple(pair)
    return _POWERS[size]


def segment_sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash, yet to be mixed, of each of some ascending segments of bytes."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _CHUNK, "right")))
        low, high = int(starts[i]), int(ends[j - 1])
        power, inverse = _powers(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTES[data[low:high]] * power[:high - low], out=sums[1:])
        at = starts[i:j] - low
        out[i:j] = (sums[ends[i:j] - low] - sums[at]) * inverse[at]
        i = j
    return out


def words(texts: list[bytes], marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of words up to the end of each text.

    With ``marks``, ASCII punctuation ends a word as white space does.
    """
    data = _LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    ends_of_text = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    space = (_MARKS if marks else _SPACE)[data]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1, append=1))
    starts, ends = edge[0::2], edge[1::2]
    return mixed(segment_sums(data, starts, ends)), np.searchsorted(starts, ends_of_text)


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of each text; a shorter text is one shingle."""
    hashes, stops = words(texts)
    count = max(0, len(hashes) - size + 1)
    whole = np.zeros(count, np.uint64)
    for k in range(size):
        whole += hashes[k:k + count] * _PLACES[k]
    whole = mixed(whole)
    out, start = [], 0
    for stop in stops.tolist():
        n = stop - start
        if n >= size:
            out.append(np.unique(whole[start:stop - size + 1]))
        elif n:
            short = (hashes[start:stop] * _PLACES[:n]).sum(dtype=np.uint64, keepdims=True)
            out.append(mixed(short + _U(n) * _PLACES[63]))
        else:
            out.append(np.zeros(0, np.uint64))
        start = stop
    return out


def signature(shingles: np.ndarray) -> int:
    """A hash of the set, as a signed 64-bit integer."""
    h = mixed(shingles ^ _PLACES[62]).sum(dtype=np.uint64, keepdims=True)
    size = np.array([len(shingles)], np.uint64) * _PLACES[61]
    return int(mixed(h + size).view(np.int64)[0])
