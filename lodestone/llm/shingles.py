"""Sets of five-word shingles as sorted 64-bit hashes, in numpy.

Words are runs of bytes other than ASCII white space, A-Z lowered.  A set
holds each run of ``WORDS`` words once; a text of fewer words has its whole
sequence as its only shingle, a text without words the empty set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

WORDS = 5
#: Texts are hashed together up to so many bytes; a longer one alone.
GROUP_BYTES = 1 << 20
#: Bytes of a word from which it has a cryptographic hash.
LONG_WORD = 32
_BASE = 0x9E3779B97F4A7C15 | 1
_U64 = np.uint64
_MIX = (_U64(0xBF58476D1CE4E5B9), _U64(0x94D049BB133111EB))
_PLACES = np.array([0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x589965CC75374CC3], dtype=_U64)
_powers: list[np.ndarray] = [np.ones(1, _U64), np.ones(1, _U64)]


def _tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    if len(_powers[0]) < size:
        size = 1 << size.bit_length()
        for number, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.ones(1, _U64)
            while len(table) < size:
                table = np.concatenate([table, table * _U64(pow(base, len(table), 1 << 64))])
            _powers[number] = table
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the result is even."""
    x = (x ^ (x >> _U64(30))) * _MIX[0]
    x = (x ^ (x >> _U64(27))) * _MIX[1]
    return x ^ (x >> _U64(31))


def _group(texts: list[bytes]) -> list[np.ndarray]:
    raw = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    lowered = raw.astype(_U64)
    lowered[(raw >= 65) & (raw <= 90)] += _U64(32)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    power, inverse = _tables(len(raw))
    lowered += _U64(1)
    lowered *= power[: len(raw)]
    total = np.cumsum(lowered, dtype=_U64)
    words = mix((total[ends - 1] - total[starts - 1]) * inverse[starts])
    # Powers modulo 2 ** 64 cannot tell apart some long words, whatever the base.
    for at in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        own = raw[starts[at] : ends[at]].tobytes().lower()
        words[at] = int.from_bytes(hashlib.blake2b(own, digest_size=8).digest(), "little")
    bounds = np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in texts)]))
    if len(words) >= WORDS:
        runs = words[: len(words) - WORDS + 1] * _PLACES[0]
        for place in range(1, WORDS):
            runs = runs + words[place : len(words) - WORDS + 1 + place] * _PLACES[place]
        runs = mix(runs)
    out = []
    for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        n = last - first
        if n >= WORDS:
            own = np.sort(runs[first : last - WORDS + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif n:
            out.append(mix((words[first:last] * _PLACES[:n]).sum(keepdims=True, dtype=_U64) + _U64(n)))
        else:
            out.append(np.zeros(0, _U64))
    return out


def shingle_sets(texts: Iterator[str | None] | list) -> Iterator[np.ndarray]:
    """Each text's set, sorted; null counts as empty."""
    group: list[bytes] = []
    held = 0
    for text in texts:
        raw = (text or "").encode()
        if group and held + len(raw) > GROUP_BYTES:
            yield from _group(group)
            group, held = [], 0
        group.append(raw)
        held += len(raw)
    if group:
        yield from _group(group)
