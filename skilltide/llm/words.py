"""Words of many texts at once: spans and 64-bit hashes over one byte buffer, in numpy.

Two kinds of hash. rolling_hash() is a polynomial modulo 2**64 by prefix sums, cheap for a span
at every byte, but fixed strings are known that collide under any such polynomial. It may choose
places, never decide that two strings are equal. span_hash() mixes a span eight bytes at a time;
spans of eight bytes or less and of one length cannot collide, and others do by chance only. Where
a chance of 2**-64 for two strings does not do, same_bytes() compares them.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _class(ranges: list[tuple[int, int]]) -> np.ndarray:
    """True for bytes outside the ranges."""
    held = np.ones(256, bool)
    for a, b in ranges:
        held[a : b + 1] = False
    return held


#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] and [^\x20\x09-\x0D]
ALNUM = _class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
VISIBLE = _class([(0x20, 0x20), (0x09, 0x0D)])


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for at, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[at] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which rolling_hash makes the hash of any span."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data))[0], dtype=np.uint64, out=out[1:])
    return out


def rolling_hash(held: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    inverse = powers(len(held))[1]
    return mix((held[ends] - held[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


#: Spans longer than this are hashed one by one.
LONG = 512
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; behind the end there are zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each span of data (uint8)."""
    size = ends - starts
    loads = _loads(data)
    out = mix(size.astype(np.uint64) * np.uint64(_BASE) + np.uint64(1))
    many = size <= LONG
    active = np.flatnonzero(many & (size > 0)) if not many.all() or not size.all() else None
    at, left = (starts, size) if active is None else (starts[active], size[active])
    while len(at):
        h = mix((out if active is None else out[active]) ^ (loads[at] & _MASK[np.minimum(left, 8)])) * np.uint64(_BASE)
        if active is None:
            out = h
        else:
            out[active] = h
        more = np.flatnonzero(left > 8)
        active = more if active is None else active[more]
        at, left = at[more] + 8, left[more] - 8
    for i in np.flatnonzero(~many).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return mix(out)


def same_bytes(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, size: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Of pairs of spans of equal size in a and b (uint8): whether their bytes are equal."""
    out = np.ones(len(size), bool)
    x, y = _loads(a), _loads(b)
    active = np.arange(len(size))
    p, q, left = a_starts.astype(np.int64), b_starts.astype(np.int64), size.astype(np.int64)
    for _ in range(8):  # most spans are short
        active, p, q, left = (v[left > 0] for v in (active, p, q, left))
        if not len(active):
            return out
        out[active[((x[p] ^ y[q]) & _MASK[np.minimum(left, 8)]) != 0]] = False
        p, q, left = p + 8, q + 8, left - 8
    for i, s, t, n in zip(active.tolist(), p.tolist(), q.tolist(), left.tolist(), strict=True):
        for at in range(0, n, step):
            end = min(n, at + step)
            out[i] = out[i] and bool(np.array_equal(a[s + at : s + end], b[t + at : t + end]))
    return out


@dataclass
class Words:
    #: Of each word: its hash and the number of its text; of each text, the place of its first word, and the end.
    hashes: np.ndarray
    owner: np.ndarray
    first: np.ndarray
    #: The lower-case bytes of all texts with spaces between, and where words start and end in them.
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def words(blobs: list[bytes], inside: np.ndarray) -> Words:
    """inside: by byte, whether it belongs to words. A-Z count as lower case; the space must not belong to words."""
    data = np.frombuffer(b" ".join([b"", *blobs, b""]).translate(LOWER), np.uint8)
    edges = np.flatnonzero(np.diff(inside[data].view(np.int8))) + 1
    starts, ends = edges[::2], edges[1::2]
    begins = np.cumsum([1] + [len(b) + 1 for b in blobs])
    first = np.searchsorted(starts, begins)
    return Words(span_hash(data, starts, ends), np.repeat(np.arange(len(blobs)), np.diff(first)), first, data, starts, ends)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size words, as if the words were of one text."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = out * np.uint64(_BASE) + hashes[i : i + n]
    return mix(out)
