"""Counting quotient filters of packed word-id n-grams, without loss.

An n-gram of word ids of w bits is one number of n * w bits, in a left and a right half. A fixed permutation of such numbers (rounds of xor
between the halves, so that it can be undone) spreads them evenly. The upper bits of the permuted number are the quotient, which is
not stored but told by a unary bit vector; the lower bits are the remainder, stored in full in whole bytes. So a filter holds
exactly the n-grams that were counted and no false ones, and undoing the permutation gives the word ids back.

Entries are sorted by their permuted number, so filters merge as sorted runs and can be cut at any upper bits. Counters take
a bit where the count is one, a byte more up to 256, and eight bytes more beyond.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QBB")
_U = np.uint64
#: Round keys of the permutation.
_KEYS = np.random.default_rng(97).integers(1, 2**63, 8, dtype=np.uint64)
MOST_ID_BITS = 32


def halves(n: int, bits: int) -> tuple[int, int]:
    """Bits of the left and of the right half of an n-gram of ids of `bits` bits."""
    return (n - n // 2) * bits, n // 2 * bits


def _mask(bits: int) -> np.uint64:
    return _U((1 << bits) - 1)


def _mix(x: np.ndarray, key: np.uint64) -> np.ndarray:
    x = (x ^ key) * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


def permute(left: np.ndarray, right: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    bl, br = halves(n, bits)
    for i in range(0, len(_KEYS), 2):
        left = left ^ (_mix(right, _KEYS[i]) & _mask(bl))
        right = right ^ (_mix(left, _KEYS[i + 1]) & _mask(br))
    return left, right


def restore(left: np.ndarray, right: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    bl, br = halves(n, bits)
    for i in reversed(range(0, len(_KEYS), 2)):
        right = right ^ (_mix(left, _KEYS[i + 1]) & _mask(br))
        left = left ^ (_mix(right, _KEYS[i]) & _mask(bl))
    return left, right


def pack(ids: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Permuted numbers (upper 64 bits, lower 64 bits) of n-grams given as one array of ids for each place."""
    n = len(ids)
    cut = n - n // 2
    left, right = (_joined(part, bits) for part in (ids[:cut], ids[cut:]))
    left, right = permute(left, right, n, bits)
    br = halves(n, bits)[1]
    if br == 64:
        return left, right
    return left >> _U(64 - br), right | (left << _U(br))


def unpack(high: np.ndarray, low: np.ndarray, n: int, bits: int) -> list[np.ndarray]:
    bl, br = halves(n, bits)
    left = high if br == 64 else (low >> _U(br)) | (high << _U(64 - br))
    left, right = restore(left & _mask(bl), low & _mask(br), n, bits)
    cut = n - n // 2
    return [part >> _U(bits * (k - 1 - i)) & _mask(bits) for part, k in ((left, cut), (right, n - cut)) for i in range(k)]


def _joined(ids: list[np.ndarray], bits: int) -> np.ndarray:
    out = ids[0].astype(np.uint64)
    for x in ids[1:]:
        out = (out << _U(bits)) | x.astype(np.uint64)
    return out


def tally(high: np.ndarray, low: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct numbers in order, and the sums of their counts (one each where none are given); sorted runs merge fast."""
    if len(low) == 0:
        return high, low, np.zeros(0, np.uint64)
    order = np.lexsort((low, high)) if high.any() else np.argsort(low, kind="stable")
    high, low = high[order], low[order]
    first = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
    if counts is None:
        return high[first], low[first], np.diff(np.r_[first, len(low)]).astype(np.uint64)
    return high[first], low[first], np.add.reduceat(counts[order], first)


def _shifted(high: np.ndarray, low: np.ndarray, by: int) -> np.ndarray:
    """The number without its `by` lower bits, which must then fit 64."""
    if by == 0:
        return low
    if by >= 64:
        return high >> _U(by - 64) if by < 128 else np.zeros_like(high)
    return (low >> _U(by)) | (high << _U(64 - by))


def parts_of(high: np.ndarray, low: np.ndarray, n: int, bits: int, part_bits: int) -> np.ndarray:
    """The part of each number: its upper part_bits bits."""
    return _shifted(high, low, n * bits - part_bits)


def dump(high: np.ndarray, low: np.ndarray, counts: np.ndarray, n: int, bits: int, part_bits: int) -> bytes:
    """The filter of sorted distinct numbers that share their upper part_bits bits."""
    m, room = len(low), n * bits - part_bits
    # whole bytes for remainders, and the number of them that makes the filter smallest
    size = lambda k: ((1 << (room - 8 * k)) + m) / 8 + m * k
    k = min(range(room // 8 + 1), key=size)
    q = room - 8 * k
    quotient = (_shifted(high, low, 8 * k) & _mask(q)).astype(np.int64)
    unary = np.zeros((1 << q) + m, np.uint8)
    unary[quotient + np.arange(m)] = 1
    whole = np.stack([high, low], axis=1).astype(">u8").view(np.uint8).reshape(m, 16)
    more = counts - _U(1)
    large = more >= 255
    return b"".join([_HEAD.pack(m, k, q), np.packbits(unary).tobytes(), whole[:, 16 - k :].tobytes(), np.packbits(more > 0).tobytes(),
                     np.minimum(more[more > 0], 255).astype(np.uint8).tobytes(), more[large].astype("<u8").tobytes()])


def load(raw: bytes, part: int, n: int, bits: int, part_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers and counts of a filter of one part."""
    m, k, q = _HEAD.unpack_from(raw)
    flat, at = np.frombuffer(raw, np.uint8), _HEAD.size

    def take(size: int) -> np.ndarray:
        nonlocal at
        at += size
        return flat[at - size : at]

    unary = np.unpackbits(take(-(-((1 << q) + m) // 8)), count=(1 << q) + m)
    quotient = (np.flatnonzero(unary) - np.arange(m)).astype(np.uint64) | _U(part << q)
    whole = np.zeros((m, 16), np.uint8)
    whole[:, 16 - k :] = take(m * k).reshape(m, k)
    high, low = (x.astype(np.uint64) for x in whole.view(">u8").reshape(m, 2).T)
    shift = 8 * k
    if shift >= 64:
        high = high | (quotient << _U(shift - 64)) if shift < 128 else high
    else:
        low = low | (quotient << _U(shift))
        if shift:
            high = high | (quotient >> _U(64 - shift))
    more = np.unpackbits(take(-(-m // 8)), count=m).astype(np.uint64)
    some = np.flatnonzero(more)
    more[some] = take(len(some))
    large = np.flatnonzero(more == 255)
    more[large] = take(8 * len(large)).view("<u8") if len(large) else 0
    return high, low, more + _U(1)
