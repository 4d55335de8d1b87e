"""Media columns: lossless FLAC streams of 8-bit mono samples, coded and decoded for many frames at once.

A stream has STREAMINFO (with the MD5 of its samples), a SEEKTABLE with a point for every frame (for fewer beyond MOST_POINTS frames), and frames of
BLOCK samples. The coder picks, for each frame, constant, verbatim, fixed (order 0 to 2) or linear-predictive
(order 4) coding with a Rice parameter. The decoder reads these and, besides, all fixed orders to 4, any
predictor order to 32, partitioned and escaped Rice residuals; it verifies the CRC-8 of headers, the CRC-16 of frames
and the MD5 of the samples. The frames of a batch step together through their samples in numpy, up to GROUP of
them, so that memory beyond the stream itself does not follow its length.

Samples are bytes less 128. Defined results: null and empty payloads are stored as they are padded by the caller,
an empty stream has no frames; a damaged stream raises ValueError; streams that are not 8-bit mono do too.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadencia.llm import common

BLOCK = 1024
PAD = 64
#: Frames that are coded or read at a time.
GROUP = 2048
#: Fixed value: a seek table of that many points is the longest whose size has three bytes.
MOST_POINTS = 932_067
_LPC_ORDER, _LPC_BITS = 4, 10
#: The predictors of the fixed subframes by order.
_FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


@functools.cache
def _crc_table(bits: int, polynomial: int) -> np.ndarray:
    out, top = np.zeros(256, np.int64), 1 << (bits - 1)
    for v in range(256):
        c = v << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ polynomial) if c & top else c << 1
        out[v] = c & ((1 << bits) - 1)
    return out


@functools.cache
def _crc16_by_distance(n: int) -> np.ndarray:
    """[d, byte]: what a byte with d bytes after it adds to the CRC-16, which is linear."""
    step, out = _crc_table(16, 0x8005), np.zeros((n, 256), np.uint16)
    row = step.copy()
    for d in range(n):
        out[d] = row
        row = ((row << 8) & 0xFFFF) ^ step[row >> 8]
    return out


def _crc16(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    if len(start) == 0:
        return np.zeros(0, np.uint16)
    n = 1 << int(size.max() - 1).bit_length()
    first = np.cumsum(size) - size
    within = np.arange(int(size.sum())) - np.repeat(first, size)
    values = _crc16_by_distance(n)[np.repeat(size, size) - 1 - within, raw[np.repeat(start, size) + within]]
    return np.bitwise_xor.reduceat(values, first)


def _crc8(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    table, crc = _crc_table(8, 0x07), np.zeros(len(start), np.int64)
    for i in range(int(size.max()) if len(size) else 0):
        on = i < size
        crc[on] = table[crc[on] ^ raw[start[on] + i]]
    return crc


def _coded_number(n: int) -> bytes:
    """A frame number in the extended UTF-8 form of frame headers."""
    if n < 0x80:
        return bytes([n])
    more = next(m for m in range(1, 7) if n < 1 << (6 - m + 6 * m)) if n < 1 << 36 else 6
    lead = (0xFF00 >> (more + 1)) & 0xFF
    return bytes([lead | (n >> (6 * more)) & 0xFF, *(0x80 | (n >> (6 * i)) & 0x3F for i in range(more - 1, -1, -1))])


class _Bits:
    """A zeroed bit buffer that takes fields of many frames at once."""

    def __init__(self, size: int) -> None:
        self.bits = np.zeros(8 * size, np.uint8)

    def put(self, at: np.ndarray, value: np.ndarray, width: np.ndarray | int) -> None:
        width = np.broadcast_to(width, np.shape(at))
        value = np.asarray(value)
        for j in range(int(width.max()) if width.size else 0):
            on = width > j
            self.bits[(at + width - 1 - j)[on]] = ((value >> j) & 1)[on]


def _linear_predictors(x: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (frames x order) and shifts, from autocorrelations by Levinson's recursion."""
    y = np.where(inside, x, 0).astype(np.float32)
    r = np.stack([(y[:, : y.shape[1] - d] * y[:, d:]).sum(1) for d in range(_LPC_ORDER + 1)]).astype(float)
    r[0] = r[0] * 1.0001 + 1e-6
    a, error = np.zeros((_LPC_ORDER, len(x))), r[0].copy()
    for i in range(_LPC_ORDER):
        k = (r[i + 1] - (a[:i] * r[i:0:-1]).sum(0)) / error
        a[:i] = a[:i] - k * a[:i][::-1]
        a[i] = k
        error = np.maximum(error * (1 - k * k), 1e-9)
    largest = np.maximum(np.abs(a).max(0), 1e-6)
    shift = np.clip(_LPC_BITS - 2 - np.floor(np.log2(largest)).astype(np.int64), 0, 14)
    top = 1 << (_LPC_BITS - 1)
    return np.clip(np.rint(a.T * (1 << shift)[:, None]), -top, top - 1).astype(np.int32), shift.astype(np.int32)


def _residuals(x: np.ndarray, coefficients: np.ndarray, shift: np.ndarray) -> np.ndarray:
    out, order = x.copy(), coefficients.shape[1]
    if order:
        total = sum(coefficients[:, j : j + 1] * x[:, order - 1 - j : x.shape[1] - 1 - j] for j in range(order))
        out[:, order:] -= total >> shift[:, None]
    return out


def _code_frames(raw: np.ndarray, first: np.ndarray, number: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The coded frames, one after the other, and their sizes; raw goes on for BLOCK bytes after the last sample."""
    inside = np.arange(BLOCK)[None, :] < length[:, None]
    x = np.where(inside, raw[first[:, None] + np.arange(BLOCK)].astype(np.int32) - 128, 0)
    n = len(number)
    coefficients, shift = _linear_predictors(x, inside)
    none = np.zeros(n, np.int32)
    plans = [(8 + o, o, np.tile(np.array(_FIXED[o], np.int32), (n, 1)), none) for o in range(3)] + [(31 + _LPC_ORDER, _LPC_ORDER, coefficients, shift)]
    residual, estimate = [], np.full((len(plans), n), np.inf)
    for i, (code, o, c, s) in enumerate(plans):
        e = _residuals(x, c, s)
        e[:, :o] = 0
        e[~inside] = 0
        residual.append(e)
        mean = 2 * np.abs(e).sum(1) / np.maximum(length - o, 1) + 1
        # a Rice code takes about 1.5 bits more than the logarithm of the mean
        estimate[i] = np.where(length > o, (np.log2(mean) + 1.5) * (length - o) + 8 * o + (50 if code > 31 else 0), np.inf)
    plan = estimate.argmin(0)
    kind, order = np.array([q[0] for q in plans])[plan], np.array([q[1] for q in plans])[plan]
    kept = residual[0]
    for i in range(1, len(plans)):
        kept[plan == i] = residual[i][plan == i]
    del residual
    kept = (kept << 1) ^ (kept >> 31)
    count, linear = np.maximum(length - order, 1), kind > 31
    head = 8 + 8 * order + 10 + np.where(linear, 9 + _LPC_BITS * order, 0)
    guess = np.clip(np.log2(np.maximum(kept.sum(1) / count, 1)).astype(np.int64), 1, 13)
    rice, best = np.zeros(n, np.int64), 8 + 8 * length
    fits = np.zeros(n, bool)
    top = kept.max(1)
    for k in (guess - 1, guess):
        bits = head + (kept >> k[:, None].astype(np.int32)).sum(1) + (k + 1) * count
        better = (bits < best) & ((top >> k) < 24)
        best, rice, fits = np.where(better, bits, best), np.where(better, k, rice), fits | better
    kind, order = np.where(fits, kind, 1), np.where(fits, order, 0)
    same = (np.where(inside, x, x[:, :1]) == x[:, :1]).all(1)
    kind[same], order[same], best[same] = 0, 0, 16
    heads = [_coded_number(int(i)) for i in number]
    number_size = np.array([len(h) for h in heads], np.int64)
    short = length != BLOCK
    head_size = 4 + number_size + 2 * short + 1
    frame_size = head_size + -(-best // 8) + 2
    at = np.cumsum(frame_size) - frame_size
    out = _Bits(int(frame_size.sum()))
    p = 8 * (at + head_size)
    out.put(p + 1, np.where(kind > 31, 32 + order - 1, kind), 6)
    p += 8
    for o in range(1, _LPC_ORDER + 1):
        on = (order >= o) & (kind >= 8)
        out.put((p + 8 * (o - 1))[on], x[on, o - 1] & 0xFF, 8)
    out.put(p[same], x[same, 0] & 0xFF, 8)
    verbatim = np.flatnonzero(kind == 1)
    put_at = (p[verbatim][:, None] + 8 * np.arange(BLOCK))[inside[verbatim]]
    out.put(put_at, x[verbatim][inside[verbatim]] & 0xFF, 8)
    p += 8 * order
    linear = kind > 31
    coefficients, shift = coefficients.astype(np.int64), shift.astype(np.int64)
    out.put(p[linear], np.full(linear.sum(), _LPC_BITS - 1), 4)
    out.put((p + 4)[linear], shift[linear], 5)
    for j in range(_LPC_ORDER):
        out.put((p + 9 + _LPC_BITS * j)[linear], coefficients[linear, j] & ((1 << _LPC_BITS) - 1), _LPC_BITS)
    p += np.where(linear, 9 + _LPC_BITS * _LPC_ORDER, 0)
    coded = np.flatnonzero(kind >= 8)
    out.put((p + 6)[coded], rice[coded], 4)
    live = inside[coded] & (np.arange(BLOCK)[None, :] >= order[coded][:, None])
    z, k = kept[coded][live].astype(np.int64), np.repeat(rice[coded], live.sum(1))
    width = (z >> k) + 1 + k
    many = live.sum(1)
    begin = np.cumsum(width) - width
    begin += np.repeat((p + 10)[coded] - begin[np.cumsum(many) - many] if len(z) else p[:0], many)
    stop = begin + (z >> k)
    # stop bit and low bits lie within 24 bits from their first byte; codes share bytes but no bits, so sums join them
    field = (1 << k | z & ((1 << k) - 1)) << (23 - k - (stop & 7))
    sums = np.bincount(stop >> 3, field, len(out.bits) // 8 + 2).astype(np.int64)
    data = np.packbits(out.bits)
    sums = np.r_[0, 0, sums]
    n_bytes = len(data)
    data |= (sums[2 : n_bytes + 2] >> 16 | sums[1 : n_bytes + 1] >> 8 & 0xFF | sums[:n_bytes] & 0xFF).astype(np.uint8)
    # headers and checksums are whole bytes
    data[at], data[at + 1] = 0xFF, 0xF8
    data[at + 2] = np.where(short, 7, 10) << 4
    data[at + 3] = 1 << 1
    for i in range(int(number_size.max())):
        on = number_size > i
        data[(at + 4 + i)[on]] = [h[i] for h in heads if len(h) > i]
    data[(at + 4 + number_size)[short]] = (length[short] - 1) >> 8
    data[(at + 5 + number_size)[short]] = (length[short] - 1) & 0xFF
    data[at + head_size - 1] = _crc8(data, at, head_size - 1)
    crc = _crc16(data, at, frame_size - 2).astype(np.int64)
    data[at + frame_size - 2], data[at + frame_size - 1] = crc >> 8, crc & 0xFF
    return data, frame_size


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    """One FLAC stream for each payload; a byte is a sample. Frames are coded in groups, so memory does not follow the length of a payload."""
    sizes = np.array([len(p) for p in payloads], np.int64)
    frames = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(payloads)), frames)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(frames) - frames, frames)
    length = np.minimum(sizes[owner] - number * BLOCK, BLOCK)
    raw = np.frombuffer(b"".join(payloads) + bytes(BLOCK), np.uint8)
    first = (np.cumsum(sizes) - sizes)[owner] + number * BLOCK
    groups = [slice(a, a + GROUP) for a in range(0, len(owner), GROUP)]
    coded = [_code_frames(raw, first[g], number[g], length[g]) for g in groups]
    data = np.concatenate([np.zeros(0, np.uint8), *(c for c, _ in coded)])
    frame_size = np.concatenate([np.zeros(0, np.int64), *(c for _, c in coded)])
    del coded
    ends = np.r_[0, np.cumsum(frame_size)]
    stream = np.r_[0, np.cumsum(frames)]
    within = ends[:-1] - ends[stream[owner]]
    points = np.zeros((len(owner), 18), np.uint8)
    points[:, :8] = (number * BLOCK).astype(">u8")[:, None].view(np.uint8).reshape(-1, 8)
    points[:, 8:16] = within.astype(">u8")[:, None].view(np.uint8).reshape(-1, 8)
    points[:, 16:] = length.astype(">u2")[:, None].view(np.uint8).reshape(-1, 2)
    done, data_at = [], np.r_[0, np.cumsum(sizes)]
    for d in range(len(payloads)):
        mine = slice(stream[d], stream[d + 1])
        lo, hi = (int(frame_size[mine].min()), int(frame_size[mine].max())) if frames[d] else (0, 0)
        info = BLOCK.to_bytes(2, "big") * 2 + lo.to_bytes(3, "big") + hi.to_bytes(3, "big")
        info += ((8000 << 44) | (0 << 41) | (7 << 36) | int(sizes[d])).to_bytes(8, "big")
        info += hashlib.md5((raw[data_at[d] : data_at[d + 1]] ^ 0x80).tobytes()).digest()
        # the size of a seek table has three bytes: a longer stream names every second, third .. frame
        table = points[mine][:: max(-(-int(frames[d]) // MOST_POINTS), 1)].tobytes()
        frames_of = data[ends[stream[d]] : ends[stream[d + 1]]].tobytes()
        done.append(b"fLaC" + b"\0\0\0\x22" + info + b"\x83" + len(table).to_bytes(3, "big") + table + frames_of)
    return done


def _metadata(stream: bytes) -> tuple[int, bytes, np.ndarray, int]:
    """(samples, MD5, seek points as rows (sample, offset, length), place of the first frame)."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, total, digest, points, last = 4, 0, b"", np.zeros((0, 3), np.int64), False
    while not last:
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            if (packed >> 41) & 7 or (packed >> 36) & 31 != 7:
                raise ValueError("only 8-bit mono streams are read")
            total, digest = packed & ((1 << 36) - 1), body[18:34]
        elif kind == 3:
            table = np.frombuffer(body, np.dtype([("s", ">u8"), ("o", ">u8"), ("n", ">u2")]))
            table = table[table["s"] != 2**64 - 1]
            points = np.column_stack([table["s"].astype(np.int64), table["o"].astype(np.int64), table["n"].astype(np.int64)])
        at += 4 + size
    return total, digest, points, at


def _scan_frames(stream: bytes, at: int, total: int) -> np.ndarray:
    """Seek points of a stream whose table does not name every frame, from its sync codes and header checksums."""
    raw, rows, sample, n = np.frombuffer(stream, np.uint8), [], 0, 0
    places = at + np.flatnonzero((raw[at:-1] == 0xFF) & (raw[at + 1 :] & 0xFE == 0xF8)) if len(raw) > at else []
    for place in places:
        try:
            size, number, block = _header(raw, int(place))
        except ValueError:
            continue
        if number == n and sample < total:
            rows.append((sample, place - at, block))
            sample, n = sample + block, n + 1
    return np.array(rows, np.int64).reshape(-1, 3)


def _header(raw: np.ndarray, at: int) -> tuple[int, int, int]:
    """(bytes, frame number, samples) of a frame header; ValueError if it is none or its CRC-8 is wrong."""
    head = raw[at : at + 16].tobytes()
    if len(head) < 6 or head[0] != 0xFF or head[1] & 0xFE != 0xF8:
        raise ValueError("no frame header")
    size_code, rate_code = head[2] >> 4, head[2] & 15
    lead = head[4]
    more = 0 if lead < 0x80 else 7 - (lead ^ 0xFF).bit_length()
    number = lead if not more else lead & (0x3F >> more)
    for b in head[5 : 5 + more]:
        number = number << 6 | b & 0x3F
    i = 5 + more
    block = 192 if size_code == 1 else 576 << (size_code - 2) if 2 <= size_code <= 5 else 256 << (size_code - 8) if size_code >= 8 else 0
    if size_code in (6, 7):
        width = size_code - 5
        block = int.from_bytes(head[i : i + width], "big") + 1
        i += width
    i += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if not block or _crc8(raw, np.array([at]), np.array([i]))[0] != head[i]:
        raise ValueError("damaged frame header")
    return i + 1, number, block


class _Reader:
    """64-bit windows into a byte buffer, read by many frames at once."""

    def __init__(self, raw: np.ndarray) -> None:
        padded = np.concatenate([raw, np.zeros(16, np.uint8)])
        self.words = np.zeros(len(raw) + 8, np.uint64)
        for j in range(8):
            self.words |= padded[j : j + len(self.words)].astype(np.uint64) << np.uint64(56 - 8 * j)

    def window(self, p: np.ndarray) -> np.ndarray:
        return self.words[np.minimum(p >> 3, len(self.words) - 1)] << (p & 7).astype(np.uint64)

    def get(self, p: np.ndarray, width: int) -> np.ndarray:
        return (self.window(p) >> np.uint64(64 - width)).astype(np.int64)


def _signed(v: np.ndarray, width) -> np.ndarray:
    half = 1 << (np.asarray(width, np.int64) - 1)
    return np.where(v >= half, v - 2 * half, v)


def _rice(reader: _Reader, p: np.ndarray, samples: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Residuals (steps x frames) of frames whose numbers of residuals (samples - order) fall; a step reads one from each."""
    wide = np.where(reader.get(p, 2) == 1, 5, 4)
    parts = reader.get(p + 2, 4)
    p = p + 6
    many = samples - order
    out = np.zeros((int(many.max()), len(p)), np.int32)
    k, raw_bits = np.zeros(len(p), np.uint64), np.full(len(p), -1)
    part_size = samples >> parts
    next_part = np.zeros(len(p), np.int64)
    active = np.searchsorted(-many, -np.arange(len(out)), "left")
    due, escapes, m = 0, False, len(p)
    one, top = np.uint64(1), np.uint64(63)
    for i in range(len(out)):
        if active[i] != m or i == 0:
            m = int(active[i])
            p, k, raw_bits = p[:m], k[:m], raw_bits[:m]
            short = top - k
        if i == due:
            on = np.flatnonzero(next_part[:m] == i)
            value = np.where(wide[on] == 5, reader.get(p[on], 5), reader.get(p[on], 4))
            p[on] += wide[on]
            escaped = value == np.where(wide[on] == 5, 31, 15)
            k[on], raw_bits[on] = value, -1
            e = on[escaped]
            raw_bits[e] = reader.get(p[e], 5)
            p[e] += 5
            next_part[on] = ((i + order[on]) // part_size[on] + 1) * part_size[on] - order[on]
            due, escapes, short = int(next_part[:m].min()), bool((raw_bits >= 0).any()), top - k
        w = reader.window(p)
        # leading zeros of the upper half, from the exponent of a float
        zeros = 1054 - ((w >> np.uint64(32)).view(np.int64).astype(np.float64).view(np.int64) >> 52)
        if escapes or zeros.max(initial=0) >= 24:
            out[i, :m] = _one_by_one(reader, p, k, raw_bits)
            continue
        quotient = zeros.view(np.uint64)
        z = ((quotient << k) | (w << (quotient + one)) >> short >> one).view(np.int64)
        out[i, :m] = (z >> 1) ^ -(z & 1)
        p += zeros + k.view(np.int64) + 1
    return out


def _one_by_one(reader: _Reader, p: np.ndarray, k: np.ndarray, raw_bits: np.ndarray) -> np.ndarray:
    """A step with long quotients or escaped partitions; moves p on."""
    out = np.zeros(len(p), np.int64)
    for f in range(len(p)):
        at = p[f : f + 1].copy()
        if raw_bits[f] >= 0:
            width = int(raw_bits[f])
            if width:
                out[f] = _signed(reader.get(at, width), width)[0]
            p[f] += width
            continue
        q = 0
        while not (bit := int(reader.get(at + q, 16)[0])):
            q += 16
            if at[0] + q > 8 * len(reader.words):
                raise ValueError("a residual runs past the stream")
        q += 16 - bit.bit_length()
        width = int(k[f])
        low = int(reader.get(at + q + 1, width)[0]) if width else 0
        z = (q << width) | low
        out[f] = (z >> 1) ^ -(z & 1)
        p[f] += q + 1 + width
    return out


def _read_frames(raw: np.ndarray, start: np.ndarray, end: np.ndarray, samples: np.ndarray) -> list[bytes]:
    """The samples of each frame; ValueError where a checksum or the structure is wrong."""
    # longest first: frames that end leave the common step from the end
    order_of = np.argsort(-samples, kind="stable")
    start, end, samples = start[order_of], end[order_of], samples[order_of]
    crc = _crc16(raw, start, end - start - 2)
    if ((raw[end - 2].astype(np.int64) << 8 | raw[end - 1]) != crc).any():
        raise ValueError("a frame's CRC-16 is wrong")
    if ((raw[start] != 0xFF) | (raw[start + 1] & 0xFE != 0xF8)).any():
        raise ValueError("no frame header where one is due")
    lead = raw[start + 4].astype(np.int64)
    more = np.where(lead < 0x80, 0, 7 - np.ceil(np.log2(np.maximum((lead ^ 0xFF) + 1, 1))).astype(np.int64))
    size_code, rate_code = raw[start + 2] >> 4, raw[start + 2] & 15
    head = 5 + more + np.select([size_code == 6, size_code == 7], [1, 2], 0) + np.select([rate_code == 12, rate_code >= 13], [1, 2], 0)
    if (_crc8(raw, start, head) != raw[start + head]).any():
        raise ValueError("a frame header's CRC-8 is wrong")
    reader = _Reader(raw)
    p = 8 * (start + head + 1)
    kind = reader.get(p, 8) >> 1
    if (reader.get(p, 8) & 1).any():
        raise ValueError("wasted bits are not read")
    p = p + 8
    pcm = np.zeros((int(samples.max()), len(start)), np.int32)
    constant = np.flatnonzero(kind == 0)
    pcm[:, constant] = _signed(reader.get(p[constant], 8), 8)
    for i in range(int(samples[kind == 1].max(initial=0))):
        on = np.flatnonzero((kind == 1) & (samples > i))
        pcm[i, on] = raw[(p[on] >> 3) + i].astype(np.int8)
    order = np.where(kind > 31, kind - 31, np.where((kind >= 8) & (kind <= 12), kind - 8, -1))
    if ((order < 0) & (kind > 1)).any():
        raise ValueError("a reserved subframe type")
    coded = np.flatnonzero(order >= 0)
    coded = coded[np.argsort(-(samples - order)[coded], kind="stable")]
    if len(coded):
        o, linear, at = order[coded], kind[coded] > 31, p[coded]
        for j in range(int(o.max())):
            on = o > j
            pcm[j, coded[on]] = _signed(reader.get(at[on] + 8 * j, 8), 8)
        at = at + 8 * o
        shift, c = np.zeros(len(coded), np.int32), np.zeros((32, len(coded)), np.int32)
        width = np.where(linear, reader.get(at, 4) + 1, 1)
        shift[linear] = _signed(reader.get(at[linear] + 4, 5), 5)
        at = at + np.where(linear, 9, 0)
        for n in range(5):
            c[:n, (o == n) & ~linear] = np.array(_FIXED[n], np.int32)[:, None]
        for j in range(int(o[linear].max(initial=0))):
            on = linear & (o > j)
            c[j, on] = _signed((reader.window(at[on]) >> (64 - width[on]).astype(np.uint64)).astype(np.int64), width[on])
            at[on] += width[on]
        if (samples[coded] <= o).any():
            raise ValueError("a frame is shorter than its predictor")
        residual = _rice(reader, at, samples[coded], o)
        for n in np.unique(o):
            on = np.flatnonzero(o == n)
            x = np.zeros((int(samples[coded[on]].max()), len(on)), np.int32)
            x[:n] = pcm[:n, coded[on]]
            x[n:] = residual[: len(x) - n, on]
            back, by = c[:n, on][::-1].copy(), shift[on]
            for i in range(n, len(x)) if n else ():
                x[i] += (back * x[i - n : i]).sum(0, dtype=np.int32) >> by
            pcm[: len(x), coded[on]] = x
    pcm = (pcm + 128).astype(np.uint8).T
    back_at = np.argsort(order_of)
    return [pcm[f, : samples[f]].tobytes() for f in back_at]


def decode_streams(streams: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """The PCM blocks (sample offset, bytes) of each stream; ValueError where a checksum or the structure is wrong."""
    infos = [_metadata(s) for s in streams]
    base = np.cumsum([0, *(len(s) for s in streams)])
    raw = np.frombuffer(b"".join(streams), np.uint8)
    rows = []
    for d, (total, _, points, at) in enumerate(infos):
        if points[:, 2].sum() != total:
            points = _scan_frames(streams[d], at, total)
        if points[:, 2].sum() != total:
            raise ValueError("frames are missing")
        start = base[d] + at + points[:, 1]
        rows.append(np.column_stack([np.full(len(points), d), start, np.r_[start[1:], base[d + 1]][: len(points)], points[:, 0], points[:, 2]]))
    frames = np.concatenate(rows) if rows else np.zeros((0, 5), np.int64)
    out: list[list] = [[] for _ in streams]
    for g in range(0, len(frames), GROUP):
        owner, start, end, offset, samples = frames[g : g + GROUP].T
        low = int(start.min())
        for d, at, pcm in zip(owner, offset, _read_frames(raw[low : int(end.max())], start - low, end - low, samples), strict=True):
            out[d].append((int(at), pcm))
    for d, (_, digest, _, _) in enumerate(infos):
        whole = hashlib.md5()
        for _, block in out[d]:
            whole.update((np.frombuffer(block, np.uint8) ^ 0x80).tobytes())
        if any(digest) and whole.digest() != digest:
            raise ValueError("the samples' MD5 is wrong")
    return out


def read_samples(stream: bytes, start: int, count: int) -> bytes:
    """Samples start .. start + count - 1, by decoding only the frames that hold them."""
    total, _, points, at = _metadata(stream)
    if points[:, 2].sum() != total:
        points = _scan_frames(stream, at, total)
    stop = min(start + count, total)
    on = np.flatnonzero((points[:, 0] < stop) & (points[:, 0] + points[:, 2] > start))
    if not len(on):
        return b""
    a, z = points[on[0]], on[-1] + 1
    end = at + points[z, 1] if z < len(points) else len(stream)
    part = points[on] - [0, a[1], 0]
    table = b"".join(int(s).to_bytes(8, "big") + int(o).to_bytes(8, "big") + int(n).to_bytes(2, "big") for s, o, n in part)
    info = bytearray(stream[8:42])
    info[10:18] = ((int.from_bytes(info[10:18], "big") >> 36 << 36) | int(part[:, 2].sum())).to_bytes(8, "big")
    info[18:34] = bytes(16)
    cut = b"fLaC\0\0\0\x22" + bytes(info) + b"\x83" + len(table).to_bytes(3, "big") + table + stream[at + a[1] : end]
    samples = b"".join(b for _, b in decode_streams([cut])[0])
    return samples[start - a[0] : stop - a[0]]


def padded(raw: bytes) -> bytes:
    """raw with zero bytes up to a positive multiple of PAD."""
    return raw + bytes(-len(raw) % PAD or (0 if raw else PAD))


def encode_media(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with n_bytes and media (a FLAC stream of the padded UTF-8 bytes of the text); such columns are replaced."""

    def make(b: pa.RecordBatch) -> dict:
        raw = [t.encode() for t in common.text_array(b.column(text_col)).to_pylist()]
        return {"n_bytes": [len(r) for r in raw], "media": encode_streams([padded(r) for r in raw])}

    return common.add_columns(df, make, [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())], text_col)


def media_blocks(df: DataFrame, key: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(key, block, sample_offset, n_samples, pcm): a row for each frame of each stream; null media have none."""
    schema = T.StructType([df.schema[key], T.StructField("block", T.LongType()), T.StructField("sample_offset", T.LongType()), T.StructField("n_samples", T.LongType()), T.StructField("pcm", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b.column(1).is_valid())
            for part in common.slices(b, media_col):
                rows = [(i, n, at, len(pcm), pcm) for i, blocks in enumerate(decode_streams(part.column(1).to_pylist())) for n, (at, pcm) in enumerate(blocks)]
                c = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(c[0], pa.int64())), *(pa.array(v, pa.int64()) for v in c[1:4]), pa.array(c[4], pa.binary())], names=schema.names)

    return df.select(key, media_col).mapInArrow(run, schema)


def _feature(payload: bytes) -> str:
    """Sum, energy, zero crossings and peak of the samples: exact whole numbers."""
    total = energy = crossings = peak = 0
    for at in range(0, len(payload), BLOCK * GROUP):
        x = np.frombuffer(payload[max(at - 1, 0) : at + BLOCK * GROUP], np.uint8).astype(np.int64) - 128
        crossings += int(((x[1:] < 0) != (x[:-1] < 0)).sum())
        x = x[1:] if at else x
        total, energy, peak = total + int(x.sum()), energy + int((x * x).sum()), max(peak, int(np.abs(x).max()))
    return f"{total}:{energy}:{crossings}:{peak}"


def media_digests(df: DataFrame, media_col: str = "media") -> DataFrame:
    """df without the media, with digests of the stored form and of the samples read back from it."""
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    kinds = (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType(), T.StringType())

    def make(b: pa.RecordBatch) -> dict:
        media = [m.as_py() for m in b.column(media_col)]
        made = []
        for m, blocks in zip(media, decode_streams(media), strict=True):
            payload = b"".join(x for _, x in blocks)
            made.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(m), hashlib.sha256(m).hexdigest(), _feature(payload)))
        return dict(zip(names, zip(*made, strict=True), strict=True))

    fields = [T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]
    return common.add_columns(df, make, fields, media_col).drop(media_col)


def op3_media(spark, sf_dir: str) -> DataFrame:
    coded = encode_media(common.read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "media")
    return media_digests(coded).select("doc_id", F.col("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
