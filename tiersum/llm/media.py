"""Media columns: progressive JPEG.

A payload is stored in the quantized coefficients of a progressive JPEG, one byte less 128 for each coefficient in zigzag
order: the format's unit, which it keeps without loss. Images have 4:2:0 sampling, quantizers of one and one MCU a
row; a payload that needs more rows than an image can have goes to several images, one after the other. Each component
has five scans: the DC's upper bits, two spectral bands with the AC's upper bits, then a refining scan for DC and AC. Restart
intervals cut every scan into short pieces.

Encoder and decoder work on many pieces at a time: the decoder reads one symbol of every piece in each step and
collects the scans in coefficient arrays. Then come the inverse transform, level shift and doubling of the chroma planes, and conversion
to RGB. All arithmetic is exact, so that equal payloads give equal tensors wherever they are decoded.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 576
FILL = b"\xff"
#: Blocks in a restart interval.
INTERVAL = 9
#: Blocks of an MCU by component (Y, Cb, Cr) and the largest number of MCUs in an image.
MCU_BLOCKS, MAX_MCUS = (4, 1, 1), 4095
#: (first coefficient, last, bit position of an earlier scan or 0, bit position of this one)
SCANS = ((0, 0, 0, 1), (1, 31, 0, 1), (32, 63, 0, 1), (0, 0, 1, 0), (1, 63, 1, 0))
#: Code lengths by symbol: DC sizes; AC runs and sizes, short for the sizes that text has.
DC_LENGTHS = {s: 4 for s in range(12)}
AC_LENGTHS = {r << 4 | s: 11 for r in range(16) for s in range(1, 9)} | {0xF0: 11, 0: 5} | {s: 5 for s in range(1, 9)} | {4: 2, 3: 3, 6: 3}
_COMMENT = re.compile(r"(\d+) of \d+, (\d+) used")
_SIZE = np.array([int(v).bit_length() for v in range(1 << 11)], np.int32)


def zigzag() -> np.ndarray:
    """Row-major position of each coefficient of the diagonal order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


def canonical(lengths: dict[int, int]) -> tuple[bytes, dict[int, int]]:
    """Body of a table segment (numbers of codes by length, symbols) and the code of each symbol."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    code, last, codes = 0, 0, {}
    for s in order:
        code <<= lengths[s] - last
        last, codes[s] = lengths[s], code
        code += 1
    return bytes(sum(n == lengths[s] for s in order) for n in range(1, 17)) + bytes(order), codes


def _encoder_table(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    codes, table = canonical(lengths)[1], np.zeros((2, 256), np.int32)
    for s, c in codes.items():
        table[:, s] = c, lengths[s]
    return table[0], table[1]


def decoder_table(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Length and symbol by the next 16 bits; length 0 where no code begins so."""
    length, symbol, at, k = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0, 16
    for n, count in enumerate(body[:16], 1):
        for _ in range(count):
            width = 1 << (16 - n)
            length[at : at + width], symbol[at : at + width] = n, body[k]
            at, k = at + width, k + 1
    return length, symbol


ZIGZAG = zigzag()
DC_CODES, AC_CODES = _encoder_table(DC_LENGTHS), _encoder_table(AC_LENGTHS)


@dataclass
class Lanes:
    """Blocks in order of lanes (restart intervals). first, blocks: by lane; lane, at: by block, at being its place there."""

    first: np.ndarray
    blocks: np.ndarray
    lane: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, blocks: np.ndarray) -> Lanes:
        first = np.cumsum(blocks) - blocks
        lane = np.repeat(np.arange(len(blocks)), blocks)
        return cls(first, blocks, lane, np.arange(len(lane)) - first[lane])


def _stuffed(data: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Entropy-coded bytes with a zero after each 255, and the lanes' ends therein."""
    full = np.nonzero(data == 255)[0]
    return np.insert(data, full + 1, 0).tobytes(), ends + np.searchsorted(full, ends)


def pack_items(value: np.ndarray, bits: np.ndarray, lane: np.ndarray, lanes: int) -> tuple[bytes, np.ndarray]:
    """Items of at most 32 bits, in order of lanes, as bytes; lanes end on bytes, filled up with ones."""
    per = np.bincount(lane, weights=bits, minlength=lanes).astype(np.int64)
    size = -(-per // 8)
    start = 8 * (np.cumsum(size) - size)
    offset = np.cumsum(bits) - bits + (start - (np.cumsum(per) - per))[lane]
    spare = 8 * size - per
    value = np.concatenate((value, (1 << spare) - 1)).astype(np.uint64)
    bits, offset = np.concatenate((bits, spare)), np.concatenate((offset, start + per))
    value <<= (64 - bits - (offset & 31)).astype(np.uint64) & np.uint64(63)
    value[bits == 0] = 0
    word, total = offset >> 5, int(size.sum())
    n = total // 4 + 3
    words = np.bincount(word, weights=(value >> np.uint64(32)).astype(np.float64), minlength=n) + np.bincount(word + 1, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)
    return _stuffed(words.astype(np.uint64).astype(">u4").view(np.uint8)[:total], np.cumsum(size))


def _amplitude(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = v.astype(np.int32)
    size = _SIZE[np.abs(v)]
    return size, v + (v < 0) * ((np.int32(1) << size) - 1)


def encode_dc(dc: np.ndarray, lanes: Lanes) -> tuple[bytes, np.ndarray]:
    v = dc >> 1
    before = np.concatenate(([0], v[:-1]))
    size, amplitude = _amplitude(v - np.where(lanes.at == 0, 0, before))
    return pack_items(DC_CODES[0][size] << size | amplitude, DC_CODES[1][size] + size, lanes.lane, len(lanes.first))


def encode_band(coef: np.ndarray, lanes: Lanes) -> tuple[bytes, np.ndarray]:
    """First scan of an AC band: the upper bits of the magnitudes."""
    v = np.sign(coef) * (np.abs(coef) >> 1)
    width = v.shape[1]
    flat = np.flatnonzero(v).astype(np.int32)
    row, col = np.divmod(flat, np.int32(width))
    new = np.ones(len(row), bool)
    new[1:] = row[1:] != row[:-1]
    run = col - np.where(new, -1, np.concatenate(([0], col[:-1]))) - 1
    jumps = run >> 4  # symbols for sixteen zeros each
    size, amplitude = _amplitude(v.ravel()[flat])
    symbol = (run & 15) << 4 | size
    last = np.full(len(v), -1)
    last[row] = col
    stop = last < width - 1
    stops_before = np.cumsum(stop) - stop
    place = np.arange(len(row)) + np.cumsum(jumps) + stops_before[row]
    per_row = np.bincount(row, weights=1 + jumps, minlength=len(v)).astype(np.int64)
    stop_place = (np.cumsum(per_row) + stops_before)[stop]
    n = len(row) + int(jumps.sum()) + int(stop.sum())
    value, bits, of = np.full(n, AC_CODES[0][0xF0]), np.full(n, AC_CODES[1][0xF0]), np.empty(n, np.int32)
    value[place], bits[place] = AC_CODES[0][symbol] << size | amplitude, AC_CODES[1][symbol] + size
    value[stop_place], bits[stop_place] = AC_CODES[0][0], AC_CODES[1][0]
    of[place], of[stop_place] = row, np.nonzero(stop)[0]
    if jumps.any():
        at = np.repeat(place, jumps) - 1 - (np.arange(int(jumps.sum())) - np.repeat(np.cumsum(jumps) - jumps, jumps))
        of[at] = np.repeat(row, jumps)
    return pack_items(value, bits, lanes.lane[of], len(lanes.first))


def _code_bits(symbol: int) -> list[int]:
    n, code = int(AC_CODES[1][symbol]), int(AC_CODES[0][symbol])
    return [code >> (n - 1 - i) & 1 for i in range(n)]


def _refine_block(v: list[int]) -> list[int]:
    """Bits of one block's refining scan where some coefficient becomes nonzero."""
    out, held, run = [], [], 0
    new = [k for k, x in enumerate(v) if abs(x) == 1]
    for k, x in enumerate(v):
        if abs(x) > 1:
            held.append(abs(x) & 1)
        elif x == 0:
            run += 1
            if run == 16 and k < new[-1]:
                out += _code_bits(0xF0) + held
                held, run = [], 0
        else:
            out += _code_bits(run << 4 | 1) + [int(x > 0)] + held
            held, run = [], 0
        if k == new[-1]:
            rest = v[k + 1 :]
            return out + (_code_bits(0) + [abs(x) & 1 for x in rest if x] if rest else [])
    return out


def encode_refining(coef: np.ndarray, lanes: Lanes) -> tuple[bytes, np.ndarray]:
    """Refining AC scan: the lowest bit of coefficients known to be nonzero, and those that become nonzero."""
    size = np.abs(coef)
    stop = np.array(_code_bits(0), np.uint8)
    grid, keep = np.empty((len(coef), len(stop) + coef.shape[1]), np.uint8), np.ones((len(coef), len(stop) + coef.shape[1]), bool)
    grid[:, : len(stop)], grid[:, len(stop) :] = stop, size & 1
    keep[:, len(stop) :] = size > 1
    special = np.nonzero((size == 1).any(axis=1))[0]
    keep[special] = False
    own = {int(r): np.array(_refine_block(coef[r].tolist()), np.uint8) for r in special}
    counts = keep.sum(axis=1)
    counts[special] = [len(own[int(r)]) for r in special]
    per = np.bincount(lanes.lane, weights=counts, minlength=len(lanes.first)).astype(np.int64)
    nbytes = -(-per // 8)
    start = 8 * (np.cumsum(nbytes) - nbytes)
    offset = np.cumsum(counts) - counts + (start - (np.cumsum(per) - per))[lanes.lane]
    bits = np.ones(int(nbytes.sum()) * 8, np.uint8)
    rank = np.cumsum(keep, axis=1) - 1 + offset[:, None]
    bits[rank[keep]] = grid[keep]
    for r, b in own.items():
        bits[offset[r] : offset[r] + len(b)] = b
    return _stuffed(np.packbits(bits), np.cumsum(nbytes))


def encode_low_bits(dc: np.ndarray, lanes: Lanes) -> tuple[bytes, np.ndarray]:
    return pack_items(dc & 1, np.ones(len(dc), np.int64), lanes.lane, len(lanes.first))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


_TABLES = _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC4, b"\x00" + canonical(DC_LENGTHS)[0] + b"\x10" + canonical(AC_LENGTHS)[0]) + _segment(0xDD, struct.pack(">H", INTERVAL))


def encode(payloads: list[bytes], sizes: list[int]) -> list[bytes]:
    """Stored forms of payloads (positive multiples of UNIT bytes). sizes: their lengths without fill, kept in a comment."""
    images = []  # (payload, comment, bytes, MCUs)
    for d, p in enumerate(payloads):
        step = MAX_MCUS * sum(MCU_BLOCKS) * 64
        for lo in range(0, len(p), step):
            part = p[lo : lo + step]
            images.append((d, f"{len(part)} of {len(p)}, {sizes[d]} used".encode(), part, -(-len(part) // (sum(MCU_BLOCKS) * 64))))
    coef = np.zeros((sum(i[3] for i in images) * sum(MCU_BLOCKS), 64), np.int16)
    at, per_lane = 0, []
    for _, _, part, mcus in images:
        n = len(part) // 64
        np.subtract(np.frombuffer(part, np.uint8).reshape(n, 64), np.int16(128), out=coef[at : at + n], dtype=np.int16)
        at += mcus * sum(MCU_BLOCKS)
        for b in MCU_BLOCKS:
            full, rest = divmod(b * mcus, INTERVAL)
            per_lane += [INTERVAL] * full + [rest] * bool(rest)
    lanes = Lanes.of(np.array(per_lane))
    done = []
    for first, last, high, low in SCANS:
        if first == 0:
            data, ends = (encode_low_bits if high else encode_dc)(coef[:, 0], lanes)
        else:
            data, ends = (encode_refining if high else encode_band)(coef[:, first : last + 1], lanes)
        done.append((data, [0, *ends.tolist()]))
    out, lane = [b""] * len(payloads), 0
    for d, comment, _, mcus in images:
        counts = [-(-b * mcus // INTERVAL) for b in MCU_BLOCKS]
        parts = [b"\xff\xd8", _segment(0xFE, comment), _TABLES, _segment(0xC2, struct.pack(">BHHB", 8, 16 * mcus, 16, 3) + bytes((1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0)))]
        for (first, last, high, low), (data, ends) in zip(SCANS, done):
            k = lane
            for c, n in enumerate(counts):
                parts.append(_segment(0xDA, bytes((1, c + 1, 0, first, last, high << 4 | low))))
                for i in range(n):
                    if i:
                        parts.append(bytes((255, 0xD0 + (i - 1) % 8)))
                    parts.append(data[ends[k + i] : ends[k + i + 1]])
                k += n
        lane += sum(counts)
        out[d] += b"".join([*parts, b"\xff\xd9"])
    return out


class Bits:
    """Entropy-coded bytes of many pieces, without stuffing, for reads at many bit positions at a time."""

    def __init__(self, data: np.ndarray):
        d = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.int64)
        self.bytes = np.concatenate((data, np.zeros(8, np.uint8)))
        self.words = d[:-3] << 24 | d[1:-2] << 16 | d[2:-1] << 8 | d[3:]

    def bit(self, at: np.ndarray) -> np.ndarray:
        return self.bytes[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1

    def peek(self, at: np.ndarray, n) -> np.ndarray:
        """n bits (25 at most) from each position."""
        return self.words[at >> 3] >> (32 - (at & 7) - n) & ((1 << n) - 1)


def _symbol(bits: Bits, at: np.ndarray, table) -> tuple[np.ndarray, np.ndarray]:
    code = bits.peek(at, 16)
    length = table[0][code]
    if (length == 0).any():
        raise ValueError("no such code")
    return table[1][code], at + length


def _value(bits: Bits, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    v = bits.peek(at, size)
    return np.where(v < 1 << np.maximum(size, 1) - 1, v - (1 << size) + 1, v) * (size > 0)


def decode_dc(bits: Bits, at: np.ndarray, lanes: Lanes, coef: np.ndarray, table, low: int) -> None:
    at, sum_ = at.copy(), np.zeros(len(at), np.int64)
    for b in range(int(lanes.blocks.max(initial=0))):
        on = np.nonzero(lanes.blocks > b)[0]
        size, p = _symbol(bits, at[on], table)
        sum_[on] += _value(bits, p, size)
        at[on] = p + size
        coef[lanes.first[on] + b, 0] = sum_[on] << low


def decode_low_bits(bits: Bits, at: np.ndarray, lanes: Lanes, coef: np.ndarray, low: int) -> None:
    coef[:, 0] |= (bits.bit(at[lanes.lane] + lanes.at) << low).astype(np.int16)


def decode_band(bits: Bits, at: np.ndarray, lanes: Lanes, coef: np.ndarray, table, first: int, last: int, low: int) -> None:
    flat = coef.reshape(-1)
    p, block, stop = at.copy(), lanes.first.copy(), lanes.first + lanes.blocks
    k = np.full(len(p), first)
    while len(p):
        symbol, p = _symbol(bits, p, table)
        run, size = symbol >> 4, symbol & 15
        k = k + run
        value = _value(bits, p, size)
        given = size > 0
        if (given & (k > last)).any():
            raise ValueError("a run leaves the band")
        flat[block[given] * 64 + k[given]] = value[given] << low
        p = p + size
        k = k + 1  # past the coefficient, or past the last of sixteen zeros
        ends = ~given & (run < 15)
        if ends.any():
            extra = np.where(ends, run, 0)
            skip = (1 << extra) - 1 + bits.peek(p, extra)
            p = p + extra
            block = np.where(ends, block + skip, block)
            k = np.where(ends, last + 1, k)
        over = k > last
        block = block + over
        k = np.where(over, first, k)
        live = block < stop
        if not live.all():
            p, block, stop, k = p[live], block[live], stop[live], k[live]


def decode_refining(bits: Bits, at: np.ndarray, lanes: Lanes, coef: np.ndarray, table, first: int, last: int, low: int) -> None:
    p, block, stop = at.copy(), lanes.first.copy(), lanes.first + lanes.blocks
    k, whole = np.full(len(p), first), np.zeros(len(p), np.int64)  # whole: blocks to refine to their ends without a symbol
    place = np.arange(first, last + 1)
    while len(p):
        run, fresh = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        ask = np.nonzero(whole == 0)[0]
        if len(ask):
            symbol, q = _symbol(bits, p[ask], table)
            r, s = symbol >> 4, symbol & 15
            if (s > 1).any():
                raise ValueError("a refining scan has a larger size")
            ends = (s == 0) & (r < 15)
            extra = np.where(ends, r, 0)
            whole[ask] = np.where(ends, (1 << extra) + bits.peek(q, extra), 0)
            fresh[ask] = np.where(s == 1, 2 * bits.peek(q, 1) - 1, 0)
            p[ask] = q + extra + s
            run[ask] = r
        rows = coef[block, first : last + 1]
        ahead = place[None, :] >= k[:, None]
        known = (rows != 0) & ahead
        zeros = np.cumsum((rows == 0) & ahead, axis=1, dtype=np.uint8)
        hit = zeros == (run + 1).astype(np.uint8)[:, None]
        target = np.where((whole > 0) | ~hit.any(axis=1), last + 1, hit.argmax(axis=1) + first)
        if ((fresh != 0) & (target > last)).any():
            raise ValueError("a run leaves the band")
        known &= place[None, :] < target[:, None]
        number = np.cumsum(known, axis=1, dtype=np.uint8)
        lane, col = np.nonzero(known)
        bit = bits.bit(p[lane] + number[known] - 1)
        old = rows[known]
        coef[block[lane], col + first] = old + np.sign(old) * (bit << low).astype(np.int16)
        p = p + number[:, -1]
        new = np.nonzero(fresh)[0]
        coef[block[new], target[new]] = fresh[new] << low
        k = target + 1
        over = k > last
        whole = np.where(over & (whole > 0), whole - 1, whole)
        block = block + over
        k = np.where(over, first, k)
        live = block < stop
        if not live.all():
            p, block, stop, k, whole = p[live], block[live], stop[live], k[live], whole[live]


@dataclass
class Decoded:
    """Coefficients (blocks x 64, diagonal order) of all images, and by image: its file, MCUs and comment."""

    coef: np.ndarray
    file: np.ndarray
    mcus: np.ndarray
    comments: list[str]

    def payloads(self, files: int) -> tuple[list[bytes], list[int]]:
        """The stored bytes of each file without blocks beyond them, and their number without fill."""
        data, used, at = [b""] * files, [0] * files, 0
        for f, mcus, comment in zip(self.file.tolist(), self.mcus.tolist(), self.comments):
            own, size = map(int, _COMMENT.fullmatch(comment).groups())
            data[f] += (self.coef[at : at + own // 64] + 128).astype(np.uint8).tobytes()
            used[f] = size
            at += mcus * sum(MCU_BLOCKS)
        return data, used

    def rgb(self) -> np.ndarray:
        """All images one below the other: rows x 16 x 3, 8 bits."""
        scale, n = 1 << 13, np.arange(8)
        basis = np.rint(scale * np.where(n == 0, np.sqrt(1 / 8), 0.5)[:, None] * np.cos((2 * n[None, :] + 1) * n[:, None] * np.pi / 16))
        square = np.empty((len(self.coef), 64))
        square[:, ZIGZAG] = self.coef
        half = (square.reshape(-1, 8) @ basis).reshape(-1, 8, 8).transpose(0, 2, 1)  # whole numbers below 2^53: no rounding
        full = np.ascontiguousarray(half).reshape(-1, 8) @ basis
        full *= 1 / scale**2
        full += 128.5
        level = np.clip(full, 0, 255, out=full).astype(np.uint8).reshape(-1, 8, 8).transpose(0, 2, 1)
        of = np.repeat(np.arange(len(self.mcus)), self.mcus * 6)
        start = (np.cumsum(self.mcus) - self.mcus) * 6
        at = np.arange(len(of)) - start[of]
        luma, blue = at < 4 * self.mcus[of], at < 5 * self.mcus[of]
        y = level[luma].reshape(-1, 2, 8, 8).transpose(0, 2, 1, 3).reshape(-1, 16)
        cb, cr = (level[m].reshape(-1, 8).astype(np.int32) - 128 for m in (~luma & blue, ~blue))
        half16 = 1 << 15
        shifts = (91881 * cr + half16 >> 16, -(22554 * cb + 46802 * cr + half16 >> 16), 116130 * cb + half16 >> 16)
        out = np.empty((*y.shape, 3), np.uint8)
        for k, shift in enumerate(shifts):  # each chroma sample serves two columns and two rows
            wide = shift.astype(np.int16).repeat(2, axis=1).repeat(2, axis=0)
            wide += y
            out[:, :, k] = np.clip(wide, 0, 255, out=wide)
        return out


def decode(files: list[bytes]) -> Decoded:
    """Read files of one or more images as `encode` writes them: three components with 4:2:0 sampling, one MCU a row, scans of one component.

    Tables, intervals, scan scripts, end-of-band runs and comments are read from the file. Raises ValueError for anything else.
    """
    images: list[tuple[int, int, str]] = []
    scans: dict[tuple, list] = {}  # by what they share: pieces (image, component, start, end)
    interval = 0
    data = np.frombuffer(b"".join(files) + b"\0\0", np.uint8)
    marks = (np.nonzero((data[:-1] == 255) & (data[1:] != 0) & (data[1:] != 255))[0]).tolist()
    text, base, m = data.tobytes(), 0, 0
    for f, file in enumerate(files):
        at, end, tables, comment = base, base + len(file), {}, ""
        while at < end:
            if text[at] != 255:
                raise ValueError("no marker where one is due")
            kind, at = text[at + 1], at + 2
            if kind in (0xD8, 0xD9):
                continue
            size = int.from_bytes(text[at : at + 2], "big")
            body, at = text[at + 2 : at + size], at + size
            if kind == 0xFE:
                comment = body.decode()
            elif kind == 0xDD:
                interval = int.from_bytes(body, "big")
            elif kind == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    tables[body[0]], body = body[1:n], body[n:]
            elif kind == 0xC2:
                height, width = struct.unpack(">HH", body[1:5])
                if body[5:] != bytes((3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0)) or width != 16 or height % 16:
                    raise ValueError("another kind of image")
                images.append((f, height // 16, comment))
            elif kind == 0xDA:
                if body[0] != 1:
                    raise ValueError("a scan of several components")
                first, last, bits = body[3:6]
                table = tables[0x10 | body[2] & 15] if first else tables[body[2] >> 4]
                ends = []
                while marks[m] < at:
                    m += 1
                while 0xD0 <= text[marks[m] + 1] <= 0xD7:
                    ends.append(marks[m])
                    m += 1
                ends.append(marks[m])
                starts = [at, *(e + 2 for e in ends[:-1])]
                scans.setdefault((first, last, bits >> 4, bits & 15, table), []).append((len(images) - 1, body[1] - 1, starts, ends))
                at = ends[-1]
        base = end
    mcus = np.array([i[1] for i in images], np.int64)
    coef = np.zeros((int(mcus.sum()) * 6, 64), np.int16)
    first_block = (np.cumsum(mcus) - mcus) * 6
    stuffing = np.zeros(len(data), bool)
    stuffing[1:] = (data[1:] == 0) & (data[:-1] == 255)
    clean, moved = Bits(data[~stuffing]), np.cumsum(~stuffing) - ~stuffing
    decoders: dict[bytes, tuple] = {}
    for (first, last, high, low, table), pieces in scans.items():
        blocks, where, begin = [], [], []
        for image, c, starts, ends in pieces:
            n, own = int(mcus[image]) * MCU_BLOCKS[c], interval or 1 << 30
            if len(starts) != -(-n // own):
                raise ValueError("a scan with another number of intervals")
            blocks += [min(own, n - i * own) for i in range(len(starts))]
            offset = int(first_block[image]) + int(mcus[image]) * sum(MCU_BLOCKS[:c])
            where += [offset + i * own for i in range(len(starts))]
            begin += starts
        lanes = Lanes.of(np.array(blocks, np.int64))
        rows = np.array(where, np.int64)[lanes.lane] + lanes.at
        ordered = len(rows) == len(coef) and bool((rows == np.arange(len(rows))).all())
        part, start = coef if ordered else coef[rows], moved[np.array(begin)] * 8
        if table not in decoders:
            decoders[table] = decoder_table(table)
        found = decoders[table]
        if first == 0 and not high:
            decode_dc(clean, start, lanes, part, found, low)
        elif first == 0:
            decode_low_bits(clean, start, lanes, part, low)
        elif not high:
            decode_band(clean, start, lanes, part, found, first, last, low)
        else:
            decode_refining(clean, start, lanes, part, found, first, last, low)
        if not ordered:
            coef[rows] = part
    return Decoded(coef, np.array([i[0] for i in images], np.int64), mcus, [i[2] for i in images])


def payload_of(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode("utf-8", "surrogatepass")
    size = max(1, -(-len(data) // UNIT)) * UNIT
    return data.ljust(size, FILL), len(data)


def _chunks(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches with about `limit` bytes in a column."""
    for batch in batches:
        lo, size, values = 0, 0, []
        for k, v in enumerate(batch.column(column)):
            values.append(v.as_py())
            size += len(values[-1] or "") + UNIT
            if size >= limit:
                yield batch.slice(lo, len(values)), values
                lo, size, values = k + 1, 0, []
        if values:
            yield batch.slice(lo, len(values)), values


#: Bytes encoded or decoded at a time.
STEP = 3_000_000


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (doc_id, media binary), one row per row of docs; a null text is empty. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _chunks(batches, 1, STEP):
            payloads, sizes = zip(*map(payload_of, texts))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(encode(list(payloads), list(sizes)), pa.binary())], ["doc_id", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, media binary")


def rows_of(image_rows: np.ndarray, decoded: Decoded, files: int) -> list[np.ndarray]:
    """The RGB tensor of each file: its images one below the other."""
    ends = np.cumsum(np.bincount(decoded.file, weights=16 * decoded.mcus, minlength=files)).astype(np.int64)
    return np.split(image_rows, ends[:-1])


def read_media(media: DataFrame, tensors: bool = True) -> DataFrame:
    """(doc_id, media) -> payload figures read back from the stored form, a feature and, if asked for, the RGB tensor.

    One row per row of media; a null media has nulls in all other columns, an empty table gives none. Other columns are ignored.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last 32 payload bytes), media_bytes,
    media_sha256, feature, and height, width, rgb (rows of 8-bit RGB). feature has the tensor's height and width, then
    mean and standard deviation of red, green and blue.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", height int, width int, rgb binary" * tensors
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values in _chunks(batches, 1, STEP):
            files = [v for v in values if v is not None]
            if len(files) < len(values):
                none = part.filter(pa.array([v is None for v in values]))
                yield pa.RecordBatch.from_arrays([none.column(0), *(pa.nulls(none.num_rows, t) for t in kinds[1:])], names)
                part = part.filter(pa.array([v is not None for v in values]))
            if not files:
                continue
            got = decode(files)
            payloads, used = got.payloads(len(files))
            tall = got.rgb()
            images = rows_of(tall, got, len(files))
            height = np.array([i.shape[0] for i in images])
            first = np.cumsum(height) - height
            sums = np.add.reduceat(tall.sum(axis=1, dtype=np.int64), first)
            squares = np.add.reduceat(np.square(tall, dtype=np.uint16).sum(axis=1, dtype=np.int64), first)
            mean = sums / (16 * height[:, None])
            spread = np.sqrt(np.maximum(0, squares / (16 * height[:, None]) - mean**2))
            stats = np.stack((mean, spread), axis=-1).reshape(len(files), 6).tolist()
            columns = [
                part.column(0), pa.array(used, pa.int64()), pa.array([len(p) for p in payloads], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in payloads]), pa.array([zlib.crc32(p[-32:]) for p in payloads], pa.int64()),
                pa.array([len(f) for f in files], pa.int64()), pa.array([hashlib.sha256(f).hexdigest() for f in files]), pa.array([f"{i.shape[0]}x16;" + ",".join(f"{x:.4f}" for x in s) for i, s in zip(images, stats)]),
            ]
            if tensors:
                columns += [pa.array([i.shape[0] for i in images], pa.int32()), pa.array([16] * len(images), pa.int32()), pa.array([i.tobytes() for i in images], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return media.select("doc_id", "media").mapInArrow(run, schema)
