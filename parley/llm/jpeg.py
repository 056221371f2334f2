"""Progressive JPEG media columns, coded and decoded with numpy.

The decoder takes progressive streams of one or three components: it accumulates spectral-selection and
successive-approximation scans into coefficient arrays, inverse-transforms these, upsamples chroma, and gives RGB
tensors at full resolution. Entropy-coded data are decoded in lockstep: every restart interval of every image of a batch
is a lane, and one numpy step reads one symbol of each lane.

The encoder stores a payload losslessly in the format's own units, the quantised coefficients: with all quantiser steps
1, byte b becomes coefficient b + 256, 64 bytes a block. The bias keeps coefficients nonzero in every approximation.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parley.llm.common import tidy

#: Blocks per restart interval, and payload bytes that are coded at once.
LANE_BLOCKS, CHUNK_BYTES = 8, 3_000_000
BIAS = 256


def _zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order."""
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in order])


ZIGZAG = _zigzag()
#: The inverse transform's matrix in 12-bit fixed point. Products of integers below 2 ** 53 are exact in float64, so that
#: results don't depend on how a matrix product is split.
_SCALE = 12
_BASIS = np.array([[(np.sqrt(1 / 8) if u == 0 else 0.5 * np.cos((2 * x + 1) * u * np.pi / 16)) for x in range(8)] for u in range(8)])
BASIS = np.round(_BASIS * (1 << _SCALE))


# ---------------------------------------------------------------- entropy decoding


class Lanes:
    """Bit readers over restart intervals, all at once. Reads past an end give ones, as after a marker."""

    def __init__(self, segments: list[bytes]) -> None:
        pad = b"\xff" * 16
        sizes = np.fromiter(map(len, segments), np.int64, len(segments)) + len(pad)
        self.raw = np.frombuffer(pad.join(segments) + pad, np.uint8)
        self.at = (np.cumsum(sizes) - sizes) * 8
        wide = self.raw.astype(np.int64)
        self.last = len(wide) - 5
        self.window = wide[:-4] << 32 | wide[1:-3] << 24 | wide[2:-2] << 16 | wide[3:-1] << 8 | wide[4:]

    def peek(self, at: np.ndarray) -> np.ndarray:
        """The 32 bits from bit position at."""
        return (self.window[np.minimum(at >> 3, self.last)] >> (8 - (at & 7))) & 0xFFFFFFFF

    def read(self, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next symbol at each bit position with its extra bits: table entry, number in the extra bits, new position."""
        x = self.peek(at)
        entry = table[x >> 16]
        total = entry & 63
        if not total.all():
            raise ValueError("a Huffman code isn't in its table")
        return entry, (x >> (32 - total)) & ((1 << ((entry >> 6) & 31)) - 1), at + total

    def bits(self, lanes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The next n (0 to 16) bits of each lane as a number."""
        out = self.peek(self.at[lanes]) >> (32 - n)
        self.at[lanes] += n
        return out

    def rows(self, at: np.ndarray) -> np.ndarray:
        """The next 64 bits from each position, a bit an entry."""
        octets = self.raw[np.minimum((at >> 3)[:, None] + np.arange(9), len(self.raw) - 1)]
        bits, shift = np.unpackbits(octets, axis=1), at & 7
        if (shift == shift[:1]).all():
            return bits[:, int(shift[0]) : int(shift[0]) + 64]
        out = np.empty((len(at), 64), np.uint8)
        for s in range(8):
            own = shift == s
            out[own] = bits[own, s : s + 64]
        return out


#: By category: numbers below HALF are negative, by OFFSET.
_HALF = np.array([0] + [1 << s for s in range(16)])
_OFFSET = np.array([0] + [1 - (2 << s) for s in range(16)])


def extend(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The signed number of a magnitude category."""
    return value + np.where(value < _HALF[size], _OFFSET[size], 0)


def huffman_codes(counts: list[int], symbols: bytes) -> dict[int, tuple[int, int]]:
    """symbol: (code, length), from the number of codes of each length 1 to 16."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = code, length
            code, k = code + 1, k + 1
        code <<= 1
    return out


def huffman_table(spec: bytes, ac: bool) -> np.ndarray:
    """For every 16 bits, the entry of the code they begin with (0: none): length with extra bits, extra bits << 6,
    size << 11, run << 15, and for AC tables 1 << 19 where a band ends."""
    table = np.zeros(1 << 16, np.int64)
    for symbol, (code, length) in huffman_codes(list(spec[:16]), spec[16:]).items():
        run, size = (symbol >> 4, symbol & 15) if ac else (0, symbol)
        end = ac and size == 0 and run < 15
        extra = run if end else size
        table[code << (16 - length) : (code + 1) << (16 - length)] = length + extra | extra << 6 | size << 11 | run << 15 | end << 19
    return table


def decode_dc(lanes: Lanes, blocks: np.ndarray, component: np.ndarray, coef: np.ndarray, tables: list[np.ndarray], first: bool, low: int) -> None:
    """A DC scan. blocks: (lanes, most blocks of a lane) rows of coef in coding order, -1 where a lane has no more;
    component: index of the component in the scan, by column, for predictions and tables."""
    last = np.zeros((len(blocks), len(tables)), np.int64)
    for j in range(blocks.shape[1]):
        live = np.flatnonzero(blocks[:, j] >= 0)
        if not first:
            coef[blocks[live, j], 0] |= lanes.bits(live, np.ones(len(live), np.int64)) << low
            continue
        c = component[j]
        entry, value, lanes.at[live] = lanes.read(lanes.at[live], tables[c])
        last[live, c] += extend(value, (entry >> 11) & 15)
        coef[blocks[live, j], 0] = last[live, c] << low


def decode_ac_first(lanes: Lanes, blocks: np.ndarray, coef: np.ndarray, table: np.ndarray, ss: int, se: int, low: int) -> None:
    """The first scan of a band."""
    flat, n = coef.reshape(-1), (blocks >= 0).sum(1)
    live = np.flatnonzero(n > 0)
    at, block, k, row = lanes.at[live], np.zeros(len(live), np.int64), np.full(len(live), ss), blocks[live, 0] * 64
    while len(live):
        entry, value, at = lanes.read(at, table)
        end = entry >= 1 << 19
        k += np.where(end, 0, (entry >> 15) & 15)
        number = extend(value, (entry >> 11) & 15) * (1 << low)
        if end.any():
            put = ~end
            if (k[put] > se).any():
                raise ValueError("a run leaves its band")
            flat[row[put] + k[put]] = number[put]
            block[end] += (1 << ((entry[end] >> 15) & 15)) + value[end]
            k = np.where(end, ss, k + 1)
        else:
            if int(k.max()) > se:
                raise ValueError("a run leaves its band")
            flat[row + k] = number
            k += 1
        over = k > se
        if over.any() or end.any():
            block += over
            k[over] = ss
            on = block < n[live]
            if not on.all():
                live, at, block, k = live[on], at[on], block[on], k[on]
            row = blocks[live, block] * 64


def decode_ac_refine(lanes: Lanes, blocks: np.ndarray, coef: np.ndarray, table: np.ndarray, ss: int, se: int, low: int) -> None:
    """A later scan of a band: one more bit of nonzero coefficients, and coefficients that become nonzero."""
    n = (blocks >= 0).sum(1)
    block, k = np.zeros(len(blocks), np.int64), np.full(len(blocks), ss)
    runs = np.zeros(len(blocks), np.int64)  # blocks of the current end-of-band run, this one included
    columns, unit = np.arange(se + 1), 1 << low
    live = np.flatnonzero(n > 0)
    while len(live):
        read = live[runs[live] == 0]
        entry, value, lanes.at[read] = lanes.read(lanes.at[read], table)
        end, run = entry >= 1 << 19, (entry >> 15) & 15
        runs[read[end]] = (1 << run[end]) + value[end]
        rows = blocks[live, block[live]]
        part = coef[rows, : se + 1]
        inside = columns >= k[live, None]
        old = inside & (part != 0)
        stop = np.full(len(live), se + 1)
        if not end.all():
            # a run ends at the zero with as many zeros of the band before it as the run says
            wanted, fresh = np.full(len(blocks), -1), np.zeros(len(blocks), np.int64)
            wanted[read[~end]] = run[~end]
            fresh[read[~end]] = np.where(((entry >> 11) & 15)[~end] == 0, 0, np.where(value[~end] == 1, unit, -unit))
            zero = inside & (part == 0)
            target = zero & (np.cumsum(zero, 1, dtype=np.int16) == wanted[live, None] + 1) & (wanted[live, None] >= 0)
            has = target.any(1)
            stop = np.where(has, target.argmax(1), se + 1)
            if ((wanted[live] >= 0) & ~has).any():
                raise ValueError("a run leaves its band")
            old &= columns < stop[:, None]
        count = old.sum(1)
        bits = lanes.rows(lanes.at[live])
        if (count == se + 1 - ss).all():
            part[:, ss:] += np.sign(part[:, ss:]) * (bits[:, : se + 1 - ss].astype(np.int32) << low)
        else:
            places = np.maximum(np.cumsum(old, 1, dtype=np.int16) - 1, 0)
            part += np.sign(part) * ((np.take_along_axis(bits, places, 1) & old).astype(np.int32) << low)
        if not end.all():
            i = np.flatnonzero(has)
            part[i, stop[i]] = fresh[live[i]]
        lanes.at[live] += count
        coef[rows, : se + 1] = part
        k[live] = stop + 1
        done = k[live] > se
        block[live[done]] += 1
        k[live[done]] = ss
        runs[live] -= (runs[live] > 0) & done
        live = live[block[live] < n[live]]


# ---------------------------------------------------------------- streams


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int
    rows: int = 0  # blocks in each direction, filled up to whole MCUs
    columns: int = 0
    own_rows: int = 0  # blocks that scans of this component alone have
    own_columns: int = 0
    first: int = 0


@dataclass
class Scan:
    components: list[int]
    dc: list[bytes]
    ac: list[bytes]
    band: tuple[int, int, int, int]
    interval: int
    segments: list[bytes]


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quants: dict[int, np.ndarray]
    scans: list[Scan] = field(default_factory=list)
    comments: list[bytes] = field(default_factory=list)
    n_blocks: int = 0


def _segments(data: bytes, at: int) -> tuple[list[bytes], int]:
    """Restart intervals of the entropy-coded data at `at`, without stuffing, and where the next marker is."""
    out, start = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise ValueError("the stream ends within a scan")
        mark = data[at + 1]
        if mark == 0:
            at += 2
        elif mark == 0xFF:
            at += 1
        else:
            out.append(data[start:at].replace(b"\xff\x00", b"\xff"))
            if not 0xD0 <= mark <= 0xD7:
                return out, at
            at += 2
            start = at


def parse(data: bytes) -> Image:
    """Headers and scans of a progressive stream; ValueError if it isn't one."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG stream")
    at, image, quants, tables, interval, comments = 2, None, {}, {}, 0, []
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            if data[at : at + 2] == b"\xff\xd9":
                break
            raise ValueError("a marker is missing")
        mark = data[at + 1]
        if mark == 0xD9:
            break
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 65 + 64 * wide
                quants[body[0] & 15] = np.frombuffer(body[1:n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[n:]
        elif mark == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]] = body[1:n]
                body = body[n:]
        elif mark == 0xDD:
            (interval,) = struct.unpack(">H", body)
        elif mark == 0xFE:
            comments.append(body)
        elif mark == 0xC2:
            depth, height, width, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or n not in (1, 3) or not height or not width:
                raise ValueError("only 8-bit images of one or three components are read")
            image = Image(width, height, [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)], quants, comments=comments)
            _lay_out(image)
        elif mark in (0xC0, 0xC1) or 0xC3 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a progressive stream")
        elif mark == 0xDA:
            if image is None:
                raise ValueError("a scan without a frame")
            n = body[0]
            idents = [c.ident for c in image.components]
            parts = [idents.index(body[1 + 2 * i]) for i in range(n)]
            picks = [body[2 + 2 * i] for i in range(n)]
            ss, se, approx = body[1 + 2 * n : 4 + 2 * n]
            segments, at = _segments(data, at)
            image.scans.append(Scan(parts, [tables.get(p >> 4, b"") for p in picks], [tables.get(0x10 | p & 15, b"") for p in picks], (ss, se, approx >> 4, approx & 15), interval, segments))
    if image is None:
        raise ValueError("no frame")
    return image


def _lay_out(image: Image) -> None:
    h, v = max(c.h for c in image.components), max(c.v for c in image.components)
    across, down = -(-image.width // (8 * h)), -(-image.height // (8 * v))
    at = 0
    for c in image.components:
        c.rows, c.columns = down * c.v, across * c.h
        c.own_columns, c.own_rows = -(-(-(-image.width * c.h // h)) // 8), -(-(-(-image.height * c.v // v)) // 8)
        c.first = at
        at += c.rows * c.columns
    image.n_blocks = at


def _order(image: Image, parts: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """Blocks of a scan in coding order, their component within the scan by column, and blocks per unit of interval."""
    return _order_of(tuple((c.h, c.v, c.rows, c.columns, c.own_rows, c.own_columns, c.first) for c in image.components), tuple(parts))


@lru_cache(512)
def _order_of(layout: tuple[tuple[int, ...], ...], parts: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    if len(parts) == 1:
        _, _, rows, columns, own_rows, own_columns, first = layout[parts[0]]
        grid = first + np.arange(rows * columns).reshape(rows, columns)[:own_rows, :own_columns]
        return grid.ravel(), np.zeros(1, np.int64), 1
    units, which = [], []
    for i, p in enumerate(parts):
        h, v, rows, columns, _, _, first = layout[p]
        grid = first + np.arange(rows * columns).reshape(rows // v, v, columns // h, h)
        units.append(grid.transpose(0, 2, 1, 3).reshape(-1, v * h))
        which += [i] * (v * h)
    return np.concatenate(units, 1).ravel(), np.array(which), len(which)


def decode_coefficients(images: list[Image]) -> np.ndarray:
    """The coefficient arrays (blocks, 64), in zigzag order, of all images one after another. Scans of images are
    decoded together where their headers agree."""
    starts = np.cumsum([0] + [i.n_blocks for i in images])
    coef = np.zeros((int(starts[-1]), 64), np.int32)
    for step in range(max((len(i.scans) for i in images), default=0)):
        groups: dict[tuple, list[int]] = defaultdict(list)
        for k, image in enumerate(images):
            if step < len(image.scans):
                s = image.scans[step]
                sampling = tuple((image.components[p].h, image.components[p].v) for p in s.components)
                groups[(tuple(s.components), sampling, tuple(s.dc), tuple(s.ac), s.band)].append(k)
        for (parts, _, dc, ac, (ss, se, high, low)), members in groups.items():
            segments, rows = [], []
            for k in members:
                scan = images[k].scans[step]
                order, which, unit = _order(images[k], list(parts))
                order = order + starts[k]
                width = scan.interval * unit or len(order)
                cuts = -(-len(order) // width)
                if cuts != len(scan.segments):
                    raise ValueError("a scan has too few or too many restart intervals")
                segments += scan.segments
                rows.append((order, width, cuts))
            most = max(min(w, len(o)) for o, w, _ in rows)
            blocks = np.full((len(segments), most), -1, np.int64)
            at = 0
            for order, width, cuts in rows:
                whole = len(order) // width
                if whole:
                    blocks[at : at + whole, :width] = order[: whole * width].reshape(whole, width)
                if whole < cuts:
                    blocks[at + whole, : len(order) - whole * width] = order[whole * width :]
                at += cuts
            lanes = Lanes(segments)
            if ss == 0:
                if se:
                    raise ValueError("a progressive scan mixes DC and AC")
                component = np.resize(which, most)
                decode_dc(lanes, blocks, component, coef, [huffman_table(t, False) for t in dc] if high == 0 else [np.zeros(0)] * len(dc), high == 0, low)
            elif high == 0:
                decode_ac_first(lanes, blocks, coef, huffman_table(ac[0], True), ss, se, low)
            else:
                decode_ac_refine(lanes, blocks, coef, huffman_table(ac[0], True), ss, se, low)
    return coef


def to_samples(coef: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Dequantises and inverse-transforms blocks (n, 64) in zigzag order; samples (n, 8, 8) of uint8."""
    grid = np.zeros((len(coef), 64))
    grid[:, ZIGZAG] = coef * quant[:64]
    rows = (grid.reshape(-1, 8) @ BASIS).reshape(-1, 8, 8)  # along the columns of a row
    both = (rows.transpose(0, 2, 1).reshape(-1, 8) @ BASIS).reshape(-1, 8, 8).transpose(0, 2, 1)
    return np.clip(np.floor(both / (1 << 2 * _SCALE) + 128.5), 0, 255).astype(np.uint8)


def to_rgb(image: Image, coef: np.ndarray) -> np.ndarray:
    """The RGB tensor (height, width, 3) of an image from its coefficients; chroma is upsampled by repetition."""
    planes = []
    h, v = max(c.h for c in image.components), max(c.v for c in image.components)
    for c in image.components:
        samples = to_samples(coef[c.first : c.first + c.rows * c.columns], image.quants[c.quant])
        plane = samples.reshape(c.rows, c.columns, 8, 8).transpose(0, 2, 1, 3).reshape(c.rows * 8, c.columns * 8)
        if (c.h, c.v) != (h, v):
            if h % c.h or v % c.v:
                raise ValueError("only whole sampling ratios are read")
            plane = plane.repeat(v // c.v, 0).repeat(h // c.h, 1)
        planes.append(plane[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, 2)
    # 16-bit fixed point of the public colour transform
    y, cb, cr = planes[0].astype(np.int32) << 16, planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
    half = 1 << 15
    r, g, b = y + 91881 * cr + half, y - 22554 * cb - 46802 * cr + half, y + 116130 * cb + half
    return np.clip(np.stack([r, g, b], 2) >> 16, 0, 255).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """The RGB tensor of one stream."""
    image = parse(data)
    return to_rgb(image, decode_coefficients([image]))


# ---------------------------------------------------------------- payloads

#: Huffman tables of the encoder, as counts by length and symbols. DC differences of biased bytes have 7 bits at most
#: after the first one (8 bits); AC scans have one symbol each, and a second one that keeps the all-ones code unused.
_DC = bytes([0, 0, 0, 9, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]) + bytes(range(9))
_AC_FIRST = bytes([1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]) + bytes([0x07, 0x00])
_AC_REFINE = bytes([1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]) + bytes([0x00, 0x01])
#: Scans: DC without its last bit, AC bands without their last two bits, then the bits that are left.
_BANDS = ((1, 5), (6, 63))


def _shape(n_blocks: int) -> tuple[int, int]:
    """MCUs across and down that hold at least n_blocks blocks, six a MCU (4:2:0)."""
    mcus = -(-n_blocks // 6)
    across = max(1, int(np.ceil(np.sqrt(mcus))))
    return across, -(-mcus // across)


def _pack(values: np.ndarray, sizes: np.ndarray, lane: np.ndarray, n_lanes: int) -> list[bytes]:
    """Bit strings of lanes: values of sizes bits, in order; filled up with ones, FF stuffed."""
    total = np.bincount(lane, sizes, n_lanes).astype(np.int64)
    fill = -total % 8
    ends = np.cumsum(total + fill)
    before = np.cumsum(sizes) - sizes
    first = np.searchsorted(lane, np.arange(n_lanes))
    shift = (ends - total - fill) - np.append(before, int(sizes.sum()))[first]
    start = before + shift[lane]
    bits = np.ones(int(ends[-1]), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        has = sizes > k
        bits[start[has] + k] = (values[has] >> (sizes[has] - 1 - k)) & 1
    raw = np.packbits(bits).tobytes()
    edges = [0, *(ends // 8).tolist()]
    return [raw[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip(edges, edges[1:])]


def _pack_rows(bits: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Bit strings of lanes of sizes[i] rows each, where bits has the rows of all lanes, (rows, width)."""
    width = bits.shape[1]
    if width % 8 == 0:
        return _cut(np.packbits(bits, axis=1), sizes)
    total = sizes * width
    ends = np.cumsum(total + -total % 8)
    out = np.ones(int(ends[-1]), np.uint8)
    gaps = (ends - -total % 8) - np.cumsum(total)  # what is filled before a lane
    out[np.arange(int(total.sum())) + np.repeat(gaps, total)] = bits.ravel()
    return _cut(np.packbits(out)[:, None], (total + 7) // 8)


def _cut(octets: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The bytes of lanes of sizes[i] rows each, with FF stuffed."""
    raw, edges = octets.tobytes(), [0, *(np.cumsum(sizes) * octets.shape[1]).tolist()]
    if b"\xff" not in raw:
        return [raw[a:b] for a, b in zip(edges, edges[1:])]
    return [raw[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip(edges, edges[1:])]


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A progressive stream for each payload of a positive multiple of 64 bytes: three components, chroma halved in both
    directions, a comment with the number of payload blocks."""
    if not payloads:
        return []
    shapes = [_shape(len(p) // 64) for p in payloads]
    n_blocks = np.array([6 * a * d for a, d in shapes])
    starts = np.concatenate([[0], np.cumsum(n_blocks)])
    value = np.full((int(starts[-1]), 64), BIAS, np.int32)
    for p, at in zip(payloads, starts):
        value[at : at + len(p) // 64] += np.frombuffer(p, np.uint8).reshape(-1, 64)
    images = []
    for (across, down), n in zip(shapes, n_blocks):
        image = Image(16 * across, 16 * down, [Component(1, 2, 2, 0), Component(2, 1, 1, 0), Component(3, 1, 1, 0)], {})
        _lay_out(image)
        images.append(image)
    known: dict = {}
    scans: list[list[bytes]] = [[] for _ in payloads]  # each scan's header and data, by image

    def lanes_of(parts: list[int], interval: int) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray]:
        """Blocks in coding order over all images, blocks per lane, lanes per image, component by block."""
        if (key := (tuple(parts), interval)) in known:
            return known[key]
        orders, sizes, per, comps = [], [], [], []
        for image, at in zip(images, starts):
            order, which, unit = _order(image, parts)
            width = interval * unit
            cuts = -(-len(order) // width)
            orders.append(order + at)
            comps.append(np.resize(which, len(order)))
            per.append(cuts)
            sizes.append(np.minimum(width, len(order) - width * np.arange(cuts)))
        known[key] = np.concatenate(orders), np.concatenate(sizes), per, np.concatenate(comps)
        return known[key]

    def emit(parts: list[int], band: tuple[int, int, int, int], interval: int, per: list[int], lanes: list[bytes]) -> None:
        head = struct.pack(">BBHH", 0xFF, 0xDD, 4, interval) + b"\xff\xda" + struct.pack(">HB", 6 + 2 * len(parts), len(parts))
        refine = band[2] > 0 and band[0] > 0
        head += b"".join(bytes([p + 1, 1 if refine else 0]) for p in parts) + bytes([band[0], band[1], band[2] << 4 | band[3]])
        at = 0
        for k, n in enumerate(per):
            body = [lanes[at]]
            for i in range(1, n):
                body += [bytes([0xFF, 0xD0 + (i - 1) % 8]), lanes[at + i]]
            scans[k].append(head + b"".join(body))
            at += n

    dc_codes = huffman_codes(list(_DC[:16]), _DC[16:])
    code = np.array([dc_codes[s][0] for s in range(9)])
    rst = max(1, LANE_BLOCKS // 6)
    order, sizes, per, comp = lanes_of([0, 1, 2], rst)
    lane = np.repeat(np.arange(len(sizes)), sizes)
    dc = value[order, 0] >> 1
    by = np.lexsort((np.arange(len(order)), comp, lane))  # the blocks of a component within a lane side by side
    before = np.zeros(len(order), np.int64)
    same = (lane[by][1:] == lane[by][:-1]) & (comp[by][1:] == comp[by][:-1])
    before[by[1:][same]] = dc[by[:-1][same]]
    diff = dc - before
    size = np.zeros(len(diff), np.int64)
    for k in range(9):
        size += np.abs(diff) >= 1 << k
    low = np.where(diff < 0, diff + (1 << size) - 1, diff)
    emit([0, 1, 2], (0, 0, 0, 1), rst, per, _pack((code[size] << size) | low, 4 + size, lane, len(sizes)))
    for p in range(3):
        order, sizes, per, _ = lanes_of([p], LANE_BLOCKS)
        for ss, se in _BANDS:  # code 0 and 7 bits of the coefficient without its last two bits: one byte
            emit([p], (ss, se, 0, 2), LANE_BLOCKS, per, _cut((value[order, ss : se + 1] >> 2).astype(np.uint8), sizes))
    for level in (1, 0):
        if level == 0:
            order, sizes, per, _ = lanes_of([0, 1, 2], rst)
            emit([0, 1, 2], (0, 0, 1, 0), rst, per, _pack_rows((value[order, :1] & 1).astype(np.uint8), sizes))
        for p in range(3):
            order, sizes, per, _ = lanes_of([p], LANE_BLOCKS)
            bits = np.zeros((len(order), 64), np.uint8)  # code 0: the band ends, then a bit for each coefficient
            bits[:, 1:] = (value[order, 1:] >> level) & 1
            emit([p], (1, 63, level + 1, level), LANE_BLOCKS, per, _pack_rows(bits, sizes))
    tables = b"".join(b"\xff\xc4" + struct.pack(">HB", 3 + len(t), k) + t for k, t in ((0x00, _DC), (0x10, _AC_FIRST), (0x11, _AC_REFINE)))
    out = []
    for payload, image, own in zip(payloads, images, scans):
        frame = struct.pack(">BHHB", 8, image.height, image.width, 3) + b"".join(bytes([c.ident, c.h << 4 | c.v, 0]) for c in image.components)
        note = struct.pack(">I", len(payload) // 64)
        head = b"\xff\xd8" + b"\xff\xfe" + struct.pack(">H", 2 + len(note)) + note + b"\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([1]) * 64
        out.append(head + b"\xff\xc2" + struct.pack(">H", 2 + len(frame)) + frame + tables + b"".join(own) + b"\xff\xd9")
    return out


def read_payloads(streams: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """(payload, RGB tensor) of each stream of encode_payloads."""
    images = [parse(s) for s in streams]
    coef = decode_coefficients(images)
    out, at = [], 0
    for image in images:
        own = coef[at : at + image.n_blocks]
        (n,) = struct.unpack(">I", image.comments[0])
        out.append(((own[:n] - BIAS).astype(np.uint8).tobytes(), to_rgb(image, own)))
        at += image.n_blocks
    return out


def payload_of(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes of a text (null: none) and their number, filled up with zeros to a positive multiple of 64."""
    body = (text or "").encode()
    return len(body), body + bytes(-len(body) % 64 or (0 if body else 64))


def _runs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= CHUNK_BYTES or i + 1 == len(texts):
            yield start, i + 1
            start, held = i + 1, 0


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and media (a progressive JPEG) of every row of docs. Null and empty texts are one block of zeros; equal texts
    give equal media; other columns are ignored."""
    rows = docs.select(docs[id_col].alias(id_col), docs[text_col].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            for a, b in _runs(texts):
                media = encode_payloads([payload_of(t)[1] for t in texts[a:b]])
                yield pa.RecordBatch.from_arrays([batch.column(id_col).slice(a, b - a), pa.array(media, pa.binary())], [id_col, "media"])

    return rows.mapInArrow(tidy(run), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, media binary")


def decode_media(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """id, height, width and rgb (bytes of the tensor) of every progressive JPEG; null media give nulls, and so do
    streams that aren't progressive JPEG."""
    rows = media.select(media[id_col].alias(id_col), media[media_col].alias("_media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, data in zip(batch.column(id_col), batch.column("_media")):
                try:
                    rgb = decode(data.as_py()) if data.is_valid else None
                except (ValueError, IndexError, KeyError, struct.error):
                    rgb = None
                row = [None, None, None] if rgb is None else [rgb.shape[0], rgb.shape[1], rgb.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([ident.as_py()], batch.column(id_col).type), *(pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.binary())))], [id_col, "height", "width", "rgb"])

    return rows.mapInArrow(tidy(run), f"`{id_col}` {media.schema[id_col].dataType.simpleString()}, height int, width int, rgb binary")


def media_report(docs: DataFrame) -> DataFrame:
    """Stores every text as a progressive JPEG, decodes that, and returns doc_id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256 and feature: shape, channel sums and crc32 of the RGB tensor.

    A stream is read back in the task that made it. Null texts count as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in _runs(texts):
                made = [payload_of(t) for t in texts[a:b]]
                media = encode_payloads([p for _, p in made])
                cols: list[list] = [[] for _ in range(7)]
                for (n, _), stream, (payload, rgb) in zip(made, media, read_payloads(media)):
                    sums = ",".join(map(str, rgb.reshape(-1, 3).sum(0, dtype=np.int64).tolist()))
                    feature = f"rgb:{rgb.shape[0]}x{rgb.shape[1]}:{sums}:{zlib.crc32(rgb):08x}"
                    for col, v in zip(cols, (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stream), hashlib.sha256(stream).hexdigest(), feature)):
                        col.append(v)
                types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *(pa.array(c, t) for c, t in zip(cols, types))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
