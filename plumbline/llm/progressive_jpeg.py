"""Media columns as progressive JPEG.

``encode`` writes quantised coefficients (or bytes stored in them) as a progressive file: DC by successive approximation, a low band of AC coefficients by successive
approximation, the rest by spectral selection. ``decode`` accumulates the scans of many files into coefficient arrays. A restart
marker after every block or MCU cuts the entropy-coded data into intervals, and the intervals of all files of a batch are decoded in step, one vector
operation per symbol. Files of other writers without restart markers decode the same way, only with fewer intervals at once.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import table, text_or_empty

#: fixed values of the format: coefficient order, and the marker bytes used below
ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])
SOI, EOI, SOS, DQT, DHT, DRI, SOF2, COM = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xDD, 0xC2, 0xFE
#: the writer's code lengths: the eight run-0 symbols take 4 bits, the other 122 take 8, so that a symbol and its value fit 16 bits
SHORT = [size for size in range(1, 9)]
LONG = [0x00, 0xF0] + [run << 4 | size for run in range(1, 16) for size in range(1, 9)]
#: scans as (components, first, last, high bit, low bit)
SCRIPT = (((0, 1, 2), 0, 0, 0, 1), *(((c,), 1, 5, 0, 1) for c in range(3)), *(((c,), 6, 63, 0, 0) for c in range(3)), ((0, 1, 2), 0, 0, 1, 0), *(((c,), 1, 5, 1, 0) for c in range(3)))
#: luma blocks per MCU across and down; chroma has one block, so it is upsampled by the same factors
SAMPLING = (2, 2)
PAYLOAD_UNIT = 192
#: MCU rows of at most this many; the height of a file is limited to 65,535
ROWS = 4_000
CHUNK = 1_500_000


def canonical(lengths: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, bits), codes given in order of length."""
    code, out, at = 0, {}, 0
    for bits, count in enumerate(lengths, 1):
        for _ in range(count):
            out[symbols[at]] = (code, bits)
            code, at = code + 1, at + 1
        code <<= 1
    return out


CODES = canonical([0, 0, 0, 8, 0, 0, 0, 122] + [0] * 8, SHORT + LONG)
_CODE, _BITS = np.zeros(256, np.uint64), np.zeros(256, np.int64)
for _s, (_c, _b) in CODES.items():
    _CODE[_s], _BITS[_s] = _c, _b
#: DC differences use the same table with size 0 as symbol 0
_DHT = bytes([0, 0, 0, 8, 0, 0, 0, 122] + [0] * 8 + SHORT + LONG)


@dataclass
class Layout:
    """Blocks of one file: sampling and size in MCUs, and for each component its blocks in raster order within a batch."""

    across: int
    down: int
    factors: tuple[tuple[int, int], ...]
    first: list[int] = field(default_factory=list)

    def shape(self, c: int) -> tuple[int, int]:
        h, v = self.factors[c]
        return self.down * v, self.across * h

    def mcu_blocks(self, c: int) -> np.ndarray:
        """Block numbers of component c by MCU and place in it."""
        h, v = self.factors[c]
        rows, cols = self.shape(c)
        grid = np.arange(rows * cols).reshape(self.down, v, self.across, h)
        return self.first[c] + grid.transpose(0, 2, 1, 3).reshape(-1, h * v)


def magnitude(v: np.ndarray) -> np.ndarray:
    """Bits of |v|."""
    return np.frexp(np.abs(v).astype(np.float32))[1].astype(np.int64)


def join_items(value: np.ndarray, bits: np.ndarray, owner: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate bit strings (at most 32 bits each) by owner, pad each owner's to a byte with ones; (bytes, bytes per owner)."""
    value, live = value.astype(np.uint64), bits > 0
    value, bits, owner = value[live], bits[live].astype(np.int64), owner[live]
    total = np.bincount(owner, weights=bits, minlength=owners).astype(np.int64)
    size = (total + 7) // 8
    base = np.cumsum(size) - size
    ends = np.cumsum(bits)
    before = np.cumsum(total) - total
    at = ends - bits - before[owner] + 8 * base[owner]
    n = int(size.sum())
    words = np.zeros((n + 7) // 8 + 2, np.uint64)
    shift = 64 - (at & 63) - bits
    head = np.where(shift >= 0, value << np.maximum(shift, 0).astype(np.uint64), value >> np.maximum(-shift, 0).astype(np.uint64))
    np.bitwise_or.at(words, at >> 6, head)
    over = np.flatnonzero(shift < 0)
    np.bitwise_or.at(words, (at[over] >> 6) + 1, value[over] << (64 + shift[over]).astype(np.uint64))
    out = np.frombuffer(words.astype(">u8").tobytes(), np.uint8)[:n].copy()
    pad = np.flatnonzero(total % 8)
    out[base[pad] + size[pad] - 1] |= ((1 << (8 - total[pad] % 8)) - 1).astype(np.uint8)
    return out, size


def first_pass_items(coefs: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Items (value, bits; two columns per coefficient place and an end) of a first AC scan of blocks (n, band)."""
    n, band = coefs.shape
    sign = coefs < 0
    v = np.abs(coefs.astype(np.int64)) >> low
    size = magnitude(v)
    live = v > 0
    place = np.arange(1, band + 1)
    last = np.maximum.accumulate(np.where(live, place, 0), axis=1)
    run = place - 1 - np.concatenate([np.zeros((n, 1), np.int64), last[:, :-1]], axis=1)
    extra = np.where(sign, ((np.int64(1) << size) - 1) ^ v, v)
    symbol = np.where(live, (run & 15) << 4 | size, 0)
    value = np.where(live, (_CODE[symbol] << size.astype(np.uint64)) | extra.astype(np.uint64), 0)
    bits = np.where(live, _BITS[symbol] + size, 0)
    zrl = np.where(live, run >> 4, 0)  # runs of sixteen zeros come before; at most three in a band
    code, width = int(_CODE[0xF0]), int(_BITS[0xF0])
    lead = np.array([0, code, code << width | code, (code << width | code) << width | code], np.uint64)[zrl]
    values, widths = np.zeros((n, 2 * band + 1), np.uint64), np.zeros((n, 2 * band + 1), np.int64)
    values[:, 0:-1:2], widths[:, 0:-1:2] = lead, zrl * width
    values[:, 1:-1:2], widths[:, 1:-1:2] = value, bits
    end = last[:, -1] < band
    values[:, -1], widths[:, -1] = np.where(end, _CODE[0], 0), np.where(end, _BITS[0], 0)
    return values, widths


def refine_items(coefs: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Items of an AC refinement scan. The band must be at most 16 wide, so that no run needs a zero-run symbol."""
    n, band = coefs.shape
    v = np.abs(coefs.astype(np.int64)) >> low
    run, held, n_held = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.int64)
    values, widths = np.zeros((n, band + 1), np.uint64), np.zeros((n, band + 1), np.int64)
    for k in range(band):
        fresh, old = v[:, k] == 1, v[:, k] > 1
        symbol = run << 4 | 1
        head = (_CODE[symbol] << np.uint64(1)) | (coefs[:, k] > 0).astype(np.uint64)
        values[:, k] = np.where(fresh, (head << n_held.astype(np.uint64)) | held, 0)
        widths[:, k] = np.where(fresh, _BITS[symbol] + 1 + n_held, 0)
        held = np.where(fresh, 0, np.where(old, (held << np.uint64(1)) | (v[:, k] & 1).astype(np.uint64), held)).astype(np.uint64)
        n_held = np.where(fresh, 0, n_held + old)
        run = np.where(fresh, 0, run + (v[:, k] == 0))
    end = (run > 0) | (n_held > 0)
    values[:, band] = np.where(end, (_CODE[0] << n_held.astype(np.uint64)) | held, 0)
    widths[:, band] = np.where(end, _BITS[0] + n_held, 0)
    return values, widths


def dc_items(coefs: np.ndarray, high: int, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Items of a DC scan by MCU and place; with a restart after each MCU, a component's first block is coded in full."""
    values, widths = [], []
    for dc in coefs:  # one (MCUs, places) array per component
        v = dc.astype(np.int64) >> low
        if high:
            values.append((v & 1).astype(np.uint64))
            widths.append(np.ones_like(v))
            continue
        d = np.diff(v, axis=1, prepend=0)
        size = magnitude(d)
        extra = np.where(d < 0, d - 1, d) & ((np.int64(1) << size) - 1)
        values.append((_CODE[size] << size.astype(np.uint64)) | extra.astype(np.uint64))
        widths.append(_BITS[size] + size)
    return np.hstack(values), np.hstack(widths)


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def layout_of(blocks: int, sampling: tuple[int, int] = SAMPLING) -> tuple[int, int]:
    """MCUs across and down that hold ``blocks`` blocks (luma blocks and two of chroma to an MCU)."""
    mcus = max(1, -(-blocks // (sampling[0] * sampling[1] + 2)))
    across = -(-mcus // ROWS)
    return across, -(-mcus // across)


def encode(coefs: list[list[np.ndarray]], comments: list[bytes], sampling: tuple[int, int] = SAMPLING, quant: np.ndarray | None = None) -> list[bytes]:
    """Files from three coefficient arrays each, (rows, columns, 64) in zigzag order; values of -128..127 fit the tables."""
    factors = (sampling, (1, 1), (1, 1))
    layouts, flat, at = [], [[], [], []], [0, 0, 0]
    for parts in coefs:
        rows, cols = parts[1].shape[:2]
        layouts.append(Layout(cols, rows, factors, list(at)))
        for c, part in enumerate(parts):
            flat[c].append(part.reshape(-1, 64))
            at[c] += len(flat[c][-1])
    blocks = [np.concatenate(f) for f in flat]
    mcus = [np.concatenate([x.mcu_blocks(c) for x in layouts]) for c in range(3)]
    of_file = [np.array([x.across * x.down for x in layouts])] + [np.array([x.shape(c)[0] * x.shape(c)[1] for x in layouts]) for c in range(3)]
    streams = []
    for comps, first, last, high, low in SCRIPT:
        if first == 0:
            values, widths = dc_items([blocks[c][mcus[c], 0] for c in comps], high, low)
            counts = of_file[0]
        else:
            band = blocks[comps[0]][:, first : last + 1]
            values, widths = refine_items(band, low) if high else first_pass_items(band, low)
            counts = of_file[1 + comps[0]]
        n = len(values)
        data, size = join_items(values.ravel(), widths.ravel(), np.repeat(np.arange(n), values.shape[1]), n)
        streams.append(mark(data, size, counts))
    table_bytes = segment(DQT, bytes([0]) + (np.ones(64, np.uint8) if quant is None else quant.astype(np.uint8)).tobytes()) + segment(DHT, bytes([0x00]) + _DHT) + segment(DHT, bytes([0x10]) + _DHT) + segment(DRI, struct.pack(">H", 1))
    heads = []
    for comps, first, last, high, low in SCRIPT:
        heads.append(segment(SOS, bytes([len(comps)]) + b"".join(bytes([c + 1, 0]) for c in comps) + bytes([first, last, high << 4 | low])))
    out = []
    for i, (x, comment) in enumerate(zip(layouts, comments)):
        frame = struct.pack(">BHHB", 8, x.down * 8 * sampling[1], x.across * 8 * sampling[0], 3) + b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(factors))
        scans = b"".join(head + s[i] for head, s in zip(heads, streams))
        out.append(b"\xff\xd8" + segment(COM, comment) + table_bytes + segment(SOF2, frame) + scans + b"\xff\xd9")
    return out


def mark(data: np.ndarray, size: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Stuff a zero after each 0xFF, put restart markers between the intervals of a file, and cut the stream by file."""
    n = len(size)
    ends_file = np.zeros(n, bool)
    ends_file[np.cumsum(counts) - 1] = True
    number = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    stuffed = np.cumsum(data == 0xFF)
    ends = np.cumsum(size)
    markers = np.cumsum(np.where(ends_file, 0, 2))
    before = np.append(0, markers[:-1])
    owner = np.repeat(np.arange(n), size)
    out = np.zeros(len(data) + int(stuffed[-1] if len(data) else 0) + int(markers[-1]), np.uint8)
    out[np.arange(len(data)) + stuffed - (data == 0xFF) + before[owner]] = data
    shifted = ends + np.append(0, stuffed)[ends] + before
    gap = shifted[~ends_file]
    out[gap], out[gap + 1] = 0xFF, 0xD0 + number[~ends_file] % 8
    whole = out.tobytes()
    cuts = [0, *(ends + np.append(0, stuffed)[ends] + markers)[ends_file].tolist()]
    return [whole[a:b] for a, b in zip(cuts, cuts[1:])]


@dataclass
class Parsed:
    """One file: its layout, tables, comment, and scans as (components, first, last, high, low, tables, restart interval, byte range)."""

    width: int
    height: int
    layout: Layout
    quant: list[np.ndarray]
    comment: bytes
    scans: list[tuple]


def parse(data: bytes, stops: np.ndarray, offset: int) -> Parsed:
    """Markers of a file; ``stops`` are the batch positions of markers that end entropy-coded data, ``offset`` is the file's own."""
    at, tables, quants, comment, restart, scans, frame = 2, {}, {}, b"", 0, [], None
    while True:
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        kind = data[at + 1]
        if kind == EOI:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == DQT:
            while body:
                wide = body[0] >> 4
                quants[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                body = body[129 if wide else 65 :]
        elif kind == DHT:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif kind == DRI:
            restart = struct.unpack(">H", body)[0]
        elif kind == COM:
            comment = body
        elif kind == SOF2:
            depth, height, width, n = struct.unpack_from(">BHHB", body)
            frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC0 <= kind <= 0xCF and kind != 0xCC:
            raise ValueError("only progressive Huffman files are read")
        elif kind == SOS:
            n = body[0]
            ids = [f[0] for f in frame]
            comps = tuple(ids.index(body[1 + 2 * i]) for i in range(n))
            picks = tuple((tables.get(body[2 + 2 * i] >> 4), tables.get(0x10 | body[2 + 2 * i] & 15)) for i in range(n))
            first, last, approx = body[1 + 2 * n : 4 + 2 * n]
            end = int(stops[np.searchsorted(stops, offset + at)]) - offset
            scans.append((comps, first, last, approx >> 4, approx & 15, picks, restart, at, end))
            at = end
    factors = tuple((h, v) for _, h, v, _ in frame)
    hmax, vmax = max(h for h, _ in factors), max(v for _, v in factors)
    layout = Layout(-(-width // (8 * hmax)), -(-height // (8 * vmax)), factors)
    return Parsed(width, height, layout, [quants[q] for _, _, _, q in frame], comment, scans)


_LOOKUPS: dict[bytes, np.ndarray] = {}


def lookup(spec: bytes) -> np.ndarray:
    """For every 16-bit window the symbol and the length of its code, as length << 8 | symbol; 0 where no code fits."""
    if spec not in _LOOKUPS:
        out = np.zeros(1 << 16, np.int64)
        for symbol, (code, bits) in canonical(list(spec[:16]), list(spec[16:])).items():
            out[code << (16 - bits) : (code + 1) << (16 - bits)] = bits << 8 | symbol
        _LOOKUPS[spec] = out
    return _LOOKUPS[spec]


class Bits:
    """Big-endian windows at any bit of a byte array."""

    def __init__(self, data: np.ndarray):
        b = np.append(data, np.full(8, 255, np.uint8)).astype(np.uint64)
        self.words = b[:-7] << np.uint64(32) | b[1:-6] << np.uint64(24) | b[2:-5] << np.uint64(16) | b[3:-4] << np.uint64(8) | b[4:-3]
        self.last = len(self.words) - 1

    def window(self, at: np.ndarray) -> np.ndarray:
        """32 bits from each bit position."""
        return (self.words[np.minimum(at >> 3, self.last)] >> (8 - (at & 7)).astype(np.uint64)).astype(np.int64) & 0xFFFFFFFF


def extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Signed value of ``size`` extra bits."""
    return np.where(bits < (1 << np.maximum(size - 1, 0)), bits - (1 << size) + 1, bits)


def _symbols(source: Bits, table_: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, window, code length) at each position."""
    window = source.window(at)
    found = table_[window >> 16]
    if (found == 0).any():
        raise ValueError("broken Huffman data")
    return found & 255, window, found >> 8


def ac_first(source: Bits, table_: np.ndarray, at: np.ndarray, blocks: np.ndarray, counts: np.ndarray, coefs: np.ndarray, first: int, last: int, low: int) -> None:
    """First pass of AC coefficients. Interval i starts at bit at[i] and fills counts[i] blocks from blocks[i] on; all intervals read one symbol a turn."""
    block, left, k, skip = blocks.copy(), counts.copy(), np.full(len(at), first), np.zeros(len(at), np.int64)
    flat = coefs.reshape(-1)
    while len(at):
        symbol, window, used = _symbols(source, table_, at)
        run, size = symbol >> 4, symbol & 15
        bits = (window >> (32 - used - size)) & ((1 << size) - 1)
        some = size > 0
        place = k + run
        value = extend(bits, size) << low
        if some.all():
            flat[block * 64 + place] = value
        else:
            flat[(block * 64 + place)[some]] = value[some]
        ends = ~some & (run < 15)
        if ends.any():  # end of band, for 2**run + extra blocks
            tail = (window >> (32 - used - run)) & ((1 << run) - 1)
            skip = np.where(ends, (1 << run) + tail - 1, 0)
            at = at + used + np.where(ends, run, size)
            k = np.where(ends, last + 1, place + 1)
        else:
            at, k = at + used + size, place + 1
        full = k > last
        if full.any():
            step = np.where(full, 1 + skip, 0)
            block, left = block + step, left - step
            k = np.where(full, first, k)
            skip = np.zeros_like(skip)
            live = left > 0
            if not live.all():
                at, block, left, k, skip = at[live], block[live], left[live], k[live], skip[live]


def ac_refine(source: Bits, table_: np.ndarray, at: np.ndarray, blocks: np.ndarray, counts: np.ndarray, coefs: np.ndarray, first: int, last: int, low: int) -> None:
    """Refinement of AC coefficients, one coefficient a turn in every interval."""
    n = len(at)
    block, left, k = blocks.copy(), counts.copy(), np.full(n, first)
    run, fresh, ask, skip = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool), np.zeros(n, np.int64)
    flat = coefs.reshape(-1)
    one = 1 << low
    while len(at):
        need = np.flatnonzero(ask & (skip == 0))
        if len(need):
            symbol, window, used = _symbols(source, table_, at[need])
            r, size = symbol >> 4, symbol & 15
            sign = (window >> (31 - used)) & 1
            ends = (size == 0) & (r < 15)
            tail = (window >> (32 - used - r)) & ((1 << r) - 1)
            skip[need] = np.where(ends, (1 << r) + tail, 0)
            fresh[need] = np.where(size > 0, np.where(sign > 0, one, -one), 0)
            run[need] = r
            at[need] += used + np.where(ends, r, size > 0)
            ask[need] = False
        where = block * 64 + k
        value = flat[where]
        old = value != 0
        bit = (source.window(at) >> 31) & 1
        flat[where] = np.where(old & (bit > 0) & ((np.abs(value) & one) == 0), value + np.where(value > 0, one, -one), value)
        at = at + old
        band_end = skip > 0
        hit = ~old & ~band_end & (run == 0)
        put = hit & (fresh != 0)
        flat[where[put]] = fresh[put]
        ask |= hit
        run = np.where(~old & ~band_end, np.maximum(run - 1, 0), run)
        k = k + 1
        full = k > last
        if full.any():
            block, left, k = block + full, left - full, np.where(full, first, k)
            ask |= full
            skip = np.where(full, np.maximum(skip - 1, 0), skip)
            live = left > 0
            if not live.all():
                at, block, left, k, run, fresh, ask, skip = (x[live] for x in (at, block, left, k, run, fresh, ask, skip))


def dc_scan(source: Bits, tables: list[np.ndarray], at: np.ndarray, places: list[np.ndarray], coefs: list[np.ndarray], per: int, units: np.ndarray, high: int, low: int) -> None:
    """DC scan: places[c][i, j] is the j-th block of component c in unit i; intervals of ``per`` units (the last may hold fewer) go in step."""
    starts = np.cumsum(units) - units
    previous = [np.zeros(len(at), np.int64) for _ in places]
    for u in range(per):
        live = np.flatnonzero(units > u)
        for c, blocks in enumerate(places):
            for j in range(blocks.shape[1]):
                target = blocks[starts[live] + u, j]
                if high:
                    coefs[c][target, 0] |= ((source.window(at[live]) >> 31) & 1) << low
                    at[live] += 1
                    continue
                size, window, used = _symbols(source, tables[c], at[live])
                bits = (window >> (32 - used - size)) & ((1 << size) - 1)
                previous[c][live] += np.where(size > 0, extend(bits, size), 0)
                coefs[c][target, 0] = previous[c][live] << low
                at[live] += used + size


def decode(files: list[bytes]) -> list[tuple[Parsed, list[np.ndarray]]]:
    """Each file's headers and its coefficient arrays (rows, columns, 64), zigzag order, accumulated over all scans."""
    buffer = np.frombuffer(b"".join(files), np.uint8)
    ff = np.flatnonzero(buffer[:-1] == 0xFF)
    after = buffer[ff + 1]
    stuffed, restarts = ff[after == 0] + 1, ff[(after >= 0xD0) & (after <= 0xD7)]
    stops = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7))]
    offsets = np.cumsum([0] + [len(f) for f in files])
    parsed = [parse(f, stops, int(o)) for f, o in zip(files, offsets)]
    groups: dict[tuple, list[int]] = {}
    for i, p in enumerate(parsed):
        groups.setdefault((p.layout.factors, tuple(s[:7] for s in p.scans)), []).append(i)
    keep = np.ones(len(buffer), bool)
    keep[stuffed] = False
    dense = buffer[keep]
    source = Bits(dense)
    shift = np.cumsum(~keep)
    squeeze = lambda x: x - np.append(0, shift)[x]  # noqa: E731  positions in the buffer without stuffed zeros
    out: list = [None] * len(files)
    for (factors, scans), members in groups.items():
        total = [0] * len(factors)
        for i in members:
            parsed[i].layout.first = list(total)
            for c in range(len(factors)):
                rows, cols = parsed[i].layout.shape(c)
                total[c] += rows * cols
        coefs = [np.zeros((n, 64), np.int32) for n in total]
        for number, (comps, first, last, high, low, picks, restart) in enumerate(scans):
            starts, units, places = [], [], []
            for i in members:
                p, x = parsed[i], parsed[i].layout
                a, b = int(offsets[i]) + p.scans[number][7], int(offsets[i]) + p.scans[number][8]
                marks = restarts[np.searchsorted(restarts, a) : np.searchsorted(restarts, b)]
                starts.append(np.append(a, marks + 2))
                if len(comps) > 1:
                    n = x.across * x.down
                    places.append([x.mcu_blocks(c) for c in comps])
                else:
                    c = comps[0]
                    h, v = factors[c]
                    hmax, vmax = max(f[0] for f in factors), max(f[1] for f in factors)
                    rows, cols = -(-p.height * v // (8 * vmax)), -(-p.width * h // (8 * hmax))  # blocks that hold samples
                    n = rows * cols
                    places.append([(x.first[c] + np.arange(rows)[:, None] * x.shape(c)[1] + np.arange(cols)).reshape(-1, 1)])
                per = restart or n
                units.append(np.minimum(per, n - per * np.arange(len(marks) + 1)))
            at = squeeze(np.concatenate(starts)).astype(np.int64) * 8
            counts = np.concatenate(units)
            where = [np.concatenate([p[k] for p in places]) for k in range(len(comps))]
            if first == 0:
                dc_scan(source, [lookup(t[0]) if t[0] else None for t in picks], at, where, [coefs[c] for c in comps], int(counts.max()), counts, high, low)
                continue
            # AC scans have one component; its blocks are gathered so that an interval's are consecutive
            line = where[0].ravel()
            part = coefs[comps[0]][line]
            begin = np.cumsum(counts) - counts
            (ac_refine if high else ac_first)(source, lookup(picks[0][1]), at, begin, counts, part, first, last, low)
            coefs[comps[0]][line] = part
        for i in members:
            x = parsed[i].layout
            out[i] = (parsed[i], [coefs[c][x.first[c] : x.first[c] + x.shape(c)[0] * x.shape(c)[1]].reshape(*x.shape(c), 64) for c in range(len(factors))])
    return out


#: the inverse transform scaled to integers, so that sums are exact in float64 and do not depend on their order
_SCALE = 1 << 20
_u = np.arange(8)
_C = np.cos((2 * np.arange(8)[:, None] + 1) * _u * np.pi / 16) * np.where(_u == 0, np.sqrt(1 / 8), 0.5)
_BASIS = np.rint(np.einsum("yv,xu->vuyx", _C, _C).reshape(64, 64)[ZIGZAG] * _SCALE)


def samples(coefs: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """8-bit samples (rows*8, columns*8) of a component."""
    rows, cols = coefs.shape[:2]
    pixels = (coefs.reshape(-1, 64) * quant).astype(np.float64) @ _BASIS
    pixels = np.clip(np.floor((pixels + _SCALE / 2) / _SCALE) + 128, 0, 255)
    return pixels.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)


def to_rgb(parsed: Parsed, coefs: list[np.ndarray]) -> np.ndarray:
    """Full-resolution RGB tensor (height, width, 3): chroma is repeated to the luma grid, colours by the JFIF matrix in integers."""
    hmax, vmax = max(f[0] for f in parsed.layout.factors), max(f[1] for f in parsed.layout.factors)
    planes = []
    for c, (h, v) in enumerate(parsed.layout.factors):
        plane = samples(coefs[c], parsed.quant[c]).astype(np.int32)
        planes.append(plane.repeat(vmax // v, axis=0).repeat(hmax // h, axis=1)[: parsed.height, : parsed.width])
    if len(planes) == 1:
        planes = [planes[0]] * 3
        return np.stack(planes, axis=-1).astype(np.uint8)
    y, cb, cr = planes[0] << 16, planes[1] - 128, planes[2] - 128
    half = 1 << 15
    rgb = [(y + 91881 * cr + half) >> 16, (y - 22554 * cb - 46802 * cr + half) >> 16, (y + 116130 * cb + half) >> 16]
    return np.clip(np.stack(rgb, axis=-1), 0, 255).astype(np.uint8)


def store_bytes(payloads: list[bytes], sampling: tuple[int, int] = SAMPLING) -> list[bytes]:
    """A file per payload with every byte (less 128) as one quantised coefficient; the rest of the last MCUs is zero. The comment has the payload's length."""
    per = sampling[0] * sampling[1]
    coefs = []
    for p in payloads:
        across, down = layout_of(-(-len(p) // 64), sampling)
        n = across * down * (per + 2) * 64
        flat = np.zeros(n, np.int16)
        flat[: len(p)] = np.frombuffer(p, np.uint8).astype(np.int16) - 128
        flat = flat.reshape(-1, 64)
        a = across * down * per
        coefs.append([flat[:a].reshape(down * sampling[1], across * sampling[0], 64), flat[a : a + across * down].reshape(down, across, 64), flat[a + across * down :].reshape(down, across, 64)])
    return encode(coefs, [struct.pack(">Q", len(p)) for p in payloads], sampling)


def load_bytes(parsed: Parsed, coefs: list[np.ndarray]) -> bytes:
    """The payload of ``store_bytes``."""
    flat = np.concatenate([c.reshape(-1) for c in coefs])
    return (flat[: struct.unpack(">Q", parsed.comment)[0]] + 128).astype(np.uint8).tobytes()


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id_col, n_bytes, media). The payload is the text in UTF-8, with blanks up to a positive multiple of 192.

    Null text is empty, which is one unit of blanks. Rows are independent; equal texts have equal media."""

    def run(batches):
        for pdf in batches:
            chunk = (pdf["_text"].str.len() + PAYLOAD_UNIT).cumsum() // CHUNK
            for _, part in pdf.groupby(chunk, sort=False):
                raw = [t.encode("utf-8", "replace") for t in part["_text"]]
                padded = [r + b" " * (max(1, -(-len(r) // PAYLOAD_UNIT)) * PAYLOAD_UNIT - len(r)) for r in raw]
                yield pd.DataFrame({id_col: part[id_col], "n_bytes": [len(r) for r in raw], "media": store_bytes(padded)})

    rows = docs.select(id_col, text_or_empty(text_col).alias("_text"))
    return rows.mapInPandas(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, n_bytes long, media binary")


def read_media(media: DataFrame, id_col: str = "doc_id", tensors: bool = False) -> DataFrame:
    """(id_col, n_bytes, payload, media, feature[, height, width, rgb]) from stored files. ``feature`` is the size and the sums of the colours over the RGB tensor;
    with ``tensors`` the tensor itself is returned as bytes, row by row."""

    def run(batches):
        for pdf in batches:
            chunk = pdf["media"].map(len).cumsum() // (2 * CHUNK)
            for _, part in pdf.groupby(chunk, sort=False):
                rows = []
                for parsed, coefs in decode(part["media"].tolist()):
                    rgb = to_rgb(parsed, coefs)
                    sums = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64)
                    row = (load_bytes(parsed, coefs), f"{parsed.width}x{parsed.height}:" + ",".join(map(str, sums.tolist())))
                    rows.append(row + ((rgb.shape[0], rgb.shape[1], rgb.tobytes()) if tensors else ()))
                names = ["payload", "feature"] + (["height", "width", "rgb"] if tensors else [])
                got = pd.DataFrame(rows, columns=names, index=part.index)
                yield pd.concat([part[[id_col, "n_bytes"]], got[["payload"]], part[["media"]], got[names[1:]]], axis=1)

    extra = ", height int, width int, rgb binary" if tensors else ""
    return media.select(id_col, "n_bytes", "media").mapInPandas(run, f"`{id_col}` {dict(media.dtypes)[id_col]}, n_bytes long, payload binary, media binary, feature string{extra}")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = read_media(media_column(table(spark, sf_dir, "documents")))
    size = F.octet_length("payload")
    return back.select("doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature")


QUERIES = {"op3_media": op3_media}
ORACLES: dict[str, str] = {}
