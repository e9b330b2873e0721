"""Media columns: progressive JPEG.

Decoding accumulates spectral-selection and successive-approximation scans into coefficient arrays, inverse-transforms them in
numpy, upsamples chroma and gives full-resolution RGB tensors. All images of a chunk are decoded together: every restart
interval of every scan is a lane, and the lanes advance one Huffman symbol (AC), one block (refinement, DC) at a time in numpy.
Scans of one kind that follow each other and touch different coefficients run side by side.

Storing: a payload of whole 192-byte units becomes an image with chroma subsampled by two in both directions. Two units are one MCU of
16 x 16 pixels: their bytes, less 128, are the quantised coefficients in zigzag order of four blocks of Y and one of Cb and Cr (the
format keeps coefficients without loss), written as one DC scan, two AC bands a component with the lowest bit held back, and
refinement scans for that bit. A comment segment holds the number of units; a missing second unit is zeros.

Edge cases: null and empty texts are one unit of blanks; empty payloads are not images and raise ValueError; a
null medium gives null tensors; streams that are not progressive JPEG raise ValueError; copies give equal bytes; images are as
high as 4,095 MCUs, then more columns are used, so texts may be as long as Spark's strings. Texts and streams of the stored form over
a megabyte are written and read in strips of rows, cut where the restart markers of all scans begin their cycle anew: the bytes are
those of one picture, and beside the row's own values the work takes memory for one strip.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_udf, raw, tune, without

UNIT, ROWS_MOST, INTERVAL = 192, 4095, 4
#: MCUs of a strip; its rows are a multiple of 32, eight restart intervals of a column.
STRIP = 2048
#: Sampling of the stored images: (horizontal, vertical) of Y, Cb and Cr.
SAMPLING = ((2, 2), (1, 1), (1, 1))
CHUNK = 1 << 20

_ORDER = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
#: Natural position of each zigzag position.
ZIGZAG = np.array(_ORDER)
_EOB = [r << 4 for r in range(15)]


# ---- Huffman tables -------------------------------------------------------------------------------------------------------

def _table(groups: list[tuple[int, list[int]]]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A canonical table from (code length, symbols): its DHT body, and code and length of each symbol."""
    bits, values, code, length = [0] * 16, [], np.zeros(256, np.uint32), np.zeros(256, np.int64)
    at, last = 0, 0
    for n, symbols in groups:
        at <<= n - last
        for s in symbols:
            code[s], length[s] = at, n
            at += 1
        bits[n - 1], last = len(symbols), n
        values += symbols
    return bytes(bits) + bytes(values), code, length


DC_TABLE = _table([(4, list(range(12)))])
_COMMON = [0x04, 0x06, 0x03, 0x05, 0x02, 0x07, 0x01, 0x00]
AC_TABLE = _table([(1, [0x04]), (2, [0x06]), (3, [0x03]), (5, [0x05, 0x02]), (6, [0x07, 0x01]), (7, [0x00]), (13, [s for s in sorted([*_EOB, 0xF0, *(r << 4 | n for r in range(16) for n in range(1, 11))]) if s not in _COMMON])])
REFINE_TABLE = _table([(1, [0x00]), (6, [*_EOB[1:], 0xF0, *(r << 4 | 1 for r in range(16))])])


def lookup(body: bytes) -> np.ndarray:
    """For every 16 bits that follow: length << 8 | symbol of the code that they begin with (0: none)."""
    out, at, k = np.zeros(1 << 16, np.uint16), 0, 16
    for n in range(1, 17):
        for _ in range(body[n - 1]):
            out[at : at + (1 << (16 - n))] = n << 8 | body[k]
            at += 1 << (16 - n)
            k += 1
    return out


# ---- Writing --------------------------------------------------------------------------------------------------------------

def _sizes(v: np.ndarray) -> np.ndarray:
    """Bits of |v|, for |v| < 2048."""
    return _BIT_LENGTH[np.abs(v)]


_BIT_LENGTH = np.array([i.bit_length() for i in range(2049)])


def _packed(value: np.ndarray, length: np.ndarray, lane: np.ndarray, lanes: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenates bit strings (value, length up to 32; ordered by lane) to byte-aligned lanes, ends them with ones, stuffs zeros
    after 0xFF and puts restart markers between the lanes of a picture. first: whether a lane begins a picture. Returns
    the bytes and where every lane (with the marker before it) begins."""
    bits = np.bincount(lane, length, lanes).astype(np.int64)
    pad = -bits % 8
    start = np.cumsum((bits + pad) // 8) - (bits + pad) // 8
    done = np.cumsum(length) - length
    base = np.zeros(lanes, np.int64)
    head = np.flatnonzero(np.r_[True, lane[1:] != lane[:-1]]) if len(lane) else np.zeros(0, np.int64)
    base[lane[head]] = done[head]
    at = start[lane] * 8 + done - base[lane]
    at, value, length = np.concatenate([at, start * 8 + bits]), np.concatenate([value.astype(np.uint64), (np.uint64(1) << pad.astype(np.uint64)) - np.uint64(1)]), np.concatenate([length, pad])
    total = int(start[-1] * 8 + bits[-1] + pad[-1]) if lanes else 0
    words = np.zeros((total + 63) // 32 + 1, np.float64)
    shifted = value << (64 - (at & 31) - length).astype(np.uint64) % np.uint64(64)
    word = at >> 5
    words += np.bincount(word, (shifted >> np.uint64(32)).astype(np.float64), len(words))
    words[1:] += np.bincount(word, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), len(words))[:-1]
    data = words.astype(np.uint64).astype(">u4").view(np.uint8)[: total // 8]
    full = data == 255
    before = np.cumsum(full) - full
    mark = np.where(first, 0, 2)
    marks = np.cumsum(mark)
    ends = np.append(start[1:], len(data))
    shift = before + np.repeat(marks, ends - start)
    extra = int(full.sum())
    out = np.zeros(len(data) + extra + int(marks[-1] if lanes else 0), np.uint8)
    out[np.arange(len(data)) + shift] = data
    stuffed = np.append(before, extra)[start]
    begin = start + stuffed + marks - mark
    number = np.arange(lanes) - np.maximum.accumulate(np.where(first, np.arange(lanes), 0))
    rest = np.flatnonzero(~first)
    out[begin[rest]], out[begin[rest] + 1] = 255, 0xD0 + (number[rest] - 1) % 8
    return out, begin


def _ac_first(v: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value, length and row of the bit strings of zigzag coefficients lo..hi of blocks (rows of v), EOB after each block."""
    _, code, bits = AC_TABLE
    band = v[:, lo : hi + 1]
    row, col = np.nonzero(band)
    x = band[row, col]
    new = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
    run = col - np.where(new, -1, np.r_[0, col[:-1]]) - 1
    size = _sizes(x)
    symbol = (run & 15) << 4 | size
    value = code[symbol].astype(np.uint64) << size.astype(np.uint64) | (np.where(x < 0, x - 1, x) & ((1 << size) - 1)).astype(np.uint64)
    length = bits[symbol] + size
    last = np.full(len(v), -1)
    last[row] = col
    ended = last < hi - lo
    zrl = run >> 4
    tokens = np.bincount(row, zrl + 1, len(v)).astype(np.int64) + ended
    base = np.cumsum(tokens) - tokens
    n = int(tokens.sum())
    out_value, out_length = np.full(n, code[0xF0], np.uint64), np.full(n, bits[0xF0], np.int64)
    taken = np.cumsum(zrl + 1)
    before = np.zeros(len(v), np.int64)
    before[row[new]] = (taken - zrl - 1)[new]
    at = base[row] + taken - 1 - before[row]
    out_value[at], out_length[at] = value, length
    end = (base + tokens - 1)[ended]
    out_value[end], out_length[end] = code[0], bits[0]
    return out_value, out_length, np.repeat(np.arange(len(v)), tokens)


def _ac_refine(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit strings that add the lowest bit of zigzag coefficients 1..63."""
    _, code, bits = REFINE_TABLE
    band = np.abs(v[:, 1:])
    low = (band & 1).astype(np.uint64)
    plain = (band >= 2).all(1)
    # 1 + 3 bit strings: the end of the block, and its 63 correction bits
    parts = (low.reshape(len(v), 3, 21) << np.arange(20, -1, -1, dtype=np.uint64)).sum(2, dtype=np.uint64)
    value = np.column_stack([np.full(len(v), code[0], np.uint64), parts])
    length = np.tile(np.array([bits[0], 21, 21, 21]), (len(v), 1))
    if plain.all():
        return value.ravel(), length.ravel(), np.repeat(np.arange(len(v)), 4)
    odd = np.flatnonzero(~plain)
    code_value, code_length, code_row = _refine_tokens(v[odd, 1:], code, bits)
    count = np.where(plain, 4, 0)
    count[odd] = np.bincount(code_row, minlength=len(odd))
    base = np.cumsum(count) - count
    out_value, out_length = np.zeros(int(count.sum()), np.uint64), np.zeros(int(count.sum()), np.int64)
    at = (base[plain][:, None] + np.arange(4)).ravel()
    out_value[at], out_length[at] = value[plain].ravel(), length[plain].ravel()
    at = base[odd][code_row] + np.arange(len(code_row)) - (np.cumsum(count[odd]) - count[odd])[code_row]
    out_value[at], out_length[at] = code_value, code_length
    return out_value, out_length, np.repeat(np.arange(len(v)), count)


def _refine_tokens(band: np.ndarray, code: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value, length and row of the bit strings of blocks with zeros or fresh coefficients (those whose first bit this scan adds).

    A fresh coefficient is a code with the zeros before it, a sign, and the correction bits of older coefficients passed since the last
    code. Sixteen zeros too many are a code of their own before the next coefficient, and the end of the block is one."""
    n = np.abs(band)
    row, col = np.nonzero(n)
    index, begin = np.arange(len(row)), np.searchsorted(row, row)
    fresh, opens = n[row, col] == 1, begin == index
    zeros = col - (index - begin)  # zeros of the block before each coefficient
    last = np.r_[-1, np.maximum.accumulate(np.where(fresh, index, -1))][:-1]
    run = zeros - np.where(last >= begin, zeros[last], 0)  # those since the last fresh one
    before = np.where(opens | np.r_[False, fresh][:-1], 0, np.r_[0, run][:-1])
    end = np.full(len(n), -1)
    end[row[fresh]] = col[fresh]
    long_runs = np.where(col <= end[row], run // 16 - before // 16, 0)
    ended = n[:, -1] != 1
    # codes in order: those of each coefficient, then that of the block's end
    per = long_runs + fresh
    per_row = np.bincount(row, per, len(n)).astype(np.int64) + ended
    first_code = np.cumsum(per_row) - per_row
    done = np.cumsum(per) - per
    at = first_code[row] + done - done[begin]
    total = int(per_row.sum())
    symbol = np.full(total, 0xF0)
    own = at[fresh] + long_runs[fresh]
    symbol[own] = (run[fresh] & 15) << 4 | 1
    symbol[(first_code + per_row - 1)[ended]] = 0
    code_row = np.repeat(np.arange(len(n)), per_row)
    old = ~fresh
    # an older coefficient's bit follows the next code after it
    after = (at + long_runs)[old]
    value = np.concatenate([code[symbol].astype(np.uint64), (band[row, col][fresh] > 0).astype(np.uint64), (n[row, col][old] & 1).astype(np.uint64)])
    length = np.concatenate([bits[symbol], np.ones(len(row), np.int64)])
    of = np.concatenate([code_row, row[fresh], row[old]])
    order = np.argsort(np.concatenate([np.arange(total) * 3, own * 3 + 1, after * 3 + 2]), kind="stable")
    return value[order], length[order], of[order]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def _scan_header(components: list[int], dc: int, ac: int, lo: int, hi: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(components), *(x for c in components for x in (c, dc << 4 | ac)), lo, hi, high << 4 | low]))


_FIXED = b"".join([_segment(0xDB, bytes([0]) + bytes([1] * 64)), _segment(0xC4, b"".join(bytes([kind]) + t[0] for kind, t in ((0x00, DC_TABLE), (0x10, AC_TABLE), (0x11, REFINE_TABLE)))), _segment(0xDD, struct.pack(">H", INTERVAL))])


def shape(mcus: int) -> tuple[int, int]:
    """MCU rows and columns of the picture of a payload."""
    columns = -(-mcus // ROWS_MOST)
    return -(-mcus // columns), columns


@lru_cache(maxsize=64)
def _raster(rows: int, columns: int) -> np.ndarray:
    """Place among the Y blocks, row by row, of the four Y blocks of each MCU."""
    r, c = np.divmod(np.arange(rows * columns), columns)
    return np.stack([(2 * r + i) * 2 * columns + 2 * c + j for i in (0, 1) for j in (0, 1)], 1)


class _Lanes:
    """Restart intervals of a scan: ``counts`` are its MCUs in each picture."""

    def __init__(self, counts: np.ndarray) -> None:
        base = np.cumsum(counts) - counts
        within = np.arange(int(counts.sum())) - np.repeat(base, counts)
        self.opens = within % INTERVAL == 0
        self.lane = np.cumsum(self.opens) - 1
        self.count = int(self.lane[-1]) + 1
        self.first = within[self.opens] == 0
        self.of_picture = np.append(self.lane[base], self.count)


def _strip_rows(columns: int) -> int:
    return max(32, STRIP // columns // 32 * 32)


def _units(payload: bytes) -> int:
    if not payload or len(payload) % UNIT:
        raise ValueError("a payload is a positive number of 192-byte units")
    return len(payload) // UNIT


def _scans(payloads: list[bytes], shapes: list[tuple[int, int]]) -> list[tuple[bytes, np.ndarray, np.ndarray]]:
    """Header and entropy-coded data of every scan of pictures of these MCU rows and columns, and where each picture's data begin."""
    units = np.array([len(p) // UNIT for p in payloads])
    mcus = np.array([r * c for r, c in shapes])
    base = np.cumsum(mcus) - mcus
    total = int(mcus.sum())
    coefficients = np.zeros((2 * total, UNIT), np.int32)
    where = np.arange(int(units.sum())) + np.repeat(2 * base - (np.cumsum(units) - units), units)
    coefficients[where] = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT).astype(np.int32) - 128
    coefficients = coefficients.reshape(total, 6, 64)
    luma = coefficients[:, :4].reshape(-1, 64)
    for (rows, columns), at in zip(shapes, base):
        if columns > 1:
            own = luma[4 * at : 4 * at + 4 * rows * columns].copy()
            luma[4 * at + _raster(rows, columns).ravel()] = own
    together, bright, plain = _Lanes(mcus), _Lanes(4 * mcus), _Lanes(mcus)
    scans: list[tuple[bytes, np.ndarray, np.ndarray]] = []

    def add(header: bytes, value: np.ndarray, length: np.ndarray, lanes: _Lanes, mcu: np.ndarray) -> None:
        data, begin = _packed(value, length, lanes.lane[mcu], lanes.count, lanes.first)
        scans.append((header, data, np.append(begin, len(data))[lanes.of_picture]))

    dc = coefficients[:, :, 0] >> 1
    x = dc.copy()
    x[:, 1:4] -= dc[:, :3]
    for own, last in ((0, 3), (4, 4), (5, 5)):
        before = np.r_[0, dc[:-1, last]]
        before[together.opens] = 0
        x[:, own] -= before
    x, each = x.ravel(), np.repeat(np.arange(total), 6)
    size = _sizes(x)
    add(_scan_header([1, 2, 3], 0, 0, 0, 0, 0, 1), DC_TABLE[1][size].astype(np.uint64) << size.astype(np.uint64) | (np.where(x < 0, x - 1, x) & ((1 << size) - 1)).astype(np.uint64), DC_TABLE[2][size] + size, together, each)
    parts = [(luma, bright), (coefficients[:, 4], plain), (coefficients[:, 5], plain)]
    for c, (v, lanes) in enumerate(parts):
        half = np.sign(v) * (np.abs(v) >> 1)
        for lo, hi in ((1, 8), (9, 63)):
            value, length, row = _ac_first(half, lo, hi)
            add(_scan_header([c + 1], 0, 0, lo, hi, 0, 1), value, length, lanes, row)
    add(_scan_header([1, 2, 3], 0, 0, 0, 0, 1, 0), (coefficients[:, :, 0] & 1).ravel().astype(np.uint64), np.ones(total * 6, np.int64), together, each)
    for c, (v, lanes) in enumerate(parts):
        value, length, row = _ac_refine(v)
        add(_scan_header([c + 1], 0, 1, 1, 63, 1, 0), value, length, lanes, row)
    return scans


def _stream(units: int, rows: int, columns: int, scans: list[bytes]) -> bytes:
    """The stream of one picture from its scans, headers included."""
    frame = _segment(0xC2, struct.pack(">BHHB", 8, rows * 16, columns * 16, 3) + bytes(x for k, (h, v) in enumerate(SAMPLING) for x in (k + 1, h << 4 | v, 0)))
    return b"".join([b"\xff\xd8", _segment(0xFE, struct.pack(">Q", units)), _FIXED, frame, *scans, b"\xff\xd9"])


def write(payloads: list[bytes]) -> list[bytes]:
    """Progressive JPEG streams of payloads of whole units."""
    if not payloads:
        return []
    units = [_units(p) for p in payloads]
    shapes = [shape(-(-u // 2)) for u in units]
    scans = _scans(payloads, shapes)
    return [_stream(u, *shapes[i], [x for header, data, at in scans for x in (header, data[at[i] : at[i + 1]].tobytes())]) for i, u in enumerate(units)]


def write_long(payload: bytes) -> bytes:
    """The stream that write() gives for one payload, made a strip at a time."""
    units = _units(payload)
    rows, columns = shape(-(-units // 2))
    step, scans = _strip_rows(columns), []
    for lo in range(0, rows, step):
        own = min(step, rows - lo)
        for k, (header, data, _) in enumerate(_scans([payload[lo * columns * 2 * UNIT : (lo + own) * columns * 2 * UNIT]], [(own, columns)])):
            if not lo:
                scans.append([header])
            scans[k].append(b"\xff\xd7" * bool(lo) + data.tobytes())
    return _stream(units, rows, columns, [x for s in scans for x in s])


# ---- Reading --------------------------------------------------------------------------------------------------------------

class _Picture:
    """Frame of one image: components with sampling, quantisation, and their place in the coefficient array."""

    def __init__(self) -> None:
        self.quant: dict[int, np.ndarray] = {}
        self.tables: dict[int, bytes] = {}
        self.interval, self.comment, self.components, self.named, self.base = 0, b"", [], {}, 0

    def frame(self, body: bytes) -> None:
        precision, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if precision != 8 or n not in (1, 3) or not self.height or not self.width:
            raise ValueError("only 8-bit images of one or three components are read")
        parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        self.hmax, self.vmax = max(p[1] for p in parts), max(p[2] for p in parts)
        self.mcus = -(-self.height // (8 * self.vmax)), -(-self.width // (8 * self.hmax))
        at = 0
        for name, h, v, q in parts:
            rows, columns = self.mcus[0] * v, self.mcus[1] * h
            seen = -(-(-(-self.height * v // self.vmax)) // 8), -(-(-(-self.width * h // self.hmax)) // 8)
            self.components.append({"name": name, "h": h, "v": v, "q": q, "rows": rows, "columns": columns, "base": at, "key": (at, columns, v, h, *seen)})
            self.named.setdefault(name, self.components[-1])
            at += rows * columns
        self.blocks = at

    def of_rows(self, rows: int) -> _Picture:
        """A picture like this one with so many rows of MCUs."""
        p = _Picture()
        p.quant, p.tables, p.interval = self.quant, self.tables, self.interval
        p.frame(struct.pack(">BHHB", 8, rows * 8 * self.vmax, self.width, len(self.components)) + bytes(x for c in self.components for x in (c["name"], c["h"] << 4 | c["v"], c["q"])))
        return p


@lru_cache(maxsize=256)
def _quant_tables(body: bytes) -> dict[int, np.ndarray]:
    out, k = {}, 0
    while k < len(body):
        wide = body[k] >> 4
        table = np.zeros(64, np.int64)
        table[ZIGZAG] = np.frombuffer(body[k + 1 : k + 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8)
        out[body[k] & 15] = table
        k += 65 + 64 * wide
    return out


@lru_cache(maxsize=256)
def _huffman_tables(body: bytes) -> dict[int, bytes]:
    out, k = {}, 0
    while k < len(body):
        size = 17 + sum(body[k + 1 : k + 17])
        out[body[k]] = body[k + 1 : k + size]
        k += size
    return out


def _parsed(data: bytes, offset: int, entropy_end) -> tuple[_Picture, list[dict]]:
    """Segments of one stream that begins at ``offset`` of the chunk. entropy_end(position): where the entropy-coded data from there
    end (the next marker other than a restart)."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG stream")
    p, scans, at = _Picture(), [], 2
    while True:
        while data[at] == 255 and data[at + 1] == 255:
            at += 1
        marker = data[at + 1]
        if marker == 0xD9:
            return p, scans
        n = data[at + 2] << 8 | data[at + 3]
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xC2:
            p.frame(body)
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not a progressive JPEG stream")
        elif marker == 0xFE:
            p.comment = body
        elif marker == 0xDD:
            p.interval = body[0] << 8 | body[1]
        elif marker == 0xDB:
            p.quant.update(_quant_tables(body))
        elif marker == 0xC4:
            p.tables.update(_huffman_tables(body))
        elif marker == 0xDA:
            n = body[0]
            parts = [p.named[body[1 + 2 * k]] for k in range(n)]
            lo, hi, both = body[1 + 2 * n : 4 + 2 * n]
            ids = [body[2 + 2 * k] for k in range(n)]
            end = entropy_end(offset + at) - offset
            scans.append({"parts": parts, "lo": lo, "hi": hi, "high": both >> 4, "low": both & 15, "dc": [p.tables.get(i >> 4) for i in ids], "ac": p.tables.get(16 | ids[0] & 15), "begin": offset + at, "end": offset + end, "interval": p.interval})
            at = end


class _Bits:
    """Destuffed bytes of a chunk, readable at any bit."""

    def __init__(self, data: np.ndarray) -> None:
        drop = np.zeros(len(data), bool)
        drop[1:] = (data[:-1] == 255) & (data[1:] == 0)
        self.moved = np.arange(len(data) + 1) - np.concatenate([[0], np.cumsum(drop)])
        b = np.concatenate([data[~drop], np.zeros(8, np.uint8)]).astype(np.uint32)
        self.words = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]

    def peek(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """n (up to 25) bits at bit positions, as signed integers."""
        return (self.words[at >> 3].astype(np.int64) >> (32 - (at & 7) - n)) & ((1 << n) - 1)


def _extend(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < (1 << np.maximum(size - 1, 0)), v - (1 << size) + 1, v)


class _Tables:
    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.looked: list[np.ndarray] = []

    def of(self, body: bytes | None) -> int:
        if body is None:
            return 0
        if body not in self.number:
            self.number[body] = len(self.looked)
            self.looked.append(lookup(body))
        return self.number[body]

    def all(self) -> np.ndarray:
        return np.concatenate(self.looked) if self.looked else np.zeros(1 << 16, np.uint16)


@lru_cache(maxsize=2048)
def _layout(parts: tuple[tuple[int, ...], ...], mcus: tuple[int, int], interval: int) -> tuple[np.ndarray, ...]:
    """Blocks of a scan in order (counted from the picture's first), the component of each, and first block and number of blocks
    of each restart interval. parts: base, columns, v, h, rows and columns seen, of each component."""
    if len(parts) == 1:
        base, width, _, _, rows, columns = parts[0]
        t = np.arange(rows * columns)
        slots, component, per = base + t // columns * width + t % columns, np.zeros(rows * columns, np.int64), 1
    else:
        t = np.arange(mcus[0] * mcus[1])
        y, x = t // mcus[1], t % mcus[1]
        each = [(k, base + (y * v + i) * width + x * h + j) for k, (base, width, v, h, _, _) in enumerate(parts) for i in range(v) for j in range(h)]
        slots, component, per = np.stack([e for _, e in each], 1).ravel(), np.tile([k for k, _ in each], len(t)), len(each)
    step = interval * per if interval else len(slots)
    first = np.arange(0, len(slots), step)
    return slots, component, first, np.minimum(step, len(slots) - first)


def _joined(phase: list[tuple[dict, _Picture]], restarts: np.ndarray, bits: _Bits) -> dict:
    """Lanes of several scans side by side: first bit, first block and number of blocks of each lane, and its scan's numbers."""
    layouts = [_layout(tuple(c["key"] for c in s["parts"]), p.mcus, s["interval"]) for s, p in phase]
    each, blocks = np.array([len(x[2]) for x in layouts]), np.array([len(x[0]) for x in layouts])
    begin, end = np.array([s["begin"] for s, _ in phase]), np.array([s["end"] for s, _ in phase])
    lo = np.searchsorted(restarts, begin)
    if (np.searchsorted(restarts, end) - lo + 1 != each)[each > 1].any():
        raise ValueError("restart markers do not match the interval")
    scan = np.repeat(np.arange(len(phase)), each)
    within = np.arange(len(scan)) - np.repeat(np.cumsum(each) - each, each)
    start = begin[scan]
    rest = np.flatnonzero(within)
    start[rest] = restarts[lo[scan[rest]] + within[rest] - 1] + 2
    out: dict = {"at": bits.moved[start] * 8, "scan": scan, "component": [x[1] for x in layouts]}
    out["slots"] = np.concatenate([x[0] for x in layouts]) + np.repeat([p.base for _, p in phase], blocks)
    out["first"] = np.concatenate([x[2] for x in layouts]) + (np.cumsum(blocks) - blocks)[scan]
    out["count"] = np.concatenate([x[3] for x in layouts])
    for k in ("lo", "hi", "low"):
        out[k] = np.array([s[k] for s, _ in phase])[scan]
    return out


def _read_dc_first(scans, restarts: np.ndarray, bits: _Bits, tables: _Tables, out: np.ndarray) -> None:
    x = _joined(scans, restarts, bits)
    table_of = np.zeros((len(scans), 4), np.int64)
    for k, (s, _) in enumerate(scans):
        table_of[k, : len(s["dc"])] = [tables.of(t) for t in s["dc"]]
    looked, component = tables.all(), np.concatenate(x["component"])
    at, last = x["at"], np.zeros((len(x["at"]), 4), np.int64)
    for t in range(int(x["count"].max())):
        lane = np.flatnonzero(x["count"] > t)
        slot = x["first"][lane] + t
        c = component[slot]
        code = looked[table_of[x["scan"][lane], c] << 16 | bits.peek(at[lane], 16)].astype(np.int64)
        size, p = code & 255, at[lane] + (code >> 8)
        last[lane, c] += np.where(size > 0, _extend(bits.peek(p, size), size), 0)
        at[lane] = p + size
        out[x["slots"][slot], 0] = last[lane, c] << x["low"][lane]


def _read_dc_refine(scans, restarts: np.ndarray, bits: _Bits, tables: _Tables, out: np.ndarray) -> None:
    x = _joined(scans, restarts, bits)
    n = x["count"]
    lane = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(lane)) - np.repeat(np.cumsum(n) - n, n)
    slot = x["slots"][x["first"][lane] + within]
    out[slot, 0] |= bits.peek(x["at"][lane] + within, 1) << x["low"][lane]


def _read_ac_first(scans, restarts: np.ndarray, bits: _Bits, tables: _Tables, out: np.ndarray) -> None:
    x = _joined(scans, restarts, bits)
    table = np.array([tables.of(s["ac"]) for s, _ in scans])[x["scan"]] << 16
    looked, flat, slots, words = tables.all(), out.reshape(-1), x["slots"], bits.words
    at, slot, end, k = x["at"], x["first"].copy(), x["first"] + x["count"], x["lo"].copy()
    lo, hi, low = x["lo"], x["hi"], x["low"]
    while len(at):
        code = looked[table | ((words[at >> 3] >> (16 - (at & 7)).astype(np.uint32)) & np.uint32(0xFFFF))].astype(np.int64)
        size, run = code & 15, (code >> 4) & 15
        at = at + (code >> 8)
        more = np.where(size == 0, np.where(run < 15, run, 0), size)
        v = (words[at >> 3].astype(np.int64) >> (32 - (at & 7) - more)) & ((1 << more) - 1)
        at += more
        k += run
        real = size > 0
        if real.all():
            flat[slots[slot] << 6 | k] = _extend(v, size) << low
        else:
            i = np.flatnonzero(real)
            flat[slots[slot[i]] << 6 | k[i]] = _extend(v[i], size[i]) << low[i]
            ended = ~real & (run < 15)
            slot += np.where(ended, (1 << run) + v - 1, 0)
            k = np.where(ended, hi, k)
        k += 1
        over = k > hi
        if over.any():
            slot += over
            k = np.where(over, lo, k)
            live = slot < end
            if not live.all():
                at, slot, end, k, lo, hi, low, table = (y[live] for y in (at, slot, end, k, lo, hi, low, table))


def _read_ac_refine(scans, restarts: np.ndarray, bits: _Bits, tables: _Tables, out: np.ndarray) -> None:
    x = _joined(scans, restarts, bits)
    table = np.array([tables.of(s["ac"]) for s, _ in scans])[x["scan"]] << 16
    looked, slots, place = tables.all(), x["slots"], np.arange(64)
    at, slot, end, k = x["at"], x["first"].copy(), x["first"] + x["count"], x["lo"].copy()
    lo, hi, bit = x["lo"], x["hi"], 1 << x["low"]
    run_left = np.zeros(len(at), np.int64)

    def corrected(i: np.ndarray, block: np.ndarray, mask: np.ndarray) -> None:
        """Reads a bit for each coefficient in mask, in order, and adds it to those that have one of the lowest bit missing."""
        rank = np.cumsum(mask, 1) - 1
        row, col = np.nonzero(mask)
        got = bits.peek(at[i][row] + rank[row, col], 1) == 1
        row, col = row[got], col[got]
        v = out[block[row], col]
        b = bit[i][row]
        out[block[row], col] = np.where(np.abs(v) & b, v, v + np.sign(v) * b)
        at[i] += mask.sum(1)

    while len(at):
        n = len(at)
        i = np.flatnonzero(run_left == 0)
        fresh, target = np.zeros(n, np.int64), np.full(n, 64)
        if len(i):
            code = looked[table[i] | bits.peek(at[i], 16)].astype(np.int64)
            size, run = code & 15, (code >> 4) & 15
            at[i] += code >> 8
            eob = (size == 0) & (run < 15)
            more = np.where(eob, run, size)
            v = bits.peek(at[i], more)
            at[i] += more
            run_left[i[eob]] = (1 << run[eob]) + v[eob]
            w = i[~eob]
            if len(w):
                zeros = (out[slots[slot[w]]] == 0) & (place >= k[w, None]) & (place <= hi[w, None])
                reached = np.cumsum(zeros, 1) == run[~eob][:, None] + 1
                target[w] = np.where(reached.any(1), reached.argmax(1), hi[w] + 1)
                fresh[w] = np.where(size[~eob] == 1, np.where(v[~eob] == 1, bit[w], -bit[w]), 0)
        block = slots[slot]
        mask = (out[block] != 0) & (place >= k[:, None]) & (place <= hi[:, None]) & (place < target[:, None])
        corrected(np.arange(n), block, mask)
        put = np.flatnonzero((fresh != 0) & (target <= hi))
        out[block[put], target[put]] = fresh[put]
        k = np.minimum(target, hi) + 1
        k[run_left > 0] = hi[run_left > 0] + 1
        run_left = np.maximum(run_left - 1, 0)
        over = k > hi
        slot = slot + over
        k = np.where(over, lo, k)
        live = slot < end
        if not live.all():
            at, slot, end, k, lo, hi, bit, table, run_left = (y[live] for y in (at, slot, end, k, lo, hi, bit, table, run_left))


_READERS = {(True, True): _read_dc_first, (True, False): _read_dc_refine, (False, True): _read_ac_first, (False, False): _read_ac_refine}


def _markers(data: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Places of restart markers and of all others."""
    mark = np.flatnonzero((data[:-1] == 255) & (data[1:] != 0) & (data[1:] != 255))
    kind = data[mark + 1]
    restart = (kind >= 0xD0) & (kind <= 0xD7)
    return mark[restart], mark[~restart].tolist()


def read(streams: list[bytes]) -> tuple[list[_Picture], np.ndarray]:
    """Pictures and the coefficients (zigzag order) of all their blocks, after all scans."""
    data = np.frombuffer(b"".join(streams), np.uint8)
    restarts, others = _markers(data)
    pictures, plans, offset, blocks = [], [], 0, 0
    for s in streams:
        p, scans = _parsed(s, offset, lambda at: others[bisect_left(others, at)])
        p.base = blocks
        blocks += p.blocks
        pictures.append(p)
        plans.append(scans)
        offset += len(s)
    return pictures, _accumulated(pictures, plans, data, restarts)


def _accumulated(pictures: list[_Picture], plans: list[list[dict]], data: np.ndarray, restarts: np.ndarray) -> np.ndarray:
    """The coefficients that the scans of pictures add up to. plans: the scans of each picture, at their places in data."""
    out, bits, tables = np.zeros((sum(p.blocks for p in pictures), 64), np.int32), _Bits(data), _Tables()
    at = [0] * len(plans)
    while True:
        phase, which = [], None
        for i, scans in enumerate(plans):
            touched: dict[int, int] = {}
            while at[i] < len(scans):
                s = scans[at[i]]
                now = s["lo"] == 0, s["high"] == 0
                mine = (2 << s["hi"]) - (1 << s["lo"])
                if which not in (None, now) or any(touched.get(c["name"], 0) & mine for c in s["parts"]):
                    break
                which = now
                for c in s["parts"]:
                    touched[c["name"]] = touched.get(c["name"], 0) | mine
                phase.append((s, pictures[i]))
                at[i] += 1
        if which is None:
            return out
        _READERS[which](phase, restarts, bits, tables, out)


def read_strips(stream: bytes) -> Iterator[tuple[_Picture, np.ndarray]]:
    """One stream of the stored form, a strip at a time: each as a picture of its own with its coefficients. Other streams come whole."""
    restarts, others = _markers(np.frombuffer(stream, np.uint8))
    whole, scans = _parsed(stream, 0, lambda at: others[bisect_left(others, at)])
    rows, columns = whole.mcus
    if not _is_stored_form(whole) or len(whole.comment) != 8 or any(s["interval"] != INTERVAL for s in scans):
        pictures, coefficients = read([stream])
        yield pictures[0], coefficients
        return
    units, step = struct.unpack(">Q", whole.comment)[0], _strip_rows(columns)
    # MCUs of a row in each scan (a scan of one component counts its blocks), and each scan's restart markers
    per_row = [columns * (s["parts"][0]["h"] * s["parts"][0]["v"] if len(s["parts"]) == 1 else 1) for s in scans]
    marks = [restarts[slice(*np.searchsorted(restarts, [s["begin"], s["end"]]))] for s in scans]
    if any(len(m) != -(-rows * n // INTERVAL) - 1 for m, n in zip(marks, per_row)):
        raise ValueError("restart markers do not match the interval")
    for lo in range(0, rows, step):
        own = min(step, rows - lo)
        p = whole.of_rows(own)
        p.comment = struct.pack(">Q", min(max(units - 2 * lo * columns, 0), 2 * own * columns))
        named, plan, pieces, at = {c["name"]: c for c in p.components}, [], [], 0
        for s, m, n in zip(scans, marks, per_row):
            begin = s["begin"] if not lo else int(m[lo * n // INTERVAL - 1]) + 2
            end = s["end"] if lo + own == rows else int(m[(lo + own) * n // INTERVAL - 1])
            plan.append({**s, "parts": [named[c["name"]] for c in s["parts"]], "begin": at, "end": at + end - begin})
            pieces += [stream[begin:end], b"\xff\xd9"]
            at += end - begin + 2
        data = np.frombuffer(b"".join(pieces), np.uint8)
        yield p, _accumulated([p], [plan], data, _markers(data)[0])


# ---- Pixels ---------------------------------------------------------------------------------------------------------------

_COS = np.round(np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)]) * 4096)


#: Blocks that are transformed at a time: they stay in the cache, and products this small start no threads of the linear algebra library,
#: which would only wait for each other.
TOGETHER = 256


def samples(coefficients: np.ndarray) -> np.ndarray:
    """8 x 8 samples (0 to 255) of dequantised blocks in natural order. Whole numbers in double precision: exact everywhere."""
    blocks = coefficients.reshape(-1, 8, 8)
    out = np.empty(blocks.shape, np.int16)
    for lo in range(0, len(blocks), TOGETHER):
        x = blocks[lo : lo + TOGETHER].astype(np.float64)
        half = (x.reshape(-1, 8) @ _COS).reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8) @ _COS
        half *= 1 / (1 << 24)
        half += 128.5
        np.floor(half, out=half)
        np.clip(half, 0, 255, out=half)
        out[lo : lo + TOGETHER] = half.reshape(-1, 8, 8).transpose(0, 2, 1)
    return out


def _tints(cb: np.ndarray, cr: np.ndarray) -> list[np.ndarray]:
    """What chroma adds to red, green and blue, in 16-bit fixed point."""
    cb, cr, half = cb.astype(np.int32) - 128, cr.astype(np.int32) - 128, 1 << 15
    return [x.astype(np.int16) for x in ((91881 * cr + half) >> 16, (half - 22554 * cb - 46802 * cr) >> 16, (116130 * cb + half) >> 16)]


def _upsampled(plane: np.ndarray, down: int, across: int) -> np.ndarray:
    """A plane, or a stack of planes, with every sample repeated."""
    return np.repeat(np.repeat(plane, down, -2), across, -1)


def _coloured(y: np.ndarray, tints: list[np.ndarray]) -> np.ndarray:
    """Luma and full-resolution tints as RGB; the last axis holds the channels."""
    out = np.empty((*y.shape, 3), np.uint8)
    for k, t in enumerate(tints):
        out[..., k] = np.clip(y + t, 0, 255)
    return out


def _natural(pictures: list[_Picture], coefficients: np.ndarray) -> np.ndarray:
    """Dequantised coefficients in natural order."""
    out = np.empty_like(coefficients)
    out[:, ZIGZAG] = coefficients
    for p in pictures:
        if any((p.quant[c["q"]] != 1).any() for c in p.components):
            out[p.base : p.base + p.blocks] *= np.repeat(np.stack([p.quant[c["q"]] for c in p.components]), [c["rows"] * c["columns"] for c in p.components], 0).astype(out.dtype)
    return out


def _mcu_blocks(pictures: list[_Picture]) -> np.ndarray:
    """The six blocks (four Y, Cb, Cr) of each MCU of pictures of the stored form, picture after picture."""
    n = np.array([p.mcus[0] * p.mcus[1] for p in pictures])
    first = np.cumsum(n) - n
    i = np.arange(int(n.sum())) - np.repeat(first, n)
    base, n_of = np.repeat([p.base for p in pictures], n), np.repeat(n, n)
    out = np.empty((len(i), 6), np.int64)
    out[:, :4] = (base + 4 * i)[:, None] + np.arange(4)
    out[:, 4], out[:, 5] = base + 4 * n_of + i, base + 5 * n_of + i
    for p, at in zip(pictures, first):
        if p.mcus[1] > 1:
            out[at : at + p.mcus[0] * p.mcus[1], :4] = p.base + _raster(*p.mcus)
    return out


def _is_stored_form(p: _Picture) -> bool:
    return tuple((c["h"], c["v"]) for c in p.components) == SAMPLING and p.height == 16 * p.mcus[0] and p.width == 16 * p.mcus[1]


def images(pictures: list[_Picture], coefficients: np.ndarray) -> list[np.ndarray]:
    """Full-resolution RGB arrays (height, width, 3) of pictures; one component gives equal channels. Pictures of the stored form are
    transformed, upsampled and coloured together."""
    s = samples(_natural(pictures, coefficients))
    alike = [p for p in pictures if _is_stored_form(p)]
    whole = set(map(id, alike))
    if alike:
        blocks = _mcu_blocks(alike)
        y = s[blocks[:, :4]].reshape(-1, 2, 2, 8, 8).transpose(0, 1, 3, 2, 4).reshape(-1, 16, 16)
        together = _coloured(y, [_upsampled(t, 2, 2) for t in _tints(s[blocks[:, 4]], s[blocks[:, 5]])])
    out, at = [], 0
    for p in pictures:
        if id(p) in whole:
            rows, columns = p.mcus
            x = together[at : at + rows * columns]
            at += rows * columns
            out.append(x.reshape(rows, columns, 16, 16, 3).transpose(0, 2, 1, 3, 4).reshape(p.height, p.width, 3))
            continue
        planes = []
        for c in p.components:
            own = s[p.base + c["base"] : p.base + c["base"] + c["rows"] * c["columns"]]
            plane = own.reshape(c["rows"], c["columns"], 8, 8).transpose(0, 2, 1, 3).reshape(c["rows"] * 8, c["columns"] * 8)
            planes.append(_upsampled(plane, p.vmax // c["v"], p.hmax // c["h"])[: p.height, : p.width])
        out.append(_coloured(planes[0], _tints(*planes[1:])) if len(planes) == 3 else np.repeat(planes[0].astype(np.uint8)[:, :, None], 3, 2))
    return out


def tensors(streams: list[bytes]) -> list[np.ndarray]:
    """Full-resolution RGB arrays of progressive JPEG streams."""
    return images(*read(streams))


def contents(pictures: list[_Picture], coefficients: np.ndarray) -> list[bytes]:
    """What write() stored in the pictures."""
    if any(not _is_stored_form(p) or len(p.comment) != 8 for p in pictures):
        raise ValueError("the stream holds no payload")
    data = (coefficients + 128).astype(np.uint8)[_mcu_blocks(pictures)] if pictures else None
    out, at = [], 0
    for p in pictures:
        n = p.mcus[0] * p.mcus[1]
        out.append(data[at : at + n].tobytes()[: struct.unpack(">Q", p.comment)[0] * UNIT])
        at += n
    return out


def payloads(streams: list[bytes]) -> list[bytes]:
    """What write() stored."""
    return contents(*read(streams))


# ---- Columns --------------------------------------------------------------------------------------------------------------

def _groups(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    lo, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > lo and held + n > CHUNK:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)


def padded(text: bytes) -> bytes:
    """The text with blanks up to a positive multiple of a unit."""
    return text.ljust(max(1, -(-len(text) // UNIT)) * UNIT, b" ")


def stored(docs: DataFrame, text_col: str = "text", out_col: str = "media") -> DataFrame:
    """Adds each text's payload as a progressive JPEG stream (binary)."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            data, at = raw(texts)
            out: list[bytes] = []
            for lo, hi in _groups(np.diff(at)):
                payloads = [padded(data[at[i] : at[i + 1]].tobytes()) for i in range(lo, hi)]
                out += [write_long(*payloads)] if len(payloads[0]) > CHUNK else write(payloads)
            yield pa.array(out, pa.binary())

    return without(docs, out_col).withColumn(out_col, batch_udf(run, "binary")(F.col(text_col)))


def _streams(media: pa.Array) -> Iterator[list[bytes | None]]:
    values = media.to_pylist()
    for lo, hi in _groups(np.array([len(v or b"") for v in values])):
        yield values[lo:hi]


def _opened(streams: list[bytes], with_payload: bool) -> list[tuple]:
    """Height, width and rgb bytes of streams, and what they store if asked for."""
    long = len(streams) == 1 and len(streams[0]) > CHUNK
    out: list[tuple] = []
    for pictures, coefficients in (([p], c) for p, c in read_strips(streams[0])) if long else [read(streams)]:
        out += zip([p.height for p in pictures], [p.width for p in pictures], [x.tobytes() for x in images(pictures, coefficients)], contents(pictures, coefficients) if with_payload else pictures)
    if long:
        height, width, rgb, payload = zip(*out)
        out = [(sum(height), width[0], b"".join(rgb), b"".join(payload) if with_payload else None)]
    return out if with_payload else [x[:3] for x in out]


_IMAGE = "height int, width int, rgb binary"


def decoded(media: DataFrame, media_col: str = "media", out_col: str = "image", with_payload: bool = False) -> DataFrame:
    """Adds the decoded image: struct of height, width and rgb (binary, height x width x 3 bytes), with_payload also of payload (what
    ``stored`` was given); null for null media."""
    tune(media.sparkSession)
    kinds = [("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())] + ([("payload", pa.binary())] if with_payload else [])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            rows: list[tuple | None] = []
            for values in _streams(column):
                each = iter(_opened([v for v in values if v is not None], with_payload))
                rows += [None if v is None else next(each) for v in values]
            columns = [pa.array([None if r is None else r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)]
            yield pa.StructArray.from_arrays(columns, fields=[pa.field(*k) for k in kinds], mask=pa.array([r is None for r in rows], pa.bool_()))

    return without(media, out_col).withColumn(out_col, batch_udf(run, _IMAGE + (", payload binary" if with_payload else ""))(F.col(media_col)))


def op9_progressive_jpeg(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decoded(stored(docs), with_payload=True)
    feature = F.format_string("%dx%d rgb=%08x", "image.height", "image.width", F.crc32("image.rgb"))  # size and checksum of the stored tensor
    return found.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.octet_length("image.payload").cast("long").alias("payload_bytes"), F.sha2("image.payload", 256).alias("payload_sha256"), F.crc32(F.substring("image.payload", -16, 16)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))
