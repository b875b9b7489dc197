"""Media columns: progressive JPEG read in numpy, many images in step.

The reader accumulates spectral-selection and successive-approximation scans into coefficient arrays, applies the inverse
transform, repeats chroma samples up to full resolution and gives 8-bit RGB tensors.  Restart intervals are independent,
so all intervals of all images of a batch are decoded together: one numpy step decodes the next symbol of each.

The writer stores bytes losslessly in the format's own unit, the quantized coefficient: byte values, taken as signed, fill
the coefficients of a 4:2:0 image plane after plane.  DC and the first five AC coefficients come in two approximations,
the others in one band; each block is a restart interval.  An APP11 segment holds the number of stored bytes.

Cases: null text is empty; a payload has at least one unit of padding, so there is always a block; bytes are processed in
batches of about ``BATCH`` bytes and a row's result does not depend on its batch; a file that is not such a JPEG, or ends
early, raises ``ValueError``; other columns pass through.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphspan.llm.common import unused

UNIT = 576
BATCH = 400_000
SPLIT = 5  # AC coefficients 1..SPLIT are refined
# Fixed values of the format: the zigzag order by diagonals of an 8 x 8 block.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8) if (i // 8 + i % 8) % 2 else (i % 8))))
_DCT = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)], np.float32)

# --- Huffman tables: (number of codes of each length 1..16, symbols in order of their codes)
_AC_SYMBOLS = [0x07, 0x06, 0x00, 0x01, 0x02, 0x03, 0x04, 0x05, 0x08, 0x11, 0x21, 0xF0]
_AC_SYMBOLS += [r << 4 | s for r in range(16) for s in range(1, 11) if (r << 4 | s) not in _AC_SYMBOLS]
AC_TABLE = (bytes([0, 2, 0, 0, 10, 0, 0, 0, 0, len(_AC_SYMBOLS) - 12, 0, 0, 0, 0, 0, 0]), bytes(_AC_SYMBOLS))
DC_TABLE = (bytes([0, 0, 0, 12] + [0] * 12), bytes(range(12)))


@functools.lru_cache(maxsize=256)
def _codes(table: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code and length by symbol."""
    code, at = 0, 0
    codes, lengths = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for length, n in enumerate(table[0], 1):
        for symbol in table[1][at : at + n]:
            codes[symbol], lengths[symbol] = code, length
            code += 1
        at += n
        code <<= 1
    return codes, lengths


@functools.lru_cache(maxsize=256)
def _lookup(table: tuple[bytes, bytes]) -> np.ndarray:
    """Length << 8 | symbol by the next 16 bits; 0 where there is no code."""
    codes, lengths = _codes(table)
    out = np.zeros(65536, np.uint16)
    for s in table[1]:
        first, n = int(codes[s]) << (16 - int(lengths[s])), int(lengths[s])
        out[first : first + (1 << (16 - n))] = n << 8 | s
    return out


_CATEGORY = np.array([i.bit_length() for i in range(4096)], np.int64)


# --- writing


def _packed(value: np.ndarray, length: np.ndarray, segment: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of entries (ordered by segment), each segment filled up with ones to whole bytes: (bytes, bytes of each segment)."""
    bits = np.bincount(segment, length, segments).astype(np.int64)
    size = (bits + 7) // 8
    first = np.cumsum(size) - size
    run = np.cumsum(length) - length
    of_segment = np.cumsum(bits) - bits
    at = first[segment] * 8 + (run - of_segment[segment])
    pad = size * 8 - bits
    value = np.concatenate([value, (1 << pad) - 1])
    length = np.concatenate([length, pad])
    at = np.concatenate([at, first * 8 + bits])
    window = value << (40 - (at & 7) - length)
    out = np.zeros(int(size.sum()) + 5, np.uint8)
    byte = at >> 3
    reach = (at & 7) + length
    for i in range(5):
        if i < 2:
            np.add.at(out, byte + i, ((window >> (32 - 8 * i)) & 255).astype(np.uint8))
        elif len(some := np.flatnonzero(reach > 8 * i)):
            np.add.at(out, byte[some] + i, ((window[some] >> (32 - 8 * i)) & 255).astype(np.uint8))
    return out[:-5], size


def _marked(data: np.ndarray, size: np.ndarray, number: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zero bytes stuffed after 0xFF and restart markers between a scan's segments: (bytes, bytes of each segment)."""
    ends = np.cumsum(size) - 1
    extra = (data == 255).astype(np.int64)
    full = extra.copy()
    full[ends] += np.where(last, 0, 2)
    start = np.cumsum(full + 1) - (full + 1)
    out = np.zeros(int(len(data) + full.sum()), np.uint8)
    out[start] = data
    at = (start[ends] + 1 + extra[ends])[~last]
    out[at], out[at + 1] = 255, 0xD0 + (number[~last] & 7)
    stop = start[ends] + 1 + full[ends]
    return out, np.diff(np.concatenate([[0], stop]))


def _magnitude(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Category and appended bits of signed values."""
    s = _CATEGORY[np.abs(v)]
    return s, np.where(v < 0, v + (1 << s) - 1, v)


def _write_dc(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of interleaved 4:2:0 DC values (MCUs x 6); the prediction starts anew in each MCU."""
    diff = values.copy()
    diff[:, 1:4] -= values[:, 0:3]
    s, bits = _magnitude(diff.ravel())
    codes, lengths = _codes(DC_TABLE)
    return codes[s] << s | bits, lengths[s] + s, np.repeat(np.arange(len(values)), 6)


def _write_ac(band: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of a first AC scan of blocks x coefficients."""
    codes, lengths = _codes(AC_TABLE)
    n, width = band.shape
    block, k = np.nonzero(band)
    v = band[block, k].astype(np.int64)
    first = np.ones(len(block), bool)
    first[1:] = block[1:] != block[:-1]
    run = k - np.where(first, -1, np.concatenate([[-1], k[:-1]])) - 1
    s, bits = _magnitude(v)
    symbol = (run & 15) << 4 | s
    value, length = codes[symbol] << s | bits, lengths[symbol] + s
    reach = np.full(n, -1)
    reach[block] = k  # the last one stays
    eob = np.flatnonzero(reach < width - 1)
    zrl = np.repeat(np.arange(len(block)), run >> 4)
    value = np.concatenate([value, np.full(len(zrl), codes[0xF0]), np.full(len(eob), codes[0])])
    length = np.concatenate([length, np.full(len(zrl), lengths[0xF0]), np.full(len(eob), lengths[0])])
    order = np.concatenate([block * 256 + k * 2 + 1, block[zrl] * 256 + k[zrl] * 2, eob * 256 + 255])
    if len(zrl) or len(eob):
        by = np.argsort(order, kind="stable")
        return value[by], length[by], order[by] >> 8
    return value, length, block


def _write_refinement(band: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of an AC scan that gives the lowest bit of at most 16 coefficients; 32-bit accumulators emit as they fill."""
    codes, lengths = _codes(AC_TABLE)
    n = len(band)
    run, held, n_held = (np.zeros(n, np.int64) for _ in range(3))
    values, sizes, blocks = [], [], []

    def emit(rows: np.ndarray, symbol: np.ndarray, sign: np.ndarray | None) -> None:
        value, size = codes[symbol], lengths[symbol]
        if sign is not None:
            value, size = value << 1 | sign, size + 1
        values.append(value << n_held[rows] | held[rows])
        sizes.append(size + n_held[rows])
        blocks.append(rows)
        run[rows] = held[rows] = n_held[rows] = 0

    for k in range(band.shape[1]):
        a = np.abs(band[:, k]).astype(np.int64)
        known = a > 1
        held = np.where(known, held << 1 | (a & 1), held)
        n_held += known
        new = np.flatnonzero(a == 1)
        emit(new, run[new] << 4 | 1, (band[new, k] > 0).astype(np.int64))
        run += a == 0
    rest = np.flatnonzero((run > 0) | (n_held > 0))
    emit(rest, np.zeros(len(rest), np.int64), None)
    block = np.concatenate(blocks)
    by = np.argsort(block, kind="stable")
    return np.concatenate(values)[by], np.concatenate(sizes)[by], block[by]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def _scan_head(parts: list[int], first: int, last: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(parts)]) + b"".join(bytes([c + 1, 0]) for c in parts) + bytes([first, last, high << 4 | low]))


def write_jpegs(payloads: list[bytes]) -> list[bytes]:
    """Progressive JPEG files that hold the payloads in their coefficients."""
    lengths = np.array([len(p) for p in payloads], np.int64)
    mcus = np.maximum(-(-lengths // 384), 1)
    cols = np.minimum(mcus, 4095)
    rows = -(-mcus // cols)
    mcus = rows * cols
    if len(payloads) and rows.max() > 4095:
        raise ValueError("payload too large for one image")
    base = (np.cumsum(mcus) - mcus) * 6
    flat = np.zeros(int(mcus.sum()) * 384, np.int8)
    for p, b in zip(payloads, base, strict=True):
        flat[b * 64 : b * 64 + len(p)] = np.frombuffer(p, np.int8)
    blocks = flat.reshape(-1, 64).astype(np.int16)
    doc = np.repeat(np.arange(len(payloads)), mcus)
    n = np.arange(len(doc)) - (base // 6)[doc]
    interleaved = _mcu_blocks(base[doc], n, cols[doc], rows[doc])
    dc = blocks[:, 0].astype(np.int64)[interleaved]
    scans: list[tuple[bytes, np.ndarray, np.ndarray]] = []

    def add(head: bytes, entries: tuple, count: np.ndarray) -> None:
        value, length, segment = entries
        total = int(count.sum())
        data, size = _packed(value, length, segment, total)
        ends = np.cumsum(count)
        number = np.arange(total) - np.repeat(ends - count, count)
        last = np.zeros(total, bool)
        last[ends - 1] = True
        data, size = _marked(data, size, number, last)
        scans.append((head, data, np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], ends])]))

    planes = []
    for start, share in ((0, 4), (4, 1), (5, 1)):
        count = mcus * share
        index = np.repeat(base + start * mcus - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        planes.append((blocks[index], count))
    halved = lambda x: np.sign(x) * (np.abs(x) >> 1)
    add(_scan_head([0, 1, 2], 0, 0, 0, 1), _write_dc(dc >> 1), mcus)
    for c, (plane, count) in enumerate(planes):
        add(_scan_head([c], 1, SPLIT, 0, 1), _write_ac(halved(plane[:, 1 : SPLIT + 1])), count)
    for c, (plane, count) in enumerate(planes):
        add(_scan_head([c], SPLIT + 1, 63, 0, 0), _write_ac(plane[:, SPLIT + 1 :]), count)
    add(_scan_head([0, 1, 2], 0, 0, 1, 0), ((dc & 1).ravel(), np.ones(dc.size, np.int64), np.repeat(np.arange(len(dc)), 6)), mcus)
    for c, (plane, count) in enumerate(planes):
        add(_scan_head([c], 1, SPLIT, 1, 0), _write_refinement(plane[:, 1 : SPLIT + 1]), count)
    tables = _segment(0xDB, bytes([0]) + bytes([1] * 64)) + _segment(0xC4, b"\x00" + b"".join(DC_TABLE)) + _segment(0xC4, b"\x10" + b"".join(AC_TABLE)) + _segment(0xDD, b"\x00\x01")
    data = [(head, bytes(d), at) for head, d, at in scans]
    out = []
    for i, p in enumerate(payloads):
        frame = struct.pack(">BHHB", 8, int(rows[i]) * 16, int(cols[i]) * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        parts = [b"\xff\xd8", _segment(0xEB, b"bytes\0" + struct.pack(">Q", len(p))), tables, _segment(0xC2, frame)]
        for head, d, at in data:
            parts += [head, d[at[i] : at[i + 1]]]
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


def _mcu_blocks(base: np.ndarray, n: np.ndarray, cols: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Blocks of MCU n of 4:2:0 images whose planes lie one after another from ``base``."""
    r, c, m = n // cols, n % cols, rows * cols
    y = [base + (2 * r + v) * 2 * cols + 2 * c + h for v in (0, 1) for h in (0, 1)]
    return np.stack([*y, base + 4 * m + n, base + 5 * m + n], axis=1)


# --- reading


@dataclass
class _Scan:
    parts: list[tuple[int, tuple | None, tuple | None]]  # component, DC and AC table
    first: int
    last: int
    high: int
    low: int
    restart: int
    start: int  # of the coded bytes in the batch
    stop: int


@dataclass
class Image:
    """A frame and where its planes' blocks lie in the batch's coefficient array."""

    height: int = 0
    width: int = 0
    parts: list[dict] = field(default_factory=list)
    scans: list[_Scan] = field(default_factory=list)
    stored: int | None = None
    base: int = 0
    blocks: int = 0


def _parse(data: bytes, at: int, markers: np.ndarray) -> Image:
    """Segments of one file that begins at ``at`` of the batch; ``markers``: places of its markers but RST."""
    image, quant, huffman, restart = Image(), {}, {}, 0
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    pos, ids = 2, {}
    while True:
        if pos + 2 > len(data) or data[pos] != 255:
            raise ValueError("marker expected")
        kind = data[pos + 1]
        if kind == 0xD9:
            return image
        (size,) = struct.unpack_from(">H", data, pos + 2)
        body = data[pos + 4 : pos + 2 + size]
        pos += 2 + size
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 128 if wide else 64
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[1 + n :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif kind == 0xEB and body[:6] == b"bytes\0":
            (image.stored,) = struct.unpack(">Q", body[6:14])
        elif kind == 0xC2:
            _, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            image.parts = [{"h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "table": body[8 + 3 * i]} for i in range(n)]
            ids = {body[6 + 3 * i]: i for i in range(n)}
            high, tall = max(p["h"] for p in image.parts), max(p["v"] for p in image.parts)
            cols, rows = -(-image.width // (8 * high)), -(-image.height // (8 * tall))
            for p in image.parts:
                p |= {"cols": cols * p["h"], "rows": rows * p["v"], "first": image.blocks, "mcu_cols": cols, "mcus": cols * rows}
                p |= {"own_cols": -(-(-(-image.width * p["h"] // high)) // 8), "own_rows": -(-(-(-image.height * p["v"] // tall)) // 8)}
                image.blocks += p["cols"] * p["rows"]
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a progressive JPEG file")
        elif kind == 0xDA:
            n = body[0]
            parts = [(ids[body[1 + 2 * i]], huffman.get(body[2 + 2 * i] >> 4), huffman.get(0x10 | body[2 + 2 * i] & 15)) for i in range(n)]
            first, last, approx = body[1 + 2 * n : 4 + 2 * n]
            i = int(np.searchsorted(markers, at + pos))
            if i == len(markers):
                raise ValueError("scan without an end")
            stop = int(markers[i]) - at
            image.scans.append(_Scan(parts, first, last, approx >> 4, approx & 15, restart, at + pos, at + stop))
            for c, _, _ in parts:
                image.parts[c]["quant"] = quant[image.parts[c]["table"]]
            pos = stop


class _Bits:
    """Bit readers, one a segment, over one array of unstuffed bytes.

    Every byte has a view of the eight bytes from it on as one number, so a reader gets its next bits by one look-up.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        """``data`` ends in 64 bytes of padding."""
        self.words = np.ndarray(len(data) - 8, ">u8", data, 0, (1,))
        self.pos, self.most = starts * 8, (len(data) - 16) * 8

    def ahead(self, p: np.ndarray) -> np.ndarray:
        """The next 56 or more bits at bit positions p, left-aligned in 64."""
        return self.words[p >> 3].astype(np.uint64) << (p & 7).astype(np.uint64)

    def take(self, who: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The next n (at most 16) bits of readers ``who``."""
        p = np.minimum(self.pos[who], self.most)
        self.pos[who] = p + n
        return (self.ahead(p) >> np.uint64(48)).astype(np.int64) >> (16 - n)

    def symbol(self, who: np.ndarray, table: tuple[bytes, bytes]) -> np.ndarray:
        p = np.minimum(self.pos[who], self.most)
        entry = _lookup(table)[self.ahead(p) >> np.uint64(48)]
        self.pos[who] = p + (entry >> 8)
        return (entry & 255).astype(np.int64)


def _extend(bits: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << s) >> 1, bits - (1 << s) + 1, bits)


def _read_ac_first(bits: _Bits, who: np.ndarray, block: np.ndarray, run: np.ndarray, scan: _Scan, coefs: np.ndarray) -> None:
    go = run[who] == 0
    run[who[~go]] -= 1
    who, at = who[go], block[go] * 64 + scan.first
    last = block[go] * 64 + scan.last
    table, flat = _lookup(scan.parts[0][2]), coefs.reshape(-1)
    pos = bits.pos[who]
    while len(who):
        np.minimum(pos, bits.most, out=pos)
        word = bits.ahead(pos)
        entry = table[word >> np.uint64(48)].astype(np.int64)
        size, r, s = entry >> 8, (entry >> 4) & 15, entry & 15
        # the bits behind the code, at most 15 of them
        value = (((word << size.astype(np.uint64)) >> np.uint64(49)).astype(np.int64)) >> (15 - s)
        pos += size + s
        go = s > 0
        if go.all():
            at += r
            ok = at <= last
            v = (_extend(value, s) << scan.low).astype(np.int16)
            if ok.all():
                flat[at] = v
            else:
                flat[at[ok]] = v[ok]
            at += 1
            go = at <= last
        else:
            put = np.flatnonzero(go & (at + r <= last))
            flat[at[put] + r[put]] = (_extend(value[put], s[put]) << scan.low).astype(np.int16)
            eob = np.flatnonzero(~go & (r < 15))
            if len(eob):
                run[who[eob]] = (1 << r[eob]) - 1 + ((((word << size.astype(np.uint64)) >> np.uint64(48)).astype(np.int64)[eob]) >> (16 - r[eob]))
                pos[eob] += r[eob]
            at = at + r + 1
            go = at <= last
            go[eob] = False
        if not go.all():
            bits.pos[who] = pos
            who, at, last, pos = who[go], at[go], last[go], pos[go]


def _read_ac_refinement(bits: _Bits, who: np.ndarray, block: np.ndarray, run: np.ndarray, scan: _Scan, coefs: np.ndarray) -> None:
    """All readers stand at the same coefficient; each is in a run of zeros, in need of a symbol, or past its last one."""
    one, table = 1 << scan.low, scan.parts[0][2]
    ended = run[who] > 0
    left = np.full(len(who), -1)  # zeros to pass before the next new value; -1: a symbol is due
    new = np.zeros(len(who), np.int64)
    for k in range(scan.first, scan.last + 1):
        if len(due := np.flatnonzero(~ended & (left < 0))):
            symbol = bits.symbol(who[due], table)
            r, s = symbol >> 4, symbol & 15
            eob = (s == 0) & (r < 15)
            run[who[due[eob]]] = (1 << r[eob]) + bits.take(who[due[eob]], r[eob])
            ended[due[eob]] = True
            sign = bits.take(who[due], (s > 0).astype(np.int64))
            new[due] = np.where(s > 0, np.where(sign == 1, one, -one), 0)
            left[due] = r
        now = coefs[block, k].astype(np.int64)
        known = now != 0
        if len(at := np.flatnonzero(known)):
            bit = bits.take(who[at], np.ones(len(at), np.int64))
            add = (bit == 1) & (np.abs(now[at]) & one == 0)
            now[at] += np.where(add, np.sign(now[at]) * one, 0)
        zero = ~known & ~ended
        here = zero & (left == 0)
        now[here] = new[here]
        left[zero] -= 1
        coefs[block, k] = now
    run[who[ended]] -= 1


@functools.lru_cache(maxsize=512)
def _interleaved(shape: tuple[tuple[int, ...], ...]) -> np.ndarray:
    """Blocks of each MCU (MCUs x blocks) of a frame; shape: (h, v, columns of blocks, first block, MCUs, MCU columns) of each part."""
    columns = []
    for h, v, cols, first, mcus, mcu_cols in shape:
        r, q = np.divmod(np.arange(mcus), mcu_cols)
        columns += [first + (r * v + y) * cols + q * h + x for y in range(v) for x in range(h)]
    return np.stack(columns, axis=1)


def _units(group: list[tuple[Image, _Scan]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of MCUs of each scan, and the blocks of each MCU (MCUs x blocks, in the batch's array)."""
    if len(group[0][1].parts) > 1:
        keys = ("h", "v", "cols", "first", "mcus", "mcu_cols")
        each = [_interleaved(tuple(tuple(m.parts[c][k] for k in keys) for c, _, _ in s.parts)) for m, s in group]
        n = np.array([len(x) for x in each], np.int64)
        return n, np.concatenate(each) + np.repeat(np.array([m.base for m, _ in group], np.int64), n)[:, None]
    parts = [m.parts[s.parts[0][0]] for m, s in group]
    own, n = (np.array(x, np.int64) for x in ([p["own_cols"] for p in parts], [p["own_cols"] * p["own_rows"] for p in parts]))
    cols, first = (np.array(x, np.int64) for x in ([p["cols"] for p in parts], [m.base + p["first"] for (m, _), p in zip(group, parts, strict=True)]))
    number = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    own, cols, first = (np.repeat(x, n) for x in (own, cols, first))
    return n, (first + number // own * cols + number % own)[:, None]


class _Coded:
    """The bytes of a batch without stuffed zeros and restart markers, and where each of its bytes has come to lie."""

    def __init__(self, data: np.ndarray, ff: np.ndarray):
        after = data[ff + 1]
        self.marks = ff[(after & 0xF8) == 0xD0]
        keep = np.ones(len(data), bool)
        keep[ff[after == 0] + 1] = False
        keep[self.marks] = keep[self.marks + 1] = False
        self.place = np.cumsum(keep) - keep
        self.bytes = np.concatenate([data[keep], np.zeros(64, np.uint8)])


def _read_scans(group: list[tuple[Image, _Scan]], coded: _Coded, coefs: np.ndarray) -> None:
    """Scans of several images that differ only in their place."""
    scan = group[0][1]
    n, blocks = _units(group)
    start = np.array([s.start for _, s in group], np.int64)
    first_mark, end_mark = (np.searchsorted(coded.marks, x) for x in (start, [s.stop for _, s in group]))
    step = np.array([s.restart for _, s in group], np.int64)
    step = np.where(step > 0, step, n)
    segments = -(-n // step)
    if (end_mark - first_mark + 1 != segments).any():
        raise ValueError("restart markers do not fit the scan")
    number = np.arange(int(segments.sum())) - np.repeat(np.cumsum(segments) - segments, segments)
    image = np.repeat(np.arange(len(group)), segments)
    marks = np.append(coded.marks, 0)[np.maximum(first_mark[image] + number - 1, 0)]
    bits = _Bits(coded.bytes, coded.place[np.where(number == 0, start[image], marks)])
    count = np.minimum(step[image], n[image] - number * step[image])
    first = np.cumsum(count) - count
    run = np.zeros(len(count), np.int64)
    parts = group[0][0].parts
    order = [c for c, _, _ in scan.parts for _ in range(parts[c]["h"] * parts[c]["v"])] if len(scan.parts) > 1 else [scan.parts[0][0]]
    tables = {c: dc for c, dc, _ in scan.parts}
    before = {c: np.zeros(len(count), np.int64) for c in tables}
    for u in range(int(count.max())):
        who = np.flatnonzero(count > u)
        here = blocks[first[who] + u]
        if scan.first:
            (_read_ac_refinement if scan.high else _read_ac_first)(bits, who, here[:, 0], run, scan, coefs)
            continue
        for i, c in enumerate(order):
            if scan.high:
                coefs[here[:, i], 0] |= (bits.take(who, np.ones(len(who), np.int64)) << scan.low).astype(coefs.dtype)
            else:
                s = bits.symbol(who, tables[c])
                before[c][who] += _extend(bits.take(who, s), s)
                coefs[here[:, i], 0] = before[c][who] << scan.low


def read_coefficients(files: list[bytes]) -> tuple[list[Image], np.ndarray]:
    """Frames and the (blocks x 64, zigzag) coefficients of all files together."""
    data = np.frombuffer(b"".join(files), np.uint8)
    ff = np.flatnonzero(data[:-1] == 255)
    after = data[ff + 1]
    markers = ff[(after != 0) & ((after & 0xF8) != 0xD0) & (after != 255)]
    images, at, base = [], 0, 0
    for f in files:
        image = _parse(f, at, markers)
        image.base = base
        images.append(image)
        at += len(f)
        base += image.blocks
    coefs, coded = np.zeros((base, 64), np.int16), _Coded(data, ff)
    for i in range(max((len(m.scans) for m in images), default=0)):
        groups: dict[tuple, list] = {}
        for image in images:
            if i < len(image.scans):
                s = image.scans[i]
                shape = tuple((p["h"], p["v"]) for p in image.parts)
                groups.setdefault((tuple(s.parts), s.first, s.last, s.high, s.low, shape), []).append((image, s))
        for group in groups.values():
            _read_scans(group, coded, coefs)
    return images, coefs


def samples(image: Image, coefs: np.ndarray) -> list[np.ndarray]:
    """8-bit planes at their own resolution."""
    planes = []
    for p in image.parts:
        first = image.base + p["first"]
        own = np.zeros((p["cols"] * p["rows"], 64), np.float32)
        own[:, ZIGZAG] = coefs[first : first + len(own)] * p["quant"]
        pixels = _DCT.T @ own.reshape(-1, 8, 8) @ _DCT
        plane = np.clip(np.rint(pixels + 128), 0, 255).astype(np.uint8)
        planes.append(plane.reshape(p["rows"], p["cols"], 8, 8).swapaxes(1, 2).reshape(p["rows"] * 8, p["cols"] * 8))
    return planes


def rgb(image: Image, coefs: np.ndarray) -> np.ndarray:
    """Height x width x 3 tensor; chroma samples are repeated, one component is grey."""
    high, tall = max(p["h"] for p in image.parts), max(p["v"] for p in image.parts)
    full = []
    for p, plane in zip(image.parts, samples(image, coefs), strict=True):
        if (p["h"], p["v"]) != (high, tall):
            plane = plane.repeat(tall // p["v"], axis=0).repeat(high // p["h"], axis=1)
        full.append(plane[: image.height, : image.width])
    if len(full) < 3:
        return np.stack([full[0]] * 3, axis=-1)
    y, cb, cr = full[0].astype(np.float32), full[1].astype(np.float32) - 128, full[2].astype(np.float32) - 128
    out = np.empty((*full[0].shape, 3), np.uint8)
    out[..., 0] = np.clip(np.rint(y + np.float32(1.402) * cr), 0, 255)
    out[..., 1] = np.clip(np.rint(y - np.float32(0.344136) * cb - np.float32(0.714136) * cr), 0, 255)
    out[..., 2] = np.clip(np.rint(y + np.float32(1.772) * cb), 0, 255)
    return out


def feature(tensor: np.ndarray) -> str:
    """Size, sums of the channels and a 16-bin histogram of green, as text; whole numbers, so exact."""
    sums = tensor.sum(axis=(0, 1), dtype=np.int64)
    bins = np.bincount(tensor[..., 1].ravel() >> 4, minlength=16)
    return f"{tensor.shape[1]}x{tensor.shape[0]};" + ",".join(map(str, sums)) + ";" + ",".join(map(str, bins))


def padded(text: str | None) -> bytes:
    """UTF-8 bytes and then 255s, up to the next multiple of ``UNIT`` that is at least one unit."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\xff" * (max(-(-len(data) // UNIT), 1) * UNIT - len(data))


def _batches(items: Iterable[bytes]) -> Iterator[list[bytes]]:
    now, size = [], 0
    for x in items:
        now.append(x)
        size += len(x)
        if size >= BATCH:
            yield now
            now, size = [], 0
    if now:
        yield now


def with_media(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Add ``media`` (a name ``df`` has not): each whole text, padded, as the coefficients of a progressive JPEG file."""
    unused(df, media)

    @F.pandas_udf("binary")
    def written(texts: pd.Series) -> pd.Series:
        return pd.Series([f for some in _batches(map(padded, texts)) for f in write_jpegs(some)], dtype=object)

    return df.withColumn(media, written(F.col(text)))


def with_decoded(df: DataFrame, media: str = "media", out: str = "decoded", tensors: bool = True) -> DataFrame:
    """Add ``out``: struct of payload (stored bytes, null in other files), height, width, rgb (row-major bytes) and feature.

    ``tensors`` false leaves rgb null, for those who need features or payloads alone.  A null file gives nulls.  ``out`` is a
    name ``df`` has not.
    """
    unused(df, out)

    @F.pandas_udf("payload binary, height int, width int, rgb binary, feature string")
    def read(files: pd.Series) -> pd.DataFrame:
        rows = []
        for some in _batches(f for f in files if f is not None):
            images, coefs = read_coefficients(some)
            for image in images:
                tensor = rgb(image, coefs)
                payload = None
                if image.stored is not None:
                    payload = coefs[image.base : image.base + image.blocks].astype(np.int8).tobytes()[: image.stored]
                rows.append((payload, image.height, image.width, tensor.tobytes() if tensors else None, feature(tensor)))
        found = iter(rows)
        return pd.DataFrame([next(found) if f is not None else (None,) * 5 for f in files], columns=["payload", "height", "width", "rgb", "feature"])

    return df.withColumn(out, read(F.col(media)))
