"""Media columns: progressive JPEG, entropy-coded and decoded for whole batches of images in numpy.

The decoder gathers all scans of a progressive image (spectral selection and successive approximation) in an array of
coefficients, transforms it back, upsamples the chroma planes and makes a full-resolution RGB tensor. What is
sequential inside a stretch between restart markers runs in step over all stretches of all images of a batch.

A payload of bytes is stored losslessly in the coefficients themselves: byte b becomes the level b where b >= 128 and
b - 255 elsewhere, so that each level has eight magnitude bits. Blocks fill the Y plane, then Cb and Cr, in 4:2:0; a
comment holds the payload's length.

Edge cases: a null or empty text is stored as 64 zero bytes; equal texts give equal media; a null doc_id stays null;
an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import math
import re
import struct
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tracefold.llm.common import blocks, small_batches

UNIT = 64
#: Characters that are coded together: what goes in step costs by the step, so large blocks cost less.
BLOCK = 4 << 20
#: Bytes of media that are given on at once, with their payloads and tensors.
PIECE = 1 << 20
#: Blocks (in a scan of one component) or MCUs (in one of several) between restart markers.
RESTART = 64
_PER_MCU = 6
_SPLIT = 5  # the first AC band ends here

#: The zigzag order: the places of an 8 x 8 block along its diagonals, turning at each edge.
ZIGZAG = np.array([8 * a + b for d in range(15) for a, b in sorted(((i, d - i) for i in range(8) if 0 <= d - i < 8), key=lambda p: p[0] if d % 2 else p[1])])

#: Huffman tables of the writer: how many codes of each length from 1 to 16, and the symbols in order of their codes.
_DC_TABLE = (bytes([0, 0, 0, 12] + [0] * 12), bytes(range(12)))
_AC_TABLE = (bytes([1, 1] + [0] * 14), bytes([0x07, 0x00]))
_REFINE_TABLE = (bytes([0, 0, 0, 15] + [0] * 12), bytes(n << 4 for n in range(15)))


# ---------------------------------------------------------------------------------------------------- writer


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _scan_header(components: list[tuple[int, int]], ss: int, se: int, ah: int, al: int) -> bytes:
    return _segment(0xDA, bytes([len(components)]) + b"".join(bytes(c) for c in components) + bytes([ss, se, ah << 4 | al]))


def _table(kind: int, place: int, table: tuple[bytes, bytes]) -> bytes:
    return _segment(0xC4, bytes([kind << 4 | place]) + table[0] + table[1])


def _grid(n_blocks: int) -> tuple[int, int]:
    """MCUs across and down for so many blocks."""
    mcus = max(1, -(-n_blocks // _PER_MCU))
    across = math.isqrt(mcus - 1) + 1
    if across > 4095:
        raise ValueError("a payload of over 6 GB does not fit one image")
    return across, -(-mcus // across)


@lru_cache(maxsize=4096)
def _mcu_order(across: int, down: int) -> np.ndarray:
    """The blocks of an interleaved 4:2:0 scan, as places among the blocks of Y, Cb and Cr."""
    n = across * down
    y, x = np.divmod(np.arange(n), across)
    luma = np.stack([(2 * y + j) * 2 * across + 2 * x + i for j in (0, 1) for i in (0, 1)], 1)
    return np.concatenate([luma, 4 * n + np.arange(n)[:, None], 5 * n + np.arange(n)[:, None]], 1).ravel()


def _stretches(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """How many stretches of at most ``size`` each count makes, and the length of every stretch."""
    each = -(-counts // size)
    length = np.full(int(each.sum()), size, np.int64)
    length[np.cumsum(each) - 1] = counts - (each - 1) * size
    return each, length


def _join(data: np.ndarray, first: np.ndarray, stop: np.ndarray, each: np.ndarray) -> list[bytes]:
    """For each image, its stretches of bytes with zeros stuffed after 255 and restart markers between them."""
    full = np.flatnonzero(data == 255)
    if full.size:
        data = np.insert(data, full + 1, 0)
        first, stop = first + np.searchsorted(full, first), stop + np.searchsorted(full, stop)
    raw, out, at = data.tobytes(), [], 0
    first, stop = first.tolist(), stop.tolist()
    for n in each.tolist():
        if n == 1:
            out.append(raw[first[at] : stop[at]])
        else:
            parts = []
            for k in range(n):
                parts += [raw[first[at + k] : stop[at + k]], bytes([255, 0xD0 + k % 8])]
            out.append(b"".join(parts[:-1]))
        at += n
    return out


def _pack(values: np.ndarray, widths: np.ndarray, owner_first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit fields to bytes, each stretch (from its first field on) filled up with ones."""
    total = np.concatenate(([0], np.cumsum(widths)))
    size = np.diff(np.append(total[owner_first], total[-1]))
    n_bytes = (size + 7) // 8
    stop = np.cumsum(n_bytes)
    bits = np.ones(8 * int(stop[-1]), np.uint8)
    owner = np.repeat(np.arange(len(owner_first)), np.diff(np.append(owner_first, len(values))))
    start = 8 * (stop - n_bytes)[owner] + total[:-1] - total[owner_first][owner]
    for k in range(int(widths.max(initial=0))):
        has = widths > k
        bits[start[has] + k] = values[has] >> (widths[has] - 1 - k) & 1
    return np.packbits(bits), stop - n_bytes, stop


def encode(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG for each payload, whose length is a positive multiple of 64."""
    sizes = np.array([len(p) // UNIT for p in payloads], np.int64)
    grids = [_grid(n) for n in sizes.tolist()]
    mcus = np.array([a * b for a, b in grids], np.int64)
    blocks_ = _PER_MCU * mcus
    base = np.cumsum(blocks_) - blocks_
    data = np.frombuffer(b"".join(p + bytes(UNIT * int(n) - len(p)) for p, n in zip(payloads, blocks_, strict=True)), np.uint8).reshape(-1, UNIT)
    scans: list[tuple[bytes, list[bytes]]] = []

    # DC, its lowest bit held back
    level = data[:, 0].astype(np.int64)
    level = np.where(level >= 128, level, level - 255)
    order = np.concatenate([b + _mcu_order(*g) for b, g in zip(base.tolist(), grids, strict=True)])
    pattern = np.tile(np.array([0, 0, 0, 0, 1, 2]), int(mcus.sum()))
    each, length = _stretches(mcus, RESTART)
    first = _PER_MCU * (np.cumsum(length) - length)
    high = (level >> 1)[order]
    mcu = np.arange(len(order)) // _PER_MCU
    fresh = np.zeros(int(mcus.sum()), bool)
    fresh[first // _PER_MCU] = True
    # what a block is told from: in Y the block before it, in Cb and Cr the MCU before it
    previous = np.where((pattern == 0) & (np.arange(len(order)) % _PER_MCU > 0), np.arange(len(order)) - 1, np.arange(len(order)) - np.where(pattern == 0, 3, _PER_MCU))
    reset = fresh[mcu] & (np.arange(len(order)) % _PER_MCU % 5 * (pattern > 0) + np.arange(len(order)) % _PER_MCU * (pattern == 0) == 0) | fresh[mcu] & (pattern > 0)
    diff = high - np.where(reset, 0, high[np.maximum(previous, 0)])
    size = np.ceil(np.log2(np.abs(diff) + 1)).astype(np.int64)
    magnitude = np.where(diff < 0, diff + (1 << size) - 1, diff)
    all_ = [(1, 0), (2, 0), (3, 0)]
    scans.append((_scan_header(all_, 0, 0, 0, 1), _join(*_pack(size << size | magnitude, size + 4, first), each)))

    # AC, lowest bit held back: code 0 and seven bits, a byte a coefficient
    planes = [(0, 4), (4, 5), (5, 6)]
    rows = [np.concatenate([np.arange(b + m * lo, b + m * hi) for b, m in zip(base.tolist(), mcus.tolist(), strict=True)]) for lo, hi in planes]
    for component, own in enumerate(rows):
        counts = mcus * (planes[component][1] - planes[component][0])
        each, length = _stretches(counts, RESTART)
        stop = np.cumsum(length)
        seven = np.where(data[own] >= 128, data[own] >> 1, data[own] >> 1 & 63)
        for lo, hi in ((1, _SPLIT), (_SPLIT + 1, 63)):
            n = hi - lo + 1
            scans.append((_scan_header([(component + 1, 0)], lo, hi, 0, 1), _join(np.ascontiguousarray(seven[:, lo : hi + 1]).ravel(), n * (stop - length), n * stop, each)))
    for component, own in enumerate(rows):
        counts = mcus * (planes[component][1] - planes[component][0])
        each, length = _stretches(counts, RESTART)
        # an end-of-band run over the whole stretch, then a correction bit for each coefficient
        power = np.floor(np.log2(length)).astype(np.int64)
        width = 4 + power + 63 * length
        n_bytes = (width + 7) // 8
        stop = np.cumsum(n_bytes)
        bits = np.ones(8 * int(stop[-1]), np.uint8)
        head = 8 * (stop - n_bytes)
        for k in range(4):
            bits[head + k] = power >> (3 - k) & 1
        extra = length - (1 << power)
        for k in range(int(power.max())):
            has = power > k
            bits[head[has] + 4 + k] = extra[has] >> (power[has] - 1 - k) & 1
        low = (data[own, 1:] & 1) ^ (data[own, 1:] < 128)
        row = np.repeat(head + 4 + power - 63 * (np.cumsum(length) - length), length) + 63 * np.arange(len(own))
        bits[(row[:, None] + np.arange(63)).ravel()] = low.ravel()
        scans.append((_scan_header([(component + 1, 1)], 1, 63, 1, 0), _join(np.packbits(bits), stop - n_bytes, stop, each)))
    each, length = _stretches(mcus, RESTART)
    scans.append((_scan_header(all_, 0, 0, 1, 0), _join(*_pack((level & 1)[order], np.ones(len(order), np.int64), _PER_MCU * (np.cumsum(length) - length)), each)))

    tables = _segment(0xDB, bytes([0]) + bytes([1] * 64)), _table(0, 0, _DC_TABLE) + _table(1, 0, _AC_TABLE) + _table(1, 1, _REFINE_TABLE) + _segment(0xDD, struct.pack(">H", RESTART))
    out = []
    for i, (payload, (across, down)) in enumerate(zip(payloads, grids, strict=True)):
        frame = _segment(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        parts = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), tables[0], frame, tables[1]]
        for header, bodies in scans:
            parts += [header, bodies[i]]
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


# ---------------------------------------------------------------------------------------------------- decoder


@dataclass
class _Scan:
    components: tuple[int, ...]
    band: tuple[int, int, int, int]  # Ss, Se, Ah, Al
    tables: tuple
    restart: int
    data: tuple[int, int]


@dataclass
class _Image:
    raw: bytes
    comment: bytes = b""
    height: int = 0
    width: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantization table
    quantization: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[_Scan] = field(default_factory=list)


_NEXT = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]").search
_RST = re.compile(rb"\xff[\xd0-\xd7]")


def parse(raw: bytes) -> _Image:
    """The markers of a progressive JPEG of 8 bits a sample."""
    image, at, huffman, restart = _Image(raw), 2, {}, 0
    if raw[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    while at < len(raw):
        marker = raw[at + 1]
        if marker == 0xD9:
            break
        n = raw[at + 2] << 8 | raw[at + 3]
        body = raw[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide, place = body[0] >> 4, body[0] & 15
                image.quantization[place] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                count = sum(body[1:17])
                huffman[body[0]] = body[1 : 17 + count]
                body = body[17 + count :]
        elif marker == 0xC2:
            bits, image.height, image.width, count = struct.unpack(">BHHB", body[:6])
            if bits != 8:
                raise ValueError("only 8 bits a sample are supported")
            image.components = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * count, 3)]
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("not a progressive JPEG with Huffman codes")
        elif marker == 0xDD:
            restart = body[0] << 8 | body[1]
        elif marker == 0xFE:
            image.comment = body
        elif marker == 0xDA:
            count = body[0]
            ids = [c[0] for c in image.components]
            chosen = tuple(ids.index(body[1 + 2 * k]) for k in range(count))
            ss, se, approx = body[1 + 2 * count : 4 + 2 * count]
            found = _NEXT(raw, at)
            stop = found.start() if found else len(raw)
            tables = tuple(huffman.get(body[2 + 2 * k] >> 4 if ss == 0 else 0x10 | body[2 + 2 * k] & 15) for k in range(count))
            image.scans.append(_Scan(chosen, (ss, se, approx >> 4, approx & 15), tables, restart, (at, stop)))
            at = stop
    return image


@lru_cache(maxsize=64)
def _lookup(table: bytes) -> np.ndarray:
    """For each 16 bits that may come, the code's length << 8 | its symbol; 0 where no code begins so."""
    out, code, at = np.zeros(1 << 16, np.int64), 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            out[code << 16 - n : code + 1 << 16 - n] = n << 8 | table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


@lru_cache(maxsize=4096)
def _layout(height: int, width: int, components: tuple) -> tuple:
    """The blocks of each component (across, down, first), of the whole image, and of each plane's own scan."""
    hmax, vmax = max(c[1] for c in components), max(c[2] for c in components)
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    planes, first = [], 0
    for _, h, v, _ in components:
        own = -(-(-(-width * h // hmax)) // 8), -(-(-(-height * v // vmax)) // 8)
        planes.append((across * h, down * v, first, own))
        first += across * h * down * v
    return across, down, planes, first


@lru_cache(maxsize=8192)
def _order(height: int, width: int, components: tuple, chosen: tuple) -> tuple[np.ndarray, int, np.ndarray]:
    """The blocks of a scan in coding order, how many make an MCU, and which of the scan's components each of those has."""
    across, down, planes, _ = _layout(height, width, components)
    if len(chosen) == 1:
        wide, _, first, (x, y) = planes[chosen[0]]
        return (first + np.arange(y)[:, None] * wide + np.arange(x)).ravel(), 1, np.zeros(1, np.int64)
    my, mx = np.divmod(np.arange(across * down), across)
    columns, pattern = [], []
    for place, c in enumerate(chosen):
        _, h, v, _ = components[c]
        wide, _, first, _ = planes[c]
        for j in range(v):
            for i in range(h):
                columns.append(first + (my * v + j) * wide + mx * h + i)
                pattern.append(place)
    return np.stack(columns, 1).ravel(), len(columns), np.array(pattern)


def _words(raw: bytes) -> np.ndarray:
    """The 32 bits from each byte on."""
    b = np.frombuffer(raw + bytes(8), np.uint8).astype(np.uint32)
    return b[:-3] << np.uint32(24) | b[1:-2] << np.uint32(16) | b[2:-1] << np.uint32(8) | b[3:]


def _peek(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """32 bits from a place on, the first 25 of them right."""
    return words[at >> 3] << (at & 7).astype(np.uint32)


def _take(window: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (window >> np.uint32(1) >> (31 - n).astype(np.uint32)).astype(np.int64)


def _extend(bits: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << n >> 1), bits - (1 << n) + 1, bits)


def _symbol(lut: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = lut[window >> np.uint32(16)]
    if not found.all():
        raise ValueError("bits that are no Huffman code")
    return found >> 8, found & 255


def _dc_first(words, bit, order, first, n, pattern, luts, al, coef) -> None:
    prediction = np.zeros((len(bit), int(pattern.max()) + 1), np.int64)
    rank = np.argsort(-n, kind="stable")
    bit, first, n, prediction = bit[rank], first[rank], n[rank], prediction
    for step in range(int(n.max(initial=0))):
        live = int(np.searchsorted(-n, -step, side="left"))
        component = pattern[step % len(pattern)]
        length, size = _symbol(luts[component], _peek(words, bit[:live]))
        value = bit[:live] + length
        diff = _extend(_take(_peek(words, value), size), size)
        bit[:live] = value + size
        prediction[:live, component] += diff
        coef[order[first[:live] + step], 0] = prediction[:live, component] << al


def _ac_first(words, bit, order, first, n, ss, se, al, lut, coef) -> None:
    flat = coef.reshape(-1)
    at, end = first.copy(), first + n
    k, base = np.full(len(bit), ss, np.int64), order[at] * 64
    while len(bit):
        length, symbol = _symbol(lut, _peek(words, bit))
        run, size = symbol >> 4, symbol & 15
        bit = bit + length
        window = _peek(words, bit)
        if size.all():
            k += run
            flat[base + k] = _extend(_take(window, size), size) << al
            k += 1
            bit += size
        else:
            some = np.flatnonzero(size)
            k[some] += run[some]
            flat[base[some] + k[some]] = _extend(_take(window[some], size[some]), size[some]) << al
            k[some] += 1
            bit[some] += size[some]
            k[(size == 0) & (run == 15)] += 16
            over = np.flatnonzero((size == 0) & (run < 15))
            at[over] += (1 << run[over]) + _take(window[over], run[over])
            bit[over] += run[over]
            k[over] = ss
            base[over] = order[np.minimum(at[over], len(order) - 1)] * 64
        wrap = k > se
        if wrap.any():
            at[wrap] += 1
            k[wrap] = ss
        elif size.all():
            continue
        keep = at < end
        if not keep.all():
            bit, at, end, k = bit[keep], at[keep], end[keep], k[keep]
        base = order[at] * 64


def _ac_refine(raw, words, bit, order, first, n, ss, se, al, lut, coef) -> None:
    bits = np.unpackbits(np.frombuffer(raw + bytes(8), np.uint8))
    at, end = first.copy(), first + n
    k, run = np.full(len(bit), ss, np.int64), np.zeros(len(bit), np.int64)
    places = np.arange(64)

    def correct(who: np.ndarray, stop: np.ndarray) -> None:
        """A bit for each coefficient that is not zero, from k up to ``stop``."""
        rows = order[at[who]]
        held = coef[rows]
        mask = (held != 0) & (places >= k[who][:, None]) & (places < stop[:, None])
        count = np.cumsum(mask, 1)
        got = bits[np.minimum(bit[who][:, None] + count - 1, len(bits) - 1)] * mask
        coef[rows] = held + np.sign(held) * (got.astype(held.dtype) << al)
        bit[who] += count[:, -1]

    while len(bit):
        fresh = np.flatnonzero(run == 0)
        if fresh.size:
            length, symbol = _symbol(lut, _peek(words, bit[fresh]))
            zeros, size = symbol >> 4, symbol & 15
            bit[fresh] += length
            over = (size == 0) & (zeros < 15)
            who = fresh[over]
            run[who] = (1 << zeros[over]) + _take(_peek(words, bit[who]), zeros[over])
            bit[who] += zeros[over]
            who, zeros, size = fresh[~over], zeros[~over], size[~over]
            if who.size:
                sign = bits[bit[who]]
                bit[who] += size
                empty = np.cumsum((coef[order[at[who]]] == 0) & (places >= k[who][:, None]), 1)
                target = np.where(empty[:, -1] > zeros, (empty > zeros[:, None]).argmax(1), se + 1)
                correct(who, target)
                new = size > 0
                coef[order[at[who[new]]], target[new]] = np.where(sign[new], 1, -1) << al
                k[who] = target + 1
                past = who[k[who] > se]
                at[past] += 1
                k[past] = ss
        ending = np.flatnonzero((run > 0) & (at < end))
        if ending.size:
            correct(ending, np.full(len(ending), se + 1))
            at[ending] += 1
            run[ending] -= 1
            k[ending] = ss
        keep = at < end
        if not keep.all():
            bit, at, end, k, run = bit[keep], at[keep], end[keep], k[keep], run[keep]


def coefficients(images: list[_Image]) -> tuple[np.ndarray, list[int]]:
    """The levels of all blocks of all images in zigzag order, and each image's first block."""
    shapes = [(i.height, i.width, tuple(i.components)) for i in images]
    totals = [_layout(*s)[3] for s in shapes]
    base = [0, *np.cumsum(totals).tolist()]
    coef = np.zeros((base[-1], 64), np.int16)
    for turn in range(max((len(i.scans) for i in images), default=0)):
        groups = defaultdict(list)
        for place, image in enumerate(images):
            if turn < len(image.scans):
                s = image.scans[turn]
                groups[s.band, s.tables, s.components if len(s.components) > 1 else (0,), tuple(image.components) if len(s.components) > 1 else ()].append(place)
        for ((ss, se, ah, al), tables, *_), members in groups.items():
            raws, sizes, counts, orders = [], [], [], []
            for place in members:
                image, scan = images[place], images[place].scans[turn]
                order, unit, pattern = _order(*shapes[place], scan.components)
                body = image.raw[scan.data[0] : scan.data[1]]
                step = scan.restart * unit or len(order)
                stretches = _RST.split(body) if scan.restart else [body]
                for k, part in enumerate(stretches):
                    raws.append(part.replace(b"\xff\x00", b"\xff"))
                    counts.append(min(step, len(order) - k * step))
                orders.append(order + base[place])
            sizes = np.array([*map(len, raws)], np.int64)
            raw, n = b"".join(raws), np.array(counts, np.int64)
            order, first, bit = np.concatenate(orders), np.cumsum(n) - n, 8 * (np.cumsum(sizes) - sizes)
            if ss == 0 and ah:
                place = np.arange(len(order)) - np.repeat(first, n) + np.repeat(bit, n)
                coef[order, 0] |= np.unpackbits(np.frombuffer(raw, np.uint8))[place].astype(np.int16) << al
            elif ss == 0:
                _dc_first(_words(raw), bit, order, first, n, pattern, [_lookup(t) for t in tables], al, coef)
            elif ah:
                _ac_refine(raw, _words(raw), bit, order, first, n, ss, se, al, _lookup(tables[0]), coef)
            else:
                _ac_first(_words(raw), bit, order, first, n, ss, se, al, _lookup(tables[0]), coef)
    return coef, base


def _basis() -> np.ndarray:
    """The inverse transform of a block as a matrix of whole numbers, 2^13 times the real ones.

    With whole numbers the sums are exact in double precision, in whatever order they are made.
    """
    a = np.array([[(math.sqrt(0.125) if u == 0 else 0.5) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)])
    return np.rint(np.einsum("ux,vy->uvxy", a, a).reshape(64, 64) * 8192)[ZIGZAG]


_BASIS = _basis()


def tensors(images: list[_Image], coef: np.ndarray, base: list[int]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Full-resolution RGB tensors: groups of images of one shape, and an array (image, row, column, channel)."""
    groups = defaultdict(list)
    for place, image in enumerate(images):
        groups[image.height, image.width, tuple(image.components), tuple(image.quantization[c[3]].tobytes() for c in image.components)].append(place)
    for (height, width, components, quantization), members in groups.items():
        _, _, planes, total = _layout(height, width, components)
        for some in range(0, len(members), step := max(1, 8192 // total)):
            own = members[some : some + step]
            rows = np.concatenate([np.arange(base[i], base[i] + total) for i in own])
            levels = coef[rows].reshape(len(own), total, 64)
            hmax, vmax = max(c[1] for c in components), max(c[2] for c in components)
            channels = []
            for (wide, high, first, _), (_, h, v, _), q in zip(planes, components, quantization, strict=True):
                scaled = (levels[:, first : first + wide * high] * np.frombuffer(q, np.int64)).reshape(-1, 64).astype(np.float64)
                samples = np.clip((((scaled @ _BASIS).astype(np.int64) + 4096) >> 13) + 128, 0, 255).astype(np.int32)
                plane = samples.reshape(len(own), high, wide, 8, 8).transpose(0, 1, 3, 2, 4).reshape(len(own), 8 * high, 8 * wide)
                plane = plane.repeat(vmax // v, 1).repeat(hmax // h, 2)
                channels.append(plane[:, :height, :width])
            if len(channels) == 1:
                yield own, np.repeat(channels[0][..., None], 3, 3).astype(np.uint8)
                continue
            y, cb, cr = channels[0], channels[1] - 128, channels[2] - 128
            rgb = np.stack([y + (91881 * cr + 32768 >> 16), y - (22554 * cb + 46802 * cr - 32768 >> 16), y + (116130 * cb + 32768 >> 16)], -1)
            yield own, np.clip(rgb, 0, 255).astype(np.uint8)


def payload_of(image: _Image, coef: np.ndarray, first: int) -> bytes:
    """The bytes that ``encode`` has put into the levels."""
    n = int(image.comment.split()[1])
    levels = coef[first : first + -(-n // UNIT)]
    return np.where(levels < 0, levels + 255, levels).astype(np.uint8).tobytes()[:n]


def feature(tensor: np.ndarray) -> str:
    """Shape, the channels' sums and the sum of the steps between neighbours in a row."""
    sums = tensor.sum((0, 1), dtype=np.int64)
    steps = np.abs(np.diff(tensor[..., 1].astype(np.int16), axis=1)).sum(dtype=np.int64)
    return f"{tensor.shape[0]}x{tensor.shape[1]} rgb {sums[0]} {sums[1]} {sums[2]} steps {steps}"


# ---------------------------------------------------------------------------------------------------- operator


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % UNIT or UNIT * (not raw))


def store_and_read(docs: DataFrame) -> DataFrame:
    """Stores each text of (doc_id, text) as an image and reads the stored bytes back.

    (doc_id, n_bytes, media binary, payload binary, height, width, rgb binary): rgb is the full-resolution tensor, row by
    row, three bytes a sample. The payload and the tensor come from the media alone.
    """
    names = ["doc_id", "n_bytes", "media", "payload", "height", "width", "rgb"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", BLOCK):
            found = b.column(1).to_pylist()
            media = encode([payload(t) for t in found])
            images = [parse(m) for m in media]
            coef, base = coefficients(images)
            rgb = [b""] * len(images)
            for own, made in tensors(images, coef, base):
                for place, tensor in zip(own, made, strict=True):
                    rgb[place] = tensor.tobytes()
            columns = [
                b.column(0).to_pylist(),
                [len((t or "").encode()) for t in found],
                media,
                [payload_of(i, coef, at) for i, at in zip(images, base, strict=False)],
                [i.height for i in images],
                [i.width for i in images],
                rgb,
            ]
            whole = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
            starts = np.flatnonzero(np.diff(np.cumsum([*map(len, media)]) // PIECE, prepend=-1)).tolist()
            for start, stop in zip(starts, [*starts[1:], len(media)], strict=True):
                yield whole.slice(start, stop - start)

    schema = "doc_id long, n_bytes long, media binary, payload binary, height int, width int, rgb binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def with_feature(stored: DataFrame) -> DataFrame:
    """``stored`` with the feature of each row's tensor (height, width, rgb) in place of the tensor."""
    kept = stored.drop("rgb", "feature")
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = dict(zip(b.schema.names, b.columns, strict=True))
            shapes = zip(columns["height"].to_pylist(), columns["width"].to_pylist(), columns["rgb"], strict=True)
            found = [feature(np.frombuffer(v.as_buffer(), np.uint8).reshape(h, w, 3)) for h, w, v in shapes]
            yield pa.RecordBatch.from_arrays([*(columns[c] for c in names), pa.array(found, pa.string())], names=[*names, "feature"])

    return stored.mapInArrow(run, StructType([*kept.schema.fields, StructField("feature", StringType())]))


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    stored = store_and_read(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    # The digests are taken beside the tensors, so that texts, media and payloads go no further than this.
    digests = stored.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -UNIT, UNIT)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "height",
        "width",
        "rgb",
    )
    return with_feature(digests).drop("height", "width")
