"""Progressive JPEG in numpy: many files at a time, each restart interval a lane that is coded in step with the others.

decode() reads any Huffman-coded progressive file of 8-bit samples with one to four components: spectral-selection and
successive-approximation scans add up in coefficient arrays.  rgb() dequantises, applies the inverse transform in whole
numbers (so equal files give equal samples on any machine), upsamples chroma and converts to RGB.

encode_payload() keeps bytes in the format's own unit, quantised coefficients, where nothing is lost: byte b is the
coefficient b + 2 in spectral order, with three components in 4:2:0.  So no coefficient vanishes in the first scans, and
refinement scans hold correction bits only.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np

BLANK = 32
#: Restart intervals in MCUs: of the interleaved DC scans, and of the AC scans (an MCU is a block there).
DC_LANE, AC_LANE = 16, 4
_MOST_ROWS = 4000
#: (components, first and last spectral index, high and low bit of the approximation)
SCRIPT = [((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 9, 0, 1), ((0,), 10, 63, 0, 1), ((1,), 1, 63, 0, 1), ((2,), 1, 63, 0, 1), ((0, 1, 2), 0, 0, 1, 0), ((0,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((2,), 1, 63, 1, 0)]


def _zigzag() -> np.ndarray:
    """Row-major place of each spectral index: along anti-diagonals, turning at the edges."""
    order = sorted(((y + x, y if (y + x) % 2 else x, y, x) for y in range(8) for x in range(8)))
    return np.array([8 * y + x for _, _, y, x in order])


def _inverse_transform() -> np.ndarray:
    """Samples of each spectral index's pattern, scaled by 2 ** 13 and rounded."""
    f = np.arange(8)
    basis = np.cos((2 * f[None, :] + 1) * f[:, None] * np.pi / 16) * np.where(f == 0, np.sqrt(0.5), 1.0)[:, None] / 2
    return np.rint(np.einsum("uy,vx->uvyx", basis, basis).reshape(64, 64)[_zigzag()] * 8192)


ZIGZAG, PATTERNS = _zigzag(), _inverse_transform()


def canonical(lengths: dict[int, int]) -> tuple[dict[int, tuple[int, int]], bytes]:
    """Codes (value, bits) of symbols with given code lengths, and the table as a DHT segment lists it."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    codes, code, bits = {}, 0, 0
    for s in order:
        code <<= lengths[s] - bits
        bits = lengths[s]
        codes[s] = (code, bits)
        code += 1
    return codes, bytes(sum(n == k for n in lengths.values()) for k in range(1, 17)) + bytes(order)


def _tables() -> dict[tuple[int, int], tuple[dict, bytes]]:
    """Class and number of each table: DC differences, AC first scans, AC refinements."""
    dc = {s: n for s, n in enumerate([3, 4, 3, 3, 3, 3, 3, 4, 6, 7, 8, 8])}
    first = {r << 4 | s: 12 for r in range(16) for s in range(11) if s or r < 15} | {0xF0: 12} | {6: 1, 5: 2, 7: 4, 4: 5, 3: 5, 2: 7, 1: 7, 8: 7, 0: 7}
    fine = {r << 4 | 1: 7 for r in range(16)} | {r << 4: 8 for r in range(16)} | {0x20: 1, 0x00: 3, 0x10: 3}
    return {(0, 0): canonical(dc), (1, 0): canonical(first), (1, 1): canonical(fine)}


TABLES = _tables()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_DHT = b"".join(_segment(0xC4, bytes([c << 4 | n]) + t) for (c, n), (_, t) in TABLES.items())
_DQT = _segment(0xDB, b"\x00" + b"\x01" * 64)


def _scan_header(comps: tuple[int, ...], ss: int, se: int, ah: int, al: int) -> bytes:
    interval = _segment(0xDD, struct.pack(">H", AC_LANE if ss else DC_LANE))
    table = (1 if ah else 0) if ss else 0
    return interval + _segment(0xDA, bytes([len(comps)]) + b"".join(bytes([c + 1, table]) for c in comps) + bytes([ss, se, ah << 4 | al]))


_HEADERS = [_scan_header(*s) for s in SCRIPT]


def _lanes(counts: np.ndarray, each: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For files with `counts` MCUs: each lane's file, first MCU in it and number of MCUs."""
    lanes = -(-counts // each)
    file = np.repeat(np.arange(len(counts)), lanes)
    first = (np.arange(len(file)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * each
    return file, first, np.minimum(each, counts[file] - first)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] numbers, and so on."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def _pack(codes: np.ndarray, bits: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of lanes with `tokens` tokens each, every lane filled up with ones; and the lanes' byte counts."""
    ends = np.cumsum(tokens)
    total = np.add.reduceat(bits, ends - tokens)
    size = -(-total // 8)
    begin = (np.cumsum(size) - size) * 8
    at = np.cumsum(bits) - bits
    at += np.repeat(begin - at[ends - tokens], tokens)
    # What fills up each lane is a token too.
    at = np.append(at, begin + total)
    bits = np.append(bits, size * 8 - total)
    codes = np.append(codes, (1 << (size * 8 - total)) - 1).astype(np.uint64)
    word, off = at >> 5, at & 31
    room = 64 - off - bits
    wide = codes << room.astype(np.uint64)
    words = np.zeros(int(size.sum()) // 4 + 3, dtype=np.uint64)
    # Bits of tokens never overlap, so sums are unions.
    for part, shift in ((wide >> np.uint64(32), 0), (wide & np.uint64(0xFFFFFFFF), 1)):
        words += np.bincount(word + shift, weights=part.astype(np.float64), minlength=len(words))[: len(words)].astype(np.uint64)
    return words.astype(">u4").view(np.uint8)[: int(size.sum())], size


def _marked(data: np.ndarray, size: np.ndarray, index: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Lanes with stuffed zeros and a restart marker behind each, and where each lane then begins (and the end)."""
    full = data == 0xFF
    grow = 1 + full
    ends = np.cumsum(size)
    size = np.add.reduceat(grow, ends - size)
    begin = np.cumsum(size + 2) - size - 2
    out = np.zeros(int((size + 2).sum()), dtype=np.uint8)
    at = np.cumsum(grow) - grow + 2 * np.repeat(np.arange(len(size)), np.diff(np.r_[0, ends]))
    out[at] = data
    out[begin + size] = 0xFF
    out[begin + size + 1] = 0xD0 + index % 8
    return out.tobytes(), np.append(begin, len(out))


def _first_codes() -> tuple[np.ndarray, np.ndarray]:
    """Code and bits of each byte in the first AC scans."""
    code, bits = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64)
    for b in range(256):
        v = b + 2 >> 1
        s = v.bit_length()
        c, n = TABLES[1, 0][0][s]
        code[b], bits[b] = c << s | v, n + s
    return code, bits


_FIRST_CODE, _FIRST_BITS = _first_codes()


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG file for each payload; lengths are multiples of 192."""
    mcus = np.array([-(-len(p) // 384) for p in payloads], dtype=np.int64)
    across = -(-mcus // _MOST_ROWS)
    mcus = across * -(-mcus // across)
    b = np.frombuffer(b"".join(p + bytes([BLANK]) * (int(m) * 384 - len(p)) for p, m in zip(payloads, mcus)), dtype=np.uint8).reshape(-1, 64)
    start = (np.cumsum(mcus) - mcus) * 6
    counts = [4 * mcus, mcus, mcus]
    starts = [start, start + 4 * mcus, start + 5 * mcus]
    scans: list[tuple[bytes, list[int]]] = []
    for comps, ss, se, ah, _ in SCRIPT:
        if len(comps) == 3:
            file, first, n = _lanes(mcus, DC_LANE)
            mcu, of = _spread(first, n), np.repeat(file, n)
            wide = across[of]
            y, x = mcu // wide, mcu % wide
            luma = starts[0][of] + 4 * y * wide + 2 * x
            blocks = np.stack([luma, luma + 1, luma + 2 * wide, luma + 2 * wide + 1, starts[1][of] + mcu, starts[2][of] + mcu], axis=1)
            v = b[blocks, 0].astype(np.int64) + 2
            if ah:
                codes, bits = (v & 1).ravel(), np.ones(v.size, dtype=np.int64)
            else:
                v >>= 1
                new = np.zeros(len(v), dtype=bool)
                new[np.cumsum(n) - n] = True
                before = np.stack([np.where(new, 0, np.r_[0, v[:-1, 3]]), v[:, 0], v[:, 1], v[:, 2], np.where(new, 0, np.r_[0, v[:-1, 4]]), np.where(new, 0, np.r_[0, v[:-1, 5]])], axis=1)
                d = (v - before).ravel()
                s = np.ceil(np.log2(np.abs(d) + 1)).astype(np.int64)
                code, bits = (np.array([TABLES[0, 0][0][k][i] for k in range(12)]) for i in (0, 1))
                codes, bits = code[s] << s | np.where(d < 0, d + (1 << s) - 1, d), bits[s] + s
            data, size = _pack(codes, bits, 6 * n)
        else:
            c = comps[0]
            file, first, n = _lanes(counts[c], AC_LANE)
            blocks = _spread(starts[c][file] + first, n)
            if ah:
                data, size = _corrections(b[blocks, ss : se + 1] & 1, n)
            else:
                flat = b[blocks, ss : se + 1].ravel()
                data, size = _pack(_FIRST_CODE[flat], _FIRST_BITS[flat], n * (se - ss + 1))
        out, at = _marked(data, size, first // (DC_LANE if len(comps) == 3 else AC_LANE))
        lanes = np.bincount(file, minlength=len(payloads))
        scans.append((out, at[np.r_[0, np.cumsum(lanes)]].tolist()))
    files = []
    for i, p in enumerate(payloads):
        w = int(across[i]) * 16
        frame = struct.pack(">BHHB", 8, int(mcus[i] // across[i]) * 16, w, 3) + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00"
        head = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(p)), _DQT, _segment(0xC2, frame), _DHT]
        for h, (out, at) in zip(_HEADERS, scans):
            head += [h, out[at[i] : at[i + 1] - 2]]
        files.append(b"".join([*head, b"\xff\xd9"]))
    return files


def _corrections(low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lanes that are one end-of-band run with the low bits of n blocks each."""
    size = np.zeros(len(n), dtype=np.int64)
    rows = np.cumsum(n) - n
    done = {}
    for k in np.unique(n).tolist():
        e = k.bit_length() - 1
        code, bits = TABLES[1, 1][0][e << 4]
        code, bits = code << e | k - (1 << e), bits + e
        lanes = np.flatnonzero(n == k)
        body = low[(rows[lanes][:, None] + np.arange(k)).ravel()].reshape(len(lanes), -1)
        head = np.tile(np.array([code >> bits - 1 - i & 1 for i in range(bits)], dtype=np.uint8), (len(lanes), 1))
        pad = np.ones((len(lanes), -(bits + body.shape[1]) % 8), dtype=np.uint8)
        done[k] = lanes, np.packbits(np.hstack([head, body, pad]), axis=1)
        size[lanes] = done[k][1].shape[1]
    out = np.empty(int(size.sum()), dtype=np.uint8)
    begin = np.cumsum(size) - size
    for lanes, data in done.values():
        out[(begin[lanes][:, None] + np.arange(data.shape[1])).ravel()] = data.ravel()
    return out, size


@dataclass
class Component:
    h: int
    v: int
    quant: np.ndarray
    #: Blocks across and down that hold samples, blocks across and down in memory, first block of all.
    wide: int = 0
    high: int = 0
    stride: int = 0
    rows: int = 0
    start: int = 0


@dataclass
class Picture:
    width: int
    height: int
    comps: list[Component]
    across: int
    down: int
    comment: bytes = b""
    scans: list[tuple] = field(default_factory=list)


_END = re.compile(rb"\xff+[^\x00\xff\xd0-\xd7]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def _look_up(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length by the next 16 bits."""
    symbol, bits = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
    at = k = 0
    for n, count in enumerate(counts, 1):
        for s in symbols[k : k + count]:
            symbol[at : at + (1 << 16 - n)], bits[at : at + (1 << 16 - n)] = s, n
            at += 1 << 16 - n
        k += count
    return symbol, bits


def parse(data: bytes, tables: dict[bytes, tuple]) -> Picture:
    """Frame, tables and scans of a file; tables: look-ups by content, shared between files."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    quant: dict[int, np.ndarray] = {}
    huff: dict[int, bytes] = {}
    at, interval, picture, ids, comment = 2, 0, None, {}, b""
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker where one is due")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        body = data[at + 4 : at + 2 + int.from_bytes(data[at + 2 : at + 4], "big")]
        at += len(body) + 4
        if marker == 0xDB:
            while body:
                n = 128 if body[0] >> 4 else 64
                quant[body[0] & 15] = np.frombuffer(body[1 : n + 1], dtype=">u2" if n == 128 else np.uint8).astype(np.int64)
                body = body[n + 1 :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                huff[body[0]] = body[1:n]
                if body[1:n] not in tables:
                    tables[body[1:n]] = _look_up(body[1:17], body[17:n])
                body = body[n:]
        elif marker == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            comment = body
        elif marker == 0xC2:
            bits, height, width, n = struct.unpack(">BHHB", body[:6])
            if bits != 8 or not height or not width:
                raise ValueError("only 8-bit files that state their size are read")
            parts = [body[6 + 3 * i : 9 + 3 * i] for i in range(n)]
            ids = {p[0]: i for i, p in enumerate(parts)}
            comps = [Component(p[1] >> 4, p[1] & 15, p[2]) for p in parts]
            h, v = max(c.h for c in comps), max(c.v for c in comps)
            picture = Picture(width, height, comps, -(-width // (8 * h)), -(-height // (8 * v)), comment)
            for c in comps:
                c.wide, c.high = -(-(-(-width * c.h // h)) // 8), -(-(-(-height * c.v // v)) // 8)
                c.stride, c.rows = picture.across * c.h, picture.down * c.v
        elif marker in (0xC0, 0xC1, *range(0xC3, 0xC4), *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("only progressive Huffman-coded files are read")
        elif marker == 0xDA:
            if picture is None:
                raise ValueError("a scan before its frame")
            picture.comment = comment
            n = body[0]
            chosen = tuple((ids[body[1 + 2 * i]], huff.get(body[2 + 2 * i] >> 4, b""), huff.get(16 | body[2 + 2 * i] & 15, b"")) for i in range(n))
            ss, se, a = body[1 + 2 * n : 4 + 2 * n]
            end = _END.search(data, at)
            stop = end.start() if end else len(data)
            picture.scans.append(((chosen, ss, se, a >> 4, a & 15), interval, data[at:stop]))
            at = stop
    if picture is None:
        raise ValueError("no frame")
    for c in picture.comps:
        c.quant = quant.get(c.quant, np.ones(64, dtype=np.int64))
    return picture


class Lanes:
    """The lanes of one kind of scan of many files, as one bit string, and a reading position in each."""

    def __init__(self, lanes: list[bytes]):
        size = np.array([len(x) for x in lanes], dtype=np.int64)
        data = np.frombuffer(b"".join([*lanes, bytes(8)]), dtype=np.uint8)
        self.data = data
        self.at = (np.cumsum(size) - size) * 8
        n = len(data) - 7
        w = np.zeros(n, dtype=np.uint64)
        for k in range(5):
            w |= data[k : k + n].astype(np.uint64) << np.uint64(56 - 8 * k)
        self.window = w
        self.last = n - 1

    def see(self, at: np.ndarray) -> np.ndarray:
        """The next 33 bits or more, from the top of 64."""
        return self.window[np.minimum(at >> 3, self.last)] << (at & 7).astype(np.uint64)


def _take(w: np.ndarray, skip: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n bits of w (at most 17) behind `skip` bits."""
    return ((w << skip.astype(np.uint64)) >> np.uint64(47)).astype(np.int64) >> (17 - n)


def decode(files: list[bytes], tables: dict[bytes, tuple] | None = None) -> tuple[list[Picture], np.ndarray]:
    """The files' frames, and the coefficients of all their blocks in spectral order."""
    tables = {} if tables is None else tables
    pictures = [parse(f, tables) for f in files]
    total = 0
    for p in pictures:
        for c in p.comps:
            c.start = total
            total += c.stride * c.rows
    coef = np.zeros((total, 64), dtype=np.int32)
    # The n-th scans of files go together where they agree in kind.
    for k in range(max((len(p.scans) for p in pictures), default=0)):
        kinds: dict[tuple, list[int]] = {}
        for i, p in enumerate(pictures):
            if k < len(p.scans):
                kinds.setdefault(p.scans[k][0], []).append(i)
        for kind, members in kinds.items():
            _decode_scan(kind, [pictures[i] for i in members], [pictures[i].scans[k] for i in members], coef, tables)
    return pictures, coef


def _decode_scan(kind: tuple, pictures: list[Picture], scans: list[tuple], coef: np.ndarray, tables: dict) -> None:
    chosen, ss, se, ah, al = kind
    lanes, counts, blocks = [], [], []
    for p, (_, interval, data) in zip(pictures, scans):
        if len(chosen) == 1:
            c = p.comps[chosen[0][0]]
            total = c.wide * c.high
            j = np.arange(total)
            order = (c.start + j // c.wide * c.stride + j % c.wide)[:, None]
        else:
            total = p.across * p.down
            y, x = np.divmod(np.arange(total), p.across)
            order = np.stack([p.comps[i].start + (y * p.comps[i].v + v) * p.comps[i].stride + x * p.comps[i].h + h for i, _, _ in chosen for v in range(p.comps[i].v) for h in range(p.comps[i].h)], axis=1)
        each = interval or total
        parts = [x.replace(b"\xff\x00", b"\xff") for x in _RESTART.split(data)] if interval else [data.replace(b"\xff\x00", b"\xff")]
        need = -(-total // each)
        if len(parts) < need:
            raise ValueError("a scan ends early")
        lanes += parts[:need]
        counts += [min(each, total - i * each) for i in range(need)]
        blocks.append(order)
    bits, n = Lanes(lanes), np.array(counts, dtype=np.int64)
    if ss == 0:
        shapes = {b.shape[1] for b in blocks}
        if len(shapes) > 1 or len({tuple((p.comps[i].h, p.comps[i].v) for i, _, _ in chosen) for p in pictures}) > 1:
            for p, s in zip(pictures, scans):  # files that differ in sampling go one by one
                _decode_scan(kind, [p], [s], coef, tables)
            return
        order = np.concatenate(blocks)
        if ah:
            _refine_dc(bits, n, order, al, coef)
        else:
            owner = [i for i, (c, _, _) in enumerate(chosen) for _ in range(pictures[0].comps[c].h * pictures[0].comps[c].v if len(chosen) > 1 else 1)]
            _first_dc(bits, n, order, owner, [tables[t] for _, t, _ in chosen], al, coef)
    else:
        order, table = np.concatenate(blocks)[:, 0], tables[chosen[0][2]]
        (_refine_ac if ah else _first_ac)(bits, n, order, ss, se, al, table, coef)


def _first_dc(bits: Lanes, n: np.ndarray, order: np.ndarray, owner: list[int], tables: list[tuple], al: int, coef: np.ndarray) -> None:
    width = order.shape[1]
    row = np.cumsum(n) - n
    diff = np.zeros(order.shape, dtype=np.int64)
    at, live = bits.at.copy(), np.arange(len(n))
    for m in range(int(n.max(initial=0))):
        live = live[n[live] > m]
        for k in range(width):
            symbol, length = tables[owner[k]]
            w = bits.see(at[live])
            look = (w >> np.uint64(48)).astype(np.int64)
            s, skip = symbol[look], length[look]
            v = _take(w, skip, s)
            diff[row[live] + m, k] = np.where(v < 1 << np.maximum(s - 1, 0), v - (1 << s) + 1, v) * (s > 0)
            at[live] += skip + s
    for i in set(owner):
        cols = [k for k, o in enumerate(owner) if o == i]
        run = np.cumsum(diff[:, cols].ravel()).reshape(-1, len(cols))
        base = run[row, 0] - diff[row, cols[0]]
        coef[order[:, cols], 0] = (run - np.repeat(base, n)[:, None]) << al


def _refine_dc(bits: Lanes, n: np.ndarray, order: np.ndarray, al: int, coef: np.ndarray) -> None:
    width = order.shape[1]
    every = np.unpackbits(bits.data)
    coef[order.ravel(), 0] |= every[_spread(bits.at, n * width)].astype(np.int32) << al


def _first_ac(bits: Lanes, n: np.ndarray, order: np.ndarray, ss: int, se: int, al: int, table: tuple, coef: np.ndarray) -> None:
    symbol, length = table
    flat, row = coef.reshape(-1), np.cumsum(n) - n
    at, block, left, k = bits.at, row.copy(), row + n, np.full(len(n), ss, dtype=np.int64)
    while len(at):
        w = bits.see(at)
        look = (w >> np.uint64(48)).astype(np.int64)
        sym, skip = symbol[look], length[look]
        r, s = sym >> 4, sym & 15
        has = s > 0
        if has.all():
            k = k + r
            v = _take(w, skip, s)
            flat[order[block] * 64 + k] = np.where(v < 1 << s - 1, v - (1 << s) + 1, v) << al
            at = at + skip + s
            k += 1
        else:
            stop = ~has & (r < 15)
            extra = np.where(has, s, np.where(stop, r, 0))
            v = _take(w, skip, extra)
            k = k + np.where(has, r, 16)
            i = np.flatnonzero(has)
            vi, si = v[i], s[i]
            flat[order[block[i]] * 64 + k[i]] = np.where(vi < 1 << si - 1, vi - (1 << si) + 1, vi) << al
            at = at + skip + extra
            k[i] += 1
            block = block + np.where(stop, (1 << np.where(stop, r, 0)) + v, 0)
            k[stop] = ss
        full = k > se
        if full.any():
            block = block + full
            k = np.where(full, ss, k)
        live = block < left
        if not live.all():
            at, block, left, k = at[live], block[live], left[live], k[live]


def _refine_ac(bits: Lanes, n: np.ndarray, order: np.ndarray, ss: int, se: int, al: int, table: tuple, coef: np.ndarray) -> None:
    symbol, length = table
    row = np.cumsum(n) - n
    one = 1 << al
    at = bits.at
    # A lane that is one end-of-band run over blocks without zeros holds nothing but a bit for each coefficient.
    w = bits.see(at)
    look = (w >> np.uint64(48)).astype(np.int64)
    r, s, skip = symbol[look] >> 4, symbol[look] & 15, length[look]
    stop = (s == 0) & (r < 15)
    run = np.where(stop, (1 << np.where(stop, r, 0)) + _take(w, skip, np.where(stop, r, 0)), 0)
    band = coef[order, ss : se + 1]
    easy = stop & (run >= n) & np.logical_and.reduceat((band != 0).all(axis=1), row)
    if easy.any():
        e = np.flatnonzero(easy)
        width = se - ss + 1
        every = np.unpackbits(bits.data)
        got = every[_spread(at[e] + skip[e] + r[e], n[e] * width)].reshape(-1, width).astype(np.int32)
        rows = order[_spread(row[e], n[e])]
        old = coef[rows, ss : se + 1]
        coef[rows, ss : se + 1] = old + np.sign(old) * (got << al) * ((np.abs(old) & one) == 0)
    hard = np.flatnonzero(~easy)
    flat = coef.reshape(-1)
    at, block, left = at[hard], row[hard], row[hard] + n[hard]
    k = np.full(len(hard), ss, dtype=np.int64)
    band_run, zeros, value = np.zeros(len(hard), dtype=np.int64), np.full(len(hard), -1, dtype=np.int64), np.zeros(len(hard), dtype=np.int64)
    while len(at):
        i = np.flatnonzero((band_run == 0) & (zeros < 0))
        if len(i):
            w = bits.see(at[i])
            look = (w >> np.uint64(48)).astype(np.int64)
            r, s, skip = symbol[look] >> 4, symbol[look] & 15, length[look]
            stop = (s == 0) & (r < 15)
            extra = np.where(stop, r, s)
            v = _take(w, skip, extra)
            at[i] += skip + extra
            band_run[i] = np.where(stop, (1 << np.where(stop, r, 0)) + v, 0)
            zeros[i] = np.where(stop, -1, r)
            value[i] = np.where(s > 0, np.where(v > 0, one, -one), 0)
        place = order[block] * 64 + k
        now = flat[place]
        old = now != 0
        bit = (bits.see(at) >> np.uint64(63)).astype(np.int64)
        flat[place] = np.where(old & (bit == 1) & ((np.abs(now) & one) == 0), now + np.sign(now) * one, now)
        at = at + old
        new = ~old & (band_run == 0)
        put = new & (zeros == 0) & (value != 0)
        flat[place[put]] = value[put]
        zeros = zeros - new
        k = k + 1
        full = k > se
        block = block + full
        band_run = np.where(full & (band_run > 0), band_run - 1, band_run)
        k = np.where(full, ss, k)
        live = block < left
        if not live.all():
            at, block, left, k, band_run, zeros, value = (x[live] for x in (at, block, left, k, band_run, zeros, value))


def payload_of(picture: Picture, coef: np.ndarray) -> bytes:
    """The bytes that encode_payloads() stored."""
    n = int(picture.comment.split()[1])
    start = picture.comps[0].start
    return (coef[start : start + n // 64].ravel() - 2).astype(np.uint8).tobytes()


def samples(picture_blocks: np.ndarray) -> np.ndarray:
    """8-bit samples of dequantised blocks, by exact whole-number arithmetic."""
    return np.clip(np.floor((picture_blocks.astype(np.float64) @ PATTERNS + 4096) / 8192) + 128, 0, 255).astype(np.uint8)


def rgb(picture: Picture, coef: np.ndarray) -> np.ndarray:
    """Full-resolution RGB samples, height x width x 3; one component gives grey, a fourth is ignored."""
    h, v = max(c.h for c in picture.comps), max(c.v for c in picture.comps)
    planes = []
    for c in picture.comps[:3] if len(picture.comps) > 2 else picture.comps[:1]:
        blocks = samples(coef[c.start : c.start + c.stride * c.rows] * c.quant)
        plane = blocks.reshape(c.rows, c.stride, 8, 8).transpose(0, 2, 1, 3).reshape(c.rows * 8, c.stride * 8)
        if (c.v, c.h) != (v, h):
            # Each sample covers a rectangle of the full grid.
            y, x = np.arange(picture.down * 8 * v) * c.v // v, np.arange(picture.across * 8 * h) * c.h // h
            plane = plane[y[:, None], x[None, :]]
        planes.append(plane[: picture.height, : picture.width].astype(np.int32))
    if len(planes) == 1:
        planes = [planes[0], np.full_like(planes[0], 128), np.full_like(planes[0], 128)]
    y, cb, cr = planes[0] << 16, planes[1] - 128, planes[2] - 128
    half = 1 << 15
    out = np.stack([y + 91881 * cr + half, y - 22554 * cb - 46802 * cr + half, y + 116130 * cb + half], axis=-1) >> 16
    return np.clip(out, 0, 255).astype(np.uint8)
