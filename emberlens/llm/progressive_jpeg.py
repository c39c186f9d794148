"""Progressive JPEG as a media column: payloads in coefficients, pixels from scans.

``encode`` stores bytes in the quantised coefficients of a 4:2:0 image and writes them
as a progressive JPEG; ``Decoder`` reads any progressive 8-bit JPEG of Huffman codes:
it accumulates the scans' spectral bands and bit planes into coefficient arrays and
turns these into pixels in numpy.

A payload's bytes lie in zigzag order, a half byte a coefficient and so 32 a block, in the blocks of Y, then
Cb, then Cr. An AC coefficient is 8 to 15 in size, its sign and three bits the half byte's; DC coefficients
are their half bytes + 32 and + 80 by turns, so that their differences have one size. That keeps pixels well
within their range, and codes of one length for what follows make every scan a table of fields, which
numpy packs and unpacks at once.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Fixed values of the format: the zigzag order, and markers.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
SOI, EOI, SOF2, DHT, DQT, SOS, COM, DRI = 0xD8, 0xD9, 0xC2, 0xC4, 0xDB, 0xDA, 0xFE, 0xDD
BANDS = ((1, 5), (6, 63))
#: Blocks that one end-of-band run spans at most, and bytes that a block holds.
LONGEST_RUN, BLOCK_BYTES = 0x7FFF, 32
_PER_MCU = 6
#: What DC coefficients have beyond their half bytes, by turns; multiples of 16.
_DC_BASE = np.array([32, 80])
#: By half byte: its coefficient, in steps of two for the first scan, which the last bit moves away from zero; and back, from coefficient + 16.
_STEP = np.array([f if f >= 4 else f - 7 for f in range(8)], np.int16) * 2
_HALF = np.zeros(32, np.uint8)
for _v in range(16):
    _HALF[16 + _STEP[_v >> 1] + (_v & 1) * np.sign(_STEP[_v >> 1])] = _v


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, number: int, lengths: dict[int, list[int]]) -> bytes:
    return bytes([kind << 4 | number, *(len(lengths.get(n, ())) for n in range(1, 17)), *(s for n in sorted(lengths) for s in lengths[n])])


#: DC: differences of size 5. AC first scans: coefficients of size 3. AC refinements: end-of-band runs.
_DC, _AC, _RUNS = {1: [5]}, {1: [3]}, {4: [n << 4 for n in range(15)]}


def _scan(components: list[int], band: tuple[int, int], high: int, low: int, ac: int, bits: np.ndarray | None = None, data: bytes = b"") -> bytes:
    head = bytes([len(components), *(x for c in components for x in (c + 1, ac)), *band, high << 4 | low])
    if bits is not None:
        pad = -len(bits) % 8
        data = np.packbits(np.append(bits, np.ones(pad, np.uint8)) if pad else bits).tobytes()
    return _segment(SOS, head) + data.replace(b"\xff", b"\xff\x00")


def _fields(values: np.ndarray, width: int) -> np.ndarray:
    """Bits of each value, the highest first."""
    return ((values[:, None] >> np.arange(width - 1, -1, -1)) & 1).astype(np.uint8).ravel()


def shape(n_blocks: int) -> tuple[int, int]:
    """MCUs across and down for so many blocks."""
    n = -(-n_blocks // _PER_MCU)
    across = int(np.ceil(np.sqrt(n)))
    return across, -(-n // across)


@lru_cache(256)
def _mcu_order(across: int, down: int) -> np.ndarray:
    """The blocks of Y, of a raster, in the order of MCUs."""
    return _by_mcu(across, down, 2, 2).ravel()


def _by_mcu(across: int, down: int, h: int, v: int) -> np.ndarray:
    """The blocks of a component's raster, a row an MCU."""
    raster = np.arange(h * v * across * down).reshape(down, v, across, h)
    return raster.transpose(0, 2, 1, 3).reshape(across * down, h * v)


def encode(payload: bytes, comment: bytes = b"") -> bytes:
    """The image of a payload whose length is a positive multiple of 64."""
    if not payload or len(payload) % 64:
        raise ValueError("a payload has a positive multiple of 64 bytes")
    across, down = shape(len(payload) // BLOCK_BYTES)
    mcus = across * down
    data = np.zeros((mcus * _PER_MCU, BLOCK_BYTES), np.uint8)
    data.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    halves = np.stack([data >> 4, data & 15], 2).reshape(-1, 64)
    parts = np.split(halves, [4 * mcus, 5 * mcus])
    out = [
        bytes([0xFF, SOI]), _segment(COM, struct.pack(">Q", len(payload)) + comment), _segment(DQT, bytes([0] + [1] * 64)),
        _segment(SOF2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _segment(DHT, _table(0, 0, _DC) + _table(1, 0, _AC) + _table(1, 1, _RUNS)),
    ]
    first, low = np.empty((mcus, _PER_MCU), np.int64), np.empty((mcus, _PER_MCU), np.uint8)
    at = 0
    for i, part in enumerate(parts):
        dc = part[:, 0].astype(np.int64)
        dc = dc[_mcu_order(across, down)] if i == 0 else dc
        dc[0::2] += _DC_BASE[0]
        dc[1::2] += _DC_BASE[1]
        d = np.diff(dc >> 1, prepend=0)
        n = len(dc) // mcus
        first[:, at : at + n], low[:, at : at + n] = np.where(d < 0, d + 31, d).reshape(mcus, n), (dc & 1).reshape(mcus, n)  # five bits after the code 0
        at += n
    out.append(_scan([0, 1, 2], (0, 0), 0, 1, 0, bits=_fields(first.ravel(), 6)))
    out.append(_scan([0, 1, 2], (0, 0), 1, 0, 0, bits=low.ravel()))
    for i, part in enumerate(parts):
        for band in BANDS:
            field = (part[:, band[0] : band[1] + 1] >> 1).ravel()  # the code 0, then three bits: two coefficients a byte
            field = np.append(field, np.uint8(15)) if len(field) % 2 else field
            out.append(_scan([i], band, 0, 1, 0, data=(field[0::2] << 4 | field[1::2]).tobytes()))
        plane, bits = (part[:, 1:] & 1).reshape(-1), []
        for begin in range(0, len(part), LONGEST_RUN):
            run = min(LONGEST_RUN, len(part) - begin)
            n = run.bit_length() - 1
            bits += [_fields(np.array([n << n | run - (1 << n)]), 4 + n), plane[begin * 63 : (begin + run) * 63]]
        out.append(_scan([i], (1, 63), 1, 0, 1, bits=np.concatenate(bits)))
    return b"".join([*out, bytes([0xFF, EOI])])


class _Bits:
    """Bits of a scan's data, one field after the other."""

    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0

    def take(self, n: int) -> int:
        value = 0
        for b in self.bits[self.at : self.at + n].tolist():
            value = value << 1 | b
        self.at += n
        return value

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        n = code = 0
        while (n, code) not in codes:
            code, n = code << 1 | int(self.bits[self.at]), n + 1
            self.at += 1
        return codes[n, code]

    def signed(self, size: int) -> int:
        value = self.take(size)
        return value if not size or value >> size - 1 else value - (1 << size) + 1


class Decoder:
    """Coefficients and pixels of one image. ``fast`` reads scans that are tables of
    fields at once; the same scans read field by field give the same."""

    def __init__(self, image: bytes, fast: bool = True):
        self.fast, self.tables, self.quant, self.restart = fast, {}, {}, 0
        self.comment, self.components, self.coefficients, self.orders = b"", [], [], {}
        at = 2
        while image[at + 1] != EOI:
            marker, size = image[at + 1], int.from_bytes(image[at + 2 : at + 4], "big")
            body, at = image[at + 4 : at + 2 + size], at + 2 + size
            if marker == COM:
                self.comment = body
            elif marker == DQT:
                self._quantisation(body)
            elif marker == DHT:
                self._huffman(body)
            elif marker == DRI:
                self.restart = int.from_bytes(body, "big")
            elif marker == SOF2:
                self._frame(body)
            elif marker == SOS:
                end = at
                while True:  # up to a marker that is neither a stuffed byte nor a restart
                    end = image.index(b"\xff", end)
                    if image[end + 1] and not 0xD0 <= image[end + 1] <= 0xD7:
                        break
                    end += 2
                self._scan(body, image[at:end])
                at = end

    def payload(self) -> bytes:
        """What ``encode`` stored."""
        size, parts = int.from_bytes(self.comment[:8], "big"), []
        for c in self.coefficients:
            half = _HALF[(c + np.int16(16)) & 31]
            half[:, 0] = c[:, 0] & 15
            parts.append((half[:, 0::2] << 4 | half[:, 1::2]).tobytes())
        return b"".join(parts)[:size]

    def _quantisation(self, body: bytes) -> None:
        while body:
            wide, number = body[0] >> 4, body[0] & 15
            n = 64 << wide
            self.quant[number] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float64)
            body = body[1 + n :]

    def _huffman(self, body: bytes) -> None:
        while body:
            counts, at, code, codes = body[1:17], 17, 0, {}
            for n, count in enumerate(counts, 1):
                for _ in range(count):
                    codes[n, code] = body[at]
                    at, code = at + 1, code + 1
                code <<= 1
            self.tables[body[0] >> 4, body[0] & 15] = codes
            body = body[at:]

    def _frame(self, body: bytes) -> None:
        _, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        specs = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        self.most_h, self.most_v = max(s[1] for s in specs), max(s[2] for s in specs)
        self.across, self.down = -(-self.width // (8 * self.most_h)), -(-self.height // (8 * self.most_v))
        for name, h, v, q in specs:
            own = (-(-self.width * h // (8 * self.most_h)), -(-self.height * v // (8 * self.most_v)))
            self.components.append({"name": name, "h": h, "v": v, "q": q, "stride": self.across * h, "rows": self.down * v, "own": own})
            self.coefficients.append(np.zeros((self.across * h * self.down * v, 64), np.int16))

    def _scan(self, head: bytes, data: bytes) -> None:
        names = {c["name"]: i for i, c in enumerate(self.components)}
        chosen = [(names[head[1 + 2 * k]], head[2 + 2 * k] >> 4, head[2 + 2 * k] & 15) for k in range(head[0])]
        begin, end, high, low = head[-3], head[-2], head[-1] >> 4, head[-1] & 15
        key = tuple(c for c, _, _ in chosen)
        if key not in self.orders:
            self.orders[key] = self._order(list(key))
        order = self.orders[key]
        pieces = [data] if not self.restart else _restarts(data)
        step = self.restart * len(order) // max(1, self._units([c for c, _, _ in chosen])) if self.restart else len(order)
        for k, piece in enumerate(pieces):
            part, clean = order[k * step : (k + 1) * step], piece.replace(b"\xff\x00", b"\xff")
            if begin == 0:
                (self._dc_refine if high else self._dc_first)(chosen, part, clean, low)
            else:
                codes = self.tables[1, chosen[0][2]]
                (self._ac_refine if high else self._ac_first)(self.coefficients[chosen[0][0]], part[:, 1], codes, clean, begin, end, low)

    def _units(self, chosen: list[int]) -> int:
        own = self.components[chosen[0]]["own"]
        return self.across * self.down if len(chosen) > 1 else own[0] * own[1]

    def _order(self, chosen: list[int]) -> np.ndarray:
        """(component, block) in the order of a scan; those of small images are kept."""
        own = tuple((i, self.components[i]["h"], self.components[i]["v"], self.components[i]["stride"], self.components[i]["own"]) for i in chosen)
        return (_kept_order if self.across * self.down <= 1024 else _scan_order)(own, self.across, self.down)

    def _dc_first(self, chosen: list, order: np.ndarray, data: bytes, low: int) -> None:
        codes = {i: self.tables[0, t] for i, t, _ in chosen}
        if self.fast and all(c == {(1, 0): 5} for c in codes.values()):
            bits = np.unpackbits(np.frombuffer(data, np.uint8))[: 6 * len(order)].reshape(-1, 6)
            if not bits[:, 0].any():
                d = bits.astype(np.int64) @ (1 << np.arange(5, -1, -1))
                d = np.where(d < 16, d - 31, d)
                for i, _, _ in chosen:
                    own = order[:, 0] == i
                    self.coefficients[i][order[own, 1], 0] = np.cumsum(d[own]) << low
                return
        bits, last = _Bits(data), dict.fromkeys(codes, 0)
        for i, block in order.tolist():
            last[i] += bits.signed(bits.symbol(codes[i]))
            self.coefficients[i][block, 0] = last[i] << low

    def _dc_refine(self, chosen: list, order: np.ndarray, data: bytes, low: int) -> None:
        bits = np.unpackbits(np.frombuffer(data, np.uint8))[: len(order)].astype(np.int16) << low
        for i, _, _ in chosen:
            own = order[:, 0] == i
            self.coefficients[i][order[own, 1], 0] |= bits[own]

    def _ac_first(self, out: np.ndarray, blocks: np.ndarray, codes: dict, data: bytes, begin: int, end: int, low: int) -> None:
        if self.fast and codes == {(1, 0): 3} and low == 1:
            n = end - begin + 1
            pairs = np.frombuffer(data, np.uint8, (len(blocks) * n + 1) // 2)
            field = np.stack([pairs >> 4, pairs & 15], 1).reshape(-1)[: len(blocks) * n]
            if (field < 8).all():
                out[blocks, begin : end + 1] = _STEP[field].reshape(-1, n)
                return
        bits, run = _Bits(data), 0
        for block in blocks.tolist():
            if run:
                run -= 1
                continue
            k = begin
            while k <= end:
                r, size = divmod(bits.symbol(codes), 16)
                if size:
                    k += r
                    out[block, k] = bits.signed(size) * (1 << low)
                    k += 1
                elif r == 15:
                    k += 16
                else:
                    run = (1 << r) + bits.take(r) - 1
                    break

    def _ac_refine(self, out: np.ndarray, blocks: np.ndarray, codes: dict, data: bytes, begin: int, end: int, low: int) -> None:
        bits, run, step, n = _Bits(data), 0, 1 << low, end - begin + 1
        band = out[:, begin : end + 1]
        if self.fast and codes == {(4, k): k << 4 for k in range(15)} and (band[blocks] != 0).all():
            done = 0
            while done < len(blocks):
                size = bits.take(4)
                run = (1 << size) + bits.take(size)
                some = blocks[done : done + run]
                plane = bits.bits[bits.at : bits.at + len(some) * n].reshape(-1, n)
                old = band[some]
                band[some] = old + np.where(old > 0, step, -step).astype(np.int16) * plane
                bits.at, done = bits.at + len(some) * n, done + run
            return

        def correct(block: int, k: int) -> None:
            value = int(out[block, k])
            if bits.take(1) and not abs(value) & step:
                out[block, k] = value + (step if value > 0 else -step)

        for block in blocks.tolist():
            k = begin
            while not run and k <= end:
                r, size = divmod(bits.symbol(codes), 16)
                value = 0
                if size:
                    value = step if bits.take(1) else -step
                elif r < 15:
                    run = (1 << r) + bits.take(r)
                    break
                while k <= end:
                    if out[block, k]:
                        correct(block, k)
                    elif r:
                        r -= 1
                    else:
                        out[block, k] = value
                        k += 1
                        break
                    k += 1
            if run:
                for j in range(k, end + 1):
                    if out[block, j]:
                        correct(block, j)
                run -= 1

    def strips(self, mcus: int = 4096) -> Iterator[np.ndarray]:
        """RGB tensors (height, width, 3) of bytes, some rows of MCUs at a time."""
        rows = max(1, mcus // self.across)
        for top in range(0, self.down, rows):
            n = min(rows, self.down - top)
            planes = []
            for c, coefficients in zip(self.components, self.coefficients):
                part = coefficients[top * c["v"] * c["stride"] : (top + n) * c["v"] * c["stride"]]
                plane = pixels(part, self.quant[c["q"]]).reshape(n * c["v"], c["stride"], 8, 8).transpose(0, 2, 1, 3)
                plane = plane.reshape(n * c["v"] * 8, c["stride"] * 8)
                planes.append(plane.repeat(self.most_v // c["v"], 0).repeat(self.most_h // c["h"], 1))
            strip = np.stack(to_rgb(*planes) if len(planes) == 3 else planes * 3, 2).astype(np.uint8)
            yield strip[: min(self.height - top * 8 * self.most_v, len(strip)), : self.width]

    def mcu_blocks(self) -> list[np.ndarray] | None:
        """A 4:2:0 image's coefficients by MCU: (n, 4, 64) of Y, (n, 64) of Cb and Cr;
        None for images of other kinds or whose MCUs are cut at the edges."""
        kinds = [(c["h"], c["v"]) for c in self.components]
        if kinds != [(2, 2), (1, 1), (1, 1)] or self.width % 16 or self.height % 16:
            return None
        y, cb, cr = self.coefficients
        return [y[_mcu_order(self.across, self.down)].reshape(-1, 4, 64), cb, cr]

    def tensor(self) -> np.ndarray:
        return np.concatenate(list(self.strips()))


def _scan_order(own: tuple, across: int, down: int) -> np.ndarray:
    if len(own) == 1:
        i, _, _, stride, size = own[0]
        blocks = (np.arange(size[1])[:, None] * stride + np.arange(size[0])).ravel()
        return np.stack([np.full(len(blocks), i), blocks], 1)
    parts = []
    for i, h, v, _, _ in own:
        blocks = _by_mcu(across, down, h, v)
        parts.append(np.stack([np.full_like(blocks, i), blocks], 2))
    return np.concatenate(parts, 1).reshape(-1, 2)


_kept_order = lru_cache(512)(_scan_order)


def _restarts(data: bytes) -> list[bytes]:
    """The data between restart markers."""
    out, begin, at = [], 0, 0
    while (at := data.find(b"\xff", at)) >= 0:
        if 0xD0 <= data[at + 1] <= 0xD7:
            out.append(data[begin:at])
            begin = at + 2
        at += 2
    return [*out, data[begin:]]


_UNIT = 1 << 20


def _inverse() -> np.ndarray:
    """From 64 coefficients in zigzag order to 8 x 8 pixels, in whole parts of a unit: sums of
    whole numbers are exact, so that pixels don't depend on how a product is split."""
    u = np.arange(8)
    basis = np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 1 / 2)[:, None]
    return np.rint(np.kron(basis, basis)[ZIGZAG] * _UNIT)


_INVERSE = _inverse()


def pixels(coefficients: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """0 to 255, 64 a block."""
    out = coefficients.astype(np.float64) @ (quant[:, None] * _INVERSE)
    out += 128.5 * _UNIT
    out *= 1 / _UNIT
    np.clip(out, 0, 255, out)
    return out.astype(np.int32)


def _shifts(cb: np.ndarray, cr: np.ndarray) -> list[np.ndarray]:
    """What chroma adds to red, green and blue, in 65536ths: the format's factors
    1.402, -0.344136, -0.714136 and 1.772."""
    cb, cr = cb - 128, cr - 128
    return [91881 * cr + 32768, 32768 - 22554 * cb - 46802 * cr, 116130 * cb + 32768]


def to_rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> list[np.ndarray]:
    y = y << 16
    return [np.clip(y + x >> 16, 0, 255) for x in _shifts(cb, cr)]


def mcu_rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray, quants: list[np.ndarray]) -> list[np.ndarray]:
    """Channels (n, 256) of the pixels of MCUs, of whatever images; chroma is doubled both ways."""
    n = len(y)
    luma = pixels(y.reshape(-1, 64), quants[0]).reshape(n, 2, 2, 8, 8).transpose(0, 1, 3, 2, 4).reshape(n, 256) << 16
    wide = (x.reshape(n, 8, 1, 8, 1).repeat(2, 2).repeat(2, 4).reshape(n, 256) for x in _shifts(pixels(cb, quants[1]), pixels(cr, quants[2])))
    return [np.clip(luma + x >> 16, 0, 255) for x in wide]
