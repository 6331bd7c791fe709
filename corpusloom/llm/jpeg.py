"""Progressive JPEG: lossless payloads as coefficients, and decoding to full-resolution RGB.

``encode`` stores bytes as quantised coefficients of a three-component 4:2:0 image: one coefficient to a
byte, none of them zero, so entropy coding loses nothing.  The scans are progressive: DC and two spectral
bands of AC to all but the last bit (spectral selection), then the last bits (successive approximation).
The Huffman tables give every coefficient of a first scan a field of one size (code and value bits
together), which both sides handle as whole arrays.

``decode`` accumulates the scans of any progressive Huffman JPEG of 8-bit samples into coefficient
arrays, with array operations where a scan has such fields and bit by bit elsewhere.  ``rgb``
inverse-transforms in numpy, with integer-valued arithmetic that is exact in any order of summation,
upsamples chroma and converts to RGB.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np

# fixed values of the format: zigzag order of an 8 x 8 block
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)), np.int64)
UNZIGZAG = np.argsort(ZIGZAG)
BANDS = ((1, 5), (6, 63))
MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.DOTALL)


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def stuffed(bits: np.ndarray) -> bytes:
    """Bits (0/1) as entropy-coded bytes: padded by ones, 0xff followed by 0x00."""
    data = np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()
    return data.replace(b"\xff", b"\xff\x00")


# encoder

#: byte -> coefficient: +-2 ... +-129
VALUES = np.array([(b // 2 + 2) * (1 - 2 * (b % 2)) for b in range(256)], np.int16)


def _field(value: int, width: int) -> int:
    """Code and value bits of a coefficient or difference: width - 1 - size ones, a zero, size value bits."""
    size = abs(value).bit_length()
    code = (1 << width - size) - 2
    return code << size | (value if value >= 0 else value + (1 << size) - 1)


AC_BYTE = np.array([_field(int(v) // 2 if v > 0 else -(-int(v) // 2), 8) for v in VALUES], np.uint8)
LAST_BIT = (np.abs(VALUES) & 1).astype(np.uint8)
DC_FIELD = np.array([_field(d, 9) for d in range(-130, 131)], np.uint16)


def table(kind: int, slot: int, symbols: list[tuple[int, int]]) -> bytes:
    """DHT segment of (code length, symbol) in the order of codes."""
    counts = bytes(sum(n == length for n, _ in symbols) for length in range(1, 17))
    return segment(0xC4, bytes([kind << 4 | slot]) + counts + bytes(s for _, s in symbols))


#: DC differences have sizes 0 to 8 and fields of 9 bits, AC values sizes 1 to 7 and fields of 8, runs of blocks codes of 4.
TABLES = table(0, 0, [(9 - s, s) for s in range(8, -1, -1)]) + table(1, 0, [(8 - s, s) for s in range(7, 0, -1)]) + table(1, 1, [(4, r << 4) for r in range(15)])


def scan(component: int, ac_slot: int, first: int, last: int, high: int, low: int) -> bytes:
    return segment(0xDA, bytes([1, component, ac_slot, first, last, high << 4 | low]))


def encode(payload: bytes) -> bytes:
    """A progressive JPEG that holds the payload; a comment segment has its size, the rest is filled by 255."""
    units = max(1, -(-len(payload) // 384))  # six blocks of 64
    across = int(np.ceil(np.sqrt(units)))
    down = -(-units // across)
    count = across * down
    data = np.full(count * 384, 255, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    blocks = data.reshape(-1, 64)
    parts = blocks[: 4 * count], blocks[4 * count : 5 * count], blocks[5 * count :]
    out = [b"\xff\xd8", segment(0xFE, b"payload %d" % len(payload)), segment(0xDB, b"\0" + b"\1" * 64)]
    out += [segment(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])), TABLES]
    for c, part in enumerate(parts, 1):
        dc = (VALUES[part[:, 0]] >> 1).astype(np.int64)
        fields = DC_FIELD[np.diff(dc, prepend=0) + 130]
        out += [scan(c, 0, 0, 0, 0, 1), stuffed(((fields[:, None] >> np.arange(8, -1, -1, dtype=np.uint16)) & 1).astype(np.uint8).ravel())]
    coded = [AC_BYTE[part] for part in parts]
    for a, b in BANDS:
        for c, part in enumerate(coded, 1):
            out += [scan(c, 0, a, b, 0, 1), part[:, a : b + 1].tobytes()]
    for c, part in enumerate(parts, 1):
        out += [scan(c, 0, 0, 0, 1, 0), stuffed((VALUES[part[:, 0]] & 1).astype(np.uint8))]
        bits = []
        for at in range(0, len(part), 32767):
            some = LAST_BIT[part[at : at + 32767, 1:]]
            power = len(some).bit_length() - 1
            head = power << power | len(some) - (1 << power)
            bits += [np.array([int(x) for x in f"{head:0{4 + power}b}"], np.uint8), some.ravel()]
        out += [scan(c, 1, 1, 63, 1, 0), stuffed(np.concatenate(bits))]
    return b"".join([*out, b"\xff\xd9"])


# decoder


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int
    across: int = 0  # blocks in a row of the array, whole units
    down: int = 0
    own_across: int = 0  # blocks that a scan of this component alone has
    own_down: int = 0
    coefficients: np.ndarray = None  # (blocks, 64) in zigzag order


@dataclass
class Huffman:
    lengths: dict[tuple[int, int], int]  # (length, code) -> symbol
    sizes: list[tuple[int, int]]  # (length, symbol)

    def pitch(self, dc: bool) -> int:
        """Size of the fields if all are of one size and none is a run, else 0."""
        found = {n + (s & 15) for n, s in self.sizes}
        plain = all(s <= 15 for _, s in self.sizes) and (dc or all(s & 15 for _, s in self.sizes))
        return found.pop() if plain and len(found) == 1 else 0


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quants: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        value = 0
        for _ in range(n):
            byte = self.data[self.at >> 3] if self.at >> 3 < len(self.data) else 255
            value = value << 1 | byte >> 7 - (self.at & 7) & 1
            self.at += 1
        return value

    def symbol(self, huffman: Huffman) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in huffman.lengths:
                return huffman.lengths[length, code]
        raise ValueError("no such code")

    def value(self, size: int) -> int:
        v = self.take(size)
        return v if not size or v >> size - 1 else v - (1 << size) + 1


def _huffman(body: bytes) -> tuple[dict[tuple[int, int], int], list[tuple[int, int]], int]:
    codes, sizes, code, at = {}, [], 0, 16
    for length in range(1, 17):
        for _ in range(body[length - 1]):
            codes[length, code] = body[at]
            sizes.append((length, body[at]))
            code += 1
            at += 1
        code <<= 1
    return codes, sizes, at


_tables: dict[bytes, list[tuple[int, Huffman]]] = {}


def tables(body: bytes) -> list[tuple[int, Huffman]]:
    """(class and slot, table) of a DHT segment."""
    if body not in _tables:
        if len(_tables) > 256:
            _tables.clear()
        found, at = [], 0
        while at < len(body):
            codes, sizes, used = _huffman(body[at + 1 :])
            found.append((body[at], Huffman(codes, sizes)))
            at += 1 + used
        _tables[body] = found
    return _tables[body]


def _values_of_fields(pitch: int, huffman: Huffman) -> np.ndarray:
    """Value of each field of this size; fields that no code begins have 0."""
    out = np.zeros(1 << pitch, np.int16)
    for (length, code), size in huffman.lengths.items():
        raw = np.arange(1 << size)
        out[(code << size) + raw] = np.where(raw >> max(0, size - 1) > 0, raw, raw - (1 << size) + 1) if size else 0
    return out


_field_values: dict[int, tuple[Huffman, np.ndarray]] = {}


def values_of_fields(pitch: int, huffman: Huffman) -> np.ndarray:
    kept = _field_values.get(id(huffman))
    if kept is None or kept[0] is not huffman:
        if len(_field_values) > 256:
            _field_values.clear()
        kept = _field_values[id(huffman)] = huffman, _values_of_fields(pitch, huffman)
    return kept[1]


def decode(data: bytes) -> Image:
    """Coefficient arrays of a progressive JPEG, all scans accumulated."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    image, huffman, restart, at = Image(), {}, 0, 2
    while True:
        marker = data[at + 1]
        if marker == 0xD9:
            return image
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                image.quants[body[k] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, k + 1).astype(np.int64)
                k += 1 + 64 * (1 + wide)
        elif marker == 0xC4:
            huffman.update(tables(body))
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif marker == 0xC2:
            _frame(image, body)
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("only progressive Huffman coding is read here")
        elif marker == 0xDA:
            stop = MARKER.search(data, at)
            end = stop.start() if stop else len(data)
            _scan(image, huffman, restart, body, data[at:end])
            at = end


def _frame(image: Image, body: bytes) -> None:
    precision, image.height, image.width, n = struct.unpack_from(">BHHB", body)
    if precision != 8:
        raise ValueError("only 8-bit samples are read here")
    image.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
    h, v = max(c.h for c in image.components), max(c.v for c in image.components)
    for c in image.components:
        c.across, c.down = c.h * -(-image.width // (8 * h)), c.v * -(-image.height // (8 * v))
        c.own_across, c.own_down = -(-image.width * c.h // (8 * h)), -(-image.height * c.v // (8 * v))
        c.coefficients = np.zeros((c.across * c.down, 64), np.int16)


def _scan(image: Image, huffman: dict[int, Huffman], restart: int, body: bytes, data: bytes) -> None:
    n = body[0]
    chosen = []
    for i in range(n):
        ident, slots = body[1 + 2 * i], body[2 + 2 * i]
        chosen.append((next(c for c in image.components if c.ident == ident), huffman.get(slots >> 4), huffman.get(16 | slots & 15)))
    first, last, approximation = body[1 + 2 * n :]
    high, low = approximation >> 4, approximation & 15
    pieces = [p.replace(b"\xff\x00", b"\xff") for p in (re.split(rb"\xff[\xd0-\xd7]", data) if restart else [data])]
    if n == 1 and len(pieces) == 1 and _whole(*chosen[0], first, last, high, low, pieces[0]):
        return
    if n == 1:
        c = chosen[0][0]
        units = [[(0, y * c.across + x)] for y in range(c.own_down) for x in range(c.own_across)]
    else:
        c = chosen[0][0]
        units = [[(i, (my * c.v + y) * c.across + mx * c.h + x) for i, (c, _, _) in enumerate(chosen) for y in range(c.v) for x in range(c.h)] for my in range(c.down // c.v) for mx in range(c.across // c.h)]
    step = restart or len(units)
    for piece, begin in zip(pieces, range(0, len(units), step), strict=False):
        _by_bits(chosen, units[begin : begin + step], first, last, high, low, Bits(piece))


def _whole(c: Component, dc: Huffman | None, ac: Huffman | None, first: int, last: int, high: int, low: int, data: bytes) -> bool:
    """Handles a scan of one component by array operations if its codes allow; False if not."""
    if (c.own_across, c.own_down) != (c.across, c.down):
        return False
    blocks = len(c.coefficients)
    raw = np.frombuffer(data, np.uint8)
    if first == 0 and high:
        c.coefficients[:, 0] |= np.unpackbits(raw, count=blocks).astype(np.int16) << low
        return True
    if first == 0:
        if not (pitch := dc.pitch(True)) or 8 * len(raw) < pitch * blocks:
            return False
        bits = np.unpackbits(raw, count=pitch * blocks).reshape(blocks, pitch)
        fields = bits @ (1 << np.arange(pitch - 1, -1, -1))
        c.coefficients[:, 0] = np.cumsum(values_of_fields(pitch, dc)[fields], dtype=np.int64) << low
        return True
    count = (last - first + 1) * blocks
    if not high:
        if ac.pitch(False) != 8 or len(raw) != count:
            return False
        values = values_of_fields(8, ac)[raw]
        c.coefficients[:, first : last + 1] = (values << low).reshape(blocks, -1)
        return True
    band = c.coefficients[:, first : last + 1]
    if not band.all():
        return False
    # all coefficients are known to be nonzero, so blocks have no codes but those of runs of blocks
    bits, at, done = np.unpackbits(raw), 0, 0
    head = Bits(data)
    while done < blocks:
        head.at = at
        symbol = head.symbol(ac)
        if symbol & 15 or symbol >> 4 == 15:
            return False
        run = (1 << (symbol >> 4)) + head.take(symbol >> 4)
        at = head.at
        size = run * (last - first + 1)
        part = band[done : done + run]
        fix = bits[at : at + size].reshape(part.shape).astype(np.int16) << low
        part += np.where(part > 0, fix, -fix)
        at += size
        done += run
    return True


def _by_bits(chosen, units, first: int, last: int, high: int, low: int, bits: Bits) -> None:
    before = [0] * len(chosen)
    blocks_left = 0  # of a run of blocks whose band has ended
    for unit in units:
        for i, block in unit:
            c, dc, ac = chosen[i]
            values = c.coefficients[block]
            if first == 0:
                if high:
                    values[0] |= bits.take(1) << low
                else:
                    before[i] += bits.value(bits.symbol(dc))
                    values[0] = before[i] << low
            elif not high:
                blocks_left = _ac_first(values, ac, first, last, low, bits, blocks_left)
            else:
                blocks_left = _ac_refine(values, ac, first, last, low, bits, blocks_left)


def _ac_first(values, ac, first, last, low, bits, blocks_left) -> int:
    if blocks_left:
        return blocks_left - 1
    k = first
    while k <= last:
        symbol = bits.symbol(ac)
        run, size = symbol >> 4, symbol & 15
        if size:
            k += run
            values[k] = bits.value(size) * (1 << low)
        elif run < 15:
            return (1 << run) + bits.take(run) - 1
        else:
            k += 15
        k += 1
    return 0


def _ac_refine(values, ac, first, last, low, bits, blocks_left) -> int:
    def fix(k):
        if bits.take(1):
            values[k] += (1 << low) if values[k] > 0 else -(1 << low)

    k = first
    if not blocks_left:
        while k <= last:
            symbol = bits.symbol(ac)
            run, size = symbol >> 4, symbol & 15
            fresh = 0
            if size:
                fresh = (1 << low) if bits.take(1) else -(1 << low)
            elif run < 15:
                blocks_left = (1 << run) + bits.take(run)
                break
            while k <= last:
                if values[k]:
                    fix(k)
                else:
                    if not run:
                        break
                    run -= 1
                k += 1
            if fresh and k <= last:
                values[k] = fresh
            k += 1
    if blocks_left:
        for k in range(k, last + 1):
            if values[k]:
                fix(k)
        blocks_left -= 1
    return blocks_left


def payload(image: Image) -> bytes:
    """The bytes that ``encode`` stored, from the coefficients."""
    if not image.comment.startswith(b"payload "):
        raise ValueError("this image holds no payload")
    v = np.concatenate([c.coefficients for c in image.components]).ravel()
    size = np.abs(v)
    return (2 * (size - 2) + (v < 0)).astype(np.uint8).tobytes()[: int(image.comment[8:])]


#: Basis of the inverse transform, scaled to integers: sums of products stay below 2**53, so doubles are exact.
SCALE = 12
_cosine = np.array([[(0.5**0.5 if u == 0 else 1.0) / 2 * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
BASIS = np.rint(np.einsum("ux,vy->uvxy", _cosine, _cosine).reshape(64, 64)[ZIGZAG] * (1 << SCALE))


def samples(c: Component, quant: np.ndarray) -> np.ndarray:
    """Plane of a component, whole blocks: inverse transform, level shift, clipped to a byte."""
    values = c.coefficients * quant if (quant != 1).any() else c.coefficients
    plane = (values.astype(np.float64) @ BASIS + (1 << SCALE - 1)) * 2.0**-SCALE
    np.floor(plane, out=plane)
    plane += 128
    np.clip(plane, 0, 255, out=plane)
    return plane.astype(np.uint8).reshape(c.down, c.across, 8, 8).transpose(0, 2, 1, 3).reshape(8 * c.down, 8 * c.across)


def rgb(image: Image) -> np.ndarray:
    """(height, width, 3) tensor of bytes; components of lower resolution are repeated to the full one."""
    h, v = max(c.h for c in image.components), max(c.v for c in image.components)
    planes = []
    for c in image.components:
        plane = samples(c, image.quants[c.quant])
        if (c.h, c.v) != (h, v):
            plane = plane.repeat(v // c.v, 0).repeat(h // c.h, 1)
        planes.append(plane[: image.height, : image.width].astype(np.int32))
    if len(planes) == 1:
        return np.repeat(planes[0].astype(np.uint8)[..., None], 3, 2)
    y, cb, cr = planes[0] << 16, planes[1] - 128, planes[2] - 128
    out = np.empty((image.height, image.width, 3), np.uint8)
    half = 1 << 15
    for k, plane in enumerate((y + 91881 * cr + half, y - 22554 * cb - 46802 * cr + half, y + 116130 * cb + half)):
        plane >>= 16
        np.clip(plane, 0, 255, out=plane)
        out[..., k] = plane
    return out
