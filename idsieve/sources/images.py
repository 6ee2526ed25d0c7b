"""Image files as samples: PNG and JPEG bytes to RGB, what their headers say, and PNG bytes from samples.

Decoders work on one file's bytes with numpy and are called within Arrow batches (operators.forensics). A file that
they can't read raises Unreadable, with the reason.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np

MAX_PIXELS = 1 << 27  # more are refused before memory is taken for them
BAND = 256  # rows of a PNG whose filters are undone at a time
TOGETHER = 1 << 22  # bytes of samples of files that are decoded together


class Unreadable(ValueError):
    """Bytes that are no image that can be decoded."""


# What files of image formats begin with.
MAGIC = {"PNG": b"\x89PNG\r\n\x1a\n", "JPEG": b"\xff\xd8\xff", "GIF": b"GIF8", "BMP": b"BM", "PDF": b"%PDF", "TIFF": b"II*\x00", "WEBP": b"RIFF"}


def format_of(content: bytes) -> str:
    return next((name for name, magic in MAGIC.items() if content.startswith(magic)), "UNKNOWN")


def _sized(width: int, height: int) -> None:
    if not width or not height:
        raise Unreadable("the image has no pixels")
    if width * height > MAX_PIXELS:
        raise Unreadable(f"{width} x {height} pixels are more than {MAX_PIXELS}")


# PNG ----------------------------------------------------------------------------------------------------

CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}  # samples of a pixel by colour type
# Of each pass of an interlaced image, first row and column, and steps.
ADAM7 = [(0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)]


def chunks(content: bytes):
    """(type, data) of a PNG's chunks; damaged ones that matter for the samples are an error."""
    at = 8
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        data = content[at + 8 : at + 8 + size]
        if len(data) < size or at + 12 + size > len(content):
            raise Unreadable("the file ends within a chunk")
        if kind[:1].isupper() and zlib.crc32(kind + data) != struct.unpack(">I", content[at + 8 + size : at + 12 + size])[0]:
            raise Unreadable(f"the checksum of a chunk {kind.decode(errors='replace')} is wrong")
        yield kind, data
        if kind == b"IEND":
            return
        at += 12 + size


def _along_diagonals(raw: np.ndarray, kinds: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Rows (images x rows x pixels x bytes) without their filters, below the rows ``top``; no more rows than pixels.

    A byte may need the one to its left and those above, so bytes are made along diagonals, all rows and images of one at a time.
    They lie by diagonals, so that what a diagonal needs are slices of the two before it.
    """
    n, high, across, step = raw.shape
    laid = np.zeros((high + across + 1, high + 1, n * step), np.uint8)  # (y, x) at [2 + y + x, 1 + y]; what is left of a row is 0
    a, b, c = laid.strides
    place = np.lib.stride_tricks.as_strided(laid[1:], (high + 1, across, n, step), (a + b, a, step * c, c))
    place[0], place[1:] = top.swapaxes(0, 1), raw.transpose(1, 2, 0, 3)
    has = [np.repeat(kinds.T == k, step, 1) for k in range(5)]
    before, last = laid[0].astype(np.int16), laid[1].astype(np.int16)
    for d in range(high + across - 1):
        lo, hi = max(0, d - across + 1), min(high, d + 1)
        left, above, corner = last[lo + 1 : hi + 1], last[lo:hi], before[lo:hi]
        down, right = above - corner, left - corner
        to_left, to_above, to_corner = abs(down), abs(right), abs(down + right)
        nearest = np.where((to_left <= to_above) & (to_left <= to_corner), left, np.where(to_above <= to_corner, above, corner))
        add = np.where(has[4][lo:hi], nearest, np.where(has[3][lo:hi], (left + above) >> 1, left * has[1][lo:hi] + above * has[2][lo:hi]))
        laid[d + 2, lo + 1 : hi + 1] += add.astype(np.uint8)
        before, last = last, laid[d + 2].astype(np.int16)
    return place[1:].transpose(2, 0, 1, 3)


def unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """Rows of bytes without their filters, of images of one size (images x rows x bytes); the first byte of each row tells which.
    ``step``: bytes of a pixel."""
    n, high, across = *lines.shape[:2], (lines.shape[2] - 1) // step
    kinds, raw = lines[:, :, 0], lines[:, :, 1:].reshape(n, high, across, step)
    out = np.empty((n, high, across, step), np.uint8)
    if (kinds <= 2).all():  # no diagonals needed
        for y in range(high):
            out[:, y] = raw[:, y]
            left, above = kinds[:, y] == 1, kinds[:, y] == 2
            if left.any():
                out[left, y] = np.cumsum(raw[left, y], 1, np.uint8)
            if y and above.any():
                out[above, y] += out[above, y - 1]
        return out.reshape(n, high, -1)
    top, rows = np.zeros((n, across, step), np.uint8), min(BAND, across)
    for y in range(0, high, rows):
        out[:, y : y + rows] = _along_diagonals(raw[:, y : y + rows], kinds[:, y : y + rows], top)
        top = out[:, min(y + rows, high) - 1]
    return out.reshape(n, high, -1)


class _Png(NamedTuple):
    """A PNG whose rows still have their filters: of each pass the place in the image, and the rows."""

    width: int
    height: int
    depth: int
    colour: int
    palette: np.ndarray | None
    passes: list[tuple[int, int, int, int]]
    lines: list[np.ndarray]

    @property
    def step(self) -> int:
        return max(1, CHANNELS[self.colour] * self.depth // 8)

    def samples(self, rows: np.ndarray, width: int) -> np.ndarray:
        """The samples of one pass as height x width x channels."""
        channels = CHANNELS[self.colour]
        if self.depth == 16:
            rows = rows[:, ::2]  # the high bytes
        elif self.depth < 8:
            parts = [(rows >> shift) & ((1 << self.depth) - 1) for shift in range(8 - self.depth, -1, -self.depth)]
            rows = np.stack(parts, 2).reshape(len(rows), -1)[:, : width * channels]
        return rows.reshape(len(rows), width, channels)

    def rgb(self, rows: list[np.ndarray]) -> np.ndarray:
        """RGB samples, from the rows of each pass without their filters; transparency is left out."""
        channels = CHANNELS[self.colour]
        image = np.zeros((self.height, self.width, channels), np.uint8)
        for (y, x, dy, dx), own in zip(self.passes, rows, strict=True):
            part = image[y::dy, x::dx]
            part[:] = self.samples(own, part.shape[1])
        if self.colour == 3:
            if self.palette is None or image.max() >= len(self.palette):
                raise Unreadable("a colour is not in the palette")
            return self.palette[image[:, :, 0]]
        if self.depth < 8:
            image = image * np.uint8(255 // ((1 << self.depth) - 1))
        return np.repeat(image[:, :, :1], 3, 2) if channels < 3 else np.ascontiguousarray(image[:, :, :3])


def open_png(content: bytes) -> _Png:
    """A PNG of any depth, colour type or interlacing, unpacked."""
    header, palette, packed = None, None, []
    for kind, data in chunks(content):
        if kind == b"IHDR" and len(data) == 13:
            header = struct.unpack(">IIBBBBB", data)
        elif kind == b"PLTE":
            palette = np.frombuffer(data[: len(data) // 3 * 3], np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(data)
    if header is None or header[3] not in CHANNELS or header[2] not in (1, 2, 4, 8, 16):
        raise Unreadable("there is no header")
    width, height, depth, colour, _, _, interlaced = header
    _sized(width, height)
    passes = [p for p in (ADAM7 if interlaced else [(0, 0, 1, 1)]) if height > p[0] and width > p[1]]
    sizes = [(-(-(height - y) // dy), 1 + (-(-(width - x) // dx) * CHANNELS[colour] * depth + 7) // 8) for y, x, dy, dx in passes]
    try:
        data = zlib.decompressobj().decompress(b"".join(packed), sum(rows * size for rows, size in sizes))  # whatever the data unpack to, no more than this is needed
    except zlib.error as e:
        raise Unreadable(f"the samples can't be unpacked: {e}") from e
    lines, at = [], 0
    for rows, size in sizes:
        if at + rows * size > len(data):
            raise Unreadable("there are fewer samples than the header says")
        lines.append(np.frombuffer(data, np.uint8)[at : at + rows * size].reshape(rows, size))
        if (lines[-1][:, 0] > 4).any():
            raise Unreadable("a row has an unknown filter")
        at += rows * size
    return _Png(width, height, depth, colour, palette, passes, lines)


def decode_png(content: bytes) -> np.ndarray:
    """RGB samples of a PNG of any depth, colour type or interlacing; transparency is left out."""
    png = open_png(content)
    return png.rgb([unfiltered(lines[None], png.step)[0] for lines in png.lines])


def encode_png(image: np.ndarray, filters: tuple[int, ...] = (0,), software: str | None = None) -> bytes:
    """A PNG of height x width x 1 or 3 samples. Rows take the filters in turn; ``software`` goes to an Exif chunk."""
    height, width, channels = image.shape
    padded = np.zeros((height + 1, width + 1, channels), np.int16)
    padded[1:, 1:] = image
    here, left, above, corner = padded[1:, 1:], padded[1:, :-1], padded[:-1, 1:], padded[:-1, :-1]
    guess = left + above - corner
    a, b, c = abs(guess - left), abs(guess - above), abs(guess - corner)
    taken = [0 * here, left, above, (left + above) >> 1, np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))]
    kinds = np.resize(np.array(filters, np.uint8), height)
    rows = np.select([(kinds == k)[:, None, None] for k in range(5)], [here - t for t in taken]).astype(np.uint8).reshape(height, -1)
    packed = zlib.compress(np.concatenate((kinds[:, None], rows), 1).tobytes())
    parts = [(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0 if channels == 1 else 2, 0, 0, 0))]
    if software is not None:
        said = software.encode() + b"\x00"
        inline = len(said) <= 4
        entry = struct.pack(">HHI", 0x0131, 2, len(said)) + (said.ljust(4, b"\x00") if inline else struct.pack(">I", 26))
        parts.append((b"eXIf", b"MM\x00*" + struct.pack(">IH", 8, 1) + entry + bytes(4) + (b"" if inline else said)))
    parts += [(b"IDAT", packed), (b"IEND", b"")]
    return MAGIC["PNG"] + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in parts)


# JPEG ---------------------------------------------------------------------------------------------------


@functools.lru_cache(1)
def zigzag() -> np.ndarray:
    """Place (8 * row + column) of each coefficient in the order of a scan: along the diagonals, in turn up and down."""
    places = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    return np.array([8 * y + x for y, x in places])


@functools.lru_cache(1)
def cosines() -> np.ndarray:
    """The orthonormal DCT of 8 samples as a matrix."""
    k, n = np.arange(8)[:, None], np.arange(8)[None, :]
    return np.cos(np.pi * (2 * n + 1) * k / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)


def blocks_of(plane: np.ndarray) -> np.ndarray:
    """A plane whose sides are multiples of 8, as rows x columns of 8x8 blocks."""
    return plane.reshape(plane.shape[0] // 8, 8, -1, 8).swapaxes(1, 2)


def plane_of(blocks: np.ndarray) -> np.ndarray:
    return blocks.swapaxes(1, 2).reshape(blocks.shape[0] * 8, -1)


def from_cosines(coefficients: np.ndarray) -> np.ndarray:
    """Samples from 0 to 255 of blocks of coefficients, halves rounded up."""
    c = cosines()
    return np.clip(np.floor(c.T @ coefficients @ c + (128.5 + 1e-7)), 0, 255).astype(np.uint8)


def to_cosines(samples: np.ndarray) -> np.ndarray:
    c = cosines()
    return c @ (samples.astype(np.float64) - 128) @ c.T


def doubled(plane: np.ndarray, down: bool) -> np.ndarray:
    """Twice as many samples across (and down), each from the nearest and the second nearest one, three to one."""
    p = plane.astype(np.int32)
    if down:
        up, low = np.concatenate((p[:1], p[:-1])), np.concatenate((p[1:], p[-1:]))
        p = np.stack((3 * p + up, 3 * p + low), 1).reshape(2 * len(plane), -1)
    before, after = np.concatenate((p[:, :1], p[:, :-1]), 1), np.concatenate((p[:, 1:], p[:, -1:]), 1)
    shift, first, second = (4, 8, 7) if down else (2, 1, 2)
    left, right = (3 * p + before + first) >> shift, (3 * p + after + second) >> shift
    return np.stack((left, right), 2).reshape(len(p), -1).astype(np.uint8)


def rgb_of(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """RGB by the usual weights of luminance and colour differences, in fixed point."""
    y, b, r = y.astype(np.int32), cb.astype(np.int32) - 128, cr.astype(np.int32) - 128
    fixed = lambda x: int(x * 65536 + 0.5)
    half = 1 << 15
    red, blue = y + ((fixed(1.402) * r + half) >> 16), y + ((fixed(1.772) * b + half) >> 16)
    green = y + ((-fixed(0.344136286) * b - fixed(0.714136286) * r + half) >> 16)
    return np.clip(np.stack((red, green, blue), 2), 0, 255).astype(np.uint8)


def ycc_of(rgb: np.ndarray) -> list[np.ndarray]:
    """Luminance and colour differences from 0 to 255 of RGB, in fixed point."""
    r, g, b = (rgb[:, :, k].astype(np.int32) for k in range(3))
    fixed = lambda x: int(x * 65536 + 0.5)
    half = 1 << 15
    y = (fixed(0.299) * r + fixed(0.587) * g + fixed(0.114) * b + half) >> 16
    cb = (-fixed(0.168735892) * r - fixed(0.331264108) * g + fixed(0.5) * b + (128 << 16) + half - 1) >> 16
    cr = (fixed(0.5) * r - fixed(0.418687589) * g - fixed(0.081312411) * b + (128 << 16) + half - 1) >> 16
    return [y, cb, cr]


def code_table(sizes: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits: 256 times the length of the code that they begin with, and its symbol; 0 if there is none."""
    table, code, at = np.zeros(1 << 16, np.int64), 0, 0
    for length, n in enumerate(sizes, 1):
        for _ in range(n):
            first, last = code << (16 - length), (code + 1) << (16 - length)
            if last > 1 << 16 or at >= len(symbols):
                raise Unreadable("a table of codes is wrong")
            table[first:last] = 256 * length + symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table.tolist()


class _Bits:
    """The bits of one restart interval, and the codes in them."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff") + bytes(64), np.uint8).astype(np.int64)
        self.words = ((raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]).tolist()
        self.at, self.end = 0, 8 * (len(raw) - 64) + 256  # some bits may be left off at the end

    def code(self, table: list[int]) -> int:
        at = self.at
        if at > self.end:
            raise Unreadable("the file ends within the samples")
        found = table[(self.words[at >> 3] >> (16 - (at & 7))) & 0xFFFF]
        if not found:
            raise Unreadable("there is no such code")
        self.at = at + (found >> 8)
        return found & 255

    def take(self, n: int) -> int:
        at = self.at
        self.at = at + n
        return ((self.words[at >> 3] << (at & 7)) & 0xFFFFFFFF) >> (32 - n) if n else 0

    def value(self, n: int) -> int:
        """A number of n bits; those that begin with 0 are negative."""
        if n > 16:
            raise Unreadable("a coefficient is too large")
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


class _Component:
    def __init__(self, number: int, across: int, down: int, table: int):
        self.number, self.across, self.down, self.table = number, across, down, table
        self.dc = self.ac = None
        self.before = 0


def _first(bits: _Bits, c: _Component, out: list[int], start: int, stop: int, shift: int, run: int) -> int:
    """The coefficients start..stop of a block for the first time, in the order of the scan; blocks still without any."""
    if start == 0:
        c.before += bits.value(bits.code(c.dc))
        out[0] = c.before << shift
        start = 1
    if run:
        return run - 1
    k = start
    while k <= stop:
        code = bits.code(c.ac)
        zeros, size = code >> 4, code & 15
        if size:
            k += zeros
            if k > stop:
                raise Unreadable("a block has too many coefficients")
            out[k] = bits.value(size) << shift
            k += 1
        elif zeros == 15:
            k += 16
        else:
            return (1 << zeros) - 1 + bits.take(zeros)
    return 0


def _refined(bits: _Bits, c: _Component, out: list[int], start: int, stop: int, shift: int, run: int) -> int:
    """One more bit of the coefficients start..stop of a block; blocks still without new ones."""
    bit = 1 << shift
    if start == 0:
        if bits.take(1):
            out[0] |= bit
        return 0
    k = start

    def more(upto: int, zeros: int) -> int:
        """Correct what is there, up to the place where ``zeros`` places without a value have passed."""
        k = upto
        while k <= stop:
            if out[k]:
                if bits.take(1) and not abs(out[k]) & bit:
                    out[k] += bit if out[k] > 0 else -bit
            else:
                if not zeros:
                    return k
                zeros -= 1
            k += 1
        return k

    if run:
        more(k, 64)
        return run - 1
    while k <= stop:
        code = bits.code(c.ac)
        zeros, size = code >> 4, code & 15
        if not size and zeros < 15:
            left = (1 << zeros) + bits.take(zeros)
            more(k, 64)
            return left - 1
        new = (bit if bits.take(1) else -bit) if size else 0
        k = more(k, zeros)
        if k > stop:
            if new:
                raise Unreadable("a block has too many coefficients")
            break
        if new:
            out[k] = new
        k += 1
    return 0


class _Jpeg:
    """The segments of a JPEG file, and its coefficients."""

    def __init__(self, content: bytes):
        self.content = content
        self.quantisers: dict[int, np.ndarray] = {}
        self.codes: dict[int, list[int]] = {}
        self.components: list[_Component] = []
        self.interval, self.colours, self.scans = 0, None, 0
        self.read()

    def read(self) -> None:
        at, content = 2, self.content
        while True:
            while at < len(content) and content[at] != 0xFF:
                at += 1
            while at < len(content) and content[at] == 0xFF:
                at += 1
            if at >= len(content):
                raise Unreadable("the file ends before its end is marked")
            marker = content[at]
            at += 1
            if marker == 0xD9:
                return
            if marker == 0 or marker == 1 or 0xD0 <= marker <= 0xD8:
                continue
            size = int.from_bytes(content[at : at + 2], "big")
            data = content[at + 2 : at + size]
            if size < 2 or len(data) < size - 2:
                raise Unreadable("the file ends within a segment")
            at += size
            if marker == 0xDB:
                self.quantiser(data)
            elif marker == 0xC4:
                self.code(data)
            elif marker in (0xC0, 0xC1, 0xC2):
                self.frame(marker == 0xC2, data)
            elif 0xC3 <= marker <= 0xCF:
                raise Unreadable("lossless, arithmetic and hierarchical coding are not supported")
            elif marker == 0xDD:
                self.interval = int.from_bytes(data[:2], "big")
            elif marker == 0xEE and data[:5] == b"Adobe" and len(data) >= 12:
                self.colours = data[11]
            elif marker == 0xDA:
                at = self.scan(data, at)

    def quantiser(self, data: bytes) -> None:
        at = 0
        while at < len(data):
            wide, number = data[at] >> 4, data[at] & 15
            values = np.frombuffer(data[at + 1 : at + 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8)
            if len(values) < 64:
                raise Unreadable("a table of quantisers is short")
            self.quantisers[number] = values.astype(np.int64)
            at += 1 + 64 * (1 + wide)

    def code(self, data: bytes) -> None:
        at = 0
        while at + 17 <= len(data):
            sizes = data[at + 1 : at + 17]
            self.codes[data[at]] = code_table(sizes, data[at + 17 : at + 17 + sum(sizes)])
            at += 17 + sum(sizes)

    def frame(self, progressive: bool, data: bytes) -> None:
        if self.components:
            raise Unreadable("there is more than one frame")
        depth, self.height, self.width, n = struct.unpack(">BHHB", data[:6])
        if depth != 8 or n not in (1, 3, 4) or len(data) < 6 + 3 * n:
            raise Unreadable("samples of other than 8 bits, or of other than 1, 3 or 4 components, are not supported")
        _sized(self.width, self.height)
        self.progressive = progressive
        for k in range(6, 6 + 3 * n, 3):
            across, down = data[k + 1] >> 4, data[k + 1] & 15
            if not 1 <= across <= 4 or not 1 <= down <= 4:
                raise Unreadable("a sampling factor is wrong")
            self.components.append(_Component(data[k], across, down, data[k + 2]))
        if n == 1:
            self.components[0].across = self.components[0].down = 1
        self.across, self.down = max(c.across for c in self.components), max(c.down for c in self.components)
        units = -(-self.width // (8 * self.across)), -(-self.height // (8 * self.down))
        for c in self.components:
            c.width, c.height = -(-self.width * c.across // self.across), -(-self.height * c.down // self.down)
            c.columns, c.rows = units[0] * c.across, units[1] * c.down
            c.blocks = {}
            c.coefficients = np.zeros((c.rows * c.columns, 64), np.int32)
        self.units = units

    def scan(self, data: bytes, at: int) -> int:
        if not self.components:
            raise Unreadable("there are samples before the frame")
        n = data[0]
        if len(data) < 4 + 2 * n:
            raise Unreadable("a scan is short")
        own = []
        for k in range(1, 1 + 2 * n, 2):
            c = next((c for c in self.components if c.number == data[k]), None)
            if c is None:
                raise Unreadable("a scan has an unknown component")
            c.dc, c.ac = self.codes.get(data[k + 1] >> 4), self.codes.get(16 + (data[k + 1] & 15))
            own.append(c)
        start, stop, steps = data[1 + 2 * n : 4 + 2 * n]
        high, shift = steps >> 4, steps & 15
        if not self.progressive:
            start, stop, high, shift = 0, 63, 0, 0
        if stop > 63 or start > stop or (start and n > 1):
            raise Unreadable("a scan is wrong")
        first = high == 0
        if any((c.dc is None and start == 0 and first) or (c.ac is None and stop > 0) for c in own):
            raise Unreadable("a table of codes is not there")
        self.scans += 1
        parts, at = self.entropy_coded(at)
        read = _first if first else _refined
        if self.progressive and start == 0:
            stop = 0  # coefficients of both kinds are never in one scan
        if n == 1:  # a single component has its own blocks only, by rows
            c = own[0]
            wide, tall = -(-c.width // 8), -(-c.height // 8)
            order = [[(c, y * c.columns + x)] for y in range(tall) for x in range(wide)]
        else:
            order = [[(c, (v * c.down + b) * c.columns + u * c.across + a) for c in own for b in range(c.down) for a in range(c.across)] for v in range(self.units[1]) for u in range(self.units[0])]
        every = self.interval or len(order)
        for k, lo in enumerate(range(0, len(order), every)):
            if k >= len(parts):
                raise Unreadable("the file ends within the samples")
            bits, run = _Bits(parts[k]), 0
            for c in own:
                c.before = 0
            for unit in order[lo : lo + every]:
                for c, place in unit:
                    block = c.blocks.get(place)
                    if block is None:
                        block = c.blocks[place] = [0] * 64
                    run = read(bits, c, block, start, stop, shift, run)
                    if not self.progressive:
                        run = 0
                        c.coefficients[place] = c.blocks.pop(place)
        return at

    def entropy_coded(self, at: int) -> tuple[list[bytes], int]:
        """The bytes of each restart interval, and where the next segment begins."""
        parts, begin = [], at
        while True:
            at = self.content.find(b"\xff", at)
            if at < 0 or at + 1 >= len(self.content):
                return [*parts, self.content[begin:]], len(self.content)
            marker = self.content[at + 1]
            if 0xD0 <= marker <= 0xD7:
                parts.append(self.content[begin:at])
                begin = at + 2
            elif marker not in (0, 0xFF):
                return [*parts, self.content[begin:at]], at
            at += 1 if marker == 0xFF else 2

    def planes(self) -> list[np.ndarray]:
        """The samples of each component in the image's size."""
        if not self.scans:
            raise Unreadable("there are no samples")
        out = []
        for c in self.components:
            for place, block in c.blocks.items():
                c.coefficients[place] = block
            c.blocks = {}
            if c.table not in self.quantisers:
                raise Unreadable("a table of quantisers is not there")
            steps = self.quantisers[c.table]
            plane = np.zeros((c.rows * 8, c.columns * 8), np.uint8)
            for row in range(c.rows):  # a row of blocks at a time
                natural = np.zeros((c.columns, 64))
                natural[:, zigzag()] = c.coefficients[row * c.columns : (row + 1) * c.columns] * steps
                plane[8 * row : 8 * row + 8] = plane_of(from_cosines(natural.reshape(1, -1, 8, 8)))
            plane = plane[: c.height, : c.width]
            across, down = self.across // c.across, self.down // c.down
            if across == 2 and down in (1, 2) and c.width > 2:
                plane = doubled(plane, down == 2)
            elif across > 1 or down > 1:
                plane = np.repeat(np.repeat(plane, down, 0), across, 1)
            if plane.shape[0] < self.height or plane.shape[1] < self.width:
                raise Unreadable("sampling factors that are no multiples are not supported")
            out.append(plane[: self.height, : self.width])
        return out


def decode_jpeg(content: bytes) -> np.ndarray:
    """RGB samples of a baseline, extended or progressive JPEG with Huffman codes, grey, in colour or with four components."""
    jpeg = _Jpeg(content)
    planes = jpeg.planes()
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, 2)
    as_rgb = jpeg.colours == 0 or (jpeg.colours is None and [c.number for c in jpeg.components[:3]] == list(b"RGB"))
    if len(planes) == 3:
        return np.stack(planes, 2) if as_rgb else rgb_of(*planes)
    # four components are stored inverted by the usual programs: colours without black, and how much is not black
    colour = rgb_of(*planes[:3]) if jpeg.colours == 2 else np.stack(planes[:3], 2)
    if jpeg.colours is None:
        colour, black = 255 - colour, 255 - planes[3]
    else:
        black = planes[3]
    return (colour.astype(np.int32) * black[:, :, None] // 255).astype(np.uint8)


def _attempt(step, *given):
    """What a step gives, or why it can't."""
    try:
        return step(*given)
    except Unreadable as e:
        return e
    except (IndexError, ValueError, struct.error) as e:  # sizes that don't fit
        return Unreadable(f"the file is damaged: {e}")


def _opened(content: bytes | None) -> _Png | np.ndarray:
    if content is None:
        raise Unreadable("there is no content")
    kind = format_of(content)
    if kind not in ("PNG", "JPEG"):
        raise Unreadable(f"files of format {kind} are not supported")
    return open_png(content) if kind == "PNG" else decode_jpeg(content)


def _finished(opened: list) -> Iterator[tuple[str, np.ndarray] | Unreadable]:
    """Opened files decoded; the rows of PNGs that have one size lose their filters together."""
    alike: dict[tuple, list[tuple[int, int]]] = {}
    for n, file in enumerate(opened):
        if isinstance(file, _Png):
            for k, lines in enumerate(file.lines):
                alike.setdefault((lines.shape, file.step, bool((lines[:, 0] > 2).any())), []).append((n, k))
    rows = {}
    for (_, step, _), own in alike.items():
        rows |= zip(own, unfiltered(np.stack([opened[n].lines[k] for n, k in own]), step), strict=True)
    for n, file in enumerate(opened):
        if isinstance(file, _Png):
            rgb = _attempt(file.rgb, [rows.pop((n, k)) for k in range(len(file.lines))])
            yield rgb if isinstance(rgb, Unreadable) else ("PNG", rgb)
        else:
            yield file if isinstance(file, Unreadable) else ("JPEG", file)


def decoded(contents: Iterable[bytes | None]) -> Iterator[tuple[str, np.ndarray] | Unreadable]:
    """For the bytes of each file (format, RGB samples), or why it can't be decoded, in their order.

    Small files are decoded together, as numpy takes longer to begin with a row of one than to do it. Files are taken in as they are
    asked for, so samples of TOGETHER bytes and one file at most are held.
    """
    opened, size = [], 0
    for content in contents:
        file = _attempt(_opened, content)
        opened.append(file)
        size += sum(lines.size for lines in file.lines) if isinstance(file, _Png) else 0 if isinstance(file, Unreadable) else file.size
        if size >= TOGETHER:
            yield from _finished(opened)
            opened, size = [], 0
    yield from _finished(opened)


def decode(content: bytes) -> tuple[str, np.ndarray]:
    """(format, RGB samples) of the bytes of a file; Unreadable for whatever can't be decoded."""
    found = next(decoded([content]))
    if isinstance(found, Unreadable):
        raise found
    return found


# headers ------------------------------------------------------------------------------------------------


def tiff_software(data: bytes) -> str | None:
    """The software that a TIFF directory (Exif) names."""
    if data[:4] not in (b"II*\x00", b"MM\x00*") or len(data) < 8:
        return None
    order = "<" if data[:2] == b"II" else ">"
    at = struct.unpack(order + "I", data[4:8])[0]
    if at + 2 > len(data):
        return None
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
        if len(entry) < 12:
            return None
        tag, kind, n = struct.unpack(order + "HHI", entry[:8])
        if tag == 0x0131 and kind == 2:
            begin = struct.unpack(order + "I", entry[8:])[0]
            said = entry[8 : 8 + n] if n <= 4 else data[begin : begin + n]
            return said.split(b"\x00")[0].decode("utf-8", "replace")
    return None


def described(content: bytes) -> dict:
    """format, width, height, software (Exif) and text_software (a PNG's text), as far as the headers tell; samples aren't looked at."""
    out = {"format": format_of(content), "width": None, "height": None, "software": None, "text_software": None}
    if out["format"] == "PNG":
        try:
            for kind, data in chunks(content):
                if kind == b"IHDR" and len(data) == 13:
                    out["width"], out["height"] = struct.unpack(">II", data[:8])
                elif kind == b"eXIf":
                    out["software"] = tiff_software(data)
                elif kind in (b"tEXt", b"iTXt") and data.startswith(b"Software\x00"):
                    said = data[9:] if kind == b"tEXt" else data[11:].split(b"\x00", 2)[-1] if data[9:10] == b"\x00" else b""
                    out["text_software"] = said.decode("latin-1" if kind == b"tEXt" else "utf-8", "replace")
        except Unreadable:
            pass  # what came before is known
    elif out["format"] == "JPEG":
        at = 2
        while at + 4 <= len(content) and content[at] == 0xFF:
            marker, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
            if marker == 0xFF:
                at += 1
                continue
            if marker == 0xDA:
                break
            data = content[at + 4 : at + 2 + size]
            if marker == 0xE1 and data[:6] == b"Exif\x00\x00" and out["software"] is None:
                out["software"] = tiff_software(data[6:])
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(data) >= 5:
                out["height"], out["width"] = struct.unpack(">HH", data[1:5])
            at += 2 + size
    return out
