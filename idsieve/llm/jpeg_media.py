"""Media columns: baseline JPEG.

``features`` parses the markers of JPEG images in a binary column, Huffman-decodes their scans and
rebuilds the luminance from the DC coefficients alone: a thumbnail with one sample for each 8x8 block.
All restart intervals of a batch are decoded in step with each other, one symbol at a time, so the
inner loop is numpy over thousands of intervals. ``encode_media`` stores bytes as such images without
loss: with a DC quantiser of 8, the DC coefficient of a flat block is its sample less 128.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytewords as B
from . import scratch

ROW = 192  # blocks in a row of a stored image, which is also its restart interval
MAX_ROWS = 8191  # an image is at most 65,535 samples high; longer payloads take several images
QUANT = 8
# With these code lengths a block takes whole bytes: one if its DC difference has 1 to 6 bits, else two. Equal passages of texts
# are equal bytes then, which the compression of the table that holds the images makes use of.
DC_COUNTS = [1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 1, 0]
DC_VALUES = [6, 5, 4, 3, 2, 1, 8, 7, 0]
AC_COUNTS = [1] + [0] * 15  # one code of one bit: end of block
AC_VALUES = [0]


def _codes(counts: list[int], values: list[int]) -> list[tuple[int, int, int]]:
    """(value, code, length) of a canonical Huffman table."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for v in values[at : at + n]:
            out.append((v, code, length))
            code += 1
        at += n
        code <<= 1
    return out


def _peek_table(counts: list[int], values: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(value, length) for every 16 bits that may come next; length 0 where no code matches."""
    value, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for v, code, n in _codes(counts, values):
        value[code << (16 - n) : (code + 1) << (16 - n)] = v
        length[code << (16 - n) : (code + 1) << (16 - n)] = n
    return value, length


def _header(rows: int) -> bytes:
    segment = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    return (
        b"\xff\xd8"
        + segment(0xDB, b"\0" + bytes([QUANT] * 64))
        + segment(0xC0, struct.pack(">BHHB3B", 8, rows * 8, ROW * 8, 1, 1, 0x11, 0))
        + segment(0xC4, b"\x00" + bytes(DC_COUNTS) + bytes(DC_VALUES))
        + segment(0xC4, b"\x10" + bytes(AC_COUNTS) + bytes(AC_VALUES))
        + segment(0xDD, struct.pack(">H", ROW))
        + segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


@functools.lru_cache(1)
def _diff_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for a block with each DC difference from -255 to 255, its end of block included."""
    dc = {v: (c, n) for v, c, n in _codes(DC_COUNTS, DC_VALUES)}
    bits, size = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        c, n = dc[s]
        bits[d + 255] = ((c << s) | (d if d >= 0 else d + (1 << s) - 1)) << 1
        size[d + 255] = n + s + 1
    return bits, size


def encode(payload: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(images of all texts, offsets of the texts in them) for payloads with so many rows of ROW bytes each."""
    total = int(rows.sum())
    bits, size = _diff_codes()
    dc = payload.reshape(total, ROW).astype(np.int64) - 128
    diff = np.diff(dc, axis=1, prepend=0) + 255
    length = np.empty((total, ROW + 1), np.int64)
    length[:, :ROW] = size[diff]
    row_bits = length[:, :ROW].sum(1)
    length[:, ROW] = pad = -row_bits % 8
    code = np.empty((total, ROW + 1), np.uint64)
    code[:, :ROW] = bits[diff]
    code[:, ROW] = (np.uint64(1) << pad.astype(np.uint64)) - np.uint64(1)
    row_bytes = (row_bits + pad) // 8
    row_at = np.cumsum(row_bytes) - row_bytes
    at = (np.cumsum(length, 1) - length + row_at[:, None] * 8).ravel()
    length, code = length.ravel(), code.ravel()
    # each code lies in two words of 32 bits at most
    shifted = code << (np.int64(64) - length - (at & 31)).astype(np.uint64) % np.uint64(64)
    word = at >> 5
    new = np.flatnonzero(np.diff(word, prepend=-1))
    either = np.bitwise_or.reduceat(shifted, new)
    words = np.zeros(int(word[-1]) + 2, np.uint32)
    words[word[new]] |= (either >> np.uint64(32)).astype(np.uint32)
    words[word[new] + 1] |= (either & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    raw = words.astype(">u4").view(np.uint8)[: int(row_bytes.sum())]
    # images: runs of at most MAX_ROWS rows of one text
    per_text = -(-rows // MAX_ROWS)
    text = np.repeat(np.arange(len(rows)), per_text)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    frame_rows = np.minimum(MAX_ROWS, rows[text] - nth * MAX_ROWS)
    head = np.frombuffer(_header(1), np.uint8)
    high = head.tobytes().index(b"\xff\xc0") + 5
    last = np.zeros(total, bool)
    last[np.cumsum(frame_rows) - 1] = True
    frame = np.repeat(np.arange(len(text)), frame_rows)
    in_frame = np.arange(total) - np.repeat(np.cumsum(frame_rows) - frame_rows, frame_rows)
    full = raw == 0xFF
    stuffed = np.concatenate(([0], np.cumsum(full)))
    # before a row: the heads, the ends of earlier images and the restart marks of earlier rows
    extra = (frame + 1) * len(head) + frame * 2 + 2 * (np.arange(total) - frame)
    row_of = np.repeat(np.arange(total), row_bytes)
    out = np.zeros(len(raw) + int(stuffed[-1]) + len(text) * (len(head) + 2) + 2 * (total - len(text)), np.uint8)
    out[np.arange(len(raw)) + stuffed[:-1] + extra[row_of]] = raw
    row_end = row_at + row_bytes + stuffed[row_at + row_bytes] + extra
    out[row_end] = 0xFF
    out[row_end + 1] = np.where(last, 0xD9, 0xD0 + in_frame % 8)
    frame_end = row_end[last] + 2
    frame_at = np.concatenate(([0], frame_end[:-1]))
    out[frame_at[:, None] + np.arange(len(head))] = head
    out[frame_at + high] = frame_rows * 8 >> 8
    out[frame_at + high + 1] = frame_rows * 8 & 255
    return out, np.concatenate(([0], frame_end[np.cumsum(per_text) - 1]))


@dataclass
class Frame:
    """One image of a batch: where its scan lies, its size, and the tables it uses."""

    start: int
    end: int
    width: int
    height: int
    interval: int
    components: tuple[tuple[int, int, int, int, int], ...]  # h, v, quantiser of DC, DC table, AC table
    tables: tuple[tuple[int, bytes], ...]


def _frames(data: bytes, stops: np.ndarray, at: int, end: int) -> list[Frame]:
    """The images from ``at`` to ``end``; ``stops`` has the markers that end a scan. Raises ValueError on what is no baseline JPEG."""
    frames = []
    while at < end:
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at += 2
        quant: dict[int, int] = {}
        tables: dict[int, bytes] = {}
        shape, interval = None, 0
        while True:
            if at + 4 > end or data[at] != 0xFF:
                raise ValueError("no marker")
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4])
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                i = 0
                while i < len(body):
                    wide = body[i] >> 4
                    quant[body[i] & 15] = int.from_bytes(body[i + 1 : i + 2 + wide])
                    i += 1 + 64 * (1 + wide)
            elif marker == 0xC4:
                i = 0
                while i < len(body):
                    n = sum(body[i + 1 : i + 17])
                    tables[body[i]] = body[i + 1 : i + 17 + n]
                    i += 17 + n
            elif marker == 0xC0:
                height, width = struct.unpack(">HH", body[1:5])
                shape = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
            elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
                raise ValueError("not baseline")
            elif marker == 0xDD:
                interval = int.from_bytes(body[:2])
            elif marker == 0xDA:
                break
        if shape is None:
            raise ValueError("no frame before the scan")
        use = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
        if len(use) != len(shape):
            raise ValueError("several scans")
        stop = int(stops[min(np.searchsorted(stops, at), len(stops) - 1)]) if len(stops) else end
        if stop < at or stop >= end:
            stop = end
        frames.append(Frame(at, stop, width, height, interval, tuple((h, v, quant[q], use[c] >> 4, use[c] & 15) for c, h, v, q in shape), tuple(sorted(tables.items()))))
        at = stop + 2
    return frames


def _thumbnails(data: np.ndarray, frames: list[Frame]) -> list[np.ndarray]:
    """DC-only luminance of frames that share tables and components, a sample for each block."""
    first = frames[0]
    parts = first.components
    tables = {k: _peek_table(list(v[:16]), list(v[16:])) for k, v in first.tables}
    single = len(parts) == 1
    slots = [(c, x, y) for c, (h, v, *_) in enumerate(parts) for y in range(1 if single else v) for x in range(1 if single else h)]
    hmax, vmax = (1, 1) if single else (max(p[0] for p in parts), max(p[1] for p in parts))
    peeks = [(*tables[parts[c][3]], *tables[16 | parts[c][4]]) for c, _, _ in slots]
    dc_value, dc_length, ac_value, ac_length = (np.stack([p[i] for p in peeks]) for i in range(4))
    component = np.array([c for c, _, _ in slots])
    luma = [i for i, (c, _, _) in enumerate(slots) if c == 0]
    # the bytes of all scans without stuffing and restart marks, and where the intervals begin
    inside = np.zeros(len(data) + 1, np.int8)
    for f in frames:
        inside[f.start] += 1
        inside[f.end] -= 1
    inside = np.cumsum(inside[:-1]) > 0
    full = np.flatnonzero((data[:-1] == 0xFF) & inside[:-1] & inside[1:])
    after = data[full + 1]
    marks = full[(after >= 0xD0) & (after <= 0xD7)]
    inside[full[after == 0] + 1] = False
    inside[marks] = inside[marks + 1] = False
    place = np.concatenate(([0], np.cumsum(inside)))
    raw = np.concatenate((data[inside], np.zeros(8, np.uint8))).astype(np.uint64)
    window = (raw[:-4] << np.uint64(32)) | (raw[1:-3] << np.uint64(24)) | (raw[2:-2] << np.uint64(16)) | (raw[3:-1] << np.uint64(8)) | raw[4:]
    begin, count, out_at, grids, total = [], [], [], [], 0
    for f in frames:
        wide, tall = -(-f.width // (8 * hmax)), -(-f.height // (8 * vmax))
        mcus = wide * tall
        grids.append((total, wide, tall))
        own = place[[f.start, *(marks[np.searchsorted(marks, f.start) : np.searchsorted(marks, f.end)] + 2)]]
        step = f.interval or mcus
        sizes = np.minimum(step, mcus - np.arange(len(own)) * step)
        if sizes.min() <= 0 or sizes.sum() != mcus:
            raise ValueError("restart marks don't fit the size")
        begin.append(own), count.append(sizes), out_at.append(total + np.arange(len(own)) * step)
        total += mcus
    bit, left, where = np.concatenate(begin) * 8, np.concatenate(count), np.concatenate(out_at)
    n, limit = len(bit), 8 * (len(window) - 1)
    samples = np.zeros((len(slots), total), np.int64)
    predicted = np.zeros((len(parts), n), np.int64)
    slot, k = np.zeros(n, np.int64), np.zeros(n, np.int64)
    live = np.arange(n)

    def take(width):  # the next bits of each live interval, so many as `width` says
        b = bit[live]
        return (window[b >> 3] >> (np.int64(40) - (b & 7) - width).astype(np.uint64)).astype(np.int64) & ((1 << width) - 1)

    sixteen = np.int64(16)
    while len(live):
        if (bit[live] > limit).any():
            raise ValueError("the scan is too short")
        s, kk = slot[live], k[live]
        peek = take(sixteen)
        dc = kk == 0
        value = np.where(dc, dc_value[s, peek], ac_value[s, peek])
        length = np.where(dc, dc_length[s, peek], ac_length[s, peek])
        if (length == 0).any():
            raise ValueError("unknown code")
        bit[live] += length
        low = value & 15
        if dc.any():
            amount = take(low)
            diff = np.where((low > 0) & (amount < (1 << np.maximum(low - 1, 0))), amount - (1 << low) + 1, amount)
            at = live[dc]
            c = component[s[dc]]
            predicted[c, at] += diff[dc]
            samples[s[dc], where[at]] = predicted[c, at]
        bit[live] += low
        run = value >> 4
        step = np.where(dc, 1, np.where(low > 0, run + 1, np.where(run == 15, 16, 64)))
        kk = kk + step
        done = kk >= 64
        k[live] = np.where(done, 0, kk)
        if done.any():
            over = live[done]
            slot[over] += 1
            wrap = over[slot[over] == len(slots)]
            slot[wrap] = 0
            left[wrap] -= 1
            where[wrap] += 1
            if len(wrap):
                live = live[left[live] > 0]
    h, v = (1, 1) if single else parts[0][:2]
    level = np.clip((samples[luma] * parts[0][2] + 4) // 8 + 128, 0, 255).astype(np.uint8)
    out = []
    for f, (at, wide, tall) in zip(frames, grids, strict=True):
        blocks = level[:, at : at + wide * tall].reshape(v, h, tall, wide).transpose(2, 0, 3, 1).reshape(tall * v, wide * h)
        out.append(blocks[: -(-f.height * v // (8 * vmax)), : -(-f.width * h // (8 * hmax))])
    return out


def thumbnails(data: np.ndarray, offsets: np.ndarray) -> list[list[np.ndarray] | None]:
    """The thumbnails of the images in each value; None for a value that is no baseline JPEG."""
    ff = np.flatnonzero(data[:-1] == 0xFF)
    after = data[ff + 1]
    stops = ff[(after != 0) & ~((after >= 0xD0) & (after <= 0xD7)) & (after != 0xFF)]
    raw = data.tobytes()
    found: list[list[np.ndarray] | None] = []
    groups: dict[tuple, list[tuple[Frame, int, int]]] = {}
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        try:
            frames = _frames(raw, stops, a, b) if a < b else []
        except (ValueError, IndexError, KeyError, struct.error):
            frames = []
        found.append([None] * len(frames) if frames else None)
        for j, f in enumerate(frames):
            groups.setdefault((f.components, f.tables), []).append((f, i, j))
    for group in groups.values():
        try:
            made = list(_thumbnails(data, [f for f, _, _ in group]))
        except (ValueError, IndexError, KeyError):  # one of them is damaged: one by one
            made = []
            for f, _, _ in group:
                try:
                    made.append(_thumbnails(data, [f])[0])
                except (ValueError, IndexError, KeyError):
                    made.append(None)
        for (_, i, j), t in zip(group, made, strict=True):
            if found[i] is not None:
                if t is None:
                    found[i] = None
                else:
                    found[i][j] = t
    return found


def _grid(image: np.ndarray, tall: int, wide: int) -> np.ndarray:
    """Means of tall x wide cells that cover the image; a small image repeats its samples."""
    sums = np.zeros((image.shape[0] + 1, image.shape[1] + 1), np.int64)
    np.cumsum(np.cumsum(image, 0, dtype=np.int64), 1, out=sums[1:, 1:])
    y, x = (np.arange(n) * size // n for n, size in ((tall, image.shape[0]), (wide, image.shape[1])))
    y2, x2 = (np.maximum(a + 1, (np.arange(n) + 1) * size // n) for a, n, size in ((y, tall, image.shape[0]), (x, wide, image.shape[1])))
    cells = sums[np.ix_(y2, x2)] - sums[np.ix_(y, x2)] - sums[np.ix_(y2, x)] + sums[np.ix_(y, x)]
    return cells / ((y2 - y)[:, None] * (x2 - x)[None, :])


def thumbnail_hash(image: np.ndarray) -> str:
    """64 bits of cells above the mean and 64 of cells brighter than their right neighbour, as hex."""
    mean, step = _grid(image, 8, 8), _grid(image, 8, 9)
    return np.packbits(np.concatenate(((mean > mean.mean()).ravel(), (step[:, :-1] > step[:, 1:]).ravel()))).tobytes().hex()


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: the UTF-8 bytes of the whole text, with blanks up to a positive multiple of ROW, as JPEG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in B.chunked(B.as_strings(batch.column("text")), 1 << 19):
                n = np.diff(offsets)
                rows = np.maximum(1, -(-n // ROW))
                at = np.concatenate(([0], np.cumsum(rows * ROW)))
                payload = np.full(int(at[-1]), 32, np.uint8)
                payload[np.arange(len(data)) + np.repeat(at[:-1] - offsets[:-1], n)] = data
                out, ends = encode(payload, rows)
                media = pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(n), media], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame, column: str = "media") -> DataFrame:
    """The other columns, and width, height, images, thumbnail (its samples, row by row) and thumbnail_hash.

    Null, empty or damaged values, and images that are not baseline, get nulls. Values with several images
    one after the other, as long payloads have, give one thumbnail with all their rows.
    """
    kept = [c for c in media.columns if c not in (column, "width", "height", "images", "thumbnail", "thumbnail_hash", "media_bytes", "media_sha256")]
    schema = media.select(*kept).schema.add("media_bytes", "long").add("media_sha256", "string").add("width", "integer").add("height", "integer").add("images", "integer").add("thumbnail", "binary").add("thumbnail_hash", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(column)
            values = values.cast(pa.large_binary()).fill_null(b"") if values.null_count else values.cast(pa.large_binary())
            for lo, hi, data, offsets in B.chunked(values, 3 << 20):
                rows = []
                raw = data.tobytes()
                for (a, b), images in zip(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True), thumbnails(data, offsets), strict=True):
                    sha = hashlib.sha256(raw[a:b]).hexdigest()
                    if not images or len({t.shape[1] for t in images}) > 1:
                        rows.append((b - a, sha, None, None, None, None, None))
                    else:
                        whole = images[0] if len(images) == 1 else np.concatenate(images)
                        rows.append((b - a, sha, whole.shape[1] * 8, whole.shape[0] * 8, len(images), whole.tobytes(), thumbnail_hash(whole)))
                made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in kept), *made], schema.names)

    return media.select(*kept, column).mapInArrow(run, schema)


def op10_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts stored as JPEG in a table in the shared folder, read back from there, and their features.

    Null or empty text: a payload of blanks. Repeated rows: a result each. An empty table gives no rows.
    """
    rows = features(scratch.saved(encode_media(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media"))
    payload = F.col("thumbnail")
    return rows.select(
        "doc_id",
        "n_bytes",
        F.length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -16, 16)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.format_string("%dx%d:%d:%s", "width", "height", "images", "thumbnail_hash").alias("feature"),
    )
