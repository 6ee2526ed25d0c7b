"""Files to pages and signals: against Java's own reader and writer of images, and plain loops."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from idsieve.operators import forensics, imaging
from idsieve.operators.isolation import isolated
from idsieve.sources import images
from tests.test_golden import drawn


def photo(height, width, seed=0):
    """Smooth colours, hard edges and some noise."""
    r = np.random.default_rng(seed)
    y, x = np.mgrid[:height, :width]
    image = np.stack([120 + 80 * np.sin(x / 17 + k) + 50 * np.cos(y / (11 + k)) for k in range(3)], 2) + r.normal(0, 6, (height, width, 3))
    image[height // 3 : height // 2, width // 4 : width // 2] = (200, 30, 60)
    return np.clip(image, 0, 255).astype(np.uint8)


def java_bytes(spark, image, kind, quality=None, progressive=False):
    """The image as Java writes it."""
    j = spark._jvm
    height, width, _ = image.shape
    picture = j.java.awt.image.BufferedImage(width, height, 1)
    values = (image.astype(np.int64) @ np.array([65536, 256, 1])).ravel()
    array = spark.sparkContext._gateway.new_array(j.int, len(values))
    for n, v in enumerate(values.tolist()):
        array[n] = v
    picture.setRGB(0, 0, width, height, array, 0, width)
    out = j.java.io.ByteArrayOutputStream()
    if quality is None:
        j.javax.imageio.ImageIO.write(picture, kind, out)
    else:
        writer = j.javax.imageio.ImageIO.getImageWritersByFormatName("jpg").next()
        p = writer.getDefaultWriteParam()
        p.setCompressionMode(2)  # explicit
        p.setCompressionQuality(quality)
        if progressive:
            p.setProgressiveMode(1)  # default
        stream = j.javax.imageio.ImageIO.createImageOutputStream(out)
        writer.setOutput(stream)
        writer.write(None, j.javax.imageio.IIOImage(picture, None, None), p)
        stream.close()
    return bytes(out.toByteArray())


def java_pixels(spark, content):
    """RGB samples as Java reads them."""
    j = spark._jvm
    picture = j.javax.imageio.ImageIO.read(j.java.io.ByteArrayInputStream(content))
    width, height = picture.getWidth(), picture.getHeight()
    out = j.java.nio.ByteBuffer.allocate(4 * width * height)
    out.asIntBuffer().put(picture.getRGB(0, 0, width, height, None, 0, width))
    return np.frombuffer(bytes(out.array()), np.uint8).reshape(height, width, 4)[:, :, 1:]


@pytest.mark.parametrize(("size", "quality", "progressive"), [((61, 83), 0.9, False), ((48, 64), 0.3, False), ((61, 83), 0.9, True), ((33, 17), 0.5, True), ((1, 1), 0.9, False), ((2, 5), 0.9, False), ((9, 2), 0.9, True)])
def test_jpeg_samples_are_java_s(spark, size, quality, progressive):
    content = java_bytes(spark, photo(*size), "jpg", quality, progressive)
    kind, rgb = images.decode(content)
    away = np.abs(rgb.astype(int) - java_pixels(spark, content))
    assert kind == "JPEG" and rgb.shape == (*size, 3) and away.max() <= 4 and away.mean() < 0.3
    about = images.described(content)
    assert (about["format"], about["height"], about["width"], about["software"]) == ("JPEG", *size, None)


def test_png_samples_are_java_s(spark):
    image = photo(40, 53)
    assert (images.decode(java_bytes(spark, image, "png"))[1] == image).all()
    for filters in [(0,), (1,), (2,), (3,), (4,), (4, 3, 2, 1, 0), (0, 1, 2), (3, 0, 4)]:
        content = images.encode_png(image, filters, "GIMP 2.10")
        assert (java_pixels(spark, content) == image).all() and (images.decode_png(content) == image).all(), filters
        assert images.described(content)["software"] == "GIMP 2.10"
    assert (images.decode_png(images.encode_png(image[:, :, :1], (4,)))[:, :, 1] == image[:, :, 0]).all()


def png(width, height, depth, colour, rows, palette=None, interlaced=0, extra=()):
    parts = [(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced)), *extra]
    if palette is not None:
        parts.append((b"PLTE", palette))
    parts += [(b"IDAT", zlib.compress(rows)), (b"IEND", b"")]
    return images.MAGIC["PNG"] + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in parts)


def test_other_kinds_of_png(spark):
    r = np.random.default_rng(1)
    for depth in (1, 2, 4):
        width = 13
        values = r.integers(0, 1 << depth, (5, width))
        bits = "".join("0" * 8 + "".join(format(v, f"0{depth}b") for v in row).ljust(-(-width * depth // 8) * 8, "0") for row in values)
        packed = int(bits, 2).to_bytes(len(bits) // 8, "big")
        grey = images.decode_png(png(width, 5, depth, 0, packed))
        assert (grey[:, :, 0] == values * 255 // ((1 << depth) - 1)).all()
        palette = bytes(r.integers(0, 256, 3 << depth).tolist())
        content = png(width, 5, depth, 3, packed, palette)
        assert (images.decode_png(content) == np.frombuffer(palette, np.uint8).reshape(-1, 3)[values]).all() and (java_pixels(spark, content) == images.decode_png(content)).all()
    deep = r.integers(0, 65536, (3, 4, 3)).astype(">u2")
    assert (images.decode_png(png(4, 3, 16, 2, b"".join(b"\x00" + row.tobytes() for row in deep))) == deep >> 8).all()
    image = r.integers(0, 256, (11, 9, 4)).astype(np.uint8)
    passes = b"".join(b"\x00" + line.tobytes() for y, x, dy, dx in images.ADAM7 if image[y::dy, x::dx].size for line in image[y::dy, x::dx])
    assert (images.decode_png(png(9, 11, 8, 6, passes, interlaced=1)) == image[:, :, :3]).all()


def test_damaged_files_are_told_from_others(spark):
    """Cut anywhere or with any byte changed, a file is decoded or Unreadable, and nothing else."""
    image = photo(24, 31)
    r = np.random.default_rng(2)
    for content in (images.encode_png(image, (4, 1)), java_bytes(spark, image, "jpg", 0.8), java_bytes(spark, image, "jpg", 0.8, True)):
        for n in [*range(0, 40), *r.integers(40, len(content) - 20, 60).tolist()]:
            with pytest.raises(images.Unreadable):
                images.decode(content[:n])
        for at in r.integers(0, len(content), 300).tolist():
            odd = bytearray(content)
            odd[at] = r.integers(256)
            try:
                images.decode(bytes(odd))
            except images.Unreadable:
                pass
            images.described(bytes(odd))
    with pytest.raises(images.Unreadable, match="more than"):
        images.decode(png(60000, 60000, 8, 2, b""))
    with pytest.raises(images.Unreadable, match="PDF"):
        images.decode(b"%PDF-1.4")


def test_headers_of_files():
    exif = lambda order, said: (b"II*\x00" if order == "<" else b"MM\x00*") + struct.pack(order + "IHHHI", 8, 1, 0x0131, 2, len(said)) + (said if len(said) <= 4 else struct.pack(order + "I", 26) + bytes(4) + said)
    sof = b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 300, 400, 1) + b"\x01\x11\x00"
    for order, said in (("<", b"Adobe Photoshop 25\x00"), (">", b"abc\x00")):
        app = b"Exif\x00\x00" + exif(order, said)
        content = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app) + 2) + app + sof + b"\xff\xda"
        assert images.described(content) == {"format": "JPEG", "width": 400, "height": 300, "software": said[:-1].decode(), "text_software": None}
    told = images.described(png(3, 2, 8, 0, bytes(8), extra=[(b"tEXt", b"Software\x00Canva"), (b"iTXt", b"Comment\x00\x00\x00\x00\x00x")]))
    assert told == {"format": "PNG", "width": 3, "height": 2, "software": None, "text_software": "Canva"}
    assert images.described(b"") == {"format": "UNKNOWN", "width": None, "height": None, "software": None, "text_software": None}
    assert images.tiff_software(b"II*\x00\xff\xff\xff\xff") is None


def plain_recompressed(rgb):
    """The same by loops over samples, for sides that are multiples of 16."""
    height, width, _ = rgb.shape
    ycc = [[[0] * 3 for _ in range(width)] for _ in range(height)]
    for y in range(height):
        for x in range(width):
            r, g, b = map(int, rgb[y, x])
            ycc[y][x] = [math.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5), math.floor(-0.168735892 * r - 0.331264108 * g + 0.5 * b + 128.499999), math.floor(0.5 * r - 0.418687589 * g - 0.081312411 * b + 128.499999)]
    planes = [[[ycc[y][x][0] for x in range(width)] for y in range(height)]]
    for k in (1, 2):
        planes.append([[(sum(ycc[2 * y + a][2 * x + b][k] for a in (0, 1) for b in (0, 1)) + 1 + x % 2) // 4 for x in range(width // 2)] for y in range(height // 2)])
    out = []
    for k, plane in enumerate(planes):
        table = [int(v) for v in (forensics.CHROMINANCE if k else forensics.LUMINANCE).split()]
        steps = [max(1, (v * 20 + 50) // 100) for v in table]
        back = [[0] * len(plane[0]) for _ in plane]
        for by in range(0, len(plane), 8):
            for bx in range(0, len(plane[0]), 8):
                scale = lambda u: math.sqrt(0.125) if u == 0 else 0.5
                wave = lambda n, u: math.cos((2 * n + 1) * u * math.pi / 16)
                c = {}
                for v in range(8):
                    for u in range(8):
                        s = scale(u) * scale(v) * sum((plane[by + y][bx + x] - 128) * wave(x, u) * wave(y, v) for y in range(8) for x in range(8))
                        q = steps[8 * v + u]
                        c[v, u] = q * int(math.copysign(math.floor(abs(s) / q + 0.5 + 1e-9), s))
                for y in range(8):
                    for x in range(8):
                        s = sum(scale(u) * scale(v) * c[v, u] * wave(x, u) * wave(y, v) for v in range(8) for u in range(8) if c[v, u])
                        back[by + y][bx + x] = min(255, max(0, math.floor(s + 128.5 + 1e-7)))
        out.append(back)
    full = [out[0]]
    for plane in out[1:]:
        h, w = len(plane), len(plane[0])
        near = lambda n, size: (n // 2, min(size - 1, max(0, n // 2 + (1 if n % 2 else -1))))
        rows = []
        for y in range(2 * h):
            a, b = near(y, h)
            column = [3 * plane[a][x] + plane[b][x] for x in range(w)]
            rows.append([(3 * column[near(x, w)[0]] + column[near(x, w)[1]] + (7 if x % 2 else 8)) // 16 for x in range(2 * w)])
        full.append(rows)
    result = np.zeros_like(rgb)
    for y in range(height):
        for x in range(width):
            l, cb, cr = full[0][y][x], full[1][y][x] - 128, full[2][y][x] - 128
            for n, v in enumerate((l + 1.402 * cr, l - 0.344136286 * cb - 0.714136286 * cr, l + 1.772 * cb)):
                result[y, x, n] = min(255, max(0, math.floor(v + 0.5)))
    return result


def test_error_levels_against_loops_and_java(spark):
    image = photo(32, 48, 4)
    own, plain = forensics.recompressed(image), plain_recompressed(image)
    assert np.abs(own.astype(int) - plain).max() <= 1 and (own != plain).mean() < 0.001
    for size in ((61, 83), (32, 48), (17, 100)):
        image = photo(*size, 5)
        java = java_pixels(spark, java_bytes(spark, image, "jpg", 0.9))
        own = forensics.recompressed(image)
        assert np.abs(own.astype(int) - java).mean() < 0.6, size  # Java transforms in whole numbers, so some coefficients fall on the other side
        levels = imaging.block_means(np.abs(image.astype(int) - java).sum(2))
        assert np.abs(forensics.error_levels(image) - levels).max() < 0.1 * levels.max()


def test_signals_from_bytes(spark):
    """An even image, one with a noisy patch and a JPEG; damaged, empty and unknown files are rows too."""
    plain, patched = np.full((160, 240, 3), 180, np.uint8), np.full((160, 240, 3), 180, np.uint8)
    patched[64:80, 96:112] = np.random.default_rng(0).integers(0, 256, (16, 16, 3))
    stamp = drawn(1)
    rows = [
        ("even", images.encode_png(plain)),
        ("patched", images.encode_png(patched, (4,), "Adobe Photoshop 25")),
        ("jpeg", java_bytes(spark, plain, "jpg", 0.9)),
        ("stamp", images.encode_png(stamp, (1,))),
        ("cut", images.encode_png(plain)[:-30]),
        ("none", None),
        ("empty", b""),
        ("pdf", b"%PDF-1.7"),
    ]
    files = spark.createDataFrame(rows, "doc_id string, content binary").repartition(1)
    got = {r.doc_id: r for r in forensics.examined(files, ["doc_id"]).collect()}
    assert len(got) == len(rows)
    assert got["even"].tampering.detected is False and got["even"].ela_score == got["even"].noise_score == 0
    assert got["patched"].software == "Adobe Photoshop 25" and got["patched"].tampering.detected
    want = imaging.block_variances(imaging.grey(patched))
    assert got["patched"].noise_max == pytest.approx(want.max()) and got["patched"].ela_max == pytest.approx(forensics.error_levels(patched).max())
    assert got["jpeg"].format == "JPEG" and "Image is not a JPEG" not in got["jpeg"].tampering.indicators and "Image is not a JPEG" in got["even"].tampering.indicators
    for name, reason in (("cut", "within a chunk"), ("none", "no content"), ("empty", "UNKNOWN"), ("pdf", "PDF")):
        assert reason in got[name].unreadable and got[name].tampering.confidence == 0 and reason in got[name].tampering.indicators[0]
    assert (got["cut"].format, got["cut"].width) == ("PNG", 240)
    page = {r.doc_id: r for r in forensics.pages(files, ["doc_id"]).collect()}
    assert bytes(page["patched"].pixels) == patched.tobytes() and page["cut"].error and page["cut"].pixels is None
    shown = forensics.pages(files, ["doc_id"])
    stamps = {r.doc_id: r for r in imaging.stamp_regions(imaging.ink_candidates(shown)).collect()}
    assert stamps["stamp"].status == "STAMP_DETECTED" and stamps["even"].status == "NO_STAMP_DETECTED" and stamps["cut"].status == "INSUFFICIENT_EVIDENCE"


def test_one_bad_row_among_many(spark):
    """One failing row of a thousand changes nothing of the others, and takes few further calls."""
    calls = spark.sparkContext.accumulator(0)

    def step(frame):
        calls.add(1)
        if (frame["v"] == 617).any():
            raise ValueError("617 is bad")
        return frame[["v"]].assign(double=frame["v"] * 2)[["double"]]

    rows = spark.range(1000).selectExpr("id AS v", "id % 7 AS k").repartition(1)
    got = {r.v: r for r in isolated(rows, step, "double long", ["v"], ["v", "k"]).collect()}
    assert len(got) == 1000 and got[617].error == "617 is bad" and got[617].double is None and got[617].k == 617 % 7
    assert all(r.double == 2 * v and r.error is None for v, r in got.items() if v != 617)
    assert calls.value <= 2 * 10 + 2
    assert isolated(rows.where("v < 0"), step, "double long", ["v"], ["v"]).count() == 0


def test_contents_are_fetched_late(spark, tmp_path):
    """Prior records are looked for without contents, whatever the records' table holds."""
    red, blue = (images.encode_png(np.full((16, 16, 3), c, np.uint8)) for c in ((200, 0, 0), (0, 0, 200)))
    rows = [(1, "CONFIRMED", "a", "p", "k", red), (2, "CONFIRMED", "b", "p", "k", blue), (3, "CONFIRMED", "c", "p", "k", b"no image"), (4, "CONFIRMED", "c", "p", "k", red), (5, "CONFIRMED", "d", None, None, red)]
    spark.createDataFrame(rows, "record_id long, status string, document_hash string, identity_type string, identity_key string, content binary").write.parquet(str(tmp_path / "r"))
    records = spark.read.parquet(str(tmp_path / "r"))
    out = forensics.compared_with_prior(records, records.select("record_id", "content"), ["record_id"])
    got = {r.record_id: (r.prior_id, r.comparison, r.changed, r.percent, r.error is None) for r in out.collect()}
    assert got == {2: (1, "CHANGED", 256, 100.0, True), 3: (2, "UNAVAILABLE", None, None, False)}
    scans = [line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window" in line or "Join" in line]
    assert scans and not any("content" in line for line in scans if "Window" in line)
    text = forensics.pixel_reasons(F.array(F.lit("x")), F.lit("CHANGED"), F.lit(12.5), [F.lit(n) for n in (1, 2, 3, 4)])
    assert spark.range(1).select(text.alias("t")).first().t == ["x", "12.5000 % of the pixels changed, from (1, 2) to (3, 4)"]


def mixed_files():
    """PNGs of a few sizes with all filters, some interlaced, cut off, of other formats or not there."""
    out = []
    for n in range(60):
        size = [(16, 16), (40, 5), (3, 50), (300, 7), (1, 1)][n % 5]
        content = images.encode_png(photo(*size, n)[:, :, : 1 if n % 4 == 1 else 3], (n % 5, 4, 1) if n % 3 else (0, 2, 1))
        out.append(None if n % 11 == 5 else content[: len(content) * 2 // 3] if n % 7 == 3 else b"%PDF" if n == 30 else content)
    return out


def test_files_are_decoded_together_as_alone(monkeypatch):
    contents = mixed_files()
    calls, own = [], images.unfiltered
    monkeypatch.setattr(images, "unfiltered", lambda lines, step: calls.append(len(lines)) or own(lines, step))
    together = list(images.decoded(contents))
    assert len(calls) <= 20 < sum(calls)  # one for each size, kind and need of diagonals
    for n, (content, found) in enumerate(zip(contents, together, strict=True)):
        if isinstance(found, images.Unreadable):
            with pytest.raises(images.Unreadable, match=str(found)):
                images.decode(content)
            assert n % 11 == 5 or n % 7 == 3 or n == 30
        else:
            image = photo(*found[1].shape[:2], n)
            assert found[0] == "PNG" and (found[1] == (image[:, :, :1] if n % 4 == 1 else image)).all()
    # files are taken in as they are asked for
    monkeypatch.setattr(images, "TOGETHER", 1000)
    taken = []
    next(images.decoded(taken.append(c) or c for c in contents))
    assert len(taken) < 10


def test_filters_against_plain_loops():
    r = np.random.default_rng(5)
    for n, high, across, step in [(1, 1, 1, 1), (3, 1, 9, 3), (2, 23, 5, 3), (4, 16, 16, 2), (2, 7, 30, 4), (1, 9, 1, 2)]:
        lines = r.integers(0, 256, (n, high, 1 + across * step)).astype(np.uint8)
        lines[:, :, 0] = r.integers(0, 5, (n, high))
        want = np.zeros((n, high, across * step), int)
        for k, y, x in np.ndindex(want.shape):
            left, above = want[k, y, x - step] if x >= step else 0, want[k, y - 1, x] if y else 0
            corner = want[k, y - 1, x - step] if y and x >= step else 0
            nearest = min((abs(above - corner), 0, left), (abs(left - corner), 1, above), (abs(left + above - 2 * corner), 2, corner))[2]
            want[k, y, x] = (int(lines[k, y, 1 + x]) + [0, left, above, (left + above) // 2, nearest][lines[k, y, 0]]) % 256
        assert (images.unfiltered(lines, step) == want).all()


@pytest.mark.parametrize("name", ["pages", "headers", "measured", "compared_contents"])
def test_unreadable_files_bring_no_further_calls(monkeypatch, name):
    """A step tells of them itself, so the other files of its batch are not decoded again."""
    import pandas as pd

    steps = []

    class Rows:
        def withColumn(self, *_):  # noqa: N802
            return self

        def drop(self, *_):
            return self

    monkeypatch.setattr(forensics, "isolated", lambda rows, step, *_: steps.append(step) or Rows())
    monkeypatch.setattr(forensics, "F", type("Functions", (), {n: staticmethod(lambda *_: None) for n in ("coalesce", "lit")}))
    getattr(forensics, name)(None, ["k"])
    contents = mixed_files()
    out = steps[0](pd.DataFrame({"content": contents, "prior_content": contents[1:] + contents[:1]}))
    failed = [c is None if name == "headers" else isinstance(found, images.Unreadable) for c, found in zip(contents, images.decoded(contents), strict=True)]
    if name == "compared_contents":
        failed = [a or b for a, b in zip(failed, failed[1:] + failed[:1], strict=True)]
    assert list(out["unreadable"].notna()) == failed
