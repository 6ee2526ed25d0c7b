"""Stamp analysis against a plain version that looks at one pixel after the other."""

import numpy as np

from idsieve.operators import imaging
from idsieve.plans import imaging as plans
from idsieve.plans import catalog
from tests.test_golden import drawn


def plain_regions(image):
    """(box in pixels, area, share of coloured pixels) of each connected ink region, gaps under five samples filled."""
    h, w, _ = image.shape
    ink, coloured = set(), set()
    for y in range(h):
        for x in range(w):
            most, least = max(map(int, image[y, x])), min(map(int, image[y, x]))
            if most - least >= 24 and (most - least) / max(most, 1) >= 0.16 and most <= 252 and least <= 235:
                coloured.add((y, x))
            if (y, x) in coloured or (most <= 125 and most - least >= 10):
                ink.add((y, x))
    near = lambda y, x: [(min(max(y + a, 0), h - 1), min(max(x + b, 0), w - 1)) for a in range(-2, 3) for b in range(-2, 3)]
    wide = {(y, x) for y in range(h) for x in range(w) if any(p in ink for p in near(y, x))}
    left = {(y, x) for y in range(h) for x in range(w) if all(p in wide for p in near(y, x))}
    out = []
    while left:
        todo, own = [left.pop()], []
        while todo:
            y, x = todo.pop()
            own.append((y, x))
            for a in (-1, 0, 1):
                for b in (-1, 0, 1):
                    if (y + a, x + b) in left:
                        left.remove((y + a, x + b))
                        todo.append((y + a, x + b))
        ys, xs = [y for y, _ in own], [x for _, x in own]
        box = min(xs), min(ys), max(xs) + 1, max(ys) + 1
        share = sum((y, x) in coloured for y in range(box[1], box[3]) for x in range(box[0], box[2])) / ((box[2] - box[0]) * (box[3] - box[1]))
        out.append((box, len(own), share))
    return out


def plain_stamps(image, low):
    """(status, boxes of stamps in shares) of an image."""
    h, w, _ = image.shape
    found = []
    for (x, y, x2, y2), area, colour in plain_regions(image):
        bw, bh = x2 - x, y2 - y
        if bw / w >= 0.035 and bh / h >= 0.025 and 0.0015 <= bw * bh / (w * h) <= 0.35 and area / (bw * bh) >= 0.04:
            found.append(((round(x / w, 4), round(y / h, 4), round(bw / w, 4), round(bh / h, 4)), round(max(bw / bh, bh / bw), 2), round(area / (bw * bh), 3), round(colour, 3)))
    kept = []
    for f in sorted(found, key=lambda f: (-f[0][2] * f[0][3], f[0][1], f[0][0])):
        a = f[0]
        if not any(min(a[0] + a[2], b[0] + b[2]) > max(a[0], b[0]) and min(a[1] + a[3], b[1] + b[3]) > max(a[1], b[1]) for b, *_ in kept):
            kept.append(f)
    stamps, doubt = [], False
    for box, aspect, fill, colour in sorted(kept, key=lambda f: (f[0][1], f[0][0])):
        if aspect > 2.8 or fill < 0.06 or colour < 0.04:
            continue
        evidence = 0.35 * (1 if aspect <= 2.4 else 0.65) + 0.2 * (1 if 0.09 <= fill <= 0.42 else 0.55) + 0.45 * min(1, colour / 0.18)
        if evidence >= 0.68 and not (low and evidence < 0.82):
            stamps.append(box)
        elif evidence >= 0.45:
            doubt = True
    return "STAMP_DETECTED" if stamps else "UNCERTAIN" if doubt else "NO_STAMP_DETECTED", stamps


def test_stamps_of_all_small_images(spark, small_dir):
    rows = plans.ink_images(lambda name: spark.read.parquet(f"{small_dir}/{name}.parquet").limit(40)).collect()
    df = spark.createDataFrame(rows, "doc_id long, document_type string, format string, pixels binary, height int, width int, channels int")
    texts = spark.createDataFrame([(r.doc_id, "STAMP-01", "port 3/4/2020, ENTRY Port 2020-1-31") for r in rows], "doc_id long, region_id string, text string")
    got = {r.doc_id: r for r in imaging.stamp_analysis(df, texts).collect()}
    assert len(got) == len(rows)
    kinds = set()
    for r in rows:
        have = got[str(r.doc_id)]
        if r.document_type == "AADHAAR":
            assert (have.status, have.regions, have.quality_status) == ("NOT_APPLICABLE", [], "UNAVAILABLE") and len(have.limitations) == 1
        elif r.pixels is None:
            assert have.status == "INSUFFICIENT_EVIDENCE" and have.regions == []
        else:
            status, boxes = plain_stamps(np.frombuffer(r.pixels, np.uint8).reshape(96, 96, 3), True)
            assert have.status == status and [(x.x, x.y, x.width, x.height) for x in have.regions] == boxes
            assert [x.region_id for x in have.regions] == [f"STAMP-{n:02d}" for n in range(1, len(boxes) + 1)]
            assert have.flagged == sum(bool(x.anomalies) for x in have.regions)
            for n, x in enumerate(have.regions):
                assert (x.text_status, x.dates, x.terms) == (("READABLE", ["3/4/2020", "2020-1-31"], ["ENTRY", "PORT"]) if n == 0 else ("UNREADABLE", [], []))
        kinds.add(have.status)
    assert {"NOT_APPLICABLE", "INSUFFICIENT_EVIDENCE", "STAMP_DETECTED"} <= kinds


def test_overlaps_go_before_the_gate(spark):
    """A large region that is no stamp hides a small stamp whose box it overlaps."""
    c = lambda *box, fill, colour: ("a", 50.0, 1000, 800, *box, box[2], box[3], box[2] * box[3], fill, 1.0, colour, ["X"])
    df = spark.createDataFrame([c(0.1, 0.1, 0.5, 0.5, fill=0.05, colour=0.3), c(0.2, 0.2, 0.1, 0.1, fill=0.2, colour=0.3)], imaging.CANDIDATES)
    r = imaging.stamp_regions(df).first()
    assert r.status == "NO_STAMP_DETECTED" and r.regions == []
    r = imaging.stamp_regions(df.where("width < 0.3")).first()
    assert r.status == "STAMP_DETECTED" and r.regions[0].anomalies == ["X"] and imaging.CANDIDATES


def test_large_images_are_reduced_first():
    image = drawn(1, 1400, 2000)
    small = imaging.working(image)
    assert small.shape == (int(1400 * (1400 / 2000)), 1400, 3) and imaging.working(drawn()).shape == (700, 1000, 3)
    assert imaging.working(np.full((3000, 10, 1), 77, np.uint8)).shape == (1400, 4, 1)
    assert (imaging.working(np.full((2800, 2800, 3), 90, np.uint8)) == 90).all()
    means = image.reshape(-1, 1).astype(float).mean(), small.reshape(-1, 1).astype(float).mean()
    assert abs(means[0] - means[1]) < 3


def test_anomalies_of_regions():
    r = np.random.default_rng(0)
    assert imaging.region_anomalies(np.zeros((7, 100))) == ["LOW_REGION_RESOLUTION"]
    assert imaging.region_anomalies(np.full((40, 40), 200.0)) == []
    assert "INTERNAL_TEXTURE_VARIATION" in imaging.region_anomalies(np.where(r.random((40, 40)) < 0.5, 0.0, 255.0))
    framed = np.full((60, 60), 128.0)
    framed[::2, :3] = framed[::2, -3:] = framed[:3, ::2] = framed[-3:, ::2] = 0
    assert imaging.region_anomalies(framed) == ["BOUNDARY_DISCONTINUITY"]


def test_boxes_without_overlaps(spark, small_dir):
    got = {}
    for r in catalog.QUERIES["boxes_without_overlaps"](spark, small_dir).collect():
        got.setdefault(r.l_orderkey, []).append((r.region_id, r.x, r.y))
    by = {}
    for r in spark.read.parquet(f"{small_dir}/lineitem.parquet").collect():
        by.setdefault(r.l_orderkey, []).append((r.l_partkey % 90 / 100, r.l_suppkey % 90 / 100, float(r.l_quantity) / 200, r.l_linenumber / 20))
    for key, boxes in by.items():
        kept = []
        for b in sorted(boxes, key=lambda b: (-b[2] * b[3], b[1], b[0])):
            if not any(min(b[0] + b[2], k[0] + k[2]) > max(b[0], k[0]) and min(b[1] + b[3], k[1] + k[3]) > max(b[1], k[1]) for k in kept):
                kept.append(b)
        want = [(x, y) for x, y, *_ in sorted(kept, key=lambda b: (b[1], b[0]))]
        assert [(x, y) for _, x, y in sorted(got[key])] == want
