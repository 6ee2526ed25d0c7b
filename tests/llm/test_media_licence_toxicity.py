"""JPEG payloads, licence scans and toxicity scores on small and odd inputs."""

import hashlib
import re
import zlib

import numpy as np

from idsieve.llm import jpeg_media, license_scan, toxicity
from tests.llm.tables import documents, write

ODD = [(1, "Hello é"), (1, "Hello é"), (2, None), (3, ""), (None, "x" * 192), (5, "y" * 193), (6, "\x00\x7f" * 500), (7, "ÿ\U0001f600" * 3000), (8, "a" * 192 * 100)]


def test_payloads_come_back(spark, tmp_path, monkeypatch):
    got = jpeg_media.op10_jpeg_media(spark, documents(spark, tmp_path, ODD)).collect()
    want = []
    for i, t in ODD:
        raw = (t or "").encode()
        pad = raw + b" " * (-len(raw) % 192) if raw else b" " * 192
        want.append((i, len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:])))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got), key=str) == sorted(want, key=str)
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id == 1}) == 1
    assert jpeg_media.op10_jpeg_media(spark, documents(spark, tmp_path, [])).collect() == []


def test_long_payloads_take_several_images(monkeypatch):
    monkeypatch.setattr(jpeg_media, "MAX_ROWS", 3)
    payload = np.random.default_rng(0).integers(0, 256, 192 * 8, dtype=np.uint8)
    out, ends = jpeg_media.encode(payload, np.array([1, 7]))
    first, second = jpeg_media.thumbnails(out, ends)
    assert len(first) == 1 and len(second) == 3
    assert (np.concatenate([*first, *second]).ravel() == payload).all()


def test_images_are_whole_jpegs():
    payload = np.arange(192 * 10, dtype=np.int64).astype(np.uint8)
    out, ends = jpeg_media.encode(payload, np.array([10]))
    raw = out.tobytes()
    assert raw[:2] == b"\xff\xd8" and raw[-2:] == b"\xff\xd9" and ends.tolist() == [0, len(raw)]
    assert re.findall(rb"\xff([\xd0-\xd7])", raw) == [bytes([0xD0 + n % 8]) for n in range(9)]


def colour_jpeg():
    """A 32x16 picture of three components, the first with 2x2 blocks, with coefficients beside DC and no restarts."""
    ac_values = [0x00, 0x01, 0xF0, 0x21]
    ac = {v: (c, n) for v, c, n in jpeg_media._codes([0, 2, 1, 1] + [0] * 12, ac_values)}
    dc = {v: (c, n) for v, c, n in jpeg_media._codes(jpeg_media.DC_COUNTS, jpeg_media.DC_VALUES)}
    bits, levels, last = "", {}, [0, 0, 0]

    def put(code):
        return format(code[0], f"0{code[1]}b")

    r = np.random.default_rng(3)
    for mx in range(2):
        for c in range(3):
            for s in range(4 if c == 0 else 1):
                v = int(r.integers(-90, 90))
                d = v - last[c]
                last[c] = v
                n = abs(d).bit_length()
                bits += put(dc[n]) + (format(d if d > 0 else d + (1 << n) - 1, f"0{n}b") if n else "")
                bits += put(ac[0x01]) + "1" + put(ac[0xF0]) + put(ac[0x21]) + "0" + put(ac[0x00])
                if c == 0:
                    levels[s // 2, mx * 2 + s % 2] = v
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    seg = lambda m, b: bytes([0xFF, m]) + (len(b) + 2).to_bytes(2, "big") + b
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, b"\0" + bytes([8] * 64)) + seg(0xC0, b"\x08\0\x10\0\x20\x03\x01\x22\0\x02\x11\0\x03\x11\0")
    head += seg(0xC4, b"\0" + bytes(jpeg_media.DC_COUNTS) + bytes(jpeg_media.DC_VALUES) + b"\x10" + bytes([0, 2, 1, 1] + [0] * 12) + bytes(ac_values)) + seg(0xDA, b"\x03\x01\0\x02\0\x03\0\0\x3f\0")
    return head + scan + b"\xff\xd9", np.array([[levels[y, x] + 128 for x in range(4)] for y in range(2)])


def test_other_baseline_jpegs(spark):
    raw, want = colour_jpeg()
    data = np.frombuffer(raw, np.uint8)
    assert (jpeg_media.thumbnails(data, np.array([0, len(raw)]))[0][0] == want).all()
    rows = [(1, raw), (2, raw[: len(raw) // 2]), (3, None), (4, b""), (5, b"no image"), (6, raw.replace(b"\xff\xc0", b"\xff\xc2"))]
    got = {r.id: r for r in jpeg_media.features(spark.createDataFrame(rows, "id long, media binary")).collect()}
    assert (got[1].width, got[1].height, got[1].images) == (32, 16, 1) and bytes(got[1].thumbnail) == want.astype(np.uint8).tobytes()
    assert all(got[n].thumbnail is None for n in (2, 3, 4, 5, 6))


LICENCES = [
    (1, "Some MIT License, and the mit\nLICENSE again."),
    (1, "Some MIT License, and the mit\nLICENSE again."),
    (2, None),
    (3, ""),
    (None, "GNU General Public License"),
    (5, "word " * 20000 + "This work is licensed under the GNU General Public License, version 3. " + "word " * 10),
    (6, "Permission is hereby granted, free of charge, to any lucky person obtaining a copy of this software and associated documentation files"),
    (7, "Permission is hereby granted, free"),
    (8, "mit"),
    (9, "Licensed under CC BY-NC 4.0. All rights reserved. Apache license"),
    (10, "general public general public license"),
]


def plain_base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at, labels = [], set()
    for t in license_scan.PHRASES:
        p = t.text.split()
        own = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        at += own
        labels |= {t.label} if own else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_licences(spark, tmp_path):
    got = license_scan.op5_license_scan(spark, documents(spark, tmp_path, LICENCES)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == sorted(((i, *plain_base(t)) for i, t in LICENCES), key=str)
    by = {r.doc_id: r for r in got}
    assert by[6].labels == "mit" and 0.8 <= by[6].score < 1 and by[7].labels == "" and by[8].labels == ""
    assert by[9].labels == "apache,cc-by-nc,reserved" and by[9].score == 1.0 and by[2].score == 0.0
    assert license_scan.op5_license_scan(spark, documents(spark, tmp_path, [])).collect() == []


def every_chain(runs, shift):
    """(start, end, covered) of all spans, one run after the other in every way."""
    found = set()

    def go(first, last, covered):
        found.add((first.i, last.i + last.size, covered))
        for r in runs:
            if new := license_scan.added(last, r, shift):
                go(first, r, covered + new)

    for r in runs:
        go(r, r, r.size)
    return found


def plain_spans(words, template, k, shift, cover):
    """Spans by trying every chain of runs of common k-grams."""
    by = {}
    for i in range(len(words) - k + 1):
        for j in range(len(template) - k + 1):
            if words[i : i + k] == template[j : j + k]:
                by.setdefault(i - j, []).append(j)
    runs = [r for d, at in by.items() for r in license_scan.runs_of(d, at, k)]
    found = [(-c / max(len(template), b - a), a, b - a) for a, b, c in every_chain(runs, shift)]
    out = []
    for score, start, length in sorted(f for f in found if -f[0] >= cover - 1e-9):
        if all(start + length <= s or s + n <= start for s, n, _ in out):
            out.append((start, length, -score))
    return sorted(out)


def plain_scan(text):
    """(labels, score, number of spans) of a text."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    labels, scores, n = set(), [0.0], 0
    for t in license_scan.TEMPLATES:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.text.lower())
        if t.exact:
            spans = [(i, len(own), 1.0) for i in range(len(words)) if words[i : i + len(own)] == own]
        else:
            spans = plain_spans(words, own, license_scan.GRAM_WORDS, license_scan.MAX_SHIFT, license_scan.MIN_COVER)
        labels |= {t.label for _ in spans}
        scores += [s for _, _, s in spans]
        n += len(spans)
    return ",".join(sorted(labels)), round(max(scores), 6), n


def scans(spark, folder):
    return sorted(((r.doc_id, r.labels, round(r.score, 6), r.n_spans) for r in license_scan.op5_license_scan(spark, folder).collect()), key=str)


def test_notices_beside_each_other(spark, tmp_path):
    """Repeated, adjacent, interleaved and worn notices, and stray words of them, against every way to merge."""
    r = np.random.default_rng(5)
    notices = [re.findall(r"[a-z0-9]+", t.text.lower()) for t in license_scan.NOTICES]
    reserved = "All rights reserved."
    texts = [f"{reserved} {reserved}", f"rights {reserved} {reserved}", f"rights reserved. {reserved}", reserved, f"{reserved} rights reserved", "All rights all rights reserved reserved", " ".join([reserved] * 50)]
    for _ in range(120):
        words = []
        for _ in range(int(r.integers(1, 4))):
            own = list(notices[int(r.integers(len(notices)))])
            for _ in range(int(r.integers(0, 4))):
                at = int(r.integers(len(own)))
                match int(r.integers(4)):
                    case 0:
                        own.insert(at, "uh")
                    case 1 if len(own) > 2:
                        del own[at]
                    case 2:
                        own[at] = "um"
                    case 3:
                        own[at:at] = own[max(0, at - 3) : at]
            words += own + ["and"] * int(r.integers(0, 3))
        texts.append(" ".join(words))
    texts += [" ".join(x for pair in zip(a, b) for x in pair) for a, b in zip(notices, notices[1:])]
    assert scans(spark, documents(spark, tmp_path, list(enumerate(texts)))) == sorted(((i, *plain_scan(t)) for i, t in enumerate(texts)), key=str)
    assert [plain_scan(t)[0] for t in texts[:5]] == ["reserved"] * 5 and plain_scan(texts[6])[2] == 50


def test_notices_of_the_corpus(spark, small_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert scans(spark, small_dir) == sorted(((i, *plain_scan(t)) for i, t in rows), key=str)


def test_licence_base_on_the_corpus(spark, small_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = license_scan.op5_license_scan(spark, small_dir).collect()
    assert sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == sorted((i, *plain_base(t)) for i, t in rows)


def corpus(n):
    r = np.random.default_rng(7)
    plain = ["table", "green", "walk", "seven", "river", "Monday", "stone", "cloud"]
    rude = ["grobian", "grobianer", "grobiane", "idiot", "scum"]
    docs, labels = [], []
    for i in range(n):
        words = [str(x) for x in r.choice(plain, r.integers(20, 60))]
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                words.insert(int(r.integers(len(words))), str(r.choice(rude)))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return docs, labels


def scores(spark, folder):
    return {(r.doc_id, r.held_out): (r.score, r.predicted) for r in toxicity.op9_toxicity(spark, folder).collect()}


def test_toxicity_of_held_out_rows(spark, tmp_path):
    docs, labels = corpus(1500)
    write(spark, tmp_path, "labels", labels, "doc_id long, quality int, toxic int")
    got = scores(spark, documents(spark, tmp_path, docs))
    held = [(labels[i][2], s, p) for (i, h), (s, p) in got.items() if h]
    assert len(held) > 200 and all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in got)
    assert sum(y == p for y, _, p in held) / len(held) > 0.97 and all(0 <= s <= 1 for _, s, _ in held)


def test_labels_of_held_out_rows_are_not_used(spark, tmp_path):
    docs, labels = corpus(600)
    folder = documents(spark, tmp_path, docs)
    write(spark, tmp_path, "labels", labels, "doc_id long, quality int, toxic int")
    before = scores(spark, folder)
    write(spark, tmp_path, "labels", [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    assert scores(spark, folder) == before


def test_toxicity_of_odd_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (None, "idiot you idiot"), (4, "fine"), (4, "fine"), (5, "w " * 50000)]
    write(spark, tmp_path, "labels", [(1, None, None), (4, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.op9_toxicity(spark, documents(spark, tmp_path, rows)).collect()
    assert len(got) == 6 and {r.doc_id: r.predicted for r in got} == {1: 0, 2: 0, None: 1, 4: 0, 5: 0}
    assert {r.doc_id: r.held_out for r in got} == {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in (1, 2, None, 4, 5)}
    assert toxicity.op9_toxicity(spark, documents(spark, tmp_path, [])).collect() == []


def test_the_sample_is_bounded_by_texts(spark, tmp_path):
    docs = spark.createDataFrame([(i % 7, f"text {i % 40}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i > 3)) for i in range(7)] + [(1, 1)], "doc_id long, toxic int")
    all_ = toxicity.labelled_sample(docs, labels).collect()
    held = [i for i in range(7) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(all_) == len({(i % 7, i % 40) for i in range(400) if i % 7 not in held})
    some = toxicity.labelled_sample(docs, labels, 25).collect()
    assert len(some) == 25 and sorted(some) == sorted(toxicity.labelled_sample(docs, labels, 25).collect()) and set(some) <= set(all_)


def test_isotonic_fit_rises():
    r = np.random.default_rng(0)
    raw = r.normal(size=500)
    y = (r.random(500) < 1 / (1 + np.exp(-2 * raw))).astype(float)
    x, p = toxicity.isotonic(raw, y)
    assert (np.diff(x) > 0).all() and (np.diff(p) >= 0).all()
