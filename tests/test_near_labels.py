"""Labelled numbers in large documents, and boxes on many pages."""

import math
import random
import time

from folioguard.functions.text import normalize_token
from folioguard.operators import detect, redact

WORDS = "doc_id long, line_key string, word_seq long, text string, left double, top double, width double, height double, confidence double"


def plain(words):
    """The number of the first label that has one, by document."""
    out = {}
    for d in {w[0] for w in words}:
        own = sorted((w for w in words if w[0] == d), key=lambda w: w[2])
        for label in (w for w in own if w[3] == "AUSWEISNR"):
            bottom = label[5] + label[7]
            near = [w for w in own if w[3] != "AUSWEISNR" and -4 <= w[5] - bottom <= max(80, label[7] * 5) and abs(w[4] - label[4]) <= 180]
            if near:
                out[d] = min(near, key=lambda w: (abs(w[5] - bottom) + abs(w[4] - label[4]) * 0.2, w[2]))[3]
                break
    return out


def test_labels_meet_numbers_in_cells(spark):
    rng = random.Random(2)
    rows = []
    for d in range(60):
        spread = rng.choice([50, 400, 3000])
        for n in range(rng.choice([2, 10, 60])):
            label = rng.random() < 0.4
            height = rng.choice([0.0, 16.0, 16.0, 40.0, 900.0, 1e12]) if label else 16.0
            text = "AUSWEISNR" if label else f"L{rng.randrange(10**7, 10**8)}X"
            left, top = (rng.choice([0.0, -90.0, 180.0]), rng.choice([0.0, 80.0])) if rng.random() < 0.2 else (rng.uniform(-spread, spread), rng.uniform(-spread, spread))
            rows.append((d, f"{n}", n, text, left, top, 80.0, height, 90.0))
    df = spark.createDataFrame(rows, WORDS).withColumn("normalized", normalize_token(detect.F.col("text")))
    found = detect.detect(df).where("label <> 'Unterschrift'").collect()
    got = {r["doc_id"]: r["value"] for r in found}
    assert len(got) == len(found) and got == plain(rows) and len(got) > 20


def test_a_large_document_takes_seconds(spark):
    """16,000 tokens of one document, and 8,000 labels and numbers at one place."""
    rows = [(1, f"{i}", i, "AUSWEISNR" if i % 2 else f"L{10_000_000 + i}X", 400.0 * (i // 2 % 40), 200.0 * (i // 80) + 30 * (1 - i % 2), 80.0, 16.0, 90.0) for i in range(16_000)]
    rows += [(2, f"{i}", i, "AUSWEISNR" if i % 2 else f"L{10_000_000 + i}X", 0.0, 0.0, 0.0, 0.0, 90.0) for i in range(8_000)]
    df = spark.createDataFrame(rows, WORDS).withColumn("normalized", normalize_token(detect.F.col("text")))
    detect.detect(df.limit(50)).collect()
    began = time.time()
    got = {r["doc_id"]: r["value"] for r in detect.detect(df).collect()}
    assert got == {1: "L10000000X", 2: "L10000000X"} and time.time() - began < 20


def test_boxes_on_many_pages_are_linear(spark):
    rng = random.Random(5)
    pages, top = [], 0.0
    for n in range(10_000):
        height = rng.choice([0.0, 700.0, 710.5])
        pages.append((1, n, top, 500.0, height))
        top += height
    pages += [(2, 0, 100.0, 500.0, 50.0), (2, 1, None, 500.0, 50.0), (3, 0, 0.0, 500.0, 10.0)]
    boxes = [(1, i, (1.0, rng.choice([rng.uniform(-50, top + 500), pages[rng.randrange(10_000)][2]]), 2.0, rng.choice([0.0, 20.0]))) for i in range(10_000)]
    boxes += [(2, 10_000, (0.0, 0.0, 1.0, 1.0)), (2, 10_001, (0.0, 149.0, 1.0, 1.0)), (2, 10_002, (0.0, 150.0, 1.0, 1.0)), (2, 10_003, None), (9, 10_004, (0.0, 0.0, 1.0, 1.0))]
    d = spark.createDataFrame(boxes, f"doc_id long, box_id long, bbox {detect.BOX}")
    p = spark.createDataFrame(pages, "doc_id long, page_no int, top double, width double, height double")
    got = {r["box_id"]: (r["page_no"], r["page_top"]) for r in redact.boxes_to_pages(d, p).collect()}
    starts = [t for _, _, t, _, _ in pages[:10_000]]
    import bisect

    for doc, i, box in boxes:
        want = None
        if doc == 1:
            c = box[1] + box[3] / 2
            k = bisect.bisect_right(starts, c) - 1
            want = k if k >= 0 and c < starts[k] + pages[k][4] else None
        elif i == 10_001:
            want = 0
        assert got[i][0] == want and (want is None) == (got[i][1] is None)
    assert len(got) == len(boxes) and not math.isnan(top)
