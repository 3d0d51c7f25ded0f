"""Images by Spark's image source, and rectangles joined to them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioguard.functions import pixels
from folioguard.operators import redact
from folioguard.plans.fixtures import png
from folioguard.sources import images

RECT = "struct<left: double, top: double, width: double, height: double>"


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(1)
    made = {}
    for name, (h, w) in {"a": (5, 9), "b": (70, 80), "c": (1, 1)}.items():
        made[name] = rng.integers(0, 256, (h, w, 3)).astype(np.uint8)
        (tmp_path / f"{name}.png").write_bytes(png(made[name]) + b"\n")
    page = np.full((80, 100, 3), 30, np.uint8)
    page[6:72, 10:95] = (230, 230, 180)  # too yellow for a paper only if blue were red
    made["page"] = page
    (tmp_path / "page.png").write_bytes(png(page))
    (tmp_path / "broken.png").write_bytes(b"\x89PNG no image")
    return str(tmp_path), made


def test_images_are_decoded_and_broken_ones_left_out(spark, folder):
    path, made = folder
    rows = {r["name"]: r for r in images.read_images(spark, path).withColumn("name", F.regexp_extract(images.file_name(F.col("path")), r"(.*)\.png", 1)).collect()}
    assert rows.keys() == made.keys()
    for name, r in rows.items():
        h, w, _ = made[name].shape
        assert (r["height"], r["width"], r["channels"]) == (h, w, 3)
        assert bytes(r["pixels"]) == made[name][:, :, ::-1].tobytes()


def test_paper_of_blue_first_pixels(spark, folder):
    path, made = folder
    b = images.read_images(spark, path).select("path", pixels.paper_bounds_column(F.col("pixels"), F.col("width"), F.col("height"), 3, bgr=True).alias("b")).collect()
    got = {r["path"].rsplit("/", 1)[1][:-4]: tuple(r["b"]) for r in b}
    assert got == {name: pixels.paper_bounds(plane) for name, plane in made.items()}
    assert got["page"] != (0, 0, 100, 80)


def test_rectangles_are_burned_into_their_images(spark):
    plane = np.arange(4 * 6 * 3, dtype=np.uint8).reshape(4, 6, 3) + 1
    rows = [(i, 6, 4, plane.tobytes()) for i in (1, 2, 3)] + [(4, 6, 4, b"short"), (None, 6, 4, plane.tobytes())]
    df = spark.createDataFrame(rows, "image_id long, width int, height int, pixels binary")
    rects = [(1, (0.0, 0.0, 2.0, 1.0)), (1, (5.0, 3.0, 9.0, 9.0)), (2, None), (4, (0.0, 0.0, 9.0, 9.0)), (9, (0.0, 0.0, 9.0, 9.0)), (None, (0.0, 0.0, 9.0, 9.0))]
    got = {r["image_id"]: bytes(r["pixels"]) for r in redact.burn_images(df, spark.createDataFrame(rects, f"image_id long, rect {RECT}")).collect()}
    black = plane.copy()
    black[0, :2] = 0
    black[3, 5] = 0
    assert got == {1: black.tobytes(), 2: plane.tobytes(), 3: plane.tobytes(), 4: b"short", None: plane.tobytes()}


def test_content_types_by_name(spark):
    names = ["a.png", "B.JPG", "x.tar.gz", "none", ".pdf", "photo.webp", None]
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", images.mime_of(F.col("name")).alias("m")).collect()
    assert [r["m"] for r in rows] == ["image/png", "image/jpeg", None, None, "application/pdf", "image/webp", None]
