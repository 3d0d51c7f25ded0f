"""Validators, classification, advice, folders, geometry and pixels by example."""

import tempfile

import pytest
from pyspark.sql import functions as F

from folioguard.functions import geometry as g
from folioguard.functions import pixels, quality
from folioguard.functions import text as t
from folioguard.functions import validators as v
from folioguard.operators import advise, classify, detect, drafts, folder, frames, redact
from folioguard.sources import ocr, profiles, store


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(s):
    return F.lit(s)


@pytest.mark.parametrize(
    "value, good",
    [("DE89 3704 0044 0532 0130 00", True), ("DE89 3704 0044 0532 0130 01", False), ("GB82WEST12345698765432", True), ("NL91ABNA0417164300", True), ("FR1420041010050500013M02606", True), ("DE8937040044053201300", False), ("", False)],
)
def test_iban(spark, value, good):
    assert one(spark, v.is_valid_iban(lit(value))) is good


def test_identifiers(spark):
    found = lambda s: [(m["value"], m["start"]) for m in one(spark, v.find_ibans(lit(s)))]
    assert found("IBANDE89370400440532013000BICCOBADEFFXXX") == [("DE89370400440532013000", 4)] and found("") == [] and found("AB12") == []
    assert one(spark, v.is_tax_id(lit("STEUERID12345678901"), lit("12345678901"))) and not one(spark, v.is_tax_id(lit("RECHNUNGSNUMMER12345678901"), lit("12345678901")))
    assert not one(spark, v.is_tax_id(lit("IDNR11111111111"), lit("11111111111")))
    assert one(spark, v.is_social_security_number(lit("SOZIALVERSICHERUNG120390A123"), lit("12039012A123")))
    assert not one(spark, v.is_social_security_number(lit("KUNDENNUMMER12039012A123"), lit("12039012A123")))
    assert one(spark, v.identity_number(lit("DOKUMENTNRL01X00T471")))["value"] == "L01X00T471" and one(spark, v.identity_number(lit("REFERENZNUMMER12345678901"))) is None
    assert one(spark, v.is_mrz_line(lit("IDD<<L01X00T471<<<<<<<<<<<<<<<"))) and one(spark, v.is_mrz_line(lit("9001010F3001010D<<<<<<<<<<<<<<<")))
    assert not one(spark, v.is_mrz_line(lit("IBAN DE89 3704 0044 0532 0130 00")))


WORDS = "doc_id long, line_key string, word_seq long, text string, normalized string, left double, top double, width double, height double, confidence double"


def test_nearest_label_and_repeats(spark):
    rows = [
        (1, "a", 0, "Dokumentnummer", "DOKUMENTNUMMER", 100.0, 100.0, 80.0, 12.0, 90.0), (1, "b", 1, "L01X00T47", "L01X00T47", 100.0, 118.0, 70.0, 12.0, 80.0),
        (2, "a", 0, "Dokumentnummer", "DOKUMENTNUMMER", 100.0, 100.0, 80.0, 12.0, 90.0), (2, "b", 1, "L01X00T47", "L01X00T47", 500.0, 400.0, 70.0, 12.0, 80.0),
        (3, "a", 0, "Unterschrift", "UNTERSCHRIFT", 5.0, 5.0, 9.0, 9.0, -1.0), (3, "b", 1, "Unterschrift", "UNTERSCHRIFT", 5.2, 5.2, 99.0, 9.0, 70.0),
    ]
    got = sorted((r["doc_id"], r["label"], r["value"], r["confidence"], r["selected"], r["bbox"]["width"]) for r in detect.detect(spark.createDataFrame(rows, WORDS)).collect())
    assert got == [(1, "Ausweisnummer", "L01X00T47", 80, True, 70.0), (3, "Unterschrift", "Bitte visuell prüfen", 0, False, 9.0)]
    assert detect.detect(spark.createDataFrame([], WORDS)).collect() == []


@pytest.mark.parametrize(
    "text, kind",
    [
        ("Gehaltsabrechnung Januar Brutto Netto Lohnsteuer Sozialversicherung", "Gehaltsabrechnung"), ("SCHUFA BonitätsAuskunft Basisscore Bonitätsinformationen", "SCHUFA-Auskunft"),
        ("BUNDESREPUBLIK DEUTSCHLAND PERS0NALAUSWEIS GEBURTSDATUM", "Identitätsnachweis"), ("Dies ist ein freundliches Anschreiben für eine Wohnung.", "Sonstiges"), (None, "Sonstiges"), ("NETTOÜ", "Sonstiges"),
        ("I0D <<< Date of birth", "Identitätsnachweis"), ("Reisepass", "Identitätsnachweis"), ("bewerbung für die wohnung", "Anschreiben"),
    ],
)
def test_types(spark, text, kind):
    assert one(spark, classify.classify(F.lit(text).cast("string")))["type"] == kind


def test_scores_and_advice(spark):
    d = spark.createDataFrame([(1, "Steuer-ID", True), (2, "Steuer-ID", False), (3, detect.MRZ, False), (3, detect.MRZ, False), (4, "IBAN", True), (4, "IBAN", False)], "doc_id long, label string, selected boolean")
    got = {r["doc_id"]: r["score"] for r in advise.privacy_scores(spark.range(1, 6).toDF("doc_id"), d).collect()}
    assert got == {1: 100, 2: 78, 3: 78, 4: 88, 5: 100}
    rows = {r["label"]: r["action"] for r in advise.recommend(d.withColumn("type", F.lit(None).cast("string"))).collect()}
    assert rows == {"Steuer-ID": "redact", detect.MRZ: "redact", "IBAN": "redact"}


def test_text_functions(spark):
    assert one(spark, t.masked(lit("12345"))) == "•••••" and one(spark, t.masked(lit("DE89370400440532013000"))) == "DE•••••••••00" and one(spark, t.masked(lit("123456"))) == "12••56"
    assert one(spark, t.folder_file_name(lit("Wohnung / Berlin?"))) == "Mappe-Wohnung-Berlin.pdf" and one(spark, t.folder_file_name(lit("ﬁ Straße"))) == "Mappe-fi-Straße.pdf"
    assert one(spark, t.bundle_file_name(F.lit(None).cast("string"), lit("Größe"))) == "Gro-e-mehrseitig.pdf"
    assert one(spark, t.watermark(lit("  Teststraße 12,  12345 Berlin  "))) == "Nur für Wohnungsbewerbung – Teststraße 12, 12345 Berlin" and one(spark, t.watermark(lit(" "))) == "Nur für diese Wohnungsbewerbung"


def test_sizes_halfway_go_to_the_even_hundredth(spark):
    sizes = [(131072 * 77777, "9722.12 MB"), (393216, "0.38 MB"), (131072, "0.12 MB"), (131073, "0.13 MB"), (1048576, "1.00 MB"), (0, "0.00 MB")]
    got = spark.createDataFrame([(n,) for n, _ in sizes], "n long").select("n", t.megabytes(F.col("n")).alias("s")).collect()
    assert {r["n"]: r["s"] for r in got} == dict(sizes)


def test_folder_rules(spark):
    docs = spark.createDataFrame([("f", 1, "z.pdf", "Anschreiben"), ("f", 2, "Ä.pdf", "Gehaltsnachweise"), ("f", 3, "a.pdf", "Gehaltsnachweise"), ("f", 4, "b.pdf", None), ("f", 5, "i.pdf", "Ausweiskopie")], "folder_id string, id long, name string, slot string")
    assert [r["id"] for r in folder.positions(docs).orderBy("position").collect()] == [1, 3, 2, 5, 4]
    c = folder.completeness(docs).first()
    assert (c["completed"], c["percent"], c["missing"]) == (3, 60, ["Mieterselbstauskunft", "SCHUFA-Auskunft"])
    turns = [("f", 4, 1, "Ausweiskopie"), ("f", 5, 2, "SCHUFA-Auskunft"), ("f", 4, 3, "Ausweiskopie"), ("f", 1, 4, "Ausweiskopie"), ("f", 1, 5, "Gehaltsnachweise"), ("f", 2, 6, None), ("f", 9, 7, "Anschreiben"), ("f", 3, 8, "Anschreiben")]
    got = {r["id"]: r["slot"] for r in folder.assign_slots(docs, spark.createDataFrame(turns, "folder_id string, id long, turn long, wanted string")).collect()}
    assert got == {1: "Gehaltsnachweise", 2: "Gehaltsnachweise", 3: "Anschreiben", 4: "Ausweiskopie", 5: "SCHUFA-Auskunft"}
    plan = folder.page_plan(spark.createDataFrame([("f", 1, 1, 1.0, True), ("f", 2, 2, 3.9, True), ("g", 1, 1, None, False)], "folder_id string, id long, ord long, page_count double, include_cover boolean"))
    assert sorted((r["folder_id"], r["page_label"]) for r in plan.collect()) == [("f", "2"), ("f", "3–5"), ("g", "1")]


def test_drafts(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/d"
    versions = spark.createDataFrame([("a", 1, 1, "old", False), ("a", 2, 2, "new", False), ("b", 1, 3, "x", False)], "id string, updated_at long, seq long, title string, deleted boolean")
    store.put_drafts(versions, path)
    assert [r["title"] for r in drafts.get_draft(store.read_versions(spark, path), "a").collect()] == ["new"]
    store.delete_drafts(spark.createDataFrame([("a",), ("zz",)], "id string"), path)
    assert [(r["id"], r["title"]) for r in drafts.newest_drafts(store.read_versions(spark, path), 5).collect()] == [("b", "x")]


def test_sources(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    header = "level\tpage\tblock\tpar\tline\tword\tleft\ttop\twidth\theight\tconf\ttext"
    rows = ["5\t1\t2\t3\t4\t1\t10\t20\t30\t40\t95.5\tStraße\tx ", "4\t1\t2\t3\t4\t1\t1\t1\t1\t1\t1\tno", "", "5\t1\t1\t1\t1\t1\t1\t1\t1\t1\t1\t<<<", "5\t1\t1\t1\t1\t1\tjunk\t1\t1\t1\t1\tgone", "5\t1\t1\t1\t1\t1\t1\t1\t1\t1\t\tok"]
    with open(f"{path}/a.tsv", "w", newline="") as f:
        f.write("\r\n".join([header, *rows]))
    got = [(r["word_seq"], r["text"], r["normalized"], r["line_key"], r["left"], r["confidence"]) for r in ocr.read_words(spark, path).orderBy("word_seq").collect()]
    assert got == [(1, "Straße\tx", "STRASSEX", "1-2-3-4", 10.0, 95.5), (6, "ok", "OK", "1-1-1-1", 1.0, 0.0)]
    names = spark.createDataFrame([("a.PDF", None), ("x", "image/png"), ("x", "text/plain")], "name string, mime string")
    assert [r[0] for r in names.select(ocr.supported(F.col("name"), F.col("mime"))).collect()] == [True, True, False]
    people = spark.createDataFrame([(" Ada ", "a@b", None, "x")], "name string, email string, phone string, currentAddress string")
    profiles.write_profiles(people, f"{path}/p")
    read = profiles.read_profiles(spark, f"{path}/p").where("name <> ''").collect()
    assert [(r["name"], r["email"], r["phone"]) for r in read] == [("Ada", "a@b", "")]


def test_geometry(spark):
    size = lambda w, h, **k: F.struct(lit(float(w)).alias("width"), lit(float(h)).alias("height"), *[lit(float(x)).alias(n) for n, x in k.items()])
    point = lambda x, y: F.struct(lit(float(x)).alias("x"), lit(float(y)).alias("y"))
    assert tuple(one(spark, g.document_point(point(150, 100), size(200, 100, left=50, top=50), size(1000, 500)))) == (500.0, 250.0)
    assert one(spark, g.manual_box(point(10, 10), point(12, 12))) is None and tuple(one(spark, g.manual_box(point(50, 60), point(10, 20)))) == (10.0, 20.0, 40.0, 40.0)
    box = g.box(lit(2500.0), lit(3400.0), lit(900.0), lit(900.0))
    assert tuple(one(spark, g.scale_box(g.box(lit(10.0), lit(20.0), lit(30.0), lit(40.0)), size(900, 1200), size(2700, 3600)))) == (30.0, 60.0, 90.0, 120.0)
    assert tuple(one(spark, g.scale_box(box, size(2700, 3600), size(2700, 3600)))) == (2500.0, 3400.0, 200.0, 200.0)
    assert tuple(one(spark, g.capture_size(lit(4000.0), lit(6000.0)))) == (2731, 4096) and tuple(one(spark, g.preview_size(lit(3000.0), lit(4000.0), lit(400.0), lit(300.0)))) == (225, 300)
    assert tuple(one(spark, g.preview_size(lit(0.0), lit(4000.0), lit(400.0), lit(300.0)))) == (1, 1)
    corners = lambda a, b: F.struct(point(a, a).alias("top_left"), point(b, a).alias("top_right"), point(b, b).alias("bottom_right"), point(a, b).alias("bottom_left"))
    assert one(spark, g.valid_corners(corners(0.1, 0.9))) and not one(spark, g.valid_corners(corners(0.5, 0.52))) and not one(spark, g.valid_corners(corners(-0.1, 0.9)))
    assert one(spark, g.safe_full_frame(corners(0.02, 0.98))) and not one(spark, g.safe_full_frame(corners(0.1, 0.9))) and one(spark, g.plausible_live_paper(corners(0.1, 0.9)))
    square = lambda a, b: [a, a, b, a, b, b, a, b]
    mid = frames.smooth(square(0.1, 0.9), square(0.15, 0.85))
    assert 0.1 < mid[0] < 0.15 and frames.smooth(square(0.1, 0.9), square(0.4, 0.6))[0] == 0.4


def test_boxes_on_no_page_are_reported(spark):
    found = spark.createDataFrame([(1, (0.0, 50.0, 10.0, 10.0)), (1, (0.0, 500.0, 10.0, 10.0))], f"doc_id long, bbox {detect.BOX}")
    pages = spark.createDataFrame([(1, 0, 0.0, 100.0, 100.0)], "doc_id long, page_no int, top double, width double, height double")
    placed = redact.boxes_to_pages(found, pages)
    assert sorted((r["bbox"]["top"], r["page_no"]) for r in placed.collect()) == [(50.0, 0), (500.0, None)] and redact.rectangles(placed).count() == 1


def test_pixels(spark):
    w = h = 100
    rgba = lambda f: bytes(x for y in range(h) for x_ in range(w) for x in (*([f(x_, y)] * 3), 255))
    stripes, flat, shifted = rgba(lambda x, y: 255 * (x // 2 % 2)), rgba(lambda x, y: 128), rgba(lambda x, y: 148)
    paper = rgba(lambda x, y: 240 if 10 <= x < 90 and 10 <= y < 90 else 20)
    df = spark.createDataFrame([(1, stripes), (2, flat), (3, None), (4, b"short"), (5, paper)], "i int, raw binary").withColumns({"w": F.lit(w), "h": F.lit(h)})
    r = F.col("raw"), F.col("w"), F.col("h")
    got = {x["i"]: x for x in df.select("i", pixels.sharpness_column(*r).alias("s"), pixels.scan_statistics_column(*r).alias("q"), pixels.paper_bounds_column(*r).alias("b")).collect()}
    assert got[1]["s"] > 200 and got[2]["s"] == got[3]["s"] == got[4]["s"] == 0 and got[3]["q"]["mean"] is None and abs(got[2]["q"]["mean"] - 128) < 1e-6
    assert abs(got[5]["b"]["left"] - 10) <= 2 and abs(got[5]["b"]["width"] - 80) <= 4 and tuple(got[2]["b"]) == (0, 0, 100, 100)
    two = spark.createDataFrame([(flat, shifted), (flat, stripes), (flat, None)], "a binary, b binary")
    moved = [x[0] for x in two.select(pixels.movement_column(F.col("a"), F.col("b"), lit(w), lit(h))).collect()]
    assert moved[0] < 1e-9 and moved[1] > 20 and moved[2] == float("inf")
    box = F.array(g.box(lit(0.0), lit(0.0), lit(2.0), lit(1.0)))
    assert one(spark, pixels.burn_column(F.lit(bytearray(flat)), lit(w), lit(h), box))[:12] == b"\0\0\0\xff\0\0\0\xff\x80\x80\x80\xff"
    graded = {x["i"]: x["g"] for x in df.select("i", quality.grade(pixels.scan_statistics_column(*r), lit(1000), lit(True)).alias("g")).collect()}
    assert graded[1]["level"] == "good" and graded[2]["level"] == "retry" and graded[3]["score"] == 0 and graded[3]["metrics"][0]["message"] == "Bilddaten fehlen"
