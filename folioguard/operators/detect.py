"""From OCR words to detections.

Words are read and shuffled once, to their lines.  What the rules find in a line,
and the words that matter beyond it, leave it as marks; these few are shuffled by
document, where windows choose among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import half_up, once
from ..functions.validators import SOCIAL, TAX, all_matches, find_ibans, identity_number, is_mrz_line, is_signature_label, is_social_security_number, is_tax_id
from ..rules import ID_LABEL, ID_LABEL_TOKEN, ID_NUMBER, MRZ, SIGNATURE

WORD = ("left", "word_seq", "text", "normalized", "top", "width", "height", "confidence")
BOX = "struct<left: double, top: double, width: double, height: double>"


def assemble_lines(words: DataFrame) -> DataFrame:
    """One row for each (``doc_id``, ``line_key``): ``words`` from left to right
    (ties in input order), the ``compact`` text, the ``raw`` text, and the input
    place ``line_seq`` of the line's first word."""
    return with_texts(words.groupBy("doc_id", "line_key").agg(F.collect_list(F.struct(*WORD)).alias("words")))


def with_texts(lines: DataFrame) -> DataFrame:
    """``lines`` (``doc_id``, ``line_key``, ``words``: structs of ``WORD``, each line
    one row) as ``assemble_lines`` gives them."""
    first = F.array_min(F.transform("words", lambda w: w["word_seq"])).alias("line_seq")
    return lines.select("doc_id", "line_key", F.array_sort("words").alias("words"), first).withColumns(
        {"compact": F.array_join(F.transform("words", lambda w: w["normalized"]), ""), "raw": F.array_join(F.transform("words", lambda w: w["text"]), " ")}
    )


def union_box(words: Column) -> Column:
    """The smallest box around an array of words or boxes."""
    left, top = F.array_min(F.transform(words, lambda w: w["left"])), F.array_min(F.transform(words, lambda w: w["top"]))
    right = F.array_max(F.transform(words, lambda w: w["left"] + w["width"]))
    bottom = F.array_max(F.transform(words, lambda w: w["top"] + w["height"]))
    return F.struct(left.alias("left"), top.alias("top"), (right - left).alias("width"), (bottom - top).alias("height"))


def mean_confidence(words: Column) -> Column:
    total = F.aggregate(F.transform(words, lambda w: F.greatest(F.lit(0.0), w["confidence"])), F.lit(0.0), lambda a, x: a + x)
    return half_up(total / F.size(words)).cast("int")


def words_in(words: Column, start: Column, end: Column) -> Column:
    """The words of a line that a range of its compact text touches: one slice of
    the line, by the places where its words end.  Words between have characters."""
    none = F.struct(F.lit(0).alias("at"), F.lit(0).alias("skipped"), F.lit(0).alias("touched"))

    def step(state: Column, w: Column) -> Column:
        at = state["at"] + F.length(w["normalized"])
        return F.struct(
            at.alias("at"), (state["skipped"] + (at <= start).cast("int")).alias("skipped"), (state["touched"] + ((at > start) & (state["at"] < end)).cast("int")).alias("touched")
        )

    return F.aggregate(words, none, step, lambda state: F.slice(words, state["skipped"] + 1, state["touched"]))


HIT = "array<struct<label: string, value: string, start: int, end: int>>"


def line_hits(compact: Column, raw: Column) -> Column:
    """array<struct<label, value, start, end>> of what the line rules find, in
    their order."""
    none = F.array().cast(HIT)

    def tagged(label: str, matches: Column) -> Column:
        made = F.transform(matches, lambda m: F.struct(F.lit(label).alias("label"), m["value"].alias("value"), m["start"].cast("int").alias("start"), (m["start"] + F.length(m["value"])).cast("int").alias("end")))
        return F.coalesce(made, none)

    def if_any(pattern: str, label: str, length: int, holds) -> Column:
        return F.when(compact.rlike(pattern), tagged(label, F.filter(all_matches(compact, pattern, length), lambda m: holds(compact, m["value"])))).otherwise(none)

    whole = F.struct(F.lit(MRZ).alias("label"), F.lit("MRZ-Zeile").alias("value"), F.lit(0).alias("start"), F.length(compact).alias("end"))
    number = once(identity_number(compact), lambda n: F.when(n.isNotNull(), tagged(ID_NUMBER, F.array(n))).otherwise(none))
    return F.concat(
        tagged("IBAN", find_ibans(compact)),
        if_any(SOCIAL, "Sozialversicherungsnummer", 12, is_social_security_number),
        if_any(TAX, "Steuer-ID", 11, is_tax_id),
        F.when(compact.rlike(ID_LABEL), number).otherwise(none),
        F.when(is_mrz_line(raw), F.array(whole)).otherwise(none),
    )


def line_marks(lines: DataFrame) -> DataFrame:
    """(``doc_id``, ``role``, ``seq``, ``label``, ``value``, ``selected``,
    ``words``): hits of the line rules (``hit``), signature labels (``sign``), and
    the words that the nearest labelled number is looked for among, ``label`` and
    ``value``.  ``seq`` is the order in which rules find them."""
    compact, raw = F.col("compact"), F.col("raw")
    # One look at each line first: most have nothing that a rule could use.
    some = lines.where(compact.rlike(f"[0-9]|UNTERSCHRIFT|SIGNATURE|{ID_LABEL}|{ID_LABEL_TOKEN}") | (F.length(raw) - F.length(F.replace(raw, F.lit("<"), F.lit(""))) >= 3))
    seq = lambda part, line, place: F.struct(F.lit(part).alias("part"), line.alias("line_seq"), place.alias("place"))

    def mark(role: str, at: Column, label: Column, value: Column, selected: bool, words: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), at.alias("seq"), label.alias("label"), value.alias("value"), F.lit(selected).alias("selected"), words.alias("words"))

    def of_word(role: str, part: int, label: str, selected: bool, value: str | None = None):
        return lambda w: mark(role, seq(part, w["word_seq"], F.lit(0)), F.lit(label), w["normalized"] if value is None else F.lit(value), selected, F.array(w))

    words = F.col("words")
    hits = F.transform(line_hits(compact, raw), lambda h, i: mark("hit", seq(0, F.col("line_seq"), i), h["label"], h["value"], True, words_in(words, h["start"], h["end"])))
    signs = F.transform(F.filter(words, lambda w: is_signature_label(w["normalized"])), of_word("sign", 2, SIGNATURE, False, "Bitte visuell prüfen"))
    labels = F.transform(F.filter(words, lambda w: w["normalized"].rlike(f"^(?:{ID_LABEL_TOKEN})$")), of_word("label", 1, ID_NUMBER, True))
    is_value = lambda n: F.length(n).between(8, 12) & n.rlike("[0-9]") & n.rlike("^[A-Z0-9]+$") & n.rlike("[A-Z]")
    values = F.transform(F.filter(words, lambda w: is_value(w["normalized"])), of_word("value", 1, ID_NUMBER, True))
    return some.select("doc_id", F.inline(F.concat(hits, signs, labels, values)))


def detect(words: DataFrame) -> DataFrame:
    """All detections of a word table: ``doc_id``, ``detection_id``, ``label``,
    ``value``, ``confidence``, ``selected``, ``bbox`` and ``seq``.

    The identity number nearest below a label only counts where no line of the
    document has one: of the first label with a candidate, the nearest, then the
    first in input order.  Of repeats with one label, rounded corner and value the
    first stays.  Labels and numbers meet in the cells of a grid, so the work grows
    with the words of a document.
    """
    return _detected(line_marks(assemble_lines(words.select("doc_id", "line_key", *WORD))))


def detect_lines(lines: DataFrame) -> DataFrame:
    """``detect`` of words that are together by line already (``doc_id``, ``line_key``,
    ``words``), as a source that reads whole lines has them: no word is shuffled."""
    return _detected(line_marks(with_texts(lines)))


def _detected(marks: DataFrame) -> DataFrame:
    doc, own = W.partitionBy("doc_id"), F.get("words", F.lit(0))
    placed = marks.withColumn("numbered", F.max((F.col("role") == "hit") & (F.col("label") == ID_NUMBER)).over(doc))
    met = with_labels_of_cell(placed.withColumns({"left": own["left"], "top": own["top"], "height": own["height"], "word_seq": own["word_seq"]}))
    down, across = lambda l: F.col("top") - l["bottom"], lambda l: F.abs(F.col("left") - l["left"])
    near = lambda l: (down(l) >= -4) & (down(l) <= F.greatest(F.lit(80.0), l["height"] * 5)) & (across(l) <= 180)
    rank = lambda l: F.struct(l["seq"].alias("label_seq"), (F.abs(down(l)) + across(l) * 0.2).alias("far"), F.col("word_seq").alias("word_seq"))
    ranked = met.withColumn("rank", F.when((F.col("role") == "value") & ~F.col("numbered"), F.array_min(F.transform(F.filter("labels", near), rank)))).drop("labels")
    nearest = F.coalesce(F.col("rank") == F.min("rank").over(doc), F.lit(False))
    found = ranked.withColumn("nearest", nearest).where(F.col("role").isin("hit", "sign") | F.col("nearest")).select(
        "doc_id", "label", "value", mean_confidence(F.col("words")).alias("confidence"), "selected", union_box(F.col("words")).alias("bbox"), "seq"
    )
    return first_of_each(found.withColumn("detection_id", detection_key(F.col("label"), F.col("bbox"), F.col("value"))))


#: How far right or left, and how far down, a number may be from its label.
ACROSS, DOWN, UP = 180, 80, 4


def with_labels_of_cell(marks: DataFrame) -> DataFrame:
    """``marks`` but labels, with ``labels``: of values, those labels that may be
    near, as array<struct<seq, left, bottom, height>>.

    Documents are laid out in cells of ``ACROSS`` by ``DOWN``, and by twice, four
    times ... ``DOWN`` for higher labels.  A label is in the few cells of its level
    that a value near it can be in, a value in one of each level of its document;
    they meet within cells, all in the partitions of their documents.  Of labels at
    one place the first counts.
    """
    label, value = F.col("role") == "label", F.col("role") == "value"

    def step(x, size) -> Column:
        return F.floor(F.least(F.greatest(x / size, F.lit(-1e15)), F.lit(1e15))).cast("long")

    def cell(level: Column, column: Column, row: Column) -> Column:
        return F.struct(level.alias("level"), column.alias("column"), row.alias("row"))

    column, bottom = step(F.col("left"), ACROSS), F.col("top") + F.col("height")
    band = F.greatest(F.lit(float(DOWN)), F.col("height") * 5)
    level = F.ceil(F.log2(F.least(band / DOWN, F.lit(1e15)))).cast("int")
    size = lambda k: F.lit(float(DOWN)) * F.pow(F.lit(2.0), k)
    rows = F.sequence(step(bottom - UP, size(level)), step(bottom + band, size(level)))
    reach = F.flatten(F.transform(F.sequence(column - 1, column + 1), lambda c: F.transform(rows, lambda r: cell(level, c, r))))
    own = F.transform(F.collect_set(F.when(label, level)).over(W.partitionBy("doc_id")), lambda k: cell(k, column, step(F.col("top"), size(k))))
    nowhere = cell(F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(None).cast("long"))
    first = F.row_number().over(W.partitionBy("doc_id", "role", "left", "top", "height").orderBy("word_seq"))
    dealt = marks.withColumns({"nth": first, "own": own}).where(~label | (F.col("nth") == 1))
    cells = F.when(label, reach).when(value, F.col("own")).otherwise(F.array(nowhere))
    dealt = dealt.withColumn("cell", F.explode(cells)).drop("nth", "own")
    known = F.when(label, F.struct(F.col("word_seq").alias("seq"), "left", bottom.alias("bottom"), "height"))
    # Hits have no cell of their own; each is alone in one, whatever their number.
    place = W.partitionBy("doc_id", "cell", F.when(~label & ~value, F.col("seq")))
    return dealt.withColumn("labels", F.when(value, F.collect_list(known).over(place))).where(~label).drop("cell")


def detection_key(label: Column, bbox: Column, value: Column) -> Column:
    return F.concat_ws("-", label, half_up(bbox["left"]).cast("string"), half_up(bbox["top"]).cast("string"), value)


def first_of_each(found: DataFrame) -> DataFrame:
    """The first by ``seq`` of each (``doc_id``, ``detection_id``)."""
    order = W.partitionBy("doc_id", "detection_id").orderBy("seq")
    return found.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def union_detections(text: DataFrame, codes: DataFrame, manual: DataFrame) -> DataFrame:
    """Detections of the text rules, of decoded codes (``doc_id``, ``value``,
    ``bbox``) and of manual boxes (``doc_id``, ``bbox``) in one table; codes have
    confidence 95 and manual boxes 100."""
    columns = ("doc_id", "label", "value", "confidence", "selected", "bbox")
    code = codes.select("doc_id", F.lit("QR-Code / Barcode").alias("label"), "value", F.lit(95).alias("confidence"), F.lit(True).alias("selected"), "bbox")
    hand = manual.where(F.col("bbox").isNotNull()).select(
        "doc_id", F.lit("Manuelle Schwärzung").alias("label"), F.lit("Manuell ausgewählt").alias("value"), F.lit(100).alias("confidence"), F.lit(True).alias("selected"), "bbox"
    )
    return text.select(*columns).unionByName(code).unionByName(hand)
