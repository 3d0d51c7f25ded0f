"""Document types by weighted keywords, row by row, without a shuffle."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import half_up, normalize_text, once
from ..rules import CLASSIFICATION, LEAST_SCORE, OTHER


#: An upper-case letter that a match begins with, and a group of such beginnings.
_LETTER = r"[A-Z](?![?*+{])"
_GROUP = rf"\(\?:{_LETTER}(?:[^()|]|\(\?:[^()]*\))*(?:\|{_LETTER}(?:[^()|]|\(\?:[^()]*\))*)*\)(?![?*+{{])"


def ascii_bounds(pattern: str) -> str:
    """``\\b`` as an ASCII word boundary, where Java's knows more letters.

    Before a letter it is looked for behind that letter, which few places have.
    """
    edge = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    pattern = re.sub(rf"\\b({_LETTER})", r"\1(?<![A-Za-z0-9_]\1)", pattern)
    pattern = re.sub(rf"\\b({_GROUP})", r"(?<![A-Za-z0-9_])\1", pattern)
    return re.sub(r"\\b", lambda _: edge, pattern)


def alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern, or of the one group that it consists of."""
    whole = re.fullmatch(r"\\b\(\?:([^()]*)\)\\b", pattern)
    out, depth = [""], 0
    for c in whole.group(1) if whole else pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def anchor(alternative: str) -> str | None:
    """Characters that each match of ``alternative`` contains; None if none are sure."""
    sure = re.sub(r"\(\?:[^()]*(?:\([^()]*\)\??[^()]*)*\)\??|\[[^\]]*\]|\\.[*+?]?|[^<][*?]", "\n", alternative)
    return max(re.findall("[A-ZÄÖÜ]{3,}|<", sure), key=len, default=None)


def anchors(alternative: str) -> list[str] | None:
    """Strings of which each match of ``alternative`` contains one: its anchor, or
    those of a group that it cannot do without."""
    if sure := anchor(alternative):
        return [sure]
    for group in re.finditer(r"\(\?:((?:[^()]|\(\?:[^()]*\)\??)*)\)(?![?*])", alternative):
        inner = [anchor(x) for x in alternatives(group.group(1))]
        if None not in inner:
            return inner
    return None


def has_keyword(normalized: Column, pattern: str) -> Column:
    """Whether ``pattern`` matches; texts without its anchors never reach it."""
    found = normalized.rlike(ascii_bounds(pattern))
    sure = [anchors(x) for x in alternatives(pattern)]
    return found if None in sure else reduce(lambda a, b: a | b, [normalized.contains(x) for some in sure for x in some]) & found


def keyword_scores(normalized: Column, rules=CLASSIFICATION) -> Column:
    """array<struct<score, order, type, matches>>, best first: higher score, then
    the earlier rule."""

    def scorer(order: int, kind: str) -> Callable[[Column], Column]:
        def run(found: Column) -> Column:
            total = F.aggregate(found, F.lit(0), lambda n, m: n - m["weight"])
            return F.struct(total.alias("negative"), F.lit(order).alias("order"), F.lit(kind).alias("type"), F.transform(found, lambda m: m["label"]).alias("matches"))

        return run

    scored = []
    for order, (kind, words) in enumerate(rules):
        hit = [F.when(has_keyword(normalized, p), F.struct(F.lit(w).alias("weight"), F.lit(label).alias("label"))) for label, p, w in words]
        scored.append(once(F.array_compact(F.array(*hit)), scorer(order, kind)))
    return F.array_sort(F.array(*scored))


def classify(text: Column, rules=CLASSIFICATION) -> Column:
    """struct(type, confidence, matched_keywords, explanation) of a text.  A null
    or blank text has no type and confidence 0."""

    def made(kind: Column, confidence: Column, words: Column, why: Column) -> Column:
        return F.struct(kind.alias("type"), confidence.cast("int").alias("confidence"), words.alias("matched_keywords"), why.alias("explanation"))

    empty = made(F.lit(OTHER), F.lit(0), F.array().cast("array<string>"), F.lit("Kein auswertbarer OCR-Text vorhanden."))

    def choose(ranked: Column) -> Column:
        best, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
        score, margin = -best["negative"], second["negative"] - best["negative"]
        found = F.size(best["matches"])
        sure = F.least(F.lit(98), half_up(45 + score * 5 + found * 3 + F.greatest(F.lit(0), margin) * 2).cast("int"))
        weak = made(F.lit(OTHER), F.least(F.lit(35), score * 10), best["matches"], F.lit("Die gefundenen Begriffe reichen für eine zuverlässige Zuordnung nicht aus."))
        why = F.concat(F.lit("Erkannt anhand von: "), F.array_join(best["matches"], ", "), F.lit("."))
        return F.when(score < LEAST_SCORE, weak).otherwise(made(best["type"], sure, best["matches"], why))

    def typed(normalized: Column) -> Column:
        return F.when(normalized == "", empty).otherwise(once(keyword_scores(normalized, rules), choose))

    return once(normalize_text(F.coalesce(text, F.lit(""))), typed)
