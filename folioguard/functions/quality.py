"""Scan quality grades from statistics, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TITLES = {"good": "Dokument vollständig und gut lesbar", "check": "Aufnahme bitte prüfen", "retry": "Neu fotografieren empfohlen"}


def _metric(name: str, label: str, status: str, message: str, cost: int) -> Column:
    return F.struct(F.lit(name).alias("id"), F.lit(label).alias("label"), F.lit(status).alias("status"), F.lit(message).alias("message"), F.lit(cost).alias("cost"))


def grade(statistics: Column, short_edge: Column, framing_safe: Column) -> Column:
    """struct(score, level, title, metrics) of scan statistics (mean, deviation,
    strength, coverage).  Null statistics are missing image data: score 0."""
    mean, deviation, strength, coverage = (statistics[f] for f in ("mean", "deviation", "strength", "coverage"))
    made = F.array(
        F.when(framing_safe, _metric("framing", "Blattränder", "good", "Alle vier Blattränder sicher erkannt", 0)).otherwise(
            _metric("framing", "Blattränder", "check", "Blattränder bitte in der Vorschau prüfen", 12)
        ),
        F.when((strength < 14) | (coverage < 0.003), _metric("sharpness", "Schärfe", "poor", "Zu wenig klare Textkanten erkannt", 32))
        .when((strength < 28) | (coverage < 0.012), _metric("sharpness", "Schärfe", "check", "Kleine Schrift bitte kurz prüfen", 12))
        .otherwise(_metric("sharpness", "Schärfe", "good", "Textkanten wirken klar", 0)),
        F.when(mean < 62, _metric("brightness", "Licht", "poor", "Aufnahme ist zu dunkel", 28))
        .when(mean < 88, _metric("brightness", "Licht", "check", "Mehr Licht wäre besser", 12))
        .when(mean > 232, _metric("brightness", "Licht", "check", "Sehr hell – Text prüfen", 12))
        .otherwise(_metric("brightness", "Licht", "good", "Gut ausgeleuchtet", 0)),
        F.when(deviation < 18, _metric("contrast", "Kontrast", "poor", "Text hebt sich kaum ab", 24))
        .when(deviation < 30, _metric("contrast", "Kontrast", "check", "Kontrast bitte prüfen", 10))
        .otherwise(_metric("contrast", "Kontrast", "good", "Dokument gut lesbar", 0)),
        F.when(short_edge < 620, _metric("resolution", "Auflösung", "poor", "Zu wenig Bilddetails", 32))
        .when(short_edge < 900, _metric("resolution", "Auflösung", "check", "Für kleine Schrift knapp", 12))
        .otherwise(_metric("resolution", "Auflösung", "good", "Ausreichend Details", 0)),
    )
    metrics = F.when(mean.isNull(), F.array(_metric("resolution", "Auflösung", "poor", "Bilddaten fehlen", 100))).otherwise(made)

    def graded(m: Column) -> Column:
        score = F.greatest(F.lit(0), 100 - F.aggregate(m, F.lit(0), lambda n, x: n + x["cost"]))
        has = lambda status: F.exists(m, lambda x: x["status"] == status)
        level = F.when((score < 58) | has("poor"), "retry").when((score < 80) | has("check"), "check").otherwise("good")
        title = F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair])
        shown = F.transform(m, lambda x: F.struct(x["id"].alias("id"), x["label"].alias("label"), x["status"].alias("status"), x["message"].alias("message")))
        return F.struct(score.alias("score"), level.alias("level"), F.element_at(title, level).alias("title"), shown.alias("metrics"))

    return F.get(F.transform(F.array(metrics), graded), F.lit(0))


def main_hint(metrics: Column) -> Column:
    """The first poor metric, else the first to check, else the first."""
    first = lambda status: F.get(F.filter(metrics, lambda m: m["status"] == status), F.lit(0))
    return F.coalesce(first("poor"), first("check"), F.get(metrics, F.lit(0)))
