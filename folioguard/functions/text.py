"""String, date and JSON expressions over columns.  Nulls stay null unless a
function says otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"(?U)\s+"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed a single time: it is bound to the
    variable of a one-element transform, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_token(c: Column) -> Column:
    """Upper case, A-Z and 0-9 alone."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def normalize_text(c: Column) -> Column:
    """Upper case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.upper(c), SPACES, " "))


def masked(c: Column) -> Column:
    """First two and last two characters with at most nine bullets between; five
    bullets for values of up to five characters."""
    n = F.length(c)
    between = F.repeat(F.lit("•"), F.least(F.lit(9), n - 4))
    return F.when(n <= 5, "•••••").otherwise(F.concat(F.left(c, F.lit(2)), between, F.right(c, F.lit(2))))


def without_marks(c: Column) -> Column:
    """Compatibility decomposition without combining marks U+0300 to U+036F."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        def plain(s: str | None) -> str | None:
            return s and "".join(x for x in unicodedata.normalize("NFKD", s) if not "̀" <= x <= "ͯ")

        return pa.array([plain(t.as_py()) for t in texts], pa.string())

    return run(c)


def _dashed(c: Column, allowed: str, most: int) -> Column:
    dashes = F.regexp_replace(without_marks(c), f"[^{allowed}]+", "-")
    return F.substring(F.regexp_replace(dashes, "^-+|-+$", ""), 1, most)


def folder_file_name(title: Column, prefix: str = "Mappe", fallback: str = "Wohnungsbewerbung") -> Column:
    """``prefix-title.pdf`` with other characters as dashes, 60 of them at most."""
    name = _dashed(F.coalesce(title, F.lit("")), "a-zA-Z0-9äöüÄÖÜß_-", 60)
    return F.concat(F.lit(f"{prefix}-"), F.coalesce(F.nullif(name, F.lit("")), F.lit(fallback)), F.lit(".pdf"))


def bundle_file_name(slot: Column, fallback: Column | None = None) -> Column:
    """The name of a file of several pages, from the slot or the fallback."""
    either = F.coalesce(F.nullif(slot, F.lit("")), fallback if fallback is not None else F.lit("Dokument"))
    return F.concat(F.coalesce(F.nullif(_dashed(either, "a-zA-Z0-9_-", 52), F.lit("")), F.lit("Dokument")), F.lit("-mehrseitig.pdf"))


def watermark(address: Column, custom: Column | None = None) -> Column:
    """The rental watermark; a custom text that is not blank wins."""
    clean = F.regexp_replace(strip(F.coalesce(address, F.lit(""))), SPACES, " ")
    own = F.when(clean != "", F.concat(F.lit("Nur für Wohnungsbewerbung – "), clean)).otherwise("Nur für diese Wohnungsbewerbung")
    return own if custom is None else F.coalesce(F.nullif(strip(custom), F.lit("")), own)


def or_blank(c: Column, fallback: str) -> Column:
    """Trimmed text, or the fallback for blank and null."""
    return F.coalesce(F.nullif(strip(c), F.lit("")), F.lit(fallback))


def contact_lines(*columns: Column) -> Column:
    """Trimmed lines without the empty ones."""
    return F.filter(F.array(*[strip(F.coalesce(c, F.lit(""))) for c in columns]), lambda x: x != "")


def megabytes(size: Column) -> Column:
    """With two decimals; what is halfway between two, which only sizes of whole
    multiples of 128 KB are, goes to the even one, as in SQL."""
    return F.format_string("%.2f MB", F.bround(size / 1048576.0, 2))


def german_date(ts: Column, with_time: bool = False) -> Column:
    """``dd.MM.yyyy`` or ``dd.MM.yyyy, HH:mm`` in the session's time zone."""
    return F.date_format(ts, "dd.MM.yyyy, HH:mm" if with_time else "dd.MM.yyyy")


def page_label(start: Column, end: Column) -> Column:
    return F.when(start == end, start.cast("string")).otherwise(F.concat(start.cast("string"), F.lit("–"), end.cast("string")))


def row_number_label(n: Column) -> Column:
    """At least two digits."""
    return F.when(F.length(n.cast("string")) >= 2, n.cast("string")).otherwise(F.lpad(n.cast("string"), 2, "0"))


def footer(slot: Column, name: Column, page: Column) -> Column:
    return F.concat(F.coalesce(slot, name), F.lit(" · Seite "), page.cast("string"))


def download_name(name: Column, fallback: str = "Mappe.pdf") -> Column:
    """Forbidden characters as dashes, 120 characters at most."""
    some = F.coalesce(F.nullif(name, F.lit("")), F.lit(fallback))
    return F.substring(F.regexp_replace(some, r'[\\/:*?"<>|\r\n]+', "-"), 1, 120)


def protected_name(name: Column, extension: str = "png") -> Column:
    """``<base>-geschuetzt.<extension>``."""
    return F.concat(F.regexp_replace(name, r"\.[^.]+$", ""), F.lit(f"-geschuetzt.{extension}"))


def polygon_points(points: Column) -> Column:
    """``x,y`` in percent with two decimals for an array of (x, y) structs."""
    return F.array_join(F.transform(points, lambda p: F.format_string("%.2f,%.2f", p["x"] * 100, p["y"] * 100)), " ")


def half_up(c: Column) -> Column:
    """Rounded half towards plus infinity, as a long."""
    return F.floor(c + 0.5)
