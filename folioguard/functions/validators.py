"""Checks for sensitive identifiers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import ID_LABEL, SOCIAL_CONTEXT, TAX_CONTEXT
from .text import normalize_token, once

SOCIAL, TAX = "[0-9]{8}[A-Z][0-9]{3}", "[0-9]{11}"
IBAN_SHAPE = "[A-Z]{2}[0-9]{2}"
IBAN_HINT = IBAN_SHAPE + "[A-Z0-9]{11}"


def _compact_iban_ok(iban: Column) -> Column:
    turned = F.concat(F.substring(iban, 5, 1000), F.left(iban, F.lit(4)))
    digit = lambda c: F.ascii(c) - F.when(F.ascii(c) >= 65, 55).otherwise(48)
    step = lambda acc, c: F.pmod(acc * F.when(F.ascii(c) >= 65, 100).otherwise(10) + digit(c), F.lit(97))
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c)))
    shape = iban.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (~iban.startswith("DE") | (F.length(iban) == 22))
    return F.when(shape, rest == 1).otherwise(False)


def is_valid_iban(value: Column) -> Column:
    """Shape, 22 characters for DE, and remainder 1 by 97."""
    return _compact_iban_ok(normalize_token(value))


def find_ibans(compact: Column) -> Column:
    """array<struct<value, start>> of the shortest valid IBAN at each place of a
    compact line that looks like one; starts count from 0."""
    none = F.array().cast("array<struct<value: string, start: int>>")

    def shortest(start: Column) -> Column:
        def of(head: Column) -> Column:
            fits = F.filter(F.sequence(F.lit(15), F.length(head)), lambda k: _compact_iban_ok(F.substr(head, F.lit(1), k)))
            return F.struct(F.substr(head, F.lit(1), F.get(fits, F.lit(0))).alias("value"), start.alias("start"))

        return once(F.substr(compact, start + 1, F.lit(34)), of)

    # Each piece but a first one that does not look like it begins at such a place.
    pieces = F.split(compact, f"(?={IBAN_HINT})", -1)
    ends = lambda p: F.transform(p, lambda _, i: F.aggregate(F.slice(p, F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x)))
    starts = once(pieces, lambda p: F.filter(ends(p), lambda n, i: F.get(p, i).rlike(f"^{IBAN_SHAPE}")))
    found = F.filter(F.transform(starts, shortest), lambda m: m["value"].isNotNull())
    return F.when(compact.rlike(IBAN_HINT), found).otherwise(none)


def all_matches(compact: Column, pattern: str, length: int) -> Column:
    """array<struct<value, start>> of the leftmost matches, which have one
    length, without overlaps."""
    values, pieces = F.regexp_extract_all(compact, F.lit(pattern), F.lit(0)), F.split(compact, pattern, -1)

    def at(value: Column, k: Column) -> Column:
        before = F.aggregate(F.slice(pieces, F.lit(1), k + 1), F.lit(0), lambda n, p: n + F.length(p))
        return F.struct(value.alias("value"), (before + k * length).alias("start"))

    return F.transform(values, at)


def is_tax_id(line: Column, value: Column) -> Column:
    """Eleven digits, not all equal, and a context word on the line."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return digits.rlike("^[0-9]{11}$") & ~digits.rlike(r"^([0-9])\1{10}$") & line.rlike(TAX_CONTEXT)


def is_social_security_number(line: Column, value: Column) -> Column:
    return value.rlike(f"^{SOCIAL}$") & line.rlike(SOCIAL_CONTEXT)


def identity_number(text: Column) -> Column:
    """struct(value, start) of the 8 to 12 characters behind the first label;
    null without one."""
    pattern = f"(?:{ID_LABEL})([A-Z0-9]{{8,12}})"

    def of(compact: Column) -> Column:
        def made(whole: Column) -> Column:
            value = F.regexp_extract(whole, pattern, 1)
            start = F.instr(compact, whole) - 1 + F.length(whole) - F.length(value)
            return F.struct(value.alias("value"), start.cast("int").alias("start"))

        return once(F.regexp_extract(compact, pattern, 0), lambda whole: F.when(whole != "", made(whole)))

    return once(normalize_token(text), of)


def is_mrz_line(text: Column) -> Column:
    """Twenty machine characters with three fillers, or with a document prefix, 24
    other characters and six digits in a row."""

    def of(machine: Column) -> Column:
        def judged(compact: Column) -> Column:
            prefix = compact.rlike("^(?:I[D0]D|P[A-Z0-9])")
            fillers = F.length(machine) - F.length(compact)
            return (F.length(machine) >= 20) & ((fillers >= 3) | (prefix & (F.length(compact) >= 24) & compact.rlike("[0-9]{6}")))

        return once(F.replace(machine, F.lit("<"), F.lit("")), judged)

    return once(F.regexp_replace(F.upper(text), "[^A-Z0-9<]", ""), of)


def is_signature_label(normalized: Column) -> Column:
    return normalized.rlike("UNTERSCHRIFT|SIGNATURE")
