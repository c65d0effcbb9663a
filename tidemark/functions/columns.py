"""Column expressions that every layer uses."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

def safe(name: str, kind: str) -> Column:
    """``name`` trimmed and cast; what does not parse becomes NULL instead of an ANSI error."""
    return F.col(name).cast("string").alias(name) if kind == "string" else F.expr(f"try_cast(trim(`{name}`) AS {kind})").alias(name)


def clean(name: str, case: str | None = None) -> Column:
    """``name`` trimmed, in upper or lower case if asked."""
    trimmed = F.trim(F.col(name))
    return {"upper": F.upper(trimmed), "lower": F.lower(trimmed), None: trimmed}[case].alias(name)


def row_hash(names: Sequence[str]) -> Column:
    """SHA-256 of the columns as one JSON object with its NULLs, so that no two different rows look alike."""
    return F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)


def raw_payload(names: Iterable[str]) -> Column:
    """The record as JSON text; NULL fields are left out."""
    return F.to_json(F.struct(*(F.col(n) for n in names)))


def trailing(day: Column, as_of: Column, days: int) -> Column:
    """Whether ``day`` lies in (as_of - days, as_of]."""
    return (day > F.date_sub(as_of, days)) & (day <= as_of)


def following(day: Column, as_of: Column, days: int) -> Column:
    """Whether ``day`` lies in (as_of, as_of + days]."""
    return (day > as_of) & (day <= F.date_add(as_of, days))


def in_effect(valid_from: Column, valid_to: Column, moment: Column) -> Column:
    """Whether the half-open validity interval holds ``moment``; a NULL end is open."""
    return (valid_from <= moment) & (valid_to.isNull() | (valid_to > moment))


def mask_email(email: Column, may_see: bool) -> Column:
    return email if may_see else F.regexp_replace(email, "^[^@]+", "***")


def region_filter(country: Column, regions: Sequence[str] | None) -> Column:
    """All rows without ``regions``, else those whose country is among them, whatever its case."""
    return F.lit(True) if regions is None else F.lower(country).isin([r.lower() for r in regions])


def ratio(part: Column, whole: Column) -> Column:
    """NULL where the denominator is zero or NULL."""
    return F.when(whole != 0, part / whole)


def date_list(name: str, days: Iterable[str]) -> Column:
    """Whether a date is one of ``days``, dates or texts like ``2025-01-31``."""
    return F.col(name).isin([F.lit(d).cast("date") for d in days])


def snapshot_date(path: Column) -> Column:
    """The date in a file name that ends in ``YYYYMMDD.csv``; NULL for any other name."""
    return F.try_to_date(F.regexp_extract(path, r"(\d{8})\.csv$", 1), "yyyyMMdd")
