"""Readable numbers, dates and units for explanation text.

``format_number`` with a pattern rounds the exact binary value half to even,
so 0.125 prints as 0.12; ``format_string`` would print 0.13.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column, decimals: int) -> Column:
    pattern = "0" if decimals == 0 else "0." + "0" * decimals
    return F.call_function("format_number", x, F.lit(pattern))


def value(v: Column) -> Column:
    """0, 1 or 2 decimals by magnitude."""
    size = F.abs(v)
    return F.when(size >= 100, fixed(v, 0)).when(size >= 10, fixed(v, 1)).otherwise(fixed(v, 2))


def signed_pct(fraction: Column) -> Column:
    return F.concat(F.when(fraction < 0, "").otherwise("+"), fixed(fraction * 100.0, 1), F.lit(" %"))


def pct(fraction: Column) -> Column:
    return F.concat(fixed(fraction * 100.0, 1), F.lit(" %"))


def utc_date(t: Column) -> Column:
    """Calendar date of epoch seconds, independent of the session time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(t / 86400).cast("int"))


def iso_date(t: Column) -> Column:
    return utc_date(t).cast("string")


def iso_instant(t: Column) -> Column:
    """RFC 3339 UTC text of epoch seconds."""
    s = F.pmod(t, F.lit(86400))
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    return F.concat(
        iso_date(t), F.lit("T"), two(s / 3600), F.lit(":"), two((s % 3600) / 60), F.lit(":"), two(s % 60), F.lit("Z")
    )


def p_value(p: Column) -> Column:
    return F.when(p < 0.001, F.lit("p < 0.001")).otherwise(F.concat(F.lit("p = "), fixed(p, 3)))


def display_unit(unit: Column) -> Column:
    # UCUM spellings and how clinicians read them.
    for ucum, prose in (("m[IU]/L", "mIU/L"), ("umol/L", "µmol/L"), ("mL/min/{1.73_m2}", "mL/min/1.73 m²")):
        unit = F.replace(unit, F.lit(ucum), F.lit(prose))
    return unit


def stripped(raw: Column | str) -> Column:
    """Without white space of any script at both ends: tabs, line ends and no-break spaces as well as blanks."""
    return F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")


def text(*parts) -> Column:
    """Concatenate literals and columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
