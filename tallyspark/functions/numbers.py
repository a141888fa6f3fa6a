"""Number rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, places: int = 0) -> Column:
    """Rounded with halves towards plus infinity, also for negative numbers."""
    unit = 10**places
    return F.floor(x * unit + 0.5) / unit


def sentinel_to_null(x: Column, y: Column) -> tuple[Column, Column]:
    """A pair that is (0, 0) stands for "not estimated"."""
    missing = (x == 0) & (y == 0)
    return F.when(~missing | missing.isNull(), x), F.when(~missing | missing.isNull(), y)


#: What sources write for a missing number.
MISSING = (".", "", "Not Available", "Withheld")


def number_or_missing(text: Column) -> Column:
    """A number; null for a marker of a missing one; any other text stops the run."""
    trimmed = F.trim(text)
    number = trimmed.try_cast("double")
    return F.when(text.isNull() | trimmed.isin(*MISSING), None).when(number.isNotNull(), number).otherwise(F.raise_error(F.concat(F.lit("not a number: "), text)).cast("double"))


def balance(exports: Column, imports: Column) -> Column:
    return exports - imports


def total(exports: Column, imports: Column) -> Column:
    return exports + imports


def rate(part: Column, whole: Column) -> Column:
    """Null unless both are there and the whole is positive."""
    return F.when(whole > 0, part / whole)


def yes_share(yes: Column, no: Column) -> Column:
    return F.when(yes + no > 0, yes / (yes + no))


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def clip_band(x: Column, top: int) -> Column:
    """Whole-number bands 0, 1, ..., the last one open."""
    return F.least(x, F.lit(top))


def band_of(x: Column, bounds: list[float]) -> Column:
    """How many of the rising bounds x reaches; null stays null."""
    return sum((F.when(x >= b, 1).otherwise(0) for b in bounds), F.when(x.isNotNull(), 0))


def signed_log(x: Column, scale: float = 100_000) -> Column:
    return F.asinh(x / scale)


def signed_log_inverse(y: Column, scale: float = 100_000) -> Column:
    return F.sinh(y) * scale


def nice_step(span: Column, steps: int = 5) -> Column:
    """The least of 1, 2, 2.5, 5 times a power of ten that covers span in that many steps."""
    raw = span / steps
    unit = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    return F.when(raw <= unit, unit).when(raw <= 2 * unit, 2 * unit).when(raw <= 2.5 * unit, 2.5 * unit).when(raw <= 5 * unit, 5 * unit).otherwise(10 * unit)


def nice_domain(low: Column, high: Column, steps: int = 5) -> Column:
    """(low, high, step): bounds at whole steps around two numbers, the step being nice_step() of their distance, or 1 if that is nothing."""
    step = F.when(high > low, nice_step(high - low, steps)).otherwise(F.lit(1.0))
    return F.when(low.isNotNull() & high.isNotNull(), F.struct((F.floor(low / step) * step).alias("low"), (F.ceil(high / step) * step).alias("high"), step.alias("step")))


def money_label(x: Column) -> Column:
    """$950, $12.3K, $1.2M, $4.5B."""
    size, sign = F.abs(x), F.when(x < 0, "-").otherwise("")
    short = lambda unit, letter: F.concat(F.format_string("%.1f", size / unit), F.lit(letter))
    body = F.when(size >= 1e9, short(1e9, "B")).when(size >= 1e6, short(1e6, "M")).when(size >= 1e3, short(1e3, "K")).otherwise(F.format_string("%.0f", size))
    return F.concat(sign, F.lit("$"), body)
