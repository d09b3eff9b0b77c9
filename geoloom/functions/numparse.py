"""Numbers out of tag texts: first number, speeds, lengths, weights, typed values with defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_number(text: Column, *, signed: bool = False, dotted: bool = True) -> Column:
    """The first run of digits (and dots, if `dotted`), as text; null if there is none."""
    pattern = ("-?" if signed else "") + (r"[0-9][0-9.]*" if dotted else r"[0-9]+")
    found = F.regexp_extract(text, pattern, 0)
    return F.when(found != "", found)


def _value(text: Column) -> Column:
    return first_number(text).try_cast("double")


def speed_mps(text: Column, default: float) -> Column:
    """km/h or mph in metres a second; "none" is 40."""
    mps = _value(text) / 3.6 * F.when(F.contains(text, F.lit("mph")), 1.6).otherwise(1.0)
    return F.when(text == "none", 40.0).otherwise(F.coalesce(mps, F.lit(default)))


def length_m(text: Column, default: float) -> Column:
    """Metres, or feet (ft, ", or ' with inches after it)."""
    feet = F.contains(text, F.lit("ft")) | F.contains(text, F.lit('"')) | F.contains(text, F.lit("'"))
    value = _value(text) * F.when(feet, 0.3048).otherwise(1.0)
    inches = F.when(F.contains(text, F.lit("'")), _value(F.regexp_extract(text, "'(.*)$", 1)) * 0.0254)
    return F.coalesce(value + F.coalesce(inches, F.lit(0.0)), F.lit(default))


def weight_t(text: Column, default: float) -> Column:
    """Tonnes; lbs are converted."""
    return F.coalesce(_value(text) * F.when(F.contains(text, F.lit("lbs")), 0.4535 / 1000).otherwise(1.0), F.lit(default))


def as_int(text: Column, default: int) -> Column:
    return F.coalesce(first_number(text, signed=True, dotted=False).try_cast("int"), F.lit(default))


def as_long(text: Column, default: int) -> Column:
    return F.coalesce(first_number(text, signed=True, dotted=False).try_cast("long"), F.lit(default).cast("long"))


def as_uint(text: Column, default: int) -> Column:
    return F.coalesce(first_number(text, dotted=False).try_cast("long"), F.lit(default).cast("long"))


def as_double(text: Column, default: float) -> Column:
    return F.coalesce(first_number(text, signed=True).try_cast("double"), F.lit(float(default)))


def as_bool(text: Column, default: bool) -> Column:
    folded = F.lower(F.trim(text))
    return F.coalesce(F.when(folded.isin("true", "yes", "1"), True).when(folded.isin("false", "no", "0"), False), F.lit(default))


#: fixed values: hundredths of an inch in a unit
UNITS = {
    "CM": 39.37, "CENTIMETER": 39.37, "CENTIMETERS": 39.37, "METER": 3937.0, "METERS": 3937.0, "KM": 3937000.0,
    "KILOMETER": 3937000.0, "KILOMETERS": 3937000.0, "INCH": 100.0, "INCHES": 100.0, "FEET": 1200.0, "FOOT": 1200.0,
    "YARD": 3600.0, "YARDS": 3600.0, "MILE": 6336000.0, "MILES": 6336000.0,
}


def unit_factor(from_unit: str | float, to_unit: str | float) -> float:
    """What coordinates are multiplied by; units by name or as numbers."""
    size = lambda u: UNITS[u.upper()] if isinstance(u, str) else float(u)
    return size(from_unit) / size(to_unit)


def scale_and_shift(values: Column, factor: float, shift: float) -> Column:
    """Every coordinate of an array, scaled, then shifted."""
    return F.transform(values, lambda v: v * factor + shift)
