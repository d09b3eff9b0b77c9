"""Style filter expressions (JSON lists) compiled to columns."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

GEOMETRIES = {"Point": 1, "LineString": 2, "Polygon": 3}  # fixed values


def compile_filter(expression: str | list | None, properties: Mapping[str, Column], geometry: Column | None = None) -> Column:
    """A filter such as ["all", ["==", "class", "main"], [">", "rank", 2]] as a boolean column.

    A missing or null property makes != and !in true and every other comparison false. Numbers
    compare as doubles with anything that reads as one; unlike kinds compare false. $type
    compares `geometry` (1 point, 2 line, 3 polygon). None and the empty list accept all.
    """
    tree = json.loads(expression) if isinstance(expression, str) else expression
    if not tree:
        return F.lit(True)
    op, *args = tree
    if op in ("all", "any", "none"):
        parts = [compile_filter(a, properties, geometry) for a in args]
        if op == "all":
            return reduce(lambda a, b: a & b, parts, F.lit(True))
        some = reduce(lambda a, b: a | b, parts, F.lit(False))
        return ~some if op == "none" else some
    key, *values = args
    if key == "$type":
        held: Column | None = geometry
        values = [GEOMETRIES.get(v, v) for v in values]
    else:
        held = properties.get(key)
    negative = op in ("!=", "!in")
    if held is None:
        return F.lit(negative)
    compare: Callable[[Column, Column], Column] = {
        "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__,
    }.get(op, Column.__eq__)
    hits = [_compared(held, v, compare) for v in values]
    some = reduce(lambda a, b: a | b, hits, F.lit(False))
    return ~some if negative else some


def _compared(held: Column, value: object, compare: Callable[[Column, Column], Column]) -> Column:
    if isinstance(value, bool):
        hit = compare(held.cast("string"), F.lit(str(value).lower()))
    elif isinstance(value, int | float):
        hit = compare(held.cast("string").try_cast("double"), F.lit(float(value)))
    else:
        hit = compare(held.cast("string"), F.lit(value))
    return F.coalesce(hit, F.lit(False))
