"""Web-mercator, tile and distance arithmetic as column expressions.

Coordinates: degrees (double), or "x31/y31", the mercator square scaled to 2**31 (long).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
EARTH_KM = 6372.8
EARTH_KM_ATAN2 = 6371.0
EQUATOR_M = 40075017.0
MAX_LATITUDE = 85.0511
METERS_X31 = 0.011
METERS_Y31 = 0.01863
SEMI_MAJOR_M = 6378137
SEMI_MINOR_M = 6356752

Number = Column | float | int


def _c(v: Number) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def pow_zoom(zoom: Number) -> Column:
    return F.pow(F.lit(2.0), _c(zoom))


def _shift_right(v: Column, by: Number) -> Column:
    return F.call_function("shiftright", v, _c(by).cast("int"))


def _shift_left(v: Column, by: Number) -> Column:
    return F.call_function("shiftleft", v, _c(by).cast("int"))


def _haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    d_lat, d_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    return F.pow(F.sin(d_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(d_lon), 2)


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance in metres, radius 6372.8 km."""
    return 2 * F.lit(EARTH_KM) * 1000 * F.asin(F.sqrt(_haversine(lat1, lon1, lat2, lon2)))


def distance_atan2_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The second variant: radius 6371 km, by atan2."""
    a = _haversine(lat1, lon1, lat2, lon2)
    return 2 * F.lit(EARTH_KM_ATAN2) * 1000 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def rounded(name: str, digits: int) -> Column:
    """round() of a double column without a decimal for each value: only what lies close to the middle of
    two results, or is large, goes that way."""
    up = F.col(name) * 10**digits
    middle = F.abs(up - F.floor(up) - 0.5) < 1e-3
    return F.when(~middle & (F.abs(up) < 2**40), F.floor(up + 0.5) / 10**digits).otherwise(F.round(name, digits))


def wrap_longitude(lon: Column) -> Column:
    return F.when(lon.between(-180, 180), lon).otherwise(F.pmod(lon + 180, F.lit(360.0)) - 180)


def clamp_latitude(lat: Column) -> Column:
    """Wrapped into -90..90, then clamped to the mercator square."""
    turned = F.when(lat.between(-90, 90), lat).otherwise(F.pmod(lat + 90, F.lit(180.0)) - 90)
    return F.greatest(F.lit(-MAX_LATITUDE), F.least(F.lit(MAX_LATITUDE), turned))


def _mercator(lat: Column) -> Column:
    rad = F.radians(clamp_latitude(lat))
    return (1 - F.ln(F.tan(rad) + 1 / F.cos(rad)) / math.pi) / 2


def x31(lon: Column) -> Column:
    return ((wrap_longitude(lon) + 180) / 360 * F.lit(2.0**31)).cast("long")


def y31(lat: Column) -> Column:
    return (_mercator(lat) * F.lit(2.0**31)).cast("long")


def longitude31(x: Column) -> Column:
    """Longitude of an x31, through zoom 21 (whole units of 1024)."""
    return tile_longitude(_shift_right(x, 10), 21)


def latitude31(y: Column) -> Column:
    return tile_latitude(_shift_right(y, 10), 21)


def tile_x(lon: Column, zoom: Number) -> Column:
    """Fractional tile column; the antimeridian from the west is the last column."""
    return F.when(lon == 180, pow_zoom(zoom) - 1).otherwise((wrap_longitude(lon) + 180) / 360 * pow_zoom(zoom))


def tile_y(lat: Column, zoom: Number) -> Column:
    return _mercator(lat) * pow_zoom(zoom)


def tile_longitude(x: Column, zoom: Number) -> Column:
    return x / pow_zoom(zoom) * 360 - 180


def tile_latitude(y: Column, zoom: Number) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / pow_zoom(zoom)))))


def tile_of_x31(v: Column, zoom: Number) -> Column:
    """Tile column or row of a 31-bit coordinate."""
    return _shift_right(v, 31 - zoom if not isinstance(zoom, Column) else F.lit(31) - zoom)


def tile_key(x: Column, y: Column, zoom: Number) -> Column:
    """One long for a tile of a zoom level."""
    return _shift_left(x.cast("long"), zoom) + y


def tile_box31(x: Column, y: Column, zoom: int) -> list[Column]:
    """min x, min y, max x, max y (inclusive) of a tile, as columns of those names."""
    shift = 31 - zoom
    return [
        _shift_left(x.cast("long"), shift).alias("min_x"),
        _shift_left(y.cast("long"), shift).alias("min_y"),
        (_shift_left(x.cast("long") + 1, shift) - 1).alias("max_x"),
        (_shift_left(y.cast("long") + 1, shift) - 1).alias("max_y"),
    ]


def ellipsoid_tile_y(lat: Column, zoom: Number) -> Column:
    """Tile row on the ellipsoid."""
    j = math.sqrt(SEMI_MAJOR_M**2 - SEMI_MINOR_M**2) / SEMI_MAJOR_M
    s = F.sin(F.radians(lat))
    m = F.ln((1 + s) / (1 - s)) / 2 - j * F.ln((1 + j * s) / (1 - j * s)) / 2
    return pow_zoom(zoom) * (0.5 - m / (2 * math.pi))


def ellipsoid_latitude(y: Column, zoom: Number, steps: int = 10) -> Column:
    """Inverse of `ellipsoid_tile_y`: a fixed number of fixed-point steps, folded over a
    sequence so that the expression doesn't double with each; each shrinks the error 150 times."""
    e = math.sqrt(SEMI_MAJOR_M**2 - SEMI_MINOR_M**2) / SEMI_MAJOR_M
    m = (0.5 - y / pow_zoom(zoom)) * 2 * math.pi
    start = 2 * F.atan(F.exp(m)) - math.pi / 2

    def step(phi: Column, _: Column) -> Column:
        ratio = F.pow((1 + e * F.sin(phi)) / (1 - e * F.sin(phi)), F.lit(e / 2))
        return 2 * F.atan(F.exp(m) * ratio) - math.pi / 2

    return F.degrees(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step))


def _spread(v: Column) -> Column:
    """A 0 bit after each of the low 32 bits."""
    v = v.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    for shift, mask in (
        (16, 0x0000FFFF0000FFFF),
        (8, 0x00FF00FF00FF00FF),
        (4, 0x0F0F0F0F0F0F0F0F),
        (2, 0x3333333333333333),
        (1, 0x5555555555555555),
    ):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton(x: Column, y: Column) -> Column:
    """Bits of two 32-bit numbers in turn, x first: a 64-bit key that keeps near tiles near."""
    return F.shiftleft(_spread(x), 1).bitwiseOR(_spread(y))


#: fixed value: the 64 signs of short location codes
SHORT_SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_@"


def short_code(lat: Column, lon: Column, zoom: int) -> Column:
    """Short location code: three zoom levels a sign, '-' for each level short of a whole sign."""
    code = morton(((lon + 180) / 360 * F.lit(2.0**32)).cast("long"), ((lat + 90) / 180 * F.lit(2.0**32)).cast("long"))
    signs = -(-(zoom + 8) // 3)

    def text(c: Column) -> Column:
        sign = lambda i: F.shiftrightunsigned(c, 58 - 6 * i).bitwiseAND(F.lit(63)).cast("int") + 1
        return F.concat(*(F.substring(F.lit(SHORT_SIGNS), sign(i), F.lit(1)) for i in range(signs)), F.lit("-" * ((zoom + 8) % 3)))

    return F.transform(F.array(code), text)[0]  # the code is evaluated once


def short_code_position(code: Column) -> Column:
    """struct(lat, lon) of a short location code."""
    signs = F.filter(F.split(code, ""), lambda c: (c != "-") & (c != ""))
    values = F.transform(signs, lambda c: F.instr(F.lit(SHORT_SIGNS), c).cast("long") - 1)
    bit = lambda v, k: F.shiftright(v, k).bitwiseAND(F.lit(1))
    three = lambda v, a, b, c: bit(v, a) * 4 + bit(v, b) * 2 + bit(v, c)
    x = F.aggregate(values, F.lit(0).cast("long"), lambda acc, v: acc * 8 + three(v, 5, 3, 1))
    y = F.aggregate(values, F.lit(0).cast("long"), lambda acc, v: acc * 8 + three(v, 4, 2, 0))
    units = F.pow(F.lit(8.0), F.size(signs))
    return F.struct((180 * y / units - 90).alias("lat"), (360 * x / units - 180).alias("lon"))


def meters_x31(dx: Column) -> Column:
    return dx * METERS_X31


def meters_y31(dy: Column) -> Column:
    return dy * METERS_Y31


def distance31_m(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt(F.pow(meters_x31(x1 - x2), 2) + F.pow(meters_y31(y1 - y2), 2))


def projection31(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """struct(x, y): the point of segment a-b nearest to p, measured in metres."""
    along = meters_x31(bx - ax) * meters_x31(px - ax) + meters_y31(by - ay) * meters_y31(py - ay)
    whole = F.pow(meters_x31(bx - ax), 2) + F.pow(meters_y31(by - ay), 2)
    share = F.when(along < 0, 0.0).when(along >= whole, 1.0).otherwise(F.try_divide(along, whole))
    return F.struct(
        F.when(share == 1, bx).otherwise((ax + (bx - ax) * share).cast("long")).alias("x"),
        F.when(share == 1, by).otherwise((ay + (by - ay) * share).cast("long")).alias("y"),
    )


def projection(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """struct(lat, lon): the nearest point of a segment, flat in degrees (good below a kilometre)."""
    whole = F.pow(lat1 - lat2, 2) + F.pow(lon1 - lon2, 2)
    along = (lat2 - lat1) * (lat - lat1) + (lon2 - lon1) * (lon - lon1)
    share = F.when(along < 0, 0.0).when(along >= whole, 1.0).otherwise(F.try_divide(along, whole))
    return F.struct((lat1 + (lat2 - lat1) * share).alias("lat"), (lon1 + (lon2 - lon1) * share).alias("lon"))


def orthogonal_distance_m(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p = projection(lat, lon, lat1, lon1, lat2, lon2)
    return distance_m(p["lat"], p["lon"], lat, lon)


def _turned(v: Column, turn: float, half: float) -> Column:
    """v modulo a turn, in (-half, half]."""
    return half - F.pmod(half - v, F.lit(turn))


def degrees_diff(a: Column, b: Column) -> Column:
    return _turned(a - b, 360.0, 180.0)


def align_angle(diff: Column) -> Column:
    return _turned(diff, 2 * math.pi, math.pi)


def rotation_diff(rotate: Column, target: Column) -> Column:
    """target - rotate in [-180, 180)."""
    return F.pmod(target - rotate + 180, F.lit(360.0)) - 180


def rotation_to_360(rotate: Column) -> Column:
    return F.when(rotate.between(-180, 180), rotate).when(rotate > 180, _turned(rotate, 360.0, 180.0)).otherwise(
        F.pmod(rotate + 180, F.lit(360.0)) - 180
    )


def meters_per_tile_unit(y: Column, zoom: Number, units: float) -> Column:
    s = F.sinh(2 * math.pi * y / pow_zoom(zoom) - math.pi)
    return F.lit(EQUATOR_M) / (pow_zoom(zoom) * units * F.sqrt(s * s + 1))


def normalize_tile(v: Column, zoom: int) -> Column:
    """A tile column or row wrapped into the level's range; zoom 31 is only lifted above zero."""
    n = F.lit(1 << zoom).cast("long")
    return F.pmod(v.cast("long"), n) if zoom < 31 else F.when(v < 0, F.pmod(v.cast("long"), n)).otherwise(v.cast("long"))


def pixel_shift_x(lon1: Column, lon2: Column, zoom: Number, tile_size: int) -> Column:
    return ((tile_x(lon1, zoom) - tile_x(lon2, zoom)) * tile_size).cast("int")


def pixel_shift_y(lat1: Column, lat2: Column, zoom: Number, tile_size: int) -> Column:
    return ((tile_y(lat1, zoom) - tile_y(lat2, zoom)) * tile_size).cast("int")


def rotated_pixels(dx: Column, dy: Column, degrees: Column, tile_size: int) -> Column:
    """struct(x, y): a tile offset turned by an angle, in pixels."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return F.struct(((c * dx - s * dy) * tile_size).alias("x"), ((s * dx + c * dy) * tile_size).alias("y"))


#: fixed values: bits of an out-code
LEFT, RIGHT, BOTTOM, TOP = 1, 2, 4, 8


def out_code(x: Column, y: Column, min_x: Number, min_y: Number, max_x: Number, max_y: Number) -> Column:
    side = F.when(x < min_x, LEFT).when(x > max_x, RIGHT).otherwise(0)
    end = F.when(y < min_y, BOTTOM).when(y > max_y, TOP).otherwise(0)
    return side.bitwiseOR(end)


def generated_id(base: Column, level: Column, is_way: Column) -> Column:
    """((base * 8 + level) * 2), odd for ways."""
    return F.shiftleft(F.shiftleft(base.cast("long"), 3).bitwiseOR(level.cast("long")), 1).bitwiseOR(is_way.cast("long"))


def base_id(generated: Column) -> Column:
    """The base and way bit back: base * 2 + way."""
    return F.shiftleft(F.shiftright(generated, 4), 1).bitwiseOR(generated.bitwiseAND(F.lit(1)))


def tile_parent(v: Column, levels: int = 1) -> Column:
    return F.shiftright(v, levels)


def tile_children(x: Column, y: Column) -> Column:
    """Array of the four structs (x, y) one level down."""
    return F.array(*(F.struct((x * 2 + i).alias("x"), (y * 2 + j).alias("y")) for j in (0, 1) for i in (0, 1)))


def is_child_of(x: Column, y: Column, zoom: Column, px: Column, py: Column, p_zoom: Column) -> Column:
    up = zoom - p_zoom
    return (up >= 0) & (_shift_right(x, up) == px) & (_shift_right(y, up) == py)


def covering_tiles(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """Array of structs (x, y): the tiles of a box of fractional tile coordinates."""
    xs = F.sequence(F.floor(min_x), F.floor(max_x))
    ys = F.sequence(F.floor(min_y), F.floor(max_y))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def stops_value(zoom: Column, stops: list[tuple[float, float]], base: float = 1.0) -> Column:
    """A zoom function: clamped outside its stops, between them linear or exponential in `base`."""
    out = F.lit(float(stops[-1][1]))
    for (z0, v0), (z1, v1) in reversed(list(zip(stops[:-1], stops[1:], strict=True))):
        if base == 1.0:
            share = (zoom - z0) / (z1 - z0)
        else:
            share = (F.pow(F.lit(float(base)), zoom - z0) - 1) / (base ** (z1 - z0) - 1)
        out = F.when(zoom < z1, v0 + share * (v1 - v0)).otherwise(out)
    return F.when(zoom <= stops[0][0], F.lit(float(stops[0][1]))).otherwise(out)


def ccw(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return (cy - ay) * (bx - ax) > (by - ay) * (cx - ax)


def segments_cross(a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column], d: tuple[Column, Column]) -> Column:
    """Whether segments a-b and c-d cross (touching ends excluded, as the turn test has it)."""
    return (ccw(*a, *c, *d) != ccw(*b, *c, *d)) & (ccw(*a, *b, *c) != ccw(*a, *b, *d))


def parse_zooms(spec: str, highest: int = 22) -> list[tuple[int, int, int]]:
    """(level, min zoom, max zoom) of a range list such as "11;12;13-14;15-", most detailed first."""
    levels = []
    for part in (p.strip() for p in spec.split(";") if p.strip()):
        low, dash, high = part.partition("-")
        levels.append((int(low), int(high) if high else highest if dash else int(low)))
    if not 1 <= len(levels) <= 8:
        raise ValueError("a zoom list has one to eight ranges")
    return [(i, low, high) for i, (low, high) in enumerate(reversed(levels))]
