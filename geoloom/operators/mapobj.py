"""Map objects: box queries, predicates, generalisation levels, draw order, density, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.session import ranked


def box_intersects(min_x: int, min_y: int, max_x: int, max_y: int) -> Column:
    """B8. For columns minx, miny, maxx, maxy; range conditions that reach the Parquet scan."""
    return (F.col("minx") <= max_x) & (F.col("maxx") >= min_x) & (F.col("miny") <= max_y) & (F.col("maxy") >= min_y)


def map_query(objects: DataFrame, levels: DataFrame, box: tuple[int, int, int, int], zoom: int) -> DataFrame:
    """B9. Objects of the levels of a zoom that intersect a box; the level prunes partitions."""
    wanted = levels.where(F.lit(zoom).between(F.col("minzoom"), F.col("maxzoom"))).select("level")
    return objects.where(box_intersects(*box)).join(F.broadcast(wanted), "level", "left_semi")


def has_type(types: Column, rule_id: int) -> Column:
    """B11."""
    return F.array_contains(types, rule_id)


def is_closed(pts: Column, inner: Column | None = None) -> Column:
    """B12. First point = last, and so for all inner rings if given."""
    closed = lambda p: (F.size(p) > 1) & (F.element_at(p, 1) == F.element_at(p, -1))
    return closed(pts) if inner is None else closed(pts) & F.forall(inner, closed)


def common_types(one: Column, other: Column) -> Column:
    """G5. The additional types that two lines have in common when they are merged, in the first's order."""
    return F.array_intersect(one, other)


def with_coast(objects: DataFrame, coast: DataFrame) -> DataFrame:
    """G6. Map objects and the objects made of coast lines, by name; what one lacks is null there."""
    return objects.unionByName(coast, allowMissingColumns=True)


def layer_sign(add_types: Column, positive: list[int], negative: list[int]) -> Column:
    """B13. 1, -1 or 0 by the first additional type of either set."""
    either = F.array(*map(F.lit, positive + negative))
    first = F.get(F.filter(add_types, lambda t: F.array_contains(either, t)), F.lit(0))
    return F.when(first.isin(*positive), 1).when(first.isin(*negative), -1).otherwise(0)


def is_small_area(pts: Column, zoom: int, min_px: int, max_px: int) -> Column:
    """B14. Points are structs (lat, lon): fewer than two, or a pixel box within the limits either way."""
    px = lambda v: F.floor(v * 256).cast("int")
    xs = F.transform(pts, lambda p: px(geo.tile_x(p["lon"], zoom)))
    ys = F.transform(pts, lambda p: px(geo.tile_y(p["lat"], zoom)))
    w, h = F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys)
    within = ((w <= min_px) & (h <= max_px)) | ((w <= max_px) & (h <= min_px))
    return F.coalesce((F.size(pts) < 2) | within, F.lit(True))


def ring_area_m2(pts: Column) -> Column:
    """I8. Area of a closed ring of structs (lat, lon), flat around its lower left corner."""
    lat0, lon0 = F.array_min(pts["lat"]), F.array_min(pts["lon"])
    plane = F.transform(
        pts, lambda p: F.struct(geo.distance_m(lat0, lon0, lat0, p["lon"]).alias("x"), geo.distance_m(lat0, lon0, p["lat"], lon0).alias("y"))
    )
    return F.abs(_shoelace(plane)) / 2


def ring_area31(pts: Column) -> Column:
    """I8. Area in 31-bit units of structs (x, y)."""
    plane = F.transform(pts, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    return F.abs(_shoelace(plane)) / 2


def ring_area_pixels(pts: Column, zoom: int) -> Column:
    """I8. Area in pixels of 256 a tile at a zoom, of structs (x, y) in 31-bit units."""
    return ring_area31(pts) * F.lit(2.0 ** (-2 * max(31 - (zoom + 8), 0)))


def _shoelace(plane: Column) -> Column:
    n = F.size(plane) - 1
    terms = F.zip_with(F.slice(plane, F.lit(1), n), F.slice(plane, F.lit(2), n), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.when(n >= 1, F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v)).otherwise(0.0)


def drawable_polygons(objects: DataFrame, zoom: int, least_pixels: float) -> DataFrame:
    """B15. Closed polygons over an area in pixels, with z = order + 1 / area. pts: structs (x, y)."""
    area = ring_area_pixels(F.col("pts"), zoom)
    sized = objects.where((F.size("pts") > 2) & is_closed(F.col("pts"))).withColumn("area_px", area)
    return sized.where(F.col("area_px") > least_pixels).withColumn("z", F.col("order") + F.try_divide(F.lit(1.0), F.col("area_px")))


def draw_order(primitives: DataFrame) -> DataFrame:
    """F4. By z, type index, number of vertices; the id makes it total."""
    return primitives.orderBy("z", "type_index", "n_points", "id")


def draw_ranks(primitives: DataFrame) -> DataFrame:
    """F4. Adds n, the place in draw order from 1."""
    return ranked(primitives, "z", "type_index", "n_points", "id")


def thin_by_density(lines: DataFrame, zoom: int, delta: int, most: int) -> DataFrame:
    """D13. Ids of the lines that win a tile: at most `most` in each tile of zoom + delta, those
    drawn last first. lines: id, z, pts of structs (x, y)."""
    tile = lambda p: geo.tile_key(geo.tile_of_x31(p["x"], zoom + delta), geo.tile_of_x31(p["y"], zoom + delta), zoom + delta)
    visits = lines.select("id", "z", F.explode(F.array_distinct(F.transform("pts", tile))).alias("tile"))
    rank = F.row_number().over(Window.partitionBy("tile").orderBy(F.desc("z"), F.desc("id")))
    return visits.withColumn("n", rank).where(F.col("n") <= most).select("id").distinct()


def label_points(objects: DataFrame) -> DataFrame:
    """I19. (id, lat, lon): centroid of polygons, middle vertex of lines, the point itself.
    objects: id, kind (point, line, polygon), pts of structs (lat, lon)."""
    n = F.size("pts")
    mean = lambda c: F.try_divide(F.aggregate("pts", F.lit(0.0), lambda acc, p: acc + p[c]), n)
    middle = F.get(F.col("pts"), (n / 2).cast("int"))
    pick = lambda c: F.when(F.col("kind") == "line", middle[c]).otherwise(mean(c))
    return objects.select("id", pick("lat").alias("lat"), pick("lon").alias("lon"))


def viewport_tiles(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """I20, F7. Tiles of a viewport (fractional tile coordinates) nearest to its centre first, by
    |dx| + |dy|: array of structs (d, x, y)."""
    cx, cy = (min_x + max_x) / 2, (min_y + max_y) / 2
    tiles = geo.covering_tiles(min_x, min_y, max_x, max_y)
    return F.array_sort(F.transform(tiles, lambda t: F.struct((F.abs(t["x"] + 0.5 - cx) + F.abs(t["y"] + 0.5 - cy)).alias("d"), t["x"].alias("x"), t["y"].alias("y"))))


def quad_key(min_x: Column, min_y: Column, max_x: Column, max_y: Column, depth: int = 16) -> Column:
    """I16. struct(zoom, x, y): the deepest tile that holds the whole box (31-bit coordinates)."""
    levels = F.sequence(F.lit(depth), F.lit(0), F.lit(-1))
    shift = lambda v, z: F.call_function("shiftright", v, F.lit(31) - z)
    tiles = F.transform(levels, lambda z: F.struct(z.alias("zoom"), shift(min_x, z).alias("x"), shift(min_y, z).alias("y"), ((shift(min_x, z) == shift(max_x, z)) & (shift(min_y, z) == shift(max_y, z))).alias("fits")))
    best = F.get(F.filter(tiles, lambda t: t["fits"]), F.lit(0))
    return F.struct(best["zoom"].alias("zoom"), best["x"].alias("x"), best["y"].alias("y"))


QUAD_DEPTH = 15


def with_quad(objects: DataFrame, depth: int = QUAD_DEPTH) -> DataFrame:
    """I16. Adds quad_zoom and quad_code: the deepest tile (`depth` at most) that holds an object's box,
    and its first cell of zoom `depth` in Morton order. An object without a box has nulls."""
    k = quad_key(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"), depth)
    up = F.lit(depth) - k["zoom"]
    code = geo.morton(F.call_function("shiftleft", k["x"], up), F.call_function("shiftleft", k["y"], up))
    return objects.withColumn("quad_zoom", k["zoom"]).withColumn("quad_code", code)


def write_quad_map(objects: DataFrame, path: str, depth: int = QUAD_DEPTH, **options: object) -> None:
    """I16. Parquet in the order of quad keys, so that a box query reads few row groups."""
    keyed = with_quad(objects, depth)
    keyed.repartitionByRange("quad_code", "quad_zoom").sortWithinPartitions("quad_code", "quad_zoom").write.options(**options).parquet(path)


def quad_intervals(box: tuple[int, int, int, int], depth: int = QUAD_DEPTH, most: int = 32) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The tiles that meet a box: (zoom, code) of those that hold more than the box's parts, and about
    `most` Morton intervals (first and last code) that hold all others."""

    def code(x: int, y: int) -> int:
        return sum(((x >> i & 1) << 2 * i + 1) | ((y >> i & 1) << 2 * i) for i in range(depth))

    def meets(z: int, x: int, y: int) -> tuple[bool, bool]:
        x0, y0, side = x << 31 - z, y << 31 - z, 1 << 31 - z
        x1, y1 = x0 + side - 1, y0 + side - 1
        return x0 <= box[2] and x1 >= box[0] and y0 <= box[3] and y1 >= box[1], x0 >= box[0] and x1 <= box[2] and y0 >= box[1] and y1 <= box[3]

    above, whole, part = [], [], [(0, 0, 0)]
    while part and part[0][0] < depth and len(whole) + 4 * len(part) <= max(most, 4):
        above += part
        inner = [(z + 1, 2 * x + i, 2 * y + j) for z, x, y in part for i in (0, 1) for j in (0, 1)]
        part = []
        for tile in inner:
            hit, held = meets(*tile)
            if hit:
                (whole if held else part).append(tile)
    ends = sorted((code(x << depth - z, y << depth - z), code(x << depth - z, y << depth - z) + 4 ** (depth - z) - 1) for z, x, y in whole + part)
    merged: list[tuple[int, int]] = []
    for lo, hi in ends:
        if merged and lo <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], hi)
        else:
            merged.append((lo, hi))
    return [(z, code(x << depth - z, y << depth - z)) for z, x, y in above], merged


def quad_query(objects: DataFrame, box: tuple[int, int, int, int], depth: int = QUAD_DEPTH) -> DataFrame:
    """I16. The objects (with_quad) whose box meets a box: a few ranges of quad_code, which reach the
    Parquet scan, then the exact test."""
    above, intervals = quad_intervals(box, depth)
    hit = F.lit(False)
    for lo, hi in intervals:
        hit = hit | F.col("quad_code").between(lo, hi)
    for z, c in above:
        hit = hit | ((F.col("quad_code") == c) & (F.col("quad_zoom") == z))
    return objects.where(hit).where(box_intersects(*box))


def write_map(objects: DataFrame, path: str, zoom: int = 12) -> None:
    """A14. Parquet by level, in Morton order of the object's tile, so that row groups are small boxes."""
    tile = geo.morton(geo.tile_of_x31(F.col("minx"), zoom), geo.tile_of_x31(F.col("miny"), zoom))
    placed = objects.withColumn("morton", tile)
    placed.repartitionByRange("level", "morton").sortWithinPartitions("level", "morton").drop("morton").write.partitionBy("level").parquet(path)


def write_staging(tables: dict[str, tuple[DataFrame, list[str], str]], path: str, buckets: int, prefix: str = "staged") -> dict[str, DataFrame]:
    """A7. Tables under `path` in the catalogue, bucketed and sorted by a column, so that joins on it
    (C1, C3, C25) read them without a shuffle. tables: name -> (rows, key, the column); rows are unique
    by key. Returns the tables as they are read back; a table of that name is replaced."""
    out = {}
    for name, (df, key, by) in tables.items():
        spark, full = df.sparkSession, f"{prefix}_{name}"
        unique = df.dropDuplicates(key).repartition(buckets, by)
        unique.write.bucketBy(buckets, by).sortBy(by).mode("overwrite").option("path", f"{path}/{name}").saveAsTable(full)
        out[name] = spark.table(full)
    return out


def write_tables(tables: dict[str, tuple[DataFrame, list[str]]], path: str) -> None:
    """A7, A8. Each table as Parquet under `path`, its rows unique by key."""
    for name, (df, key) in tables.items():
        df.dropDuplicates(key).write.parquet(f"{path}/{name}")
