"""Places and boundaries: extraction, containment, nearest candidates, city matching.

Spatial joins go over tile keys: a polygon's box is covered with tiles, points carry the tile
they are in, and the equi-join is refined by the exact test.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from geoloom.functions.geo import EARTH_KM, covering_tiles, distance_m, tile_latitude, tile_x, tile_y
from geoloom.operators import nearby
from geoloom.session import bounded, cut_lineage, in_parts

#: fixed values: radius in metres by kind of place, 400 for other kinds
RADIUS_M = {"city": 10000.0, "town": 5000.0, "village": 1300.0, "hamlet": 1000.0}
CITY_KINDS, TOWN_KINDS = ("CITY", "TOWN"), ("VILLAGE", "HAMLET", "SUBURB", "DISTRICT")
CITY_ZOOM, TOWN_ZOOM = 10, 13
LEAST_LEVEL = 7  # of a boundary for a city without one of its own


def extract_places(nodes: DataFrame) -> DataFrame:
    """B4. (id, name, lat, lon, kind, grid city or town): kinds upper-cased, capitals are cities,
    other kinds dropped. nodes: id, name, place, capital boolean, lat, lon."""
    kind = F.when(F.col("capital"), "CITY").otherwise(F.upper("place"))
    grid = F.when(kind.isin(*CITY_KINDS), "city").when(kind.isin(*TOWN_KINDS), "town")
    known = F.upper("place").isin(*CITY_KINDS, *TOWN_KINDS)
    return nodes.where(known).select("id", "name", "lat", "lon", kind.alias("kind"), grid.alias("grid"))


def radius_m(kind: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in RADIUS_M.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(kind)), F.lit(400.0))


def point_tile(df: DataFrame, zoom: int, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.withColumn("tx", F.floor(tile_x(F.col(lon), zoom))).withColumn("ty", F.floor(tile_y(F.col(lat), zoom)))


def box_tiles(df: DataFrame, zoom: int) -> DataFrame:
    """One row for each tile of min_lat, min_lon, max_lat, max_lon."""
    z = zoom
    tiles = covering_tiles(tile_x(F.col("min_lon"), z), tile_y(F.col("max_lat"), z), tile_x(F.col("max_lon"), z), tile_y(F.col("min_lat"), z))
    return df.withColumn("__tile", F.explode(tiles)).withColumn("tx", F.col("__tile.x")).withColumn("ty", F.col("__tile.y")).drop("__tile")


def in_ring(ring: Column, lat: Column, lon: Column) -> Column:
    """I7. Ray casting parity over all edges of a closed ring (array of structs lat, lon)."""
    nxt = F.slice(ring, F.lit(2), F.size(ring) - 1)
    crossed = F.zip_with(
        F.slice(ring, F.lit(1), F.size(ring) - 1),
        nxt,
        lambda a, b: F.when(
            ((a["lat"] > lat) != (b["lat"] > lat)) & (lon < a["lon"] + F.try_divide((lat - a["lat"]) * (b["lon"] - a["lon"]), b["lat"] - a["lat"])), 1
        ).otherwise(0),
    )
    return F.aggregate(crossed, F.lit(0), lambda acc, v: acc + v) % 2 == 1


def in_polygon(outer: Column, inner: Column, lat: Column, lon: Column) -> Column:
    """Inside some outer ring and no inner one (arrays of rings)."""
    return F.exists(outer, lambda r: in_ring(r, lat, lon)) & ~F.exists(inner, lambda r: in_ring(r, lat, lon))


def box_ring(min_lat: Column, min_lon: Column, max_lat: Column, max_lon: Column) -> Column:
    point = lambda a, b: F.struct(a.alias("lat"), b.alias("lon"))
    return F.array(point(min_lat, min_lon), point(min_lat, max_lon), point(max_lat, max_lon), point(max_lat, min_lon), point(min_lat, min_lon))


def points_in_boxes(points: DataFrame, boxes: DataFrame, zoom: int = TOWN_ZOOM) -> DataFrame:
    """Points with the boxes they are in (edges included): columns of both, boxes' as b_*."""
    b = box_tiles(boxes, zoom)
    b = b.select("tx", "ty", *(F.col(c).alias(f"b_{c}") for c in boxes.columns))
    joined = point_tile(points, zoom).join(b, ["tx", "ty"])
    return joined.where(
        F.col("lat").between(F.col("b_min_lat"), F.col("b_max_lat")) & F.col("lon").between(F.col("b_min_lon"), F.col("b_max_lon"))
    ).drop("tx", "ty")


def points_in_polygons(points: DataFrame, polygons: DataFrame, zoom: int = TOWN_ZOOM) -> DataFrame:
    """C8. (point columns, b_id, ...): polygons have outer, inner and the four box columns."""
    return points_in_boxes(points, polygons, zoom).where(in_polygon(F.col("b_outer"), F.col("b_inner"), F.col("lat"), F.col("lon")))


#: what candidates of one point have in common, and by what `closest_candidates` leaves them dealt
GROUP = ("tx", "ty", "deal")
GROUP_POINTS, MOST_POINTS = 500, 4_000  # of a group; as many as leave 32 groups to a core
AROUND_ROWS = 300_000  # objects, and pairs of tiles, up to which all tasks have them


def _occupied_around(tiles: DataFrame, occupied: DataFrame, zoom: int, step: int) -> DataFrame:
    """(tx, ty, ox, oy, ring): the occupied tiles (ox, oy) within ring distance `step` of each of `tiles`,
    doubled until there are some. Rounds work on the tiles that are left, at a coarser tile for wider rings."""
    found: list[DataFrame] = []
    rest, some = tiles, not occupied.isEmpty()
    for k in range(zoom + 1):
        reach = step * 2**k
        coarse = lambda c: F.shiftright(c, k)  # noqa: B023, E731
        steps = F.sequence(F.lit(-step - 1), F.lit(step + 1))
        spread = occupied.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps))
        spread = spread.withColumn("kx", coarse(F.col("ox")) + F.col("dx")).withColumn("ky", coarse(F.col("oy")) + F.col("dy"))
        keyed = rest.withColumn("kx", coarse(F.col("tx"))).withColumn("ky", coarse(F.col("ty")))
        hit = keyed.join(spread, ["kx", "ky"]).where((F.abs(F.col("ox") - F.col("tx")) <= reach) & (F.abs(F.col("oy") - F.col("ty")) <= reach))
        hit = cut_lineage(hit.select("tx", "ty", "ox", "oy", F.lit(reach).alias("ring")))
        found.append(hit)
        if not some or reach >= 2**zoom:
            break
        rest = cut_lineage(rest.join(hit.select("tx", "ty").distinct(), ["tx", "ty"], "left_anti"))
        if rest.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def closest_candidates(
    points: DataFrame, objects: DataFrame, zoom: int, step: int = 3, of_points: tuple[str, ...] = (), of_objects: tuple[str, ...] = (), nested: bool = False
) -> DataFrame:
    """C11. For each point all objects in the tiles within ring distance `step`, doubled until
    there are some: (p_id, o_id, lat, lon, o_lat, o_lon, ring), the columns `of_points` and `of_objects`,
    and GROUP.

    points and objects: id, lat, lon. What tiles belong together is found on the tiles alone; the last
    ring covers the whole grid, so only without any object are there no rows. The points of a tile are
    dealt into groups, each of which meets the objects around its tile once: the candidates are only
    made, neither written nor shuffled, and windows over GROUP and p_id find them dealt already. Where
    an id stands for several points, it takes the smallest ring of them all, and GROUP is left out.

    nested: the same as rows (one, ring, parts), where parts are arrays of pts (p_id, lat, lon, `of_points`) and
    objs (o_id, o_lat, o_lon, `of_objects`), all of which are each other's candidates; with one, all
    points of the row have the same id, or none, and their candidates belong together.
    """
    place = lambda df, p, lat, lon, keep: point_tile(df.select(F.col("id").alias(p), F.col("lat").alias(lat), F.col("lon").alias(lon), *keep), zoom, lat, lon)
    placed = place(points, "p_id", "lat", "lon", of_points)
    offered = place(objects, "o_id", "o_lat", "o_lon", of_objects).withColumnsRenamed({"tx": "ox", "ty": "oy"})
    ids = placed.agg(F.count("*").alias("all"), F.count("p_id").alias("n"), F.count_distinct("p_id").alias("known")).first()
    cores = points.sparkSession.sparkContext.defaultParallelism
    size = min(MOST_POINTS, max(GROUP_POINTS, ids["all"] // (32 * cores)))
    tiles = placed.where("tx IS NOT NULL AND ty IS NOT NULL").groupBy("tx", "ty")
    tiles = cut_lineage(tiles.agg(F.ceil(F.count("*") / size).cast("int").alias("deals")))
    around = _occupied_around(tiles.select("tx", "ty"), cut_lineage(offered.select("ox", "oy").distinct()), zoom, step)
    tiles = tiles.join(around.select("tx", "ty", "ring").distinct(), ["tx", "ty"])
    unique = ids["n"] == ids["known"]
    at = placed.join(bounded(tiles), ["tx", "ty"]).withColumn("deal", F.pmod(F.xxhash64("p_id"), F.col("deals")).cast("int")).drop("deals")
    if not unique:
        at = at.withColumn("least", F.min("ring").over(Window.partitionBy("p_id"))).where("ring = least").drop("least")
    groups = tiles.agg(F.coalesce(F.sum("deals"), F.lit(0))).first()[0]
    n = max(cores, min(groups, 20_000))
    few = all(df.limit(AROUND_ROWS + 1).count() <= AROUND_ROWS for df in (offered, around))
    if not nested:
        if few:
            out = at.repartition(n, *GROUP).join(F.broadcast(around.drop("ring")), ["tx", "ty"]).join(F.broadcast(offered), ["ox", "oy"])
        else:
            near = around.drop("ring").join(tiles.select("tx", "ty", "deals"), ["tx", "ty"]).join(offered, ["ox", "oy"])
            near = near.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).drop("ox", "oy", "deals")
            out = at.repartition(n, *GROUP).join(near.repartition(n, *GROUP), list(GROUP))
        return out.select("p_id", "o_id", "lat", "lon", "o_lat", "o_lon", "ring", *of_points, *of_objects, *(GROUP if unique else ()))

    lists = offered.groupBy("ox", "oy").agg(F.collect_list(F.struct("o_id", "o_lat", "o_lon", *of_objects)).alias("objs"))
    wide = (lambda df: F.broadcast(df)) if few else (lambda df: df)

    def held(at: DataFrame, *key: str) -> DataFrame:
        """The points of a group, and of a key, in one row with all that is around them."""
        blocks = at.repartition(n, *GROUP).groupBy(*GROUP, "ring", *key).agg(F.collect_list(F.struct("p_id", "lat", "lon", *of_points)).alias("pts"))
        own = blocks.select(*GROUP).distinct().join(wide(around.drop("ring")), ["tx", "ty"]).join(wide(lists), ["ox", "oy"])
        own = own.groupBy(*GROUP).agg(F.flatten(F.collect_list("objs")).alias("objs"))
        return blocks.join(own if few else own.repartition(n, *GROUP), list(GROUP))

    alone = lambda at: held(at).select(F.lit(False).alias("one"), "ring", F.array(F.struct("pts", "objs")).alias("parts"))
    if ids["all"] == ids["known"]:
        return alone(at)
    often = placed.groupBy("p_id").agg(F.count("*").alias("times")).where("times > 1 OR p_id IS NULL").select(F.col("p_id").alias("again"))
    same = F.col("p_id").eqNullSafe(F.col("again"))
    whole = held(at.join(often, same, "left_semi"), "p_id").groupBy("p_id", "ring", *(GROUP if unique else ())).agg(F.collect_list(F.struct("pts", "objs")).alias("parts"))
    return alone(at.join(often, same, "left_anti")).union(whole.select(F.lit(True), "ring", "parts"))


def candidate_pairs(candidates: DataFrame) -> DataFrame:
    """C11. (p_id, o_id, ring) of nested candidates, one object of a group after the other."""
    return nearby.pairs(candidates)


def nearest(candidates: DataFrame) -> DataFrame:
    """F8. Of each point's candidates the nearest: (p_id, o_id, m)."""
    m = distance_m(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon"))
    return candidates.withColumn("m", m).groupBy("p_id").agg(F.min_by("o_id", F.struct("m", "o_id")).alias("o_id"), F.min("m").alias("m"))


NEAREST_POINTS = 100_000  # points of a task


def nearest_object(points: DataFrame, objects: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """F8 over all objects. The nearest one of each point: (p_id, o_id, m), the smaller id of equals.

    points and objects: id, lat, lon, and the columns `by`, which come with the rows: a point looks among
    the objects that have the same there. A round looks in the 3 x 3 tiles around each point that is
    left, starting where a tile holds about one object. A point is done once its nearest is nearer
    than anything outside these tiles can be; the others go on to tiles of twice the width, at
    last to the whole globe. Points are dealt once; the objects, the smaller side, are repeated for the
    tiles around them and listed by tile, so a point isn't repeated for each. Columns go round the antimeridian. Points and objects without a
    position have no row; without objects there is none at all.
    """
    placed = objects.where("lat IS NOT NULL AND lon IS NOT NULL").groupBy(*by, F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"))
    placed = cut_lineage(placed.agg(F.min("id").alias("o_id")))
    rest = in_parts(points.where("lat IS NOT NULL AND lon IS NOT NULL").select(F.col("id").alias("p_id"), "lat", "lon", *by), NEAREST_POINTS, "p_id")
    if by:
        rest = rest.join(bounded(placed.select(*by).distinct()), list(by))
    of = F.count_distinct(F.struct(*by)) if by else F.lit(1)
    box = placed.agg((F.count("*") / F.greatest(F.lit(1), of)).alias("n"), (F.max("o_lat") - F.min("o_lat")).alias("h"), (F.max("o_lon") - F.min("o_lon")).alias("w")).first()
    if not box["n"]:
        return rest.select("p_id", *by, F.lit(None).cast(dict(objects.dtypes)["id"]).alias("o_id"), F.lit(0.0).alias("m")).limit(0)
    start = max(0, min(22, math.floor(math.log2(360 * math.sqrt(box["n"]) / max(box["h"], box["w"], 1e-4)))))
    edge = EARTH_KM * 1000 * (1 - 1e-9)
    found: list[DataFrame] = []
    for z in range(start, -1, -1):
        last = 2**z - 1
        row = lambda c: F.greatest(F.lit(0), F.least(F.lit(last), F.floor(tile_y(F.col(c), z))))  # noqa: B023, E731
        column = lambda c: F.least(F.lit(last), F.floor(tile_x(F.col(c), z)))  # noqa: B023, E731
        at = rest.withColumn("kx", column("lon")).withColumn("ky", row("lat"))
        part = tile_x(F.col("lon"), z) - F.col("kx")
        turn = F.radians(F.least(F.lit(90.0), F.least(1 + part, 2 - part) * 360 / 2**z))
        beside = F.asin(F.cos(F.radians("lat")) * F.sin(turn))
        north = F.when(F.col("ky") >= 2, F.radians(tile_latitude(F.col("ky") - 1, z) - F.col("lat"))).otherwise(math.inf)
        south = F.when(F.col("ky") <= last - 2, F.radians(F.col("lat") - tile_latitude(F.col("ky") + 2, z))).otherwise(math.inf)
        safe = edge * F.least(beside if z >= 2 else F.lit(math.inf), north, south)
        steps = F.sequence(F.lit(-1), F.lit(1))
        spread = placed.withColumn("dx", F.explode(steps)).withColumn("ky", F.explode(F.transform(steps, lambda d: row("o_lat") + d)))  # noqa: B023
        spread = spread.withColumn("kx", F.pmod(column("o_lon") + F.col("dx"), F.lit(2**z))).select(*by, "kx", "ky", "o_id", "o_lat", "o_lon").distinct()
        # the objects around a tile in lists of bounded size, so that a point meets few rows
        listed = spread.withColumn("list", F.shiftright(F.row_number().over(Window.partitionBy(*by, "kx", "ky").orderBy("o_lat", "o_lon")), 8))
        listed = listed.groupBy(*by, "kx", "ky", "list").agg(F.collect_list(F.struct("o_id", "o_lat", "o_lon")).alias("near"))
        m = lambda o: distance_m(F.col("lat"), F.col("lon"), o["o_lat"], o["o_lon"])
        hit = at.withColumn("safe", safe).join(listed, [*by, "kx", "ky"]).withColumn("best", F.array_min(F.transform("near", lambda o: F.struct(m(o).alias("m"), o["o_id"].alias("o_id")))))
        best = hit.groupBy("p_id", *by, "lat", "lon", "safe").agg(F.min("best").alias("best"))
        done = cut_lineage(best.where(F.col("best.m") < F.col("safe")).select("p_id", *by, "lat", "lon", "best"))
        found.append(done.select("p_id", *by, F.col("best.o_id").alias("o_id"), F.col("best.m").alias("m")))
        rest = cut_lineage(rest.join(done.select("p_id", *by, "lat", "lon"), ["p_id", *by, "lat", "lon"], "left_anti"))
        if rest.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def _of_a_point(candidates: DataFrame) -> WindowSpec:
    return Window.partitionBy(*(c for c in GROUP if c in candidates.columns), "p_id")


def relative_order(candidates: DataFrame) -> DataFrame:
    """F3. Candidates (with kind) by distance over radius: adds rel and rank, nearest first. Candidates that
    come with GROUP stay where they are. Of nested ones (p_id, o_id, rel, rank): a point's are ranked by
    themselves, in memory, so nothing is sorted on disk."""
    if "parts" in candidates.columns:
        return nearby.in_relative_order(candidates, RADIUS_M)
    rel = distance_m(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon")) / radius_m(F.col("kind"))
    return candidates.withColumn("rel", rel).withColumn("rank", F.row_number().over(_of_a_point(candidates).orderBy("rel", "o_id")))


def streets_to_cities(candidates: DataFrame, near: float = 0.2, flags: nearby.Flags | None = None) -> DataFrame:
    """C12. (p_id, o_id) of the cities that a street belongs to.

    candidates: p_id, o_id, lat, lon, o_lat, o_lon, kind, contains (the city's boundary has the
    point), has_boundary, named (the city is in the street's is_in). Taken are those that
    contain the point or are named; then, by relative distance, those up to `near` that have no
    boundary, or any if nothing was taken; if there is still none, the nearest. Of nested
    candidates `flags` gives contains, named and has_boundary.
    """
    if "parts" in candidates.columns:
        return nearby.cities_of_streets(candidates, RADIUS_M, near, flags)
    ranked = relative_order(candidates)
    w = _of_a_point(candidates)
    direct = F.col("contains") | F.col("named")
    some = F.max(direct.cast("int")).over(w) == 1
    by_distance = (F.col("rel") <= near) & (~F.col("has_boundary") | ~some)
    marked = ranked.withColumn("some", some).withColumn("taken", direct | by_distance)
    any_taken = F.max(F.col("taken").cast("int")).over(w) == 1
    return marked.withColumn("any_taken", any_taken).where(F.col("taken") | (~F.col("any_taken") & (F.col("rank") == 1))).select("p_id", "o_id")


def name_rank(city: Column, name: Column, short: Column) -> Column:
    """C9. 2 for a city of a boundary's name or short name, 3 where one name contains the other, else null. All lower case."""
    return F.when((city == name) | (city == short), 2).when(F.contains(name, city) | F.contains(city, name), 3)


def match_boundaries(boundaries: DataFrame, inside: DataFrame, centres: DataFrame) -> DataFrame:
    """C9. The city of each boundary: (b_id, city_id, rank).

    boundaries: id, name, and short_name if it is known; inside: b_id, city_id, city_name of places
    inside the boundary; centres: b_id, city_id of admin_centre or label members. Rank 1 a centre
    member, 2 the same name or short name (any case) inside, 3 a name that contains the other inside;
    the smallest id of the best rank wins.
    """
    short = F.lower("short_name") if "short_name" in boundaries.columns else F.lit(None).cast("string")
    named = inside.join(boundaries.select(F.col("id").alias("b_id"), F.lower("name").alias("b_name"), short.alias("b_short")), "b_id")
    city = F.lower("city_name")
    rank = name_rank(city, F.col("b_name"), F.col("b_short"))
    by_name = named.select("b_id", "city_id", rank.alias("rank")).where("rank IS NOT NULL")
    all_ = by_name.unionByName(centres.select("b_id", "city_id", F.lit(1).alias("rank")))
    best = all_.groupBy("b_id").agg(F.min(F.struct("rank", "city_id")).alias("best"))
    return best.select("b_id", F.col("best.city_id").alias("city_id"), F.col("best.rank").alias("rank"))


def missing_cities(boundaries: DataFrame, matches: DataFrame) -> DataFrame:
    """C9, last step. Cities made of boundaries without a match whose place is a small one."""
    rest = boundaries.where(F.lower("place").isin("town", "hamlet", "suburb", "village"))
    rest = rest.join(matches.select(F.col("b_id").alias("id")), "id", "left_anti")
    return rest.select((-F.col("id") - 1).alias("id"), "name", F.upper("place").alias("kind"), F.col("id").alias("boundary_id"))


def boundary_relations(relations: DataFrame) -> DataFrame:
    """B25. Relations or ways that may bound a place: boundary=administrative, or any place tag. tags: a map."""
    return relations.where(F.coalesce(F.col("tags")["boundary"] == "administrative", F.lit(False)) | F.coalesce(F.map_contains_key("tags", "place"), F.lit(False)))


def multipolygon_relations(relations: DataFrame) -> DataFrame:
    """B24. Multipolygons with types of their own that aren't administrative. relations: rel_type,
    admin_level, types (array)."""
    return relations.where("rel_type = 'multipolygon' AND admin_level IS NULL AND size(types) > 0")


def candidate_union(cities: DataFrame, towns: DataFrame) -> DataFrame:
    """G2. Candidates of the city grid and of the town grid as one list; rows of both stay twice."""
    return cities.unionByName(towns)


def boundary_score(name_equal: Column, has_place: Column, has_centre: Column, level: Column) -> Column:
    """E1. Importance of a boundary for a city; smaller is better."""
    # fixed values: admin level -> rank
    rank = F.when(level == 8, 1).when(level == 7, 2).when(level == 6, 3).when(level == 9, 4).when(level == 10, 5).when(level.isNull(), 5).otherwise(6)
    return (
        F.when(name_equal & has_place, 0).when(name_equal & has_centre, rank).when(name_equal, 10 + rank).when(has_centre, 20 + rank).otherwise(30 + rank)
    )


def best_boundaries(pairs: DataFrame) -> DataFrame:
    """E1. (city_id, boundary_ids, score): the best boundary of each city; those of the same level,
    name and score belong together. pairs: city_id, b_id, b_name, level, name_equal, has_place, has_centre."""
    scored = pairs.withColumn("score", boundary_score(F.col("name_equal"), F.col("has_place"), F.col("has_centre"), F.col("level")))
    w = Window.partitionBy("city_id").orderBy("score", "b_id")
    first = scored.withColumn("n", F.row_number().over(w)).where("n = 1").select("city_id", "score", F.col("level").alias("l1"), F.col("b_name").alias("n1"))
    same = scored.join(first, ["city_id", "score"]).where(F.col("level").eqNullSafe(F.col("l1")) & F.col("b_name").eqNullSafe(F.col("n1")))
    return same.groupBy("city_id").agg(F.array_sort(F.collect_set("b_id")).alias("boundary_ids"), F.min("score").alias("score"))


def free_city_boundaries(cities: DataFrame, taken: DataFrame, inside: DataFrame, least_level: int = LEAST_LEVEL) -> DataFrame:
    """C10. (city_id, b_id): cities and towns without a boundary get the containing one of the
    highest admin level, `least_level` at least. inside: city_id, b_id, level."""
    free = cities.where(F.upper("kind").isin(*CITY_KINDS)).join(taken.select(F.col("city_id").alias("id")), "id", "left_anti")
    usable = inside.where(F.col("level") >= least_level)
    return free.join(usable, free["id"] == usable["city_id"]).groupBy("city_id").agg(F.max_by("b_id", F.struct("level", -F.col("b_id"))).alias("b_id"))


def valid_boundary(level: Column, centre: Column, name: Column) -> Column:
    """B21."""
    return (level > 4) & centre.isNotNull() & name.isNotNull() & (name != "")


def city_parts(points: DataFrame, sub_boundaries: DataFrame, places: DataFrame, names: DataFrame) -> DataFrame:
    """C13. (p_id, part): the deepest sub-boundary with the point, else the nearest place within one
    and a half radii among the boundary's places, else the boundary's name.

    points: p_id, b_id, lat, lon; sub_boundaries: p_id, name, level; places: b_id, name, kind, lat,
    lon; names: b_id, b_name.
    """
    deepest = sub_boundaries.groupBy("p_id").agg(F.max_by("name", F.struct("level", "name")).alias("sub"))
    # within a kind the radius is the same, so only the nearest place of each kind can be the one
    objects = places.select("b_id", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("name", F.lit("\0")).alias("id"), "lat", "lon")  # \0: no name
    kinds = bounded(objects.select("b_id", "kind").distinct())
    near = nearest_object(points.select("b_id", F.col("p_id").alias("id"), "lat", "lon").join(kinds, "b_id"), objects, by=("b_id", "kind"))
    near = near.where(F.col("m") <= 1.5 * radius_m(F.col("kind"))).groupBy("p_id").agg(F.min(F.struct("m", "o_id"))["o_id"].alias("place"))
    near = near.where(F.col("place") != "\0")
    return points.join(names, "b_id", "left").join(deepest, "p_id", "left").join(near, "p_id", "left").select(
        "p_id", F.coalesce("sub", "place", "b_name").alias("part")
    )


def suburbs_of_cities(suburbs: DataFrame, cities: DataFrame) -> DataFrame:
    """C14. (suburb_id, city_id) where the suburb's is_in has the city's name.

    is_in is a list of names, so the theta join is an equi-join on its words' positions: every
    suffix of is_in that starts a word is cut to the lengths that city names have.
    """
    lengths = cities.select(F.length("name").alias("n")).distinct()
    sizes = [r["n"] for r in lengths.collect()]  # as many as there are lengths of names
    text = F.lower("is_in")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text)))
    cuts = F.flatten(F.transform(starts, lambda s: F.transform(F.array(*map(F.lit, sizes)), lambda n: F.substring(text, s, n))))
    keys = suburbs.where("is_in IS NOT NULL").select(F.col("id").alias("suburb_id"), F.explode(F.array_distinct(cuts)).alias("key"))
    return keys.join(cities.select(F.col("id").alias("city_id"), F.lower("name").alias("key")), "key").select("suburb_id", "city_id").distinct()


def visited_boundary_ways(ways: DataFrame, members: DataFrame, relations: DataFrame) -> DataFrame:
    """C17. Boundary ways that no boundary relation has taken: outer members that have no name or
    the relation's are out. ways: id, name; relations: id, name, rel_type."""
    taken = (
        members.where("role = 'outer'")
        .join(relations.where("rel_type = 'boundary'").select(F.col("id").alias("rel_id"), F.col("name").alias("r_name")), "rel_id")
        .join(ways.select(F.col("id").alias("member_id"), "name"), "member_id")
        .where(F.col("name").isNull() | (F.col("name") == F.col("r_name")))
    )
    return ways.join(taken.select(F.col("member_id").alias("id")), "id", "left_anti")
