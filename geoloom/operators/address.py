"""Streets and buildings: get-or-create, gazetteer, intersections, interpolation, postcodes, indexes."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import tags
from geoloom.functions.geo import EARTH_KM, distance_m, wrap_longitude
from geoloom.operators.components import SMALL_ROWS, components
from geoloom.session import bounded, cut_lineage, parts_of

VERTEX_ROWS = 1_000_000  # vertices of whole streets that a task of merge_streets gathers


def get_or_create_streets(found: DataFrame) -> DataFrame:
    """C19. (street_id, city_id, part, name, lat, lon): one street for each (city, part, name), at the
    place of its first sighting by ord. A null or empty part is no part."""
    part = F.coalesce(F.col("part"), F.lit(""))
    key = found.withColumn("part", part)
    streets = key.groupBy("city_id", "part", "name").agg(F.min_by(F.struct("lat", "lon"), "ord").alias("at"))
    return streets.select(F.xxhash64("city_id", "part", "name").alias("street_id"), "city_id", "part", "name", F.col("at.lat").alias("lat"), F.col("at.lon").alias("lon"))


def gazetteer(streets: DataFrame, buildings: DataFrame, cities: DataFrame) -> DataFrame:
    """C5, F5. Streets with buildings and city, the main town's first: (city_id, street_id, street, main,
    building_id, housenumber), ordered by city, main town, street, number."""
    main = F.coalesce(F.col("part") == F.col("city_name"), F.lit(False))
    joined = streets.join(buildings, "street_id", "left").join(cities.select(F.col("id").alias("city_id"), F.col("name").alias("city_name")), "city_id")
    out = joined.select("city_id", "street_id", F.col("name").alias("street"), main.alias("main"), "building_id", "housenumber")
    return out.orderBy("city_id", F.desc("main"), "street", "housenumber", "building_id")


def street_vertices(street_nodes: DataFrame, way_nodes: DataFrame) -> DataFrame:
    """C6. street_nodes: street_id, way_id."""
    return street_nodes.join(way_nodes, "way_id").select("street_id", "node_id").distinct()


def new_only(found: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """C18. Rows whose key isn't stored."""
    return found.join(stored.select(key), key, "left_anti")


def already_stored(found: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """C18. Rows whose key is stored."""
    return found.join(stored.select(key), key, "left_semi")


def intersections(vertices: DataFrame) -> DataFrame:
    """C21. Streets of one city that share a vertex: (street_id, other_id, node_id), the smallest
    shared vertex of each pair. vertices: city_id, street_id, node_id."""
    v = vertices.distinct()
    other = v.select("city_id", "node_id", F.col("street_id").alias("other_id"))
    pairs = v.join(other, ["city_id", "node_id"]).where("street_id < other_id")
    once = pairs.groupBy("street_id", "other_id").agg(F.min("node_id").alias("node_id"))
    both = F.array(F.struct("street_id", "other_id"), F.struct(F.col("other_id").alias("street_id"), F.col("street_id").alias("other_id")))
    return once.select(F.explode(both).alias("pair"), "node_id").select("pair.*", "node_id")


def interpolation_pairs(vertices: DataFrame) -> DataFrame:
    """E6. (way_id, from_id, to_id, interpolation) of neighbouring numbered vertices of interpolated
    ways. vertices: way_id, ord, id, housenumber, street, interpolation."""
    numbered = vertices.where("interpolation IS NOT NULL AND housenumber IS NOT NULL AND street IS NOT NULL")
    w = Window.partitionBy("way_id").orderBy("ord")
    before = numbered.withColumn("from_id", F.lag("id").over(w))
    return before.where("from_id IS NOT NULL").select("way_id", "from_id", F.col("id").alias("to_id"), "interpolation")


def associated_streets(members: DataFrame, relations: DataFrame, ways: DataFrame, known: DataFrame) -> DataFrame:
    """C26. (rel_id, street, building_id, number) of associatedStreet relations.

    The street's name is that of the first named street member, else the relation's. Houses are
    the house and address members that aren't known; their number is housename, else housenumber.
    members: rel_id, ord, member_id, role, housename, housenumber; ways: id, name.
    """
    kept = relations.where("rel_type = 'associatedStreet'").select(F.col("id").alias("rel_id"), F.col("name").alias("r_name"))
    names = members.where("role = 'street'").join(ways.select(F.col("id").alias("member_id"), "name"), "member_id").where("name IS NOT NULL")
    names = names.groupBy("rel_id").agg(F.min_by("name", "ord").alias("street"))
    houses = members.where(F.col("role").isin("house", "address")).join(known.select(F.col("building_id").alias("member_id")), "member_id", "left_anti")
    return kept.join(names, "rel_id", "left").join(houses, "rel_id").select(
        "rel_id", F.coalesce("street", "r_name").alias("street"), F.col("member_id").alias("building_id"), F.coalesce("housename", "housenumber").alias("number")
    )


def postcode_rollup(buildings: DataFrame) -> DataFrame:
    """D10. A pseudo-city for each postcode: (postcode, lat, lon, streets, n_buildings), at its first
    building. buildings: id, street, postcode, lat, lon."""
    by = buildings.where("postcode IS NOT NULL").groupBy(F.upper("postcode").alias("postcode"))
    out = by.agg(F.min_by(F.struct("lat", "lon"), "id").alias("at"), F.array_sort(F.collect_set("street")).alias("streets"), F.count("*").alias("n_buildings"))
    return out.select("postcode", F.col("at.lat").alias("lat"), F.col("at.lon").alias("lon"), "streets", "n_buildings")


def city_groups(cities: DataFrame) -> DataFrame:
    """D11. Each city's block: city+town, suburbs that name what they are in, or other."""
    kind = F.lower("kind")
    block = F.when(kind.isin("city", "town"), "city").when((kind == "suburb") & F.col("is_in").isNotNull(), "suburb").otherwise("other")
    return cities.withColumn("block", block)


def distinct_buildings(buildings: DataFrame) -> DataFrame:
    """D12."""
    return buildings.dropDuplicates(["street_id", "building_id"])


def address_index(cities: DataFrame, streets: DataFrame, postcodes: DataFrame) -> DataFrame:
    """K2. (prefix, kind, obj_id, city_id): 1 city or town, 2 postcode, 3 village and the like, 4 street."""
    none = F.lit(None).cast("bigint")
    big = F.lower("kind").isin("city", "town")
    parts = [
        cities.select(F.when(big, 1).otherwise(3).alias("kind"), F.col("id").cast("string").alias("obj_id"), none.alias("city_id"), "name"),
        postcodes.select(F.lit(2).alias("kind"), F.col("postcode").alias("obj_id"), none.alias("city_id"), F.col("postcode").alias("name")),
        streets.select(F.lit(4).alias("kind"), F.col("street_id").cast("string").alias("obj_id"), F.col("city_id").cast("bigint").alias("city_id"), "name"),
    ]
    both = reduce(DataFrame.unionByName, parts)
    return both.select(F.explode(tags.name_prefixes(F.col("name"))).alias("prefix"), "kind", "obj_id", "city_id", "name")


def name_search(index: DataFrame, text: str) -> DataFrame:
    """K3. Objects with a word that starts with `text`: by prefix first, then exactly."""
    folded = text.lower()
    word = F.concat(F.lit(" "), tags.ascii_folded(F.col("name")))
    return index.where(F.col("prefix") == folded[:4]).where(F.contains(word, F.lit(" " + folded))) if len(folded) >= 4 else index.where(F.col("prefix").startswith(folded))


def merge_streets(vertices: DataFrame, max_m: float = 900.0) -> DataFrame:
    """I12. (street_id, merged_id): streets of one city with one name (any case) whose vertices come
    within `max_m` of each other, transitively; merged_id is the smallest of them. Streets without
    a name stay by themselves. vertices: city_id, street_id, name, lat, lon.

    Vertices of one city and name fall into cells so small that all in a cell, or in two adjacent
    ones, are within `max_m`: each goes with its cell's first street, so only these are linked, those of a
    street's cells and those of cells whose boxes suffice. Only cells of different components that boxes leave open have their
    distinct points compared, those within `max_m` of the other's box, so a hot cell doesn't pair its
    vertices. Rows of cells have their own width in degrees, and columns go round the antimeridian.
    """
    k = math.radians(1) * EARTH_KM * 1000  # metres a degree
    side = max_m / math.sqrt(8) / k * 0.999
    rows = math.ceil(max_m / k / side) + 1
    # a row's columns are counted where it is widest; what is near is bounded where it is narrowest
    near_lat = lambda cy: F.when(cy >= 0, cy * side).otherwise(-(cy + 1) * side)
    columns = lambda cy: F.greatest(F.lit(1), F.ceil(360 * F.cos(F.radians(near_lat(cy))) / side))
    column = lambda lon, cy: F.floor((lon + 180) * columns(cy) / 360)
    keys = ["city_id", "name", "cy", "cx"]
    points = vertices.select("city_id", "street_id", F.lower("name").alias("name"), "lat", wrap_longitude(F.col("lon")).alias("lon")).dropna()
    points = points.withColumn("cy", F.floor(F.col("lat") / side)).withColumn("cx", F.pmod(column(F.col("lon"), F.col("cy")), columns(F.col("cy"))))
    points = cut_lineage(points)
    box = [f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("lo", F.min), ("hi", F.max))]
    cells = cut_lineage(points.groupBy(*keys).agg(F.min("street_id").alias("rep"), *box))
    # a street's cells are linked to the first of them, so components are those of the cells' first streets
    firsts = bounded(cells.select(*keys, "rep"), SMALL_ROWS)
    parts = parts_of(points, VERTEX_ROWS)
    own = points.select("street_id", *keys).repartition(parts, "street_id").join(firsts, keys).groupBy("street_id").agg(F.collect_set("rep").alias("reps"))
    own = cut_lineage(own.select("street_id", F.array_min("reps").alias("home"), "reps"))

    other = cells.select(*keys, *(F.col(c).alias(f"o_{c}") for c in ("rep", "lo_lat", "hi_lat", "lo_lon", "hi_lon")))
    around = cells.withColumnsRenamed({"cy": "y", "cx": "x"}).withColumn("cy", F.explode(F.sequence(F.col("y") - rows, F.col("y") + rows)))
    farthest = F.greatest(F.abs(F.col("lo_lat")), F.abs(F.col("hi_lat")), (F.abs(F.col("cy")) + 1) * side)
    narrow = F.greatest(F.cos(F.radians(F.least(farthest, F.lit(90.0)))), F.lit(1e-12))
    reach = 2 * F.degrees(F.asin(F.least(F.lit(1.0), math.sin(math.radians(max_m / k) / 2) / narrow))) * 1.000001 + 1e-9
    first, last = column(F.col("lo_lon") - reach, F.col("cy")), column(F.col("hi_lon") + reach, F.col("cy"))
    last = F.least(last, first + columns(F.col("cy")) - 1)  # once round at most
    around = around.withColumn("reach", reach).withColumn("cx", F.explode(F.sequence(first, last))).withColumn("cx", F.pmod("cx", columns(F.col("cy"))))
    pairs = around.join(other, keys).where((F.col("cy") > F.col("y")) | ((F.col("cy") == F.col("y")) & (F.col("cx") > F.col("x"))))
    span = lambda c: F.greatest(f"hi_{c}", f"o_hi_{c}") - F.least(f"lo_{c}", f"o_lo_{c}")
    gap = F.greatest(F.col("lo_lat") - F.col("o_hi_lat"), F.col("o_lo_lat") - F.col("hi_lat"))
    pairs = pairs.where(gap * k <= max_m * 1.000001)
    wide = F.cos(F.radians(F.greatest(F.lit(0.0), F.least("lo_lat", "o_lo_lat"), -F.greatest("hi_lat", "o_hi_lat"))))
    sure = F.hypot(span("lat"), span("lon") * wide) * k <= max_m * 0.999999
    boxes = [f"{o}{n}_{c}" for o in ("", "o_") for n in ("lo", "hi") for c in ("lat", "lon")]
    both = ["city_id", "name", "y", "x", "cy", "cx"]
    pairs = cut_lineage(pairs.select(*both, *boxes, "reach", F.col("rep").alias("a"), F.col("o_rep").alias("b"), sure.alias("sure")))
    links = own.select(F.explode("reps").alias("a"), F.col("home").alias("b")).union(pairs.where("sure").select("a", "b"))
    roots = cut_lineage(components(links))

    open_ = pairs.where("not sure").join(roots.toDF("a", "a_root"), "a").join(roots.toDF("b", "b_root"), "b").where("a_root <> b_root")
    spots = points.select(*keys, "lat", "lon").distinct()
    off = lambda at, box: F.greatest(F.col(f"{box.format('lo')}_{at}") - F.col(at), F.col(at) - F.col(f"{box.format('hi')}_{at}"))

    def facing(box: str) -> Column:
        """Whether a spot can be within `max_m` of the other cell's box; longitudes may go round."""
        lon = off("lon", box)
        return (off("lat", box) * k <= max_m * 1.000001) & ((lon <= F.col("reach")) | (lon + F.col("reach") >= 180))

    here = open_.join(spots.withColumnsRenamed({"cy": "y", "cx": "x"}), ["city_id", "name", "y", "x"]).where(facing("o_{}"))
    there = open_.join(spots, keys).where(facing("{}")).select(*both, F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"))
    met = here.select(*both, "a_root", "b_root", "lat", "lon").join(there, both)
    met = met.where(distance_m(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon")) <= max_m)
    more = cut_lineage(met.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct())
    merged = roots.join(components(more).toDF("root", "merged"), "root", "left").select(F.col("node").alias("home"), F.coalesce("merged", "root").alias("merged_id"))
    merged = own.select("street_id", "home").join(bounded(cut_lineage(merged), SMALL_ROWS), "home").select("street_id", "merged_id")
    # dealt before they are made distinct: a scan's task would gather the streets of all it reads
    streets = vertices.select("street_id").repartition(parts, "street_id").distinct()
    return streets.join(merged, "street_id", "left").select("street_id", F.coalesce("merged_id", "street_id").alias("merged_id"))


def rewrite_buildings(buildings: DataFrame, merged: DataFrame) -> DataFrame:
    """I12. Buildings under the street that theirs was merged into, each once a street: of those that
    merged streets shared, the row of the smallest old street stays. buildings: street_id, building_id
    and any others; merged: street_id, merged_id. Streets that aren't in `merged` keep their id."""
    to = merged.select("street_id", "merged_id")
    joined = buildings.join(to, "street_id", "left").withColumn("__to", F.coalesce("merged_id", "street_id"))
    first = F.row_number().over(Window.partitionBy("__to", "building_id").orderBy("street_id", *(c for c in buildings.columns if c not in ("street_id", "building_id"))))
    once = joined.withColumn("__n", first).where("__n = 1")
    return once.select(*(F.col("__to").alias(c) if c == "street_id" else F.col(c) for c in buildings.columns))


def corner_streets(first: Column, second: Column) -> Column:
    """G3. The streets of a corner house's second name that the first doesn't have."""
    return F.array_except(second, first)


def write_gazetteer(streets: DataFrame, buildings: DataFrame, cities: DataFrame) -> DataFrame:
    """A16. City blocks: one row a city with its nested streets and their buildings."""
    nested = streets.join(buildings, "street_id", "left").groupBy("city_id", "street_id", "name").agg(
        F.array_sort(F.collect_list(F.when(F.col("building_id").isNotNull(), F.struct("building_id", "housenumber")))).alias("buildings")
    )
    by_city = nested.groupBy("city_id").agg(F.array_sort(F.collect_list(F.struct("name", "street_id", "buildings"))).alias("streets"))
    return cities.select(F.col("id").alias("city_id"), F.col("name").alias("city")).join(by_city, "city_id", "left")
