"""Tag rules: catalogue, lookup, feature and road encoding, amenities, propagation, splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.functions import tags as T
from geoloom.session import bounded

RULE_SCHEMA = (
    "rule_id int, tag string, value string, kind string, minzoom int, maxzoom int, only_point boolean, relation boolean, target_id int, "
    "apply_to array<struct<tag:string,value:string>>, poi_category string, poi_prefix string"
)
#: fixed values: zoom ranges of rules that state none
MAIN_ZOOMS, OTHER_ZOOMS = (15, 31), (5, 31)
RULES_IN_PLAN = 10_000  # rules up to which a plan holds them as a constant, in SLOTS parts by the hash of the tag
SLOTS = 1024
RULE_FIELDS = ("rule_id", "tag", "value", "kind", "minzoom", "maxzoom", "only_point", "target_id", "apply_to")


def read_rules(spark: SparkSession, path: str, row_tag: str = "type") -> DataFrame:
    """A9. The rule table of an XML catalogue.

    <category minzoom="12"><type tag="highway" value="primary" kind="main" apply_to="a=b;c"/></category>:
    attributes of a category hold for its types unless they state their own. A rule without a
    zoom range has its kind's default. Rules are numbered in document order, file by file by name; repeated additional
    and text rules are merged, repeated main rules are an error.
    """
    # a file that isn't split is read by one task from its beginning, so rows of a file are numbered in its order
    categories = spark.read.format("xml").option("rowTag", "category").option("multiLine", True).load(path)
    types = categories.select("*", F.posexplode(row_tag).alias("at", "one"))
    inside = set(types.schema["one"].dataType.names)

    def attribute(name: str) -> Column:
        own = F.col(f"one._{name}").cast("string") if f"_{name}" in inside else F.lit(None).cast("string")
        return F.coalesce(own, F.col(f"_{name}").cast("string")) if f"_{name}" in categories.columns else own

    kind = F.coalesce(attribute("kind"), F.lit("main"))
    pattern = lambda p: F.struct(F.substring_index(p, "=", 1).alias("tag"), F.when(F.contains(p, F.lit("=")), F.substring_index(p, "=", -1)).alias("value"))
    flag = lambda name: F.coalesce(attribute(name) == "true", F.lit(False))
    zoom = lambda name, i: F.coalesce(attribute(name).cast("int"), F.when(kind == "main", MAIN_ZOOMS[i]).otherwise(OTHER_ZOOMS[i]))
    rules = types.select(
        F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("n")).alias("row"), "at", attribute("tag").alias("tag"), attribute("value").alias("value"), kind.alias("kind"),
        zoom("minzoom", 0).alias("minzoom"), zoom("maxzoom", 1).alias("maxzoom"), flag("point").alias("only_point"), flag("relation").alias("relation"),
        F.lit(None).cast("int").alias("target_id"), F.transform(F.split(attribute("apply_to"), ";"), pattern).alias("apply_to"),
        attribute("poi_category").alias("poi_category"), attribute("poi_prefix").alias("poi_prefix"),
    )
    key = ["tag", "value", "kind"]
    repeated = rules.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1 AND kind = 'main'").limit(1).collect()
    if repeated:
        raise ValueError(f"main rule {repeated[0]['tag']}={repeated[0]['value']} stands twice")
    columns = [c for c in rules.columns if c not in key]
    merged = rules.groupBy(*key).agg(F.min(F.struct(*columns)).alias("first")).select(*key, "first.*")
    numbered = merged.withColumn("rule_id", F.row_number().over(Window.orderBy("row", "at")).cast("int"))
    return numbered.select([f.split(" ")[0] for f in RULE_SCHEMA.replace("array<struct<tag:string,value:string>>", "x").split(", ")])


def rule_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Rules written as dictionaries, with the defaults filled in."""
    filled = []
    for i, row in enumerate(rows):
        low, high = MAIN_ZOOMS if row.get("kind", "main") == "main" else OTHER_ZOOMS
        base = {
            "rule_id": i + 1, "value": None, "kind": "main", "minzoom": low, "maxzoom": high, "only_point": False, "relation": False,
            "target_id": None, "apply_to": None, "poi_category": None, "poi_prefix": None,
        }
        filled.append(base | row)
    return spark.createDataFrame(filled, RULE_SCHEMA)


def lookup(long_tags: DataFrame, rules: DataFrame) -> DataFrame:
    """C22. (.., k, v) with the rule for (k, v), else the one for k with any value."""
    exact = rules.where("value IS NOT NULL").select(F.struct(*rules.columns).alias("exact"), F.col("tag").alias("k"), F.col("value").alias("v"))
    any_ = rules.where("value IS NULL").select(F.struct(*rules.columns).alias("any"), F.col("tag").alias("k"))
    joined = long_tags.join(bounded(exact), ["k", "v"], "left").join(bounded(any_), "k", "left")
    return joined.select(*long_tags.columns, F.coalesce("exact", "any").alias("rule")).where("rule IS NOT NULL").select(*long_tags.columns, "rule.*")


def visible(rules: DataFrame, zoom: int, is_node: Column) -> DataFrame:
    """B5, B6. Rules of a zoom; those for points only where the object is one."""
    return rules.where(F.lit(zoom).between(F.col("minzoom"), F.col("maxzoom")) & (~F.col("only_point") | is_node))


def _constant(rules: DataFrame) -> Column | None:
    """Rules by the hash of their tag, one constant of the plan; None where they are more than RULES_IN_PLAN."""
    place = F.pmod(F.xxhash64("tag"), F.lit(SLOTS)).alias("slot")
    rows = rules.select(place, F.to_json(F.struct(*RULE_FIELDS)).alias("rule")).limit(RULES_IN_PLAN + 1).collect()
    if len(rows) > RULES_IN_PLAN:
        return None
    slots: list[list[str]] = [[] for _ in range(SLOTS)]
    for row in rows:
        slots[row["slot"]].append(row["rule"])
    text = ",".join(f"[{','.join(slot)}]" for slot in slots)
    one = rules.select(*RULE_FIELDS).schema.simpleString()
    return F.from_json(F.lit(f'{{"slots":[{text}]}}'), f"struct<slots:array<array<{one}>>>")["slots"]


def matched(entities: DataFrame, rules: DataFrame) -> DataFrame:
    """Entities with found, what C22 finds for their tags: an array of (r, the rule; v, the tag's value).

    Up to RULES_IN_PLAN rules stand in the plan as a constant, and a row is looked up where it is read;
    more are joined, and then an id stands once. entities: id, tags and any others.
    """
    table = _constant(rules)
    if table is None:
        long_tags = entities.select("id", F.explode("tags").alias("k", "v"))
        found = lookup(long_tags, rules).select("id", F.struct(F.struct(*RULE_FIELDS).alias("r"), "v").alias("one"))
        return entities.join(found.groupBy("id").agg(F.collect_list("one").alias("found")), "id")

    def of(tag: Column) -> Column:
        slot = F.get(table, F.pmod(F.xxhash64(tag["key"]), F.lit(SLOTS)).cast("int"))
        fit = F.filter(slot, lambda r: (r["tag"] == tag["key"]) & (r["value"].isNull() | (r["value"] == tag["value"])))
        return F.struct(tag["value"].alias("v"), fit.alias("fit"))

    def best(one: Column) -> Column:  # rules for the value before those for any
        exact = F.exists(one["fit"], lambda r: r["value"].isNotNull())
        kept = F.filter(one["fit"], lambda r: ~exact | r["value"].isNotNull())
        return F.transform(kept, lambda r: F.struct(r.alias("r"), one["v"].alias("v")))

    tried = F.filter(F.transform(F.map_entries("tags"), of), lambda one: F.size(one["fit"]) > 0)
    return entities.withColumn("found", F.flatten(F.transform(tried, best)))


def encode_levels(entities: DataFrame, rules: DataFrame, zooms: dict[int, int], *keep: str) -> DataFrame:
    """H1 at several levels in one pass: (level, id, types, add_types, names, area, *keep) as in `encode_features`,
    a row for each level of `zooms` (level: zoom) at which the entity has a main type."""
    own = entities.select("id", "is_node", "tags", *(c for c in keep if c not in ("id", "is_node", "tags")))
    same = lambda f: (f["r"]["tag"] == "name:en") & F.coalesce(f["v"] == F.col("tags")["name"], F.lit(False))
    holds = lambda f: ((f["r"]["kind"] == "main") | T.applies_any(F.col("tags"), f["r"]["apply_to"])) & (~f["r"]["only_point"] | F.col("is_node"))
    found = matched(own, rules).withColumn("found", F.filter("found", lambda f: holds(f) & ~same(f)))
    number = lambda f: F.coalesce(f["r"]["target_id"], f["r"]["rule_id"])

    def encoded(level: int, zoom: int) -> Column:
        seen = lambda f, kind: (f["r"]["kind"] == kind) & F.lit(zoom).between(f["r"]["minzoom"], f["r"]["maxzoom"])
        ids = lambda kind: F.sort_array(F.array_distinct(F.transform(F.filter("found", lambda f: seen(f, kind)), number)))
        texts = F.transform(F.filter("found", lambda f: seen(f, "text")), lambda f: F.struct(number(f).alias("rule"), f["v"].alias("text")))
        names = F.map_from_entries(F.sort_array(F.array_distinct(texts)))
        return F.struct(F.lit(level).alias("level"), ids("main").alias("types"), ids("additional").alias("add_types"), names.alias("names"))

    each = F.filter(F.array(*(encoded(level, zoom) for level, zoom in zooms.items())), lambda e: F.size(e["types"]) > 0)
    return found.select("id", T.area_flag(F.col("tags")).alias("area"), *keep, F.explode(each).alias("e")).select(
        "e.level", "id", "e.types", "e.add_types", "e.names", "area", *keep
    )


def encode_features(entities: DataFrame, rules: DataFrame, zoom: int) -> DataFrame:
    """H1, F6. (id, types, add_types, names, area) of the entities that have a main type at a zoom.

    entities: id, tags, is_node. Type ids ascend. Additional and text rules count only where one of
    their apply_to patterns holds. name:en is left out when it equals name. A rule with a target is
    written as the target. Entities whose tags are null or empty have no type.
    """
    return encode_levels(entities, rules, {0: zoom}).drop("level")


def encode_roads(entities: DataFrame, route_rules: DataFrame) -> DataFrame:
    """H2. (id, types, names): ids of accepted tags and of tags that start with an amended prefix, and
    texts. route_rules: rule_id, mode (register, amend, replace, text), tag, value, tag2, value2."""
    long_tags = entities.select("id", F.explode("tags").alias("k", "v")).withColumn("v", T.yes_no(F.col("v")))
    replace = route_rules.where("mode = 'replace'").select(F.col("tag").alias("k"), F.col("value").alias("v"), "tag2", "value2")
    replaced = long_tags.join(bounded(replace), ["k", "v"], "left").select("id", F.coalesce("tag2", "k").alias("k"), F.coalesce("value2", "v").alias("v"))
    own = route_rules.where("mode <> 'replace'").select("rule_id", "mode", "tag", "value")
    exact = (F.col("mode").isin("register", "text")) & (F.col("k") == F.col("tag"))
    prefix = (F.col("mode") == "amend") & F.col("k").startswith(F.col("tag"))
    fits = (exact | prefix) & (F.col("value").isNull() | (F.col("value") == F.col("v")))
    met = replaced.join(bounded(own), fits)
    accepted = met.groupBy("id").agg(
        F.array_sort(F.collect_set(F.when(F.col("mode") != "text", F.col("rule_id")))).alias("types"),
        F.map_from_entries(F.array_sort(F.collect_set(F.when(F.col("mode") == "text", F.struct("rule_id", "v"))))).alias("names"),
        F.max((F.col("mode") == "register").cast("int")).alias("road"),
    )
    return accepted.where("road = 1").drop("road")


def amenities(entities: DataFrame, rules: DataFrame) -> DataFrame:
    """H5. (id, category, subtype): by tag key ascending; the value "no" is none, and one is left out
    when its category already has a larger subtype. entities: id, tags, is_relation."""
    long_tags = entities.select("id", "is_relation", F.explode("tags").alias("k", "v"))
    found = lookup(long_tags, rules.where("poi_category IS NOT NULL")).where("v <> 'no' AND (NOT is_relation OR relation)")
    found = found.select("id", "k", F.col("poi_category").alias("category"), F.concat(F.coalesce("poi_prefix", F.lit("")), "v").alias("subtype"))
    before = Window.partitionBy("id", "category").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    kept = found.withColumn("top", F.max("subtype").over(before)).where("top IS NULL OR subtype >= top")
    return kept.select("id", "category", "subtype")


def additional_info(entities: DataFrame, rules: DataFrame) -> DataFrame:
    """H6. (id, info map): additional and text rules that apply; a fixed value is the rule's."""
    long_tags = entities.select("id", "tags", F.explode("tags").alias("k", "v"))
    found = lookup(long_tags, rules.where("kind <> 'main'")).where(T.applies_any(F.col("tags"), F.col("apply_to")))
    entry = F.struct("k", F.coalesce("value", "v").alias("v"))
    return found.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_set(entry))).alias("info"))


def propagate(relations: DataFrame, members: DataFrame, rules: DataFrame) -> DataFrame:
    """C7. (member_id, tags): what relations hand to their members.

    relations: id, tags. Tags with a relation rule go to all members, with their name tags; several
    relations' text values are joined by ", ", other values are the smallest.
    """
    long_tags = relations.select(F.col("id").alias("rel_id"), F.explode("tags").alias("k", "v"))
    handed = lookup(long_tags, rules.where("relation"))
    carriers = handed.select("rel_id").distinct()
    names = long_tags.where("k IN ('name', 'name:en')").join(carriers, "rel_id", "left_semi").select("rel_id", "k", "v", F.lit("text").alias("kind"))
    both = handed.select("rel_id", "k", "v", "kind").unionByName(names).distinct()
    met = both.join(members.select("rel_id", "member_id").distinct(), "rel_id")
    value = F.when(F.max(F.col("kind") == "text"), F.array_join(F.array_sort(F.collect_set("v")), ", ")).otherwise(F.min("v"))
    by_key = met.groupBy("member_id", "k").agg(value.alias("v"))
    return by_key.groupBy("member_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("tags"))


def _first_handed(handed: DataFrame, members: DataFrame) -> DataFrame:
    """(member_id, tags): for each member and key the value of its first relation by id."""
    met = handed.join(members.select("rel_id", "member_id").distinct(), "rel_id")
    by_key = met.groupBy("member_id", "k").agg(F.min_by("v", "rel_id").alias("v"))
    return by_key.groupBy("member_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("tags"))


def propagate_roads(relations: DataFrame, members: DataFrame, route_rules: DataFrame) -> DataFrame:
    """C7 for roads. (member_id, tags): relations with a tag that a rule of mode relation accepts hand on
    their text tags (mode text), accepted tags (register) and tags with an amended prefix (amend);
    true and false count as yes and no. relations: id, tags; route_rules: mode, tag, value."""
    long_tags = relations.select(F.col("id").alias("rel_id"), F.explode("tags").alias("k", "v")).withColumn("v", T.yes_no(F.col("v")))
    same = F.col("value").isNull() | (F.col("value") == F.col("v"))
    tables = lambda *modes: bounded(route_rules.where(F.col("mode").isin(*modes)).select("mode", "tag", "value"))
    carriers = long_tags.join(tables("relation"), (F.col("k") == F.col("tag")) & same, "left_semi").select("rel_id").distinct()
    exact = F.col("mode").isin("text", "register") & (F.col("k") == F.col("tag"))
    fits = (exact | ((F.col("mode") == "amend") & F.col("k").startswith(F.col("tag")))) & ((F.col("mode") == "text") | same)
    handed = long_tags.join(carriers, "rel_id", "left_semi").join(tables("text", "register", "amend"), fits, "left_semi")
    return _first_handed(handed, members)


def propagate_pois(relations: DataFrame, members: DataFrame, rules: DataFrame) -> DataFrame:
    """C7 for POIs. (member_id, tags): tags of relations that are a POI category for relations."""
    long_tags = relations.select(F.col("id").alias("rel_id"), F.explode("tags").alias("k", "v"))
    return _first_handed(lookup(long_tags, rules.where("poi_category IS NOT NULL AND relation")).select("rel_id", "k", "v"), members)


def with_propagated(entities: DataFrame, propagated: DataFrame) -> DataFrame:
    """C7. Entities with handed tags where they lack them (own tags win)."""
    handed = propagated.select(F.col("member_id").alias("id"), F.col("tags").alias("handed"))
    joined = entities.join(handed, "id", "left")
    missing = F.map_filter("handed", lambda k, v: ~F.map_contains_key("tags", k))
    return joined.withColumn("tags", F.when(F.col("handed").isNull(), F.col("tags")).otherwise(F.map_concat("tags", missing))).drop("handed")


def exclude_polygon_types(features: DataFrame, polygon_members: DataFrame) -> DataFrame:
    """C16. Ways of a multipolygon without the relation's types. polygon_members: id, rel_types."""
    by = polygon_members.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("rel_types"))).alias("rel_types"))
    rest = features.join(by, "id", "left").withColumn("types", F.array_except("types", F.coalesce("rel_types", F.array().cast("array<int>"))))
    return rest.drop("rel_types").where(F.size("types") > 0)


def rule_usage(types: DataFrame, rules: DataFrame) -> DataFrame:
    """D9. (rule_id, n, code): codes from 1, rarest used rule first, ties by rule id; unused after.
    types: one row per use (rule_id)."""
    used = types.groupBy("rule_id").agg(F.count("*").alias("n"))
    counted = rules.select("rule_id").join(used, "rule_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return counted.withColumn("code", F.row_number().over(Window.orderBy((F.col("n") == 0).cast("int"), "n", "rule_id")))


def split_seamarks(entities: DataFrame) -> DataFrame:
    """G7. (id, part, tags): objects with seamark:<group>:<attribute> tags, one for each group.

    light_major and light_minor are group light. Every part has the tags common to all. Part 0 is
    the group that seamark:type names, else the first by name; objects without such tags are part 0
    as they are.
    """
    long_tags = entities.select("id", "tags", F.explode("tags").alias("k", "v"))
    group = F.regexp_extract("k", "^seamark:([^:]+):.+$", 1)
    group = F.when(group.isin("light_major", "light_minor"), "light").otherwise(group)
    named = long_tags.withColumn("group", group)
    grouped = named.where("group <> ''").groupBy("id", "group").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("own"))
    kind = F.col("tags")["seamark:type"]
    kind = F.when(kind.isin("light_major", "light_minor"), "light").otherwise(kind)
    common = F.map_filter("tags", lambda k, v: F.regexp_extract(k, "^seamark:([^:]+):.+$", 1) == "")
    joined = entities.join(grouped, "id", "left").withColumn("first", F.coalesce((F.col("group") != kind).cast("int"), F.lit(1)))
    part = F.row_number().over(Window.partitionBy("id").orderBy("first", "group")) - 1
    return joined.select("id", part.alias("part"), F.when(F.col("own").isNull(), F.col("tags")).otherwise(F.map_concat(common, "own")).alias("tags"))
