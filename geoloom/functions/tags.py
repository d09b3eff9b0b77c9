"""Tag maps and tag texts as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_tags(text: Column) -> Column:
    """k~v~k~v~ as a map: empty pieces are dropped, the first value of a key wins."""
    parts = F.filter(F.split(text, "~"), lambda s: s != "")
    pairs = F.floor(F.size(parts) / 2).cast("int")
    entry = lambda i: F.struct(F.get(parts, i * 2).alias("key"), F.get(parts, i * 2 + 1).alias("value"))
    entries = F.when(pairs > 0, F.transform(F.sequence(F.lit(0), pairs - 1), entry)).otherwise(
        F.array().cast("array<struct<key:string,value:string>>")
    )
    seen = lambda i, e: ~F.exists(F.slice(entries, F.lit(1), i), lambda x: x["key"] == e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: seen(i, e)))


def format_tags(tags: Column) -> Column:
    """The inverse of `parse_tags`, keys ascending."""
    entries = F.array_sort(F.map_entries(tags))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("~"), e["value"], F.lit("~"))), "")


def applies(tags: Column, tag: Column, value: Column) -> Column:
    """Whether a pattern (tag, value; null or empty value: any) holds for a tag map."""
    held = F.element_at(tags, tag)
    return held.isNotNull() & (value.isNull() | (value == "") | (held == value))


def applies_any(tags: Column, patterns: Column) -> Column:
    """Whether any struct (tag, value) of an array holds; no patterns: yes."""
    return (F.size(patterns) <= 0) | patterns.isNull() | F.exists(patterns, lambda p: applies(tags, p["tag"], p["value"]))


def yes_no(value: Column) -> Column:
    """true and false as yes and no, the rest as it is."""
    folded = F.lower(value)
    return F.when(folded == "true", "yes").when(folded == "false", "no").otherwise(value)


def rule_key(tag: Column, value: Column) -> Column:
    """tag, or tag/value."""
    return F.when(value.isNull() | (value == ""), tag).otherwise(F.concat_ws("/", tag, value))


def rule_tag(key: Column) -> Column:
    return F.substring_index(key, "/", 1)


def rule_value(key: Column) -> Column:
    """What follows the first slash; null without one."""
    at = F.instr(key, F.lit("/"))
    return F.when(at > 0, F.substring(key, at + 1, F.length(key)))


def area_flag(tags: Column) -> Column:
    return F.coalesce(F.lower(tags["area"]).isin("yes", "true"), F.lit(False))


def website(tags: Column) -> Column:
    """wikipedia, website, url or contact:website, with a scheme."""
    some = F.coalesce(*(F.nullif(tags[k], F.lit("")) for k in ("wikipedia", "website", "url", "contact:website")))
    return F.when(some.startswith("http://") | some.startswith("https://"), some).otherwise(F.concat(F.lit("http://"), some))


def object_name(tags: Column) -> Column:
    """name, else name:en, else "operator [ref]", else ref."""
    name, english, operator, ref = (F.nullif(tags[k], F.lit("")) for k in ("name", "name:en", "operator", "ref"))
    by_operator = F.when(ref.isNotNull(), F.concat(operator, F.lit(" ["), ref, F.lit("]"))).otherwise(operator)
    return F.coalesce(name, english, by_operator, ref)


def poi_id(entity_id: Column, is_node: Column) -> Column:
    return entity_id * 2 + F.when(is_node, 0).otherwise(1)


#: fixed values: colour names by their web hexadecimal
COLOURS = {
    "#ff0000": "red", "#00ff00": "green", "#0000ff": "blue", "#ffff00": "yellow", "#ffa500": "orange", "#000000": "black",
    "#ffffff": "white", "#a52a2a": "brown", "#800080": "purple", "#808080": "gray",
}


def hiking_symbol_tags(symbol: Column) -> Column:
    """osmc:symbol "waycolour:background:foreground:text:textcolour" as an array of structs (k, v):
    one osmc_symbol_<colour> for the way colour, and osmc_text for the text."""
    parts = F.split(symbol, ":")
    made = F.array(
        F.struct(F.concat(F.lit("osmc_symbol_"), F.get(parts, F.lit(0))).alias("k"), F.lit("").alias("v")),
        F.struct(F.lit("osmc_text").alias("k"), F.coalesce(F.get(parts, F.lit(3)), F.lit("")).alias("v")),
    )
    return F.when(symbol.isNotNull(), F.filter(made, lambda e: ((e["k"] != "osmc_text") | (e["v"] != "")) & (e["k"] != "osmc_symbol_")))


def colour_tag(colour: Column, names: Mapping[str, str] = COLOURS) -> Column:
    """color_<name> of a colour tag: a known hexadecimal by its name, names as they are."""
    folded = F.lower(colour)
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.concat(F.lit("color_"), F.coalesce(F.try_element_at(known, folded), folded))


#: fixed values: letters folded to ASCII in name prefixes
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def ascii_folded(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), "ß", "ss"), "æ", "ae")


def name_prefixes(name: Column, length: int = 4) -> Column:
    """Distinct first letters of the words of a name, lower-cased and folded; the apostrophe is
    part of a word."""
    words = F.filter(F.split(ascii_folded(name), "[^a-z0-9']+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, length)))


def house_number(number: Column, interpolation: Column) -> Column:
    """struct(first, last, corner, kind): "a-b" is a range if its way is interpolated, "n/m" a corner
    house; kind is 0 none, -1 all, -2 even, -3 odd, -4 alphabetic, or a positive step."""
    dash = F.regexp_extract(number, r"^([^-/]+)-([^-/]+)$", 2)
    slash = F.regexp_extract(number, r"^([^/]+)/([^/]+)$", 2)
    first = F.when(slash != "", F.regexp_extract(number, r"^([^/]+)/", 1)).when(dash != "", F.regexp_extract(number, r"^([^-]+)-", 1)).otherwise(number)
    folded = F.lower(interpolation)
    kind = (
        F.when(folded == "all", -1).when(folded == "even", -2).when(folded == "odd", -3).when(folded == "alphabetic", -4)
        .otherwise(F.coalesce(folded.try_cast("int"), F.lit(0)))
    )
    return F.struct(first.alias("first"), F.nullif(dash, F.lit("")).alias("last"), F.nullif(slash, F.lit("")).alias("corner"), kind.alias("kind"))


def postcode(tags: Column) -> Column:
    return F.upper(F.coalesce(tags["addr:postcode"], tags["postal_code"]))


def is_in_names(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(text, ";"), lambda s: F.trim(s)), lambda s: s != ""))


def display_name(street: Column, district: Column, city: Column) -> Column:
    """Street, with " (district)" where the district isn't the city itself."""
    return F.when(district.isNotNull() & (district != "") & (district != city), F.concat(street, F.lit(" ("), district, F.lit(")"))).otherwise(street)


def plain_name(display: Column) -> Column:
    return F.regexp_replace(display, r" \([^()]*\)$", "")


def english_to_write(name: Column, english: Column) -> Column:
    """The English name where it says something else."""
    return F.when(~(english == name) | name.isNull(), english)


def replace_tokens(template: str, properties: Mapping[str, Column], case: str | None = None) -> Column:
    """{key} templates filled from properties (missing: empty); upper- or lower-cased on demand."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        key, closed, after = rest.partition("}")
        if not closed:
            parts.append(F.lit(before + "{" + key))
            rest = ""
            break
        parts += [F.lit(before), F.coalesce(properties[key].cast("string"), F.lit("")) if key in properties else F.lit("")]
        rest = after
    text = F.concat(*parts, F.lit(rest))
    return F.upper(text) if case == "uppercase" else F.lower(text) if case == "lowercase" else text


def road_rule(tag: Column, value: Column) -> Column:
    """struct(kind, number) of a road tag: 1 access, 2 oneway (-1, 0, 1), 3 highway, 4 maxspeed (m/s),
    5 roundabout, 6 traffic signals, 7 crossing, 8 lanes; 0 for the rest."""
    from .numparse import as_int, speed_mps

    oneway = F.when(value.isin("-1", "reverse"), -1).when(value.isin("1", "yes", "true"), 1).otherwise(0)
    kind = (
        F.when(tag == "oneway", 2).when((tag == "highway") & (value == "traffic_signals"), 6)
        .when(((tag == "railway") & value.isin("crossing", "level_crossing")) | ((tag == "highway") & (value == "crossing")), 7)
        .when((tag == "junction") & (value == "roundabout"), 5).when(tag == "roundabout", 5).when(tag == "maxspeed", 4)
        .when(tag == "lanes", 8).when(tag == "highway", 3).when(tag == "access", 1).otherwise(0)
    )
    number = (
        F.when(kind == 2, oneway.cast("double")).when(kind == 4, speed_mps(value, -1.0)).when(kind == 8, as_int(value, -1).cast("double"))
    )
    return F.struct(kind.alias("kind"), number.alias("number"))
