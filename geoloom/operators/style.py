"""Style rules: catalogue, evaluation, primitives, labels, icons, render sets."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.session import bounded, cut_lineage

from . import mapobj
from .coast import coast_areas

#: fixed values: kinds of primitive
POINT, LINE, POLYGON = 1, 2, 3
ICON_ORDER_OFFSET = 100_000


@dataclass
class Rule:
    """Inputs that must hold, outputs, and branches: the first matching one of `if_else`, every one of `if_`."""

    inputs: dict[str, str] = field(default_factory=dict)
    outputs: dict[str, str] = field(default_factory=dict)
    if_else: list[Rule] = field(default_factory=list)
    if_: list[Rule] = field(default_factory=list)


INPUTS = ("tag", "value", "minzoom", "maxzoom", "additional", "nightMode", "area", "layer", "point", "textLength")


def read_style(xml: str) -> dict[str, list[Rule]]:
    """A10. Classes (order, text, point, line, polygon) of top-level rules from a style document.

    <filter> is a rule with its attributes as inputs or outputs; <group> hands its attributes to the
    filters inside; <case> children of a filter are if-else branches, <apply> children if branches;
    <constant name="x" value="y"/> is what $x stands for.
    """
    root = ET.fromstring(xml)
    constants = {c.get("name"): c.get("value", "") for c in root.iter("constant")}

    def rule(node: ET.Element, inherited: dict[str, str]) -> Rule:
        every = inherited | {k: constants.get(v[1:], v) if v.startswith("$") else v for k, v in node.attrib.items()}
        made = Rule({k: v for k, v in every.items() if k in INPUTS}, {k: v for k, v in every.items() if k not in INPUTS})
        made.if_else = [rule(c, {}) for c in node if c.tag == "case"]
        made.if_ = [rule(c, {}) for c in node if c.tag == "apply"]
        return made

    def walk(node: ET.Element, inherited: dict[str, str]) -> list[Rule]:
        out = []
        for child in node:
            if child.tag == "group":
                out += walk(child, inherited | {k: constants.get(v[1:], v) if v.startswith("$") else v for k, v in child.attrib.items()})
            elif child.tag == "filter":
                out.append(rule(child, inherited))
        return out

    return {node.tag: walk(node, {}) for node in root if node.tag in ("order", "text", "point", "line", "polygon")}


def rule_table(classes: dict[str, list[Rule]]) -> list[tuple]:
    """The rules flat: (rule_id, parent_id, class, branch, seq, inputs, outputs)."""
    rows: list[tuple] = []

    def add(r: Rule, parent: int | None, kind: str, branch: str, seq: int) -> None:
        rows.append((len(rows) + 1, parent, kind, branch, seq, r.inputs, r.outputs))
        own = len(rows)
        for name, children in (("if_else", r.if_else), ("if", r.if_)):
            for i, c in enumerate(children):
                add(c, own, kind, name, i)

    for kind, rules in classes.items():
        for i, r in enumerate(rules):
            add(r, None, kind, "root", i)
    return rows


def _holds(rule: Rule, inputs: dict[str, Column], tag: bool) -> Column:
    """All inputs of a rule hold (tag and value only if asked for)."""
    conditions = []
    for key, want in rule.inputs.items():
        if key in ("tag", "value") and not tag:
            continue
        if key == "minzoom":
            conditions.append(inputs["zoom"] >= int(want))
        elif key == "maxzoom":
            conditions.append(inputs["zoom"] <= int(want))
        elif key == "additional":
            conditions.append(F.array_contains(inputs["additional"], want))
        elif key in inputs:
            number = want.replace(".", "", 1).isdigit() and "." in want
            conditions.append(F.abs(inputs[key].cast("double") - float(want)) < 1e-9 if number else inputs[key].cast("string") == want)
        else:
            conditions.append(F.lit(False))
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _output(rule: Rule, name: str, inputs: dict[str, Column]) -> Column | None:
    """A rule's value of an output, given that its own inputs hold; None if it has none anywhere."""
    value = F.lit(rule.outputs[name]) if name in rule.outputs else None
    for branch in _first_branches(rule, name, inputs):
        value = branch if value is None else F.coalesce(branch, value)
    for child in rule.if_:
        inner = _output(child, name, inputs)
        if inner is not None:
            inner = F.when(_holds(child, inputs, True), inner)
            value = inner if value is None else F.coalesce(inner, value)
    return value


def _first_branches(rule: Rule, name: str, inputs: dict[str, Column]) -> list[Column]:
    """The value that the first matching if-else branch gives, or nothing."""
    chosen: Column | None = None
    for child in rule.if_else:
        inner = _output(child, name, inputs)
        inner = F.lit(None).cast("string") if inner is None else inner
        hit = _holds(child, inputs, True)
        chosen = F.when(hit, inner) if chosen is None else chosen.when(hit, inner)
    return [] if chosen is None else [chosen]


def evaluate(rules: list[Rule], inputs: dict[str, Column], outputs: list[str]) -> dict[str, Column]:
    """K4, C23. One column for each output, null where no rule gives it.

    Rules are tried by (tag, value), then (tag, ""), then ("", ""): the first of a step whose inputs
    hold decides; later steps are tried only if none does. inputs: tag, value, zoom, additional
    (array of "tag=value"), and others by name. The rule tree is compiled to nested conditions, so
    Catalyst sees plain expressions.
    """
    steps = (
        lambda r: bool(r.inputs.get("tag")) and bool(r.inputs.get("value")),
        lambda r: bool(r.inputs.get("tag")) and not r.inputs.get("value"),
        lambda r: not r.inputs.get("tag"),
    )
    out = {}
    for name in outputs:
        value: Column | None = None
        for step in steps:
            for rule in filter(step, rules):
                hit = _holds(rule, inputs, False)
                for key in ("tag", "value"):
                    if rule.inputs.get(key):
                        hit = hit & (inputs[key] == rule.inputs[key])
                inner = _output(rule, name, inputs)
                inner = F.lit(None).cast("string") if inner is None else inner
                value = F.when(hit, inner) if value is None else value.when(hit, inner)
        out[name] = F.lit(None).cast("string") if value is None else value
    return out


def primitives(objects: DataFrame, classes: dict[str, list[Rule]], zoom: int, point_area_px: float = 10_000.0) -> DataFrame:
    """K5. (id, type_index, tag, value, kind, z): what each type of an object is drawn as.

    objects: id, types array<struct<tag, value>> (most important first), additional array<string>,
    names map, area boolean, area_px. The order class gives objectType and order; polygons add
    1 / area. Polygons over `point_area_px` also give a point. A point stays only for the first type
    or where the object has a name.
    """
    spread = objects.select("*", F.posexplode("types").alias("type_index", "type"))
    inputs = {"tag": F.col("type.tag"), "value": F.col("type.value"), "zoom": F.lit(zoom), "additional": F.col("additional"), "area": F.col("area").cast("string")}
    made = evaluate(classes.get("order", []), inputs, ["objectType", "order"])
    typed = spread.select("id", "type_index", "type", "names", "area_px", made["objectType"].cast("int").alias("kind"), made["order"].cast("double").alias("order"))
    typed = typed.where("kind IS NOT NULL")
    z = F.when(F.col("kind") == POLYGON, F.col("order") + F.try_divide(F.lit(1.0), F.col("area_px"))).otherwise(F.col("order"))
    base = typed.withColumn("z", z)
    points = base.where((F.col("kind") == POLYGON) & (F.col("area_px") > point_area_px)).withColumn("kind", F.lit(POINT))
    both = base.unionByName(points)
    keep = (F.col("kind") != POINT) | (F.col("type_index") == 0) | (F.size("names") > 0)
    return both.where(keep).select("id", "type_index", F.col("type.tag").alias("tag"), F.col("type.value").alias("value"), "kind", "z")


def text_labels(objects: DataFrame, classes: dict[str, list[Rule]], zoom: int) -> DataFrame:
    """K6. (id, name_tag, text, size, color, halo, wrap, order, shield) of names with a text size."""
    named = objects.select("id", "types", "additional", F.explode("names").alias("name_tag", "text")).where("text <> ''")
    first = F.get(F.col("types"), F.lit(0))
    inputs = {
        "tag": first["tag"], "value": first["value"], "zoom": F.lit(zoom), "additional": F.col("additional"),
        "nameTag": F.col("name_tag"), "textLength": F.length("text"),
    }
    made = evaluate(classes.get("text", []), inputs, ["textSize", "textColor", "textHaloRadius", "textWrapWidth", "textOrder", "textShield"])
    # fixed values: defaults of colour, halo, wrap width and order
    out = named.select(
        "id", "name_tag", "text", made["textSize"].cast("double").alias("size"), F.coalesce(colour_value(made["textColor"]), F.lit(0xFF000000)).alias("color"),
        F.coalesce(made["textHaloRadius"].cast("double"), F.lit(0.0)).alias("halo"), F.coalesce(made["textWrapWidth"].cast("int"), F.lit(0)).alias("wrap"),
        F.coalesce(made["textOrder"].cast("int"), F.lit(100)).alias("order"), made["textShield"].alias("shield"),
    )
    return out.where("size > 0")


def colour_value(text: Column) -> Column:
    """#rrggbb or #aarrggbb as a number; without an alpha it is opaque."""
    digits = F.conv(F.substring(text, 2, 8), 16, 10).cast("long")
    return F.when(F.length(text) <= 7, digits.bitwiseOR(F.lit(0xFF000000))).otherwise(digits)


def icon_symbols(prims: DataFrame, classes: dict[str, list[Rule]], zoom: int) -> DataFrame:
    """K7. (id, icon, order) of point primitives with an icon; icons are ordered after texts."""
    inputs = {"tag": F.col("tag"), "value": F.col("value"), "zoom": F.lit(zoom), "additional": F.array().cast("array<string>")}
    made = evaluate(classes.get("point", []), inputs, ["icon", "iconOrder"])
    points = prims.where(F.col("kind") == POINT)
    order = F.coalesce(made["iconOrder"].cast("int"), F.lit(100)) + ICON_ORDER_OFFSET
    return points.select("id", made["icon"].alias("icon"), order.alias("order")).where("icon IS NOT NULL")


def layer_gate(tiles: DataFrame, layers: DataFrame) -> DataFrame:
    """B26. Tiles (zoom, source_layer) with the style layers that draw them: zoom in [min, max)."""
    fits = (F.col("zoom") >= F.col("min_zoom")) & (F.col("zoom") < F.col("max_zoom"))
    return tiles.join(bounded(layers), "source_layer").where(fits)


def render_set(objects: DataFrame, levels: DataFrame, classes: dict[str, list[Rule]], box: tuple[int, int, int, int], zoom: int, density: int = 10) -> dict[str, DataFrame]:
    """K8. What a box at a zoom is drawn from: primitives in draw order, texts and icons.

    Highway lines are thinned by density. The coast lines among them make areas of land and water, and
    a box without any gets a background (`coast_areas`); these are drawn like other objects. objects:
    id, level, types, additional, names, area, pts (structs x, y in 31-bit units), minx, miny, maxx, maxy.
    """
    found = mapobj.map_query(objects, levels, box, zoom).select("id", "types", "additional", "names", "area", "pts")
    frame = objects.sparkSession.createDataFrame([("box", *box)], "tile string, min_x long, min_y long, max_x long, max_y long")
    found = cut_lineage(found.unionByName(coast_areas(found.withColumn("tile", F.lit("box")), frame).drop("tile")))
    found = found.withColumn("area_px", mapobj.ring_area_pixels(F.col("pts"), zoom))
    prims = primitives(found, classes, zoom)
    lines = prims.where((F.col("kind") == LINE) & (F.col("tag") == "highway"))
    winners = mapobj.thin_by_density(lines.select("id", "z").distinct().join(found.select("id", "pts"), "id"), zoom, 1, density)
    thinned = prims.join(lines.select("id", "type_index", F.lit(1).alias("road")), ["id", "type_index"], "left").join(winners.withColumn("won", F.lit(1)), "id", "left")
    thinned = thinned.where("road IS NULL OR won IS NOT NULL").drop("road", "won")
    sized = thinned.join(found.select("id", F.size("pts").alias("n_points")), "id")
    return {"primitives": mapobj.draw_order(sized), "texts": text_labels(found, classes, zoom), "icons": icon_symbols(thinned, classes, zoom)}


def first_by_priority(candidates: DataFrame, key: str, priority: str) -> DataFrame:
    """The row of the smallest priority of each key."""
    w = Window.partitionBy(key).orderBy(priority)
    return candidates.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
