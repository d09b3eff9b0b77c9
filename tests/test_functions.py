"""Scalar functions: round trips, worked values, defined results for odd input."""

import pytest
from pyspark.sql import functions as F

from geoloom.functions import filters, geo, numparse, tags


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_short_code_worked_value(spark):
    assert one(spark, geo.short_code(F.lit(40.59), F.lit(-115.213), 9)) == "TelHTB--"


def test_tag_text_round_trip(spark):
    text = "a~1~b~2~"
    assert one(spark, tags.format_tags(tags.parse_tags(F.lit(text)))) == text
    assert one(spark, tags.parse_tags(F.lit("~a~1~~a~2~odd~"))) == {"a": "1"}
    assert one(spark, tags.parse_tags(F.lit(""))) == {}


def test_generated_ids_round_trip(spark):
    made = geo.generated_id(F.lit(77), F.lit(5), F.lit(1))
    assert one(spark, geo.base_id(made)) == 77 * 2 + 1


@pytest.mark.parametrize(
    ("text", "metres"), [("12'6\"", (12 * 0.3048) + 6 * 0.0254), ("20 ft", 6.096), ("3.5", 3.5), ("abc", -1.0), ("", -1.0), (None, -1.0)]
)
def test_lengths(spark, text, metres):
    assert one(spark, numparse.length_m(F.lit(text).cast("string"), -1.0)) == pytest.approx(metres)


def test_speeds_and_weights(spark):
    assert one(spark, numparse.speed_mps(F.lit("none"), -1.0)) == 40
    assert one(spark, numparse.speed_mps(F.lit("50 mph"), -1.0)) == pytest.approx(50 / 3.6 * 1.6)
    assert one(spark, numparse.weight_t(F.lit("4000 lbs"), -1.0)) == pytest.approx(4000 * 0.4535 / 1000)
    assert one(spark, numparse.as_double(F.lit("1.2.3"), 9.0)) == 9.0


def test_missing_property_in_filters(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "id int, k string")
    ids = lambda f: [r["id"] for r in df.where(filters.compile_filter(f, {"k": F.col("k")})).orderBy("id").collect()]
    assert ids('["!=", "k", "a"]') == [1] and ids('["!in", "k", "a", "b"]') == [1]
    assert ids('["==", "k", "a"]') == [2] and ids("[]") == [1, 2] and ids('["none", ["==", "k", "a"]]') == [1]


def test_zoom_list():
    assert geo.parse_zooms("11;12;13-14;15-") == [(0, 15, 22), (1, 13, 14), (2, 12, 12), (3, 11, 11)]
    with pytest.raises(ValueError, match="one to eight"):
        geo.parse_zooms("")


def test_angles(spark):
    assert one(spark, geo.degrees_diff(F.lit(-170.0), F.lit(170.0))) == pytest.approx(20)
    assert one(spark, geo.degrees_diff(F.lit(180.0), F.lit(0.0))) == pytest.approx(180)
    assert one(spark, geo.rotation_diff(F.lit(0.0), F.lit(180.0))) == pytest.approx(-180)


def test_house_numbers(spark):
    assert tuple(one(spark, tags.house_number(F.lit("12/3"), F.lit("even")))) == ("12", None, "3", -2)
    assert tuple(one(spark, tags.house_number(F.lit("1-9"), F.lit(None).cast("string")))) == ("1", "9", None, 0)


def test_nearest_grows_its_ring(spark):
    from geoloom.operators import places

    p = spark.createDataFrame([(1, 40.0, -5.0)], "id long, lat double, lon double")
    far = spark.createDataFrame([(9, 40.0, -4.0)], "id long, lat double, lon double")
    out = places.closest_candidates(p, far, 13).collect()
    assert [(r["o_id"], r["ring"]) for r in out] == [(9, 24)]
    nowhere = spark.createDataFrame([(9, -40.0, 120.0)], "id long, lat double, lon double")
    assert [(r["o_id"], r["ring"]) for r in places.closest_candidates(p, nowhere, 13).collect()] == [(9, 3072)]
    assert places.closest_candidates(p, nowhere.where("false"), 13).count() == 0
