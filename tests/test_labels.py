"""Edge rows for label derivation, casts and defaults."""

import pytest
from pyspark.sql import functions as F

from itemlens.functions import rules as R
from itemlens.functions.labels import classify_contains, classify_tokens, extract_area, level_label, level_rank
from itemlens.functions.values import base_rating, round_half_up, text_or, to_double, to_int


def one_col(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


@pytest.mark.parametrize(
    "types, token, substring",
    [
        ("cafe,indian_restaurant", "Café", "Indian"),
        ("barbecue_restaurant", "Restaurant", "Bar & Grill"),
        (" Cafe , BAR", "Café", "Restaurant"),
        (None, "Restaurant", "Restaurant"),
        ("", "Restaurant", "Restaurant"),
        ("meal_takeaway,bakery", "Takeaway", "Bakery"),
    ],
)
def test_category_modes(spark, types, token, substring):
    assert one_col(spark, [types], classify_tokens) == [token]
    assert one_col(spark, [types], classify_contains) == [substring]


@pytest.mark.parametrize(
    "address, intpad, lpad2",
    [
        ("x, colombo  3", "Colombo 03", "Colombo 03"),
        ("x, Colombo 400", "Colombo 400", "Colombo 40"),
        ("Colombo 00500", "Colombo 500", "Colombo 00"),
        ("Colombo 99999999999", "Colombo 99999999999", "Colombo 99"),
        ("Colombo 0", "Colombo 00", "Colombo 00"),
        (None, "Colombo", "Colombo"),
        ("", "Colombo", "Colombo"),
        ("Dehiwala-Mount Lavinia", "Dehiwala", "Colombo"),
        ("12 Galle Rd, MOUNT LAVINIA", "Mount Lavinia", "Colombo"),
    ],
)
def test_area_modes(spark, address, intpad, lpad2):
    assert one_col(spark, [address], lambda c: extract_area(c, R.AreaRules())) == [intpad]
    lp = R.AreaRules(named=(), mode="lpad2")
    assert one_col(spark, [address], lambda c: extract_area(c, lp)) == [lpad2]


def test_level_vocabularies(spark):
    vals = [0, 4, 9, None]
    serving = one_col(spark, vals, lambda c: level_label(c, R.LEVEL_LABELS_SERVING), "int")
    artefact = one_col(spark, vals, lambda c: level_label(c, R.LEVEL_LABELS_ARTEFACT), "int")
    assert serving == ["Budget", "Very Expensive", "Unknown", "Unknown"]
    assert artefact == ["Free", "Luxury", "Unknown", "Unknown"]
    ranks = one_col(spark, ["Free", "Luxury", "Unknown", "Very Expensive"], lambda c: level_rank(c))
    assert ranks == [0, 4, 5, 5]


def test_tolerant_casts(spark):
    assert one_col(spark, ["12.0", "abc", "", None, "12.7", "-3.9", "1e20"], to_int) == [
        12, None, None, None, 12, -3, None
    ]
    assert one_col(spark, ["4.7", "x", " 2 "], to_double) == [4.7, None, 2.0]


def test_defaults_and_base_rating(spark):
    assert one_col(spark, [None, "", "A"], lambda c: text_or(c, "Unknown")) == ["Unknown", "Unknown", "A"]
    assert one_col(spark, [None, 0.0, 4.2], base_rating, "double") == [3.0, 3.0, 4.2]


def test_round_half_up_through_decimal(spark):
    assert one_col(spark, [2.675, 2.665, 1.005, None], lambda c: round_half_up(c, 2), "double") == [
        2.68, 2.67, 1.01, None
    ]


def test_rule_tables_are_complete():
    assert len(R.TOKEN_CATEGORY_RULES) == 29
    assert len(R.CONTAINS_CATEGORY_RULES) == 19
    assert len(R.NAMED_AREAS) == 11
    assert R.NAMED_AREAS.index("Dehiwala") < R.NAMED_AREAS.index("Mount Lavinia")


def test_int_id_checked_cast(spark):
    from itemlens.functions.values import to_int_id

    ok = spark.createDataFrame([(5,), (None,), (2**31 - 1,)], "k long").select(to_int_id("k").alias("i"))
    assert [r.i for r in ok.collect()] == [5, None, 2**31 - 1]
    assert ok.schema["i"].dataType.typeName() == "integer"
    bad = spark.createDataFrame([(2**31,)], "k long").select(to_int_id("k", "user key").alias("i"))
    with pytest.raises(Exception, match="user key out of int range"):
        bad.collect()
