"""Browse, totals, trending and top list on hand-made catalogues."""

import pytest

from itemlens.plans.browse import browse, browse_total
from itemlens.plans.toplist import build_top_list, cold_start_list
from itemlens.plans.trending import busiest_areas, trending_categories

COLS = (
    "item_id int, item_key string, name string, rating double, total_ratings int, "
    "activity_score double, category string, area string, level string, lat double, lng double"
)


@pytest.fixture()
def cat(spark):
    rows = [
        (1, "k1", "A", 4.7, 20, 10.0, "Café", "Colombo 03", "Budget", None, None),
        (2, "k2", None, None, 50, 99.0, "Café", "Colombo 03", "Free", None, None),
        (3, "k3", "C", 4.3, 11, None, "Indian", "Dehiwala", "Luxury", None, None),
        (4, "k4", "D", 4.7, 20, 5.0, "Restaurant", "Fort", "Unknown", None, None),
        (5, "k5", "E", None, 3, 7.0, "Indian", "Fort", "Moderate", None, None),
        (6, "k6", "F", None, 12, 8.0, "Thai", "Pettah", "Moderate", None, None),
    ]
    return spark.createDataFrame(rows, COLS)


def keys(df):
    return [r.item_key for r in df.orderBy("rank").collect()]


def test_inclusive_min_rating_and_null_drop(spark, cat):
    assert sorted(keys(browse(cat, min_rating=4.7))) == ["k1", "k4"]
    # NULL ratings pass no bound, not even 0 ...
    assert "k2" not in keys(browse(cat, min_rating=0))
    # ... but print as 0.0 when unfiltered
    row = browse(cat).filter("item_key = 'k2'").first()
    assert row.rating == 0.0 and row.name == "Unknown"


def test_injection_text_is_just_a_value(spark, cat):
    assert browse(cat, category="\\' OR true -- ").count() == 0
    assert browse_total(cat, category="' OR '1'='1").first().total == 0


def test_sort_keys_and_tie_break(spark, cat):
    assert keys(browse(cat, sort_by="rating"))[:2] == ["k1", "k4"]
    assert keys(browse(cat, sort_by="popularity"))[0] == "k2"
    assert keys(browse(cat, sort_by="reviews"))[0] == "k2"
    assert keys(browse(cat, sort_by="price")) == ["k2", "k1", "k5", "k6", "k3", "k4"]


def test_filters_conjunction_and_total(spark, cat):
    page = browse(cat, category="Café", area="Colombo 03", limit=1)
    assert page.count() == 1
    assert browse_total(cat, category="Café", area="Colombo 03").first().total == 2
    assert browse_total(cat).first().total == 6


@pytest.mark.parametrize(
    "kw",
    [{"sort_by": "name"}, {"limit": 0}, {"limit": 201}, {"min_rating": 5.5}, {"min_rating": -1}],
)
def test_argument_validation(spark, cat, kw):
    with pytest.raises(ValueError):
        browse(cat, **kw)


def test_trending_and_null_rating_area(spark, cat):
    tc = [(r.category, r.item_count, r.avg_rating) for r in trending_categories(cat).orderBy("rank").collect()]
    assert tc == [("Café", 1, 4.7), ("Indian", 1, 4.3)]
    areas = {r.area: r for r in busiest_areas(cat).collect()}
    assert areas["Pettah"].avg_rating is None and areas["Pettah"].item_count == 1
    assert list(areas) and "Dehiwala" not in areas  # NULL activity is excluded


def test_top_list_threshold_and_order(spark, cat):
    top = build_top_list(cat, min_reviews=10, limit=50).orderBy("rank").collect()
    assert [r.item_id for r in top] == [1, 4, 3, 2, 6]
    assert top[3].rating == 0.0 and top[3].name == "Unknown"


def test_cold_start_list_lower_id_first(spark, cat):
    top = cold_start_list(cat, 3).orderBy("rank").collect()
    assert [r.item_id for r in top] == [1, 4, 3]
    assert top[0].predicted_rating == 4.7
