"""Declared schemas for inputs and outputs."""

from __future__ import annotations

from pyspark.sql import types as T

# Raw catalogue columns as they sit in a CSV (every field is text on disk).
CATALOG_TEXT_FIELDS = (
    "item_key",
    "name",
    "address",
    "lat",
    "lng",
    "rating",
    "total_ratings",
    "price_level",
    "types",
    "activity_score",
)

# The original catalogue CSV's column names that differ from
# this library's (all other columns share their names).
LEGACY_CATALOG_FIELDS: dict[str, str] = {
    "place_id": "item_key",
    "busyness_score": "activity_score",
}

# Typed raw catalogue.
CATALOG_SCHEMA = T.StructType(
    [
        T.StructField("item_key", T.StringType(), True),
        T.StructField("name", T.StringType(), True),
        T.StructField("address", T.StringType(), True),
        T.StructField("lat", T.DoubleType(), True),
        T.StructField("lng", T.DoubleType(), True),
        T.StructField("rating", T.DoubleType(), True),
        T.StructField("total_ratings", T.IntegerType(), True),
        T.StructField("price_level", T.IntegerType(), True),
        T.StructField("types", T.StringType(), True),
        T.StructField("activity_score", T.DoubleType(), True),
    ]
)

# Ratings triples.
RATINGS_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.IntegerType(), True),
        T.StructField("item_id", T.IntegerType(), True),
        T.StructField("rating", T.DoubleType(), True),
    ]
)

# Ranked top list (the stored artefact).
TOP_LIST_SCHEMA = T.StructType(
    [
        T.StructField("rank", T.IntegerType(), False),
        T.StructField("item_id", T.IntegerType(), True),
        T.StructField("name", T.StringType(), True),
        T.StructField("category", T.StringType(), True),
        T.StructField("area", T.StringType(), True),
        T.StructField("level", T.StringType(), True),
        T.StructField("rating", T.DoubleType(), True),
        T.StructField("total_ratings", T.IntegerType(), True),
        T.StructField("activity_score", T.DoubleType(), True),
        T.StructField("lat", T.DoubleType(), True),
        T.StructField("lng", T.DoubleType(), True),
    ]
)

# Field names of the original service's top-list JSON array,
# mapped to this library's names (read with ``read_top_list(..., legacy=True)``).
LEGACY_TOP_LIST_FIELDS: dict[str, str] = {
    "restaurantId": "item_id",
    "name": "name",
    "cuisine": "category",
    "location": "area",
    "price_range": "level",
    "rating": "rating",
    "total_ratings": "total_ratings",
    "busyness_score": "activity_score",
    "lat": "lat",
    "lng": "lng",
}

# One browse row.
BROWSE_SCHEMA = T.StructType(
    [
        T.StructField("rank", T.IntegerType(), False),
        T.StructField("item_key", T.StringType(), True),
        T.StructField("name", T.StringType(), True),
        T.StructField("category", T.StringType(), True),
        T.StructField("area", T.StringType(), True),
        T.StructField("level", T.StringType(), True),
        T.StructField("rating", T.DoubleType(), True),
        T.StructField("total_ratings", T.IntegerType(), True),
        T.StructField("activity_score", T.DoubleType(), True),
    ]
)

# One recommendation row (flat: one row per user and rank).
RECOMMENDATION_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.IntegerType(), True),
        T.StructField("is_cold_start", T.BooleanType(), False),
        T.StructField("rank", T.IntegerType(), False),
        T.StructField("item_id", T.IntegerType(), True),
        T.StructField("name", T.StringType(), True),
        T.StructField("category", T.StringType(), True),
        T.StructField("area", T.StringType(), True),
        T.StructField("level", T.StringType(), True),
        T.StructField("predicted_rating", T.DoubleType(), True),
        T.StructField("activity_score", T.DoubleType(), True),
    ]
)


def conform(df, schema: T.StructType):
    """Select exactly ``schema``'s fields, cast to their declared types.

    Extra columns are dropped (as response models drop unknown fields);
    a missing column is an error.
    """
    from pyspark.sql import functions as F

    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing output columns: {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
