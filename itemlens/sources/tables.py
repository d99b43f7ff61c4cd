"""Driver tables and the recipes that map them onto catalogue and ratings.

The driver ships TPC-H-shaped parquet tables.  They become:

* catalogue: one row per ``part``, statistics from its ``lineitem`` rows
  (rating = mean quantity / 10, review count = line count, activity =
  summed quantity, level from the retail price band);
* interactions: ``orders`` joined to ``lineitem`` -> (customer, part,
  quantity / 10), one row per line;
* areas: brand numbers for parts, URL numbers / hosts for ``pages``.

The rule sets below are parameters for this data (the category rules for the
original domain never match TPC-H vocabulary).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemlens.functions.rules import LEVEL_LABELS_ARTEFACT, LEVEL_LABELS_SERVING, AreaRules, RuleSet
from itemlens.functions.values import round_half_up, to_int_id
from itemlens.session import partitions_for

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Rule sets for the TPC-H-shaped test data.
PART_TOKEN_RULES = (
    ("promo", "Promotional"),
    ("gizmo", "Gizmos"),
    ("widget", "Widgets"),
    ("red", "Red Range"),
    ("large", "Large Goods"),
)
PART_CONTAINS_RULES = (
    ("widget", "Widgets"),
    ("PROMO", "Promotional"),
    ("red", "Red Range"),
    ("ring", "Rings"),
    ("LARGE", "Large Goods"),
    ("bolt", "Bolts"),
)
PART_DEFAULT_CATEGORY = "General"
PART_AREA = AreaRules(pattern=r"(?i)Brand#(\d+)", prefix="Brand ", named=(), default="No Brand")
PART_RULES = RuleSet(
    category_mode="tokens",
    token_rules=PART_TOKEN_RULES,
    contains_rules=PART_CONTAINS_RULES,
    default_category=PART_DEFAULT_CATEGORY,
    area=PART_AREA,
    level_labels=dict(LEVEL_LABELS_ARTEFACT),
)
# The serving flavour: substring categories, two-character areas, serving vocabulary.
PART_SERVING_RULES = RuleSet(
    category_mode="contains",
    token_rules=PART_TOKEN_RULES,
    contains_rules=PART_CONTAINS_RULES,
    default_category=PART_DEFAULT_CATEGORY,
    area=AreaRules(pattern=r"(?i)Brand#(\d+)", prefix="Brand ", named=(), default="No Brand", mode="lpad2"),
    level_labels=dict(LEVEL_LABELS_SERVING),
)
PAGE_AREA_NAMED = AreaRules(
    pattern=r"(?i)/en/(\d+)",
    prefix="Page ",
    named=("spam-farm", "cheap-pills", "blog.", "www."),
    default="Other",
    mode="intpad",
)
PAGE_AREA_LPAD2 = AreaRules(pattern=r"/(\d+)", prefix="Page ", named=(), default="Other", mode="lpad2")


def catalog_from_parts(part: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Typed raw catalogue: one row per part with per-part line statistics.

    Lines are aggregated per part first (map-side partial aggregation keeps
    a hot part cheap), then joined to ``part`` on the key.
    """
    stats = lineitem.groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("l_quantity").alias("qty_sum"),
    )
    joined = part.join(stats, part["p_partkey"] == stats["l_partkey"], "left")
    return joined.select(
        F.concat(F.lit("P-"), F.col("p_partkey").cast("string")).alias("item_key"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("address"),
        F.lit(None).cast("double").alias("lat"),
        F.lit(None).cast("double").alias("lng"),
        round_half_up(F.col("qty_sum") / F.col("n_lines") / F.lit(10.0), 1).alias("rating"),
        F.col("n_lines").cast("int").alias("total_ratings"),
        F.when(F.col("p_size") >= 5, F.floor((F.col("p_retailprice") - 900) / 20))
        .cast("int")
        .alias("price_level"),
        F.concat(F.col("p_type"), F.lit(", "), F.regexp_replace("p_name", " ", ", ")).alias("types"),
        F.col("qty_sum").alias("activity_score"),
    )


def load_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_from_parts(read_table(spark, sf_dir, "part"), read_table(spark, sf_dir, "lineitem"))


def interactions_from_orders(orders: DataFrame, lineitem: DataFrame, wide_user_keys: bool = False) -> DataFrame:
    """One interaction per order line: (user_id, item_key, value = quantity / 10).

    An inner equi-join on the order key; a hot order key is split by AQE's
    skew-join handling rather than landing in one task.

    ALS needs int user ids.  By default the customer key is converted with a
    checked cast that fails loudly on overflow; with ``wide_user_keys=True`` the 64-bit
    key is kept as ``user_key`` for ``operators.dense_ids.index_keys`` (the
    training pipeline does this when it sees ``user_key``).
    """
    lines = lineitem.select("l_orderkey", "l_partkey", "l_quantity")
    heads = orders.select("o_orderkey", "o_custkey")
    user = (
        F.col("o_custkey").alias("user_key") if wide_user_keys else to_int_id("o_custkey", "user key").alias("user_id")
    )
    return lines.join(heads, lines["l_orderkey"] == heads["o_orderkey"], "inner").select(
        user,
        F.concat(F.lit("P-"), F.col("l_partkey").cast("string")).alias("item_key"),
        (F.col("l_quantity") / F.lit(10.0)).alias("value"),
    )


def load_interactions(spark: SparkSession, sf_dir: str, wide_user_keys: bool = False) -> DataFrame:
    return interactions_from_orders(
        read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem"), wide_user_keys
    )


def interaction_partitions(spark: SparkSession, sf_dir: str) -> int | None:
    """Partitions by which the interactions (one per line; counted by the files' footers)
    fit their tasks; None if they fit one."""
    return partitions_for(spark, read_table(spark, sf_dir, "lineitem").count())


def load_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users to serve: every customer (a relation, deduplicated)."""
    return read_table(spark, sf_dir, "customer").select(to_int_id("c_custkey", "user key").alias("user_id")).distinct()
