"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each runs over the whole driver tables (or data Spark derives from them).
Expensive shared inputs (the prepared catalogue, the ratings table, the
labelled train / test split, the fitted bias baseline and ALS model) are
built once per session and directory, written under the shared checkpoint
folder where they are tables, and reused.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemlens import schemas as S
from itemlens.functions import rules as R
from itemlens.functions.labels import classify_contains, classify_tokens, extract_area, level_label
from itemlens.functions.values import base_rating, number_or, round_half_up, text_or, to_double, to_int
from itemlens.operators.dedupe import dedupe_by_key
from itemlens.operators.dense_ids import assign_dense_ids, extend_id_map
from itemlens.operators.factors import topk_dot_product
from itemlens.operators.hot_join import heavy_keys, join_heavy
from itemlens.operators.id_registry import IdRegistry
from itemlens.operators.joins import cold_users, enrich_with_catalog, known_users
from itemlens.operators.predicates import catalog_filter, scored_area, specific_category
from itemlens.plans import als as A
from itemlens.plans.browse import browse, browse_page, browse_total
from itemlens.plans.catalog import default_dedupe_order, id_map, prepare_catalog, write_catalog_table
from itemlens.plans.ratings import (
    cap_per_user,
    fit_bias_baseline,
    interaction_ratings,
    item_base,
    join_base_rating,
    rmse,
    split_labels,
    user_offset,
)
from itemlens.plans.recommend import assemble, recommend, rerank_rounded
from itemlens.plans.train import rating_counts
from itemlens.plans.toplist import build_top_list, cold_start_list
from itemlens.plans.trending import busiest_areas, trending_categories
from itemlens.session import materialize, scratch_path
from itemlens.sources import io as IO
from itemlens.sources import layout as LAY
from itemlens.sources import tables as TB

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the registered queries (chosen for the driver's test data).
RULES = TB.PART_RULES
DEFAULT_CATEGORY = TB.PART_DEFAULT_CATEGORY
DEFAULT_AREA = TB.PART_AREA.default
HOLDOUT_USERS = 0.1
TOP_N = 10
FILTER_CATEGORY = "Widgets"
FILTER_MIN_RATING = 2.6
CONJ_CATEGORY = "General"
CONJ_LEVEL = "Budget"
CONJ_MIN_RATING = 2.5
MIN_REVIEWS_FILTER = 30
FACTOR_K = 10

_cache: dict[tuple, object] = {}


def _key(spark: SparkSession, sf_dir: str, what: str) -> tuple:
    return (spark.sparkContext.applicationId, sf_dir.rstrip("/"), what)


def _memo(spark: SparkSession, sf_dir: str, what: str, build):
    k = _key(spark, sf_dir, what)
    if k not in _cache:
        _cache[k] = build()
    return _cache[k]


def clear_cache() -> None:
    _cache.clear()


# --- shared inputs -------------------------------------------------------------


def raw_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TB.load_catalog(spark, sf_dir)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared catalogue (ids + labels), materialised once per session."""

    def build():
        path = scratch_path(spark, "catalog")
        write_catalog_table(prepare_catalog(raw_catalog(spark, sf_dir), RULES), path)
        return spark.read.parquet(path)

    return _memo(spark, sf_dir, "catalog", build)


def _interaction_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = TB.interaction_partitions(spark, sf_dir)
    return interaction_ratings(TB.load_interactions(spark, sf_dir), id_map(catalog(spark, sf_dir)), partitions=parts)


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings table derived from orders and lines, written once to parquet."""

    def build():
        path = scratch_path(spark, "ratings")
        IO.write_ratings(_interaction_ratings(spark, sf_dir), path)
        return IO.read_ratings(spark, path)

    return _memo(spark, sf_dir, "ratings", build)


def labelled_ratings(spark: SparkSession, sf_dir: str, holdout: float) -> DataFrame:
    """Ratings with their split label, written once, partitioned by label."""

    def build():
        path = scratch_path(spark, "ratings-split")
        labelled = split_labels(ratings(spark, sf_dir), holdout_user_fraction=holdout)
        labelled.write.mode("overwrite").partitionBy("split").parquet(path)
        return spark.read.parquet(path)

    return _memo(spark, sf_dir, f"ratings-split-{holdout}", build)


def train_test(spark: SparkSession, sf_dir: str, holdout: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Training and test rows; each read prunes to its own partition directory.

    All users take part, but for ``holdout`` of them (``HOLDOUT_USERS`` in the
    queries whose feature is users that the model doesn't know).
    """
    labelled = labelled_ratings(spark, sf_dir, holdout)
    cols = ["user_id", "item_id", "rating"]
    train = labelled.filter(F.col("split") == "train").select(*cols)
    test = labelled.filter(F.col("split") == "test").select(*cols)
    return train, test


def trained_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = train_test(spark, sf_dir, HOLDOUT_USERS)
    return train.select("user_id").distinct()


def baseline(spark: SparkSession, sf_dir: str, holdout: float = 0.0):
    """Bias baseline fitted once on the training split."""

    def build():
        train, _ = train_test(spark, sf_dir, holdout)
        return fit_bias_baseline(train)

    return _memo(spark, sf_dir, f"baseline-{holdout}", build)


def model(spark: SparkSession, sf_dir: str, holdout: float = 0.0):
    def build():
        train, _ = train_test(spark, sf_dir, holdout)
        return A.fit_als(train)

    return _memo(spark, sf_dir, f"als-{holdout}", build)


# --- sources and sinks -----------------------------------------------------------


def q_csv_scan_typed(spark, sf_dir):
    path = scratch_path(spark, "catalog-csv")
    IO.write_catalog_csv(raw_catalog(spark, sf_dir), path)
    return IO.read_catalog_csv(spark, path, null_value=IO.CSV_NULL)


def q_csv_rejects(spark, sf_dir):
    """The catalogue as CSV lines of which every seventh part's has lost two fields and
    every eleventh's has one more; the records put aside, by their keys."""
    text = IO.catalog_as_text(raw_catalog(spark, sf_dir))
    number = F.substring_index("item_key", "-", -1).cast("long")
    line = F.to_csv(F.struct(*text.columns))
    line = F.when(number % 7 == 0, F.to_csv(F.struct(*text.columns[:-2]))).when(number % 11 == 0, F.concat(line, F.lit(",more"))).otherwise(line)
    path, rejects = scratch_path(spark, "damaged-csv"), scratch_path(spark, "csv-rejects")
    text.select(line.alias("value")).write.text(path)
    good, n = IO.split_catalog_csv(spark, path, rejects, header=False)
    aside = IO.read_rejects(spark, rejects)
    key = F.substring_index(F.trim("record"), ",", 1).alias("item_key")
    kept = good.agg(F.count(F.lit(1))).scalar()
    return aside.select(key, F.lit(n).cast("long").alias("n_rejects"), kept.alias("n_kept"))


def q_ratings_scan(spark, sf_dir):
    return ratings(spark, sf_dir)


def q_users_relation(spark, sf_dir):
    return TB.load_users(spark, sf_dir)


def q_temp_view_scan(spark, sf_dir):
    catalog(spark, sf_dir).createOrReplaceTempView("itemlens_catalog")
    return spark.sql("SELECT item_id, item_key, category, area, level FROM itemlens_catalog")


def _written_top_list(spark, sf_dir) -> str:
    def build():
        path = scratch_path(spark, "top-list")
        IO.write_top_list(build_top_list(catalog(spark, sf_dir), R.MIN_REVIEWS, R.TOP_LIST_SIZE, DEFAULT_CATEGORY, DEFAULT_AREA), path)
        return path

    return _memo(spark, sf_dir, "top-list-path", build)


def q_json_artefact_roundtrip(spark, sf_dir):
    return IO.read_top_list(spark, _written_top_list(spark, sf_dir))


def q_top_list_prefix(spark, sf_dir):
    return IO.read_top_list(spark, _written_top_list(spark, sf_dir), limit=R.TOP_LIST_READ_DEFAULT)


def q_top_list_array(spark, sf_dir):
    path = scratch_path(spark, "top-list-array")
    top = build_top_list(catalog(spark, sf_dir), R.MIN_REVIEWS, R.TOP_LIST_SIZE, DEFAULT_CATEGORY, DEFAULT_AREA)
    IO.write_top_list_array(top, path, legacy=True)
    return IO.read_top_list(spark, path, array_file=True, legacy=True)


def ratings_layout(spark: SparkSession, sf_dir: str) -> LAY.RatingsLayout:
    """The ratings in buckets by user and by item, written once."""
    return _memo(spark, sf_dir, "ratings-layout", lambda: LAY.write_ratings_layout(ratings(spark, sf_dir), scratch_path(spark, "ratings-layout")))


def q_bucketed_cap(spark, sf_dir):
    return cap_per_user(ratings_layout(spark, sf_dir).by_user)


def q_bucketed_offset(spark, sf_dir):
    return user_offset(ratings_layout(spark, sf_dir).by_item, catalog(spark, sf_dir))


# --- projections and derived columns -----------------------------------------------


def q_cast_tolerant(spark, sf_dir):
    ev = TB.read_table(spark, sf_dir, "events")
    return ev.select(
        "event_id",
        to_int(F.regexp_extract("props", r'"k":\s*([^,}]*)', 1)).alias("k_int"),
        to_int(F.col("value").cast("string")).alias("value_int"),
        to_double(F.col("value").cast("string")).alias("value_double"),
        to_int("event_type").alias("type_int"),
    )


def q_project_pruned(spark, sf_dir):
    return catalog(spark, sf_dir).select("item_id", "item_key", "name", "rating", "total_ratings")


def q_project_rename(spark, sf_dir):
    return catalog(spark, sf_dir).select(
        F.col("item_key").alias("item_ref"),
        F.col("name").alias("title"),
        F.col("activity_score").alias("popularity"),
    )


def q_null_defaults(spark, sf_dir):
    docs = TB.read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    labels = TB.read_table(spark, sf_dir, "labels")
    joined = docs.join(labels, "doc_id", "left")
    return joined.select(
        "doc_id",
        text_or("lang", "unknown").alias("lang"),
        text_or("source", "unknown").alias("source"),
        number_or("quality", 0).alias("quality"),
        number_or("toxic", 0).alias("toxic"),
    )


def q_rounded_projection(spark, sf_dir):
    return catalog(spark, sf_dir).select(
        "item_id",
        round_half_up(number_or("rating", 0.0), 2).alias("rating_2dp"),
        round_half_up(number_or("activity_score", 0.0), 1).alias("activity_1dp"),
        round_half_up(F.col("activity_score") / F.col("total_ratings"), 4).alias("per_review_4dp"),
    )


def q_classify_contains(spark, sf_dir):
    return raw_catalog(spark, sf_dir).select(
        "item_key", classify_contains("types", TB.PART_CONTAINS_RULES, DEFAULT_CATEGORY).alias("category")
    )


def q_classify_tokens(spark, sf_dir):
    return raw_catalog(spark, sf_dir).select(
        "item_key", classify_tokens("types", TB.PART_TOKEN_RULES, DEFAULT_CATEGORY).alias("category")
    )


def q_area_lpad2(spark, sf_dir):
    return TB.read_table(spark, sf_dir, "pages").select("page_id", extract_area("url", TB.PAGE_AREA_LPAD2).alias("area"))


def q_area_intpad_named(spark, sf_dir):
    return TB.read_table(spark, sf_dir, "pages").select("page_id", extract_area("url", TB.PAGE_AREA_NAMED).alias("area"))


def q_level_label_serving(spark, sf_dir):
    return raw_catalog(spark, sf_dir).select(
        "item_key", "price_level", level_label("price_level", R.LEVEL_LABELS_SERVING).alias("level")
    )


def q_level_label_artefact(spark, sf_dir):
    return raw_catalog(spark, sf_dir).select(
        "item_key", "price_level", level_label("price_level", R.LEVEL_LABELS_ARTEFACT).alias("level")
    )


def q_output_contract(spark, sf_dir):
    cat = catalog(spark, sf_dir)
    rows = cat.select(
        F.col("item_id").alias("rank"),
        "item_key",
        text_or("name", R.DEFAULT_NAME).alias("name"),
        text_or("category", DEFAULT_CATEGORY).alias("category"),
        text_or("area", DEFAULT_AREA).alias("area"),
        text_or("level", R.UNKNOWN_LEVEL).alias("level"),
        round_half_up(number_or("rating", 0.0), 2).alias("rating"),
        number_or("total_ratings", 0).alias("total_ratings"),
        round_half_up(number_or("activity_score", 0.0), 1).alias("activity_score"),
        F.lit("dropped by the contract").alias("extra"),
    )
    return S.conform(rows, S.BROWSE_SCHEMA)


def q_base_rating_default(spark, sf_dir):
    return catalog(spark, sf_dir).select("item_id", base_rating("rating").alias("base_rating"))


# --- filters -----------------------------------------------------------------


def q_filter_equality(spark, sf_dir):
    return catalog(spark, sf_dir).filter(catalog_filter(category=FILTER_CATEGORY)).select("item_id", "category")


def q_filter_min_rating(spark, sf_dir):
    return catalog(spark, sf_dir).filter(catalog_filter(min_rating=FILTER_MIN_RATING)).select("item_id", "rating")


def q_filter_conjunction(spark, sf_dir):
    pred = catalog_filter(category=CONJ_CATEGORY, level=CONJ_LEVEL, min_rating=CONJ_MIN_RATING)
    return catalog(spark, sf_dir).filter(pred).select("item_id", "category", "level", "rating")


def q_filter_clustered(spark, sf_dir):
    """The conjunction over the catalogue in files clustered by its labels."""

    def build():
        path = scratch_path(spark, "catalog-clustered")
        LAY.write_clustered_catalog(catalog(spark, sf_dir), path)
        return path

    cat = spark.read.parquet(_memo(spark, sf_dir, "catalog-clustered", build))
    pred = catalog_filter(category=CONJ_CATEGORY, level=CONJ_LEVEL, min_rating=CONJ_MIN_RATING)
    return cat.filter(pred).select("item_id", "category", "level", "rating")


def q_filter_min_reviews(spark, sf_dir):
    return catalog(spark, sf_dir).filter(F.col("total_ratings") >= MIN_REVIEWS_FILTER).select("item_id", "total_ratings")


def q_filter_specific_category(spark, sf_dir):
    return catalog(spark, sf_dir).filter(specific_category(DEFAULT_CATEGORY)).select("item_id", "category", "rating")


def q_filter_scored_area(spark, sf_dir):
    return catalog(spark, sf_dir).filter(scored_area()).select("item_id", "area", "activity_score")


# --- joins ---------------------------------------------------------------------


def q_enrich_left_join(spark, sf_dir):
    return enrich_with_catalog(
        ratings(spark, sf_dir), catalog(spark, sf_dir), default_category=DEFAULT_CATEGORY, default_area=DEFAULT_AREA
    )


def hot_lines(spark, sf_dir):
    """Order lines as scored rows; those of every third order are of one item."""
    lines = TB.read_table(spark, sf_dir, "lineitem")
    part = F.when(F.col("l_orderkey") % 3 == 0, F.lit(1)).otherwise(F.col("l_partkey"))
    rows = lines.select("l_orderkey", "l_linenumber", F.concat(F.lit("P-"), part.cast("string")).alias("item_key"))
    ids = id_map(catalog(spark, sf_dir)).select(F.col("item_key").alias("_key"), "item_id")
    return join_heavy(rows, ids, "item_key", "_key", "left").drop("_key")


def q_hot_item_enrich(spark, sf_dir):
    """Every line with its item's metadata and base rating, an item with a third of them spread."""
    cat = catalog(spark, sf_dir)
    rows = materialize(hot_lines(spark, sf_dir), "hot-lines")
    heavy = heavy_keys(rows, "item_id")
    base = item_base(cat).withColumnRenamed("item_id", "_item")
    rated = join_heavy(rows, base, "item_id", "_item", "left", heavy=heavy).drop("_item")
    return enrich_with_catalog(rated, cat, default_category=DEFAULT_CATEGORY, default_area=DEFAULT_AREA, spread_heavy=True)


def q_join_base_rating(spark, sf_dir):
    return join_base_rating(ratings(spark, sf_dir), catalog(spark, sf_dir))


def q_semi_known_users(spark, sf_dir):
    return known_users(TB.load_users(spark, sf_dir), trained_users(spark, sf_dir))


def q_anti_cold_users(spark, sf_dir):
    return cold_users(TB.load_users(spark, sf_dir), trained_users(spark, sf_dir))


def q_factor_topk_per_user(spark, sf_dir):
    emb = TB.read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    top = topk_dot_product(
        emb, emb, FACTOR_K, "vec_id", "embedding", "vec_id", "embedding", exclude_same_id=True
    )
    return top.select("query_id", "item_id", "rank", round_half_up("score", 4).alias("score"))


# --- aggregations ------------------------------------------------------------------


def q_trending_categories(spark, sf_dir):
    return trending_categories(catalog(spark, sf_dir), R.TRENDING_K, DEFAULT_CATEGORY)


def q_busiest_areas(spark, sf_dir):
    return busiest_areas(catalog(spark, sf_dir), R.TRENDING_K)


def q_browse_total(spark, sf_dir):
    return browse_total(catalog(spark, sf_dir), category=CONJ_CATEGORY, min_rating=CONJ_MIN_RATING)


def q_browse_page_total(spark, sf_dir):
    page = browse_page(
        catalog(spark, sf_dir),
        category=CONJ_CATEGORY,
        min_rating=CONJ_MIN_RATING,
        sort_by="reviews",
        default_category=DEFAULT_CATEGORY,
        default_area=DEFAULT_AREA,
    )
    return page.select("total", F.inline_outer("page"))


def q_dedupe_by_key(spark, sf_dir):
    docs = TB.read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    kept = dedupe_by_key(docs, ["text"], [F.col("doc_id")])
    return kept.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


def lines_as_listings(spark, sf_dir):
    """Listings with many rows per key: one per order line, keyed by part.

    Parts of every tenth supplier have no key; rows of one key differ in any
    of the columns that the survivor order names.
    """
    lines = TB.read_table(spark, sf_dir, "lineitem")
    part, line = F.col("l_partkey").cast("string"), F.col("l_linenumber")
    return lines.select(
        F.when(F.col("l_suppkey") % 10 != 0, F.concat(F.lit("P-"), part)).alias("item_key"),
        F.when(line % 3 != 0, F.col("l_returnflag")).alias("name"),
        F.col("l_linestatus").alias("address"),
        F.col("l_tax").alias("lat"),
        F.col("l_discount").alias("lng"),
        (F.col("l_quantity") / F.lit(10.0)).alias("rating"),
        F.when(line % 4 != 0, line % 2).cast("int").alias("total_ratings"),
        (line % 3).cast("int").alias("price_level"),
        F.lit("gizmo").alias("types"),
        F.col("l_extendedprice").alias("activity_score"),
    )


def q_catalog_dedupe(spark, sf_dir):
    return dedupe_by_key(lines_as_listings(spark, sf_dir), ["item_key"], default_dedupe_order())


def q_extend_ids(spark, sf_dir):
    """Ids of the customers of open orders stay; all other customers' follow.  Customers
    whose key ends in 0 are one customer without a key, which both sides have."""
    orders = TB.read_table(spark, sf_dir, "orders")
    key = F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("user_key")
    old = assign_dense_ids(orders.where("o_orderstatus = 'O'").select(key).distinct(), ["user_key"], "user_id")
    return extend_id_map(materialize(old, "old-ids"), orders.select(key), "user_key", "user_id")


def q_id_registry(spark, sf_dir):
    """Customers register three times, as those of finished, open and pending orders; many
    leave and return.  Customers whose key ends in 0 are one customer without a key."""
    orders = TB.read_table(spark, sf_dir, "orders")
    key = F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("user_key")
    registry = IdRegistry(spark, scratch_path(spark, "id-registry"), "user_key", "user_id", T.LongType())
    for status in ("F", "O", "P"):
        registry.register(orders.where(F.col("o_orderstatus") == status).select(key))
    return registry.read()


def q_rmse_bias_baseline(spark, sf_dir):
    _, test = train_test(spark, sf_dir)
    return rmse(baseline(spark, sf_dir).predict(test))


def q_run_counts(spark, sf_dir):
    cat = catalog(spark, sf_dir)
    rt = ratings(spark, sf_dir)
    stats = rating_counts(rt).withColumnRenamed("n_items", "n_items_rated")
    return stats.select("*", cat.agg(F.count(F.lit(1))).scalar().alias("n_catalog"))


# --- windows, sorts, limits ---------------------------------------------------------


def q_dense_ids(spark, sf_dir):
    return catalog(spark, sf_dir).select("item_key", "item_id")


def q_sort_by_key(spark, sf_dir):
    rt = ratings(spark, sf_dir)
    return assign_dense_ids(rt, ["user_id", "item_id"], "position").select("position", "user_id", "item_id")


def q_top_list_build(spark, sf_dir):
    return build_top_list(catalog(spark, sf_dir), R.MIN_REVIEWS, R.TOP_LIST_SIZE, DEFAULT_CATEGORY, DEFAULT_AREA)


def _browse(sort_by):
    def q(spark, sf_dir):
        return browse(
            catalog(spark, sf_dir),
            sort_by=sort_by,
            limit=R.BROWSE_DEFAULT_LIMIT,
            default_category=DEFAULT_CATEGORY,
            default_area=DEFAULT_AREA,
        )

    return q


def q_cold_start_topn(spark, sf_dir):
    return cold_start_list(catalog(spark, sf_dir), TOP_N, DEFAULT_CATEGORY, DEFAULT_AREA)


def q_rerank_rounded(spark, sf_dir):
    _, test = train_test(spark, sf_dir)
    scored = baseline(spark, sf_dir).predict(test).select("user_id", "item_id", F.col("prediction").alias("score"))
    return rerank_rounded(scored, TOP_N).select("user_id", "rank", "item_id", round_half_up("score", 4).alias("score"))


# --- set operation: warm + cold ------------------------------------------------------


def q_warm_cold_union(spark, sf_dir):
    users = TB.load_users(spark, sf_dir)
    base = baseline(spark, sf_dir, HOLDOUT_USERS)
    scores = base.warm_scores(users, TOP_N)
    return assemble(users, trained_users(spark, sf_dir), scores, catalog(spark, sf_dir), TOP_N, DEFAULT_CATEGORY, DEFAULT_AREA)


# --- ratings -------------------------------------------------------------------------


def q_interaction_ratings(spark, sf_dir):
    return _interaction_ratings(spark, sf_dir)


def q_cap_per_user(spark, sf_dir):
    return cap_per_user(ratings(spark, sf_dir))


def q_user_offset(spark, sf_dir):
    return user_offset(ratings(spark, sf_dir), catalog(spark, sf_dir))


def q_hash_split(spark, sf_dir):
    return split_labels(ratings(spark, sf_dir), holdout_user_fraction=HOLDOUT_USERS).select(
        "user_id", "item_id", "split"
    )


def q_prepare_catalog(spark, sf_dir):
    return catalog(spark, sf_dir)


def q_prepare_catalog_serving(spark, sf_dir):
    return prepare_catalog(raw_catalog(spark, sf_dir), TB.PART_SERVING_RULES)


# --- model -----------------------------------------------------------------------------
# Factors and scores are floating-point results of an iterative fit, which SQL has no
# form for: the queries return what of them the tables alone determine, and the tests
# hold the values against invariants.


def q_als_fit_predict(spark, sf_dir):
    _, test = train_test(spark, sf_dir)
    scored = A.predict(model(spark, sf_dir), test)
    finite = ~F.isnan("prediction") & (F.abs("prediction") < float("inf"))
    return scored.select("user_id", "item_id", "rating", finite.alias("finite"))


def q_als_eval(spark, sf_dir):
    _, test = train_test(spark, sf_dir)
    scored = A.evaluate(model(spark, sf_dir), test)
    return scored.select("n_scored", F.col("rmse").between(0.0, 4.5).alias("rmse_in_range"))


def q_als_recommend_subset(spark, sf_dir):
    top = A.recommend_known(model(spark, sf_dir, HOLDOUT_USERS), TB.load_users(spark, sf_dir), TOP_N)
    # Along the ranks, no score may rise (as displayed).
    before = F.lag(round_half_up("score", 4)).over(Window.partitionBy("user_id").orderBy("rank"))
    falls = F.coalesce(round_half_up("score", 4) <= before, F.lit(True))
    return top.select("user_id", "rank", falls.alias("in_order"), F.col("item_id").isNotNull().alias("has_item"))


def q_als_save_load(spark, sf_dir):
    path = scratch_path(spark, "als-model")
    fitted = model(spark, sf_dir)
    IO.save_model(fitted, path)
    loaded = IO.load_model(path).itemFactors.withColumnRenamed("features", "loaded")
    both = fitted.itemFactors.join(loaded, "id", "full")
    usable = F.forall("features", lambda x: (x >= 0) & ~F.isnan(x) & (x < float("inf"))) & (F.size("features") == R.ALS_RANK)
    return both.select(
        F.col("id").alias("item_id"), F.col("features").eqNullSafe(F.col("loaded")).alias("same_factors"), usable.alias("nonnegative")
    )


def q_recommend_with_fallback(spark, sf_dir):
    users = TB.load_users(spark, sf_dir)
    known = model(spark, sf_dir, HOLDOUT_USERS)
    rows = recommend(users, known, catalog(spark, sf_dir), TOP_N, DEFAULT_CATEGORY, DEFAULT_AREA)
    key = ["user_id", "is_cold_start", "rank"]
    return rows.select(*key, *[F.when(F.col("is_cold_start"), F.col(c)).alias(c) for c in rows.columns if c not in key])


def q_train_pipeline(spark, sf_dir):
    from itemlens.plans.train import TrainConfig, train

    result = train(
        spark,
        raw_catalog(spark, sf_dir),
        TB.load_interactions(spark, sf_dir),
        RULES,
        TrainConfig(),
        model_path=scratch_path(spark, "pipeline-model"),
        top_list_path=scratch_path(spark, "pipeline-top-list"),
        ratings_path=scratch_path(spark, "pipeline-ratings"),
        partitions=TB.interaction_partitions(spark, sf_dir),
    )
    return result.metrics.select("n_test_scored", "n_ratings", "n_users", "n_items")


QUERIES: dict[str, Query] = {
    # sources / sinks
    "csv_scan_typed": q_csv_scan_typed,
    "csv_rejects": q_csv_rejects,
    "ratings_scan": q_ratings_scan,
    "users_relation": q_users_relation,
    "temp_view_scan": q_temp_view_scan,
    "json_artefact_roundtrip": q_json_artefact_roundtrip,
    "top_list_prefix": q_top_list_prefix,
    "top_list_array": q_top_list_array,
    "bucketed_cap": q_bucketed_cap,
    "bucketed_offset": q_bucketed_offset,
    # projections
    "cast_tolerant": q_cast_tolerant,
    "project_pruned": q_project_pruned,
    "project_rename": q_project_rename,
    "null_defaults": q_null_defaults,
    "rounded_projection": q_rounded_projection,
    "classify_contains": q_classify_contains,
    "classify_tokens": q_classify_tokens,
    "area_lpad2": q_area_lpad2,
    "area_intpad_named": q_area_intpad_named,
    "level_label_serving": q_level_label_serving,
    "level_label_artefact": q_level_label_artefact,
    "output_contract": q_output_contract,
    "base_rating_default": q_base_rating_default,
    # filters
    "filter_equality": q_filter_equality,
    "filter_min_rating": q_filter_min_rating,
    "filter_conjunction": q_filter_conjunction,
    "filter_clustered": q_filter_clustered,
    "filter_min_reviews": q_filter_min_reviews,
    "filter_specific_category": q_filter_specific_category,
    "filter_scored_area": q_filter_scored_area,
    # joins
    "enrich_left_join": q_enrich_left_join,
    "hot_item_enrich": q_hot_item_enrich,
    "join_base_rating": q_join_base_rating,
    "semi_known_users": q_semi_known_users,
    "anti_cold_users": q_anti_cold_users,
    "factor_topk_per_user": q_factor_topk_per_user,
    # aggregations
    "trending_categories": q_trending_categories,
    "busiest_areas": q_busiest_areas,
    "browse_total": q_browse_total,
    "browse_page_total": q_browse_page_total,
    "dedupe_by_key": q_dedupe_by_key,
    "catalog_dedupe": q_catalog_dedupe,
    "extend_ids": q_extend_ids,
    "id_registry": q_id_registry,
    "rmse_bias_baseline": q_rmse_bias_baseline,
    "run_counts": q_run_counts,
    # windows / sorts / limits
    "dense_ids": q_dense_ids,
    "sort_by_key": q_sort_by_key,
    "top_list_build": q_top_list_build,
    "browse_by_rating": _browse("rating"),
    "browse_by_popularity": _browse("popularity"),
    "browse_by_reviews": _browse("reviews"),
    "browse_by_price": _browse("price"),
    "cold_start_topn": q_cold_start_topn,
    "rerank_rounded": q_rerank_rounded,
    # set operation
    "warm_cold_union": q_warm_cold_union,
    # ratings
    "interaction_ratings": q_interaction_ratings,
    "cap_per_user": q_cap_per_user,
    "user_offset": q_user_offset,
    "hash_split": q_hash_split,
    # composite
    "prepare_catalog": q_prepare_catalog,
    "prepare_catalog_serving": q_prepare_catalog_serving,
    # model
    "als_fit_predict": q_als_fit_predict,
    "als_eval": q_als_eval,
    "als_recommend_subset": q_als_recommend_subset,
    "als_save_load": q_als_save_load,
    "recommend_with_fallback": q_recommend_with_fallback,
    "train_pipeline": q_train_pipeline,
}
