"""Catalogue preparation: dedupe, stable ids, derived labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemlens.functions import rules as R
from itemlens.functions.labels import classify_contains, classify_tokens, extract_area, level_label
from itemlens.operators.dedupe import dedupe_by_key
from itemlens.operators.dense_ids import assign_dense_ids, extend_id_map, join_ids
from itemlens.session import materialize

def default_dedupe_order() -> list[Column]:
    """Survivor order for duplicate keys: most reviews first (NULL counts
    last), then by every other column, so that rows that differ at all have
    one order and the pick is the same on every run."""
    return [
        F.col("total_ratings").isNull(),
        -F.col("total_ratings"),
        F.col("name"),
        F.col("address"),
        F.col("types"),
        F.col("rating"),
        F.col("price_level"),
        F.col("activity_score"),
        F.col("lat"),
        F.col("lng"),
    ]


def category_column(rules: R.RuleSet = R.ARTEFACT_RULES, text: str = "types") -> Column:
    if rules.category_mode == "tokens":
        return classify_tokens(text, rules.token_rules, rules.default_category)
    if rules.category_mode == "contains":
        return classify_contains(text, rules.contains_rules, rules.default_category)
    raise ValueError(f"unknown category mode {rules.category_mode!r}")


def label_catalog(df: DataFrame, rules: R.RuleSet = R.ARTEFACT_RULES) -> DataFrame:
    """Add ``category``, ``area`` and ``level`` (pure Column expressions)."""
    return df.select(
        "*",
        category_column(rules).alias("category"),
        extract_area("address", rules.area).alias("area"),
        level_label("price_level", rules.level_labels, rules.unknown_level).alias("level"),
    )


def prepare_catalog(
    raw: DataFrame,
    rules: R.RuleSet = R.ARTEFACT_RULES,
    dedupe_order: Sequence[Column | str] | None = None,
    partitions: int | None = None,
    existing_ids: DataFrame | None = None,
) -> DataFrame:
    """Typed raw catalogue -> one row per ``item_key`` with ``item_id`` and labels.

    ``item_id`` is the 1-based position of ``item_key`` in ascending key order
    (NULL key first).  Numbering writes the de-duplicated, labelled rows once to
    the session's shared checkpoint folder; persist the result (and its
    key -> id map) next to any model trained on it.

    With ``existing_ids`` (a previous ``item_key, item_id`` map), known keys
    keep their ids and new keys are numbered after the current maximum, so
    a model trained on the old ids stays valid.
    """
    deduped = dedupe_by_key(raw, ["item_key"], dedupe_order or default_dedupe_order())
    # Labels are per-row expressions: derive them while the rows are still
    # spread over all partitions, before numbering regroups them by bucket.
    labelled = label_catalog(deduped, rules)
    if existing_ids is None:
        with_ids = assign_dense_ids(labelled, ["item_key"], "item_id", partitions)
    else:
        labelled = materialize(labelled, "catalog-labelled")
        ids = extend_id_map(existing_ids, labelled, "item_key", "item_id", partitions)
        with_ids = join_ids(labelled, ids, "item_key", "item_id")
    return with_ids.select(
        "item_id",
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
        "category",
        "area",
        "level",
    )


def id_map(catalog: DataFrame) -> DataFrame:
    """The persisted key -> id mapping."""
    return catalog.select("item_key", "item_id")


def write_catalog_table(catalog: DataFrame, path: str) -> None:
    """Persist the prepared catalogue as parquet, clustered by its labels.

    Sorting within each output file by (category, area, level) gives tight
    per-row-group min/max statistics, so equality filters on the labels
    skip row groups at the scan; ids and keys ride along unchanged.
    """
    (
        catalog.sortWithinPartitions("category", "area", "level", "item_id")
        .write.mode("overwrite")
        .parquet(path)
    )
