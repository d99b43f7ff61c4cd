"""Relational building blocks that Spark lacks as single calls."""

from itemlens.operators.dedupe import dedupe_by_key
from itemlens.operators.dense_ids import assign_dense_ids, index_keys
from itemlens.operators.factors import topk_dot_product
from itemlens.operators.joins import cold_users, enrich_with_catalog, known_users
from itemlens.operators.topk import global_topk, topk_per_group

__all__ = [
    "assign_dense_ids",
    "cold_users",
    "dedupe_by_key",
    "enrich_with_catalog",
    "global_topk",
    "index_keys",
    "known_users",
    "topk_dot_product",
    "topk_per_group",
]
