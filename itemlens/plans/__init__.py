"""Query-level plans: each takes DataFrames and returns a DataFrame."""

from itemlens.plans.browse import browse, browse_total
from itemlens.plans.catalog import id_map, label_catalog, prepare_catalog
from itemlens.plans.ratings import (
    cap_per_user,
    interaction_ratings,
    join_base_rating,
    rmse,
    split_labels,
    split_ratings,
    user_offset,
)
from itemlens.plans.recommend import assemble, attach_fallback, recommend, rerank_rounded
from itemlens.plans.toplist import build_top_list, cold_start_list
from itemlens.plans.trending import busiest_areas, trending_categories

__all__ = [
    "assemble",
    "attach_fallback",
    "browse",
    "browse_total",
    "build_top_list",
    "busiest_areas",
    "cap_per_user",
    "cold_start_list",
    "id_map",
    "interaction_ratings",
    "join_base_rating",
    "label_catalog",
    "prepare_catalog",
    "recommend",
    "rerank_rounded",
    "rmse",
    "split_labels",
    "split_ratings",
    "trending_categories",
    "user_offset",
]
