"""Scans and sinks (CSV, parquet, JSON artefact, model) and driver-table recipes."""

from itemlens.sources.io import (
    catalog_as_text,
    guarded_read,
    load_model,
    read_catalog_csv,
    read_ratings,
    read_top_list,
    save_model,
    type_catalog,
    write_catalog_csv,
    write_ratings,
    write_top_list,
)
from itemlens.sources.tables import (
    catalog_from_parts,
    interactions_from_orders,
    load_catalog,
    load_interactions,
    load_users,
    read_table,
)

__all__ = [
    "catalog_as_text",
    "catalog_from_parts",
    "guarded_read",
    "interactions_from_orders",
    "load_catalog",
    "load_interactions",
    "load_model",
    "load_users",
    "read_catalog_csv",
    "read_ratings",
    "read_table",
    "read_top_list",
    "save_model",
    "type_catalog",
    "write_catalog_csv",
    "write_ratings",
    "write_top_list",
]
