"""Column-expression building blocks: rule tables, labels and value helpers."""

from itemlens.functions.labels import (
    classify_contains,
    classify_tokens,
    extract_area,
    level_label,
    level_rank,
)
from itemlens.functions.values import (
    base_rating,
    clamp,
    hash_fraction_bucket,
    number_or,
    round_half_up,
    text_or,
    to_double,
    to_int,
)

__all__ = [
    "base_rating",
    "clamp",
    "classify_contains",
    "classify_tokens",
    "extract_area",
    "hash_fraction_bucket",
    "level_label",
    "level_rank",
    "number_or",
    "round_half_up",
    "text_or",
    "to_double",
    "to_int",
]
