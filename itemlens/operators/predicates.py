"""Argument validation and filter predicates.

User values only ever become literals inside Column expressions; nothing is
spliced into SQL text, so quoting tricks cannot change a predicate.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from itemlens.functions import rules as R


def check_range(name: str, value, lo, hi) -> None:
    if value is None:
        return
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ValueError(f"{name} must be a number, got {value!r}")
    if not (lo <= value <= hi):
        raise ValueError(f"{name} must be between {lo} and {hi}, got {value!r}")


def check_int_range(name: str, value, lo: int, hi: int) -> None:
    if isinstance(value, bool) or not isinstance(value, int):
        raise ValueError(f"{name} must be an integer, got {value!r}")
    check_range(name, value, lo, hi)


def check_choice(name: str, value, choices) -> None:
    if value not in choices:
        raise ValueError(f"{name} must be one of {list(choices)}, got {value!r}")


def equals_if_given(column: str, value: str | None) -> Column | None:
    """``column = value`` when ``value`` is a non-empty string, else no filter."""
    if value:
        return F.col(column) == F.lit(str(value))
    return None


def at_least(column: str, bound: float | int | None) -> Column | None:
    """Inclusive lower bound; ``0`` is a real bound, ``None`` is none.  NULLs drop."""
    if bound is None:
        return None
    return F.col(column) >= F.lit(bound)


def conjunction(preds) -> Column:
    """AND of the given predicates; none given means every row."""
    preds = [p for p in preds if p is not None]
    if not preds:
        return F.lit(True)
    return functools.reduce(operator.and_, preds)


def catalog_filter(
    category: str | None = None,
    area: str | None = None,
    level: str | None = None,
    min_rating: float | None = None,
) -> Column:
    check_range("min_rating", min_rating, 0.0, R.RATING_MAX)
    return conjunction(
        [
            equals_if_given("category", category),
            equals_if_given("area", area),
            equals_if_given("level", level),
            at_least("rating", min_rating),
        ]
    )


def specific_category(default_category: str = R.DEFAULT_CATEGORY) -> Column:
    """Rows with a specific (non-default, non-NULL) category and a rating."""
    return (
        (F.col("category") != F.lit(default_category))
        & F.col("category").isNotNull()
        & F.col("rating").isNotNull()
    )


def scored_area() -> Column:
    """Rows with an area and an activity score (rating may be NULL)."""
    return F.col("area").isNotNull() & F.col("activity_score").isNotNull()
