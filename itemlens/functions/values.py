"""Value-level helpers: tolerant casts, defaults, rounding, clamping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from itemlens.functions import rules as R


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double(c: Column | str) -> Column:
    """Text/number -> double; unparsable input becomes NULL instead of failing."""
    return _col(c).try_cast("double")


def to_int(c: Column | str) -> Column:
    """Text/number -> int through double, so ``'12.0'`` is 12 and ``'abc'`` is NULL.

    Fractions truncate toward zero; out-of-range values become NULL.
    """
    return to_double(c).try_cast("int")


def text_or(c: Column | str, default: str) -> Column:
    """NULL or empty text -> ``default``."""
    return F.coalesce(F.nullif(_col(c), F.lit("")), F.lit(default))


def number_or(c: Column | str, default: float | int) -> Column:
    return F.coalesce(_col(c), F.lit(default))


def round_half_up(c: Column | str, scale: int) -> Column:
    """Round half-up on the decimal value of a double, back to double.

    Rounding through a decimal keeps ties deterministic (plain binary
    doubles such as 2.675 would otherwise round either way).  Values beyond
    the decimal's range have no fraction left and are rounded as doubles.
    """
    x = _col(c)
    dec = x.try_cast("decimal(38,12)")
    return F.coalesce(F.round(dec, scale).cast("double"), F.round(x.cast("double"), scale))


def clamp(c: Column | str, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), _col(c)))


def base_rating(c: Column | str, default: float = R.DEFAULT_BASE_RATING) -> Column:
    """Item base rating: NULL *or zero* means unknown and becomes ``default``."""
    c = _col(c)
    return F.when(c.isNull() | (c == 0), F.lit(default)).otherwise(c.cast("double"))


def hash_fraction_bucket(key: Column, salt: str, buckets: int = 100) -> Column:
    """Reproducible bucket in ``[0, buckets)`` from md5 of ``salt:key``.

    The first 8 hex digits of the md5 digest are read as an unsigned integer,
    so the value depends only on the key (never on partition layout).
    """
    digest = F.md5(F.concat(F.lit(f"{salt}:"), key.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(buckets))


INT_MIN, INT_MAX = -(2**31), 2**31 - 1


def to_int_id(c: Column | str, what: str = "id") -> Column:
    """Integer id from a wider integer, failing loudly when it does not fit.

    ALS needs int ids.  A plain cast wraps silently when ANSI mode is off;
    this raises in either mode (use ``operators.dense_ids.index_keys`` for
    keys beyond the int range).
    """
    c = _col(c)
    return (
        F.when(c.isNull(), F.lit(None).cast("int"))
        .when((c >= F.lit(INT_MIN)) & (c <= F.lit(INT_MAX)), c.cast("int"))
        .otherwise(F.raise_error(F.concat(F.lit(f"{what} out of int range: "), c.cast("string"))).cast("int"))
    )
