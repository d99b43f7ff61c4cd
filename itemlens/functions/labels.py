"""Label derivation as Column expressions (no UDFs).

Every function takes Columns and returns a Column, so Catalyst can fold,
prune and codegen the whole derivation next to the scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from itemlens.functions import rules as R


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def classify_contains(
    text: Column | str,
    rules: Iterable[tuple[str, str]] = R.CONTAINS_CATEGORY_RULES,
    default: str = R.DEFAULT_CATEGORY,
) -> Column:
    """First rule whose needle is a (case-sensitive) substring of ``text``.

    Rule order decides; NULL text gets ``default``.
    """
    text = _col(text)
    expr = None
    for needle, label in rules:
        cond = text.contains(needle)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default))


def _quote(token: str) -> str:
    """Literal-quote a token for a Java regular expression."""
    return "\\Q" + token.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def classify_tokens(
    text: Column | str,
    rules: Iterable[tuple[str, str]] = R.TOKEN_CATEGORY_RULES,
    default: str = R.DEFAULT_CATEGORY,
    sep: str = ",",
) -> Column:
    """Label of the first token (in the row's own order) found in ``rules``.

    Tokens are the ``sep``-separated parts of ``text``, whitespace-trimmed and
    compared case-insensitively; NULL or empty text gets ``default``.

    One regular expression finds the leftmost whole token that is a rule key
    (an alternation anchored on separators), so the row's order decides, and
    a CASE maps it to its label; no per-token lambda runs.
    """
    pairs = [(k.lower(), v) for k, v in rules]
    if not pairs:
        return F.lit(default)
    sep_q = _quote(sep)
    alternation = "|".join(_quote(k) for k, _ in pairs)
    pattern = f"(?i)(?:^|{sep_q})\\s*({alternation})\\s*(?={sep_q}|$)"
    found = F.lower(F.regexp_extract(_col(text), pattern, 1))
    expr = None
    for k, v in pairs:
        cond = found == F.lit(k)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return expr.otherwise(F.lit(default))


def _pad2_integer(digits: Column) -> Column:
    """Integer value of a digit string, zero-padded to at least 2 places.

    Leading zeros are stripped textually, so arbitrarily long digit runs
    never overflow.
    """
    trimmed = F.ltrim(digits, F.lit("0"))
    stripped = F.when(trimmed == F.lit(""), F.lit("0")).otherwise(trimmed)
    return F.when(F.length(stripped) < 2, F.lpad(stripped, 2, "0")).otherwise(stripped)


def extract_area(text: Column | str, rules: R.AreaRules = R.AreaRules()) -> Column:
    """Area label from an address-like text.

    ``mode="intpad"``: the number captured by ``rules.pattern`` becomes
    ``prefix + max(2-digit zero pad, all digits)``; otherwise the first listed
    named area found (case-insensitive substring); otherwise ``default``.

    ``mode="lpad2"``: the captured digits are left-padded / truncated to
    exactly two characters; no named areas.
    """
    text = _col(text)
    digits = F.regexp_extract(text, rules.pattern, 1)
    found = digits != F.lit("")
    if rules.mode == "lpad2":
        return F.when(found, F.concat(F.lit(rules.prefix), F.lpad(digits, 2, "0"))).otherwise(
            F.lit(rules.default)
        )
    if rules.mode != "intpad":
        raise ValueError(f"unknown area mode {rules.mode!r}")
    expr = F.when(found, F.concat(F.lit(rules.prefix), _pad2_integer(digits)))
    lowered = F.lower(text)
    for area in rules.named:
        expr = expr.when(lowered.contains(area.lower()), F.lit(area))
    return expr.otherwise(F.lit(rules.default))


def level_label(
    level: Column | str,
    labels: Mapping[int, str] = R.LEVEL_LABELS_ARTEFACT,
    unknown: str = R.UNKNOWN_LEVEL,
) -> Column:
    """Integer level -> label; anything outside the map (or NULL) is ``unknown``."""
    level = _col(level)
    expr = None
    for k, v in sorted(labels.items()):
        cond = level == F.lit(k)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    if expr is None:
        return F.lit(unknown)
    return expr.otherwise(F.lit(unknown))


def level_rank(
    label: Column | str,
    labels: Mapping[int, str] = R.LEVEL_LABELS_ARTEFACT,
) -> Column:
    """Sort rank of a level label, taken from the same map that produced it.

    Labels outside the map sort after every known one.
    """
    label = _col(label)
    expr = None
    for k, v in sorted(labels.items()):
        cond = label == F.lit(v)
        expr = F.when(cond, F.lit(k)) if expr is None else expr.when(cond, F.lit(k))
    last = (max(labels) + 1) if labels else 0
    if expr is None:
        return F.lit(last)
    return expr.otherwise(F.lit(last))
