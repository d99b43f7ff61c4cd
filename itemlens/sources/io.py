"""Scans and sinks: catalogue CSV, ratings parquet, ranked JSON artefact, model.

All readers declare their schema (no inference pass over the data) and
turn a missing path into ``FileNotFoundError`` with a clear message.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemlens import schemas as S
from itemlens.functions.values import to_double, to_int
from itemlens.session import materialize


def _missing_path(exc: AnalysisException) -> bool:
    cond = getattr(exc, "getCondition", None) or getattr(exc, "getErrorClass", None)
    name = cond() if callable(cond) else None
    return name == "PATH_NOT_FOUND" or "Path does not exist" in str(exc)


def guarded_read(read, path: str, what: str) -> DataFrame:
    """Run ``read(path)``; a missing path becomes ``FileNotFoundError``."""
    try:
        return read(path)
    except AnalysisException as exc:
        if _missing_path(exc):
            raise FileNotFoundError(f"{what} not found at {path}") from exc
        raise


# --- catalogue CSV ---------------------------------------------------------


def type_catalog(text_df: DataFrame) -> DataFrame:
    """All-text catalogue -> typed catalogue with tolerant casts.

    Unparsable numbers become NULL; integers go through double so ``'12.0'``
    is 12.
    """
    return text_df.select(
        "item_key",
        "name",
        "address",
        to_double("lat").alias("lat"),
        to_double("lng").alias("lng"),
        to_double("rating").alias("rating"),
        to_int("total_ratings").alias("total_ratings"),
        to_int("price_level").alias("price_level"),
        "types",
        to_double("activity_score").alias("activity_score"),
    )


#: What ``write_catalog_csv`` writes for NULL, so that empty text stays empty.
CSV_NULL = "\\N"
#: Quoted fields may hold line breaks and quotes, and blanks are data.
_CSV = {
    "header": "true",
    "escape": '"',
    "multiLine": "true",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def read_catalog_csv(spark: SparkSession, path: str, null_value: str = "") -> DataFrame:
    """Header CSV with every field as text, then typed.

    Columns are matched by header name, not position (no schema inference
    pass: every field is read as text).  The original service's names
    (``place_id``, ``busyness_score``) are accepted; absent columns are NULL.
    All files of a folder must have the same header; a file with another
    order of columns is an error.  A field equal to ``null_value`` is NULL.
    Fields may hold line breaks, so one task reads a file: provide a large
    catalogue as many files.
    """
    raw = guarded_read(
        lambda p: spark.read.options(**_CSV, mode="PERMISSIVE", enforceSchema="false", nullValue=null_value).csv(p),
        path,
        "catalogue CSV",
    )
    return _typed_catalog(raw)


def _typed_catalog(raw: DataFrame) -> DataFrame:
    """Text columns under either set of names -> typed catalogue; absent ones are NULL."""
    present = {c: c for c in raw.columns}
    for old, new in S.LEGACY_CATALOG_FIELDS.items():
        if old in present and new not in present:
            present[new] = old
    text = raw.select(
        *[
            F.col(present[c]).cast("string").alias(c) if c in present else F.lit(None).cast("string").alias(c)
            for c in S.CATALOG_TEXT_FIELDS
        ]
    )
    return type_catalog(text)


def split_catalog_csv(
    spark: SparkSession, path: str, rejects_path: str, null_value: str = "", header: bool = True
) -> tuple[DataFrame, int]:
    """(typed catalogue of the well-formed records, number of the others).

    A record with more or fewer fields than the header is put, as it stands, into the
    table at ``rejects_path`` (``file, record``) instead of being filled up or cut.  The
    files are parsed once, into a scratch table that both sides are read from; bad
    numbers in well-formed records stay tolerant, as in ``read_catalog_csv``.  Without a
    header the fields are those of ``schemas.CATALOG_TEXT_FIELDS`` in their order.
    """
    bad = "_record"
    options = {**_CSV, "header": str(header).lower()}
    if header:
        first = guarded_read(lambda p: spark.read.options(**options).csv(p), path, "catalogue CSV")
        names = first.columns
    else:
        names = list(S.CATALOG_TEXT_FIELDS)
    if bad in names:
        raise ValueError(f"a field is called {bad}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, bad]])
    # Only whole records show whether they are well-formed, so no column is pruned.
    parsed = guarded_read(
        lambda p: spark.read.options(
            **options, mode="PERMISSIVE", enforceSchema="true", nullValue=null_value, columnNameOfCorruptRecord=bad, columnPruning="false"
        )
        .schema(schema)
        .csv(p),
        path,
        "catalogue CSV",
    )
    rows = materialize(parsed.withColumn("_file", F.input_file_name()), "catalog-parsed")
    rejects = rows.where(F.col(bad).isNotNull()).select(F.col("_file").alias("file"), F.col(bad).alias("record"))
    seen = Observation()
    rejects.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(rejects_path)
    good = rows.where(F.col(bad).isNull()).drop(bad, "_file")
    return _typed_catalog(good), seen.get["rows"]


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """What ``split_catalog_csv`` put aside: ``file, record``."""
    return guarded_read(spark.read.parquet, path, "rejected records")


def catalog_as_text(df: DataFrame) -> DataFrame:
    """Typed catalogue -> all-text columns (what a CSV export holds)."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in S.CATALOG_TEXT_FIELDS])


def write_catalog_csv(df: DataFrame, path: str) -> None:
    """Header CSV that ``read_catalog_csv(..., null_value=CSV_NULL)`` reads back unchanged."""
    options = {k: v for k, v in _CSV.items() if k != "multiLine"}
    catalog_as_text(df).write.mode("overwrite").options(**options, nullValue=CSV_NULL).csv(path)


# --- ratings ---------------------------------------------------------------


def write_ratings(df: DataFrame, path: str) -> None:
    """Durable ratings table (parquet); survives executor loss, unlike a temp file."""
    S.conform(df, S.RATINGS_SCHEMA).write.mode("overwrite").parquet(path)


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    return guarded_read(
        lambda p: spark.read.schema(S.RATINGS_SCHEMA).parquet(p), path, "ratings table"
    )


# --- ranked JSON artefact --------------------------------------------------


def write_top_list(df: DataFrame, path: str) -> None:
    """Write the ranked list as JSON lines; ``rank`` carries the order.

    The list is bounded by its builder's limit, so one output file is fine.
    """
    S.conform(df, S.TOP_LIST_SCHEMA).coalesce(1).write.mode("overwrite").json(path)


def write_top_list_array(df: DataFrame, path: str, legacy: bool = False) -> None:
    """Write the ranked list as one JSON array in rank order, without ``rank`` fields.

    The layout that the original service writes and serves, with its field names if
    ``legacy``.  NULL fields are written; an empty list is ``[]``.  The list is bounded
    by its builder's limit, so it is put together in one row and one file.
    """
    new = [f.name for f in S.TOP_LIST_SCHEMA.fields if f.name != "rank"]
    names = {v: k for k, v in S.LEGACY_TOP_LIST_FIELDS.items()} if legacy else {c: c for c in new}
    rows = S.conform(df, S.TOP_LIST_SCHEMA)
    ordered = F.sort_array(F.collect_list(F.struct("rank", F.struct(*new).alias("entry"))))
    entries = F.transform(ordered, lambda x: F.struct(*[x["entry"][c].alias(names[c]) for c in new if c in names]))
    text = rows.agg(F.to_json(entries, {"ignoreNullFields": "false"}).alias("value"))
    text.coalesce(1).write.mode("overwrite").text(path)


def read_top_list(
    spark: SparkSession,
    path: str,
    limit: int | None = None,
    array_file: bool = False,
    legacy: bool = False,
) -> DataFrame:
    """Read a ranked list, optionally only its first ``limit`` entries.

    ``array_file=True`` reads a single JSON array file without ``rank``
    fields; the position in the file becomes the rank.  ``legacy=True`` (an
    array file) reads the original service's field names
    (``schemas.LEGACY_TOP_LIST_FIELDS``).
    """
    if array_file or legacy:
        by_name = {f.name: f for f in S.TOP_LIST_SCHEMA.fields}
        if legacy:
            fields = [T.StructField(old, by_name[new].dataType, True) for old, new in S.LEGACY_TOP_LIST_FIELDS.items()]
        else:
            fields = [f for f in S.TOP_LIST_SCHEMA.fields if f.name != "rank"]
        raw = guarded_read(
            lambda p: spark.read.schema(T.StructType(fields)).option("multiLine", "true").json(p),
            path,
            "top list",
        )
        if legacy:
            raw = raw.select(*[F.col(old).alias(new) for old, new in S.LEGACY_TOP_LIST_FIELDS.items()])
        # A multi-line JSON file is read by one task in file order, and the
        # list is bounded, so a single ordered window here is cheap.
        pos = F.monotonically_increasing_id()
        df = raw.withColumn("_pos", pos).withColumn(
            "rank", F.row_number().over(Window.orderBy("_pos"))
        ).drop("_pos")
        df = S.conform(df, S.TOP_LIST_SCHEMA)
    else:
        df = guarded_read(
            lambda p: spark.read.schema(S.TOP_LIST_SCHEMA).json(p), path, "top list"
        )
    if limit is not None:
        from itemlens.functions.rules import TOP_LIST_READ_MAX
        from itemlens.operators.predicates import check_int_range

        check_int_range("limit", limit, 1, TOP_LIST_READ_MAX)
        df = df.filter(F.col("rank") <= F.lit(int(limit)))
    return df


# --- model -----------------------------------------------------------------


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml.recommendation import ALSModel

    try:
        return ALSModel.load(path)
    except Exception as exc:  # Spark raises different types per version
        if "does not exist" in str(exc) or "PATH_NOT_FOUND" in str(exc) or "No such file" in str(exc):
            raise FileNotFoundError(f"model not found at {path}") from exc
        raise
