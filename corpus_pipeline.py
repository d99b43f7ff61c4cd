"""The corpus pipeline: stages over ``documents``, each on all that the one before kept.

1. ``toxicity``: documents that score as toxic go.
2. ``near_duplicates``: one document of each group of linked documents stays, the one
   with the least id.
3. ``decontamination``: documents contaminated by benchmark text go.
4. ``secrets``: every secret's characters give way to a mark; ``n_chars`` follows.
5. ``encoding``: every whole text as token ids.

Stages 1 to 4 return the columns of ``documents``.  Null texts count as empty: they are
neither toxic, linked nor contaminated, and stay.  Rows without an id stay too, unless a
linked row goes before them; rows that repeat an id and its text are one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemlens.llm.bpe import encode
from itemlens.llm.common import DOCUMENT_COLUMNS, documents, table
from itemlens.llm.decontaminate import decontaminate
from itemlens.llm.ngram_join import ngram_join, representatives, row_key
from itemlens.llm.secrets import redact_secrets
from itemlens.llm.toxicity import THRESHOLD, score_toxicity
from itemlens.session import scratch_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), carry=DOCUMENT_COLUMNS)
    return scored.where(F.col("score") < THRESHOLD).select(*DOCUMENT_COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    stay = representatives(ngram_join(docs))
    rows = docs.select(*DOCUMENT_COLUMNS).withColumn("row_key", row_key())
    return rows.join(stay, "row_key", "left_semi").dropDuplicates(["row_key"]).select(*DOCUMENT_COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=DOCUMENT_COLUMNS)
    return found.where(~F.col("contaminated")).select(*DOCUMENT_COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = redact_secrets(docs, carry=[c for c in DOCUMENT_COLUMNS if c != "n_chars"])
    text = F.col("redacted")
    return clean.drop("text").withColumn("text", text).withColumn("n_chars", F.length(text).cast("long")).select(*DOCUMENT_COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = encode(docs, carry=("doc_id", "lang", "source", "n_chars"))
    return rows.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("encoding", encoding),
]

#: Several stages have no SQL form (a trained classifier, a tokenizer).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
