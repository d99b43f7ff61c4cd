"""One registered query per operator, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemlens.llm.bpe import roundtrip
from itemlens.llm.collocations import collocations
from itemlens.llm.common import documents, table
from itemlens.llm.decontaminate import decontaminate, items_digest
from itemlens.llm.katz import katz_scores
from itemlens.llm.langid import identify, language_profiles
from itemlens.llm.ngram_join import ngram_join
from itemlens.llm.pii import BASE_KINDS as PII_KINDS
from itemlens.llm.pii import find_pii
from itemlens.llm.runs import edit_number, periodic_runs
from itemlens.llm.secrets import BASE_KINDS, count_of, find_secrets, joined
from itemlens.llm.sharding import shard
from itemlens.llm.spotsigs import fingerprints
from itemlens.llm.suffix_dedup import suffix_dedup
from itemlens.llm.toxicity import THRESHOLD, held_out, score_toxicity
from itemlens.session import materialize


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op2_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(documents(spark, sf_dir)).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op3_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir)).select(
        "doc_id",
        *[count_of(F.col("base"), k).alias(f"n_{k}") for k in PII_KINDS],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip(documents(spark, sf_dir))


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return find_secrets(documents(spark, sf_dir)).select(
        "doc_id",
        *[count_of(F.col("spans"), k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        items_digest().alias("items_sha256"),
        "contaminated",
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return periodic_runs(documents(spark, sf_dir), edit=edit_number(), keep=columns)


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    profiles = materialize(language_profiles(docs.where(~held_out())), "language-profiles")
    found = identify(docs, profiles)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_katz_backoff": op2_katz_backoff,
    "op3_virtual_slots": op3_virtual_slots,
    "op4_toxicity": op4_toxicity,
    "op5_pii": op5_pii,
    "op6_bpe": op6_bpe,
    "op7_spotsigs": op7_spotsigs,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_secrets": op9_secrets,
    "op10_decontaminate": op10_decontaminate,
    "op11_collocations": op11_collocations,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_language_id": op13_language_id,
}
