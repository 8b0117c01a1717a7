"""The queries of the ten operators and of the pipeline, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, cotrain, ctw, latent_leaks, pii, sql, toxicity
from .iblt import edited_pairs
from .line_dedup import dedup_lines
from .secrets import scan
from .simhash import near_duplicates
from .store import table


#: The query's key is known, so that its results can be repeated and compared; real data takes a secret one.
PSEUDONYM_KEY = "known key of the registered query"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = cotrain.train(docs, table(spark, sf_dir, "labels"))
    scored = cotrain.score(docs, model)
    return scored.select(
        "doc_id", "quality_score", "text_score", "meta_score", (F.col("quality_score") >= cotrain.THRESHOLD).cast("int").alias("predicted")
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    return found.drop("text")


def op5_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.language_scores(table(spark, sf_dir, "documents"))


def op6_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_bare", "n_live", "n_copied", "most_owners", "most_repositories"
    )


def op7_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = latent_leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")


def op8_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op9_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_cotraining_quality": op2_cotraining_quality,
    "op3_line_dedup": op3_line_dedup,
    "op4_pii_pseudonyms": op4_pii_pseudonyms,
    "op5_context_tree": op5_context_tree,
    "op6_secret_ownership": op6_secret_ownership,
    "op7_latent_leaks": op7_latent_leaks,
    "op8_transducer_bpe": op8_transducer_bpe,
    "op9_weak_toxicity": op9_weak_toxicity,
    "op10_iblt_fingerprints": op10_iblt_fingerprints,
}
ORACLES: dict[str, str] = {"op3_line_dedup": sql.LINE_DEDUP, "op6_secret_ownership": sql.SECRETS}
