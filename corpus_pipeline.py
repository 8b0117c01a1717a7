"""The corpus pipeline: quality, lines, near duplicates, benchmark leaks, tokens.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; its result
is written and read again as the next stage's ``docs``.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, cotrain, latent_leaks
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.similar import similar_texts
from tidemark.llm.store import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier rejects go.

    Null texts are judged as empty ones, missing language or source as unknown;
    rows of any id, repeated or null, are judged each by itself; texts are read
    whole; without labels every document scores 0.5 and stays; an empty table
    stays empty; further columns are dropped, so none can clash.
    """
    plain = docs.select(*COLUMNS)
    model = cotrain.train(plain, table(spark, sf_dir, "labels"))
    scored = cotrain.score(plain, model, keep_text=True)
    return scored.where(F.col("quality_score") >= cotrain.THRESHOLD).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them only; ``n_chars`` follows the kept text.

    A null text becomes an empty one; rows of a repeated id count as documents
    of their own; rows without an id are counted and keep their lines; texts are
    read whole; an empty table stays empty; further columns are dropped.
    """
    kept = dedup_lines(docs.select(*COLUMNS)).withColumn("text", F.col("kept_text"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest id stays.

    Rows of one id are one document and stay together; rows without an id stay;
    null and blank texts are copies of each other; texts are read whole; an
    empty table stays empty; further columns are dropped.
    """
    plain = docs.select(*COLUMNS)
    first = similar_texts(plain).where("doc_id = component_id").select("doc_id")
    kept = plain.join(first.distinct(), "doc_id", "left_semi").select(*COLUMNS)
    return kept.unionByName(plain.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.

    Null and empty texts hold none and stay; repeated and null ids are judged
    row by row; texts are read whole; with an empty benchmark all stay; an empty
    table stays empty; further columns are dropped.
    """
    found = latent_leaks.find_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), keep_text=True)
    return found.where(F.size("leaks") == 0).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every kept text, and the proof that they decode to it.

    Null and empty texts have no tokens; repeated and null ids stay; texts are
    read whole; an empty table gives an empty result.
    """
    return bpe.encode(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality),
    ("line_dedup", lines),
    ("simhash", near_dedup),
    ("decontaminate", decontaminate),
    ("bpe", tokens),
]
#: SQL cannot express trained models and tokenizers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written and read again in between."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
