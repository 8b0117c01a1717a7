"""Transcript corpora and result documents: JSON and CSV in and out."""

from __future__ import annotations

import json
from dataclasses import asdict
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed import ALPHA, EVASION, FEATURES, FLAG_AT, MATERIAL_MOVE, MIN_SD, MIN_TOKENS
from ..operators import baseline as B
from ..operators import langmodel as L
from ..operators.lexical import Lexicon

if TYPE_CHECKING:
    from ..operators.scoring import Measured

SCHEMA = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in (
            ("id", T.StringType()),
            ("speaker", T.StringType()),
            ("org", T.StringType()),
            ("domain", T.StringType()),
            ("event", T.StringType()),
            ("event_type", T.StringType()),
            ("date", T.DateType()),
            ("window", T.StringType()),
            ("days_to_disclosure", T.IntegerType()),
            ("next_event", T.DateType()),
            ("text", T.StringType()),
            ("synthetic", T.BooleanType()),
            ("source_url", T.StringType()),
            ("outcome_move_pct", T.DoubleType()),
            ("outcome", T.StringType()),
        )
    ]
)


def load_corpus(spark: SparkSession, path: str, with_corrupt: bool = False) -> DataFrame:
    """One JSON object per file under a fixed schema; the id defaults to the file's stem.

    Malformed files are skipped (or kept with ``_corrupt_record``); an empty
    corpus is an error.
    """
    schema = T.StructType([*SCHEMA.fields, T.StructField("_corrupt_record", T.StringType())])
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"(.*)\.json$", 1)
    rows = raw.withColumn("id", F.coalesce("id", stem))
    rows = rows if with_corrupt else rows.where("_corrupt_record is null").drop("_corrupt_record")
    if not rows.select("id").take(1):  # (Spark refuses to read the corrupt-record column alone)
        raise ValueError(f"no transcripts under {path}")
    return rows


def save_corpus(rows: DataFrame, path: str, keep_synthetic: bool = True) -> None:
    """Replace a corpus; synthetic rows can be left out."""
    kept = rows if keep_synthetic else rows.where("not coalesce(synthetic, false)")
    kept.write.mode("overwrite").json(path)


def cleaned(column: Column, kind: T.DataType) -> Column:
    """A value for JSON: NaN as null and keys that begin with an underscore dropped, at any depth."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(column), column)
    if isinstance(kind, T.StructType):
        inner = [cleaned(column[f.name], f.dataType).alias(f.name) for f in kind.fields if not f.name.startswith("_")]
        return F.when(column.isNotNull(), F.struct(*inner)) if inner else F.lit(None).cast("string")
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: cleaned(x, kind.elementType))
    if isinstance(kind, T.MapType):
        kept = F.map_filter(column, lambda k, v: ~F.startswith(k.cast("string"), F.lit("_")))
        return F.transform_values(kept, lambda k, v: cleaned(v, kind.valueType))
    return column


def document(rows: DataFrame) -> DataFrame:
    """``value``: each row as one cleaned JSON object."""
    kept = [f for f in rows.schema.fields if not f.name.startswith("_")]
    return rows.select(F.to_json(F.struct(*[cleaned(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in kept])).alias("value"))


def export_document(rows: DataFrame, path: str) -> None:
    """One JSON line for each row, underscore keys dropped and NaN as null at any depth."""
    document(rows).write.mode("overwrite").text(path)


def save_study(rows: DataFrame, path: str, name: str, title: str = "") -> None:
    """A study's (small) result table as one JSON document ``{name, title, rows}`` in the folder of studies."""
    kept = document(rows).agg(F.collect_list("value").alias("rows"))
    head = json.dumps({"name": name, "title": title})[:-1]
    whole = F.concat(F.lit(head + ', "rows": ['), F.array_join("rows", ","), F.lit("]}"))
    kept.select(whole.alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/{name}")


def study_index(spark: SparkSession, path: str) -> DataFrame:
    """``(name, title, n_rows)`` of every study in the folder, rebuilt by reading it."""
    found = spark.read.option("recursiveFileLookup", True).schema("name string, title string, rows array<string>").json(path)
    return found.where("name is not null").select("name", "title", F.size("rows").alias("n_rows")).orderBy("name")


def slug(name):
    """Key of a display name: blanks to underscores, dots gone."""
    return F.replace(F.replace(name, F.lit(" "), F.lit("_")), F.lit("."), F.lit(""))


def star_speakers(statements: DataFrame, measured: Measured | None = None) -> DataFrame:
    """One row for each speaker: key, name, organisation and domain of its first statement, and its baseline."""
    first = lambda c, default: F.min_by(F.col(c), F.col("id")).alias(default) if c in statements.columns else F.lit("").alias(default)
    speakers = statements.groupBy("speaker").agg(
        F.count_if(F.col("window") == "baseline").alias("baseline_n"), F.count("*").alias("n"), first("org", "organization"), first("domain", "domain")
    )
    if measured is not None:
        b = measured.baselines.select(
            "speaker",
            "mean_shrinkage",
            F.round("intensity", 3).alias("cov_shrinkage"),
            *[F.round(f"mean_resid_{f}", 4).alias(f"baseline_mean__{f}") for f in FEATURES],
            *[F.round(F.element_at("deviation", i + 1), 4).alias(f"baseline_sd__{f}") for i, f in enumerate(FEATURES)],
        )
        speakers = speakers.join(b, "speaker", "left")
    return speakers.select(slug(F.col("speaker")).alias("speaker_id"), F.col("speaker").alias("display_name"), *[c for c in speakers.columns if c != "speaker"])


def star_scores(measured: Measured) -> DataFrame:
    """Scores of the constrained statements, one column for each feature and kind."""
    kinds = {"raw": "{}", "resid": "resid_{}", "z": "z_resid_{}", "attribution": "attribution_resid_{}"}
    return measured.anomalies.select(
        F.col("id").alias("statement_id"),
        slug(F.col("speaker")).alias("speaker_id"),
        F.round("evasion", 4).alias("evasion_projection"),
        F.round("mahalanobis", 4).alias("mahalanobis"),
        F.round("percentile", 2).alias("chi2_percentile"),
        "p_chi2",
        F.replace("dominant_feature", F.lit("resid_"), F.lit("")).alias("dominant_feature"),
        *[F.round(form.format(f), 4).alias(f"{kind}__{f}") for kind, form in kinds.items() for f in FEATURES],
    )


def star_tables(statements: DataFrame, outcomes: DataFrame, measured: Measured | None = None) -> dict[str, DataFrame]:
    """Speakers, statements, events and outcomes with their keys; with a measured corpus the scores and baselines too."""
    keyed = statements.withColumn("speaker_id", slug(F.col("speaker")))
    joined = keyed.join(outcomes, "id")
    own = lambda c, name: F.col(c).alias(name) if c in statements.columns else F.lit("").alias(name)
    star = {
        "speakers": star_speakers(statements, measured),
        "statements": keyed.select(F.col("id").alias("statement_id"), "speaker_id", "window", "date"),
        "events": keyed.where("window = 'constrained'").select(
            F.concat(F.lit("evt_"), F.col("id")).alias("event_id"),
            F.col("id").alias("statement_id"),
            "speaker_id",
            own("org", "organization"),
            own("domain", "domain"),
            own("event", "event_label"),
            own("event_type", "event_type"),
            F.col("date").alias("statement_date"),
            own("days_to_disclosure", "days_to_disclosure"),
        ),
        "outcomes": joined.where("window = 'constrained'").select(
            F.concat(F.lit("out_"), F.col("id")).alias("outcome_id"),
            F.concat(F.lit("evt_"), F.col("id")).alias("event_id"),
            F.col("move"),
            F.abs("move").alias("abs_move"),
            (F.abs("move") >= MATERIAL_MOVE).alias("is_material"),
        ),
    }
    if measured is not None:
        star["scores"] = star_scores(measured).drop("speaker_id")
    return star


def save_star(tables: dict[str, DataFrame], path: str) -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").option("header", True).option("nullValue", "").csv(f"{path}/{name}")


#: A document of word counts holds about so many words; larger vocabularies take several.
WORDS = 1 << 16


def runtime_model(statements: DataFrame, measured: Measured, lexicon: Lexicon | None = None, words: int = WORDS) -> DataFrame:
    """``(part, name, value)``: what a scorer needs at run time, each row one JSON document.

    Parts: the lexicon, thresholds, the confound fit with its moments, every
    speaker's baseline, and the counts of all words, of each speaker and of all.
    A vocabulary of more than ``words`` is dealt by hash over ``pieces`` documents
    of the same name, each with the totals over all of them, so no row grows with the corpus.
    """
    spark = statements.sparkSession
    lx = lexicon or Lexicon()
    fixed_parts = spark.createDataFrame(
        [
            ("lexicon", "phrases", json.dumps(asdict(lx))),
            ("thresholds", "scoring", json.dumps({"alpha": ALPHA, "min_tokens": MIN_TOKENS, "min_sd": MIN_SD, "flag_at": FLAG_AT, "material_move": MATERIAL_MOVE, "direction": EVASION, "features": FEATURES})),
        ],
        "part string, name string, value string",
    )
    rows = measured.rows
    features = list(FEATURES)
    moments = rows.agg(F.avg(B.log_words()).alias("mean_log_words"), F.stddev_pop(B.log_words()).alias("sd_log_words"), F.avg("t").alias("mean_t"), F.stddev_pop("t").alias("sd_t"))
    design = B.standardised(rows, {"x1": B.log_words(), "x2": F.col("t")})
    fit = B.confound_fit(design.agg(*B.confound_sums(features)), features).crossJoin(F.broadcast(moments))
    confounds = fit.select(F.lit("confounds").alias("part"), F.lit("residualiser").alias("name"), F.to_json(F.struct("*")).alias("value"))
    entropy = measured.entropy if measured.entropy is not None else L.baseline_entropy_table(statements)
    base = measured.baselines.join(entropy, "speaker", "left")
    kept = ["n", "mean_shrinkage", "intensity", "precision", "factor", "deviation", "baseline_ce", "baseline_ce_sd", *[f"mean_resid_{f}" for f in features]]
    baselines = base.select(F.lit("baseline").alias("part"), F.col("speaker").alias("name"), F.to_json(F.struct(*kept)).alias("value"))
    counts, common = L.models_and_background(statements)
    return fixed_parts.unionByName(confounds).unionByName(baselines).unionByName(_vocabulary(counts, "speaker", "c_s", words, "language_model")).unionByName(
        _vocabulary(common.withColumn("speaker", F.lit("all")), "speaker", "c_bg", words, "background")
    )


def _vocabulary(counts: DataFrame, key: str, n: str, words: int, part: str) -> DataFrame:
    """All words of each key with their counts, about ``words`` in a document, with the totals over all its words."""
    totals = L.small(counts.groupBy(key).agg(F.sum(n).alias("total"), F.count("*").alias("vocabulary")).withColumn("pieces", F.ceil(F.col("vocabulary") / words)))
    dealt = counts.join(totals, key).withColumn("piece", F.pmod(F.xxhash64("word"), F.col("pieces")))
    held = dealt.groupBy(key, "total", "vocabulary", "piece", "pieces").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", F.col(n).alias("c"))))).alias("words"))
    value = F.to_json(F.struct("total", "vocabulary", F.lit(False).alias("truncated"), "piece", "pieces", "words"))
    return held.select(F.lit(part).alias("part"), F.col(key).alias("name"), value.alias("value"))
