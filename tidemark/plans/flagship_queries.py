"""The flagship: documents as statements, scored end to end, with its validation and reading views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import FEATURES
from ..operators import baseline as B
from ..operators import lexical as X
from ..operators import scoring as P
from ..sources import corpus
from . import views as V
from .anomaly_queries import _LEX2, _RES, _lexical
from .registry import Registry

REGISTRY = Registry()
_PERMUTATIONS, _DRAWS = 200, 100


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements with the descriptive columns of a corpus and a made-up outcome move for constrained ones."""
    move = F.when(F.col("window") == "constrained", ((F.col("id") * 37) % 401 - 200) / F.lit(10.0))
    st = V.statements(spark, sf_dir, {"lang": "org"})
    return st.select(
        "*",
        F.lit("documents").alias("domain"),
        F.substring("text", 1, 140).alias("event"),
        F.concat(F.lit("type_"), F.col("id") % 3).alias("event_type"),
        (F.col("id") % 28).cast("int").alias("days_to_disclosure"),
        F.lit(True).alias("synthetic"),
        move.alias("outcome_move_pct"),
        F.when(move < -2.5, "miss").when(move > 2.5, "beat").when(move.isNotNull(), "inline").alias("outcome"),
    )


def _measured(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, P.Measured]:
    st = described(spark, sf_dir)
    return st, P.measure(st, X.PROXY)


def _with_outcomes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, P.Measured]:
    st, m = _measured(spark, sf_dir)
    return P.cut(P.with_outcomes(m, st.select("id", "outcome_move_pct"))), m


@REGISTRY.query()
def q_pipeline_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: six features, confounds, shrunken baselines, anomalies and evasion of every constrained statement."""
    st, m = _measured(spark, sf_dir)
    return P.records(st, m, X.PROXY)


@REGISTRY.query()
def q_top_evasive(spark: SparkSession, sf_dir: str) -> DataFrame:
    st, m = _measured(spark, sf_dir)
    return P.top_records(P.records(st, m, X.PROXY)).select("id", "speaker", "evasion", "mahalanobis", "dominant_feature")


@REGISTRY.query()
def q_baseline_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    st, m = _measured(spark, sf_dir)
    return P.baseline_view(st, m, X.PROXY)


@REGISTRY.query()
def q_validation_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, m = _with_outcomes(spark, sf_dir)
    _, directed = P.learn_direction(scored, m)
    return P.validation_block(P.cut(directed), _PERMUTATIONS, _DRAWS)


@REGISTRY.query()
def q_material_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold probability of a material move and the projection on the learned direction, statement by statement."""
    scored, m = _with_outcomes(spark, sf_dir)
    return P.learn_direction(scored, m)[1].select("id", "speaker", "material", "p_material_oof", "directional")


@REGISTRY.query()
def q_model_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The learned direction: status, C, areas in and out of fold, and the handpicked weights' area."""
    scored, m = _with_outcomes(spark, sf_dir)
    report, _ = P.learn_direction(scored, m)
    direction = report.get("direction") or [None] * len(FEATURES)
    row = (report["status"], report["n"], report.get("c"), report.get("auc_in_sample"), report.get("auc_out_of_fold"), report.get("auc_handpicked_weights"), *direction)
    names = ", ".join(f"direction_{f} double" for f in FEATURES)
    return spark.createDataFrame([row], f"status string, n bigint, c double, auc_in_sample double, auc_out_of_fold double, auc_handpicked_weights double, {names}")


@REGISTRY.query()
def q_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's texts as if every source had written them."""
    st, m = _measured(spark, sf_dir)
    texts = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("text_id"), "text")
    found = P.probe(texts, st, m, X.PROXY)
    return found.select("text_id", "speaker", "n_tokens", "cross_entropy", "surprisal_z", "novel_rate", "mahalanobis", "p_chi2", "dominant_feature", "evasion")


@REGISTRY.query()
def q_runtime_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scorer needs at run time, one JSON document for each part."""
    st, m = _measured(spark, sf_dir)
    return corpus.runtime_model(st, m, X.PROXY)


# Two residual text features: the inverse has a closed form, so the whole chain fits into SQL.
_TEXT2 = f"""{_RES}, f1 as (select speaker, count(*) as n, avg(resid_hedging) as mv, avg(resid_pronoun_distancing) as mk from rs where "window" = 'baseline' group by 1 having count(*) >= 2),
cn as (select rs.speaker, n, mv, mk, resid_hedging - mv as cv, resid_pronoun_distancing - mk as ck from rs join f1 on rs.speaker = f1.speaker where "window" = 'baseline'),
mo as (select speaker, any_value(n) as n, any_value(mv) as mv, any_value(mk) as mk, avg(cv * cv) as svv, avg(cv * ck) as svk, avg(ck * ck) as skk, sum((cv * cv + ck * ck) * (cv * cv + ck * ck)) as q from cn group by 1),
mi as (select *, svv + skk as tr, svv * svv + 2 * svk * svk + skk * skk as sq from mo),
md as (select *, (sq - tr * tr + tr * tr / 2) / 2 as delta, (q / n - sq) / (2 * n) as beta from mi),
sh as (select *, case when beta <= 0 then 0 else least(beta, delta) / greatest(delta, 1e-300) end as s from md),
cv as (select *, case when n < 3 then greatest(svv, 1e-3) else (1 - s) * svv + s * tr / 2 + 1e-4 end as c11, case when n < 3 then 0 else (1 - s) * svk end as c12,
       case when n < 3 then greatest(skk, 1e-3) else (1 - s) * skk + s * tr / 2 + 1e-4 end as c22 from sh),
po as (select avg(mv) as pv, avg(mk) as pk, coalesce(var_samp(mv), 1) as bv, coalesce(var_samp(mk), 1) as bk, avg(svv * n / (n - 1)) as wv, avg(skk * n / (n - 1)) as wk from cv),
eb as (select cv.*, pv, pk, (greatest(bv - wv / n, 1e-6) / (greatest(bv - wv / n, 1e-6) + wv / n) + greatest(bk - wk / n, 1e-6) / (greatest(bk - wk / n, 1e-6) + wk / n)) / 2 as w from cv, po),
bl as (select *, w * mv + (1 - w) * pv as mean_1, w * mk + (1 - w) * pk as mean_2, c11 * c22 - c12 * c12 as det from eb),
an as (select rs.id, rs.speaker, resid_hedging - mean_1 as d1, resid_pronoun_distancing - mean_2 as d2, c11, c12, c22, det from rs join bl on rs.speaker = bl.speaker where rs."window" = 'constrained'),
fi as (select id, speaker, (c22 * d1 * d1 - 2 * c12 * d1 * d2 + c11 * d2 * d2) / det as m2, (d1 * (c22 * 1.0 - c12 * 0.8) + d2 * (c11 * 0.8 - c12 * 1.0)) / det / sqrt((c22 * 1.0 - 2 * c12 * 0.8 + c11 * 0.64) / det) as e from an)"""


@REGISTRY.query(f"with {_TEXT2} select id, speaker, round(sqrt(m2), 4) as mahalanobis, round(exp(-m2 / 2), 6) as p_chi2, round(100 * (1 - exp(-m2 / 2)), 3) as percentile, round(e, 4) as evasion from fi")
def q_text_anomalies_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship's chain on two lexical features: scores, confounds, shrunken baselines, anomaly and signed projection."""
    names = [f"resid_{f}" for f in _LEX2]
    r = B.residualise(_lexical(spark, sf_dir), _LEX2)
    base = B.fit_baselines(r.where("window = 'baseline'"), "speaker", names)
    a = B.anomalies(r.where("window = 'constrained'").select("id", "speaker", *names), base, "speaker", names, (1.0, 0.8))
    return a.select(
        "id", "speaker", F.round("mahalanobis", 4).alias("mahalanobis"), F.round("p_chi2", 6).alias("p_chi2"), F.round("percentile", 3).alias("percentile"), F.round("projection", 4).alias("evasion")
    )


@REGISTRY.query(f"with {_TEXT2} select id, round(e, 4) as evasion from fi order by round(e, 4) desc, id limit 8")
def q_top_evasive_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.top_records(q_text_anomalies_2d(spark, sf_dir).select("id", "evasion"))


_VIEW = f"""{_TEXT2}, br as (select rs.id, rs.speaker, round(pow((rs.hedging - mean_1) / sqrt(c11), 2) + pow((rs.pronoun_distancing - mean_2) / sqrt(c22), 2), 9) as d
    from rs join bl on rs.speaker = bl.speaker where "window" = 'baseline'), rp as (select *, row_number() over (partition by speaker order by d, id) as rn from br)"""


@REGISTRY.query(f"with {_VIEW} select speaker, id, round(d, 4) as distance from rp where rn = 1")
def q_representative_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline statement whose raw scores are closest to the mean in residual space."""
    names = [f"resid_{f}" for f in _LEX2]
    rows = B.residualise(_lexical(spark, sf_dir), _LEX2).where("window = 'baseline'")
    return B.representative(rows, B.fit_baselines(rows, "speaker", names), "speaker", _LEX2, "id", names)


@REGISTRY.query(
    f"""with {V.STATEMENTS}, w as (select id, speaker, date, row_number() over (partition by speaker order by length(text) desc, id) as rn, text from st where "window" = 'baseline')
    select speaker, count(*) as n, string_agg(cast(id as varchar), ',' order by date, id) as by_date, any_value(length(text)) filter (where rn = 1) as kept_chars from w group by 1"""
)
def q_collected_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows gathered by speaker in the order of their dates, all texts but one left behind."""
    base = V.statements(spark, sf_dir).where("window = 'baseline'")
    longest = base.groupBy("speaker").agg(F.min_by("id", F.struct((-F.length("text")).alias("n"), F.col("id"))).alias("rep"))
    item = F.struct("date", "id", F.when(F.col("id") == F.col("rep"), F.col("text")).alias("text"))
    got = base.join(longest, "speaker").groupBy("speaker").agg(F.sort_array(F.collect_list(F.struct("date", "id"))).alias("s"), F.max(F.length(item["text"])).alias("kept_chars"))
    return got.select("speaker", F.size("s").cast("long").alias("n"), F.array_join(F.transform("s", lambda x: x["id"].cast("string")), ",").alias("by_date"), F.col("kept_chars").cast("long").alias("kept_chars"))


@REGISTRY.query("select o_orderkey, cast(printf('%.6g', o_totalprice / 7919.0) as double) as six, round(1 / (1 + exp(-(o_totalprice - 150000) / 50000.0)), 6) as p from orders")
def q_significant_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six significant digits and the logistic function."""
    o = V.table(spark, sf_dir, "orders")
    x = F.col("o_totalprice").cast("double")
    return o.select("o_orderkey", P.significant(x / 7919.0).alias("six"), F.round(P.logistic((x - 150000) / 50000.0), 6).alias("p"))


@REGISTRY.query(
    """with t as (select doc_id as id, source as speaker, lang as org, text from documents), f as (select speaker, min(id) as first_id from t group by 1)
    select replace(replace(f.speaker, ' ', '_'), '.', '') as speaker_id, f.speaker as display_name, t.org as organization, 'documents' as domain,
    (select count(*) from t x where x.speaker = f.speaker and x.id % 7 <> 0) as baseline_n from f join t on t.id = f.first_id"""
)
def q_star_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers of the star schema with the organisation and domain of their first statement."""
    return corpus.star_speakers(described(spark, sf_dir)).select("speaker_id", "display_name", "organization", "domain", "baseline_n")


@REGISTRY.query()
def q_star_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, outcomes and scores of the star schema, joined on their keys."""
    st, m = _measured(spark, sf_dir)
    star = corpus.star_tables(st, st.select("id", F.col("outcome_move_pct").alias("move")), m)
    return star["events"].join(star["outcomes"], "event_id").join(star["scores"], "statement_id").select("event_id", "outcome_id", "speaker_id", "organization", "abs_move", "is_material", "evasion_projection", "mahalanobis", "p_chi2", "dominant_feature")
