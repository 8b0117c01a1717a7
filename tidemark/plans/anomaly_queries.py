"""Confounds, baselines and multivariate anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import baseline as B
from ..operators import lexical as X
from . import views as V
from .registry import Registry
from .text_queries import _scores_sql

REGISTRY = Registry()
V0_FEATURES = {"value": 0.6, "k": 0.4}
TWO = ["value", "k"]


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.events(spark, sf_dir).where("window <> 'out_of_coverage' and value is not null and k is not null")


_EV = f"""{V.EVENTS}, ce as (select * from ev where "window" <> 'out_of_coverage' and value is not null and k is not null)"""
# Means of a few two-decimal values can end in an exact five: SQL rounds such a tie down, Spark up, hence the 1e-9.
_V0 = f"""{_EV}, b0 as (select speaker, count(*) as n_base, round(avg(value) + 1e-9, 4) as mv, round(avg(k) + 1e-9, 4) as mk,
    round(greatest(stddev_samp(value), 0.12), 4) as sv, round(greatest(stddev_samp(k), 0.12), 4) as sk
    from ce where "window" = 'baseline' group by 1 having count(*) >= 2)"""


@REGISTRY.query(f"with {_V0} select speaker, n_base, mv as mean_value, mk as mean_k, sv as sd_value, sk as sd_k from b0")
def q_v0_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.v0_baseline(_covered(spark, sf_dir), "speaker", TWO, F.col("window") == "baseline").select(
        "speaker", "n_base", "mean_value", "mean_k", "sd_value", "sd_k"
    )


@REGISTRY.query(
    f"""with {_V0} select id, ce.speaker, round((value - mv) / sv, 3) as z_value, round((k - mk) / sk, 3) as z_k,
    round(0.6::double * round((value - mv) / sv, 3) + 0.4::double * round((k - mk) / sk, 3), 3) as composite
    from ce join b0 on ce.speaker = b0.speaker where "window" <> 'baseline'"""
)
def q_v0_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: constrained rows against their speaker's own baseline."""
    found = B.v0_divergence(_covered(spark, sf_dir), "speaker", V0_FEATURES, F.col("window") == "baseline")
    return found.select("id", "speaker", "z_value", "z_k", "composite")


def _lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = X.lexical_scores(V.statements(spark, sf_dir), lexicon=X.PROXY)
    return scored.withColumn("t", X.time_index(F.col("date")))


_LEX = f"""{V.STATEMENTS}, {_scores_sql("st", X.PROXY)},
lx as (select sc.*, st.speaker, st."window", year(date) * 12 + month(date) + day(date) / 31.0::double as t from sc join st on sc.id = st.id)"""
_RES = f"""{_LEX},
m as (select avg(ln(greatest(words, 1))) as m1, greatest(stddev_pop(ln(greatest(words, 1))), 1e-6) as s1, avg(t) as m2, greatest(stddev_pop(t), 1e-6) as s2 from lx),
dz as (select lx.*, (ln(greatest(words, 1)) - m1) / s1 as x1, (t - m2) / s2 as x2 from lx, m),
sm as (select count(*) as n, sum(x1 * x1) + 1e-6 as a, sum(x1 * x2) as b, sum(x2 * x2) + 1e-6 as d,
  sum(hedging) as y1, sum(x1 * hedging) as p1, sum(x2 * hedging) as q1, sum(pronoun_distancing) as y2, sum(x1 * pronoun_distancing) as p2, sum(x2 * pronoun_distancing) as q2 from dz),
bt as (select y1 / (n + 1e-6) as b01, (d * p1 - b * q1) / (a * d - b * b) as b11, (a * q1 - b * p1) / (a * d - b * b) as b21, y1 / n as mm1,
  y2 / (n + 1e-6) as b02, (d * p2 - b * q2) / (a * d - b * b) as b12, (a * q2 - b * p2) / (a * d - b * b) as b22, y2 / n as mm2 from sm),
rs as (select id, speaker, "window", hedging, pronoun_distancing, hedging - (b01 + b11 * x1 + b21 * x2) + mm1 as resid_hedging,
  pronoun_distancing - (b02 + b12 * x1 + b22 * x2) + mm2 as resid_pronoun_distancing from dz, bt)"""
_LEX2 = ["hedging", "pronoun_distancing"]


@REGISTRY.query(f"with {_RES} select id, round(resid_hedging, 5) as resid_hedging, round(resid_pronoun_distancing, 5) as resid_pronoun_distancing from rs")
def q_residualise(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = B.residualise(_lexical(spark, sf_dir), _LEX2)
    return r.select("id", *[F.round(f"resid_{f}", 5).alias(f"resid_{f}") for f in _LEX2])


@REGISTRY.query(
    f"""with {_RES} select 'hedging' as feature, round(greatest(0, least(1, 1 - var_pop(resid_hedging) / greatest(var_pop(hedging), 1e-9))), 6) as explained from rs
    union all select 'pronoun_distancing', round(greatest(0, least(1, 1 - var_pop(resid_pronoun_distancing) / greatest(var_pop(pronoun_distancing), 1e-9))), 6) from rs"""
)
def q_variance_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.variance_explained(B.residualise(_lexical(spark, sf_dir), _LEX2), _LEX2)
    return found.select("feature", F.round("explained", 6).alias("explained"))


@REGISTRY.query(
    f"""with {_RES}, b0 as (select speaker, round(avg(resid_hedging), 4) as m1, round(greatest(stddev_samp(resid_hedging), 0.12), 4) as s1,
    round(avg(resid_pronoun_distancing), 4) as m2, round(greatest(stddev_samp(resid_pronoun_distancing), 0.12), 4) as s2 from rs where "window" = 'baseline' group by 1 having count(*) >= 2)
    select rs.speaker, count(*) as n, round(avg(0.5::double * (resid_hedging - m1) / s1 + 0.5::double * (resid_pronoun_distancing - m2) / s2), 4) as divergence
    from rs join b0 on rs.speaker = b0.speaker where "window" = 'constrained' group by 1"""
)
def q_text_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical scores, confounds removed, against the speaker's baseline, by speaker."""
    r = B.residualise(_lexical(spark, sf_dir), _LEX2)
    names = {f"resid_{f}": 0.5 for f in _LEX2}
    base = B.v0_baseline(r, "speaker", list(names), F.col("window") == "baseline")
    z = sum((F.lit(w) * (F.col(f) - F.col(f"mean_{f}")) / F.col(f"sd_{f}") for f, w in names.items()), F.lit(0.0))
    held = r.where("window = 'constrained'").join(base, "speaker")
    return held.groupBy("speaker").agg(F.count("*").alias("n"), F.round(F.avg(z), 4).alias("divergence"))


# Two features: the inverse has a closed form, so the whole model fits into SQL.
_LW = f"""{_EV}, f1 as (select speaker, count(*) as n, avg(value) as mv, avg(k) as mk from ce where "window" = 'baseline' group by 1 having count(*) >= 2),
cn as (select ce.speaker, n, mv, mk, value - mv as cv, k - mk as ck from ce join f1 on ce.speaker = f1.speaker where "window" = 'baseline'),
mo as (select speaker, any_value(n) as n, any_value(mv) as mv, any_value(mk) as mk, avg(cv * cv) as svv, avg(cv * ck) as svk, avg(ck * ck) as skk,
       sum((cv * cv + ck * ck) * (cv * cv + ck * ck)) as q from cn group by 1),
mi as (select *, svv + skk as tr, svv * svv + 2 * svk * svk + skk * skk as sq from mo),
md as (select *, (sq - tr * tr + 2 * (tr / 2) * (tr / 2)) / 2 as delta, (q / n - sq) / (2 * n) as beta from mi),
sh as (select *, case when beta <= 0 then 0 else least(beta, delta) / greatest(delta, 1e-300) end as s from md),
cv as (select *, case when n < 3 then greatest(svv, 1e-3) else (1 - s) * svv + s * tr / 2 + 1e-4 end as c11,
       case when n < 3 then 0 else (1 - s) * svk end as c12,
       case when n < 3 then greatest(skk, 1e-3) else (1 - s) * skk + s * tr / 2 + 1e-4 end as c22, case when n < 3 then 1 else s end as intensity from sh),
po as (select avg(mv) as pv, avg(mk) as pk, coalesce(var_samp(mv), 1) as bv, coalesce(var_samp(mk), 1) as bk, avg(svv * n / (n - 1)) as wv, avg(skk * n / (n - 1)) as wk from cv),
eb as (select cv.*, pv, pk, (greatest(bv - wv / n, 1e-6) / (greatest(bv - wv / n, 1e-6) + wv / n) + greatest(bk - wk / n, 1e-6) / (greatest(bk - wk / n, 1e-6) + wk / n)) / 2 as w from cv, po),
bl as (select *, w * mv + (1 - w) * pv as mean_value, w * mk + (1 - w) * pk as mean_k, c11 * c22 - c12 * c12 as det from eb),
an as (select ce.id, ce.speaker, ce.value, ce.k, ce.days_to_event, value - mean_value as dv, k - mean_k as dk, c11, c12, c22, det,
       (c22 * (value - mean_value) * (value - mean_value) - 2 * c12 * (value - mean_value) * (k - mean_k) + c11 * (k - mean_k) * (k - mean_k)) / det as d2,
       ((value - mean_value) * (c22 * 1.0 - c12 * 0.8) + (k - mean_k) * (c11 * 0.8 - c12 * 1.0)) / det
         / sqrt((c22 * 1.0 - 2 * c12 * 0.8 + c11 * 0.64) / det) as projection
       from ce join bl on ce.speaker = bl.speaker where ce."window" = 'constrained')"""
DIRECTION = (1.0, 0.8)


def _baseline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _covered(spark, sf_dir).where("window = 'baseline'")


@REGISTRY.query(f"with {_LW} select speaker, n, round(c11, 4) as cov_value_value, round(c12, 4) as cov_value_k, round(c22, 4) as cov_k_k, round(intensity, 6) as intensity from cv")
def q_ledoit_wolf_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    cov = B.covariances(B.speaker_moments(_baseline_rows(spark, sf_dir), "speaker", TWO), "speaker", TWO)
    return cov.select("speaker", "n", *[F.round(c, 4).alias(c) for c in ("cov_value_value", "cov_value_k", "cov_k_k")], F.round("intensity", 6).alias("intensity"))


@REGISTRY.query(f"with {_LW} select speaker, n, round(w, 6) as weight, round(1 - w, 3) as mean_shrinkage, round(mean_value, 5) as mean_value, round(mean_k, 5) as mean_k from bl")
def q_eb_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    cov = B.covariances(B.speaker_moments(_baseline_rows(spark, sf_dir), "speaker", TWO), "speaker", TWO)
    m = B.shrunken_means(cov, "speaker", TWO)
    return m.select("speaker", "n", F.round("weight", 6).alias("weight"), "mean_shrinkage", F.round("mean_value", 5).alias("mean_value"), F.round("mean_k", 5).alias("mean_k"))


def _anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = B.fit_baselines(_baseline_rows(spark, sf_dir), "speaker", TWO)
    rows = _covered(spark, sf_dir).where("window = 'constrained'").select("id", "speaker", "value", "k", "days_to_event")
    return B.anomalies(rows, base, "speaker", TWO, DIRECTION)


@REGISTRY.query(f"with {_LW} select id, speaker, round(sqrt(d2), 4) as mahalanobis, round(exp(-d2 / 2), 6) as p_chi2, round(100 * (1 - exp(-d2 / 2)), 3) as percentile from an")
def q_mahalanobis_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _anomalies(spark, sf_dir)
    return a.select("id", "speaker", F.round("mahalanobis", 4).alias("mahalanobis"), F.round("p_chi2", 6).alias("p_chi2"), F.round("percentile", 3).alias("percentile"))


@REGISTRY.query(f"with {_LW} select id, speaker, round(projection, 4) as projection from an")
def q_signed_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anomalies(spark, sf_dir).select("id", "speaker", F.round("projection", 4).alias("projection"))


@REGISTRY.query(
    f"""with {_LW} select id, round(dv / greatest(sqrt(c11), 1e-6), 4) as z_value, round(dk / greatest(sqrt(c22), 1e-6), 4) as z_k,
    case when abs(dv / greatest(sqrt(c11), 1e-6)) >= abs(dk / greatest(sqrt(c22), 1e-6)) then 'value' else 'k' end as loudest from an"""
)
def q_marginal_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _anomalies(spark, sf_dir)
    loud = F.when(F.abs("z_value") >= F.abs("z_k"), "value").otherwise("k")
    return a.select("id", F.round("z_value", 4).alias("z_value"), F.round("z_k", 4).alias("z_k"), loud.alias("loudest"))


@REGISTRY.query(
    f"""with {_LW}, w as (select id, (sqrt(c22 / det) * dv - c12 / det / sqrt(c22 / det) * dk) as w1, sqrt(c11 / det - c12 * c12 / det / det / (c22 / det)) * dk as w2 from an)
    select id, round(w1 * w1 / (w1 * w1 + w2 * w2), 4) as attribution_value, round(w2 * w2 / (w1 * w1 + w2 * w2), 4) as attribution_k from w"""
)
def q_attribution_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _anomalies(spark, sf_dir)
    return a.select("id", F.round("attribution_value", 4).alias("attribution_value"), F.round("attribution_k", 4).alias("attribution_k"))


@REGISTRY.query(
    f"""with {_LW}, d as (select ce.speaker, id, round((value - mean_value) * (value - mean_value) / c11 + (k - mean_k) * (k - mean_k) / c22, 9) as d
    from ce join bl on ce.speaker = bl.speaker where ce."window" = 'baseline'),
    r as (select *, row_number() over (partition by speaker order by d, id) as rn from d) select speaker, id, round(d, 4) as distance from r where rn = 1"""
)
def q_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _baseline_rows(spark, sf_dir)
    return B.representative(rows, B.fit_baselines(rows, "speaker", TWO), "speaker", TWO, "id")


@REGISTRY.query()
def q_mahalanobis_6d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six features of the embeddings against the baseline of their label; attribution and dominant feature."""
    names = [f"f{i}" for i in range(6)]
    em = V.table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.element_at("embedding", i + 1).cast("double").alias(f) for i, f in enumerate(names)])
    base = B.fit_baselines(em.where("vec_id % 5 <> 0"), "label", names)
    found = B.anomalies(em.where("vec_id % 5 = 0"), base, "label", names, (1.0, 1.0, 0.8, 0.9, 0.3, 0.6))
    return found.select("vec_id", "label", "mahalanobis", "p_chi2", "percentile", "projection", "dominant_feature", *[f"attribution_{f}" for f in names])
