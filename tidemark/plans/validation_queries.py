"""Rank statistics, calibration, resampling and studies over measured rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import learn, studies, worldstudies
from ..operators import validate as S
from . import views as V
from .anomaly_queries import _EV, _covered
from .registry import Registry

REGISTRY = Registry()
_NEAR = f"""{_EV}, cn as (select id, speaker, value, k, days_to_event from ce where "window" = 'constrained')"""


def _constrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _covered(spark, sf_dir).where("window = 'constrained'").select("id", "speaker", "value", "k", "days_to_event")


def _rank(x: str, part: str = "") -> str:
    p = f"partition by {part} " if part else ""
    q = f"partition by {part}, {x}" if part else f"partition by {x}"
    return f"rank() over ({p}order by {x}) + (count(*) over ({q}) - 1) / 2.0"


@REGISTRY.query(f"with {_NEAR}, r as (select {_rank('value')} as rx, {_rank('k')} as ry from cn) select count(*) as n, round(corr(rx, ry), 6) as rho from r")
def q_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.spearman(_constrained(spark, sf_dir), "value", "k").select("n", F.round("rho", 6).alias("rho"))


@REGISTRY.query(
    f"""with {_NEAR}, r as (select speaker, row_number() over (partition by speaker order by value, id) as rx, row_number() over (partition by speaker order by k, id) as ry from cn)
    select speaker, count(*) as n, round(case when count(*) < 3 then 0 else 1 - 6 * sum((rx - ry) * (rx - ry)) / greatest(count(*) * (count(*) * count(*) - 1), 1) end, 3)::double as rho from r group by 1"""
)
def q_spearman_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.spearman_ordinal(_constrained(spark, sf_dir), "value", "k", "id", ["speaker"])


_WITHIN = f"""{_NEAR}, nr as (select *, -days_to_event as near from cn),
wr as (select speaker, id, value, near, {_rank('value', 'speaker')} as rx, {_rank('near', 'speaker')} as ry from nr),
ws as (select speaker, count(*) as n, corr(rx, ry) as rho from wr group by 1 having count(*) >= 3 and stddev_pop(value) > 1e-9 and stddev_pop(near) > 1e-9)"""


@REGISTRY.query(f"with {_WITHIN} select speaker, n, round(rho, 6) as rho from ws")
def q_within_speaker_rho(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _constrained(spark, sf_dir).withColumn("near", -F.col("days_to_event"))
    return studies.within_speaker_rho(ev, "speaker", "value", "near").select("speaker", "n", F.round("rho", 6).alias("rho"))


@REGISTRY.query(
    f"""with {V.LABELLED}, r as (select quality, {_rank('n_chars')} as rx from lb), s as (select sum(rx) filter (where quality = 1) as r, count(*) filter (where quality = 1) as n1, count(*) filter (where quality = 0) as n0 from r)
    select n1 as n_pos, n0 as n_neg, round((r - n1 * (n1 + 1) / 2.0) / (n1 * n0), 6) as auc from s"""
)
def q_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.auc(V.labelled_documents(spark, sf_dir), "n_chars", "quality").select("n_pos", "n_neg", F.round("auc", 6).alias("auc"))


_CAL = f"{V.LABELLED}, pb as (select doc_id, toxic, cast(doc_id % 97 as double) / 97 as p from lb)"


def _probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.labelled_documents(spark, sf_dir).select("doc_id", "toxic", ((F.col("doc_id") % 97).cast("double") / 97).alias("p"))


@REGISTRY.query(
    f"""with {_CAL} select cast(least(floor(p * 5), 4) as integer) as bin, count(*) as n, round(avg(p), 6) as mean_p, round(avg(toxic), 6) as observed, round(abs(avg(p) - avg(toxic)), 6) as gap from pb group by 1"""
)
def q_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.calibration(_probabilities(spark, sf_dir), "p", "toxic")
    return c.select("bin", "n", *[F.round(x, 6).alias(x) for x in ("mean_p", "observed", "gap")])


@REGISTRY.query(
    f"""with {_CAL}, b as (select least(floor(p * 5), 4) as bin, count(*) as n, abs(avg(p) - avg(toxic)) as gap from pb group by 1)
    select (select round(avg((p - toxic) * (p - toxic)), 6) from pb) as brier, (select count(*) from pb) as n, round(sum(n * gap) / sum(n), 6)::double as ece from b"""
)
def q_calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.calibration_error(_probabilities(spark, sf_dir), "p", "toxic").select(F.round("brier", 6).alias("brier"), "n", F.round("ece", 6).alias("ece"))


def _permutation_sql(n: int, block: bool, seed: int = 7) -> str:
    part = "rep, speaker" if block else "rep"
    on = "a.rep = b.rep and a.speaker = b.speaker and a.slot = b.drawn" if block else "a.rep = b.rep and a.slot = b.drawn"
    return f"""with {_NEAR}, rk as (select id, speaker, {_rank('value')} as rx, {_rank('k')} as ry from cn), ob as (select corr(rx, ry) as observed from rk),
    gr as (select rk.*, rep from rk, (select unnest(range({n})) as rep)),
    sl as (select *, row_number() over (partition by {part} order by id) as slot, row_number() over (partition by {part} order by md5(rep || '-' || id || '-{seed}'), id) as drawn from gr),
    nl as (select a.rep, corr(a.rx, b.ry) as s from sl a join sl b on {on} group by 1)
    select round(any_value(observed), 6) as observed, (count(*) filter (where abs(s) >= abs(observed) - 1e-12) + 1) / (count(*) + 1) as p_value,
    round(avg(s), 6) as null_mean, round(stddev_pop(s), 6) as null_sd, count(*) as n_perm from nl, ob"""


def _tested(spark: SparkSession, sf_dir: str, block: str | None) -> DataFrame:
    t = S.permutation_test(_constrained(spark, sf_dir), "value", "k", "id", 200, block)
    return t.select(F.round("observed", 6).alias("observed"), "p_value", F.round("null_mean", 6).alias("null_mean"), F.round("null_sd", 6).alias("null_sd"), "n_perm")


@REGISTRY.query(_permutation_sql(200, False))
def q_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tested(spark, sf_dir, None)


@REGISTRY.query(_permutation_sql(200, True))
def q_permutation_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tested(spark, sf_dir, "speaker")


@REGISTRY.query(
    f"""with {_NEAR}, nb as (select row_number() over (order by id) - 1 as i, value, k, count(*) over () as n from cn),
    dr as (select rep, ('0x' || substr(md5(rep || '-' || i || '-7'), 1, 8))::bigint % n as i from nb, (select unnest(range(100)) as rep)),
    bs as (select rep, value, k from dr join nb on dr.i = nb.i),
    rk as (select rep, {_rank('value', 'rep')} as rx, {_rank('k', 'rep')} as ry from bs), rh as (select rep, corr(rx, ry) as rho from rk group by 1)
    select round(quantile_cont(rho, 0.025), 6) as lo, round(quantile_cont(rho, 0.975), 6) as hi, count(*) as n_boot from rh"""
)
def q_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bootstrap_ci(_constrained(spark, sf_dir), "value", "k", "id", 100).select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n_boot")


@REGISTRY.query(
    f"""with {_NEAR}, b as (select * from (values (0, -5.0::double, 0.0::double), (1, 0, 3), (2, 3, 6), (3, 6, 9), (4, 9, 12), (5, 12, 30)) t(bin, lo, hi))
    select bin, lo, hi, count(value) as n, round(avg(value), 5) as mean from b left join cn on days_to_event >= lo and days_to_event < hi group by 1, 2, 3"""
)
def q_dose_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = studies.binned_mean(_constrained(spark, sf_dir), "days_to_event", "value", (-5, 0, 3, 6, 9, 12, 30))
    return m.withColumn("mean", F.round("mean", 5))


@REGISTRY.query(
    f"""with {_WITHIN}, ob as (select median(rho) as observed, count(*) as n_speakers, avg(cast(rho > 1e-12 as integer)) as share_positive from ws),
    gr as (select wr.*, rep from wr, (select unnest(range(60)) as rep) where speaker in (select speaker from ws)),
    sl as (select rep, speaker, rx, ry, row_number() over (partition by rep, speaker order by id) as slot, row_number() over (partition by rep, speaker order by md5(rep || '-' || id || '-11'), id) as drawn from gr),
    nl as (select a.rep, a.speaker, corr(a.rx, b.ry) as rho from sl a join sl b on a.rep = b.rep and a.speaker = b.speaker and a.slot = b.drawn group by 1, 2),
    ns as (select rep, median(rho) as s from nl group by 1),
    pr as (select id, speaker, {_rank('value')} as rx, {_rank('near')} as ry from nr), po as (select corr(rx, ry) as rho_pooled from pr),
    pg as (select pr.*, rep from pr, (select unnest(range(60)) as rep)),
    ps as (select rep, speaker, rx, ry, row_number() over (partition by rep, speaker order by id) as slot, row_number() over (partition by rep, speaker order by md5(rep || '-' || id || '-7'), id) as drawn from pg),
    pn as (select a.rep, corr(a.rx, b.ry) as s from ps a join ps b on a.rep = b.rep and a.speaker = b.speaker and a.slot = b.drawn group by 1),
    pp as (select (count(*) filter (where abs(s) >= abs(rho_pooled) - 1e-12) + 1) / (count(*) + 1) as p_pooled, any_value(rho_pooled) as rho_pooled from pn, po)
    select (select count(*) from nr) as n, 'ok' as status, round(any_value(observed), 6) as observed, any_value(n_speakers) as n_speakers, round(any_value(share_positive), 6) as share_positive,
    (count(*) filter (where s >= observed - 1e-12) + 1) / (count(*) + 1) as p_within, count(*) as n_perm, round(any_value(rho_pooled), 6) as rho_pooled, any_value(p_pooled) as p_pooled from ns, ob, pp"""
)
def q_dose_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = studies.dose_response(_constrained(spark, sf_dir), "speaker", "id", "value", "days_to_event", 60)
    rounded = [F.round(c, 6).alias(c) for c in ("observed", "share_positive", "rho_pooled")]
    return d.select("n", "status", "n_speakers", *rounded, "p_within", "p_pooled", "n_perm")


@REGISTRY.query(
    f"""with {_NEAR} select speaker, count(*) as n, round(avg(cast(value >= 60 as integer)), 6) as flag_rate,
    round(avg(cast(value >= 60 as integer)) filter (where k >= 50), 6) as true_rate, round(avg(cast(value >= 60 as integer)) filter (where not k >= 50), 6) as false_rate from cn group by 1"""
)
def q_flag_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = studies.flag_rates(_constrained(spark, sf_dir), "speaker", "value", 60, F.col("k") >= 50)
    return f.select("speaker", "n", *[F.round(c, 6).alias(c) for c in ("flag_rate", "true_rate", "false_rate")])


@REGISTRY.query(
    f"""with {_NEAR}, c as (select quantile_cont(value, 0.9) as qa, quantile_cont(k, 0.9) as qb from cn)
    select count(*) filter (where value >= qa) as alarms_a, round(count(*) filter (where value >= qa and days_to_event <= 3) / nullif(count(*) filter (where value >= qa), 0), 6) as precision_a,
    round(count(*) filter (where value >= qa and days_to_event <= 3) / nullif(count(*) filter (where days_to_event <= 3), 0), 6) as recall_a,
    count(*) filter (where k >= qb) as alarms_b, round(count(*) filter (where k >= qb and days_to_event <= 3) / nullif(count(*) filter (where k >= qb), 0), 6) as precision_b,
    round(count(*) filter (where k >= qb and days_to_event <= 3) / nullif(count(*) filter (where days_to_event <= 3), 0), 6) as recall_b from cn, c"""
)
def q_matched_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = studies.matched_budget(_constrained(spark, sf_dir), "value", "k", 0.1, F.col("days_to_event") <= 3)
    return m.select("alarms_a", "alarms_b", *[F.round(f"{x}_{s}", 6).alias(f"{x}_{s}") for s in "ab" for x in ("precision", "recall")])


_SIZES, _POWER_PERMUTATIONS = (4, 8, 12, 20), 200
_POWER = f"""{_EV}, cn as (select id, speaker, value, cast(k >= 50 as integer) as y from ce where "window" = 'constrained'),
sp as (select distinct speaker from cn), gr as (select speaker, size, draw from sp, (select unnest([4, 8, 12, 20]) as size), (select unnest(range(20)) as draw)),
pk as (select *, row_number() over (partition by size, draw order by md5(size || '-' || draw || '-' || speaker || '-3'), speaker) as kk from gr),
ra as (select size, draw, cn.speaker, id, value, y from pk join cn on pk.speaker = cn.speaker where kk <= size),
ok as (select size, draw, count(*) as n from ra group by 1, 2 having count(*) >= 6 and count(distinct y) > 1),
rw as (select ra.*, n from ra join ok on ra.size = ok.size and ra.draw = ok.draw),
rk as (select size, draw, speaker, id, y, {_rank('value', 'size, draw')} as r, {_rank('y', 'size, draw')} as ry from rw),
ag as (select size, draw, count(*) filter (where y = 1) as n1, count(*) filter (where y = 0) as n0, sum(r) filter (where y = 1) as r, corr(r, ry) as observed from rk group by 1, 2),
gs as (select rk.*, rep from rk, (select unnest(range({_POWER_PERMUTATIONS})) as rep)),
sl as (select *, row_number() over (partition by rep, size, draw, speaker order by id) as slot, row_number() over (partition by rep, size, draw, speaker order by md5(rep || '-' || id || '-7'), id) as drawn from gs),
nl as (select a.size, a.draw, a.rep, corr(a.r, b.ry) as s from sl a join sl b on a.rep = b.rep and a.size = b.size and a.draw = b.draw and a.speaker = b.speaker and a.slot = b.drawn group by all),
pv as (select nl.size, nl.draw, (count(*) filter (where abs(s) >= abs(observed) - 1e-12) + 1) / (count(*) + 1) as p from nl join ag on nl.size = ag.size and nl.draw = ag.draw where s is not null and not isnan(s) group by 1, 2),
au as (select ag.size, (r - n1 * (n1 + 1) / 2.0) / (n1 * n0) as auc, p, n from ag join pv on ag.size = pv.size and ag.draw = pv.draw join ok on ag.size = ok.size and ag.draw = ok.draw),
pw as (select size, count(*) as draws, cast(floor(median(n)) as integer) as median_n, avg(auc) as auc_mean, quantile_cont(auc, 0.1) as auc_q10, quantile_cont(auc, 0.9) as auc_q90, median(p) as median_p,
       avg(cast(p < 0.05 as integer)) as power from au group by 1)"""


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _constrained(spark, sf_dir).withColumn("y", (F.col("k") >= 50).cast("int"))
    return studies.power_curve(own, "speaker", "id", "value", "y", _SIZES, 20, _POWER_PERMUTATIONS)


@REGISTRY.query(
    f"""with {_POWER} select cast(size as integer) as size, draws, median_n, round(auc_mean, 6) as auc_mean, round(auc_q10, 6) as auc_q10, round(auc_q90, 6) as auc_q90,
    round(median_p, 6) as median_p, round(power, 6) as power from pw"""
)
def q_power_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curve(spark, sf_dir).select("size", "draws", "median_n", *[F.round(c, 6).alias(c) for c in ("auc_mean", "auc_q10", "auc_q90", "median_p", "power")])


@REGISTRY.query(
    f"""with {_POWER}, f as (select count(*) as points, max(power) as top, regr_slope(power, sqrt(size)) as slope, regr_intercept(power, sqrt(size)) as intercept from pw),
    s as (select *, case when points < 3 then 'insufficient_points' when top < 0.02 then 'no_power' when coalesce(slope, 0) <= 0 then 'power_not_increasing' else 'ok' end as status from f)
    select points, round(top, 6) as top, round(slope, 6) as slope, round(intercept, 6) as intercept, status, case when status = 'ok' then cast(ceil(pow((0.8 - intercept) / slope, 2)) as bigint) end as needed from s"""
)
def q_speakers_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = studies.speakers_needed(_curve(spark, sf_dir))
    return n.select("points", *[F.round(c, 6).alias(c) for c in ("top", "slope", "intercept")], "status", "needed")


@REGISTRY.query(
    """with em as (select vec_id, embedding[1]::double as f0, embedding[2]::double as f1, embedding[3]::double as f2 from embeddings),
    sc as (select greatest(stddev_pop(f0), 1e-9) as s0, greatest(stddev_pop(f1), 1e-9) as s1, greatest(stddev_pop(f2), 1e-9) as s2 from em),
    ds as (select vec_id, sqrt(pow((f0 - 0.1) / s0, 2) + pow((f1 + 0.1) / s1, 2) + pow(f2 / s2, 2)) as d from em, sc),
    kp as (select * from ds order by d, vec_id limit 40), w as (select vec_id, d, greatest(1e-9, 1 - pow(d / (select max(d) from kp), 2)) as w from kp)
    select vec_id, round(d, 6) as d, round(w / (select sum(w) from w), 6) as w from w"""
)
def q_abc_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _nearest(spark, sf_dir)
    return n.select("vec_id", F.round("d", 6).alias("d"), F.round("w", 6).alias("w"))


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    em = V.table(spark, sf_dir, "embeddings").select("vec_id", *[F.element_at("embedding", i + 1).cast("double").alias(f"f{i}") for i in range(4)])
    return studies.nearest(em, ["f0", "f1", "f2"], {"f0": 0.1, "f1": -0.1}, 40, "vec_id")


@REGISTRY.query(
    """with em as (select vec_id, embedding[1]::double as f0, embedding[2]::double as f1, embedding[3]::double as f2, embedding[4]::double as f3 from embeddings),
    sc as (select greatest(stddev_pop(f0), 1e-9) as s0, greatest(stddev_pop(f1), 1e-9) as s1, greatest(stddev_pop(f2), 1e-9) as s2 from em),
    ds as (select vec_id, f3, sqrt(pow((f0 - 0.1) / s0, 2) + pow((f1 + 0.1) / s1, 2) + pow(f2 / s2, 2)) as d from em, sc),
    kp as (select * from ds order by d, vec_id limit 40), w0 as (select vec_id, f3, greatest(1e-9, 1 - pow(d / (select max(d) from kp), 2)) as w from kp),
    w as (select vec_id, f3, w / (select sum(w) from w0) as w from w0),
    cu as (select f3 as v, vec_id, sum(w) over (order by f3, vec_id rows unbounded preceding) / sum(w) over () as c from w),
    lg as (select v, c, lag(v) over (order by c, v, vec_id) as v0, lag(c) over (order by c, v, vec_id) as c0 from cu),
    iq as (select q, first(case when c0 is null then v else v0 + (v - v0) * (q - c0) / greatest(c - c0, 1e-300) end order by c, v) as x from lg, (select unnest([0.1::double, 0.5::double, 0.9::double]) as q) where c >= q group by 1)
    select (select round(sum(w * f3), 6) from w) as mean, round(max(x) filter (where q = 0.1), 6) as q10, round(max(x) filter (where q = 0.5), 6) as q50, round(max(x) filter (where q = 0.9), 6) as q90 from iq"""
)
def q_abc_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _nearest(spark, sf_dir)
    quantiles = studies.weighted_quantiles(near, "f3", "w", "vec_id", (0.1, 0.5, 0.9))
    mean = near.agg(F.round(F.sum(F.col("w") * F.col("f3")), 6).alias("mean"))
    return mean.crossJoin(quantiles).select("mean", *[F.round(q, 6).alias(q) for q in ("q10", "q50", "q90")])


@REGISTRY.query(
    """with em as (select embedding[1]::double as f0 from embeddings), b as (select unnest(range(12)) as bin),
    c as (select cast(least(floor((f0 + 1) / (2.0 / 12)), 11) as integer) as bin, count(*) as n from em where f0 between -1 and 1 group by 1)
    select cast(b.bin as integer) as bin, round(-1 + b.bin * (2.0 / 12), 6)::double as lo, round(-1 + (b.bin + 1) * (2.0 / 12), 6)::double as hi, coalesce(n, 0) as n, round(coalesce(n, 0) / sum(coalesce(n, 0)) over (), 6) as p from b left join c on b.bin = c.bin"""
)
def q_abc_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    em = V.table(spark, sf_dir, "embeddings").select(F.element_at("embedding", 1).cast("double").alias("f0"))
    return studies.histogram(em, "f0", 12, -1.0, 1.0).select("bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n", F.round("p", 6).alias("p"))


@REGISTRY.query(
    f"""with {_NEAR}, q as (select * from cn where id % 3 = 0), r as (select speaker, value, k, {_rank('value', 'speaker')} as rx, {_rank('k', 'speaker')} as ry from q)
    select speaker, round(case when count(*) >= 6 and stddev_pop(value) >= 1e-12 and stddev_pop(k) >= 1e-12 then corr(rx, ry) end, 6) as rho from r group by 1"""
)
def q_rho_of_six(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation within speakers, null under six rows or without variation (every third event, so that some have few)."""
    some = _constrained(spark, sf_dir).where("id % 3 = 0")
    return worldstudies.rho(some, "value", "k", ["speaker"]).select("speaker", F.round("rho", 6).alias("rho"))


@REGISTRY.query(
    f"""with {V.LABELLED}, o as (select doc_id, source, cast(sum(toxic) over (partition by source) - toxic as double) / nullif(count(*) over (partition by source) - 1, 0) as p, toxic from lb)
    select doc_id, round(p, 6) as p from o"""
)
def q_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each labelled document predicted by the others of its source."""
    lb = V.labelled_documents(spark, sf_dir)
    return learn.leave_one_out_mean(lb, "toxic", "p", ["source"]).select("doc_id", F.round("p", 6).alias("p"))


@REGISTRY.query(
    f"""with {_EV}, x as (select speaker, case when k % 10 = 0 then 'nan'::double else value end as v from ce)
    select speaker, count(*) filter (where not isnan(v)) as n, round(avg(v) filter (where not isnan(v)), 6) as mean, round(stddev_pop(v) filter (where not isnan(v)), 6) as sd from x group by 1"""
)
def q_nan_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation that ignore NaN."""
    rows = _covered(spark, sf_dir).withColumn("v", F.when(F.col("k") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return S.nan_moments(rows, "v", ["speaker"]).select("speaker", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@REGISTRY.query()
def q_logistic_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-source-out validation of toxicity from length and quality, for each C."""
    lb = V.labelled_documents(spark, sf_dir).select(
        "doc_id", "source", "toxic", F.log1p(F.col("n_chars")).alias("size"), F.col("quality").cast("double").alias("q")
    )
    return learn.cv_report(learn.grouped_cv(lb, "doc_id", "source", "toxic", ["size", "q"]))
