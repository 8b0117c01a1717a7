"""Calendar: windows, labels, shares, pivots, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calendar as C
from ..operators.game import outcome_class
from ..sources.corpus import star_tables
from . import views as V
from .registry import Registry

REGISTRY = Registry()


@REGISTRY.query(f"with {V.CALENDAR} select s as start, e as \"end\", m as meeting from wn")
def q_blackout_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.constrained_windows(C.meetings(spark))


@REGISTRY.query(f"with {V.CALENDAR} select * from cal")
def q_labelled_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.labelled_days(C.meetings(spark))


@REGISTRY.query(
    f"""with {V.CALENDAR}, {V.STATEMENTS} select id, speaker, date, coalesce(cal."window", 'out_of_coverage') as label, next_event, days_to_event
    from st left join cal on date = day"""
)
def q_label_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = V.statements(spark, sf_dir).select("id", "speaker", "date")
    return C.label_windows(st, "date", C.meetings(spark)).withColumnRenamed("window", "label")


@REGISTRY.query(f"with {V.EVENTS} select d, \"window\", next_event, days_to_event, count(*) as n from ev group by all")
def q_label_events_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.events(spark, sf_dir).groupBy("d", "window", "next_event", "days_to_event").agg(F.count("*").alias("n"))


@REGISTRY.query(
    f"""with {V.CALENDAR}, days as (select cast(unnest(generate_series(date '2024-01-01', date '2026-12-30', interval 1 day)) as date) as d)
    select count(*) as n_days, count(*) filter (where cal."window" = 'constrained') as n_constrained,
           count(*) filter (where cal."window" = 'constrained') / count(*) as share from days left join cal on d = day"""
)
def q_calendar_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.calendar_share(C.meetings(spark), "2024-01-01", "2026-12-31")


@REGISTRY.query(
    f"""with {V.EVENTS}, days as (select cast(unnest(generate_series(date '2024-01-01', date '2026-12-30', interval 1 day)) as date) as dd),
    sh as (select count(*) filter (where cal."window" = 'constrained') / count(*) as calendar_share from days left join cal on dd = day),
    own as (select count(*) as n, count(*) filter (where "window" = 'constrained') as n_constrained from ev where "window" <> 'out_of_coverage')
    select n, n_constrained, n_constrained / n as row_share, calendar_share, calendar_share / (n_constrained / n) as suppression from own, sh"""
)
def q_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.suppression(V.events(spark, sf_dir), C.meetings(spark), "2024-01-01", "2026-12-31")


@REGISTRY.query(
    f"""with {V.EVENTS} select speaker, count(*) filter (where "window" = 'baseline') as n_baseline,
    count(*) filter (where "window" = 'constrained') as n_constrained, count(*) as n from ev group by 1"""
)
def q_window_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.window_pivot(V.events(spark, sf_dir), "speaker")


@REGISTRY.query(
    f"""with {V.CALENDAR} select o_custkey as speaker, count(*) as n, count(*) filter (where cal."window" = 'constrained') as n_constrained,
    min(days_to_event) as nearest from orders left join cal on cast(o_orderdate as date) = day group by 1"""
)
def q_label_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = V.table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("od"))
    labelled = C.label_windows(orders, "od", C.meetings(spark))
    return labelled.groupBy(F.col("o_custkey").alias("speaker")).agg(
        F.count("*").alias("n"), F.count_if(F.col("window") == "constrained").alias("n_constrained"), F.min("days_to_event").alias("nearest")
    )


@REGISTRY.query(
    f"""with {V.EVENTS} select case when value - 50 < -2.5 then 'miss' when value - 50 > 2.5 then 'beat' else 'inline' end as outcome,
    cast(abs(value - 50) >= 6 as integer) as material, count(*) as n from ev where "window" = 'constrained' and value is not null group by all"""
)
def q_outcome_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = V.events(spark, sf_dir).where("window = 'constrained' and value is not null").withColumn("move", F.col("value") - 50)
    return ev.groupBy(outcome_class(F.col("move")).alias("outcome"), (F.abs("move") >= 6).cast("int").alias("material")).agg(F.count("*").alias("n"))


@REGISTRY.query(
    f"""with {V.STATEMENTS}, o as (select id, cast(id % 21 as double) - 10 as move from st)
    select 'out_' || cast(st.id as varchar) as outcome_id, 'evt_' || cast(st.id as varchar) as event_id,
    replace(replace(speaker, ' ', '_'), '.', '') as speaker_id, move, abs(move) as abs_move, abs(move) >= 6 as is_material
    from st join o on st.id = o.id where "window" = 'constrained'"""
)
def q_star_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = V.statements(spark, sf_dir).withColumn("id", F.col("id").cast("string"))
    moves = st.select("id", ((F.col("id").cast("bigint") % 21).cast("double") - 10).alias("move"))
    tables = star_tables(st, moves)
    return tables["outcomes"].join(tables["events"].select("event_id", "speaker_id"), "event_id")
