"""The driver's tables seen as statements, events and features, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import MEETINGS
from ..operators.calendar import label_windows, meetings


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def statements(spark: SparkSession, sf_dir: str, more: dict[str, str] | None = None) -> DataFrame:
    """``documents`` as statements: speaker = source, one in seven constrained, a date by id; ``more`` names further columns."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("speaker"),
        "text",
        F.when(F.col("doc_id") % 7 == 0, "constrained").otherwise("baseline").alias("window"),
        F.date_add(F.lit("2021-02-01").cast("date"), (F.col("doc_id") % 2000).cast("int")).alias("date"),
        *[F.col(c).alias(name) for c, name in (more or {}).items()],
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` under the real calendar: speaker = user, two numeric features."""
    own = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("speaker"),
        F.to_date("ts").alias("d"),
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )
    return label_windows(own, "d", meetings(spark))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with their length."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source", "n_chars", "quality", "toxic")


_VALUES = ", ".join(f"(date '{a}', date '{b}')" for a, b in MEETINGS)
CALENDAR = f"""
mt as (select * from (values {_VALUES}) t(first_day, last_day)),
wn as (select first_day - cast((isodow(first_day) + 1) % 7 + 7 as integer) as s, last_day + 1 as e, first_day as m from mt),
cov as (select min(s) as lo, max(m) as hi from wn),
spine as (select cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as day from cov),
cal as (select day, case when own is not null then 'constrained' else 'baseline' end as "window", coalesce(own, nxt) as next_event,
        cast(coalesce(own, nxt) - day as integer) as days_to_event
        from (select day, (select max(m) from wn where day between s and e) as own, (select min(m) from wn where m >= day) as nxt from spine))
"""
STATEMENTS = """
st as (select doc_id as id, source as speaker, text, case when doc_id % 7 = 0 then 'constrained' else 'baseline' end as "window",
       date '2021-02-01' + cast(doc_id % 2000 as integer) as date from documents)
"""
EVENTS = f"""{CALENDAR},
ev as (select event_id as id, user_id as speaker, cast(ts as date) as d, value, cast(json_extract_string(props, '$.k') as double) as k,
       coalesce("window", 'out_of_coverage') as "window", next_event, days_to_event
       from events left join cal on cast(ts as date) = day)
"""
LABELLED = """
lb as (select d.doc_id, d.source, d.n_chars, l.quality, l.toxic from documents d join labels l on d.doc_id = l.doc_id)
"""
TERMS = rf"""{STATEMENTS},
tk as (select id, speaker, "window", unnest(regexp_extract_all(lower(text), '[a-z'']+')) as word from st),
tf as (select id, speaker, "window", word, count(*) as c from tk group by all),
bg as (select word, sum(c) as c_bg from tf group by 1),
en as (select speaker from st where "window" = 'baseline' group by 1 having count(*) >= 2),
lm as (select speaker, word, sum(c) as c_s from tf where "window" = 'baseline' and speaker in (select speaker from en) group by 1, 2),
ls as (select en.speaker, coalesce(sum(c_s), 0) as n_s from en left join lm on en.speaker = lm.speaker group by 1),
bs as (select sum(c_bg) as n_bg, count(*) as v_bg from bg),
pr as (select tf.*, lm.c_s, (coalesce(lm.c_s, 0) + 300.0::double * (coalesce(bg.c_bg, 0) + 0.5) / (n_bg + 0.5 * v_bg + 1)) / (n_s + 300.0::double) as p
       from tf join ls on tf.speaker = ls.speaker left join lm on tf.speaker = lm.speaker and tf.word = lm.word left join bg on tf.word = bg.word, bs),
nm as (select id, sum(c) as n, sum(p) as mass from pr group by 1),
sx as (select pr.id, any_value(speaker) as speaker, any_value("window") as "window", any_value(n) as n,
       -sum(c * log2(p)) / any_value(n) as ce,
       sum((c / n) * log2((c / n) / (p / mass))) as kl,
       0.5 * sum((c / n) * log2((c / n) / ((c / n + p / mass) / 2))) + 0.5 * sum((p / mass) * log2((p / mass) / ((c / n + p / mass) / 2))) as jsd,
       sum(case when c_s is null then c else 0 end) / any_value(n) as novel
       from pr join nm on pr.id = nm.id group by pr.id),
be as (select st.speaker, avg(coalesce(ce, 0)) as bce, coalesce(stddev_samp(coalesce(ce, 0)), 0) as bsd from st join en on st.speaker = en.speaker left join sx on st.id = sx.id where st."window" = 'baseline' group by 1)
"""
