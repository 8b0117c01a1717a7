"""Text: lexical features, evidence, language models, web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import langmodel as L
from ..operators import lexical as X
from ..operators.calendar import meetings
from ..sources import html as H
from . import views as V
from .registry import Registry

REGISTRY = Registry()
#: Texts with known answers for the real lexicon.
FIXTURE = (
    (1, "We expect revenue of 42.5 million in Q3, up 12% year over year, and I am confident."),
    (2, "I think, broadly speaking, the company is stepping back; there are conditions that might, perhaps, matter over time."),
    (3, "Absolutely no question. We will, clearly, zoom out and it's fair to say management sort of agrees."),
    (4, "Short answer."),
    (5, "The bigger picture: in January we paid 1,200 bps. Our team, i think, we'll see. Maybe. Possibly."),
)
_FIX = ", ".join("({}, '{}')".format(i, t.replace("'", "''")) for i, t in FIXTURE)


def fixture(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FIXTURE), "id bigint, text string")


def _hits(text: str, phrases: list[str]) -> str:
    hay = f"(' ' || lower({text}) || ' ')"
    return " + ".join("(length({h}) - length(replace({h}, '{p}', ''))) // {n}".format(h=hay, p=p.replace("'", "''"), n=len(p)) for p in phrases)


def _unit(x: str) -> str:
    return f"round(greatest(0.0::double, least(1.0::double, {x})), 4)"


def _scores_sql(source: str, lx: X.Lexicon) -> str:
    nums, periods = fixed.NUMERIC_PATTERN.replace("'", "''"), fixed.PERIOD_PATTERN
    return f"""
    hit as (select id, text, cast(greatest(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')), 1) as double) as words,
        {_hits("text", lx.hedges)} as h, {_hits("text", lx.deflectors)} as d, {_hits("text", lx.confidence)} as c,
        {_hits("text", lx.first_person)} as f, {_hits("text", lx.impersonal)} as i,
        len(regexp_extract_all(text, '(?i){nums}')) + len(regexp_extract_all(text, '(?i){periods}')) as n from {source}),
    sc as (select id, {_unit("h / words * 100 / 4.0")} as hedging, {_unit("1 - n / words * 100 / 6.0")} as specificity_avoidance,
        {_unit("(i / words * 100) / greatest(f / words * 100 + i / words * 100, 1e-6)")} as pronoun_distancing,
        {_unit("d / words * 100 / 2.0")} as topic_deflection, {_unit("c / words * 100 / 2.0")} as confidence_language,
        cast(words as integer) as words, round(n / words * 100, 2) as concrete_per_100w from hit)"""


_COLUMNS = ["id", "hedging", "specificity_avoidance", "pronoun_distancing", "topic_deflection", "confidence_language", "words", "concrete_per_100w"]


@REGISTRY.query(f"with {V.STATEMENTS}, {_scores_sql('st', X.PROXY)} select * from sc")
def q_lexical_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.lexical_scores(V.statements(spark, sf_dir), lexicon=X.PROXY).select(*_COLUMNS)


@REGISTRY.query(f"with fx as (select * from (values {_FIX}) t(id, text)), {_scores_sql('fx', X.Lexicon())} select cast(id as bigint) as id, * exclude (id) from sc")
def q_lexical_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.lexical_scores(fixture(spark)).select(*_COLUMNS)


def _evidence_sql(phrases: list[str]) -> str:
    items = ", ".join("'{}'".format(p.replace("'", "''")) for p in phrases)
    return f"""array_to_string(list_slice(list_transform(list_sort(list_transform(list_distinct(list_transform(list_filter([{items}],
        lambda p: contains(' ' || lower(text) || ' ', p)), lambda p: trim(p))), lambda p: {{'n': -length(p), 'p': p}})), lambda s: s.p), 1, 6), '|')"""


@REGISTRY.query(
    f"""with fx as (select * from (values {_FIX}) t(id, text)) select cast(id as bigint) as id, {_evidence_sql(fixed.HEDGES)} as hedging,
    {_evidence_sql(fixed.DEFLECTORS)} as deflection, {_evidence_sql(fixed.CONFIDENCE)} as confidence, {_evidence_sql(fixed.IMPERSONAL)} as impersonal from fx"""
)
def q_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = lambda p: F.array_join(X.evidence(F.col("text"), p), "|")
    return fixture(spark).select(
        "id",
        shown(fixed.HEDGES).alias("hedging"),
        shown(fixed.DEFLECTORS).alias("deflection"),
        shown(fixed.CONFIDENCE).alias("confidence"),
        shown(fixed.IMPERSONAL).alias("impersonal"),
    )


@REGISTRY.query(
    f"""with {V.STATEMENTS} select id, cast(len(regexp_extract_all(text, '(?i){fixed.NUMERIC_PATTERN}')) as integer) as numeric_markers,
    cast(len(regexp_extract_all(text, '(?i){fixed.PERIOD_PATTERN}')) as integer) as period_markers,
    cast(len(regexp_extract_all(text, '(?i){fixed.NUMERIC_PATTERN}')) as varchar) || ' numeric markers' as shown from st"""
)
def q_numeric_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return V.statements(spark, sf_dir).select(
        "id", X.numeric_markers(t).alias("numeric_markers"), X.period_markers(t).alias("period_markers"), X.marker_evidence(t)[0].alias("shown")
    )


@REGISTRY.query(
    f"""with {V.STATEMENTS} select speaker, count(*) as n, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')))::bigint as words
    from st where greatest(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')), 1) >= 400 group by 1"""
)
def q_min_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = V.statements(spark, sf_dir).withColumn("w", X.word_count(F.col("text"))).where("w >= 400")
    return st.groupBy("speaker").agg(F.count("*").alias("n"), F.sum("w").alias("words"))


@REGISTRY.query(f"with {V.TERMS} select word, c_bg::bigint as c_bg from bg")
def q_bg_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.models_and_background(V.statements(spark, sf_dir))[1]


@REGISTRY.query(
    f"""with {V.TERMS}, rk as (select *, row_number() over (partition by speaker order by c_s desc, word) as place from lm)
    select speaker, word, c_s::bigint as c_s, place::integer as place from rk where place <= 50"""
)
def q_lm_top_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = V.statements(spark, sf_dir)
    return L.top_vocabulary(L.models_and_background(st)[0], 50)


@REGISTRY.query(
    f"""with {V.TERMS}, j as (select sx.*, bce, bsd from sx join be on sx.speaker = be.speaker)
    select st.id, st.speaker, st."window", coalesce(n, 0)::bigint as n_tokens,
    case when n >= 40 then round(ce, 4) end as cross_entropy, case when n >= 40 then round(bce, 4) end as baseline_ce,
    coalesce(case when n >= 40 then round((ce - bce) / greatest(bsd, 0.15), 4) end, 0) as surprisal_z,
    case when n >= 40 then round(kl, 4) end as kl, case when n >= 40 then round(jsd, 4) end as jsd, case when n >= 40 then round(novel, 4) end as novel_rate,
    coalesce(n, 0) < 40 as insufficient from st left join j on st.id = j.id"""
)
def q_surprisal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.surprisal(V.statements(spark, sf_dir))


@REGISTRY.query(
    f"""with {V.TERMS}, qt as (select id as text_id, unnest(regexp_extract_all(lower(text), '[a-z'']+')) as word from (values {_FIX}) t(id, text)),
    qc as (select text_id, word, count(*) as c from qt group by all),
    g as (select qc.*, ls.speaker, n_s from qc, ls),
    pp as (select g.*, lm.c_s, (coalesce(lm.c_s, 0) + 300.0::double * (coalesce(c_bg, 0) + 0.5) / (n_bg + 0.5 * v_bg + 1)) / (n_s + 300.0::double) as p
           from g left join lm on g.speaker = lm.speaker and g.word = lm.word left join bg on g.word = bg.word, bs)
    select text_id::bigint as text_id, speaker, sum(c)::bigint as n_tokens, round(-sum(c * log2(p)) / sum(c), 4) as cross_entropy,
    round(sum(case when c_s is null then c else 0 end) / sum(c), 4) as novel_rate from pp group by all"""
)
def q_score_all_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.against_all_speakers(fixture(spark).withColumnRenamed("id", "text_id"), V.statements(spark, sf_dir))


@REGISTRY.query(f"with {V.STATEMENTS} select id, round(year(date) * 12 + month(date) + day(date) / 31.0::double, 6) as t from st")
def q_time_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.statements(spark, sf_dir).select("id", F.round(X.time_index(F.col("date")), 6).alias("t"))


def _strip_sql(c: str) -> str:
    for tag in ("script", "style", "nav", "header", "footer"):
        c = f"regexp_replace({c}, '(?is)<{tag}.*?</{tag}>', ' ', 'g')"
    return c


_BODY = """case when regexp_matches(k, '(?is)<div[^>]*class="[^"]*col-xs-12[^"]*"[^>]*>(.*)')
    then regexp_extract(k, '(?is)<div[^>]*class="[^"]*col-xs-12[^"]*"[^>]*>(.*)', 1) else k end"""


@REGISTRY.query(
    f"""with k as (select page_id, html, {_strip_sql("html")} as k from pages), b as (select page_id, html, {_BODY} as b from k)
    select page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(b, '(?s)<[^>]+>', ' ', 'g'),
    '&nbsp;', ' '), '&amp;', '&'), '&#39;', ''''), '&quot;', '"'), '&mdash;', '—'), '&rsquo;', ''''), '\\s+', ' ', 'g'))) as text_md5,
    case when trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '\\s+', ' ', 'g')) = '' then 'Speech'
    else substr(trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '\\s+', ' ', 'g')), 1, 140) end as title from b"""
)
def q_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = V.table(spark, sf_dir, "pages")
    return pages.select("page_id", F.md5(H.strip_html(F.col("html"))).alias("text_md5"), H.title(F.col("html")).alias("title"))


@REGISTRY.query("""select page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) as href from pages""")
def q_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.links(V.table(spark, sf_dir, "pages"))


@REGISTRY.query(
    """select * from (values ('/newsevents/speech/cook20230216a.htm', date '2023-02-16', 'cook', 'Lisa D. Cook'),
    ('/newsevents/speech/newman20240105b.htm', date '2024-01-05', 'newman', 'Newman'),
    ('/newsevents/speech/powell20240301a.htm', date '2024-03-01', 'powell', 'Jerome H. Powell')) t(url, date, surname, speaker)"""
)
def q_link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = (
        '<a href="/newsevents/speech/powell20240301a.htm">x</a><a href="/newsevents/speech/Powell20240301A.htm">x</a>'
        '<a href="/newsevents/speech/newman20240105b.htm">y</a><a href="/newsevents/testimony/powell20240306a.htm">t</a>'
        '<a href="/newsevents/speech/cook20230216a.htm">z</a><a href="/newsevents/speech/barr20231399a.htm">bad date</a>'
    )
    return H.permalinks(spark.createDataFrame([(index,)], "html string"))


@REGISTRY.query(
    f"""with {V.CALENDAR}, {V.STATEMENTS}, r as (select id, speaker, text, date from st where date >= date '2022-06-01' order by date, id limit 400)
    select r.id, r.speaker, date, cal."window", next_event, days_to_event from r join cal on date = day
    where greatest(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')), 1) >= 400"""
)
def q_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = V.statements(spark, sf_dir).select("id", "speaker", "text", "date")
    return H.ingest(st, meetings(spark), "2022-06-01", 400).drop("text")


@REGISTRY.query(
    f"""with {V.STATEMENTS}, k as (select id, len(regexp_extract_all(text, '(?i){fixed.NUMERIC_PATTERN}')) + len(regexp_extract_all(text, '(?i){fixed.PERIOD_PATTERN}')) as n,
    greatest(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')), 1) as w from st)
    select id, printf('%.1f concrete markers / 100 words', n / w * 100.0::double + 1e-9) as shown from k"""
)
def q_marker_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.statements(spark, sf_dir).select("id", X.marker_evidence(F.col("text"))[2].alias("shown"))


_YEARS = {
    2023: '<a href="/newsevents/speech/cook20230216a.htm">z</a><a href="/newsevents/speech/barr20230704a.htm">x</a>',
    2024: '<a href="/newsevents/speech/powell20240301a.htm">x</a><a href="/newsevents/speech/barr20230704a.htm">x</a><a href="/newsevents/speech/cook20240613a.htm">z</a>',
}


@REGISTRY.query(
    f"""with {V.CALENDAR}, l as (select * from (values ('/newsevents/speech/barr20230704a.htm', date '2023-07-04'), ('/newsevents/speech/cook20240613a.htm', date '2024-06-13'),
    ('/newsevents/speech/powell20240301a.htm', date '2024-03-01')) t(url, date))
    select url, l.date, cal."window", next_event, days_to_event from l join cal on l.date = cal.day"""
)
def q_planned_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dry run over the union of two years' index pages, from mid-2023 on."""
    indexes = {year: spark.createDataFrame([(page,)], "html string") for year, page in _YEARS.items()}
    return H.planned(H.year_links(indexes), meetings(spark), "2023-06-01", 400).drop("speaker")
