"""Reading transcripts from web pages with native string expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import SPEAKER_NAMES

# Markup that carries no text, the main column, and character entities.
DROPPED_BLOCKS = r"(?is)<(script|style|nav|header|footer).*?</\1>"
MAIN_COLUMN = r'(?is)<div[^>]*class="[^"]*col-xs-12[^"]*"[^>]*>(.*)'
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&#39;", "'"), ("&quot;", '"'), ("&mdash;", "—"), ("&rsquo;", "'"))
PERMALINK = r"(?i)/newsevents/speech/([a-z]+?)(\d{8})([a-z])\.htm"
TITLE = r"(?is)<title>(.*?)</title>"


def strip_html(html: Column) -> Column:
    """Text of a page: blocks without text dropped, the main column if there is one, tags and entities resolved."""
    kept = F.regexp_replace(html, DROPPED_BLOCKS, " ")
    body = F.when(kept.rlike(MAIN_COLUMN), F.regexp_extract(kept, MAIN_COLUMN, 1)).otherwise(kept)
    text = F.regexp_replace(body, r"(?s)<[^>]+>", " ")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def title(html: Column, prefix: str = "") -> Column:
    """The page title with white space collapsed, without a site prefix, 140 characters at most; ``Speech`` if there is none."""
    found = F.trim(F.regexp_replace(F.regexp_extract(html, TITLE, 1), r"\s+", " "))
    if prefix:
        found = F.regexp_replace(found, "^" + prefix, "")
    return F.when(F.length(found) == 0, F.lit("Speech")).otherwise(F.substring(found, 1, 140))


def permalinks(pages: DataFrame, html: str = "html", base: str = "") -> DataFrame:
    """``(url, date, surname, speaker)`` of the distinct transcript links of index pages, by date; impossible dates drop out."""
    paths = pages.select(F.explode(F.regexp_extract_all(F.col(html), F.lit(PERMALINK), F.lit(0))).alias("path")).select(F.lower("path").alias("path")).dropDuplicates(["path"])
    names = F.create_map(*[F.lit(x) for pair in SPEAKER_NAMES.items() for x in pair])
    surname = F.regexp_extract("path", PERMALINK, 1)
    return (
        paths.select(
            F.concat(F.lit(base), F.col("path")).alias("url"), F.try_to_date(F.regexp_extract("path", PERMALINK, 2), "yyyyMMdd").alias("date"), surname.alias("surname")
        )
        .where("date is not null")
        .withColumn("speaker", F.coalesce(names[F.col("surname")], F.initcap("surname")))
        .orderBy("date", "url")
    )


def links(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Every distinct ``href`` of every page."""
    found = F.regexp_extract_all(F.col(html), F.lit(r'href="([^"]*)"'), F.lit(1))
    return pages.select(page_id, F.explode(F.array_distinct(found)).alias("href"))


def ingest(records: DataFrame, calendar: DataFrame, since: str, limit: int, min_words: int = 400) -> DataFrame:
    """The fetch query: rows since a date, the first ``limit`` by date and id, labelled, covered, long enough."""
    from ..operators.calendar import label_windows
    from ..operators.lexical import word_count

    recent = records.where(F.col("date") >= F.to_date(F.lit(since))).orderBy("date", "id").limit(limit)
    labelled = label_windows(recent, "date", calendar).where("window <> 'out_of_coverage'")
    return labelled.where(word_count(F.col("text")) >= min_words).withColumn("text", F.substring("text", 1, 24_000))


def year_links(indexes: dict[int, DataFrame], base: str = "") -> DataFrame:
    """The transcript links of several years' index pages, one after the other, each link once."""
    every = None
    for year in sorted(indexes):
        one = permalinks(indexes[year], base=base)
        every = one if every is None else every.unionByName(one)
    if every is None:
        raise ValueError("no index pages")
    return every.dropDuplicates(["url"]).orderBy("date", "url")


def planned(found: DataFrame, calendar: DataFrame, since: str, limit: int) -> DataFrame:
    """What an ingest would fetch (a dry run): the first ``limit`` links since a date, labelled, without reading a page."""
    from ..operators.calendar import label_windows

    recent = found.where(F.col("date") >= F.to_date(F.lit(since))).orderBy("date", "url").limit(limit)
    labelled = label_windows(recent, "date", calendar).where("window <> 'out_of_coverage'")
    return labelled.select("url", "date", "speaker", "window", "next_event", "days_to_event")
