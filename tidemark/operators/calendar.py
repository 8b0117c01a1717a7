"""Window labels from a published calendar: interval and as-of joins over a day spine.

The calendar is a few dozen meetings, so every covered day is labelled once
(``labelled_days``, a couple of thousand rows whatever the data) and facts meet
it in one broadcast equi-join on the date: no range join and no shuffle on the
fact side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed import MEETINGS


def meetings(spark: SparkSession, rows: list[tuple[str, str]] = MEETINGS) -> DataFrame:
    named = spark.createDataFrame(rows, "first_day string, last_day string")
    return named.select(F.to_date("first_day").alias("first_day"), F.to_date("last_day").alias("last_day"))


def constrained_windows(calendar: DataFrame) -> DataFrame:
    """``(start, end, meeting)``: from the second Saturday before the first day to the day after the last."""
    return calendar.select(
        F.expr("date_sub(first_day, pmod(weekday(first_day) - 5, 7) + 7)").alias("start"),
        F.date_add("last_day", 1).alias("end"),
        F.col("first_day").alias("meeting"),
    )


def labelled_days(calendar: DataFrame) -> DataFrame:
    """One row for each covered day: ``day, window, next_event, days_to_event``.

    Coverage runs from the first window's start to the last meeting's first day.
    Inside a window the event is that window's meeting (days may be negative
    after its first day); elsewhere it is the next meeting.
    """
    windows = constrained_windows(calendar)
    spine = windows.agg(F.min("start").alias("lo"), F.max("meeting").alias("hi")).select(
        F.explode(F.sequence("lo", "hi")).alias("day")
    )
    inside = spine.join(F.broadcast(windows), F.col("day").between(F.col("start"), F.col("end")), "left").select("day", F.col("meeting").alias("own"))
    following = inside.join(F.broadcast(windows.select(F.col("meeting").alias("m"))), F.col("m") >= F.col("day"), "left")
    return (
        following.groupBy("day", "own")
        .agg(F.min("m").alias("next"))
        .select(
            "day",
            F.when(F.col("own").isNotNull(), "constrained").otherwise("baseline").alias("window"),
            F.coalesce("own", "next").alias("next_event"),
            F.datediff(F.coalesce("own", "next"), "day").alias("days_to_event"),
        )
    )


def label_windows(facts: DataFrame, date: str, calendar: DataFrame) -> DataFrame:
    """``facts`` plus ``window, next_event, days_to_event``; days outside the coverage (and null dates) are
    ``out_of_coverage`` with nulls, never baseline."""
    days = labelled_days(calendar)
    return facts.join(F.broadcast(days), facts[date].cast(T.DateType()) == days["day"], "left").select(
        *[facts[c] for c in facts.columns],
        F.coalesce("window", F.lit("out_of_coverage")).alias("window"),
        "next_event",
        "days_to_event",
    )


def calendar_share(calendar: DataFrame, since: str, until: str) -> DataFrame:
    """Days of ``[since, until)`` and how many of them are constrained."""
    spine = calendar.sparkSession.range(1).select(
        F.explode(F.sequence(F.to_date(F.lit(since)), F.date_sub(F.to_date(F.lit(until)), 1))).alias("d")
    )
    labelled = label_windows(spine, "d", calendar)
    return labelled.agg(F.count("*").alias("n_days"), F.count_if(F.col("window") == "constrained").alias("n_constrained")).withColumn(
        "share", F.col("n_constrained") / F.col("n_days")
    )


def suppression(facts: DataFrame, calendar: DataFrame, since: str, until: str) -> DataFrame:
    """Share of labelled rows in constrained windows against the share of the calendar."""
    own = facts.where(F.col("window") != "out_of_coverage").agg(
        F.count("*").alias("n"), F.count_if(F.col("window") == "constrained").alias("n_constrained")
    )
    share = calendar_share(calendar, since, until).select(F.col("share").alias("calendar_share"))
    return own.crossJoin(F.broadcast(share)).select(
        "n",
        "n_constrained",
        F.expr("try_divide(n_constrained, n)").alias("row_share"),
        "calendar_share",
        F.expr("try_divide(calendar_share, try_divide(n_constrained, n))").alias("suppression"),
    )


def window_pivot(facts: DataFrame, speaker: str) -> DataFrame:
    """Rows of each speaker by window."""
    return facts.groupBy(speaker).agg(
        F.count_if(F.col("window") == "baseline").alias("n_baseline"),
        F.count_if(F.col("window") == "constrained").alias("n_constrained"),
        F.count("*").alias("n"),
    )
