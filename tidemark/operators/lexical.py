"""Lexical features of a text as native column expressions; the phrase lists are parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


@dataclass(frozen=True)
class Lexicon:
    hedges: list[str] = field(default_factory=lambda: fixed.HEDGES)
    deflectors: list[str] = field(default_factory=lambda: fixed.DEFLECTORS)
    confidence: list[str] = field(default_factory=lambda: fixed.CONFIDENCE)
    first_person: list[str] = field(default_factory=lambda: fixed.FIRST_PERSON)
    impersonal: list[str] = field(default_factory=lambda: fixed.IMPERSONAL)


#: Stands in where texts hold none of the English phrases: very common words.
PROXY = Lexicon([" of the ", " to "], [" in "], [" is "], [" it "], [" the "])


def padded(text: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(text), F.lit(" "))


def word_count(text: Column) -> Column:
    """Words between white space, one at least."""
    return F.greatest(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")), F.lit(1))


def phrase_hits(text: Column, phrases: list[str]) -> Column:
    """Non-overlapping occurrences of each phrase, added up (substring match; phrases may overlap each other)."""
    hay = padded(text)
    total = F.lit(0)
    for p in phrases:
        total = total + (F.octet_length(hay) - F.octet_length(F.replace(hay, F.lit(p), F.lit("")))) / F.lit(len(p.encode()))
    return total.cast("int")


def rate(text: Column, phrases: list[str]) -> Column:
    return phrase_hits(text, phrases) / word_count(text) * F.lit(100.0)


def unit(x: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 4)


# A look at the first letter comes before the dearer look for a word's border; what matches is the same.


def numeric_markers(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?i)(?=\d)" + fixed.NUMERIC_PATTERN))


def period_markers(text: Column) -> Column:
    return F.regexp_count(text, F.lit("(?i)(?=[adfjmnoqsty])" + fixed.PERIOD_PATTERN))


def concrete_rate(text: Column) -> Column:
    return (numeric_markers(text) + period_markers(text)) / word_count(text) * F.lit(100.0)


def evidence(text: Column, phrases: list[str], limit: int = 6) -> Column:
    """The phrases that occur, trimmed, longest first (then alphabetical), at most ``limit``."""
    hay = padded(text)
    # Not a filter over the phrases: in its lambda the text would be put into lower case once for each phrase.
    found = F.array_compact(F.array(*[F.when(F.contains(hay, F.lit(p)), F.lit(p)) for p in phrases]))
    named = F.array_distinct(F.transform(found, lambda p: F.trim(p)))
    ordered = F.array_sort(F.transform(named, lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p"))))
    return F.transform(F.slice(ordered, 1, limit), lambda s: s["p"])


def lexical_scores(statements: DataFrame, text: str = "text", lexicon: Lexicon | None = None, markers: bool = False) -> DataFrame:
    """``statements`` plus the five dimensions (0 to 1, four decimals), ``words`` and ``concrete_per_100w``; ``markers``: and ``numeric``, ``period``.

    Hits and word counts are projected first so that no expression is computed twice.
    """
    lx = lexicon or Lexicon()
    t = F.coalesce(F.col(text), F.lit(""))
    counted = statements.select(
        "*",
        word_count(t).alias("words"),
        phrase_hits(t, lx.hedges).alias("_h"),
        phrase_hits(t, lx.deflectors).alias("_d"),
        phrase_hits(t, lx.confidence).alias("_c"),
        phrase_hits(t, lx.first_person).alias("_f"),
        phrase_hits(t, lx.impersonal).alias("_i"),
        numeric_markers(t).alias("numeric"),
        period_markers(t).alias("period"),
    ).withColumn("_n", F.col("numeric") + F.col("period"))
    per = lambda c: F.col(c) / F.col("words") * F.lit(100.0)
    return counted.select(
        *statements.columns,
        unit(per("_h") / fixed.HEDGE_SCALE).alias("hedging"),
        unit(1.0 - per("_n") / fixed.CONCRETE_SCALE).alias("specificity_avoidance"),
        unit(per("_i") / F.greatest(per("_f") + per("_i"), F.lit(1e-6))).alias("pronoun_distancing"),
        unit(per("_d") / fixed.DEFLECT_SCALE).alias("topic_deflection"),
        unit(per("_c") / fixed.CONFIDENCE_SCALE).alias("confidence_language"),
        "words",
        F.round(per("_n"), 2).alias("concrete_per_100w"),
        *(["numeric", "period"] if markers else []),
    )


def marker_evidence(text: Column) -> Column:
    """Formatted evidence strings of the concrete markers."""
    return marker_strings(numeric_markers(text), period_markers(text), word_count(text))


def marker_strings(numeric: Column, period: Column, words: Column) -> Column:
    return F.array(
        F.format_string("%d numeric markers", numeric),
        F.format_string("%d period markers", period),
        F.format_string("%.1f concrete markers / 100 words", (numeric + period) / words * F.lit(100.0)),
    )


def time_index(date: Column) -> Column:
    """Months since year zero, days as fractions of 31; a null date counts as 2024-01-01."""
    d = F.coalesce(date, F.lit("2024-01-01").cast("date"))
    return F.year(d) * 12 + F.month(d) + F.dayofmonth(d) / F.lit(31.0)
