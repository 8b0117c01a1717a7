"""Secret scanning with corpus-wide ownership frequency, native expressions only.

Base spans come from three patterns (assign, access, hex), leftmost and
non-overlapping for each kind, in code points.  The method adds ``bare`` spans:
long mixed tokens that no pattern covers.  Every candidate value is hashed and
counted over the whole corpus by distinct owners and by distinct repositories;
values in many owners' or in many repositories' hands are published examples,
values of few owners in few repositories look live.  Bare
tokens are reported as spans only when they look live; base spans always stay
and carry their verdict in the counts.

Spans need no UDF: splitting the text at the pattern gives the pieces between
the matches, so the running sum of piece and match lengths is each position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

# The patterns that define the base spans.
ASSIGN = r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Long tokens that hold a lower-case letter, an upper-case letter and a digit.
BARE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[a-z])(?=[A-Za-z0-9+/_=-]*[A-Z])[A-Za-z0-9+/_=-]{24,}"
KINDS = ("assign", "access", "hex", "bare")
#: A value of at most so many owners, in at most so many repositories, looks live.
MAX_OWNERS = 2
MAX_REPOSITORIES = 3
_SPAN = "array<struct<start:int,stop:int,kind:int,value:string>>"


def _spans(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """Matches of ``pattern`` as structs; ``group`` is the value, which needs ``least`` characters.

    (A text that does not match at all gives an empty array without splitting.)
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.transform(F.split(text, pattern), lambda x: F.length(x))
    rows = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("m"), value.alias("v"))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {_SPAN})").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["m"])
        found = F.struct(begin.alias("start"), end.alias("stop"), F.lit(kind).alias("kind"), x["v"].alias("value"))
        return F.struct(
            end.alias("at"),
            F.when(F.length(x["v"]) >= least, F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"),
        )

    return F.when(text.rlike(pattern), F.aggregate(rows, start, step, lambda acc: acc["out"])).otherwise(
        F.expr(f"cast(array() as {_SPAN})")
    )


def _joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["stop"])))
    return F.array_join(
        F.transform(
            ordered,
            lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string")),
        ),
        ",",
    )


def scan(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    owner: str = "source",
    repository: list[str] | None = None,
    max_owners: int = MAX_OWNERS,
    max_repositories: int = MAX_REPOSITORIES,
) -> DataFrame:
    """One row per row of ``docs``: spans, counts by kind, and how many base values look live or copied.

    Result: ``doc_id, n_assign, n_access, n_hex, base, spans, n_bare, n_live,
    n_copied, most_owners, most_repositories`` (the last two over the row's base
    values, 0 without any).  ``repository`` defaults to owner and language where there is
    one; clashing names of other columns do not matter.  A null owner is an owner of its own; null texts are empty; repeated
    rows stay repeated; an empty table gives an empty result.
    """
    repository = repository or [c for c in (owner, "lang") if c in docs.columns]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.coalesce(F.col(f"`{owner}`").cast("string"), F.lit("")).alias("owner"),
        F.concat_ws("/", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in repository]).alias("repo"),
        _spans(body, ASSIGN, 0, 1, 8).alias("assign"),
        _spans(body, ACCESS, 1, 0, 16).alias("access"),
        _spans(body, HEX, 2, 0, 32).alias("hex"),
        _spans(body, BARE, 3, 0, 24).alias("bare"),
    )
    found = written(base.withColumn("row", F.monotonically_increasing_id()), "secret_spans")
    candidates = found.select(
        "row", "owner", "repo", F.explode(F.concat("assign", "access", "hex", "bare")).alias("s")
    ).select("row", "owner", "repo", F.col("s.start").alias("start"), F.col("s.stop").alias("stop"), F.col("s.kind").alias("kind"), F.sha2("s.value", 256).alias("h"))
    # Distinct owners first, within each map task too, so a value copied everywhere moves once per task and owner.
    owned = candidates.groupBy("h", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = owned.groupBy("h", "owner").agg(F.count("*").alias("repos"))
    frequency = by_owner.groupBy("h").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"))
    verdicts = (
        candidates.join(frequency, "h")
        .withColumn("live", (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repositories))
        .groupBy("row")
        .agg(
            F.count_if(F.col("live") & (F.col("kind") < 3)).alias("n_live"),
            F.count_if(~F.col("live") & (F.col("kind") < 3)).alias("n_copied"),
            F.collect_set(
                F.when(F.col("live") & (F.col("kind") == 3), F.struct("start", "stop", "kind"))
            ).alias("live_bare"),
            F.max(F.when(F.col("kind") < 3, F.col("n_owners"))).alias("most_owners"),
            F.max(F.when(F.col("kind") < 3, F.col("n_repos"))).alias("most_repositories"),
        )
    )
    none = F.expr("cast(array() as array<struct<start:int,stop:int,kind:int>>)")
    plain = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    every = F.concat(plain(F.col("assign")), plain(F.col("access")), plain(F.col("hex")))
    return found.join(verdicts, "row", "left").select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        _joined(every).alias("base"),
        _joined(F.concat(every, F.coalesce("live_bare", none))).alias("spans"),
        F.coalesce(F.size("live_bare"), F.lit(0)).cast("long").alias("n_bare"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"),
        F.coalesce("most_owners", F.lit(0)).cast("long").alias("most_owners"),
        F.coalesce("most_repositories", F.lit(0)).cast("long").alias("most_repositories"),
    )
