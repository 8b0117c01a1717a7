"""Line deduplication over levelled, sorted runs of line hashes.

The index is a log-structured set of runs: tables of ``(h1, h2, n_docs,
last_id)``, bucketed and sorted by the 128-bit line hash, so that they meet a
batch in merge joins without moving again.  Each batch of documents is summed
to one row per line, written in the same buckets, and merge-anti-joined with
the runs: lines that no run has yet become a new run, so every line is in one
run only, and known lines are put down as increments in a run of deltas.
Whenever a level holds ``fanout`` runs they are merged into one run of the next
level, and deltas likewise.  A line's count is its run's row plus its
increments; found in at least ``min_docs`` documents, it loses every occurrence
except those in the largest document that holds it.

Line hashes are two independent 64-bit hashes: among 10^12 different lines the
chance of any collision is below 10^-14.  All steps are DataFrame operations;
a line that a third of all documents carry is summed before each shuffle.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import new_path, written

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 2
_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends, A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(_BLANK)), _UPPER, _LOWER)


def line_hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


class Run(NamedTuple):
    """One run: read by buckets where it is joined, plainly where runs are merged."""

    joined: DataFrame
    plain: DataFrame


class LineIndex:
    """Levelled runs; ``add`` takes one batch ``(h1, h2, doc_id)`` with one row per line and document."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        #: Runs by level, of new lines and of increments.
        self.lines: list[list[Run]] = []
        self.deltas: list[list[Run]] = []
        self.tables: list[str] = []

    def _run(self, rows: DataFrame, label: str) -> Run:
        """``rows`` as a run: bucketed and sorted files in the shared folder under a temporary table name."""
        path = new_path(self.spark, label)
        name = f"tidemark_{label}_{path[-32:]}"
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        self.tables.append(name)
        return Run(self.spark.table(name), self.spark.read.schema(rows.schema).parquet(path))

    def add(self, batch: DataFrame) -> None:
        """Merge-anti-join a batch with the runs: new lines are added as a run, known ones as increments."""
        rows = self._run(_summed(batch, F.count("*"), F.max("doc_id")), "batch")
        runs = [run for level in self.lines for run in level]
        if runs:
            fresh = rows.joined
            for run in runs:
                fresh = fresh.join(run.joined.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
            fresh = self._run(fresh, "run")
            known = rows.joined.join(fresh.joined.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
            self._push(self.deltas, 0, self._run(known, "delta"))
        self._push(self.lines, 0, fresh if runs else rows)

    def counts(self) -> DataFrame:
        """Every line once: ``(h1, h2, n_docs, last_id)``."""
        for levels in (self.lines, self.deltas):
            runs = [run for level in levels for run in level]
            if len(runs) > 1:
                levels[:] = [[self._merged(runs)]]
        runs, deltas = ([run for level in levels for run in level] for levels in (self.lines, self.deltas))
        if not runs:
            raise ValueError("the index is empty")
        if not deltas:
            return runs[0].plain
        more = deltas[0].joined.select("h1", "h2", F.col("n_docs").alias("n_more"), F.col("last_id").alias("last_more"))
        return runs[0].joined.join(more.hint("merge"), ["h1", "h2"], "left").select(
            "h1", "h2", (F.col("n_docs") + F.coalesce("n_more", F.lit(0))).alias("n_docs"), F.greatest("last_id", "last_more").alias("last_id")
        )

    def drop(self) -> None:
        """Forget the table names; what was read from them must have been written elsewhere."""
        for name in self.tables:
            self.spark.sql(f"drop table if exists {name}")
        self.tables = []

    def _merged(self, runs: list[Run]) -> Run:
        rows = runs[0].plain
        for run in runs[1:]:
            rows = rows.unionByName(run.plain)
        return self._run(_summed(rows, F.sum("n_docs"), F.max("last_id")), "run")

    def _push(self, levels: list[list[Run]], level: int, run: Run) -> None:
        while len(levels) <= level:
            levels.append([])
        levels[level].append(run)
        if len(levels[level]) >= self.fanout:
            merged = self._merged(levels[level])
            levels[level] = []
            self._push(levels, level + 1, merged)


def _summed(rows: DataFrame, n_docs: Column, last_id: Column) -> DataFrame:
    return rows.groupBy("h1", "h2").agg(n_docs.alias("n_docs"), last_id.alias("last_id"))


def dedup_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
) -> DataFrame:
    """``docs`` (all columns; clashing ones are replaced) with ``kept_text``, ``n_lines`` and ``n_dropped``.

    Null and empty texts have one empty line.  Each row is a document, repeated
    ids included (ids are whole numbers or text that reads as one); rows with a null id are counted, never named as the largest
    id, and keep all their lines.  Of a line repeated inside the largest
    document that holds it every occurrence stays.  An empty table gives an
    empty result.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # Two lines of a document can share a key without being equal: keys are made distinct per document.
    keys = F.array_distinct(F.transform(F.filter(F.split(body, "\n"), lambda x: F.length(x) >= min_chars), line_key))
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.explode(keys).alias("key"))
    hashed = own.where(F.length("key") >= min_chars).select("doc_id", line_hash(F.col("key")).alias("h")).select("doc_id", "h.h1", "h.h2")
    row = F.xxhash64("doc_id")
    lines = written(
        hashed.withColumn("batch", F.coalesce(F.pmod(row, F.lit(batches)), F.lit(0)).cast("int")), "lines", ["batch"]
    )
    lines = lines.select("doc_id", "h1", "h2", "batch")
    index = LineIndex(docs.sparkSession, fanout)
    for b in range(batches):
        index.add(lines.where(F.col("batch") == b).select("h1", "h2", "doc_id"))
    # Written, so that the join below has a plain shuffle on both sides and AQE can split a hot line.
    frequent = written(index.counts().where(F.col("n_docs") >= min_docs).select("h1", "h2", "last_id"), "frequent")
    index.drop()
    drops = (
        lines.join(frequent, ["h1", "h2"])
        .where(F.col("doc_id") < F.col("last_id"))
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct("h1", "h2")).alias("__drop"))
        .withColumnRenamed("doc_id", "__drop_id")
    )
    lines_of = F.split(body, "\n")
    kept = F.filter(
        lines_of,
        lambda x: ~((F.length(x) >= min_chars) & (F.length(line_key(x)) >= min_chars) & F.array_contains(F.col("__drop"), line_hash(line_key(x)))),
    )
    results = ("kept_text", "n_lines", "n_dropped")
    kept_columns = [c for c in docs.columns if c.lower() not in results]
    joined = docs.join(drops, F.col(f"`{doc_id}`").cast("long") == F.col("__drop_id"), "left")
    return joined.select(
        *[docs[f"`{c}`"] for c in kept_columns],
        F.when(F.col("__drop").isNull(), lines_of).otherwise(kept).alias("__kept"),
        F.size(lines_of).cast("long").alias("n_lines"),
    ).select(
        *[F.col(f"`{c}`") for c in kept_columns],
        F.array_join("__kept", "\n").alias("kept_text"),
        "n_lines",
        (F.col("n_lines") - F.size("__kept")).alias("n_dropped"),
    )
