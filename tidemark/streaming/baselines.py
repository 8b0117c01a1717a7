"""Baselines that compound as statements arrive.

Counts, sums and cross-products merge, so each micro-batch writes its own
moments and the baseline of a speaker is the sum over batches; a batch that is
replayed overwrites itself, which makes the update exactly-once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def moments(rows: DataFrame, speaker: str, features: list[str]) -> DataFrame:
    """``speaker, n, sum_<f>, sum_<f>_<g>`` of baseline rows."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    return rows.groupBy(speaker).agg(
        F.count("*").alias("n"),
        *[F.sum(f).alias(f"sum_{f}") for f in features],
        *[F.sum(F.col(a) * F.col(b)).alias(f"sum_{a}_{b}") for a, b in pairs],
    )


def merged(parts: DataFrame, speaker: str) -> DataFrame:
    sums = [c for c in parts.columns if c == "n" or c.startswith("sum_")]
    return parts.groupBy(speaker).agg(*[F.sum(c).alias(c) for c in sums])


def baseline_of(total: DataFrame, speaker: str, features: list[str]) -> DataFrame:
    """Mean and sample deviation from merged moments."""
    n = F.col("n")
    return total.where("n >= 2").select(
        speaker,
        "n",
        *[(F.col(f"sum_{f}") / n).alias(f"mean_{f}") for f in features],
        *[F.sqrt(F.greatest(F.lit(0.0), (F.col(f"sum_{f}_{f}") - F.col(f"sum_{f}") * F.col(f"sum_{f}") / n) / (n - 1))).alias(f"sd_{f}") for f in features],
    )


def maintain(stream: DataFrame, speaker: str, features: list[str], state: str, checkpoint: str) -> StreamingQuery:
    """Keep ``state/batch=<id>`` up to date from a stream of baseline rows."""

    def update(batch: DataFrame, batch_id: int) -> None:
        moments(batch, speaker, features).write.mode("overwrite").parquet(f"{state}/batch={batch_id}")

    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scored(stream: DataFrame, baselines: DataFrame, speaker: str, features: list[str]) -> DataFrame:
    """A stream of statements against the baselines so far (stream-static join)."""
    joined = stream.join(baselines, speaker)
    z = [(F.col(f) - F.col(f"mean_{f}")) / F.greatest(F.col(f"sd_{f}"), F.lit(1e-6)) for f in features]
    return joined.select(*stream.columns, *[c.alias(f"z_{f}") for c, f in zip(z, features, strict=True)], reduce(lambda a, b: a + b, (F.abs(c) for c in z)).alias("total"))
