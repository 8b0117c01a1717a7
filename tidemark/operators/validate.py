"""Rank statistics, calibration, and resampling that is the same under any partitioning.

Randomness is a hash of (replicate, row id, seed), never a stream: replicates
are identical wherever they run.  Ranks and positions are cumulative counts,
range by range, so no window ever spans a large table.

A permutation test of a whole table cuts its ranks once and counts hashes when it
is planned; replicates move as packed bytes, not as rows.

Rows whose value is null have no rank; pairs with a null on either side take no
part in correlations, tests and areas.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

try:  # CPython's own, which takes half the time of OpenSSL's for a few bytes
    from _md5 import md5
except ImportError:
    from hashlib import md5


def _ranged(counts: DataFrame, value: str) -> DataFrame:
    """Distinct values plus ``_range``: as many ranges of about equal size as there are shuffle partitions (1,024 at most)."""
    n = min(1024, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if n < 2:
        return counts.withColumn("_range", F.lit(0))
    bounds = counts.agg(F.percentile_approx(value, [i / n for i in range(1, n)], 10_000).alias("_bounds"))
    return counts.crossJoin(F.broadcast(bounds)).withColumn("_range", F.size(F.filter("_bounds", lambda b: b < F.col(value)))).drop("_bounds")


def average_ranks(df: DataFrame, value: str, out: str, groups: list[str] | None = None) -> DataFrame:
    """``df`` plus the average rank of ``value`` within ``groups`` (ties share the mean rank, null values have none).

    Over the whole table, ranges of values are counted first and each range is
    ranked by itself: no task sorts all distinct values.
    """
    keys = groups or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    if keys:
        part, start = keys, F.lit(0)
    else:
        counts = _ranged(counts, value)
        sums = counts.groupBy("_range").agg(F.sum("_n").alias("_in"))
        before = F.sum("_in").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
        starts = sums.select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
        counts = counts.join(F.broadcast(starts), "_range")  # one row for each range
        part, start = ["_range"], F.col("_start")
    below = F.sum("_n").over(Window.partitionBy(*part).orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    ranks = counts.select(*keys, value, (start + F.coalesce(below, F.lit(0)) + (F.col("_n") + 1) / 2.0).alias(out))
    return df.join(ranks, [*keys, value], "left")


def positions(df: DataFrame, row_id: str, out: str, groups: list[str] | None = None) -> DataFrame:
    """``df`` plus the place (from 1) of each row by its unique id, within ``groups``."""
    return average_ranks(df, row_id, out, groups).withColumn(out, F.col(out).cast("long"))


def spearman(df: DataFrame, x: str, y: str, groups: list[str] | None = None, min_n: int = 3) -> DataFrame:
    """``(*groups, n, rho)``; under ``min_n`` rows or without variation rho is 0."""
    keys = groups or []
    pairs = df.select(*keys, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_ranks(average_ranks(pairs, x, "_rx", keys), y, "_ry", keys)
    made = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.stddev_pop("_rx").alias("_sx"), F.stddev_pop("_ry").alias("_sy"), F.covar_pop("_rx", "_ry").alias("_c"))
    rho = F.when((F.col("n") < min_n) | (F.coalesce(F.col("_sx") * F.col("_sy"), F.lit(0.0)) < 1e-12), F.lit(0.0)).otherwise(F.col("_c") / (F.col("_sx") * F.col("_sy")))
    return made.select(*keys, "n", rho.alias("rho"))


def spearman_ordinal(df: DataFrame, x: str, y: str, order: str, groups: list[str]) -> DataFrame:
    """First-version Spearman within groups: ties broken by ``order``, three decimals."""
    ranked = df.select(
        *groups,
        F.row_number().over(Window.partitionBy(*groups).orderBy(x, order)).alias("_rx"),
        F.row_number().over(Window.partitionBy(*groups).orderBy(y, order)).alias("_ry"),
    )
    d2 = F.sum(F.pow(F.col("_rx") - F.col("_ry"), 2))
    n = F.count("*")
    return ranked.groupBy(*groups).agg(n.alias("n"), F.round(F.when(n < 3, 0.0).otherwise(1 - 6 * d2 / F.greatest(n * (n * n - 1), F.lit(1))), 3).alias("rho"))


def auc(df: DataFrame, score: str, label: str, groups: list[str] | None = None) -> DataFrame:
    """Mann-Whitney AUC with average ranks (in each group); 0.5 where only one class occurs."""
    keys = groups or []
    scored = df.select(*keys, score, label).where(F.col(score).isNotNull() & F.col(label).isNotNull())
    ranked = average_ranks(scored, score, "_r", keys)
    s = ranked.groupBy(*keys).agg(
        F.sum(F.when(F.col(label) == 1, F.col("_r"))).alias("r"), F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg")
    )
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    u = F.col("r") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0
    return s.select(*keys, "n_pos", "n_neg", F.when(both, u / (F.col("n_pos") * F.col("n_neg"))).otherwise(F.lit(0.5)).alias("auc"))


def calibration(df: DataFrame, p: str, label: str, bins: int = 5) -> DataFrame:
    """Non-empty bins of predicted probability ``[lo, hi)``, the last closed: counts, means, and gap."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return (
        df.where(F.col(p).between(0, 1))
        .groupBy(b.alias("bin"))
        .agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(label).cast("double")).alias("observed"))
        .withColumn("gap", F.abs(F.col("mean_p") - F.col("observed")))
    )


def calibration_error(df: DataFrame, p: str, label: str, bins: int = 5) -> DataFrame:
    """Expected calibration error and Brier score in one row."""
    ece = calibration(df, p, label, bins).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))
    brier = df.agg(F.avg(F.pow(F.col(p) - F.col(label), 2)).alias("brier"), F.count("*").alias("n"))
    return brier.crossJoin(F.broadcast(ece))


def nan_moments(df: DataFrame, value: str, groups: list[str] | None = None) -> DataFrame:
    """``(*groups, n, mean, sd)`` of the values that are neither null nor NaN (deviation with divisor n)."""
    v = F.when(~F.isnan(value), F.col(value))
    return df.groupBy(*(groups or [])).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"))


def shuffle_key(rep: Column, row_id: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("-", rep.cast("string"), row_id.cast("string"), F.lit(str(seed))))


#: A replicate of so many rows is cut into 16 parts by its hashes, of 16 times as many into 256.
_PART_ROWS = 4096


def permuted(df: DataFrame, fixed: list[str], value: str, row_id: str, n_perm: int, block: list[str] | None = None, seed: int = 7) -> DataFrame:
    """``(_perm, *block, *fixed, shuffled)``: ``value`` shuffled over the rows (of each block) for every replicate.

    A row's value moves to the place that its hash has among the hashes of the
    replicate.  In large tables and blocks places are found part by part (the
    leading digits of the hash), so a replicate is never one task's sort; the
    places of the rows are found once, not in every replicate.
    """
    keys = block or []
    reps = df.sparkSession.range(n_perm).withColumnRenamed("id", "_perm")
    numbered = positions(df.select(*keys, row_id, *fixed, value), row_id, "_slot", keys)
    own_rows = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    sized = numbered.join(own_rows, keys) if keys else numbered.crossJoin(F.broadcast(own_rows))
    digits = F.when(F.col("_rows") > 16 * _PART_ROWS, 2).when(F.col("_rows") > _PART_ROWS, 1).otherwise(0)
    # Sixteen digits order as well as all of them: eight bytes move.
    hashed = sized.select(*keys, row_id, F.col(value).alias("shuffled"), digits.alias("_digits")).crossJoin(F.broadcast(reps))
    drawn = hashed.withColumn("_md5", shuffle_key(F.col("_perm"), F.col(row_id), seed)).select(
        "_perm", *keys, row_id, "shuffled", F.substring("_md5", F.lit(1), F.col("_digits")).alias("_part"), F.unhex(F.substring("_md5", 1, 16)).alias("_h")
    )
    counts = drawn.groupBy("_perm", *keys, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_perm", *keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_perm", *keys, "_part", F.coalesce(before, F.lit(0)).alias("_start")).where("_start > 0")
    own = F.row_number().over(Window.partitionBy("_perm", *keys, "_part").orderBy("_h", row_id))
    placed = drawn.withColumn("_own", own).join(starts, ["_perm", *keys, "_part"], "left")
    placed = placed.select("_perm", *keys, "shuffled", (F.coalesce("_start", F.lit(0)) + F.col("_own")).alias("_slot"))
    return placed.join(numbered.select(*keys, "_slot", *fixed), [*keys, "_slot"]).drop("_slot")


#: Blocks of at most so many rows are shuffled in the task that holds them; hashes drawn there at once.
_BLOCK_ROWS, _AT_ONCE = 16 * _PART_ROWS, 1 << 20


def block_products(df: DataFrame, x: str, y: str, row_id: str, n_perm: int, block: list[str], seed: int = 7) -> DataFrame:
    """``(_perm, *block, n, xx, yy, xy)``: sums of products of ``x`` and shuffled ``y`` about the block's means, and the means ``mx, my``.

    The shuffles are those of :func:`permuted`.  A block's rows move once, not in
    every replicate; only blocks beyond ``_BLOCK_ROWS`` rows, which no task could
    bound, take the way of :func:`permuted`.
    """
    held = df.where(" and ".join(f"`{c}` is not null" for c in (*block, row_id)))
    rows = held.select(*block, F.col(row_id).alias("_id"), F.col(row_id).cast("string").alias("_key"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    sized = rows.withColumn("_rows", F.count("*").over(Window.partitionBy(*block)))
    tail = f"-{seed}"
    n_block = len(block)

    def shuffled(group: pa.Table) -> pa.Table:
        group = group.sort_by("_id")
        xs, ys = group["_x"].to_numpy(), group["_y"].to_numpy()
        mx, my = xs.mean(), ys.mean()
        xs, ys = xs - mx, ys - my
        keys = [f"-{k}{tail}".encode() for k in group["_key"].to_pylist()]
        step, found = max(1, _AT_ONCE // len(keys)), []
        for first in range(0, n_perm, step):
            reps = range(first, min(n_perm, first + step))
            order = np.argsort(_hashes(keys, reps), axis=1, kind="stable")
            found.append(ys[order] @ xs)
        same = [pa.array([group.column(i)[0].as_py()] * n_perm, group.schema.field(i).type) for i in range(n_block)]
        sums = (float((xs * xs).sum()), float((ys * ys).sum()), mx, my)
        return pa.Table.from_arrays(
            [pa.array(range(n_perm), pa.int64()), *same, pa.array([len(keys)] * n_perm, pa.int64()), pa.array(np.concatenate(found)), *[pa.array([v] * n_perm, pa.float64()) for v in sums]],
            names=["_perm", *block, "n", "xy", "xx", "yy", "mx", "my"],
        )

    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*block).schema.fields)
    small = sized.where(F.col("_rows") <= _BLOCK_ROWS).drop("_rows")
    within = small.groupBy(*block).applyInArrow(shuffled, f"_perm long, {given}, n long, xy double, xx double, yy double, mx double, my double")
    large = permuted(sized.where(F.col("_rows") > _BLOCK_ROWS), ["_x"], "_y", "_id", n_perm, block, seed).groupBy("_perm", *block)
    n = F.count("*")
    made = large.agg(
        n.alias("n"), (F.covar_pop("_x", "shuffled") * n).alias("xy"), (F.var_pop("_x") * n).alias("xx"), (F.var_pop("shuffled") * n).alias("yy"), F.avg("_x").alias("mx"), F.avg("shuffled").alias("my")
    )
    return within.unionByName(made)


def _correlation(xy: Column, xx: Column, yy: Column) -> Column:
    return F.when((xx > 0) & (yy > 0), xy / F.sqrt(xx) / F.sqrt(yy))


def block_correlations(df: DataFrame, x: str, y: str, row_id: str, n_perm: int, block: list[str], seed: int = 7) -> DataFrame:
    """``(_perm, *block, rho)``: the correlation of ``x`` and shuffled ``y`` in each block of each replicate."""
    made = block_products(df, x, y, row_id, n_perm, block, seed)
    return made.select("_perm", *block, _correlation(F.col("xy"), F.col("xx"), F.col("yy")).alias("rho"))


def _blocked_null(ranked: DataFrame, row_id: str, n_perm: int, keys: list[str], block: str, seed: int) -> DataFrame:
    """``(_perm, *keys, s)``: correlations over all blocks, from each block's products and means about those of the whole."""
    held = ranked.where(f"`{block}` is not null and `{row_id}` is not null")
    whole = held.groupBy(*keys).agg(F.avg("_rx").alias("_ax"), F.avg("_ry").alias("_ay"), (F.var_pop("_rx") * F.count("*")).alias("_sx"), (F.var_pop("_ry") * F.count("*")).alias("_sy"))
    made = block_products(held, "_rx", "_ry", row_id, n_perm, [*keys, block], seed)
    made = made.join(whole, keys) if keys else made.crossJoin(F.broadcast(whole))
    xy = F.sum(F.col("xy") + F.col("n") * (F.col("mx") - F.col("_ax")) * (F.col("my") - F.col("_ay")))
    return made.groupBy("_perm", *keys).agg(_correlation(xy, F.first("_sx"), F.first("_sy")).alias("s"))


#: Rows that a part of a replicate has on average, at most; pairs of row and replicate that a task holds at once.
_SHARE, _PAIRS = 1 << 15, 1 << 21


def _hashes(keys: list[bytes], reps: range) -> np.ndarray:
    """The leading 64 bits of each replicate's hash of each key, one row for each replicate."""
    drawn = b"".join([md5(r + k, usedforsecurity=False).digest() for r in (str(rep).encode() for rep in reps) for k in keys])
    return np.frombuffer(drawn, dtype=">u8")[::2].astype(np.uint64).reshape(len(reps), -1)


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of at most about ``most`` rows, whatever the batches' sizes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for first in range(0, batch.num_rows, most):
            held.append(batch.slice(first, most))
            if sum(b.num_rows for b in held) >= most:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _counted(bits: int, n_perm: int, step: int, tail: str):
    """Batches of ``(key)`` -> for each replicate, how many of a task's hashes fall into each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((n_perm, 1 << bits), dtype=np.int64)
        for table in _gathered(batches, _SHARE):
            keys = [f"-{k}{tail}".encode() for k in table["_key"].to_pylist()]
            for first in range(0, n_perm, step):
                for i, h in enumerate(_hashes(keys, range(first, min(n_perm, first + step)))):
                    found[first + i] += np.bincount(_part(h, bits), minlength=1 << bits)
        yield pa.RecordBatch.from_arrays([pa.array(range(n_perm), pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["_perm", "_counts"])

    return run


def _added(tallied: DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """``(_perm, _counts)`` of all tasks -> each replicate and its summed counts."""

    def added(group: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, dtype=np.int64) for x in group["_counts"].to_pylist()], axis=0)
        return pa.table({"_perm": group["_perm"][:1], "_counts": pa.array([total.astype(np.int64).tobytes()], pa.binary())})

    for r in tallied.groupBy("_perm").applyInArrow(added, "_perm long, _counts binary").toLocalIterator():
        yield r["_perm"], np.frombuffer(r["_counts"], dtype=np.int64)


def _part(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), dtype=np.int64)


def _packed(bits: int, n_perm: int, step: int, tail: str, kind: str, names: list[str]):
    """Batches of ``(key, slot, rx, ry)`` -> hashes and doubled ranks of each part, for ``step`` replicates a packet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches, _SHARE):
            keys = [f"-{k}{tail}".encode() for k in table["_key"].to_pylist()]
            twice = np.rint(2 * table["_ry"].to_numpy()).astype(kind)
            for chunk, first in enumerate(range(0, n_perm, step)):
                reps = range(first, min(n_perm, first + step))
                h = _hashes(keys, reps).ravel()
                part = _part(h, bits)
                order = np.argsort(part.astype(np.uint16) if bits <= 16 else part, kind="stable")  # by replicate inside a part
                lengths = np.bincount(part * len(reps) + np.repeat(np.arange(len(reps)), len(keys)), minlength=len(reps) << bits).reshape(-1, len(reps))
                ends = np.cumsum(lengths.sum(axis=1))
                h, y = h[order], np.tile(twice, len(reps))[order]
                own = [(int(b), slice(ends[b] - lengths[b].sum(), ends[b])) for b in np.flatnonzero(lengths.any(axis=1))]
                columns = [
                    pa.array([chunk] * len(own), pa.int64()),
                    pa.array([b for b, _ in own], pa.int64()),
                    pa.array([lengths[b].astype(np.int32).tobytes() for b, _ in own], pa.binary()),
                    pa.array([h[at].tobytes() for _, at in own], pa.binary()),
                    pa.array([y[at].tobytes() for _, at in own], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _lent(starts, counts, step: int, names: list[str]):
    """Batches of ``(key, slot, rx, ry)`` -> the places and ranks that a part may meet in some replicate of a packet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_at, after = starts.value, starts.value + counts.value
        for table in _gathered(batches, 1 << 19):
            slot, rx = table["_slot"].to_numpy(), table["_rx"].to_numpy()
            order = np.argsort(slot)
            slot, rx = slot[order], rx[order]
            for chunk, first in enumerate(range(0, len(first_at), step)):
                lo = np.searchsorted(slot, first_at[first : first + step].min(axis=0) + 1)
                hi = np.searchsorted(slot, after[first : first + step].max(axis=0), side="right")
                own = np.flatnonzero(hi > lo).tolist()
                columns = [
                    pa.array([chunk] * len(own), pa.int64()),
                    pa.array(own, pa.int64()),
                    pa.nulls(len(own), pa.binary()),
                    pa.array([slot[lo[b] : hi[b]].tobytes() for b in own], pa.binary()),
                    pa.array([rx[lo[b] : hi[b]].tobytes() for b in own], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _met(starts, step: int, kind: str, mean: float) -> Callable[[pa.Table], pa.Table]:
    """The packets of one part and ``step`` replicates -> each replicate's sum of products over the part's places."""

    def run(group: pa.Table) -> pa.Table:
        chunk, part = group["_chunk"][0].as_py(), group["_part"][0].as_py()
        rows = list(zip(group["_lengths"].to_pylist(), group["_a"].to_pylist(), group["_b"].to_pylist(), strict=True))
        slot = np.concatenate([np.frombuffer(a, dtype=np.int64) for lengths, a, _ in rows if lengths is None])
        rx = np.concatenate([np.frombuffer(b, dtype=float) for lengths, _, b in rows if lengths is None]) - mean
        order = np.argsort(slot)
        slot, rx = slot[order], rx[order]
        sent = [(np.cumsum(np.frombuffer(lengths, dtype=np.int32)), np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=kind)) for lengths, a, b in rows if lengths is not None]
        reps, found = [], []
        for i in range(len(sent[0][0]) if sent else 0):
            cuts = [slice(ends[i - 1] if i else 0, ends[i]) for ends, _, _ in sent]
            h = np.concatenate([x[1][at] for x, at in zip(sent, cuts, strict=True)])
            y = np.concatenate([x[2][at] for x, at in zip(sent, cuts, strict=True)])
            order = np.argsort(h)
            if (np.diff(h[order]) == 0).any():  # (64 bits alike: the same order under any partitioning)
                order = np.lexsort((y, h))
            at = np.searchsorted(slot, starts.value[chunk * step + i, part] + 1)
            reps.append(chunk * step + i)
            found.append(float(rx[at : at + len(h)] @ (y[order] / 2 - mean)))
        return pa.table({"_perm": pa.array(reps, pa.int64()), "_xy": pa.array(found, pa.float64())})

    return run


def _whole_null(ranked: DataFrame, row_id: str, n_perm: int, seed: int) -> DataFrame:
    """``(_perm, s)``: the correlation of ``_rx`` with shuffled ``_ry``, average ranks of one table with unique ids.

    The shuffles are those of :func:`permuted`.  A part of a replicate is a range
    of hashes; how many there are in each is counted first, so the places of a part
    are known, and the few that it can meet in any replicate are lent to it.  A row
    then costs a replicate twelve bytes in one shuffle and no sort but its part's.
    """
    own = ranked.where(F.col(row_id).isNotNull())
    slots = cut(positions(own.select(F.col(row_id).alias("_id"), F.col("_rx").cast("double").alias("_rx"), F.col("_ry").cast("double").alias("_ry")), "_id", "_slot"))
    rows = slots.select(F.col("_id").cast("string").alias("_key"), "_slot", "_rx", "_ry")
    n, xx, yy = rows.agg(F.count("*"), F.var_pop("_rx") * F.count("*"), F.var_pop("_ry") * F.count("*")).first()
    bits = max(0, (max(1, n) - 1).bit_length() - (_SHARE.bit_length() - 1))
    step, kind, tail = max(1, min(n_perm, _PAIRS // min(_SHARE, max(1, n)))), "<i4" if n < 1 << 30 else "<i8", f"-{seed}"
    tallied = rows.select("_key").mapInArrow(_counted(bits, n_perm, step, tail), "_perm long, _counts binary")
    # One number for each replicate and part: a twentieth of a byte a row for 200 replicates.
    counts = np.zeros((n_perm, 1 << bits), dtype=np.int64)

    for rep, found in _added(tallied):
        counts[rep] = found
    sc = ranked.sparkSession.sparkContext
    starts, sizes = sc.broadcast(np.cumsum(counts, axis=1) - counts), sc.broadcast(counts)
    names = ["_chunk", "_part", "_lengths", "_a", "_b"]
    given = "_chunk long, _part long, _lengths binary, _a binary, _b binary"
    packets = rows.mapInArrow(_packed(bits, n_perm, step, tail, kind, names), given).unionByName(rows.mapInArrow(_lent(starts, sizes, step, names), given))
    sums = packets.groupBy("_chunk", "_part").applyInArrow(_met(starts, step, kind, (n + 1) / 2), "_perm long, _xy double")
    return sums.groupBy("_perm").agg(_correlation(F.sum("_xy"), F.lit(xx), F.lit(yy)).alias("s"))


def permutation_test(
    df: DataFrame, x: str, y: str, row_id: str, n_perm: int = 20_000, block: str | None = None, seed: int = 7, one_sided: bool = False, groups: list[str] | None = None
) -> DataFrame:
    """Spearman correlation against shuffles of ``y`` (within blocks): observed, p (never 0), null mean and deviation.

    Ranks do not change under permutation, so only they are shuffled.  With
    ``groups`` every group is a test of its own.  Replicates without variation
    do not count.
    """
    keys = groups or []
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_ranks(average_ranks(pairs, x, "_rx", keys), y, "_ry", keys).select(*keys, row_id, *([block] if block else []), "_rx", "_ry")
    observed = ranked.groupBy(*keys).agg(F.corr("_rx", "_ry").alias("observed"))
    if block:
        null = _blocked_null(ranked, row_id, n_perm, keys, block, seed)
    elif not keys:
        null = _whole_null(ranked, row_id, n_perm, seed)
    else:
        null = permuted(ranked, ["_rx"], "_ry", row_id, n_perm, keys, seed).groupBy("_perm", *keys).agg(F.corr("_rx", "shuffled").alias("s"))
    hit = (F.col("s") if one_sided else F.abs("s")) >= (F.col("observed") if one_sided else F.abs("observed")) - 1e-12
    held = null.where("s is not null and not isnan(s)")
    return (
        (held.join(observed, keys) if keys else held.crossJoin(F.broadcast(observed)))
        .groupBy(*keys, "observed")
        .agg(
            ((F.count_if(hit) + 1) / (F.count("*") + 1)).cast("double").alias("p_value"),
            F.avg("s").alias("null_mean"),
            F.stddev_pop("s").alias("null_sd"),
            F.count("*").alias("n_perm"),
        )
    )


#: Rows of a part of a resampled table (so a place inside it takes two bytes).
_PLACES = 1 << 16

_PACKET = "_chunk long, _part long, _axis long, _at long, _a binary, _b binary, _c binary"
_COLUMNS = [c.split()[0] for c in _PACKET.split(", ")]


def _packets(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64()] * 4 + [pa.binary()] * 3
    return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=_COLUMNS)


def _narrow(counts: np.ndarray) -> bytes:
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.int64).tobytes()


def _wide(packed: bytes, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(packed, dtype=np.uint8 if len(packed) == rows * width else np.int64).reshape(rows, width)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their rows of ``counts``."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = counts[order]
    return keys[first], counts if len(first) == len(keys) else np.add.reduceat(counts, first, axis=0, dtype=np.int64)


class _Resampled:
    """Steps of a bootstrap of ``n`` rows; a packet covers ``step`` replicates.

    Draws move to the part of the row they hit as two bytes.  What was drawn there
    is summed by distinct value of either side and meets the other parts' values of
    the same range, where ranks are taken anew; these come back to the rows.
    """

    def __init__(self, n: int, n_boot: int, seed: int) -> None:
        self.n, self.n_boot, self.tail = n, n_boot, f"-{seed}"
        self.places = _PLACES
        self.parts = max(1, -(-n // self.places))
        self.step = max(1, min(n_boot, _PAIRS // max(1, min(self.places, n))))
        self.chunks = -(-n_boot // self.step)
        self.kind = "<i4" if n < 1 << 30 else "<i8"

    def reps(self, chunk: int) -> range:
        return range(chunk * self.step, min(self.n_boot, (chunk + 1) * self.step))

    def part_of(self, twice: np.ndarray) -> np.ndarray:
        """The part of doubled ranks of the whole table: values that share a rank share a part."""
        return (twice - 1) // 2 // self.places

    def drawn(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of ``(unit)``, a part's slots in one packet's replicates -> the places they draw, by part and replicate."""
        for unit in (u for b in batches for u in b.column(0).to_pylist()):
            block, chunk = divmod(unit, self.chunks)
            reps = self.reps(chunk)
            keys = [f"-{i}{self.tail}".encode() for i in range(block * self.places, min(self.n, (block + 1) * self.places))]
            at = ((_hashes(keys, reps) >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64).ravel()
            part = at // self.places
            order = np.argsort(part.astype(np.uint16) if self.parts <= 1 << 16 else part, kind="stable")  # by replicate inside a part
            lengths = np.bincount(part * len(reps) + np.repeat(np.arange(len(reps)), len(keys)), minlength=self.parts * len(reps)).reshape(-1, len(reps))
            ends = np.cumsum(lengths.sum(axis=1))
            place = (at % self.places).astype(np.uint16)[order]
            own = np.flatnonzero(lengths.any(axis=1)).tolist()
            rows = [(chunk, b, -2, 0, lengths[b].astype(np.int32).tobytes(), place[ends[b] - lengths[b].sum() : ends[b]].tobytes(), None) for b in own]
            yield from _packets(rows).to_batches()

    def held(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of ``(slot, doubled ranks)`` -> the rows of each part, for each packet."""
        for table in _gathered(batches, 1 << 19):
            slot, x, y = (table[c].to_numpy() for c in ("_slot", "_x", "_y"))
            order = np.argsort(slot, kind="stable")
            slot, x, y = slot[order], x[order], y[order]
            for part in np.unique(slot // self.places).tolist():
                cut_at = slice(*np.searchsorted(slot, (part * self.places, (part + 1) * self.places)))
                own = ((slot[cut_at] % self.places).astype(np.uint16).tobytes(), x[cut_at].tobytes(), y[cut_at].tobytes())
                yield from _packets([(chunk, part, -1, 0, *own) for chunk in range(self.chunks)]).to_batches()

    def weighed(self, group: pa.Table) -> pa.Table:
        """The packets of one part -> how often each of its rows was drawn in each replicate, and the rows' ranks."""
        rows, chunk = group.to_pylist(), group["_chunk"][0].as_py()
        home = [r for r in rows if r["_axis"] == -1]
        if not home:
            return _packets([])
        width, size = len(self.reps(chunk)), min(self.n, self.places)
        cells = [np.zeros(0, dtype=np.int64)]
        for r in rows:
            if r["_axis"] == -2:
                rep = np.repeat(np.arange(width), np.frombuffer(r["_a"], dtype=np.int32))
                cells.append(np.frombuffer(r["_b"], dtype=np.uint16).astype(np.int64) * width + rep)
        drawn = np.bincount(np.concatenate(cells), minlength=size * width).reshape(size, width)
        place, x, y = (np.concatenate([np.frombuffer(r[c], dtype=t) for r in home]) for c, t in (("_a", np.uint16), ("_b", np.int64), ("_c", np.int64)))
        order = np.lexsort((y, x, place))
        return _packets([(chunk, group["_part"][0].as_py(), -1, 0, _narrow(drawn[place[order]]), x[order].tobytes(), y[order].tobytes())])

    def sides(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """``(chunk, part, side, doubled ranks, draws)`` of weighed parts."""
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                for side in (0, 1):
                    twice = np.frombuffer(r["_b" if side == 0 else "_c"], dtype=np.int64)
                    yield r["_chunk"], r["_part"], side, twice, _wide(r["_a"], len(twice), len(self.reps(r["_chunk"])))

    def totals(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Weighed parts -> for each replicate, how many of a task's draws have their values in each part, on either side."""
        found = np.zeros((self.n_boot, 2, self.parts), dtype=np.int64)
        for chunk, _, side, twice, drawn in self.sides(batches):
            parts, sums = _summed(self.part_of(twice), drawn)
            reps = self.reps(chunk)
            found[reps.start : reps.stop, side, parts] += sums.T.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(self.n_boot), pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["_perm", "_counts"])

    def sent(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Weighed parts -> draws of each distinct value, to the part of the value."""
        for chunk, part, side, twice, drawn in self.sides(batches):
            values, sums = _summed(twice, drawn)
            to = self.part_of(values)
            edges = [*np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1]))).tolist(), len(to)]
            rows = [(chunk, part, side, int(to[a]), values[a:b].tobytes(), _narrow(sums[a:b]), None) for a, b in zip(edges, edges[1:], strict=False)]
            yield from _packets(rows).to_batches()

    def ranked(self, starts) -> Callable[[pa.Table], pa.Table]:
        """The packets of one range of values -> the doubled rank of each value in each replicate, to the part it came from."""

        def run(group: pa.Table) -> pa.Table:
            chunk, side, at = (group[c][0].as_py() for c in ("_chunk", "_axis", "_at"))
            reps, senders = self.reps(chunk), group["_part"].to_pylist()
            values = [np.frombuffer(a, dtype=np.int64) for a in group["_a"].to_pylist()]
            drawn = [_wide(b, len(v), len(reps)) for b, v in zip(group["_b"].to_pylist(), values, strict=True)]
            every, sums = _summed(np.concatenate(values), np.concatenate(drawn))
            sums = sums.astype(np.int64)
            twice = 2 * (np.cumsum(sums, axis=0) - sums + starts.value[reps.start : reps.stop, side, at]) + sums + 1
            twice = twice.astype(self.kind)
            return _packets([(chunk, part, side, at, twice[np.searchsorted(every, v)].tobytes(), None, None) for part, v in zip(senders, values, strict=True)])

        return run

    def multiplied(self, group: pa.Table) -> pa.Table:
        """A weighed part and the ranks of its values -> sums and products over its draws, about the mean rank."""
        rows, chunk = group.to_pylist(), group["_chunk"][0].as_py()
        home = next(r for r in rows if r["_axis"] == -1)
        reps, ranks = self.reps(chunk), []
        for side in (0, 1):
            own = sorted((r["_at"], r["_a"]) for r in rows if r["_axis"] == side)
            of_value = np.concatenate([np.frombuffer(a, dtype=self.kind) for _, a in own]).reshape(-1, len(reps))
            _, value = np.unique(np.frombuffer(home["_b" if side == 0 else "_c"], dtype=np.int64), return_inverse=True)
            ranks.append((of_value[value] - (self.n + 1)).astype(float))
        w = _wide(home["_a"], len(ranks[0]), len(reps)).astype(float)
        x, y = ranks
        wx, wy = w * x, w * y
        sums = {"n": w.sum(axis=0), "x": wx.sum(axis=0), "y": wy.sum(axis=0)} | {k: np.einsum("ij,ij->j", a, b) for k, a, b in (("xx", wx, x), ("yy", wy, y), ("xy", wx, y))}
        return pa.table({"rep": pa.array(reps, pa.int64())} | {f"_{k}": pa.array(v) for k, v in sums.items()})


def bootstrap_ci(df: DataFrame, x: str, y: str, row_id: str, n_boot: int = 10_000, alpha: float = 0.05, seed: int = 7) -> DataFrame:
    """Percentile interval of Spearman over resampled rows (unique ids, none null); ranks are taken anew in every replicate.

    A replicate is how often each row was drawn: rows are ranked once, move once
    for each packet of replicates, and draws move as bytes (:class:`_Resampled`).
    """
    spark = df.sparkSession
    pairs = df.select(F.col(row_id).alias("_id"), F.col(x).alias("_x"), F.col(y).alias("_y")).where("_id is not null and _x is not null and _y is not null")
    ranked = average_ranks(average_ranks(pairs, "_x", "_rx"), "_y", "_ry").select("_id", "_rx", "_ry")
    twice = [F.round(2 * F.col(r)).cast("long").alias(c) for r, c in (("_rx", "_x"), ("_ry", "_y"))]
    rows = cut(positions(ranked, "_id", "_slot").select((F.col("_slot") - 1).alias("_slot"), *twice))
    steps = _Resampled(rows.count(), n_boot, seed)
    units = -(-steps.n // steps.places) * steps.chunks
    spread = min(max(1, units), max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    draws = spark.range(0, units, 1, spread).mapInArrow(steps.drawn, _PACKET)
    weighed = cut(draws.unionByName(rows.mapInArrow(steps.held, _PACKET)).groupBy("_chunk", "_part").applyInArrow(lambda g: steps.weighed(g), _PACKET))
    # Two numbers for each replicate and part pass through the driver.
    counts = np.zeros((n_boot, 2, steps.parts), dtype=np.int64)
    for rep, found in _added(weighed.mapInArrow(steps.totals, "_perm long, _counts binary")):
        counts[rep] = found.reshape(2, -1)
    starts = spark.sparkContext.broadcast(np.cumsum(counts, axis=2) - counts)
    ranks = weighed.mapInArrow(steps.sent, _PACKET).groupBy("_chunk", "_axis", "_at").applyInArrow(steps.ranked(starts), _PACKET)
    names = ["n", "x", "y", "xx", "yy", "xy"]
    parts = weighed.unionByName(ranks).groupBy("_chunk", "_part").applyInArrow(lambda g: steps.multiplied(g), "rep long, " + ", ".join(f"_{c} double" for c in names))
    sums = parts.groupBy("rep").agg(*[F.sum(f"_{c}").alias(c) for c in names])
    about = {a + b: F.greatest(F.col(a + b) - F.col(a) * F.col(b) / F.col("n"), F.lit(0.0 if a == b else -float("inf"))) for a, b in ("xx", "yy", "xy")}
    flat = (F.col("n") < 3) | (F.sqrt(about["xx"]) * F.sqrt(about["yy"]) < 4e-12 * F.col("n"))
    each = sums.select("rep", F.when(flat, F.lit(0.0)).otherwise(about["xy"] / F.sqrt(about["xx"]) / F.sqrt(about["yy"])).alias("rho"))
    return each.agg(F.percentile("rho", F.lit(alpha / 2)).alias("lo"), F.percentile("rho", F.lit(1 - alpha / 2)).alias("hi"), F.count("*").alias("n_boot"))
