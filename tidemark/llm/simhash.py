"""SimHash near-duplicates through pivot distance tables.

1. ``fingerprints``: a 64-bit SimHash of each whole text (Arrow batches; the
   hash of a shingle is XXH64 with seed 42).
2. ``pivot_table``: the Hamming distances of every *distinct* fingerprint to
   reference fingerprints.  The 64 bits are split into ``blocks`` zones, each
   zone with its own references (distances restricted to the zone are the
   differences of two full distances whose references agree elsewhere).
3. Two fingerprints at most ``d`` bits apart change at most ``d`` zones, so at
   least ``blocks - d`` zones have coordinate difference zero: pairs are only
   compared inside buckets of equal coordinates for some choice of
   ``blocks - d`` zones.  Inside a bucket, pairs with a coordinate difference
   over ``d`` to any full-width reference are discarded and the survivors are
   verified by their exact distance.
4. A bucket never becomes a list of all its pairs: it yields a spanning star of
   each of its components.  Buckets above ``bucket_limit`` fingerprints take an
   exact linear way instead: every member is filed under all words within
   ``ceil(d / 2)`` bits of it, two members within ``d`` bits meet under a common
   word, and no word can gather more than the size of that ball.
5. Components over the stars give the smallest reachable document.

Memory: a task holds one Arrow batch, or one bucket of at most ``bucket_limit``
(or one ball of at most 2,081) eight-byte fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import free_name, written

SHINGLE = 4
MAX_DISTANCE = 4
SEED = 42
BUCKET_LIMIT = 2048
ZONE_REFERENCES = 8
FULL_REFERENCES = 16
#: Hashes turned into bit counts at once.
_CHUNK = 1 << 16


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of every word shingle (of the whole sequence if there are fewer words; none for blank texts)."""
    import xxhash

    words = (text or b"").lower().split()  # bytes: exactly A-Z and \x20 \x09-\x0D
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype="<u8")
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    last = len(words) - shingle + 1
    found = [digest(joined[a:b], SEED) for a, b in zip(starts[:last].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    return np.array(found, dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(sum(1 << int(i) for i in np.nonzero(ones * 2 > len(hashes))[0]))


def fingerprint_of(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one UTF-8 text; 0 for null, empty or blank texts."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without the text, plus ``fp`` (``_fp`` if that is taken): the fingerprint as a signed 64-bit integer."""
    keep = [c for c in docs.columns if c != text]
    name = free_name(docs, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            found = np.fromiter((fingerprint_of(t, shingle) for t in texts.to_pylist()), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(found.view(np.int64))],
                names=[*keep, name],
            )

    wanted = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("binary").alias("__text"))
    schema = docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(0).cast("long").alias(name)).schema
    return wanted.mapInArrow(run, schema)


# ---------------------------------------------------------------- references


def _zones(blocks: int) -> list[int]:
    """Masks of ``blocks`` disjoint zones that cover 64 bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def _references(n: int, seed: int) -> list[int]:
    rng = np.random.default_rng(seed)
    return [int(x) for x in rng.integers(0, 1 << 64, n, dtype=np.uint64)]


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def pivot_table(fp: Column, blocks: int) -> list[Column]:
    """One long per zone: the distances to its references, four bits each (zones have at most 15 bits)."""
    out = []
    for j, mask in enumerate(_zones(blocks)):
        packed = F.lit(0).cast("long")
        for i, reference in enumerate(_references(ZONE_REFERENCES, 1000 + j)):
            distance = F.bit_count(fp.bitwiseXOR(F.lit(_signed(reference))).bitwiseAND(F.lit(_signed(mask))))
            packed = packed.bitwiseOR(F.shiftleft(distance.cast("long"), 4 * i))
        out.append(packed)
    return out


def zones_for(n: int, max_distance: int = MAX_DISTANCE, per_bucket: int = 16) -> int:
    """The fewest zones whose buckets would hold ``per_bucket`` unrelated fingerprints at most, on average.

    Only the work depends on it, never the result: any number above
    ``max_distance`` finds all pairs.
    """
    for blocks in range(max_distance + 2, 2 * max_distance + 8):
        bits = 64 * (blocks - max_distance) // blocks
        if n <= per_bucket << bits or comb(blocks + 1, max_distance) > 500:
            return blocks
    return 2 * max_distance + 8


def _stars(members: np.ndarray, max_distance: int, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each fingerprint of a bucket to the least of its component there."""
    members = np.unique(members)
    n = len(members)
    if n < 2:
        return members[:0], members[:0]
    coordinates = np.bitwise_count(members[:, None] ^ references[None, :]).astype(np.int8)
    left, right = [], []
    for at in range(0, n, 512):
        near = np.ones((min(512, n - at), n), dtype=bool)
        for c in coordinates.T:
            near &= np.abs(c[at : at + 512, None] - c[None, :]) <= max_distance
        i, j = np.nonzero(near)
        i += at
        survivors = i < j
        i, j = i[survivors], j[survivors]
        close = np.bitwise_count(members[i] ^ members[j]) <= max_distance
        left.append(i[close])
        right.append(j[close])
    i, j = np.concatenate(left), np.concatenate(right)
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.nonzero(label != np.arange(n))[0]
    return members[moved], members[label[moved]]


def _star_job(max_distance: int):
    references = np.array(_references(FULL_REFERENCES, 7), dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy().view(np.uint64)
            sizes = np.diff(offsets)
            pairs = offsets[:-1][sizes == 2]
            x, y = values[pairs], values[pairs + 1]
            gap = np.abs(
                np.bitwise_count(x[:, None] ^ references).astype(np.int8) - np.bitwise_count(y[:, None] ^ references).astype(np.int8)
            ).max(axis=1, initial=0)
            survive = gap <= max_distance
            x, y = x[survive], y[survive]
            close = np.bitwise_count(x ^ y) <= max_distance
            left, right = [x[close]], [y[close]]
            for at in np.nonzero(sizes > 2)[0]:
                a, b = _stars(values[offsets[at] : offsets[at + 1]], max_distance, references)
                left.append(a)
                right.append(b)
            a, b = np.concatenate(left), np.concatenate(right)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return run


def _ball_job(radius: int):
    masks = [0]
    for r in range(1, radius + 1):
        masks += [sum(1 << b for b in bits) for bits in combinations(range(64), r)]
    ball = np.array(masks, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(own), 256):
                part = own[at : at + 256]
                words = (part[:, None] ^ ball[None, :]).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words.view(np.int64)), pa.array(np.repeat(part, len(ball)).view(np.int64))], names=["word", "fp"]
                )

    return run


def links(distinct: DataFrame, max_distance: int = MAX_DISTANCE, blocks: int | None = None, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``distinct(fp)`` -> ``(a, b)``: verified links whose components are those of all links within ``max_distance``."""
    if blocks is None:
        blocks = zones_for(distinct.count(), max_distance)
    zones = distinct.select("fp", *[c.alias(f"z{j}") for j, c in enumerate(pivot_table(F.col("fp"), blocks))])
    choices = list(combinations(range(blocks), blocks - max_distance))
    # Eight references of four bits each: a zone's coordinates are 32 bits; more than two zones are hashed
    # together, which can only make a bucket larger, never lose a pair.
    keys = []
    for k, chosen in enumerate(choices):
        if len(chosen) <= 2:
            key = F.col(f"z{chosen[0]}")
            if len(chosen) == 2:
                key = F.shiftleft(key, 32).bitwiseOR(F.col(f"z{chosen[1]}"))
        else:
            key = F.xxhash64(*[F.col(f"z{j}") for j in chosen])
        keys.append(F.struct(F.lit(k).cast("short").alias("c"), key.alias("k")))
    filed = zones.select("fp", F.explode(F.array(*keys)).alias("e")).select(F.col("e.c").alias("c"), F.col("e.k").alias("k"), "fp")
    shared = filed.groupBy("c", "k").agg(F.count("*").alias("n")).where("n > 1")
    held = written(filed.join(shared, ["c", "k"]), "buckets")
    usual = held.where(F.col("n") <= bucket_limit).groupBy("c", "k").agg(F.collect_list("fp").alias("members")).select("members")
    edges = usual.mapInArrow(_star_job(max_distance), "a long, b long")
    radius = (max_distance + 1) // 2
    hot = held.where(F.col("n") > bucket_limit).select("fp").distinct()
    balls = (
        hot.mapInArrow(_ball_job(radius), "word long, fp long")
        .groupBy("word")
        .agg(F.collect_list("fp").alias("members"))
        .where(F.size("members") > 1)
        .select("members")
    )
    return edges.union(balls.mapInArrow(_star_job(max_distance), "a long, b long"))


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    max_distance: int = MAX_DISTANCE,
    bucket_limit: int = BUCKET_LIMIT,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id, component_size``.

    ``component_id`` is the smallest document id that can be reached by links of
    fingerprints ``max_distance`` or fewer bits apart.  Null and blank texts have
    fingerprint zero and link like any other; rows with a null id take part and
    get their component's smallest known id (null where it has none); repeated
    rows stay repeated; other columns are ignored; an empty table gives an empty
    result.  ``component_size`` counts the rows of the component.
    """
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    marked = written(fingerprints(own, "text", shingle), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_docs")), "distinct")
    found = components(links(distinct.select("fp"), max_distance, None, bucket_limit))
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first_id", "n_docs"
    )
    classes = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.sum("n_docs").alias("component_size"))
    by_fp = written(rooted.join(classes, "root").select("fp", "component_id", "component_size"), "classes")
    return marked.join(by_fp, "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
        "component_size",
    )
