"""Near copies at a stated similarity of texts: distinct five-word shingles, Jaccard 0.8 or more.

``simhash.near_duplicates`` links fingerprints at a fixed small distance.  Here
fingerprints only propose, and a proposed pair becomes a link only if the sets
of shingles themselves reach the similarity.

At similarity 0.8 two SimHashes are 27 degrees apart, 19.4 of 128 bits on
average, so no zone of them is selective enough to meet on whatever the number
of documents.  Members therefore meet on the least of their shingles under
``KEYS`` permutations (each agrees with odds equal to the similarity: at 0.8 all
eight fail once in 390,000 pairs), which unrelated texts do not share.  Inside
a bucket the distances of every fingerprint to reference fingerprints, drawn
from the bucket itself, make a pivot table; pairs are discarded by the maximum
coordinate difference, and the survivors by exact distance (``MAX_TOTAL`` of
128 bits, 4.5 deviations), by size, and by the share of equal least shingles in
``BINS`` ranges of the hash (``LEAST_SHARE``, 4.5 deviations).

Equal sets are one member.  First every member proposes its nearest earlier
one, and the links among those make groups.  Then all surviving pairs of two
different groups are checked: a bucket first names the members that have such a
pair, and those come together again with their sets, where each pair is decided
once (in the first bucket that both share) and only links that join two groups
leave the task.  So a dense group costs rows in proportion to its members, and
no pair that could still join two groups is passed over.  A bucket over
``BUCKET_LIMIT`` is dealt in cells of at most two chunks.  Its members of the
largest group meet only members of other groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .simhash import majority
from .store import written

SHINGLE = 5
MAX_TOTAL = 38
#: Similarity 0.8 or more, as whole numbers.
SIMILAR = (4, 5)
KEYS = 8
BINS = 128
LEAST_SHARE = 0.64
REFERENCES = 8
BUCKET_LIMIT = 32768
_ROWS = 256
_EMPTY = 255
_MEMBER = ("node", "f1", "f2", "size", "sketch", "group")


def mixed(hashes: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hashes mixed again (a published 64-bit finaliser), as good as independent for each salt."""
    z = hashes + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & ((1 << 64) - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text (of its whole words if there are fewer), as sorted 64-bit hashes; none for blank texts."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(shingle, len(own))
    found = np.full(len(own) - width + 1, width, dtype=np.uint64)
    for j in range(width):
        found = mixed(found ^ own[j : len(own) - width + 1 + j], j)
    return np.unique(found)


def fingerprint_pair(hashes: np.ndarray) -> tuple[int, int]:
    """Two independent SimHashes of a set of shingles."""
    return majority(hashes), majority(mixed(hashes, 100))


_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """One byte of the least hash in each of ``BINS`` equal ranges; ``_EMPTY`` where a range has none."""
    at = np.append(np.searchsorted(hashes, _EDGES), len(hashes))
    out = np.full(BINS, _EMPTY, dtype=np.uint8)
    full = at[1:] > at[:-1]
    out[full] = hashes[at[:-1][full]] % np.uint64(_EMPTY)
    return out


def meeting_keys(hashes: np.ndarray) -> np.ndarray:
    """The least shingle under each permutation; texts without any meet on zero."""
    return np.array([mixed(hashes, 200 + k).min() if len(hashes) else 0 for k in range(KEYS)], dtype=np.uint64)


def _marks_job(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS)):
            found = np.zeros((batch.num_rows, 3 + KEYS), dtype=np.uint64)
            sizes, sketches = np.zeros(batch.num_rows, dtype=np.int32), []
            for i, t in enumerate(batch.column(2).to_pylist()):
                hashes = shingle_set(t, shingle)
                found[i, :2] = fingerprint_pair(hashes)
                found[i, 2] = xxhash.xxh64_intdigest(hashes.tobytes(), 42)
                found[i, 3:] = meeting_keys(hashes)
                sizes[i] = len(hashes)
                sketches.append(sketch(hashes).tobytes())
            f1, f2, node = (pa.array(np.ascontiguousarray(found[:, i]).view(np.int64)) for i in range(3))
            keys = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(found[:, 3:]).view(np.int64).ravel()), KEYS)
            columns = [batch.column(0), batch.column(1), node, f1, f2, pa.array(sizes), pa.array(sketches, pa.binary()), keys.cast(pa.list_(pa.int64()))]
            columns.append(pa.array([row.tobytes() for row in np.ascontiguousarray(found[:, 3:])], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "node", "f1", "f2", "size", "sketch", "meets", "keys"])

    return run


def _sets_job(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS)):
            sets = [shingle_set(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["node", "own"])

    return run


def survivors(prints: np.ndarray, size: np.ndarray, own: slice, coordinates: np.ndarray, max_total: int) -> np.ndarray:
    """Of the rows ``own`` against all: which pairs pass the pivot table, the exact distance and the sizes."""
    near = np.ones((len(prints[own]), len(prints)), dtype=bool)
    for c in coordinates.T:
        near &= np.abs(c[own, None] - c[None, :]) <= max_total
    if near.all():
        i, j = slice(None), slice(None)
        total = np.bitwise_count(prints[own, None, 0] ^ prints[None, :, 0]) + np.bitwise_count(prints[own, None, 1] ^ prints[None, :, 1])
        near = (total <= max_total) & (np.minimum(size[own, None], size[None, :]) * SIMILAR[1] >= np.maximum(size[own, None], size[None, :]) * SIMILAR[0])
        return near
    i, j = np.nonzero(near)
    x, y = prints[own][i], prints[j]
    a, b = size[own][i], size[j]
    near[i, j] = (np.bitwise_count(x ^ y).sum(axis=1) <= max_total) & (np.minimum(a, b) * SIMILAR[1] >= np.maximum(a, b) * SIMILAR[0])
    return near


def shares(sketches: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The share of equal bytes among the ranges that are not empty in both: an estimate of the similarity."""
    out = np.ones(len(i))
    for at in range(0, len(i), 1 << 15):
        x, y = sketches[i[at : at + (1 << 15)]], sketches[j[at : at + (1 << 15)]]
        void = ((x == _EMPTY) & (y == _EMPTY)).sum(axis=1)
        out[at : at + len(x)] = ((x == y).sum(axis=1) - void) / np.maximum(BINS - void, 1)
        out[at : at + len(x)][void == BINS] = 1
    return out


class Cell:
    """Members of a bucket (or of two of its chunks), in the order of their nodes."""

    def __init__(self, rows: pa.StructArray, a: int, b: int, across: bool, first: int) -> None:
        field = lambda name: rows.field(rows.type.get_field_index(name)).slice(a, b - a)
        self.has = {rows.type.field(i).name for i in range(rows.type.num_fields)}
        self.node = field("node").to_numpy(zero_copy_only=False)
        order = np.argsort(self.node, kind="stable")
        plain = lambda name: field(name).to_numpy(zero_copy_only=False)[order]
        self.node, self.size, self.group, self.spread = self.node[order], plain("size").astype(np.int64), plain("group"), plain("spread")
        self.prints = np.stack([plain("f1").view(np.uint64), plain("f2").view(np.uint64)], axis=1)
        packed = lambda name, kind, width: np.frombuffer(b"".join(field(name).to_pylist()), dtype=kind).reshape(b - a, width)[order]
        self.sketches = packed("sketch", np.uint8, BINS)
        self.keys = packed("keys", np.int64, KEYS) if "keys" in self.has else None
        self.own, self.order = (field("own") if "own" in self.has else None), order
        self.across, self.first = across, first

    def set_of(self, i: int) -> np.ndarray:
        return self.own[int(self.order[i])].values.to_numpy().view(np.uint64)

    def candidates(self, grouped: bool, max_total: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of indexes ``(later, earlier)`` that may be similar, and the share of their sketches, some rows at a time.

        ``grouped``: of different groups only, in a cell across two chunks only
        between a spread member and one that is not, and only in the first
        bucket that both members share.
        """
        n = len(self.node)
        references = self.prints[:: max(1, n // REFERENCES)][:REFERENCES]
        coordinates = np.zeros((n, 0), dtype=np.int16)
        if n > _ROWS:
            coordinates = np.stack([np.bitwise_count(self.prints ^ r).sum(axis=1).astype(np.int16) for r in references], axis=1)
        for at in range(0, n, _ROWS):
            rows = slice(at, at + _ROWS)
            near = survivors(self.prints, self.size, rows, coordinates, max_total)
            near &= np.arange(n)[None, :] < np.arange(at, at + len(near))[:, None]
            if grouped:
                near &= self.group[rows, None] != self.group[None, :]
                if self.across:
                    near &= self.spread[rows, None] != self.spread[None, :]
            x, y = np.nonzero(near)
            x += at
            if grouped and self.first:
                here = ~(self.keys[x, : self.first] == self.keys[y, : self.first]).any(axis=1)
                x, y = x[here], y[here]
            share = shares(self.sketches, x, y)
            kept = share >= LEAST_SHARE
            yield x[kept], y[kept], share[kept]

    def links(self, max_total: int) -> list[tuple[int, int]]:
        """Pairs of indexes that are similar and join two groups not joined in this cell before."""
        root: dict[int, int] = {}

        def top(g: int) -> int:
            while root.get(g, g) != g:
                root[g] = g = root.get(root[g], root[g])
            return g

        out = []
        for x, y, share in self.candidates(True, max_total):
            for k in np.argsort(-share, kind="stable").tolist():
                i, j = int(x[k]), int(y[k])
                g, h = top(int(self.group[i])), top(int(self.group[j]))
                if g != h and alike(self.set_of(i), self.set_of(j)):
                    root[max(g, h)] = min(g, h)
                    out.append((i, j))
        return out


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets reach the similarity."""
    if not len(x) or not len(y):
        return len(x) == len(y)
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return shared * SIMILAR[1] >= (len(x) + len(y) - shared) * SIMILAR[0]


def _cells_of(batch: pa.RecordBatch) -> Iterator[Cell]:
    members, across, first = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
    offsets = members.offsets.to_numpy()
    for a, b, x, c in zip(offsets[:-1].tolist(), offsets[1:].tolist(), across, first, strict=True):
        yield Cell(members.values, a, b, x, c)


def _nearest_job(max_total: int):
    """Of each member its nearest earlier one: ``(a, b)``, ``a < b``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for cell in _cells_of(batch):
                for x, y, share in cell.candidates(False, max_total):
                    order = np.lexsort((y, -share, x))
                    first = order[np.diff(x[order], prepend=-1) > 0]
                    left.append(cell.node[y[first]])
                    right.append(cell.node[x[first]])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    return run


def _doubtful_job(max_total: int):
    """The members that have a pair of another group to be checked: ``(c, node)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in _cells_of(batch):
                found = [np.unique(np.concatenate([x, y])) for x, y, _ in cell.candidates(True, max_total)]
                nodes = cell.node[np.unique(np.concatenate(found))]
                if len(nodes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), cell.first, dtype=np.int16)), pa.array(nodes)], names=["c", "node"])

    return run


def _links_job(max_total: int):
    """The links that join two groups: ``(a, b)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in _cells_of(batch):
                found = cell.links(max_total)
                if found:
                    i, j = np.array(found).T
                    yield pa.RecordBatch.from_arrays([pa.array(cell.node[j]), pa.array(cell.node[i])], names=["a", "b"])

    return run


def _chunk(salt: str, n: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "node"), n).cast("int")


def cells(filed: DataFrame, columns: tuple[str, ...], grouped: bool, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``filed(c, k, n, *columns)`` -> one row for each cell: its members, whether it lies across two chunks, and ``c``."""
    member = F.struct(*columns, "spread")
    usual = filed.where(F.col("n") <= bucket_limit).withColumn("spread", F.lit(False))
    whole = usual.groupBy("c", "k").agg(F.collect_list(member).alias("m")).select("m", F.lit(False).alias("across"), "c")
    large = filed.where(F.col("n") > bucket_limit)
    # Of a large bucket the members of its largest group (without groups: all but its least member) meet only the others.
    if grouped:
        counted = large.groupBy("c", "k", "group").agg(F.count("*").alias("own_n"))
        main = counted.groupBy("c", "k").agg(F.max_by("group", F.struct("own_n", "group")).alias("main"), F.max("own_n").alias("inside"))
    else:
        main = large.groupBy("c", "k").agg(F.min("node").alias("main"), (F.count("*") - 1).alias("inside"))
    spread = F.col("group") != F.col("main") if grouped else F.col("node") == F.col("main")
    per = F.lit(bucket_limit)
    dealt = (
        large.join(main, ["c", "k"])
        .withColumn("spread", spread)
        .withColumn("u", F.greatest(F.ceil(F.col("inside") / per), F.lit(1)).cast("int"))
        .withColumn("f", F.ceil((F.col("n") - F.col("inside")) / per).cast("int"))
        .withColumn("u_own", _chunk("u", F.col("u")))
        .withColumn("f_own", _chunk("f", F.col("f")))
    )
    inside = F.transform(F.sequence(F.lit(0), F.col("f") - 1), lambda j: F.struct(F.lit(True).alias("across"), F.col("u_own").alias("x"), j.alias("y")))
    outside = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("u") - 1), lambda i: F.struct(F.lit(True).alias("across"), i.alias("x"), F.col("f_own").alias("y"))),
        F.transform(F.sequence(F.lit(0), F.col("f") - 1), lambda j: F.struct(F.lit(False).alias("across"), F.least("f_own", j).alias("x"), F.greatest("f_own", j).alias("y"))),
    )
    placed = dealt.select("c", "k", *columns, "spread", F.explode(F.when(F.col("spread"), outside).otherwise(inside)).alias("at"))
    split = placed.groupBy("c", "k", "at").agg(F.collect_list(member).alias("m")).select("m", F.col("at.across").alias("across"), "c")
    return whole.union(split).where(F.size("m") > 1)


def crossing_links(held: DataFrame, members: DataFrame, sets: DataFrame, max_total: int = MAX_TOTAL, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links ``(a, b)`` between members of different groups, enough to join all groups that any link joins.

    ``held(c, k, node, n)`` are the buckets, ``members(node, f1, f2, size, sketch,
    keys, group)`` what is known of their members, ``sets(node, own)`` their sets.
    """
    columns = (*_MEMBER, "keys")
    filed = held.join(members, "node")
    several = filed.groupBy("c", "k").agg(F.min("group").alias("least"), F.max("group").alias("most")).where("least <> most").select("c", "k")
    filed = written(filed.join(several, ["c", "k"], "left_semi"), "filed")
    doubtful = cells(filed, columns, True, bucket_limit).mapInArrow(_doubtful_job(max_total), "c short, node long").distinct()
    again = written(filed.drop("n").join(doubtful, ["c", "node"]), "doubtful")
    counted = again.groupBy("c", "k").agg(F.count("*").alias("n"))
    # Sets are carried in smaller cells.
    full = again.join(counted, ["c", "k"]).join(sets, "node")
    return cells(full, (*columns, "own"), True, max(2, bucket_limit // 16)).mapInArrow(_links_job(max_total), "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs ``(a, b)`` whose sets ``sets(node, own)`` are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared * SIMILAR[1] >= (F.size("x") + F.size("y") - shared) * SIMILAR[0]).select("a", "b")


def similar_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, component_id`` (the smallest id of its group of near copies).

    Groups are the components of the pairs whose sets of distinct shingles have a
    Jaccard similarity of 0.8 or more.  Blank and null texts are copies of each
    other; rows with a null id take part; repeated rows stay repeated; other
    columns are ignored; texts of any length are taken whole; an empty table
    gives an empty result.
    """
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text")).select("doc_id", F.xxhash64("text").alias("key"), "text")
    kind = own.schema["doc_id"].dataType.simpleString()
    marks = f"doc_id {kind}, key long, node long, f1 long, f2 long, size int, sketch binary, meets array<long>, keys binary"
    marked = written(own.mapInArrow(_marks_job(shingle), marks), "marks")
    known = ("f1", "f2", "size", "sketch", "meets", "keys")
    first = F.min(F.struct("doc_id", "key"))  # one text of the set
    firsts = marked.groupBy("node").agg(F.min("doc_id").alias("first_id"), first.alias("text_of"), *[F.min(c).alias(c) for c in known])
    distinct = written(firsts.select("node", "first_id", F.col("text_of.doc_id").alias("text_id"), F.col("text_of.key").alias("key"), *known), "distinct")
    filed = distinct.select("node", F.posexplode("meets").alias("c", "k")).select(F.col("c").cast("short").alias("c"), "k", "node")
    shared = filed.groupBy("c", "k").agg(F.count("*").alias("n")).where("n > 1")
    held = written(filed.join(shared, ["c", "k"]), "buckets")
    members = distinct.select("node", "f1", "f2", "size", "sketch", "keys", F.col("node").alias("group"))
    nearest = written(cells(held.join(members, "node"), _MEMBER, False, bucket_limit).mapInArrow(_nearest_job(MAX_TOTAL), "a long, b long").distinct(), "nearest")
    # Sets of all members that share a bucket, each from one of its texts: copies stay behind.
    wanted = distinct.select("node", "text_id", "key").join(held.select("node").distinct(), "node", "left_semi")
    same = (own["key"] == wanted["key"]) & own["doc_id"].eqNullSafe(wanted["text_id"])
    texts = own.join(wanted, same).select("node", "text").dropDuplicates(["node"])
    sets = written(texts.mapInArrow(_sets_job(shingle), "node long, own array<long>"), "sets")
    groups = written(components(verified(nearest, sets)), "groups")
    grouped = members.drop("group").join(groups, "node", "left").withColumn("group", F.coalesce("root", "node")).drop("root")
    # Groups are contracted: a link between two members is a link between their roots.
    root_of = lambda c: groups.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    crossing = crossing_links(held, grouped, sets, MAX_TOTAL, bucket_limit).join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
    joined = components(crossing.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    inner = grouped.select("node", F.col("group").alias("root")).join(joined.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    rooted = distinct.select("node", "first_id").join(inner.select("node", F.coalesce("top", "root").alias("root")), "node")
    classes = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_node = written(rooted.join(classes, "root").select("node", "component_id"), "classes")
    return marked.select("doc_id", "node").join(by_node, "node").select("doc_id", "component_id")
