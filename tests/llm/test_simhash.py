import numpy as np
import xxhash

from tidemark.llm import simhash
from tidemark.llm.components import components


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, distance=4):
    """Smallest id reachable by links of fingerprints."""
    fps = [slow_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, f"{f:016x}", least.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))]


def result(frame, rows, **kw):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(frame(rows), **kw).collect()), key=str)


def test_against_brute_force(frame, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert result(frame, rows) == sorted(brute(rows), key=str)


def test_edges(frame):
    rows = [(5, None), (3, ""), (9, " \t\n"), (4, "One two"), (4, "one TWO"), (None, "one two"), (7, "É one two three four five"), (8, "word " * 5000)]
    assert result(frame, rows) == sorted(brute(rows), key=str)
    assert result(frame, []) == []


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c d e", 7, "x"), (2, "a b c d e", 8, "y")], "doc_id long, text string, fp int, component_id string")
    assert {r["component_id"] for r in simhash.near_duplicates(df).collect()} == {1}


def test_links_are_complete_also_in_large_buckets(spark):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 6, dtype=np.int64).astype(np.uint64)
    members = set()
    for c in centre:
        for _ in range(120):
            f = int(c)
            for b in rng.choice(64, rng.integers(0, 7), replace=False):
                f ^= 1 << int(b)
            members.add(f)
    values = sorted(members)
    label = {v: v for v in values}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 4:
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    groups = {}
    for v in values:
        groups.setdefault(find(v), set()).add(v)
    want = {frozenset(g) for g in groups.values() if len(g) > 1}
    table = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    for limit, blocks in ((2048, 6), (8, 6), (8, 7), (2048, 8)):
        found = {}
        for r in components(simhash.links(table, 4, blocks, limit)).collect():
            found.setdefault(r["root"], set()).add(r["node"] % (1 << 64))
        assert {frozenset(g) for g in found.values()} == want


def test_components_of_a_long_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(500, 500), (601, 600), (600, 601)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(n + 1)) and got[601] == 600 and 500 not in got


def test_coordinates_bound_distances():
    rng = np.random.default_rng(1)
    refs = np.array(simhash._references(16, 7), dtype=np.uint64)
    x = rng.integers(0, 1 << 63, 100).astype(np.uint64)
    y = x ^ np.uint64(0b1011 << 20)
    gap = np.abs(np.bitwise_count(x[:, None] ^ refs).astype(int) - np.bitwise_count(y[:, None] ^ refs).astype(int))
    assert gap.max() <= 3
    assert sum(m.bit_count() for m in simhash._zones(7)) == 64
