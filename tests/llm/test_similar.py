import random

from tidemark.llm import similar


def result(df, **kw):
    return sorted(((r["doc_id"], r["component_id"]) for r in similar.similar_texts(df, **kw).collect()), key=str)


def test_near_copies_are_found_and_others_left_alone(frame, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(30):
        base = [rng.choice(words) for _ in range(250)]
        rows.append((10 * g, " ".join(base)))
        for k in range(1, 4):
            copy = list(base)
            for _ in range(k):
                copy[rng.randrange(250)] = rng.choice(words)
            rows.append((10 * g + k, " ".join(copy)))
    got = dict(result(frame(rows)))
    caught = sum(got[10 * g + k] == 10 * g for g in range(30) for k in range(1, 4))
    assert caught >= 86  # shingle similarity 0.89 to 0.96
    assert all(got[10 * g] == 10 * g for g in range(30))


def test_cells_lose_nothing(frame):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(3):  # groups around one text, whose members differ in one place each
        base = [rng.choice(words) for _ in range(120)]
        for k in range(50):
            copy = list(base)
            copy[rng.randrange(120)] = rng.choice(words)
            rows.append((100 * g + k, " ".join(copy)))
    # Two clusters that share most shingles, too little for a link between most of their members.
    base = [rng.choice(words) for _ in range(120)]
    for k in range(40):
        other = base[:100] + [f"x{k % 2}{i}" for i in range(20)] + [rng.choice(words)]
        rows.append((1000 + k, " ".join(other)))
    right = by_jaccard(rows)
    assert result(frame(rows)) == right
    assert result(frame(rows), bucket_limit=7) == right


def test_edges(frame):
    rows = [(3, None), (2, ""), (None, " \n"), (7, "one two"), (7, "ONE two"), (9, "x " * 3000)]
    assert result(frame(rows)) == by_jaccard(rows)
    assert result(frame([])) == []


def by_jaccard(rows):
    """Components of all pairs with Jaccard similarity 0.8 or more of their distinct five-word shingles."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def test_against_brute_force_jaccard(frame, docs):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    rows = [(r["doc_id"] + 10_000, r["text"]) for r in docs.collect()]
    # One block of n words replaced changes n + 4 shingles: similarities from 0.6 to 0.95 around the threshold.
    for g in range(120):
        size = rng.choice([20, 60, 150, 400])
        base = [rng.choice(words) for _ in range(size)]
        rows.append((4 * g, " ".join(base)))
        for k in range(1, 4):
            n = max(1, round(rng.uniform(0.03, 0.25) * size) - 4)
            at = rng.randrange(size - n)
            rows.append((4 * g + k, " ".join(base[:at] + [rng.choice(words) for _ in range(n)] + base[at + n :])))
    # A dense group, and repeats that count once.
    base = [rng.choice(words) for _ in range(100)]
    for k in range(60):
        copy = list(base)
        copy[rng.randrange(100)] = rng.choice(words)
        rows.append((1000 + k, " ".join(copy)))
    rows += [(2000, " ".join(base[:50] + ["x"] * 300)), (2001, " ".join(base[50:] + ["x"] * 300))]
    found, right = dict(result(frame(rows))), dict(by_jaccard(rows))
    assert all(right[c] == right[d] for d, c in found.items())  # no link below the threshold
    assert sum(found[d] != right[d] for d in found) <= 1  # in 5,000 pairs at the threshold one does not meet
