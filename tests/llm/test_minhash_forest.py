import random

import numpy as np
import pytest

from sitewise.llm import minhash_forest as m

SCHEMA = "doc_id long, text string, _key string, n string"


def brute_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    words = low.split()
    return frozenset(tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))) if words else frozenset()


def brute(rows):
    """Size of the set and least id of the component of each row, by trying all pairs."""
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            if s and 100 * len(s & sets[j]) >= 85 * len(s | sets[j]):
                root[find(i)] = find(j)
    ids = [k if k is not None else m.NO_ID for k, _ in rows]
    least: dict = {}
    for i, k in enumerate(ids):
        least[find(i)] = min(least.get(find(i), m.NO_ID), k)
    return sorted((k, len(s), least[find(i)]) for i, (k, s) in enumerate(zip(ids, sets)))


def check(spark, rows, **kw):
    frame = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], SCHEMA).repartition(3)
    assert sorted((r._key, r.n, r.least) for r in m.groups(frame, **kw).collect()) == brute(rows)
    return frame


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
    return " ".join(words)


def crowd(rng, n):
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    return [edited(rng, base, rng.randrange(8)) for _ in range(n)]


@pytest.mark.parametrize("group", [2, 256])
def test_against_brute_force(spark, group):
    rng = random.Random(group)
    texts = crowd(rng, 60)
    for _ in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(5, 300))]
        texts += [edited(rng, base, rng.randrange(4)) for _ in range(rng.randrange(1, 4))]
    texts += texts[:9]
    rng.shuffle(texts)
    frame = check(spark, [(i * 7 % 1009 + 3, t) for i, t in enumerate(texts)], group=group)
    kept = m.representatives(frame, "doc_id", "text")
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, _, least in brute([(r.doc_id, r.text) for r in frame.collect()]) if k == least}


def test_regions_deepen(spark, monkeypatch):
    """A crowd that its neighbours don't tie up goes down to the last depth."""
    monkeypatch.setattr(m, "neighbours", lambda nodes: nodes.limit(0).selectExpr("id AS a", "id AS b"))
    check(spark, list(enumerate(crowd(random.Random(3), 40))), group=4)


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(250_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (7, "two one"), (8, "a b c"), (8, "A b\vC"), (9, "É é"), (10, "é É"), (None, "a b c"), (None, None), (11, long), (12, long + " end"), (1, None), (5, "one"), (13, "a b c a b c a b c")]
    check(spark, rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert m.groups(empty).count() == 0
    assert m.representatives(empty).columns == empty.columns


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (rng.integers(0, 1 << 64, n, np.uint64) for n in rng.integers(1, 400, 2))
        both = np.unique(np.r_[a, b])
        a, b = (np.union1d(x, both[:200]) for x in (a, b))
        differ = int(np.bitwise_count(m.bitmap(a).view(np.uint64) ^ m.bitmap(b).view(np.uint64)).sum())
        assert differ <= len(np.setxor1d(a, b))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    v = rng.integers(0, 1 << 64, 1000, np.uint64)
    equal = [(m.signature(v[:k]) == m.signature(v)).mean() for k in (250, 500, 850, 1000)]
    assert np.allclose(equal, (0.25, 0.5, 0.85, 1), atol=0.13)


def test_crowd_makes_few_pairs(spark, monkeypatch):
    """Pairs of a crowd that its neighbours don't tie up grow as its nodes do, not as all their pairs."""
    monkeypatch.setattr(m, "neighbours", lambda nodes: nodes.limit(0).selectExpr("id AS a", "id AS b"))
    made, verified = [], m.verified
    monkeypatch.setattr(m, "verified", lambda pairs, *rest: (made.append(pairs.count()), verified(pairs, *rest))[1])
    rng = random.Random(4)
    base = [f"w{rng.randrange(3000)}" for _ in range(300)]
    check(spark, [(i, edited(rng, base, 3)) for i in range(80)])
    assert sum(made) <= 5 * 80
