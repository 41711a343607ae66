import random

import numpy as np
import pytest
import xxhash

from sitewise.llm import simhash_dedup as s
from sitewise.llm.components import connected_components


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    words = low.split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """Root index of each, by trying all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_golay_keys_cover_two_errors():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 1 << 23, 4000)
    flips = rng.integers(0, 23, (4000, 2))
    u = v ^ (1 << flips[:, 0]) ^ np.where(rng.random(4000) < 0.8, 1 << flips[:, 1], 0)
    mine, theirs = [{} for _ in range(2)]
    for keys, x in ((mine, v), (theirs, u)):
        for row, word in zip(*(c.tolist() for c in s.codewords(x))):
            keys.setdefault(row, set()).add(word)
    assert all(mine[i] & theirs[i] for i in range(4000))
    assert set(map(len, mine.values())) == {1, 6}


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one two", "A b C d \x0b e É É É É", "x " * 50, "ab" * 5000])
def test_fingerprint(text):
    assert s.fingerprint((text or "").encode()) == brute_fingerprint(text)


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def rows():
    rng = random.Random(1)
    base = [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(1, 300))) for _ in range(40)]
    out = []
    for i in range(250):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(9)}"
        out.append((i * 11 % 251 + 5, " ".join(words), "en"))
    return out + [(1, None, None), (2, "", None), (3, " \t", None), (None, base[0], None), (None, "only here, without an id", None), (7, base[1], None), (7, base[1], None)]


def test_components_against_brute_force(spark):
    data = rows()
    got = s.groups(documents(spark, data)).collect()
    fps = [brute_fingerprint(t) for _, t, _ in data]
    roots = brute_components(fps)
    least: dict = {}
    for (key, *_), r in zip(data, roots):
        least[r] = min(least.get(r, s.NO_ID), key if key is not None else s.NO_ID)
    want = sorted(((key if key is not None else s.NO_ID), fp, least[r]) for (key, *_), fp, r in zip(data, fps, roots))
    assert sorted((g._key, g.fp % (1 << 64), g.least) for g in got) == want
    kept = s.representatives(documents(spark, data)).collect()
    assert len(kept) == len(set(roots))
    assert {k.doc_id for k in kept} == {k if k != s.NO_ID else None for k in least.values()}


@pytest.mark.parametrize("group", [1, 5, 256])
def test_crowded_keys(spark, group):
    rng = random.Random(2)
    fps = {0, 1 << 63}
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(40):
            fps.add(x)
            x ^= (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
            if rng.random() < 0.1:
                x ^= 7 << rng.randrange(60)
    fps = sorted(fps)
    signed = [f - (1 << 64) * (f >> 63) for f in fps]
    edges = s.links(spark.createDataFrame([(f,) for f in signed], "fp long"), group)
    label = {r.node: r.root for r in connected_components(edges).collect()}
    roots = brute_components(fps)
    parts: dict = {}
    for f, r in zip(signed, roots):
        parts.setdefault(r, set()).add(label.get(f, f))
    assert all(len(p) == 1 for p in parts.values())
    assert len({next(iter(p)) for p in parts.values()}) == len(parts)


def test_keys_go_from_their_shuffle_to_the_comparison(spark, monkeypatch):
    """Above a join on the key Spark drops a repartition by it and may read that join's side by mapper, which parts a key's rows."""
    plans, cut = [], s.cut
    see = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(s, "cut", lambda df: (see(df), cut(df))[1])
    fps = [(i * 7 % 5 << 50 | i << 3,) for i in range(300)]
    see(s.links(spark.createDataFrame(fps, "fp long").distinct(), 5))
    compared = [p for p in plans if "sortWithin" in p or "Sort [key" in p]
    assert compared and all("REPARTITION_BY_COL" in p and "Join" not in p.split("MapInArrow _keys")[0] for p in compared)


def test_crowd_over_many_batches():
    """A key's rows that come in many batches are all handed on, and none is held back for long."""
    key = np.repeat([1, 2, 3, 4, 5], [2, 7, 1, 30, 2]).astype(np.int64)
    fp = np.arange(len(key), dtype=np.int64) << 8
    fp[[0, 1, 40, 41]] = [0, 1, 1 << 60, (1 << 60) + 3]
    for rows in (1, 3, 4, 100):
        batches = (s.pa.RecordBatch.from_arrays([s.pa.array(key[i : i + rows]), s.pa.array(fp[i : i + rows])], names=["key", "fp"]) for i in range(0, len(key), rows))
        got = [tuple(r.values()) for b in s._links(5)(batches) for r in b.to_pylist()]
        assert sorted(a for a, b in got if b is None) == fp[2:9].tolist() + fp[10:40].tolist()
        assert [r for r in got if r[1] is not None] == [(1, 0), ((1 << 60) + 3, 1 << 60)]


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert s.groups(empty).count() == 0
    assert s.representatives(empty).columns == empty.columns
