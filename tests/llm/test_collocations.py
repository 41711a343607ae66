import random
import re
from collections import Counter

import pytest

from sitewise.llm import collocations as m

SCHEMA = "doc_id long, text string, lang string, word string"


def brute(rows, least, longest=5, top=2000):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        f = counts.setdefault(lang, Counter())
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            totals[lang] += len(w)
            f.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        n, scored = totals[lang], []
        candidates = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        for p, a in candidates.items():
            inside = any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items())
            if not inside:
                score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def mined(spark, rows, least, block_bytes=1 << 20, top=2000):
    frame = spark.createDataFrame([(i, t, lang, "x") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)
    counted, totals = m.phrases(frame, least, block_bytes=block_bytes)
    return sorted(map(tuple, m.ranked(m.not_inside(m.scored(counted, totals)), top).collect()))


def corpus(rng, n):
    words = [f"w{i}" for i in range(3)] * 4 + ["É", "x\x00", "a-b", "x\x1cy"]
    made = lambda: "".join(rng.choice(words) + rng.choice([" "] * 8 + ["\t", "  ", ". ", "\n", "\x0b", " ;"]) for _ in range(rng.randrange(40)))
    return [(made(), rng.choice(["en", "de", None])) for _ in range(n)]


@pytest.mark.parametrize("block_bytes,least", [(200, 6), (1 << 20, 3), (1, 10)])
def test_against_brute_force(spark, block_bytes, least):
    rows = corpus(random.Random(least), 120)
    want = brute(rows, least)
    assert len(want) > 20
    assert mined(spark, rows, least, block_bytes) == want


def test_ties_limit_and_edge_cases(spark):
    rows = [(None, "en"), ("", None), ("One two. one TWO, one two", "en"), ("one two", "en"), ("a a a a a a a", "und"), ("b b b b b b b", None), ("c d " * 9, "x"), ("c d " * 9, "x"), ("." * 50, "x")]
    for top in (1, 2000):
        assert mined(spark, rows, 2, top=top) == brute(rows, 2, top=top)
    assert mined(spark, rows, 100) == []
    assert mined(spark, [], 2) == []


def test_long_text(spark):
    """One piece of some MB, and a text of many pieces that is cut into blocks."""
    one = "u v w " * 300_000
    many = "u v, w x y z. " * 200_000
    got = mined(spark, [(one, "en"), (many, "en")], 1000, 1 << 18)
    f = {r[2]: r[3] for r in got}
    assert f["u v w u v"] == 299_999 and f["w x y z"] == 200_000


def test_products_beyond_64_bits(spark):
    counted = spark.createDataFrame([("en", ["a"], 4 * 10**12), ("en", ["b"], 3 * 10**12), ("en", ["a", "b"], 2 * 10**12)], "lang string, words array<string>, f long")
    totals = spark.createDataFrame([("en", 10**15 + 7)], "lang string, n long")
    assert m.scored(counted, totals).first().score == 1000 * 2 * 10**12 * (10**15 + 7) // (12 * 10**24)


def test_workers_give_memory_back(spark):
    from sitewise.llm.common import lean_workers

    def pool(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pa.default_memory_pool().backend_name] * batch.num_rows)], names=["pool"])

    lean_workers(spark)
    assert spark.range(1).mapInArrow(pool, "pool string").first().pool == "system"
