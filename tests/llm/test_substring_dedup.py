import random

from sitewise.llm import substring_dedup, windows

DOCS = "doc_id long, text string, lang string"


def brute(rows, size):
    docs = sorted({(k if k is not None else 1 << 63, t or "") for k, t in rows})
    first: dict = {}
    words = [(k, t, t.encode().split()) for k, t in docs]
    for key, _, w in words:
        for p in range(len(w) - size + 1):
            first.setdefault(tuple(w[p : p + size]), key)
    out = {}
    for key, text, w in words:
        gone = set()
        for p in range(len(w) - size + 1):
            if first[tuple(w[p : p + size])] < key:
                gone |= set(range(p, p + size))
        out[key, text] = (len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
    return out


def check(spark, rows, size=13):
    frame = spark.createDataFrame([(k, t, None) for k, t in rows], DOCS)
    got = substring_dedup.dedup(frame.repartition(3), size).collect()
    want = brute(rows, size)
    found = sorted(((r._row.doc_id if r._row.doc_id is not None else 1 << 63), r.n_words, sum(s.stop - s.start for s in r.removed), r.kept or "") for r in got)
    assert found == sorted(((k if k is not None else 1 << 63), *want[k if k is not None else 1 << 63, t or ""]) for k, t in rows)
    return got


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "çé", "ωμέγα", "the", "of"]) + rng.choice(["", str(rng.randrange(30))]) for _ in range(n))


def test_against_brute_force(spark):
    rng = random.Random(5)
    shared = [prose(rng, 50) for _ in range(4)]
    rows = []
    for i in range(90):
        parts = [prose(rng, rng.randrange(1, 40))]
        for _ in range(rng.randrange(4)):
            s = rng.choice(shared).split()
            a = rng.randrange(len(s) // 2)
            parts += [" \n\t".join(s[a : a + rng.randrange(40)]), prose(rng, rng.randrange(20))]
        rows.append((i * 7 % 97, "\x0b".join(parts)))
    rows += [(200 + i, rows[5][1]) for i in range(30)] + [(300, "na " * 500), (301, "na " * 30), (302, "na " * 12)]
    check(spark, rows)
    check(spark, rows, 5)


def test_edge_cases(spark):
    same = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    got = check(spark, [(1, None), (2, ""), (3, same), (3, same), (4, same), (4, "zero " + same), (None, same), (None, None), (5, "a b c"), (6, same + " " + same)])
    assert sum(r.kept is None for r in got) == 2


def test_one_minimiser_in_many_rows(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SORTED", 64)
    judge = substring_dedup.judge_words(3)
    import numpy as np

    strings = [f"a b c {i % 5}".encode() for i in range(200)]
    key = np.arange(200)
    spans = judge(np.zeros(200, np.int64), key, np.zeros(200, np.int64), np.zeros(200, np.int64), np.full(200, 2), strings)
    got = {(k, p) for k, _, a, b in zip(*spans) for p in range(a, b)}
    assert got == {(k, 0) for k in range(1, 200)} | {(k, 1) for k in range(5, 200)}


def test_empty_table_and_clashing_columns(spark):
    assert substring_dedup.dedup(spark.createDataFrame([], DOCS)).count() == 0
    frame = spark.createDataFrame([(1, "x y", 5, "k")], "doc_id long, text string, _key long, kept string")
    assert substring_dedup.dedup(frame).collect()[0]._row.kept == "k"


def hot_rows(n):
    """Documents that share three words, each with its own text around them; some have a neighbour's text too."""
    rng = random.Random(8)
    words = min((f"one two {i}" for i in range(200)), key=lambda t: windows.gram_hashes(substring_dedup.word_hashes(t.encode()), 3)[0])
    around = [(prose(rng, 14), prose(rng, 14)) for _ in range(n)]
    rows = [(i, f"{a} {words} {b}") for i, (a, b) in enumerate(around)]
    return rows + [(n + i, f"x{i} {around[i][0]} {words} {around[i][1]} y{i}") for i in range(0, n, 5)]


def test_hot_minimiser_parts_into_windows(spark, monkeypatch):
    monkeypatch.setattr(windows, "PIECES", 1)
    monkeypatch.setattr(windows, "HOT_BYTES", 20_000)
    monkeypatch.setattr(windows, "BUCKET_BYTES", 4_000)
    rows, cut = hot_rows(500), substring_dedup.cut_words(13, 3)
    docs = spark.createDataFrame(rows, "_key long, _text string")
    hot = windows.hot_minimisers(docs, cut, 60)
    assert len(hot)

    def largest(hot):
        """Different strings of one key, at most."""
        found: dict = {}
        for _, text in rows:
            least, first, n, _ = cut(text.encode(), hot)
            for key, string in zip(least.tolist(), substring_dedup.word_strings(13)(text.encode(), first, n)):
                found.setdefault(key, set()).add(string)
        return max(map(len, found.values()))

    assert largest(None) > 100 and largest(hot) <= 60
    check(spark, rows)


def test_settled_rows_of_like_chunks_go_to_many_buckets():
    same = " ".join(f"w{i}" for i in range(40)).encode()
    cut, strings = substring_dedup.cut_words(13, 3), substring_dedup.word_strings(13)
    asked, sent = set(), set()
    for at in range(0, 200, 2):
        docs = [(at, 0, same), (at + 1, 0, same)]
        asked |= {r["bucket"] for r in windows.ask(docs, cut, 50, True).to_pylist() if r["done"]}
        least, first, n, _ = (x.tolist() for x in cut(same))
        found = [{"least": a, "first": b, "n": c} for a, b, c in zip(least, first, n)]
        sent |= {r["bucket"] for r in windows.send([(*d, found) for d in docs], strings, 50, True).to_pylist() if r["done"]}
    assert len(asked) > 25 and len(sent) > 25
