import hashlib
import random

import numpy as np
import pytest

from sitewise.llm import suffix_dedup, windows
from sitewise.llm.bwt import common_prefixes, dense, repeat_groups, sorted_suffixes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, size):
    """Result by (doc_id, text) from a dictionary of every window."""
    docs = sorted({(k if k is not None else 1 << 63, (t or "").encode()) for k, t in rows})
    seen, out = set(), {}
    for key, text in docs:
        covered = np.zeros(len(text), bool)
        for p in range(len(text) - size + 1):
            w = text[p : p + size]
            if w in seen:
                covered[p : p + size] = True
            seen.add(w)
        runs = int((np.diff(np.r_[0, covered.astype(int)]) == 1).sum())
        out[key, text] = (len(text), int(covered.sum()), runs, bytes(np.frombuffer(text, np.uint8)[~covered]))
    return out


def check(spark, rows, size=100):
    frame = spark.createDataFrame([(k, t, None, "s", 1) for k, t in rows], DOCS)
    got = suffix_dedup.dedup(frame.repartition(3), size).collect()
    want = brute(rows, size)
    assert len(got) == len(rows)
    texts = {}
    for r in got:
        texts.setdefault(r._row.doc_id if r._row.doc_id is not None else 1 << 63, []).append((r.n_bytes, sum(s.stop - s.start for s in r.removed), len(r.removed), bytes(r.kept)))
    for key, found in texts.items():
        assert sorted(found) == sorted(want[k if k is not None else 1 << 63, (t or "").encode()] for k, t in rows if (k if k is not None else 1 << 63) == key)


def prose(rng, n, words=60):
    return " ".join(rng.choice(["alpha", "beta", "çé", "delta", "ωμέγα", "x", "the", "of"]) + str(rng.randrange(words)) for _ in range(n))


def test_against_brute_force(spark):
    rng = random.Random(3)
    shared = [prose(rng, 60) for _ in range(4)]
    rows = []
    for i in range(80):
        parts = [prose(rng, rng.randrange(1, 60))]
        for _ in range(rng.randrange(4)):
            s = rng.choice(shared)
            a = rng.randrange(len(s) // 2)
            parts += [s[a : a + rng.randrange(len(s))], prose(rng, rng.randrange(30))]
        rows.append((i * 7 % 83, " ".join(parts)))
    rows += [(200 + i, rows[5][1]) for i in range(30)] + [(300, "ab" * 900), (301, "z" * 3000), (302, "z" * 140)]
    check(spark, rows)


def test_edge_cases(spark):
    same = "The quick brown fox jumps over the lazy dog. " * 2 + "Something more is written here, so that it is long."
    check(spark, [(1, None), (2, ""), (3, same), (3, same), (4, same), (4, "x" + same), (None, same), (None, None), (5, "short"), (6, "short")])


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert suffix_dedup.dedup(empty).count() == 0


def test_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "a" * 150, 9, 8, "k", "s")], "doc_id long, text string, _key long, start long, kept string, _spans string")
    out = suffix_dedup.with_kept_text(suffix_dedup.dedup(frame), frame.columns)
    assert out.columns == frame.columns
    assert out.collect()[0][2:] == (9, 8, "k", "s")


def test_kept_text(spark):
    long = "".join(chr(0x3B1 + i % 20) + str(i) for i in range(80))
    frame = spark.createDataFrame([(1, long, "en"), (2, "é" + long + "ü", "en"), (3, None, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.text for r in suffix_dedup.with_kept_text(suffix_dedup.dedup(frame), frame.columns).collect()}
    assert got == {1: long, 2: "éü", 3: None}


@pytest.mark.parametrize("depth", [1, 3, 8, 20, 100])
def test_common_prefixes(depth):
    rng = np.random.default_rng(depth)
    text = rng.choice(np.frombuffer(b"abc\xff", np.uint8), 700)
    text[300:420] = text[100:220]
    symbols, n = dense(text)
    order = sorted_suffixes(symbols, depth)
    whole = symbols.tobytes()
    assert [whole[i : i + depth] for i in order] == sorted(whole[i : i + depth] for i in range(len(whole)))
    shared = common_prefixes(symbols, n, order, depth)
    for k in range(1, len(order)):
        a, b = whole[order[k - 1] :], whole[order[k] :]
        lcp = next((i for i in range(min(len(a), len(b), depth)) if a[i] != b[i]), min(len(a), len(b), depth))
        assert shared[k] == lcp
    place, group = repeat_groups(text, depth)
    assert len(place) == len(text) + 1 and group[0] == 1


def test_query_digest(spark, tmp_path):
    rows = [(1, "q" * 50 + "w" * 200), (2, "nothing special"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in suffix_dedup.op2_suffix_dedup(spark, str(tmp_path)).collect()}
    want = brute(rows, 100)
    for key, text in rows:
        n, removed, runs, kept = want[key, (text or "").encode()]
        assert (got[key].n_bytes, got[key].n_removed, got[key].n_spans, got[key].kept_sha256) == (n, removed, runs, hashlib.sha256(kept).hexdigest())


def test_hot_minimiser_parts_into_windows(spark, monkeypatch):
    monkeypatch.setattr(windows, "PIECES", 1)
    monkeypatch.setattr(windows, "HOT_BYTES", 20_000)
    monkeypatch.setattr(windows, "BUCKET_BYTES", 4_000)
    rng = random.Random(9)
    hashed = lambda t: windows.gram_hashes(np.frombuffer(t.encode(), np.uint8).astype(np.uint64) + np.uint64(1), 32).min()
    line = min((f"licensed under the terms of licence {i};" for i in range(200)), key=hashed)
    around = [(prose(rng, 20), prose(rng, 20)) for _ in range(300)]
    rows = [(i, f"{a} {line} {b}") for i, (a, b) in enumerate(around)]
    rows += [(300 + i, f"x {around[i][0]} {line} {around[i][1]} y") for i in range(0, 300, 5)]
    rows += [(400, " ".join([rows[7][1]] * 3))]
    cut = suffix_dedup.cut_bytes(100, 32)
    docs = spark.createDataFrame(rows, "_key long, _text string")
    hot = windows.hot_minimisers(docs, cut, 60)
    assert len(hot)

    def largest(hot):
        """Different strings of one key, at most."""
        found: dict = {}
        for _, text in rows:
            least, first, n, _ = cut(text.encode(), hot)
            for key, string in zip(least.tolist(), suffix_dedup.byte_strings(100)(text.encode(), first, n)):
                found.setdefault(key, set()).add(string)
        return max(map(len, found.values()))

    assert largest(None) > 100 and largest(hot) <= 60
    check(spark, rows)
