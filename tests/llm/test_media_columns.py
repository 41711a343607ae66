import hashlib
import os
import re
import zlib

import numpy as np
import pytest

from sitewise.llm import media_columns as m

DATA = "/root/testdata/sf0.001"
A, B = "a" * 64, "b" * 64


def test_segments():
    html = f"""<html><head><title>Title</title><script>no()</script></head><body><p>One &amp; two<b> bold</b></p>
    <figure><img src="sha256:{A}" alt="x"><img src="x/sha256:{B}"><figcaption>A <i>caption</i></figcaption></figure>tail
    <img src="sha256:{B}" alt="alone"><img src="http://elsewhere/x.png">end"""
    got = [(s["position"], s["kind"], s["text"] or s["digest"], s["caption"]) for s in m.segments(html)]
    assert got == [
        (0, "text", "Title", None),
        (1, "text", "One & two bold", None),
        (2, "media", A, "A caption"),
        (3, "media", B, "A caption"),
        (4, "text", "tail", None),
        (5, "media", B, "alone"),
        (6, "media", None, None),
        (7, "text", "end", None),
    ]
    assert m.segments(html)[6]["source"] == "http://elsewhere/x.png"
    assert m.segments(None) == [] and m.segments("") == []


def test_captions():
    before = m.segments(f"<figure><figcaption>first</figcaption><img src='sha256:{A}' alt='x'><img src='sha256:{B}'></figure>after")
    assert [(s["kind"], s["digest"], s["caption"], s["text"]) for s in before] == [("media", A, "first", None), ("media", B, "first", None), ("text", None, None, "after")]
    inner = m.segments(f"<figure><img src='sha256:{A}'><figure><img src='sha256:{B}'><figcaption>in</figcaption></figure><figcaption>out</figcaption></figure>")
    assert [s["caption"] for s in inner] == ["out", "in"]
    # a caption without media is text, an open figure ends with the page
    assert [s["text"] for s in m.segments("<p>open <figure><figcaption>cut")] == ["open", "cut"]
    assert [s["text"] for s in m.segments("<figure><figcaption>a<script>x</script> b</figcaption></figure>c")] == ["a b", "c"]


def test_round_trip():
    for data in (b"", b"x", bytes(range(256)), b"\n" * 64, b"\0" * 65):
        image = m.from_pgm(m.to_pgm(data))
        assert image.shape[1] == 64 and image.tobytes() == data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")


def test_unresolved_and_order(spark):
    pages = spark.createDataFrame([(1, f"t<img src='sha256:{hashlib.sha256(b'pay').hexdigest()}' alt='c'>u<img src='sha256:{A}'>", "k"), (2, None, None)], "page_id long, html string, digest string")
    known = m.features(m.store(spark.createDataFrame([("pay",), ("pay",), (None,)], "payload string")))
    got = sorted(m.resolve(m.interleave(pages), known).collect(), key=lambda r: r.position)
    assert [(r._row.page_id, r._row.digest, r.position, r.caption, r.n_bytes) for r in got] == [(1, "k", 1, "c", 3), (1, "k", 3, None, None)]


def test_hot_digest(spark, monkeypatch):
    """References to a frequent payload are dealt out and all resolved."""
    monkeypatch.setattr(m, "HOT", 8)
    monkeypatch.setattr(m, "SALTS", 4)
    name = lambda t: hashlib.sha256(t.encode()).hexdigest()
    texts = ["hot"] * 60 + [f"cold {i}" for i in range(40)]
    pages = spark.createDataFrame([(i, f"<img src='sha256:{name(t)}'>") for i, t in enumerate(texts)], "page_id long, html string").repartition(3)
    known = m.features(m.store(spark.createDataFrame([(t,) for t in texts], "payload string")))
    sequences = m.interleave(pages)
    references = sequences.selectExpr("inline(sequence)")
    assert m.hot_digests(references) == [name("hot")]
    got = m.resolve(sequences, known).collect()
    assert sorted((r._row.page_id, r.digest, r.n_bytes) for r in got) == [(i, name(t), len(t)) for i, t in enumerate(texts)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables needed")
def test_pages(spark):
    """Raw pages: every medium of the page stands in its sequence, in order, and no tag is left in a text."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    rows = m.interleave(pages).collect()
    html = {r.page_id: r.html for r in pages.collect()}
    assert len(rows) == len(html)
    for r in rows:
        sources = re.findall(r"<(?:img|audio|video|source|embed)\b[^>]*?\ssrc=[\"']?([^\"'\s>]+)", html[r._row.page_id] or "")
        assert [s.source for s in r.sequence if s.kind == "media"] == sources
        assert [s.position for s in r.sequence] == list(range(len(r.sequence)))
        assert all(s.text and "<p>" not in s.text for s in r.sequence if s.kind == "text")


def test_query(spark, tmp_path):
    texts = [(1, "héllo"), (2, None), (3, ""), (4, "héllo"), (5, "long " * 5000), (6, "x\0"), (7, "x"), (1, "twice"), (None, "no id")]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = m.op9_media_columns(spark, str(tmp_path)).collect()
    want = []
    for key, text in texts:
        raw = (text or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        media = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        image = np.frombuffer(payload, np.uint8).reshape(-1, 64)
        want.append((key, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), m.image_features(image)))
    order = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "page_id long, html string")
    assert m.interleave(empty).count() == 0
    assert m.features(m.store(spark.createDataFrame([], "payload string"))).count() == 0
