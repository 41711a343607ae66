import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from sitewise.llm import packing
from sitewise.llm.bpe_codec import VOCABULARY

LIBRARY = Tokenizer.from_file(VOCABULARY)


def check(rows, docs):
    """Pieces are those of the library's ids; sequences have no gap or overlap."""
    want = []
    for doc, text in docs:
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            want.append((doc, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())))
    key = lambda r: (r[0] is None, r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    bins: dict = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins), len(packing.best_fit([r.length for r in rows], 2048))


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_documents(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "of", "the", "gamma7", "it's"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 30, 200, 900, 5000])))) for i in range(150)]
    docs += [(1, None), (1, ""), (None, "x"), (None, None), (7, docs[7][1])]
    used, bound = check(packing.pack_documents(documents(spark, docs)).collect(), docs)
    assert used <= bound + 2


def test_empty_table(spark):
    assert packing.pack_documents(documents(spark, [])).count() == 0


def test_many_rounds(spark):
    rng = random.Random(5)
    lengths = [rng.choice([3, 90, 700, 1100, 2048, 1500]) for _ in range(3000)]
    items = spark.createDataFrame(list(enumerate(lengths)), "pid long, length long")
    placed = packing.pack(items, items_per_task=100).collect()
    assert sorted(p.pid for p in placed) == list(range(3000))
    bins: dict = {}
    for p in placed:
        bins.setdefault(p.sequence_id, []).append((p.offset, lengths[p.pid]))
    for members in bins.values():
        members.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(members, members[1:])) and members[0][0] == 0
        assert sum(n for _, n in members) <= 2048
    assert len(bins) <= 1.05 * len(packing.best_fit(lengths, 2048))


def test_best_fit_against_plain_search():
    rng = random.Random(6)
    lengths = [rng.randrange(1, 2049) for _ in range(500)]
    bins: list = []
    for i in sorted(range(500), key=lambda i: -lengths[i]):
        rooms = [(2048 - sum(lengths[j] for j in b), k) for k, b in enumerate(bins)]
        fit = [r for r in rooms if r[0] >= lengths[i]]
        bins[min(fit)[1]].append(i) if fit else bins.append([i])
    assert len(packing.best_fit(lengths, 2048)) == len(bins)


def test_sequences(spark):
    docs = [(1, "hello world"), (2, "more " * 3000)]
    whole = packing.sequences(packing.pack_documents(documents(spark, docs), keep_ids=True)).collect()
    ids = [i for r in whole for i in r.ids]
    assert all(len(r.ids) == r.length <= 2048 for r in whole)
    assert sorted(ids) == sorted(i for _, t in docs for i in [*LIBRARY.encode(t, add_special_tokens=False).ids, 0])
