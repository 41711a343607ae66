import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from sitewise.llm import bpe_codec
from sitewise.llm.bpe_codec import VOCABULARY, encoder

LIBRARY = Tokenizer.from_file(VOCABULARY)


def same(texts):
    code = encoder(VOCABULARY)
    for text, ids in zip(texts, code.encode(texts)):
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(ids, "<u4").tolist()
        assert got == want, repr(text[:80])
        assert code.decode(ids) == LIBRARY.decode(want, skip_special_tokens=False)


def test_every_plain_character():
    plain = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    same([f"a{c}b1{c}2 {c}'s X{c}" for c in plain])
    assert sum(bpe_codec.NOT_PLAIN.search(c) is None for c in plain) > 400


def test_random_texts():
    rng = random.Random(0)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDE0123'.,;<|>  \n\t\xa0éèüßñÀŁžıİΣσςЖ中🙂é_-#$%&*"
    same(["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(600)])


@pytest.mark.parametrize("text", ["", " \n ", "<|endoftext|>", "a<|startoftext|>B <|endoftext|><|EndOfText|>", "x" * 5000, "ab" * 3000 + "é" * 900, "zqxj" * 400, "don't we'll I'VE 'S's", "hello hello hello", "²³¼ªº", "ΑΣ ΑΣΑ ΟΔΟΣ"])
def test_special_cases(text):
    same([text])


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe_codec, "CACHED_WORDS", 50)
    code = bpe_codec.Encoder(VOCABULARY)
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(500)}x" for _ in range(60)) for _ in range(20)]
    for t in texts:
        assert np.frombuffer(code.encode([t])[0], "<u4").tolist() == LIBRARY.encode(t, add_special_tokens=False).ids
    assert len(code.cache) <= 60


def test_forced_boundaries_are_used():
    code = encoder(VOCABULARY)
    assert code.forced.any() and not code.forced[ord("t"), ord("h")]


def test_frames(spark):
    rows = [(1, "Some text", None), (1, "Some text", "k"), (None, None, "k"), (3, "", "k")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe_codec.decode(bpe_codec.encode(frame)).collect()
    assert sorted(len(r.ids) for r in got) == [0, 0, 8, 8]
    assert {r._row.ids for r in got} == {None, "k"}
    assert bpe_codec.encode(frame.limit(0)).count() == 0


def test_frequent_words_stay_cached(monkeypatch):
    """Words met once, however many, don't push out one that comes again and again."""
    monkeypatch.setattr(bpe_codec, "CACHED_WORDS", 100)
    code = bpe_codec.Encoder(VOCABULARY)
    learned = []
    learn = code._learn
    monkeypatch.setattr(code, "_learn", lambda words: (learned.extend(words), learn(words)))
    for i in range(20):
        texts = ["often " + " ".join(f"w{chr(97 + i)}{chr(97 + k)}" for k in range(26))]
        (ids,) = code.encode(texts)
        assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode(texts[0], add_special_tokens=False).ids
    assert learned.count("often") == 1 and len(learned) == 20 * 26 + 1
    assert len(code.cache) <= 100 and len(code.older) <= 100
