"""BPE encoding and decoding of documents, with forced boundaries.

For a tokenizer file whose words are lower-cased, stripped of white space and
closed by an end-of-word suffix.  Ids are those the tokenizers library gives
for the whole text without adding special tokens; special tokens' own strings
in a text are single ids, as in the library.

Method: a pair of bytes that stands next to each other inside no vocabulary
token can never be merged across, so a word is cut there for certain.  The
fragments are encoded independently and their ids concatenated.  Fragments of
up to ``SHORT`` bytes are merged together as numpy rows, all of one length at
a time, each step merging every row's lowest-ranked pair; longer ones go to
the library's BPE model.  A bounded cache of two generations keeps the ids of
recent words: when the younger is full it becomes the older, and words met again
move on, so that words met once don't push out those met often.

Texts with characters outside ``PLAIN`` (where Python's lower-casing and the
library's normaliser might differ) are normalised and split by the library.

Defined results: null and blank texts have no ids and decode to ""; rows
that repeat ids or texts are encoded each for itself; of pairs of equal rank the
leftmost merges first; a very long text is encoded whole, word by word; other
columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

import json
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType
from tokenizers import Tokenizer, models

from .common import documents, others, with_fields

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SHORT = 24
#: Words of a generation of the cache.
CACHED_WORDS = 150_000
#: Anything else is left to the library's normaliser.
NOT_PLAIN = regex.compile(r"[^\t-\r -~¡-įı-ɏ]")
_NONE = np.int32(1 << 30)


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class _Pairs:
    """Rank of a pair of ids among the merges, for arrays of pairs; ``_NONE`` if there is no such merge."""

    def __init__(self, left: np.ndarray, right: np.ndarray, size: int = 1 << 20):
        self.key = np.r_[(left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64), np.uint64((1 << 64) - 1)]
        self.shift = np.uint64(64 - size.bit_length() + 1)
        slot = self._slot(self.key[:-1], 0)
        self.first = np.full(size, len(left), np.int32)
        self.first[slot[::-1]] = np.arange(len(left), dtype=np.int32)[::-1]
        rest = np.flatnonzero(self.first[slot] != np.arange(len(left)))
        for self.salt in range(1, 1000):
            slot = self._slot(self.key[rest], self.salt)
            if len(np.unique(slot)) == len(rest):
                break
        self.second = np.full(size, len(left), np.int32)
        self.second[slot] = rest

    def _slot(self, key: np.ndarray, salt: int) -> np.ndarray:
        return (key * np.uint64((0x9E3779B97F4A7C15 + 0x1234567_89ABCDE * salt) & 0xFFFFFFFFFFFFFFFF | 1)) >> self.shift

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = self.first[self._slot(key, 0)]
        at = np.where(self.key[at] == key, at, self.second[self._slot(key, self.salt)])
        return np.where(self.key[at] == key, at, _NONE)


class Encoder:
    """Ids of texts under one tokenizer file, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        if model["type"] != "BPE" or not suffix or model["continuing_subword_prefix"] or spec["decoder"] or spec["post_processor"]:
            raise ValueError(f"{path} isn't a BPE vocabulary with word ends and neither decoder nor post-processor")
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.path = path
        self.special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.words = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.characters = byte_characters()
        self.byte_of = {c: b for b, c in enumerate(self.characters)}
        self.inner = np.array([vocab[c] for c in self.characters], np.int32)
        self.last = np.array([vocab[c + suffix] for c in self.characters], np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.pairs = _Pairs(*(np.array([vocab[m[i]] for m in merges], np.int64) for i in (0, 1)))
        self.tokens = [None] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        together = np.zeros((256, 256), bool)
        for token, i in vocab.items():
            self.tokens[i] = token
            if token not in self.special:
                b = [self.byte_of[c] for c in token.removesuffix(suffix)]
                together[b[:-1], b[1:]] = True
        for token in spec["added_tokens"]:
            self.tokens[token["id"]] = token["content"]
        self.forced = ~together
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @cached_property
    def tokenizer(self) -> Tokenizer:
        """The library's objects are made when a text first needs them: they are tens of MB."""
        return Tokenizer.from_file(self.path)

    @cached_property
    def library_inner(self) -> models.BPE:
        """The model for fragments that don't end their word."""
        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        return models.BPE(vocab=model["vocab"], merges=[tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])

    def _short(self, symbols: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows of equal length, merged as far as they go: (row numbers, ids)."""
        rows, done = np.arange(len(symbols)), []
        rank = self.pairs.rank(symbols[:, :-1], symbols[:, 1:])
        while symbols.shape[1] > 1:
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(rank)), at]
            go = best < _NONE
            if not go.all():
                done.append((rows[~go], symbols[~go]))
                rows, symbols, rank, at, best = rows[go], symbols[go], rank[go], at[go], best[go]
            if not len(rows):
                return done
            k = np.arange(len(rows))
            symbols[k, at] = self.merged[best]
            width = symbols.shape[1] - 1
            column = np.arange(width)
            symbols = np.take_along_axis(symbols, column + (column > at[:, None]), axis=1)
            rank = np.take_along_axis(rank, column[:-1] + (column[:-1] >= at[:, None]), axis=1)
            for shift in (-1, 0):  # the pairs on both sides of the new symbol
                on = np.flatnonzero((at + shift >= 0) & (at + shift < width - 1))
                left = at[on] + shift
                rank[on, left] = self.pairs.rank(symbols[on, left], symbols[on, left + 1])
        return [*done, (rows, symbols)]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of non-empty words, one after another, and each word's number of ids."""
        return self._encode_bytes(np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words]))

    def _encode_bytes(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        closes = np.zeros(len(raw), bool)
        closes[ends - 1] = True
        cut = closes.copy()
        cut[:-1] |= self.forced[raw[:-1], raw[1:]]
        stop = np.flatnonzero(cut) + 1
        start = np.r_[0, stop[:-1]]
        first = np.where(closes, self.last[raw], self.inner[raw])
        size = stop - start
        parts, count = [], np.zeros(len(size), np.int64)
        for length in np.unique(size).tolist():
            which = np.flatnonzero(size == length)
            if length <= SHORT:
                found = [(which[r], ids) for r, ids in self._short(first[start[which][:, None] + np.arange(length)])]
            else:
                found = []
                for i in which.tolist():
                    text = "".join([self.characters[b] for b in raw[start[i] : stop[i]].tolist()])
                    model = self.tokenizer.model if closes[stop[i] - 1] else self.library_inner
                    found.append((np.array([i]), np.array([[t.id for t in model.tokenize(text)]], np.int32)))
            for row, ids in found:
                count[row] = ids.shape[1]
            parts += found
        offset = np.cumsum(count) - count
        out = np.empty(int(count.sum()), "<u4")
        for row, ids in parts:
            out[offset[row][:, None] + np.arange(ids.shape[1])] = ids
        fragments = np.searchsorted(stop, ends, side="right")
        return out, np.diff(np.r_[0, np.r_[0, np.cumsum(count)][fragments]])

    def _learn(self, words: set[str]) -> None:
        """Caches the ids of new stretches without white space."""
        words = [w for w in words if w]
        # a stretch of letters is one word
        split = [[w] if w.isalpha() else self.words.findall(w) for w in words]
        raw = np.frombuffer("".join([p + "\n" for parts in split for p in parts]).encode(), np.uint8)
        line = np.flatnonzero(raw == 10)  # no word has a line end
        ids, count = self._encode_bytes(raw[raw != 10], line - np.arange(len(line)))
        buffer = ids.tobytes()
        ends = (4 * np.r_[0, np.cumsum(count)][np.cumsum(list(map(len, split)))]).tolist()
        self.cache.update(zip(words, map(buffer.__getitem__, map(slice, [0, *ends[:-1]], ends))))

    def _know(self, words: set[str]) -> None:
        """Sees to it that the cache has all of these words."""
        new = words.difference(self.cache)
        if self.cache and len(self.cache) + len(new) > CACHED_WORDS:
            self.cache, self.older, new = {}, self.cache, words
        again = new.intersection(self.older)
        self.cache.update(zip(again, map(self.older.__getitem__, again)))
        new = new - again
        if new:
            self._learn(new)

    def _library_split(self, text: str) -> bytes:
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))
        words = [bytes([self.byte_of[c] for c in word]) for word, _ in split]
        return self.encode_words(words)[0].tobytes() if words else b""

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        stretches: list[list] = []
        for text in texts:
            parts = self.specials.split(text) if "<|" in text else [text]
            stretches.append([(p in self.special, NOT_PLAIN.search(p) is None, p.lower().split() if p not in self.special else p, p) for p in parts if p])
        out = []
        self._know({w for parts in stretches for special, plain, words, _ in parts if plain and not special for w in words})
        get = self.cache.__getitem__
        for parts in stretches:
            out.append(b"".join([self.special[raw] if special else b"".join(map(get, words)) if plain else self._library_split(raw) for special, plain, words, raw in parts]))
        return out

    def decode(self, ids: bytes) -> str:
        """As the library does without a decoder: tokens joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, path: str = VOCABULARY, text_col: str = "text") -> DataFrame:
    """``_row`` (the columns but the text) and ``ids`` (little-endian unsigned 32-bit integers)."""
    frame = docs.select(others(docs, text_col), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))

    def run(batches):
        code = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(code.encode(part.column(1).to_pylist()), pa.binary())], names=["_row", "ids"])

    return frame.mapInArrow(run, with_fields(frame.select("_row"), ids=BinaryType()))


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``_row``, ``ids`` and their text, ``decoded``."""

    def run(batches):
        code = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                decoded = [code.decode(i) for i in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(decoded, pa.string())], names=["_row", "ids", "decoded"])

    return encoded.mapInArrow(run, with_fields(encoded, decoded=StringType()))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = decode(encode(documents(spark, sf_dir).select("doc_id", "text")))
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    return both.select("_row.doc_id", n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


QUERIES = {"op10_bpe_codec": op10_bpe_codec}
ORACLE_SQL: dict[str, str] = {}
