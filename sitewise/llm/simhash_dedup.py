"""SimHash near-dedup by Golay-code fuzzy hashing.

A document's fingerprint has 64 bits: A-Z lower-cased, words (runs of bytes
other than ASCII white space) in shingles of three, repeats included; a bit is
1 if more than half of the shingles' XXH64 values (seed 42) have it.
Fingerprints that differ in two bits or fewer are linked.

Method: a fingerprint is cut into segments of 22, 21 and 21 bits.  Of two
linked ones some segment is equal, by pigeonhole, and the next segment differs
in two bits at most.  A segment of up to 23 bits is decoded to all codewords
of the perfect (23, 12) Golay code within distance four: one of them if it
lies within two bits of a codeword, six if it lies three bits off.  Segments
that differ in two bits or fewer always share one, so a key is an exact
segment with a codeword index of the next: 3 to 18 keys for a fingerprint.
Fingerprints are joined on keys and verified.

Keys of more than ``GROUP`` distinct fingerprints are not compared pair by
pair: fingerprints differ in two bits or fewer if and only if they share a
centre, a value within one bit of both, and a centre has 65 at most; so their
fingerprints are joined on centres.  Nothing is dropped.

Defined results: null and blank texts have fingerprint zero and are linked
like any other; a component's id is its least non-null id (null if it has
none); rows that repeat ids or texts are rows like any other;
bits that half the shingles have are 0; of a very long text all shingles count,
32,768 at a time; other columns
don't matter; an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, cut, documents, identity
from .components import connected_components

SHINGLE = 3
DISTANCE = 2
SEED = 42
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of a key that are compared pair by pair.
GROUP = 256
_GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def _syndrome(v: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit polynomials by the generator."""
    v = v.copy()
    for bit in range(22, 10, -1):
        v ^= ((v >> bit) & 1) * (_GENERATOR << (bit - 11))
    return v


def _decoder() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome, the error patterns of up to four bits that lead to a codeword, and their number."""
    patterns = np.array([sum(1 << b for b in bits) for n in range(5) for bits in combinations(range(23), n)], np.int64)
    syndrome = _syndrome(patterns)
    table, count = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    for s, p in zip(syndrome.tolist(), patterns.tolist()):
        table[s, count[s]] = p
        count[s] += 1
    return table, count


_PATTERNS, _COUNT = _decoder()


def codewords(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each segment: its row number, repeated, and the 12-bit index of each codeword near it."""
    s = _syndrome(segment)
    near = np.arange(6) < _COUNT[s][:, None]
    row = np.nonzero(near)[0]
    return row, ((segment[:, None] ^ _PATTERNS[s])[near]) >> 11


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words])[: max(1, len(words) - shingle + 1)].tolist()
    ends = (ends - 1)[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 15):
        h = np.array([digest(data[a:b], SEED) for a, b in zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)])], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = (2 * total > len(starts)).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_key, _ver, fp`` of each row."""

    def scan(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            fp = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=["_key", "_ver", "fp"])

    return docs.select(*identity(docs, id_col, text_col)).mapInArrow(scan, "_key long, _ver long, fp long")


def _keys(batches):
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        keys, owners = [], []
        for z in range(3):
            (a, width), (b, next_width) = SEGMENTS[z], SEGMENTS[(z + 1) % 3]
            exact = (fp >> np.uint64(a)).astype(np.int64) & ((1 << width) - 1)
            row, word = codewords((fp >> np.uint64(b)).astype(np.int64) & ((1 << next_width) - 1))
            keys.append((z << 36) | (exact[row] << 12) | word)
            owners.append(row)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(fp.view(np.int64)[np.concatenate(owners)])], names=["key", "fp"])


def _forest(values: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is linked within one group: each fingerprint with the first of its part."""
    u = values.view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= DISTANCE
    label = np.arange(len(u))
    while True:
        least = np.where(near, label[None, :], len(u)).min(axis=1)
        if (least == label).all():
            return [(int(values[i]), int(values[r])) for i, r in enumerate(label.tolist()) if i != r]
        label = least


def _links(group: int):
    """Rows come sorted by key; a key's rows may cross batches. Of a key with more than ``group`` fingerprints each comes out by itself, without ``b``, and no more than a batch and that many wait."""

    def met(batches):
        rest_key = rest = none = np.empty(0, np.int64)
        crowd = None  # a crowded key of which more rows may come
        for batch in batches:
            key = np.concatenate([rest_key, batch.column(0).to_numpy()])
            fp = np.concatenate([rest, batch.column(1).to_numpy()])
            more = 0 if crowd is None else int(np.searchsorted(key, crowd, "right"))
            yield _edges([], fp[:more])
            key, fp = key[more:], fp[more:]
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            yield _linked(key[:last], fp[:last], group)
            rest_key, rest = key[last:], fp[last:]
            if len(rest) > group:
                yield _edges([], rest)
                crowd, rest_key, rest = key[-1], none, none
        yield _linked(rest_key, rest, group)

    return met


def _edges(found: list[tuple[int, int]], alone: np.ndarray) -> pa.RecordBatch:
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array([*a, *alone.tolist()], pa.int64()), pa.array([*b, *[None] * len(alone)], pa.int64())], names=["a", "b"])


def _linked(key: np.ndarray, fp: np.ndarray, group: int) -> pa.RecordBatch:
    edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else np.zeros(1, int)
    size = np.diff(edges)
    several = (size > 1) & (size <= group)
    found = [link for lo, hi in zip(edges[:-1][several].tolist(), edges[1:][several].tolist()) for link in _forest(fp[lo:hi])]
    return _edges(found, fp[np.repeat(size > group, size)])


def links(distinct: DataFrame, group: int = GROUP) -> DataFrame:
    """Edges ``a, b`` that connect all fingerprints (column ``fp``, distinct) at distance two or less.

    Keys go from their shuffle straight to the comparison: Spark may drop a
    repartition by key that follows a join on it, and read that join's side by
    mapper once the other turns out small, so a key's rows would part.
    """
    keys = distinct.select("fp").mapInArrow(_keys, "key long, fp long")
    met = cut(keys.repartition("key").sortWithinPartitions("key").mapInArrow(_links(group), "a long, b long"))
    near = met.where("b IS NOT NULL")
    crowded = met.where("b IS NULL").select(F.col("a").alias("fp")).distinct()
    if crowded.isEmpty():
        return near
    flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64) * (i == 63)).cast("long")) for i in range(64)))
    centres = crowded.select("fp", F.explode(flips).alias("centre"))
    heads = centres.groupBy("centre").agg(F.min("fp").alias("head"), F.max("fp").alias("top")).where("head != top").select("centre", "head")
    return near.union(centres.join(heads, "centre").where("fp != head").select("fp", "head"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_key, _ver, fp, root, least`` of each row: fingerprint, least fingerprint of its component, least ``_key`` of it."""
    found = cut(fingerprints(docs, id_col, text_col))
    distinct = cut(found.groupBy("fp").agg(F.min("_key").alias("least")))
    roots = connected_components(links(distinct)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    by_root = rooted.groupBy("root").agg(F.min("least").alias("least"))
    by_fp = rooted.select("fp", "root").join(by_root, "root")
    return found.join(by_fp, "fp").select("_key", "_ver", "fp", "root", "least")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: of least id, then least text hash where ids repeat."""
    first = groups(docs, id_col, text_col).groupBy("root").agg(F.min(F.struct("_key", "_ver")).alias("at")).select("at.*")
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *identity(docs, id_col, text_col)[:2])
    return named.join(first, ["_key", "_ver"], "left_semi").dropDuplicates(["_key", "_ver"]).select("_row.*")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def known(c):
        return F.when(F.col(c) != NO_ID, F.col(c))

    docs = groups(documents(spark, sf_dir).select("doc_id", "text"))
    return docs.select(known("_key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), known("least").alias("component_id"))


QUERIES = {"op8_simhash_dedup": op8_simhash_dedup}
ORACLE_SQL: dict[str, str] = {}
