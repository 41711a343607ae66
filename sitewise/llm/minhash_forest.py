"""MinHash near-dedup with an LSH forest, links confirmed on whole shingle sets.

A-Z is lower-cased; words are runs of ``[^\\x20\\x09-\\x0D]``.  A document's set has
its distinct shingles of three words; with fewer words, the whole sequence as
one.  Documents are linked if their sets' Jaccard similarity is ``SIMILARITY``
percent or more; a document without words is linked with nothing.

Method:

1. One scan makes each document's signature of ``HASHES`` minima and a digest of
   its set.  Documents of equal sets are one node from here on.
2. An order sorts the nodes by the signature, rotated.  In a few orders, dealt
   to tasks by range, each node is paired with its neighbour in the order: the
   one with the longest common prefix.  Pairs are verified and their components
   labelled.  That ties up crowds of near copies with a few pairs for a node.
3. A region is what shares a prefix in one of ``ORDERS`` orders.  Only regions
   with several labels can hold more links; tasks find them with partial
   minima, maxima and counts.  In those each node is first compared with the
   ``NEAREST`` of its regions' nodes of least and greatest label, and labels are taken
   anew: crowds that are no neighbours in the sorted orders become one
   component without making their pairs.
   After that all pairs of different labels are
   candidates; so a link is missed only if its nodes share no prefix in any
   order.  The depth of the prefix adapts to the region: four values, and where
   more than ``GROUP`` nodes share them six.  At the last depth regions are
   taken at any size.
   Pairs are joined under a bound on sizes and on parity bitmaps of the sets:
   these differ in no more bits than the sets do in shingles, so it drops none
   that is similar.
   Tables that grow with the corpus are joined by sorting at any size.
4. Candidates are verified on the full sets, and components are taken of all links.

At a similarity of exactly 0.85 a pair shares no region with a probability of
4e-7 at depth four and 8e-5 at six, at 0.9 of 1e-9 and 3e-7.

Defined results: null and blank texts have no shingles and are components of
their own; a component's id is its least non-null id (null if it has none);
rows that repeat ids or texts are rows like any other; texts of any length are
taken whole; other columns don't matter, whatever their names; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, cut, discard, documents, identity, stash
from .components import connected_components
from .windows import mix, pieces

SIMILARITY = 85
SHINGLE = 3
HASHES = 128
#: Orders begin six values apart or more, so prefixes of different orders share none.
ORDERS = 20
DEPTHS = (4, 6)
#: Nodes of a region that are compared without asking for a longer prefix.
GROUP = 256
#: Orders of which the neighbours are compared first.
FIRST_ORDERS = 8
#: Values by which these are sorted.
SORTED_BY = 8
#: Comparisons of a node with ends of its regions.
NEAREST = 3
#: Numbers of 64 bits in a parity bitmap.
BITMAP = 8
_CACHED_WORDS = 200_000
_RANDOM = np.random.default_rng(11)
_XOR = _RANDOM.integers(0, 1 << 64, HASHES, np.uint64)
_ODD = _RANDOM.integers(0, 1 << 64, HASHES, np.uint64) | np.uint64(1)
_PLACE = _RANDOM.integers(0, 1 << 64, max(DEPTHS), np.uint64) | np.uint64(1)
_SHINGLED = _RANDOM.integers(0, 1 << 64, SHINGLE, np.uint64) | np.uint64(1)
SETS = "_key long, _ver long, n long, digest binary, signature binary, bits array<long>"


class Shingler:
    """Shingle sets as sorted 64-bit hashes; keeps hashes of words met before, up to a bound."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        known = self.known
        if len(known) > _CACHED_WORDS:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return h
        n = max(1, len(h) - SHINGLE + 1)
        mixed = np.full(n, min(len(h), SHINGLE), np.uint64)
        for k in range(min(len(h), SHINGLE)):
            mixed = mixed + h[k : k + n] * _SHINGLED[k]
        return np.unique(mix(mixed))


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 512):
        least = np.minimum(least, ((shingles[at : at + 512, None] ^ _XOR) * _ODD).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Which of 64 x ``BITMAP`` hash buckets have an odd number of the set's shingles."""
    odd = np.bincount((shingles & np.uint64(64 * BITMAP - 1)).astype(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sets(docs: DataFrame) -> DataFrame:
    """``_key, _ver, n, digest, signature, bits`` of the shingle set of each row with the columns of ``identity``; the last three are null if it is empty."""

    def scan(batches):
        shingled = Shingler()
        for batch in batches:
            for keys, vers, texts in pieces(batch):
                found = [shingled(t) for t in texts]
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in found]
                signatures = [signature(s).tobytes() if len(s) else None for s in found]
                columns = (keys, vers, [len(s) for s in found], digests, signatures, [bitmap(s) if len(s) else None for s in found])
                kinds = (*[pa.int64()] * 3, pa.binary(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=[c.split()[0] for c in SETS.split(", ")])

    return docs.select("_key", "_ver", "_text").mapInArrow(scan, SETS)


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _rotated(signatures: np.ndarray, start: int, n: int) -> np.ndarray:
    return signatures[:, np.arange(start, start + n) % HASHES]


def neighbours(nodes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of nodes that follow each other in a sorted order and share a prefix."""

    def orders(batches):
        for batch in batches:
            found = _signatures(batch.column(2))
            for t in range(FIRST_ORDERS):
                prefix = np.ascontiguousarray(_rotated(found, t * HASHES // FIRST_ORDERS, SORTED_BY).astype(">u4")).tobytes()
                width = 4 * SORTED_BY
                at = [bytes([t]) + prefix[i : i + width] for i in range(0, len(prefix), width)]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.binary()), batch.column(0), batch.column(1), batch.column(3)], names=["at", "id", "n", "bits"])

    shared = 1 + 4 * DEPTHS[0]

    def follow(batches):
        last = []
        for batch in batches:
            rows = last + list(zip(*(c.to_pylist() for c in batch.columns[:3]), np.array(batch.column(3).to_pylist(), np.int64).reshape(-1, BITMAP)))
            last = rows[-1:]
            found = [(x[1], y[1]) for x, y in zip(rows, rows[1:]) if x[0][:shared] == y[0][:shared] and _sizes_fit(x[2], y[2]) and _few_bits(int(np.bitwise_count(x[3] ^ y[3]).sum()), x[2] + y[2])]
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    placed = nodes.select("id", "n", "signature", "bits").mapInArrow(orders, "at binary, id long, n long, bits array<long>")
    pairs = placed.repartitionByRange("at").sortWithinPartitions("at", "id").mapInArrow(follow, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sizes_fit(n, m):
    """Of numbers or columns."""
    return (100 * n >= SIMILARITY * m) & (100 * m >= SIMILARITY * n)


def _few_bits(differ, both):
    """Of numbers or columns: what similar sets' bitmaps and sizes fulfil."""
    return (100 + SIMILARITY) * differ <= (100 - SIMILARITY) * both


def regions(nodes: DataFrame, depth: int) -> DataFrame:
    """``key, t, id, n, label``: the region of ``depth`` values of each node in each order, or in those of its array ``orders``."""

    def run(batches):
        for batch in batches:
            ids, n, label = (batch.column(i).to_numpy() for i in range(3))
            found = _signatures(batch.column(3)).astype(np.uint64)
            key = np.empty((len(ids), ORDERS), np.uint64)
            for t in range(ORDERS):
                key[:, t] = mix((_rotated(found, t * HASHES // ORDERS, depth) * _PLACE[:depth]).sum(axis=1, dtype=np.uint64) + np.uint64(t))
            row, t = (x.ravel() for x in np.indices(key.shape))
            key = key.ravel()
            if batch.num_columns > 4:
                asked = np.zeros((len(ids), ORDERS), bool)
                for i, orders in enumerate(batch.column(4).to_pylist()):
                    asked[i, orders] = True
                row, t, key = (x[asked.ravel()] for x in (row, t, key))
            for at in range(0, len(key), 50_000):
                r = row[at : at + 50_000]
                columns = (key[at : at + 50_000].view(np.int64), t[at : at + 50_000].astype(np.int32), ids[r], n[r], label[r])
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["key", "t", "id", "n", "label"])

    more = ["orders"] if "orders" in nodes.columns else []
    return nodes.select("id", "n", "label", "signature", *more).mapInArrow(run, "key long, t int, id long, n long, label long")


def _differ(a: str, b: str) -> Column:
    return reduce(Column.__add__, (F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(BITMAP)))


def across_labels(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of nodes in one region with different labels that may be similar, each once: in the least region that both are in."""
    every = rows.groupBy("id").agg(F.collect_list("key").alias("keys"))  # ORDERS at most
    rows = rows.join(nodes.select("id", "bits"), "id").join(every, "id")
    a, b = (rows.select("key", *(F.col(c).alias(f"{c}_{side}") for c in ("id", "n", "label", "bits", "keys"))) for side in "ab")
    fit = _sizes_fit(F.col("n_a"), F.col("n_b")) & _few_bits(_differ("bits_a", "bits_b"), F.col("n_a") + F.col("n_b"))
    fit &= a["key"] == F.array_min(F.array_intersect("keys_a", "keys_b"))
    found = a.join(b, "key").where((F.col("label_a") != F.col("label_b")) & (F.col("id_a") < F.col("id_b")) & fit)
    return found.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def shared(rows: DataFrame) -> DataFrame:
    """Of ``regions``: those with several labels."""
    mixed = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("key")
    mixed = stash(mixed, "mixed")
    found = stash(rows.join(mixed.hint("merge"), "key", "left_semi"), "regions")
    discard(mixed)
    return found


def ends(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` that may be similar of each node with nodes of least or greatest label in its regions, ``NEAREST`` of another label at most."""
    rows = rows.join(nodes.select("id", "bits"), "id")
    end = F.struct("label", "id", "n", "bits")
    outer = rows.groupBy("key").agg(F.min(end).alias("low"), F.max(end).alias("high"))
    both = rows.join(outer, "key").select("id", "n", "label", "bits", F.explode(F.array("low", "high")).alias("e"))
    differ = _differ("bits", "e.bits")
    near = both.where((F.col("label") != F.col("e.label")) & _sizes_fit(F.col("n"), F.col("e.n")) & _few_bits(differ, F.col("n") + F.col("e.n")))
    near = near.groupBy("id").agg(F.collect_set(F.struct((differ / (F.col("n") + F.col("e.n"))).alias("apart"), F.col("e.id").alias("end"))).alias("near"))  # two a region at most
    near = near.select("id", F.explode(F.slice(F.sort_array("near"), 1, NEAREST)).alias("e"))
    return near.select(F.least("id", "e.end").alias("a"), F.greatest("id", "e.end").alias("b")).distinct()


def candidates(nodes: DataFrame, group: int = GROUP, rows: DataFrame | None = None) -> DataFrame:
    """Pairs ``a, b`` of nodes of different labels that share a region; ``rows``: the ``regions`` of the least depth, if known."""
    found, rows = [], regions(nodes, DEPTHS[0]) if rows is None else rows
    for depth in DEPTHS:
        rows = shared(rows)
        if depth == DEPTHS[-1]:
            found.append(across_labels(rows, nodes))
            break
        crowded = cut(rows.groupBy("key").count().where(F.col("count") > group).select("key"))
        found.append(across_labels(rows.join(crowded, "key", "left_anti"), nodes))
        if crowded.isEmpty():
            break
        asked = rows.join(crowded, "key", "left_semi").groupBy("id").agg(F.collect_list("t").alias("orders"))
        rows = regions(nodes.join(asked, "id"), DEPTHS[DEPTHS.index(depth) + 1])
    return reduce(DataFrame.union, found).distinct()


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs ``a, b`` that are similar by their full sets; ``docs`` with the columns of ``identity``."""

    def shingle(batches):
        shingled = Shingler()
        for batch in batches:
            for ids, texts in pieces(batch):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([shingled(t).tobytes() for t in texts], pa.binary())], names=["id", "shingles"])

    def compare(batches):
        for batch in batches:
            found = []
            for a, b, *both in pieces(batch):
                for i, j, *x in zip(a, b, *both):
                    s, t = (np.frombuffer(v, np.uint64) for v in x)
                    common = len(s) + len(t) - len(np.union1d(s, t))
                    if 100 * common >= SIMILARITY * (len(s) + len(t) - common):
                        found.append((i, j))
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(nodes.select("id", "_key", "_ver"), "id")
    texts = docs.select("_key", "_ver", "_text").join(wanted.hint("merge"), ["_key", "_ver"]).select("id", "_text").mapInArrow(shingle, "id long, shingles binary")
    texts = stash(texts.dropDuplicates(["id"]), "shingles")
    side = {c: texts.select(F.col("id").alias(c), F.col("shingles").alias(name)) for c, name in zip("ab", "st")}
    both = pairs.join(side["a"], "a").join(side["b"], "b")
    links = stash(both.select("a", "b", "s", "t").mapInArrow(compare, "a long, b long"), "links")
    discard(texts)
    return links


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """``_key, _ver, n, least`` of each row: size of its shingle set, least ``_key`` of its component."""
    mine = docs.select(*identity(docs, id_col, text_col))
    every = stash(sets(mine), "sets")
    found = stash(every.select("_key", "_ver", "n", "digest"), "sizes")
    nodes = every.where("n > 0").groupBy("digest").agg(F.min(F.struct("_key", "_ver", "n", "signature", "bits")).alias("at"))
    nodes = stash(nodes.select(F.monotonically_increasing_id().alias("id"), "digest", "at.*"), "nodes")
    discard(every)
    near = stash(neighbours(nodes), "neighbours")
    links = verified(near, nodes, mine)
    labels = connected_components(links).withColumnRenamed("node", "id")
    labelled = stash(nodes.join(labels, "id", "left").withColumn("label", F.coalesce("root", "id")).drop("root"), "labelled")
    discard(nodes)
    rows = shared(regions(labelled, DEPTHS[0]))
    some = stash(ends(rows, labelled).join(near, ["a", "b"], "left_anti"), "ends")
    if not some.isEmpty():
        links = links.union(verified(some, labelled, mine))
        labels = cut(connected_components(links).select(F.col("node").alias("id"), F.col("root").alias("label")))
        again, earlier = (stash(df.withColumnRenamed("label", "own").join(labels, "id", "left").withColumn("label", F.coalesce("label", "own")).select(df.columns), name) for df, name in ((labelled, "labelled"), (rows, "regions")))
        discard(labelled, rows)
        labelled, rows = again, earlier
    near = near.union(some)
    more = stash(candidates(labelled, group, rows).join(near, ["a", "b"], "left_anti"), "candidates")
    discard(rows)
    nodes = stash(labelled.select("id", "digest", "_key", "_ver", F.col("label").alias("root")), "components")
    discard(labelled)
    if not more.isEmpty():
        links = links.union(verified(more, nodes, mine))
        labels = connected_components(links).withColumnRenamed("node", "id")
        nodes = nodes.drop("root").join(labels, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = nodes.groupBy("root").agg(F.min("_key").alias("least"))
    by_digest = nodes.join(least, "root").select("digest", "least")
    blank = found.where("n = 0").select("_key", "_ver", "n", F.col("_key").alias("least"))
    return found.where("n > 0").join(by_digest, "digest").select("_key", "_ver", "n", "least").union(blank)


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: of least id, then least text hash where ids repeat."""
    mine = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *identity(docs, id_col, text_col)[:2])
    found = groups(docs, id_col, text_col)
    blank = F.when(F.col("n") == 0, F.xxhash64("_key", "_ver"))
    first = found.groupBy("least", blank.alias("blank")).agg(F.min(F.struct("_key", "_ver")).alias("at")).select("at.*")
    return mine.join(first, ["_key", "_ver"], "left_semi").dropDuplicates(["_key", "_ver"]).select("_row.*")


def op11_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    def known(c: str) -> Column:
        return F.when(F.col(c) != NO_ID, F.col(c))

    docs = groups(documents(spark, sf_dir).select("doc_id", "text"))
    return docs.select(known("_key").alias("doc_id"), F.col("n").alias("n_shingles"), known("least").alias("component_id"), F.col("_key").eqNullSafe(F.col("least")).alias("kept"))


QUERIES = {"op11_minhash_forest": op11_minhash_forest}
ORACLE_SQL: dict[str, str] = {}
