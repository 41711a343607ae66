"""Best-fit packing of tokenised documents into sequences of bounded length.

A document is its token ids and an end id; only one longer than a sequence is
cut, into full pieces and a last one that may be shorter.

Method: hierarchical residual packing.  Each partition packs its pieces by
best-fit decreasing: a piece goes to the open sequence with the least room
that still holds it.  Sequences that are full but for ``SLACK`` tokens are
done.  The others become items themselves: partitions merge, ``FAN_IN`` into
one, and pack the underfull sequences by best fit again, up to the last round.
A round has so many partitions that none gets more than ``ITEMS`` items, so no
task grows with the corpus.  A sequence holds ``capacity`` pieces at most, as
each has a token, so its list of members is bounded.

Defined results: null and empty texts are documents of one token, the end id;
rows that repeat ids or texts are packed each for itself; of pieces of equal
length, and sequences with equal room, any may come first, so numbers and places
are not fixed; a very long text is encoded whole and cut into pieces; an empty
table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_codec import VOCABULARY, encoder
from .common import cut, documents, stash

CAPACITY = 2048
END = 0
SLACK = 8
FAN_IN = 8
ITEMS = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
BINS = "bin long, fill long, members array<struct<pid:bigint,length:bigint>>"


def cut_pieces(ids: bytes, capacity: int, end: int) -> list[bytes]:
    """A document's ids with the end id, in pieces."""
    whole = ids + int(end).to_bytes(4, "little")
    return [whole[a : a + 4 * capacity] for a in range(0, len(whole), 4 * capacity)]


def pieces(docs: DataFrame, path: str = VOCABULARY, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32`` and, if wanted, ``ids``."""

    def run(batches):
        code = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [
                    (doc, k, k * capacity, len(p) // 4, zlib.crc32(p), p)
                    for doc, ids in zip(part.column(0).to_pylist(), code.encode(part.column(1).to_pylist()))
                    for k, p in enumerate(cut_pieces(ids, capacity, end))
                ]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
                n = 5 + keep_ids
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(n)], names=names[:n])

    texts = docs.select(F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    return texts.mapInArrow(run, PIECES + ", ids binary" * keep_ids)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indices by bin: longest first, each to the fullest bin that has room.

    ``rooms`` has a bit for each amount of room some open bin has, so the
    least sufficient one is found in a few operations on an integer.
    """
    bins: list[list[int]] = []
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = open_[room].pop()
            if not open_[room]:
                rooms ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        room -= n
        if room:
            open_[room].append(b)
            rooms |= 1 << room
    return bins


def _round(bins: DataFrame, capacity: int, parts: int) -> DataFrame:
    """Packs the bins of each partition, as items, into fewer; a bin's number is that of its first member."""

    def run(batches):
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        table = pa.Table.from_batches(tables).sort_by("bin")
        fill, members = table.column("fill").to_pylist(), table.column("members").to_pylist()
        rows = []
        for group in best_fit(fill, capacity):
            inside = [m for i in group for m in members[i]]
            rows.append((inside[0]["pid"], sum(fill[i] for i in group), inside))
        for at in range(0, len(rows), 4096):
            part = rows[at : at + 4096]
            member = pa.list_(pa.struct([("pid", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], kind) for i, kind in enumerate((pa.int64(), pa.int64(), member))], names=["bin", "fill", "members"])

    return bins.repartition(parts, F.xxhash64("bin")).mapInArrow(run, BINS)


def pack(items: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, items_per_task: int = ITEMS) -> DataFrame:
    """``pid, sequence_id, offset`` of items (columns ``pid``, unique, and ``length``, from 1 to ``capacity``)."""
    full = items.where(F.col("length") >= capacity - slack)
    done = [full.select("pid", F.col("pid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest = items.where(F.col("length") < capacity - slack)
    count = rest.count()
    bins = rest.select(F.col("pid").alias("bin"), F.col("length").alias("fill"), F.array(F.struct("pid", "length")).alias("members"))
    parts = -(-count // items_per_task)
    while count:
        bins = cut(_round(bins, capacity, parts))
        under = bins.where(F.col("fill") < capacity - slack)
        left = under.count()
        fewer = max(-(-left // items_per_task), parts // FAN_IN, 1)
        last = parts == 1 or left == 0 or fewer >= parts
        finished = bins if last else bins.where(F.col("fill") >= capacity - slack)
        before = F.expr("transform(members, (m, i) -> struct(m.pid AS pid, aggregate(slice(members, 1, i), 0L, (s, x) -> s + x.length) AS offset))")
        done.append(finished.select(F.col("bin").alias("sequence_id"), F.explode(before).alias("m")).select("m.pid", "sequence_id", "m.offset"))
        if last:
            break
        bins, count, parts = under, left, fewer
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    return placed


def pack_documents(docs: DataFrame, path: str = VOCABULARY, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces with their place: ``sequence_id, offset``. The pieces are written once and read again, so that their numbers stay."""
    found = pieces(docs, path, capacity, end, id_col, text_col, keep_ids).withColumn("pid", F.monotonically_increasing_id())
    found = stash(found, "pieces")
    return found.join(pack(found.select("pid", "length"), capacity), "pid").drop("pid")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, length, ids`` of whole sequences, from ``pack_documents(..., keep_ids=True)``; a sequence's size is bounded by the capacity."""
    inside = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("m"), F.sum("length").alias("length"))

    def run(batches):
        for batch in batches:
            ids = [b"".join(m["ids"] for m in members) for members in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([np.frombuffer(i, "<u4").astype(np.int64) for i in ids], pa.list_(pa.int64()))], names=["sequence_id", "length", "ids"])

    return inside.select("sequence_id", "length", "m").mapInArrow(run, "sequence_id long, length long, ids array<long>")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


QUERIES = {"op3_best_fit_packing": op3_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
