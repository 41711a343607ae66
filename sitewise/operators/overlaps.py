"""Overlaps of hits and structure segments, summed where blocks of both meet, so that no row of a hit and a segment travels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hits of a block of alignments, and segments of a block of groups, about; two blocks meet in one task.
HITS, SEGMENTS = 200_000, 500_000
#: Cells of a matrix that a task holds at once.
CELLS = 1 << 21
MOST_TASKS = 4_000
#: Stands for an end that is null, which bounds nothing.
END = 1 << 60
_MOST = np.iinfo("int64").max


def _numbers(array: pa.Array) -> np.ndarray:
    return array.to_numpy(zero_copy_only=False)


class _Hits:
    """A block's hits in the order of their alignments, with their distinct intervals in the order of ``ac`` and the rank of each score (-1 for null)."""

    def __init__(self, hits: pa.StructArray, acs: np.ndarray):
        code = _numbers(hits.field("alignment_id").dictionary_encode().indices.fill_null(-1))
        order = np.argsort(code, kind="stable")
        self.firsts = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
        self.alignments = hits.field("alignment_id").take(pa.array(order[self.firsts]))
        ends = [acs, *(_numbers(hits.field(c)) for c in ("start", "stop"))]
        (self.ac, self.start, self.stop), which = np.unique(np.stack(ends)[:, order], axis=1, return_inverse=True)
        self.which = which.ravel()
        score = hits.field("score").take(pa.array(order))
        by_score = _numbers(pc.array_sort_indices(score, null_placement="at_end")).astype("int64")
        known = by_score[: len(score) - score.null_count]
        self.scores, self.rank = score.take(pa.array(known)), np.full(len(score), -1)
        self.rank[known] = np.arange(len(known))


def _per_interval(hits: _Hits, ac: np.ndarray, owner: np.ndarray, s0: np.ndarray, s1: np.ndarray, n: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each interval and group: summed overlap, least start and greatest end of the segments it overlaps."""
    total, low, high = (np.full((len(hits.ac), groups), v) for v in (0, _MOST, -_MOST))
    for a in np.unique(ac):
        first, last = np.searchsorted(hits.ac, [a, a + 1])
        mine = np.flatnonzero(ac == a)
        cut = np.flatnonzero(np.r_[True, np.diff(owner[mine]) != 0])
        begin, end, times, at = s0[mine], s1[mine], n[mine], owner[mine[cut]]
        least, most = np.where(begin == -END, _MOST, begin), np.where(end == END, -_MOST, end)
        step = max(1, CELLS // len(mine))
        for lo in range(first, last, step):
            rows = slice(lo, min(last, lo + step))
            overlap = np.minimum(hits.stop[rows, None], end) - np.maximum(hits.start[rows, None], begin)
            # an end that neither has makes no overlap
            some = (overlap > 0) & (overlap < END // 2)
            total[rows, at] = np.add.reduceat(np.where(some, overlap * times, 0), cut, axis=1)
            low[rows, at] = np.minimum.reduceat(np.where(some, least, _MOST), cut, axis=1)
            high[rows, at] = np.maximum.reduceat(np.where(some, most, -_MOST), cut, axis=1)
    return total, low, high


def _met(rows: pa.StructArray, groups: pa.StructArray, least: int) -> Iterator[pa.RecordBatch]:
    """Results of two blocks, as many groups at once as ``CELLS`` has room for."""
    segments = groups.field("segments")
    offsets, flat = _numbers(segments.offsets) - segments.offsets[0].as_py(), segments.flatten()
    acs = _numbers(pa.concat_arrays([rows.field("ac"), flat.field("ac")]).dictionary_encode().indices)
    hits, seg_ac = _Hits(rows, acs[: len(rows)]), acs[len(rows) :]
    s0, s1, n = (_numbers(flat.field(c)) for c in ("start", "stop", "n"))
    width = max(1, CELLS // len(rows))
    for g in range(0, len(groups), width):
        here = slice(offsets[g], offsets[min(len(groups), g + width)])
        owner = np.repeat(np.arange(len(groups)), np.diff(offsets))[here] - g
        total, low, high = (v[hits.which] for v in _per_interval(hits, seg_ac[here], owner, s0[here], s1[here], n[here], min(width, len(groups) - g)))
        best = np.maximum.reduceat(np.where(total > 0, hits.rank[:, None], -2), hits.firsts)
        total, low, high = np.add.reduceat(total, hits.firsts), np.minimum.reduceat(low, hits.firsts), np.maximum.reduceat(high, hits.firsts)
        p, q = np.nonzero((total >= least) & (best > -2))
        if len(p):
            best, low, high = best[p, q], low[p, q], high[p, q]
            names = [groups.field(c).take(pa.array(q + g)) for c in ("structure", "chain")]
            score = hits.scores.take(pa.array(best, mask=best < 0))
            ends = pa.array(low, mask=low == _MOST), pa.array(high, mask=high == -_MOST)
            yield pa.RecordBatch.from_arrays([hits.alignments.take(pa.array(p)), *names, pa.array(total[p, q]), *ends, score], names=["alignment_id", "structure", "chain", "overlap", "first", "last", "score"])


def overlap_hits(hits: DataFrame, segments: DataFrame, least: int = 20) -> DataFrame:
    """Joins hits to structure segments on ``ac``, sums overlaps by (alignment, structure, chain), keeps ``least`` or more.

    hits: ``alignment_id, ac, start, stop, score``; segments: ``ac, structure, chain, seg_start, seg_stop``.
    As in SQL a null end bounds nothing.  An alignment's hits meet in one
    task, and so do the distinct segments of a structure's chain; a block of
    alignments travels once for each block of groups and the other way round.
    Rows may be as many as alignments times groups; they are made where blocks
    meet and don't travel.
    """
    kind = hits.select("ac").union(segments.select("ac")).schema["ac"].dataType
    end = lambda c, none: F.coalesce(F.col(c).cast("long"), F.lit(none))
    rows = hits.where("ac IS NOT NULL").select("alignment_id", F.col("ac").cast(kind).alias("ac"), end("start", -END).alias("start"), end("stop", END).alias("stop"), "score")
    asked = segments.select(F.col("ac").cast(kind).alias("ac"), "structure", "chain", end("seg_start", -END).alias("start"), end("seg_stop", END).alias("stop"))
    alike = asked.join(rows.select("ac").distinct(), "ac", "left_semi").groupBy("structure", "chain", "ac", "start", "stop").agg(F.count("*").alias("n"))
    blocks, parts = (max(1, -(-df.count() // most)) for df, most in ((rows, HITS), (alike, SEGMENTS)))
    tasks = min(MOST_TASKS, max(hits.sparkSession.sparkContext.defaultParallelism, blocks * parts))
    # enough blocks for all tasks, unless there are few alignments
    blocks = max(blocks, tasks // parts)
    upto = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    # rows go to their block first, so that no task gathers parts of all blocks
    dealt = rows.withColumn("h", F.pmod(F.xxhash64("alignment_id"), F.lit(blocks)).cast("int")).repartition(blocks, "h")
    left = dealt.groupBy("h").agg(F.collect_list(F.struct("alignment_id", "ac", "start", "stop", "score")).alias("hits"))
    groups = alike.groupBy("structure", "chain").agg(F.sort_array(F.collect_list(F.struct("ac", "start", "stop", "n"))).alias("segments"))
    right = groups.groupBy(F.pmod(F.xxhash64("structure", "chain"), F.lit(parts)).cast("int").alias("p")).agg(F.collect_list(F.struct("structure", "chain", "segments")).alias("groups"))
    left, right = left.select("h", upto(parts).alias("p"), "hits"), right.select(upto(blocks).alias("h"), "p", "groups")
    met = left.repartition(tasks, "h", "p").join(right.repartition(tasks, "h", "p").hint("merge"), ["h", "p"]).select("hits", "groups")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, groups in zip(batch.column(0), batch.column(1)):
                yield from _met(rows.values, groups.values, least)

    kinds = {"alignment_id": hits.schema["alignment_id"], "structure": segments.schema["structure"], "chain": segments.schema["chain"], "score": hits.schema["score"]}
    fields = ["alignment_id", "structure", "chain", "overlap", "first", "last", "score"]
    found = met.mapInArrow(run, ", ".join(f"{c} {kinds[c].dataType.simpleString() if c in kinds else 'long'}" for c in fields))
    return found.withColumns({c: F.col(c).cast(segments.schema[s].dataType) for c, s in (("first", "seg_start"), ("last", "seg_stop"))})
