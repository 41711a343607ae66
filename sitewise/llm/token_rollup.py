"""Token counts as delta-maintained rollups by source, language and tokenizer version.

``counted`` counts each document's tokens once, under every tokenizer version,
and leaves the text behind; what follows moves narrow rows.  A batch of
changes has counted rows with ``sign`` 1 (insert) or -1 (delete); a revised
document is a delete of what it was and an insert of what it is.  ``commit``
sums a batch by group in the tasks and in one small shuffle and writes its
deltas, which are as small as the number of groups.  Totals are the newest
snapshot plus the deltas of batches committed since; ``fold`` makes the next
snapshot of them, so a reader's work follows the number of groups and of
unfolded batches, not the history.

Commits and folds are idempotent: both write to a folder of their own attempt
and count from the moment a ledger row names it.  A batch id that the ledger
has is not counted again; a snapshot lists the batches it holds, and only
others are added to it.  If two writers raced, the first attempt in order of
name counts and the other does not.  A writer that dies leaves files no ledger
row names.  ``vacuum`` removes the files of folded deltas and older snapshots;
it is for times without a fold under way.  Everything lies in the folder
given, which all executors share.

Defined results: null text counts no tokens, null sources and languages are
groups of their own, a null sign counts nothing; rows that come twice in a
batch count twice, as documents that stand twice in a table do; texts of any
length are counted whole, some at a time; groups whose counts have all gone
back to zero are left out of the totals; an empty batch is committed and
changes nothing; an empty table counts to nothing; other columns don't matter,
whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_codec import VOCABULARY, encoder
from .common import documents, remove, shared_dir, stash
from .windows import pieces

GROUP = ["source", "lang", "tokenizer_version"]
SUMS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
COUNTED = "doc_id long, source string, lang string, n_tokens map<string, long>"
LEDGER = "batch_id string, attempt string"
SNAPSHOTS = "number long, attempt string"


def words(texts: list[bytes]) -> list[int]:
    return [len(t.split()) for t in texts]


def bpe(path: str = VOCABULARY) -> Callable[[list[bytes]], list[int]]:
    return lambda texts: [len(ids) // 4 for ids in encoder(path).encode([t.decode() for t in texts])]


#: Tokenizer versions that the query counts by.
VERSIONS: dict[str, Callable[[list[bytes]], list[int]]] = {"words-1": words, "word_bpe_49k-1": bpe()}


def counted(docs: DataFrame, versions: dict[str, Callable] | None = None) -> DataFrame:
    """``doc_id, source, lang`` and ``n_tokens``, the number of tokens by version, of documents."""
    chosen = versions or VERSIONS
    names = list(chosen)

    def run(batches):
        for batch in batches:
            for *row, texts in pieces(batch):
                counts = zip(*(chosen[name](texts) for name in names))
                maps = pa.array([list(zip(names, c)) for c in counts], pa.map_(pa.string(), pa.int64()))
                kinds = (pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([*(pa.array([v.decode() if isinstance(v, bytes) else v for v in column], kind) for column, kind in zip(row, kinds)), maps], names=["doc_id", "source", "lang", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.coalesce("text", F.lit("")))
    return rows.mapInArrow(run, COUNTED)


def signed(rows: DataFrame, sign: int) -> DataFrame:
    return rows.select(F.lit(sign).alias("sign"), "source", "lang", "n_tokens")


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums by group of changes ``sign, source, lang, n_tokens``."""
    rows = changes.select(F.coalesce(F.col("sign").cast("long"), F.lit(0).cast("long")).alias("sign"), "source", "lang", F.explode("n_tokens").alias("tokenizer_version", "n"))
    return rows.groupBy(GROUP).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n")).alias("n_tokens"))


class Rollup:
    """The totals kept in one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._append([], LEDGER, "ledger", "ignore")
        self._append([], SNAPSHOTS, "snapshots", "ignore")

    def _append(self, rows: list[tuple], schema: str, name: str, mode: str = "append") -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode(mode).parquet(f"{self.root}/{name}")

    def _read(self, schema: str, *names: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{n}" for n in names)) if names else self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        return self._read(LEDGER, "ledger").groupBy("batch_id").agg(F.min("attempt").alias("attempt"))

    def snapshot(self) -> str | None:
        """The attempt that made the newest snapshot."""
        newest = self._read(SNAPSHOTS, "snapshots").groupBy("number").agg(F.min("attempt").alias("attempt")).orderBy(F.desc("number")).first()
        return newest and newest.attempt

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds a batch; False if it was there already."""
        if not self.ledger().where(F.col("batch_id") == batch_id).isEmpty():
            return False
        attempt = uuid.uuid4().hex
        deltas(changes).coalesce(1).write.parquet(f"{self.root}/deltas-{attempt}")
        self._append([(batch_id, attempt)], LEDGER, "ledger")
        return True

    def _state(self) -> tuple[DataFrame, DataFrame]:
        """The sums by group, and the batches that they hold."""
        at = self.snapshot()
        done = self._read(LEDGER, *([f"folded-{at}"] if at else []))
        fresh = [(r.batch_id, r.attempt) for r in self.ledger().join(done, "batch_id", "left_anti").collect()]  # those since the last fold
        rows = self._read(SUMS, *([f"totals-{at}"] if at else []), *(f"deltas-{attempt}" for _, attempt in fresh))
        sums = rows.groupBy(GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs != 0 OR n_tokens != 0")
        return sums, done.unionByName(self.spark.createDataFrame(fresh, LEDGER))

    def totals(self) -> DataFrame:
        return self._state()[0]

    def fold(self) -> None:
        """Makes a snapshot of the totals and the list of the batches in them."""
        last = self._read(SNAPSHOTS, "snapshots").agg(F.max("number")).first()[0] or 0
        attempt = uuid.uuid4().hex
        sums, batches = self._state()
        sums.coalesce(1).write.parquet(f"{self.root}/totals-{attempt}")
        batches.coalesce(1).write.parquet(f"{self.root}/folded-{attempt}")
        self._publish(last + 1, attempt)

    def _publish(self, number: int, attempt: str) -> None:
        self._append([(number, attempt)], SNAPSHOTS, "snapshots")

    def vacuum(self) -> None:
        """Removes what only readers of older snapshots need."""
        at = self.snapshot()
        if not at:
            return
        gone = [f"deltas-{r.attempt}" for r in self._read(LEDGER, f"folded-{at}").collect()]
        gone += [f"{kind}-{r.attempt}" for r in self._read(SNAPSHOTS, "snapshots").collect() if r.attempt != at for kind in ("totals", "folded")]
        for name in gone:
            remove(self.spark, f"{self.root}/{name}")


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads all documents, deletes the toxic ones, folds, moves those of quality 0 to source ``quarantine``, and has the deletions delivered twice."""
    return _history(spark, sf_dir, VERSIONS)


def token_rollup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by white-space words only, which SQL can count."""
    return _history(spark, sf_dir, {"words-1": words})


def _history(spark: SparkSession, sf_dir: str, versions: dict[str, Callable]) -> DataFrame:
    docs = stash(counted(documents(spark, sf_dir).select("doc_id", "source", "lang", "text"), versions), "counted")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    labelled = docs.join(labels, "doc_id")
    toxic = signed(labelled.where("toxic = 1"), -1)
    poor = labelled.where("quality = 0 AND coalesce(toxic, 0) != 1")
    rollup = Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.commit("load", signed(docs, 1))
    rollup.commit("delete-toxic", toxic)
    rollup.fold()
    rollup.commit("quarantine", signed(poor, -1).unionByName(signed(poor.withColumn("source", F.lit("quarantine")), 1)))
    rollup.commit("delete-toxic", toxic)
    return rollup.totals()


QUERIES = {"op6_token_rollup": op6_token_rollup, "token_rollup_words": token_rollup_words}
ORACLE_SQL = {
    "token_rollup_words": r"""
WITH l AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
d AS (
  SELECT CASE WHEN l.quality = 0 THEN 'quarantine' ELSE source END AS source, lang,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	
]+'), lambda x: x <> '')) AS n
  FROM documents LEFT JOIN l USING (doc_id) WHERE coalesce(l.toxic, 0) <> 1)
SELECT source, lang, 'words-1' AS tokenizer_version, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM d GROUP BY source, lang
"""
}
