"""Shared helpers: reading documents, row identity, the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: Sorts documents without an id after all others.
NO_ID = (1 << 63) - 1
BATCH_ROWS = 1000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: What Python workers free goes back to the system, not to their own pools.
_ALLOCATION = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "1048576"}


def lean_workers(spark: SparkSession) -> None:
    """Python workers that wait for later tasks keep no freed memory, for the executors' memory; holds for workers started from now on."""
    for name, value in _ALLOCATION.items():
        spark.sparkContext.environment.setdefault(name, value)


def small_batches(spark: SparkSession) -> None:
    """Whole texts are long: at most ``BATCH_ROWS`` rows travel to Python at once, for the executors' memory."""
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    if not 0 < int(rows) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local session gets a temporary one and a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="sitewise-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a stored table, wherever the shared folder lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by an eager checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stash(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again, for tables of which later steps read a few columns.

    The job's shuffle files go once the table is written; a lost executor takes nothing along that later steps need.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        # the plan is made under that setting
        df.select("*").write.parquet(path, compression=compression)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(*stored: DataFrame) -> None:
    """Deletes tables that ``stash`` returned, once no later step or result reads them."""
    for df in stored:
        remove(df.sparkSession, df.stored_at)


def _key(id_col: str) -> Column:
    return F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("_key")


def repeats_ids(docs: DataFrame, id_col: str = "doc_id") -> bool:
    return docs.select(_key(id_col)).groupBy("_key").count().where("count > 1").limit(1).count() > 0


def identity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeated: bool | None = None) -> list[Column]:
    """Columns ``_key, _ver, _text`` of each row.

    ``_key`` is the id (NO_ID for null).  ``_ver`` is 0 where ids are unique; if
    any id repeats it is the text's hash, so rows that share an id but not a
    text are told apart and rows that share both count as one document.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    if repeated is None:
        repeated = repeats_ids(docs, id_col)
    ver = F.xxhash64(text) if repeated else F.lit(0).cast("long")
    return [_key(id_col), ver.alias("_ver"), text.alias("_text")]


def others(docs: DataFrame, text_col: str) -> Column:
    """All columns but the text as one struct ``_row``, so that their names can't clash with an operator's."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("_row")


def with_fields(df: DataFrame, **fields: DataType) -> StructType:
    """The schema of ``df`` and more fields."""
    return StructType([*df.schema.fields, *(StructField(name, kind) for name, kind in fields.items())])
