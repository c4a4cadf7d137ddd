"""Shared folders, tables and small helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separates nothing but ASCII characters that are no letter and no digit; upper case becomes lower case.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


#: Most bytes of an Arrow batch between the JVM and Python: texts vary too much in length to count rows.
BATCH_BYTES = 4 << 20
_BATCH_BYTES_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


#: Rows that Parquet's reader holds at a time, a column's values side by side.
READ_ROWS = 1024
_READ_ROWS_CONF = "spark.sql.parquet.columnarReaderBatchSize"


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of this session at BATCH_BYTES or so, and Parquet's at READ_ROWS; smaller settings stay."""
    if int(spark.conf.get(_READ_ROWS_CONF, "4096")) > READ_ROWS:
        spark.conf.set(_READ_ROWS_CONF, str(READ_ROWS))
    held = spark.conf.get(_BATCH_BYTES_CONF, "64m").lower().removesuffix("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(held[-1:], 1)
    if int(held.rstrip("kmg")) * unit > BATCH_BYTES:
        spark.conf.set(_BATCH_BYTES_CONF, str(BATCH_BYTES))


def release() -> None:
    """Give memory that Python, Arrow and the C library hold but don't use back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run, forget=None):
    """A map over Arrow batches that leaves a small worker behind: after the last batch forget() empties the
    worker's caches, and what is free goes back to the system. Workers outlive tasks and stages."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            if forget:
                forget()
            release()

    return inner


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or else the context's checkpoint folder. Without
    either there is none that would be right on a cluster; only where driver and executors are one process (a
    local master, as in tests) one is made."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = held.get() if held.isDefined() else None
    if not path and spark.sparkContext.master.partition("[")[0] == "local":
        path = "file://" + tempfile.mkdtemp(prefix="quillstream-")
        spark.sparkContext.setCheckpointDir(path)
    if not path:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, **options) -> tuple[DataFrame, str]:
    """Write df to a table in the shared folder and read it back: lineage ends there, and a lost
    executor costs a file read. Returns the table and its path, for drop()."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keep_rows(docs: DataFrame, verdict) -> DataFrame:
    """The rows of docs, with all their columns, for whose texts verdict(list of texts) says True. Texts go
    to Python, verdicts come back; the rows stay in the JVM."""
    bound_batches(docs.sparkSession)

    @F.arrow_udf("boolean")
    def keep(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array(verdict(b.to_pylist()), pa.bool_())
        release()

    return docs.where(keep(F.col("text").cast("string")))


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n; null ids count as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def fold_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def labelled_sample(labels: DataFrame, label: str, held_mod: int, held_rest: int, limit: int) -> list[tuple[int, int]]:
    """At most `limit` (doc_id, label) rows that may be learnt from, chosen by a hash of the id.

    Rows with a null id or label are no labels; of repeated ids the largest label counts."""
    one = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (crc_mod("doc_id", held_mod) != held_rest))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    rows = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()
    return [(r.doc_id, int(r.y > 0)) for r in rows]


def learning_rows(docs: DataFrame, sample: list[tuple[int, int]]) -> DataFrame:
    """The documents of a labelled sample. The sample is bounded by its limit, so broadcasting it is safe."""
    spark = docs.sparkSession
    ids = spark.createDataFrame(sample, "doc_id long, y int")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
