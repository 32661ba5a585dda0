"""What the corpus operators share: the shared folder, written tables, size-checked joins, word splitting."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.sources.tables import spread, table

#: Words are maximal runs of characters other than ASCII space and \t \n \v \f \r.
SPACES = r"[\x20\x09-\x0D]+"

#: A side of a join is broadcast only when it has been counted and measured, and holds no more rows and characters than this.
BROADCAST_ROWS, BROADCAST_CHARS = 50_000, 10_000_000

#: Copies of the small side, when it is too large to broadcast, so that one hot key is dealt to as many tasks.
SALTS = 64

#: Spark's setting that lets shuffle files go when the query that made them has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows of an Arrow batch, so that a task holds little text at once.
ARROW, ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_000

_own: dict[str, str] = {}
_paths: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (where it is unset) one of our own.

    The own folder is a temporary one in local mode only; elsewhere it lies in the warehouse, which a cluster shares.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            _own[app] = tempfile.mkdtemp(prefix="inkfold-")
            atexit.register(shutil.rmtree, _own[app], True)
        else:
            _own[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_inkfold"
    return _own[app]


def written(df: DataFrame, name: str, by: str | None = None, batch: int = ARROW_ROWS) -> DataFrame:
    """df as a table in the shared folder: lineage ends here, so a lost executor costs no recomputation.

    With `by`, values of that column are kept apart, and a filter on it reads no others. Python stages get at most `batch`
    rows at once. Shuffle files of what has been written are let go. The table goes when `dropped` or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, v) for k, v in {CLEANUP: "false", ARROW: "10000"}.items()}
    try:
        spark.conf.set(CLEANUP, "true")
        spark.conf.set(ARROW, str(batch))
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    at, fs = _file_system(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path).select(df.columns)
    _paths[id(out)] = path
    weakref.finalize(out, _paths.pop, id(out), None)
    return out


def _file_system(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def dropped(table: DataFrame, part: str = "") -> None:
    """Delete a table that `written` has returned (not a frame derived from it), or one part of it, that nothing needs any more."""
    at, fs = _file_system(table.sparkSession, f"{_paths[id(table)]}/{part}".rstrip("/"))
    fs.delete(at, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def join_small(left: DataFrame, small: DataFrame, key: str, salt_by: Column, how: str = "left") -> DataFrame:
    """left joined with small (one row a key, already written) on a null-safe key; `key` of small is dropped.

    Up to BROADCAST_ROWS rows and BROADCAST_CHARS characters, counted first, small is broadcast. Beyond, left rows are salted
    by salt_by and small is repeated SALTS times, so no key's rows land in one task.
    """
    right = small.withColumnRenamed(key, "_k")
    rows, chars = small.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))).first()
    if rows <= BROADCAST_ROWS and chars <= BROADCAST_CHARS:
        return left.join(F.broadcast(right), left[key].eqNullSafe(F.col("_k")), how).drop("_k")
    right = right.withColumn("_salt_r", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = left.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int"))
    return left.join(right, left[key].eqNullSafe(F.col("_k")) & (F.col("_salt") == F.col("_salt_r")), how).drop("_k", "_salt", "_salt_r")
