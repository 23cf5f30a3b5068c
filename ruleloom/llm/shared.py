"""Tables that several jobs read, kept in the cluster's shared folder."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark then drops an execution's shuffle files when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BYTES_PER_FILE = 4_000_000
_WRITTEN: list[tuple[SparkSession, str]] = []


#: Spark's name for how many rows a batch for Python holds.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS_AT_ONCE = 1000


def small_batches(spark: SparkSession) -> None:
    """Rows with whole documents go to Python ROWS_AT_ONCE at a time, unless the session sets another number than Spark's 10,000, which makes batches of tens of MB."""
    if int(spark.conf.get(BATCH_ROWS)) == 10_000:
        spark.conf.set(BATCH_ROWS, ROWS_AT_ONCE)


Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidied(run: Mapper) -> Mapper:
    """run, giving the memory that it is done with back to the system: Python workers are used again by later stages, and would keep it."""

    @wraps(run)
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return each


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def few(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """Those most rows whose ids have the least hashes (all rows, if they are fewer).

    Rows are first cut down to twice as many by the hash itself, so that no partition sends as many as most to the one task
    that orders them. rows: cheap to read twice.
    """
    share, key = 2 * most / max(rows.count(), 1), F.xxhash64(id_col)
    near = rows.filter(key < F.lit(int(share * 2.0**64) - 2**63)) if share < 1 else rows
    return near.orderBy(key, id_col).limit(most)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one of our own only where it is unset and everything runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ruleloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/ruleloom-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def bytes_of(df: DataFrame) -> int:
    """The size of the files of a table from written()."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def written(df: DataFrame, name: str, near: DataFrame | None = None) -> DataFrame:
    """Writes df once as a Parquet table in the shared folder and reads it back: lineage ends here, and a lost executor costs no recomputation.

    near: a table from written() that df is made from and hardly larger than. The last step then has no more tasks, and so
    writes no more files, than one for every BYTES_PER_FILE of it: steps of many rounds don't leave thousands of tiny files.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if near is not None:
        df = df.coalesce(1 + bytes_of(near) // BYTES_PER_FILE)
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a table from written(), once nothing that is still to run reads it."""
    remove(df.sparkSession, df.written_to)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release() -> None:
    """Deletes every table written so far; call it once no result that reads them is needed."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended
            return


atexit.register(release)
