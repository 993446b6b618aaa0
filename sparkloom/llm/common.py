"""What the corpus operators share: scratch tables, batch limits, ASCII word rules, row identities."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, functions as F

#: The white space of the word rule, [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
#: Python's bytes.split() splits at exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of rows that Python workers get at once.
BATCH_BYTES = "4m"

_outside: list[str] = []
_scope: ContextVar[list[str] | None] = ContextVar("sparkloom_scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; one of our own only where none is set and the
    master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = own.get() if own.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it lies."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def folder(spark: SparkSession, tag: str) -> str:
    """A new name in the shared folder, whose files go as scratch tables do."""
    path = f"{shared_dir(spark)}/sparkloom-{tag}-{uuid.uuid4().hex}"
    mine = _scope.get()
    (_outside if mine is None else mine).append(path)
    return path


def scratch(df: DataFrame, tag: str, narrow: int = 1) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: cuts the lineage and survives lost executors. The table
    goes with the scope() that it was written in; outside of any, with release() or when the driver's Python ends.

    Partitions are set for rows with texts; rows that are so many times narrower, as ids are, go to so many times fewer files."""
    spark = df.sparkSession
    path = folder(spark, tag)
    out = df.coalesce(max(1, partitions(spark) // narrow)) if narrow > 1 else df
    out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Scratch tables written inside are deleted at the end, those of other threads and scopes are not. What is based on them must
    have been written by then."""
    mine: list[str] = []
    token = _scope.set(mine)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in mine:
            delete(spark, path)


def release(spark: SparkSession) -> None:
    """Deletes the scratch tables written outside of any scope. Call it only when every result based on them has been written."""
    while _outside:
        delete(spark, _outside.pop())


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession() if _outside else None
    if spark is not None:
        with contextlib.suppress(Exception):  # the JVM may have gone first
            release(spark)


def small_batches(spark: SparkSession) -> None:
    """Python workers get rows by bytes, not by number, so a batch of long texts stays small. A value that the session has stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(key):
        spark.conf.set(key, BATCH_BYTES)


def tidy() -> None:
    """Gives freed memory back to the system: a worker that waits for its next task must not keep what the last one needed."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run(frames), with tidy() when its task ends."""

    @functools.wraps(run)
    def wrapped(frames: Iterator) -> Iterator:
        try:
            yield from run(frames)
        finally:
            tidy()

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(docs: DataFrame) -> DataFrame:
    """Only doc_id and text, null texts as empty ones, and no clash with the callers' further columns."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def named(rows: DataFrame) -> DataFrame:
    """rows with doc_id as decimal text: a long column with a null in it would come to pandas as floats, which change ids over
    2 ** 53. Python steps pass it on as it is; a result column of type long is cast back by numbered()."""
    return rows.withColumn("doc_id", F.col("doc_id").cast("string"))


def numbered(rows: DataFrame) -> DataFrame:
    """rows with doc_id as a long again."""
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to clash with no column of docs."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
