"""The folder that driver and executors share: checkpoints and tables in it."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of checkpoints; one of our own is set only where none is and the master is local."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not found and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="sparkloom-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df as written to the checkpoint folder: read as often as needed, and not computed again when an executor is lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, tag: str) -> str:
    """A new name in the shared folder; what is written there goes when the driver's Python ends."""
    path = f"{shared_dir(spark)}/sparkloom-{tag}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def _system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _system(spark, path)
    return system.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    place, system = _system(spark, path)
    system.delete(place, True)


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession() if _made else None
    for path in _made if spark is not None else ():
        with contextlib.suppress(Exception):  # the JVM may have gone first
            delete(spark, path)
