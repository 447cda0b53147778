"""Tables written in the folder that all executors share, to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="lamina-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: what follows is recomputed from that table when an
    executor is lost. The tables go when the driver ends, or by ``discard_since``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lamina/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables there are; for ``discard_since``."""
    return len(_written)


def discard_since(start: int, *, keep: int = 1) -> None:
    """Delete the tables written after ``written()`` gave ``start``, but for the last ``keep``."""
    for entry in _written[start : len(_written) - keep]:
        _written.remove(entry)
        delete(*entry)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def cleanup() -> None:
    """Delete the tables that ``materialise`` wrote."""
    while _written:
        try:
            delete(*_written.pop())
        except Exception:  # noqa: BLE001  the session has already ended
            return
