"""Document files as rows, and per-document outputs with a conflict check before any write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..schema import SUFFIXES


def scan(spark: SparkSession, path: str, only: str = "*") -> DataFrame:
    """Files whose name matches ``only`` (see ``glob``): ``path, filename, length, content, verdict``; names and sizes are judged without reading content."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", only).load(path)
    x = x.withColumn("filename", F.element_at(F.split(F.col("path"), "/"), -1))
    return x.select("path", "filename", "length", "content", text.input_verdict(F.col("filename"), F.col("length")).alias("verdict"))


def glob(suffixes: tuple[str, ...] = SUFFIXES) -> str:
    """A name filter for ``scan``; file systems tell case apart, so both cases are listed."""
    return "*.{" + ",".join(x for s in suffixes for x in (s[1:], s[1:].upper())) + "}"


def file_system(folder: str):
    """The store that a folder lies in and its path there; local paths need no scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def taken(spark: SparkSession, folder: str) -> DataFrame:
    """``name`` of every file that lies under a folder already."""
    from pyarrow import fs

    store, root = file_system(folder)
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return spark.createDataFrame([(f.path[len(root.rstrip("/")) + 1 :],) for f in found if f.type == fs.FileType.File], "name string")


def write_outputs(outputs: DataFrame, folder: str, *, overwrite: bool = False) -> None:
    """Write rows ``name, content`` as files under ``folder``, from the executors.

    Unless ``overwrite``, nothing is written if any name is taken; overwriting
    replaces those files alone. Files go by way of a hidden one with a name of its
    own, so a task that is run again, or twice at once, leaves no half-written file.
    ``folder`` must be one that all executors reach.
    """
    spark = outputs.sparkSession
    store, root = file_system(folder)
    store.create_dir(root, recursive=True)
    if not overwrite and (clash := outputs.select("name").join(taken(spark, folder), "name", "left_semi").limit(1).collect()):
        raise FileExistsError(clash[0]["name"])

    def write(rows) -> None:
        import uuid

        store, root = file_system(folder)
        for row in rows:
            there = f"{root.rstrip('/')}/{row['name']}"
            place, _, name = there.rpartition("/")
            store.create_dir(place, recursive=True)
            part = f"{place}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as stream:
                stream.write(bytes(row["content"] or b""))
            store.move(part, there)

    outputs.select("name", F.col("content").cast("binary").alias("content")).foreachPartition(write)
