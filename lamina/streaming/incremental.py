"""Document files as a stream: each new file is judged once. Not a capability of the batch contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    x = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", per_trigger).load(folder)
    x = x.withColumn("filename", F.element_at(F.split(F.col("path"), "/"), -1))
    return x.select("path", "filename", "length", "modificationTime", text.input_verdict(F.col("filename"), F.col("length")).alias("verdict"))
