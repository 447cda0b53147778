"""What the operators of this package share: reading, shared-folder tables, batch mapping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..sources.tables import materialise, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str) -> Column:
    """crc32 of the id's text mod 5; fold 0 is held out. Null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(5))


def held_out(doc_id: Column | str) -> Column:
    """True in fold 0; a null id counts as not held out."""
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def share(key: Column, part: float) -> Column:
    """A seeded sample of about ``part`` of the keys, the same in each run."""
    return F.pmod(F.xxhash64(key, F.lit(20_011)), F.lit(1_000_003)) < int(part * 1_000_003) + 1


#: Bytes of an Arrow batch at most.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """From now on Arrow batches are bounded by bytes, so that many long texts never make a large one; a lower bound stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def schema_of(ddl: str | StructType) -> StructType:
    return ddl if isinstance(ddl, StructType) else _parse_datatype_string(ddl)


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict], dict | None]], ddl: str) -> DataFrame:
    """``make()`` runs once in each task and gives a function from columns (lists) to columns.

    If that function has an attribute ``finish``, its columns come last, once a task.
    """
    wanted = to_arrow_schema(schema_of(ddl))
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()

        def batch(out: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(out[x.name], type=x.type) for x in wanted], schema=wanted)

        for b in batches:
            if b.num_rows and (out := f({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})) is not None:
                yield batch(out)
        if (finish := getattr(f, "finish", None)) and (out := finish()) is not None:
            yield batch(out)

    return df.mapInArrow(run, schema_of(ddl))


class Sent:
    """A model broadcast with its code; ``value`` unpacks it once in each task."""

    def __init__(self, spark: SparkSession, model):
        from pyspark import cloudpickle

        self.sent, self.got = spark.sparkContext.broadcast(cloudpickle.dumps(model)), None

    def __getstate__(self):
        return {"sent": self.sent, "got": None}

    def drop(self) -> None:
        """Free the executors' copies; a task that still needs it fetches it again."""
        self.sent.unpersist()

    @property
    def value(self):
        if self.got is None:
            import pickle

            self.got = pickle.loads(self.sent.value)
        return self.got


def utf32(text: str):
    """Code points of a text as a numpy array; lone surrogates are kept as they are."""
    import numpy as np

    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Memo(dict):
    """A dict that computes what it lacks and empties itself before it outgrows memory."""

    def __init__(self, compute: Callable, most: int = 100_000):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.compute(key)
        return value


def tag(source: str) -> Column:
    """A source as a text that is never null, to join and group by."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def prefix_sums(df: DataFrame, by: list[str], order: str, sums: dict[str, str], run: int = 4096) -> DataFrame:
    """Adds under each name of ``sums`` the total of its column over the rows of the same ``by`` that come before.

    ``order`` is a whole number, one row each; ``by`` holds no nulls. Runs of ``run``
    numbers are added up first, so a window sees only one run, or one row for each run.
    """
    x = df.withColumn("_run", F.floor(F.col(order) / run).cast("long"))
    every = Window.partitionBy(*by, F.lit(1)).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = x.groupBy(*by, "_run").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    runs = runs.select(*by, "_run", *[F.coalesce(F.sum(f"_t_{n}").over(every), F.lit(0)).alias(f"_b_{n}") for n in sums])
    inside = Window.partitionBy(*by, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    got = x.join(runs, [*by, "_run"])
    return got.select(*df.columns, *[(F.col(f"_b_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(n) for n, c in sums.items()])
