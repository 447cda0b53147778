"""Token usage, exact cost and statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import COUNTERS, Config


def totals(usage: DataFrame, *by: str) -> DataFrame:
    """Sums of the counters and calls; complete only if every part is. Empty groups are 0 and complete."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in (*COUNTERS, "calls")]
    return usage.groupBy(*by).agg(*sums, F.coalesce(F.bool_and("complete"), F.lit(True)).alias("complete"))


def reported(usage: Column) -> dict[str, Column]:
    """Counters of one response, 0 where it has none; without usage one call that isn't complete."""
    got = {c: F.coalesce(usage[c].cast("bigint"), F.lit(0)).cast("bigint") for c in COUNTERS}
    return got | {"calls": F.lit(1).cast("bigint"), "complete": usage.isNotNull()}


def uncached(input_tokens: Column, cached: Column, cache_write: Column) -> Column:
    return input_tokens - cached - cache_write


def cost(c: dict[str, Column], config: Config = Config()) -> Column:
    """Exact decimal cost; null if usage is incomplete."""
    rate = lambda r: F.lit(r).cast("decimal(6,2)")
    paid = (
        uncached(c["input_tokens"], c["cached_input_tokens"], c["cache_write_tokens"]) * rate(config.input_rate)
        + c["cached_input_tokens"] * rate(config.cached_rate)
        + c["cache_write_tokens"] * rate(config.cache_write_rate)
        + c["output_tokens"] * rate(config.output_rate)
    )
    return F.when(c["complete"], (paid * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(18,8)"))


def cost_text(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit("$"), F.format_number(value, 6)), F.lit("Unavailable"))


def page_status(failed: Column, warnings: Column) -> Column:
    return F.when(failed, "failed").when(F.coalesce(F.size(warnings), F.lit(0)) > 0, "partial").otherwise("ok")


def exit_code(pages: DataFrame, *by: str) -> DataFrame:
    """1 if any page failed, else 2 if any is partial, else 0."""
    worst = F.when(F.coalesce(F.bool_or(F.col("status") == "failed"), F.lit(False)), 1).when(F.coalesce(F.bool_or(F.col("status") == "partial"), F.lit(False)), 2).otherwise(0)
    return pages.groupBy(*by).agg(worst.cast("int").alias("exit_code"), F.array_join(F.array_sort(F.collect_set("status")), ",").alias("statuses"))
