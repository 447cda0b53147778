"""Page selection, context windows, block merge, assembly and memo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..schema import VISUAL_TYPES

PAGE_BREAK = "<!-- PAGE BREAK -->"


def select_pages(sources: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One row a selected page of the sources whose range holds."""
    return sources.select(doc, F.explode(text.page_range(F.col("page_spec"), F.col("page_count"))).alias("page"))


def context(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Neighbours in the selection, how many are selected, and the request variant and image order."""
    w = Window.partitionBy(doc).orderBy("page")
    x = pages.withColumn("previous_page", F.lag("page").over(w)).withColumn("next_page", F.lead("page").over(w)).withColumn("selected_page_count", F.count(F.lit(1)).over(Window.partitionBy(doc)).cast("int"))
    before, after = F.col("previous_page").isNotNull(), F.col("next_page").isNotNull()
    variant = F.when(before & after, "previous_next").when(before, "previous").when(after, "next").otherwise("target")
    return x.withColumn("variant", variant).withColumn("images", F.array_compact(F.array("previous_page", "page", "next_page")))


def merge_blocks(blocks: DataFrame, keys: tuple[str, ...] = ("doc_id", "page"), order: str = "seq") -> DataFrame:
    """Ordered keyed merge: an id keeps its first place and takes its last content; ``order`` is total in a page."""
    rest = [c for c in blocks.columns if c not in (*keys, "id", order)]
    merged = blocks.groupBy(*keys, "id").agg(F.min(order).alias("first_seq"), F.max_by(F.struct(*rest), order).alias("last"))
    return merged.select(*keys, "id", "first_seq", *[F.col("last")[c].alias(c) for c in rest])


def name_assets(blocks: DataFrame) -> DataFrame:
    """Visual blocks get the name of their crop; others keep what they came with."""
    kept = F.col("asset") if "asset" in blocks.columns else F.lit(None).cast("string")
    return blocks.withColumn("asset", F.when(F.col("type").isin(*VISUAL_TYPES), text.asset_name(F.col("page"), F.col("id"))).otherwise(kept))


def block_markdown(b: dict[str, Column] | Column) -> Column:
    """A block's text, then its image link, then its generated description."""
    link = F.when(F.coalesce(b["asset"], F.lit("")) != "", F.concat(F.lit("!["), b["type"], F.lit(" "), b["id"], F.lit("]("), b["asset"], F.lit(")")))
    note = F.when(F.coalesce(b["description"], F.lit("")) != "", F.concat(F.lit("*Generated description: "), b["description"], F.lit("*")))
    return F.concat_ws("\n\n", text.strip(b["markdown"]), link, note)


def document_markdown(pages: DataFrame, blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Reading-ordered Markdown of every document; pages without blocks keep their break."""
    b = blocks.groupBy(doc, "page").agg(F.collect_list(F.struct("seq", block_markdown({c: F.col(c) for c in ("markdown", "asset", "type", "id", "description")}).alias("md"))).alias("bs"))
    p = pages.select(doc, "page").join(b, [doc, "page"], "left")
    p = p.select(doc, "page", F.when(F.col("bs").isNotNull(), F.array_join(F.transform(F.array_sort("bs"), lambda x: x["md"]), "\n\n")).alias("md"), F.coalesce(F.size("bs"), F.lit(0)).alias("n"))
    one = p.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("page", "md"))).alias("ps"), F.count(F.lit(1)).cast("int").alias("n_pages"), F.sum("n").cast("bigint").alias("n_blocks"))
    # a page with no blocks leaves only its break
    parts = F.flatten(F.transform("ps", lambda x, i: F.filter(F.array(F.when(i > 0, F.lit(PAGE_BREAK)), x["md"]), lambda y: y.isNotNull())))
    return one.select(doc, F.concat(text.strip(F.array_join(parts, "\n\n")), F.lit("\n")).alias("markdown"), "n_pages", "n_blocks")


def document_warnings(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Page warnings in page order."""
    return pages.groupBy(doc).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page", "warnings"))), lambda p: p["warnings"])).alias("warnings"))


def zoom_budget(requests: DataFrame, crops: int = 4, keys: tuple[str, ...] = ("doc_id", "page"), order: str = "req") -> DataFrame:
    """The requests of a page that its budget serves, first come first served."""
    w = Window.partitionBy(*keys).orderBy(order)
    return requests.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= crops)


def not_in_memo(sources: DataFrame, memo: DataFrame, key: str = "cache_key") -> DataFrame:
    return sources.join(memo.select(key), key, "left_anti")


def conflicts(outputs: DataFrame, existing: DataFrame, name: str = "name") -> DataFrame:
    """Outputs whose name is taken; a writer must find none before it writes any."""
    return outputs.join(existing.select(name), name, "left_semi")


def batch_limits(sources: DataFrame, *by: str, max_files: int = 20, max_pages: int = 100) -> DataFrame:
    """Whether a batch (of each ``by``) keeps within its limits: ``files, pages, ok``; a source without a range breaks them."""
    ordered = F.coalesce(F.bool_and(F.coalesce(F.col("start") <= F.col("end"), F.lit(False))), F.lit(True))
    x = sources.groupBy(*by).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.col("end") - F.col("start") + 1), F.lit(0)).cast("bigint").alias("pages"), ordered.alias("ordered"))
    return x.select(*by, "files", "pages", ((F.col("files") <= max_files) & (F.col("pages") <= max_pages) & F.col("ordered")).alias("ok"))
