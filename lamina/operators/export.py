"""Exports: JSON view, annotation geometry, bundles."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, markup, raster, text
from ..schema import BLOCK, CONTRACT_VERSION, COUNTERS, VISUAL_TYPES
from .layout import PAGE_BREAK, block_markdown

BOX_FIELDS = ("xmin", "ymin", "xmax", "ymax")


def warning_text(code: Column, detail: Column, page: Column) -> Column:
    """A warning as a sentence; what a model remarked is told as it is."""
    p = page.cast("string")
    return (
        F.when(code == "PAGE_FAILED", F.concat(F.lit("Page "), p, F.lit(" could not be read; tokens of the failed requests are not known.")))
        .when(code == "PAGE_RECOVERED_MARKDOWN", F.concat(F.lit("Page "), p, F.lit(" was read as plain Markdown: its one box is the whole page, and tokens of the failed request are not known.")))
        .when(code == "CROP_FAILED", F.lit("A region could not be read again; the page's own reading stays, and tokens of the failed requests are not known."))
        .when(code == "CROP_RETRIED", F.lit("A region was read at the second attempt; tokens of the first are not known."))
        .when(code == "REREAD_LIMIT", F.lit("No more regions may be read again; small or unclear text needs a look."))
        .otherwise(F.coalesce(detail, code))
    )


def document_view(sources: DataFrame, pages: DataFrame, blocks: DataFrame, model: str, doc: str = "doc_id") -> DataFrame:
    """One row a document: what its export holds, as ``view``, with ``markdown`` and ``status`` beside it.

    ``sources``: doc, filename; ``pages``: doc, page, width, height, status, notes,
    counters, calls, complete; ``blocks``: doc, page, seq, id, type, markdown, box,
    description, asset. A document without pages has empty lists and complete usage.
    All three grow with the documents and hold texts that compress well, so Spark may
    not take any for small enough to broadcast: they are merged.
    """
    counted = (*COUNTERS, "calls")
    used = F.struct(*counted, "complete")
    block = F.struct("id", "type", "markdown", "box", "description", "asset")
    b = blocks.groupBy(doc, "page").agg(F.array_sort(F.collect_list(F.struct("seq", block.alias("b")))).alias("bs"))
    p = pages.join(b.hint("merge"), [doc, "page"], "left").withColumn("blocks", F.coalesce(F.transform("bs", lambda x: x["b"]), F.array().cast(f"array<{BLOCK}>")))
    told = F.transform("notes", lambda n: warning_text(n["code"], n["detail"], F.col("page")))
    page = F.struct("page", "width", "height", "blocks", told.alias("warnings"), "status", used.alias("usage"))
    one = p.select(doc, "page", page.alias("p")).groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "p"))), lambda x: x["p"]).alias("pages"))
    view = sources.select(doc, "filename").join(one.hint("merge"), doc, "left").withColumn("pages", F.coalesce("pages", F.array().cast(one.schema["pages"].dataType)))
    parts = F.flatten(F.transform("pages", lambda x, i: F.concat(F.when(i > 0, F.array(F.lit(PAGE_BREAK))).otherwise(F.array().cast("array<string>")), F.transform(x["blocks"], block_markdown))))
    markdown = F.concat(text.strip(F.array_join(parts, "\n\n")), F.lit("\n"))
    added = lambda c: F.aggregate("pages", F.lit(0).cast("bigint"), lambda a, x: a + x["usage"][c]).alias(c)
    total = [added(c) for c in counted]
    complete = F.forall("pages", lambda x: x["usage"]["complete"]).alias("complete")
    view = view.withColumn("markdown", markdown).withColumn("warnings", F.flatten(F.transform("pages", lambda x: x["warnings"]))).withColumn("usage", F.struct(*total, complete))
    whole = F.struct(F.lit(CONTRACT_VERSION).alias("version"), F.lit(model).alias("model"), F.col("filename").alias("source_filename"), "pages", "markdown", "warnings", "usage")
    worst = F.when(F.exists("pages", lambda x: x["status"] == "failed"), "failed").when(F.exists("pages", lambda x: x["status"] == "partial"), "partial").otherwise("ok")
    return view.select(doc, "filename", "markdown", worst.alias("status"), F.size("warnings").alias("n_warnings"), whole.alias("view"))


def json_text(view: Column) -> Column:
    """The document's JSON; nulls are kept."""
    return F.to_json(view, {"ignoreNullFields": "false"})


def crops(blocks: DataFrame, images: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``doc, page, id, name, png``: the images of named visual blocks, cut from the rendered pages.

    ``images``: doc, page, data, height, width, channels (see ``raster.read_images``).
    """
    x = blocks.filter(F.col("type").isin(*VISUAL_TYPES) & F.col("asset").isNotNull()).join(images, [doc, "page"])
    box = {c: F.col("box")[c] for c in BOX_FIELDS}
    png = raster.crop_png({c: F.col(c) for c in ("data", "height", "width", "channels")}, box, F.lit(0))
    return x.select(doc, "page", "id", F.col("asset").alias("name"), png.alias("png"))


def artifacts(views: DataFrame, assets: DataFrame | None = None, doc: str = "doc_id") -> DataFrame:
    """``doc, position, name, content``: Markdown, JSON, HTML and the assets of each document of ``document_view``.

    Images that the Markdown names stand in the HTML as data URLs.
    """
    x = views
    if assets is not None:
        urls = assets.filter(F.col("png").isNotNull()).groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("name", text.data_url(F.col("png")).alias("url")))).alias("urls"))
        x = x.join(urls.hint("merge"), doc, "left").withColumn("urls", F.coalesce("urls", F.array().cast("array<struct<name:string,url:string>>")))
    names = text.artifact_names(F.col("filename"))
    page = markup.html_document(F.col("markdown"), F.col("filename"), F.col("urls") if assets is not None else None)
    three = ((names["markdown_name"], F.col("markdown")), (names["json_name"], json_text(F.col("view"))), (names["html_name"], page))
    files = F.array(*[F.struct(F.lit(i).alias("position"), name.alias("name"), F.encode(body, "UTF-8").alias("content")) for i, (name, body) in enumerate(three)])
    out = x.select(doc, F.explode(files).alias("f")).select(doc, "f.*")
    return out if assets is None else out.unionByName(assets.filter(F.col("png").isNotNull()).select(doc, F.lit(len(three) + 1).alias("position"), "name", F.col("png").alias("content")))


def overlay(rendered: DataFrame, blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Rectangles and labels of blocks on rendered pages; every rendered page must have a result."""
    x = blocks.join(rendered.select(doc, "page", "width", "height"), [doc, "page"])
    box = {c: F.col(c) for c in BOX_FIELDS}
    return x.select(doc, "page", "seq", *[c.alias(k) for k, c in geometry.overlay(box, F.col("width"), F.col("height"), F.col("id"), F.col("type")).items()])


def bundle(outputs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """A ZIP a document of its outputs ``name, content``, in the order of ``position``; rows are grouped by document."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            for r in rows.sort_values(["position", "name"]).itertuples():
                z.writestr(zipfile.ZipInfo(r.name_, (1980, 1, 1, 0, 0, 0)), r.content, zipfile.ZIP_DEFLATED)
        return pd.DataFrame({doc: [rows[doc].iloc[0]], "zip": [data.getvalue()]})

    x = outputs.select(doc, "position", "name", F.col("name").alias("name_"), F.col("content").cast("binary").alias("content"))
    return x.groupBy(doc).applyInPandas(pack, f"{doc} {outputs.schema[doc].dataType.simpleString()}, zip binary")


def thousands(x: Column) -> Column:
    return F.format_number(x, 0)
