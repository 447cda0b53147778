"""Readers: what turns a page into blocks. Recognition itself is outside the engine.

``ReplayReader`` joins recorded answers; ``TextReader`` and ``HtmlReader`` are
deterministic segmenters. A live reader is any DataFrame function of the same shape
whose result is materialised before it is used, since its answers cost money.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import BLOCK_TYPES

LINES_A_PAGE = 4


class Reader(Protocol):
    def read(self, requests: DataFrame) -> DataFrame: ...


class ReplayReader:
    """Answers from a table keyed by (doc_id, page, round, req, attempt, kind).

    Requests grow with the documents, yet their keys compress so well that Spark would
    send them to the driver and every executor as a small table; so they are merged.
    """

    def __init__(self, recorded: DataFrame):
        self.recorded = recorded

    def read(self, requests: DataFrame) -> DataFrame:
        key = ["doc_id", "page", "round", "req", "attempt", "kind"]
        return requests.select(*key).hint("merge").join(self.recorded, key)


class TextReader:
    """Lines of a text as blocks, four a page; types and boxes by position."""

    def read(self, documents: DataFrame) -> DataFrame:
        x = documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "markdown"))
        seq = F.pmod("pos", F.lit(LINES_A_PAGE))
        kind = F.element_at(F.array(*map(F.lit, BLOCK_TYPES)), F.pmod("pos", F.lit(len(BLOCK_TYPES))) + 1)
        x = x.select("doc_id", (F.floor(F.col("pos") / LINES_A_PAGE) + 1).cast("int").alias("page"), seq.cast("int").alias("seq"), "pos", kind.alias("type"), "markdown")
        top = F.col("seq") / 4.0
        return x.withColumns({"id": F.concat("type", F.lit("-0")), "xmin": F.lit(0.125), "ymin": top, "xmax": F.lit(0.875), "ymax": top + 0.125, "description": F.when(F.col("type").isin("figure", "chart"), F.concat(F.lit("line "), F.col("pos").cast("string")))})


# Elements that begin a block of text, and elements that browsers don't show as content.
BLOCK_TAGS = "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
HIDDEN_TAGS = "script style nav footer head template".split()


class HtmlReader:
    """The text of pages in order, a block at each block element, without what browsers don't show as content."""

    def read(self, pages: DataFrame, html: str = "html") -> DataFrame:
        x = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?s)<!--.*?-->", "")
        for tag in HIDDEN_TAGS:
            x = F.regexp_replace(x, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
        x = F.regexp_replace(x, rf"(?i)<(/?(?:{'|'.join(BLOCK_TAGS)})\b)", "\x01<$1")
        rows = pages.select("page_id", F.posexplode(F.split(x, "\x01", -1)).alias("seq", "raw"))
        tag = F.lower(F.regexp_extract("raw", r"^<([a-zA-Z][a-zA-Z0-9]*)", 1))
        text = F.trim(F.regexp_replace(F.regexp_replace("raw", r"(?s)<[^>]*>", " "), r"\s+", " "))
        kind = F.when(tag.rlike("^h[1-6]$"), "heading").when(tag == "li", "list").when(tag.isin("td", "th"), "table").when(tag.isin("caption", "figcaption"), "caption").otherwise("paragraph")
        return rows.select("page_id", "seq", kind.alias("type"), text.alias("markdown")).filter(F.col("markdown") != "")
