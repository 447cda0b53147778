"""Request texts, as expressions: which page to read, and what the images show."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHOWN = {
    "target": ("**the page to read**",),
    "previous": ("**the page before it, for context**", "**the page to read**"),
    "next": ("**the page to read**", "**the page after it, for context**"),
    "previous_next": ("**the page before it, for context**", "**the page to read**", "**the page after it, for context**"),
}


def page_request(variant: Column, page: Column, selected: Column) -> Column:
    """The text of a page request: its number, how many pages are selected, and the images in order."""
    order = None
    for name, images in SHOWN.items():
        text = "; ".join(f"image {i + 1} is {what}" for i, what in enumerate(images))
        order = F.when(variant == name, text) if order is None else order.when(variant == name, text)
    return F.concat(F.lit("Read page "), page.cast("string"), F.lit(" of "), selected.cast("string"), F.lit(": "), order, F.lit(". Give blocks of that page alone."))


def fallback_request(page: Column) -> Column:
    return F.concat(F.lit("Write page "), page.cast("string"), F.lit(" as Markdown in reading order, and nothing else."))


def box_json(box: Column) -> Column:
    return F.to_json(box)


def crop_request(page: Column, box: Column, rotate: Column, reason: Column) -> Column:
    return F.concat(F.lit("This image shows part of page "), page.cast("string"), F.lit(", at "), box_json(box), F.lit(", turned by "), rotate.cast("string"), F.lit(" degrees. It was asked for because: "), reason)
