"""Boxes, crops, overlays and render scale as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MAX_PIXELS

MARGIN = 0.02


def expand(box: dict[str, Column]) -> dict[str, Column]:
    """Grown by an absolute margin on each side, within the page."""
    return {k: F.greatest(F.lit(0.0), c - F.lit(MARGIN)) if k.endswith("min") else F.least(F.lit(1.0), c + F.lit(MARGIN)) for k, c in box.items()}


def crop_pixels(box: dict[str, Column], width: Column, height: Column) -> dict[str, Column]:
    """Pixel corners, halves to even."""
    size = {"xmin": width, "xmax": width, "ymin": height, "ymax": height}
    return {k: F.bround(c * size[k], 0).cast("int") for k, c in box.items()}


def rotated_size(width: Column, height: Column, rotate: Column) -> tuple[Column, Column]:
    swap = rotate.isin(90, 270)
    return F.when(swap, height).otherwise(width), F.when(swap, width).otherwise(height)


def overlay(box: dict[str, Column], width: Column, height: Column, block_id: Column, kind: Column) -> dict[str, Column]:
    """Rectangle, label anchor and label of a block on its page."""
    x0, y0 = box["xmin"] * width, box["ymin"] * height
    return {"x0": x0, "y0": y0, "x1": box["xmax"] * width, "y1": box["ymax"] * height, "label_x": x0 + 2, "label_y": F.greatest(F.lit(10.0), y0 + 10), "label": F.concat(block_id, F.lit(" · "), kind)}


def render_scale(width_points: Column, height_points: Column, dpi: int = 300) -> Column:
    """dpi / 72, shrunk so that the page keeps within the pixel cap."""
    scale = F.lit(dpi) / F.lit(72.0)
    pixels = width_points * scale * height_points * scale
    return F.when(pixels > MAX_PIXELS, scale * F.sqrt(MAX_PIXELS / pixels)).otherwise(scale)


def image_ok(width: Column, height: Column) -> Column:
    return width.cast("bigint") * height <= MAX_PIXELS
