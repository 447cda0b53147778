"""Closed values, bounds and row predicates of the layout contract."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTRACT_VERSION = "1.0"
# Block types, those with an image of their own, file suffixes.
BLOCK_TYPES = ("heading", "paragraph", "list", "table", "figure", "chart", "diagram", "formula", "caption", "footnote", "marginalia", "checkbox", "attestation", "logo", "scan_code")
VISUAL_TYPES = ("figure", "chart", "diagram", "attestation", "logo", "scan_code")
SUFFIXES = (".pdf", ".png", ".jpg", ".jpeg", ".webp", ".tif", ".tiff", ".bmp")
MAX_BYTES = 200 * 1024 * 1024
MAX_PIXELS = 20_000_000
COUNTERS = ("input_tokens", "cached_input_tokens", "cache_write_tokens", "output_tokens", "reasoning_tokens")
MAX_REQUESTS = 4
ROTATIONS = (0, 90, 180, 270)
BOX = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"
BLOCK = f"struct<id:string,type:string,markdown:string,box:{BOX},description:string,asset:string>"
ZOOM = f"struct<box:{BOX},reason:string,rotate_degrees:int>"


@dataclass(frozen=True)
class Config:
    """Bounded settings; rates are exact decimals per million tokens."""

    dpi: int = 300
    max_zoom_rounds: int = 2
    max_crops_per_page: int = 4
    timeout_seconds: float = 300.0
    input_rate: str = "2.00"
    cached_rate: str = "0.20"
    cache_write_rate: str = "2.50"
    output_rate: str = "10.00"

    def __post_init__(self) -> None:
        if not (150 <= self.dpi <= 400 and 0 <= self.max_zoom_rounds <= 2 and 0 <= self.max_crops_per_page <= 4 and 0 < self.timeout_seconds <= 900):
            raise ValueError("a setting is out of its bounds")


def box_ok(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Corners in [0, 1], in order, none NaN or null."""
    inside = [c.isNotNull() & ~F.isnan(c) & c.between(0.0, 1.0) for c in (xmin, ymin, xmax, ymax)]
    return F.coalesce(inside[0] & inside[1] & inside[2] & inside[3] & (xmax > xmin) & (ymax > ymin), F.lit(False))


def block_ok(block_id: Column, kind: Column, markdown: Column, box: Column) -> Column:
    ok = block_id.rlike(r"^[a-z_]+-[0-9]+\z") & kind.isin(*BLOCK_TYPES) & (F.char_length(markdown) >= 1)
    return F.coalesce(ok, F.lit(False)) & box_ok(box["xmin"], box["ymin"], box["xmax"], box["ymax"])


def zoom_ok(reason: Column, rotate: Column, box: Column) -> Column:
    ok = F.char_length(reason).between(1, 200) & rotate.isin(*ROTATIONS)
    return F.coalesce(ok, F.lit(False)) & box_ok(box["xmin"], box["ymin"], box["xmax"], box["ymax"])


def keys_within(raw: Column, allowed: tuple[str, ...]) -> Column:
    """True if the text is a JSON object that has no other keys; false for anything malformed."""
    keys = F.json_object_keys(raw)
    return F.coalesce(F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) == 0, F.lit(False))
