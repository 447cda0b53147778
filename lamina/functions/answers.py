"""Strict reading of a reader's raw answers.

An answer is JSON of one closed shape; what has unknown or missing fields, values
out of bounds or more than ``MAX_REQUESTS`` rereads is no answer at all. A fallback
answer is Markdown, which becomes one block over the whole page; blank it is none.
Numbers may come as numeric strings, as JSON readers of this contract allow.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from ..schema import BLOCK, BLOCK_TYPES, MAX_REQUESTS, ROTATIONS, ZOOM

READ = f"struct<ok:boolean,blocks:array<{BLOCK}>,warnings:array<string>,requests:array<{ZOOM}>>"
#: By kind of answer: the fields for blocks and for rereads.
SHAPES = {"page": ("blocks", "zoom_requests"), "crop": ("replacement_blocks", "needs_another_zoom")}
ID = re.compile(r"[a-z_]+-[0-9]+")


class Refused(ValueError):
    pass


def need(ok: bool) -> None:
    if not ok:
        raise Refused


def fields(x, known: dict[str, bool]) -> dict:
    """An object that has no field but the known ones, and all that must be there."""
    need(isinstance(x, dict) and x.keys() <= known.keys() and all(k in x for k, must in known.items() if must))
    return x


def text(x, low: int = 0, high: float = math.inf) -> str:
    need(isinstance(x, str) and low <= len(x) <= high)
    return x


def share(x) -> float:
    """A number from 0 to 1."""
    need(isinstance(x, bool | int | float | str))
    try:
        v = float(x)
    except ValueError:
        raise Refused from None
    need(0.0 <= v <= 1.0)
    return v


def box(x) -> dict:
    x = {k: share(v) for k, v in fields(x, dict.fromkeys(("xmin", "ymin", "xmax", "ymax"), True)).items()}
    need(x["xmin"] < x["xmax"] and x["ymin"] < x["ymax"])
    return x


def block(x) -> dict:
    x = fields(x, {"id": True, "type": True, "markdown": True, "box": True, "description": False, "asset": False})
    need(ID.fullmatch(text(x["id"])) is not None and text(x["type"]) in BLOCK_TYPES)
    notes = {k: None if x.get(k) is None else text(x[k]) for k in ("description", "asset")}
    return {"id": x["id"], "type": x["type"], "markdown": text(x["markdown"], 1), "box": box(x["box"]), **notes}


def request(x) -> dict:
    x = fields(x, {"box": True, "reason": True, "rotate_degrees": False})
    turn = x.get("rotate_degrees", 0)
    need(isinstance(turn, int) and not isinstance(turn, bool) and turn in ROTATIONS)
    return {"box": box(x["box"]), "reason": text(x["reason"], 1, 200), "rotate_degrees": turn}


def listed(x, read) -> list:
    need(isinstance(x, list))
    return [read(v) for v in x]


def answer(kind: str | None, raw: str | None) -> dict:
    """``ok, blocks, warnings, requests`` of one raw answer."""
    none = {"ok": False, "blocks": [], "warnings": [], "requests": []}
    if kind == "fallback":
        markdown = (raw or "").strip()
        whole = {"id": "paragraph-0", "type": "paragraph", "markdown": markdown, "box": {"xmin": 0.0, "ymin": 0.0, "xmax": 1.0, "ymax": 1.0}, "description": None, "asset": None}
        return none | {"ok": True, "blocks": [whole]} if markdown else none
    if kind not in SHAPES or raw is None:
        return none
    blocks, rereads = SHAPES[kind]
    try:
        x = fields(json.loads(raw), {blocks: kind == "page", "warnings": False, rereads: False})
        more = listed(x.get(rereads, []), request)
        need(len(more) <= MAX_REQUESTS)
        return {"ok": True, "blocks": listed(x.get(blocks, []), block), "warnings": listed(x.get("warnings", []), text), "requests": more}
    except (Refused, ValueError, RecursionError):
        return none


def read(kind: Column, raw: Column) -> Column:
    """``answer`` of two columns, a batch at a time."""
    shape = _parse_datatype_string(READ)
    wanted = to_arrow_type(shape)

    @F.arrow_udf(shape)
    def tell(kinds: pa.Array, raws: pa.Array) -> pa.Array:
        return pa.array([answer(k, r) for k, r in zip(kinds.to_pylist(), raws.to_pylist(), strict=True)], type=wanted)

    return tell(kind, raw)
