"""The bounded reread of pages, folded from a reader's answers.

A reader answers three kinds of requests: ``page`` (one attempt), ``fallback``
(plain Markdown, one attempt) and ``crop`` (two attempts, numbered from 1 in each
round as its page asked). Answers are rows ``doc_id, page, round, req, attempt, kind,
raw`` with token counters and ``has_usage``; they are kept, never asked for twice,
since they cost money and differ. Pages, and crops of a round, don't depend on each
other: all answers of a page meet in one shuffle and its rounds are folded there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as raw_answers
from ..functions import geometry, prompts
from ..schema import BLOCK, COUNTERS, ZOOM, Config
from ..sources.readers import Reader
from .layout import merge_blocks

KEY = ("doc_id", "page")
NOTE = "struct<code:string,detail:string>"
LAST = f"struct<round:int,req:int,pos:int,b:{BLOCK}>"


def note(code: Column | str, detail: Column | None = None) -> Column:
    return F.struct((F.lit(code) if isinstance(code, str) else code).cast("string").alias("code"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))


def notes(texts: Column) -> Column:
    """What a model remarks on its own reading."""
    return F.transform(texts, lambda t: note("MODEL_NOTE", t))


def none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def placed(blocks: Column, round_: int, req: Column) -> Column:
    """Blocks with their place in the order of reading."""
    return F.transform(blocks, lambda b, i: F.struct(F.lit(round_).alias("round"), req.cast("int").alias("req"), i.cast("int").alias("pos"), b.alias("b")))


def parsed(answers: DataFrame) -> DataFrame:
    return answers.withColumn("read", raw_answers.read(F.col("kind"), F.col("raw"))).drop("raw")


def gathered(answers: DataFrame) -> DataFrame:
    """One row a page: its own answer ``p``, its fallback ``f`` and the array ``crops`` of crop answers."""
    x = answers if "read" in answers.columns else parsed(answers)
    one = F.struct("round", "req", "attempt", "read", "has_usage", *COUNTERS)
    mine = lambda kind: F.min_by(F.when(F.col("kind") == kind, one), F.when(F.col("kind") == kind, F.struct("round", "req", "attempt")))
    crops = F.collect_list(F.when((F.col("kind") == "crop") & F.col("attempt").isin(1, 2), one))
    return x.groupBy(*KEY).agg(mine("page").alias("p"), mine("fallback").alias("f"), crops.alias("crops"))


def state(answers: DataFrame, config: Config = Config(), rounds: int | None = None) -> DataFrame:
    """One row a page after ``rounds`` rounds (all by default).

    ``placed`` (blocks with their places), ``notes``, ``todo`` (open requests),
    ``used`` (crops spent), ``status``, counters, ``calls``, ``complete``, and
    ``missing``: requests served in these rounds to which an answer isn't there yet.
    """
    most, rounds = config.max_crops_per_page, config.max_zoom_rounds if rounds is None else rounds
    x = gathered(answers)
    p_ok, f_ok = F.coalesce(F.col("p.read.ok"), F.lit(False)), F.coalesce(F.col("f.read.ok"), F.lit(False))
    x = x.withColumn("p_ok", p_ok).withColumn("failed", ~p_ok & ~f_ok).withColumn("by", F.when(F.col("p_ok"), F.col("p")).when(f_ok, F.col("f")))
    blank = lambda c, kind: F.coalesce(c, none(kind))
    x = x.withColumn("placed", blank(placed(F.col("by.read.blocks"), 0, F.lit(0)), LAST))
    told = F.when(F.col("failed"), F.array(note("PAGE_FAILED"))).when(~F.col("p_ok"), F.array(note("PAGE_RECOVERED_MARKDOWN"))).otherwise(none(NOTE))
    x = x.withColumn("notes", F.concat(told, blank(notes(F.col("by.read.warnings")), NOTE)))
    x = x.withColumn("todo", blank(F.when(F.col("p_ok"), F.slice(F.col("p.read.requests"), 1, most)), ZOOM)).withColumn("used", F.lit(0))
    counted = lambda c, has: F.coalesce(F.when(has, c), F.lit(0)).cast("bigint")
    has = F.coalesce(F.col("by.has_usage"), F.lit(False))
    sums = {c: counted(F.col("by")[c], has) for c in COUNTERS}
    x = x.withColumns(sums | {"calls": F.when(F.col("p_ok"), 1).otherwise(2).cast("bigint"), "complete": F.col("p_ok") & has, "missing": none("struct<round:int,req:int,attempt:int>")})
    for r in range(1, rounds + 1):
        # of each served request its two attempts; later ones only count if the first is no answer
        tried = lambda q, a: F.get(F.filter("crops", lambda c: (c["round"] == r) & (c["req"] == q) & (c["attempt"] == a)), F.lit(0))  # noqa: B023, E731
        served = F.transform(F.slice("todo", F.lit(1), F.greatest(F.lit(0), F.least(F.size("todo"), most - F.col("used")))), lambda z, i: F.struct((i + 1).cast("int").alias("req"), tried(i + 1, 1).alias("one"), tried(i + 1, 2).alias("two")))
        x = x.withColumn("served", served)
        good = lambda c: F.coalesce(c["read"]["ok"], F.lit(False))
        x = x.withColumn("served", F.transform("served", lambda s: F.struct(s["req"].alias("req"), good(s["one"]).alias("once"), (good(s["one"]) | good(s["two"])).alias("ok"), F.when(good(s["one"]), s["one"]).when(good(s["two"]), s["two"]).alias("by"), F.when(s["one"].isNull(), 1).when(~good(s["one"]) & s["two"].isNull(), 2).alias("lacks"))))
        told = F.transform("served", lambda s: F.concat(F.when(~s["ok"], F.array(note("CROP_FAILED"))).when(~s["once"], F.array(note("CROP_RETRIED"))).otherwise(none(NOTE)), F.coalesce(notes(s["by"]["read"]["warnings"]), none(NOTE))))
        add = lambda f: F.aggregate("served", F.lit(0).cast("bigint"), lambda a, s: a + f(s))
        spent = lambda c: add(lambda s: counted(s["by"][c], F.coalesce(s["by"]["has_usage"], F.lit(False))))  # noqa: B023, E731
        more = {c: F.col(c) + spent(c) for c in COUNTERS}
        asked = F.flatten(F.transform(F.filter("served", lambda s: s["ok"]), lambda s: s["by"]["read"]["requests"]))
        x = x.withColumns(
            more
            | {
                "placed": F.concat("placed", F.flatten(F.transform(F.filter("served", lambda s: s["ok"]), lambda s: placed(s["by"]["read"]["blocks"], r, s["req"])  # noqa: B023
                ))),
                "notes": F.concat("notes", F.flatten(told)),
                "calls": F.col("calls") + add(lambda s: F.when(s["once"], 1).otherwise(2).cast("bigint")),
                "complete": F.col("complete") & F.forall("served", lambda s: s["once"] & F.coalesce(s["by"]["has_usage"], F.lit(False))),
                "missing": F.concat("missing", F.transform(F.filter("served", lambda s: s["lacks"].isNotNull()), lambda s: F.struct(F.lit(r).alias("round"), s["req"].alias("req"), s["lacks"].cast("int").alias("attempt")))),
                "used": F.col("used") + F.size("served"),
                "asked": F.col("todo"),
                # a page whose budget is spent keeps its open requests
                "todo": F.when(F.size("served") > 0, asked).otherwise(F.col("todo")),
            }
        )
    over = F.when(F.size("todo") > 0, F.array(note("REREAD_LIMIT"))).otherwise(none(NOTE))
    x = x.withColumn("notes", F.concat("notes", over))
    status = F.when(F.col("failed"), "failed").when(F.size("notes") > 0, "partial").otherwise("ok")
    return x.withColumn("status", status).drop("crops", "served")


def pages_of(folded: DataFrame) -> DataFrame:
    """``doc_id, page, status, notes``, counters, ``calls, complete``."""
    return folded.select(*KEY, "status", "notes", *COUNTERS, "calls", "complete")


def blocks_of(folded: DataFrame) -> DataFrame:
    """The merged blocks of every page; ``first_seq`` is their order."""
    x = folded.select(*KEY, F.explode("placed").alias("x"))
    x = x.select(*KEY, F.struct("x.round", "x.req", "x.pos").alias("seq"), "x.b.id", "x.b.type", "x.b.markdown", "x.b.box", "x.b.description", "x.b.asset")
    return merge_blocks(x)


def reread(answers: DataFrame, config: Config = Config()) -> dict[str, DataFrame]:
    """``pages`` and ``blocks`` of recorded answers; see ``pages_of`` and ``blocks_of``."""
    folded = state(answers, config)
    return {"pages": pages_of(folded), "blocks": blocks_of(folded)}


def page_requests(context: DataFrame) -> DataFrame:
    """The first request of every page of ``layout.context``."""
    text = prompts.page_request(F.col("variant"), F.col("page"), F.col("selected_page_count"))
    return context.select(*KEY, F.lit(0).alias("round"), F.lit(0).alias("req"), F.lit(1).alias("attempt"), F.lit("page").alias("kind"), text.alias("prompt"), "images")


def fallback_requests(context: DataFrame, answers: DataFrame) -> DataFrame:
    """Markdown requests for the pages whose own answer was none."""
    bad = answers.filter((F.col("kind") == "page") & ~F.col("read.ok")).select(*KEY)
    x = context.join(bad.hint("merge"), list(KEY), "left_semi")
    return x.select(*KEY, F.lit(0).alias("round"), F.lit(0).alias("req"), F.lit(1).alias("attempt"), F.lit("fallback").alias("kind"), prompts.fallback_request(F.col("page")).alias("prompt"), F.array("page").alias("images"))


def crop_requests(answers: DataFrame, config: Config, round_: int, attempt: int) -> DataFrame:
    """What a round asks for: grown boxes with their requests' texts."""
    x = state(answers, config, round_).select(*KEY, F.explode(F.filter("missing", lambda m: (m["round"] == round_) & (m["attempt"] == attempt))).alias("m"), "asked")
    z = F.get("asked", F.col("m.req") - 1)
    x = x.select(*KEY, F.lit(round_).alias("round"), "m.req", F.lit(attempt).alias("attempt"), F.lit("crop").alias("kind"), z.alias("z"))
    grown = F.struct(*[c.alias(k) for k, c in geometry.expand({k: F.col("z.box")[k] for k in ("xmin", "ymin", "xmax", "ymax")}).items()])
    x = x.withColumn("box", grown)
    text = prompts.crop_request(F.col("page"), F.col("box"), F.col("z.rotate_degrees"), F.col("z.reason"))
    return x.select(*KEY, "round", "req", "attempt", "kind", text.alias("prompt"), F.array("page").alias("images"), "box", F.col("z.rotate_degrees").alias("rotate"))


def ask(context: DataFrame, reader: Reader, config: Config = Config(), keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """All answers that the selected pages need, round by round.

    ``keep`` stores answers before anything depends on them (a table, a checkpoint);
    the default is for readers whose answers can be had again at no cost.
    """
    got = keep(parsed(reader.read(page_requests(context))))
    got = got.unionByName(keep(parsed(reader.read(fallback_requests(context, got)))))
    for r in range(1, config.max_zoom_rounds + 1):
        for attempt in (1, 2):
            got = got.unionByName(keep(parsed(reader.read(crop_requests(got, config, r, attempt)))))
    return got
