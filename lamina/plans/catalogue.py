"""The named queries of the layout engine and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, markup, text
from ..operators import export, layout, reread, usage
from ..schema import COUNTERS, VISUAL_TYPES, box_ok
from ..sources.readers import BLOCK_TAGS, HIDDEN_TAGS, HtmlReader, ReplayReader
from ..sources.tables import materialise
from .fixtures import BLOCKS_SQL, PAGES, REREAD_SQL, SOURCES_SQL, answers, blocks, quoted, read, sources

BOX = ("xmin", "ymin", "xmax", "ymax")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def sha(c) -> F.Column:
    return F.sha2(c, 256)


SUFFIX_SQL = r"lower(regexp_extract(filename, '^.+(\.[^.]+)$', 1))"


@query(rf"""WITH {SOURCES_SQL} SELECT doc_id, filename, {SUFFIX_SQL} AS suffix, CASE
  WHEN filename = '' OR contains(filename, '/') THEN 'NOT_A_FILE_NAME'
  WHEN length(filename) > 255 OR regexp_matches(filename, '[\x00-\x1f<>:"/\\|?*]') THEN 'UNSAFE_NAME'
  WHEN {SUFFIX_SQL} NOT IN ('.pdf', '.png', '.jpg', '.jpeg', '.webp', '.tif', '.tiff', '.bmp') THEN 'UNSUPPORTED_TYPE'
  WHEN length <= 0 THEN 'EMPTY' WHEN length > 209715200 THEN 'TOO_LARGE' ELSE 'ok' END AS verdict FROM sources""")
def input_verdict(spark, d):
    f = F.col("filename")
    return sources(spark, d).select("doc_id", "filename", text.suffix(f).alias("suffix"), text.input_verdict(f, F.col("length")).alias("verdict"))


@query(r"""WITH s AS (SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '[^\p{L}\p{N}_-]', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'document') AS s FROM pages)
SELECT page_id, s || '.md' AS markdown_name, s || '.json' AS json_name, s || '.html' AS html_name, s || '.annotated.pdf' AS pdf_name, s || '.outputs.zip' AS zip_name FROM s""")
def artifact_names(spark, d):
    return read(spark, d, "pages").select("page_id", *[c.alias(k) for k, c in text.artifact_names(F.concat("url", F.lit(".pdf"))).items()])


SP = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
ITEMS_SQL = rf"""{SOURCES_SQL}, t0 AS (SELECT doc_id, filename, page_spec, page_count AS n, regexp_replace(page_spec, '^{SP}+|{SP}+$', '', 'g') AS spec FROM sources),
i0 AS (SELECT doc_id, spec, n, regexp_replace(unnest(string_split(spec, ',')), '^{SP}+|{SP}+$', '', 'g') AS item, unnest(range(len(string_split(spec, ',')))) AS k FROM t0 WHERE spec IS NOT NULL),
i1 AS (SELECT *, TRY_CAST(regexp_extract(item, '^([0-9]+)', 1) AS BIGINT) AS low, coalesce(TRY_CAST(nullif(regexp_extract(item, '-{SP}*([0-9]+)$', 1), '') AS BIGINT), TRY_CAST(regexp_extract(item, '^([0-9]+)', 1) AS BIGINT)) AS high FROM i0),
i2 AS (SELECT *, CASE WHEN spec = '' THEN NULL WHEN item = '' THEN 'EMPTY_ITEM'
  WHEN NOT regexp_full_match(item, '[0-9]+({SP}*-{SP}*[0-9]+)?') THEN CASE WHEN contains(item, '-') THEN 'BAD_RANGE' ELSE 'BAD_PAGE' END
  WHEN contains(item, '-') AND low > high THEN 'REVERSED' WHEN low < 1 OR high > n THEN 'OUT_OF_RANGE' END AS code FROM i1),
e0 AS (SELECT doc_id, coalesce(min_by(code, k) FILTER (code <> 'OUT_OF_RANGE'), max(code) FILTER (code = 'OUT_OF_RANGE')) AS code FROM i2 GROUP BY doc_id),
e AS (SELECT t0.doc_id, filename, page_spec, spec, n, CASE WHEN page_spec IS NULL THEN 'NO_RANGE' ELSE code END AS code FROM t0 LEFT JOIN e0 USING (doc_id)),
sel AS (SELECT DISTINCT e.doc_id, CAST(unnest(CASE WHEN e.spec = '' THEN range(1, e.n + 1) ELSE range(low, high + 1) END) AS INTEGER) AS page FROM i2 JOIN e USING (doc_id) WHERE e.code IS NULL)"""


@query(f"WITH {ITEMS_SQL} SELECT doc_id, page FROM sel")
def page_selection(spark, d):
    return layout.select_pages(sources(spark, d))


@query(f"WITH {ITEMS_SQL} SELECT doc_id, page_spec, coalesce(code, 'ok') AS code FROM e")
def page_selection_errors(spark, d):
    s = sources(spark, d)
    return s.select("doc_id", "page_spec", F.coalesce(text.page_range_error(F.col("page_spec"), F.col("page_count")), F.lit("ok")).alias("code"))


@query(f"""WITH {ITEMS_SQL} SELECT doc_id, filename, list(page ORDER BY page) = [1] OR lower(filename) LIKE '_%.pdf' AS ok FROM sel JOIN e USING (doc_id) GROUP BY doc_id, filename""")
def image_selection(spark, d):
    s = sources(spark, d).select("doc_id", "filename", text.page_range(F.col("page_spec"), F.col("page_count")).alias("pages"))
    return s.filter("pages is not null").select("doc_id", "filename", text.selection_ok(F.col("filename"), F.col("pages")).alias("ok"))


@query("""WITH p AS (SELECT event_id, 100 + event_id % 5000 AS w, 100 + (event_id * 7) % 7000 AS h FROM events), q AS (SELECT *, (w * (300 / 72.0::DOUBLE)) * h * (300 / 72.0::DOUBLE) AS px FROM p)
SELECT event_id, CAST(round(CASE WHEN px > 20000000 THEN 300 / 72.0::DOUBLE * sqrt(20000000 / px) ELSE 300 / 72.0::DOUBLE END, 6) AS DECIMAL(18, 6)) AS scale, w * h <= 20000000 AS image_ok FROM q""")
def render_scale(spark, d):
    w, h = 100 + F.pmod("event_id", F.lit(5000)), 100 + F.pmod(F.col("event_id") * 7, F.lit(7000))
    return read(spark, d, "events").select("event_id", F.round(geometry.render_scale(w, h), 6).cast("decimal(18,6)").alias("scale"), geometry.image_ok(w, h).alias("image_ok"))


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, page, seq, id, type, sha256(markdown) AS md_sha256 FROM blocks")
def segment_blocks(spark, d):
    return blocks(spark, d).select("doc_id", "page", "seq", "id", "type", sha("markdown").alias("md_sha256"))


@query(f"""WITH {BLOCKS_SQL}, p AS (SELECT DISTINCT doc_id, page FROM blocks WHERE page % 4 <> 2),
w AS (SELECT doc_id, page, lag(page) OVER o AS previous_page, lead(page) OVER o AS next_page, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS selected_page_count FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY page))
SELECT *, CASE WHEN previous_page IS NOT NULL AND next_page IS NOT NULL THEN 'previous_next' WHEN previous_page IS NOT NULL THEN 'previous' WHEN next_page IS NOT NULL THEN 'next' ELSE 'target' END AS variant,
  concat_ws(',', previous_page, page, next_page) AS images FROM w""")
def page_context(spark, d):
    p = blocks(spark, d).filter(F.pmod("page", F.lit(4)) != 2).select("doc_id", "page").distinct()
    return layout.context(p).withColumn("images", F.array_join(F.col("images").cast("array<string>"), ","))


BOXES_SQL = f"""{BLOCKS_SQL}, b AS (SELECT doc_id, pos, (doc_id % 9) / 8.0::DOUBLE AS xmin, (pos % 9) / 8.0::DOUBLE AS ymin, (doc_id % 9 + pos % 4 - 1) / 8.0::DOUBLE AS xmax, (pos % 9 + doc_id % 3) / 8.0::DOUBLE AS ymax FROM blocks)"""


def boxes(spark, d):
    i, p = F.col("doc_id"), F.col("pos")
    m = lambda c, n: F.pmod(c, F.lit(n))
    return blocks(spark, d).select("doc_id", "pos", (m(i, 9) / 8.0).alias("xmin"), (m(p, 9) / 8.0).alias("ymin"), ((m(i, 9) + m(p, 4) - 1) / 8.0).alias("xmax"), ((m(p, 9) + m(i, 3)) / 8.0).alias("ymax"))


@query(f"WITH {BOXES_SQL} SELECT doc_id, CAST(pos AS INTEGER) AS pos, xmin BETWEEN 0 AND 1 AND ymin BETWEEN 0 AND 1 AND xmax BETWEEN 0 AND 1 AND ymax BETWEEN 0 AND 1 AND xmax > xmin AND ymax > ymin AS valid FROM b")
def block_validity(spark, d):
    return boxes(spark, d).select("doc_id", "pos", box_ok(*map(F.col, BOX)).alias("valid"))


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, page, id, 'assets/page-' || page || '-' || id || '.png' AS asset FROM blocks WHERE type IN ({quoted(VISUAL_TYPES)[1:-1]})")
def visual_assets(spark, d):
    return layout.name_assets(blocks(spark, d)).filter(F.col("asset").isNotNull()).select("doc_id", "page", "id", "asset")


@query(f"""WITH {BLOCKS_SQL}, r AS (SELECT doc_id, page, seq AS req, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY seq) AS INTEGER) AS turn FROM blocks WHERE length(markdown) % 3 <> 0) SELECT * FROM r WHERE turn <= 2""")
def zoom_budget(spark, d):
    r = blocks(spark, d).filter(F.pmod(F.char_length("markdown"), F.lit(3)) != 0).select("doc_id", "page", F.col("seq").alias("req"))
    return layout.zoom_budget(r, 2)


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, page, seq, round(greatest(0, xmin - 0.02), 6) AS xmin, round(greatest(0, ymin - 0.02), 6) AS ymin, round(least(1, xmax + 0.02), 6) AS xmax, round(least(1, ymax + 0.02), 6) AS ymax FROM blocks")
def expand_box(spark, d):
    got = geometry.expand({c: F.col(c) for c in BOX})
    return blocks(spark, d).select("doc_id", "page", "seq", *[F.round(c, 6).alias(k) for k, c in got.items()])


@query(f"""WITH {BLOCKS_SQL}, s AS (SELECT *, 20 + doc_id % 50 AS w, 10 + doc_id % 30 AS h FROM blocks) SELECT doc_id, page, seq, CAST(round_even(xmin * w, 0) AS INTEGER) AS xmin, CAST(round_even(ymin * h, 0) AS INTEGER) AS ymin,
  CAST(round_even(xmax * w, 0) AS INTEGER) AS xmax, CAST(round_even(ymax * h, 0) AS INTEGER) AS ymax FROM s""")
def crop_pixels(spark, d):
    w, h = 20 + F.pmod("doc_id", F.lit(50)), 10 + F.pmod("doc_id", F.lit(30))
    return blocks(spark, d).select("doc_id", "page", "seq", *[c.alias(k) for k, c in geometry.crop_pixels({c: F.col(c) for c in BOX}, w, h).items()])


@query(f"""WITH {BLOCKS_SQL}, s AS (SELECT *, 800 + doc_id % 100 AS w, 600 + page AS h FROM blocks) SELECT doc_id, page, seq, xmin * w AS x0, ymin * h AS y0, xmax * w AS x1, ymax * h AS y1, xmin * w + 2 AS label_x, greatest(10.0::DOUBLE, ymin * h + 10) AS label_y, id || ' · ' || type AS label FROM s""")
def overlay_geometry(spark, d):
    b = blocks(spark, d)
    rendered = b.select("doc_id", "page").distinct().select("doc_id", "page", (800 + F.pmod("doc_id", F.lit(100))).alias("width"), (600 + F.col("page")).alias("height"))
    return export.overlay(rendered, b)


@query(f"""WITH {BLOCKS_SQL}, m AS (SELECT doc_id, page, 'paragraph-' || (length(markdown) % 2) AS id, seq, markdown, type FROM blocks)
SELECT doc_id, page, id, min(seq) AS first_seq, max_by(type, seq) AS type, sha256(max_by(markdown, seq)) AS md_sha256 FROM m GROUP BY doc_id, page, id""")
def merge_blocks(spark, d):
    b = blocks(spark, d).select("doc_id", "page", F.concat(F.lit("paragraph-"), F.pmod(F.char_length("markdown"), F.lit(2)).cast("string")).alias("id"), "seq", "markdown", "type")
    return layout.merge_blocks(b).select("doc_id", "page", "id", "first_seq", "type", sha("markdown").alias("md_sha256"))


@query(f"WITH {REREAD_SQL} SELECT doc_id, page, codes, status, {', '.join(COUNTERS)}, calls, complete FROM outcome")
def reread_outcome(spark, d):
    x = reread.pages_of(reread.state(answers(spark, d)))
    return x.withColumn("codes", F.array_join(F.transform("notes", lambda n: n["code"]), ",")).drop("notes")


@query(f"WITH {REREAD_SQL} SELECT doc_id, page, id, first_seq, markdown FROM merged")
def reread_blocks(spark, d):
    x = reread.blocks_of(reread.state(answers(spark, d)))
    return x.select("doc_id", "page", "id", (F.col("first_seq.round") * 10000 + F.col("first_seq.req") * 100 + F.col("first_seq.pos")).alias("first_seq"), "markdown")


@query(f"""WITH {REREAD_SQL}, x AS (SELECT doc_id, page, 'page' AS kind, 0 AS round, 0 AS req, 1 AS attempt FROM pa UNION ALL SELECT doc_id, page, 'fallback', 0, 0, 1 FROM pa WHERE NOT p_ok
  UNION ALL SELECT doc_id, page, 'crop', round, req, 1 FROM cr UNION ALL SELECT doc_id, page, 'crop', round, req, 2 FROM cr WHERE NOT once) SELECT * FROM x""")
def reader_requests(spark, d):
    """What a reader is asked, round by round."""
    return asked(all_pages(spark, d), spark, d).select("doc_id", "page", "kind", "round", "req", "attempt")


def asked(pages, spark, d):
    """The answers to all requests of these pages, each round kept before the next asks."""
    recorded = materialise(answers(spark, d), "recorded")
    return reread.ask(pages, ReplayReader(recorded), keep=lambda df: materialise(df, "answers"))


def all_pages(spark, d):
    p = read(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(PAGES))).alias("page"))
    return layout.context(p)


# Of documents of three pages: the pages that their ranges select, as read, merged, assembled and exported.
SELECTED_SQL = ITEMS_SQL.replace("page_count AS n", f"{PAGES} AS n") + f", {REREAD_SQL}"


@query(rf"""WITH {SELECTED_SQL}, pgs AS (SELECT outcome.* FROM outcome JOIN sel USING (doc_id, page)),
b AS (SELECT m.doc_id, m.page, first_seq, trim(markdown) || CASE WHEN id = 'figure-0' THEN chr(10) || chr(10) || '![figure figure-0](assets/page-' || m.page || '-figure-0.png)' ELSE '' END AS md FROM merged m JOIN sel USING (doc_id, page)),
pm AS (SELECT doc_id, page, list(md ORDER BY first_seq) AS mds FROM b GROUP BY doc_id, page),
d AS (SELECT pgs.doc_id, flatten(list(CASE WHEN page = first_page THEN [] ELSE ['<!-- PAGE BREAK -->'] END || coalesce(mds, []) ORDER BY page)) AS parts, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'partial') THEN 'partial' ELSE 'ok' END AS status,
  CAST(sum(n) AS INTEGER) AS n_warnings, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(calls) AS BIGINT) AS calls, bool_and(complete) AS complete, CAST(count(*) AS INTEGER) AS n_pages FROM pgs LEFT JOIN pm USING (doc_id, page) JOIN (SELECT doc_id, min(page) AS first_page FROM sel GROUP BY doc_id) USING (doc_id) GROUP BY pgs.doc_id)
SELECT doc_id, e.filename, coalesce(status, 'ok') AS status, coalesce(n_warnings, 0) AS n_warnings, coalesce(n_pages, 0) AS n_pages, coalesce(input_tokens, 0) AS input_tokens, coalesce(calls, 0) AS calls, coalesce(complete, true) AS complete,
  sha256(coalesce(array_to_string(parts, chr(10) || chr(10)), '') || chr(10)) AS md_sha256 FROM e LEFT JOIN d USING (doc_id)""")
def document_results(spark, d):
    """From sources to results: selection, context, reader, rereads, assets, assembly, warnings, usage."""
    return results(spark, d).select("doc_id", "filename", "status", "n_warnings", F.size("view.pages").alias("n_pages"), "view.usage.input_tokens", "view.usage.calls", "view.usage.complete", sha("markdown").alias("md_sha256"))


def results(spark, d):
    s = sources(spark, d).withColumn("page_count", F.lit(PAGES))
    pages = materialise(layout.context(layout.select_pages(s)), "pages")
    folded = materialise(reread.state(asked(pages, spark, d)).select("doc_id", "page", "placed", "status", "notes", *COUNTERS, "calls", "complete"), "folded")
    read_ = reread.pages_of(folded).withColumns({"width": F.lit(850), "height": F.lit(1100)})
    blocks_ = layout.name_assets(reread.blocks_of(folded).withColumnRenamed("first_seq", "seq"))
    return export.document_view(s, read_, blocks_, "replay")


@query()
def document_files(spark, d):
    """The same results as files: Markdown, JSON and HTML of every document."""
    x = export.artifacts(results(spark, d))
    return x.select("doc_id", "name", F.length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"))


@query(f"""WITH {BLOCKS_SQL}, p AS (SELECT DISTINCT doc_id, page FROM blocks), w AS (SELECT doc_id, page, lag(page) OVER o AS a, lead(page) OVER o AS b, count(*) OVER (PARTITION BY doc_id) AS n FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY page))
SELECT doc_id, page, len(regexp_extract_all(txt, '[*][*][^*]+[*][*]')) AS images, regexp_extract(txt, 'page ([0-9]+ of [0-9]+)', 1) AS place, strpos(txt, '**the page to read**') AS target FROM (SELECT *, 'Read page ' || page || ' of ' || n || ': ' || CASE WHEN a IS NULL THEN '' ELSE 'image 1 is **the page before it, for context**; ' END
  || 'image ' || CASE WHEN a IS NULL THEN 1 ELSE 2 END || ' is **the page to read**' || CASE WHEN b IS NULL THEN '' ELSE '; image ' || CASE WHEN a IS NULL THEN 2 ELSE 3 END || ' is **the page after it, for context**' END AS txt FROM w)""")
def request_texts(spark, d):
    x = reread.page_requests(layout.context(blocks(spark, d).select("doc_id", "page").distinct()))
    said = F.col("prompt")
    return x.select("doc_id", "page", F.size(F.regexp_extract_all(said, F.lit(r"[*][*][^*]+[*][*]"), F.lit(0))).cast("bigint").alias("images"), F.regexp_extract(said, "page ([0-9]+ of [0-9]+)", 1).alias("place"), F.locate("**the page to read**", said).cast("bigint").alias("target"))


STATUS_SQL = "s AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'partial' ELSE 'ok' END AS status FROM events)"


def statuses(spark, d):
    kind = F.col("event_type")
    return read(spark, d, "events").select("user_id", "event_id", "event_type", F.when(kind == "error", "failed").when(kind == "click", "partial").otherwise("ok").alias("status"))


@query(f"WITH {STATUS_SQL} SELECT event_id, status FROM s")
def page_status(spark, d):
    e = read(spark, d, "events")
    warned = F.when(F.col("event_type") == "click", F.array(F.lit("MODEL_NOTE"))).otherwise(F.array().cast("array<string>"))
    return e.select("event_id", usage.page_status(F.col("event_type") == "error", warned).alias("status"))


@query(f"""WITH {STATUS_SQL} SELECT user_id, CAST(CASE WHEN bool_or(status = 'failed') THEN 1 WHEN bool_or(status = 'partial') THEN 2 ELSE 0 END AS INTEGER) AS exit_code, string_agg(DISTINCT status, ',' ORDER BY status) AS statuses FROM s GROUP BY user_id""")
def run_exit_code(spark, d):
    return usage.exit_code(statuses(spark, d), "user_id")


USAGE_SQL = """u AS (SELECT conv_id, turn, length(text) AS input_tokens, length(text) // 4 AS cached_input_tokens, length(text) // 8 AS cache_write_tokens, length(text) // 2 AS output_tokens, length(text) // 16 AS reasoning_tokens, 1 AS calls, turn % 7 <> 6 AS complete FROM conversations),
t AS (SELECT conv_id, """ + ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in (*COUNTERS, "calls")) + ", coalesce(bool_and(complete), true) AS complete FROM u GROUP BY conv_id)"


def turns(spark, d):
    n = F.char_length("text").cast("bigint")
    div = lambda k: F.call_function("div", n, F.lit(k).cast("bigint"))
    return read(spark, d, "conversations").select("conv_id", "turn", n.alias("input_tokens"), div(4).alias("cached_input_tokens"), div(8).alias("cache_write_tokens"), div(2).alias("output_tokens"), div(16).alias("reasoning_tokens"), F.lit(1).cast("bigint").alias("calls"), (F.pmod("turn", F.lit(7)) != 6).alias("complete"))


@query(f"WITH {USAGE_SQL} SELECT conv_id, turn, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in (*COUNTERS, "calls")) + ", bool_and(complete) AS complete FROM u GROUP BY conv_id, turn")
def usage_by_page(spark, d):
    return usage.totals(turns(spark, d), "conv_id", "turn")


@query(f"WITH {USAGE_SQL} SELECT * FROM t")
def usage_by_document(spark, d):
    return usage.totals(turns(spark, d), "conv_id")


@query(f"""WITH {USAGE_SQL} SELECT conv_id, input_tokens - cached_input_tokens - cache_write_tokens AS uncached, CASE WHEN complete THEN CAST(((input_tokens - cached_input_tokens - cache_write_tokens)::DECIMAL(20,0) * 2.00::DECIMAL(4,2) + cached_input_tokens::DECIMAL(20,0) * 0.20::DECIMAL(4,2)
 + cache_write_tokens::DECIMAL(20,0) * 2.50::DECIMAL(4,2) + output_tokens::DECIMAL(20,0) * 10.00::DECIMAL(4,2))::DECIMAL(24,2) * 0.000001::DECIMAL(7,6) AS DECIMAL(18,8)) END AS cost FROM t""")
def document_cost(spark, d):
    t = usage.totals(turns(spark, d), "conv_id")
    c = {k: F.col(k) for k in (*COUNTERS, "complete")}
    return t.select("conv_id", usage.uncached(c["input_tokens"], c["cached_input_tokens"], c["cache_write_tokens"]).alias("uncached"), usage.cost(c).alias("cost"))


STRIP_SQL = r"regexp_replace({}, '^[\s\x1c-\x1f\x0b\x85\p{{Z}}]+|[\s\x1c-\x1f\x0b\x85\p{{Z}}]+$', '', 'g')"


@query(f"""WITH {BLOCKS_SQL}, m AS (SELECT *, {STRIP_SQL.format("markdown")} || CASE WHEN type IN ({quoted(VISUAL_TYPES)[1:-1]}) THEN chr(10) || chr(10) || '![' || type || ' ' || id || '](assets/page-' || page || '-' || id || '.png)' ELSE '' END
  || CASE WHEN coalesce(description, '') <> '' THEN chr(10) || chr(10) || '*Generated description: ' || description || '*' ELSE '' END AS md FROM blocks),
p AS (SELECT doc_id, page, string_agg(md, chr(10) || chr(10) ORDER BY seq) AS md, count(*) AS n FROM m GROUP BY doc_id, page),
d AS (SELECT doc_id, string_agg(md, chr(10) || chr(10) || '<!-- PAGE BREAK -->' || chr(10) || chr(10) ORDER BY page) AS md, CAST(count(*) AS INTEGER) AS n_pages, CAST(sum(n) AS BIGINT) AS n_blocks FROM p GROUP BY doc_id)
SELECT doc_id, sha256({STRIP_SQL.format("md")} || chr(10)) AS md_sha256, n_pages, n_blocks FROM d""")
def document_markdown(spark, d):
    b = layout.name_assets(blocks(spark, d))
    x = layout.document_markdown(b.select("doc_id", "page").distinct(), b)
    return x.select("doc_id", sha("markdown").alias("md_sha256"), "n_pages", "n_blocks")


@query(f"""WITH {BLOCKS_SQL}, p AS (SELECT doc_id, page, list(id ORDER BY seq) FILTER (length(markdown) % 5 = 0) AS w FROM blocks GROUP BY doc_id, page)
SELECT doc_id, coalesce(string_agg(array_to_string(w, ','), ',' ORDER BY page) FILTER (w IS NOT NULL), '') AS warnings FROM p GROUP BY doc_id""")
def document_warnings(spark, d):
    b = blocks(spark, d)
    warned = F.array_sort(F.collect_list(F.when(F.pmod(F.char_length("markdown"), F.lit(5)) == 0, F.struct("seq", "id"))))
    p = b.groupBy("doc_id", "page").agg(F.transform(warned, lambda x: x["id"]).alias("warnings"))
    return layout.document_warnings(p).select("doc_id", F.array_join("warnings", ",").alias("warnings"))


@query("SELECT doc_id, sha256(text || '  [image: b ' || doc_id || '] c [d](HTTP://up.org) [e](/local) f') AS md_sha256 FROM documents WHERE NOT contains(text, '](')")
def safe_markdown(spark, d):
    links = [F.lit(" ![a](assets/page-1-figure-0.png) ![b "), F.col("doc_id").cast("string"), F.lit("](https://x.org/i.png) [c](javascript:alert) [d](HTTP://up.org) [e](/local) [f](data:x)")]
    x = read(spark, d, "documents").filter(~F.contains("text", F.lit("](")))
    return x.select("doc_id", sha(text.safe_markdown(F.concat("text", *links))).alias("md_sha256"))


HIDDEN_SQL = "regexp_replace(coalesce(html, ''), '<!--.*?-->', '', 'gs')"
for hidden in HIDDEN_TAGS:
    HIDDEN_SQL = rf"regexp_replace({HIDDEN_SQL}, '<{hidden}\b.*?</{hidden}\s*>', ' ', 'gis')"


@query(rf"""WITH x AS (SELECT page_id, string_split(regexp_replace({HIDDEN_SQL}, '<(/?(?:{"|".join(BLOCK_TAGS)})\b)', chr(1) || '<\1', 'gi'), chr(1)) AS parts FROM pages),
r AS (SELECT page_id, unnest(parts) AS raw, unnest(range(len(parts))) AS seq FROM x),
t AS (SELECT page_id, CAST(seq AS INTEGER) AS seq, lower(regexp_extract(raw, '^<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag, trim(regexp_replace(regexp_replace(raw, '<[^>]*>', ' ', 'g'), '[\s\x0b]+', ' ', 'g')) AS md FROM r)
SELECT page_id, seq, CASE WHEN regexp_full_match(tag, 'h[1-6]') THEN 'heading' WHEN tag = 'li' THEN 'list' WHEN tag IN ('td', 'th') THEN 'table' WHEN tag IN ('caption', 'figcaption') THEN 'caption' ELSE 'paragraph' END AS type, sha256(md) AS md_sha256 FROM t WHERE md <> ''""")
def html_blocks(spark, d):
    return HtmlReader().read(read(spark, d, "pages")).select("page_id", "seq", "type", sha("markdown").alias("md_sha256"))


@query()
def sanitized_html(spark, d):
    return read(spark, d, "pages").select("page_id", markup.clean_html(F.col("html")).alias("html"))


@query()
def html_export(spark, d):
    b = layout.name_assets(blocks(spark, d))
    x = layout.document_markdown(b.select("doc_id", "page").distinct(), b)
    return x.select("doc_id", markup.html_document(F.col("markdown"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("html"))


KEY_SQL = "k AS (SELECT doc_id, sha256(text || CASE doc_id % 3 WHEN 0 THEN '(1,)' WHEN 1 THEN '(1, 2)' ELSE '(1, 2, 3)' END) AS cache_key FROM documents)"


def keyed(spark, d):
    pages = F.sequence(F.lit(1), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    return read(spark, d, "documents").select("doc_id", text.content_key(F.col("text"), pages).alias("cache_key"))


@query(f"WITH {KEY_SQL} SELECT * FROM k")
def content_key(spark, d):
    return keyed(spark, d)


@query(f"WITH {KEY_SQL} SELECT * FROM k WHERE cache_key NOT IN (SELECT cache_key FROM k WHERE doc_id < 500)")
def uncached_sources(spark, d):
    k = keyed(spark, d)
    return layout.not_in_memo(k, k.filter("doc_id < 500")).select("doc_id", "cache_key")


@query(f"WITH {SOURCES_SQL} SELECT doc_id, filename AS name FROM sources WHERE filename IN (SELECT filename FROM sources WHERE doc_id % 5 = 0)")
def output_conflicts(spark, d):
    s = sources(spark, d).select("doc_id", F.col("filename").alias("name"))
    return layout.conflicts(s, s.filter("doc_id % 5 = 0")).select("doc_id", "name")


@query("""SELECT o_custkey AS batch, CAST(count(*) AS BIGINT) AS files, CAST(sum(b - a + 1) AS BIGINT) AS pages, count(*) <= 20 AND sum(b - a + 1) <= 100 AND bool_and(a <= b) AS ok FROM (SELECT o_custkey, o_orderkey % 7 + 1 AS a, o_orderkey % 5 + 1 + o_orderkey % 9 AS b FROM orders) GROUP BY 1""")
def batch_pages(spark, d):
    o, m = read(spark, d, "orders"), lambda n: F.pmod("o_orderkey", F.lit(n))
    o = o.select(F.col("o_custkey").alias("batch"), (m(7) + 1).alias("start"), (m(5) + 1 + m(9)).alias("end"))
    return layout.batch_limits(o, "batch")


ZERO = ", ".join(f"'{c}': 0" for c in (*COUNTERS, "calls"))


@query(rf"""WITH {BLOCKS_SQL}, b AS (SELECT *, CASE WHEN type IN ({quoted(VISUAL_TYPES)[1:-1]}) THEN 'assets/page-' || page || '-' || id || '.png' END AS asset FROM blocks),
m AS (SELECT *, {STRIP_SQL.format("markdown")} || CASE WHEN asset IS NOT NULL THEN chr(10) || chr(10) || '![' || type || ' ' || id || '](' || asset || ')' ELSE '' END || CASE WHEN description IS NOT NULL THEN chr(10) || chr(10) || '*Generated description: ' || description || '*' ELSE '' END AS md FROM b),
p AS (SELECT doc_id, page, list({{'id': id, 'type': type, 'markdown': markdown, 'box': {{'xmin': xmin, 'ymin': ymin, 'xmax': xmax, 'ymax': ymax}}, 'description': description, 'asset': asset}} ORDER BY seq) AS blocks, string_agg(md, chr(10) || chr(10) ORDER BY seq) AS md,
  CASE WHEN page % 3 = 0 THEN ['look here'] ELSE [] END AS w FROM m GROUP BY doc_id, page),
d AS (SELECT doc_id, list({{'page': page, 'width': 800, 'height': 600, 'blocks': blocks, 'warnings': w, 'status': CASE WHEN len(w) > 0 THEN 'partial' ELSE 'ok' END, 'usage': {{{ZERO}, 'complete': true}}}} ORDER BY page) AS pages,
  string_agg(md, chr(10) || chr(10) || '<!-- PAGE BREAK -->' || chr(10) || chr(10) ORDER BY page) AS md, flatten(list(w ORDER BY page)) AS w FROM p GROUP BY doc_id)
SELECT doc_id, sha256(CAST(to_json({{'version': '1.0', 'model': 'lines', 'source_filename': 'doc-' || doc_id || '.pdf', 'pages': pages, 'markdown': {STRIP_SQL.format("md")} || chr(10), 'warnings': w, 'usage': {{{ZERO}, 'complete': true}}}}) AS VARCHAR)) AS json_sha256 FROM d""")
def json_export(spark, d):
    b = layout.name_assets(blocks(spark, d)).withColumn("box", F.struct(*BOX))
    noted = F.when(F.pmod("page", F.lit(3)) == 0, F.array(reread.note("MODEL_NOTE", F.lit("look here")))).otherwise(reread.none(reread.NOTE))
    none = {c: F.lit(0).cast("bigint") for c in (*COUNTERS, "calls")} | {"complete": F.lit(True)}
    pages = b.select("doc_id", "page").distinct().withColumns({"width": F.lit(800), "height": F.lit(600), "notes": noted} | none)
    pages = pages.withColumn("status", usage.page_status(F.lit(False), F.col("notes")))
    s = read(spark, d, "documents").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"))
    return export.document_view(s, pages, b, "lines").select("doc_id", sha(export.json_text(F.col("view"))).alias("json_sha256"))
