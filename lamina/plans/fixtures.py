"""Tables of the layout contract derived from the shared test tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import BLOCK_TYPES, COUNTERS
from ..sources.readers import TextReader

# Suffixes and page ranges dealt out by document id.
FILE_ENDS = (".pdf", ".PNG", ".jpg", ".JPEG", ".webp", ".tif", ".TIFF", ".bmp", ".txt", "")
SPECS = ("", "1", "1-3", " 1 , 3 - 5 ", "5,5,4-6", "3-1", "1,,2", "1-", "0", "x", "1-99999999", "\t", "\u00a0", "1,\u00a02", "2\t-\u20033", None)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], key) -> F.Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), pick(FILE_ENDS, F.col("doc_id")))
    name = F.when(F.pmod("doc_id", F.lit(29)) == 0, F.concat(F.lit("in/"), name)).when(F.pmod("doc_id", F.lit(23)) == 0, F.concat(F.lit("a<b "), name)).otherwise(name)
    length = F.when(F.pmod("doc_id", F.lit(17)) == 0, 0).when(F.pmod("doc_id", F.lit(19)) == 0, 209715201).otherwise(F.col("n_chars")).cast("long")
    return d.select("doc_id", name.alias("filename"), length.alias("length"), pick(SPECS, F.col("doc_id")).alias("page_spec"), (1 + F.pmod("n_chars", F.lit(7))).cast("int").alias("page_count"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TextReader().read(read(spark, sf_dir, "documents"))


def quoted(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v + "'" for v in values) + "]"


SOURCES_SQL = f"""s0 AS (SELECT doc_id, n_chars, 'doc-' || doc_id || ({quoted(FILE_ENDS)})[doc_id % 10 + 1] AS f, ({quoted(SPECS)})[doc_id % 16 + 1] AS page_spec FROM documents),
sources AS (SELECT doc_id, CASE WHEN doc_id % 29 = 0 THEN 'in/' || f WHEN doc_id % 23 = 0 THEN 'a<b ' || f ELSE f END AS filename,
  CASE WHEN doc_id % 17 = 0 THEN 0 WHEN doc_id % 19 = 0 THEN 209715201 ELSE n_chars END AS length, page_spec, CAST(1 + n_chars % 7 AS INTEGER) AS page_count FROM s0)"""
BLOCKS_SQL = f"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS markdown, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
blocks AS (SELECT doc_id, CAST(pos // 4 + 1 AS INTEGER) AS page, CAST(pos % 4 AS INTEGER) AS seq, pos, ({quoted(BLOCK_TYPES)})[pos % 15 + 1] AS type, markdown,
  ({quoted(BLOCK_TYPES)})[pos % 15 + 1] || '-0' AS id, 0.125::DOUBLE AS xmin, (pos % 4) / 4.0::DOUBLE AS ymin, 0.875::DOUBLE AS xmax, (pos % 4) / 4.0::DOUBLE + 0.125::DOUBLE AS ymax,
  CASE WHEN ({quoted(BLOCK_TYPES)})[pos % 15 + 1] IN ('figure', 'chart') THEN 'line ' || pos END AS description FROM l)"""


# Recorded answers. Of page p of document d let v = 31 d + 17 p; of crop q of round r there let w = v + 5 r + 3 q.
# A page's own answer is none if v % 10 < 3 (cut off, an unknown field, five rereads); its fallback is blank if v % 4 = 0.
# A crop's first attempt is none if w % 3 = 0, its second if w % 6 = 0. All else follows from v and w as below.
PAGES = 3


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All answers that pages 1 to 3 of every document could need."""
    p = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(PAGES))).alias("page"))
    p = p.withColumn("v", F.col("doc_id") * 31 + F.col("page") * 17)
    m = lambda c, n: F.pmod(c, F.lit(n))
    box = lambda i: F.struct(F.lit(0.125).alias("xmin"), (m(i, 7) / 8.0).alias("ymin"), F.lit(0.875).alias("xmax"), ((m(i, 7) + 1) / 8.0).alias("ymax"))
    block = lambda kind, number, words, i: F.struct(F.concat(kind, F.lit("-"), number.cast("string")).alias("id"), kind.alias("type"), words.alias("markdown"), box(i).alias("box"))
    zooms = lambda n: F.transform(F.slice(F.sequence(F.lit(0), F.lit(4)), F.lit(1), n.cast("int")), lambda i: F.struct(box(i).alias("box"), F.lit("small text").alias("reason"), (m(i, 4) * 90).alias("rotate_degrees")))
    some = lambda on, words: F.when(on, F.array(F.lit(words))).otherwise(F.array().cast("array<string>"))
    counters = lambda base, x: [(base + m(x, 7 + i)).cast("bigint").alias(c) for i, c in enumerate(COUNTERS)]
    key = lambda r, q, a, kind: ["doc_id", "page", F.lit(r).cast("int").alias("round") if isinstance(r, int) else r, q, a, F.lit(kind).alias("kind")]
    v = F.col("v")
    own = F.transform(F.sequence(F.lit(0).cast("bigint"), m(v, 3)), lambda i: block(F.when(m(v + i, 5) == 0, "figure").otherwise("paragraph"), F.when(m(v + i, 5) == 0, 0).otherwise(m(v + i, 2)), F.concat(F.lit(" Page "), F.col("page").cast("string"), F.lit(" text "), i.cast("string")), i))
    whole = F.to_json(F.struct(own.alias("blocks"), some(m(v, 7) == 3, "faint text").alias("warnings"), zooms(F.when(m(v, 10) == 2, 5).otherwise(m(v, 5))).alias("zoom_requests")))
    raw = F.when(m(v, 10) == 0, F.left(whole, F.length(whole) - 1)).when(m(v, 10) == 1, F.concat(F.lit('{"extra":1,'), F.substring(whole, 2, 1_000_000))).otherwise(whole)
    nil, one = F.lit(0).alias("req"), F.lit(1).alias("attempt")
    out = p.select(*key(0, nil, one, "page"), raw.alias("raw"), *counters(F.lit(100), v), (m(v, 13) != 5).alias("has_usage"))
    blank = F.when(m(v, 4) == 0, " \n").otherwise(F.concat(F.lit(" # Page "), F.col("page").cast("string")))
    out = out.unionByName(p.filter(m(v, 10) < 3).select(*key(0, nil, one, "fallback"), blank.alias("raw"), *counters(F.lit(200), v), F.lit(True).alias("has_usage")))
    c = p.withColumn("round", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("req", F.explode(F.sequence(F.lit(1), F.lit(4)))).withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2))))
    w = F.col("v") + F.col("round") * 5 + F.col("req") * 3
    new = F.transform(F.sequence(F.lit(0).cast("bigint"), m(w, 2)), lambda i: block(F.lit("paragraph"), m(w + i, 4), F.concat_ws(" ", F.lit("crop"), "round", "req", i.cast("string")), i))
    part = F.to_json(F.struct(new.alias("replacement_blocks"), some(m(w, 5) == 1, "unsure").alias("warnings"), zooms(m(w, 4)).alias("needs_another_zoom")))
    bad = F.when(F.col("attempt") == 1, m(w, 3) == 0).otherwise(m(w, 6) == 0)
    return out.unionByName(c.select(*key(F.col("round"), "req", "attempt", "crop"), F.when(bad, F.left(part, F.length(part) - 2)).otherwise(part).alias("raw"), *counters(50 + F.col("attempt"), w), (m(w, 17) != 4).alias("has_usage")))


_CROP = "{r} AS round, CAST(q AS INTEGER) AS req, v + 5 * {r} + 3 * q AS w"
REREAD_SQL = f"""pg AS (SELECT doc_id, CAST(page AS INTEGER) AS page, doc_id * 31 + page * 17 AS v FROM documents, range(1, {PAGES + 1}) t(page)),
pa AS (SELECT *, v % 10 > 2 AS p_ok, v % 10 <= 2 AND v % 4 <> 0 AS f_ok, CASE WHEN v % 10 > 2 THEN v % 5 ELSE 0 END AS n0 FROM pg),
c1 AS (SELECT doc_id, page, n0, v, {_CROP.format(r=1)} FROM pa, LATERAL (SELECT unnest(range(1, n0 + 1)) AS q)),
s1 AS (SELECT doc_id, page, any_value(n0) AS n0, any_value(v) AS v, sum(CASE WHEN w % 6 <> 0 THEN w % 4 ELSE 0 END) AS n1 FROM c1 GROUP BY doc_id, page),
c2 AS (SELECT doc_id, page, n0, v, {_CROP.format(r=2)} FROM s1, LATERAL (SELECT unnest(range(1, CAST(least(n1, 4 - n0) AS BIGINT) + 1)) AS q)),
cr AS (SELECT *, w % 3 <> 0 AS once, w % 6 <> 0 AS ok, CASE WHEN w % 3 <> 0 THEN 51 ELSE 52 END AS base, w % 17 <> 4 AS has FROM (SELECT * FROM c1 UNION ALL SELECT * FROM c2)),
left_over AS (SELECT s1.doc_id, s1.page FROM s1 LEFT JOIN (SELECT doc_id, page, sum(CASE WHEN w % 6 <> 0 THEN w % 4 ELSE 0 END) AS n2 FROM c2 GROUP BY doc_id, page) USING (doc_id, page) WHERE CASE WHEN n0 = 4 THEN n1 ELSE coalesce(n2, 0) END > 0),
nt AS (SELECT doc_id, page, 0 AS k, 0 AS q, 0 AS j, CASE WHEN f_ok THEN 'PAGE_RECOVERED_MARKDOWN' ELSE 'PAGE_FAILED' END AS code, NULL AS detail FROM pa WHERE NOT p_ok
  UNION ALL SELECT doc_id, page, 0, 0, 1, 'MODEL_NOTE', 'faint text' FROM pa WHERE p_ok AND v % 7 = 3
  UNION ALL SELECT doc_id, page, round, req, 0, CASE WHEN ok THEN 'CROP_RETRIED' ELSE 'CROP_FAILED' END, NULL FROM cr WHERE NOT once
  UNION ALL SELECT doc_id, page, round, req, 1, 'MODEL_NOTE', 'unsure' FROM cr WHERE ok AND w % 5 = 1
  UNION ALL SELECT doc_id, page, 9, 0, 0, 'REREAD_LIMIT', NULL FROM left_over),
cs AS (SELECT doc_id, page, {", ".join(f"sum(CASE WHEN ok AND has THEN base + w % {7 + i} ELSE 0 END) AS {c}" for i, c in enumerate(COUNTERS))}, sum(CASE WHEN once THEN 1 ELSE 2 END) AS calls, bool_and(once AND has) AS complete FROM cr GROUP BY doc_id, page),
ns AS (SELECT doc_id, page, string_agg(code, ',' ORDER BY k, q, j) AS codes, count(*) AS n FROM nt GROUP BY doc_id, page),
outcome AS (SELECT pa.doc_id, pa.page, coalesce(codes, '') AS codes, CASE WHEN NOT p_ok AND NOT f_ok THEN 'failed' WHEN codes IS NOT NULL THEN 'partial' ELSE 'ok' END AS status, coalesce(n, 0) AS n,
  {", ".join(f"CAST(CASE WHEN p_ok AND v % 13 <> 5 THEN 100 + v % {7 + i} WHEN NOT p_ok AND f_ok THEN 200 + v % {7 + i} ELSE 0 END + coalesce(cs.{c}, 0) AS BIGINT) AS {c}" for i, c in enumerate(COUNTERS))},
  CAST(CASE WHEN p_ok THEN 1 ELSE 2 END + coalesce(cs.calls, 0) AS BIGINT) AS calls, p_ok AND v % 13 <> 5 AND coalesce(cs.complete, true) AS complete
  FROM pa LEFT JOIN cs USING (doc_id, page) LEFT JOIN ns USING (doc_id, page)),
bl AS (SELECT doc_id, page, 0 AS round, 0 AS req, CAST(pos AS INTEGER) AS pos, CASE WHEN (v + pos) % 5 = 0 THEN 'figure-0' ELSE 'paragraph-' || ((v + pos) % 2) END AS id, ' Page ' || page || ' text ' || pos AS markdown FROM pa, LATERAL (SELECT unnest(range(0, v % 3 + 1)) AS pos) WHERE p_ok
  UNION ALL SELECT doc_id, page, 0, 0, 0, 'paragraph-0', '# Page ' || page FROM pa WHERE f_ok
  UNION ALL SELECT doc_id, page, round, req, CAST(pos AS INTEGER), 'paragraph-' || ((w + pos) % 4), 'crop ' || round || ' ' || req || ' ' || pos FROM cr, LATERAL (SELECT unnest(range(0, w % 2 + 1)) AS pos) WHERE ok),
merged AS (SELECT doc_id, page, id, min(round * 10000 + req * 100 + pos) AS first_seq, max_by(markdown, round * 10000 + req * 100 + pos) AS markdown FROM bl GROUP BY doc_id, page, id)"""
