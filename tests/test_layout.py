"""The layout engine: expressions against plain Python, queries against SQL, the reread machine against a model."""

import base64
import io
import json
import struct
import zipfile
import zlib
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions import answers, geometry, markup, prompts, raster, text
from lamina.operators import export, layout, reread, usage
from lamina.plans import catalogue
from lamina.schema import COUNTERS, Config, block_ok, keys_within, zoom_ok
from lamina.sources import files, tables
from lamina.sources.readers import ReplayReader
from lamina.streaming import incremental

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_agrees_with_sql(spark, sf, duck, name):
    got = catalogue.queries()[name](spark, sf)
    names = sorted(got.columns)
    found = duck.execute(catalogue.oracle_sql()[name])
    cols = [c[0] for c in found.description]
    assert names == sorted(cols)
    want = sorted(repr(tuple(dict(zip(cols, r))[c] for c in names)) for r in found.fetchall())
    assert sorted(repr(tuple(r[c] for c in names)) for r in got.collect()) == want


def plain_range(spec, n):
    if spec is None:
        return None
    if not spec.strip():
        return list(range(1, n + 1))
    out = set()
    for part in spec.split(","):
        ends = [p.strip() for p in part.split("-")]
        if not part.strip() or len(ends) > 2 or not all(p.isascii() and p.isdigit() for p in ends):
            return None
        low, high = int(ends[0]), int(ends[-1])
        if low > high or low < 1 or high > n:
            return None
        out.update(range(low, high + 1))
    return sorted(out)


def test_page_ranges(spark):
    specs = ["\t", "\u00a0", "1,\u00a02", "\u20031\u2003-\t2\x1f", None, "", " ", "1", "3-5", "5-3", "1,,2", "1-2-3", " 2 , 4-5 ", "0", "7", "99999999999999999999", "1-99999999", "-1", "x", "2,2,1", "+3", "1 - 3", "1,"]
    rows = [(s, n) for s in specs for n in (1, 5)]
    df = spark.createDataFrame(rows, "s string, n int")
    got = df.select("s", "n", text.page_range(F.col("s"), F.col("n")).alias("p")).collect()
    assert [r.p for r in got] == [plain_range(r.s, r.n) for r in got]
    codes = df.withColumn("n", F.lit(None).cast("int")).union(df).select("s", "n", text.page_range_error(F.col("s"), F.col("n")).alias("c"), text.page_range(F.col("s"), F.col("n")).alias("p")).collect()
    assert all((r.c is None) == (r.p is not None) for r in codes) and {r.c for r in codes if r.s is None} == {"NO_RANGE"}
    one = spark.createDataFrame([("a.png", [1]), ("a.png", [1, 2]), ("a.png", [2]), ("a.PDF", [2]), ("a.png", None)], "f string, p array<int>")
    assert [r[0] for r in one.select(text.selection_ok(F.col("f"), F.col("p"))).collect()] == [True, False, False, True, False]


def test_verdicts_and_names(spark):
    rows = [("a.pdf", 1), ("A.PNG", 1), (".pdf", 1), ("..pdf", 1), ("", 1), (None, 1), ("x/y.pdf", 1), ("a?.pdf", 1), ("a\x01.pdf", 1), ("b" * 252 + ".pdf", 1), ("a.txt", 1), ("a.pdf", 0), ("a.pdf", 209715201)]
    df = spark.createDataFrame(rows, "f string, n long")
    got = [r[0] for r in df.select(text.input_verdict(F.col("f"), F.col("n"))).collect()]
    assert got == ["ok", "ok", "UNSUPPORTED_TYPE", "ok", "NOT_A_FILE_NAME", "NOT_A_FILE_NAME", "NOT_A_FILE_NAME", "UNSAFE_NAME", "UNSAFE_NAME", "UNSAFE_NAME", "UNSUPPORTED_TYPE", "EMPTY", "TOO_LARGE"]
    stems = [r[0] for r in spark.createDataFrame([("a b.pdf",), ("--é_1--.pdf",), ("...pdf",)], "f string").select(text.safe_stem(F.col("f"))).collect()]
    assert stems == ["a-b", "é_1", "document"]


def test_endpoint_key_loopback_and_errors(spark):
    urls = ["https://api.a.org/v1", "https://eu.api.a.org", "http://api.a.org/v1", "https://api.a.org:443/v1/", "https://api.a.org:8443/v1", "https://u:p@api.a.org/v1", "https://api.a.org/v1?x=1", "https://api.a.org.evil.com/v1", "https://api.a.org/v2"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(text.endpoint_ok(F.col("u"), "api.a.org")).collect()] == [True, True, False, True, False, False, False, False, False]
    df = spark.createDataFrame([("localhost",), ("127.0.0.1",), ("::1",), ("0.0.0.0",), (None,), ("127.0.0.256",)], "a string")
    assert [r[0] for r in df.select(text.loopback(F.col("a"))).collect()] == [True, True, True, False, False, False]
    df = spark.createDataFrame([("k",), (" k",), ("k\n",), ("",), (None,), ("k\x7f",), ("k\x01",)], "k string")
    assert [r[0] for r in df.select(text.key_ok(F.col("k"))).collect()] == [True, False, False, False, False, True, False]
    df = spark.createDataFrame([("RuntimeError", "Required x"), ("ValueError", "Required x"), ("RuntimeError", "/tmp/y")], "k string, m string")
    got = [r[0] for r in df.select(text.public_error(F.col("k"), F.col("m"), ("Required",))).collect()]
    assert got[0] == "Required x" and got[1] == got[2] != "/tmp/y"


def test_contract_checks(spark):
    df = spark.createDataFrame([("p-0", "paragraph", "x", 0.1, 0.1, 0.2, 0.2), ("p-0\n", "paragraph", "x", 0.1, 0.1, 0.2, 0.2), ("p-0", "poem", "x", 0.1, 0.1, 0.2, 0.2), ("p-0", "list", "", 0.1, 0.1, 0.2, 0.2), ("p-0", "list", "x", 0.8, 0.1, 0.2, 0.2), ("p-0", "list", "x", float("nan"), 0.1, 0.2, 0.2), ("p-0", "list", "x", 0.1, 0.1, None, 0.2)], "i string, t string, m string, a double, b double, c double, d double")
    box = F.struct(F.col("a").alias("xmin"), F.col("b").alias("ymin"), F.col("c").alias("xmax"), F.col("d").alias("ymax"))
    assert [r[0] for r in df.select(block_ok(F.col("i"), F.col("t"), F.col("m"), box)).collect()] == [True, False, False, False, False, False, False]
    df = spark.createDataFrame([('{"a":1}',), ('{"a":1,"z":2}',), ("{",), (None,), ("[]",)], "r string")
    assert [r[0] for r in df.select(keys_within(F.col("r"), ("a", "b"))).collect()] == [True, False, False, False, False]
    df = spark.createDataFrame([("r", 90, 0.1), ("", 90, 0.1), ("r" * 201, 0, 0.1), ("r", 45, 0.1), ("r", 0, 0.9), (None, 0, 0.1)], "r string, t int, x double")
    box = F.struct(F.col("x").alias("xmin"), F.lit(0.1).alias("ymin"), F.lit(0.5).alias("xmax"), F.lit(0.5).alias("ymax"))
    assert [r[0] for r in df.select(zoom_ok(F.col("r"), F.col("t"), box)).collect()] == [True, False, False, False, False, False]
    for bad in ({"dpi": 100}, {"max_zoom_rounds": 3}, {"max_crops_per_page": 5}, {"timeout_seconds": 901}):
        with pytest.raises(ValueError):
            Config(**bad)


def test_cost_is_exact_and_missing_if_incomplete(spark):
    df = spark.createDataFrame([(1000001, 7, 3, 11, True), (10, 0, 0, 5, False)], "input_tokens long, cached_input_tokens long, cache_write_tokens long, output_tokens long, complete boolean")
    got = [r[0] for r in df.select(usage.cost({c: F.col(c) for c in df.columns})).collect()]
    want = (Decimal(1000001 - 7 - 3) * 2 + 7 * Decimal("0.20") + 3 * Decimal("2.50") + 11 * 10) / 1_000_000
    assert got == [want, None]


def test_markdown_of_documents(spark):
    blocks = spark.createDataFrame([(1, 1, 0, "heading-0", "heading", " # A ", None, None), (1, 3, 0, "figure-0", "figure", "B", "assets/f.png", "a map")], "doc_id long, page int, seq int, id string, type string, markdown string, asset string, description string")
    pages = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1)], "doc_id long, page int")
    got = {r.doc_id: r.markdown for r in layout.document_markdown(pages, blocks).collect()}
    assert got[1] == "# A\n\n<!-- PAGE BREAK -->\n\n<!-- PAGE BREAK -->\n\nB\n\n![figure figure-0](assets/f.png)\n\n*Generated description: a map*\n"
    assert got[2] == "\n"


def test_merge_keeps_place_and_takes_last(spark):
    b = spark.createDataFrame([(1, 1, 0, "a-0", "Old"), (1, 1, 1, "b-0", "B"), (1, 1, 2, "a-0", "Exact"), (1, 1, 3, "c-0", "New")], "doc_id long, page int, seq int, id string, markdown string")
    got = layout.merge_blocks(b).orderBy("first_seq").collect()
    assert [(r.id, r.markdown) for r in got] == [("a-0", "Exact"), ("b-0", "B"), ("c-0", "New")]


BOX = {"xmin": 0.1, "ymin": 0.1, "xmax": 0.9, "ymax": 0.9}
ANSWER = "doc_id long, page int, round int, req int, attempt int, kind string, raw string, " + ", ".join(f"{c} long" for c in COUNTERS) + ", has_usage boolean"


def block(i, words, **more):
    return {"id": i, "type": "paragraph", "markdown": words, "box": BOX} | more


def page_answer(blocks=(), zooms=0, notes=()):
    return json.dumps({"blocks": list(blocks), "warnings": list(notes), "zoom_requests": [{"box": BOX, "reason": "small"}] * zooms})


def crop_answer(blocks=(), zooms=0, notes=()):
    return json.dumps({"replacement_blocks": list(blocks), "warnings": list(notes), "needs_another_zoom": [{"box": BOX, "reason": "small"}] * zooms})


def rows_of(page, own, fallback=None, crops=None, has_usage=True):
    """Answers of one page: ``crops`` maps (round, request) to its attempts."""
    out = [(1, page, 0, 0, 1, "page", own, 10, 0, 0, 5, 0, has_usage)]
    if fallback is not None:
        out.append((1, page, 0, 0, 1, "fallback", fallback, 7, 0, 0, 3, 0, True))
    return out + [(1, page, r, q, k + 1, "crop", raw, 10, 0, 0, 5, 0, True) for (r, q), tries in (crops or {}).items() for k, raw in enumerate(tries)]


# name: (answers, config) -> (status, codes, calls, complete, input tokens, blocks)
CASES = {
    "one reading": ((page_answer([block("paragraph-0", "A")]),), {}, ("ok", [], 1, True, 10, [("paragraph-0", "A")])),
    "a crop corrects in place": ((page_answer([block("paragraph-0", "Old"), block("paragraph-1", "B")], 1), None, {(1, 1): [crop_answer([block("paragraph-0", "Exact")])]}), {}, ("ok", [], 2, True, 20, [("paragraph-0", "Exact"), ("paragraph-1", "B")])),
    "a new block comes last": ((page_answer([block("list-0", "A")], 1), None, {(1, 1): [crop_answer([block("heading-0", "H")])]}), {}, ("ok", [], 2, True, 20, [("list-0", "A"), ("heading-0", "H")])),
    "an id twice in one answer": ((page_answer([block("list-0", "A"), block("list-1", "B"), block("list-0", "C")]),), {}, ("ok", [], 1, True, 10, [("list-0", "C"), ("list-1", "B")])),
    "a note alone is partial": ((page_answer([block("list-0", "A")], 0, ["faint"]),), {}, ("partial", ["MODEL_NOTE"], 1, True, 10, [("list-0", "A")])),
    "recovered": ((page_answer()[:-1], " # H "), {}, ("partial", ["PAGE_RECOVERED_MARKDOWN"], 2, False, 7, [("paragraph-0", "# H")])),
    "both fail": (("{", " "), {}, ("failed", ["PAGE_FAILED"], 2, False, 0, [])),
    "no usage": ((page_answer([block("list-0", "A")]), None, None, False), {}, ("ok", [], 1, False, 0, [("list-0", "A")])),
    "second attempt": ((page_answer([], 1), None, {(1, 1): ["{", crop_answer([block("list-0", "A")], 0, ["dim"])]}), {}, ("partial", ["CROP_RETRIED", "MODEL_NOTE"], 3, False, 20, [("list-0", "A")])),
    "crop fails": ((page_answer([block("list-0", "A")], 1), None, {(1, 1): ["{", "{"]}), {}, ("partial", ["CROP_FAILED"], 3, False, 10, [("list-0", "A")])),
    "crops ask for more than the budget": ((page_answer([], 2), None, {(1, 1): [crop_answer([], 4)], (1, 2): [crop_answer([], 4)], (2, 1): [crop_answer()], (2, 2): [crop_answer()]}), {}, ("ok", [], 5, True, 50, [])),
    "still open after two rounds": ((page_answer([], 1), None, {(1, 1): [crop_answer([], 1)], (2, 1): [crop_answer([], 1)]}), {}, ("partial", ["REREAD_LIMIT"], 3, True, 30, [])),
    "budget spent in round one": ((page_answer([], 4), None, {(1, q): [crop_answer([], 1)] for q in (1, 2, 3, 4)}), {}, ("partial", ["REREAD_LIMIT"], 5, True, 50, [])),
    "no rounds": ((page_answer([], 1),), {"max_zoom_rounds": 0}, ("partial", ["REREAD_LIMIT"], 1, True, 10, [])),
    "no crops": ((page_answer([], 1),), {"max_crops_per_page": 0}, ("ok", [], 1, True, 10, [])),
    "five rereads are no answer": ((page_answer([], 5), "x"), {}, ("partial", ["PAGE_RECOVERED_MARKDOWN"], 2, False, 7, [("paragraph-0", "x")])),
}


def test_rereads(spark):
    by: dict = {}
    for i, (name, (given, config, _)) in enumerate(CASES.items()):
        by.setdefault(tuple(config.items()), []).append((name, i, rows_of(i, *given)))
    for config, some in by.items():
        folded = reread.state(spark.createDataFrame([r for _, _, rows in some for r in rows], ANSWER), Config(**dict(config)))
        blocks: dict = {}
        for b in reread.blocks_of(folded).orderBy("page", "first_seq").collect():
            blocks.setdefault(b.page, []).append((b.id, b.markdown))
        pages = {p.page: p for p in reread.pages_of(folded).collect()}
        for name, i, _ in some:
            p = pages[i]
            assert (p.status, [n.code for n in p.notes], p.calls, p.complete, p.input_tokens, blocks.get(i, [])) == CASES[name][2], name
    assert folded._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2


def test_a_reader_is_asked_only_for_what_is_needed(spark):
    rows = [r for i, (given, config, _) in enumerate(CASES.values()) for r in rows_of(i, *given) if not config]
    recorded = spark.createDataFrame(rows, ANSWER).cache()
    seen = []

    class Asked:
        def read(self, requests):
            seen.append(requests)
            return requests.select("doc_id", "page", "round", "req", "attempt", "kind").join(recorded, ["doc_id", "page", "round", "req", "attempt", "kind"])

    pages = layout.context(recorded.select("doc_id", "page").distinct())
    got = reread.ask(pages, Asked(), keep=lambda df: spark.createDataFrame(df.collect(), df.schema))
    # answers that no page asked for aren't read
    unasked = recorded.count() - got.count()
    assert unasked == 0 and {r.kind for r in got.collect()} == {"page", "fallback", "crop"}
    crops = [r for x in seen[2:] for r in x.collect()]
    assert all(abs(r.box.xmin - 0.08) < 1e-9 and abs(r.box.ymax - 0.92) < 1e-9 and '"xmin":0.08' in r.prompt and "small" in r.prompt for r in crops) and crops


def test_requests_and_answers_are_never_broadcast(spark, sf):
    """Both grow with the documents, and small keys look small: at any threshold they are merged."""
    plans = []

    def keep(df):
        rows = df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return spark.createDataFrame(rows, df.schema)

    pages = catalogue.all_pages(spark, sf).filter("doc_id < 20")
    got = reread.ask(pages, ReplayReader(catalogue.answers(spark, sf).filter("doc_id < 20").cache()), keep=keep)
    assert {(r["kind"], r["round"], r["attempt"]) for r in got.collect()} == {("page", 0, 1), ("fallback", 0, 1), *(("crop", r, a) for r in (1, 2) for a in (1, 2))}
    assert len(plans) == 6 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)


def test_raw_answers_are_read_strictly():
    good = {"blocks": [block("a_b-0", "x", description=None, asset="f.png")], "warnings": ["w"], "zoom_requests": [{"box": BOX, "reason": "r", "rotate_degrees": 90}]}
    got = answers.answer("page", json.dumps(good))
    assert got["ok"] and got["blocks"][0]["asset"] == "f.png" and got["requests"][0]["rotate_degrees"] == 90 and got["warnings"] == ["w"]
    assert answers.answer("page", '{"blocks": []}')["ok"] and answers.answer("crop", "{}")["ok"] and not answers.answer("page", "{}")["ok"]
    assert answers.answer("page", json.dumps({"blocks": [block("a-0", "x", box=BOX | {"xmin": "0.5"})]}))["blocks"][0]["box"]["xmin"] == 0.5
    bad = [
        {"blocks": [], "more": 1}, {"blocks": [block("a-0", "x", colour="red")]}, {"blocks": [block("a-0", "")]}, {"blocks": [block("A-0", "x")]}, {"blocks": [block("a-0\n", "x")]}, {"blocks": [block("a-0", "x", type="poem")]},
        {"blocks": [block("a-0", 5)]}, {"blocks": [block("a-0", "x", box=BOX | {"xmin": 0.95})]}, {"blocks": [block("a-0", "x", box=BOX | {"xmax": 1.1})]}, {"blocks": [block("a-0", "x", box=BOX | {"ymin": "top"})]}, {"blocks": [block("a-0", "x", box=BOX | {"z": 1})]},
        {"blocks": [], "warnings": [1]}, {"blocks": [], "warnings": None}, {"blocks": [], "zoom_requests": [{"box": BOX, "reason": ""}]}, {"blocks": [], "zoom_requests": [{"box": BOX, "reason": "r" * 201}]}, {"blocks": [], "zoom_requests": [{"box": BOX, "reason": "r", "rotate_degrees": 45}]}, {"blocks": None}, [], "x", None, 3,
    ]
    for x in bad:
        assert not answers.answer("page", json.dumps(x))["ok"], x
    for raw in ("", "{", '{"blocks": []} x', "[" * 100_000, '{"blocks": [{"id": "a-0", "type": "list", "markdown": "x", "box": {"xmin": NaN, "ymin": 0, "xmax": 1, "ymax": 1}}]}', None):
        assert not answers.answer("page", raw)["ok"]


def test_request_texts_tell_the_images(spark):
    pages = spark.createDataFrame([(v, 4, 9) for v in prompts.SHOWN], "v string, p int, n int")
    got = {r.v: r.t for r in pages.select("v", prompts.page_request(F.col("v"), F.col("p"), F.col("n")).alias("t")).collect()}
    assert all("page 4 of 9" in t and "{" not in t for t in got.values())
    assert {v: t.count("**") // 2 for v, t in got.items()} == {"target": 1, "previous": 2, "next": 2, "previous_next": 3}


def test_outputs_of_a_document(spark):
    """A figure with a script in its text: JSON, HTML with the image inside, ZIP with all of it."""
    pixels = np.zeros((100, 200, 3), np.uint8)
    images = spark.createDataFrame([(1, 1, pixels.tobytes(), 100, 200, 3)], "doc_id long, page int, data binary, height int, width int, channels int")
    box = "box struct<xmin:double,ymin:double,xmax:double,ymax:double>"
    blocks = spark.createDataFrame([(1, 1, 0, "figure-0", "figure", "<script>x</script>Visible", (0.0, 0.0, 1.0, 0.5), None)], f"doc_id long, page int, seq int, id string, type string, markdown string, {box}, description string")
    counters = [(1, 1, 200, 100, "partial", [("MODEL_NOTE", "dim"), ("CROP_FAILED", None)], 10, 0, 0, 5, 0, 2, False)]
    pages = spark.createDataFrame(counters, "doc_id long, page int, width int, height int, status string, notes array<struct<code:string,detail:string>>, " + ", ".join(f"{c} long" for c in COUNTERS) + ", calls long, complete boolean")
    sources = spark.createDataFrame([(1, "a sample.png"), (2, "none.pdf")], "doc_id long, filename string")
    named = layout.name_assets(blocks)
    views = export.document_view(sources, pages, named, "any-reader")
    assets = export.crops(named, images)
    out = export.artifacts(views, assets)
    by = {(r.doc_id, r.name): bytes(r.content) for r in out.collect()}
    asset = "assets/page-1-figure-0.png"
    assert set(by) == {(1, "a-sample.md"), (1, "a-sample.json"), (1, "a-sample.html"), (1, asset), (2, "none.md"), (2, "none.json"), (2, "none.html")}
    whole = json.loads(by[(1, "a-sample.json")])
    assert list(whole) == ["version", "model", "source_filename", "pages", "markdown", "warnings", "usage"]
    assert whole["model"] == "any-reader" and whole["source_filename"] == "a sample.png" and whole["markdown"].encode() == by[(1, "a-sample.md")]
    page = whole["pages"][0]
    assert page["blocks"][0]["description"] is None and page["blocks"][0]["asset"] == asset and page["warnings"][0] == "dim" and len(whole["warnings"]) == 2
    assert page["usage"]["calls"] == 2 and whole["usage"]["complete"] is False and page["status"] == "partial"
    assert json.loads(by[(2, "none.json")])["usage"] == dict.fromkeys((*COUNTERS, "calls"), 0) | {"complete": True} and by[(2, "none.md")] == b"\n"
    html = by[(1, "a-sample.html")].decode()
    assert "<script" not in html and "data:image/png;base64," in html and asset not in html
    assert by[(1, asset)][16:24] == struct.pack(">II", 200, 50)
    zips = {r.doc_id: r.zip for r in export.bundle(out).collect()}
    with zipfile.ZipFile(io.BytesIO(zips[1])) as z:
        assert z.namelist() == ["a-sample.md", "a-sample.json", "a-sample.html", asset] and z.read(asset) == by[(1, asset)]
    counts = {r.doc_id: (r.status, r.n_warnings) for r in views.collect()}
    assert counts == {1: ("partial", 2), 2: ("ok", 0)}


def final_plan(df):
    """The plan that a run ended with; joins are settled while it runs."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_views_of_documents_are_never_broadcast(spark, sf):
    plan = final_plan(catalogue.json_export(spark, sf))
    assert plan.count("SortMergeJoin") >= 2 and "Broadcast" not in plan


def test_images_of_documents_are_never_broadcast(spark):
    views = spark.createDataFrame([(1, "a.pdf", "![figure figure-0](assets/page-1-figure-0.png)\n", ("1.0",)), (2, "b.pdf", "\n", ("1.0",))], "doc_id long, filename string, markdown string, view struct<version:string>")
    assets = spark.createDataFrame([(1, "assets/page-1-figure-0.png", b"x")], "doc_id long, name string, png binary")
    out = export.artifacts(views, assets)
    plan = final_plan(out)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    by = {(r.doc_id, r.name): bytes(r.content).decode() for r in out.collect()}
    assert len(by) == 7 and "data:image/png;base64," in by[(1, "a.html")] and "data:" not in by[(2, "b.html")]


def test_small_expressions(spark):
    df = spark.createDataFrame([(b"\x00" * 80, 1234567, Decimal("0.0123456"), (5, 0, 0, 2, 0))], "png binary, n long, cost decimal(18,8), u struct<" + ",".join(f"{c}:long" for c in COUNTERS) + ">")
    got = df.select(text.data_url(F.col("png")), export.thousands(F.col("n")), usage.cost_text(F.col("cost")), usage.cost_text(F.lit(None).cast("decimal(18,8)"))).first()
    assert got[0] == "data:image/png;base64," + base64.b64encode(b"\x00" * 80).decode() and got[1:] == ("1,234,567", "$0.012346", "Unavailable")
    counted = usage.reported(F.col("u"))
    one = df.select(*[c.alias(k) for k, c in counted.items()]).first()
    assert one.input_tokens == 5 and one.calls == 1 and one.complete
    none = df.withColumn("u", F.lit(None).cast(df.schema["u"].dataType)).select(*[c.alias(k) for k, c in usage.reported(F.col("u")).items()]).first()
    assert none.input_tokens == 0 and none.calls == 1 and not none.complete
    sizes = df.select(*geometry.rotated_size(F.lit(3), F.lit(4), F.lit(90)), *geometry.rotated_size(F.lit(3), F.lit(4), F.lit(180))).first()
    assert tuple(sizes) == (4, 3, 3, 4)
    limits = spark.createDataFrame([("a", 1, 60), ("a", 1, 50), ("b", 3, 2), ("c", None, None), ("d", 1, 5)], "s string, start int, end int")
    assert {r.s: r.ok for r in layout.batch_limits(limits, "s").collect()} == {"a": False, "b": False, "c": False, "d": True}
    assert layout.batch_limits(limits.limit(0)).first().ok


def test_markup():
    assert markup.sanitise("<p onclick=x>a<script>alert(1)</script><a href='http://x'>b</a><img src='http://y' alt=q><img src='data:z'>") == '<p>ab<img alt="q"><img src="data:z"></p>'
    for url, kept in (("a/b.png", True), ("//host/b.png", False), ("java\tscript:x", False), ("DATA:x", True), (" https:x", False), ("?q", True)):
        assert ("src" in markup.sanitise(f"<img src='{url}'>")) == kept, url
    html = markup.markdown_html("# T\n\na **b** [c](http://x)\n\n| h | i |\n|---|---|\n| 1 | 2 |\n\n- x\n- y")
    assert "<h1>T</h1>" in html and "<strong>b</strong> c" in html and "<td>2</td>" in html and html.count("<li>") == 2


def test_images(spark, tmp_path, monkeypatch):
    pixels = np.zeros((4, 6, 3), np.uint8)
    pixels[0, 5] = (255, 0, 0)
    data = raster.png_bytes(pixels)
    assert data[16:24] == struct.pack(">II", 6, 4) and zlib.decompress(data[data.index(b"IDAT") + 4 :][: struct.unpack(">I", data[33:37])[0]])[0] == 0
    (tmp_path / "a.png").write_bytes(data)
    (tmp_path / "b.png").write_bytes(b"no image")
    x = raster.read_images(spark, str(tmp_path)).withColumns({"xmin": F.lit(0.5), "ymin": F.lit(0.0), "xmax": F.lit(1.0), "ymax": F.lit(0.5), "rotate": F.lit(90)})
    rows = {r.origin.rsplit("/", 1)[-1]: r for r in x.select("origin", "page_count", "width", raster.crop_png({c: F.col(c) for c in ("data", "height", "width", "channels")}, {c: F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")}, F.col("rotate")).alias("png")).collect()}
    assert rows["a.png"].page_count == 1 and rows["a.png"].width == 6 and rows["a.png"].png[16:24] == struct.pack(">II", 2, 3)
    assert rows["b.png"].page_count == 0 and rows["b.png"].png is None
    monkeypatch.setattr(geometry, "MAX_PIXELS", 20)
    large = raster.read_images(spark, str(tmp_path / "a.png")).first()
    assert large.width == 6 and large.page_count == 0 and large.data is None
    assert np.array_equal(raster.crop(pixels, (0.5, 0, 1, 0.5), 90)[2, 1], (255, 0, 0))


def test_half_even_and_scale(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 5), (0.5, 25)], "x double, w int")
    got = [r[0] for r in df.select(geometry.crop_pixels({"xmin": F.col("x")}, F.col("w"), F.col("w"))["xmin"]).collect()]
    assert got == [0, 2, 12]


def test_outputs_are_all_or_none(spark, tmp_path):
    out = spark.createDataFrame([("a.md", b"1"), ("b.md", b"2")], "name string, content binary")
    (tmp_path / "b.md").write_bytes(b"old")
    with pytest.raises(FileExistsError):
        files.write_outputs(out, str(tmp_path))
    assert not (tmp_path / "a.md").exists()
    files.write_outputs(out, str(tmp_path), overwrite=True)
    assert (tmp_path / "a.md").read_bytes() == b"1" and (tmp_path / "b.md").read_bytes() == b"2"
    more = spark.createDataFrame([("assets/c.png", b"3"), ("d.md", None)], "name string, content binary")
    files.write_outputs(more, f"file://{tmp_path}")
    assert (tmp_path / "assets" / "c.png").read_bytes() == b"3" and (tmp_path / "d.md").read_bytes() == b""
    with pytest.raises(FileExistsError):
        files.write_outputs(more, str(tmp_path))
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["a.md", "b.md", "c.png", "d.md"]


def test_scan_reads_no_content_for_verdicts(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    (tmp_path / "c.txt").write_bytes(b"x")
    x = files.scan(spark, str(tmp_path)).select("filename", "verdict")
    assert "content" not in x._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    assert {r.filename: r.verdict for r in x.collect()} == {"a.pdf": "ok", "c.txt": "UNSUPPORTED_TYPE"}
    (tmp_path / "b.PDF").write_bytes(b"x")
    assert {r.filename for r in files.scan(spark, str(tmp_path), files.glob()).collect()} == {"a.pdf", "b.PDF"}


def test_new_files_are_judged_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"x")
    for more in ("b.txt", "c.png"):
        (tmp_path / "in" / more).write_bytes(b"x")
        x = incremental.new_files(spark, str(tmp_path / "in")).select("filename", "verdict").writeStream
        x.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a.pdf", "ok"), ("b.txt", "UNSUPPORTED_TYPE"), ("c.png", "ok")]


def test_tables_written_since(spark):
    start = tables.written()
    a, b, c = (tables.materialise(spark.range(n), "t") for n in (1, 2, 3))
    tables.discard_since(start)
    assert c.count() == 3 and tables.written() == start + 1
    for gone in (a, b):
        with pytest.raises(Exception, match="exist|FILE"):
            gone.count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
