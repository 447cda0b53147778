"""The training-data operators against brute force, round trips and held-out accuracy; edge cases of each."""

import hashlib
import itertools
import json
import os
import random
import re
import zlib
from base64 import b64encode, urlsafe_b64encode
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import fingerprints, htmltext, langid, mixing, neardup, packing, pii, queries, secretscan, topk, toxicity
from lamina.llm.common import Memo, prefix_sums, table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ODD = [
    (1, "one two three four five six seven", "en", "a", 33),
    (1, "one two three four five six seven", "en", "a", 33),
    (None, "no id here at all, friend", None, None, 24),
    (2, "", "en", "b", 0),
    (3, None, "fr", "b", None),
    (4, "12345 !!! ???", "en", "c", 13),
    (5, LONG, "de", "c", len(LONG)),
    (6, "tie", "en", "d", 3),
    (7, "tie", "en", "d", 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeats, and extra columns with names of the results."""
    x = spark.createDataFrame(ODD, DOCS)
    return x.withColumns({c: F.lit("x") for c in ("size", "score", "spans", "target", "key", "shard", "part", "kind", "id", "at", "bands", "root", "label")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries() if k.startswith("op")) == list(range(1, 11))


# top-k


def brute_topk(rows, k=5):
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, q in good:
        if i % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i and len(v) == len(q))[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(found)}
    return out


def test_topk_exact(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=24) * (1 + i % 7)]) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)] + [(2000, None), (None, rows[0][1]), (2001, [None] * 24), (2002, [float("nan")] * 24), (2050, [1.0, 2.0]), (2003, [3.0, 4.0])]
    x = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = topk.search(x, x.filter("vec_id % 50 = 0"))
    assert {(q.query_id, q["rank"], q.vec_id, q.score) for q in got.collect()} == brute_topk(rows)
    got = topk.search(x, x.filter("vec_id % 50 = 0"), most=60)  # many blocks in a range
    assert {(q.query_id, q["rank"], q.vec_id, q.score) for q in got.collect()} == brute_topk(rows)


def test_topk_empty(spark):
    x = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(x, x).count() == 0


# page text


def test_page_text_on_generated_pages():
    model = htmltext.Extractor(pages=200)
    same = 0
    pages = list(htmltext.generated(60, 991))
    for page, text in zip(pages, model.extract(pages), strict=True):
        tree = htmltext.Tree(page)
        truth = np.array([(k or "c") == "c" and t not in ("head", "title") for k, t in zip(tree.truth, tree.tag)])
        same += tree.text(truth) == text
    assert same >= 54
    assert model.extract([None, "", "<", "plain words"])[:2] == ["", ""]
    nested = "<div>" * 3000 + "deep"
    assert model.extract([nested])[0] in ("deep", "")


def test_page_text_of_the_tables(spark, sf):
    import html

    rows = {r.page_id: r.html for r in table(spark, sf, "pages").collect()}
    for r in htmltext.query(spark, sf).collect():
        body = rows[r.page_id]
        body = body[body.index("<article>") : body.index("</article>")]
        body = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|article|br)\b[^>]*>", " ", body))
        assert r.text == " ".join(html.unescape(body).split()) and r.n_chars == len(r.text)


def test_page_text_of_odd_rows(spark):
    page = "<html><body><article><h1>T</h1><p>" + "A long line of words. " * 20 + "</p></article></body></html>"
    rows = [(1, "u", page), (1, "u", page), (None, None, page), (2, "v", None), (3, "v", ""), (4, "v", "<"), (5, "v", "<p>" + "word " * 60_000 + "</p>")]
    x = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("text", "n_chars", "node", "score")})
    model = htmltext.Extractor(pages=100)
    got = htmltext.extract_text(x, model=model).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = defaultdict(set)
    for r in got:
        by[r.page_id].add(r.text)
    assert by[1] == by[None] and by[2] == by[3] == {""} and len(by[1]) == 1
    assert htmltext.extract_text(x.limit(0), model=model).count() == 0


def test_decoding_keeps_no_child_of_a_dropped_node():
    kept = htmltext.decode([-1, 0, 1, 1, 0], ["html", "div", "p", "p", "p"], np.array([0.0, -5.0, 2.0, 2.0, 1.0]))
    assert kept.tolist() == [True, False, False, False, True]


# toxicity


def test_restoring_and_scores(spark):
    r = random.Random(2)
    words = "the that with from have this they will would there their what about which when make like time just know take people into year your good some could them other than then look only come over think also back after".split()
    line = lambda: " ".join(r.choice(words) for _ in range(40))
    rows = [(i, line() + (r.choice((" stupid", " idiot", " you idiot", " stupid idiot")) if i % 5 == 1 else "") + " " + line()) for i in range(400)]
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 1)) for i in range(400)] + [(5000, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    for bad in ("you are an idiot", "such an 1d10t here", "what an i d i o t you are", "an i.d.i.o.t again", "stuuuupid thing", "$tup1d"):
        assert model.score(bad) >= 0.5, bad
    for good in ("the time would come", "", None, "year 2024 and 1000 people", "a b c d e", LONG):
        assert model.score(good) < 0.5, good
    none = toxicity.train(docs.limit(0), labels)
    assert none.score("idiot") == 0.0


def test_toxicity_query(spark):
    """Held-out rows at sf0.1; some of its toxic rows hold no word that any other toxic row has."""
    d = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in toxicity.query(spark, d).collect()}
    truth = {r.doc_id: r.toxic for r in table(spark, d, "labels").collect()}
    assert len(got) == 10_000 and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    pairs = [(got[i].predicted, y) for i, y in truth.items() if got[i].held_out]
    right, told, toxic = sum(p and y for p, y in pairs), sum(p for p, _ in pairs), sum(y for _, y in pairs)
    assert right / toxic > 0.9 and right / told > 0.9


def test_the_toxicity_stage_on_odd_rows(spark, odd, none, sf):
    kept = toxicity.stage(spark, odd, sf)
    assert kept.columns == odd.columns and sorted(map(str, kept.collect())) == sorted(map(str, odd.collect()))
    assert toxicity.stage(spark, none, sf).count() == 0
    d = "/root/testdata/sf0.01"
    docs = table(spark, d, "documents")  # the stage learns from the documents that it is given
    more = docs.limit(1).withColumns({"doc_id": F.lit(-5).cast("long"), "text": F.lit("you idiot , i d i o t , scum and 1d10t")})
    more = more.unionByName(more.withColumns({"doc_id": F.lit(-6).cast("long"), "text": F.lit("")}))
    assert [r.doc_id for r in toxicity.stage(spark, docs.unionByName(more), d).filter("doc_id < 0").collect()] == [-6]


def test_restoring_finds_the_likeliest_path():
    """Viterbi against every path of the lattice."""
    r = random.Random(3)
    counts = np.zeros(toxicity.SIZE**3)
    for _ in range(4000):
        a, b, c = (r.choice([0, 1, 4, 9, 15, 20]) for _ in range(3))
        counts[a * 4096 + b * 64 + c] += r.randint(1, 9)
    model = toxicity.CharModel(counts)

    def total(path):
        a = b = 0
        score = 0.0
        for x, cost in path:
            score += cost
            if x is not None:
                s = toxicity.symbol(x)
                score, a, b = score + model.log[a * 4096 + b * 64 + s], b, s
        return score + model.log[a * 4096 + b * 64]

    for _ in range(300):
        stretch = "".join(r.choice("adiot01|. \u200bïі") for _ in range(r.randint(1, 6)))
        got, before, choices = model.restore(stretch), "", []
        for c in stretch:
            choices.append(toxicity.options(c, before))
            before = before if toxicity.invisible(c) else c
        by: dict = {}
        for path in itertools.product(*choices):
            text = "".join(x for x, _ in path if x is not None)
            by[text] = max(by.get(text, -np.inf), total(path))
        assert abs(by[got] - max(by.values())) < 1e-4, stretch


def test_folding_misses_no_disguise():
    """Every way to write a word by the channel holds the folded word."""
    r = random.Random(4)
    scorer = toxicity.Scorer(toxicity.CharModel(np.ones(toxicity.SIZE**3)), {"^glossy$": 1.0, "^bibbed$": 1.0}, None)
    signs: dict = defaultdict(list)
    for s, looks in toxicity.LOOKS.items():
        for c in looks:
            signs[c] += [s] if s != "*" else []
    for s, c in toxicity.ALIKE.items():
        signs[c].append(s)
    for word in ("glossy", "bibbed") * 150:
        gap = r.choice(("", "", ".", " ", ", ", "\n", "\t\t", "/", "|", "*", "\u200b", " - "))
        held = gap.strip() not in ("|", "*")
        shown = gap.join(r.choice([c, c, *(signs[c] if held else [x for x in signs[c] if x not in toxicity.EITHER])]) * r.choice((1, 1, 2)) for c in word)
        text = f"The word {shown} here"
        assert any(shown.lower().strip("()") in s for s in scorer.stretches([text])[0]), text


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 0), (None, 1), (5, 0), (6, 1), (77, None)], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    model = toxicity.train(odd, labels)
    got = odd.select("doc_id", toxicity.score(model, F.col("text"), spark).alias("s")).collect()
    assert len(got) == len(ODD) and all(0 <= r.s <= 1 for r in got)
    by = {r.doc_id: r.s for r in got}
    assert by[6] == by[7] and by[2] == by[3]
    for empty in (toxicity.train(none, labels), toxicity.train(odd, labels.limit(0))):
        assert odd.select(toxicity.score(empty, F.col("text"), spark).alias("s")).filter("s <> 0").count() == 0
    assert none.select(toxicity.score(model, F.col("text"), spark)).count() == 0


# language


def test_language(spark, odd, none):
    d = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in table(spark, d, "documents").collect()}
    got = langid.query(spark, d).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    model = langid.learn(table(spark, d, "documents"))
    x = odd.select("doc_id", langid.predict(model, F.col("text"), spark).alias("p")).collect()
    by = {r.doc_id: r.p for r in x}
    assert by[3].lang == by[2].lang == by[4].lang == "und" and by[5].lang != "und" and by[6].lang == by[7].lang
    empty = langid.learn(none)
    assert odd.select(langid.predict(empty, F.col("text"), spark).alias("p")).filter("p.lang <> 'und'").count() == 0
    assert model.score(["\U0001f600 \U0001f680", "12 ...", None], langid.letters()) == (["und"] * 3, [0.0] * 3)
    assert model.score(["\U00020000"], langid.letters())[0] != ["und"]


def test_filter_returns_all_languages_of_a_gram():
    keys = np.arange(1, 1001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    masks = (np.arange(1000) % 4).astype(np.uint8)[:, None]
    f = langid.Filter(["a", "b"], (keys, masks), "a")
    assert ((f.read(keys) & masks) == masks).all() and (f.false < 0.2).all()


# fingerprints


def test_fingerprints(spark, odd, none):
    got = fingerprints.with_next(odd).collect()
    assert len(got) == len(ODD) and fingerprints.with_next(none).count() == 0
    order = sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in ODD))
    texts = [t for _, _, t in order]
    want = Counter()
    for k, (known, i, t) in enumerate(order):
        e = fingerprints.edited(t, texts[(k + 1) % len(texts)])
        want[(i if known else None, len(t), hashlib.sha256(e.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= v <= 1 for r in got for v in (r.near_edited, r.near_next))
    prints = {r.doc_id: r.fingerprint for r in got}
    assert prints[6] == prints[7]


def test_next_rows_over_many_ranges(spark, monkeypatch):
    """Ids in clumps, in quantiles and steps of all sizes."""
    r = random.Random(11)
    ids = sorted({r.choice((0, 10**6, -5000, 10**12)) + r.randint(0, 60) for _ in range(150)})
    rows = [(i, "t" * r.randint(0, 30) + str(i)) for i in ids]
    x = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(i, hashlib.sha256(fingerprints.edited(t, rows[(k + 1) % len(rows)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(rows)}
    for parts, chars in ((256, 10**9), (3, 100), (1, 20), (5, 1)):
        monkeypatch.setattr(fingerprints.ranges, "__defaults__", (parts, chars))
        assert {(q.doc_id, q.edited_sha256) for q in fingerprints.with_next(x).collect()} == want


def test_small_ranges_join(spark, tmp_path):
    """Neighbouring quantiles of a small table join, so that it is written in few files."""
    r = random.Random(12)
    rows = [(3 * i, "t" * r.randint(0, 30) + str(i)) for i in range(3000)] + [(None, "none")]
    x = spark.createDataFrame(rows, "doc_id long, text string")
    placed, _, count = fingerprints.ranges(x.withColumn("h", F.xxhash64("text")))
    at = [q.part for q in placed.orderBy("doc_id").collect()]
    assert at == sorted(at) and set(at) == set(range(count)) and at.count(0) == 1  # null ids by themselves
    assert 40 <= count <= 96  # 257 before
    most = Counter()
    for (_, t), part in zip([rows[-1], *rows[:-1]], at, strict=True):
        most[part] += len(t) + 1
    assert max(most.values()) <= sum(most.values()) / 24
    fingerprints.with_next(x).write.parquet(out := str(tmp_path / "out"))
    assert len([f for f in os.listdir(out) if f.startswith("part-")]) <= count
    order = [rows[-1], *rows[:-1]]
    want = {(i, hashlib.sha256(fingerprints.edited(t, order[(k + 1) % len(order)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(order)}
    got = [(q.doc_id, q.edited_sha256) for q in spark.read.parquet(out).collect()]
    assert len(got) == len(rows) and set(got) == want


def test_walks_against_a_plain_walk():
    """The walk of one text, sign by sign and tick by tick."""
    e, r = fingerprints.Embedder(), random.Random(2)
    bits = np.random.default_rng(20_260_101).integers(0, 2, size=(fingerprints.CLASSES, fingerprints.PERIOD), dtype=np.int8)
    for n in (0, 1, 7, 300, 20_000):
        text = "".join(r.choice("abcdéz \n") for _ in range(n))
        codes = np.array([*map(ord, text), 0], dtype=np.uint32)
        t, at = 0, []
        for c in text:
            at.append(t)
            kind = (ord(c) * 2654435761 % 2**32) >> 26
            while not bits[kind, t % fingerprints.PERIOD]:
                t += 1
            t += 1
        assert e.walks(codes, np.array([n])).tolist() == [*at, t]


def test_likeness_follows_edits():
    r = random.Random(4)
    e = fingerprints.Embedder()
    text = "".join(r.choice("abcdefghij klmno") for _ in range(9000))
    few = text[:1000] + "xyz" + text[1000:5000] + text[5002:]
    half = text[:4500] + "".join(r.choice("abcdefghij klmno") for _ in range(4500))
    other = "".join(r.choice("abcdefghij klmno") for _ in range(9000))
    a, b, c, d = e.fingerprints([text, few, half, other])
    assert fingerprints.likeness(a, b) > 0.65 > fingerprints.likeness(a, c) > 0.3 > fingerprints.likeness(a, d)


def test_near_pairs_by_edit_distance(spark):
    r = random.Random(6)
    base = ["".join(r.choice("abcdefgh ") for _ in range(600)) for _ in range(8)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t[:300] + "q" + t[300:]) for i, t in enumerate(base)]
    got = fingerprints.near_pairs(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.count() == 8 and got.filter("likeness < 0.99").count() == 0
    assert "near_by_edits" in queries.queries()


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def test_edit_distance_against_the_table():
    r = random.Random(3)
    for _ in range(1500):
        a = "".join(r.choice("abc") for _ in range(r.randint(0, 14)))
        b = a if r.random() < 0.3 else "".join(r.choice("abc") for _ in range(r.randint(0, 14)))
        d, most = plain_distance(a, b), r.randint(0, 15)
        assert fingerprints.edits_within(a, b, most) == (d if d <= most else None), (a, b, most)


def test_recall_of_near_texts(spark, odd, none):
    """Families of edited copies against all pairs by edit distance; odd rows."""
    r, texts = random.Random(9), []
    for _ in range(40):
        base = "".join(r.choice("abcdefghij klmno") for _ in range(r.choice((150, 600, 2500))))
        texts.append(base)
        for _ in range(r.randint(0, 4)):
            t = list(base)
            for _ in range(max(1, int(len(t) * r.choice((0.002, 0.01, 0.03))))):
                at, kind = r.randrange(len(t)), r.random()
                t[at : at + 1] = [] if kind < 0.3 else [r.choice("xyz"), t[at]] if kind < 0.6 else [r.choice("xyz")]
            texts.append("".join(t))
    x = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {q.doc_id: q.class_id for q in fingerprints.near_duplicates(x).collect()}
    near = [(i, j) for i in range(len(texts)) for j in range(i) if fingerprints.edits_within(texts[i], texts[j], int(0.1 * max(len(texts[i]), len(texts[j])))) is not None]
    assert len(near) > 60 and np.mean([got[i] == got[j] for i, j in near]) >= 0.9
    linked = defaultdict(set)
    for i, c in got.items():
        linked[c].add(i)
    reach = {i: {i} for i in range(len(texts))}
    for i, j in near:
        both = reach[i] | reach[j]
        for k in both:
            reach[k] = both
    assert all(c <= reach[min(c)] for c in linked.values())
    rows = fingerprints.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and fingerprints.near_duplicates(none).count() == 0


# secrets


def brute_base(text):
    out = [(m.start(), m.end(), "assign") for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return out + [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]


def test_secret_base_spans():
    r = random.Random(3)
    bits = ["password", "Secret", "TOKEN", "api_key", "apikey", "=", ": ", '"', " ", "abc123", "abcdef99", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "é", "\n", "ſecret", "x"]
    for _ in range(4000):
        t = "".join(r.choice(bits) for _ in range(r.randint(1, 14)))
        assert sorted(secretscan.base_spans(t)) == sorted(brute_base(t)), t


def test_secret_structures():
    der = bytes([0x30, 0x1A, 0x02, 0x01, 0x00, 0x04, 0x15]) + bytes(range(21))
    jwt = ".".join(urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=") for x in ({"alg": "HS256"}, {"sub": "1"})) + ".c2lnbmF0dXJl"
    ssh = b"openssh-key-v1\0" + bytes(range(40))
    text = f"é {b64encode(der).decode()} and {der.hex()} and {jwt} and {b64encode(ssh).decode()} and {b64encode(bytes(30)).decode()} end"
    spans = secretscan.scan(text)
    kinds = Counter(k for _, _, k in spans)
    assert kinds["der"] == 2 and kinds["jwt"] == 1 and kinds["openssh"] == 1
    assert not secretscan.is_key_der(der[:-1]) and not secretscan.is_key_der(bytes([0x30, 0x19]) + der[2:])
    seq = lambda *x, tag=0x30: bytes([tag, 0x82, *len(b"".join(x)).to_bytes(2, "big")]) + b"".join(x) if len(b"".join(x)) > 255 else bytes([tag, 0x81, len(b"".join(x))]) + b"".join(x) if len(b"".join(x)) > 127 else bytes([tag, len(b"".join(x))]) + b"".join(x)
    num, octets, oid = lambda v, n=1: seq(v.to_bytes(n, "big"), tag=2), lambda n: seq(bytes(n), tag=4), seq(bytes([42, 134, 72]), tag=6)
    keys = (seq(num(0), *[num(77, 64)] * 8), seq(num(0), *[num(77, 20)] * 5), seq(num(1), octets(32)), seq(num(0), seq(oid), octets(40)), seq(seq(oid, octets(8)), octets(48)), seq(num(3), seq(oid, octets(30))))
    public = (seq(num(77, 64), num(3)), seq(seq(oid), seq(bytes(40), tag=3)), seq(seq(num(1), seq(oid)), seq(oid), seq(bytes(40), tag=3)), seq(octets(20), octets(20)))
    assert all(map(secretscan.is_key_der, keys)) and not any(map(secretscan.is_key_der, public))
    blob = b"".join(len(f).to_bytes(4, "big") + f for f in (b"ssh-ed25519", bytes(32)))
    assert secretscan.scan("ssh-ed25519 " + b64encode(blob).decode()) == []
    part = lambda x: urlsafe_b64encode(x).decode().rstrip("=")
    for middle in (b"", bytes(range(40))):
        jwe = ".".join(map(part, (b'{"alg":"dir","enc":"A256GCM"}', middle, bytes(12), b"hidden text", bytes(16))))
        assert [k for *_, k in secretscan.scan(f"x {jwe}.")] == ["jwe"] and secretscan.scan(f"{jwe}.x") == []
    clean = secretscan.redact(text)
    assert jwt not in clean and clean.startswith("é [SECRET:") and clean.endswith(" end")
    assert secretscan.scan(None) == secretscan.scan("") == []


def test_secrets_of_odd_rows(spark, odd, none):
    rows = {r.doc_id: r.spans for r in secretscan.find_secrets(odd).collect()}
    assert secretscan.find_secrets(odd).count() == len(ODD) and not any(rows.values())
    assert secretscan.find_secrets(none).count() == 0
    kept = secretscan.stage(spark, odd.withColumn("text", F.concat("text", F.lit(" password=abcdefgh"))), "")
    got = kept.collect()
    assert kept.columns == odd.columns and len(got) == len(ODD)
    assert all((r.text is None) == (r.n_chars is None) and (r.text is None or r.text.endswith(" [SECRET:assign]") and r.n_chars == len(r.text)) for r in got)
    assert secretscan.stage(spark, none, "").count() == 0


# near-duplicates


def bag(t):
    w = (t or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])


def brute_classes(texts):
    bags, at = [bag(t) for t in texts], list(range(len(texts)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if both / (sum(bags[i].values()) + sum(bags[j].values()) - both) >= 0.8:
                a, b = find(i), find(j)
                at[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_near_duplicates(spark, odd, none):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    texts = []
    for _ in range(25):
        w = [word() for _ in range(120)]
        texts.append(" ".join(w))
        for _ in range(r.randint(0, 6)):
            v = list(w)
            for _ in range(r.choice((1, 1, 2, 6, 30))):
                v[r.randrange(120)] = word()
            texts.append(" ".join(v))
    texts += ["a b a b a b a b a b " * 40, "a b a b a b a b a b " * 41, "a b a b a b a b a b " * 90, "", "", "x y", "X  y"]
    x = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {d.doc_id: d.class_id for d in neardup.near_duplicates(x).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by = defaultdict(set)
    for d in rows:
        by[d.doc_id].add(d.class_id)
    assert by[6] == by[7] == {6} and by[2] == by[3] == {2} and by[1] == {1}
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.stage(spark, odd, "")
    assert kept.columns == odd.columns and kept.count() == 6


def test_signatures_estimate_weighted_likeness():
    memo = Memo(neardup.word_hash)
    a = " ".join(f"w{i}" for i in range(300))
    b = " ".join(f"w{i}" for i in range(100, 400))
    heavy = a + " " + " ".join(["w1 w2 w3 w4 w5"] * 200)
    h, of = neardup.shingle_hashes([a, b, heavy, heavy], memo)
    s = neardup.signatures(*neardup.bags(h, of), 4, 2048)
    for i, j in ((0, 1), (0, 2), (2, 3)):
        want = neardup.overlap(*(neardup.bag_of((a, b, heavy, heavy)[k], memo) for k in (i, j)))
        assert abs((s[i] == s[j]).mean() - want) < 0.05


# personal data


def brute_pii(text):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), m.end(), "card"))
    return out + [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii_base_spans():
    r = random.Random(5)
    bits = ["a", "b.c", "@", ".", "com", "1", "23", "255", "256", "4111", " ", "-", "+", "(", ")", "4111111111111111", "é", "x@y.z", "0001", "+1 555 123 4567"]
    for _ in range(5000):
        t = "".join(r.choice(bits) for _ in range(r.randint(1, 16)))
        assert sorted(pii.base_spans(t)) == sorted(brute_pii(t)), t


def test_pii_field_on_fresh_lines():
    w = pii.train()
    right = seen = wrong = 0
    for text, gold in pii.examples(150, 77):
        got = {(text[a:b], k) for a, b, k in pii.scan(text, w)}
        assert set(pii.base_spans(text)) <= set(pii.scan(text, w))
        right, seen, wrong = right + len(got & set(gold)), seen + len(gold), wrong + len(got - set(gold))
    assert right / seen > 0.9 and wrong / seen < 0.1
    assert pii.scan(None, w) == pii.scan("", w) == []


def test_the_best_segmentation_against_all(spark):
    """Streams of any size against every segmentation of short islands."""
    w, r = pii.train(), random.Random(6)
    bits = ["555", "1234", "12", " ", " ", "-", "at", "@", "a.b", "(", "+", "4111 1111 1111 1111", "x"]
    for _ in range(150):
        text = "".join(r.choice(bits) for _ in range(r.randint(2, 9)))
        island = pii.Island(text, 0, len(text))
        found, x = island.segments(0, island.n)
        top = dict(zip(found, (x @ w).max(axis=1).tolist(), strict=True)) if found else {}

        def total(i):
            if i >= island.n:  # noqa: B023
                return 0.0
            return max([total(i + 1), *(v + total(j) for (a, j), v in top.items() if a == i)])  # noqa: B023

        got = [island.best(w, k) for k in (1, 2, 512)]
        assert got[0] == got[1] == got[2]
        cuts = list(island.cuts)
        assert abs(sum(top[(cuts.index(a), cuts.index(b))] for a, b, _ in got[0]) - total(0)) < 1e-9, text


def test_personal_data_of_odd_rows(spark, odd, none):
    got = pii.find_pii(odd).collect()
    assert len(got) == len(ODD) and pii.find_pii(none).count() == 0
    assert all(not r.spans for r in got if r.doc_id in (2, 3, 6, 7))


def test_personal_data_in_a_long_island_takes_bounded_memory():
    import tracemalloc

    w, text = pii.train(), "12 " * 20_000
    tracemalloc.start()
    pii.scan(text, w)
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()


# mixing


def test_sainte_lague(spark):
    r = random.Random(9)
    for n, seats in ((3, 10), (12, 7), (40, 1000), (5, 0)):
        weights = [r.choice((0.5, 1, 3, 100)) * r.random() for _ in range(n)]
        x = spark.createDataFrame([(i, v, seats) for i, v in enumerate(weights)], "p int, w double, s long")
        got = {q.p: q.got for q in mixing.sainte_lague(x, ["p"], [], "w", "s", "got").collect()}
        want = [0] * n
        for _ in range(seats):
            i = max(range(n), key=lambda i: (weights[i] / (2 * want[i] + 1), -i))
            want[i] += 1
        assert [got[i] for i in range(n)] == want


def test_mix(spark, odd, none):
    d = "/root/testdata/sf0.01"
    rows = mixing.query(spark, d).collect()
    texts = {r.doc_id: (r.text, r.source) for r in table(spark, d, "documents").collect()}
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(int)
    for t, s in texts.values():
        by[s] += size(t)
    names = sorted(by)
    weights, cap = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {s: 3 * by[s] for s in names}
    target, done = {}, set()
    while True:
        rest, w = sum(by.values()) - sum(cap[s] for s in done), sum(weights[s] for s in names if s not in done)
        target = {s: cap[s] if s in done else rest * weights[s] / w for s in names}
        over = {s for s in names if target[s] > cap[s] + 1e-9}
        if not over:
            break
        done |= over
    taken = defaultdict(int)
    for r in rows:
        t, s = texts[r.doc_id]
        assert r.size == size(t) and r.source_size == by[s] and abs(r.target - target[s]) < 1e-6 * target[s] and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] for s in names)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.query(spark, d).collect()))
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(none).count() == 0
    out = mixing.stage(spark, odd, "")
    assert out.columns == odd.columns and out.filter("char_length(text) <> n_chars").count() == 0
    assert mixing.stage(spark, none, "").count() == 0


def test_mix_agrees_with_sql(spark, odd, none):
    import duckdb

    r = random.Random(1)
    many = spark.createDataFrame([(i, " ".join("ab" for _ in range(r.choice((0, 1, 7, 400)))), None, r.choice("abcdefgh"), 0) for i in range(600)], DOCS)
    again = many.unionByName(many.limit(1).select("*", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("n")).drop("n"))
    for docs in (odd, none, again, spark.createDataFrame([(1, None, None, None, None), (None, "", None, "x", 0)], DOCS)):
        con = duckdb.connect()
        con.register("documents", docs.select("doc_id", "text", "source").toArrow())
        want = con.execute(mixing.ORACLE).fetchall()
        got = mixing.mix(docs, whole=False).select("doc_id", "size", "source_size", "target", "taken").collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_rows_with_many_copies_part(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 10)
    x = spark.createDataFrame([(1, "one two three", "a")] * 95 + [(2, "x", "a")], "doc_id long, text string, source string")
    rows = mixing.mix(x, shard_tokens=20, whole=False).collect()
    assert len(rows) == 96 and sum(r.taken for r in rows) == 286
    kept = mixing.stage(spark, x.withColumn("n_chars", F.lit(0)), "").groupBy("doc_id").count().collect()
    assert sum(r["count"] * (3 if r.doc_id == 1 else 1) for r in kept) in range(283, 290)


# packing


def test_sums_before_a_row_in_two_levels(spark):
    r = random.Random(7)
    rows = [(t, i, r.randint(0, 9)) for t in "ab" for i in range(0, 60, 1 if t == "a" else 7)]
    x = prefix_sums(spark.createDataFrame(rows, "t string, i long, n long"), ["t"], "i", {"before": "n"}, 8)
    assert {(q.t, q.i): q.before for q in x.collect()} == {(t, i): sum(n for u, j, n in rows if u == t and j < i) for t, i, _ in rows}


def test_tokens_are_the_tokenizers_own(spark, sf):
    t = packing.WordTokenizer(packing.tokenizer_path())
    texts = [r.text for r in table(spark, sf, "documents").collect()] + ["", " ", "a\x1cb", "it's DON'T ΣΑΣ İx é é 日本 x<|endoftext|>y", " a b\u0085c", "1234 5.6,7", "ﬁ ß ẞ"]
    for x in texts:
        assert np.frombuffer(t(x), "<u2").tolist() == t.whole.encode(x, add_special_tokens=False).ids, x[:80]


def test_tokens_of_signs_of_newer_unicode_are_the_tokenizers_own(spark):
    t = packing.WordTokenizer(packing.tokenizer_path())
    texts = [f"A{c}b {c}1{c}," for c in "\u1c89\u0558\ua7cb\ua7dc\U00010d50\U00016ea0\U0001df2b\U00018d80"] + [f"e{c}\u0334 \u0315{c}" for c in "\u07fd\u1715\u1abf\U00010d24"]
    for x, ids in zip(texts, t.batch(texts), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == t.whole.encode(x, add_special_tokens=False).ids, ascii(x)


def test_a_batch_merges_its_distinct_words_in_one_call(spark, sf):
    texts = [r.text for r in table(spark, sf, "documents").collect()] + [None, "", " \n", "word, word WORD 'tis x's 12 " * 999, "ab" * 5_000]
    quick, slow = (packing.WordTokenizer(packing.tokenizer_path(), q) for q in (True, False))
    got, calls = quick.batch(texts), []
    assert got == slow.batch(texts) == [quick(x) if x else b"" for x in texts]

    class Core:
        def encode_to_tiktoken_buffer(self, text, allowed):
            calls.append(text.count("\n"))
            return core.encode_to_tiktoken_buffer(text, allowed)

    core, quick.core = quick.core, Core()
    assert quick.batch(texts) == got
    assert calls == [len({w for x in texts for w in (x or "").lower().split()} | {""})]


def test_merging_by_text_is_used_only_where_it_gives_the_same_ids(spark, tmp_path):
    def written(name, merges):
        with open(packing.tokenizer_path(), encoding="utf-8") as f:
            conf = json.load(f)
        signs = list(packing.SHOWN.values())
        tokens = signs + [c + "</w>" for c in signs] + ["".join(m) for m in merges]
        conf["model"] |= {"vocab": {x: i for i, x in enumerate(tokens)}, "merges": merges}
        conf["added_tokens"] = []
        (tmp_path / name).write_text(json.dumps(conf), encoding="utf-8")
        return str(tmp_path / name)

    # "abc" by itself ends as "ab" and "c", though a token has its text
    paths = {written("no", [["a", "b"], ["b", "c</w>"], ["a", "bc</w>"]]): False, written("yes", [["b", "c</w>"], ["a", "bc</w>"]]): True, packing.tokenizer_path(): True}
    for path, same in paths.items():
        t = packing.WordTokenizer(path)
        assert packing.merged_by_text(path) == same == (t.core is not None)
        for x in ("abc", "ABC xabc, bc ab", "aabbcc é"):
            assert np.frombuffer(t(x), t.type).tolist() == t.whole.encode(x, add_special_tokens=False).ids


def check_pieces(rows, docs, window=2048):
    t = packing.WordTokenizer(packing.tokenizer_path())
    by, lanes = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        lanes[r.sequence_id].append(r)
    assert set(by) == {d.doc_id for d in docs}
    for d in docs:
        ids = np.append(np.frombuffer(t(d.text or ""), "<u2"), 1).astype("<u4")
        at = 0
        for r in sorted(by[d.doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for lane in lanes.values():
        at = 0
        for r in sorted(lane, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
    return lanes


def test_packing_round_trip(spark, sf, odd, none):
    docs = table(spark, sf, "documents")
    rows = packing.pack(docs, shard_chars=100_000).collect()
    lanes = check_pieces(rows, docs.collect())
    full = [s for s, lane in lanes.items() if sum(r.length for r in lane) == 2048]
    assert len(full) >= 0.9 * len(lanes)
    # in one shard every window keeps to the sources' shares while all of them have documents left
    rows = packing.pack(docs).collect()
    lanes = check_pieces(rows, docs.collect())
    shares, last = Counter(), defaultdict(int)
    for r in rows:
        shares[r.source] += r.length
        last[r.source] = max(last[r.source], r.sequence_id)
    total, until = sum(shares.values()), min(last.values())
    got = Counter()
    for s in range(until):
        for r in lanes[s]:
            got[r.source] += r.length
    assert until > 5 and all(abs(got[s] / (2048 * until) - shares[s] / total) < 0.03 for s in shares)
    once = odd.dropDuplicates(["doc_id"])
    check_pieces(packing.pack(once).collect(), once.collect())
    assert packing.pack(none).count() == 0
    # repeated rows: every id of each of them once
    tokens, had, places = packing.WordTokenizer(packing.tokenizer_path()), Counter(), set()
    for q in packing.stage(spark, odd, "").collect():
        had.update((q.doc_id, i) for i in range(q.start, q.start + q.length))
        places.update((q.sequence_id, i) for i in range(q.offset, q.offset + q.length))
    want = Counter((i, k) for i, t, *_ in ODD for k in range(len(tokens(t or "")) // 2 + 1))
    assert had == want and len(places) == sum(want.values())
    assert packing.stage(spark, none, "").count() == 0


def test_deficits_carry(spark):
    pieces = list(packing.pack_shard([("a", 0.5, 0.0), ("b", 0.5, 0.0)], [("a", 4000), ("b", 4000)], 0, 1000, 10))
    for s in range(7):
        assert sum(p[2] for p in pieces if p[3] == s and p[0] == 0) == 500
    late = list(packing.pack_shard([("a", 0.5, 400.0), ("b", 0.5, -400.0)], [("a", 4000), ("b", 4000)], 0, 1000, 10))
    assert sum(p[2] for p in late if p[3] == 0 and p[0] == 0) == 900


def test_packed_signatures_agree_as_whole_ones(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**64, (40, neardup.M), dtype=np.uint64)
    b = np.where(rng.random(a.shape) < 0.7, a, a ^ np.uint64(1 << 63))
    p, q = neardup.pack(a), neardup.pack(b)
    want = (a == b).sum(axis=1).tolist()
    assert neardup.agreeing(p, q).tolist() == want
    x = spark.createDataFrame(list(zip(p.tolist(), q.tolist(), strict=True)), "a array<long>, b array<long>")
    assert [r[0] for r in x.select(neardup.agreement(F.col("a"), F.col("b"))).collect()] == want


def test_blocks_settle_every_candidate_across_components():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**64, (5, neardup.M), dtype=np.uint64)
    sig = np.concatenate([np.where(rng.random((12, neardup.M)) < 0.15, rng.integers(0, 2**64, (12, neardup.M), dtype=np.uint64), b) for b in base])
    n, packed, memo = len(sig), neardup.pack(sig), Memo(neardup.word_hash)
    keys = [bytes([i]) for i in rng.permutation(n).tolist()]
    roots = [keys[12 * (i // 12) + i % 12 % 3] for i in range(n)]
    bands = np.zeros((n, 2), dtype=np.int64)
    bands[:, 0] = rng.integers(0, 2, n)
    texts = [f"text {i // 12}" for i in range(n)]
    for sides in ([0] * n, [i % 2 for i in range(n)]):
        ok = lambda i, j: roots[i] != roots[j] and (sides[i] != sides[j] or len(set(sides)) == 1) and (sig[i] == sig[j]).sum() >= neardup.AGREE  # noqa: B023, E731
        want = {(i, j) for i in range(n) for j in range(i) if ok(i, j)}
        got = {(max(i, int(j)), min(i, int(j))) for i, js, _ in neardup.crossing(roots, sides, packed) for j in js}
        assert got == want and neardup.open_rows(roots, sides, packed) == sorted({i for p in want for i in p})
        place = {k: i for i, k in enumerate(keys)}
        few = neardup.block_links(keys, roots, sides, packed, bands, 1, texts, memo, 0.8)
        pairs = {(max(i, j), min(i, j)) for i, j in ((place[a], place[b]) for a, b in few)}
        assert pairs <= {(i, j) for i, j in want if bands[i, 0] != bands[j, 0]} and len(few) == 10  # five groups of three components
        assert not neardup.block_links(keys, roots, sides, packed, bands, 1, [f"text {i}" for i in range(n)], memo, 0.8)


def test_near_duplicates_link_texts_whose_bands_have_other_centres(spark, monkeypatch):
    rng = np.random.default_rng(7)
    texts = []
    for g in range(6):  # relatives at 0.6 or so, each with a close copy
        common = [f"c{g}_{i}" for i in range(150)]
        for k in range(10):
            own = common + [f"o{g}_{k}_{i}" for i in range(40)]
            texts += [" ".join(own), " ".join(own[:-3] + [f"z{g}_{k}_{i}" for i in range(int(rng.integers(1, 4)))])]
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "CHARS", 500)
    x = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = {d.doc_id: d.class_id for d in neardup.near_duplicates(x).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)
