"""Cases that an operator once did in part only."""

import hashlib
import json
import random
from base64 import b64encode, urlsafe_b64encode

from pyspark.sql import functions as F

from lamina.llm import fingerprints, htmltext, mixing, pii, secretscan, toxicity


def test_likeness_survives_an_insertion_at_the_front_of_a_long_text():
    r, e, got = random.Random(8), fingerprints.Embedder(), []
    letters = lambda k: "".join(r.choice("abcdefghij klmno") for _ in range(k))
    for k in (10, 30, 60):
        for _ in range(12):
            text = letters(60_000)
            a, b = e.fingerprints([text, letters(k) + text])
            got.append(fingerprints.likeness(a, b))
    assert sum(got[:12]) / 12 > 0.9 and sum(got[12:24]) / 12 > 0.6 and sum(got[24:]) / 12 > 0.4


def test_every_disguise_of_the_lattice_is_restored(spark):
    r = random.Random(2)
    words = "the that with from have this they will would there their what about which when make like time just know take people into year your good some could them other than then look only come over think also back after".split()
    line = lambda: " ".join(r.choice(words) for _ in range(40))
    rows = [(i, line() + (" idiot " if i % 5 == 1 else " ") + line()) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 == 1)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    for bad in ("iidiioott", "i, d, i, o, t", "i|d|i|o|t", "i/d/i/o/t", "id iot", "i\u200bd\u200biot", "іdіоt", "ｉｄｉｏｔ", "idïot", "id*ot", "i*d*i*o*t", "1 d 1 0 t", "iiddiioott", "i,d,i,o,t", "i\td\ti\to\tt", "i\nd\ni\no\nt", "i  d  i  o  t", "(i d i o t!)", "i , d , i , o , t"):
        assert model.score(f"you are an {bad}") >= 0.5, bad
    for good in ("looking for a good book", "1 2 3 4 5", "10,100 and 1001", "a b c d e", "x, y, z, t"):
        assert model.score(good) < 0.5, good


def test_near_pairs_of_a_family_whose_centre_is_far(spark):
    """Twos of near texts whose shared bands all lie in a passage that every text has."""
    r = random.Random(12)
    letters = lambda k: "".join(r.choice("abcdefgh ") for _ in range(k))
    passage, texts = letters(300), []
    for _ in range(6):
        own = letters(500)
        texts += [passage + own, passage + "".join("q" if i % 6 == 0 else c for i, c in enumerate(own))]
    key = lambda t: bytearray(hashlib.md5(t.encode()).digest())
    want = {tuple(bytes(k) for k in sorted((key(a), key(b)))) for a, b in zip(texts[::2], texts[1::2], strict=True)}
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for block in (1024, 3):
        got = [(bytes(x.center), bytes(x.member)) for x in fingerprints.near_pairs(docs, like=0.8, block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_tiny_sources_meet_their_targets_beside_a_large_one(spark):
    """More than 64 M words in all; tiny sources lie at three times their size."""
    sizes = {"a": 30, "b": 10, "c": 100, "d": 1}
    small = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())], "doc_id long, text string, source string")
    large = spark.range(100, 780, numPartitions=8).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.lit(100_000)).alias("text"), F.lit("large").alias("source"))
    rows = mixing.mix(small.unionByName(large), whole=False).filter("source_size <= 100").collect()
    assert len(rows) == 4 and all(r.target == 3 * r.source_size and abs(r.taken - r.target) <= 1 for r in rows)


def test_personal_data_of_many_atoms_is_found_whole():
    w = pii.train()
    addresses = ("john.smith [at] example [dot] com", "john99 [at] mail7 [dot] com", "jo [at] mail [dot] example [dot] com", "John [At] Example [Dot] Com", "john.smith {at} example {dot} co {dot} uk")
    accounts = ("MT84 MALT 0110 0001 2345 MTLC AST0 01S", "MT94 1234 5678 9123 4567 8912 3456 789")
    for kind, values in (("email", addresses), ("iban", accounts)):
        for value in values:
            for text in (f"write to {value} today", f"{value}."):
                assert [(text[a:b], k) for a, b, k in pii.scan(text, w)] == [(value, kind)], text


def test_secrets_in_sentences_and_over_lines():
    url = lambda x: urlsafe_b64encode(x.encode()).decode().rstrip("=")
    for gap in ("", " ", "\n "):
        token = ".".join((url("{" + gap + '"alg":"HS256"}'), url("{" + gap + '"sub":"me"}'), "c2lnbmF0dXJlLW9mLWl0"))
        for end in (".", "...", ". Next", ""):
            text = f"It sent Bearer {token}{end}"
            assert [text[a:b] for a, b, k in secretscan.scan(text) if k == "jwt"] == [token], text
        assert not [1 for *_, k in secretscan.scan(f"{token}.more") if k == "jwt"]
    for n in (200, 201, 202):
        der = b"\x30\x81" + bytes([n + 6]) + b"\x02\x01\x00\x04\x81" + bytes([n]) + random.Random(n).randbytes(n)
        assert secretscan.is_key_der(der)
        key = b64encode(der).decode()
        for width in (20, 64, 76):
            lines = [key[i : i + width] for i in range(0, len(key), width)]
            for sep in ("\n", "\r\n", "\n    ", "\\n", "\\r\\n"):
                body = sep.join(lines)
                for text in (f"key:{sep}{body}{sep}Then it ends.", f"x {body}", f"{body}{sep}more"):
                    assert (text.index(body), text.index(body) + len(body), "der") in secretscan.scan(text), text
                    assert lines[1] not in secretscan.redact(text)
        pem = json.dumps({"k": f"-----BEGIN PRIVATE KEY-----\n{key}\n-----END PRIVATE KEY-----\n"}).replace("/", "\\/")
        assert "pem" in [k for *_, k in secretscan.scan(pem)]


def test_pages_keep_all_but_scripts_and_drawings():
    model = htmltext.Extractor(pages=200)
    para = "<p>{} long line of the article that goes on with words and more words until its end.</p>"
    page = lambda x: "<html><body><article><h1>A title</h1>" + para.format("First") + x + para.format("Last") + "</article></body></html>"
    clean = model.extract([page("")])[0]
    assert "First" in clean and "Last" in clean
    letters = "İ" * 200
    got = model.extract([page(f"<p>{letters}</p><SCRIPT>var a = '<p>no</p>';</Script>")])[0]
    assert got == clean.replace(" Last", f" {letters} Last")
    for raw in ("<svg><text>x</text></svg>", "<style>p {}</style>", "<svg>", "<template>", "<iframe>"):
        assert model.extract([page(raw)])[0] == clean, raw
    for kept in ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>", "<noscript><p>Read this text as well, with all of its words.</p></noscript>", "<object><p>Read this text as well, with all of its words.</p></object>", "<canvas>Read this text as well, with all of its words.</canvas>"):
        text = "so x=2 holds" if "math" in kept else "Read this text as well, with all of its words."
        assert model.extract([page(kept)])[0] == clean.replace(" Last", f" {text} Last"), kept


def test_the_pipeline_mixes_whole_documents(spark):
    r = random.Random(5)
    rows = [(i, f"  doc {i} " + " ".join("word" for _ in range(r.choice((5, 50, 3000)))), "abc"[i % 3], 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    texts, words = {i: t for i, t, *_ in rows}, dict.fromkeys("abc", 0)
    for x in mixing.stage(spark, docs, "").collect():
        assert x.text == texts[x.doc_id] and x.n_chars == len(x.text)
        words[x.source] += len(x.text.split())
    target = {x.source: x.target for x in mixing.mix(docs, keep=["source"]).distinct().collect()}
    assert all(abs(words[s] - target[s]) <= 1502 for s in words)
    shards = mixing.mix(docs, keep=["source"], shard_tokens=2000).groupBy("source").agg(F.sum("taken").alias("n")).collect()
    assert all(abs(x.n - target[x.source]) <= 1502 for x in shards)
