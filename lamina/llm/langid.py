"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, at each of its positions, one bit a language.
A character n-gram is put in at two positions for every language that uses it;
reading it back ANDs the two masks and so gives all languages that may contain it
at once. For each text the masks are counted by language, the counts are freed of
the false positives that each language's fill predicts, and the largest decides.

What is learned: n-gram frequencies of at most ``PER_LANGUAGE`` documents a
language (a seeded sample), of which the ``NGRAMS`` most frequent of a language
that are not far commoner in another one go into the filter; fewer where languages
are so many that the filter would pass ``TABLE`` bytes, which is what is broadcast.

Edge cases: a null text, or one without letters, is ``und`` with score 0; a text
whose n-grams are all unknown gets the most frequent language with score 0; ties
go to the first language by name; with nothing to learn from all is ``und``;
repeated rows get equal results; texts of any length are read whole; an empty table
gives an empty result; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Sent, bound_batches, held_out, map_batches, table, utf32

N = 4
PER_LANGUAGE = 4000
NGRAMS = 60_000
#: Bytes of the filter at most, whatever the number of languages.
TABLE = 1 << 27
#: A language gets an n-gram if its rate is this share of the highest rate of any.
KEPT_RATE = 0.15
CHUNK = 1 << 20


#: Letters have code points below this; all beyond are marks, private or unassigned.
LETTERS_END = 0x34000


def letters() -> np.ndarray:
    """For code points up to ``LETTERS_END``: letters as they are, all else a space."""
    out = np.full(LETTERS_END + 1, 32, dtype=np.uint32)
    for c in range(LETTERS_END):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            out[c] = c
    return out


def grams(texts: list[str], kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams with a letter inside, and the index of the text each is of."""
    pad = " " * (N - 1)
    codes = utf32(pad + pad.join(t.lower() for t in texts) + pad)
    codes = kept[np.minimum(codes, LETTERS_END)]
    lengths = np.fromiter((len(t.lower()) + N - 1 for t in texts), dtype=np.int64, count=len(texts))
    h = codes[: len(codes) - N + 1].astype(np.uint64)
    some = codes[: len(codes) - N + 1] != 32
    for k in range(1, N):
        part = codes[k : len(codes) - N + 1 + k]
        h = h * np.uint64(0x9E3779B97F4A7C15) + part
        some |= part != 32
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    of = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)[: len(h)]
    return h[some], of[some]


def chunks(texts: list[str]):
    """Runs of texts of about a million characters."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


class Filter:
    def __init__(self, languages: list[str], masks: dict[int, int] | tuple[np.ndarray, np.ndarray], usual: str | None):
        self.languages, self.usual = languages, usual
        keys, bits = masks
        self.words = max(1, -(-len(languages) // 8))
        self.bits = max(16, int(np.ceil(np.log2(max(1, len(keys)) * 8))))
        self.table = np.zeros((1 << self.bits, self.words), dtype=np.uint8)
        for at in self.places(keys):
            np.bitwise_or.at(self.table, at, bits)
        self.false = np.array([float(np.mean(self.table[:, i // 8] >> (i % 8) & 1)) ** 2 for i in range(len(languages))])

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.uint64((1 << self.bits) - 1)
        return (h & low).astype(np.int64), (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def read(self, h: np.ndarray) -> np.ndarray:
        a, b = self.places(h)
        return self.table[a] & self.table[b]

    def score(self, texts: list[str | None], kept: np.ndarray) -> tuple[list[str], list[float]]:
        names, scores = [], []
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        for a, b in chunks([t or "" for t in texts]):
            part = [t or "" for t in texts[a:b]]
            h, of = grams(part, kept)
            masks = self.read(h)
            n = np.bincount(of, minlength=len(part)).astype(float)
            hits = np.zeros((len(part), len(self.languages)))
            for w in range(self.words):
                by = np.bincount(of.astype(np.int64) * 256 + masks[:, w], minlength=len(part) * 256).reshape(-1, 256)
                for i in range(8 * w, min(len(self.languages), 8 * w + 8)):
                    hits[:, i] = by[:, np.arange(256) >> (i % 8) & 1 == 1].sum(axis=1)
            true = np.maximum(0.0, (hits - n[:, None] * self.false) / (1 - self.false))
            best = true.argmax(axis=1)
            total = true.sum(axis=1)
            for i in range(len(part)):
                if n[i] == 0:
                    names.append("und")
                    scores.append(0.0)
                elif total[i] <= 0:
                    names.append(self.usual)
                    scores.append(0.0)
                else:
                    names.append(self.languages[best[i]])
                    scores.append(float(min(1.0, true[i, best[i]] / total[i])))
        return names, scores


def learn(docs: DataFrame, *, per_language: int = PER_LANGUAGE, most: int = NGRAMS) -> Filter:
    """A filter from the rows of ``docs`` (all of them may be learned from)."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Filter([], (np.zeros(0, np.uint64), np.zeros((0, 1), np.uint8)), None)
    # as many entries as there are languages; a map needs no shuffle of the texts
    part = F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(1.0, per_language / n))])[F.col("lang")]
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(20_011)), F.lit(1_000_003)) <= part * 1_000_003
    rows = rows.filter(drawn).select("lang", "text")

    def make():
        kept = letters()

        def run(x: dict) -> dict:
            lang, hashes, times = [], [], []
            for name in sorted(set(x["lang"])):
                texts = [t for k, t in zip(x["lang"], x["text"], strict=True) if k == name]
                for a, b in chunks(texts):
                    h, n = np.unique(grams(texts[a:b], kept)[0], return_counts=True)
                    lang += [name] * len(h)
                    hashes.append(h.view(np.int64))
                    times.append(n)
            cat = lambda v: np.concatenate(v) if v else np.zeros(0, np.int64)
            return {"lang": lang, "h": cat(hashes), "n": cat(times)}

        return run

    seen = map_batches(rows, make, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.col("n").desc(), "h")
    languages = sorted(counts)
    words = -(-len(languages) // 8)
    # 8 to 16 places an n-gram, a bit a language each
    most = max(1, min(most, TABLE // (16 * len(languages) * words)))
    got = seen.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= most).select("lang", "h", "n").toPandas()
    keys, inverse = np.unique(got["h"].to_numpy(np.int64), return_inverse=True)
    place = {k: i for i, k in enumerate(languages)}
    which = np.array([place[k] for k in got["lang"]], dtype=np.int64)
    n = got["n"].to_numpy(float)
    rate = n / np.maximum(np.bincount(which, weights=n, minlength=len(languages)), 1)[which]
    highest = np.zeros(len(keys))
    np.maximum.at(highest, inverse, rate)
    inside = rate >= np.maximum(highest[inverse] * KEPT_RATE, 1e-12)
    masks = np.zeros((len(keys), words), dtype=np.uint8)
    np.bitwise_or.at(masks, (inverse[inside], which[inside] // 8), (1 << (which[inside] % 8)).astype(np.uint8))
    return Filter(languages, (keys.view(np.uint64), masks), max(languages, key=lambda k: counts[k]))


def predict(model: Filter, text: Column, spark: SparkSession) -> Column:
    """A struct ``lang, score`` of a text column."""
    sent = Sent(spark, model)
    bound_batches(spark)
    state: dict = {}

    @F.arrow_udf("struct<lang:string,score:double>")
    def tell(texts: pa.Array) -> pa.Array:
        if not state:
            state.update(kept=letters())
        names, scores = sent.value.score(texts.to_pylist(), state["kept"])
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return tell(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.filter(~held_out("doc_id")))
    x = docs.select("doc_id", held_out("doc_id").alias("held_out"), predict(model, F.col("text"), spark).alias("p"))
    return x.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
