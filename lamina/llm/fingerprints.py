"""Document fingerprints by randomised edit embedding.

A walk reads a text character by character: at each time it emits the character
it stands on, and a shared random bit, looked up by time and character, tells
whether it moves on. Texts a few edits apart meet again soon after each edit, so
their edit distance maps to the Hamming distance of what the walks emit. One walk
and one clock run over the whole text; the random bits recur every ``PERIOD`` times.

The fingerprint samples the emitted string: ``SAMPLES`` fixed places in every
octave of the clock, each a digest of symbols emitted there and shortly after, as
two hex digits (00: after the end). So texts of any length compare by place, and
the fingerprint grows with the logarithm of the length. Likeness is the share of
equal samples, octaves weighed by their length. For near-duplicate search
(``near_duplicates``, query ``near_by_edits``), samples in groups are bands; pairs of
a band are candidates, confirmed by edit distance. ``op5_fingerprints`` gives
fingerprints and likenesses alone.

Edge cases: a null text counts as empty, and an empty text samples nothing but
the end; equal texts have equal fingerprints; rows of one id follow each other in
the order of a hash of their texts; null ids come first; the only row is followed by itself; an
empty table gives an empty result; texts are read whole; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from functools import cache
from itertools import accumulate, islice
from operator import getitem, itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, map_batches, materialise, table, utf32
from .neardup import BLOCK, CHARS, blocks_of, by_block, components, settled, text_key, with_nodes

PERIOD = 16_384
SAMPLES = 32
FIRST = 64
LAGS = (0, 4, 9)
CLASSES = 64
CHUNK = 1_000_000
#: Ids lie in about so many ranges, and each of these in as many as keep to so many characters; at most so many in all.
RANGES, RANGE_CHARS, MOST_RANGES = 256, 64_000_000, 1 << 20
#: Neighbours join while they hold no more characters than this, or than this part of all: each range can be a file, and for
#: files an executor's JVM starts processes (without Hadoop's native code), which count with all its memory until they run.
JOIN_CHARS, JOIN_SHARE = 8_000_000, 48
#: Near: edit distance of at most one less this share of the longer text. Fingerprints that are less alike than the second are no candidates.
LIKE, CANDIDATE = 0.9, 0.15
#: Bands are made of a text's last octaves.
OCTAVES = 3


@cache
def walk_start() -> list:
    """The walk's state at time 0.

    A state is a list: the next state for each class of the character it stands on,
    then the state that starts a text, then its own time, modulo ``PERIOD``.
    """
    bits = np.random.default_rng(20_260_101).integers(0, 2, size=(CLASSES, PERIOD), dtype=np.int8)
    after, t_next = np.empty((PERIOD, CLASSES), dtype=np.int32), np.zeros(CLASSES, dtype=np.int32)
    for t in range(2 * PERIOD - 1, -1, -1):
        now = t % PERIOD
        after[now] = t_next = np.where(bits[:, now] == 1, (now + 1) % PERIOD, t_next)
    states: list[list] = [[] for _ in range(PERIOD)]
    for t, (state, row) in enumerate(zip(states, after.tolist(), strict=True)):
        state += [states[k] for k in row]
        state += [states[0], t]
    return states[0]


def places(octave: int) -> np.ndarray:
    """Sampled places of the virtual clock: octave 0 is [0, 64), the next are [64, 128), [128, 256), ..."""
    rng = np.random.default_rng(77 + octave)
    low, high = (0, FIRST) if octave == 0 else (FIRST << (octave - 1), FIRST << octave)
    return np.sort(rng.choice(high - low, SAMPLES, replace=False) if high - low <= 1 << 16 else np.unique(rng.integers(0, high - low, 4 * SAMPLES))[:: 3][:SAMPLES]) + low


class Embedder:
    def __init__(self):
        self.start, self.places = walk_start(), {}

    def walks(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each character when it is first emitted; at a text's end, the place after it, when its walk ends."""
        classes = ((codes * np.uint32(2654435761)) >> np.uint32(26)).astype(np.uint8)
        classes[ends] = CLASSES
        states = islice(accumulate(classes.tobytes(), getitem, initial=self.start), len(classes))
        at = np.fromiter(map(itemgetter(CLASSES + 1), states), dtype=np.int64, count=len(classes))
        at[1:] = np.cumsum(np.diff(at) % PERIOD)
        first = np.concatenate([[0], ends[:-1] + 1])
        return at - np.repeat(at[first], ends - first + 1)

    def fingerprints(self, texts: list[str]) -> list[str]:
        out: list[str] = []
        start, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= CHUNK:
                out += self._some(texts[start : i + 1])
                start, size = i + 1, 0
        return out + self._some(texts[start:])

    def _some(self, texts: list[str]) -> list[str]:
        if not texts:
            return []
        codes = utf32("\0".join([*texts, ""]))
        n = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        ends = np.cumsum(n + 1) - 1
        at = self.walks(codes, ends)
        reach = at[ends]
        wide = reach.max() + 1
        clock = np.repeat(np.arange(len(texts), dtype=np.int64), n + 1) * wide + at  # ascending
        octaves = 1 + np.ceil(np.log2(np.maximum(reach, FIRST) / FIRST)).astype(np.int64)
        hexed: list[list[str]] = [[] for _ in texts]
        for o in range(int(octaves.max())):
            have = np.nonzero(octaves > o)[0]
            if o not in self.places:
                self.places[o] = places(o)
            v = self.places[o]
            end = reach[have][:, None]
            real = v[None, :] < end
            h = np.zeros(real.shape, dtype=np.uint64)
            for lag in LAGS:
                when = np.minimum(v[None, :] + lag, np.maximum(end - 1, 0))
                i = np.searchsorted(clock, (have[:, None] * wide + when).ravel(), side="right").reshape(real.shape) - 1
                c = codes[i]
                h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            digest = np.where(real, 1 + (h % np.uint64(255)), 0).astype(np.uint8)
            for row, d in enumerate(have.tolist()):
                hexed[d].append(digest[row].tobytes().hex())
        return ["".join(x) for x in hexed]


def likeness(a: str, b: str) -> float:
    """Share of equal samples of two fingerprints, octaves weighed by their length."""
    if a == b:
        return 1.0
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    size = max(len(x), len(y))
    x, y = (np.frombuffer(v.ljust(size, b"\0"), dtype=np.uint8).reshape(-1, SAMPLES) for v in (x, y))
    weight = FIRST * 2.0 ** np.maximum(np.arange(len(x)) - 1, 0)
    some = (x != 0) | (y != 0)
    total = float((some.sum(axis=1) * weight).sum())
    return float((((x == y) & some).sum(axis=1) * weight).sum() / total) if total else 1.0


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column."""
    state: dict = {}

    @F.arrow_udf("string")
    def tell(texts: pa.Array) -> pa.Array:
        if not state:
            state["e"] = Embedder()
        return pa.array(state["e"].fingerprints([t or "" for t in texts.to_pylist()]), type=pa.string())

    return tell(text)


def edited(text: str, after: str) -> str:
    """The text with its last half replaced by as much of the start of the one after it."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def ranges(rows: DataFrame, parts: int = RANGES, chars: int = RANGE_CHARS) -> tuple[DataFrame, DataFrame, int]:
    """Rows with a range number ``part`` by id, in order; the ranges' heads; and how many ranges there are.

    ``parts`` ranges by quantiles, and each of these in equal steps of its ids, so that
    a range has about ``chars`` characters; small neighbours make up one range. Heads: range, the id and hash of its first
    row, and the range that comes before it (before the first: the last); one row a
    range, at most ``MOST_RANGES``. Null ids make up the first range. The driver gets
    ``parts`` rows.
    """
    got = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10_000).alias("q")).first()["q"] or []
    cuts = sorted(set(got))
    coarse = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>"), lambda c: c <= F.col("doc_id"))) + 1)
    sizes = sorted((r["r"], r["low"], r["high"], r["n"]) for r in rows.groupBy(coarse.alias("r")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum(F.length("text").cast("long") + 1).alias("n")).collect())
    most = max(1, MOST_RANGES // max(1, len(sizes)))
    small, joined = min(chars, JOIN_CHARS, -(-sum(n for *_, n in sizes) // JOIN_SHARE)), None  # characters of the last range, if more may join it
    at, first, number = F.lit(None).cast("int"), 0, F.col("_coarse")
    table: dict[str, dict[int, int]] = {"first": {}, "low": {}, "width": {}, "steps": {}}
    for r, low, high, n in sizes:
        steps = 1 if low is None else max(1, min(most, -(-n // chars), high - low + 1))
        if joins := joined is not None and steps == 1 and joined + n <= small:
            first -= 1
        for k, v in (("first", first), ("low", low or 0), ("width", 1 if low is None else -(-(high - low + 1) // steps)), ("steps", steps)):
            table[k][r] = v
        first += steps
        joined = n + (joined if joins else 0) if steps == 1 and low is not None else None
    if sizes:
        look = {k: F.element_at(F.create_map(*[F.lit(x).cast("bigint") for r, v in t.items() for x in (r, v)]), number.cast("bigint")) for k, t in table.items()}
        at = (look["first"] + F.coalesce(F.call_function("div", F.col("doc_id") - look["low"], look["width"]), F.lit(0))).cast("int")
    placed = rows.withColumn("_coarse", coarse).withColumn("part", at).drop("_coarse")
    held = placed.groupBy("part").agg(F.min(F.struct("doc_id", "h")).alias("least"))
    order = Window.partitionBy(F.lit(1)).orderBy("part")
    last = F.max("part").over(Window.partitionBy(F.lit(1)))
    heads = held.select("part", F.col("least.doc_id").alias("head_id"), F.col("least.h").alias("head_h"), F.coalesce(F.lag("part").over(order), last).alias("before"))
    return placed, heads, first


def with_next(docs: DataFrame, text: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness to it and to the next row's.

    Rows go to ranges of ids once; each range also gets the first row of the next.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows, heads, count = ranges(rows.withColumn("h", F.xxhash64("text")))
    # a range's first row, once more, for the range before it; there are at most MOST_RANGES heads
    heads = materialise(heads, "fp-heads").withColumnRenamed("part", "of")
    x = rows.join(F.broadcast(heads), F.col("part") == F.col("of"), "left")
    is_head = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h"))
    x = x.withColumn("to", F.explode(F.when(is_head, F.array(F.lit(None).cast("int"), F.col("before"))).otherwise(F.array(F.lit(None).cast("int")))))
    rows = x.select("doc_id", "text", "h", F.coalesce("to", "part").alias("part"), F.col("to").isNotNull().cast("int").alias("guest"))

    def make():
        embed, held = Embedder(), {"part": None, "row": None}
        names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")

        def pairs(x: dict):
            """(row, the row after it) for rows of a part, in order; only its first guest counts."""
            for part, guest, i, t in zip(x["part"], x["guest"], x["doc_id"], x["text"], strict=True):
                if part != held["part"]:
                    held.update(part=part, row=None)
                if held["row"] is not None:
                    yield held["row"], t
                held["row"] = None if guest else (i, t)

        def run(x: dict) -> dict | None:
            todo = list(pairs(x))
            if not todo:
                return None
            out: dict = {k: [] for k in names}
            texts = [row[1] for row, _ in todo]
            after = [t for _, t in todo]
            prints = dict(zip(every := list(dict.fromkeys([*texts, *after])), embed.fingerprints(every), strict=True))
            new = [edited(a, b) for a, b in zip(texts, after, strict=True)]
            for (i, t), b, e, p in zip((r for r, _ in todo), after, new, embed.fingerprints(new), strict=True):
                own = prints[t]
                for k, v in zip(names, (i, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), own, p, likeness(own, p), likeness(own, prints[b])), strict=True):
                    out[k].append(v)
            return out

        return run

    dealt = rows.repartition(max(1, count), "part").sortWithinPartitions("part", "guest", "doc_id", "h").drop("h")
    return map_batches(dealt, make, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def print_matrix(prints: list[str]) -> np.ndarray:
    """Fingerprints as rows of samples, zero where a text has ended."""
    raw = [bytes.fromhex(p) for p in prints]
    wide = max(map(len, raw), default=0)
    return np.frombuffer(b"".join(r.ljust(wide, b"\0") for r in raw), dtype=np.uint8).reshape(len(raw), wide)


class Prints:
    """Fingerprints of a block, compared one with many."""

    def __init__(self, prints: list[str], band: int):
        self.m, self.band = print_matrix(prints), band
        octaves = self.m.shape[1] // SAMPLES
        self.weight = np.repeat(FIRST * 2.0 ** np.maximum(np.arange(octaves) - 1, 0), SAMPLES)
        self.low = np.array([first_band(len(p) // 2, band) for p in prints])

    def likeness(self, i: int, others: np.ndarray) -> np.ndarray:
        """``likeness`` of one row and others."""
        x = self.m[others]
        some = (x != 0) | (self.m[i] != 0)
        total = some @ self.weight
        return np.where(total > 0, (((x == self.m[i]) & some) @ self.weight) / np.maximum(total, 1e-9), 1.0)

    def first_shared(self, i: int, others: np.ndarray) -> np.ndarray:
        """The first band that one row and others share."""
        x = self.m[others].reshape(len(others), -1, self.band)
        same = (x == self.m[i].reshape(-1, self.band)).all(axis=2) & (x != 0).any(axis=2)
        same &= np.arange(same.shape[1]) >= np.maximum(self.low[others], self.low[i])[:, None]
        return same.argmax(axis=1)

    def candidates(self, sides: list):
        """Pairs of rows ``(i, others, likeness)`` that are alike by their fingerprints; of two sides, one of each."""
        side = np.array(sides)
        two = len(set(sides)) > 1
        for i in range(len(side) - 1):
            others = np.arange(i + 1, len(side))
            if two:
                others = others[side[others] != side[i]]
            like = self.likeness(i, others)
            good = like >= CANDIDATE
            if good.any():
                yield i, others[good], like[good]


def first_band(samples: int, band: int) -> int:
    """The first band of a text's last ``OCTAVES`` octaves, which hold most of its walk."""
    return max(0, samples // SAMPLES - OCTAVES) * (SAMPLES // band)


def edits_within(a: str, b: str, most: int) -> int | None:
    """The edit distance if it is at most ``most``; bit-parallel, a column of the table in one number."""
    if abs(len(a) - len(b)) > most:
        return None
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    a, b = a[start:], b[start:]
    while a and b and a[-1] == b[-1]:
        cut = next((k for k in range(1, min(len(a), len(b))) if a[-k - 1] != b[-k - 1]), min(len(a), len(b)))
        a, b = a[: len(a) - cut], b[: len(b) - cut]
    if not a or not b:
        return len(a) + len(b) if len(a) + len(b) <= most else None
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = full, 0, len(a)  # rows where the column goes up, and down, by one
    for left, c in zip(range(len(b) - 1, -1, -1), b, strict=True):
        same = where.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same
        rise, fall = down | (full & ~(diagonal | up)), up & diagonal
        score += 1 if rise & top else -1 if fall & top else 0
        if score - left > most:
            return None
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        same |= down
        up, down = fall | (full & ~(same | rise)), rise & same
    return score if score <= most else None


def near_pairs(docs: DataFrame, *, like: float = LIKE, text: str = "text", band: int = 4, block: int = BLOCK) -> DataFrame:
    """``center, member`` (keys of texts, the smaller first) and ``likeness``: links that join all near texts.

    Bands are ``band`` samples of one of a text's last ``OCTAVES`` octaves. Texts of a
    band go to blocks of about ``block`` rows, and each two blocks meet by themselves.
    Pairs whose fingerprints are alike by ``CANDIDATE`` are compared by edit distance,
    most alike first, unless links found in the block join them already: a pair is
    near if its distance is at most (1 - like) times the longer text. So no task grows
    with a band, and what is written grows with texts and links, while fingerprints of
    a band are compared by the square of its texts.
    """
    x = docs.select(text_key(F.col(text)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    x = x.groupBy("key").agg(F.any_value("text").alias("text"))
    bound_batches(docs.sparkSession)
    x = materialise(x.withColumn("fp", fingerprint(F.col("text"))).withColumn("chars", F.length("text")), "fp-texts")
    width, each = 2 * band, SAMPLES // band
    low = F.greatest(F.lit(0), F.length("fp") / (2 * SAMPLES) - OCTAVES).cast("int") * each
    last = (F.length("fp") / width - 1).cast("int")
    bands = x.select("key", F.explode(F.when(last >= low, F.sequence(low, last))).alias("at"), "fp").withColumn("v", F.substring("fp", F.col("at") * width + 1, F.lit(width)))
    bands = bands.filter(F.col("v") != "0" * width).select("key", "at", F.xxhash64("at", "v").alias("band"))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("band")
    bands = materialise(bands.join(shared, "band"), "fp-bands")
    alone = docs.sparkSession.createDataFrame([], "key binary, root binary")

    def opened(rows: dict) -> dict:
        found: set[int] = set()
        for i, others, _ in Prints(rows["fp"], band).candidates(rows["side"]):
            found.update((i, *others.tolist()))
        return {n: [rows[n][k] for k in sorted(found)] for n in ("band", "at", "key")}

    def linked(rows: dict) -> dict:
        p, top, out = Prints(rows["fp"], band), {}, {"center": [], "member": [], "likeness": []}

        def find(v):
            while (up := top.get(v, v)) != v:
                top[v] = v = top.get(up, up)
            return v

        todo = []
        for i, others, alike in p.candidates(rows["side"]):
            mine = p.first_shared(i, others) == rows["at"][0]
            todo += [(-v, i, j) for v, j in zip(alike[mine].tolist(), others[mine].tolist(), strict=True)]
        for _, i, j in sorted(todo):
            if (a := find(i)) == (b := find(j)):
                continue
            one, two = rows["text"][i], rows["text"][j]
            size = max(len(one), len(two), 1)
            d = edits_within(one, two, int((1 - like) * size + 1e-9))
            if d is not None:
                top[a] = b
                for n, v in (("center", min(rows["key"][i], rows["key"][j])), ("member", max(rows["key"][i], rows["key"][j])), ("likeness", 1 - d / size)):
                    out[n].append(v)
        return out

    rows = blocks_of(bands.withColumn("weight", F.lit(1)), alone, block).join(x.select("key", "fp"), "key")
    left = materialise(by_block(rows, opened, "band long, at int, key binary").distinct(), "fp-open")
    left = left.join(x.select("key", (F.lit(1) + F.floor(F.col("chars") / CHARS)).alias("weight")), "key")
    rows = blocks_of(left, alone, block).join(x.select("key", "fp", "text"), "key")
    return by_block(rows, linked, "center binary, member binary, likeness double").dropDuplicates(["center", "member"])


def near_duplicates(docs: DataFrame, *, like: float = LIKE, text: str = "text", band: int = 4) -> DataFrame:
    """``doc_id, class_id, class_rows``: classes of texts that are near by edit distance, named by their smallest id."""
    signed = docs.select(text_key(F.col(text)).alias("key"), F.col("doc_id").cast("long").alias("doc_id"))
    roots = components(materialise(near_pairs(docs, like=like, text=text, band=band), "fp-links"))
    nodes = signed.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"))
    nodes = materialise(nodes.join(roots, "key", "left").select("key", "rows", "first", F.coalesce("root", "key").alias("root")), "fp-nodes")
    return with_nodes(signed, materialise(settled(nodes), "fp-classes")).select("doc_id", "class_id", "class_rows")


def near_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(table(spark, sf_dir, "documents"))


