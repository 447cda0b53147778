"""Near-duplicates by BagMinHash over multisets of five-word shingles.

Signature. A shingle that occurs c times has weight c. Weights are cut into
dyadic ranges [0,1), [1,2), [2,4), ...; on every range of every shingle runs a
Poisson process whose rate is the range's length, seeded by shingle and range
alone, and each of its points has a height in the range and one of ``M``
components. A document keeps the points below its weight. Component i of its
signature is its earliest point there, so two documents agree in a component with
probability equal to their weighted Jaccard similarity. Only points up to a time
that is likely to fill all components are made, and later ones if it did not.

Classes. Equal texts are one node (by a 128-bit digest). In the first turn nodes
that share a band are compared with that band's smallest node: a group of copies
becomes one component at a cost linear in its rows. Every other pair of a band is
then settled by signatures: whoever agrees in fewer than ``AGREE`` of ``M``
components is no candidate (a pair at 0.8 falls below that about once in a
million). Nodes that have a candidate in another component meet once more, with
their texts, and candidates are compared exactly, most alike first, unless links
found so far already join them. So no pair of a band is left unsettled, and what
is written grows with nodes and links, not with pairs. Bands larger than
``BLOCK`` are dealt in blocks of about that many nodes, each two blocks to a
task, but for blocks of the band's largest component, which meet only the rest.
The components of the links are the classes. Class ids and sizes are settled for texts,
not rows, so a text with many copies is one row until the end.

Edge cases: a document column named ``_lm_key`` is the one name that the stage can't
take; null and empty texts count as equal; texts under five words are one
shingle of all their words; null ids keep their rows, and sort last for a class's
representative; repeated rows fall in one class; an empty table gives an empty
result; other columns aren't read.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, map_batches, materialise, table

WORDS = 5
LIKE = 0.8
BANDS, ROWS = 25, 5
M = BANDS * ROWS
#: Members of a band that are compared in one task with their centre.
TOGETHER = 256
#: Components of two signatures that must agree for a candidate: 4.9 deviations under 0.8 of them.
AGREE = 78
#: Nodes of a band in one block; with their texts, a node counts once more for so many characters.
BLOCK, CHARS = 1024, 8192
#: A text is hot if more than one in so many documents have it.
HOT = 1000
#: Shingles of the bags that a block keeps at once.
KEPT = 1_000_000
#: Signature bytes in a word: seven of seven bits each, so that sums stay within a signed word.
BYTES = 7
PACKED = -(-M // BYTES)
LOWS, HIGHS = sum(0x7F << 8 * k for k in range(BYTES)), sum(0x80 << 8 * k for k in range(BYTES))
PIECE = 200_000  # words signed at once
#: Odd multipliers of a shingle's words.
ODD = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) ** 5 % 2**64 | 1 for k in range(WORDS)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def unit(h: np.ndarray) -> np.ndarray:
    """Doubles in (0, 1] from hashes."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def word_hash(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def shingle_hashes(texts: list[str], memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, and the index of the text that each is of."""
    words = [t.lower().split() for t in texts]
    n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = np.fromiter(map(memo.__getitem__, chain.from_iterable(words)), dtype=np.uint64, count=int(n.sum()))
    starts = np.cumsum(n) - n
    long, at, of = np.nonzero(n >= WORDS)[0], [], []
    counts = n[long] - (WORDS - 1)
    if len(long):
        of.append(np.repeat(long, counts))
        base = np.repeat(starts[long] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        h = np.zeros(len(base), dtype=np.uint64)
        for k in range(WORDS):
            h += flat[base + k] * ODD[k]
        at.append(mix(h))
    short = np.nonzero(n < WORDS)[0]
    if len(short):
        of.append(short)
        value = np.zeros(len(short), dtype=np.uint64)
        for i, d in enumerate(short.tolist()):
            h = np.zeros(1, dtype=np.uint64) + np.uint64(int(n[d]) + 1)
            for w in flat[starts[d] : starts[d] + n[d]]:
                h = mix(h + w + np.uint64(0x9E3779B97F4A7C15))
            value[i] = h[0]
        at.append(value)
    return (np.concatenate(at), np.concatenate(of)) if at else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def bags(h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) with counts; only shingles that occur twice in a text are sorted with it."""
    key = mix(h + of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.sort(key)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return h, of, np.ones(len(h), dtype=np.int64)
    at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    many = twice[at] == key
    i = np.nonzero(many)[0]
    _, first, count = np.unique(at[i], return_index=True, return_counts=True)
    return np.concatenate([h[~many], h[i[first]]]), np.concatenate([of[~many], of[i[first]]]), np.concatenate([np.ones(int((~many).sum()), dtype=np.int64), count])


def signatures(h: np.ndarray, of: np.ndarray, count: np.ndarray, texts: int, m: int = M) -> np.ndarray:
    """BagMinHash signatures, a row a text: in each component the hash of its earliest point."""
    sig, best = np.zeros(texts * m, dtype=np.uint64), np.full(texts * m, np.inf)
    # a row for each dyadic range that a weight reaches into
    levels = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1
    row = np.repeat(np.arange(len(h)), levels)
    level = np.arange(len(row)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    rate = np.maximum(low, 1.0)
    doc, weight = of[row], count[row]
    seed = mix(h[row] + level.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    total = np.bincount(doc, weights=rate, minlength=texts)
    limit = m * np.log(m) / np.maximum(total, 1e-9)
    step = np.ones(len(seed), dtype=np.uint64)
    t = -np.log(unit(mix(seed + np.uint64(1)))) / rate
    while len(seed):
        now = np.nonzero(t <= limit[doc])[0]  # rows whose next point is within their text's limit
        while len(now):
            s, d, r = seed[now], doc[now], rate[now]
            point = mix(s ^ mix(step[now] + np.uint64(0x632BE59BD9B4E019)))
            inside = low[now] + r * unit(mix(point + np.uint64(3))) <= weight[now]
            cell = (d * m + (point % np.uint64(m)).astype(np.int64))[inside]
            when = t[now][inside]
            np.minimum.at(best, cell, when)
            mine = best[cell] == when
            sig[cell[mine]] = mix(point[inside][mine] + np.uint64(5))
            step[now] += np.uint64(1)
            t[now] += -np.log(unit(mix(s + mix(step[now])))) / r
            now = now[t[now] <= limit[d]]
        # a signature is final once every component has a point: later points are never earlier
        open_ = np.isinf(best.reshape(texts, m)).any(axis=1) & (total > 0)
        stay = open_[doc]
        if not stay.any():
            break
        limit = limit * 1.6
        seed, doc, weight, low, rate, t, step = (v[stay] for v in (seed, doc, weight, low, rate, t, step))
    return sig.reshape(texts, m)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    out = np.zeros((len(sig), bands), dtype=np.uint64)
    for b in range(bands):
        h = np.full(len(sig), b + 1, dtype=np.uint64)
        for r in range(rows):
            h = mix(h + sig[:, b * rows + r] + np.uint64(0x9E3779B97F4A7C15))
        out[:, b] = h
    return out.view(np.int64)


def pack(sig: np.ndarray) -> np.ndarray:
    """Seven bits of each component, seven components a word; what is past the last is 0."""
    v = np.zeros((len(sig), PACKED * BYTES), dtype=np.uint64)
    v[:, : sig.shape[1]] = sig >> np.uint64(57)
    return (v.reshape(len(sig), PACKED, BYTES) << (np.arange(BYTES, dtype=np.uint64) * np.uint64(8))).sum(axis=2, dtype=np.uint64).view(np.int64)


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Components in which packed signatures agree."""
    differ = np.bitwise_count(((a ^ b) + np.int64(LOWS)) & np.int64(HIGHS)).sum(axis=-1, dtype=np.int64)
    return M - differ


def agreement(a: Column, b: Column) -> Column:
    """``agreeing`` as an expression."""
    differ = [F.bit_count((a[i].bitwiseXOR(b[i]) + F.lit(LOWS)).bitwiseAND(F.lit(HIGHS))) for i in range(PACKED)]
    return F.lit(M) - sum(differ[1:], differ[0])


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def sign(docs: DataFrame, text: str = "text") -> DataFrame:
    """``key, doc_id, bands, sig``, a row a document."""

    def make():
        memo = Memo(word_hash)

        def run(x: dict) -> dict:
            texts, keys, bands, packed = [t or "" for t in x["text"]], x["key"], {}, {}
            todo = list({k: i for i, k in enumerate(keys)}.values())
            while todo:
                part, size = [], 0
                while todo and (not part or size < PIECE * 6):
                    part.append(todo.pop())
                    size += len(texts[part[-1]])
                h, of = shingle_hashes([texts[i] for i in part], memo)
                got = signatures(*bags(h, of), len(part))
                bands.update((keys[i], row) for i, row in zip(part, band_keys(got).tolist(), strict=True))
                packed.update((keys[i], row) for i, row in zip(part, pack(got).tolist(), strict=True))
            return {"key": keys, "doc_id": x["doc_id"], "bands": [bands[k] for k in keys], "sig": [packed[k] for k in keys]}

        return run

    rows = docs.select(text_key(F.col(text)).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_batches(rows, make, "key binary, doc_id long, bands array<long>, sig array<long>")


def bag_of(text: str, memo: Memo) -> Counter:
    return Counter(shingle_hashes([text], memo)[0].tolist())


def overlap(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two multisets."""
    x, y = (a, b) if len(a) <= len(b) else (b, a)
    both = sum(min(n, y[k]) for k, n in x.items() if k in y)
    return both / (sum(a.values()) + sum(b.values()) - both)


def compare(pairs: DataFrame, texts: DataFrame, like: float = LIKE) -> DataFrame:
    """Of ``center, member`` pairs those whose texts overlap at least ``like``.

    A centre's text goes once to every ``TOGETHER`` members or so, not to each.
    """
    size = pairs.groupBy("center").agg(F.count(F.lit(1)).alias("n"))
    salt = F.pmod(F.xxhash64("member"), F.greatest(F.lit(1), F.ceil(F.col("n") / TOGETHER)).cast("long"))
    rows = pairs.join(size, "center").select("center", salt.alias("salt"), "member")
    asked = rows.select("center", "salt", F.lit(1).alias("kind"), F.col("member").alias("key"))
    asked = asked.unionByName(rows.select("center", "salt").distinct().select("center", "salt", F.lit(0).alias("kind"), F.col("center").alias("key")))
    given = asked.join(texts.select("key", "text"), "key")

    def make():
        memo, held = Memo(word_hash), {"of": None}

        def run(x: dict) -> dict:
            out: dict = {"center": [], "member": []}
            for c, s, kind, key, text in zip(x["center"], x["salt"], x["kind"], x["key"], x["text"], strict=True):
                if kind == 0:
                    held.update(of=(c, s), bag=bag_of(text or "", memo))
                elif held["of"] == (c, s) and overlap(held["bag"], bag_of(text or "", memo)) >= like:
                    out["center"].append(c)
                    out["member"].append(key)
            return out

        return run

    given = given.select("center", "salt", "kind", "key", "text").repartition("center", "salt").sortWithinPartitions("center", "salt", "kind")
    return map_batches(given, make, "center binary, member binary")


def likely(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Of ``center, member`` pairs those whose signatures agree in ``AGREE`` components."""
    x = pairs.join(sigs.select(F.col("key").alias("member"), F.col("sig").alias("m_sig")), "member")
    x = x.join(sigs.select(F.col("key").alias("center"), F.col("sig").alias("c_sig")), "center")
    return x.filter(agreement(F.col("m_sig"), F.col("c_sig")) >= AGREE).select("center", "member")


def crossing(roots: list, sides: list, sig: np.ndarray):
    """Rows of a block with those after them that are candidates: ``(row, rows, agreement)``.

    Candidates agree in ``AGREE`` components and lie in different graph components
    and, if the block has two sides, on different sides. Rows of the largest graph
    component come last and begin no pair.
    """
    names, size = {r: i for i, r in enumerate(dict.fromkeys(roots))}, Counter(roots)
    part = np.array([names[r] for r in roots])
    order = np.lexsort((part, np.array([size[r] for r in roots])))
    part, side, sig = part[order], np.array(sides)[order], sig[order]
    two = len(set(sides)) > 1
    ends = np.append(np.nonzero(part[1:] != part[:-1])[0] + 1, len(part))
    end = ends[np.searchsorted(ends, np.arange(len(part)), side="right")]
    for i in range(int(ends[-2]) if len(ends) > 1 else 0):
        count = agreeing(sig[end[i] :], sig[i])
        good = count >= AGREE
        if two:
            good &= side[end[i] :] != side[i]
        if good.any():
            yield int(order[i]), order[end[i] :][good], count[good]


def open_rows(roots: list, sides: list, sig: np.ndarray, first: np.ndarray | None = None, at: int = 0) -> list[int]:
    """Rows of a block with a candidate; given each row's bands, with one whose first shared band is ``at``."""
    found = np.zeros(len(roots), dtype=bool)
    for i, others, _ in crossing(roots, sides, sig):
        if first is not None:
            others = others[(first[others] == first[i]).argmax(axis=1) == at]
        if len(others):
            found[i] = True
            found[others] = True
    return np.nonzero(found)[0].tolist()


def block_links(keys: list, roots: list, sides: list, sig: np.ndarray, first: np.ndarray, at: int, texts: list, memo: Memo, like: float) -> list[tuple]:
    """Links between components of a block: candidates compared exactly, most alike first.

    ``first`` holds each row's bands; a pair is that of the first band it shares.
    """
    top, bags_, size, out, todo = {}, {}, 0, [], []

    def find(x):
        while (up := top.get(x, x)) != x:
            top[x] = x = top.get(up, up)
        return x

    for i, others, count in crossing(roots, sides, sig):
        mine = (first[others] == first[i]).argmax(axis=1) == at
        todo.append(np.stack([np.full(int(mine.sum()), i), others[mine], count[mine]], axis=1))
    if not todo:
        return out
    todo = np.concatenate(todo)
    for i, j, _ in todo[np.argsort(-todo[:, 2], kind="stable")].tolist():
        if (x := find(roots[i])) == (y := find(roots[j])):
            continue
        for k in (i, j):
            if k not in bags_:
                if size > KEPT:
                    bags_, size = {n: bags_[n] for n in (i, j) if n in bags_}, 0
                bags_[k] = bag_of(texts[k] or "", memo)
                size += len(bags_[k])
        if overlap(bags_[i], bags_[j]) >= like:
            top[x] = y
            out.append((min(keys[i], keys[j]), max(keys[i], keys[j])))
    return out


def blocks_of(bands: DataFrame, roots: DataFrame, most: int = BLOCK) -> DataFrame:
    """``band, at, i, j, side, key, root``: nodes of bands that several components share, in each pair of blocks to be compared.

    Blocks come to ``most`` by the sum of ``weight``. Those of a band's largest
    component have the higher numbers and aren't paired with each other.
    """
    x = bands.join(roots, "key", "left").select("band", "at", "key", "weight", F.coalesce("root", "key").alias("root"))
    sizes = x.groupBy("band", "root").agg(F.sum("weight").alias("w")).groupBy("band")
    sizes = sizes.agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("all"), F.max(F.struct("w", "root")).alias("top")).filter(F.col("n") > 1)
    sizes = sizes.select("band", F.col("top.root").alias("top"), F.ceil((F.col("all") - F.col("top.w")) / most).cast("int").alias("rest"), F.ceil(F.col("top.w") / most).cast("int").alias("own"))
    x, in_top, h = x.join(sizes, "band"), F.col("root") == F.col("top"), F.xxhash64("key")
    x = x.withColumn("side", F.when(in_top, F.col("rest") + F.pmod(h, F.col("own"))).otherwise(F.pmod(h, F.col("rest"))).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("rest") - 1 + F.when(in_top, 0).otherwise(F.col("own")))))
    return x.select("band", "at", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "key", "root")


def by_block(rows: DataFrame, settle, ddl: str) -> DataFrame:
    """``settle(columns)`` for each ``band, i, j`` gives columns of ``ddl``; blocks are bounded, see ``blocks_of``."""
    names, out_names = rows.columns, [f.split()[0] for f in ddl.split(", ")]

    def make():
        held: dict = {"of": None, "rows": []}

        def close(out: dict) -> None:
            if len(held["rows"]) > 1:
                for n, v in settle(dict(zip(names, map(list, zip(*held["rows"], strict=True)), strict=True))).items():
                    out[n].extend(v)

        def run(x: dict) -> dict:
            out: dict = {n: [] for n in out_names}
            for of, row in zip(zip(x["band"], x["i"], x["j"], strict=True), zip(*(x[n] for n in names), strict=True), strict=True):
                if of != held["of"]:
                    close(out)
                    held.update(of=of, rows=[])
                held["rows"].append(row)
            return out

        def finish() -> dict:
            out: dict = {n: [] for n in out_names}
            close(out)
            return out

        run.finish = finish
        return run

    return map_batches(rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j"), make, ddl)


def across(bands: DataFrame, roots: DataFrame, bodies: DataFrame, like: float = LIKE) -> DataFrame:
    """``center, member``: links of each band across components, as few as join all that belong together.

    ``bodies``: key, bands, sig, text, chars; texts go to the blocks in which a
    candidate of theirs first shares a band, and to no others.
    """

    def opened(x: dict) -> dict:
        rows = open_rows(x["root"], x["side"], np.array(x["sig"], dtype=np.int64), np.array(x["bands"], dtype=np.int64), x["at"][0])
        return {n: [x[n][k] for k in rows] for n in ("band", "at", "key", "weight")}

    def linked(x: dict) -> dict:
        got = block_links(x["key"], x["root"], x["side"], np.array(x["sig"], dtype=np.int64), np.array(x["bands"], dtype=np.int64), x["at"][0], x["text"], Memo(word_hash), like)
        return {"center": [a for a, _ in got], "member": [b for _, b in got]}

    weight = (F.lit(1) + F.floor(F.col("chars") / CHARS)).cast("long").alias("weight")
    rows = blocks_of(bands.withColumn("weight", F.lit(1)), roots, BLOCK).join(bodies.select("key", "bands", "sig", weight), "key")
    left = materialise(by_block(rows, opened, "band long, at int, key binary, weight long").distinct(), "dup-open")
    rows = blocks_of(left, roots, BLOCK).join(bodies.select("key", "bands", "sig", "text"), "key")
    return by_block(rows, linked, "center binary, member binary").distinct()


def components(links: DataFrame) -> DataFrame:
    """``key, root``: the smallest key of each connected component, by label passing with shortcuts."""
    both = links.select(F.col("center").alias("a"), F.col("member").alias("b"))
    both = materialise(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "dup-edges")
    labels = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("key"), F.least("a", "low").alias("root"))
    labels = materialise(labels, "dup-labels")
    while True:
        heard = both.join(labels, both["b"] == labels["key"]).groupBy("a").agg(F.min("root").alias("heard"))
        new = labels.join(heard, labels["key"] == heard["a"]).select("key", F.col("root").alias("old"), F.least("root", "heard").alias("near"))
        up = labels.select(F.col("key").alias("k"), F.col("root").alias("far"))
        new = new.join(up, new["near"] == up["k"]).select("key", "old", F.least("near", "far").alias("root"))
        new = materialise(new, "dup-labels")
        labels = new.select("key", "root")
        if new.filter(F.col("old") != F.col("root")).isEmpty():
            return labels


def row_key(doc_id: Column, key: Column) -> Column:
    """A digest of an id, which may be null, and of a text's key."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("long").cast("string"), F.lit("-")).cast("binary"), key)))


def nodes_of(docs: DataFrame, like: float, text: str) -> tuple[DataFrame, DataFrame]:
    """``signed`` (key, doc_id; a row a document) and ``nodes`` (key, root, rows, first; a row a text).

    ``first`` is the node's smallest id, with ``none`` true if it has no id.
    """
    signed = materialise(sign(docs, text), "dup-signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    nodes = materialise(signed.groupBy("key").agg(F.any_value("bands").alias("bands"), F.any_value("sig").alias("sig"), F.count(F.lit(1)).alias("rows"), first), "dup-nodes")
    bands = nodes.select("key", F.posexplode("bands").alias("at", "h")).select("key", "at", F.xxhash64("at", "h").alias("band"))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("band")
    bands = materialise(bands.join(shared, "band"), "dup-bands")
    wanted = materialise(bands.select("key").distinct(), "dup-wanted")
    # of each text one row, by a digest that no two ids share, so copies don't meet in one task
    chosen = nodes.select("key", "bands", "sig", "first").join(wanted.hint("merge"), "key")
    chosen = materialise(chosen.select("key", "bands", "sig", row_key(F.col("first.doc_id"), F.col("key")).alias("row")), "dup-chosen")
    found = docs.select(row_key(F.col("doc_id"), text_key(F.col(text))).alias("row"), F.col(text).alias("text")).join(chosen.hint("merge"), "row")
    bodies = materialise(found.dropDuplicates(["row"]).select("key", "bands", "sig", "text", F.coalesce(F.length("text"), F.lit(0)).alias("chars")), "dup-bodies")
    # first turn: the band's smallest key is its centre, and has no other pairs there after it
    center = bands.groupBy("band").agg(F.min("key").alias("center"))
    bands = materialise(bands.join(center, "band").filter(F.col("key") != F.col("center")), "dup-bands")
    pairs = materialise(likely(bands.select("center", F.col("key").alias("member")).distinct(), bodies), "dup-pairs")
    bands = bands.select("band", "at", "key")
    links = materialise(compare(pairs, bodies, like), "dup-links")
    links = links.unionByName(materialise(across(bands, components(links), bodies, like), "dup-links"))
    roots = components(links)
    nodes = nodes.select("key", "rows", "first").join(roots, "key", "left").select("key", "rows", "first", F.coalesce("root", "key").alias("root"))
    return signed.select("key", "doc_id"), nodes


def settled(nodes: DataFrame) -> DataFrame:
    """``key, rows, class_id, class_rows, kept_id, kept_key``: of each node its class, named by its smallest id."""
    each = nodes.groupBy("root").agg(F.sum("rows").alias("class_rows"), F.min("first").alias("first"))
    x = nodes.select("key", "rows", "root").join(each, "root")
    return x.select("key", "rows", F.col("first.doc_id").alias("class_id"), "class_rows", F.col("first.doc_id").alias("kept_id"), F.col("first.key").alias("kept_key"))


def with_nodes(signed: DataFrame, info: DataFrame) -> DataFrame:
    """Documents with what is known of their texts.

    A text that more than one in ``HOT`` documents have would be one task of a join;
    there are at most ``HOT`` of these, so they are sent to all tasks instead.
    """
    n = signed.count()
    hot = materialise(info.filter(F.col("rows") * HOT > n), "dup-hot")
    names = F.broadcast(hot.select("key"))
    cold = signed.join(names, "key", "left_anti").join(info, "key")
    return cold.unionByName(signed.join(F.broadcast(hot), "key"))


def near_duplicates(docs: DataFrame, *, like: float = LIKE, text: str = "text") -> DataFrame:
    """``doc_id, class_id, class_rows, kept``: the class is named by its smallest id, whose row is kept."""
    signed, nodes = nodes_of(docs, like, text)
    x = with_nodes(signed, materialise(settled(nodes), "dup-classes"))
    return x.select("doc_id", "class_id", "class_rows", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays: that of its smallest id (a null id only if there is no other).

    Rows of the same id and text count as one. Texts move once: whoever isn't its
    class's choice goes by a join on digests, and repeated rows go in the same partition.
    """
    _, nodes = nodes_of(docs, LIKE, "text")
    kept = settled(nodes).filter(F.col("key") == F.col("kept_key")).select(row_key(F.col("kept_id"), F.col("kept_key")).alias("_lm_key"))
    kept = materialise(kept, "dup-kept")
    rows = docs.withColumn("_lm_key", row_key(F.col("doc_id"), text_key(F.col("text"))))
    return rows.join(kept, "_lm_key", "left_semi").dropDuplicates(["_lm_key"]).select(*docs.columns)
