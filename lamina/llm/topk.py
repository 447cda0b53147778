"""Exact top-k inner-product search over norm-sorted vectors.

Vectors of integers (floor(256 x) of each component) are turned by the singular
vectors of the table's second moments, so that a few first dimensions hold most of
the mass. A block's vectors are taken in order of descending length. For a query
with the score to beat s: when |q| |x| < s, all that follow in the block are out;
else the product over the first dimensions plus the product of the lengths of the
rests (Cauchy-Schwarz) bounds the score; only what may still reach s is multiplied
out, in integers. The first score to beat comes from the ``SEEDS`` longest vectors
of the whole table.

Blocks hold vectors of one range of length (``RANGES`` equal steps, so few numbers
reach the driver). Each vector goes to its block once; a query goes to the blocks
whose longest vector may still reach its score, and to no others. A task holds one
block and a batch of queries, and only k rows a query leave a block.

Edge cases: a null vector, or one with a null or non-finite component, or one
without an id, takes no part; vectors of other lengths than a query's aren't its
candidates; ties go to the smaller id; a query never meets rows of its own id;
repeated rows are candidates each; an empty table gives an empty result; other
columns aren't read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Sent, map_batches, materialise, table

K = 5
SEEDS = 2048
#: Vectors in a block at most, and where there are too few of these to keep all cores busy at least.
MOST, LEAST = 32_768, 1024
RANGES = 64
#: Queries and vectors that meet at once.
QUERIES, STEP = 1024, 512
#: Pairs multiplied out at once.
PAIRS = 32_768
HEAD = 16


def integers(vectors: DataFrame) -> DataFrame:
    """``id, dim, v`` (array of long) of the rows that take part."""
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.filter(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("id"), F.size("embedding").alias("dim"), F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("long")).alias("v"))


def matrix(rows: list) -> np.ndarray:
    return np.array(rows, dtype=np.float64).reshape(len(rows), -1)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of paired rows; Python integers where doubles could round."""
    if a.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= 2.0**53:
        return np.array([sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for p, q in zip(a, b, strict=True)], dtype=object)
    return np.einsum("ij,ij->i", a, b).astype(np.int64)


def exact_pairs(q: np.ndarray, i: np.ndarray, x: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``exact`` for rows i of q and j of x, some at a time: copies of the rows stay small."""
    return np.concatenate([exact(q[i[a : a + PAIRS]], x[j[a : a + PAIRS]]) for a in range(0, len(i), PAIRS)])


def second_moments(rows: DataFrame) -> dict[int, np.ndarray]:
    """By dimension, the sum of outer products: one dim x dim matrix a task reaches the driver's sum."""

    def make():
        total: dict[int, np.ndarray] = {}

        def run(x: dict) -> None:
            by: dict[int, list] = {}
            for d, v in zip(x["dim"], x["v"], strict=True):
                by.setdefault(d, []).append(v)
            for d, v in by.items():
                m = matrix(v)
                total[d] = total.get(d, 0) + m.T @ m

        def finish() -> dict:
            cells = [(d, i, float(c)) for d, m in total.items() for i, c in enumerate(np.ravel(m))]
            return {"dim": [c[0] for c in cells], "i": [c[1] for c in cells], "c": [c[2] for c in cells]}

        run.finish = finish
        return run

    got = map_batches(rows.select("dim", "v"), make, "dim int, i int, c double").groupBy("dim", "i").agg(F.sum("c").alias("c")).toPandas()
    return {int(d): g.sort_values("i")["c"].to_numpy().reshape(int(d), int(d)) for d, g in got.groupby("dim")}


class Block:
    """Vectors by descending length, turned once for all queries that meet them."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, turn: np.ndarray):
        size = np.sqrt((x * x).sum(axis=1))
        order = np.lexsort((ids, -size))
        self.ids, self.x, self.size, self.turn = ids[order], x[order], size[order], turn
        self.turned, self.head = self.x @ turn, min(HEAD, x.shape[1])
        self.rest = rests(self.turned, self.head)
        self.turned, self.top = self.turned[:, : self.head].copy(), float(np.abs(x).max()) if x.size else 0.0


def rests(turned: np.ndarray, head: int) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (turned[:, head:] ** 2).sum(axis=1)))


def search_block(queries: tuple, block: Block, beat: np.ndarray, k: int = K) -> list[list[tuple]]:
    """For each query its k best of a block: (score, id), highest first, smaller id first.

    ``queries``: (ids, integer matrix); ``beat``: the score that a candidate must
    reach. Returns only candidates that reach it.
    """
    qid, q = queries
    xid, x, size, xr, x_rest, head = block.ids, block.x, block.size, block.turned, block.rest, block.head
    qr = q @ block.turn
    q_rest, q_size = rests(qr, head), np.sqrt((q * q).sum(axis=1))
    fits = not q.size or np.abs(q).max() * block.top * x.shape[1] < 2.0**53
    best: list[list[tuple]] = [[] for _ in qid]
    beat = beat.astype(np.float64).copy()
    for a in range(0, len(xid), STEP):
        slack = 1e-6 * q_size * max(size[a], 1.0) + 1e-3
        live = np.nonzero(q_size * size[a] + slack >= beat)[0]
        if not len(live):
            break
        b = min(len(xid), a + STEP)
        bound = qr[live, :head] @ xr[a:b].T + q_rest[live][:, None] * x_rest[a:b][None, :]
        may = bound + slack[live][:, None] >= beat[live][:, None]
        may &= qid[live][:, None] != xid[a:b][None, :]
        i, j = np.nonzero(may)
        if not len(i):
            continue
        rows, cols = may.any(axis=1), may.any(axis=0)
        if fits and len(i) * 8 > rows.sum() * cols.sum():  # most of these pairs: whole products, exact in doubles
            whole = np.zeros(may.shape)
            whole[np.ix_(rows, cols)] = q[live[rows]] @ x[a:b][cols].T
            keep = whole[i, j] >= beat[live[i]]
            i, j = i[keep], j[keep]
            scores = whole[i, j].astype(np.int64)
        else:
            scores = exact_pairs(q, live[i], x, a + j)
        if not len(i):
            continue
        cuts = np.nonzero(np.diff(i))[0] + 1
        for part in np.split(np.arange(len(i)), cuts):
            at = live[i[part[0]]]
            s, ids = scores[part], xid[a + j[part]]
            pick = [p for p in zip(s.tolist(), ids.tolist(), strict=True) if p[0] >= beat[at]]
            best[at] = sorted([*best[at], *pick], key=lambda p: (-p[0], p[1]))[:k]
            if len(best[at]) == k:
                beat[at] = max(beat[at], best[at][-1][0])
    return best


def search(vectors: DataFrame, queries: DataFrame, *, k: int = K, most: int = MOST) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's k best among all vectors of other ids."""
    spark = vectors.sparkSession
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))
    x = materialise(integers(vectors).withColumn("size", length).withColumn("row", F.monotonically_increasing_id()), "topk")
    moments = second_moments(x)
    turns = {d: np.linalg.svd(m)[0] for d, m in moments.items()}
    seeds: dict[int, tuple] = {}
    for d in turns:  # at most SEEDS rows for each dimension in use
        top = x.filter(F.col("dim") == d).orderBy(F.col("size").desc(), "id", "row").limit(SEEDS).toPandas()
        seeds[d] = (top["id"].to_numpy(np.int64), matrix(list(top["v"])))
    sent = Sent(spark, (turns, seeds))

    def first_beat():
        longest: dict[int, Block] = {}

        def run(got: dict) -> dict:
            out = {"id": got["id"], "dim": got["dim"], "v": got["v"], "size": got["size"], "beat": [None] * len(got["id"])}
            turns, seeds = sent.value
            for d in set(got["dim"]):
                at = [i for i, e in enumerate(got["dim"]) if e == d]
                q = (np.array([got["id"][i] for i in at], np.int64), matrix([got["v"][i] for i in at]))
                if d not in longest and d in seeds:
                    longest[d] = Block(*seeds[d], turns[d])
                found = search_block(q, longest[d], np.full(len(at), -np.inf), k) if d in longest else [[]] * len(at)
                for i, best in zip(at, found, strict=True):
                    out["beat"][i] = float(best[-1][0]) if len(best) == k else float("-inf")
            return out

        return run

    asked = materialise(map_batches(integers(queries).withColumn("size", length), first_beat, "id long, dim int, v array<long>, size double, beat double"), "topk-asked")
    end = x.agg(F.min("size").alias("low"), F.max("size").alias("high"), F.count(F.lit(1)).alias("n")).first()
    low, step = float(end["low"] or 0.0), max(float((end["high"] or 0.0) - (end["low"] or 0.0)) / RANGES, 1e-9)
    # range 0 holds the longest vectors
    x = x.withColumn("range", F.greatest(F.lit(0), F.least(F.lit(RANGES - 1), RANGES - 1 - F.floor((F.col("size") - low) / step))).cast("int"))
    held = sorted((r["range"], r["longest"], r["n"]) for r in x.groupBy("range").agg(F.max("size").alias("longest"), F.count(F.lit(1)).alias("n")).collect())
    if not held:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    block = min(most, max(LEAST, -(-end["n"] // (4 * spark.sparkContext.defaultParallelism))))
    blocks = {r: -(-n // block) for r, _, n in held}
    first = dict(zip(blocks, np.cumsum([0, *blocks.values()]).tolist(), strict=False))
    number = lambda by: F.element_at(F.create_map(*[F.lit(v) for r in by for v in (r, int(by[r]))]), F.col("range"))
    here = x.select((number(first) + F.pmod(F.xxhash64("row"), number(blocks))).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "dim", "v", F.lit(None).cast("double").alias("beat"))
    # how many blocks, longest first, may still hold what a query looks for
    last = [(longest, first[r] + blocks[r]) for r, longest, _ in held]
    slack = lambda longest: F.lit(1e-6) * F.col("size") * max(longest, 1.0) + 1e-3
    wanted = F.greatest(*[F.when(F.col("size") * longest + slack(longest) >= F.col("beat"), upto).otherwise(0) for longest, upto in [*last, (0.0, 0)]])
    there = asked.withColumn("block", F.explode(F.when(wanted > 0, F.sequence(F.lit(0), (wanted - 1).cast("int"))))).select("block", F.lit(1).alias("kind"), "id", "dim", "v", "beat")
    dealt = here.unionByName(there).repartition(max(1, sum(blocks.values())), "block").sortWithinPartitions("block", "kind")
    wanted_schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def meet(batches):
        turns = sent.value[0]
        now, vectors = None, {}

        def by_dim(t: pa.RecordBatch):
            dims = np.asarray(t.column("dim"))
            for d in np.unique(dims).tolist():
                part = t.filter(pa.array(dims == d))
                yield d, np.asarray(part.column("id")), np.asarray(part.column("v").flatten(), dtype=np.float64).reshape(len(part), d), np.asarray(part.column("beat").fill_null(0.0))

        for batch in batches:
            at, kind = np.asarray(batch.column("block")), np.asarray(batch.column("kind"))
            cuts = [0, *(np.nonzero((at[1:] != at[:-1]) | (kind[1:] != kind[:-1]))[0] + 1).tolist(), len(at)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if at[a] != now:
                    now, vectors = at[a], {}
                if kind[a] == 0:
                    for d, ids, v, _ in by_dim(batch.slice(a, b - a)):
                        vectors.setdefault(d, []).append((ids, v))
                    continue
                vectors = {d: p if isinstance(p, Block) else Block(np.concatenate([i for i, _ in p]), np.concatenate([v for _, v in p]), turns[d]) for d, p in vectors.items()}
                for c in range(a, b, QUERIES):
                    rows: list[tuple] = []
                    for d, ids, q, beat in by_dim(batch.slice(c, min(QUERIES, b - c))):
                        if d in vectors:
                            found = search_block((ids, q), vectors[d], beat, k)
                            rows += [(int(i), int(v), int(s)) for i, best in zip(ids, found, strict=True) for s, v in best]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=wanted_schema)

    got = dealt.mapInArrow(meet, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return got.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "embeddings")
    return search(x, x.filter(F.col("vec_id") % 50 == 0))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(x.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v x ON x.vec_id <> q.vec_id AND len(x.v) = len(q.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""
