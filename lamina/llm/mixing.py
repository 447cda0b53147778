"""Mixing sources to target weights by Sainte-Laguë apportionment; DataFrame functions only.

Targets: every source gets a weight; together they share all words. No target
passes ``most`` times its source's size; what is over goes to the rest by weight
(a common level, found in closed form from the sources sorted by cap over
weight). Words, which are blocks of one token at every input size, are then allotted
to sources, in each source to its runs of ``RUN`` shards, and in each run to its
shards, by the highest quotients weight / (2 seats + 1). In a shard,
documents lie in a seeded order; the quota takes all words as often as it can and
then the first ones once more, so at most one document of a shard is cut. The
query gives words taken to the word; elsewhere that document is taken whole or not,
whichever is nearer, and the difference goes on to the source's next shard.

Edge cases: a null or empty text has size 0 and takes 0; a null source is a
source of its own, last in order; repeated rows are numbered and mixed row by row, so
they part over shards; null ids are kept; texts of any length are counted whole; an
empty table gives an empty result; other columns aren't read, whatever their names,
but names that begin with ``_lm_`` are the stage's own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table, tag

WORD = r"[^\x20\x09-\x0D]+"
CYCLE = (5.0, 2.0, 1.0)
MOST = 3
#: Tokens in a shard; a shard is what one seeded draw runs over.
SHARD_TOKENS = 131_072
#: Shards of a source in a run; they carry a difference on, one to the next.
RUN = 1024
#: Rows alike in all that one task numbers.
COPIES = 65_536


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cycle: tuple = CYCLE, most: float = MOST) -> DataFrame:
    """``source, source_size`` in; adds ``weight`` and ``target``. One row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order) - 1
    weight = reduce(lambda rest, k: F.when(F.pmod(rank, F.lit(len(cycle))) == k, F.lit(float(cycle[k]))).otherwise(rest), range(len(cycle) - 1), F.lit(float(cycle[-1])))
    x = sizes.withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rest_cap = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    x = x.withColumn("level_here", rest_cap / rest_weight).withColumn("capped_here", F.col("level_here") * F.col("weight") > F.col("cap"))
    # the level is that of the first source, in this order, that stays under its cap
    x = x.withColumn("level", F.min_by("level_here", F.struct(F.col("capped_here").cast("int"), F.col("cap") / F.col("weight"))).over(every))
    return x.select("source", "source_size", "weight", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))


def sainte_lague(parties: DataFrame, key: list[str], group: list[str], weight: str, seats: str, out: str, total: Column | None = None) -> DataFrame:
    """Adds ``out``, integer seats by the highest quotients weight / (2 s + 1), in each group.

    Only seats near a party's exact quota are listed: the divisor can't differ
    from the mean by more than half the number of parties over all seats, so the
    lists hold some three rows a party, however many seats there are.
    """
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    n, all_weight = F.count(F.lit(1)).over(w), F.sum(weight).over(w)
    x = parties.withColumn("_n", n).withColumn("_quota", F.when(all_weight > 0, F.col(weight) / all_weight * F.col(seats)).otherwise(0.0))
    slack = F.when(F.col(seats) > 0, F.col("_quota") * F.col("_n") / (2.0 * F.col(seats))).otherwise(0.0) + 1.5
    x = x.withColumn("_low", F.greatest(F.lit(0), F.floor(F.col("_quota") - slack)).cast("long")).withColumn("_high", F.ceil(F.col("_quota") + slack).cast("long"))
    x = x.withColumn("_left", F.col(seats) - F.sum("_low").over(w))
    rows = x.withColumn("_s", F.explode(F.sequence("_low", "_high")))
    best = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    best = best.orderBy((F.col(weight) / (2 * F.col("_s") + 1)).desc(), *[F.col(k).asc_nulls_last() for k in key], "_s")
    rows = rows.withColumn("_won", ((F.row_number().over(best) <= F.col("_left")) & (F.col(weight) > 0)).cast("long"))
    rest = [c for c in parties.columns if c not in key]
    won = rows.groupBy(*key).agg(*[F.first(c).alias(c) for c in rest], (F.first("_low") + F.sum("_won")).alias(out))
    return won.select(*parties.columns, out)


def settle(y: DataFrame) -> DataFrame:
    """Takes the cut document of each shard once more whole or not, and carries the difference to the next shard of its run."""
    over = F.pmod(F.col("taken"), F.greatest(F.col("size"), F.lit(1)))
    cut = y.filter(over > 0).select("tag", run_of("shard").alias("run"), F.struct("shard", over.alias("over"), "size").alias("cut"))

    def step(state: Column, x: Column) -> Column:
        due = state["carry"] + x["over"]
        won = due * 2 >= x["size"]
        return F.struct((due - F.when(won, x["size"]).otherwise(F.lit(0).cast("long"))).alias("carry"), F.when(won, F.array_append(state["won"], x["shard"])).otherwise(state["won"]).alias("won"))

    start = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<long>").alias("won"))
    # at most one cut document a shard, so at most RUN of them in a list
    won = cut.groupBy("tag", "run").agg(F.sort_array(F.collect_list("cut")).alias("cuts"))
    won = won.select("tag", F.explode(F.aggregate("cuts", start, step, lambda s: s["won"])).alias("shard"), F.lit(True).alias("won"))
    y = y.join(won, ["tag", "shard"], "left")
    more = F.when((over > 0) & F.coalesce("won", F.lit(False)), F.col("size")).otherwise(F.lit(0).cast("long"))
    return y.withColumn("taken", F.col("taken") - over + more).drop("won")


def run_of(shard: str) -> Column:
    return F.floor(F.col(shard) / RUN).cast("long")


def digest(*parts: Column) -> Column:
    """A whole number below 2 ** 60 from a digest that other engines have as well."""
    return F.conv(F.left(F.md5(F.concat_ws(":", *parts)), F.lit(15)), 16, 10).cast("long")


def single_rows(x: DataFrame, seed: int) -> DataFrame:
    """Rows with a seeded place ``at``; rows that are alike in all are told apart by a number, so they part as well."""
    same = x.groupBy(*x.columns).agg(F.count(F.lit(1)).alias("n"))
    few = same.filter(F.col("n") <= COPIES).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    # a row with very many copies is dealt to tasks in parts first
    many = same.filter(F.col("n") > COPIES).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES)))).repartition("tie", "part")
    many = many.withColumn("copy", F.explode(F.sequence(F.col("part") * COPIES + 1, F.least("n", (F.col("part") + 1) * COPIES)))).drop("part")
    at = digest(F.lit(str(seed)), F.coalesce(F.col("k_0").cast("string"), F.lit("")), F.col("tie"), F.col("copy").cast("string"))
    return few.unionByName(many).withColumn("at", at).drop("n", "copy")


def mix(docs: DataFrame, *, seed: int = 7, cycle: tuple = CYCLE, most: int = MOST, shard_tokens: int = SHARD_TOKENS, keep: list[str] | None = None, text: str = "text", whole: bool = True) -> DataFrame:
    """One row a document: the kept columns, ``size, source_size, target, taken``; with ``whole``, taken is a multiple of size."""
    keep = ["doc_id"] if keep is None else keep
    x = docs.select(*[F.col(k).alias(f"k_{i}") for i, k in enumerate(keep)], F.col("source").cast("string").alias("source"), word_count(F.col(text)).alias("size"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("tie"))
    x = materialise(single_rows(x, seed).withColumn("tag", tag("source")), "mix")
    sources = targets(x.groupBy("source").agg(F.sum("size").alias("source_size")), cycle, most)
    every = Window.partitionBy(F.lit(1))
    sources = sources.withColumn("words", F.round(F.sum("target").over(every)).cast("long"))
    sources = sainte_lague(sources, ["source"], [], "target", "words", "seats")
    sources = sources.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(float(shard_tokens)))).cast("long"))
    s = materialise(sources.select(tag("source").alias("tag"), "source_size", "target", "seats", "shards"), "mix-sources")
    # as many rows as there are sources: Spark broadcasts it while it is under its own threshold
    x = x.join(s.select("tag", "source_size", "target", "shards"), "tag").withColumn("shard", F.pmod(F.col("at"), F.col("shards")))
    # words go to a source's runs of shards first, then in each run to its shards: no task sees all shards of a source
    parts = materialise(x.groupBy("tag", "shard").agg(F.sum("size").cast("double").alias("weight")).withColumn("run", run_of("shard")), "mix-shards")
    runs = parts.groupBy("tag", "run").agg(F.sum("weight").alias("weight")).join(s.select("tag", "seats"), "tag")
    runs = sainte_lague(runs, ["tag", "run"], ["tag"], "weight", "seats", "run_seats").select("tag", "run", "run_seats")
    quota = sainte_lague(parts.join(runs, ["tag", "run"]), ["tag", "shard"], ["tag", "run"], "weight", "run_seats", "quota")
    n = F.col("weight").cast("long")
    quota = quota.select("tag", "shard", n.alias("n"), F.least(F.col("quota"), most * n).alias("q"))
    y = x.join(quota, ["tag", "shard"])
    lie = Window.partitionBy("tag", "shard").orderBy("at", "k_0", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.greatest(F.col("n"), F.lit(1))
    y = y.withColumn("end", F.sum("size").over(lie)).withColumn("times", F.call_function("div", F.col("q"), n)).withColumn("more", F.pmod(F.col("q"), n))

    def before(offset: Column) -> Column:
        """Words taken before an offset in the shard: all of them ``times`` over, and those of the first ``more`` once more."""
        return F.col("times") * offset + F.least(offset, F.col("more"))

    taken = F.when(F.col("size") > 0, before(F.col("end")) - before(F.col("end") - F.col("size"))).otherwise(F.lit(0)).cast("long")
    y = y.withColumn("taken", taken)
    if whole:
        y = settle(materialise(y.select(*[f"k_{i}" for i in range(len(keep))], "tag", "shard", "size", "source_size", "target", "taken"), "mix-taken"))
    return y.select(*[F.col(f"k_{i}").alias(k) for i, k in enumerate(keep)], "size", "source_size", "target", "taken")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), whole=False)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document, whole, as often as the mix takes it.

    A document that isn't taken goes. Columns are those of documents.
    """
    key = {"_lm_id": F.col("doc_id"), "_lm_source": F.col("source").cast("string"), "_lm_h1": F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), "_lm_h2": F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.lit(1))}
    mixed = mix(docs.select("text", "source", *[c.alias(k) for k, c in key.items()]), keep=list(key))
    # rows alike in id, source and text share what the mix takes of them
    times = F.call_function("div", F.col("taken"), F.greatest(F.col("size"), F.lit(1)))
    drawn = mixed.groupBy(*key).agg(F.sum(times).alias("_lm_all"), F.count(F.lit(1)).alias("_lm_rows")).filter("_lm_all > 0")
    named = drawn.select("_lm_all", "_lm_rows", *[F.col(k).alias(f"{k}r") for k in key])
    x = docs.withColumns(key)
    x = x.join(named, reduce(lambda a, b: a & b, [x[k].eqNullSafe(named[f"{k}r"]) for k in key]))
    turn = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1)))
    got = F.call_function("div", F.col("_lm_all"), F.col("_lm_rows")) + (F.col("_lm_turn") <= F.pmod("_lm_all", "_lm_rows")).cast("long")
    x = x.withColumn("_lm_turn", turn).withColumn("_lm_copy", F.explode(F.array_repeat(F.lit(1), got.cast("int"))))
    return x.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def _seats(rows: str, group: str, key: str, seats: str, out: str) -> str:
    """SQL for ``sainte_lague``: the highest quotients of each group, near each party's exact quota."""
    q = f"CASE WHEN sum(weight) OVER g > 0 THEN weight / sum(weight) OVER g * {seats} ELSE 0 END"
    slack = f"CASE WHEN {seats} > 0 THEN q * parties / (2.0 * {seats}) ELSE 0 END + 1.5"
    over = f"(PARTITION BY {group})" if group else "()"
    return f"""{out}_q AS (SELECT *, {q} AS q, count(*) OVER g AS parties FROM {rows} WINDOW g AS {over}),
{out}_l AS (SELECT *, CAST(greatest(0, floor(q - ({slack}))) AS BIGINT) AS low, CAST(ceil(q + {slack}) AS BIGINT) AS high FROM {out}_q),
{out}_s AS (SELECT *, {seats} - sum(low) OVER {over} AS open FROM {out}_l),
{out}_r AS (SELECT *, unnest(range(low, high + 1)) AS s FROM {out}_s),
{out}_w AS (SELECT *, weight > 0 AND row_number() OVER (PARTITION BY {group or "1"} ORDER BY weight / (2 * s + 1) DESC, {key}, s) <= open AS won FROM {out}_r),
{out}_n AS (SELECT {key.replace(" NULLS LAST", "")}, any_value(low) + count(*) FILTER (won) AS {out} FROM {out}_w GROUP BY {key.replace(" NULLS LAST", "")})"""


ORACLE = rf"""WITH x0 AS (SELECT doc_id, CAST(source AS VARCHAR) AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(text, '')) AS tie FROM documents),
x1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size, tie) AS copy, coalesce('=' || source, '') AS tag FROM x0),
x2 AS (SELECT *, CAST('0x' || left(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || tie || ':' || copy), 15) AS BIGINT) AS lie FROM x1),
s0 AS (SELECT tag, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM x2 GROUP BY tag),
s1 AS (SELECT *, CAST({MOST} * source_size AS DOUBLE) AS cap, CAST(([{", ".join(map(str, CYCLE))}])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(CYCLE)} + 1 AS INTEGER)] AS DOUBLE) AS w FROM s0),
s2 AS (SELECT *, ((SELECT sum(source_size) FROM s0) - coalesce(sum(cap) OVER b, 0)) / ((SELECT sum(w) FROM s1) - coalesce(sum(w) OVER b, 0)) AS level, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS place FROM s1 WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, least(cap, (SELECT arg_min(level, place) FROM s2 WHERE level * w <= cap) * w) AS target, CAST(greatest(1, ceil(source_size / {float(SHARD_TOKENS)})) AS BIGINT) AS shards FROM s2),
s4 AS (SELECT tag, source, target AS weight, CAST(round((SELECT sum(target) FROM s3)) AS BIGINT) AS words FROM s3),
{_seats("s4", "", "source NULLS LAST", "words", "seats")},
x3 AS (SELECT x2.*, source_size, target, shards, lie % shards AS shard FROM x2 JOIN s3 USING (tag)),
p0 AS (SELECT tag, any_value(source) AS source, shard, shard // {RUN} AS run, CAST(sum(size) AS DOUBLE) AS weight FROM x3 GROUP BY tag, shard),
r0 AS (SELECT tag, run, CAST(sum(weight) AS DOUBLE) AS weight, any_value(seats) AS seats FROM p0 JOIN seats_n ON p0.source IS NOT DISTINCT FROM seats_n.source GROUP BY tag, run),
{_seats("r0", "tag", "tag, run", "seats", "run_seats")},
p1 AS (SELECT p0.*, run_seats FROM p0 JOIN run_seats_n USING (tag, run)),
{_seats("p1", "tag, run", "tag, shard", "run_seats", "quota")},
p2 AS (SELECT tag, shard, CAST(weight AS BIGINT) AS n, CAST(least(quota, {MOST} * weight) AS BIGINT) AS quota FROM p0 JOIN quota_n USING (tag, shard)),
y AS (SELECT x3.*, n, quota // greatest(n, 1) AS times, quota % greatest(n, 1) AS more, sum(size) OVER (PARTITION BY tag, shard ORDER BY lie, doc_id, tie ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS till FROM x3 JOIN p2 USING (tag, shard))
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size > 0 THEN times * size + least(till, more) - least(till - size, more) ELSE 0 END AS BIGINT) AS taken FROM y"""
