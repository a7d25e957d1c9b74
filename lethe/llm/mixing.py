"""Mixing sources to target weights by systematic sampling.

Within a source each document expects target / source_size copies. The expected copies are summed up
in an order that spreads document sizes evenly (size class, then a hash, then doc_id), one offset from
a seeded hash is added, and a document is emitted once for each integer that its step crosses.

The prefix sum has three levels, so that no task holds a whole source: ranks within small blocks
(source, size class, salt), block counts summed up within (source, size class), class counts summed
up within a source. The number of salts grows with the square root of the rows.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; sources
weigh 1, 2, 3, repeating, in the order of their code points; a target stops at ``cap`` times its
source's size and the excess goes to the others by weight; with no words at all targets are 0 and
each document expects no copy; repeated rows count as rows of their own; an empty table gives an
empty result; further columns pass through ``mix`` unchanged, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lethe.llm.common import WORD, Scratch, carried, md5_int, small

WEIGHTS = (1, 2, 3)


SIZED = ["doc_id", "src", "size"]
CHUNK = 1 << 16
BLOCK = ["src", "class", "salt"]


def _classed(docs: DataFrame, salts: int, *more) -> DataFrame:
    """(more..., doc_id, src, size, class, salt) of each row."""
    rows = docs.select(
        *more, "doc_id", F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1")).alias("src"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size")
    )
    top = F.when(F.col("size") < 8, F.col("size")).otherwise(F.expr("shiftright(size, cast(char_length(bin(size)) - 3 as int))"))
    return rows.withColumn("class", (F.char_length(F.bin("size")) * 8 + top).cast("long")).withColumn("salt", md5_int(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % F.lit(salts))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3) -> DataFrame:
    """(src, source_size, target) from (src, source_size), one row for each source.

    Sources that stop at their cap are those with the least cap per weight. With sources in that order,
    the level that the rest would get is the words left over by the weights left. It rises while the
    next source is capped and falls after that, so its largest value is where capping stops. Targets
    hang on all sources at once, so these windows are one task over as many rows as there are sources.
    """
    by_name, by_ratio = Window.orderBy("src"), Window.orderBy("ratio", "src")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    x = (
        sizes.withColumn("w", w.cast("long"))
        .withColumn("cap", F.col("source_size") * cap)
        .withColumn("ratio", F.col("cap").cast("double") / F.col("w"))
        .withColumn("left", F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("wleft", F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("level", F.col("left").cast("double") / F.col("wleft"))
    )
    level = F.max("level").over(all_rows)
    return x.select("src", "source_size", F.least(F.col("cap").cast("double"), F.col("w") * level).alias("target"))


def _blocks(counts: DataFrame, scratch: Scratch, weights: tuple[int, ...], cap: int, seed: str) -> DataFrame:
    """(src, class, salt, at, source_size, target, rate, u) from written (src, class, salt, n, words)."""
    below = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    classes = counts.groupBy("src", "class").agg(F.sum("n").alias("cn")).withColumn("class_at", F.coalesce(F.sum("cn").over(below("src", "class")), F.lit(0)))
    sizes = scratch.write(counts.groupBy("src").agg(F.sum("words").alias("source_size")), "sources")
    targets = small(source_targets(sizes, weights, cap), sizes.count(), 10_000)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (
        counts.withColumn("before", F.coalesce(F.sum("n").over(below(*BLOCK)), F.lit(0)))
        .join(classes.select("src", "class", "class_at"), ["src", "class"])
        .join(targets, "src")
        .select(*BLOCK, (F.col("before") + F.col("class_at")).alias("at"), "source_size", "target", rate.alias("rate"), (md5_int(F.concat(F.lit(seed), "src")).cast("double") / F.lit(4294967296.0)).alias("u"))
    )


def _with_copies(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """rows (with their rank in a block) and how often the mix takes each: the integers that its step crosses."""
    i = F.col("rank") + F.col("at")
    step = lambda i: F.floor(i.cast("double") * F.col("rate") + F.col("u"))
    return rows.join(blocks, BLOCK).withColumn("copies", (step(i) - step(i - 1)).cast("long"))


def _salts(docs: DataFrame) -> int:
    return max(1, math.isqrt(docs.count()))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3, seed: str = "mix") -> DataFrame:
    """docs, each row as often as the mix takes it."""
    scratch, salts = Scratch(docs.sparkSession, "mix"), _salts(docs)
    counts = scratch.write(_classed(docs, salts).groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "counts")
    # Texts settle ties, so that a task that runs again ranks rows of one doc_id as before.
    rows = _classed(docs, salts, carried(docs)).withColumn("rank", F.row_number().over(Window.partitionBy(*BLOCK).orderBy("doc_id", "size", F.xxhash64("row.text"))))
    taken = _with_copies(rows, _blocks(counts, scratch, weights, cap, seed)).where(F.col("copies") > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def mix_report(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken.

    Texts are read once: rows of equal doc_id, source and size are counted before they are shuffled, so
    that one doc_id, or none, may hold any share of the rows.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    same = scratch.write(_classed(docs, _salts(docs)).groupBy(*SIZED, "class", "salt").agg(F.count(F.lit(1)).alias("n")), "sizes")
    counts = scratch.write(same.groupBy(*BLOCK).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("words")), "counts")
    earlier = F.sum("n").over(Window.partitionBy(*BLOCK).orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    rows = same.withColumn("earlier", F.coalesce(earlier, F.lit(0)))
    chunk = lambda c: F.floor((c - 1) / F.lit(CHUNK)).cast("long")  # noqa: E731  arrays of bounded length
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), chunk(F.col("n")))))
    within = F.sequence(F.col("part") * CHUNK + 1, F.least(F.col("n"), (F.col("part") + 1) * CHUNK))
    rows = rows.select(*SIZED, "class", "salt", "earlier", F.explode(within).alias("k")).withColumn("rank", F.col("earlier") + F.col("k"))
    out = _with_copies(rows, _blocks(counts, scratch, weights, cap, seed))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce('0' || source, '1') AS src,
             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
               % greatest(1, floor(sqrt((SELECT count(*) FROM documents)))::BIGINT) AS salt FROM documents),
e AS (SELECT *, length(bin(size)) * 8 + CASE WHEN size < 8 THEN size ELSE size >> (length(bin(size)) - 3)::INT END AS class FROM d),
s AS (SELECT src, sum(size)::BIGINT AS source_size FROM d GROUP BY src),
w AS (SELECT src, source_size, (row_number() OVER (ORDER BY src) - 1) % 3 + 1 AS w FROM s),
r AS (SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / w AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lev
      FROM r WINDOW b AS (ORDER BY ratio, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT src, source_size, least(cap::DOUBLE, w * (SELECT max(lev) FROM l)) AS target FROM l),
x AS (SELECT e.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
        ('0x' || substr(md5('mix' || e.src), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u,
        row_number() OVER (PARTITION BY e.src ORDER BY class, salt, doc_id, size) AS i
      FROM e JOIN t ON e.src = t.src)
SELECT doc_id, size, source_size, target,
       (floor(i::DOUBLE * rate + u) - floor((i - 1)::DOUBLE * rate + u))::BIGINT * size AS taken
FROM x
"""
