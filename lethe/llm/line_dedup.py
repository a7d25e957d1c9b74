"""Line deduplication with levelled sorted runs of line hashes.

A run is a table of line keys, bucketed by hash with one sorted file for each bucket: how many documents
of a batch hold the key, and the key's owner where the batch saw it first. Batches arrive in descending
order of doc_id, so the batch whose anti-join with all earlier runs finds a key new holds the key's
largest doc_id. A batch's keys come out of their aggregation in the same buckets, so they merge with each
run as it lies: the runs are neither shuffled nor sorted again. Runs of a level are merged, side by side,
into one run of the next level once there are ``fanout`` of them.

Everything is DataFrame work: no Python touches a row.

Defined cases: a null or empty text is one empty line; lines shorter than ``min_chars`` after
stripping are never dropped; a document that repeats a line counts once; rows that repeat a doc_id
count as one document and each loses the same lines; the owner keeps all its copies of a line; a null
doc_id owns nothing and counts as one document; an empty table gives an empty result. Columns of the
input beside doc_id and text pass through ``dedup_lines`` unchanged, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.llm.common import LOWER, UPPER, Scratch, carried, setting

STRIP = " \t\n\x0b\x0c\r"
KEY = ["h", "g"]
NO_ID = -1 << 63
IN_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"  # a bucket's only file is read as sorted as it was written


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(STRIP)), UPPER, LOWER)


def line_rows(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """(doc_id, th, pos, h, g) for each line long enough to be compared; 96 bits stand for the key."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: line_key(x))
    return (
        docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("th"), F.posexplode(lines).alias("pos", "k"))
        .where(F.char_length("k") >= min_chars)
        .select("doc_id", "th", "pos", F.xxhash64("k").alias("h"), F.hash("k").alias("g"))
    )


class LineRuns:
    """Levelled runs of line hashes in the shared folder, under passing names in the session's catalog."""

    def __init__(self, spark: SparkSession, scratch: Scratch, fanout: int = 2):
        self.spark, self.scratch, self.fanout = spark, scratch, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.prefix = f"line_run_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.made = 0

    def _write(self, rows: DataFrame, level: int) -> None:
        """Write a run. rows come hashed by key into as many partitions as there are buckets, so each bucket is one file."""
        name = f"{self.prefix}_{self.made}"
        self.made += 1
        with setting(self.spark, IN_ORDER, "true"):
            rows.write.format("parquet").option("path", self.scratch.path(name)).bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        self.scratch.drop(name)

    def names(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def joined(self, batch: DataFrame) -> DataFrame:
        """(h, g, n_docs, owner) of a batch's keys: those that an anti-join with every run leaves own their largest doc_id."""
        keys = batch.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("owner"))
        for name in self.names():
            known = self.spark.table(name).select(*KEY, F.lit(True).alias("known"))
            met = keys.join(known.hint("merge"), KEY, "left")
            keys = met.select(*KEY, "n_docs", F.when(F.col("known").isNull(), F.col("owner")).alias("owner"))
        return keys

    def add(self, batch: DataFrame) -> None:
        """Add a batch of (h, g, doc_id) rows, one for each key and document."""
        self._write(self.joined(batch), 0)
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                old, self.levels[level] = self.levels[level], []
                self._write(self._merged(old), level + 1)
                for name in old:
                    self._drop(name)
            level += 1

    def _merged(self, names: list[str]) -> DataFrame:
        """Runs merged by key; a key has its owner in one of them."""
        out = self.spark.table(names[0])
        for name in names[1:]:
            other = self.spark.table(name).select(*KEY, F.col("n_docs").alias("more"), F.col("owner").alias("other"))
            both = out.join(other.hint("merge"), KEY, "full")
            out = both.select(*KEY, (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_docs"), F.coalesce("owner", "other").alias("owner"))
        return out

    def merged(self) -> DataFrame:
        """(h, g, n_docs, owner) over all runs."""
        return self._merged(self.names())

    def close(self) -> None:
        for name in self.names():
            self._drop(name)


def mark_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, batches: int = 4, fanout: int = 2) -> DataFrame:
    """(row, drop): each row as a struct, and the sorted positions of its lines that go, null for none."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    rows = scratch.write(line_rows(docs, min_chars), "lines")
    held = rows.groupBy(*KEY, "doc_id").agg(F.count(F.lit(1)).alias("n")).drop("n")
    cuts = rows.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    bounds = sorted(set(cuts or []))
    runs = LineRuns(spark, scratch, fanout)
    for low, high in reversed(list(zip([None, *bounds], [*bounds, None]))):
        part = held
        if low is not None:
            part = part.where(F.col("doc_id") > low)
        if high is not None:
            part = part.where(F.col("doc_id") <= high)
        runs.add(part)
    # Written, so that both sides of the join are plain shuffles and a very common line's rows can be split.
    with setting(spark, IN_ORDER, "true"):
        common = scratch.write(runs.merged().where(F.col("n_docs") >= min_docs).select(*KEY, "owner"), "common")
    runs.close()
    gone = rows.join(common, KEY).where(F.col("doc_id") != F.col("owner"))
    drops = gone.groupBy(F.col("doc_id").alias("id"), "th").agg(F.sort_array(F.collect_set("pos")).alias("drop"))
    whole = docs.select(carried(docs), F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("th"))
    return whole.join(drops, ["id", "th"], "left").select("row", "drop")


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def kept_text(text: Column, drop: Column) -> Column:
    """The lines between the dropped positions, joined again. The text is split once, outside the lambda over pieces."""
    starts = F.concat(F.array(F.lit(-1)), drop)

    def joined(lines: Column) -> Column:
        ends = F.concat(drop, F.array(F.size(lines)))
        return F.array_join(F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(lines, s + 2, e - s - 1))), "\n")

    return F.transform(F.array(lines_of(text)), joined)[0]


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """docs without the repeated lines; all columns stay, n_chars follows the text if it is there."""
    text, drop, types = F.col("row.text"), F.col("drop"), dict(zip(docs.columns, docs.schema))
    new = {"text": kept_text(text, drop)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length(new["text"]).cast(types["n_chars"].dataType)
    field = F.col("row").getField
    columns = [F.when(drop.isNull(), field(c)).otherwise(new[c]).alias(c) if c in new else field(c).alias(c) for c in docs.columns]
    return mark_lines(docs, **options).select(*columns)


def line_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    text, drop = F.col("row.text"), F.col("drop")
    kept = F.when(drop.isNull(), F.coalesce(text, F.lit(""))).otherwise(kept_text(text, drop))
    return mark_lines(docs.select("doc_id", "text"), **options).select(
        "row.doc_id",
        F.size(lines_of(text)).cast("long").alias("n_lines"),
        F.when(drop.isNull(), 0).otherwise(F.size(drop)).cast("long").alias("n_dropped"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, string_split(t, chr(10)) AS ls FROM d),
x AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM l),
k AS (SELECT doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
c AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.owner AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
