"""Topic links: items that share rare terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frequency_cap(window: int, percent: float) -> int:
    return max(8, int(window * percent / 100))


def related(items: DataFrame, min_shared: int = 2, limit: int = 5, cap: int = 8) -> DataFrame:
    """(id, other, shared): for each of (id, terms) the items that share the most terms.

    Only terms that at most ``cap`` items hold count, which is the feature, and bounds each term's
    pairs by cap squared whatever the table's size.
    """
    rows = items.select("id", F.explode(F.array_distinct("terms")).alias("term"))
    df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df").between(2, cap))
    rare = rows.join(df, "term").groupBy("term").agg(F.collect_list("id").alias("ids"))  # of at most cap
    pairs = rare.select(F.explode("ids").alias("id"), "ids").select("id", F.explode("ids").alias("other")).where(F.col("id") != F.col("other"))
    shared = pairs.groupBy("id", "other").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= min_shared)
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("shared"), "other"))
    return shared.withColumn("r", best).where(F.col("r") <= limit).drop("r")


def topic_links(items: DataFrame, significance: int, created: int, **options) -> DataFrame:
    """Link rows from each item to its related ones."""
    return related(items, **options).select(F.col("id").alias("from_id"), F.col("other").alias("to_id"), F.lit(significance).alias("significance"), F.lit(created).cast("long").alias("created"))
