"""What the operators of this subpackage share: tables, scratch space, checked broadcasts."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.sources.scratch import Scratch, shared_dir

__all__ = ["Scratch", "shared_dir"]

#: White space of the word contracts, as a Java/RE2 class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """A column by its whole name, whatever characters that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def carried(df: DataFrame, name: str = "row") -> Column:
    """All columns of a table as one struct, so that a plan's own names can't clash with them; ``row.*`` gives them back."""
    return F.struct(*map(column, df.columns)).alias(name)


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the actions inside, put back afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Mark a side for broadcast only if its counted rows are within the bound; else Spark shuffles it."""
    return F.broadcast(df) if rows <= most else df


def md5_int(col):
    """The first 32 bits of an md5, the hash that both Spark and the SQL oracle have."""
    return F.conv(F.substring(F.md5(col), 1, 8), 16, 10).cast("long")


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches to Python hold at most so many rows, since a single text can be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)


def text_or_empty():
    return F.coalesce(F.col("text"), F.lit(""))
