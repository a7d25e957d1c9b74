"""Readers of message streams: Kafka where its connector is on the class path, folders of files anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGES = "subject string, data binary, headers map<string,string>, timestamp long"


def kafka_messages(spark: SparkSession, servers: str, topics: str, most_per_batch: int = 0) -> DataFrame:
    """Kafka records as messages; offsets are committed with the checkpoint, after a batch is stored."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).option("includeHeaders", "true")
    if most_per_batch:
        reader = reader.option("maxOffsetsPerTrigger", most_per_batch)
    return kafka_rows(reader.load())


def kafka_rows(records: DataFrame) -> DataFrame:
    heads = F.map_from_entries(F.transform(F.coalesce("headers", F.array().cast("array<struct<key:string,value:binary>>")), lambda h: F.struct(h["key"].alias("key"), h["value"].cast("string").alias("value"))))
    return records.select(F.col("topic").alias("subject"), F.coalesce("value", F.lit(b"")).alias("data"), heads.alias("headers"), (F.unix_micros("timestamp") * 1000).alias("timestamp"))


def file_messages(spark: SparkSession, path: str, files_per_batch: int = 0) -> DataFrame:
    """Parquet files of messages that land in a folder."""
    reader = spark.readStream.schema(MESSAGES)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


#: Field names of a feed's commit frames.
FRAME = (
    "did string, time_us long, kind string, commit struct<operation:string,collection:string,rkey:string,"
    "record:struct<text:string,langs:array<string>,reply:struct<root:struct<uri:string>,parent:struct<uri:string>>,subject:struct<uri:string>>>"
)


def feed_frames(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(posts, undecodable) of JSON frames (value)."""
    parsed = lines.withColumn("f", F.from_json("value", FRAME))
    good = parsed.where(F.col("f.did").isNotNull() & F.col("f.commit").isNotNull())
    record = F.col("f.commit.record")
    posts = good.select(
        F.concat(F.lit("at://"), "f.did", F.lit("/"), "f.commit.collection", F.lit("/"), "f.commit.rkey").alias("uri"), F.col("f.did").alias("author"), "f.time_us",
        F.substring_index("f.commit.collection", ".", -1).alias("collection"), "f.commit.operation", record["text"].alias("text"), record["langs"].alias("langs"),
        record["reply"]["root"]["uri"].alias("reply_root"), record["reply"]["parent"]["uri"].alias("reply_parent"), record["subject"]["uri"].alias("subject_uri"),
    )
    return posts, parsed.where(F.col("f.did").isNull() | F.col("f.commit").isNull()).select("value")
