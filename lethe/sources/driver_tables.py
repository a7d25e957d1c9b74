"""The model's tables from the driver's: memories from lineitem, events from orders, bodies from documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = 1_009_843_200_000_000_000  # 2002-01-01, after all of lineitem's dates
N_LEVELS = 50


def nanos(ts: Column) -> Column:
    """Nanoseconds of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts) * 1000


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def levels(spark: SparkSession) -> DataFrame:
    return spark.range(1, N_LEVELS + 1).select((F.col("id") + 1000).alias("id"), F.col("id").cast("int").alias("level_rank"))


def stored_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unresolved memories: rank 0, no event, dangling events, summaries, binaries and missing metadata all occur."""
    li = raw(spark, sf_dir, "lineitem")
    ts = nanos(F.col("l_shipdate"))
    row_id = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long"))
    order = F.col("l_orderkey").cast("string")
    meta = F.map_from_arrays(F.array(F.lit("flag"), F.lit("status")), F.array("l_returnflag", "l_linestatus"))
    return li.select(
        row_id.alias("id"),
        ts.alias("timestamp"),
        F.when(F.col("l_quantity").cast("int") % 10 != 0, F.col("l_quantity").cast("long") + 1000).alias("significance_level_id"),
        F.when(F.col("l_partkey") % 7 == 0, "").when(F.col("l_partkey") % 11 == 0, F.concat(F.lit("gone-"), order)).otherwise(order).alias("event_id"),
        (F.col("l_tax") > 0.07).alias("is_binary"),
        F.when(F.col("l_linenumber") > 1, ts + F.col("l_linenumber").cast("long") * F.lit(2_592_000_000_000_000)).otherwise(F.lit(0)).cast("long").alias("time_recalled"),
        (F.col("l_linenumber") - 1).alias("recall_count"),
        ((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1)).alias("is_summary"),
        F.col("l_returnflag").alias("group_name"),
        F.round(F.col("l_discount") * 100).cast("long").alias("link_significance"),
        F.repeat(F.concat("l_returnflag", "l_linestatus"), F.col("l_linenumber") * 3).alias("body"),
        F.when(F.col("l_suppkey") % 5 != 0, meta).alias("metadata"),
    )


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = raw(spark, sf_dir, "orders")
    start = nanos(F.col("o_orderdate"))
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"),
        start.alias("time_start"),
        F.when(F.col("o_custkey") % 5 == 0, F.lit(0)).otherwise(start + F.col("o_custkey") % 30 * F.lit(86_400_000_000_000)).cast("long").alias("time_end"),
        F.when(F.col("o_custkey") % 3 != 0, F.substring("o_orderpriority", 1, 1).cast("long") + 1000).alias("significance_level_id"),
        F.concat("o_orderstatus", F.lit("-"), F.col("o_custkey").cast("string")).alias("name"),
        F.lit("").alias("description"),
        F.lit(False).alias("memories_consolidated"),
        (F.col("o_custkey") % 17).alias("link_significance"),
        F.col("o_orderstatus").alias("group_name"),
        F.when(F.col("o_custkey") % 4 != 0, F.create_map(F.lit("priority"), F.col("o_orderpriority"))).alias("metadata"),
    )


def memory_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn n to turn n + 1 of a conversation."""
    c = raw(spark, sf_dir, "conversations")
    key = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    return c.join(last, "conv_id").where(F.col("turn") < F.col("last")).select(
        key(F.col("turn")).alias("from_id"), key(F.col("turn") + 1).alias("to_id"), (F.char_length("text") % 50).cast("int").alias("significance"), F.lit(NOW).alias("created")
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = raw(spark, sf_dir, "conversations")
    return c.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("conv_id").cast("string").alias("event_id"), F.col("role").alias("group_name"),
        F.lit(0).cast("long").alias("link_significance"), (F.col("turn") + 1).cast("int").alias("significance"), "text",
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searchable memories from documents."""
    d = raw(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"), F.col("text").alias("body"), F.lit(False).alias("is_binary"), F.col("lang").alias("group_name"),
        (F.col("n_chars") % 100).cast("int").alias("significance"), (F.col("doc_id") % 7).cast("int").alias("recall_count"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broker messages from the event stream."""
    e = raw(spark, sf_dir, "events")
    heads = F.map_from_arrays(
        F.array(F.lit("significance"), F.lit("event"), F.lit("meta-User Id")),
        F.array(F.floor(F.col("value") / 10).cast("string"), F.concat(F.lit("u"), F.col("user_id").cast("string")), F.col("user_id").cast("string")),
    )
    return e.select(F.col("event_type").alias("subject"), F.col("props").cast("binary").alias("data"), heads.alias("headers"), nanos(F.col("ts")).alias("timestamp"), "event_id", "user_id", "value")


#: The same relations for the SQL that queries are held against.
MEM = """mem AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT) AS id,
  epoch_us(l_shipdate) * 1000 AS timestamp, CASE WHEN l_quantity::INT % 10 <> 0 THEN l_quantity::INT ELSE 0 END AS significance,
  CASE WHEN l_partkey % 7 = 0 THEN '' WHEN l_partkey % 11 = 0 THEN 'gone-' || l_orderkey ELSE l_orderkey::VARCHAR END AS event_id,
  l_tax > 0.07 AS is_binary, (CASE WHEN l_linenumber > 1 THEN epoch_us(l_shipdate) * 1000 + l_linenumber * 2592000000000000 ELSE 0 END)::BIGINT AS time_recalled,
  l_linenumber - 1 AS recall_count, l_linestatus = 'F' AND l_linenumber = 1 AS is_summary, l_returnflag AS group_name,
  round(l_discount * 100)::BIGINT AS link_significance, repeat(l_returnflag || l_linestatus, l_linenumber * 3) AS body,
  CASE WHEN l_suppkey % 5 <> 0 THEN l_returnflag END AS m_flag, CASE WHEN l_suppkey % 5 <> 0 THEN l_linestatus END AS m_status,
  CASE WHEN l_suppkey % 5 <> 0 THEN '{"flag":"' || l_returnflag || '","status":"' || l_linestatus || '"}' END AS m_json FROM lineitem),
memb AS (SELECT *, (strlen(body) + coalesce(strlen(m_json), 0))::BIGINT AS body_bytes, greatest(timestamp, time_recalled) AS since FROM mem)"""
EV = """ev AS (SELECT o_orderkey::VARCHAR AS id, epoch_us(o_orderdate) * 1000 AS time_start,
  (CASE WHEN o_custkey % 5 = 0 THEN 0 ELSE epoch_us(o_orderdate) * 1000 + o_custkey % 30 * 86400000000000 END)::BIGINT AS time_end,
  CASE WHEN o_custkey % 3 <> 0 THEN o_orderpriority[1]::INT ELSE 0 END AS significance, o_orderstatus || '-' || o_custkey AS name,
  o_custkey % 17 AS link_significance, o_orderstatus AS group_name, CASE WHEN o_custkey % 4 <> 0 THEN o_orderpriority END AS m_priority FROM orders)"""
LINKS_SQL = """lk AS (SELECT c.conv_id || ':' || c.turn AS from_id, c.conv_id || ':' || (c.turn + 1) AS to_id, (length(c.text) % 50)::INT AS significance
  FROM conversations c JOIN (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id) m ON c.conv_id = m.conv_id WHERE c.turn < m.last),
ends AS (SELECT from_id AS id, to_id AS other, significance, 'out' AS direction FROM lk UNION ALL SELECT to_id, from_id, significance, 'in' FROM lk)"""
