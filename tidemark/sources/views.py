"""The engine's tables derived from the star schema, and the same derivations as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.withColumn("t_us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


def v_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.create_map(*[F.lit(x) for pair in {"signup": "SET", "purchase": "INCR", "view": "GET", "click": "EXPIRE", "error": "DEL"}.items() for x in pair])
    return _events(spark, sf_dir).select((F.col("event_id") + 1).alias("log_index"), "t_us", F.col("user_id").alias("client"), F.concat(F.lit("k"), (F.col("user_id") % 64).cast("string")).alias("key"), op[F.col("event_type")].alias("op"), F.col("event_id").alias("value"), "k")


V_LOG = """v_log AS (SELECT event_id + 1 AS log_index, epoch_us(ts) AS t_us, user_id AS client, 'k' || CAST(user_id % 64 AS VARCHAR) AS key,
  CASE event_type WHEN 'signup' THEN 'SET' WHEN 'purchase' THEN 'INCR' WHEN 'view' THEN 'GET' WHEN 'click' THEN 'EXPIRE' WHEN 'error' THEN 'DEL' END AS op,
  event_id AS value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


def v_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of eight clients; an open one has no completion. GET and INCR observe event_id % 50."""
    from pyspark.sql import Window

    log = v_log(spark, sf_dir)
    client = F.col("client") % 8 + 1
    kind = F.when(F.col("op") == "EXPIRE", "GET").otherwise(F.col("op"))
    rows = log.select(F.col("log_index").alias("id"), client.alias("client"), "key", kind.alias("kind"), F.col("t_us").alias("invoke"), F.when((F.col("log_index") - 1) % 37 != 0, F.col("t_us") + F.col("k") * 1_000_000).alias("complete"), (F.col("value") % 50).alias("seen"))
    return rows.withColumn("sequence", F.row_number().over(Window.partitionBy("client").orderBy("id")))


V_HISTORY = (
    V_LOG
    + """, v_history AS (SELECT log_index AS id, client % 8 + 1 AS client, key, CASE op WHEN 'EXPIRE' THEN 'GET' ELSE op END AS kind, t_us AS invoke,
  CASE WHEN (log_index - 1) % 37 <> 0 THEN t_us + k * 1000000 END AS complete, value % 50 AS seen,
  row_number() OVER (PARTITION BY client % 8 + 1 ORDER BY log_index) AS sequence FROM v_log)"""
)


def v_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.col("t_us").alias("time_us"), (F.col("user_id") % 5 + 1).alias("node"), F.col("event_type").alias("kind"), F.col("props").alias("payload"))


V_TRACE = "v_trace AS (SELECT event_id AS seq, epoch_us(ts) AS time_us, user_id % 5 + 1 AS node, event_type AS kind, props AS payload FROM events)"


def v_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_custkey's versions by o_orderkey; status F deletes. Files hold 500 sequence numbers."""
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("user_key"), F.col("o_orderkey").alias("sequence"), F.when(F.col("o_orderstatus") == "F", "DEL").otherwise("PUT").alias("kind"), F.floor(F.col("o_totalprice") * 100).cast("bigint").alias("value"), F.expr("o_orderkey div 500").alias("file_no"))


V_VERSIONS = "v_versions AS (SELECT o_custkey AS user_key, o_orderkey AS sequence, CASE WHEN o_orderstatus = 'F' THEN 'DEL' ELSE 'PUT' END AS kind, CAST(floor(o_totalprice * 100) AS BIGINT) AS value, o_orderkey // 500 AS file_no FROM orders)"


def v_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = v_versions(spark, sf_dir)
    return v.groupBy("file_no").agg(F.min("user_key").alias("smallest"), F.max("user_key").alias("largest"), F.min("sequence").alias("min_seq"), F.max("sequence").alias("max_seq"), (F.count("*") * 64).alias("file_size")).withColumn("level", F.col("file_no") % 4)


V_FILES = V_VERSIONS + ", v_files AS (SELECT file_no, min(user_key) AS smallest, max(user_key) AS largest, min(sequence) AS min_seq, max(sequence) AS max_seq, count(*) * 64 AS file_size, file_no % 4 AS level FROM v_versions GROUP BY file_no)"


def v_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    verdict = F.element_at(F.array(*[F.lit(x) for x in ("ok", "ok", "ok", "undecided", "failed", "ok")]), (F.col("o_custkey") % 6 + 1).cast("int"))
    return o.select(F.col("o_orderpriority").alias("build_label"), F.concat(F.lit("c"), (F.col("o_custkey") % 3).cast("string")).alias("config_hash"), F.col("o_orderstatus").alias("profile"), F.col("o_orderkey").alias("seed"), verdict.alias("verdict"), (F.col("o_custkey") * 7).alias("events"))


V_LEDGER = "v_ledger AS (SELECT o_orderpriority AS build_label, 'c' || CAST(o_custkey % 3 AS VARCHAR) AS config_hash, o_orderstatus AS profile, o_orderkey AS seed, ['ok','ok','ok','undecided','failed','ok'][CAST(o_custkey % 6 + 1 AS INTEGER)] AS verdict, o_custkey * 7 AS events FROM orders)"


def v_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.col("l_returnflag").alias("workload"), F.floor(F.col("l_quantity") * 100 + F.col("l_linenumber")).cast("bigint").alias("latency_ns"), "l_orderkey", "l_linenumber")


V_SAMPLES = "v_samples AS (SELECT l_returnflag AS workload, CAST(floor(l_quantity * 100 + l_linenumber) AS BIGINT) AS latency_ns, l_orderkey, l_linenumber FROM lineitem)"
