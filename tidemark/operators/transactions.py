"""Client transactions and replica reads: the MULTI queue of each connection, and reads of a state at an applied index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Commands that a transaction may queue; DEL with one key only.
QUEUED = ("SET", "SETNX", "GET", "DEL", "CAS", "INCR", "DECR", "INCRBY", "APPEND", "GETSET", "GETDEL", "EXPIRE", "EXPIREAT", "PERSIST", "TTL")
MOST_COMMANDS = 256


def multi(commands: DataFrame, most: int = MOST_COMMANDS) -> DataFrame:
    """commands(connection, ord, verb, keys) with transaction and reply: what each command of a connection is answered.

    A transaction opens at MULTI and ends at the next EXEC or DISCARD. What can't be queued makes it dirty: everything
    after that is refused, and EXEC aborts. transaction is the place of the MULTI, null outside. reply: OK, QUEUED, EXEC n
    (n queued commands are proposed as one batch), IMMEDIATE for commands outside, or an error. Windows by connection: a
    connection's commands are in order by nature.
    """
    w = Window.partitionBy("connection").orderBy("ord")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    v = F.col("verb")
    # a MULTI opens one only where none is open: the last of MULTI, EXEC and DISCARD before it isn't a MULTI
    edge = F.last(F.when(v.isin("MULTI", "EXEC", "DISCARD"), v), ignorenulls=True).over(before)
    rows = commands.withColumn("_in", F.coalesce(edge == "MULTI", F.lit(False)))
    opens = (v == "MULTI") & ~F.col("_in")
    rows = rows.withColumn("transaction", F.when(F.col("_in"), F.last(F.when(opens, F.col("ord")), ignorenulls=True).over(before)))
    inside = F.col("_in") & ~v.isin("EXEC", "DISCARD", "MULTI")
    fits = v.isin(*QUEUED) & ((v != "DEL") | (F.col("keys") == 1))
    tw = Window.partitionBy("connection", "transaction").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", inside).withColumn("_bad", inside & ~fits)
    rows = rows.withColumn("_n", F.coalesce(F.sum(F.when(F.col("_inside") & ~F.col("_bad"), 1)).over(tw), F.lit(0)))
    rows = rows.withColumn("_bad", F.col("_bad") | (F.col("_inside") & (F.col("_n") >= most)))
    rows = rows.withColumn("_dirty", F.col("_in") & F.coalesce(F.max(F.col("_bad")).over(tw), F.lit(False)))
    reply = (
        F.when(opens, "OK")
        .when(v == "MULTI", "ERR nested")
        .when((v == "EXEC") & ~F.col("_in"), "ERR EXEC without MULTI")
        .when((v == "DISCARD") & ~F.col("_in"), "ERR DISCARD without MULTI")
        .when(v == "DISCARD", "OK")
        .when((v == "EXEC") & F.col("_dirty"), "EXECABORT")
        .when(v == "EXEC", F.concat(F.lit("EXEC "), F.col("_n").cast("string")))
        .when(~F.col("_in"), "IMMEDIATE")
        .when(F.col("_dirty"), "ERR already dirty")
        .when(F.col("_bad") & fits, "ERR batch limits")
        .when(F.col("_bad"), "ERR cannot be queued")
        .otherwise("QUEUED")
    )
    return rows.withColumn("reply", reply).drop(*[c for c in rows.columns if c.startswith("_")])


def replica_reads(writes: DataFrame, reads: DataFrame) -> DataFrame:
    """reads(read_id, key, mode, read_index, applied_index) with what a replica answers from writes(log_index, key, op, value).

    stale answers from what the replica has applied. follower is granted only where it has applied the leader's read_index,
    and then answers from applied_index as well; else the client has to retry (status retry). status is ok otherwise. Each
    read meets the last write of its key up to its index: a union and a running value, no join of reads with writes.
    """
    granted = (F.col("mode") == "stale") | (F.col("applied_index") >= F.col("read_index"))
    asked = reads.withColumn("status", F.when(granted, "ok").otherwise("retry"))
    w = Window.partitionBy("key").orderBy("_at", "_o").rowsBetween(Window.unboundedPreceding, 0)
    kept = writes.filter("op IN ('SET', 'DEL')").select("key", F.col("log_index").alias("_at"), F.lit(0).alias("_o"), F.struct("op", "value").alias("_w"))
    rows = kept.unionByName(asked.withColumn("_at", F.col("applied_index")).withColumn("_o", F.lit(1)), allowMissingColumns=True)
    rows = rows.withColumn("_w", F.last("_w", ignorenulls=True).over(w)).filter("_o = 1")
    value = F.when((F.col("status") == "ok") & (F.col("_w.op") == "SET"), F.col("_w.value"))
    return rows.select("read_id", "key", "mode", "status", F.when(F.col("status") == "ok", F.col("applied_index")).alias("served_index"), value.alias("value"))


def policy_faults(commands: DataFrame, batches: bool, most_batch: int = MOST_COMMANDS, most_key: int = 4096, most_value: int = 1 << 20) -> DataFrame:
    """(log_index, fault) of commands(log_index, kind, key, value, batch) that a cluster's policy refuses."""
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    keyed = ~F.col("kind").isin("SCAN", "PURGE", "BATCH")
    inner = F.coalesce(F.exists("batch", lambda c: (F.coalesce(F.octet_length(c["key"]), F.lit(0)) > most_key) | (F.coalesce(F.octet_length(c["value"]), F.lit(0)) > most_value)), F.lit(False))
    is_batch = F.col("kind") == "BATCH"
    fault = F.when(is_batch & F.lit(not batches), "feature disabled").when(is_batch & ((F.size("batch") == 0) | F.col("batch").isNull() | (F.size("batch") > most_batch)), "batch size")
    fault = fault.when(keyed & (size("key") == 0), "empty key").when((size("key") > most_key) | (size("value") > most_value) | inner, "too large")
    return commands.select("log_index", fault.alias("fault")).filter("fault IS NOT NULL")
