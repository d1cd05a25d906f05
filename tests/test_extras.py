"""Explanations, transactions, replica reads, write-ahead logs, workloads and stream timers on literal inputs."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from tidemark.operators import explain, transactions
from tidemark.sources import readers


def test_multi_queue(spark):
    verbs = ["SET", "EXEC", "MULTI", "SET", "GET", "EXEC", "MULTI", "MULTI", "SCAN", "SET", "EXEC", "SET", "DISCARD", "MULTI", "DEL", "DISCARD", "MULTI", "EXEC"]
    df = spark.createDataFrame([(1, i, x, 2 if x == "DEL" else 1) for i, x in enumerate(verbs)], "connection bigint, ord bigint, verb string, keys int")
    got = [(r.transaction, r.reply) for r in transactions.multi(df).orderBy("ord").collect()]
    assert [r for _, r in got] == ["IMMEDIATE", "ERR EXEC without MULTI", "OK", "QUEUED", "QUEUED", "EXEC 2", "OK", "ERR nested", "ERR cannot be queued", "ERR already dirty", "EXECABORT", "IMMEDIATE", "ERR DISCARD without MULTI", "OK", "ERR cannot be queued", "OK", "OK", "EXEC 0"]
    assert [t for t, _ in got][2:6] == [None, 2, 2, 2]
    tight = [r.reply for r in transactions.multi(df.filter("ord BETWEEN 2 AND 5"), most=1).orderBy("ord").collect()]
    assert tight == ["OK", "QUEUED", "ERR batch limits", "EXECABORT"]


def test_replica_reads(spark):
    writes = spark.createDataFrame([(1, "k", "SET", "a"), (4, "k", "DEL", None), (6, "k", "SET", "b")], "log_index bigint, key string, op string, value string")
    reads = [(1, "k", "stale", 6, 3), (2, "k", "follower", 3, 3), (3, "k", "follower", 5, 4), (4, "k", "follower", 2, 5), (5, "x", "stale", 0, 9), (6, "k", "stale", 0, 0)]
    df = spark.createDataFrame(reads, "read_id bigint, key string, mode string, read_index bigint, applied_index bigint")
    got = [(r.status, r.served_index, r.value) for r in transactions.replica_reads(writes, df).orderBy("read_id").collect()]
    assert got == [("ok", 3, "a"), ("ok", 3, "a"), ("retry", None, None), ("ok", 5, None), ("ok", 9, None), ("ok", 0, None)]


def test_policy(spark):
    batch = "array<struct<key: binary, value: binary>>"
    rows = [(1, "SET", b"k", b"v", None), (2, "SET", b"", b"v", None), (3, "SET", b"k" * 5, b"", None), (4, "BATCH", None, None, []), (5, "BATCH", None, None, [(b"k", b"v")]), (6, "BATCH", None, None, [(b"k", b"v" * 9)])]
    df = spark.createDataFrame(rows, f"log_index bigint, kind string, key binary, value binary, batch {batch}")
    faults = lambda on: {r.log_index: r.fault for r in transactions.policy_faults(df, on, most_key=4, most_value=8).collect()}
    assert faults(True) == {2: "empty key", 3: "too large", 4: "batch size", 6: "too large"}
    assert faults(False) == {2: "empty key", 3: "too large", 4: "feature disabled", 5: "feature disabled", 6: "feature disabled"}


def test_explanation(spark):
    ops = spark.createDataFrame([(10 + i, i, 1, i, 100 * i, 100 * i + 50 if i != 3 else None, "SET", "ok") for i in range(20)], "id bigint, ord bigint, client bigint, sequence bigint, invoke bigint, complete bigint, kind string, outcome string")
    trace = spark.createDataFrame([(i, 25 * i, i % 3, "Commit" if i % 2 else "NetSend") for i in range(100)], "seq bigint, time_ns bigint, node bigint, kind string")
    anomalies = spark.createDataFrame([("unclassified", [], ""), ("stale-read", [12, 13], "reads an old value")], "class string, operation_ids array<bigint>, predicate string")
    ids = spark.createDataFrame([(12,), (13,)], "id bigint")
    assert [r.id for r in explain.witnesses(ops).orderBy("id").collect()] == list(range(10, 26))
    assert [r.id for r in explain.witnesses(ops, ids).orderBy("id").collect()] == [12, 13]
    assert explain.witnesses(ops, ids.limit(0)).count() == 16
    assert tuple(explain.bounds(explain.witnesses(ops, ids)).first()) == (200, 250)
    assert tuple(explain.bounds(ops.filter("id = 13")).first()) == (300, 300)
    got = explain.explain(anomalies, ops, trace, ids).collect()
    assert [(r.part, r.at) for r in got if r.part != "event"] == [("anomaly", 0), ("operation", 12), ("operation", 13), ("summary", 0)]
    assert [r.at for r in got if r.part == "event"] == [9] and got[-1].text == "1 events of nodes 0"


def segment(n, *records, tail=b""):
    out = b"CCWL" + struct.pack("<HQ", 1, n)
    for kind, payload in records:
        body = bytes([kind]) + payload
        out += struct.pack("<II", len(payload), readers.crc(body)) + body
    return out + tail


def test_write_ahead_logs(spark, tmp_path):
    good = segment(0, (1, b"one"), (2, b"pad"), (1, b"two"), tail=b"\0" * 40)
    assert readers.wal_segment(good) == (0, [(14, "data", b"one"), (38, "data", b"two")], None)
    torn = segment(1, (1, b"three"), (3, b""), tail=b"\x05\0\0")
    assert readers.wal_segment(torn)[1:] == ([(14, "data", b"three"), (28, "seal", b"")], 37)
    broken = bytearray(segment(0, (1, b"one"), (1, b"two")))
    broken[24] ^= 1
    with pytest.raises(ValueError, match="corruption"):
        readers.wal_segment(bytes(broken))
    for bad in (b"CCWX" + good[4:], good[:10]):
        with pytest.raises(ValueError):
            readers.wal_segment(bad)

    def write(name, *segments):
        (tmp_path / name).mkdir()
        for i, x in enumerate(segments):
            (tmp_path / name / f"{i}.wal").write_bytes(x)
        return readers.read_wal(spark, f"{tmp_path}/{name}/*.wal")

    assert [(r.segment, bytes(r.payload)) for r in write("a", good, torn).orderBy("segment", "offset").collect()] == [(0, b"one"), (0, b"two"), (1, b"three"), (1, b"")]
    for name, parts in (("gap", (good, segment(2))), ("early", (segment(0, (1, b"x"), tail=b"\x05"), segment(1)))):
        with pytest.raises(Exception, match="segments|corruption"):
            write(name, *parts).collect()


def test_bench_reports(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"name": "x", "ops": 5, "latency": {"p50": 1.5, "p99": 9}}))
    assert sorted((r.metric, r.value) for r in readers.read_bench_json(spark, str(tmp_path / "b.json")).collect()) == [("latency.p50", 1.5), ("latency.p99", 9.0), ("ops", 5.0)]


def test_workloads(spark):
    df = readers.workload(spark, 10, 1000, seed=3)
    share = {r.kind: r.n / 10_000 for r in df.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert all(abs(share[k] - n / 100) < 0.02 for k, n in readers.MIXES["mixed"])
    assert df.agg(F.min("sequence"), F.max("sequence"), F.count_distinct("client", "sequence")).first()[:] == (1, 1000, 10_000)
    assert sorted(map(str, df.limit(50).collect())) == sorted(map(str, readers.workload(spark, 10, 1000, seed=3).limit(50).collect()))
    batches = readers.workload(spark, 5, 200, "batch").filter("kind = 'BATCH'")
    assert {r.n for r in batches.select(F.size("commands").alias("n")).distinct().collect()} == {2, 3, 4} and batches.filter("key IS NOT NULL").count() == 0
    assert readers.workload(spark, 2, 100, "ttl", ttl_ns=7).filter("kind = 'SET' AND ttl_ns <> 7").count() == 0


def test_stream_windows_drop_late_rows(spark, tmp_path):
    from tidemark.streaming import windows

    def put(n, times):
        rows = [(i, t, 1, "a", 0.0, "{}") for i, t in enumerate(times)]
        df = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string")
        df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))

    folder = f"file://{tmp_path}/out"
    drained = lambda: {(r.start_us // 86_400_000_000, r.n) for r in windows.drain(windows.tumbling(windows.source(spark, str(tmp_path))), folder=folder).collect()}
    put(0, ["2024-01-01 10:00:00", "2024-01-01 11:00:00", "2024-01-02 12:00:00"])
    assert drained() == {(19723, 2)}  # the second day is still open
    put(1, ["2024-01-01 09:00:00", "2024-01-02 11:30:00", "2024-01-03 08:00:00"])  # the first one is too late, the second in time
    assert drained() == {(19723, 2), (19724, 2)}


def test_stream_timers(spark, tmp_path):
    from tidemark.streaming import stateful, windows

    hour = 3_600_000_000
    stamp = lambda us: F.timestamp_micros(us)

    def put(name, rows, schema, time):
        df = spark.createDataFrame(rows, schema)
        df.withColumn("at", stamp(time)).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        return df.withColumn("at", stamp(time)).schema

    kv = "log_index bigint, key string, op string, deadline_us bigint, t bigint"
    schema = put("log", [(1, "a", "SET", 2 * hour, hour), (2, "b", "SET", 9 * hour, hour), (3, "c", "SET", 2 * hour, hour), (4, "c", "DEL", None, hour), (5, "d", "SET", 2 * hour, hour), (6, "d", "SET", 30 * hour, hour)], kv, F.col("t"))
    run = lambda: sorted((r.key, r.log_index, r.deadline_us) for r in windows.drain(stateful.expirations(spark.readStream.schema(schema).parquet(str(tmp_path / "log"))), folder=f"file://{tmp_path}/expired").collect())
    assert run() == []
    put("log", [(7, "e", "SET", 100 * hour, 5 * hour)], kv, F.col("t"))
    assert run() == [("a", 1, 2 * hour)]
    put("log", [(8, "e", "GET", None, 40 * hour), (9, "f", "SET", 99 * hour, 40 * hour)], kv, F.col("t"))
    assert run() == [("a", 1, 2 * hour), ("b", 2, 9 * hour), ("d", 6, 30 * hour)]

    second = 1_000_000
    ask = "namespace int, client bigint, sequence bigint, now_ns bigint, t bigint"
    row = lambda c, n, s: (1, c, n, s * 10**9, s * second)
    schema = put("ask", [row(1, 1, 100), row(2, 1, 100), row(2, 2, 1800)], ask, F.col("t"))
    idle = lambda: sorted((r.client, r.event, r.at_ns // 10**9) for r in windows.drain(stateful.idle_sessions(spark.readStream.schema(schema).parquet(str(tmp_path / "ask"))), folder=f"file://{tmp_path}/idle").collect())
    assert idle() == []
    put("ask", [row(3, 1, 2000)], ask, F.col("t"))
    assert idle() == [(1, "idle", 1900)]
    put("ask", [row(3, 2, 2600)], ask, F.col("t"))
    assert idle() == [(1, "forgotten", 2200), (1, "idle", 1900)]
    put("ask", [row(3, 3, 4300)], ask, F.col("t"))
    assert (2, "idle", 3600) in idle()
