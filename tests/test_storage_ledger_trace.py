"""Versions, ledgers, traces, quantiles, readers and the catalog on small literal inputs."""

import struct

import pytest
from pyspark.sql import functions as F

from tidemark.functions import hashing, quantiles, scalars
from tidemark.operators import ledger, membership, mvcc, trace
from tidemark.sources import readers


def versions(spark, rows):
    return spark.createDataFrame(rows, "user_key string, sequence bigint, kind string, value string")


def test_snapshot_reads(spark):
    v = versions(spark, [("k", 1, "PUT", "v1"), ("k", 5, "DEL", None), ("k", 9, "PUT", "v9"), ("j", 2, "PUT", "j2"), ("j", 3, "PUT", "j3")])
    at = lambda n: {r.user_key: r.value for r in mvcc.snapshot_get(v, n).collect()}.get("k")
    assert [at(n) for n in (4, 5, 8, 9)] == ["v1", None, None, "v9"]
    assert [(r.user_key, r.value) for r in mvcc.scan(v, 6).collect()] == [("j", "j3")]
    assert [(r.user_key, r.value) for r in mvcc.scan(v).collect()] == [("j", "j3"), ("k", "v9")]


def test_compaction_keeps_what_snapshots_see(spark):
    v = versions(spark, [("k", 9, "PUT", ""), ("k", 1, "PUT", ""), ("k", 0, "PUT", ""), ("j", 3, "PUT", ""), ("j", 2, "PUT", "")])
    keep = lambda df, s: sorted((r.user_key, r.sequence) for r in mvcc.compaction_keep(df, s).collect())
    assert keep(v, [4]) == [("j", 3), ("k", 1), ("k", 9)] and keep(v, []) == [("j", 3), ("k", 9)]
    assert ("a", 1) in keep(versions(spark, [("a", 1, "PUT", ""), ("b", 2, "PUT", ""), ("a", 3, "PUT", "")]), [2])


def test_level_selection(spark):
    files = spark.createDataFrame([(i, 0, 1, 0, 9) for i in range(4)] + [(10, 1, 16 << 20, 0, 9)], "file_no bigint, level int, file_size bigint, smallest bigint, largest bigint")
    assert mvcc.select_level(mvcc.compaction_scores(files)).first()["level"] == 1
    assert {r.file_no for r in mvcc.overlap_closure(files, 0, 3, 4).collect()} == {0, 1, 2, 3, 10}


def split(rows, target):
    """Entries one by one, as they come: a new output before an entry of another key that would pass the target."""
    outputs, held, last = [], 0, None
    for key, _, size in sorted(rows, key=lambda r: (r[0], -r[1])):
        if last is not None and key != last and held + size + 32 > target:
            outputs.append({})
            held = 0
        elif not outputs:
            outputs.append({})
        outputs[-1][key] = outputs[-1].get(key, 0) + size + 32
        held, last = held + size + 32, key
    return [(k, b, i) for i, o in enumerate(outputs) for k, b in o.items()]


def test_output_split_against_entries(spark):
    import random

    rng = random.Random(5)
    cases = [([(k, 1, 60) for k in range(4)], 100), ([(k, 1, 60) for k in range(4)], 184), ([(1, s, 50) for s in range(9)] + [(2, 1, 5)], 100)]
    cases += [([(rng.randint(0, 30), s, rng.randint(0, 90)) for s in range(80)], rng.randint(33, 600)) for _ in range(6)]
    for n, (rows, target) in enumerate(cases):
        df = spark.createDataFrame([(n, *r) for r in rows], "level int, user_key bigint, sequence bigint, size bigint")
        got = sorted((r.user_key, r.bytes, r.output) for r in mvcc.split_output(df, target).collect())
        assert got == sorted(split(rows, target)), (rows, target)
    assert len({r[2] for r in split(*cases[0])}) == 4


def test_level_selection_is_exact(spark):
    rows = [(1, 3 * 10**18 + 1, 10**9, 0), (2, 3 * 10**18 + 2, 10**9, 0), (3, 7, 8, 0), (4, 3 * 10**18 + 2, 10**9, 0)]
    scores = spark.createDataFrame(rows, "level int, numerator bigint, denominator bigint, victim bigint")
    assert mvcc.select_level(scores).first()["level"] == 2 and mvcc.select_level(scores.filter("level = 3")).count() == 0


def test_manifest_faults_and_batches(spark):
    schema = "batch int, ord bigint, action string, file_no bigint, level int, smallest bigint, largest bigint"
    good = [(1, 1, "ADD", 1, 1, 0, 5), (1, 2, "ADD", 2, 1, 6, 9), (1, 3, "ADD", 3, 0, 0, 9), (2, 4, "REMOVE", 1, 1, 0, 0), (2, 5, "ADD", 4, 1, 2, 5)]
    df = lambda rows: spark.createDataFrame(rows, schema)
    assert mvcc.manifest_faults(df(good), 10).count() == 0
    bad = [(3, 6, "ADD", 5, 1, 20, 21), (3, 7, "ADD", 2, 2, 0, 1), (3, 8, "REMOVE", 9, 1, 0, 0), (3, 9, "REMOVE", 4, 2, 0, 0), (3, 10, "ADD", 6, 1, 9, 12), (3, 11, "ADD", 10, 3, 0, 1)]
    faults = {(r.ord, r.fault) for r in mvcc.manifest_faults(df(good + bad), 10).collect()}
    assert faults == {(7, "file number"), (8, "removes missing file"), (9, "remove level"), (10, "level range overlap"), (11, "file number")}
    assert sorted((r.file_no, r.level) for r in mvcc.apply_manifest(df(good + bad), 10).collect()) == [(2, 1), (3, 0), (4, 1)]
    assert sorted(r.file_no for r in mvcc.apply_manifest(df(good), 10).collect()) == [2, 3, 4]
    none = spark.createDataFrame([], "bytes bigint")
    assert mvcc.write_amplification(spark.createDataFrame([(10,), (20,)], "bytes bigint"), spark.createDataFrame([(45,)], "bytes bigint")).first()["milli"] == 2500
    assert mvcc.write_amplification(none, none).first()["milli"] is None


def test_range_overlaps_against_all_pairs(spark):
    import random

    rng = random.Random(5)
    edits = []
    for o in range(400):
        a, width = rng.randrange(40), rng.choice([0, 1, 3, 20, -2])
        edits.append((o, rng.choice(["ADD", "ADD", "REMOVE"]), rng.randrange(25), rng.randrange(3), a, a + width))
    edits += [(400, "ADD", 90, 1, None, 3), (401, "ADD", None, 1, 0, 50)]
    gone = lambda o, f: min((e[0] for e in edits if e[1] == "REMOVE" and e[2] == f and e[0] > o), default=10**6)
    adds = [(*e, gone(e[0], e[2])) for e in edits if e[1] == "ADD" and e[3] > 0 and None not in e]
    want = {a[0] for a in adds for b in adds if b[3] == a[3] and b[2] != a[2] and b[0] < a[0] < b[6] and b[4] <= a[5] and a[4] <= b[5]}
    df = spark.createDataFrame(edits, "ord bigint, action string, file_no bigint, level int, smallest bigint, largest bigint")
    found = lambda df: sorted(r.ord for r in mvcc.manifest_faults(df).filter("fault = 'level range overlap'").collect())
    assert found(df) == sorted(want) and 20 < len(want) < len(adds)
    named = df.withColumn("smallest", F.lpad(F.col("smallest").cast("string"), 4, "0")).withColumn("largest", F.lpad(F.col("largest").cast("string"), 4, "0"))
    assert found(named.filter("smallest >= '0' AND largest >= '0'")) == found(df.filter("smallest >= 0 AND largest >= 0"))


def test_range_overlaps_of_a_large_level(spark):
    """300,000 files of one level that never meet: some 10^11 pairs."""
    df = spark.range(300_000).selectExpr("id AS ord", "'ADD' AS action", "id AS file_no", "1 AS level", "id * 2 AS smallest", "id * 2 + 1 AS largest")
    last = spark.createDataFrame([(300_000, "ADD", 300_000, 1, 7, 8)], df.schema)
    got = []
    import threading

    run = threading.Thread(target=lambda: got.extend(mvcc.manifest_faults(df.union(last)).collect()), daemon=True)
    run.start()
    run.join(60)
    if run.is_alive():
        spark.sparkContext.cancelAllJobs()
    assert [tuple(r) for r in got] == [(300_000, 300_000, "level range overlap")]


def test_snapshots_are_counted(spark):
    df = spark.createDataFrame([(5, 1), (5, 1), (5, -1), (7, 1), (7, -1)], "watermark bigint, delta bigint")
    assert [(r.watermark, r.refs) for r in mvcc.live_snapshots(df).collect()] == [(5, 1)]


def test_rates_of_a_sum_beyond_a_long(spark):
    rows = [("p", "failed" if i % 2 else "ok", 5 * 10**18) for i in range(4)] + [("q", "ok", 0)]
    got = ledger.rates(spark.createDataFrame(rows, "profile string, verdict string, elapsed_ns bigint"), ["profile"], cpus=4)
    assert {tuple(r) for r in got.collect()} == {("p", 4, 2, 0, 0), ("q", 1, 0, None, None)}
    assert dict(got.dtypes)["milli_runs_s"] == dict(got.dtypes)["milli_bugs_cpu_hour"] == "bigint"


def test_shard_faults(spark):
    rows = [("a", s, "b", "c") for s in (0, 2, 4)] + [("z", s, "b", "c") for s in (1, 3, 5)]
    df = lambda rows: spark.createDataFrame(rows, "source string, seed bigint, build_label string, config_hash string")
    check = lambda rows, *a: sorted(map(tuple, ledger.shard_faults(df(rows), *a).collect()), key=str)
    assert check(rows, 0, 6, 2, "b", "c") == []
    more = [*rows, ("a", 1, "b", "c"), ("z", 9, "b", "c"), ("z", 7, "x", "c"), ("z", 7, "b", "x")]
    want = [("wrong build", "z", 7), ("wrong config", "z", 7), ("outside the range", "z", 9), ("several residues", "a", None), ("several sources", None, 1), ("repeated", None, 1), ("repeated", None, 7), ("missing", None, 6)]
    assert check(more, 0, 8, 2, "b", "c") == sorted(want, key=str)


def test_footprints_and_quorums(spark):
    f = spark.createDataFrame([("a", 5, 1), ("a", 6, 1), ("b", 1, 9)], "owner string, heap bigint, disk bigint")
    assert sorted((r.owner, r.measure, r.peak) for r in ledger.breaches(f, {"heap": 10, "disk": 8}).collect()) == [("a", "heap", 11), ("b", "disk", 9)]


def test_generation_and_orphans(spark):
    m = spark.createDataFrame([(1, True), (2, True), (3, False)], "generation bigint, valid boolean")
    none = spark.createDataFrame([], "generation bigint")
    assert mvcc.generation(m, none).first()[0] == 2
    assert mvcc.generation(m, spark.createDataFrame([(1,)], "generation bigint")).first()[0] == 1
    with pytest.raises(Exception, match="no valid generation"):
        mvcc.generation(m, spark.createDataFrame([(3,)], "generation bigint")).collect()


def test_ledger_rules(spark):
    rows = lambda seeds, verdict="ok": spark.createDataFrame([("b", "c", "p", s, verdict) for s in seeds], "build_label string, config_hash string, profile string, seed bigint, verdict string")
    got = sorted((r.lo, r.hi) for r in ledger.islands(rows([0, 1, 2, 5, 6, 9]), ["profile"]).collect())
    assert got == [(0, 3), (5, 7), (9, 10)]
    assert ledger.merge(rows([1]), rows([1])).count() == 1
    with pytest.raises(ValueError):
        ledger.merge_or_fail(rows([1]), rows([1], "failed"))
    assert [r.seed for r in ledger.coverage(rows([0, 2, 1]), 0, 4).collect()] == [3]
    assert sorted(r.seed for r in ledger.todo(0, 3, rows([0]).union(rows([1], "undecided"))).collect()) == [1, 2]


def events(spark, rows):
    return spark.createDataFrame(rows, "pos bigint, seq bigint, time_us bigint, node bigint, kind string, payload string")


def test_trace_rules(spark):
    bad = events(spark, [(0, 0, 5, 1, "A", ""), (1, 1, 4, 1, "B", ""), (2, 3, 6, 1, "A", "")])
    assert {(r.name, r.detail) for r in trace.invariants(bad).collect()} == {("trace_sequence", "1 followed by 3"), ("trace_time_order", "5us followed by 4us")}
    gap = events(spark, [(0, 0, 1, 1, "A", ""), (1, 1, 2, 1, "B", ""), (2, 5, 1, 1, "A", "")]).drop("pos")
    assert {(r.name, r.at) for r in trace.invariants(gap).collect()} == {("trace_sequence", 1), ("trace_time_order", 1)}
    many = spark.createDataFrame([(7 * i,) for i in range(100)], "seq bigint").repartition(3)
    assert [r.pos for r in trace.positions(many, ["seq"], span=50).orderBy("seq").collect()] == list(range(100))
    good = events(spark, [(0, 0, 10, 1, "A", ""), (1, 1, 10, 1, "B", ""), (2, 2, 20, 1, "A", ""), (3, 3, 20, 2, "A", "")])
    assert trace.busiest(good).first()["time_us"] == 20
    assert {r.gram for r in trace.ngrams(good.filter("seq < 3")).collect()} == {"A", "B", "A>B", "B>A", "A>B>A"}
    other = good.withColumn("node", F.when(F.col("pos") == 2, 9).otherwise(F.col("node")))
    assert trace.first_difference(good, good).count() == 0
    assert tuple(trace.first_difference(good, other).first())[:2] == (2, "node")
    assert tuple(trace.first_difference(good.filter("pos < 2"), good).first())[:2] == (2, "length")
    assert trace.tail(good, 0).count() == 0 and [r.seq for r in trace.tail(good, 2).orderBy("seq").collect()] == [2, 3]
    assert trace.diagram_svg(trace.diagram_rows(good)).startswith("<svg")


def test_quantile_rules(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 11)], "x bigint")
    floor = lambda n, d: quantiles.floor_index(df, [], "x", n, d, "q").first()[0]
    assert [floor(50, 100), floor(95, 100), floor(99, 100)] == [5, 9, 9]
    assert [floor(50, 1000), floor(95, 1000), floor(99, 1000), floor(999, 1000)] == [1, 1, 1, 9]
    assert [quantiles.nearest_rank(df, [], "x", p, "q").first()[0] for p in (50, 95, 99)] == [5, 10, 10]
    four = df.filter("x <= 4")
    assert [r.x for r in quantiles.buckets(four, [], "x").orderBy("bucket").collect()] == [1] * 4 + [2] * 4 + [3] * 4 + [4] * 4
    amp = spark.createDataFrame([(1, 3), (4, 1)], "b bigint, n bigint")
    assert [quantiles.weighted_nearest_rank(amp, [], "b", "n", p, 100, "q").first()[0] for p in (50, 99)] == [1, 4]


def test_hashes(spark):
    df = spark.createDataFrame([(b"",), (b"a",), (b"123456789",)], "b binary")
    got = [(r[0] & (2**64 - 1), r[1]) for r in df.select(hashing.fnv1a64("b"), hashing.crc32c("b")).collect()]
    assert got == [(0xCBF29CE484222325, 0), (0xAF63DC4C8601EC8C, 0xC1D04330), (hashing.fnv1a(b"123456789"), 0xE3069283)]
    a, b = hashing.Stream(7), hashing.Stream(7)
    assert [a.u64() for _ in range(5)] == [b.u64() for _ in range(5)] and hashing.Stream(7).stream("x").u64() != hashing.Stream(7).stream("y").u64()


def test_scalars(spark):
    df = spark.createDataFrame([("+5", "150ms"), (" 12", "2s"), ("x", "7"), ("9223372036854775808", "7m")], "n string, d string")
    assert [r[0] for r in df.select(scalars.parse_i64(F.col("n"))).collect()] == [5, None, None, None]
    assert [r[0] for r in df.select(scalars.duration_ns(F.col("d"))).collect()] == [150_000_000, 2_000_000_000, 7, None]
    assert scalars.prefix_end(b"a\xff") == b"b" and scalars.prefix_end(b"\xff") is None


def test_payload_texts(spark):
    rows = [(b"plain text",), (b"x" * 96,), (b"x" * 97,), (b"x" * 96 + b"\xff",), (b"\x00ab",), ("é".encode() * 50,), (b"",), (b"~ \x7f",)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "p binary").select(scalars.display_payload(F.col("p")), scalars.json_escape_bytes(F.col("p"))).collect()]
    assert [g[0] for g in got] == ["plain text", "x" * 96, "x" * 96 + "\u2026", "x" * 96 + "\u2026", "0x006162", "0x" + "c3a9" * 48 + "\u2026", "", "0x7e207f"]
    assert got[4][1] == "\\u0000\\u0061\\u0062" and got[6][1] == ""


def test_small_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    ids = spark.createDataFrame([("0" * 32,), ("0a" * 16,), ("0A" * 16,), ("a" * 31,)], "x string")
    assert [r[0] for r in ids.select(scalars.cluster_id(F.col("x"))).collect()] == [None, "0a" * 16, None, None]
    assert one(scalars.xml_escape(F.lit("<a b='c\"'>&"))) == "&lt;a b=&apos;c&quot;&apos;&gt;&amp;"
    assert one(scalars.saturating_sub(F.lit(3), F.lit(5))) == 0 and one(scalars.percent_to_p16(F.lit(50))) == 32768 and one(scalars.percent_to_p16(F.lit(100))) == 65535
    assert one(scalars.ratio_at_least(F.lit(2**62), F.lit(3), F.lit(2**62 - 1), F.lit(3))) and not one(scalars.ratio_at_least(F.lit(1), F.lit(3), F.lit(1), F.lit(2)))
    assert [one(scalars.hex_decode(F.lit(x))) for x in ("0aff", "0AFF", "0af")] == [b"\x0a\xff", None, None] and one(scalars.hex_encode(F.lit(b"\x0a\xff"))) == "0aff"


def test_membership(spark):
    m = spark.createDataFrame([("c", n, i) for n, i in ((1, 5), (2, 7), (3, 3), (4, 9))], "cluster string, node bigint, match bigint")
    assert membership.commit_index(m).first()["commit"] == 5
    assert membership.negotiate({"min": 1, "max": 3, "features": 3, "frame": 9}, {"min": 2, "max": 5, "features": 2, "frame": 4}) == {"version": 3, "features": 2, "frame": 4}
    assert membership.negotiate({"min": 1, "max": 1, "features": 0, "frame": 1}, {"min": 2, "max": 2, "features": 0, "frame": 1}) is None


def test_readers(spark, tmp_path):
    (tmp_path / "h.tsv").write_text("# v1\nSET\t6b\t91d6\t1\t3\nGET\t6b\t-\t2\t3\n")
    got = readers.read_history_tsv(spark, str(tmp_path / "h.tsv")).orderBy("ord").collect()
    assert [(r.ord, r.legacy_id, r.kind, r.observed) for r in got] == [(0, 3, "SET", b"\x91\xd6"), (1, 3, "GET", None)]
    (tmp_path / "o.tsv").write_text("GET\t6b\t-\t9\t9\n\n# note\nSET\t6b\t\t1\t3\n")
    assert [(r.ord, r.kind, r.observed) for r in readers.read_history_tsv(spark, str(tmp_path / "o.tsv")).orderBy("ord").collect()] == [(0, "GET", None), (1, "SET", b"")]
    for line in ("GET\t6b\t-\t9\n", "GET\t6\t-\t1\t2\n", "GET\t6b\t-\tx\t2\n"):
        (tmp_path / "m.tsv").write_text(line)
        with pytest.raises(Exception, match="malformed"):
            readers.read_history_tsv(spark, str(tmp_path / "m.tsv")).collect()
    (tmp_path / "l.tsv").write_text("# ledger\nheader\nb\tc\tp\t0x0022\tok\t7\t13\t29\t-\ntorn")
    assert [(r.seed, r.events, r.artifact_hash) for r in readers.read_ledger_tsv(spark, str(tmp_path / "l.tsv")).collect()] == [(34, 7, None)]
    (tmp_path / "bad.tsv").write_text("# ledger\nheader\nb\tc\n")
    with pytest.raises(Exception, match="malformed"):
        readers.read_ledger_tsv(spark, str(tmp_path / "bad.tsv")).collect()
    (tmp_path / "t.json").write_text('{"trace_version":1,"seed":"0x2a","config_hash":0,"build":"b","events":[{"seq":0,"time_ns":5,"node":1,"kind":"K","payload_hex":"6162"}]}')
    assert bytes(readers.read_trace_json(spark, str(tmp_path / "t.json")).first()["payload"]) == b"ab"
    table = bytes.fromhex("4343535401000700000000000000020000000100000061010000000000000001030000006f6e65010000006202000000000000000200000000360c63d6")
    (tmp_path / "x.sst").write_bytes(table)
    assert [(bytes(r.user_key), r.sequence, r.kind) for r in readers.read_tables(spark, str(tmp_path / "x.sst")).collect()] == [(b"a", 1, "PUT"), (b"b", 2, "DEL")]
    assert readers.meta_generation(bytes.fromhex("43434d54010007000000000000008b275acd")) == 7
    with pytest.raises(ValueError):
        list(readers.table_entries(table[:-1] + b"\0"))


def test_frames_and_commands(spark, tmp_path):
    frame = lambda r: struct.pack("<II", len(r), readers.crc(r)) + r
    whole = frame(b"one") + frame(b"two")
    assert [r for _, r in readers.framed_records(whole + frame(b"torn")[:-1])] == [b"one", b"two"]
    for bad in (whole[:-1] + b"X", whole + struct.pack("<II", 0, 0), whole + struct.pack("<I", 1 << 30) + b"1234"):
        with pytest.raises(ValueError):
            list(readers.framed_records(bad))
    (tmp_path / "w.resp").write_bytes(b"*3\r\n$3\r\nset\r\n$1\r\nk\r\n$1\r\nv\r\n*2\r\n$3\r\nGET\r\n$1\r\nk\r\n*1\r\n$3\r\nGET\r\n*2\r\n$3")
    rows = readers.parse_commands(readers.read_resp(spark, str(tmp_path / "w.resp"))).orderBy("ord").collect()
    assert [(r.verb, r.key and bytes(r.key), r.valid) for r in rows] == [("SET", b"k", True), ("GET", b"k", True), ("GET", None, False)]
    with pytest.raises(ValueError):
        readers.resp(b"!oops\r\n")


def test_binary_traces(spark, tmp_path):
    from tidemark.sources import sinks

    events = [{"seq": 0, "time_ns": 5, "node": None, "kind": "Fault", "payload": b"x"}, {"seq": 1, "time_ns": 9, "node": 3, "kind": "Commit", "payload": b""}]
    data = sinks.trace_bytes(42, 7, "b", events)
    (tmp_path / "t.bin").write_bytes(data)
    got = readers.read_traces(spark, str(tmp_path / "t.bin")).orderBy("seq").collect()
    assert [(r.run_id, r.seq, r.time_ns, r.node, r.kind, bytes(r.payload)) for r in got] == [("0x000000000000002a", 0, 5, None, "Fault", b"x"), ("0x000000000000002a", 1, 9, 3, "Commit", b"")]
    for bad in (data[:-1], data + b"!", b"NOPE" + data[4:]):
        with pytest.raises((ValueError, struct.error)):
            list(readers.trace_events(bad))
    assert list(readers.trace_events(data.replace(b"\x1c\x01\0\0\0x", b"\xc8\x01\0\0\0x")))[0][5] == "kind-200"


def test_history_containers(spark, tmp_path):
    from tidemark.operators import linearize
    from tidemark.sources import sinks

    base = {"client": 1, "sequence": 1}
    ops = [
        base | {"id": 1, "invoke": 0, "complete": 1, "kind": "SET", "key": b"k", "value": b"v", "outcome": "ok", "deadline": 99},
        base | {"id": 2, "invoke": 2, "complete": 3, "kind": "GET", "key": b"k", "outcome": "ok", "out_value": b"v"},
        base | {"id": 3, "invoke": 4, "complete": 5, "kind": "GET", "key": b"x", "outcome": "ok", "out_value": None, "consistency": "stale"},
        base | {"id": 4, "invoke": 4, "complete": 5, "kind": "CAS", "key": b"k", "expected": None, "value": b"w", "outcome": "fail"},
        base | {"id": 5, "invoke": 6, "complete": 7, "kind": "INCR", "key": b"n", "outcome": "ok", "out_int": -4},
        base | {"id": 6, "invoke": 8, "complete": 9, "kind": "SCAN", "prefix": b"k", "scan_limit": 7, "outcome": "ok", "out_pairs": [{"key": b"k", "value": b"v"}]},
        base | {"id": 7, "invoke": 10, "complete": 11, "kind": "BATCH", "commands": [{"kind": "SET", "key": b"z", "value": b"1"}, {"kind": "GET", "key": b"z"}], "outcome": "ok", "replies": [{"outcome": "ok"}, {"outcome": "ok", "out_value": b"1"}]},
        base | {"id": 8, "invoke": 12, "complete": None, "kind": "DEL", "key": b"k", "outcome": "timeout"},
        base | {"id": 9, "invoke": 13, "complete": 14, "kind": "GET", "key": b"k", "outcome": "error", "probe": "replica", "consistency": "diagnostic", "replica": 3, "committed_index": 9, "state_hash": -5},
    ]
    data = sinks.history_bytes(ops, "build", 0xABC, {b"n": b"-5"})
    (tmp_path / "h.bin").write_bytes(data)
    df = readers.read_history(spark, str(tmp_path / "h.bin"))
    rows = df.orderBy("ord").collect()
    assert [r.id for r in rows] == list(range(1, 10)) and {r.config_hash for r in rows} == {"0000000000000abc"}
    assert (rows[0].deadline, rows[3].outcome, rows[4].out_int, rows[7].complete, rows[8].state_hash, rows[8].probe) == (99, "fail", -4, None, -5, "replica")
    assert [(bytes(c["key"]), c["kind"]) for c in rows[6].commands] == [(b"z", "SET"), (b"z", "GET")] and bytes(rows[6].replies[1]["out_value"]) == b"1"
    start = readers.read_history_initial(spark, str(tmp_path / "h.bin"))
    assert [(bytes(r.key), bytes(r.value)) for r in start.collect()] == [(b"n", b"-5")]
    sinks.write_history(df, str(tmp_path / "again.bin"), build="build", config_hash=0xABC, initial={b"n": b"-5"})
    assert (tmp_path / "again.bin").read_bytes() == data
    # older versions have no deadlines, modes or batches
    old = sinks.history_bytes(ops[:1])
    assert readers.history_operations(old[:4] + b"\x02\x00" + old[6:-11])[1][0]["consistency"] == "strong"
    for bad in (data[:-1], data + b"!", b"NOPE" + data[4:], data[:4] + b"\x05\x00" + data[6:], data[:4] + b"\x03\x00" + data[6:], sinks.history_bytes(ops[:1] * 2)):
        with pytest.raises(ValueError):
            readers.history_operations(bad)
    text = lambda c: F.decode(c, "UTF-8")
    shown = df.filter("kind <> 'SCAN' AND kind <> 'BATCH'").select(*[text(c).alias(c) if c in ("key", "value", "expected", "out_value") else c for c in ("run_id", "id", "invoke", "complete", "kind", "key", "value", "expected", "outcome", "out_value", "out_int", "deadline", "consistency", "probe")])
    got = {r.key: r.verdict for r in linearize.check(shown, ["run_id"], initial=start.select("run_id", text("key").alias("key"), text("value").alias("value"))).collect()}
    assert got == {"k": "linearizable", "n": "linearizable"}
