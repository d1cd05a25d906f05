"""Command semantics, sessions and scans on literal fixtures."""

from tidemark.operators import replay, sessions
from tidemark.operators.replay import SECOND, Machine, show


def c(kind, key=None, value=None, t=0, **more):
    b = lambda x: x.encode() if isinstance(x, str) else x
    return {"kind": kind, "key": b(key), "value": b(value), "leader_time_ns": t * SECOND, "delta": 1, "expected": b(more.pop("expected", None)), **more}


def run(*commands):
    m = Machine()
    return [m.apply(x) for x in commands], m


def test_counter_keeps_deadline_and_persist_revives():
    r, _ = run(c("SET", "a", "1", 0, ttl_ns=10 * SECOND), c("INCR", "a", t=5), c("TTL", "a", t=9), c("GET", "a", t=10), c("INCR", "a", t=10), c("GET", "a", t=11), c("PERSIST", "a", t=11), c("GET", "a", t=11), c("TTL", "a", t=11), c("TTL", "missing", t=11))
    assert r == ["OK", 2, 1, None, 1, None, 1, b"1", -1, -2]


def test_clock_never_goes_back():
    r, _ = run(c("SET", "b", "x", 100, ttl_ns=10 * SECOND), c("TTL", "b", t=50), c("GET", "b", t=110))
    assert r == ["OK", 10, None]


def test_conditional_set():
    r, _ = run(c("SET", "k", "1", condition="NX"), c("SET", "k", "2", condition="NX"), c("SET", "k", "3", condition="XX", ttl_ns=SECOND), c("SET", "k", "4", 5, condition="NX"))
    assert r == [True, False, True, True]


def test_compare_and_set():
    r, _ = run(c("CAS", "k", "a"), c("CAS", "k", "c", expected="b"), c("CAS", "k", None, expected="a"), c("GET", "k"))
    assert r == [True, False, True, None]


def test_batches_abort_on_errors_only():
    m = Machine()
    assert m.apply({"kind": "BATCH", "batch": [c("SET", "x", "1"), c("INCR", "x"), c("GET", "x")]}) == ["OK", 2, b"2"]
    assert m.apply({"kind": "BATCH", "batch": [c("SET", "y", "a"), c("INCR", "y")]}) == "batch-error:1:not-numeric"
    assert m.get(b"y") is None
    assert m.apply({"kind": "BATCH", "batch": [c("SET", "z", "1"), c("CAS", "z", "9", expected="0"), c("INCR", "z")]}) == ["OK", False, 2]
    assert m.apply({"kind": "BATCH", "batch": []}) == "error:invalid-input"
    assert m.apply({"kind": "BATCH", "batch": [{"kind": "BATCH"}]}) == "error:invalid-input"


def test_sweep_takes_the_oldest():
    m = Machine()
    for k, t in (("a", 1), ("b", 1), ("c", 2)):
        m.apply(c("SET", k, "v", ttl_ns=t * SECOND))
    sweep = {"kind": "PURGE", "at_ns": SECOND, "scan_limit": 1, "leader_time_ns": SECOND}
    assert [m.apply(sweep) for _ in range(3)] == [1, 1, 0]
    assert sorted(m.values) == [b"c"]


def test_numeric_edges_and_takes():
    m = Machine()
    m.values = {b"max": b"9223372036854775807", b"space": b" 5", b"plus": b"+5"}
    assert [m.apply(c("INCR", k)) for k in ("max", "space", "plus")] == ["error:not-numeric", "error:not-numeric", 6]
    assert [m.apply(c("DEL", "none")), m.apply(c("GETDEL", "none")), m.apply(c("APPEND", "none", "xy"))] == [1, None, 2]


def test_scan_limits_before_expiry():
    m = Machine()
    for k in ("a", "ab", "b", "c"):
        m.apply(c("SET", k, "v", ttl_ns=SECOND if k == "a" else None))
    scan = {"kind": "SCAN", "scan_start": b"a", "scan_end": None, "scan_limit": 2}
    assert [k for k, _ in m.apply(scan)] == [b"a", b"ab"]
    assert [k for k, _ in m.apply(scan | {"leader_time_ns": SECOND})] == [b"ab"]
    assert [k for k, _ in m.apply(scan | {"scan_end": b"b", "scan_limit": 9})] == [b"ab"]


def test_session_rules():
    s, second = sessions.Session(), 10**9
    half, five = 30 * 60, 5 * 60
    steps = [(1, "INCR p", 0), (1, "INCR p", 1), (1, "INCR q", 2), (3, "INCR p", 3), (2, "INCR p", 4), (4, "INCR p", 4 + half), (5, "INCR p", 4 + half + 240), (5, "INCR p", 4 + half + five)]
    assert [s.admit(n, cmd, t * second) for n, cmd, t in steps] == ["apply", "cached", "sequence-conflict", "apply", "stale-seq", "session-expired", "session-expired", "apply"]


COMMAND = "kind string, key binary, value binary, expected binary, delta bigint, ttl_ns bigint, at_ns bigint, condition string, scan_start binary, scan_end binary, scan_limit int"


def test_replay_folds_linked_keys_together(spark):
    fields = [f.split()[0] for f in COMMAND.split(", ")]
    row = lambda i, x: (i, x.get("leader_time_ns") or 0, *[x.get(f) for f in fields], [tuple(b.get(f) for f in fields) for b in x["batch"]] if x.get("batch") else None)
    log = [c("SET", "x", "1"), {"kind": "BATCH", "batch": [c("INCR", "x"), c("SET", "y", "q")]}, c("GET", "y"), c("GET", "x"), c("SET", "z", "5"), c("INCR", "z")]
    df = spark.createDataFrame([row(i, x) for i, x in enumerate(log)], f"log_index bigint, leader_time_ns bigint, {COMMAND}, batch array<struct<{COMMAND.replace(' ', ': ').replace(',:', ',')}>>")
    got = [r.reply for r in replay.replay(df).orderBy("log_index").collect()]
    m = Machine()
    assert got == [show(m.apply(x)) for x in log] == ["OK", '[2, OK]', '"q"', '"2"', "OK", "6"]
    assert sorted(r.reply for r in replay.replay(df, whole=True).collect()) == sorted(got)


def frame(spark, log):
    fields = [f.split()[0] for f in COMMAND.split(", ")]
    row = lambda i, x: (i, x.get("leader_time_ns") or 0, *[x.get(f) for f in fields], [tuple(b.get(f) for f in fields) for b in x["batch"]] if x.get("batch") else None)
    return spark.createDataFrame([row(i, x) for i, x in enumerate(log)], f"log_index bigint, leader_time_ns bigint, {COMMAND}, batch array<struct<{COMMAND.replace(' ', ': ').replace(',:', ',')}>>")


def test_replay_keeps_integers_exact(spark):
    t = 1704067200000000000
    at = lambda n, x: x | {"leader_time_ns": t + n}
    log = [at(0, c("SET", "a", "1")), at(1, c("EXPIREAT", "a", at_ns=t + 101)), at(50, c("GET", "a")), at(100, c("GET", "a")), at(101, c("GET", "a"))]
    log += [at(200, c("SET", "b", "0")), at(201, c("INCR", "b") | {"delta": 9007199254740993}), at(202, c("INCR", "b") | {"delta": -1}), at(203, c("SET", "c", "x", ttl_ns=3)), at(205, c("GET", "c")), at(206, c("GET", "c"))]
    got = [r.reply for r in replay.replay(frame(spark, log)).orderBy("log_index").collect()]
    assert got == ["OK", "1", '"1"', '"1"', "nil", "OK", "9007199254740993", "9007199254740992", "OK", '"x"', "nil"]


def test_replay_of_commands_that_see_all_keys(spark):
    scan = {"kind": "SCAN", "scan_start": b"a", "scan_limit": 9}
    log = [c("SET", "a", "1", ttl_ns=SECOND), c("SET", "b", "2"), scan, {"kind": "PURGE", "at_ns": SECOND, "scan_limit": 5, "leader_time_ns": SECOND}, scan, {"kind": "BATCH", "batch": [c("SET", "d", "4"), scan]}]
    m = Machine()
    want = [show(m.apply(x)) for x in log]
    assert [r.reply for r in replay.replay(frame(spark, log)).orderBy("log_index").collect()] == want and want[2] == '[["a", "1"], ["b", "2"]]' and want[3] == "1"
    assert not replay.sees_all_keys(frame(spark, log[:2])) and replay.sees_all_keys(frame(spark, log[5:]))


def test_failed_batch_leaves_everything_as_it_was():
    m = Machine()
    for x in (c("SET", "a", "1", ttl_ns=SECOND), c("SET", "b", "x"), {"kind": "BATCH", "batch": [c("DEL", "a"), c("SET", "n", "1"), c("PERSIST", "b"), c("INCR", "b")]}):
        reply = m.apply(x)
    assert reply == "batch-error:3:not-numeric" and m.values == {b"a": b"1", b"b": b"x"} and m.deadlines == {b"a": SECOND} and m.undo is None


def test_existence_and_conditions():
    r, _ = run(c("EXISTS", "k"), c("SET", "k", "v", ttl_ns=SECOND), c("EXISTS", "k"), c("EXISTS", "k", t=1), c("PERSIST", "none"))
    assert r == [0, "OK", 1, 0, 0]


def test_session_requests():
    s, second = sessions.Session(), 10**9
    told = iter("abcdefgh")
    ask = lambda n, cmd, t: s.request(n, cmd, t * second, lambda: next(told))
    assert ask(0, "x", 0) == ("apply", "a") and ask(0, "x", 1) == ("apply", "b")  # sequence 0 isn't remembered
    assert ask(1, "x", 2) == ("apply", "c") and ask(1, "x", 3) == ("cached", "c")
    assert ask(1, "y", 1000) == ("sequence-conflict", None)
    assert ask(1, "x", 1000 + 1800) == ("cached", "c")  # a conflict keeps the session alive
    tight = sessions.Session(most_bytes=3)
    assert tight.request(1, "abc", 0, lambda: "d") == ("busy", None) and tight.request(1, "ab", 0, lambda: "d") == ("apply", "d")


def test_session_expiry(spark):
    idle, grace = sessions.IDLE_NS, sessions.GRACE_NS
    rows = [(1, 1, False, 0, None), (1, 2, False, 1, None), (0, 9, False, 0, None), (1, 3, True, 0, idle), (1, 4, True, 0, idle + 1), (1, 5, False, 2, None)]
    df = spark.createDataFrame(rows, "namespace int, client bigint, tombstone boolean, last_active bigint, expires_at bigint")
    got = [(r.client, r.tombstone) for r in sessions.expire(df, idle + 1, 10).collect()]
    assert got == [(9, False), (1, False), (3, True), (2, False), (4, True)]  # due at the very instant; by time, then key
    after = {(r.client, r.tombstone): r.expires_at for r in sessions.after_expiry(df, idle + 1, 2).collect()}
    assert after == {(9, True): idle + grace, (1, True): idle + grace, (2, False): None, (3, True): idle, (4, True): idle + 1, (5, False): None}
    assert sessions.after_expiry(df, idle + grace + 2, 10).count() == 0
    assert sorted(r.client for r in sessions.for_fresh_restore(df).collect()) == [1, 2, 3, 4, 5]


def test_clock_over_many_spans(spark):
    import random

    from tidemark.operators import clock

    rng = random.Random(3)
    values = [rng.randint(0, 1000) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(values)), "i bigint, x bigint").repartition(5)
    got = [r.top for r in clock.running_max(df, "i", "x", "top", span=4).orderBy("i").collect()]
    assert got == [max(values[: i + 1]) for i in range(300)]


def test_session_fold_ignores_row_order(spark):
    rows = [(i, 1, 7, i // 2, f"c{i // 2}", i * 10**9) for i in range(40)]
    df = spark.createDataFrame(rows, "log_index bigint, namespace int, client bigint, sequence bigint, command string, now_ns bigint")
    a = {r.log_index: r.decision for r in sessions.decide(df).collect()}
    b = {r.log_index: r.decision for r in sessions.decide(df.repartition(5)).collect()}
    assert a == b and set(a.values()) == {"apply", "cached"}
