"""Anomalies, guarantees and linearizability on literal histories; the search against permutations."""

import itertools
import random

import pytest

from tidemark.operators import history, linearize

SCHEMA = "id bigint, client bigint, sequence bigint, invoke bigint, complete bigint, kind string, key string, value string, expected string, outcome string, out_value string, out_int bigint, deadline bigint, probe string, replica bigint, committed_index bigint, state_hash bigint"
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


def op(i, kind, span, out=None, value=None, key="x", client=0, sequence=0, **more):
    o = dict.fromkeys(NAMES) | {"id": i, "client": client, "sequence": sequence, "invoke": span[0], "complete": span[1], "kind": kind, "key": key, "value": value, "outcome": "timeout" if span[1] is None else "ok"}
    return o | ({"out_int": out} if kind == "INCR" else {"out_value": out}) | more


def frame(spark, ops):
    return spark.createDataFrame([tuple(o[n] for n in NAMES) for o in ops], SCHEMA)


CASES = {
    "stale": ([op(1, "SET", (0, 1), value="1"), op(2, "SET", (2, 3), value="2"), op(3, "GET", (4, 5), "1")], [("stale-read", [2, 3])], "not-linearizable"),
    "resurrection": ([op(1, "SET", (0, 1), value="1"), op(2, "DEL", (2, 3)), op(3, "GET", (4, 5), "1")], [("resurrection", [2, 3])], "not-linearizable"),
    "dirty": ([op(1, "GET", (0, 1), "9")], [("dirty-read", [1])], "not-linearizable"),
    "incr": ([op(1, "INCR", (0, 1), 2), op(2, "INCR", (2, 3), 1)], [("non-monotonic-incr", [1, 2])], "not-linearizable"),
    "lost": ([op(1, "SET", (0, 1), value="1"), op(2, "GET", (5, 6), None, probe="final")], [("acked-write-lost", [1, 2])], None),
    "update": ([op(1, "CAS", (0, 1), value="1", expected="0"), op(2, "CAS", (2, 3), value="2", expected="0"), op(3, "GET", (5, 6), "2", probe="final")], [("lost-update", [1, 2, 3])], None),
    "duplicate": ([op(1, "INCR", (0, 1), 1, client=1, sequence=1), op(2, "INCR", (2, 3), 2, client=1, sequence=1), op(3, "GET", (5, 6), "2", probe="final")], [("duplicate-apply", [1, 2, 3])], None),
    "replicas": ([op(1, "GET", (0, 1), probe="replica", replica=1, committed_index=10, state_hash=5), op(2, "GET", (0, 1), probe="replica", replica=2, committed_index=10, state_hash=6)], [("replica-divergence", [1, 2])], None),
    "open seen": ([op(1, "SET", (0, None), value="1"), op(2, "GET", (1, 2), None), op(3, "GET", (3, 4), "1")], [("dirty-read", [3])], "linearizable"),
    "open lost": ([op(1, "SET", (0, None), value="1"), op(2, "GET", (1, 2), "1"), op(3, "GET", (3, 4), None)], None, "not-linearizable"),
    "deadline either": ([op(1, "SET", (0, 1), value="1", deadline=10), op(2, "GET", (9, 11), "1")], None, "linearizable"),
    "deadline either nil": ([op(1, "SET", (0, 1), value="1", deadline=10), op(2, "GET", (9, 11), None)], None, "linearizable"),
    "deadline over": ([op(1, "SET", (0, 1), value="1", deadline=10), op(2, "GET", (10, 11), "1")], None, "not-linearizable"),
    "deadline early": ([op(1, "SET", (0, 1), value="1", deadline=10), op(2, "GET", (5, 9), None)], None, "not-linearizable"),
    "equal instants": ([op(1, "SET", (5, 5), value="1"), op(2, "GET", (5, 5), None)], [("unclassified", [])], "linearizable"),
    "clean": ([op(1, "SET", (0, 1), value="1"), op(2, "GET", (2, 3), "1")], [("unclassified", [])], "linearizable"),
}


@pytest.mark.parametrize("name", [n for n, x in CASES.items() if x[2]])
def test_search(name):
    assert linearize.search([dict(o) for o in CASES[name][0]]) == CASES[name][2]


def test_classes_in_one_table(spark):
    for name in ("stale", "resurrection", "dirty", "incr", "lost", "update", "duplicate", "replicas", "clean"):
        ops, want, _ = CASES[name]
        got = [(r["class"], list(r["operation_ids"])) for r in history.classify(frame(spark, ops)).collect()]
        assert set(map(str, want)) <= set(map(str, got)), (name, got)
        if name == "clean":
            assert got == want


def test_session_guarantees(spark):
    ops = [op(1, "SET", (0, 1), value="1", key="a", client=1, sequence=1), op(2, "GET", (2, 3), None, key="a", client=1, sequence=2)]
    ops += [op(3, "GET", (0, 1), "1", key="b", client=2, sequence=1), op(4, "GET", (2, 3), "2", key="b", client=2, sequence=2)]
    ops += [op(5, "SET", (0, 1), value="1", key="c", client=3, sequence=5), op(6, "SET", (2, 3), value="1", key="c", client=3, sequence=4)]
    ops += [op(7, "GET", (0, 1), None, key="d", client=4, sequence=5), op(8, "SET", (2, 3), value="1", key="d", client=4, sequence=4)]
    got = {(r.client, r.guarantee, tuple(r.operation_ids)) for r in history.session_violations(frame(spark, ops)).collect()}
    assert got == {(1, "read-your-writes", (1, 2)), (2, "monotonic-reads", (3, 4)), (3, "monotonic-writes", (5, 6)), (4, "writes-follow-reads", (7, 8))}
    shadow = [*ops[:2], op(9, "SET", (0, None), value="7", key="a", client=9)]
    assert history.session_violations(frame(spark, shadow)).count() == 0


def model(state, o, due=None):
    """(state after, reply) of a plain dictionary machine; deadlines matter to GET alone."""
    kind, key, state = o["kind"], o.get("key"), dict(state)
    value = state[key][0] if key in state else None
    if kind == "SET":
        state[key] = (o["value"], due)
        return state, "ok"
    if kind == "DEL":
        state.pop(key, None)
        return state, "ok"
    if kind == "INCR":
        n = int(value) + 1 if value is not None and value.lstrip("-").isdigit() else 1
        state[key] = (str(n), None)
        return state, n
    if kind == "CAS":
        if value == o["expected"]:
            state[key] = (o["value"], None)
        return state, value == o["expected"]
    if kind == "SCAN":
        return state, [(k, v[0]) for k, v in sorted(state.items()) if k.startswith(o["prefix"] or "")][: o["scan_limit"]]
    if kind == "BATCH":
        out = []
        for c in o["commands"]:
            state, reply = model(state, c, due)
            out.append(reply)
        return state, out
    return state, value


def said(o):
    if o["kind"] == "BATCH":
        return [said({**c, **r}) for c, r in zip(o["commands"], o["replies"], strict=True)]
    if o["kind"] == "SCAN":
        return [(x["key"], x["value"]) for x in o["out_pairs"]]
    return {"SET": "ok", "DEL": "ok", "INCR": o["out_int"], "CAS": o["outcome"] == "ok", "GET": o["out_value"]}[o["kind"]]


def brute(ops, initial=()):
    """Try every order of every choice of unanswered mutations."""
    must = [o for o in ops if o["outcome"] != "timeout"]
    may = [o for o in ops if o["outcome"] == "timeout" and o["kind"] not in ("GET", "SCAN")]
    for r in range(len(may) + 1):
        for extra in itertools.combinations(may, r):
            chosen = [*must, *extra]
            for order in itertools.permutations(chosen):
                place = {o["id"]: i for i, o in enumerate(order)}
                if any(a["complete"] is not None and a["complete"] < b["invoke"] and place[a["id"]] > place[b["id"]] for a in chosen for b in chosen):
                    continue
                state, fits = {k: (v, None) for k, v in initial}, True
                for o in order:
                    if o["kind"] == "GET":
                        value, due = state.get(o["key"], (None, None))
                        seen, gone = value is not None and (due is None or o["invoke"] < due), value is None or (due is not None and o["complete"] >= due)
                        fits = (o["out_value"] == value and seen) if o["out_value"] is not None else gone
                    else:
                        state, reply = model(state, o, o["deadline"])
                        fits = o["outcome"] == "timeout" or reply == said(o)
                    if not fits:
                        break
                if fits:
                    return "linearizable"
    return "not-linearizable"


def test_search_against_permutations():
    rng = random.Random(4)
    seen = set()
    for _ in range(400):
        ops = []
        for i in range(rng.randint(1, 5)):
            a = rng.randint(0, 8)
            kind = rng.choice(["SET", "GET", "DEL", "INCR", "GET", "CAS"])
            end = None if rng.random() < 0.2 else a + rng.randint(0, 4)
            o = op(i, kind, (a, end), (rng.randint(1, 2) if kind == "INCR" else rng.choice([None, "1", "2"])) if end is not None else None, rng.choice(["1", "2"]) if kind in ("SET", "CAS") else None)
            o |= {"expected": rng.choice([None, "1"])} if kind == "CAS" else {}
            o |= {"deadline": rng.randint(2, 9)} if kind == "SET" and rng.random() < 0.4 else {}
            o |= {"outcome": "fail"} if kind == "CAS" and end is not None and rng.random() < 0.4 else {}
            ops.append(o)
        initial = {"x": "1"} if rng.random() < 0.3 else {}
        want = brute([dict(o) for o in ops], initial.items())
        seen.add(want)
        assert linearize.search([dict(o) for o in ops], initial) == want, ops
    assert len(seen) == 2


def spanning(rng, n):
    """A history over two keys with SCAN and BATCH whose replies are mostly those of some order."""
    ops, state = [], {}
    for i in range(n):
        a = 3 * i + rng.randint(0, 4)
        kind = rng.choice(["SET", "GET", "DEL", "INCR", "SCAN", "BATCH"])
        end = None if rng.random() < 0.15 else a + rng.randint(0, 5)
        o = op(i, kind, (a, end), key=rng.choice("xy")) | {"prefix": rng.choice([None, "x"]), "scan_limit": rng.choice([1, 9])}
        o |= {"value": rng.choice("12")} if kind == "SET" else {}
        o |= {"commands": [{"kind": k, "key": rng.choice("xy"), "value": "1"} for k in rng.choices(["SET", "GET", "INCR"], k=2)]} if kind == "BATCH" else {}
        state, reply = model(state, o)
        if end is not None:
            o |= {"out_value": reply} if kind == "GET" else {"out_int": reply + (rng.random() < 0.1)} if kind == "INCR" else {}
            o |= {"out_pairs": [{"key": k, "value": v} for k, v in reply[: None if rng.random() < 0.9 else 0]]} if kind == "SCAN" else {}
            if kind == "BATCH":
                o["replies"] = [{"outcome": "ok", "out_value": r if c["kind"] == "GET" else None, "out_int": r if c["kind"] == "INCR" else None} for c, r in zip(o["commands"], reply, strict=True)]
        ops.append(o)
    return ops


def test_search_of_spanning_operations_against_permutations():
    rng, seen = random.Random(14), set()
    for _ in range(250):
        ops = spanning(rng, rng.randint(1, 5))
        want = brute([dict(o) for o in ops])
        seen.add(want)
        assert linearize.search([dict(o) for o in ops]) == want, ops
    assert len(seen) == 2


def test_check_of_runs_that_span_keys(spark):
    reply = "outcome: string, out_value: string, out_int: bigint"
    schema = f"run string, {SCHEMA}, consistency string, prefix string, scan_limit int, out_pairs array<struct<key: string, value: string>>, commands array<struct<kind: string, key: string, value: string>>, replies array<struct<{reply}>>"
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rng, rows, want = random.Random(15), [], {}
    for r in range(12):
        ops = spanning(rng, 4)
        want[f"r{r}"] = linearize.search([dict(o) for o in ops])
        for o in ops:
            rows.append((f"r{r}", *[o[n] for n in names], "strong", o.get("prefix"), o.get("scan_limit"), o.get("out_pairs"), [(c["kind"], c["key"], c["value"]) for c in o["commands"]] if "commands" in o else None, [(c["outcome"], c["out_value"], c["out_int"]) for c in o["replies"]] if "replies" in o else None))
        stale = op(99, "GET", (50, 51), "never", key="x")
        rows.append((f"r{r}", *[stale[n] for n in names], "stale", None, None, None, None, None))
    df = spark.createDataFrame(rows, schema)
    got = {}
    for r in linearize.check(df, ["run"]).collect():
        got.setdefault(r.run, []).append((r.key, r.verdict))
    kind = 1 + names.index("kind")
    spans = {x[0] for x in rows if x[kind] in ("SCAN", "BATCH")}
    assert set(got) == set(want)
    for run, found in got.items():
        if run in spans:
            assert found == [(None, want[run])]
        assert ("not-linearizable" in [v for _, v in found]) == (want[run] == "not-linearizable")
    start = spark.createDataFrame([("w", "x", "7")], "run string, key string, value string")
    part = spark.createDataFrame([("w", *[op(1, "GET", (0, 1), "7")[n] for n in names])], f"run string, {SCHEMA}")
    assert [r.verdict for r in linearize.check_window(part, start, ["run"]).collect()] == ["linearizable"]
    assert [r.verdict for r in linearize.check_window(part, start.limit(0), ["run"]).collect()] == ["not-linearizable"]
    with pytest.raises(ValueError):
        linearize.check_window(part, None, ["run"])


def test_increment_starts_from_strict_numbers():
    assert [linearize.integer(x) for x in ("5", "+5", "-3", "1_0", " 5", "", None, "9223372036854775808", "\u0665")] == [5, 5, -3, 0, 0, 0, 0, 0, 0]
    top = str(2**63 - 1)
    assert linearize.search([op(1, "INCR", (0, 1), 2**63)], {"x": top}) == "not-linearizable"


def test_check_groups_caps_and_witness(spark):
    ops = CASES["stale"][0] + [op(10 + i, "GET", (10 + i, 10 + i), None, key="y") for i in range(3)]
    got = {r.key: (r.operations, r.verdict, list(r.witness)) for r in linearize.check(frame(spark, ops), witness=True).collect()}
    assert got["y"] == (3, "linearizable", []) and got["x"][:2] == (3, "not-linearizable") and len(got["x"][2]) >= 1
    assert {r.verdict for r in linearize.check(frame(spark, ops), max_states=0).collect()} == {"undecided"}


def test_registered_check_covers_whole_histories(spark, monkeypatch):
    """A value set hours before its read is no violation, a stale read hours later is one, and an operation may span hours."""
    from tidemark.plans import catalog

    h = 3_600_000_000
    ops = [op(1, "SET", (0, 1), value="1", key="kept"), op(2, "GET", (7 * h, 7 * h + 1), "1", key="kept")]
    ops += [op(3, "SET", (0, 1), value="1", key="stale"), op(4, "SET", (7 * h, 7 * h + 1), value="2", key="stale"), op(5, "GET", (13 * h, 13 * h + 1), None, key="stale")]
    ops += [op(6, "SET", (5 * h, 8 * h), value="1", key="long"), op(7, "GET", (7 * h, 7 * h + 1), "1", key="long")]
    monkeypatch.setattr(catalog, "_history", lambda s, d: frame(spark, ops))
    got = sorted((r.key, r.operations, r.verdict) for r in catalog.QUERIES["history_linearizability"](spark, "").collect())
    assert got == [("kept", 2, "linearizable"), ("long", 2, "linearizable"), ("stale", 3, "not-linearizable")]


def test_search_of_a_long_history():
    """Unanswered mutations that nobody saw and earlier operations cost the search no states."""
    ops = []
    for i in range(0, 4000, 2):
        ops += [op(i, "SET", (10 * i, None if i % 20 == 0 else 10 * i + 5), value=str(i)), op(i + 1, "GET", (10 * i + 6, 10 * i + 8), str(i - 2 if i % 20 == 0 else i) if i else None)]
    assert linearize.search([dict(o) for o in ops]) == "linearizable"
    assert linearize.search([dict(o) for o in ops], max_states=1000) == "undecided"


def test_lost_updates_against_all_triples(spark):
    rng = random.Random(3)
    some = lambda *x: rng.choice(x)
    ops = [op(i, "CAS", (t := rng.randrange(60), t + rng.randrange(9)), value=some("1", "2", "3", None), expected=some("0", "1", None), key=some("x", "y")) for i in range(60)]
    ops += [op(i, "GET", (t := rng.randrange(30, 80), t + 1), some("1", "2", "9", None), key=some("x", "y"), probe=some("final", None)) for i in range(60, 90)]
    want = set()
    for a, b in itertools.combinations(ops[:60], 2):
        if a["key"] == b["key"] and a["expected"] == b["expected"] and a["value"] != b["value"] and (a["complete"] < b["invoke"] or b["complete"] < a["invoke"]):
            end = max(a["complete"], b["complete"])
            want |= {(a["id"], b["id"], r["id"]) for r in ops[60:] if r["probe"] and r["key"] == a["key"] and r["out_value"] is not None and end < r["invoke"] and r["out_value"] in (a["value"], b["value"])}
    got = [tuple(r.operation_ids) for r in history.lost_updates(frame(spark, ops)).collect()]
    assert sorted(got) == sorted(want) and len(want) > 20


def test_lost_updates_meet_only_probes_of_their_value(spark):
    """Pairs times probes of one key would be some 10^11; one probe shows a value that was written."""
    import threading

    from pyspark.sql import functions as F

    none = lambda t: F.lit(None).cast(t)
    i, write = F.col("id"), F.col("id") < 8000
    rows = spark.range(14001).select("id", F.lit("x").alias("key"), F.when(write, "CAS").otherwise("GET").alias("kind"), F.lit("ok").alias("outcome"), F.when(write, "0").alias("expected"), F.when(write, (i % 2).cast("string")).alias("value"), (i * 2).alias("invoke"), (i * 2 + 1).alias("complete"), F.when(~write, "final").alias("probe"), F.when(i == 14000, "1").when(~write, "z").otherwise(none("string")).alias("out_value"))
    got = []
    run = threading.Thread(target=lambda: got.append(history.lost_updates(rows).count()), daemon=True)
    run.start()
    run.join(60)
    if run.is_alive():
        spark.sparkContext.cancelAllJobs()
    assert got == [4000 * 4000]


@pytest.mark.parametrize("block, chunk", [(3, 4), (512, 512)])
def test_lost_updates_by_blocks_and_lists(spark, monkeypatch, block, chunk):
    """Writes and probes of equal instants, writes without an end, values and predecessors that are null."""
    monkeypatch.setattr(history, "BLOCK", block)
    monkeypatch.setattr(history, "CHUNK", chunk)
    rng = random.Random(5)
    some = lambda *x: rng.choice(x)
    ops = [op(i, "CAS", (t := rng.randrange(40), some(t + rng.randrange(9), t + rng.randrange(9), None)), value=some("1", "2", None), expected=some("0", None), key=some("x", "y"), outcome="ok") for i in range(50)]
    ops += [op(i, "GET", (rng.randrange(50), None), some("1", "2", "9", None), key=some("x", "y"), probe="final") for i in range(50, 120)]
    before = lambda a, b: a["complete"] is not None and a["complete"] < b["invoke"]
    want = set()
    for a, b in itertools.combinations(ops[:50], 2):
        if a["key"] == b["key"] and a["expected"] == b["expected"] and a["value"] != b["value"] and (before(a, b) or before(b, a)):
            end = max(t for t in (a["complete"], b["complete"]) if t is not None)
            want |= {(a["id"], b["id"], r["id"]) for r in ops[50:] if r["key"] == a["key"] and r["out_value"] is not None and end < r["invoke"] and r["out_value"] in (a["value"], b["value"])}
    got = [tuple(r.operation_ids) for r in history.lost_updates(frame(spark, ops)).collect()]
    assert sorted(got) == sorted(want) and len(want) > 200


def test_lost_updates_try_no_probe_with_a_pair(spark):
    """4000 writes of one predecessor, all at once but for one, and 4000 probes after them: 1.6 * 10^10 triples to try, 8 * 10^6 to give."""
    import threading

    from pyspark.sql import functions as F

    i, write = F.col("id"), F.col("id") < 4000
    late = i == 3999
    rows = spark.range(8000).select("id", F.lit("x").alias("key"), F.when(write, "CAS").otherwise("GET").alias("kind"), F.lit("ok").alias("outcome"), F.when(write, "0").alias("expected"), F.when(write, (i % 2).cast("string")).alias("value"), F.when(late, 5000).when(write, i).otherwise(i + 2000).cast("bigint").alias("invoke"), F.when(late, 5001).when(write, 4500).otherwise(i + 2001).cast("bigint").alias("complete"), F.when(~write, "final").alias("probe"), F.when(~write, "0").alias("out_value"))
    got = []
    run = threading.Thread(target=lambda: got.append(history.lost_updates(rows).count()), daemon=True)
    run.start()
    run.join(60)
    if run.is_alive():
        spark.sparkContext.cancelAllJobs()
    assert got == [2000 * 4000]
