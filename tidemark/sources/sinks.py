"""Sinks: ledgers, traces, histories and receipts as text; everything else is Spark's own writers."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import CONSISTENCY, HISTORY_VERSIONS, MOST_OPERATIONS, OPERATIONS, OUTCOMES


def trace_json(trace: DataFrame) -> DataFrame:
    """(run_id, json): stable JSON of each run's events in order; a run is a document, so it is built in one task."""
    event = F.struct("seq", "time_ns", "node", "kind", F.lower(F.hex("payload")).alias("payload_hex"))
    return trace.groupBy("run_id").agg(F.to_json(F.struct(F.lit(1).alias("trace_version"), F.first("run_id").alias("seed"), F.array_sort(F.collect_list(event)).alias("events"))).alias("json"))


def trace_bytes(seed: int, config_hash: int, build: str, events) -> bytes:
    """A binary trace of one run; events are rows (seq, time_ns, node, kind, payload) in order."""
    import struct

    from .readers import KINDS

    code = {k: i + 1 for i, k in enumerate(KINDS)}
    name, parts = build.encode(), []
    for e in events:
        node = struct.pack("<B", 0) if e["node"] is None else struct.pack("<BQ", 1, e["node"])
        payload = bytes(e["payload"])
        parts.append(struct.pack("<QQ", e["seq"], e["time_ns"]) + node + struct.pack("<BI", code[e["kind"]], len(payload)) + payload)
    return b"CCTR" + struct.pack("<HQII", 1, seed, config_hash, len(name)) + name + struct.pack("<I", len(parts)) + b"".join(parts)


def ledger_lines(ledger: DataFrame) -> DataFrame:
    """(value) lines of nine tab-separated fields."""
    seed = F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(F.col("seed").cast("bigint")), 16, "0")))
    return ledger.select(F.concat_ws("\t", "build_label", "config_hash", "profile", seed, "verdict", F.col("events").cast("string"), F.col("checker_states").cast("string"), F.col("peak_total_bytes").cast("string"), F.coalesce("artifact_hash", F.lit("-"))).alias("value"))


def external_events(history: DataFrame, processes: DataFrame) -> DataFrame:
    """(at, process, type, json): invoke and completion events for an external checker; an open operation has no completion."""
    rows = history.join(processes, "id")
    value = F.to_json(F.struct("kind", "key", "value", "out_value"))
    invoke = rows.select(F.col("invoke").alias("at"), "process", F.lit("invoke").alias("type"), value.alias("json"))
    kind = F.when(F.col("outcome") == "ok", "ok").when(F.col("outcome") == "timeout", "info").otherwise("fail")
    done = rows.filter("complete IS NOT NULL").select(F.col("complete").alias("at"), "process", kind.alias("type"), value.alias("json"))
    return invoke.unionByName(done)


def flush(versions: DataFrame, path: str) -> None:
    """Sorted runs: versions by key, newest first, in ranges of keys, so that files prune by key."""
    versions.repartitionByRange("user_key").sortWithinPartitions("user_key", F.desc("sequence")).write.parquet(path)


def checkpoint(state: DataFrame, path: str, now=None) -> None:
    """The visible rows of state(key, value, deadline_us), sorted by key."""
    rows = state if now is None else state.filter(F.col("deadline_us").isNull() | (F.col("deadline_us") > now))
    rows.repartitionByRange("key").sortWithinPartitions("key").write.parquet(path)


def metrics_text(metrics: DataFrame) -> DataFrame:
    """(value) lines of metrics(name, labels, value)."""
    return metrics.select(F.concat("name", F.when(F.col("labels") != "", F.concat(F.lit("{"), "labels", F.lit("}"))).otherwise(F.lit("")), F.lit(" "), F.col("value").cast("string")).alias("value"))


def _framed(x: bytes) -> bytes:
    return struct.pack("<I", len(x)) + x


def _optional(x, write) -> bytes:
    return b"\0" if x is None else b"\1" + write(x)


def _operation(o: dict) -> bytes:
    kind = o["kind"]
    head = bytes([OPERATIONS.index(kind) + 1])
    if kind == "SCAN":
        return head + _optional(o.get("prefix"), _framed) + struct.pack("<I", o["scan_limit"])
    if kind == "BATCH":
        return head + struct.pack("<I", len(o["commands"])) + b"".join(map(_operation, o["commands"]))
    middle = _optional(o.get("expected"), _framed) if kind == "CAS" else b""
    return head + _framed(o["key"]) + middle + (_framed(o["value"]) if kind in ("SET", "CAS") else b"")


def _outcome(o: dict) -> bytes:
    kind, outcome = o["kind"], o["outcome"]
    tag = lambda name: bytes([OUTCOMES.index(name) + 1])
    if outcome in ("error", "timeout"):
        return tag(outcome)
    if kind == "GET":
        return tag("value") + _optional(o.get("out_value"), _framed)
    if kind == "INCR":
        return tag("integer") + struct.pack("<q", o["out_int"])
    if kind == "CAS":
        return tag("cas") + bytes([outcome == "ok"])
    if kind == "SCAN":
        pairs = o.get("out_pairs") or []
        return tag("scan") + struct.pack("<I", len(pairs)) + b"".join(_framed(p["key"]) + _framed(p["value"]) for p in pairs)
    if kind == "BATCH":
        return tag("batch") + struct.pack("<I", len(o["replies"])) + b"".join(_outcome({"kind": c["kind"], **r}) for c, r in zip(o["commands"], o["replies"], strict=True))
    return tag("ok")


def history_bytes(operations: list[dict], build: str = "", config_hash: int = 0, initial: dict[bytes, bytes] | None = None) -> bytes:
    """A version-4 history container of one run's operations, which is what a driver can hold: at most a million."""
    u64 = lambda x: struct.pack("<Q", x & 2**64 - 1)
    out = [b"CCHY", struct.pack("<H", HISTORY_VERSIONS[-1]), _framed(build.encode()), u64(config_hash), bytes([any(o.get("complete") is None for o in operations)])]
    out += [struct.pack("<I", len(initial or {})), *(_framed(k) + _framed(v) for k, v in sorted((initial or {}).items()))]
    out.append(struct.pack("<I", len(operations)))
    for o in operations:
        out += [u64(o[f]) for f in ("id", "client", "sequence", "invoke")]
        out += [_optional(o.get("complete"), u64), _operation(o), _outcome(o), _optional(o.get("deadline"), u64)]
        probe = (None, "final", "replica").index(o.get("probe"))
        out += [bytes([CONSISTENCY.index(o.get("consistency") or "strong") + 1, probe])]
        out += [u64(o[f]) for f in ("replica", "committed_index", "state_hash")] if probe == 2 else []
    return b"".join(out)


def write_history(history: DataFrame, path: str, **head) -> None:
    """One run's operations, in their order (ord), as a history container at a local path of the driver."""
    rows = [r.asDict(recursive=True) for r in history.orderBy("ord").limit(MOST_OPERATIONS + 1).collect()]
    if len(rows) > MOST_OPERATIONS:
        raise ValueError("a container holds a million operations at most")
    plain = lambda x: bytes(x) if isinstance(x, bytearray) else {k: plain(y) for k, y in x.items()} if isinstance(x, dict) else [plain(y) for y in x] if isinstance(x, list) else x
    with open(path, "wb") as f:
        f.write(history_bytes([plain(r) for r in rows], **head))
