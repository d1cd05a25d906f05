"""Replay of command logs: closed forms where a log allows them, an ordered fold per key group where it doesn't.

Log columns of the general fold: log_index, leader_time_ns, kind, key, value, expected, delta, ttl_ns, at_ns, condition,
scan_start, scan_end, scan_limit, batch (array of the same fields). Presence and deadline of a key are separate: INCR and
APPEND keep a past deadline, PERSIST takes one off what has expired but isn't swept yet.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import shared_folder

SECOND = 1_000_000_000
MOST_BATCH, MOST_SCAN = 256, 4096
_number = re.compile(rb"^[+-]?[0-9]+$")


class Fault(Exception):
    """An error reply."""


@dataclass
class Machine:
    """The key/value state machine: apply() commands in log order."""

    values: dict[bytes, bytes] = field(default_factory=dict)
    deadlines: dict[bytes, int] = field(default_factory=dict)
    now: int = 0
    undo: dict[bytes, tuple[bytes | None, int | None]] | None = None

    def get(self, key: bytes) -> bytes | None:
        due = self.deadlines.get(key)
        return self.values.get(key) if due is None or due > self.now else None

    def _note(self, key: bytes) -> None:
        """Inside a batch: remember what a key was before its first change."""
        if self.undo is not None and key not in self.undo:
            self.undo[key] = self.values.get(key), self.deadlines.get(key)

    def _put(self, key: bytes, value: bytes | None) -> None:
        self._note(key)
        if value is None:
            self.values.pop(key, None)
        else:
            self.values[key] = value

    def _due(self, key: bytes, at: int | None) -> None:
        self._note(key)
        if at is None:
            self.deadlines.pop(key, None)
        else:
            self.deadlines[key] = at

    def apply(self, command: dict) -> object:
        """The reply; a Fault's text for an error. The clock never goes back."""
        self.now = max(self.now, command.get("leader_time_ns") or 0)
        try:
            return self.batch(command["batch"] or []) if command["kind"] == "BATCH" else self.one(command)
        except Fault as e:
            return f"error:{e}"

    def batch(self, commands: list[dict]) -> object:
        """All replies, or none of the changes and the place of the first error; a failed comparison is no error."""
        if not commands or len(commands) > MOST_BATCH or any(c["kind"] == "BATCH" for c in commands):
            raise Fault("invalid-input")
        replies: list[object] = []
        self.undo = {}
        try:
            for i, c in enumerate(commands):
                try:
                    replies.append(self.one(c))
                except Fault as e:
                    before, self.undo = self.undo, None
                    for key, (value, due) in before.items():
                        self._put(key, value)
                        self._due(key, due)
                    return f"batch-error:{i}:{e}"
        finally:
            self.undo = None
        return replies

    def one(self, c: dict) -> object:
        kind, key = c["kind"], c.get("key")
        live = self.get(key) if key is not None else None
        if kind == "SET":
            condition = c.get("condition")
            if (condition == "NX" and live is not None) or (condition == "XX" and live is None):
                return False
            self._put(key, c["value"])
            self._due(key, None if c.get("ttl_ns") is None else self.now + c["ttl_ns"])
            return "OK" if condition is None else True
        if kind == "DEL":
            self._put(key, None)
            self._due(key, None)
            return 1
        if kind == "CAS":
            if live != c.get("expected"):
                return False
            self._put(key, c.get("value"))
            self._due(key, None)
            return True
        if kind == "INCR":
            old = b"0" if live is None else live
            if not _number.match(old) or not -(2**63) <= int(old) + c["delta"] < 2**63 or not -(2**63) <= int(old) < 2**63:
                raise Fault("not-numeric")
            self._put(key, str(int(old) + c["delta"]).encode())
            return int(old) + c["delta"]
        if kind == "APPEND":
            self._put(key, (live or b"") + c["value"])
            return len(self.values[key])
        if kind in ("GETSET", "GETDEL"):
            if kind == "GETSET" or live is not None:
                self._put(key, c["value"] if kind == "GETSET" else None)
                self._due(key, None)
            return live
        if kind in ("EXPIRE", "EXPIREAT"):
            if live is None:
                return 0
            self._due(key, self.now + c["ttl_ns"] if kind == "EXPIRE" else c["at_ns"])
            return 1
        if kind == "PERSIST":
            if key not in self.values or key not in self.deadlines:
                return 0
            self._due(key, None)
            return 1
        if kind == "TTL":
            due = self.deadlines.get(key)
            return -2 if live is None else -1 if due is None else (due - self.now) // SECOND
        if kind == "GET":
            return live
        if kind == "EXISTS":
            return int(live is not None)
        if kind == "PURGE":
            due = sorted((d, k) for k, d in self.deadlines.items() if d <= c["at_ns"])[: c["scan_limit"]]
            for _, k in due:
                self._put(k, None)
                self._due(k, None)
            return len(due)
        if kind == "SCAN":
            inside = sorted(k for k in self.values if (c.get("scan_start") or b"") <= k and (c.get("scan_end") is None or k < c["scan_end"]))
            return [(k, self.values[k]) for k in inside[: min(c["scan_limit"], MOST_SCAN)] if self.get(k) is not None]
        raise Fault("invalid-input")


def clamp(log: DataFrame) -> DataFrame:
    """log with leader_time_ns as the running maximum: late stamps are clamped, never dropped."""
    from .clock import running_max

    return running_max(log, "log_index", "leader_time_ns", "_now").drop("leader_time_ns").withColumnRenamed("_now", "leader_time_ns")


def settled(df: DataFrame) -> DataFrame:
    """df with its lineage cut at files in the shared folder."""
    spark = df.sparkSession
    if spark._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def key_groups(log: DataFrame) -> DataFrame:
    """(key, root): keys that batches link are folded together; other keys are groups of their own."""
    links = log.filter("kind = 'BATCH'").select(F.col("batch.key").alias("ks")).filter("size(ks) > 1").select(F.array_min("ks").alias("a"), F.explode("ks").alias("b")).filter("a <> b")
    keys = log.select(F.explode(F.concat(F.array("key"), F.coalesce("batch.key", F.array().cast("array<binary>")))).alias("key")).filter("key IS NOT NULL").distinct()
    roots = keys.withColumn("root", F.col("key"))
    both = links.union(links.select("b", "a")).toDF("a", "b")
    while True:  # a round shortens every chain of links; batches hold at most 256 keys
        near = both.join(roots.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.min("root").alias("near"))
        new = roots.join(near, "key", "left").select("key", F.least("root", F.coalesce("near", "root")).alias("root"), F.col("root").alias("old"))
        new = settled(new)
        changed = new.filter("root <> old").limit(1).count()
        roots = new.select("key", "root")
        if not changed:
            return roots


_FIELDS = ("kind", "key", "value", "expected", "delta", "ttl_ns", "at_ns", "condition", "scan_start", "scan_end", "scan_limit")
#: Commands that see every key.
WHOLE = ("SCAN", "PURGE")


def show(reply: object) -> str:
    if reply is None:
        return "nil"
    if isinstance(reply, bool):
        return str(reply).lower()
    if isinstance(reply, bytes):
        return '"' + reply.decode("utf-8", "replace") + '"'
    if isinstance(reply, (list, tuple)):
        return "[" + ", ".join(map(show, reply)) + "]"
    return str(reply)


def sees_all_keys(log: DataFrame) -> bool:
    """Whether some command of the log, in a batch or alone, is one that sees every key."""
    inside = F.coalesce(F.arrays_overlap(F.col("batch.kind"), F.array(*[F.lit(k) for k in WHOLE])), F.lit(False))
    return bool(log.filter(F.col("kind").isin(*WHOLE) | inside).limit(1).count())


def replay(log: DataFrame, whole: bool | None = None) -> DataFrame:
    """(log_index, reply): each command's reply, folded in order by groups of linked keys; whole folds the log as one.

    SCAN and PURGE see every key, so a log that has one is folded as one unless whole says otherwise. A log of a single
    group is sequential by nature. Numbers reach the fold as integers: deadlines in nanoseconds don't fit a double.
    """
    import pyarrow as pa

    if whole is None:
        whole = sees_all_keys(log)

    def fold(rows: pa.Table) -> pa.Table:
        machine, index, replies = Machine(), [], []
        for part in rows.sort_by("log_index").to_batches(max_chunksize=4096):
            for command in part.to_pylist():
                index.append(command["log_index"])
                replies.append(show(machine.apply(command)))
        return pa.table({"log_index": pa.array(index, pa.int64()), "reply": pa.array(replies, pa.string())})

    timed = clamp(log)
    if whole:
        grouped = timed.withColumn("root", F.lit(b""))
    else:
        roots = key_groups(log)
        own = timed.withColumn("_key", F.coalesce("key", F.expr("batch[0].key")))
        grouped = own.join(roots.withColumnRenamed("key", "_key"), "_key", "left").drop("_key")
    fields = [F.col(c) for c in ("root", "log_index", "leader_time_ns", *_FIELDS, "batch")]
    return grouped.select(*fields).groupBy("root").applyInArrow(fold, "log_index bigint, reply string")


# closed forms over simple logs (log_index, t, key, op, value, k)


def visible_state(log: DataFrame, hour: int, as_of: int | None = None) -> DataFrame:
    """(key, log_index, value, deadline) visible at as_of (the clock's end): the last SET or DEL of a key decides.

    The clock at a write is the largest time up to it; a SET lives k hours from then. Writes combine before the shuffle.
    """
    from .clock import running_max

    timed = running_max(log.select("log_index", "t_us", "key", "op", "value", "k"), "log_index", "t_us", "now_us")
    last = timed.filter("op IN ('SET', 'DEL')").groupBy("key").agg(F.max_by(F.struct("log_index", "op", "value", "k", "now_us"), "log_index").alias("w"))
    state = last.filter("w.op = 'SET'").select("key", "w.log_index", "w.value", (F.col("w.now_us") + F.col("w.k") * hour).alias("deadline_us"))
    if as_of is not None:
        return state.filter(F.col("deadline_us") > as_of)
    end = log.agg(F.max("t_us").alias("_end"))
    return state.join(F.broadcast(end), F.col("deadline_us") > F.col("_end")).drop("_end")  # one row on the right


def counters(log: DataFrame) -> DataFrame:
    """(key, value) after SET, INCR and DEL: increments since the last reset on top of what it left; gone keys are missing."""
    resets = log.filter("op IN ('SET', 'DEL')").groupBy("key").agg(F.max_by(F.struct("log_index", "op", "value"), "log_index").alias("r"))
    incr = log.filter("op = 'INCR'").select("key", "log_index")
    since = incr.join(resets.select("key", F.col("r.log_index").alias("_at")), "key", "left").filter("_at IS NULL OR log_index > _at").groupBy("key").agg(F.count("*").alias("n"))
    both = resets.join(since, "key", "full")
    base = F.when(F.col("r.op") == "SET", F.col("r.value")).otherwise(0)
    return both.filter("r.op = 'SET' OR n IS NOT NULL").select("key", (F.coalesce(base, F.lit(0)) + F.coalesce("n", F.lit(0))).cast("bigint").alias("value"))


def appended(log: DataFrame) -> DataFrame:
    """(key, bytes, parts): lengths of values built by appending since the last DEL, SET starting anew (INCR rows append)."""
    last = log.filter("op IN ('SET', 'DEL')").groupBy("key").agg(F.max_by(F.struct("log_index", "op", F.length(F.col("value").cast("string")).alias("len")), "log_index").alias("r"))
    parts = log.filter("op = 'INCR'").select("key", "log_index", F.length(F.col("value").cast("string")).alias("len"))
    since = parts.join(last.select("key", F.col("r.log_index").alias("_at")), "key", "left").filter("_at IS NULL OR log_index > _at").groupBy("key").agg(F.sum("len").alias("len"), F.count("*").alias("parts"))
    both = last.join(since, "key", "full").filter("r.op = 'SET' OR len IS NOT NULL")
    return both.select("key", (F.coalesce(F.when(F.col("r.op") == "SET", F.col("r.len")), F.lit(0)) + F.coalesce("len", F.lit(0))).cast("bigint").alias("bytes"), F.coalesce("parts", F.lit(0)).cast("bigint").alias("parts"))


def old_values(log: DataFrame) -> DataFrame:
    """(log_index, key, old): what each SET replaces, as GETSET replies; DEL leaves nothing."""
    w = Window.partitionBy("key").orderBy("log_index")
    rows = log.filter("op IN ('SET', 'DEL')")
    old = F.when(F.lag("op").over(w) == "SET", F.lag("value").over(w))
    return rows.withColumn("old", old).filter("op = 'SET'").select("log_index", "key", "old")


def state_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, change, old, new) between two states(key, value)."""
    b, a = before.select("key", F.col("value").alias("old")), after.select("key", F.col("value").alias("new"))
    change = F.when(F.col("old").isNull(), "put").when(F.col("new").isNull(), "delete").otherwise("replace")
    return b.join(a, "key", "full").filter("NOT (old <=> new)").select("key", change.alias("change"), "old", "new")


def as_of(log: DataFrame, points: DataFrame) -> DataFrame:
    """points(key, at) with the last write at or before each: union and a running last value."""
    w = Window.partitionBy("key").orderBy("at", "_o").rowsBetween(Window.unboundedPreceding, 0)
    writes = log.filter("op IN ('SET', 'DEL')").select("key", F.col("log_index").alias("at"), F.lit(0).alias("_o"), F.struct("log_index", "op", "value").alias("_w"))
    asked = points.select("key", "at", F.lit(1).alias("_o"), F.lit(None).cast(writes.schema["_w"].dataType).alias("_w"))
    rows = writes.unionByName(asked).withColumn("w", F.last("_w", ignorenulls=True).over(w)).filter("_o = 1")
    return rows.select("key", "at", F.when(F.col("w.op") == "SET", F.col("w.value")).alias("value"))


def due(state: DataFrame, up_to, most: int) -> DataFrame:
    """The most oldest deadlines up to a time, by (deadline, key)."""
    return state.filter(F.col("deadline_us") <= up_to).orderBy("deadline_us", "key").limit(most)


def scan_range(state: DataFrame, start: str, limit: int, now=None) -> DataFrame:
    """Rows from start on, limited before expired ones are dropped, as the wire command has it."""
    rows = state.filter(F.col("key") >= start).orderBy("key").limit(min(limit, MOST_SCAN))
    return rows if now is None else rows.filter(F.col("deadline_us") > now)


def scan_prefix(state: DataFrame, prefix: str, limit: int | None = None, after: str | None = None) -> DataFrame:
    """Rows with a prefix, in order; after goes on from the last key of the page before."""
    from ..functions.scalars import has_prefix

    rows = state.filter(has_prefix(F.col("key"), prefix))
    rows = rows if after is None else rows.filter(F.col("key") > after)
    rows = rows.orderBy("key")
    return rows if limit is None else rows.limit(limit)
