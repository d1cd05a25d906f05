"""Stateful operators over streams of log rows: de-duplication, key replay, expiry by event time, with the batch folds' rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sessions import GRACE_NS, IDLE_NS, Session


def _session(state: GroupState) -> Session:
    fields = state.get if state.exists else (None, None, None, 0, None)
    return Session(*[None if f is None or (isinstance(f, float) and pd.isna(f)) else f for f in fields])


def _decide(key, batches, state: GroupState):
    session = _session(state)
    # the rows of a group may come in several pieces, which are in no order
    rows = pd.concat(list(batches)).sort_values("log_index")
    out = [session.request(int(s), c, int(t), lambda r=r: r) for s, c, t, r in zip(rows["sequence"], rows["command"], rows["now_ns"], rows["reply"], strict=True)]
    state.update((session.sequence, session.command, session.reply, session.active, session.blocked_until))
    yield pd.DataFrame({"log_index": rows["log_index"].to_numpy(), "decision": [d for d, _ in out], "reply": [r for _, r in out]})


def decide(requests: DataFrame) -> DataFrame:
    """(log_index, decision, reply) of a stream of requests; late rows are decided when they come, not dropped.

    A repeated request gets the reply of the first one, which the state keeps.
    """
    rows = requests if "reply" in requests.columns else requests.withColumn("reply", F.lit(""))
    fields = rows.select("log_index", "namespace", "client", "sequence", "command", "now_ns", F.coalesce("reply", F.lit("")).alias("reply"))
    state = "sequence bigint, command string, reply string, active bigint, blocked_until bigint"
    return fields.groupBy("namespace", "client").applyInPandasWithState(_decide, "log_index bigint, decision string, reply string", state, "append", GroupStateTimeout.NoTimeout)


def _counters(key, batches, state: GroupState):
    value, present, at = state.get if state.exists else (0, False, -1)
    rows = pd.concat(list(batches)).sort_values("log_index")
    for index, op, v in rows[["log_index", "op", "value"]].itertuples(index=False):
        at = max(at, int(index))
        if op == "SET":
            value, present = int(v), True
        elif op == "DEL":
            value, present = 0, False
        elif op == "INCR":
            value, present = value + 1, True
    state.update((value, present, at))
    yield pd.DataFrame({"key": [key[0]], "log_index": [at], "value": [value if present else None]}).astype({"value": "Int64"})


def counters(log: DataFrame) -> DataFrame:
    """(key, log_index, value): a key's value after each batch that has commands for it; the log arrives in order."""
    return log.groupBy("key").applyInPandasWithState(_counters, "key string, log_index bigint, value bigint", "value bigint, present boolean, at bigint", "update", GroupStateTimeout.NoTimeout)


def _expiring(key, batches, state: GroupState):
    index, due = state.get if state.exists else (-1, None)
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame({"key": [key[0]], "log_index": [index], "deadline_us": [due]})
        return
    for n, op, d in pd.concat(list(batches)).sort_values("log_index")[["log_index", "op", "deadline_us"]].itertuples(index=False):
        if int(n) > index:  # the last write decides, whatever comes after it
            index, due = int(n), int(d) if op == "SET" and not pd.isna(d) else None
    state.update((index, due))
    if due is not None:
        # timers fire once the watermark is past them; one that is past already fires with the next batch
        state.setTimeoutTimestamp(max(due // 1000, state.getCurrentWatermarkMs() + 1))


def expirations(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """(key, log_index, deadline_us) of a stream log(log_index, key, op, deadline_us, at): deadlines that pass.

    A SET with a deadline sets the key's timer, a later SET or DEL takes its place; the timer fires when the watermark of
    the log's own time (at, a timestamp) is past the deadline, as expiry by the log's clock does. Rows later than the
    watermark are dropped before they get here.
    """
    writes = log.withWatermark("at", late).filter("op IN ('SET', 'DEL')").select("log_index", "key", "op", F.col("deadline_us").cast("bigint"), "at")
    return writes.groupBy("key").applyInPandasWithState(_expiring, "key string, log_index bigint, deadline_us bigint", "log_index bigint, due bigint", "append", GroupStateTimeout.EventTimeTimeout)


def _idle(key, batches, state: GroupState):
    sequence, active, grace = state.get if state.exists else (0, 0, None)
    if state.hasTimedOut:
        if grace is None:
            grace = active + IDLE_NS + GRACE_NS
            state.update((sequence, active, grace))
            state.setTimeoutTimestamp(max(grace // 10**6, state.getCurrentWatermarkMs() + 1))
            event, when = "idle", active + IDLE_NS
        else:
            state.remove()
            event, when = "forgotten", grace
        yield pd.DataFrame({"namespace": [key[0]], "client": [key[1]], "event": [event], "at_ns": [when]})
        return
    rows = pd.concat(list(batches))
    rows = rows[rows["sequence"] > 0]
    if grace is None and len(rows):
        state.update((int(max(sequence, rows["sequence"].max())), int(max(active, rows["now_ns"].max())), None))
        state.setTimeoutTimestamp(max((int(max(active, rows["now_ns"].max())) + IDLE_NS) // 10**6, state.getCurrentWatermarkMs() + 1))
    elif grace is not None:  # a client in its grace is refused: nothing of it is remembered
        state.setTimeoutTimestamp(max(grace // 10**6, state.getCurrentWatermarkMs() + 1))


def idle_sessions(requests: DataFrame, late: str = "1 minute") -> DataFrame:
    """(namespace, client, event, at_ns) of a stream of requests with their time (at): sessions that end by timers.

    idle: half an hour after a client's last request, by the watermark; from then on its grace, in which its requests are
    refused, until forgotten.
    """
    rows = requests.withWatermark("at", late).select("namespace", "client", "sequence", "now_ns", "at")
    return rows.groupBy("namespace", "client").applyInPandasWithState(_idle, "namespace int, client bigint, event string, at_ns bigint", "sequence bigint, active bigint, grace bigint", "append", GroupStateTimeout.EventTimeTimeout)
