"""Request de-duplication with cached replies, idle expiry and a grace tombstone, per (namespace, client)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IDLE_NS, GRACE_NS = 30 * 60 * 10**9, 5 * 60 * 10**9


@dataclass
class Session:
    """One client's state: request() says what becomes of a request and what its reply is."""

    sequence: int | None = None
    command: str | None = None
    reply: str | None = None
    active: int = 0
    blocked_until: int | None = None
    #: Bytes that the client's command and reply may take together; None for no limit.
    most_bytes: int | None = None

    def request(self, sequence: int, command: str, now: int, apply: Callable[[], str]) -> tuple[str, str | None]:
        """(decision, reply). Sequence 0 isn't remembered and always applied; apply makes the reply of what is.

        A request that meets its own sequence again refreshes the session, also where its command is another one.
        """
        if sequence == 0:
            return "apply", apply()
        if self.blocked_until is not None:
            if self.blocked_until > now:
                return "session-expired", None
            self.blocked_until = None
        if self.sequence is not None and now - self.active > IDLE_NS:
            self.blocked_until = now + GRACE_NS
            self.sequence = self.command = self.reply = None
            return "session-expired", None
        if self.sequence is not None and sequence < self.sequence:
            return "stale-seq", None
        if self.sequence == sequence:
            self.active = now
            return ("cached", self.reply) if self.command == command else ("sequence-conflict", None)
        reply = apply()
        if self.most_bytes is not None and len(command.encode()) + len(reply.encode()) > self.most_bytes:
            return "busy", None
        self.sequence, self.command, self.reply, self.active = sequence, command, reply, now
        return "apply", reply

    def admit(self, sequence: int, command: str, now: int) -> str:
        return self.request(sequence, command, now, lambda: "")[0]


def decide(requests: DataFrame, most_bytes: int | None = None) -> DataFrame:
    """(log_index, decision, reply) of requests(log_index, namespace, client, sequence, command, now_ns[, reply]).

    A fold by client in log order. decision: apply, cached, stale-seq, sequence-conflict, session-expired or busy. reply is
    what the command replied when it was applied, where the column is there: repeated requests get the reply of the first.
    """
    import pyarrow as pa

    rows = requests if "reply" in requests.columns else requests.withColumn("reply", F.lit(""))
    fields = ["log_index", "namespace", "client", "sequence", "command", "now_ns", "reply"]

    def fold(group: pa.Table) -> pa.Table:
        session, out = Session(most_bytes=most_bytes), []
        for r in group.sort_by("log_index").to_pylist():
            out.append((r["log_index"], *session.request(r["sequence"], r["command"], r["now_ns"], lambda r=r: r["reply"] or "")))
        index, decision, reply = zip(*out, strict=True)
        return pa.table({"log_index": pa.array(index, pa.int64()), "decision": pa.array(decision, pa.string()), "reply": pa.array(reply, pa.string())})

    return rows.select(*fields).groupBy("namespace", "client").applyInArrow(fold, "log_index bigint, decision string, reply string")


def for_fresh_restore(sessions: DataFrame) -> DataFrame:
    """Sessions that go into a new cluster: those of users (namespace 1), not of administrators."""
    return sessions.filter("namespace = 1")


def _due_at():
    return F.when(F.col("tombstone"), F.col("expires_at")).otherwise(F.col("last_active") + IDLE_NS)


def expire(sessions: DataFrame, now_ns: int, most: int) -> DataFrame:
    """The most oldest of sessions that have been idle long enough and of tombstones whose grace is over.

    Due is what has its time at or before now; by time, then (namespace, client), then tombstones last.
    """
    return sessions.filter(_due_at() <= now_ns).orderBy(_due_at(), "namespace", "client", "tombstone").limit(most)


def after_expiry(sessions: DataFrame, now_ns: int, most: int) -> DataFrame:
    """sessions once expire() has taken its rows: an expired session whose grace isn't over leaves a tombstone."""
    key = ["namespace", "client", "tombstone"]
    gone = expire(sessions, now_ns, most).select(*key)
    left = sessions.join(gone, key, "left_anti")
    grace = F.col("last_active") + IDLE_NS + GRACE_NS
    made = sessions.join(gone, key, "left_semi").filter(~F.col("tombstone") & (grace > now_ns))
    return left.unionByName(made.withColumn("expires_at", grace).withColumn("tombstone", F.lit(True)))
