"""Linearizability of histories: a memoised search per key, or per run where an operation spans keys.

Keys are independent, so each is a group of its own; a SCAN or BATCH makes its run one group. Reads that say they are
stale or diagnostic make other claims and don't count. A search that passes its state limit is undecided, never a pass.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_STATES = 1_000_000
OPEN = 2**63 - 1
#: Operations that see more than one key.
SPANNING = ("SCAN", "BATCH")
_integer = re.compile(r"[+-]?[0-9]+\Z", re.ASCII)


def integer(value: str | None) -> int:
    """The number that INCR starts from: 0 for what isn't a decimal of 64 bits."""
    n = int(value) if value is not None and _integer.match(value) else 0
    return n if -(2**63) <= n < 2**63 else 0


def _command(model: dict, op: dict, deadline) -> tuple | None:
    """What a command does to model {key: (value, deadline)}, in place, and its reply; None where it can't have happened.

    Only GET looks at deadlines, where it was asked (_step); what has expired is otherwise still there.
    """
    kind, key = op["kind"], op.get("key")
    held = model.get(key)
    if kind == "SET":
        model[key] = op["value"], deadline
        return ("ok",)
    if kind == "GET":
        return "value", held[0] if held else None
    if kind == "DEL":
        model.pop(key, None)
        return ("ok",)
    if kind == "INCR":
        n = integer(held[0] if held else None) + 1
        if n >= 2**63:
            return None
        model[key] = str(n), None
        return "int", n
    if kind == "CAS":
        fits = (held[0] if held else None) == op.get("expected")
        if fits:
            model[key] = op["value"], None
        return "cas", fits
    if kind == "SCAN":
        prefix = op.get("prefix")
        found = sorted((k, v) for k, (v, _) in model.items() if not prefix or k.startswith(prefix))
        return "scan", tuple(found[: op["scan_limit"]])
    if kind == "BATCH":
        replies = []
        if not op.get("commands") or any(c["kind"] == "BATCH" for c in op["commands"]):
            return None
        for c in op["commands"]:
            reply = _command(model, c, deadline)
            if reply is None:
                return None
            replies.append(reply)
        return "batch", tuple(replies)
    raise ValueError(f"unknown operation {kind}")


def observed(op: dict) -> tuple:
    """The reply that an answered operation, or a command of a batch, had."""
    kind = op["kind"]
    if kind in ("SET", "DEL"):
        return ("ok",) if op["outcome"] == "ok" else ("other",)
    if kind == "GET":
        return "value", op["out_value"]
    if kind == "INCR":
        return "int", op["out_int"]
    if kind == "CAS":
        return "cas", op["outcome"] == "ok"
    if kind == "SCAN":
        return "scan", tuple((p["key"], p["value"]) for p in op.get("out_pairs") or ())
    commands, replies = op.get("commands") or [], op.get("replies") or []
    if len(commands) != len(replies):
        return ("other",)
    return "batch", tuple(observed({**c, **r}) for c, r in zip(commands, replies, strict=True))


def _sees(held, op: dict, end: int) -> bool:
    """Whether a GET may have seen what it says: what is stored until its deadline, nothing from the deadline on."""
    value, due = held if held else (None, None)
    if op["out_value"] is not None:
        return held is not None and (due is None or op["invoke"] < due) and value == op["out_value"]
    return held is None or (due is not None and end >= due)


def _one_key(held, op: dict, end: int) -> list:
    """States of a single key, None or (value, deadline), that the operation can leave."""
    unknown = op["outcome"] == "timeout"
    if op["kind"] == "GET":
        return [held] if unknown or _sees(held, op, end) else []
    model = {} if held is None else {op["key"]: held}
    reply = _command(model, op, op["deadline"])
    return [model.get(op["key"])] if reply is not None and (unknown or reply == observed(op)) else []


def _all_keys(held: tuple, op: dict, end: int) -> list:
    """The same for the state of all keys, as sorted items."""
    model, unknown = dict(held), op["outcome"] == "timeout"
    if op["kind"] == "GET":
        return [held] if unknown or _sees(model.get(op["key"]), op, end) else []
    reply = _command(model, op, op["deadline"])
    return [tuple(sorted(model.items()))] if reply is not None and (unknown or reply == observed(op)) else []


def search(ops: list[dict], initial: dict | None = None, max_states: int = MAX_STATES) -> str:
    """linearizable, not-linearizable or undecided for operations that start from initial, {key: value}.

    Depth-first over the operations that nothing unplaced precedes, remembering (placed, state). An unanswered mutation
    may also never happen. A read that spans the deadline of the value may see either side. Operations must touch one key
    unless some of them span keys.
    """
    step: Callable = _one_key
    start: object = None
    if any(o["kind"] in SPANNING for o in ops) or len({o["key"] for o in ops}) > 1:
        step, start = _all_keys, tuple(sorted((k, (v, None)) for k, v in (initial or {}).items()))
    elif ops and initial and ops[0]["key"] in initial:
        start = initial[ops[0]["key"]], None
    ops = [o for o in ops if o["outcome"] != "error" and not (o["outcome"] == "timeout" and o["kind"] in ("GET", "SCAN"))]
    ops.sort(key=lambda o: (o["invoke"], o["id"]))
    ends = [OPEN if o["complete"] is None else o["complete"] for o in ops]
    must = [i for i, o in enumerate(ops) if o["outcome"] != "timeout"]
    may = [i for i, o in enumerate(ops) if o["outcome"] == "timeout"]
    must_at, may_at = [ops[i]["invoke"] for i in must], [ops[i]["invoke"] for i in may]
    by_end = sorted(range(len(must)), key=lambda k: ends[must[k]])
    bounded = [k for k, i in enumerate(may) if ends[i] != OPEN]
    # a state: the first p answered operations and those of the bits in ahead, counted from p, and the unanswered of the bits in taken
    stack, seen = [(0, 0, 0, start, 0)], set()
    while stack:
        p, ahead, taken, held, e = stack.pop()
        state = (p, ahead, taken, held)
        if state in seen:
            continue
        if len(seen) >= max_states:
            return "undecided"
        seen.add(state)
        if p == len(must):
            return "linearizable"
        while by_end[e] < p or ahead >> by_end[e] - p & 1:
            e += 1
        first_end = min([ends[must[by_end[e]]], *(ends[may[k]] for k in bounded if not taken >> k & 1)])
        # pushed last is searched first: answered operations before unanswered ones, the earliest first
        choices = [(k, False) for k in range(bisect_right(may_at, first_end)) if not taken >> k & 1]
        choices += [(k, True) for k in range(bisect_right(must_at, first_end) - 1, p - 1, -1) if not ahead >> k - p & 1]
        for k, answered in choices:
            i = must[k] if answered else may[k]
            q, rest, used = p, ahead, taken
            if answered:
                rest |= 1 << k - p
                while rest & 1:
                    q, rest = q + 1, rest >> 1
            else:
                used |= 1 << k
            after = step(held, ops[i], ends[i])
            if not answered and ends[i] != OPEN and held not in after:
                after = [held, *after]  # given up on, it may still never have happened
            for x in after:
                stack.append((q, rest, used, x, e))
    return "not-linearizable"


def minimise(ops: list[dict], initial=None, max_states: int = MAX_STATES, budget: int = 200) -> list[int]:
    """Ids of a part of a failing history that still fails and from which no single operation can go, within a budget of searches."""
    kept, left, size = list(ops), budget, max(1, len(ops) // 2)
    while True:
        shrunk, at = False, 0
        while at < len(kept) and left > 0:
            rest = kept[:at] + kept[at + size :]
            left -= 1
            if rest and search([dict(o) for o in rest], initial, max_states) == "not-linearizable":
                kept, shrunk = rest, True
            else:
                at += size
        if left <= 0 or (size == 1 and not shrunk):
            return [o["id"] for o in kept]
        size = max(1, size // 2)


FIELDS = ("id", "invoke", "complete", "kind", "key", "value", "expected", "outcome", "out_value", "out_int", "deadline")
#: What only histories with operations on several keys have.
MORE = ("prefix", "scan_limit", "out_pairs", "commands", "replies")


def strong(history: DataFrame) -> DataFrame:
    """The operations that linearizability is about: no probes, and no reads that are stale or diagnostic by their own word."""
    rows = history.filter(F.col("probe").isNull())
    return rows.filter(F.coalesce(F.col("consistency") == "strong", F.lit(True))) if "consistency" in history.columns else rows


def check(history: DataFrame, by: list[str] | None = None, max_states: int = MAX_STATES, witness: bool = False, initial: DataFrame | None = None) -> DataFrame:
    """(by, key, operations, verdict[, witness]): each key of each run (by) of a history.

    A run with a SCAN or BATCH is checked as one: its key is null. initial(by, key, value) is what the run starts from;
    without it, nothing. Only strong operations count. With witness, a failing group has the ids of a minimal failing part.
    Optional columns: consistency; prefix, scan_limit and out_pairs of SCAN; commands and replies of BATCH.
    """
    runs = by or []
    by = [*runs, "_group"]
    width = len(by)
    rows = strong(history)
    more = [c for c in MORE if c in history.columns]
    fields = [*FIELDS, *more]
    rows = rows.select(*runs, *[F.col(f).alias(f"_{f}") for f in fields])
    if initial is not None:
        start = initial.select(*runs, F.col("key").alias("_key"), F.col("value").alias("_value"), F.lit("INITIAL").alias("_kind"))
        rows = rows.unionByName(start, allowMissingColumns=True)
    spans = rows.groupBy(*[F.col(r).alias(f"_run_{r}") for r in runs]).agg(F.bool_or(F.col("_kind").isin(*SPANNING)).alias("_spans"))  # a row a run
    same = [F.col(r).eqNullSafe(F.col(f"_run_{r}")) for r in runs] or F.lit(True)
    rows = rows.join(spans, same).select(*runs, F.when(~F.col("_spans"), F.col("_key")).alias("_group"), *[F.col(f"_{f}") for f in fields])

    def solve(held: list[dict]) -> list | None:
        start = {o["key"]: o["value"] for o in held if o["kind"] == "INITIAL"}
        ops = [o for o in held if o["kind"] != "INITIAL"]
        if not ops:
            return None
        verdict = search([dict(o) for o in ops], start, max_states)
        return [len(ops), verdict, *([minimise(ops, start, max_states) if verdict == "not-linearizable" else []] if witness else [])]

    def run(batches):
        """Rows come sorted by group: a group's operations end where the next one's begin."""
        import pyarrow as pa

        held, name, out = [], None, []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[:width] != name:
                    if held:
                        out.append((name, solve(held)))
                    held, name = [], row[:width]
                held.append(dict(zip(fields, row[width:], strict=True)))
            yield pa.RecordBatch.from_pylist([dict(zip(names, [*k, *r], strict=True)) for k, r in out if r], kinds)
            out = []
        last = solve(held) if held else None
        if last:
            yield pa.RecordBatch.from_pylist([dict(zip(names, [*name, *last], strict=True))], kinds)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

    schema = StructType([*(history.schema[b] for b in runs), StructField("key", history.schema["key"].dataType)]).add("operations", LongType()).add("verdict", StringType())
    schema = schema.add("witness", ArrayType(LongType())) if witness else schema
    names, kinds = schema.names, to_arrow_schema(schema)
    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def check_window(history: DataFrame, initial: DataFrame | None, by: list[str] | None = None, **options) -> DataFrame:
    """check() of a part of a longer history, which must say what it starts from: an empty initial(by, key, value) is an answer too."""
    if initial is None:
        raise ValueError("a window needs its initial state")
    return check(history, by, initial=initial, **options)


def cross_check(violations: DataFrame, eligible: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Session violations of eligible clients in a run whose keys are all linearizable: the two checkers contradict."""
    bad = verdicts.filter("verdict <> 'linearizable'").limit(1)
    return violations.join(eligible.filter("eligible").select("client"), "client", "left_semi").join(bad.select(F.lit(1).alias("_b")), F.lit(True), "left_anti")
