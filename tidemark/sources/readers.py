"""Readers: text formats with built-in functions, binary ones decoded file by file in Arrow batches.

A reader fails on what it doesn't know; only a torn last record is dropped, where the format allows one.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import crc32c_many

MOST_DEPTH, MOST_ITEMS, MOST_FRAME = 64, 1024, 4 << 20
MOST_RECORD = 4 << 20


def crc(data: bytes) -> int:
    import pandas as pd

    return int(crc32c_many(pd.Series([data]))[0])


# ---- RESP2


def resp(data: bytes, at: int = 0, depth: int = 0):
    """(value, end) of one frame, or None where it isn't complete; ValueError for a malformed one.

    Simple strings are ("simple", text), errors ("error", text); integers, bytes, None and lists stand for themselves.
    """
    if depth > MOST_DEPTH:
        raise ValueError("too deep")
    stop = data.find(b"\r\n", at)
    if stop < 0:
        if len(data) - at > MOST_FRAME:
            raise ValueError("too long")
        return None
    tag, line, after = data[at : at + 1], data[at + 1 : stop], stop + 2
    if tag == b"+":
        return ("simple", line.decode("utf-8", "replace")), after
    if tag == b"-":
        return ("error", line.decode("utf-8", "replace")), after
    if tag not in (b":", b"$", b"*") or not line.lstrip(b"-").isdigit():
        raise ValueError("malformed frame")
    n = int(line)
    if tag == b":":
        return n, after
    if n == -1:
        return None, after
    if n < 0 or n > (MOST_FRAME if tag == b"$" else MOST_ITEMS):
        raise ValueError("bad length")
    if tag == b"$":
        if len(data) < after + n + 2:
            return None
        if data[after + n : after + n + 2] != b"\r\n":
            raise ValueError("malformed bulk")
        return data[after : after + n], after + n + 2
    items = []
    for _ in range(n):
        got = resp(data, after, depth + 1)
        if got is None:
            return None
        items.append(got[0])
        after = got[1]
    return items, after


def resp_commands(data: bytes) -> Iterator[list[bytes]]:
    """The pipelined commands of a byte stream; an incomplete last one is left."""
    at = 0
    while at < len(data):
        got = resp(data, at)
        if got is None:
            return
        if not isinstance(got[0], list) or not all(isinstance(x, bytes) for x in got[0]):
            raise ValueError("a command is an array of bulk strings")
        yield got[0]
        at = got[1]


def _decoded(files: DataFrame, decode: Callable[[bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows (path, *schema) of binaryFile rows through a decoder of one file; schema has no types with commas."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = list(decode(bytes(content)))
                for a in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[a : a + 10_000], columns=names).assign(path=path)[["path", *names]]

    return files.select("path", "content").mapInPandas(run, f"path string, {schema}")


def binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def read_resp(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, args) of captured command streams."""
    return _decoded(binary(spark, path), lambda d: ((i, c) for i, c in enumerate(resp_commands(d))), "ord bigint, args array<binary>")


# fixed values of the wire protocol: verbs of one key, and verbs without one
KEYED = ("GET", "SET", "SETNX", "DEL", "INCR", "DECR", "INCRBY", "APPEND", "GETSET", "GETDEL", "EXPIRE", "EXPIREAT", "PERSIST", "TTL", "EXISTS", "CAS")
KEYLESS = ("PING", "ECHO", "INFO", "MULTI", "EXEC", "DISCARD", "SCAN")


def parse_commands(frames: DataFrame) -> DataFrame:
    """frames(args) with verb, key and valid: verbs in any case, the arguments that a verb asks for."""
    verb = F.upper(F.decode(F.get("args", F.lit(0)), "UTF-8"))
    out = frames.withColumn("verb", verb)
    least = F.when(F.col("verb").isin("SET", "SETNX", "INCRBY", "APPEND", "GETSET", "EXPIRE", "EXPIREAT"), 3).when(F.col("verb") == "CAS", 4).when(F.col("verb").isin(*KEYED), 2).otherwise(1)
    known = F.col("verb").isin(*KEYED, *KEYLESS)
    key = F.when(F.col("verb").isin(*KEYED), F.get("args", F.lit(1)))
    return out.withColumn("key", key).withColumn("valid", F.coalesce(known & (F.size("args") >= least) & (F.octet_length(F.coalesce(key, F.lit(b"x"))) > 0), F.lit(False)))


# ---- text formats


def read_history_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(ord, legacy_id, kind, key, observed, invoke_ns, complete_ns) of captured histories, a file a history.

    ord is a line's place among the operations of its file, as completion times repeat. Empty lines and those from # on are
    no operations; a line without five fields or with digits that aren't hex or decimal fails.
    """
    whole = spark.read.text(path, wholetext=True)
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: (x != "") & ~x.startswith("#"))
    f = F.split("line", "\t")
    rows = whole.select(F.posexplode(lines).alias("ord", "line")).withColumn("f", f)
    hex_ok = lambda c: c.rlike("^([0-9a-fA-F]{2})*$")
    good = (F.size("f") == 5) & hex_ok(F.get("f", F.lit(1))) & ((F.get("f", F.lit(2)) == "-") | hex_ok(F.get("f", F.lit(2)))) & F.get("f", F.lit(3)).rlike("^[0-9]+$") & F.get("f", F.lit(4)).rlike("^[0-9]+$")
    f = F.when(good, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("malformed history line "), F.col("ord").cast("string"))).cast("array<string>"))
    rows = rows.withColumn("f", f)
    observed = F.when(F.col("f")[2] != "-", F.unhex(F.col("f")[2]))
    return rows.select(F.col("ord").cast("bigint").alias("ord"), F.col("f")[4].cast("bigint").alias("legacy_id"), F.col("f")[0].alias("kind"), F.unhex(F.col("f")[1]).alias("key"), observed.alias("observed"), F.col("f")[3].cast("bigint").alias("invoke_ns"), F.col("f")[4].cast("bigint").alias("complete_ns"))


# fixed values of the history container: operations, outcomes and consistency modes by code, from 1 on
OPERATIONS = ("SET", "GET", "DEL", "INCR", "CAS", "SCAN", "BATCH")
OUTCOMES = ("ok", "value", "integer", "cas", "scan", "error", "timeout", "batch")
CONSISTENCY = ("strong", "stale", "diagnostic")
HISTORY_VERSIONS = (2, 3, 4)
MOST_OPERATIONS, MOST_PARTS = 1_000_000, 4096

PAIRS = "array<struct<key: binary, value: binary>>"
COMMANDS = "array<struct<kind: string, key: binary, value: binary, expected: binary, prefix: binary, scan_limit: bigint>>"
REPLIES = f"array<struct<outcome: string, out_value: binary, out_int: bigint, out_pairs: {PAIRS}>>"
HISTORY_SCHEMA = (
    "run_id string, config_hash string, ord bigint, id bigint, client bigint, sequence bigint, invoke bigint, complete bigint, kind string, key binary, value binary, "
    f"expected binary, prefix binary, scan_limit bigint, commands {COMMANDS}, outcome string, out_value binary, out_int bigint, out_pairs {PAIRS}, replies {REPLIES}, "
    "deadline bigint, consistency string, probe string, replica bigint, committed_index bigint, state_hash bigint"
)


class Cursor:
    """Little-endian fields one after another; a field that isn't there is an error."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, code: str) -> int:
        n = struct.calcsize(code)
        if self.at + n > len(self.data):
            raise ValueError("cut off")
        self.at += n
        return struct.unpack_from("<" + code, self.data, self.at - n)[0]

    def bytes(self) -> bytes:
        n = self.take("I")
        if n > MOST_RECORD or self.at + n > len(self.data):
            raise ValueError("bad length")
        self.at += n
        return self.data[self.at - n : self.at]

    def choice(self, of: tuple, what: str, first: int = 1):
        n = self.take("B") - first
        if not 0 <= n < len(of):
            raise ValueError(f"unknown {what}")
        return of[n]

    def maybe(self, read: Callable):
        return read() if self.choice((False, True), "flag", 0) else None

    def count(self, most: int) -> int:
        n = self.take("I")
        if n > most or n > len(self.data) - self.at:
            raise ValueError("bad count")
        return n


def _operation(c: Cursor, batches: bool) -> dict:
    kind = c.choice(OPERATIONS, "operation")
    if kind == "SCAN":
        return {"kind": kind, "prefix": c.maybe(c.bytes), "scan_limit": c.take("I")}
    if kind == "BATCH":
        if not batches:
            raise ValueError("unknown operation")
        return {"kind": kind, "commands": [_operation(c, False) for _ in range(c.count(MOST_PARTS))]}
    out = {"kind": kind, "key": c.bytes()}
    if kind == "CAS":
        out["expected"] = c.maybe(c.bytes)
    return out | ({"value": c.bytes()} if kind in ("SET", "CAS") else {})


def _outcome(c: Cursor, nested: bool = False) -> dict:
    outcome = c.choice(OUTCOMES, "outcome")
    if outcome == "value":
        return {"outcome": "ok", "out_value": c.maybe(c.bytes)}
    if outcome == "integer":
        return {"outcome": "ok", "out_int": c.take("q")}
    if outcome == "cas":
        return {"outcome": c.choice(("fail", "ok"), "boolean", 0)}
    if outcome == "scan":
        return {"outcome": "ok", "out_pairs": [{"key": c.bytes(), "value": c.bytes()} for _ in range(c.count(MOST_PARTS))]}
    if outcome == "batch":
        if nested:
            raise ValueError("batch in a batch")
        return {"outcome": "ok", "replies": [_outcome(c, True) for _ in range(c.count(MOST_PARTS))]}
    return {"outcome": outcome}


def history_operations(data: bytes) -> tuple[dict, list[dict]]:
    """(head, operations) of a history container of version 2 to 4; head holds build, config_hash and initial pairs.

    An unknown version, tag or flag, a repeated id or key and an open operation in a container that says it has none fail.
    """
    if data[:4] != b"CCHY":
        raise ValueError("not a history")
    c = Cursor(data)
    c.at = 4
    version = c.take("H")
    if version not in HISTORY_VERSIONS:
        raise ValueError("unknown version")
    head: dict = {"version": version, "build": c.bytes().decode(), "config_hash": c.take("Q"), "open": c.choice((False, True), "flag", 0), "initial": {}}
    for _ in range(c.count(MOST_OPERATIONS)):
        key = c.bytes()
        if key in head["initial"]:
            raise ValueError("repeated initial key")
        head["initial"][key] = c.bytes()
    out: list[dict] = []
    for n in range(c.count(MOST_OPERATIONS)):
        o = {"ord": n} | {f: c.take("Q") for f in ("id", "client", "sequence", "invoke")}
        o["complete"] = c.maybe(lambda: c.take("Q"))
        o |= _operation(c, version >= 4) | _outcome(c)
        o["consistency"], probe = "strong", 0
        if version >= 3:
            o["deadline"] = c.maybe(lambda: c.take("Q"))
            o["consistency"] = c.choice(CONSISTENCY, "consistency")
            probe = c.choice((0, 1, 2), "probe", 0)
        o["probe"] = (None, "final", "replica")[probe]
        if probe == 2:
            o |= {f: c.take("Q") for f in ("replica", "committed_index", "state_hash")}
            o["state_hash"] -= (o["state_hash"] >> 63) << 64
        if o["complete"] is None and not head["open"]:
            raise ValueError("open operation")
        out.append(o)
    if c.at != len(data):
        raise ValueError("trailing bytes")
    if len({o["id"] for o in out}) != len(out):
        raise ValueError("repeated id")
    return head, out


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Operations of history containers (HISTORY_SCHEMA); run_id is the file's path."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(HISTORY_SCHEMA))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                head, rows = history_operations(content)
                own = {"run_id": path, "config_hash": f"{head['config_hash']:016x}"}
                for a in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist([own | r for r in rows[a : a + 10_000]], kinds)

    return binary(spark, path).select("path", "content").mapInArrow(run, HISTORY_SCHEMA)


def read_history_initial(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, key, value) that the histories start from."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pairs = history_operations(content)[0]["initial"].items()
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(pairs), pa.string()), pa.array([k for k, _ in pairs], pa.binary()), pa.array([v for _, v in pairs], pa.binary())], ["run_id", "key", "value"])

    return binary(spark, path).select("path", "content").mapInArrow(run, "run_id string, key binary, value binary")


TRACE_JSON = "trace_version int, seed string, config_hash bigint, build string, events array<struct<seq: bigint, time_ns: bigint, node: bigint, kind: string, payload_hex: string>>"


def read_trace_json(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.json(path, schema=TRACE_JSON, multiLine=True, mode="FAILFAST")
    return rows.select(F.col("seed").alias("run_id"), "build", F.inline("events")).select("run_id", "build", "seq", "time_ns", "node", "kind", F.unhex("payload_hex").alias("payload"))


LEDGER = ("build_label", "config_hash", "profile", "seed_hex", "verdict", "events", "checker_states", "peak_total_bytes", "artifact_hash")


def read_ledger_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Ledger rows: two header lines, nine fields; a last line without its end is torn and left out, another malformed line fails."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split(F.regexp_replace("value", r"[^\n]*\z", ""), "\n")).alias("n", "line")).filter("n >= 2 AND line <> ''")
    f = F.split("line", "\t")
    fields = lines.select(F.when(F.size(f) == 9, f).otherwise(F.raise_error(F.concat(F.lit("malformed ledger line "), F.col("n").cast("string"))).cast("array<string>")).alias("f"))
    seed = F.conv(F.regexp_replace(F.col("f")[3], "^0x", ""), 16, 10).cast("decimal(20,0)")
    return fields.select(*[F.col("f")[i].alias(LEDGER[i]) for i in range(3)], seed.alias("seed"), F.col("f")[4].alias("verdict"), *[F.col("f")[i].cast("bigint").alias(LEDGER[i]) for i in range(5, 8)], F.when(F.col("f")[8] != "-", F.col("f")[8]).alias("artifact_hash"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(name, labels, value) of text metrics."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    pattern = r"^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{([^}]*)\})?\s+(\S+)"
    return lines.select(F.regexp_extract("value", pattern, 1).alias("name"), F.regexp_extract("value", pattern, 2).alias("labels"), F.regexp_extract("value", pattern, 3).cast("double").alias("value"))


def read_profile(spark: SparkSession, text: str) -> DataFrame:
    """(key, values) of a profile's scalar and integer-array keys; the text of one small file."""
    import tomllib

    rows = []
    for section, body in tomllib.loads(text).items():
        for k, v in body.items() if isinstance(body, dict) else ((None, body),):
            rows.append((section if k is None else f"{section}.{k}", [str(x) for x in (v if isinstance(v, list) else [v])]))
    return spark.createDataFrame(rows, "key string, values array<string>")


# ---- binary tables and logs


def table_entries(data: bytes) -> Iterator[tuple[int, bytes, int, str, bytes]]:
    """(file_no, user_key, sequence, kind, value) of a version-1 sorted table; its checksum must hold."""
    if data[:4] != b"CCST" or struct.unpack_from("<H", data, 4)[0] != 1:
        raise ValueError("not a version-1 table")
    if crc(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("checksum")
    file_no, count = struct.unpack_from("<QI", data, 6)
    at = 18
    for _ in range(count):
        n = struct.unpack_from("<I", data, at)[0]
        key = data[at + 4 : at + 4 + n]
        sequence, kind, m = struct.unpack_from("<QBI", data, at + 4 + n)
        at += 4 + n + 13
        yield file_no, key, sequence, {1: "PUT", 2: "DEL"}[kind], data[at : at + m]
        at += m
    if at != len(data) - 4:
        raise ValueError("trailing bytes")


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    return _decoded(binary(spark, path), table_entries, "file_no bigint, user_key binary, sequence bigint, kind string, value binary")


def meta_generation(data: bytes) -> int:
    """The manifest generation that a version-1 META names."""
    if data[:4] != b"CCMT" or struct.unpack_from("<H", data, 4)[0] != 1 or crc(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("not a valid META")
    return struct.unpack_from("<Q", data, 6)[0]


def framed_records(data: bytes, checked: bool = True) -> Iterator[tuple[int, bytes]]:
    """(ord, record) of length:u32 [crc32c:u32] record frames: an incomplete last frame is torn, a complete corrupt one fails.

    A length of zero or beyond MOST_RECORD is never written: it fails as well.
    """
    at = n = 0
    head = 8 if checked else 4
    while at + head <= len(data):
        size = struct.unpack_from("<I", data, at)[0]
        if not 0 < size <= MOST_RECORD:
            raise ValueError(f"bad record length at {at}")
        if at + head + size > len(data):
            return
        record = data[at + head : at + head + size]
        if checked and crc(record) != struct.unpack_from("<I", data, at + 4)[0]:
            raise ValueError(f"corrupt record at {at}")
        yield n, record
        at, n = at + head + size, n + 1


def read_frames(spark: SparkSession, path: str, checked: bool = True) -> DataFrame:
    return _decoded(binary(spark, path), lambda d: framed_records(d, checked), "ord bigint, record binary")


# ---- binary traces

# fixed values: the registry of event kinds by code, from 1 on
KINDS = ("NetSend", "NetRecv", "NetDrop", "IoIssue", "IoDone", "IoLost", "TimerSet", "TimerFire", "RoleChange", "VoteReq", "VoteGrant", "VoteDeny", "AppendSent", "AppendAck", "Commit", "Apply", "SnapshotStart", "SnapshotChunk", "SnapshotInstall", "ConfChange", "ClientInvoke", "ClientOk", "ClientFail", "ClientTimeout", "WalRecover", "Flush", "Compact", "Fault", "CheckerNote", "SyntheticKataEnabled")


def trace_events(data: bytes, strict: bool = False) -> Iterator[tuple[str, str, int, int, int | None, str, bytes]]:
    """(run_id, build, seq, time_ns, node, kind, payload) of a version-1 binary trace; an unknown kind is shown by its code unless strict."""
    if data[:4] != b"CCTR" or struct.unpack_from("<H", data, 4)[0] != 1:
        raise ValueError("not a version-1 trace")
    seed, _, size = struct.unpack_from("<QII", data, 6)
    build = data[22 : 22 + size].decode()
    count = struct.unpack_from("<I", data, 22 + size)[0]
    at = 26 + size
    for _ in range(count):
        seq, time_ns, has = struct.unpack_from("<QQB", data, at)
        if has > 1:
            raise ValueError(f"bad node flag at {at}")
        node = struct.unpack_from("<Q", data, at + 17)[0] if has else None
        at += 17 + 8 * has
        code, n = struct.unpack_from("<BI", data, at)
        if not 1 <= code <= len(KINDS) and strict:
            raise ValueError(f"unknown kind {code}")
        if at + 5 + n > len(data):
            raise ValueError("cut off")
        yield f"0x{seed:016x}", build, seq, time_ns, node, KINDS[code - 1] if 1 <= code <= len(KINDS) else f"kind-{code}", data[at + 5 : at + 5 + n]
        at += 5 + n
    if at != len(data):
        raise ValueError("trailing bytes")


def read_traces(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    return _decoded(binary(spark, path), lambda d: trace_events(d, strict), "run_id string, build string, seq bigint, time_ns bigint, node bigint, kind string, payload binary")


# ---- write-ahead log segments

# fixed values: record types by code, from 1 on
WAL_KINDS = ("data", "pad", "seal")
WAL_HEAD, WAL_RECORD, MOST_WAL_RECORD = 14, 9, 2 << 20


def _wal_record(data: bytes, at: int) -> tuple[str, bytes, int] | None:
    """(kind, payload, end) of the record at a place; None where only zeros are left; ValueError for anything else."""
    if not any(data[at : at + 64]) and not any(data[at:]):
        return None
    if len(data) - at < WAL_RECORD:
        raise ValueError("cut off")
    size, check, code = struct.unpack_from("<IIB", data, at)
    end = at + WAL_RECORD + size
    if end > len(data) or WAL_RECORD + size > MOST_WAL_RECORD or not 1 <= code <= len(WAL_KINDS) or crc(data[at + 8 : end]) != check:
        raise ValueError("bad record")
    return WAL_KINDS[code - 1], data[at + WAL_RECORD : end], end


def wal_segment(data: bytes) -> tuple[int, list[tuple[int, str, bytes]], int | None]:
    """(sequence, records as (offset, kind, payload), where a bad tail begins) of a segment.

    A bad record with a good one behind it is corruption in the middle, which fails; without, the tail is torn.
    """
    if len(data) < WAL_HEAD or data[:4] != b"CCWL" or struct.unpack_from("<H", data, 4)[0] != 1:
        raise ValueError("not a version-1 segment")
    out, at, torn = [], WAL_HEAD, None
    while at < len(data):
        try:
            got = _wal_record(data, at)
        except ValueError:
            for later in range(at + 1, len(data)):
                try:
                    good = _wal_record(data, later)
                except ValueError:
                    continue
                if good:
                    raise ValueError(f"corruption at {at}") from None
                break
            torn = at
            break
        if got is None:
            break
        kind, payload, end = got
        if kind != "pad":
            out.append((at, kind, payload))
        at = end
    return struct.unpack_from("<Q", data, 6)[0], out, torn


def read_wal(spark: SparkSession, path: str) -> DataFrame:
    """(log, segment, offset, kind, payload) of logs, a folder each, whose files are segments numbered from 0 on.

    Padding is left out. A torn tail ends a log; it may only be in the last segment, and segments must follow one another:
    else the read fails.
    """
    from pyspark.sql import Window

    found = "array<struct<offset: bigint, kind: string, payload: binary>>"

    def run(batches):
        import pyarrow as pa

        kinds = pa.list_(pa.struct([("offset", pa.int64()), ("kind", pa.string()), ("payload", pa.binary())]))
        for batch in batches:
            got = [wal_segment(c) for c in batch.column(1).to_pylist()]
            records = [[{"offset": o, "kind": k, "payload": x} for o, k, x in r] for _, r, _ in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, *_ in got], pa.int64()), pa.array([t for *_, t in got], pa.int64()), pa.array(records, kinds)], ["path", "segment", "torn", "records"])

    segments = binary(spark, path).select("path", "content").mapInArrow(run, f"path string, segment bigint, torn bigint, records {found}")
    own = segments.withColumn("log", F.regexp_replace("path", "/[^/]*$", ""))
    w = Window.partitionBy("log").orderBy("segment")  # a row a segment
    checked = own.withColumn("_n", F.row_number().over(w) - 1).withColumn("_last", F.lead("segment").over(w).isNull())
    fault = F.when(F.col("_n") != F.col("segment"), "segments don't follow one another").when(F.col("torn").isNotNull() & ~F.col("_last"), "corruption before the last segment")
    checked = checked.withColumn("records", F.when(fault.isNull(), F.col("records")).otherwise(F.raise_error(F.concat_ws(" ", fault, "path")).cast(found)))
    return checked.select("log", "segment", F.inline("records"))


def read_bench_json(spark: SparkSession, path: str) -> DataFrame:
    """(path, metric, value) of the numbers of bench reports, one JSON object a file, objects inside by dotted names."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", "map<string, string>").alias("m"))
    flat = rows.select("path", F.explode("m").alias("metric", "value"))
    inner = flat.filter(F.col("value").startswith("{")).select("path", "metric", F.explode(F.from_json("value", "map<string, string>")).alias("k", "v"))
    both = flat.select("path", "metric", "value").unionByName(inner.select("path", F.concat_ws(".", "metric", "k").alias("metric"), F.col("v").alias("value")))
    return both.select("path", "metric", F.col("value").try_cast("double").alias("value")).filter("value IS NOT NULL")


def read_trend_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST")


# ---- generated workloads

#: Shares of a hundred by workload, in the order of the draw.
MIXES = {
    "mixed": (("GET", 50), ("SET", 30), ("DEL", 10), ("INCR", 10)),
    "ttl": (("GET", 60), ("SET", 40)),
    "follower": (("SET", 40), ("READ FOLLOWER", 60)),
    "stale": (("SET", 40), ("READ STALE", 60)),
    "batch": (("GET", 20), ("SET", 20), ("BATCH", 60)),
}


def workload(spark: SparkSession, clients: int, operations: int, mix: str = "mixed", keys: int = 100, seed: int = 0, ttl_ns: int | None = None) -> DataFrame:
    """(client, sequence, kind, key, value, ttl_ns, commands): operations of each client, drawn by hashes of (seed, place).

    Any row can be made alone, so a workload of any size is one scan. A BATCH has two to four commands out of GET, SET,
    DEL and INCR in equal shares.
    """
    draw = lambda n, *salt: F.pmod(F.xxhash64(F.lit(seed), "client", "sequence", *[F.lit(x) if isinstance(x, str) else x for x in salt]), F.lit(n))
    pick = lambda shares, at: F.element_at(F.array(*[F.lit(k) for k, n in shares for _ in range(n)]), (at + 1).cast("int"))
    key = lambda *salt: F.concat(F.lit("key-"), draw(max(1, keys), "key", *salt).cast("string"))
    rows = spark.range(clients * operations).select((F.col("id") % clients + 1).alias("client"), F.expr(f"id div {clients} + 1").alias("sequence"))
    rows = rows.withColumn("kind", pick(MIXES[mix], draw(100, "kind"))).withColumn("_n", (draw(3, "count") + 2).cast("int"))
    value = F.hex(F.xxhash64(F.lit(seed), "client", "sequence", F.lit("value")))
    simple = tuple((k, 25) for k in ("GET", "SET", "DEL", "INCR"))
    command = lambda i: F.struct(pick(simple, draw(100, "part", i)).alias("kind"), key("part", i).alias("key"))
    commands = F.when(F.col("kind") == "BATCH", F.transform(F.sequence(F.lit(1), F.col("_n")), command))
    is_set = F.col("kind") == "SET"
    return rows.select("client", "sequence", "kind", F.when(F.col("kind") != "BATCH", key()).alias("key"), F.when(is_set, value).alias("value"), F.when(is_set, F.lit(ttl_ns).cast("bigint")).alias("ttl_ns"), commands.alias("commands"))
