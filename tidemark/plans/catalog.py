"""Registered queries of the engine's own operators, each with SQL that computes the same rows another way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quantiles, scalars
from ..operators import clock, explain, history, ledger, linearize, membership, mvcc, relational, replay, sessions, trace, transactions
from ..shipping import shipped
from ..sources import views as v
from ..streaming import stateful, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = shipped(f)
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- KV: replay of command logs


@query(f"WITH {v.V_LOG}, c AS (SELECT *, max(t_us) OVER (ORDER BY log_index) AS now_us FROM v_log), w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY log_index DESC) AS r FROM c WHERE op IN ('SET', 'DEL')) SELECT key, log_index, value, now_us + k * {v.HOUR_US} AS deadline_us FROM w WHERE r = 1 AND op = 'SET' AND now_us + k * {v.HOUR_US} > (SELECT max(t_us) FROM v_log)")
def kv_visible_state(s, d):
    return replay.visible_state(v.v_log(s, d), v.HOUR_US)


@query(f"WITH {v.V_LOG} SELECT log_index, max(t_us) OVER (ORDER BY log_index) AS now_us FROM v_log")
def kv_clamped_clock(s, d):
    return clock.running_max(v.v_log(s, d), "log_index", "t_us", "now_us").select("log_index", "now_us")


@query(f"WITH {v.V_LOG}, g AS (SELECT *, sum(CASE WHEN op IN ('SET','DEL') THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY log_index) AS seg FROM v_log WHERE op IN ('SET','DEL','INCR')), l AS (SELECT key, max(seg) AS seg FROM g GROUP BY key) SELECT key, CAST(coalesce(max(CASE WHEN op = 'SET' THEN value END), 0) + count(*) FILTER (op = 'INCR') AS BIGINT) AS value FROM g JOIN l USING (key, seg) GROUP BY key HAVING count(*) FILTER (op IN ('SET','INCR')) > 0")
def kv_counters(s, d):
    return replay.counters(v.v_log(s, d))


@query(f"WITH {v.V_LOG}, g AS (SELECT *, sum(CASE WHEN op IN ('SET','DEL') THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY log_index) AS seg FROM v_log WHERE op IN ('SET','DEL','INCR')), l AS (SELECT key, max(seg) AS seg FROM g GROUP BY key) SELECT key, CAST(coalesce(sum(length(CAST(value AS VARCHAR))) FILTER (op <> 'DEL'), 0) AS BIGINT) AS bytes, CAST(count(*) FILTER (op = 'INCR') AS BIGINT) AS parts FROM g JOIN l USING (key, seg) GROUP BY key HAVING count(*) FILTER (op <> 'DEL') > 0")
def kv_append_lengths(s, d):
    return replay.appended(v.v_log(s, d))


@query(f"WITH {v.V_LOG} SELECT a.log_index, a.key, CASE WHEN b.op = 'SET' THEN b.value END AS old FROM v_log a LEFT JOIN LATERAL (SELECT op, value FROM v_log c WHERE c.key = a.key AND c.op IN ('SET','DEL') AND c.log_index < a.log_index ORDER BY c.log_index DESC LIMIT 1) b ON true WHERE a.op = 'SET'")
def kv_getset_old(s, d):
    return replay.old_values(v.v_log(s, d))


def _half(s, d):
    log = v.v_log(s, d)
    mid = log.agg((F.max("log_index") / 2).cast("bigint").alias("m"))
    return log, log.join(F.broadcast(mid), F.col("log_index") <= F.col("m")).drop("m")


_COUNT = "SELECT key, CAST(coalesce(max(CASE WHEN op = 'SET' THEN value END), 0) + count(*) FILTER (op = 'INCR') AS BIGINT) AS value FROM {t} JOIN (SELECT key, max(seg) AS seg FROM {t} GROUP BY key) USING (key, seg) GROUP BY key HAVING count(*) FILTER (op IN ('SET','INCR')) > 0"


@query(f"WITH {v.V_LOG}, g AS (SELECT *, sum(CASE WHEN op IN ('SET','DEL') THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY log_index) AS seg FROM v_log WHERE op IN ('SET','DEL','INCR')), h AS (SELECT * FROM g WHERE log_index <= (SELECT max(log_index) // 2 FROM v_log)), a AS ({_COUNT.format(t='g')}), b AS ({_COUNT.format(t='h')}) SELECT key, CASE WHEN b.value IS NULL THEN 'put' WHEN a.value IS NULL THEN 'delete' ELSE 'replace' END AS change, b.value AS old, a.value AS new FROM b FULL JOIN a USING (key) WHERE a.value IS DISTINCT FROM b.value")
def kv_state_diff(s, d):
    log, half = _half(s, d)
    return replay.state_diff(replay.counters(half), replay.counters(log))


@query(f"WITH {v.V_LOG} SELECT g.key, g.log_index AS at, CASE WHEN w.op = 'SET' THEN w.value END AS value FROM (SELECT * FROM v_log WHERE op = 'GET') g ASOF LEFT JOIN (SELECT * FROM v_log WHERE op IN ('SET','DEL')) w ON g.key = w.key AND g.log_index >= w.log_index")
def kv_get_as_of(s, d):
    log = v.v_log(s, d)
    return replay.as_of(log, log.filter("op = 'GET'").select("key", F.col("log_index").alias("at")))


_STATE = f"{v.V_LOG}, c AS (SELECT *, max(t_us) OVER (ORDER BY log_index) AS now_us FROM v_log), w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY log_index DESC) AS r FROM c WHERE op IN ('SET','DEL')), st AS (SELECT key, log_index, value, now_us + k * {v.HOUR_US} AS deadline_us FROM w WHERE r = 1 AND op = 'SET')"


def _stored(s, d):
    return replay.visible_state(v.v_log(s, d), v.HOUR_US, as_of=-1)


@query(f"WITH {_STATE} SELECT key, deadline_us FROM st WHERE deadline_us <= (SELECT max(t_us) FROM v_log) ORDER BY deadline_us, key LIMIT 10")
def kv_sweep_due(s, d):
    end = v.v_log(s, d).agg(F.max("t_us").alias("e"))
    state = _stored(s, d).join(F.broadcast(end), F.col("deadline_us") <= F.col("e"))
    return state.orderBy("deadline_us", "key").limit(10).select("key", "deadline_us")


@query(f"WITH {_STATE} SELECT min(deadline_us) AS first_deadline FROM st")
def kv_first_deadline(s, d):
    return _stored(s, d).agg(F.min("deadline_us").alias("first_deadline"))


@query(f"WITH {_STATE}, e AS (SELECT max(t_us) AS e FROM v_log), keys AS (SELECT DISTINCT key FROM v_log) SELECT key, CASE WHEN deadline_us IS NULL OR deadline_us <= e THEN -2 ELSE (deadline_us - e) // 1000000 END AS ttl FROM keys LEFT JOIN st USING (key), e")
def kv_ttl(s, d):
    log = v.v_log(s, d)
    rows = log.select("key").distinct().join(_stored(s, d), "key", "left").join(F.broadcast(log.agg(F.max("t_us").alias("e"))), F.lit(True))
    return rows.select("key", scalars.ttl_seconds(F.col("deadline_us").isNotNull(), F.col("deadline_us") * 1000, F.col("e") * 1000).cast("bigint").alias("ttl"))


@query(f"WITH {_STATE} SELECT key, value FROM (SELECT * FROM st WHERE key >= 'k2' ORDER BY key LIMIT 20) WHERE deadline_us > (SELECT max(t_us) FROM v_log)")
def kv_scan_range(s, d):
    page = replay.scan_range(_stored(s, d), "k2", 20)
    end = v.v_log(s, d).agg(F.max("t_us").alias("e"))
    return page.join(F.broadcast(end), F.col("deadline_us") > F.col("e")).select("key", "value")


@query(f"WITH {_STATE} SELECT key, value FROM st WHERE starts_with(key, 'k3') ORDER BY key")
def kv_scan_prefix(s, d):
    return replay.scan_prefix(_stored(s, d), "k3").select("key", "value")


@query(f"WITH {_STATE} SELECT key, value FROM st WHERE starts_with(key, 'k') AND key > 'k25' ORDER BY key LIMIT 7")
def kv_scan_next_page(s, d):
    return replay.scan_prefix(_stored(s, d), "k", limit=7, after="k25").select("key", "value")


@query(f"WITH {v.V_LOG} SELECT key, bool_or(op = 'SET') AS ever_set, count(*) FILTER (op IN ('SET','DEL','INCR')) AS writes, count(*) FILTER (op IN ('GET','EXPIRE')) AS others FROM v_log GROUP BY key")
def kv_write_classes(s, d):
    write = F.col("op").isin("SET", "DEL", "INCR")
    return v.v_log(s, d).groupBy("key").agg(F.bool_or(F.col("op") == "SET").alias("ever_set"), F.count_if(write).alias("writes"), F.count_if(~write).alias("others"))


BATCH = "array<struct<kind: string, key: binary, value: binary, expected: binary, delta: bigint, ttl_ns: bigint, at_ns: bigint, condition: string, scan_start: binary, scan_end: binary, scan_limit: int>>"


def _commands(s, d):
    log = v.v_log(s, d)
    i, now = F.col("log_index"), F.col("t_us") * 1000
    kind = F.when(i % 11 == 0, "PERSIST").when(i % 7 == 0, "APPEND").when(i % 13 == 0, "EXPIREAT").otherwise(F.col("op"))
    b = lambda c: F.encode(c, "UTF-8")
    none = lambda t: F.lit(None).cast(t)
    ttl = F.when(((kind == "SET") & (F.col("k") < 50)) | (kind == "EXPIRE"), F.col("k") * 3_600_000_000_000)
    columns = {
        "log_index": i,
        "leader_time_ns": now,
        "kind": kind,
        "key": b(F.col("key")),
        "value": b(F.col("value").cast("string")),
        "expected": none("binary"),
        "delta": F.when(i % 17 == 0, F.lit(9_007_199_254_740_993)).otherwise(F.lit(1)).cast("bigint"),
        "ttl_ns": ttl,
        "at_ns": F.when(kind == "EXPIREAT", now + F.col("k") * 1_800_000_000_000 + i % 1000),
        "condition": F.when((kind == "SET") & (i % 5 == 0), "NX"),
        "scan_start": none("binary"),
        "scan_end": none("binary"),
        "scan_limit": none("int"),
        "batch": none(BATCH),
    }
    return log.select(*[c.alias(name) for name, c in columns.items()])


@query(f"""WITH RECURSIVE {v.V_LOG}, c AS (SELECT log_index, key, CAST(value AS VARCHAR) AS value, k, max(t_us) OVER (ORDER BY log_index) * 1000 AS now, t_us * 1000 AS own,
  CASE WHEN log_index % 11 = 0 THEN 'PERSIST' WHEN log_index % 7 = 0 THEN 'APPEND' WHEN log_index % 13 = 0 THEN 'EXPIREAT' ELSE op END AS kind, CAST(CASE WHEN log_index % 17 = 0 THEN 9007199254740993 ELSE 1 END AS HUGEINT) AS delta FROM v_log),
r AS (SELECT *, log_index % 5 = 0 AS nx, row_number() OVER (PARTITION BY key ORDER BY log_index) AS n FROM c),
f AS (SELECT key, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS held, CAST(NULL AS BIGINT) AS due, CAST(NULL AS BIGINT) AS log_index, CAST(NULL AS VARCHAR) AS reply FROM (SELECT DISTINCT key FROM r)
UNION ALL SELECT key, n,
  CASE WHEN kind = 'SET' AND (NOT nx OR live IS NULL) THEN value WHEN kind = 'SET' THEN held WHEN kind = 'DEL' THEN NULL WHEN kind = 'APPEND' THEN coalesce(live, '') || value WHEN kind = 'INCR' AND total IS NOT NULL THEN CAST(total AS VARCHAR) ELSE held END,
  CASE WHEN kind = 'SET' AND (NOT nx OR live IS NULL) THEN CASE WHEN k < 50 THEN now + k * 3600000000000 END WHEN kind IN ('DEL', 'PERSIST') AND (kind = 'DEL' OR held IS NOT NULL) THEN NULL WHEN kind = 'EXPIRE' AND live IS NOT NULL THEN now + k * 3600000000000 WHEN kind = 'EXPIREAT' AND live IS NOT NULL THEN own + k * 1800000000000 + li % 1000 ELSE due END,
  li,
  CASE kind WHEN 'SET' THEN CASE WHEN NOT nx THEN 'OK' WHEN live IS NULL THEN 'true' ELSE 'false' END WHEN 'DEL' THEN '1' WHEN 'GET' THEN coalesce('"' || live || '"', 'nil') WHEN 'APPEND' THEN CAST(length(coalesce(live, '') || value) AS VARCHAR)
    WHEN 'INCR' THEN coalesce(CAST(total AS VARCHAR), 'error:not-numeric') WHEN 'PERSIST' THEN CASE WHEN held IS NOT NULL AND due IS NOT NULL THEN '1' ELSE '0' END ELSE CASE WHEN live IS NULL THEN '0' ELSE '1' END END
FROM (SELECT *, CASE WHEN old + delta BETWEEN -9223372036854775808 AND 9223372036854775807 THEN old + delta END AS total FROM (SELECT *, CAST(TRY_CAST(coalesce(live, '0') AS BIGINT) AS HUGEINT) AS old FROM (
  SELECT r.key, r.n, r.kind, r.value, r.k, r.now, r.own, r.delta, r.nx, r.log_index AS li, f.held, f.due, CASE WHEN f.due IS NULL OR f.due > r.now THEN f.held END AS live FROM f JOIN r ON r.key = f.key AND r.n = f.n + 1))))
SELECT log_index, reply FROM f WHERE n > 0""")
def kv_general_replay(s, d):
    """Every reply of a log with conditional writes, deadlines, appends, large increments and PERSIST: no closed form."""
    return replay.replay(_commands(s, d))


# ---- sessions


def _requests(s, d):
    log = v.v_log(s, d)
    reply = F.concat(F.lit("r"), F.col("log_index").cast("string"))
    sequence = F.when(F.col("log_index") % 29 == 0, 0).otherwise(F.expr("log_index div 3"))
    return log.select("log_index", (F.col("client") % 2).cast("int").alias("namespace"), (F.col("client") % 40).alias("client"), sequence.cast("bigint").alias("sequence"), F.col("op").alias("command"), (F.col("t_us") * 1000).alias("now_ns"), reply.alias("reply"))


_REQUESTS = "q AS (SELECT log_index, client % 2 AS namespace, client % 40 AS client, CASE WHEN log_index % 29 = 0 THEN 0 ELSE log_index // 3 END AS sequence, op AS command, t_us * 1000 AS now_ns, concat('r', log_index) AS reply FROM v_log)"


@query(f"""WITH RECURSIVE {v.V_LOG}, {_REQUESTS}, r AS (SELECT *, row_number() OVER (PARTITION BY namespace, client ORDER BY log_index) AS n FROM q),
f AS (SELECT namespace, client, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS cmd, CAST(NULL AS VARCHAR) AS held, CAST(0 AS BIGINT) AS active, CAST(NULL AS BIGINT) AS blocked, CAST(NULL AS BIGINT) AS log_index, CAST(NULL AS VARCHAR) AS decision, CAST(NULL AS VARCHAR) AS reply FROM (SELECT DISTINCT namespace, client FROM r)
UNION ALL SELECT namespace, client, n, CASE d WHEN 'apply' THEN CASE WHEN sequence = 0 THEN seq ELSE sequence END WHEN 'expires' THEN NULL ELSE seq END, CASE WHEN d = 'apply' AND sequence > 0 THEN command WHEN d = 'expires' THEN NULL ELSE cmd END, CASE WHEN d = 'apply' AND sequence > 0 THEN given WHEN d = 'expires' THEN NULL ELSE held END,
  CASE WHEN sequence > 0 AND d IN ('apply', 'cached', 'sequence-conflict') THEN now_ns ELSE active END, CASE WHEN sequence = 0 THEN blocked WHEN d = 'expires' THEN now_ns + 300000000000 WHEN blocked <= now_ns THEN NULL ELSE blocked END, li, CASE d WHEN 'expires' THEN 'session-expired' ELSE d END, CASE d WHEN 'apply' THEN given WHEN 'cached' THEN held END
FROM (SELECT r.namespace, r.client, r.n, f.seq, f.cmd, f.held, f.active, f.blocked, r.sequence, r.command, r.now_ns, r.reply AS given, r.log_index AS li,
  CASE WHEN r.sequence = 0 THEN 'apply' WHEN f.blocked > r.now_ns THEN 'session-expired' WHEN f.seq IS NOT NULL AND r.now_ns - f.active > 1800000000000 THEN 'expires' WHEN r.sequence < f.seq THEN 'stale-seq' WHEN r.sequence = f.seq THEN CASE WHEN f.cmd = r.command THEN 'cached' ELSE 'sequence-conflict' END ELSE 'apply' END AS d
  FROM f JOIN r ON r.namespace = f.namespace AND r.client = f.client AND r.n = f.n + 1))
SELECT log_index, decision, reply FROM f WHERE n > 0""")
def session_dedup(s, d):
    return sessions.decide(_requests(s, d))


_SESSIONS = f"{v.V_LOG}, ss AS (SELECT client % 2 AS namespace, client, client % 5 = 0 AS tombstone, max(t_us) * 1000 AS last_active, max(t_us) * 1000 + 86400000000000 AS expires_at FROM v_log GROUP BY client), now AS (SELECT min(last_active) + 1800000000000 AS t FROM ss WHERE client % 7 = 3)"


def _session_table(s, d):
    last = F.max("t_us") * 1000
    rows = v.v_log(s, d).groupBy("client").agg(last.alias("last_active"), (last + 86_400_000_000_000).alias("expires_at"))
    return rows.select((F.col("client") % 2).alias("namespace"), "client", (F.col("client") % 5 == 0).alias("tombstone"), "last_active", "expires_at")


@query(f"WITH {_SESSIONS} SELECT namespace, client, tombstone FROM ss, now WHERE CASE WHEN tombstone THEN expires_at ELSE last_active + 1800000000000 END <= t ORDER BY CASE WHEN tombstone THEN expires_at ELSE last_active + 1800000000000 END, namespace, client, tombstone LIMIT 50")
def session_expire(s, d):
    """The first fifty due at the very instant at which some session's idle time ends."""
    rows = _session_table(s, d)
    now = rows.filter("client % 7 = 3").agg(F.min("last_active")).first()[0]
    return sessions.expire(rows, (now or 0) + sessions.IDLE_NS, 50).select("namespace", "client", "tombstone")


@query(f"WITH {v.V_LOG}, {_REQUESTS} SELECT client, count(*) AS requests, count(DISTINCT sequence) AS distinct_sequences FROM q GROUP BY client HAVING count(DISTINCT sequence) < count(*)")
def session_duplicates(s, d):
    return _requests(s, d).groupBy("client").agg(F.count("*").alias("requests"), F.count_distinct("sequence").alias("distinct_sequences")).filter("distinct_sequences < requests")


@query(f"WITH {v.V_LOG} SELECT client, max(t_us) AS last_active FROM v_log GROUP BY client HAVING (SELECT max(t_us) FROM v_log) - max(t_us) > 1800000000")
def session_idle(s, d):
    log = v.v_log(s, d)
    end = log.agg(F.max("t_us").alias("e"))
    return log.groupBy("client").agg(F.max("t_us").alias("last_active")).join(F.broadcast(end), F.col("e") - F.col("last_active") > 1_800_000_000).drop("e")


# ---- transactions and replica reads

_VERBS = "CASE WHEN i % 7 = 0 THEN 'MULTI' WHEN i % 7 = 5 THEN 'EXEC' WHEN i % 41 = 3 THEN 'DISCARD' WHEN i % 13 = 4 THEN 'SCAN' WHEN i % 3 = 0 THEN 'DEL' ELSE 'SET' END"


def _connection_commands(s, d):
    i = F.col("ord")
    rows = v.v_log(s, d).select((F.col("client") % 20).alias("connection"), F.col("log_index").alias("ord"))
    verb = F.expr(_VERBS.replace("i %", "ord %"))
    return rows.select("connection", "ord", verb.alias("verb"), F.when(i % 17 == 0, 2).otherwise(1).alias("keys"))


@query(f"""WITH RECURSIVE {v.V_LOG}, c AS (SELECT client % 20 AS connection, log_index AS i, CASE WHEN log_index % 17 = 0 THEN 2 ELSE 1 END AS keys FROM v_log), r AS (SELECT *, {_VERBS} AS verb, row_number() OVER (PARTITION BY connection ORDER BY i) AS n FROM c),
f AS (SELECT connection, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS tx, false AS dirty, 0 AS queued, CAST(NULL AS BIGINT) AS ord, CAST(NULL AS VARCHAR) AS verb, 0 AS keys, CAST(NULL AS BIGINT) AS transaction, CAST(NULL AS VARCHAR) AS reply FROM (SELECT DISTINCT connection FROM r)
UNION ALL SELECT f.connection, r.n, CASE WHEN r.verb IN ('EXEC', 'DISCARD') THEN NULL WHEN r.verb = 'MULTI' AND f.tx IS NULL THEN r.i ELSE f.tx END,
  CASE WHEN r.verb IN ('EXEC', 'DISCARD') THEN false WHEN f.tx IS NULL OR r.verb = 'MULTI' THEN f.dirty ELSE f.dirty OR r.verb = 'SCAN' OR (r.verb = 'DEL' AND r.keys <> 1) OR f.queued >= 2 END,
  CASE WHEN r.verb IN ('EXEC', 'DISCARD') OR f.tx IS NULL THEN 0 WHEN r.verb IN ('SET', 'DEL') AND NOT f.dirty AND (r.verb = 'SET' OR r.keys = 1) AND f.queued < 2 THEN f.queued + 1 ELSE f.queued END,
  r.i, r.verb, r.keys, f.tx,
  CASE WHEN r.verb = 'MULTI' THEN CASE WHEN f.tx IS NULL THEN 'OK' ELSE 'ERR nested' END WHEN r.verb IN ('EXEC', 'DISCARD') AND f.tx IS NULL THEN 'ERR ' || r.verb || ' without MULTI' WHEN r.verb = 'DISCARD' THEN 'OK' WHEN r.verb = 'EXEC' THEN CASE WHEN f.dirty THEN 'EXECABORT' ELSE 'EXEC ' || f.queued END
    WHEN f.tx IS NULL THEN 'IMMEDIATE' WHEN f.dirty THEN 'ERR already dirty' WHEN r.verb = 'SCAN' OR (r.verb = 'DEL' AND r.keys <> 1) THEN 'ERR cannot be queued' WHEN f.queued >= 2 THEN 'ERR batch limits' ELSE 'QUEUED' END
FROM f JOIN r ON r.connection = f.connection AND r.n = f.n + 1)
SELECT connection, ord, verb, keys, transaction, reply FROM f WHERE n > 0""")
def transactions_multi(s, d):
    """The MULTI queue of twenty connections, with at most two commands a transaction."""
    return transactions.multi(_connection_commands(s, d), most=2)


_READS = "g AS (SELECT log_index AS read_id, key, CASE WHEN log_index % 2 = 0 THEN 'stale' ELSE 'follower' END AS mode, log_index - 5 AS read_index, log_index - log_index % 9 AS applied_index FROM v_log WHERE op = 'GET')"


@query(f"""WITH {v.V_LOG}, {_READS}, w AS (SELECT * FROM v_log WHERE op IN ('SET', 'DEL')) SELECT g.read_id, g.key, g.mode, CASE WHEN g.mode = 'stale' OR applied_index >= read_index THEN 'ok' ELSE 'retry' END AS status,
CASE WHEN g.mode = 'stale' OR applied_index >= read_index THEN applied_index END AS served_index, CASE WHEN (g.mode = 'stale' OR applied_index >= read_index) AND w.op = 'SET' THEN w.value END AS value FROM g ASOF LEFT JOIN w ON g.key = w.key AND g.applied_index >= w.log_index""")
def kv_replica_reads(s, d):
    log, i = v.v_log(s, d), F.col("log_index")
    reads = log.filter("op = 'GET'").select(i.alias("read_id"), "key", F.when(i % 2 == 0, "stale").otherwise("follower").alias("mode"), (i - 5).alias("read_index"), (i - i % 9).alias("applied_index"))
    return transactions.replica_reads(log, reads)


# ---- ST: versions and files


@query(f"WITH {v.V_VERSIONS} SELECT user_key, sequence, value FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY sequence DESC) AS r FROM v_versions) WHERE r = 1 AND kind = 'PUT'")
def mvcc_latest(s, d):
    return mvcc.snapshot_get(v.v_versions(s, d)).select("user_key", "sequence", "value")


@query(f"WITH {v.V_VERSIONS} SELECT user_key, sequence, value FROM v_versions a WHERE sequence <= 10000 AND kind = 'PUT' AND NOT EXISTS (SELECT 1 FROM v_versions b WHERE b.user_key = a.user_key AND b.sequence <= 10000 AND b.sequence > a.sequence)")
def mvcc_snapshot_get(s, d):
    return mvcc.snapshot_get(v.v_versions(s, d), 10000).select("user_key", "sequence", "value")


@query(f"WITH {v.V_VERSIONS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY sequence DESC) AS r FROM v_versions WHERE sequence <= 12000 AND user_key >= 100 AND user_key < 900) SELECT user_key, sequence, value FROM n WHERE r = 1 AND kind = 'PUT' ORDER BY user_key LIMIT 50")
def mvcc_scan(s, d):
    return mvcc.scan(v.v_versions(s, d), 12000, 100, 900, 50).select("user_key", "sequence", "value")


@query(f"WITH {v.V_VERSIONS}, m AS (SELECT user_key, max(sequence) AS a, max(sequence) FILTER (sequence <= 4000) AS b, max(sequence) FILTER (sequence <= 9000) AS c FROM v_versions GROUP BY user_key) SELECT v.user_key, v.sequence FROM v_versions v JOIN m USING (user_key) WHERE v.sequence IN (a, b, c)")
def mvcc_compaction_keep(s, d):
    return mvcc.compaction_keep(v.v_versions(s, d), [4000, 9000]).select("user_key", "sequence")


_NARROW = v.V_FILES + ", narrow AS (SELECT file_no, level, file_no * 23 % 1300 AS smallest, file_no * 23 % 1300 + 11 AS largest FROM v_files)"


def _narrow(s, d):
    """Files whose ranges leave keys between them."""
    low = F.col("file_no") * 23 % 1300
    return v.v_files(s, d).select("file_no", "level", low.alias("smallest"), (low + 11).alias("largest"))


@query(f"WITH {_NARROW} SELECT x.user_key, x.sequence FROM v_versions x JOIN narrow f USING (file_no) WHERE x.kind = 'DEL' AND x.sequence < 9000 AND f.level = 2 AND NOT EXISTS (SELECT 1 FROM narrow g WHERE g.level > 2 AND x.user_key BETWEEN g.smallest AND g.largest)")
def mvcc_droppable_tombstones(s, d):
    return mvcc.droppable_tombstones(v.v_versions(s, d), _narrow(s, d), 9000, 2).select("user_key", "sequence")


@query(f"WITH {v.V_FILES} SELECT level, CASE WHEN level = 0 THEN count(*) ELSE CAST(sum(file_size) AS BIGINT) END AS numerator, CASE WHEN level = 0 THEN 4 ELSE CAST(8388608 * power(10, level - 1) AS BIGINT) END AS denominator, min(file_no) AS victim FROM v_files GROUP BY level")
def mvcc_compaction_scores(s, d):
    return mvcc.compaction_scores(v.v_files(s, d))


@query(f"WITH {v.V_FILES}, s AS (SELECT level, CASE WHEN level = 0 THEN count(*) ELSE CAST(sum(file_size) AS BIGINT) END AS n, CASE WHEN level = 0 THEN 4 ELSE CAST(8388608 * power(10, level - 1) AS BIGINT) END AS m, min(file_no) AS victim FROM v_files GROUP BY level) SELECT level, victim FROM s WHERE n >= m ORDER BY n::DOUBLE / m DESC, level LIMIT 1")
def mvcc_select_level(s, d):
    return mvcc.select_level(mvcc.compaction_scores(v.v_files(s, d))).select("level", "victim")


@query(f"WITH {v.V_FILES} SELECT DISTINCT b.file_no FROM v_files a JOIN v_files b ON a.level = b.level AND a.level > 0 AND (a.smallest, a.file_no) < (b.smallest, b.file_no) AND a.largest >= b.smallest")
def mvcc_overlapping_files(s, d):
    return mvcc.overlapping_files(v.v_files(s, d)).select("file_no")


@query(f"WITH {v.V_FILES} SELECT level, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes FROM v_files GROUP BY level")
def mvcc_level_metrics(s, d):
    return mvcc.level_metrics(v.v_files(s, d))


@query(f"WITH {v.V_VERSIONS} SELECT blocks, count(*) AS gets FROM (SELECT user_key, count(DISTINCT file_no) AS blocks FROM v_versions GROUP BY user_key) GROUP BY blocks")
def mvcc_read_amplification(s, d):
    return mvcc.tables_per_key(v.v_versions(s, d), v.v_files(s, d))


@query(f"WITH {v.V_VERSIONS}, h AS (SELECT blocks, count(*) AS gets FROM (SELECT user_key, count(DISTINCT file_no) AS blocks FROM v_versions GROUP BY user_key) GROUP BY blocks), c AS (SELECT blocks, sum(gets) OVER (ORDER BY blocks) AS upto, sum(gets) OVER () AS total FROM h) SELECT min(blocks) AS p99 FROM c WHERE upto >= greatest(1, ceil(total * 99 / 100))")
def mvcc_read_amp_p99(s, d):
    return quantiles.weighted_nearest_rank(mvcc.tables_per_key(v.v_versions(s, d), v.v_files(s, d)), [], "blocks", "gets", 99, 100, "p99")


@query(f"WITH {v.V_FILES} SELECT file_no FROM v_files WHERE smallest <= 40 AND largest >= 40")
def mvcc_range_prune(s, d):
    return v.v_files(s, d).filter("smallest <= 40 AND largest >= 40").select("file_no")


_EDITS = "e AS (SELECT o_orderkey AS ord, CASE WHEN o_custkey % 3 = 0 THEN 'REMOVE' ELSE 'ADD' END AS action, o_custkey % 200 AS file_no, o_custkey % 4 AS level FROM orders)"


def _edits(s, d):
    return v.read(s, d, "orders").select(F.col("o_orderkey").alias("ord"), F.when(F.col("o_custkey") % 3 == 0, "REMOVE").otherwise("ADD").alias("action"), (F.col("o_custkey") % 200).alias("file_no"), (F.col("o_custkey") % 4).alias("level"))


@query(f"WITH {_EDITS} SELECT file_no, level FROM (SELECT *, row_number() OVER (PARTITION BY file_no ORDER BY ord DESC) AS r FROM e) WHERE r = 1 AND action = 'ADD'")
def mvcc_manifest_replay(s, d):
    return mvcc.replay_manifest(_edits(s, d))


@query(f"WITH {_EDITS}, {v.V_FILES}, live AS (SELECT file_no FROM (SELECT *, row_number() OVER (PARTITION BY file_no ORDER BY ord DESC) AS r FROM e) WHERE r = 1 AND action = 'ADD') SELECT file_no FROM v_files WHERE file_no NOT IN (SELECT file_no FROM live)")
def mvcc_orphans(s, d):
    return mvcc.orphans(v.v_files(s, d), mvcc.replay_manifest(_edits(s, d))).select("file_no")


@query(f"""WITH RECURSIVE {v.V_VERSIONS}, e AS (SELECT file_no % 4 AS level, user_key, sequence, length(CAST(value AS VARCHAR)) * 8 + 32 AS w FROM v_versions),
k AS (SELECT level, user_key, CAST(sum(w) AS BIGINT) AS bytes, CAST(max_by(w, sequence) AS BIGINT) AS first, row_number() OVER (PARTITION BY level ORDER BY user_key) AS n FROM e GROUP BY level, user_key),
f AS (SELECT level, user_key, bytes, n, bytes AS held, 0 AS output FROM k WHERE n = 1
UNION ALL SELECT k.level, k.user_key, k.bytes, k.n, CASE WHEN f.held + k.first > 4096 THEN k.bytes ELSE f.held + k.bytes END, CASE WHEN f.held + k.first > 4096 THEN f.output + 1 ELSE f.output END FROM f JOIN k ON k.level = f.level AND k.n = f.n + 1)
SELECT level, user_key, bytes, output FROM f""")
def mvcc_split_output(s, d):
    size = F.length(F.col("value").cast("string")).cast("bigint") * 8
    entries = v.v_versions(s, d).select(F.expr("cast(file_no % 4 as bigint)").alias("level"), "user_key", "sequence", size.alias("size"))
    return mvcc.split_output(entries, most_bytes=4096)


@query(f"""WITH RECURSIVE {_NARROW}, g AS (SELECT * FROM narrow WHERE level IN (1, 2)), c AS (SELECT smallest AS a, largest AS b, 0 AS n FROM g WHERE level = 1 ORDER BY file_no LIMIT 1),
z AS (SELECT a, b, n FROM c UNION ALL SELECT least(z.a, (SELECT min(smallest) FROM g WHERE smallest <= z.b AND largest >= z.a)), greatest(z.b, (SELECT max(largest) FROM g WHERE smallest <= z.b AND largest >= z.a)), z.n + 1 FROM z
  WHERE EXISTS (SELECT 1 FROM g WHERE smallest <= z.b AND largest >= z.a AND (smallest < z.a OR largest > z.b)))
SELECT g.file_no FROM g, (SELECT a, b FROM z ORDER BY n DESC LIMIT 1) w WHERE g.smallest <= w.b AND g.largest >= w.a""")
def mvcc_overlap_closure(s, d):
    files = _narrow(s, d)
    first = files.filter("level = 1").orderBy("file_no").limit(1).first()
    return mvcc.overlap_closure(files, 1, first["smallest"], first["largest"]).select("file_no") if first else files.limit(0).select("file_no")


_MANIFEST = "o AS (SELECT o_orderkey AS ord, CASE WHEN o_custkey % 3 = 0 THEN 'REMOVE' ELSE 'ADD' END AS action, o_custkey % 700 AS file_no, o_custkey % 3 AS level, o_custkey % 700 * 17 % 900 AS smallest, o_custkey % 700 * 17 % 900 + 1 AS largest FROM orders), p AS (SELECT *, lag(action) OVER w AS was, lag(level) OVER w AS old, min(CASE WHEN action = 'REMOVE' THEN ord END) OVER (PARTITION BY file_no ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS until FROM o WINDOW w AS (PARTITION BY file_no ORDER BY ord))"


def _manifest(s, d):
    k, file_no = F.col("o_custkey"), F.col("o_custkey") % 700
    return v.read(s, d, "orders").select(F.col("o_orderkey").alias("ord"), F.when(k % 3 == 0, "REMOVE").otherwise("ADD").alias("action"), file_no.alias("file_no"), (k % 3).alias("level"), (file_no * 17 % 900).alias("smallest"), (file_no * 17 % 900 + 1).alias("largest"))


@query(f"""WITH {_MANIFEST} SELECT ord, file_no, CASE WHEN action = 'ADD' THEN 'file number' WHEN was IS DISTINCT FROM 'ADD' THEN 'removes missing file' ELSE 'remove level' END AS fault FROM p
WHERE (action = 'ADD' AND (was = 'ADD' OR file_no >= 650)) OR (action = 'REMOVE' AND (was IS DISTINCT FROM 'ADD' OR old <> level))
UNION ALL SELECT ord, file_no, 'level range overlap' FROM p a WHERE action = 'ADD' AND level > 0 AND EXISTS (SELECT 1 FROM p b WHERE b.action = 'ADD' AND b.level = a.level AND b.file_no <> a.file_no AND b.ord < a.ord AND (b.until IS NULL OR b.until > a.ord) AND b.smallest <= a.largest AND a.smallest <= b.largest)""")
def mvcc_manifest_faults(s, d):
    return mvcc.manifest_faults(_manifest(s, d), 650)


@query(f"WITH {v.V_FILES} SELECT a.n AS flushed, b.n AS compacted, CAST((a.n + b.n) * 1000 // a.n AS BIGINT) AS milli FROM (SELECT CAST(sum(file_size) AS BIGINT) AS n FROM v_files WHERE level = 0) a, (SELECT CAST(sum(file_size) AS BIGINT) AS n FROM v_files WHERE level > 0) b")
def mvcc_write_amplification(s, d):
    files = v.v_files(s, d).select("level", F.col("file_size").alias("bytes"))
    return mvcc.write_amplification(files.filter("level = 0"), files.filter("level > 0"))


# ---- LG: ledgers and samples


@query(f"WITH {v.V_LEDGER} SELECT verdict, profile, count(*) AS n, count(DISTINCT build_label) AS builds, CAST(sum(events) AS BIGINT) AS events FROM v_ledger GROUP BY verdict, profile")
def ledger_stats(s, d):
    return ledger.stats(v.v_ledger(s, d), ["verdict", "profile"])


@query(f"WITH {v.V_LEDGER}, x AS (SELECT DISTINCT profile, seed FROM v_ledger), y AS (SELECT *, seed - row_number() OVER (PARTITION BY profile ORDER BY seed) AS g FROM x) SELECT profile, min(seed) AS lo, max(seed) + 1 AS hi FROM y GROUP BY profile, g")
def ledger_islands(s, d):
    return ledger.islands(v.v_ledger(s, d), ["profile"])


@query(f"WITH {v.V_LEDGER}, a AS (SELECT profile, seed % 1000 AS seed, verdict FROM v_ledger) SELECT profile, seed, count(DISTINCT verdict) AS variants FROM a GROUP BY profile, seed HAVING count(DISTINCT verdict) > 1")
def ledger_conflicts(s, d):
    rows = v.v_ledger(s, d).select("profile", (F.col("seed") % 1000).alias("seed"), "verdict")
    return ledger.conflicts(rows, ["profile", "seed"])


@query(f"WITH {v.V_LEDGER} SELECT * FROM v_ledger WHERE profile <> 'F' UNION SELECT * FROM v_ledger WHERE profile <> 'O'")
def ledger_merge(s, d):
    rows = v.v_ledger(s, d)
    return ledger.merge(rows.filter("profile <> 'F'"), rows.filter("profile <> 'O'"))  # two ledgers with a common part


@query(f"""WITH {v.V_LEDGER}, l AS (SELECT *, 's' || CAST(CASE WHEN seed % 37 = 0 THEN 0 ELSE seed % 4 END AS VARCHAR) AS source FROM v_ledger WHERE build_label <> '5-LOW' OR seed % 10 = 0), e AS (SELECT max(seed) - 5 AS e FROM v_ledger)
SELECT CASE WHEN build_label = '5-LOW' THEN 'wrong build' WHEN config_hash <> 'c1' THEN 'wrong config' ELSE 'outside the range' END AS fault, source, seed FROM l, e WHERE build_label = '5-LOW' OR config_hash <> 'c1' OR seed < 2 OR seed >= e
UNION ALL SELECT 'several residues', source, NULL FROM l GROUP BY source HAVING count(DISTINCT seed % 4) > 1
UNION ALL SELECT 'several sources', NULL, seed % 4 FROM l GROUP BY seed % 4 HAVING count(DISTINCT source) > 1
UNION ALL SELECT CASE WHEN count(l.seed) = 0 THEN 'missing' ELSE 'repeated' END, NULL, w.seed FROM (SELECT CAST(unnest(range(2, (SELECT e FROM e))) AS BIGINT) AS seed) w LEFT JOIN l USING (seed) GROUP BY w.seed HAVING count(l.seed) <> 1""")
def ledger_shard_faults(s, d):
    rows = v.v_ledger(s, d)
    source = F.concat(F.lit("s"), F.when(F.col("seed") % 37 == 0, 0).otherwise(F.col("seed") % 4).cast("string"))
    kept = rows.filter("build_label <> '5-LOW' OR seed % 10 = 0").withColumn("build_label", F.when(F.col("build_label") == "5-LOW", "low").otherwise("own")).withColumn("source", source)
    return ledger.shard_faults(kept, 2, rows.agg(F.max("seed")).first()[0] - 5, 4, "own", "c1")


@query(f"WITH {v.V_LEDGER}, w AS (SELECT CAST(unnest(range(0, (SELECT max(seed) + 1 FROM v_ledger))) AS BIGINT) AS seed) SELECT w.seed, count(l.seed) AS sources FROM w LEFT JOIN v_ledger l ON l.seed = w.seed AND l.profile = 'O' GROUP BY w.seed HAVING count(l.seed) <> 1")
def ledger_coverage(s, d):
    rows = v.v_ledger(s, d)
    return ledger.coverage(rows.filter("profile = 'O'"), 0, rows.agg(F.max("seed")).first()[0] + 1)


@query(f"WITH {v.V_LEDGER} SELECT build_label AS source, list_sort(list(DISTINCT seed % 4)) AS residues FROM v_ledger GROUP BY build_label HAVING count(DISTINCT seed % 4) > 1")
def ledger_shard_residues(s, d):
    return ledger.shard_residues(v.v_ledger(s, d).withColumnRenamed("build_label", "source"), 4)


@query(f"WITH {v.V_LEDGER} SELECT seed FROM (SELECT CAST(unnest(range(0, (SELECT max(seed) + 1 FROM v_ledger))) AS BIGINT) AS seed) WHERE seed NOT IN (SELECT seed FROM v_ledger WHERE verdict = 'ok')")
def ledger_resume(s, d):
    rows = v.v_ledger(s, d)
    return ledger.todo(0, rows.agg(F.max("seed")).first()[0] + 1, rows)


@query(f"WITH {v.V_LEDGER} SELECT profile, count(*) AS n, count(*) FILTER (verdict = 'ok') AS ok, count(*) FILTER (verdict = 'undecided') AS undecided, count(*) FILTER (verdict = 'failed') AS failed, string_agg(DISTINCT config_hash, ',' ORDER BY config_hash) AS configs FROM v_ledger WHERE build_label <> '1-URGENT' GROUP BY profile")
def ledger_summary(s, d):
    return ledger.summary(v.v_ledger(s, d).filter("build_label <> '1-URGENT'"))


def _rank_sql(place: str, name: str) -> str:
    return f"WITH {v.V_SAMPLES}, r AS (SELECT *, row_number() OVER (PARTITION BY workload ORDER BY latency_ns) - 1 AS i, count(*) OVER (PARTITION BY workload) AS n FROM v_samples) SELECT workload, latency_ns AS {name} FROM r WHERE i = {place}"


@query(_rank_sql("((n - 1) * 99) // 100", "p99"))
def samples_floor_p99(s, d):
    return quantiles.floor_index(v.v_samples(s, d), ["workload"], "latency_ns", 99, 100, "p99")


@query(_rank_sql("greatest(0, CAST(ceil(n * 95 / 100) AS BIGINT) - 1)", "p95"))
def samples_nearest_p95(s, d):
    return quantiles.nearest_rank(v.v_samples(s, d), ["workload"], "latency_ns", 95, "p95")


@query(f"WITH {v.V_SAMPLES}, r AS (SELECT *, row_number() OVER (PARTITION BY workload ORDER BY latency_ns) - 1 AS i, count(*) OVER (PARTITION BY workload) AS n FROM v_samples), b AS (SELECT CAST(range AS INTEGER) AS bucket FROM range(0, 16)) SELECT workload, bucket, latency_ns FROM r, b WHERE i = least(n - 1, (bucket * n) // 16)")
def samples_buckets(s, d):
    return quantiles.buckets(v.v_samples(s, d), ["workload"], "latency_ns")


@query(f"WITH {v.V_SAMPLES}, r AS (SELECT *, row_number() OVER (PARTITION BY workload ORDER BY latency_ns) - 1 AS i, count(*) OVER (PARTITION BY workload) AS n FROM v_samples), p AS (SELECT workload, latency_ns AS p99 FROM r WHERE i = ((n - 1) * 99) // 100) SELECT workload, count(*) FILTER (latency_ns > p99) AS tail FROM v_samples JOIN p USING (workload) GROUP BY workload")
def samples_tail(s, d):
    rows = v.v_samples(s, d)
    p = quantiles.floor_index(rows, ["workload"], "latency_ns", 99, 100, "p99")
    return rows.join(p, "workload").groupBy("workload").agg(F.count_if(F.col("latency_ns") > F.col("p99")).alias("tail"))


@query(f"WITH {v.V_SAMPLES} SELECT workload, count(*) AS ops, CAST(sum(latency_ns) AS BIGINT) AS elapsed, CAST(count(*)::HUGEINT * 1000000000 // sum(latency_ns) AS BIGINT) AS ops_s FROM v_samples GROUP BY workload")
def samples_throughput(s, d):
    rows = v.v_samples(s, d).groupBy("workload").agg(F.count("*").alias("ops"), F.sum("latency_ns").cast("bigint").alias("elapsed"))
    return rows.withColumn("ops_s", ledger.throughput(F.col("ops"), F.col("elapsed")))


@query(f"WITH {v.V_SAMPLES}, r AS (SELECT *, (row_number() OVER (PARTITION BY workload ORDER BY l_orderkey, l_linenumber) - 1) % 2 AS fit FROM v_samples), m AS (SELECT workload, min(latency_ns) FILTER (fit = 0) AS measured, min(latency_ns) FILTER (fit = 1) AS modelled FROM r GROUP BY workload) SELECT workload, measured, modelled, modelled - measured AS residual FROM m")
def samples_residual(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("workload").orderBy("l_orderkey", "l_linenumber")
    rows = v.v_samples(s, d).withColumn("fit", (F.row_number().over(w) - 1) % 2)
    m = rows.groupBy("workload").agg(F.min(F.when(F.col("fit") == 0, F.col("latency_ns"))).alias("measured"), F.min(F.when(F.col("fit") == 1, F.col("latency_ns"))).alias("modelled"))
    return m.withColumn("residual", F.col("modelled") - F.col("measured"))


@query(f"WITH {v.V_LEDGER} SELECT profile, count(*) AS runs, count(*) FILTER (verdict = 'failed') AS bugs, CAST(count(*)::HUGEINT * 1000000000000 // sum(events * 1000000) AS BIGINT) AS milli_runs_s, CAST(CAST(count(*) FILTER (verdict = 'failed')::HUGEINT * 3600000000000000 // sum(events * 1000000) AS BIGINT) // 4 AS BIGINT) AS milli_bugs_cpu_hour FROM v_ledger GROUP BY profile")
def ledger_rates(s, d):
    return ledger.rates(v.v_ledger(s, d).withColumn("elapsed_ns", F.col("events") * 1_000_000), ["profile"], cpus=4)


@query(f"WITH {v.V_LEDGER} SELECT profile, seed FROM v_ledger WHERE events % 3 <> 0 AND build_label <> '1-URGENT'")
def ledger_claim_eligible(s, d):
    rows = v.v_ledger(s, d).withColumn("synthetic", F.when(F.col("events") % 3 == 0, True)).withColumn("build_label", F.when(F.col("build_label") == "1-URGENT", "dev").otherwise(F.col("build_label")))
    return ledger.claim_eligible(rows).select("profile", "seed")


@query("SELECT count(*) AS rows, CAST(sum(strlen(p_name) + strlen(p_type) + 16) AS BIGINT) AS bytes FROM part")
def kv_logical_bytes(s, d):
    return ledger.logical_bytes(v.read(s, d, "part").select(F.col("p_name").alias("key"), F.col("p_type").alias("value")), 16)


# ---- HX: traces


@query(f"""WITH {v.V_TRACE}, t AS (SELECT seq AS pos, seq + seq // 97 - CASE WHEN seq % 211 = 210 THEN 2 ELSE 0 END AS seq, CASE WHEN seq % 101 = 100 THEN time_us - 1000000000000 ELSE time_us END AS time_us FROM v_trace),
x AS (SELECT pos - 1 AS "at", lag(seq) OVER (ORDER BY pos) AS a, seq AS b, lag(time_us) OVER (ORDER BY pos) AS ta, time_us AS tb FROM t)
SELECT 'trace_sequence' AS name, "at", concat(a, ' followed by ', b) AS detail FROM x WHERE b <> a + 1 UNION ALL SELECT 'trace_time_order', "at", concat(ta, 'us followed by ', tb, 'us') FROM x WHERE tb < ta""")
def trace_invariants(s, d):
    """Gaps, repeated numbers and steps back in time, planted in the order in which the events were read."""
    seq = F.col("seq") + F.expr("seq div 97") - F.when(F.col("seq") % 211 == 210, 2).otherwise(0)
    back = F.when(F.col("seq") % 101 == 100, F.col("time_us") - 1_000_000_000_000).otherwise(F.col("time_us"))
    return trace.invariants(v.v_trace(s, d).select(F.col("seq").alias("pos"), seq.alias("seq"), back.alias("time_us")))


@query(f"WITH {v.V_TRACE} SELECT seq, kind FROM v_trace WHERE node = 2 AND kind IN ('error', 'click') AND time_us >= 1704500000000000 AND time_us <= 1705900000000000 AND contains(payload, '1')")
def trace_filter(s, d):
    return trace.select(v.v_trace(s, d), 2, ["error", "click"], 1704500000000000, 1705900000000000, "1").select("seq", "kind")


@query(f"WITH {v.V_TRACE} SELECT 'kind' AS dimension, kind AS value, count(*) AS n FROM v_trace GROUP BY kind UNION ALL SELECT 'node', CAST(node AS VARCHAR), count(*) FROM v_trace GROUP BY node")
def trace_stats(s, d):
    return trace.stats(v.v_trace(s, d))


@query(f"WITH {v.V_TRACE}, c AS (SELECT time_us // 3600000000 AS time_us, count(*) AS n FROM v_trace GROUP BY 1) SELECT time_us, n FROM c ORDER BY n DESC, time_us DESC LIMIT 1")
def trace_busiest_hour(s, d):
    return trace.busiest(v.v_trace(s, d).withColumn("time_us", F.expr("time_us div 3600000000")))


@query(f"WITH {v.V_TRACE} SELECT seq, kind FROM v_trace ORDER BY seq DESC LIMIT 25")
def trace_tail(s, d):
    return trace.tail(v.v_trace(s, d), 25).select("seq", "kind")


@query(f"WITH {v.V_TRACE}, p AS (SELECT seq, sum(octet_length(encode(payload))) OVER (ORDER BY seq) AS held FROM (SELECT * FROM v_trace WHERE seq >= 100 ORDER BY seq LIMIT 64)) SELECT seq, CAST(held AS BIGINT) AS held FROM p WHERE held <= 400")
def trace_page(s, d):
    return trace.page(v.v_trace(s, d), 100, 64, 400).select("seq", "held")


@query(f"WITH {v.V_TRACE} SELECT seq AS pos, 'node' AS field, CAST(node AS VARCHAR) AS left_value, CAST(node + 1 AS VARCHAR) AS right_value FROM v_trace WHERE seq % 613 = 612 ORDER BY seq LIMIT 1")
def trace_diff(s, d):
    a = v.v_trace(s, d).withColumn("pos", F.col("seq"))
    return trace.first_difference(a, a.withColumn("node", F.when(F.col("seq") % 613 == 612, F.col("node") + 1).otherwise(F.col("node"))))


@query(f"WITH {v.V_TRACE}, x AS (SELECT seq, kind AS a, lead(kind) OVER (ORDER BY seq) AS b, lead(kind, 2) OVER (ORDER BY seq) AS c FROM v_trace), g AS (SELECT a AS gram, seq FROM x UNION ALL SELECT a || '>' || b, seq FROM x WHERE b IS NOT NULL UNION ALL SELECT a || '>' || b || '>' || c, seq FROM x WHERE c IS NOT NULL) SELECT gram, min(seq) AS first_at, count(*) AS n FROM g GROUP BY gram")
def trace_ngrams(s, d):
    return trace.ngrams(v.v_trace(s, d))


@query(f"WITH {v.V_TRACE}, g AS (SELECT DISTINCT node AS run_id, kind || '>' || lead(kind) OVER (ORDER BY seq) AS gram FROM v_trace), f AS (SELECT gram, min(run_id) AS run_id FROM g WHERE gram IS NOT NULL GROUP BY gram) SELECT run_id, count(*) AS new_grams FROM f GROUP BY run_id")
def trace_novelty(s, d):
    t = v.v_trace(s, d)
    two = t.join(t.select((F.col("seq") - 1).alias("seq"), F.col("kind").alias("k2")), "seq").select(F.col("node").alias("run_id"), F.concat_ws(">", "kind", "k2").alias("gram"))
    return trace.novelty(two.distinct())


@query(f"WITH {v.V_TRACE}, b AS (SELECT unnest(['signup','purchase','error','view','click','timeout']) AS beacon) SELECT beacon, count(kind) AS hits FROM b LEFT JOIN v_trace ON kind = beacon GROUP BY beacon")
def trace_beacons(s, d):
    return trace.beacons(v.v_trace(s, d))


@query("SELECT 'timeout' AS beacon")
def trace_missing_beacons(s, d):
    return trace.missing_beacons(v.v_trace(s, d))


@query(f"WITH {v.V_TRACE} SELECT seq, CASE WHEN seq % 3 = 0 THEN '0x' || lower(hex(encode(substring(chr(233) || payload, 1, 5)))) || CASE WHEN length(payload) > 4 THEN chr(8230) ELSE '' END ELSE substring(payload, 1, 6) || CASE WHEN length(payload) > 6 THEN chr(8230) ELSE '' END END AS shown FROM v_trace")
def trace_payload_display(s, d):
    text = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("\u00e9"), F.col("payload"))).otherwise(F.col("payload"))
    return v.v_trace(s, d).select("seq", scalars.display_payload(F.encode(text, "UTF-8"), 6).alias("shown"))


@query(f"WITH {v.V_TRACE} SELECT seq, time_us, node, kind FROM v_trace WHERE node IN (SELECT DISTINCT node FROM v_trace ORDER BY node LIMIT 3) ORDER BY seq LIMIT 40")
def trace_diagram_rows(s, d):
    return trace.diagram_rows(v.v_trace(s, d), 3, 40)


@query(f"WITH {v.V_TRACE}, e AS (SELECT event_id + 1 AS id, event_id AS ord, epoch_us(ts) AS invoke, CASE WHEN event_id % 5 <> 0 THEN epoch_us(ts) + 3600000000 END AS complete FROM events), b AS (SELECT min(invoke) AS a, coalesce(max(complete), min(invoke)) AS z FROM e WHERE id % 1000 IN (400, 401)) SELECT seq, kind FROM v_trace, b WHERE time_us BETWEEN a AND z AND kind IN ('signup', 'error')")
def trace_witness_window(s, d):
    """Telling events within the interval of some operations."""
    t = v.v_trace(s, d)
    ops = t.select((F.col("seq") + 1).alias("id"), F.col("seq").alias("ord"), F.col("time_us").alias("invoke"), F.when(F.col("seq") % 5 != 0, F.col("time_us") + 3_600_000_000).alias("complete"))
    ids = ops.filter("id % 1000 IN (400, 401)").select("id")
    return explain.window_events(t, explain.witnesses(ops, ids), "time_us", ("signup", "error")).select("seq", "kind")


# ---- HX: histories


def _history(s, d):
    h = v.v_history(s, d)
    t = lambda c: c.cast("string")
    none = lambda k: F.lit(None).cast(k)
    return h.select("id", F.col("client").cast("bigint").alias("client"), F.col("sequence").cast("bigint").alias("sequence"), "invoke", "complete", "kind", "key", F.when(F.col("kind") == "SET", t(F.col("id") % 5)).alias("value"), none("string").alias("expected"), F.when(F.col("complete").isNull(), "timeout").otherwise("ok").alias("outcome"), F.when((F.col("kind") == "GET") & (F.col("id") % 4 != 0), t(F.col("seen") % 6)).alias("out_value"), F.when(F.col("kind") == "INCR", F.col("seen")).alias("out_int"), none("bigint").alias("deadline"), F.when((F.col("kind") == "GET") & (F.col("id") % 9 == 0), "final").alias("probe"), none("bigint").alias("replica"), none("bigint").alias("committed_index"), none("bigint").alias("state_hash"))


_H = (
    v.V_HISTORY
    + """, h AS (SELECT id, client, sequence, invoke, complete, kind, key, CASE WHEN kind = 'SET' THEN CAST(id % 5 AS VARCHAR) END AS value,
  CASE WHEN complete IS NULL THEN 'timeout' ELSE 'ok' END AS outcome, CASE WHEN kind = 'GET' AND id % 4 <> 0 THEN CAST(seen % 6 AS VARCHAR) END AS out_value,
  CASE WHEN kind = 'INCR' THEN seen END AS out_int, CASE WHEN kind = 'GET' AND id % 9 = 0 THEN 'final' END AS probe FROM v_history),
  mu AS (SELECT * FROM h WHERE kind IN ('SET', 'DEL', 'INCR')), rd AS (SELECT * FROM h WHERE kind = 'GET' AND complete IS NOT NULL)"""
)
_QUIET = "NOT EXISTS (SELECT 1 FROM mu x WHERE x.key = r.key AND x.id <> w.id AND x.invoke <= r.complete AND (x.complete IS NULL OR x.complete >= w.invoke))"


@query(f"WITH {_H} SELECT w.id AS write_id, r.id AS read_id FROM mu w JOIN rd r ON r.key = w.key AND w.kind = 'DEL' AND w.complete < r.invoke WHERE r.probe IS NULL AND r.out_value IS NOT NULL AND {_QUIET}")
def history_resurrections(s, d):
    return history.resurrections(_history(s, d)).select(F.col("operation_ids")[0].alias("write_id"), F.col("operation_ids")[1].alias("read_id"))


@query(f"WITH {_H} SELECT w.id AS write_id, r.id AS read_id FROM mu w JOIN rd r ON r.key = w.key AND w.kind = 'SET' AND w.complete < r.invoke WHERE r.probe IS NULL AND r.out_value IS NOT NULL AND r.out_value <> w.value AND EXISTS (SELECT 1 FROM mu k WHERE k.kind = 'SET' AND k.key = r.key AND k.value = r.out_value AND k.complete < r.invoke) AND {_QUIET}")
def history_stale_reads(s, d):
    return history.stale_reads(_history(s, d)).select(F.col("operation_ids")[0].alias("write_id"), F.col("operation_ids")[1].alias("read_id"))


@query(f"WITH {_H} SELECT r.id AS read_id FROM rd r WHERE r.probe IS NULL AND r.out_value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM mu k WHERE k.kind = 'SET' AND k.complete IS NOT NULL AND k.key = r.key AND k.value = r.out_value AND k.invoke <= r.complete)")
def history_dirty_reads(s, d):
    return history.dirty_reads(_history(s, d)).select(F.col("operation_ids")[0].alias("read_id"))


@query(f"WITH {_H} SELECT a.id AS first_id, b.id AS second_id FROM mu a JOIN mu b ON a.key = b.key AND a.kind = 'INCR' AND b.kind = 'INCR' AND a.complete < b.invoke AND b.out_int < a.out_int AND b.complete IS NOT NULL WHERE NOT EXISTS (SELECT 1 FROM mu x WHERE x.key = a.key AND x.kind IN ('SET','DEL') AND x.complete IS NOT NULL AND x.invoke < b.invoke AND x.complete > a.complete)")
def history_non_monotonic_incr(s, d):
    return history.non_monotonic_increments(_history(s, d)).select(F.col("operation_ids")[0].alias("first_id"), F.col("operation_ids")[1].alias("second_id"))


@query(f"WITH {_H} SELECT w.id AS write_id, r.id AS read_id FROM mu w JOIN rd r ON r.key = w.key AND w.complete < r.invoke AND r.probe = 'final' WHERE (CASE w.kind WHEN 'SET' THEN w.value WHEN 'INCR' THEN CAST(w.out_int AS VARCHAR) END) IS DISTINCT FROM r.out_value AND {_QUIET}")
def history_acked_write_lost(s, d):
    return history.acked_writes_lost(_history(s, d)).select(F.col("operation_ids")[0].alias("write_id"), F.col("operation_ids")[1].alias("read_id"))


@query(f"WITH {_H} SELECT r.id, r.key FROM h r LEFT JOIN LATERAL (SELECT kind FROM h x WHERE x.key = r.key AND x.kind IN ('SET','DEL') AND x.complete IS NOT NULL AND (x.complete, x.id) < (coalesce(r.complete, r.invoke), r.id) ORDER BY x.complete DESC, x.id DESC LIMIT 1) l ON true WHERE r.kind = 'GET' AND r.out_value IS NOT NULL AND l.kind = 'DEL'")
def history_no_resurrection(s, d):
    return history.no_resurrection(_history(s, d))


@query(f"WITH {_H}, p AS (SELECT *, lag(complete) OVER (PARTITION BY client ORDER BY invoke, id) AS pc, row_number() OVER (PARTITION BY client ORDER BY invoke, id) AS n FROM h) SELECT client, count(*) AS operations, bool_and(complete IS NOT NULL AND probe IS NULL AND (n = 1 OR coalesce(pc < invoke, false))) AS eligible FROM p GROUP BY client")
def history_clients(s, d):
    return history.clients(_history(s, d))


@query(f"WITH {_H}, o AS (SELECT id, client, row_number() OVER (ORDER BY id) AS n FROM h WHERE complete IS NULL) SELECT h.id, coalesce((SELECT max(client) FROM h) + (SELECT max(o.n) FROM o WHERE o.client = h.client AND o.id < h.id), h.client) AS process FROM h")
def history_export_processes(s, d):
    return history.export_processes(_history(s, d))


def _quick_history(s, d):
    """Complete, short operations of clients that wait for their answers."""
    from pyspark.sql import Window

    h = _history(s, d).filter("probe IS NULL AND complete IS NOT NULL")
    last = F.lead("invoke").over(Window.partitionBy("client").orderBy("invoke", "id"))
    return h.withColumn("complete", F.least(F.col("complete"), F.coalesce(last - 1, F.col("complete")))).filter("complete >= invoke").withColumn("sequence", F.when(F.col("id") % 101 == 0, F.lit(0)).otherwise(F.col("sequence")).cast("bigint"))


_QH = _H + ", q0 AS (SELECT *, lead(invoke) OVER (PARTITION BY client ORDER BY invoke, id) AS nx FROM h WHERE probe IS NULL AND complete IS NOT NULL), q AS (SELECT id, client, CASE WHEN id % 101 = 0 THEN 0 ELSE sequence END AS sequence, invoke, least(complete, coalesce(nx - 1, complete)) AS complete, kind, key, value, out_value, out_int FROM q0 WHERE least(complete, coalesce(nx - 1, complete)) >= invoke)"


@query(f"""WITH {_QH}, m AS (SELECT * FROM q WHERE kind IN ('SET','DEL','INCR')), pr AS (SELECT *, lag(id) OVER w AS pid, lag(kind) OVER w AS pk, lag(sequence) OVER w AS ps FROM q WINDOW w AS (PARTITION BY client ORDER BY invoke, id)),
rr AS (SELECT *, lag(id) OVER w AS pid, lag(key) OVER w AS pkey, lag(out_value) OVER w AS pv, lag(invoke) OVER w AS pi FROM q WHERE kind = 'GET' WINDOW w AS (PARTITION BY client ORDER BY invoke, id))
SELECT client, CASE WHEN pk = 'GET' AND kind IN ('SET','DEL','INCR') THEN 'writes-follow-reads' ELSE 'monotonic-writes' END AS guarantee, pid AS first_id, id AS second_id FROM pr WHERE ps > sequence
UNION ALL SELECT w.client, 'read-your-writes', w.id, r.id FROM m w JOIN q r ON r.kind = 'GET' AND r.client = w.client AND r.key = w.key AND w.complete < r.invoke WHERE (CASE w.kind WHEN 'SET' THEN w.value WHEN 'INCR' THEN CAST(w.out_int AS VARCHAR) END) IS DISTINCT FROM r.out_value AND NOT EXISTS (SELECT 1 FROM m x WHERE x.key = r.key AND x.id <> w.id AND x.invoke <= r.complete AND x.complete >= w.invoke)
UNION ALL SELECT client, 'monotonic-reads', pid, id FROM rr WHERE pid IS NOT NULL AND pkey = key AND pv IS DISTINCT FROM out_value AND NOT EXISTS (SELECT 1 FROM m x WHERE x.key = rr.key AND x.invoke <= rr.complete AND x.complete >= rr.pi)""")
def history_session_violations(s, d):
    return history.session_violations(_quick_history(s, d)).select("client", "guarantee", F.col("operation_ids")[0].alias("first_id"), F.col("operation_ids")[1].alias("second_id"))


_PROBED = """, rp AS (SELECT id, id AS ord, client % 3 AS replica, id // 40 AS committed_index, CASE WHEN id % 23 = 0 THEN 2 ELSE 1 END AS state_hash FROM h WHERE kind = 'GET')"""


@query(f"WITH {_H}{_PROBED} SELECT a.id AS first_id, b.id AS second_id FROM rp a JOIN rp b ON a.committed_index = b.committed_index AND a.replica <> b.replica AND a.state_hash <> b.state_hash AND a.ord < b.ord")
def history_replica_divergence(s, d):
    i = F.col("id")
    rows = _history(s, d).filter("kind = 'GET'").withColumn("probe", F.lit("replica")).withColumn("replica", F.col("client") % 3)
    rows = rows.withColumn("committed_index", F.expr("id div 40")).withColumn("state_hash", F.when(i % 23 == 0, 2).otherwise(1).cast("bigint")).withColumn("ord", i)
    return history.replica_divergence(rows).select(F.col("operation_ids")[0].alias("first_id"), F.col("operation_ids")[1].alias("second_id"))


_CAS = """, c AS (SELECT id, key, invoke, complete, CAST(id % 11 AS VARCHAR) AS expected, CAST(id % 13 AS VARCHAR) AS value FROM h WHERE kind = 'INCR' AND complete IS NOT NULL)"""


@query(f"WITH {_H}{_CAS} SELECT a.id AS first_id, b.id AS second_id, r.id AS read_id FROM c a JOIN c b ON a.key = b.key AND a.expected = b.expected AND a.id < b.id AND a.value <> b.value AND (a.complete < b.invoke OR b.complete < a.invoke) JOIN h r ON r.key = a.key AND r.probe = 'final' AND r.out_value IS NOT NULL AND greatest(a.complete, b.complete) < r.invoke AND r.out_value IN (a.value, b.value) WHERE a.id % 3 = 0")
def history_lost_updates(s, d):
    """Increments taken as compare-and-sets of planted values; those whose first write has an id divisible by three."""
    h = _history(s, d)
    i, is_cas = F.col("id"), (F.col("kind") == "INCR") & F.col("complete").isNotNull()
    t = lambda c: c.cast("string")
    rows = h.withColumn("expected", F.when(is_cas, t(i % 11))).withColumn("value", F.when(is_cas, t(i % 13)).otherwise(F.col("value"))).withColumn("kind", F.when(is_cas, "CAS").otherwise(F.col("kind")))
    ids = F.col("operation_ids")
    return history.lost_updates(rows).filter(ids[0] % 3 == 0).select(ids[0].alias("first_id"), ids[1].alias("second_id"), ids[2].alias("read_id"))


@query(f"WITH {_H}, i AS (SELECT id, key || '-' || (id % 400) AS key, client, id // 2 AS sequence, complete, invoke FROM h WHERE kind = 'INCR' AND complete IS NOT NULL), p AS (SELECT id, key || '-' || (id % 400) AS key, invoke FROM h WHERE kind = 'GET' AND complete IS NOT NULL), j AS (SELECT p.key, p.id AS p, list_sort(list(i.id)) AS ids, count(*) AS n, count(DISTINCT (client % 2, sequence // 800)) AS d FROM i JOIN p ON i.key = p.key AND i.complete < p.invoke GROUP BY p.key, p.id) SELECT key, p, n FROM j WHERE d < n")
def history_duplicate_applies(s, d):
    """Increments whose requests repeat, on many keys, against final probes of a large value."""
    h, i = _history(s, d), F.col("id")
    key = F.concat_ws("-", "key", (i % 400).cast("string"))
    incr = h.filter("kind = 'INCR' AND complete IS NOT NULL").withColumn("client", F.col("client") % 2).withColumn("sequence", F.expr("(id div 2) div 800"))
    probes = h.filter("kind = 'GET' AND complete IS NOT NULL").withColumn("probe", F.lit("final")).withColumn("out_value", F.lit("1000000"))
    found = history.duplicate_applies(incr.unionByName(probes).withColumn("key", key))
    ids = F.col("operation_ids")
    named = probes.select(i.alias("p"), key.alias("key"))
    return found.select(F.element_at(ids, -1).alias("p"), (F.size(ids) - 1).cast("bigint").alias("n")).join(named, "p").select("key", "p", "n")


@query(f"WITH {_H}, r AS (SELECT id, out_value FROM h WHERE kind = 'GET'), t AS (SELECT id, id + x AS ord, CASE WHEN id % 5 = 0 THEN 'z' ELSE out_value END AS value FROM r, (SELECT unnest([0, 1]) AS x) WHERE id % 7 <> 0) SELECT r.id, CASE WHEN t.id IS NULL THEN 'undecided' WHEN t.value IS NOT DISTINCT FROM r.out_value THEN 'ok' ELSE 'stale' END AS verdict FROM r LEFT JOIN (SELECT id, arg_min_null(value, ord) AS value FROM t GROUP BY id) t USING (id)")
def history_stale_evidence(s, d):
    reads = _history(s, d).filter("kind = 'GET'").select("id", "out_value")
    seen = reads.filter("id % 7 <> 0").withColumn("ord", F.explode(F.array(F.col("id"), F.col("id") + 1)))
    return history.stale_read_evidence(reads, seen.select("id", "ord", F.when(F.col("id") % 5 == 0, "z").otherwise(F.col("out_value")).alias("value")))


@query("SELECT o_orderkey AS run_id, NOT o_custkey % 2 = 0 OR (o_custkey % 3 = 0 AND o_custkey % 5 <> 0) AS live FROM orders")
def history_liveness(s, d):
    k = F.col("o_custkey")
    runs = v.read(s, d, "orders").select(F.col("o_orderkey").alias("run_id"), (k % 2 == 0).alias("survivable"), (k % 3 == 0).alias("leader_seen"), (k % 5 != 0).alias("probe_committed"))
    return history.liveness(runs)


@query()
def history_linearizability(s, d):
    """A verdict for each key over its whole history."""
    return linearize.check(_history(s, d))


# ---- membership and log invariants over derived node rows

_N = "n AS (SELECT l_suppkey % 5 AS node, l_orderkey AS idx, l_orderkey // 100 AS term, CASE WHEN l_partkey % 211 = 0 THEN 'x' ELSE 'y' END AS payload FROM lineitem)"


def _entries(s, d):
    li = v.read(s, d, "lineitem")
    return li.select((F.col("l_suppkey") % 5).alias("node"), F.col("l_orderkey").alias("index"), F.expr("l_orderkey div 100").alias("term"), F.when(F.col("l_partkey") % 211 == 0, "x").otherwise("y").alias("payload"))


@query(f"WITH {_N} SELECT idx AS index, term, count(DISTINCT payload) AS variants FROM n GROUP BY idx, term HAVING count(DISTINCT payload) > 1")
def raft_log_matching(s, d):
    return membership.log_matching(_entries(s, d))


@query(f"WITH {_N} SELECT term, count(DISTINCT node) AS leaders FROM n WHERE payload = 'x' GROUP BY term HAVING count(DISTINCT node) > 1")
def raft_election_safety(s, d):
    return membership.election_safety(_entries(s, d).filter("payload = 'x'"))


@query(f"WITH {_N}, m AS (SELECT term AS cluster, node, max(idx) AS match FROM n GROUP BY term, node), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY match DESC, node) AS r, count(*) OVER (PARTITION BY cluster) AS c FROM m) SELECT cluster, match AS commit FROM r WHERE r = c // 2 + 1")
def raft_commit_index(s, d):
    m = _entries(s, d).groupBy(F.col("term").alias("cluster"), "node").agg(F.max("index").alias("match"))
    return membership.commit_index(m)


@query(f"WITH {_N}, x AS (SELECT DISTINCT node, idx FROM n), f AS (SELECT *, lag(idx) OVER (PARTITION BY node ORDER BY idx) AS p FROM x) SELECT node, idx AS index FROM f WHERE p IS NOT NULL AND p <> idx - 1")
def raft_log_gaps(s, d):
    return membership.log_gaps(_entries(s, d).select("node", "index").distinct())


@query(f"WITH {_N} SELECT DISTINCT idx AS index, term FROM n WHERE node = 1 EXCEPT SELECT idx, term FROM n WHERE node = 2")
def raft_leader_completeness(s, d):
    e = _entries(s, d)
    return membership.leader_completeness(e.filter("node = 1").select("index", "term").distinct(), e.filter("node = 2"))


@query(f"WITH {_N} SELECT idx AS log_index, node, CASE WHEN payload = 'x' THEN 'voter' ELSE 'learner' END AS role, lead(idx) OVER (PARTITION BY node ORDER BY idx) AS to_index FROM (SELECT node, idx, max(payload) AS payload FROM n GROUP BY node, idx)")
def membership_intervals(s, d):
    c = _entries(s, d).groupBy("node", "index").agg(F.max("payload").alias("p")).select(F.col("index").alias("log_index"), "node", F.when(F.col("p") == "x", "voter").otherwise("learner").alias("role"))
    return membership.intervals(c).withColumnRenamed("from_index", "log_index")


@query("SELECT o_orderkey, list_sort(list_distinct([o_custkey % 7, o_custkey % 5, o_custkey % 3])) AS members, list_sort(list_filter(list_distinct([o_custkey % 7, o_custkey % 5]), lambda x: x <> o_custkey % 3)) AS gone FROM orders")
def membership_sets(s, d):
    o, k = v.read(s, d, "orders"), F.col("o_custkey")
    old, new = F.array(k % 7, k % 5), F.array(k % 3)
    return o.select("o_orderkey", membership.all_voters(old, new).alias("members"), membership.leaving(old, new).alias("gone"))


# ---- relational extension on the star schema

_CENTS = "CAST(round({} * 100) AS BIGINT)"


def _cents(c):
    return F.round(F.col(c) * 100).cast("bigint")


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS sum_qty, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS sum_cents, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def rel_pricing_summary(s, d):
    li = v.read(s, d, "lineitem").filter("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.round("l_quantity").cast("bigint")).alias("sum_qty"), F.sum(_cents("l_extendedprice")).alias("sum_cents"), F.count("*").alias("n"))


@query("SELECT n_name, count(*) AS orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name")
def rel_star_join(s, d):
    r = lambda t: v.read(s, d, t)
    asia = r("nation").join(r("region").filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = r("orders").join(r("customer"), F.col("c_custkey") == F.col("o_custkey")).join(asia, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("orders"), F.sum(_cents("o_totalprice")).alias("cents"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def rel_anti_join(s, d):
    return v.read(s, d, "customer").join(v.read(s, d, "orders").filter("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_discount > 0.05 AND l_quantity > 45)")
def rel_semi_join(s, d):
    li = v.read(s, d, "lineitem").filter("l_discount > 0.05 AND l_quantity > 45")
    return v.read(s, d, "supplier").join(li, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey")


@query("SELECT c_custkey, s_suppkey, s_nationkey FROM customer FULL JOIN supplier ON c_custkey + 5 = s_suppkey")
def rel_full_join(s, d):
    c, p = v.read(s, d, "customer"), v.read(s, d, "supplier")
    return c.join(p, F.col("c_custkey") + 5 == F.col("s_suppkey"), "full").select("c_custkey", "s_suppkey", "s_nationkey")


@query("SELECT r_name, n_name FROM nation RIGHT JOIN region ON n_regionkey = r_regionkey AND n_nationkey < 12")
def rel_right_join(s, d):
    n = v.read(s, d, "nation").filter("n_nationkey < 12")
    return n.join(v.read(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "right").select("r_name", "n_name")


@query("SELECT o_orderkey, CAST(count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW) AS BIGINT) AS near FROM orders")
def rel_range_frame(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rangeBetween(-1000, 0)
    return v.read(s, d, "orders").select("o_orderkey", F.count("*").over(w).alias("near"))


@query("SELECT o_custkey, len(list(DISTINCT o_orderstatus)) AS kinds, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY 1")
def rel_map_functions(s, d):
    per = v.read(s, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    held = per.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("m"))
    return held.select("o_custkey", F.size("m").cast("bigint").alias("kinds"), F.coalesce(F.try_element_at("m", F.lit("F")), F.lit(0)).cast("bigint").alias("f"))


@query("SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def rel_theta_join(s, d):
    a, b = v.read(s, d, "nation").alias("a"), v.read(s, d, "nation").alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("left_name"), F.col("b.n_name").alias("right_name"))


@query("WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events), r AS (SELECT event_id AS rid, user_id, epoch_us(ts) AS a, epoch_us(ts) + 86400000000 AS b FROM events WHERE event_type = 'signup') SELECT event_id, rid FROM e JOIN r ON e.user_id = r.user_id AND t >= a AND t < b")
def rel_interval_join(s, d):
    e = v.read(s, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    r = e.filter("event_type = 'signup'").select(F.col("event_id").alias("rid"), "user_id", F.col("t").alias("a"), (F.col("t") + 86_400_000_000).alias("b"))
    return relational.interval_join(e, r, ["user_id"], "t", "a", "b", 86_400_000_000).select("event_id", "rid")


@query("WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, event_id AS last_click FROM events WHERE event_type = 'click') SELECT e.event_id, r.last_click FROM e ASOF LEFT JOIN r ON e.user_id = r.user_id AND e.ts >= r.ts")
def rel_asof_join(s, d):
    e = v.read(s, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return relational.asof_join(e.filter("event_type = 'purchase'"), e.filter("event_type = 'click'").withColumn("last_click", F.col("event_id")), ["user_id"], "t", ["last_click"]).select("event_id", "last_click")


@query("SELECT o_orderpriority, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def rel_salted_join(s, d):
    big, small = v.read(s, d, "lineitem").select(F.col("l_orderkey").alias("k")), v.read(s, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority")
    return relational.salted_join(big, small, ["k"]).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def rel_cube(s, d):
    return v.read(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping("l_returnflag").cast("bigint").alias("g"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rel_rollup(s, d):
    return v.read(s, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey))")
def rel_grouping_sets(s, d):
    return v.read(s, d, "customer").groupingSets([["c_mktsegment"], ["c_nationkey"]], "c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def rel_top_per_group(s, d):
    return relational.top_per_group(v.read(s, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT o_orderkey, lag(o_orderkey) OVER w AS prev, lead(o_orderkey) OVER w AS next, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS moving, ntile(4) OVER w AS quarter FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def rel_window_frames(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return v.read(s, d, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("prev"), F.lead("o_orderkey").over(w).alias("next"), F.sum("o_orderkey").over(w.rowsBetween(-2, 0)).alias("moving"), F.ntile(4).over(w).cast("bigint").alias("quarter"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def rel_intersect(s, d):
    return v.read(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(v.read(s, d, "supplier").select("s_nationkey"))


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def rel_except_all(s, d):
    o = v.read(s, d, "orders")
    return o.filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k")).exceptAll(o.filter("o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def rel_pivot(s, d):
    p = v.read(s, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return p.select("o_orderpriority", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("F", "O", "P")])


@query("SELECT p_partkey, upper(substring(p_name, 1, 4)) AS head, length(p_type) AS len, replace(p_brand, '#', '-') AS brand, md5(p_name) AS digest, CAST(string_split(p_type, ' ')[1] AS VARCHAR) AS word FROM part")
def rel_string_functions(s, d):
    return v.read(s, d, "part").select("p_partkey", F.upper(F.substring("p_name", 1, 4)).alias("head"), F.length("p_type").cast("bigint").alias("len"), F.replace(F.col("p_brand"), F.lit("#"), F.lit("-")).alias("brand"), F.md5("p_name").alias("digest"), F.split("p_type", " ")[0].alias("word"))


@query("SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, quarter(o_orderdate) AS q, count(*) AS n, min(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE))) AS first_day FROM orders GROUP BY 1, 2, 3")
def rel_date_functions(s, d):
    o = v.read(s, d, "orders")
    big = lambda c: c.cast("bigint")
    return o.groupBy(big(F.year("o_orderdate")).alias("y"), big(F.month("o_orderdate")).alias("m"), big(F.quarter("o_orderdate")).alias("q")).agg(F.count("*").alias("n"), F.min(big(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")))).alias("first_day"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def rel_json_functions(s, d):
    return v.read(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")).filter("k IS NOT NULL")


@query("SELECT o_custkey, len(list(o_orderkey)) AS n, list_sort(list(DISTINCT o_orderpriority)) AS priorities, max(o_orderkey) AS newest FROM orders GROUP BY o_custkey")
def rel_array_functions(s, d):
    return v.read(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("o_orderpriority")).alias("priorities"), F.max("o_orderkey").alias("newest"))


@query("SELECT count(*) AS n, count(DISTINCT l_partkey) AS parts, CAST(sum(l_linenumber) AS BIGINT) AS lines, max(l_shipdate) AS last FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def rel_filtered_aggregate(s, d):
    return v.read(s, d, "lineitem").filter("l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24").agg(F.count("*").alias("n"), F.count_distinct("l_partkey").alias("parts"), F.sum("l_linenumber").alias("lines"), F.max("l_shipdate").alias("last"))


@query("WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events), n AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 1800000000 THEN 0 ELSE 1 END AS f FROM e), g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY t) AS s FROM n) SELECT user_id, min(t) AS start, max(t) AS \"end\", count(*) AS n FROM g GROUP BY user_id, s")
def rel_sessionise(s, d):
    e = v.read(s, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return relational.sessionise(e, "user_id", "t", 1_800_000_000)


# ---- streaming, drained to files: what the watermark, an hour behind the last event, has closed

_MARK = "(SELECT max(epoch_us(ts)) - 3600000000 FROM events)"


@query(f"SELECT epoch_us(date_trunc('day', ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING epoch_us(date_trunc('day', ts)) + 86400000000 <= {_MARK}")
def stream_tumbling(s, d):
    return windows.drain(windows.tumbling(windows.source(s, d)))


@query(f"SELECT epoch_us(date_trunc('day', ts) - INTERVAL (x) DAY) AS start_us, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS x) GROUP BY 1 HAVING start_us + 172800000000 <= {_MARK}")
def stream_sliding(s, d):
    return windows.drain(windows.sliding(windows.source(s, d)))


@query(f"WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events), n AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < 1800000000 THEN 0 ELSE 1 END AS f FROM e), g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY t) AS s FROM n) SELECT user_id, min(t) AS start_us, count(*) AS n FROM g GROUP BY user_id, s HAVING max(t) + 1800000000 <= {_MARK}")
def stream_sessions(s, d):
    return windows.drain(windows.sessions(windows.source(s, d)))


def _timed(s, d):
    """The events as a stream of writes: a SET lives k hours, a DEL ends it."""
    e = windows.source(s, d).withColumn("t_us", F.unix_micros("at")).withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    op = F.when(F.col("event_type") == "signup", "SET").when(F.col("event_type") == "error", "DEL").otherwise("GET")
    return e.select((F.col("event_id") + 1).alias("log_index"), F.concat(F.lit("k"), (F.col("user_id") % 500).cast("string")).alias("key"), op.alias("op"), (F.col("t_us") + F.col("k") * v.HOUR_US).alias("deadline_us"), "at")


@query(f"""WITH {v.V_LOG}, w AS (SELECT *, row_number() OVER (PARTITION BY client % 500 ORDER BY log_index DESC) AS r FROM v_log WHERE op IN ('SET', 'DEL'))
SELECT 'k' || CAST(client % 500 AS VARCHAR) AS key, log_index, t_us + k * {v.HOUR_US} AS deadline_us FROM w WHERE r = 1 AND op = 'SET' AND (t_us + k * {v.HOUR_US}) // 1000 <= {_MARK} // 1000""")
def stream_expirations(s, d):
    """Deadlines that pass by the log's own time, by timers; all events are one batch, so a key's last write decides."""
    return windows.drain(stateful.expirations(_timed(s, d)))


@query(f"WITH {v.V_LOG}, c AS (SELECT CAST(client % 2 AS INTEGER) AS namespace, client, max(t_us) * 1000 AS active FROM v_log GROUP BY client) SELECT namespace, client, 'idle' AS event, active + 1800000000000 AS at_ns FROM c WHERE (active + 1800000000000) // 1000000 <= (SELECT max(t_us) - 60000000 FROM v_log) // 1000")
def stream_idle_sessions(s, d):
    """Clients whose half hour without a request is over by the watermark."""
    e = windows.source(s, d)
    rows = e.select((F.col("user_id") % 2).cast("int").alias("namespace"), F.col("user_id").alias("client"), (F.col("event_id") + 1).alias("sequence"), (F.unix_micros("at") * 1000).alias("now_ns"), "at")
    return windows.drain(stateful.idle_sessions(rows)).filter("event = 'idle'")
