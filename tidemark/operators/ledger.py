"""Campaign ledgers: merge, coverage, shards, resume, receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["build_label", "config_hash", "profile", "seed"]


def merge(*ledgers: DataFrame) -> DataFrame:
    """The distinct rows of ledgers with equal columns."""
    out = ledgers[0]
    for other in ledgers[1:]:
        out = out.unionByName(other)
    return out.distinct()


def conflicts(ledger: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Keys with rows that differ."""
    rest = F.struct(*[c for c in ledger.columns if c not in key])
    return ledger.groupBy(*key).agg(F.count_distinct(rest).alias("variants")).filter("variants > 1")


def merge_or_fail(*ledgers: DataFrame) -> DataFrame:
    out = merge(*ledgers)
    if not conflicts(out).isEmpty():
        raise ValueError("ledgers conflict; conflicts() shows the keys")
    return out


def without_dev(ledger: DataFrame, allow_dev: bool = False) -> DataFrame:
    return ledger if allow_dev else ledger.filter("build_label <> 'dev'")


def stats(ledger: DataFrame, by: list[str]) -> DataFrame:
    return ledger.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct("build_label").alias("builds"), F.sum("events").cast("bigint").alias("events"))


def islands(ledger: DataFrame, by: list[str], seed: str = "seed") -> DataFrame:
    """Half-open ranges of consecutive seeds of each group. Seeds are dealt by blocks, so a long group spreads over tasks.

    A seed starts a range where its predecessor is missing and ends one where its successor is; the n-th start of a group
    meets the n-th end. Only range ends are numbered.
    """
    have = ledger.select(*by, seed).distinct()
    before = have.select(*by, (F.col(seed) + 1).alias(seed))
    after = have.select(*by, (F.col(seed) - 1).alias(seed))
    w = Window.partitionBy(*by).orderBy("at")
    lo = have.join(before, [*by, seed], "left_anti").select(*by, F.col(seed).alias("at")).withColumn("_n", F.row_number().over(w)).withColumnRenamed("at", "lo")
    hi = have.join(after, [*by, seed], "left_anti").select(*by, (F.col(seed) + 1).alias("at")).withColumn("_n", F.row_number().over(w)).withColumnRenamed("at", "hi")
    return lo.join(hi, [*by, "_n"]).drop("_n")


def coverage(ledger: DataFrame, start: int, end: int, seed: str = "seed") -> DataFrame:
    """(seed, sources) for the seeds of [start, end) that aren't there exactly once."""
    counts = ledger.filter((F.col(seed) >= start) & (F.col(seed) < end)).groupBy(seed).agg(F.count("*").alias("sources"))
    wanted = ledger.sparkSession.range(start, end).select(F.col("id").alias(seed))
    return wanted.join(counts, seed, "left").select(seed, F.coalesce("sources", F.lit(0)).alias("sources")).filter("sources <> 1")


def shard_residues(ledger: DataFrame, shards: int, source: str = "source", seed: str = "seed") -> DataFrame:
    """Sources whose seeds leave more than one residue: they aren't a shard."""
    return ledger.groupBy(source).agg(F.array_sort(F.collect_set(F.col(seed) % shards)).alias("residues")).filter("size(residues) > 1")


def shard_faults(ledger: DataFrame, start: int, end: int, shards: int, build: str, config_hash: str, source: str = "source") -> DataFrame:
    """(fault, source, seed) of what keeps a ledger of shards from proving that [start, end) was covered; no row is a proof.

    wrong build or config, a seed outside the range, a source with several residues, a residue with several sources, and
    seeds that are missing or there more than once.
    """
    none = lambda t: F.lit(None).cast(t)
    kind = ledger.schema[source].dataType
    rows = ledger.select(F.col(source).alias("source"), "seed", "build_label", "config_hash")
    row_fault = F.when(F.col("build_label") != build, "wrong build").when(F.col("config_hash") != config_hash, "wrong config").when((F.col("seed") < start) | (F.col("seed") >= end), "outside the range")
    bad = rows.select(row_fault.alias("fault"), "source", "seed").filter("fault IS NOT NULL")
    residues = shard_residues(rows, shards).select(F.lit("several residues").alias("fault"), "source", none("bigint").alias("seed"))
    owners = rows.select("source", (F.col("seed") % shards).alias("seed")).distinct().groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1")
    owners = owners.select(F.lit("several sources").alias("fault"), none(kind).alias("source"), "seed")
    wrong = coverage(rows, start, end).select(F.when(F.col("sources") == 0, "missing").otherwise("repeated").alias("fault"), none(kind).alias("source"), "seed")
    return bad.unionByName(residues).unionByName(owners).unionByName(wrong)


def todo(start: int, end: int, ledger: DataFrame, seed: str = "seed") -> DataFrame:
    """Seeds of [start, end) without an ok row: nothing else counts as done."""
    return ledger.sparkSession.range(start, end).select(F.col("id").alias(seed)).join(ledger.filter("verdict = 'ok'").select(seed), seed, "left_anti")


def summary(ledger: DataFrame) -> DataFrame:
    """One row a profile: rows, verdicts, and its config hashes joined in order."""
    return ledger.groupBy("profile").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "ok").alias("ok"), F.count_if(F.col("verdict") == "undecided").alias("undecided"), F.count_if(F.col("verdict") == "failed").alias("failed"), F.array_join(F.array_sort(F.collect_set("config_hash")), ",").alias("configs"))


def throughput(ops, elapsed_ns):
    """ops * 10^9 div elapsed, 0 for no time."""
    return F.coalesce(F.floor(F.try_divide(ops.cast("decimal(38,0)") * 1_000_000_000, F.nullif(elapsed_ns, F.lit(0)))).cast("bigint"), F.lit(0).cast("bigint"))


def breaches(footprints: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(owner, measure, peak, limit) where the sum of peaks of footprints(owner, measures...) passes its limit."""
    long = footprints.unpivot("owner", list(limits), "measure", "peak").groupBy("owner", "measure").agg(F.sum("peak").alias("peak"))
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col("measure")]
    return long.withColumn("most", limit).filter("peak > most")


def claim_eligible(artifacts: DataFrame, allow_dev: bool = False) -> DataFrame:
    """Artifacts that a claim may rest on: none that was made synthetically, and no development builds."""
    return without_dev(artifacts.filter(~F.coalesce(F.col("synthetic"), F.lit(False))), allow_dev)


def rates(runs: DataFrame, by: list[str], cpus: int = 1) -> DataFrame:
    """(by, runs, bugs, milli_runs_s, milli_bugs_cpu_hour) of runs(verdict, elapsed_ns): whole thousandths, null for no time."""
    per = runs.groupBy(*by).agg(F.count("*").alias("runs"), F.count_if(F.col("verdict") == "failed").alias("bugs"), F.sum(F.col("elapsed_ns").cast("decimal(38,0)")).alias("_ns"))  # a sum of longs needn't be one
    of = lambda n, scale: F.expr(f"cast(cast({n} as decimal(38,0)) * {scale} div nullif(_ns, 0) as bigint)")
    return per.select(*by, "runs", "bugs", of("runs", 10**12).alias("milli_runs_s"), of("bugs", f"{3600 * 10**12}").alias("_b")).withColumn("milli_bugs_cpu_hour", F.expr(f"_b div {cpus}")).drop("_b")


def logical_bytes(state: DataFrame, overhead: int = 0, most: int = 2**63 - 1) -> DataFrame:
    """(rows, bytes) that a state(key, value) is charged: lengths of keys and values and an overhead each, up to most."""
    size = F.coalesce(F.octet_length("key"), F.lit(0)) + F.coalesce(F.octet_length("value"), F.lit(0)) + overhead
    return state.agg(F.count("*").alias("rows"), F.least(F.coalesce(F.sum(size.cast("decimal(38,0)")), F.lit(0)), F.lit(most)).cast("bigint").alias("bytes"))
