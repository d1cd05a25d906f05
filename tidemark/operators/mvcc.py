"""Multi-version reads and compaction analytics over versions(user_key, sequence, kind PUT/DEL, value) and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

L0_TRIGGER, LEVEL1_BYTES, FANOUT = 4, 8 << 20, 10
OUTPUT_BYTES, ENTRY_OVERHEAD = 8 << 20, 32


def latest(versions: DataFrame, watermark: int | None = None) -> DataFrame:
    """The newest version of each key at or below a watermark, tombstones included; combined before the shuffle."""
    rows = versions if watermark is None else versions.filter(F.col("sequence") <= watermark)
    return rows.groupBy("user_key").agg(F.max_by(F.struct("sequence", "kind", "value"), "sequence").alias("v")).select("user_key", "v.*")


def snapshot_get(versions: DataFrame, watermark: int | None = None) -> DataFrame:
    """Visible pairs at a snapshot: the newest version if it isn't a tombstone."""
    return latest(versions, watermark).filter("kind = 'PUT'")


def scan(versions: DataFrame, watermark: int | None = None, start=None, end=None, limit: int | None = None) -> DataFrame:
    """Ordered visible pairs with start <= key < end: versions are merged, then tombstones dropped, then limited."""
    rows = versions
    if start is not None:
        rows = rows.filter(F.col("user_key") >= F.lit(start))
    if end is not None:
        rows = rows.filter(F.col("user_key") < F.lit(end))
    out = snapshot_get(rows, watermark).orderBy("user_key")
    return out if limit is None else out.limit(limit)


def compaction_keep(versions: DataFrame, snapshots: list[int]) -> DataFrame:
    """Versions that compaction must keep: each key's newest, and its newest at or below each live snapshot."""
    w = Window.partitionBy("user_key").orderBy("sequence")
    rows = versions.withColumn("_next", F.lead("sequence").over(w))
    seen = [((F.col("sequence") <= s) & (F.col("_next") > s)) for s in snapshots]
    keep = F.col("_next").isNull()
    for s in seen:
        keep = keep | s
    return rows.filter(keep).drop("_next")


def droppable_tombstones(versions: DataFrame, files: DataFrame, oldest_snapshot: int, bottom_level: int) -> DataFrame:
    """Tombstones older than the oldest snapshot, in the bottom level, that no file of a deeper level overlaps."""
    own = versions.filter("kind = 'DEL'").filter(F.col("sequence") < oldest_snapshot).join(files.filter(F.col("level") == bottom_level).select("file_no"), "file_no", "left_semi")
    below = files.filter(F.col("level") > bottom_level).select("smallest", "largest")
    ends = below.agg(F.min("smallest").alias("a"), F.max("largest").alias("b")).first()
    if ends["a"] is None:
        return own
    # keys (integers) meet the ranges of their bin alone; a range is in 1024 bins at most
    width = max(1, -(-(ends["b"] - ends["a"] + 1) // 1024))
    bin_of = lambda c: F.floor((F.col(c) - ends["a"]) / width)
    spread = below.withColumn("_bin", F.explode(F.sequence(bin_of("smallest"), bin_of("largest")))).groupBy("_bin", "smallest").agg(F.max("largest").alias("largest"))
    own = own.withColumn("_bin", bin_of("user_key"))
    return own.join(spread, (own["_bin"] == spread["_bin"]) & (F.col("user_key") >= F.col("smallest")) & (F.col("user_key") <= F.col("largest")), "left_anti").drop("_bin")


def compaction_scores(files: DataFrame) -> DataFrame:
    """(level, numerator, denominator, victim): level 0 by file count against the trigger, others by bytes against their target."""
    per = files.groupBy("level").agg(F.count("*").alias("files"), F.sum("file_size").cast("bigint").alias("bytes"), F.min("file_no").alias("victim"))
    target = F.expr(f"cast({LEVEL1_BYTES} * power({FANOUT}, level - 1) as bigint)")
    return per.select("level", F.when(F.col("level") == 0, F.col("files")).otherwise(F.col("bytes")).alias("numerator"), F.when(F.col("level") == 0, F.lit(L0_TRIGGER).cast("bigint")).otherwise(target).alias("denominator"), "victim")


def select_level(scores: DataFrame) -> DataFrame:
    """The level with the highest ratio of at least one, ties to the lower level; ratios are compared exactly.

    They are ordered by their whole part and 18 digits of long division: ratios that differ by less have denominators
    beyond 10^9.
    """
    n, d, step = "cast(numerator as decimal(20,0))", "cast(denominator as decimal(20,0))", "1000000000"
    rest = f"({n} % {d}) * {step}"
    digits = [f"{n} div {d}", f"({rest}) div {d}", f"((({rest}) % {d}) * {step}) div {d}"]
    return scores.filter("numerator >= denominator").orderBy(*[F.expr(x).desc() for x in digits], "level").limit(1)


def overlap_closure(files: DataFrame, level: int, smallest: int, largest: int) -> DataFrame:
    """Files of a level and the next that a range overlaps, grown until no file widens the range; a loop over two numbers."""
    part = files.filter(F.col("level").isin(level, level + 1))
    while True:
        hit = part.filter((F.col("smallest") <= largest) & (F.col("largest") >= smallest))
        ends = hit.agg(F.min("smallest").alias("a"), F.max("largest").alias("b")).first()
        if ends["a"] is None or (ends["a"] >= smallest and ends["b"] <= largest):
            return hit
        smallest, largest = min(smallest, ends["a"]), max(largest, ends["b"])


def overlapping_files(files: DataFrame) -> DataFrame:
    """Files of a level above 0 whose range starts at or before the largest key of an earlier one: one window, no pairs."""
    w = Window.partitionBy("level").orderBy("smallest", "file_no").rowsBetween(Window.unboundedPreceding, -1)
    return files.filter("level > 0").withColumn("reached", F.max("largest").over(w)).filter("smallest <= reached")


def split_output(entries: DataFrame, most_bytes: int = OUTPUT_BYTES, group: str = "level") -> DataFrame:
    """(group, user_key, bytes, output): the output file that each key's entries(group, user_key, sequence, size) go to.

    Entries go in order of key, then of newest sequence, and weigh 32 bytes more than their size. An output closes before
    the first entry of a key that would take it past most_bytes; the versions of a key stay together, so a key of very
    many may pass it alone. Only a key's first entry and its total matter: the greedy rule folds over those, a group at a
    time, in a stream of batches of sorted keys.
    """
    weight = F.col("size") + ENTRY_OVERHEAD
    keys = entries.groupBy(group, "user_key").agg(F.sum(weight).cast("bigint").alias("bytes"), F.max_by(weight, "sequence").cast("bigint").alias("_first"))

    def fold(batches):
        import pyarrow as pa

        name, held, n = object(), 0, 0
        for batch in batches:
            out = []
            for own, total, first in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if own != name:
                    name, held, n = own, 0, 0
                elif held + first > most_bytes:
                    held, n = 0, n + 1
                held += total
                out.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.int32())], [group, "user_key", "bytes", "output"])

    kind = entries.schema[group].dataType.simpleString()
    key = entries.schema["user_key"].dataType.simpleString()
    rows = keys.select(group, "user_key", "bytes", "_first").repartition(group).sortWithinPartitions(group, "user_key")
    return rows.mapInArrow(fold, f"{group} {kind}, user_key {key}, bytes bigint, output int")


def level_metrics(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.count("*").alias("files"), F.sum("file_size").cast("bigint").alias("bytes"))


def replay_manifest(edits: DataFrame) -> DataFrame:
    """Live files after edits(ord, action ADD/REMOVE, file_no, level): the last edit of a file decides."""
    return edits.groupBy("file_no").agg(F.max_by(F.struct("action", "level"), "ord").alias("e")).filter("e.action = 'ADD'").select("file_no", "e.level")


def manifest_faults(edits: DataFrame, next_file_no: int | None = None) -> DataFrame:
    """(ord, file_no, fault) of edits(ord, action, file_no, level[, smallest, largest]) that a manifest must refuse.

    Adding a file that is live, or whose number isn't below next_file_no; removing one that isn't live, or from another
    level; adding a range that overlaps a live file of the same level above 0. One fault makes the whole batch void.
    """
    w = Window.partitionBy("file_no").orderBy("ord")
    rows = edits.withColumn("_was", F.lag("action").over(w)).withColumn("_level", F.lag("level").over(w)).withColumn("_n", F.row_number().over(w))
    add = F.col("action") == "ADD"
    fault = F.when(add & (F.col("_was") == "ADD"), "file number")
    if next_file_no is not None:
        fault = fault.when(add & (F.col("file_no") >= next_file_no), "file number")
    fault = fault.when(~add & ~F.coalesce(F.col("_was") == "ADD", F.lit(False)), "removes missing file")
    fault = fault.when(~add & (F.col("_level") != F.col("level")), "remove level")
    out = rows.withColumn("fault", fault).filter("fault IS NOT NULL").select("ord", "file_no", "fault")
    if not {"smallest", "largest"} <= set(edits.columns):
        return out
    # a frame that ends at the last row is summed anew for each row, one that starts at the first isn't
    back = Window.partitionBy("file_no").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    gone = F.min(F.when(F.col("action") == "REMOVE", F.col("ord"))).over(back)
    live = rows.withColumn("_until", gone).filter(add & (F.col("level") > 0)).select("ord", "file_no", "level", "smallest", "largest", "_until", "_n")
    return out.union(_meeting(live).select("ord", "file_no", F.lit("level range overlap").alias("fault")))


def _meeting(live: DataFrame) -> DataFrame:
    """Rows (ord, file_no, _n) of live(ord, file_no, level, smallest, largest, _until, _n) that meet an earlier one of another
    file of their level which lives then (_until, the end of its life, is null or later).

    Two ranges meet where one starts inside the other. Range ends are ranked, a range is cut into the dyadic intervals it
    covers, and a start lies in one of each size, so the earlier ranges that meet a row are those in a common interval. Rows
    of an interval are counted in their order: a life is one more from its first row on and one less from its end; what is
    left without the row's own file meets it. Ranks of a level and an interval's rows are one sort each.
    """
    live = live.filter("ord IS NOT NULL AND file_no IS NOT NULL AND smallest IS NOT NULL AND largest IS NOT NULL")
    good = live.filter("smallest <= largest")
    ends = good.select("level", F.explode(F.array("smallest", "largest")).alias("key")).distinct()
    ends = ends.withColumn("rank", F.row_number().over(Window.partitionBy("level").orderBy("key")).cast("bigint"))
    for side in ("smallest", "largest"):
        good = good.join(ends.select("level", F.col("key").alias(side), F.col("rank").alias(f"_{side}")), ["level", side])
    lives = good.groupBy("level", "file_no", "_smallest", "_largest", "_until").agg(F.min("ord").alias("ord"))
    tall = lives.agg(F.coalesce(F.floor(F.log2(F.max(F.col("_largest") - F.col("_smallest") + 1))), F.lit(0)).cast("int").alias("_tall"))
    # of each height h: the interval of the start; the intervals at the ends of what larger ones leave of the range
    a, z, h = "_smallest", "_largest + 1", "h"
    lo, hi = f"shiftright({a} + shiftleft(1L, {h}) - 1, {h})", f"shiftright({z}, {h})"
    heights = "sequence(0, _tall)"
    point = f"transform({heights}, h -> struct(h, shiftright({a}, h) AS at))"
    cover = f"filter(flatten(transform({heights}, h -> array(struct(h, IF({lo} < {hi} AND {lo} % 2 = 1, {lo}, NULL) AS at), struct(h, IF({lo} < {hi} AND {hi} % 2 = 1, {hi} - 1, NULL) AS at)))), x -> x.at IS NOT NULL)"

    def events(df: DataFrame, asks: bool) -> DataFrame:
        # an asking row's start lies in earlier ranges, or its range holds their starts
        kinds = F.array(F.struct(F.lit(asks).alias("starts"), F.expr(point).alias("nodes")), F.struct(F.lit(not asks).alias("starts"), F.expr(cover).alias("nodes")))
        df = df.join(F.broadcast(tall), F.lit(True)).withColumn("_k", F.explode(kinds)).withColumn("_x", F.explode("_k.nodes"))
        return df.withColumn("starts", F.col("_k.starts")).withColumn("h", F.col("_x.h")).withColumn("at", F.col("_x.at")).drop("_k", "_x", "_tall", "_smallest", "_largest")

    # at one place in the order lives end first, then rows ask, then lives begin
    asks = events(good.select("level", "file_no", "ord", "_n", "_smallest", "_largest"), True).withColumn("turn", F.lit(1)).withColumn("more", F.lit(0))
    turns = F.expr("filter(array(struct(ord AS place, 2 AS turn, 1 AS more), struct(_until AS place, 0 AS turn, -1 AS more)), x -> x.place IS NOT NULL)")
    begins = events(lives, False).withColumn("_t", F.explode(turns)).withColumn("_n", F.lit(None).cast("int"))
    cell = ["level", "starts", "h", "at"]
    both = asks.select(*cell, "file_no", "ord", "turn", "more", "_n").union(begins.select(*cell, "file_no", F.col("_t.place"), F.col("_t.turn"), F.col("_t.more"), "_n"))
    so_far = lambda *by: F.sum("more").over(Window.partitionBy(*by).orderBy("ord", "turn").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_all", so_far(*cell)).withColumn("_own", so_far(*cell, "file_no")).filter("turn = 1 AND _all > _own").select("ord", "file_no", "_n")
    # a range that ends before it starts meets those that reach from its end to its start; there should be few of them
    old = live.select(*[F.col(c).alias(f"o_{c}") for c in live.columns])
    meets = (F.col("level") == F.col("o_level")) & (F.col("o_ord") < F.col("ord")) & F.coalesce(F.col("o__until") > F.col("ord"), F.lit(True)) & (F.col("o_smallest") <= F.col("largest")) & (F.col("smallest") <= F.col("o_largest")) & (F.col("file_no") != F.col("o_file_no"))
    wrong = live.filter("smallest > largest").join(old.filter("o_smallest <= o_largest"), meets, "left_semi")
    wrong = wrong.union(live.filter("smallest <= largest").join(old.filter("o_smallest > o_largest"), meets, "left_semi"))
    return found.union(wrong.select("ord", "file_no", "_n")).distinct()


def apply_manifest(edits: DataFrame, next_file_no: int | None = None) -> DataFrame:
    """replay_manifest of edits(batch, ord, ...) without the batches that have a fault: all of a batch or nothing of it.

    Batches are judged against all edits, as a refused one ends a manifest's life: only those before the first fault count.
    """
    first = manifest_faults(edits.drop("batch"), next_file_no).agg(F.min("ord").alias("_first"))
    stop = edits.join(F.broadcast(first), F.col("ord") == F.col("_first")).agg(F.min("batch").alias("_stop"))  # one row
    kept = edits.join(F.broadcast(stop), F.coalesce(F.col("batch") < F.col("_stop"), F.lit(True))).drop("_stop")
    return replay_manifest(kept)


def orphans(tables: DataFrame, manifest: DataFrame) -> DataFrame:
    return tables.join(manifest.select("file_no"), "file_no", "left_anti")


def generation(manifests: DataFrame, meta: DataFrame) -> DataFrame:
    """The generation that meta names, which must be valid; without meta the newest valid one."""
    named = meta.join(manifests, "generation", "left").withColumn("generation", F.when(~F.coalesce("valid", F.lit(False)), F.raise_error(F.lit("meta names no valid generation")).cast("bigint")).otherwise(F.col("generation")))
    newest = manifests.filter("valid").agg(F.max("generation").alias("generation"))
    return named.select("generation", F.lit(0).alias("_o")).union(newest.select("generation", F.lit(1).alias("_o"))).orderBy("_o").limit(1).select("generation")


def write_amplification(flushed: DataFrame, compacted: DataFrame) -> DataFrame:
    """(flushed, compacted, milli): bytes(bytes) written for each flushed one, in thousandths; null without any."""
    one = flushed.agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("flushed")).join(compacted.agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("compacted")), F.lit(True))
    return one.withColumn("milli", F.expr("(flushed + compacted) * 1000 div nullif(flushed, 0)"))


def tables_per_key(versions: DataFrame, files: DataFrame) -> DataFrame:
    """(blocks, gets): how many tables a point read of each key has to look into, as a histogram."""
    return versions.groupBy("user_key").agg(F.count_distinct("file_no").alias("blocks")).groupBy("blocks").agg(F.count("*").alias("gets"))


def live_snapshots(changes: DataFrame) -> DataFrame:
    """Reference-counted snapshots from changes(watermark, delta)."""
    return changes.groupBy("watermark").agg(F.sum("delta").alias("refs")).filter("refs > 0")
