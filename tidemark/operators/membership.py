"""Membership, quorums and replicated-log invariants as set and rank computations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def has_quorum(acks: Column, voters: Column) -> Column:
    return F.size(F.array_intersect(acks, voters)) * 2 > F.size(voters)


def joint_quorum(acks: Column, old: Column, new: Column) -> Column:
    """A majority of both halves; an absent half (null) asks nothing."""
    return has_quorum(acks, new) & (old.isNull() | has_quorum(acks, old))


def leaving(old: Column, new: Column) -> Column:
    return F.array_sort(F.array_except(old, new))


def all_voters(old: Column, new: Column) -> Column:
    return F.array_sort(F.array_union(old, new))


def survivable(voters: Column, wiped: Column) -> Column:
    """Whether the voters that aren't wiped are a majority."""
    return F.size(F.array_except(voters, wiped)) * 2 > F.size(voters)


def commit_index(matches: DataFrame, group: str = "cluster") -> DataFrame:
    """(group, commit): the largest index that more than half of matches(group, node, match) have."""
    w = Window.partitionBy(group).orderBy(F.desc("match"), "node")
    ranked = matches.withColumn("_r", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(group)))
    return ranked.filter(F.col("_r") == F.floor(F.col("_n") / 2) + 1).select(group, F.col("match").alias("commit"))


def intervals(changes: DataFrame) -> DataFrame:
    """(node, role, from_index, to_index) from changes(log_index, node, role); the last one is open."""
    w = Window.partitionBy("node").orderBy("log_index")
    return changes.select("node", "role", F.col("log_index").alias("from_index"), F.lead("log_index").over(w).alias("to_index"))


def election_safety(leaders: DataFrame) -> DataFrame:
    """Terms of leaders(term, node) with two leaders."""
    return leaders.groupBy("term").agg(F.count_distinct("node").alias("leaders")).filter("leaders > 1")


def log_matching(entries: DataFrame) -> DataFrame:
    """(index, term) of entries(node, index, term, payload) with different payloads."""
    return entries.groupBy("index", "term").agg(F.count_distinct("payload").alias("variants")).filter("variants > 1")


def leader_completeness(committed: DataFrame, leader_log: DataFrame) -> DataFrame:
    """Committed (index, term) that the leader's log lacks."""
    return committed.join(leader_log.select("index", "term"), ["index", "term"], "left_anti")


def state_machine_safety(applied: DataFrame) -> DataFrame:
    """Indexes of applied(node, index, payload) at which nodes applied different entries."""
    return applied.groupBy("index").agg(F.count_distinct("payload").alias("variants")).filter("variants > 1")


def node_invariants(nodes: DataFrame) -> DataFrame:
    """nodes(node, applied, committed, last) that break applied <= committed <= last."""
    return nodes.filter("applied > committed OR committed > last")


def log_gaps(entries: DataFrame) -> DataFrame:
    """(node, index) of entries whose predecessor is missing, but the first of a node."""
    firsts = entries.groupBy("node").agg(F.min("index").alias("_first"))
    have = entries.select("node", (F.col("index") + 1).alias("index"))
    return entries.select("node", "index").join(have, ["node", "index"], "left_anti").join(firsts, "node").filter("index > _first").select("node", "index")


def negotiate(ours: dict[str, int], theirs: dict[str, int]) -> dict[str, int] | None:
    """Common version, features and frame of two peers; None if their version ranges are apart."""
    low, high = max(ours["min"], theirs["min"]), min(ours["max"], theirs["max"])
    if low > high:
        return None
    return {"version": high, "features": ours["features"] & theirs["features"], "frame": min(ours["frame"], theirs["frame"])}
