"""N-gram Jaccard join: T-occurrence search with DivideSkip over the documents that can have a partner at all.

1. Blocks of documents hash their shingle sets. Each block deals its distinct hashes to buckets; a bucket finds those that
   occur in two sets and counts them for each set. A partner shares at least 80 % of a set, so a set with fewer repeated
   hashes has none. A hash goes out once a block, with an owner only where a single set of the block has it: a frequent
   shingle adds one entry a block.
2. The sets that are left are read again, one for each distinct set, and dealt to buckets in the same way, which answer
   with the class of each hash's frequency. Shingles are ordered from rare to frequent and the first n - ceil(0.8 n) + 1
   of each set are its prefix; similar sets share a prefix shingle. Those that no other set has aren't sent any further;
   their number bounds what a set can share, so a set that can't reach any of the others goes.
3. Each set is compared with one other, the one of the most frequent shingles among those that share its most frequent
   prefix shingle: the sets of a large group of near copies are mostly linked by that, in any number of tasks.
4. Prefix shingles whose sets aren't all linked yet unite what must still be compared. Those sets are searched together
   (where they are many, for each such shingle) in runs of bounded size: inverted lists, the short ones merged by a heap
   that skips (by counting, where they hold thousands of entries), the long ones probed by binary search. Sets of the
   group's largest component only answer.
   A set already linked to the asking one's component isn't verified again: links form a forest with the components of
   the full similarity graph.
"""

from __future__ import annotations

import heapq
import pickle
import uuid
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import byte_batches, discard, drop, from_planes, pack, planes, ragged, released, scratch_root, table, text_bytes, text_of, unpack
from .shingles import shingle_sets, signatures

BLOCK_BYTES = 4 << 20
#: Text bytes to a bucket of hashes, LEAST_BUCKETS at least.
BUCKET_BYTES, LEAST_BUCKETS = 8 << 20, 96
NO_OWNER = 0xFFFFFFFF
#: Sets of a run, by the bytes of their hashes: two runs meet in a task.
RUN_BYTES = 8 << 20
#: Sets that are compared with the same other one in a task.
SALT_ROWS = 512
#: A binary probe's price against a step of the heap, by which DivideSkip tells long lists from short ones.
PROBE = 0.05
#: Entries of a set's inverted lists up to which a heap merges them.
HEAP_ENTRIES = 2000
#: Rows of a class beyond this share of all are joined by broadcast: there can't be more such classes than its inverse.
HOT_SHARE = 1 / 1024
NULL_ID = -(2**63)


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n shares at least with any set that it links to."""
    return -(-n * percent // 100)


PARTS_SCHEMA = "block bigint, part int, a binary, b binary"


def _parts():
    import pyarrow as pa

    return pa.schema([("block", pa.int64()), ("part", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("kind", pa.string())])


def _name() -> int:
    """A number for a block."""
    return uuid.uuid4().int >> 65


def _deal(out: list[dict], block: int, part: np.ndarray, buckets: int, row) -> None:
    """A row 'part' for each bucket that has entries: row(places) gives its columns a and b."""
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(buckets + 1))
    for i in np.flatnonzero(np.diff(cuts)).tolist():
        a, b = row(order[cuts[i] : cuts[i + 1]])
        out.append({"kind": "part", "block": block, "part": i, "a": a, "b": b})


def _blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """A row 'sets' for each block, and a row 'part' for each bucket that the block has hashes in."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        parts = _parts()
        for batch in byte_batches(batches, lambda b: pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False), BLOCK_BYTES, most_rows=60_000):
            h, count = shingle_sets(*text_bytes(batch.column(1)))
            sig, ends = signatures(h, count), np.cumsum(count)
            local: dict[bytes, int] = {}
            own = np.array([local.setdefault(s, len(local)) for s in sig], dtype=np.int64)  # equal sets of a block are one
            first = np.unique(own, return_index=True)[1]
            pick = np.concatenate([np.arange(ends[i] - count[i], ends[i]) for i in first]) if len(first) else np.zeros(0, np.int64)
            h, owner = h[pick], np.repeat(np.arange(len(first)), count[first])
            order = np.argsort(h)
            h, owner = h[order], owner[order]
            start = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
            times = np.diff(np.append(start, len(h)))
            inside = np.bincount(owner[np.repeat(times > 1, times)], minlength=len(first))
            h, owner = h[start], np.where(times > 1, NO_OWNER, owner[start])
            part, short = (h % np.uint64(buckets)).astype(np.int64), (h >> np.uint64(32)).astype(np.int64)
            block = _name()
            held = pickle.dumps((batch.column(0).to_pylist(), batch.column(2).to_numpy(), own, count[first], [sig[i] for i in first], inside))
            out = [{"kind": "sets", "block": block, "part": -1, "a": pack(held), "b": None}]
            _deal(out, block, part, buckets, lambda at: (planes(np.diff(short[at], prepend=0)), planes(owner[at])))
            yield pa.RecordBatch.from_pylist(out, parts)

    return docs.mapInArrow(run, f"{PARTS_SCHEMA}, kind string")


def _count_repeats(rows):
    """For a bucket: how many of each set's hashes, sent with their owner, occur in another block too."""
    import pandas as pd

    sizes, hashes, owners = [], [], []
    for a, b in zip(rows["a"], rows["b"], strict=True):
        hashes.append(np.cumsum(from_planes(a).astype(np.int64)))
        owners.append(from_planes(b))
        sizes.append(len(owners[-1]))
    h = np.concatenate(hashes)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    repeated = np.zeros(len(h), dtype=bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    out, at = [], 0
    for block, n, own in zip(rows["block"], sizes, owners, strict=True):
        hit = own[repeated[at : at + n] & (own != NO_OWNER)]
        at += n
        if len(hit):
            out.append((block, planes(np.bincount(hit))))
    return pd.DataFrame(out, columns=["block", "n"])


def _decide(percent: int):
    """For a block: a row for each of its distinct sets, with the ids and text hashes of the rows that have it."""

    def run(sets, counts):
        import pandas as pd

        if not len(sets):
            return pd.DataFrame(columns=["block", "sig", "n", "open", "least", "least_hash", "ids", "hashes"])
        ids, text_hash, own, n, sig, inside = pickle.loads(unpack(sets["a"].iloc[0]))
        total = inside.astype(np.int64)
        for c in counts["n"]:
            x = from_planes(c)
            total[: len(x)] += x
        is_open = (n > 0) & (total * 100 >= percent * n)
        members: list[list] = [[] for _ in sig]
        for i, (k, h) in enumerate(zip(own.tolist(), text_hash.tolist(), strict=True)):
            members[k].append((ids[i] is None, ids[i] if ids[i] is not None else 0, h))
        for m in members:
            m.sort()
        first = [m[0] for m in members]
        return pd.DataFrame(
            {
                "block": sets["block"].iloc[0],
                "sig": sig,
                "n": n,
                "open": is_open,
                "least": pd.array([None if null else i for null, i, _ in first], dtype="Int64"),
                "least_hash": [h for *_, h in first],
                "ids": [[None if null else i for null, i, _ in m] for m in members],
                "hashes": [[h for *_, h in m] for m in members],
            }
        )

    return run


DECIDED = "block bigint, sig binary, n bigint, open boolean, least bigint, least_hash bigint, ids array<bigint>, hashes array<bigint>"


def _read_sets(docs: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in byte_batches(batches, lambda b: pc.binary_length(b.column(0)).to_numpy(zero_copy_only=False), BLOCK_BYTES, most_rows=60_000):
            h, count = shingle_sets(*text_bytes(batch.column(0)))
            ends, raw = 8 * np.cumsum(count), h.astype("<u8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(signatures(h, count), pa.binary()), pa.array(count, pa.int64()), pa.array([raw[e - 8 * n : e] for e, n in zip(ends, count, strict=True)], pa.binary())], ["sig", "n", "hashes"])

    return docs.select(text_of().alias("text")).mapInArrow(run, "sig binary, n bigint, hashes binary")


def _set_blocks(sets: DataFrame, buckets: int) -> DataFrame:
    """sets(sid, sig, n, hashes) as a row 'sets' for each block, and a row 'part' for each bucket that it has hashes in."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        parts = _parts()
        for batch in byte_batches(batches, lambda b: pc.binary_length(b.column(3)).to_numpy(zero_copy_only=False), BLOCK_BYTES, most_rows=60_000):
            raw = b"".join(batch.column(3).to_pylist())
            h, times = np.unique(np.frombuffer(raw, "<u8"), return_counts=True)
            block = _name()
            held = pickle.dumps((batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_numpy()))
            out = [{"kind": "sets", "block": block, "part": -1, "a": pack(held), "b": raw}]
            short = (h >> np.uint64(32)).astype(np.int64)
            _deal(out, block, (h % np.uint64(buckets)).astype(np.int64), buckets, lambda at: (planes(np.diff(short[at], prepend=0)), planes(times[at])))  # noqa: B023
            yield pa.RecordBatch.from_pylist(out, parts)

    return sets.select("sid", "sig", "n", "hashes").mapInArrow(run, f"{PARTS_SCHEMA}, kind string")


def frequency_class(df: np.ndarray) -> np.ndarray:
    """Frequencies as 8 bits, in the same order: themselves up to 127, then eight steps to a doubling."""
    high = np.floor(8 * np.log2(np.maximum(df, 1) / 127))
    return np.where(df <= 127, df, np.minimum(255, 127 + np.maximum(high, 0))).astype(np.uint8)


def _classes(rows):
    """For a bucket: the frequency class of each hash, in the order of the parts that the blocks sent."""
    import pandas as pd

    hashes = [np.cumsum(from_planes(a).astype(np.int64)) for a in rows["a"]]
    times = np.concatenate([from_planes(b) for b in rows["b"]]).astype(np.int64)
    _, code = np.unique(np.concatenate(hashes), return_inverse=True)
    found = frequency_class(np.bincount(code, weights=times).astype(np.int64))[code]
    ends = np.cumsum([len(h) for h in hashes])
    return pd.DataFrame({"block": rows["block"].to_numpy(), "part": rows["part"].to_numpy(), "c": [pack(found[e - len(h) : e].tobytes()) for h, e in zip(hashes, ends.tolist(), strict=True)]})


PREFIX = "sid bigint, n bigint, common bigint, weight bigint, h bigint"


def _prefixes(percent: int, buckets: int):
    """For a block, its sets' prefix shingles (PREFIX) that another set has too.

    common: shingles of the set that others have, which is all that it can share. weight: how frequent they are.
    """

    def run(sets, classes):
        import pandas as pd

        if not len(sets):
            return pd.DataFrame({"sid": [], "n": [], "common": [], "weight": [], "h": []}).astype("int64")
        sid, _, n = pickle.loads(unpack(sets["a"].iloc[0]))
        flat = np.frombuffer(sets["b"].iloc[0], "<u8")
        h, code = np.unique(flat, return_inverse=True)
        order = np.argsort((h % np.uint64(buckets)).astype(np.int64), kind="stable")
        answers = classes.sort_values("part")["c"]
        of = np.empty(len(h), dtype=np.uint8)
        of[order] = np.frombuffer(b"".join(unpack(c) for c in answers), np.uint8)
        row, cls = np.repeat(np.arange(len(sid)), n), of[code]
        shared = cls > 1
        row, cls, flat = row[shared], cls[shared], flat[shared]
        common = np.bincount(row, minlength=len(sid))
        weight = (1000 * np.bincount(row, weights=cls, minlength=len(sid)) / np.maximum(n, 1)).astype(np.int64)
        places = n - -(-n * percent // 100) + 1 - (n - common)  # shingles of one set alone come first in the order; they only use up places
        by = np.lexsort((flat, cls, row))
        row, flat = row[by], flat[by]
        rank = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        keep = rank < places[row]
        row = row[keep]
        return pd.DataFrame({"sid": sid[row], "n": n[row], "common": common[row], "weight": weight[row], "h": flat[keep].astype("<i8")})

    return run


def _reaching(prefix: DataFrame, percent: int) -> DataFrame:
    """prefix without the rows whose set can't share enough with the smallest set that has the shingle, nor with a larger one."""
    least = prefix.groupBy("h").agg(F.min("n").alias("_least"), F.count("*").alias("_sets")).filter("_sets > 1")
    partner = F.greatest("_least", F.expr(f"(n * {percent} + 99) div 100"))
    need = ((F.col("n") + partner) * percent + (99 + percent)) / (100 + percent)
    return prefix.join(least, "h").filter(F.col("common") >= F.floor(need)).drop("_least", "_sets")


def _sets_of(blocks: DataFrame) -> DataFrame:
    """Rows (sid, sig, n, hashes) of the blocks' rows 'sets'."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                sid, sig, n = pickle.loads(unpack(a.as_py()))
                raw, ends = b.as_py(), 8 * np.cumsum(n)
                for at in range(0, len(sid), 4096):
                    part = slice(at, at + 4096)
                    hashes = [raw[e - 8 * k : e] for e, k in zip(ends[part].tolist(), n[part].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(sid[part]), pa.array(sig[part], pa.binary()), pa.array(n[part]), pa.array(hashes, pa.binary())], ["sid", "sig", "n", "hashes"])

    return blocks.filter("kind = 'sets'").select("a", "b").mapInArrow(run, "sid bigint, sig binary, n bigint, hashes binary")


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link."""
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _compare(percent: int):
    """Links of the sets that are compared with the same one."""

    def run(members, hub):
        import pandas as pd

        out = []
        if len(members) and len(hub):
            one, name = np.frombuffer(hub["hub_hashes"].iloc[0], "<u8"), hub["hub_hub"].iloc[0]
            out = [(name, sid) for sid, x in zip(members["sid"], members["hashes"], strict=True) if _similar(one, np.frombuffer(x, "<u8"), percent)]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def merge_skip(lists: list[list[int]], least: int) -> list[tuple[int, int]]:
    """(number, lists that hold it) of the numbers in at least so many of the sorted lists: a heap merge that skips.

    When too few lists stand at the smallest number, least - 1 lists in all are taken off the heap and go on at the number
    that is then on top: nothing below it can be in enough of them.
    """
    heap = [(x[0], k) for k, x in enumerate(lists) if x]
    heapq.heapify(heap)
    at, out = [0] * len(lists), []
    while len(heap) >= least:
        top, off = heap[0][0], []
        while heap and heap[0][0] == top:
            off.append(heapq.heappop(heap)[1])
        if len(off) >= least:
            out.append((top, len(off)))
            goal = top + 1
        else:
            while len(off) < least - 1:
                off.append(heapq.heappop(heap)[1])
            goal = heap[0][0]
        for k in off:
            at[k] = bisect_left(lists[k], goal, at[k])
            if at[k] < len(lists[k]):
                heapq.heappush(heap, (lists[k][at[k]], k))
    return out


class Search:
    """T-occurrence search (DivideSkip) among sets of 64-bit hashes for links that join components.

    Sets are placed by (size, id). Each that asks looks for others of another component; of two that both ask, the one
    of the higher place looks.
    """

    def __init__(self, sid: np.ndarray, sets: list[np.ndarray], component: np.ndarray, asks: np.ndarray, indexed: np.ndarray, percent: int):
        n = np.array([len(s) for s in sets], dtype=np.int64)
        order = np.lexsort((sid, n))
        self.sid, self.n, self.asks = sid[order], n[order], asks[order]
        self.sets, self.percent = [sets[i] for i in order], percent
        _, label = np.unique(component[order], return_inverse=True)
        self.label, self.parent = label.tolist(), list(range(int(label.max(initial=-1)) + 1))
        held = np.flatnonzero(indexed[order])
        flat = np.concatenate([np.zeros(0, "<u8"), *[self.sets[i] for i in held]])
        owner = np.repeat(held, self.n[held])
        by = np.argsort(flat, kind="stable")
        self.keys, start = np.unique(flat[by], return_index=True)
        self.owner, self.ends = owner[by], np.append(start, len(flat))

    def find(self, i: int) -> int:
        """The component of a set, by union-find."""
        i = self.label[i]
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def links(self) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        if not len(self.keys):
            return out
        for q in np.flatnonzero(self.asks).tolist():
            x = self.sets[q]
            at = np.searchsorted(self.keys, x)
            at = at[self.keys[np.minimum(at, len(self.keys) - 1)] == x]
            at = at[(self.ends[at + 1] - self.ends[at] > 1) | (self.owner[self.ends[at]] != q)]  # lists of others
            n, percent = len(x), self.percent
            smallest = least_overlap(n, percent)
            # no partner shares more than what is found, so none is larger than that allows
            largest = min(100 * n // percent, len(at) * (100 + percent) // percent - n)
            if largest < smallest:
                continue
            low, high = int(np.searchsorted(self.n, smallest)), int(np.searchsorted(self.n, largest, side="right"))
            begin, end = self.ends[at], self.ends[at + 1]
            need = -(-percent * (n + smallest) // (100 + percent))  # overlap that the smallest possible partner requires
            found = self._heap(q, low, high, begin, end, need) if int((end - begin).sum()) <= HEAP_ENTRIES else self._count(q, low, high, begin, end, need)
            mine = self.find(q)
            for c in found:
                if self.find(c) != mine:
                    self.parent[self.find(c)] = mine
                    out.append((int(self.sid[c]), int(self.sid[q])))
                    mine = self.find(q)
        return out

    def _divide(self, need: int, longest: int) -> int:
        """How many of the longest lists are probed, not merged."""
        return min(need - 1, int(need / (PROBE * np.log2(longest + 1) + 1)))

    def _open(self, q: int, c: int, mine: int) -> bool:
        return c != q and not (self.asks[c] and c > q) and self.find(c) != mine

    def _heap(self, q: int, low: int, high: int, begin: np.ndarray, end: np.ndarray, need: int) -> list[int]:
        """Similar sets of other components, by a heap over the short lists."""
        percent, n, mine = self.percent, int(self.n[q]), self.find(q)
        lists = []
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            part = self.owner[a:b].tolist()
            part = part[bisect_left(part, low) : bisect_left(part, high)]
            if part:
                lists.append(part)
        if len(lists) < need:
            return []
        lists.sort(key=len)
        long = self._divide(need, len(lists[-1]))
        probed, out = lists[len(lists) - long :], []
        for c, both in merge_skip(lists[: len(lists) - long], need - long):
            if not self._open(q, c, mine):
                continue
            m = int(self.n[c])
            want = -(-percent * (n + m) // (100 + percent))
            for k, part in enumerate(probed):  # binary probes, until the overlap is out of reach
                if both + long - k < want:
                    break
                i = bisect_left(part, c)
                both += i < len(part) and part[i] == c
            if 100 * both >= percent * (n + m - both):
                out.append(c)
        return out

    def _count(self, q: int, low: int, high: int, begin: np.ndarray, end: np.ndarray, need: int) -> list[int]:
        """The same for long lists: the short ones among them are counted, the others probed for all candidates at once."""
        percent, n, mine = self.percent, int(self.n[q]), self.find(q)
        by = np.argsort(end - begin, kind="stable")
        begin, end = begin[by], end[by]
        long = self._divide(need, int(end[-1] - begin[-1]))
        cut = len(by) - long
        own = self.owner[ragged(end[:cut] - begin[:cut], begin[:cut])]
        times = np.bincount(own[(own >= low) & (own < high)] - low, minlength=high - low)
        found = np.flatnonzero(times >= need - long)
        found = found[[self._open(q, c, mine) for c in (found + low).tolist()]] if len(found) else found
        both, found = times[found], found + low
        want = -(-percent * (n + self.n[found]) // (100 + percent))
        for k in range(cut, len(by)):
            reach = both + (len(by) - k) >= want
            found, both, want = found[reach], both[reach], want[reach]
            if not len(found):
                return []
            run = self.owner[begin[k] : end[k]]
            both = both + (run[np.minimum(np.searchsorted(run, found), len(run) - 1)] == found)
        return found[both >= want].tolist()


def _solve(percent: int):
    def run(rows):
        import pandas as pd

        sets = [np.frombuffer(x, "<u8") for x in rows["hashes"]]
        found = Search(rows["sid"].to_numpy(), sets, rows["comp"].to_numpy(), rows["asks"].to_numpy(), rows["indexed"].to_numpy(), percent).links()
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return run


def _hub_links(prefix: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of each set with the one of the most weight that shares the most frequent of its prefix shingles."""
    hubs = prefix.groupBy("h").agg(F.count("*").alias("members"), F.max(F.struct("weight", "sid")).alias("hub")).filter("members > 1").select("h", "members", F.col("hub.sid").alias("hub"))
    near = prefix.join(hubs, "h").groupBy("sid").agg(F.max(F.struct("members", "h", "hub")).alias("x")).select("sid", "x.*").filter("sid <> hub")
    salts = F.ceil(F.col("members") / SALT_ROWS)
    near = table(near.withColumn("salt", F.pmod(F.xxhash64("sid", F.lit(9)), salts)), "near-hubs", release_shuffles=False)
    asked = near.select("h", "hub", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt")).distinct()
    hub_sets = sets.select(F.col("sid").alias("hub"), "hashes").join(asked, "hub")
    hub_sets = hub_sets.select(*[F.col(c).alias(f"hub_{c}") for c in ("h", "salt", "hub", "hashes")])  # cogrouped frames share no column
    members = sets.select("sid", "hashes").join(near.select("sid", "h", "salt"), "sid").select("h", "salt", "sid", "hashes")
    return members.groupBy("h", "salt").cogroup(hub_sets.groupBy("hub_h", "hub_salt")).applyInPandas(released(_compare(percent)), "a bigint, b bigint")


def _search_links(prefix: DataFrame, sets: DataFrame, linked: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components linked(node, root) wherever sets of two of them are similar."""
    comps = prefix.join(linked.select(F.col("node").alias("sid"), F.col("root").alias("comp")), "sid", "left")
    comps = table(comps.withColumn("comp", F.coalesce("comp", "sid")), "near-comps", release_shuffles=False)
    mixed = comps.groupBy("h").agg(F.min("comp").alias("least"), F.max("comp").alias("_most")).filter("least < _most").select("h", "least")
    open_ = table(comps.join(mixed, "h"), "near-open", release_shuffles=False)
    drop(comps)
    roots = components(open_.filter("comp <> least").select(F.col("comp").alias("a"), F.col("least").alias("b")).distinct())
    placed = open_.join(roots.select(F.col("node").alias("comp"), "root"), "comp").select("root", "h", "sid", "comp", "n")
    placed = table(placed, "near-placed", release_shuffles=False)
    drop(open_)
    whole = placed.select("root", "sid", "comp", "n").distinct()
    weight = F.sum(F.col("n") * 8)
    large = whole.groupBy("root").agg(weight.alias("_bytes")).filter(F.col("_bytes") > RUN_BYTES).select("root")
    # a large root is taken apart by its shingles
    groups = whole.join(large, "root", "left_anti").select(F.lit(0).alias("kind"), F.col("root").alias("g"), "sid", "comp", "n")
    groups = groups.union(placed.join(large, "root").select(F.lit(1).alias("kind"), F.col("h").alias("g"), "sid", "comp", "n"))
    groups = table(groups, "near-groups", release_shuffles=False)
    drop(placed)
    parts = groups.groupBy("kind", "g", "comp").agg(weight.alias("_part"))
    stats = parts.groupBy("kind", "g").agg(F.sum("_part").alias("_all"), F.max(F.struct("_part", "comp")).alias("_top"))
    runs = lambda size: F.ceil(size / RUN_BYTES).cast("int")
    stats = stats.select("kind", "g", F.col("_top.comp").alias("_major"), runs(F.col("_all")).alias("_runs"), runs(F.col("_all") - F.col("_top._part")).alias("_asking"))
    rows = groups.join(stats, ["kind", "g"]).withColumn("asks", F.col("comp") != F.col("_major"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    of = lambda n, seed: F.pmod(F.xxhash64("sid", F.lit(seed)), n).cast("int")
    key = ["kind", "g", "i", "j"]
    indexed = rows.withColumn("j", of(F.col("_runs"), 3)).withColumn("i", every(F.col("_asking"))).select(*key, "sid", "comp", F.lit(False).alias("asks"), F.lit(True).alias("indexed"))
    asking = rows.filter("asks").withColumn("i", of(F.col("_asking"), 5)).withColumn("j", every(F.col("_runs"))).select(*key, "sid", "comp", "asks", F.lit(False).alias("indexed"))
    tasks = indexed.union(asking).groupBy(*key, "sid", "comp").agg(F.max("asks").alias("asks"), F.max("indexed").alias("indexed"))
    tasks = tasks.join(sets.select("sid", "hashes"), "sid").select(*key, "sid", "comp", "asks", "indexed", "hashes")
    return tasks.groupBy(*key).applyInPandas(released(_solve(percent)), "a bigint, b bigint")


def _row_key() -> tuple:
    """(id, text_hash) of a row: equal for equal rows, and rows that share it have the same set."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64(text_of()).alias("_text_hash")


def _linked(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(rows, classes, roots) of a table that isn't empty.

    rows: DECIDED, a row for each block and distinct set. classes: sig of each set, its smallest doc_id (least), the
    text_hash of a row that has it (least_hash) and in how many rows it is. roots: sig and root of each set that links to
    another one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.xxhash64(text_of()).alias("text_hash"))
    total = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0]
    if total is None:
        return None
    folder = f"{scratch_root(spark)}/tidemark/{uuid.uuid4().hex}-near"

    def parts(where: str, kind: str) -> DataFrame:
        return spark.read.schema(f"{PARTS_SCHEMA}, kind string").parquet(where).filter(F.col("kind") == kind).drop("kind")

    buckets = max(LEAST_BUCKETS, total // BUCKET_BYTES)
    _blocks(rows, buckets).write.partitionBy("kind").parquet(f"{folder}/texts")
    counts = parts(f"{folder}/texts", "part").groupBy("part").applyInPandas(released(_count_repeats), "block bigint, n binary")
    held = parts(f"{folder}/texts", "sets").select("block", "a")
    decided = table(held.groupBy("block").cogroup(counts.groupBy("block")).applyInPandas(released(_decide(percent)), DECIDED), "near-rows")
    discard(spark, f"{folder}/texts")

    least_hash = F.coalesce(F.min_by("least_hash", "least"), F.min("least_hash")).alias("least_hash")
    classes = decided.filter("n > 0").groupBy("sig").agg(F.min("least").alias("least"), least_hash, F.max("open").alias("open"), F.count("*").alias("rows"))
    classes = table(classes, "near-classes", release_shuffles=False)
    # one text for each set that may have a partner; a set is found again by its signature
    ids = classes.filter("open").select(F.coalesce("least", F.lit(NULL_ID)).alias("_id"), F.col("least_hash").alias("_text_hash"))
    chosen = rows.select(*_row_key(), "text").join(ids, ["_id", "_text_hash"], "left_semi")
    sets = _read_sets(chosen).groupBy("sig").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes"))
    sets = sets.join(classes.filter("open").select("sig"), "sig", "left_semi").withColumn("sid", F.xxhash64("sig"))
    _set_blocks(sets, buckets).write.partitionBy("kind").parquet(f"{folder}/sets")
    answers = parts(f"{folder}/sets", "part").groupBy("part").applyInPandas(released(_classes), "block bigint, part int, c binary")
    held = parts(f"{folder}/sets", "sets").select("block", "a", "b")
    prefix = held.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(released(_prefixes(percent, buckets)), PREFIX)
    every = table(prefix, "near-prefix")
    discard(spark, f"{folder}/sets/kind=part")
    prefix = table(_reaching(every, percent), "near-reaching")
    drop(every)

    sets = _sets_of(spark.read.schema(f"{PARTS_SCHEMA}, kind string").parquet(f"{folder}/sets"))
    links = table(_hub_links(prefix, sets, percent), "near-links")
    more = table(_search_links(prefix, sets, components(links), percent), "near-links")
    drop(prefix)
    roots = components(links.union(more))
    named = table(sets.select("sig", F.col("sid").alias("node")).join(roots, "node").select("sig", "root"), "near-roots", release_shuffles=False)
    discard(spark, folder)
    return decided, classes, named


def _of_class(decided: DataFrame, classes: DataFrame, columns: list[str]) -> DataFrame:
    """decided with the columns of its class: the classes of very many rows, of which there are few, by broadcast."""
    total = classes.agg(F.sum("rows")).first()[0] or 0
    hot = classes.filter(F.col("rows") > max(64, int(total * HOT_SHARE))).select("sig", *columns)  # at most 1 / HOT_SHARE rows
    most = decided.join(F.broadcast(hot), "sig")
    rest = decided.join(F.broadcast(hot.select("sig")), "sig", "left_anti").join(classes.select("sig", *columns), "sig", "left")
    return most.unionByName(rest)


def similarity_components(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id): the components of documents linked by a Jaccard similarity of percent or more.

    A set is a text's distinct shingles of five words, its whole word sequence where there are fewer; texts without words
    (null, empty) have none and link to nothing. Equal sets always link. component_id is the smallest doc_id reached; a
    null doc_id counts as none (as -2^63, which no other document may have), and a component of such rows alone has null.
    Repeated rows are equal sets; a very long text is a block of its own. An empty table gives an empty result; other
    columns are ignored. Sets are compared by 64-bit hashes of their shingles. Components are built, links aren't counted:
    sets of one component aren't compared once they are known to be.
    """
    found = _linked(docs, percent)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, n_shingles bigint, component_id bigint")
    decided, classes, named = found
    least = named.join(classes, "sig").groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = classes.join(named.join(least, "root").select("sig", "component_id"), "sig", "left").select("sig", "rows", F.coalesce("component_id", "least").alias("component_id"))
    out = _of_class(decided.select("sig", "n", "ids"), table(of_class, "near-components"), ["component_id"])
    out = out.select("n", "component_id", F.explode("ids").alias("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs that no other row of their component precedes: one for each component, with the columns of docs.

    A row with the component's smallest doc_id stays, any row where all ids are null. Only rows of one component remove one
    another, so other texts with the same id or with a null one stay too. Documents without words are components of their
    own; of such rows repeated with the same doc_id and text one stays.
    """
    found = _linked(docs, percent)
    if found is None:
        return docs
    decided, classes, named = found
    united = classes.join(named, "sig", "left").withColumn("_alone", F.when(F.col("root").isNull(), F.col("sig")))
    first = F.coalesce(F.min_by("least_hash", "least"), F.min("least_hash"))
    kept = united.groupBy("root", "_alone").agg(F.coalesce(F.min("least"), F.lit(NULL_ID)).alias("_id"), first.alias("_text_hash")).select("_id", "_text_hash", F.lit(False).alias("_each"))
    wordless = decided.filter("n = 0").select(F.explode(F.arrays_zip("ids", "hashes")).alias("x"))
    wordless = wordless.select(F.coalesce("x.ids", F.lit(NULL_ID)).alias("_id"), F.col("x.hashes").alias("_text_hash"), F.col("x.ids").isNull().alias("_each"))
    kept = kept.union(wordless).groupBy("_id", "_text_hash").agg(F.max("_each").alias("_each"))
    # one exchange by the row's key serves the join and the removal of repeated rows
    rows = docs.select("*", *_row_key()).join(kept, ["_id", "_text_hash"])
    rows = rows.withColumn("_each", F.when(F.col("_each"), F.monotonically_increasing_id()))
    return rows.dropDuplicates(["_id", "_text_hash", "_each"]).select(*[F.col(f"`{c}`") for c in docs.columns])
