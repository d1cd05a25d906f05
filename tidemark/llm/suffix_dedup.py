"""Suffix-array dedup: maximal repeats from the common-prefix interval trees of sparse suffix arrays.

A byte goes if a string of LEAST bytes around it also starts in a document with a smaller id. To bring equal strings
together without moving every suffix, each window of LEAST bytes names an anchor, the smallest hash of its GRAM-byte
strings: equal windows name anchors at equal places, about one position in 16 is an anchor, and all occurrences of a
string meet in the bucket of its anchor's hash.

1. Blocks of documents send each distinct anchor hash once; buckets answer which of them other documents have too.
2. Around each anchor that repeats, blocks send the bytes that a window through it can reach, each distinct fragment once
   with the smallest and largest document that holds it. Copies within a block weigh nothing more.
3. A bucket sorts the suffixes of its fragments that start up to REACH bytes before the anchor: the order at one start
   follows from the order one byte later (by the byte in front), so each start has a suffix array with common-prefix
   lengths. A stack scan gives the intervals of its tree; those whose suffixes are preceded by different bytes are the
   maximal repeats, with all their occurrences. Each sends back its length and its smallest document.
4. Blocks cut the union of what the repeats cover in larger documents.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import byte_batches, discard, drop, from_planes, mix64, pack, planes, ragged, released, scratch_root, seeded_words, table, text_bytes, text_of, text_runs, unpack
from .shingles import _powers

LEAST, GRAM = 50, 20
#: Bytes before an anchor that a window through it can start at; bytes of a fragment.
REACH = LEAST - GRAM
SPAN = REACH + LEAST
BLOCK_BYTES = 3 << 20
#: Text bytes that are hashed at once.
RUN_BYTES = 1 << 19
#: Places in a run fit 24 bits.
LONGEST = 1 << 23
BUCKET_BYTES, LEAST_BUCKETS = 16 << 20, 64
#: Ends of repeats in a block that are added up at once.
SETTLED = 1 << 20
NULL_ID = -(2**63)
_BYTES = seeded_words(256, 21)
_COLUMNS = seeded_words(2 * SPAN, 22).reshape(2, SPAN) | np.uint64(1)
SCHEMA = "block string, part int, a binary, b binary, kind string"


def anchors(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the anchors of all windows of LEAST bytes that lie within one text."""
    parts = [(off[a], _anchors(raw[off[a] : off[b]], off[a : b + 1] - off[a])) for a, b in text_runs(off, RUN_BYTES)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([at + start for start, (at, _) in parts]), np.concatenate([h for _, (_, h) in parts])


def _anchors(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw)
    if n < LEAST:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n > LONGEST:  # one text: pieces whose windows follow one another
        pieces = [(a, _anchors(raw[a : a + LONGEST // 2 + LEAST - 1], np.array([0, len(raw[a : a + LONGEST // 2 + LEAST - 1])]))) for a in range(0, n, LONGEST // 2)]
        at, h = np.concatenate([at + a for a, (at, _) in pieces]), np.concatenate([h for _, (_, h) in pieces])
        new = np.append(True, at[1:] != at[:-1])
        return at[new], h[new]
    up, down = _powers(1 << max(19, int(n + 1).bit_length()))
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTES[raw] * up[:n], out=sums[1:])
    h = mix64((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    low = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)  # equal hashes: the first of the window
    width, reach = 1, REACH + 1
    while 2 * width <= reach:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < reach:
        low = np.minimum(low[: len(low) - (reach - width)], low[reach - width :])
    inside = np.zeros(n - LEAST + 1, dtype=bool)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if b - a >= LEAST:
            inside[a : b - LEAST + 1] = True
    at = (low[inside] & np.uint64(0xFFFFFF)).astype(np.int64)
    at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
    return at, h[at]


def _rows(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_pylist([dict(zip(("block", "part", "a", "b", "kind"), r, strict=True)) for r in rows], pa.schema([("block", pa.string()), ("part", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("kind", pa.string())]))


def _frame(rows):
    import pandas as pd

    return pd.DataFrame(rows, columns=["block", "part", "a", "b", "kind"])


def _dealt(keys: np.ndarray, buckets: int):
    """(order, cuts): keys sorted by bucket and upper half; bucket i is order[cuts[i]:cuts[i + 1]]."""
    part = keys % np.uint64(buckets)
    order = np.lexsort((keys, keys >> np.uint64(32), part))
    return order, np.searchsorted(part[order], np.arange(buckets + 1))


def _distinct_keys(keys: np.ndarray, doc: np.ndarray):
    """(distinct keys, number of each anchor's key, whether more than one document of the block has it)."""
    distinct, number = np.unique(keys, return_inverse=True)
    low, high = np.full(len(distinct), 1 << 62), np.full(len(distinct), -1)
    np.minimum.at(low, number, doc)
    np.maximum.at(high, number, doc)
    return distinct, number, low != high


def _blocks(buckets: int):
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in byte_batches(batches, lambda b: pc.binary_length(b.column(b.num_columns - 1)).to_numpy(zero_copy_only=False), BLOCK_BYTES, most_rows=1 << 18):
            raw, off = text_bytes(batch.column(batch.num_columns - 1))
            sink, held = pa.BufferOutputStream(), pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1])
            with pa.ipc.new_stream(sink, held.schema) as w:
                w.write_batch(held)
            block = uuid.uuid4().hex
            out = [(block, -1, pack(raw.tobytes()), pack(pickle.dumps((off, sink.getvalue().to_pybytes()))), "text")]
            at, keys = anchors(raw, off)
            distinct, _, several = _distinct_keys(keys, np.searchsorted(off, at, side="right"))
            order, cuts = _dealt(distinct, buckets)
            short = (distinct >> np.uint64(32)).astype(np.int64)
            for i in range(buckets):
                own = order[cuts[i] : cuts[i + 1]]
                if len(own):
                    out.append((block, i, planes(np.diff(short[own], prepend=0)), pack(np.packbits(several[own]).tobytes()), "key"))
            yield _rows(out)

    return run


def _answer(rows):
    """For a bucket: a bit for each hash that each block sent, whether another document has it."""
    shorts = [np.cumsum(from_planes(a).astype(np.int64)) for a in rows["a"]]
    several = [np.unpackbits(np.frombuffer(unpack(b), np.uint8))[: len(s)].astype(bool) for b, s in zip(rows["b"], shorts, strict=True)]
    h, out = np.concatenate(shorts), np.concatenate(several)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    ends = np.cumsum([len(s) for s in shorts])
    return _frame([(block, int(part), pack(np.packbits(out[e - len(s) : e]).tobytes()), None, "bits") for block, part, s, e in zip(rows["block"], rows["part"], shorts, ends, strict=True)])


def _fragments(buckets: int):
    def run(rows):
        kinds = dict(iter(rows.groupby("kind")))
        if "bits" not in kinds:
            return _frame([])
        text = kinds["text"].iloc[0]
        raw, (off, ipc) = np.frombuffer(unpack(text["a"]), np.uint8), pickle.loads(unpack(text["b"]))
        ids = _ids(ipc)
        at, keys = anchors(raw, off)
        doc = np.searchsorted(off, at, side="right") - 1
        distinct, number, _ = _distinct_keys(keys, doc)
        order, cuts = _dealt(distinct, buckets)
        repeats = np.zeros(len(distinct), dtype=bool)
        for part, bits in zip(kinds["bits"]["part"], kinds["bits"]["a"], strict=True):
            own = order[cuts[part] : cuts[part + 1]]
            repeats[own] = np.unpackbits(np.frombuffer(unpack(bits), np.uint8))[: len(own)].astype(bool)
        chosen = repeats[number]
        at, keys, doc = at[chosen], keys[chosen], doc[chosen]
        if not len(at):
            return _frame([])
        left, right = np.minimum(REACH, at - off[doc]), np.minimum(LEAST, off[doc + 1] - at)
        body = np.empty((len(at), SPAN), np.uint8)
        for a in range(0, len(at), 1 << 13):
            cut = slice(a, a + (1 << 13))
            place = at[cut, None] + np.arange(-REACH, LEAST)
            there = (place >= (at - left)[cut, None]) & (place < (at + right)[cut, None])
            body[cut] = np.where(there, raw[np.clip(place, 0, len(raw) - 1)], 0)
        prints = _prints(body, left, right)
        order = np.lexsort((prints[1], prints[0]))
        new = np.append(True, (np.diff(prints[0][order]) != 0) | (np.diff(prints[1][order]) != 0))
        fragment = np.empty(len(at), np.int64)
        fragment[order] = np.cumsum(new) - 1
        first, starts = order[new], np.flatnonzero(new)
        least, most = np.minimum.reduceat(ids[doc][order], starts), np.maximum.reduceat(ids[doc][order], starts)
        out = [(text["block"], -1, planes(at), planes(fragment), "place")]
        part = (keys[first] % np.uint64(buckets)).astype(np.int64)
        by_part = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[by_part], np.arange(buckets + 1))
        for i in range(buckets):
            own = by_part[cuts[i] : cuts[i + 1]]
            if len(own):
                own = own[np.argsort(np.ascontiguousarray(body[first[own], REACH : REACH + 8]).view(">u8").ravel(), kind="stable")]  # likes together compress
                pick = first[own]
                held = (planes(own), left[pick].astype(np.uint8), right[pick].astype(np.uint8), _longs(least[own]), _longs(most[own] - least[own]), body[pick])
                out.append((text["block"], i, pack(pickle.dumps(held)), None, "fragment"))
        return _frame(out)

    return run


def _prints(body: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each fragment, its place about the anchor included."""
    out = np.empty((2, len(body)), np.uint64)
    for a in range(0, len(body), 1 << 13):
        cut = slice(a, a + (1 << 13))
        for i in range(2):
            out[i, cut] = mix64(((_BYTES[body[cut]] ^ _COLUMNS[1 - i]) * _COLUMNS[i]).sum(1, dtype=np.uint64) + (left[cut].astype(np.int64) * 64 + right[cut]).astype(np.uint64))
    return out


def _anchor_hash(body: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each fragment's anchor string."""
    out = np.empty(len(body), np.uint64)
    for a in range(0, len(body), 1 << 15):
        part = _BYTES[body[a : a + (1 << 15), REACH : REACH + GRAM]]
        out[a : a + (1 << 15)] = mix64(((part ^ _COLUMNS[1, :GRAM]) * _COLUMNS[0, :GRAM]).sum(1, dtype=np.uint64))
    return out


def _longs(x: np.ndarray) -> np.ndarray:
    """64-bit numbers as byte planes."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T)


def _from_longs(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.T).view("<i8").ravel()


def _ids(ipc: bytes) -> np.ndarray:
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pa.ipc.open_stream(ipc).read_all().column("_id")
    return pc.fill_null(column, NULL_ID).to_numpy().astype(np.int64)


def _scan(lcp: list[int], least: list[int], first: int) -> list[tuple[int, int, int, int]]:
    """Intervals of the tree of one run of suffixes, innermost first: (length, first, last, smallest document).

    lcp[i] is the common prefix of suffixes i and i + 1 of the run, least[i] the smallest document of suffix i.
    """
    out, stack = [], []
    for i, small in enumerate(least):
        start, now = i, lcp[i] if i < len(lcp) else 0
        if stack:
            stack[-1][2] = min(stack[-1][2], small)
        while stack and stack[-1][0] > now:
            length, start, small = stack.pop()
            out.append((length, first + start, first + i, small))
            if stack:
                stack[-1][2] = min(stack[-1][2], small)
        if now and (not stack or stack[-1][0] < now):
            stack.append([now, start, small])
    return out


def maximal_repeats(group, left, right, body, least_doc, lead=None):
    """Maximal repeats of at least LEAST bytes among fragments of equal groups (anchors), with all their occurrences.

    With lead (_leads) a repeat doesn't go on to the left where its first window would name another anchor.

    Yields (start, members, sizes, lengths, smallest): repeats that begin start bytes before the anchor; members holds
    their fragments end to end, sizes how many each has, lengths their bytes, smallest their smallest document.
    """
    wide = np.zeros((len(group), -(-LEAST // 8) * 8), np.uint8)
    wide[:, :LEAST] = body[:, REACH:]
    words = wide.view(">u8")
    order = np.lexsort((right, *[words[:, i] for i in range(words.shape[1] - 1, -1, -1)], group))
    for start in range(REACH + 1):
        if start:
            front = np.where(left >= start, body[:, REACH - start].astype(np.int64) + 1, 0)
            order = order[np.argsort((group * 257 + front)[order], kind="stable")]
        sa = order[((left >= start) & (start + right >= LEAST))[order]]
        if len(sa) < 2:
            continue
        lcp = np.zeros(len(sa) - 1, np.int64)
        pairs = np.flatnonzero(group[sa[1:]] == group[sa[:-1]])
        for a in range(0, len(pairs), 1 << 17):
            cut = pairs[a : a + (1 << 17)]
            x, y = sa[cut], sa[cut + 1]
            differ = body[x, REACH - start :] != body[y, REACH - start :]
            lcp[cut] = np.minimum(np.where(differ.any(1), differ.argmax(1), differ.shape[1]), start + np.minimum(right[x], right[y]))
        linked = lcp >= LEAST
        if start < REACH:
            before = np.where(left > start, body[:, REACH - start - 1].astype(np.int64), -1)[sa]
            turns = (before[1:] != before[:-1]) | (before[1:] < 0)
            if lead is not None:
                turns |= ~lead[sa[1:], start + 1]
        else:
            turns = np.ones(len(sa) - 1, bool)
        turned = np.append(0, np.cumsum(turns))
        edge = np.flatnonzero(np.diff(np.concatenate([[False], linked, [False]]).astype(np.int8)))
        first, last = edge[0::2], edge[1::2]  # runs of suffixes first..last
        diverse = turned[last] > turned[first]
        first, last = first[diverse], last[diverse]
        if not len(first):
            continue
        small = least_doc[sa]
        inner = ragged(last - first, first)
        at = np.cumsum(last - first) - (last - first)
        low, high = np.minimum.reduceat(lcp[inner], at), np.maximum.reduceat(lcp[inner], at)
        flat = low == high
        whole = ragged(last - first + 1, first)
        least = np.minimum.reduceat(small[whole], np.cumsum(last - first + 1) - (last - first + 1))
        found = [np.stack([low[flat], first[flat], last[flat], least[flat]], axis=1)]
        for f, e in zip(first[~flat].tolist(), last[~flat].tolist(), strict=True):
            found.append(np.array(_scan(lcp[f:e].tolist(), small[f : e + 1].tolist(), f), dtype=np.int64))
        found = np.concatenate(found)
        found = found[turned[found[:, 2]] > turned[found[:, 1]]]  # left-extension diversity of each interval
        sizes = found[:, 2] - found[:, 1] + 1
        yield start, sa[ragged(sizes, found[:, 1])], sizes, found[:, 0], found[:, 3]


class Bucket:
    """A bucket's fragments: those of the blocks (own, block, with kind as their place among the distinct ones), and the
    distinct ones (first, with small and large as their documents' ends, group as their anchor)."""

    def __init__(self, rows):
        held = [pickle.loads(unpack(a)) for a in rows["a"]]
        self.block = np.repeat(np.arange(len(held)), [len(x[1]) for x in held])
        self.own, left, right, body = np.concatenate([from_planes(x[0]) for x in held]), *(np.concatenate([x[i] for x in held]) for i in (1, 2, 5))
        least, more = (np.concatenate([_from_longs(x[i]) for x in held]) for i in (3, 4))
        self.most = least + more
        del held[:], more
        prints = _prints(body, left, right)
        # equal fragments of different blocks are one, held from its smallest document on
        order = np.lexsort((prints[1], prints[0]))
        new = np.append(True, (np.diff(prints[0][order]) != 0) | (np.diff(prints[1][order]) != 0))
        self.kind = np.empty(len(order), np.int64)
        self.kind[order] = np.cumsum(new) - 1
        first, starts = order[new], np.flatnonzero(new)
        self.small, self.large = np.minimum.reduceat(least[order], starts), np.maximum.reduceat(self.most[order], starts)
        _, self.group = np.unique(_anchor_hash(body[first]), return_inverse=True)
        self.left, self.right, self.body = left[first].astype(np.int64), right[first].astype(np.int64), body[first]
        self.several = np.flatnonzero((np.bincount(self.group) > 1)[self.group])

    def repeats(self, lead=None):
        """maximal_repeats of the distinct fragments that share their anchor with another one."""
        at = self.several
        if len(at):
            for start, members, sizes, lengths, smallest in maximal_repeats(self.group[at], self.left[at], self.right[at], self.body[at], self.small[at], None if lead is None else lead[at]):
                yield start, at[members], sizes, lengths, smallest


def _leads(body: np.ndarray) -> np.ndarray:
    """For each fragment and start: whether the window that begins start bytes before the anchor names that anchor."""
    out = np.empty((len(body), REACH + 1), dtype=bool)
    up = _powers(1 << 19)[0][:GRAM]
    for a in range(0, len(body), 1 << 12):
        cut, value = slice(a, a + (1 << 12)), _BYTES[body[a : a + (1 << 12)]]
        h = np.zeros((len(value), SPAN - GRAM + 1), dtype=np.uint64)
        for i in range(GRAM):
            h += value[:, i : i + h.shape[1]] * up[i]
        h = mix64(h) & ~np.uint64(0xFFFFFF)
        for start in range(REACH + 1):
            out[cut, start] = h[:, REACH - start : 2 * REACH - start + 1].argmin(1) == start
    return out


def _groups(rows):
    """For a bucket: the maximal repeats of each block's fragments, each named by a hash of its bytes.

    Only those whose first window names the bucket's anchor: all their occurrences are here.
    """
    found = Bucket(rows)
    lead = _leads(found.body)
    # no other context: from the first window that names the anchor on
    may = lead & (np.arange(REACH + 1)[None, :] <= found.left[:, None]) & (np.arange(REACH + 1)[None, :] + found.right[:, None] >= LEAST)
    first = REACH - may[:, ::-1].argmax(1)
    alone = np.flatnonzero(may.any(1) & ~np.isin(np.arange(len(may)), found.several))
    parts = [(alone, first[alone], first[alone] + found.right[alone])]
    for start, members, sizes, lengths, _ in found.repeats(lead):
        parts.append((members, np.full(len(members), start), np.repeat(lengths, sizes)))
    fragment, start, length = (np.concatenate([p[i] for p in parts]) for i in range(3))
    own = lead[fragment, start]
    fragment, start, length = fragment[own], start[own], length[own]
    place = np.arange(SPAN)[None, :]
    names = np.empty(len(fragment), np.uint64)
    for a in range(0, len(fragment), 1 << 13):
        cut = slice(a, a + (1 << 13))
        begin = (REACH - start[cut])[:, None]
        inside = (place >= begin) & (place < begin + length[cut][:, None])
        shifted = np.where(inside, _COLUMNS[0][np.where(inside, place - begin, 0)], np.uint64(0))
        names[cut] = mix64((_BYTES[found.body[fragment[cut]]] * shifted).sum(1, dtype=np.uint64) + length[cut].astype(np.uint64))
    order = np.argsort(fragment, kind="stable")
    n = np.bincount(fragment, minlength=len(may))
    take = order[ragged(n[found.kind], (np.cumsum(n) - n)[found.kind])]
    source = np.repeat(np.arange(len(found.kind)), n[found.kind])
    out = []
    for i, name in enumerate(rows["block"]):
        mine = found.block[source] == i
        if mine.any():
            t = take[mine]
            out.append((name, int(rows["part"].iloc[0]), pack(pickle.dumps((found.own[source[mine]], start[t].astype(np.uint8), length[t].astype(np.uint8), names[t].astype(np.int64)))), None, "group"))
    return _frame(out)


def _occurrences(rows):
    """For a block: a row for each place at which a repeat of its fragments occurs."""
    import pandas as pd

    kinds = dict(iter(rows.groupby("kind")))
    out: dict[str, list] = {"repeat": [], "length": [], "doc_id": [], "at": []}
    if "group" in kinds and "place" in kinds:
        off, ipc = pickle.loads(unpack(kinds["text"].iloc[0]["b"]))
        ids, place = _ids(ipc), kinds["place"].iloc[0]
        at, fragment = from_planes(place["a"]).astype(np.int64), from_planes(place["b"]).astype(np.int64)
        order, n = np.argsort(fragment, kind="stable"), np.bincount(fragment)
        for packed in kinds["group"]["a"]:
            own, start, length, name = pickle.loads(unpack(packed))
            own = own.astype(np.int64)
            where, times = order[ragged(n[own], (np.cumsum(n) - n)[own])], n[own]
            doc = np.searchsorted(off, at[where], side="right") - 1
            for c, x in zip(out, (np.repeat(name, times), np.repeat(length, times), ids[doc], at[where] - np.repeat(start.astype(np.int64), times) - off[doc]), strict=True):
                out[c].append(x.astype(np.int64))
    frame = pd.DataFrame({c: np.concatenate(x) if x else np.zeros(0, np.int64) for c, x in out.items()})
    frame["doc_id"] = frame["doc_id"].astype("Int64").mask(frame["doc_id"] == NULL_ID)
    return frame.drop_duplicates()


def _solve(rows):
    """For a bucket: the repeats of its fragments, sent back to the blocks that hold larger documents."""
    bucket = Bucket(rows)
    block, own, most, kind, small, large = bucket.block, bucket.own, bucket.most, bucket.kind, bucket.small, bucket.large
    wide_left, wide_right = bucket.left, bucket.right
    whole = np.flatnonzero((small < large) & (wide_left + wide_right >= LEAST))
    pieces = [np.stack([whole, wide_left[whole], (wide_left + wide_right)[whole], small[whole]], axis=1)]
    for start, members, sizes, lengths, smallest in bucket.repeats():
        smallest = np.repeat(smallest, sizes)
        hit = smallest < large[members]
        pieces.append(np.stack([members[hit], np.full(int(hit.sum()), start), np.repeat(lengths, sizes)[hit], smallest[hit]], axis=1))
    found = np.concatenate(pieces)
    found = found[np.argsort(found[:, 0], kind="stable")]
    n = np.bincount(found[:, 0], minlength=len(small))
    begin = np.cumsum(n) - n
    take = ragged(n[kind], begin[kind])
    source = np.repeat(np.arange(len(kind)), n[kind])
    hit = found[take, 3] < most[source]
    take, source = take[hit], source[hit]
    cuts = np.searchsorted(block[source], np.arange(len(rows) + 1))
    out = []
    for i, name in enumerate(rows["block"]):
        a, b = cuts[i], cuts[i + 1]
        if b > a:
            f = found[take[a:b]]
            out.append((name, int(rows["part"].iloc[0]), pack(pickle.dumps((own[source[a:b]], f[:, 1].astype(np.uint8), f[:, 2].astype(np.uint8), f[:, 3]))), None, "repeat"))
    return _frame(out)


def _covered(kinds, raw: np.ndarray, off: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which bytes of a block go."""
    edge = np.zeros(len(raw) + 1, dtype=np.int32)
    if "repeat" in kinds and "place" in kinds:
        place = kinds["place"].iloc[0]
        at, fragment = from_planes(place["a"]).astype(np.int64), from_planes(place["b"]).astype(np.int64)
        order = np.argsort(fragment, kind="stable")
        n = np.bincount(fragment)
        begin = np.cumsum(n) - n
        doc = np.searchsorted(off, at, side="right") - 1
        rises: list[np.ndarray] = []
        falls: list[np.ndarray] = []
        held = 0

        def settle() -> None:
            """One pass over the block for many repeats."""
            if rises:
                at_rise, at_fall = np.concatenate(rises), np.concatenate(falls)
                edge[:] += np.bincount(at_rise, minlength=len(edge)).astype(np.int32) - np.bincount(at_fall, minlength=len(edge)).astype(np.int32)
                rises.clear()
                falls.clear()

        for packed in kinds["repeat"]["a"]:
            own, start, length, small = pickle.loads(unpack(packed))
            for a in range(0, len(own), 1 << 16):
                cut = slice(a, a + (1 << 16))
                f = own[cut].astype(np.int64)
                where, times = order[ragged(n[f], begin[f])], n[f]
                hit = ids[doc[where]] > np.repeat(small[cut], times)
                begins = (at[where] - np.repeat(start[cut].astype(np.int64), times))[hit]
                rises.append(begins)
                falls.append(begins + np.repeat(length[cut].astype(np.int64), times)[hit])
                held += len(begins)
                if held > SETTLED:
                    settle()
                    held = 0
        settle()
    return np.cumsum(edge[:-1]) > 0


def _cut(digests: bool):
    def run(rows):
        import pandas as pd
        import pyarrow as pa

        kinds = dict(iter(rows.groupby("kind")))
        text = kinds["text"].iloc[0]
        raw, (off, ipc) = np.frombuffer(unpack(text["a"]), np.uint8), pickle.loads(unpack(text["b"]))
        gone = _covered(kinds, raw, off, _ids(ipc))
        out = pa.ipc.open_stream(ipc).read_all().drop_columns(["_id"]).to_pandas(types_mapper=pd.ArrowDtype)
        total = np.append(0, np.cumsum(gone))
        rises = gone & ~np.append(False, gone[:-1])
        rises[off[:-1][np.diff(off) > 0]] = gone[off[:-1][np.diff(off) > 0]]
        spans = np.append(0, np.cumsum(rises))
        kept = raw[~gone].tobytes()
        ends = (off - total[off]).tolist()
        parts = [kept[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        if digests:
            out["n_bytes"], out["n_removed"], out["n_spans"] = np.diff(off), np.diff(total[off]), np.diff(spans[off])
            out["kept_sha256"] = [hashlib.sha256(p).hexdigest() for p in parts]
        else:
            out["text"] = [p.decode("utf-8", "ignore") for p in parts]
        return out

    return run


def _solved(rows: DataFrame, solve) -> DataFrame | None:
    """Rows (SCHEMA) of each block of rows(_id, ..., text): its text, the places of its fragments, and what solve found.

    None for a table without rows.
    """
    spark = rows.sparkSession
    total = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0]
    if total is None:
        return None
    buckets = max(LEAST_BUCKETS, total // BUCKET_BYTES)
    where = f"{scratch_root(spark)}/tidemark/{uuid.uuid4().hex}-repeats"
    rows.mapInArrow(_blocks(buckets), SCHEMA).write.partitionBy("kind").parquet(where)
    read = lambda kind: spark.read.schema(SCHEMA).parquet(where).filter(F.col("kind") == kind)
    bits = table(read("key").groupBy("part").applyInPandas(released(_answer), SCHEMA), "repeat-bits")
    discard(spark, f"{where}/kind=key")
    found = f"{where}-fragments"
    read("text").unionByName(bits).groupBy("block").applyInPandas(released(_fragments(buckets)), SCHEMA).write.partitionBy("kind").parquet(found)
    drop(bits)
    pieces = lambda kind: spark.read.schema(SCHEMA).parquet(found).filter(F.col("kind") == kind)
    repeats = table(pieces("fragment").groupBy("part").applyInPandas(released(solve), SCHEMA), "repeat-groups")
    discard(spark, f"{found}/kind=fragment")
    return read("text").unionByName(pieces("place")).unionByName(repeats)


def repeat_groups(docs: DataFrame) -> DataFrame:
    """Rows (repeat, length, doc_id, at): the maximal repeats of LEAST bytes and more, each with all its occurrences.

    repeat names the bytes, at is the first one's place in the document's UTF-8. A repeat is told within SPAN bytes around
    an anchor: a longer one is a chain of overlapping repeats, whose union it is. An anchor that only one document has is
    left out, as are repeats that another one extends to the left at all its occurrences. Null texts and ids, repeated rows and empty tables
    as in remove_repeats.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), text_of().alias("text"))
    schema = "repeat bigint, length bigint, doc_id bigint, at bigint"
    parts = _solved(rows, _groups)
    if parts is None:
        return docs.sparkSession.createDataFrame([], schema)
    return parts.groupBy("block").applyInPandas(released(_occurrences), schema).distinct()


def remove_repeats(docs: DataFrame, carry: tuple[str, ...] = (), digests: bool = False) -> DataFrame:
    """Rows (doc_id, *carry, text): docs without the bytes that a string of LEAST bytes of a smaller document covers.

    Strings are judged on the input, overlaps count, matches never cross documents; what is cut inside a character takes
    the rest of it along in text. digests gives (n_bytes, n_removed, n_spans, kept_sha256) of the bytes instead. A null
    text is empty, a null doc_id smaller than any other (as -2^63, which no other document may have); a very long text is a
    block of its own; rows with equal doc_id don't cut one another. An empty table
    gives an empty result; other columns are ignored unless in carry.
    """
    spark = docs.sparkSession
    inside = [f"_c{i}" for i in range(len(carry))]
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("doc_id"), *[F.col(f"`{c}`").alias(i) for c, i in zip(carry, inside, strict=True)], text_of().alias("text"))
    more = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" if digests else "text string"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("_id", "text")), more])
    parts = _solved(rows, _solve)
    named = [F.col(i).alias(c) for i, c in zip(inside, carry, strict=True)]
    if parts is None:
        out = spark.createDataFrame([], schema)
    else:
        out = parts.groupBy("block").applyInPandas(released(_cut(digests)), schema)
    return out.select("doc_id", *named, *out.columns[1 + len(inside) :])


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of docs with repeats cut from text and, where there is such a column, n_chars counted anew."""
    out = remove_repeats(docs, carry=tuple(c for c in docs.columns if c not in ("doc_id", "text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
