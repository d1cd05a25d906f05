"""Token-ID output: shards of raw ids in ascending document order, each with a minimal perfect hash index of its keys.

A shard is a row of a Parquet table: the payload holds the ids of its documents end to end, little-endian, 2 or 4 bytes
each; the index takes a document key to a slot without a collision, and the slot holds a fingerprint of the key and the
place of its ids, so access by key costs a few hash probes whatever the shard's size, and a foreign key is refused.
The column keys lists the distinct keys for scans of everything; keyed access (Shard.get, and lookup for a table of keys)
doesn't read it.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import byte_batches, discard, mix64, ragged, scratch_root, table, text_of

SHARD_BYTES = 4 << 20
#: Text bytes that are encoded together: the more, the fewer chunks are encoded twice.
BATCH_BYTES = 32 << 20
#: A null document key.
NULL_KEY = -(2**63)
GAMMA = 2.0
_LEVEL = 0x9E3779B97F4A7C15
_PRINT = np.uint64(0xD6E8FEB86659FD93)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: levels of bit arrays, a key's slot is the rank of its bit.

    At each level the keys that share a place with another move to the next one; those alone set their bit.
    """

    def __init__(self, levels: list[np.ndarray], slots: np.ndarray):
        self.levels, self.slots = levels, slots
        self.before = np.cumsum([0, *[int(x.sum()) for x in levels]])
        self.ranks = [np.cumsum(x) - x for x in levels]

    @staticmethod
    def places(keys: np.ndarray, level: int, m: int) -> np.ndarray:
        return (mix64(keys + np.uint64(_LEVEL * (level + 1) % 2**64)) % np.uint64(m)).astype(np.int64)

    @staticmethod
    def prints(keys: np.ndarray) -> np.ndarray:
        return (mix64(keys ^ _PRINT) >> np.uint64(32)).astype(np.uint32)

    @classmethod
    def build(cls, keys: np.ndarray, values: np.ndarray) -> PerfectHash:
        """values: a structured row for each key, without the fingerprint."""
        keys, rest, levels = keys.astype(np.uint64), keys.astype(np.uint64), []
        while len(rest):
            m = max(64, int(GAMMA * len(rest)))
            at = cls.places(rest, len(levels), m)
            alone = np.bincount(at, minlength=m)[at] == 1
            bits = np.zeros(m, dtype=bool)
            bits[at[alone]] = True
            levels.append(bits)
            rest = rest[~alone]
        made = cls(levels, np.zeros((len(keys), 1 + values.shape[1]), dtype=np.uint64))
        slot = made.slot(keys)
        made.slots[slot, 0] = cls.prints(keys)
        made.slots[slot, 1:] = values
        return made

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where no level has its bit."""
        keys = keys.astype(np.uint64)
        out, open_ = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for i, bits in enumerate(self.levels):
            at = self.places(keys[open_], i, len(bits))
            hit = bits[at]
            out[open_[hit]] = self.before[i] + self.ranks[i][at[hit]]
            open_ = open_[~hit]
        return out

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of each key; KeyError for a key whose fingerprint isn't the stored one."""
        slot = self.slot(np.asarray(keys))
        if (slot < 0).any() or (self.slots[slot, 0] != self.prints(np.asarray(keys).astype(np.uint64))).any():
            raise KeyError("no such document")
        return self.slots[slot, 1:].astype(np.int64)

    def dump(self) -> bytes:
        head = struct.pack("<4sIII", b"TMPH", len(self.levels), *self.slots.shape) + b"".join(struct.pack("<Q", len(x)) for x in self.levels)
        return head + b"".join(np.packbits(x).tobytes() for x in self.levels) + self.slots.astype("<u8").tobytes()

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        magic, levels, rows, width = struct.unpack_from("<4sIII", data)
        if magic != b"TMPH":
            raise ValueError("not an index")
        sizes = struct.unpack_from(f"<{levels}Q", data, 16)
        at, out = 16 + 8 * levels, []
        for m in sizes:
            n = -(-m // 8)
            out.append(np.unpackbits(np.frombuffer(data, np.uint8, n, at))[:m].astype(bool))
            at += n
        return cls(out, np.frombuffer(data, "<u8", rows * width, at).reshape(rows, width))


class Encoder:
    """ids of texts as the tokenizers library gives them for a byte-level vocabulary, each distinct chunk of a batch once.

    A text may be cut before any space that a character other than white space follows: the pattern of this kind of
    vocabulary joins such a space to what follows it, and a longer run of white space gives up its last space. Special
    tokens are cut out first. The ids of a batch of texts are one gather from those of its distinct chunks.
    """

    chunks = re.compile(r" (?=\S)")
    odd = re.compile(r" (?:\s|\Z)")
    #: Chunks that the library gets as one text: each begins with a space, so its first token shows where it begins.
    joined = 2000

    def __init__(self, model: str):
        import json

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share out the cores already
        self.library = Tokenizer.from_file(model)
        self.library.no_truncation()
        self.library.no_padding()
        with open(model, encoding="utf-8") as f:
            spec = json.load(f)
        pre, tokens = spec["pre_tokenizer"] or {}, spec["added_tokens"]
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex")
        self.cut = spec["normalizer"] is None and plain and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in tokens)
        self.added = {t["content"]: t["id"] for t in tokens}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        vocab = self.library.get_vocab(with_added_tokens=True)
        last = max(vocab.values(), default=0)
        self.dtype = np.dtype("<u2" if last < 65536 else "<u4")
        #: whether a token begins with a space, which the vocabulary writes as U+0120
        self.spaced = np.zeros(last + 1, dtype=bool)
        self.spaced[[i for piece, i in vocab.items() if piece.startswith("\u0120")]] = True

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.dtype) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def after_space(self, chunks) -> list[np.ndarray]:
        """[ids of the chunks, end to end, and how many each has]: chunks, without spaces, that follow a space (Arrow)."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(chunks):
            return [np.zeros(0, self.dtype), np.zeros(0, np.int64)]
        cuts = np.append(np.arange(0, len(chunks), self.joined), len(chunks))
        runs = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), chunks.cast(pa.string())), " ")
        flat = np.concatenate(self.whole([" " + r for r in runs.to_pylist()]))
        start = np.flatnonzero(self.spaced[flat])
        if len(start) == len(chunks) and start[0] == 0:
            return [flat, np.diff(np.append(start, len(flat)))]
        parts = self.whole([" " + s for s in chunks.to_pylist()])
        return [np.concatenate(parts), np.array([len(p) for p in parts])]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.cut:
            return [x.tobytes() for x in self.whole(texts)]
        import pyarrow as pa
        import pyarrow.compute as pc

        is_odd = np.array([bool(self.odd.search(t) or (self.special and self.special.search(t))) for t in texts], dtype=bool)
        plain, rest = np.flatnonzero(~is_odd), np.flatnonzero(is_odd)
        # plain texts: split at every space, all at once
        lists = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
        flat, count = lists.flatten(), np.diff(lists.offsets.to_numpy())
        first = np.cumsum(count) - count
        follows = np.ones(len(flat), dtype=bool)
        follows[first] = False
        coded = flat.filter(pa.array(follows)).dictionary_encode()
        ids, n = ([x] for x in self.after_space(coded.dictionary))
        # other chunks by (whether they follow a space, chunk), and special tokens by their id
        number: dict = {}
        store = lambda key: number.setdefault(key, len(coded.dictionary) + len(number))
        begins = [store((False, s)) for s in flat.take(pa.array(first)).to_pylist()]
        cut: list[list[int]] = []
        for i in rest.tolist():
            own: list[int] = []
            for j, run in enumerate(self.special.split(texts[i]) if self.special else [texts[i]]):
                if j % 2:
                    own.append(store(self.added[run]))
                elif run:
                    own += [store((k > 0, s)) for k, s in enumerate(self.chunks.split(run))]
            cut.append(own)
        keys = list(number)
        encoded = iter(self.whole([" " * k[0] + k[1] for k in keys if isinstance(k, tuple)]))
        parts = [next(encoded) if isinstance(k, tuple) else np.array([k], dtype=self.dtype) for k in keys]
        ids, n = np.concatenate([*ids, *parts]), np.concatenate([*n, np.array([len(p) for p in parts], dtype=np.int64)])
        # chunk numbers of all texts end to end
        size = np.zeros(len(texts), dtype=np.int64)
        size[plain], size[rest] = count, [len(own) for own in cut]
        at = np.cumsum(size) - size
        of = np.empty(int(size.sum()), dtype=np.int64)
        of[ragged(count, at[plain])[follows]] = coded.indices.to_numpy()
        of[at[plain]] = begins
        for i, own in zip(rest.tolist(), cut, strict=True):
            of[at[i] : at[i] + len(own)] = own
        raw = ids[ragged(n[of], (np.cumsum(n) - n)[of])].tobytes()
        ends = np.append(0, np.cumsum(n[of]))[np.append(at, len(of))] * self.dtype.itemsize
        return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


@functools.cache
def encoder(model: str) -> Encoder:
    return Encoder(model)


SHARD_SCHEMA = "shard bigint, first_key bigint, last_key bigint, n_docs bigint, n_ids bigint, width int, payload binary, index binary, keys binary"


def _encoded(docs: DataFrame, model: str) -> DataFrame:
    """Rows (doc_id, text_hash, ids): each text's ids in the payload's form."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        code = encoder(model)
        for batch in byte_batches(batches, lambda b: pc.binary_length(b.column(2)).to_numpy(zero_copy_only=False), BATCH_BYTES, most_rows=1 << 16):
            ids = code.encode(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["doc_id", "text_hash", "ids"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("doc_id"), F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, ids binary")


def write_shards(docs: DataFrame, model: str, path: str, end_id: int | None = 2) -> None:
    """Write the shards of docs (doc_id integer, text) to path; end_id closes each document.

    Documents go in ascending doc_id, a null one first (as the key -2^63, which no other document may have); rows with the
    same doc_id go in order of a hash of the text and may run over several shards, each of which finds its own. A null text
    is empty; a very long one is encoded whole and may fill a shard of its own. No documents, no shards. Texts are encoded
    before they are dealt: ids are sorted, not texts.
    """

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        dtype = encoder(model).dtype
        width = np.dtype(dtype).itemsize
        end = b"" if end_id is None else np.array([end_id], dtype=dtype).tobytes()
        task = TaskContext.get().partitionId()
        keys: list[int] = []
        parts: list[bytes] = []
        size = done = 0

        def shard():
            n = np.array([len(p) // width for p in parts], dtype=np.int64)
            start = np.cumsum(n) - n
            key, at, rows = np.unique(np.array(keys, dtype=np.int64), return_index=True, return_counts=True)
            ends = start + n
            values = np.stack([start[at], ends[at + rows - 1], at, rows], axis=1).astype(np.uint64)
            index = struct.pack("<Q", len(n)) + n.astype("<u4").tobytes() + PerfectHash.build(key.view(np.uint64), values).dump()
            whole = pa.large_binary() if size >= 2**31 else pa.binary()
            names = ["shard", "first_key", "last_key", "n_docs", "n_ids", "width", "payload", "index", "keys"]
            kinds = [pa.int64()] * 5 + [pa.int32(), whole, pa.binary(), pa.binary()]
            row = [(task << 32) + done, keys[0], keys[-1], len(n), int(n.sum()), width, b"".join(parts), index, key.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

        for batch in byte_batches(batches, lambda b: pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False), BATCH_BYTES, most_rows=1 << 16):
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if size >= SHARD_BYTES:
                    yield shard()
                    keys, parts, size, done = [], [], 0, done + 1
                keys.append(key)
                parts.append(ids + end)
                size += len(parts[-1])
        if keys:
            yield shard()

    spark = docs.sparkSession
    encoded = f"{scratch_root(spark)}/tidemark/{uuid.uuid4().hex}-encoded"
    _encoded(docs, model).write.option("compression", "zstd").parquet(encoded)
    rows = spark.read.schema("doc_id bigint, text_hash bigint, ids binary").parquet(encoded)
    rows.repartitionByRange("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash").select("doc_id", "ids").mapInArrow(run, SHARD_SCHEMA).write.option("compression", "zstd").parquet(path)
    discard(spark, encoded)


class Shard:
    """Constant-time keyed access to one row of the table."""

    def __init__(self, payload: bytes, index: bytes, width: int):
        n = struct.unpack_from("<Q", index)[0]
        self.sizes = np.frombuffer(index, "<u4", n, 8).astype(np.int64)
        self.index = PerfectHash.load(index[8 + 4 * n :])
        self.ids = np.frombuffer(payload, "<u2" if width == 2 else "<u4")

    def get(self, key: int | None) -> np.ndarray:
        """The ids under a key, of all its rows in this shard end to end; KeyError if there is none."""
        start, end, _, _ = self.index.get(np.array([NULL_KEY if key is None else key], dtype=np.int64).view(np.uint64))[0]
        return self.ids[start:end]


def read_documents(shards: DataFrame) -> DataFrame:
    """Rows (doc_id, shard, at, n_tokens, ids_crc32) looked up in the shards through their indexes; at counts ids in the shard."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                payload, index, keys, width, number = (batch.column(i)[row].as_py() for i in range(5))
                shard = Shard(payload, index, width)
                keys = np.frombuffer(keys, dtype=np.int64)
                found = shard.index.get(keys.view(np.uint64))
                starts = np.cumsum(shard.sizes) - shard.sizes
                at, rows = found[:, 2], found[:, 3]
                d = ragged(rows, at)
                raw = shard.ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(starts[d].tolist(), shard.sizes[d].tolist(), strict=True)]
                owner = np.repeat(keys, rows)
                arrays = [pa.array(owner, mask=owner == NULL_KEY), pa.array(np.full(len(d), number)), pa.array(starts[d]), pa.array(shard.sizes[d]), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "shard", "at", "n_tokens", "ids_crc32"])

    return shards.select("payload", "index", "keys", "width", "shard").mapInArrow(run, "doc_id bigint, shard bigint, at bigint, n_tokens bigint, ids_crc32 bigint")


def lookup(shards: DataFrame, keys: DataFrame, column: str = "doc_id", spans: int = 1024) -> DataFrame:
    """Rows (doc_id, shard, ids) for the distinct keys that some shard holds; ids (binary, as stored) of all rows of the key there.

    Keys meet the key ranges of the shards first, by spans of the key order, and only then the shards that may hold them:
    each shard is read once and answers through its index, which refuses the keys that fall in its range but aren't stored.
    """
    ranges = shards.select("shard", "first_key", "last_key")
    edges = ranges.select(F.percentile_approx("first_key", [i / spans for i in range(1, spans)], 10 * spans).alias("e")).first()["e"]  # at most spans numbers
    edges = np.unique(np.array(edges or [], dtype=np.int64))
    key = F.coalesce(F.col(column).cast("long"), F.lit(NULL_KEY))
    wanted = keys.select(key.alias("key")).distinct()

    def spread(first: str, last: str, schema: str):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                a, b = (np.searchsorted(edges, batch.column(c).to_numpy(), side="right") for c in (first, last))
                n = b - a + 1
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(np.repeat(np.arange(len(n)), n))) for c in batch.columns), pa.array(ragged(n, a))], [*batch.schema.names, "span"])

        return run, schema + ", span bigint"

    def near(want, have):
        import pandas as pd

        if not len(want) or not len(have):
            return pd.DataFrame({"shard": [], "key": []}).astype("int64")
        have, k = have.sort_values("shard"), np.sort(want["key"].to_numpy())  # shards follow one another in key order
        a, b = np.searchsorted(k, have["first_key"].to_numpy(), side="left"), np.searchsorted(k, have["last_key"].to_numpy(), side="right")
        return pd.DataFrame({"shard": np.repeat(have["shard"].to_numpy(), b - a), "key": k[ragged(b - a, a)]})

    by_key = wanted.mapInArrow(*spread("key", "key", "key bigint"))
    by_range = ranges.mapInArrow(*spread("first_key", "last_key", "shard bigint, first_key bigint, last_key bigint"))
    pairs = by_key.groupBy("span").cogroup(by_range.groupBy("span")).applyInPandas(near, "shard bigint, key bigint").distinct()

    def take(want, have):
        import pandas as pd

        if not len(want) or not len(have):
            return pd.DataFrame({"doc_id": [], "shard": [], "ids": []})
        row = have.iloc[0]
        shard, out = Shard(row["payload"], row["index"], row["width"]), []
        for k in want["key"].tolist():
            try:
                out.append((None if k == NULL_KEY else k, row["shard"], shard.get(k).tobytes()))
            except KeyError:
                continue
        return pd.DataFrame(out, columns=["doc_id", "shard", "ids"]).astype({"doc_id": "Int64"})

    held = shards.select("shard", "payload", "index", "width")
    return pairs.groupBy("shard").cogroup(held.groupBy("shard")).applyInPandas(take, "doc_id bigint, shard bigint, ids binary")


def id_documents(docs: DataFrame, model: str, path: str | None = None, end_id: int | None = 2) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32): docs written as shards (at path, else in the shared folder) and read back.

    start counts the ids of all documents before it. Null, empty, very long and repeated rows: as write_shards has them.
    Other columns of docs are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = path or f"{scratch_root(spark)}/tidemark/{uuid.uuid4().hex}-shards"
    write_shards(docs, model, path, end_id)
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    # shards are numbered by the task that wrote them: sums of the tasks first, then those inside a task
    sizes = shards.select("shard", "n_ids", F.shiftright("shard", 32).alias("_task"))
    upto = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = sizes.groupBy("_task").agg(F.sum("n_ids").alias("_n")).select("_task", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_task_at"))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("_task").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("_in_task", inside).join(tasks, "_task").select("shard", (F.col("_task_at") + F.col("_in_task")).alias("_before"))
    rows = table(read_documents(shards), "shard-rows")
    return rows.join(starts, "shard").select("doc_id", (F.col("_before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
