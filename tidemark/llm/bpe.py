"""BPE encoding and decoding by a distinct-word table.

Texts are split at ASCII white space, which a vocabulary with white space removed before its words never spans. Blocks of
documents keep their words once, in a local list, and each position as a number in that list. The lists are dealt by word
hash to buckets; a bucket unites them into its part of the distinct-word table, encodes each distinct word once, and sends
ids back to the blocks, where they are joined to the positions. Words travel once a block, not once an occurrence, so a
frequent word weighs no more than a rare one. Decoding joins ids to the vocabulary's table of pieces, whose size is fixed.
"""

from __future__ import annotations

import functools
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bucketed, byte_batches, discard, from_planes, pack, planes, ragged, released, text_of, unpack

#: Text bytes of a block: bounds the memory of every task here.
BLOCK_BYTES = 4 << 20
#: Text bytes to a bucket of words, LEAST_BUCKETS at least: bounds what a bucket's task holds.
BUCKET_BYTES, LEAST_BUCKETS = 16 << 20, 64
#: Text bytes to a file bucket of blocks.
FILE_BYTES = 32 << 20

_words = re.compile(r"[^ \t\n\r\x0b\x0c]+")


@functools.cache
def library(model: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(model)
    t.no_truncation()
    t.no_padding()
    return t


@functools.cache
def pieces(model: str) -> list[str]:
    """The id-to-piece table; an id without a piece has the empty one."""
    t = library(model)
    vocab = t.get_vocab(with_added_tokens=True)
    out = [""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        out[i] = piece
    return out


def splits_at_white_space(model: str) -> bool:
    """Whether words can be encoded alone: white space turns into spaces, words exclude it, and ids don't depend on neighbours."""
    import json

    spec = json.load(open(model))
    normal, pre = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
    split = (pre.get("pretokenizers") or [{}])[0]
    return {n.get("type") for n in normal.get("normalizers", [])} <= {"NFC", "Replace", "Lowercase"} and split.get("type") == "Split" and split.get("behavior") == "Removed" and bool(split.get("invert")) and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in spec["added_tokens"])


def encode(docs: DataFrame, model: str, carry: tuple[str, ...] = (), digests: bool = False) -> DataFrame:
    """Rows (doc_id, *carry, ids): ids as the tokenizers library gives them without added special tokens.

    ids is binary, little-endian unsigned 32-bit; digests gives what decode(..., digests=True) makes of them instead, in
    the same pass. Special tokens inside a text are taken as such, the library's default. A null or empty text has no ids;
    a very long one is a block of its own, encoded whole. Repeated rows give repeated results; an empty table gives an empty result; other columns are ignored unless in carry.
    A vocabulary whose words depend on white space raises ValueError.
    """
    if not splits_at_white_space(model):
        raise ValueError("this vocabulary can't be encoded word by word")
    spark = docs.sparkSession
    rows = docs.select("doc_id", *carry, text_of().alias("text"))
    head = rows.drop("text").schema
    more = DIGESTS if digests else "ids binary"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in head), more])
    total = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0]
    if total is None:
        return spark.createDataFrame([], schema)
    buckets, files = max(LEAST_BUCKETS, total // BUCKET_BYTES), max(12, total // FILE_BYTES)

    def to_blocks(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in byte_batches(batches, lambda b: pc.binary_length(b.column(b.num_columns - 1)).to_numpy(zero_copy_only=False), BLOCK_BYTES, most_rows=1 << 20):
            local: dict[str, int] = {}
            number, seq, counts = local.setdefault, [], []
            for t in batch.column(batch.num_columns - 1):
                words = _words.findall(t.as_py())
                counts.append(len(words))
                seq.append(np.fromiter((number(w, len(local)) for w in words), dtype=np.uint32, count=len(words)))
            # words are numbered as the buckets send them back; in order they compress better
            words = [w.encode() for w in local]
            part = np.fromiter((zlib.crc32(w) % buckets for w in words), dtype=np.int64, count=len(words))
            order = sorted(range(len(words)), key=words.__getitem__)
            order = np.array(order, dtype=np.int64)[np.argsort(part[order], kind="stable")] if words else np.zeros(0, np.int64)
            renumbered = np.empty(len(words), dtype=np.uint32)
            renumbered[order] = np.arange(len(words), dtype=np.uint32)
            cuts = np.searchsorted(part[order], np.arange(buckets + 1))
            dealt = [[words[j] for j in order[cuts[i] : cuts[i + 1]]] for i in range(buckets)]
            del local, words
            block, held = uuid.uuid4().hex, pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held.schema) as w:
                w.write_batch(held)
            seq = np.concatenate(seq)
            out = [{"kind": "at", "block": block, "part": -1, "a": planes(np.concatenate([np.array(counts, dtype=np.uint32), renumbered[seq]])), "b": pack(sink.getvalue().to_pybytes())}]
            out += [{"kind": "words", "block": block, "part": i, "a": pack(b" ".join(d)), "b": None} for i, d in enumerate(dealt) if d]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("block", pa.string()), ("part", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("kind", pa.string())]))

    def code(lists):
        import pandas as pd

        texts = [unpack(x).decode().split(" ") for x in lists["a"]]
        distinct: dict[str, int] = {}
        own = [np.fromiter((distinct.setdefault(w, len(distinct)) for w in t), dtype=np.int64, count=len(t)) for t in texts]
        del texts
        flat, lengths, whole = [], [], list(distinct)
        for at in range(0, len(whole), 5_000):
            ids = [e.ids for e in library(model).encode_batch_fast(whole[at : at + 5_000], add_special_tokens=False)]
            lengths += map(len, ids)
            flat.append(np.fromiter((i for x in ids for i in x), dtype=np.uint32))
        flat, lengths = np.concatenate(flat), np.array(lengths, dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        return pd.DataFrame({"block": lists["block"].to_numpy(), "part": lists["part"].to_numpy(), "n": [planes(lengths[x]) for x in own], "ids": [planes(flat[ragged(lengths[x], starts[x])]) for x in own]})

    def join(at, lists):
        import pandas as pd
        import pyarrow as pa

        docs_ = pa.ipc.open_stream(unpack(at["b"].iloc[0])).read_all()
        numbers = from_planes(at["a"].iloc[0])
        counts, seq = numbers[: docs_.num_rows].astype(np.int64), numbers[docs_.num_rows :].astype(np.int64)
        order = np.argsort(lists["part"].to_numpy())
        lengths, flat = (np.concatenate([np.zeros(0, "<u4"), *[from_planes(lists[c].iloc[i]) for i in order]]) for c in ("n", "ids"))
        lengths = lengths.astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        raw = flat[ragged(lengths[seq], starts[seq])].astype("<u4").tobytes()
        ends = 4 * np.append(0, np.cumsum(lengths[seq]))[np.cumsum(counts)]
        ids = [raw[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
        out = docs_.to_pandas(types_mapper=pd.ArrowDtype)
        if digests:
            for name, values in zip(("n_tokens", "ids_sha256", "decoded_sha256"), zip(*map(digester(model), ids), strict=True), strict=True):
                out[name] = values
        else:
            out["ids"] = ids
        return out

    blocks, path = bucketed(rows.mapInArrow(to_blocks, "block string, part int, a binary, b binary, kind string"), "blocks", files, "block", by="kind")
    words = blocks.filter("kind = 'words'").select("block", "part", "a")
    coded, _ = bucketed(words.groupBy("part").applyInPandas(released(code), "block string, part int, n binary, ids binary"), "coded", files, "block")
    discard(spark, f"{path}/kind=words")
    return blocks.filter("kind = 'at'").select("block", "a", "b").groupBy("block").cogroup(coded.groupBy("block")).applyInPandas(released(join), schema)


DIGESTS = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def decoder(model: str) -> Callable[[bytes], str]:
    """Text of packed ids: each id joined to its piece in the vocabulary's table, one that it doesn't have left out."""
    piece = pieces(model)
    plain = library(model).decoder is None

    def text(raw: bytes) -> str:
        ids = np.frombuffer(raw, "<u4").tolist()
        if not plain:
            return library(model).decode(ids, skip_special_tokens=False)
        return " ".join([piece[i] for i in ids if i < len(piece)])

    return text


def digester(model: str) -> Callable[[bytes], tuple[int, str, str]]:
    """(number of ids, SHA-256 of the ids in decimal, SHA-256 of the text that they decode to) of packed ids."""
    text = decoder(model)
    decimal = [str(i) for i in range(len(pieces(model)))]

    def digest(raw: bytes) -> tuple[int, str, str]:
        ids = np.frombuffer(raw, "<u4").tolist()
        shown = " ".join([decimal[i] if i < len(decimal) else str(i) for i in ids])
        return len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(text(raw).encode()).hexdigest()

    return digest


def decode(encoded: DataFrame, model: str, digests: bool = False) -> DataFrame:
    """Columns of encoded but ids, with text: ids joined to their pieces, as the library's decode does without skipping any.

    digests gives (n_tokens, ids_sha256, decoded_sha256) in place of the text. Null ids are no ids; an id that the
    vocabulary doesn't have is left out of the text, as the library does.
    """
    keep = [c for c in encoded.columns if c != "ids"]

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        make = digester(model) if digests else decoder(model)
        for batch in byte_batches(batches, lambda b: pc.binary_length(b.column(b.num_columns - 1)).to_numpy(zero_copy_only=False), 4 << 20):
            rows = [make(raw or b"") for raw in batch.column(batch.num_columns - 1).to_pylist()]
            if digests:
                made, names = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)], ["n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                made, names = [pa.array(rows, pa.string())], ["text"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*keep, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != "ids"), DIGESTS if digests else "text string"])
    return encoded.select(*keep, F.coalesce("ids", F.lit(b"")).alias("ids")).mapInArrow(run, schema)
