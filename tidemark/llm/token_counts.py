"""Token counts by a SentencePiece model: Arrow batches balanced by bytes, lengths only.

Texts are split where no piece of the vocabulary can reach across: before each run of spaces, as no piece has the space
mark after another character. The vocabulary is examined for that; with a piece that does, texts are encoded whole.
Segments repeat, so each worker keeps the counts of those it has seen in a dictionary of bounded size.
"""

from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import DataFrame

from .shared import byte_batches, text_of

BATCH_BYTES = 4 << 20
CACHE_SEGMENTS = 1_000_000
#: Longer segments aren't kept.
CACHE_CHARS = 48
#: Segments that are encoded in one call.
CALL_SEGMENTS = 20_000

_segments = re.compile(" *[^ ]+| +")


class Counter:
    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.safe = not any("▁" in p.lstrip("▁") for p in pieces) and self.model.encode("a b") == self.model.encode("a") + self.model.encode("b")
        self.known: dict[str, int] = {}

    def lengths(self, segments: list[str]) -> list[int]:
        """Of segments without the one space (or text start) that precedes each."""
        out: list[int] = []
        for at in range(0, len(segments), CALL_SEGMENTS):
            out += [len(x) for x in self.model.encode(segments[at : at + CALL_SEGMENTS], num_threads=1)]
        return [n if s else 1 for n, s in zip(out, segments, strict=True)]  # nothing after the space: the space mark alone

    def split(self, text: str) -> list[str]:
        text = text.replace("▁", " ")  # the library writes a space so, and can't tell the two apart
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [s[1:] for s in _segments.findall(" " + text)]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.safe:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        if len(self.known) > CACHE_SEGMENTS:
            self.known = {}
        known, parts = self.known, [self.split(t) if t else [] for t in texts]
        missing: dict[str, None] = {}
        for p in parts:
            missing.update(dict.fromkeys(s for s in p if s not in known))
        new = list(missing)
        found = dict(zip(new, self.lengths(new), strict=True))
        for s, n in found.items():
            if len(s) <= CACHE_CHARS:
                known[s] = n
        if len(known) and all(len(s) <= CACHE_CHARS for s in new):
            return [sum(map(known.__getitem__, p)) for p in parts]
        return [sum(found[s] if s in found else known[s] for s in p) for p in parts]


@functools.cache
def counter(model: str) -> Counter:
    return Counter(model)


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one a row of docs, without begin and end tokens.

    A null text is empty: 0 bytes, 0 tokens. Special strings inside a text are ordinary text, as the library has it. A very
    long text is cut where no piece reaches across and counted whole.
    Repeated rows give repeated results, an empty table none; other columns are ignored. model is a path that every
    executor can open.
    """

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        count = counter(model)
        for batch in byte_batches(batches, lambda b: pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False), BATCH_BYTES):
            text = batch.column(1)
            n = np.array(count.counts(text.to_pylist()), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pc.binary_length(text).to_numpy(zero_copy_only=False), pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
