"""Media columns: telephony audio. Bytes are stored as mu-law, A-law or IMA ADPCM in WAVE files and decoded with numpy.

mu-law and A-law expand through lookup tables. ADPCM blocks are independent, so one loop over the samples of a block
decodes all blocks of a batch side by side. PCM is resampled from 8 to 16 kHz by an integer half-band filter and stored
beside the file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .shared import byte_batches, scratch_root, text_of

RATE, UNIT = 8000, 192
#: The rate that PCM is stored at.
PCM_RATE = 16000
BATCH_BYTES = 1 << 20
#: How the stored table is compressed: telephony has few values, whose patterns long pages find again.
PARQUET = {"compression": "zstd", "parquet.compression.codec.zstd.level": "12", "parquet.page.size": str(8 << 20)}
#: Flags of stored PCM: its even samples are differences; odd samples aren't all as the half-band filter has them.
DIFFERENCES, CORRECTED = 1, 2
#: WAVE format tags.
MULAW, ALAW, ADPCM = 7, 6, 17
NAMES = {MULAW: "mulaw", ALAW: "alaw", ADPCM: "ima-adpcm"}
#: Bytes of an ADPCM block's header: first sample (int16), step index, reserved.
HEAD = 4

# Fixed values of the IMA ADPCM standard: quantiser steps, and the change of the step index by the low three bits.
STEPS = (7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767)
CHANGES = (-1, -1, -1, -1, 2, 4, 6, 8)


def _mulaw() -> np.ndarray:
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    x = ((((u & 15) << 3) + 132) << ((u >> 4) & 7)) - 132
    return np.where(u & 128, -x, x).astype(np.int16)


def _alaw() -> np.ndarray:
    a = np.arange(256, dtype=np.int32) ^ 0x55
    e, x = (a >> 4) & 7, ((a & 15) << 4) + 8
    x = np.where(e > 0, (x + 256) << np.maximum(e - 1, 0), x)
    return np.where(a & 128, x, -x).astype(np.int16)


def _adpcm() -> tuple[np.ndarray, np.ndarray]:
    """What a 4-bit code adds to the sample, and the next step index, for each (step index, code)."""
    step, code = np.array(STEPS, dtype=np.int32)[:, None], np.arange(16, dtype=np.int32)[None, :]
    add = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
    after = np.clip(np.arange(len(STEPS))[:, None] + np.array(CHANGES)[code & 7], 0, len(STEPS) - 1)
    return np.where(code & 8, -add, add).astype(np.int32).ravel(), after.astype(np.int32).ravel()


EXPAND = {MULAW: _mulaw(), ALAW: _alaw()}
ADDS, NEXT = _adpcm()


def write_wave(payload: bytes, tag: int) -> bytes:
    """A mono WAVE file whose samples (ADPCM: 4-bit codes) are the bytes of payload, a multiple of UNIT bytes."""
    if tag == ADPCM:
        data = np.zeros((len(payload) // UNIT, HEAD + UNIT), dtype=np.uint8)
        data[:, HEAD:] = np.frombuffer(payload, dtype=np.uint8).reshape(-1, UNIT)
        body, align, bits, samples = data.tobytes(), HEAD + UNIT, 4, 2 * UNIT + 1
        fmt = struct.pack("<HHIIHHHH", tag, 1, RATE, RATE * align // samples, align, bits, 2, samples)
        count = samples * len(data)
    else:
        body, fmt, count = payload, struct.pack("<HHIIHHH", tag, 1, RATE, RATE, 1, 8, 0), len(payload)
    chunks = b"".join(k + struct.pack("<I", len(v)) + v + b"\0" * (len(v) % 2) for k, v in ((b"fmt ", fmt), (b"fact", struct.pack("<I", count)), (b"data", body)))
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def read_wave(media: bytes) -> tuple[int, np.ndarray]:
    """(format tag, samples or ADPCM blocks as rows) of a file that write_wave made; ValueError for any other."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, tag, align, data = 12, None, 1, None
    while at + 8 <= len(media):
        name, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, align = struct.unpack_from("<H", media, at + 8)[0], struct.unpack_from("<H", media, at + 20)[0]
        elif name == b"data":
            data = np.frombuffer(media, dtype=np.uint8, count=n, offset=at + 8)
        at += 8 + n + n % 2
    if tag not in NAMES or data is None or len(data) % align:
        raise ValueError("unknown WAVE format")
    return tag, data.reshape(-1, align) if tag == ADPCM else data


def payload_of(tag: int, data: np.ndarray) -> bytes:
    return data[:, HEAD:].tobytes() if tag == ADPCM else data.tobytes()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """int16 samples, a row for each block."""
    head = blocks[:, :HEAD].copy()
    sample, index = head[:, :2].copy().view("<i2")[:, 0].astype(np.int32), np.minimum(head[:, 2], len(STEPS) - 1).astype(np.int32)
    codes = np.empty((2 * (blocks.shape[1] - HEAD), len(blocks)), dtype=np.uint8)
    codes[0::2], codes[1::2] = (blocks[:, HEAD:] & 15).T, (blocks[:, HEAD:] >> 4).T
    out = np.empty((len(codes) + 1, len(blocks)), dtype=np.int16)
    out[0] = sample
    for i, code in enumerate(codes):
        k = (index << 4) + code
        sample = np.clip(sample + ADDS[k], -32768, 32767)
        index = NEXT[k]
        out[i + 1] = sample
    return np.ascontiguousarray(out.T)


def resample(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Twice the rate: each sample, then (-1, 9, 9, -1) / 16 of its neighbours; signals begin at starts and end values repeat."""
    ends = np.append(starts[1:], len(x)) - 1
    x = x.astype(np.int32)
    before, after = np.roll(x, 1), np.roll(x, -1)
    before[starts], after[ends] = x[starts], x[ends]
    second = np.roll(after, -1)
    second[ends] = x[ends]
    out = np.empty(2 * len(x), dtype=np.int16)
    out[0::2] = x
    out[1::2] = np.clip((9 * (x + after) - before - second + 8) >> 4, -32768, 32767)
    return out


def features(pcm: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(samples, peak, root mean square in 1/100, sign changes) of the signals that begin at starts."""
    n = np.diff(np.append(starts, len(pcm)))
    wide = pcm.astype(np.int64)
    peak = np.maximum.reduceat(np.abs(wide), starts)
    power = np.add.reduceat(wide * wide, starts)
    turns = np.zeros(len(pcm), dtype=np.int64)
    turns[1:] = (pcm[1:] < 0) != (pcm[:-1] < 0)
    turns[starts] = 0
    turns = np.add.reduceat(turns, starts)
    return [(int(a), int(b), int(100 * np.sqrt(c / a)), int(d)) for a, b, c, d in zip(n, peak, power, turns, strict=True)]


def decode(media: list[bytes]) -> list[tuple[int, bytes, bytes]]:
    """(format tag, stored payload, 16 kHz PCM) of each file; files of one format are decoded together."""
    files = [read_wave(m) for m in media]
    out: list = [None] * len(files)
    for tag in NAMES:
        own = [i for i, f in enumerate(files) if f[0] == tag]
        if not own:
            continue
        data = np.concatenate([files[i][1] for i in own])
        pcm = decode_adpcm(data).ravel() if tag == ADPCM else EXPAND[tag][data]
        each = 2 * UNIT + 1 if tag == ADPCM else 1
        ends = np.cumsum([0, *[len(files[i][1]) * each for i in own]])
        pcm = resample(pcm, ends[:-1])
        for i, a, b in zip(own, (2 * ends[:-1]).tolist(), (2 * ends[1:]).tolist(), strict=True):
            out[i] = (tag, payload_of(*files[i]), pcm[a:b].tobytes())
    return out


def pack_pcm(signals: list[np.ndarray], smooth: list[bool]) -> list[bytes]:
    """Each signal of an even number of int16 samples in a lossless code by phases.

    The even samples, as differences where the signal is smooth; the odd ones as corrections to what the half-band filter
    makes of the even ones, which are left out where there are none, as in signals that were resampled by it.
    """
    starts = np.cumsum([0, *(len(x) // 2 for x in signals[:-1])])
    x = np.concatenate(signals)
    even, rest = x[0::2], x[1::2] - resample(x[0::2], starts)[1::2]
    steps = np.diff(even, prepend=np.int16(0))
    steps[starts] = even[starts]
    ends, out = [*starts[1:].tolist(), len(even)], []
    for a, b, is_smooth in zip(starts.tolist(), ends, smooth, strict=True):
        more = rest[a:b].astype("<i2").tobytes() if rest[a:b].any() else b""
        out.append(bytes([DIFFERENCES * is_smooth + CORRECTED * bool(more)]) + (steps if is_smooth else even)[a:b].astype("<i2").tobytes() + more)
    return out


def unpack_pcm(packed: list[bytes]) -> list[np.ndarray]:
    """The signals that pack_pcm made codes of."""
    even, rest = [], []
    for data in packed:
        x = np.frombuffer(data, "<i2", offset=1)
        n = len(x) // 2 if data[0] & CORRECTED else len(x)
        even.append(np.cumsum(x[:n], dtype=np.int16) if data[0] & DIFFERENCES else x[:n])
        rest.append(x[n:])
    ends = np.cumsum([0, *map(len, even)])
    pcm, out = resample(np.concatenate(even), ends[:-1]), []
    for a, b, r in zip(ends[:-1].tolist(), ends[1:].tolist(), rest, strict=True):
        if len(r):
            pcm[2 * a + 1 : 2 * b : 2] += r
        out.append(pcm[2 * a : 2 * b])
    return out


def store(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_bytes, media, pcm): every text (null: empty) as UTF-8, padded with spaces to a multiple of UNIT, in a
    WAVE file, and what that decodes to, resampled to PCM_RATE, as pack_pcm codes it.

    The format follows from a checksum of the bytes, so equal texts give equal files. A very long text is a batch of its
    own and one file.
    """

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in byte_batches(batches, lambda b: pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False), BATCH_BYTES):
            sizes, media = [], []
            for raw in batch.column(1).cast(pa.binary()).to_pylist():
                payload = raw + b" " * (-len(raw) % UNIT if raw else UNIT)
                sizes.append(len(raw))
                media.append(write_wave(payload, (MULAW, ALAW, ADPCM)[zlib.crc32(payload) % 3]))
            decoded = decode(media)
            pcm = pack_pcm([np.frombuffer(x, "<i2") for *_, x in decoded], [tag == ADPCM for tag, *_ in decoded])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(pcm, pa.binary())], ["doc_id", "n_bytes", "media", "pcm"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary, pcm binary")


def digest(stored: DataFrame) -> DataFrame:
    """What the stored rows hold: payload and file digests of the media, features of the PCM."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in byte_batches(batches, lambda b: pc.binary_length(b.column(2)).to_numpy(zero_copy_only=False), BATCH_BYTES):
            media = batch.column(2).to_pylist()
            files = [read_wave(m) for m in media]
            payloads = [payload_of(*f) for f in files]
            pcm = unpack_pcm(batch.column(3).to_pylist())
            found = features(np.concatenate(pcm), np.cumsum([0, *map(len, pcm[:-1])]))
            sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs])
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            shown = [f"{NAMES[f[0]]};n={x[0]};peak={x[1]};rms={x[2]};turns={x[3]}" for f, x in zip(files, found, strict=True)]
            arrays = [batch.column(0), batch.column(1), pa.array([len(p) for p in payloads], pa.int64()), sha(payloads), pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()), pa.array([len(m) for m in media], pa.int64()), sha(media), pa.array(shown)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = stored.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return stored.select("doc_id", "n_bytes", "media", "pcm").mapInArrow(run, schema)


def audio_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Store every text as audio and its PCM in a Parquet table (at path, else in the shared folder), read both back and digest them.

    One row a row of docs. Null and empty texts are a file of UNIT spaces; a very long text is one file; repeated rows give
    equal rows; an empty table gives an empty result; other columns are ignored.
    """
    import uuid

    spark = docs.sparkSession
    path = path or f"{scratch_root(spark)}/tidemark/{uuid.uuid4().hex}-audio"
    made = store(docs)
    made.write.options(**PARQUET).parquet(path)
    return digest(spark.read.schema(made.schema).parquet(path))


__all__ = ["audio_digests", "decode", "digest", "read_wave", "store", "write_wave"]
