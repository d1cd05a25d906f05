"""Sets of word shingles as sorted 64-bit hashes, computed for a batch of texts at once."""

from __future__ import annotations

import functools

import numpy as np

from .shared import mix64, ragged, seeded_words, text_runs

WIDTH = 5
#: Text bytes that are hashed at once; the arrays for it take some fifty times as much.
RUN_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = seeded_words(256, 11)
_PLACES = seeded_words(WIDTH, 12) | np.uint64(1)
_SALTS = seeded_words(3, 13)


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and its inverse, modulo 2^64, for i below n."""
    out = []
    for b in (_BASE, pow(_BASE, -1, 2**64)):
        x = np.full(n, b, dtype=np.uint64)
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words of each text): runs of bytes but ASCII white space, A-Z lower-cased."""
    texts, sizes = len(off) - 1, np.diff(off)
    buf = np.full(len(raw) + texts, 32, dtype=np.uint8)
    buf[np.arange(len(raw)) + np.repeat(np.arange(texts), sizes)] = raw
    buf[(buf >= 65) & (buf <= 90)] += 32
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    before = np.empty_like(space)
    before[:1], before[1:] = True, space[:-1]
    start, end = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    up, down = _powers(1 << max(20, int(len(buf) + 1).bit_length()))
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[buf] * up[: len(buf)], out=sums[1:])
    words = mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _SALTS[0])
    text = np.searchsorted(off[:-1] + np.arange(texts), start, side="right") - 1
    return words, np.bincount(text, minlength=texts)


def shingle_sets(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, sorted within each text, end to end; their number in each text), by runs of texts."""
    parts = [_shingle_sets(raw[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in text_runs(off, RUN_BYTES)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([h for h, _ in parts]), np.concatenate([n for _, n in parts])


def _shingle_sets(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, sorted within each text, end to end; their number in each text).

    A text of fewer than WIDTH words has its whole sequence as one shingle, one without words none.
    """
    words, count = word_hashes(raw, off)
    first = np.cumsum(count) - count
    full = np.where(count >= WIDTH, count - WIDTH + 1, 0)
    at = ragged(full, first)
    h = np.zeros(len(at), dtype=np.uint64)
    for j in range(WIDTH):
        h += words[at + j] * _PLACES[j]
    text = np.repeat(np.arange(len(count)), full)
    few = np.flatnonzero((count > 0) & (count < WIDTH))
    short = count[few].astype(np.uint64) * _SALTS[1]
    for j in range(WIDTH - 1):
        has = count[few] > j
        short[has] += words[first[few[has]] + j] * _PLACES[j]
    h, text = mix64(np.concatenate([h, short])), np.concatenate([text, few])
    order = np.argsort(h)
    h, text = h[order], text[order]
    order = np.argsort(text.astype(np.uint16) if len(count) < 65536 else text, kind="stable")
    h, text = h[order], text[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.bincount(text[new], minlength=len(count))


def signatures(h: np.ndarray, count: np.ndarray) -> list[bytes]:
    """16 bytes for each set, equal for equal sets; none for an empty set."""
    has = np.flatnonzero(count)
    out = np.zeros((len(count), 2), dtype=np.uint64)
    if len(has):
        starts = (np.cumsum(count) - count)[has]
        for i in range(2):
            out[has, i] = np.add.reduceat(mix64(h ^ _SALTS[i + 1]), starts)
    return [x.tobytes() if n else b"" for x, n in zip(out, count, strict=True)]
