"""Language ID: an interpolated Kneser-Ney character model per language, in sorted hash arrays.

Texts are lower-cased letters with single spaces between their runs. A model gives each character's probability after the
three before it; the language with the lowest cross-entropy per character wins, and a document whose winner costs more
than calibration texts of that language do is rejected. The models are fitted on a bounded sample of labelled rows, whose
grams the executors count.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import byte_batches, mix64, release, table, text_of

ORDER = 4
#: The sample that the models are fitted on: UTF-8 bytes of whole texts for each language, and for all of them together.
#: A fifth of it calibrates.
SAMPLE_BYTES, TOTAL_BYTES = 3 << 20, 12 << 20
#: Texts of a language that the sample holds at least.
LEAST_TEXTS = 5
#: Labels that may be languages.
MOST_LANGS = 4096
#: What the models of all languages may take: every worker holds them.
MODEL_BYTES = 256 << 20
#: Deviations above the middle of calibration texts that a text of the language may cost at least.
MIN_DEVIATIONS = 5.0
BATCH_BYTES = 1 << 20
#: Characters that are scored at once.
RUN_CHARS = 1 << 19
#: Characters that a prediction's score counts at most.
SCORE_CHARS = 40
#: An unseen character's share of the lowest model.
ALPHABET = 5000.0
_MULT = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, where each begins): ORDER - 1 spaces, then letters with single spaces, one at the end."""
    pad = " " * (ORDER - 1)
    lowered = [t.lower() for t in texts]
    x = np.frombuffer("".join(pad + t + " " for t in lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum([len(t) + ORDER for t in lowered])
    start = np.zeros(len(x), dtype=bool)
    start[np.append(0, ends[:-1]).astype(np.int64)] = True
    is_letter = letters()[np.minimum(x, 0x10FFFF)]
    x = np.where(is_letter, x, 32)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first space after a letter
    for i in range(ORDER - 1):
        keep[np.flatnonzero(start) + i] = True
    return x[keep], np.flatnonzero(start[keep])


def grams(x: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters that end at each position (the first n - 1 hold what there is)."""
    out = np.zeros(len(x), dtype=np.uint64)
    for back in range(n - 1, -1, -1):
        moved = np.zeros(len(x), dtype=np.uint64)
        moved[back:] = x[: len(x) - back]
        out = (out + moved + np.uint64(1)) * _MULT
    return mix64(out)


def scored(n: int, starts: np.ndarray) -> np.ndarray:
    """All positions but the padding in front of each text."""
    out = np.ones(n, dtype=bool)
    for i in range(ORDER - 1):
        out[starts + i] = False
    return out


def windows(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ORDER characters that end at each of the positions, a row for each."""
    return np.stack([x[np.maximum(at - back, 0)] for back in range(ORDER - 1, -1, -1)], axis=1).astype(np.uint64)


def hashes(window: np.ndarray) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """(hash of the last n characters of each window, hash of the n - 1 before the last) for each order n."""

    def of(part: np.ndarray) -> np.ndarray:
        out = np.zeros(len(part), dtype=np.uint64)
        for i in range(part.shape[1]):
            out = (out + part[:, i] + np.uint64(1)) * _MULT
        return mix64(out)

    orders = range(1, ORDER + 1)
    return {n: of(window[:, ORDER - n :]) for n in orders}, {n: of(window[:, ORDER - n : -1]) if n > 1 else np.zeros(len(window), np.uint64) for n in orders}


class Model:
    """One language. tables[n]: (sorted hashes of n-grams, log-probabilities); backs[n]: the same for contexts of n - 1."""

    def __init__(self, window: np.ndarray, count: np.ndarray):
        """From distinct windows of ORDER characters and how often each occurs.

        Each distinct longer gram is one continuation of the shorter one that ends it: counts below the top are those.
        """
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.backs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        gram, context = hashes(window)
        chosen, weight, seen = np.arange(len(window)), count.astype(np.int64), {}
        for n in range(ORDER, 0, -1):
            keys, first, inverse = np.unique(gram[n][chosen], return_index=True, return_inverse=True)
            times = np.bincount(inverse, weights=weight, minlength=len(keys)).astype(np.int64)
            chosen = chosen[first]
            seen[n] = keys, context[n][chosen], gram[n - 1][chosen] if n > 1 else None, times
            weight = np.ones(len(chosen), dtype=np.int64)
        for n in range(1, ORDER + 1):
            keys, heads_of, suffix, times = seen[n]
            once, twice = int((times == 1).sum()), int((times == 2).sum())
            less = once / (once + 2 * twice) if once else 0.5
            heads, at = np.unique(heads_of, return_inverse=True)
            total = np.bincount(at, weights=times, minlength=len(heads))
            back = less * np.bincount(at, minlength=len(heads)) / np.maximum(total, 1)
            lower = 1 / ALPHABET if n == 1 else np.exp(self._lookup(n - 1, suffix).astype(np.float64))
            prob = (times - less) / total[at] + back[at] * lower if len(keys) else np.zeros(0)
            self.tables[n] = keys, np.log(prob).astype(np.float32)
            self.backs[n] = heads, np.log(back).astype(np.float32)

    def _lookup(self, n: int, keys: np.ndarray) -> np.ndarray:
        have, prob = self.tables[n]
        return prob[np.searchsorted(have, keys)]

    def nbytes(self) -> int:
        return sum(a.nbytes + b.nbytes for part in (self.tables, self.backs) for a, b in part.values())

    def log_prob(self, gram: dict[int, np.ndarray], context: dict[int, np.ndarray]) -> np.ndarray:
        """For positions with these hashes: the longest gram that is known, times the backing-off from there."""
        size = len(gram[1])
        out, open_ = np.zeros(size, dtype=np.float32), np.arange(size)

        def find(keys, want):
            at = np.minimum(np.searchsorted(keys, want), max(0, len(keys) - 1))
            return at, keys[at] == want if len(keys) else np.zeros(len(want), bool)

        for n in range(ORDER, 0, -1):
            keys, prob = self.tables[n]
            at, hit = find(keys, gram[n][open_])
            out[open_[hit]] += prob[at[hit]]
            open_ = open_[~hit]
            heads, back = self.backs[n]
            at, hit = find(heads, context[n][open_])
            out[open_[hit]] += back[at[hit]]
        out[open_] -= np.float32(np.log(ALPHABET))
        return out


class Limit:
    """What a text of a language costs at most: calibrated on texts that the language's model wasn't fitted on.

    The cost per character scatters around a middle with variance a + b / characters. The limit lies as many deviations
    above the middle as twice the 99th of a hundred calibration texts, MIN_DEVIATIONS at least.
    """

    def __init__(self, cost: np.ndarray, n: np.ndarray):
        cost, n = cost[n > 0], n[n > 0].astype(np.float64)
        self.middle, self.a, self.b, self.deviations = np.inf, 0.0, 0.0, 0.0
        if not len(cost):  # nothing to calibrate with: the language rejects nothing
            return
        long = n >= 20
        self.middle = float(np.median(cost[long] if long.any() else cost))
        off = (cost - self.middle) ** 2
        off = np.minimum(off, np.quantile(off, 0.99))
        x = np.stack([np.ones(len(n)), 1 / n], axis=1)
        a, b = np.linalg.lstsq(x, off, rcond=None)[0]
        self.a, self.b = max(float(a), (0.05 * self.middle) ** 2), max(float(b), 1.0)
        over = (cost - self.middle) / np.sqrt(self.a + self.b / n)
        self.deviations = max(MIN_DEVIATIONS, 2 * float(np.quantile(over, 0.99)))

    def at(self, n: np.ndarray) -> np.ndarray:
        return self.middle + self.deviations * np.sqrt(self.a + self.b / np.maximum(n, 1))


class Models:
    """The languages' models and limits."""

    def __init__(self, models: dict[str, Model]):
        self.langs = sorted(models)
        self.models = [models[k] for k in self.langs]
        self.limits = [Limit(np.zeros(0), np.zeros(0)) for _ in self.langs]

    @classmethod
    def of_texts(cls, texts: dict[str, list[str]]) -> Models:
        return cls({k: Model(*_counted(v)) for k, v in texts.items()})

    def nbytes(self) -> int:
        return sum(m.nbytes() for m in self.models)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per character by text and language, characters) of the texts; 0 characters for those without letters.

        Positions are scored in runs of RUN_CHARS, so a very long text takes little more than its characters.
        """
        import pandas as pd

        x, starts = characters(texts)
        own = scored(len(x), starts)
        n = np.add.reduceat(own.astype(np.int64), starts)
        total = np.zeros((len(texts), len(self.langs)))
        for a in range(0, len(x), RUN_CHARS):
            from_ = max(0, a - ORDER + 1)  # the first characters of a run need those before
            part, skip = x[from_ : a + RUN_CHARS], a - from_
            code, distinct = pd.factorize(grams(part, ORDER)[skip:])
            first = np.zeros(len(distinct), dtype=np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            gram, context = hashes(windows(part, first + skip))
            gram[ORDER] = np.asarray(distinct)
            at = np.flatnonzero(own[a : a + RUN_CHARS])
            text, code = np.searchsorted(starts, at + a, side="right") - 1, code[at]
            for j, model in enumerate(self.models):
                total[:, j] += np.bincount(text, weights=model.log_prob(gram, context)[code], minlength=len(texts))
        return -total / np.maximum(n, 1)[:, None], n

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) of each text; score: the winner's share when likelihoods of at most SCORE_CHARS compete."""
        if not texts:
            return []
        if not self.langs:
            return [("und", 0.0, True)] * len(texts)
        h, n = self.entropies(texts)
        best, row = h.argmin(1), np.arange(len(h))
        share = np.exp((h[row, best][:, None] - h) * np.minimum(n, SCORE_CHARS)[:, None])
        score = 1 / share.sum(1)
        most = np.stack([limit.at(n) for limit in self.limits], axis=1)[row, best]
        return [(self.langs[b], float(s), bool(v > w)) if k else ("und", 0.0, True) for b, s, v, w, k in zip(best, score, h[row, best], most, n, strict=True)]


def _counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct windows of ORDER characters, how often each occurs) at the scored positions of the texts."""
    if not texts:
        return np.zeros((0, ORDER), np.uint64), np.zeros(0, np.int64)
    x, starts = characters(texts)
    at = np.flatnonzero(scored(len(x), starts))
    _, first, count = np.unique(grams(x, ORDER)[at], return_index=True, return_counts=True)
    return windows(x, at[first]), count


def _packed(window: np.ndarray) -> np.ndarray:
    """Four characters of 21 bits in two numbers."""
    w = window.astype(np.int64)
    return np.stack([w[:, 0] << 21 | w[:, 1], w[:, 2] << 21 | w[:, 3]], axis=1)


def _unpacked(packed: np.ndarray) -> np.ndarray:
    low = (1 << 21) - 1
    return np.stack([packed[:, 0] >> 21, packed[:, 0] & low, packed[:, 1] >> 21, packed[:, 1] & low], axis=1).astype(np.uint64)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of doc_id as text leaves 1 when divided by 3; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _sample(docs: DataFrame, sample_bytes: int, total_bytes: int) -> DataFrame | None:
    """Rows (lang, text, spare) of the sample, each distinct text of a language once; None without labelled text.

    Texts are taken in hash order up to the first of some thousand bands of the hash, narrower the lower they lie, below
    which a language has its bytes and LEAST_TEXTS texts: sums of bands decide, no language is ranked. spare marks those
    that calibrate: a fifth by another hash, the last one anyway where there are two, never the first.
    """
    whole = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    rows = whole.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64(F.lit(5), "text"))
    rows = rows.withColumn("band", F.floor(F.log2(F.shiftrightunsigned("h", 1).cast("double") + 1) * 16).cast("int"))
    langs = rows.select("lang").distinct().count()
    if not langs:
        return None
    if langs > MOST_LANGS:
        raise ValueError(f"{langs} languages: more than {MOST_LANGS} labels aren't languages")
    each = max(1, min(sample_bytes, total_bytes // langs))
    most = max(1, each // LEAST_TEXTS)
    size = F.least(F.octet_length("text"), F.lit(most)).cast("long") + 1
    texts = rows.select("lang", "band", "h", size.alias("size")).groupBy("lang", "band", "h").agg(F.max("size").alias("size"))
    bands = texts.groupBy("lang", "band").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    below = Window.partitionBy("lang").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)  # a row a band
    before = bands.withColumn("_size", F.coalesce(F.sum("size").over(below), F.lit(0))).withColumn("_n", F.coalesce(F.sum("n").over(below), F.lit(0)))
    order = lambda h: F.shiftrightunsigned(h, 1)
    cuts = before.filter((F.col("_size") < each) | (F.col("_n") < LEAST_TEXTS)).groupBy("lang").agg(F.max("band").alias("cut"))
    taken = rows.join(F.broadcast(cuts), "lang").filter(F.col("band") <= F.col("cut"))  # at most MOST_LANGS rows
    taken = table(taken.groupBy("lang", "h").agg(F.min(F.substring("text", 1, most)).alias("text")), "language-sample", release_shuffles=False)
    ends = taken.groupBy("lang").agg(F.min_by("h", order("h")).alias("_first"), F.max_by("h", order("h")).alias("_last"))
    spare = (F.col("h") != F.col("_first")) & ((F.col("h") == F.col("_last")) | (F.pmod(F.xxhash64(F.lit(7), "h"), F.lit(5)) == 4))
    return taken.join(F.broadcast(ends), "lang").select("lang", "text", spare.alias("spare"))


def _lang_batches(batches):
    """(language, its texts) in pieces of about BATCH_BYTES of batches (lang, text)."""
    import pyarrow.compute as pc

    for batch in byte_batches(batches, lambda b: pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False), BATCH_BYTES):
        by: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(text)
        yield from by.items()


def fit(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES, total_bytes: int = TOTAL_BYTES) -> Models:
    """Models from the rows of docs with text and lang, fitted on a bounded sample of whole texts in hash order.

    A language has sample_bytes, less where the languages together would pass total_bytes, and LEAST_TEXTS texts at least,
    if it has them; of a text of more than a LEAST_TEXTS-th of its bytes it takes the first so many characters. Grams are
    counted by the executors and meet once for each language and gram; the driver gets the counts of distinct grams, at
    most a row a character of the sample, and turns them into a model language by language. Calibration texts are scored
    by the executors as well. ValueError if the models pass MODEL_BYTES, as every worker holds them.
    """
    spark = docs.sparkSession
    sample = _sample(docs, sample_bytes, total_bytes)
    if sample is None:
        return Models({})

    def count(batches):
        import pyarrow as pa

        for lang, texts in _lang_batches(batches):
            window, n = _counted(texts)
            packed = _packed(window)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(packed[:, 0]), pa.array(packed[:, 1]), pa.array(n, pa.int64())], ["lang", "a", "b", "n"])

    sample = table(sample, "language-texts", release_shuffles=False)
    langs = [r["lang"] for r in sample.select("lang").distinct().collect()]
    counted = sample.filter(~F.col("spare")).select("lang", "text").mapInArrow(count, "lang string, a bigint, b bigint, n bigint")
    counted = table(counted.groupBy("lang", "a", "b").agg(F.sum("n").alias("n")), "language-grams", release_shuffles=False)
    made: dict[str, Model] = {}
    for lang in langs:
        own = counted.filter(F.col("lang") == lang).select("a", "b", "n").toArrow()
        made[lang] = Model(_unpacked(np.stack([own["a"].to_numpy(), own["b"].to_numpy()], axis=1)), own["n"].to_numpy())
        del own
    models = Models(made)
    if models.nbytes() > MODEL_BYTES:
        raise ValueError(f"models of {len(langs)} languages take {models.nbytes()} bytes: lower total_bytes")
    shared = spark.sparkContext.broadcast(models)

    def cost(batches):
        import pyarrow as pa

        for lang, texts in _lang_batches(batches):
            h, n = shared.value.entropies(texts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(h[:, shared.value.langs.index(lang)]), pa.array(n, pa.int64())], ["lang", "cost", "n"])

    costs = sample.filter("spare").select("lang", "text").mapInArrow(cost, "lang string, cost double, n bigint").toArrow()
    names, values, sizes = (costs[c].to_numpy() for c in ("lang", "cost", "n"))
    models.limits = [Limit(values[names == k], sizes[names == k]) for k in models.langs]
    shared.destroy()
    release()
    return models


def predict(docs: DataFrame, models: Models, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows (*keep, lang_pred, score, rejected), one a row of docs; "und", 0 and rejected for a text that is null or has no letter."""
    shared = docs.sparkSession.sparkContext.broadcast(models)  # at most MODEL_BYTES, which fit checks

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in byte_batches(batches, lambda b: pc.binary_length(b.column(b.num_columns - 1)).to_numpy(zero_copy_only=False), BATCH_BYTES):
            found = shared.value.predict(batch.column(batch.num_columns - 1).to_pylist())
            arrays = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], [*keep, "lang_pred", "score", "rejected"])

    source = docs.select(*[F.col(f"`{c}`") for c in keep], text_of().alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_text"), "lang_pred string, score double, rejected boolean"])
    return source.mapInArrow(run, schema)


def identify(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score, rejected): fitted on the rows of docs that aren't held out, applied to all.

    The prediction reads the whole text alone; score compares the languages as if the text had SCORE_CHARS characters, where
    it has more. Without labelled rows every prediction is "und" with score 0, as for null and empty texts and those
    without letters. Very long texts are scored whole, in a batch of their own. Repeated rows give repeated results; an
    empty table gives an empty result; other columns are ignored.
    """
    models = fit(docs.filter(~held_out()), sample_bytes)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(rows, models, ("doc_id", "held_out"))


def keep_identified(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs whose language is identified, with the columns of docs; fitted on all labelled rows of docs."""
    models = fit(docs, **options)
    names = docs.columns
    inside = [f"_k{i}" for i in range(len(names))]
    rows = docs.toDF(*inside).withColumn("text", F.col(inside[names.index("text")]))
    return predict(rows, models, tuple(inside)).filter(~F.col("rejected")).select(*[F.col(i).alias(c) for i, c in zip(inside, names, strict=True)])
