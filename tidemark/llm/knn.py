"""Exact top-k by inner product: a Voronoi kNN join.

Pivots divide the data into cells and the queries into groups. Summaries of the cells (rows, radius, the smallest distances
to the pivot) bound every inner product: q.x lies within |q| * d(x, pivot) of q.pivot. The (k+1)th best of the lower bounds
is a score that each query surely reaches, so a query goes only to the cells whose upper bound isn't below it. Cells are
packed into chunks of at most CHUNK_ROWS rows and neighbouring queries into blocks, one row each. Chunks stream past the
blocks in a product join whose condition is that the block wants the cell; nothing is written for a pair, and the bounds are
tried again with the scores a task has found so far. Equal vectors are one row that keeps its k+1 smallest ids: no more of
them can be among the first k of any query. Equal query vectors are one query.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop, table

#: Pivots: the root of the number of distinct vectors within these ends.
LEAST_PIVOTS, MOST_PIVOTS = 48, 4096
CHUNK_ROWS = 4096
CHUNK_BYTES = 1 << 20
QUERY_BLOCK = 2048
SCALE = 256
LONG = 2**63
SMALL = 32767


def quantised(column):
    """(positions, matrix) for each length of the vectors of an Arrow list column: floor(256 * x) of each component as a
    double, which holds it exactly. Vectors that are null or hold null or non-finite components are left out. What passes the
    range of a double counts as its end."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    most = np.finfo(np.float64).max
    for d in np.unique(lengths[lengths >= 0]).tolist():
        at = np.flatnonzero(lengths == d)
        x = values[starts[at, None] + np.arange(d)] if d else np.zeros((len(at), 0))
        fine = np.isfinite(x).all(1)
        with np.errstate(over="ignore"):
            yield at[fine], np.clip(np.floor(SCALE * x[fine]), -most, most) + 0.0  # no negative zero


def stored(x: np.ndarray) -> list[bytes]:
    """Each row as bytes: 0 and 16-bit integers where they hold it, else 1 and doubles."""
    small = (np.abs(x) <= SMALL).all(1)
    short = x.clip(-SMALL, SMALL).astype("<i2")
    return [b"\0" + short[i].tobytes() if s else b"\1" + x[i].tobytes() for i, s in enumerate(small.tolist())]


def matrix(rows: list[bytes], d: int) -> np.ndarray:
    """stored() read back, all of d components."""
    out = np.zeros((len(rows), d))
    wide = np.array([r[0] for r in rows], dtype=bool)
    for kind, dtype in ((False, "<i2"), (True, "<f8")):
        at = np.flatnonzero(wide == kind)
        if len(at) and d:
            out[at] = np.frombuffer(b"".join([rows[i][1:] for i in at.tolist()]), dtype=dtype).reshape(len(at), d)
    return out


def packed(x: np.ndarray) -> bytes:
    return x.astype("<i2").tobytes() if (np.abs(x) <= SMALL).all() else x.tobytes()


def unpacked(raw: bytes, n: int, d: int) -> np.ndarray:
    return np.frombuffer(raw, dtype="<i2" if len(raw) == 2 * n * d else "<f8").reshape(n, d).astype(np.float64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products, as the nearest long: by doubles where no sum can pass 2^53, else as Python integers."""
    if not len(a) or not len(b) or not a.shape[1]:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    small = 2.0**53 / a.shape[1]
    top_a, top_b = np.abs(a).max(1), np.abs(b).max(1)
    if float(top_a.max()) * float(top_b.max()) < small:
        return (a @ b.T).astype(np.int64)
    usual_a, usual_b = top_a < math.sqrt(small), top_b < math.sqrt(small)
    out = np.empty((len(a), len(b)), dtype=object)
    out[np.ix_(usual_a, usual_b)] = (a[usual_a] @ b[usual_b].T).astype(np.int64).astype(object)
    whole = lambda x: np.array([[int(c) for c in r] for r in x], dtype=object).reshape(x.shape)
    for rows, columns in ((~usual_a, np.ones(len(b), bool)), (usual_a, ~usual_b)):
        if rows.any() and columns.any():
            out[np.ix_(rows, columns)] = whole(a[rows]) @ whole(b[columns]).T
    return np.clip(out, -LONG, LONG - 1).astype(np.int64)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of each row to each pivot; infinite where it passes a double."""
    with np.errstate(over="ignore", invalid="ignore"):
        d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T, 0))
    return np.where(np.isnan(d), np.inf, d)


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A pivot near each row, the nearest but for rounding, and the row's distance to it."""
    top = max(float(np.abs(x).max(initial=0)), float(np.abs(pivots).max(initial=0)))
    if top > 1e6:
        away = distances(x, pivots)
        own = away.argmin(1)
        return own, away[np.arange(len(x)), own]
    p = pivots.astype(np.float32)
    own = ((p * p).sum(1)[None, :] - 2 * (x.astype(np.float32) @ p.T)).argmin(1)
    return own, np.sqrt(((x - pivots[own]) ** 2).sum(1))


class Best:
    """The keep best (score, id) of each query of a block among the rows seen so far; ties go to the smaller id."""

    def __init__(self, d: int, raw: bytes, numbers: np.ndarray, floor: np.ndarray, keep: int):
        self.x, self.numbers, self.keep = unpacked(raw, len(numbers), d), numbers, keep
        with np.errstate(over="ignore"):
            self.norm = np.sqrt((self.x * self.x).sum(1))
        self.low = np.floor(np.clip(floor, -LONG, LONG / 2)).astype(np.int64)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def see(self, x: np.ndarray, ids: np.ndarray, counts: np.ndarray, pivot: np.ndarray | None, radius: float) -> None:
        """Rows x with counts ids each, all within radius of the pivot."""
        asked = np.arange(len(self.x))
        if pivot is not None:
            with np.errstate(over="ignore", invalid="ignore"):
                inner = self.x @ pivot
                slack = 1e-9 * (1 + np.abs(inner) + self.norm * np.sqrt(pivot @ pivot)) + 1e-6 * self.norm
                high = inner + self.norm * radius + slack
            asked = np.flatnonzero(~(np.maximum(high, -LONG) < np.minimum(self.low, LONG / 2)))
        if not len(asked):
            return
        with np.errstate(over="ignore"):
            top = float(self.norm[asked].max()) * float(np.sqrt((x * x).sum(1).max()))
        # no partial sum passes the product of the norms: floats hold them all exactly below these ends
        kind, end = (np.float32, 2.0**24) if top < 2.0**23 else (np.float64, 2.0**53) if top < 2.0**52 else (None, 0.0)
        data = x.astype(kind) if kind else x
        first = np.cumsum(counts) - counts
        for at in range(0, len(asked), 512):
            q = asked[at : at + 512]
            score = self.x[q].astype(kind) @ data.T if kind else products(self.x[q], x)
            low = np.clip(self.low[q].astype(np.float64), -end, end).astype(kind) if kind else self.low[q]
            over = score >= low[:, None]
            if np.count_nonzero(over) > 16 * self.keep * len(q) and len(x) > self.keep:
                low = np.maximum(low, np.partition(score, -self.keep, axis=1)[:, -self.keep])
                over = score >= low[:, None]
            i, j = np.divmod(np.flatnonzero(over), len(x))  # far faster than nonzero of a matrix
            many = counts[j]
            within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            self.parts.append((np.repeat(q[i], many), np.repeat(score[i, j].astype(np.int64), many), ids[np.repeat(first[j], many) + within]))
            self.held += len(within)
            if self.held > 2 * self.keep * len(self.x):
                self.settle()

    def settle(self) -> None:
        if not self.parts:
            return
        q, s, i = (np.concatenate([p[n] for p in self.parts]) for n in range(3))
        order = np.lexsort((i, ~s, q))
        q, s, i = q[order], s[order], i[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = rank == self.keep - 1
        self.low[q[last]] = np.maximum(self.low[q[last]], s[last])
        fine = rank < self.keep
        self.parts = [(q[fine], s[fine], i[fine])]
        self.held = int(fine.sum())

    def found(self):
        self.settle()
        q, s, i = self.parts[0] if self.parts else (np.zeros(0, np.int64),) * 3
        return self.numbers[q], i, s


def _distinct(vectors: DataFrame, id_column: str, column: str, keep: int | None, every: int = 1) -> DataFrame:
    """Rows (dim, v, ids): each distinct quantised vector of the ids divisible by every, with its keep smallest ids or all,
    gathered first within Arrow batches."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, x in quantised(batch.column(1)):
                found: dict[bytes, set] = {}
                for i, v in zip(ids[at].tolist(), stored(x), strict=True):
                    found.setdefault(v, set()).add(i)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), x.shape[1], np.int32)), pa.array(list(found), pa.binary()), pa.array([sorted(f)[:keep] for f in found.values()], pa.list_(pa.int64()))], ["dim", "v", "ids"])

    ids = F.col(id_column).cast("long")
    rows = vectors.filter(ids.isNotNull() if every == 1 else ids % every == 0)
    partial = rows.select(ids.alias("id"), column).mapInArrow(run, "dim int, v binary, ids array<bigint>")
    every_id = F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids"))))
    return partial.groupBy("dim", "v").agg((F.slice(every_id, 1, keep) if keep else every_id).alias("ids"))


def _by_dim(batch):
    dims, v = batch.column("dim").to_numpy(), batch.column("v").to_pylist()
    for d in np.unique(dims).tolist():
        at = np.flatnonzero(dims == d)
        yield d, at, matrix([v[i] for i in at.tolist()], d)


def _runs(batches, names: list[str], most):
    """(first row, columns as lists) of runs of rows with equal (dim, cell), of at most most(dim) rows; rows come in order."""
    held: dict[str, list] = {n: [] for n in names}
    for batch in batches:
        columns = {n: batch.column(n).to_pylist() for n in names}
        for at in range(batch.num_rows):
            if held["dim"] and ((held["dim"][0], held["cell"][0]) != (columns["dim"][at], columns["cell"][at]) or len(held["dim"]) >= most(held["dim"][0])):
                yield held
                held = {n: [] for n in names}
            for n in names:
                held[n].append(columns[n][at])
    if held["dim"]:
        yield held


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_column: str = "vec_id", column: str = "embedding", pivots: int | None = None) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best of all other rows for each row whose id is divisible by every.

    Score: inner product of the vectors floor(256 * x); ties go to the smaller id; fewer than k candidates give fewer
    rows. Rows with a null id and vectors that are null or hold null or non-finite components take no part. Scores are
    exact; one beyond 64 bits is given as the nearest long, and such scores tie. Vectors of different lengths are never
    compared. A row repeated with the same id and vector counts once. An empty table gives an empty result; other columns
    are ignored. The driver holds the pivots and a summary for each chunk.
    """
    keep = k + 1
    data = table(_distinct(vectors, id_column, column, keep), "knn-distinct")
    dims = {r["dim"]: r["n"] for r in data.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row a length
    pivots = pivots or max(LEAST_PIVOTS, min(MOST_PIVOTS, math.isqrt(sum(dims.values()))))
    chosen: dict[int, list[bytes]] = {}
    for r in data.orderBy(F.xxhash64("v"), "v").limit(pivots).select("dim", "v").collect():  # at most pivots rows
        chosen.setdefault(r["dim"], []).append(bytes(r["v"]))
    far = {d: matrix(chosen[d], d) if d and d in chosen else np.zeros((1, d)) for d in dims}
    base, size = {}, 0  # cells are numbered through all lengths
    for d in sorted(far):
        base[d], size = size, size + len(far[d])
    chunk_rows, chunk_bytes, block_rows = CHUNK_ROWS, CHUNK_BYTES, QUERY_BLOCK
    most_rows = lambda rows: lambda d: max(1, min(rows, chunk_bytes // (2 * d + 1)))

    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            for d, at, x in _by_dim(batch):
                own, away = nearest(x, far[d])
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), d, np.int32)), pa.array((base[d] + own).astype(np.int32)), pa.array(away), batch.column("v").take(take), batch.column("ids").take(take)], ["dim", "cell", "away", "v", "ids"])

    cells = table(data.mapInArrow(assign, "dim int, cell int, away double, v binary, ids array<bigint>"), "knn-cells")
    drop(data)

    def chunk(batches):
        import pyarrow as pa

        for held in _runs(batches, ["dim", "cell", "away", "v", "ids"], most_rows(chunk_rows)):
            counts = np.array([len(x) for x in held["ids"]], dtype=np.uint8 if keep < 256 else np.uint32)
            ids = np.array([i for x in held["ids"] for i in x], dtype="<i8")
            near = np.sort(np.repeat(held["away"], counts))[:keep].tolist()
            row = {"dim": held["dim"][0], "cell": held["cell"][0], "n": len(counts), "radius": max(held["away"]), "near": near, "counts": counts.astype("<u4").tobytes(), "ids": ids.tobytes(), "v": packed(matrix(held["v"], held["dim"][0]))}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("n", pa.int32()), ("radius", pa.float64()), ("near", pa.list_(pa.float64())), ("counts", pa.binary()), ("ids", pa.binary()), ("v", pa.binary())]))

    order = ["dim", "cell", "away"]
    chunks = cells.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(chunk, "dim int, cell int, n int, radius double, near array<double>, counts binary, ids binary, v binary")
    chunks = table(chunks, "knn-chunks")
    drop(cells)
    summary: dict[int, dict[int, list]] = {d: {} for d in far}
    for r in chunks.select("dim", "cell", "radius", "near").collect():  # a row a chunk
        have = summary[r["dim"]].setdefault(r["cell"], [0.0, []])
        have[0], have[1] = max(have[0], r["radius"]), sorted([*have[1], *r["near"]])[:keep]

    places: dict[int, np.ndarray] = {}  # neighbouring groups follow each other
    for d, p in far.items():
        places[d] = np.empty(len(p), np.int64)
        places[d][np.argsort(distances(p, p[:1])[:, 0], kind="stable")] = np.arange(len(p))

    def group(batches):
        import pyarrow as pa

        for batch in batches:
            for d, at, x in _by_dim(batch):
                if d in far:
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), d, np.int32)), pa.array(places[d][nearest(x, far[d])[0]]), batch.column("v").take(take), batch.column("ids").take(take)], ["dim", "place", "v", "ids"])

    asked = _distinct(vectors, id_column, column, None, every).mapInArrow(group, "dim int, place bigint, v binary, ids array<bigint>")
    asked = table(asked.withColumn("number", F.monotonically_increasing_id()), "knn-queries")

    def bounds(d: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """A score that each query surely reaches, and which cells can hold one that isn't below it."""
        named = sorted(summary[d])
        if not d or not named:
            return np.full(len(q), -np.inf), np.ones((len(q), len(named)), bool), named
        p = far[d][np.array(named) - base[d]]
        with np.errstate(over="ignore", invalid="ignore"):
            norm, inner = np.sqrt((q * q).sum(1)), q @ p.T
            slack = 1e-9 * (1 + np.abs(inner) + norm[:, None] * np.sqrt((p * p).sum(1))[None, :]) + 1e-6 * norm[:, None]
            high = inner + norm[:, None] * np.array([summary[d][c][0] for c in named])[None, :] + slack
            near = np.array([summary[d][c][1] + [np.inf] * (keep - len(summary[d][c][1])) for c in named])
            floor = np.full((len(q), keep), -np.inf)
            for n in range(keep):  # the nth nearest of every cell
                low = inner - norm[:, None] * near[None, :, n] - slack
                low[~np.isfinite(low)] = -np.inf  # beyond a double: no bound
                both = np.concatenate([floor, low], axis=1)
                floor = -np.partition(-both, keep - 1, axis=1)[:, :keep]
        floor = np.minimum(floor.min(1), LONG / 2)  # scores are longs
        return floor, ~(np.maximum(high, -LONG) < floor[:, None]), named

    def block(batches):
        import pyarrow as pa

        # runs of a length, whatever the place: groups share a block
        for held in _runs(batches, ["dim", "cell", "number", "v"], most_rows(block_rows)):
            d = held["dim"][0]
            x = matrix(held["v"], d)
            floor, wants = np.empty(len(x)), np.zeros(size, bool)
            for at in range(0, len(x), 256):
                floor[at : at + 256], wanted, named = bounds(d, x[at : at + 256])
                wants[named] |= wanted.any(0)
            row = {"block": held["number"][0], "q_dim": d, "wants": wants.tolist(), "numbers": np.array(held["number"], "<i8").tobytes(), "floor": floor.astype("<f8").tobytes(), "q": packed(x)}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("block", pa.int64()), ("q_dim", pa.int32()), ("wants", pa.list_(pa.bool_())), ("numbers", pa.binary()), ("floor", pa.binary()), ("q", pa.binary())]))

    parts = max(1, min(64, -(-asked.count() // (4 * block_rows))))
    order = ["dim", "place", "number"]
    blocks = asked.select("dim", F.lit(0).alias("cell"), "place", "number", "v").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    blocks = table(blocks.mapInArrow(block, "block bigint, q_dim int, wants array<boolean>, numbers binary, floor binary, q binary"), "knn-blocks")

    def solve(batches):
        import pyarrow as pa

        best: dict[int, Best] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                at = {n: batch.column(n)[r].as_py() for n in batch.schema.names if n != "q"}
                d, n = at["dim"], at["n"]
                if at["block"] not in best:
                    best[at["block"]] = Best(d, batch.column("q")[r].as_py(), np.frombuffer(at["numbers"], "<i8"), np.frombuffer(at["floor"], "<f8"), keep)
                best[at["block"]].see(unpacked(at["v"], n, d), np.frombuffer(at["ids"], "<i8"), np.frombuffer(at["counts"], "<u4").astype(np.int64), far[d][at["cell"] - base[d]] if d else None, at["radius"])
        for b in best.values():
            number, ids, score = b.found()
            for start in range(0, len(number), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(c[start : start + 65536]) for c in (number, ids, score)], ["number", "vec_id", "score"])

    pairs = chunks.drop("near").join(blocks, F.get("wants", F.col("cell"))).drop("wants", "q_dim")
    found = pairs.mapInArrow(solve, "number bigint, vec_id bigint, score bigint")
    by_score = [F.col("score").desc(), "vec_id"]
    found = found.withColumn("_n", F.row_number().over(Window.partitionBy("number").orderBy(*by_score))).filter(F.col("_n") <= keep).drop("_n")
    found = found.join(asked.select("number", F.explode("ids").alias("query_id")), "number").filter("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(*by_score)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
