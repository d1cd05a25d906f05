"""Sharding by a Hilbert curve over metadata, with built-in DataFrame functions only.

Dimensions are quantised to BITS bits each, a higher-order aggregate turns each grid point that occurs into its place on
the curve, and the rows in curve order are cut into runs of equal counts. A string dimension is quantised by rank: its
distinct values, in order, share out the grid lines by their rows. The global rank comes from counts: cells of the curve,
ranges of a text hash within a cell, texts and ranges of a row hash within such a range (a hot cell and a text with very
many copies are spread over many ranges), and a row number within those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import prefix_sums, table, text_of

BITS = 5
#: Rows of a range that the number of ranges is chosen for.
ROWS_A_RANGE = 20_000


def hilbert_index(axes: list[Column], bits: int = BITS) -> Column:
    """Place on the Hilbert curve of a grid point with len(axes) coordinates of bits bits each.

    Reflections and exchanges from the highest bit down, then the Gray code of the result, then the bits interleaved;
    each loop is one higher-order aggregate, so an expression is never copied into itself.
    """
    n = len(axes)
    zero = F.lit(0).cast("long")
    point = F.array(*[F.coalesce(a.cast("long"), F.lit(0)) for a in axes])
    steps = F.array(*[F.struct(F.lit(1 << q).cast("long").alias("q"), F.lit(i).alias("i")) for q in range(bits - 1, 0, -1) for i in range(n)])

    def turn(x: Column, step: Column) -> Column:
        low, xi, x0 = step["q"] - 1, F.get(x, step["i"]), F.get(x, F.lit(0))
        swap = (x0.bitwiseXOR(xi)).bitwiseAND(low)
        is_set = xi.bitwiseAND(step["q"]) != 0
        return F.transform(x, lambda v, j: F.when(is_set, F.when(j == 0, v.bitwiseXOR(low)).otherwise(v)).otherwise(F.when((j == 0) | (j == step["i"]), F.when(step["i"] == 0, v).otherwise(v.bitwiseXOR(swap))).otherwise(v)))

    turned = F.aggregate(steps, point, turn)
    # Gray code: each axis is combined with all before it, then with the parities of the last one
    gray = F.transform(turned, lambda v, j: F.aggregate(F.slice(turned, F.lit(1), j + 1), zero, lambda a, b: a.bitwiseXOR(b)))
    masks = F.array(*[F.lit(1 << q).cast("long") for q in range(bits - 1, 0, -1)])
    spread = F.aggregate(F.array(gray), zero, lambda _, g: F.aggregate(masks, zero, lambda t, q: F.when(F.get(g, F.lit(n - 1)).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t)))
    final = F.transform(F.array(F.struct(gray.alias("g"), spread.alias("t"))), lambda s: F.transform(s["g"], lambda v: v.bitwiseXOR(s["t"])))
    places = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(i).alias("i")) for q in range(bits - 1, -1, -1) for i in range(n)])
    bit = lambda x, p: F.when(F.get(x, p["i"]).bitwiseAND(F.element_at(F.array(*[F.lit(1 << q).cast("long") for q in range(bits)]), p["q"] + 1)) != 0, 1).otherwise(0)
    return F.aggregate(final, zero, lambda _, x: F.aggregate(places, zero, lambda h, p: h * 2 + bit(x, p)))


def _range_bits(rows: int) -> int:
    """Bits of a hash that divide all rows into ranges of about ROWS_A_RANGE."""
    return max(2, -(-rows // ROWS_A_RANGE).bit_length())


def _before(by: list[str], order: str, value: str) -> Column:
    """Sum of value over the rows before, 0 for the first."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _lines(docs: DataFrame, dim: str, bits: int) -> DataFrame:
    """(value, line) for each distinct value of a string column: 1 .. 2^bits - 1 by the rows before it in order of value.

    Values go by ranges to tasks, whose sums are added up first, so very many distinct values are no single task's.
    """
    counts = docs.select(F.col(f"`{dim}`").cast("string").alias("value")).filter("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    places = prefix_sums(counts, ["value"], {"_at": "n"}).join(F.broadcast(total), F.lit(True))  # one row on the right
    top = (1 << bits) - 1
    return places.select("value", F.expr(f"cast(_at * {top} div _total as bigint) + 1").alias("line"))


def shard(docs: DataFrame, shards: int = 8, dims: tuple[str, ...] = ("source", "lang"), bits: int = BITS, carry: bool = False) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard, curve): every document in one of the shards.

    size is the text's UTF-8 bytes plus 1 (null text: 1), text_crc32 that of the bytes (null: of none); a very long text
    weighs as any other row. The curve's axes are the logarithm of size and the string columns dims, by rank; a null is
    the lowest grid line. law is "rows": shards are runs of the curve order whose row counts differ by at most one, slot
    counts from 0 in a shard, grown_shard is null. Equal texts of one curve cell are neighbours, in an order that follows
    from (size, text_crc32) and the row; equal rows tie and take neighbouring slots. An empty table gives an empty result.
    Other columns of docs are ignored, unless carry adds all of them as a struct "row".
    """
    text = F.encode(text_of(), "UTF-8")
    kept = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), *[F.col(f"`{d}`").cast("string").alias(f"_v{i}") for i, d in enumerate(dims)], *kept)
    for i, d in enumerate(dims):
        rows = rows.join(_lines(docs, d, bits).select(F.col("value").alias(f"_v{i}"), F.col("line").alias(f"_g{i + 1}")), f"_v{i}", "left").drop(f"_v{i}")
    grid = [f"_g{i}" for i in range(len(dims) + 1)]
    rows = rows.withColumn("_g0", F.least(F.floor(F.log2("size") * 1.5), F.lit((1 << bits) - 1)).cast("long"))
    rows = rows.select("doc_id", "size", "text_crc32", *["row"] * carry, *[F.coalesce(g, F.lit(0)).cast("long").alias(g) for g in grid])
    rows = rows.withColumn("_text", F.xxhash64("size", "text_crc32")).withColumn("_own", F.xxhash64("doc_id", "size", "text_crc32"))
    rows = table(rows, "hilbert-rows")
    total = rows.count()
    top = _range_bits(total)
    # at most 2^(bits * axes) points, whatever the input: each one's place is computed once
    points = rows.select(*grid).distinct().withColumn("curve", hilbert_index([F.col(g) for g in grid], bits))
    rows = rows.join(F.broadcast(points), grid).drop(*grid)
    first = lambda c: F.shiftrightunsigned(c, 64 - top).cast("int")
    rows = rows.withColumn("_range", first("_text")).withColumn("_part", first("_own"))

    parts = rows.groupBy("curve", "_range", "_text", "_part").agg(F.count("*").alias("_n"))
    texts = parts.withColumn("_place", F.struct("_text", "_part"))
    ranges = parts.groupBy("curve", "_range").agg(F.sum("_n").alias("_sum"))
    cells = ranges.groupBy("curve").agg(F.sum("_sum").alias("_cell"))  # as many as points
    cells = cells.select("curve", _before([], "curve", "_cell").alias("_cell_at"))
    ranges = ranges.withColumn("_range_at", _before(["curve"], "_range", "_sum")).join(cells, "curve").select("curve", "_range", (F.col("_cell_at") + F.col("_range_at")).alias("_start"))
    starts = texts.withColumn("_in_range", _before(["curve", "_range"], "_place", "_n")).join(ranges, ["curve", "_range"])
    starts = starts.select("curve", "_text", "_part", (F.col("_start") + F.col("_in_range")).alias("_start"))

    inside = Window.partitionBy("curve", "_text", "_part").orderBy("_own", "doc_id")
    ranked = rows.join(starts, ["curve", "_text", "_part"]).withColumn("_rank", F.col("_start") + F.row_number().over(inside) - 1)
    small, larger = max(1, total // shards), total % shards
    edge = larger * (total // shards + 1)
    where = F.when(F.col("_rank") < edge, F.expr(f"_rank div {total // shards + 1}")).otherwise(F.lit(larger) + F.expr(f"(_rank - {edge}) div {small}"))
    slot = F.when(F.col("_rank") < edge, F.col("_rank") % (total // shards + 1)).otherwise((F.col("_rank") - edge) % small)
    out = ["doc_id", "size", "text_crc32", F.lit("rows").alias("law"), where.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve"]
    return ranked.select(*out, *["row"] * carry)


def write_shards(docs: DataFrame, path: str, dims: tuple[str, ...] = ("source", "lang"), **options) -> DataFrame:
    """Write docs in curve order to path, in a folder for each shard; gives the files' statistics.

    Each file is a run of the curve, so it holds narrow ranges of several dimensions at once.
    """
    placed = shard(docs, dims=dims, carry=True, **options)
    placed = placed.select(*[F.col(c).alias(f"tm_{c}") for c in ("shard", "slot", "size")], "row.*")  # docs may have such names
    placed.repartitionByRange("tm_shard", "tm_slot").sortWithinPartitions("tm_shard", "tm_slot").write.partitionBy("tm_shard").parquet(path)
    return file_statistics(docs.sparkSession, path, (*dims, "tm_size"))


def file_statistics(spark, path: str, columns: tuple[str, ...]) -> DataFrame:
    """(file, rows, and low_c, high_c, nulls_c for each column): what each file under path holds."""
    ends = [f(c).alias(f"{k}_{c}") for c in columns for k, f in (("low", F.min), ("high", F.max), ("nulls", lambda c: F.count_if(F.col(c).isNull())))]
    return spark.read.parquet(path).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("rows"), *ends)


def files_for(statistics: DataFrame, **ranges) -> DataFrame:
    """The files of file_statistics that may hold a row with low <= column <= high for every column=(low, high)."""
    out = statistics
    for c, (low, high) in ranges.items():
        out = out.filter((F.col(f"low_{c}") <= F.lit(high)) & (F.col(f"high_{c}") >= F.lit(low)))
    return out.select("file")
