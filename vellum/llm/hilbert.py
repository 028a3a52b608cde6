"""Sharding along a Hilbert curve, with DataFrame functions only.

Several metadata dimensions are quantised to a few bits each; the cell of a row
gets its index on the Hilbert curve; rows sorted by that index are cut into
runs of equal counts. Neighbours on the curve are neighbours in all dimensions,
so the minima and maxima of each shard (zone_map) prune on any of them.

No global sort: cells are counted, each cell is split into pieces of about
PIECE_ROWS rows by a hash of the row's key, and a row's rank is the rows in cells
and pieces before its own plus its row number in its piece. A cell that holds a
third of all rows is so shared by many tasks. What is broadcast is the table of
cells, at most 2**MAX_BITS rows; offsets of pieces are joined where their rows are.

Defined results: a null dimension is quantised to 0; null or empty texts have
size 8; an empty table gives an empty result; rows that repeat are placed as
separate rows, and of rows with equal key, which are of one cell, either may come first; columns
named shard, slot or curve_index are replaced; other columns pass through, whatever their names.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.runtime import unused, written

#: Bits of a cell code over all dimensions.
MAX_BITS = 12
#: Rows of a cell that one window partition gets, about.
PIECE_ROWS = 1 << 9
SHARDS = 24


def _curve_position(axes: list[int], bits: int) -> int:
    """Index on the Hilbert curve of a cell, after Skilling (2004): undo the turns, then Gray decode."""
    x, n = list(axes), len(axes)
    for level in range(bits - 1, 0, -1):
        high, low = 1 << level, (1 << level) - 1
        for i in range(n):
            if x[i] & high:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = 0
    for level in range(bits - 1, 0, -1):
        if x[-1] & (1 << level):
            flip ^= (1 << level) - 1
    x = [v ^ flip for v in x]
    position = 0
    for level in range(bits - 1, -1, -1):
        for v in x:
            position = position << 1 | (v >> level & 1)
    return position


@cache
def curve_table(dimensions: int, bits: int) -> list[int]:
    """Curve index of each cell; a cell's code holds the axes one after another, first axis highest."""
    if dimensions < 1 or dimensions * bits > MAX_BITS:
        raise ValueError(f"dimensions * bits is {dimensions * bits}; at most {MAX_BITS}")
    mask = (1 << bits) - 1
    return [_curve_position([code >> bits * (dimensions - 1 - i) & mask for i in range(dimensions)], bits) for code in range(1 << dimensions * bits)]


def curve_index(axes: list[Column], bits: int) -> Column:
    """Curve index of integer axes below 2**bits; the table is a constant of the plan."""
    code = F.lit(0)
    for axis in axes:
        code = F.shiftleft(code, bits).bitwiseOR(axis.cast("int"))
    table = F.split(F.lit(",".join(map(str, curve_table(len(axes), bits)))), ",").cast("array<int>")
    return F.get(table, code)


def hashed_axis(value: Column, bits: int) -> Column:
    """Quantise a category: equal values share an axis cell; null is 0."""
    return F.coalesce(F.pmod(F.crc32(value.cast("string").cast("binary")), F.lit(1 << bits)), F.lit(0)).cast("int")


def magnitude_axis(value: Column, bits: int, least: int = 0) -> Column:
    """Quantise a size to its power of two, counted from 2**least; null is 0."""
    power = F.length(F.bin(F.greatest(value.cast("long"), F.lit(0)))) - 1 - least
    return F.coalesce(F.least(F.greatest(power, F.lit(0)), F.lit((1 << bits) - 1)), F.lit(0)).cast("int")


def document_axes(size: Column, bits: int = MAX_BITS // 3) -> list[Column]:
    """Source, language and size of a document."""
    return [hashed_axis(F.col("source"), bits), hashed_axis(F.col("lang"), bits), magnitude_axis(size, bits, 4)]


def hilbert_shards(df: DataFrame, axes: list[Column], key: Column, shards: int = SHARDS) -> DataFrame:
    """Add curve_index, shard and slot; shards differ by one row at most.

    key spreads and orders the rows of one cell; rows of equal key may come in either order."""
    bits = MAX_BITS // len(axes)
    kept = [c for c in df.columns if c.lower() not in ("curve_index", "shard", "slot")]
    cell, piece, pieces, order, row, before, total = unused(df, "cell", "piece", "pieces", "order", "row", "before", "total")
    placed = df.withColumns({cell: curve_index(axes, bits), order: key})
    cells = placed.groupBy(cell).agg(F.count("*").alias("n"))
    along = Window.orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = cells.select(cell, F.ceil(F.col("n") / F.lit(PIECE_ROWS)).cast("int").alias(pieces), F.coalesce(F.sum("n").over(along), F.lit(0)).alias("cells_before"), F.sum("n").over(everywhere).alias(total))
    cells = F.broadcast(written(cells, "curve-cells"))
    placed = placed.join(cells.select(cell, pieces), cell).withColumn(piece, F.pmod(F.xxhash64(order), F.col(pieces)).cast("int"))
    within = Window.partitionBy(cell).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(cell, piece).agg(F.count("*").alias("n")).select(cell, piece, F.coalesce(F.sum("n").over(within), F.lit(0)).alias("pieces_before"))
    offsets = offsets.join(cells, cell).select(cell, piece, (F.col("cells_before") + F.col("pieces_before")).alias(before), total)
    own = Window.partitionBy(cell, piece).orderBy(order)
    # the ranks stand by cell and piece already, so this join moves offsets only
    ranked = placed.withColumn(row, F.row_number().over(own)).join(offsets, [cell, piece])
    rank = F.col(before) + F.col(row) - 1
    # shard i holds the ranks from ceil(i * total / shards) on
    shard = F.expr(f"cast((`{before}` + `{row}` - 1) * {shards} div `{total}` as int)")
    first = F.expr(f"(((`{before}` + `{row}` - 1) * {shards} div `{total}`) * `{total}` + {shards - 1}) div {shards}")
    return ranked.select(*kept, F.col(cell).alias("curve_index"), shard.alias("shard"), (rank - first).alias("slot"))


def zone_map(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, minimum and maximum of each column by shard: what file pruning reads."""
    bounds = [f(c).alias(f"{name}_{c}") for c in columns for name, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), *bounds)
