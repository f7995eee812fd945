"""Contractions of two tensors on dense tiles.

``Out[b.., i.., j..] += f(Left[b.., i.., k..], Right[b.., k.., j..])`` for any f of two tensors: products,
distances, counts of matches.  Joined by cells, every pair of cells with one k is a row.  Here cells are
packed into tiles where they are read, tiles meet by key, and one task works a pair of tiles out as arrays:
a product as a matrix product, anything else element by element over slices.

* The key of a meeting is (batch, tile of i, tile of j, tile of k).  A left tile is copied once for each
  tile of j, a right one for each tile of i, so a meeting holds two tiles however long any axis is.
* Copies grow with the square where both axes of the result are long.  With more than ``COPIES`` tiles along both
  and one of k, every tile is shuffled once, to a partition of its side, and a task reads one partition of
  each side (a cross join without a broadcast).  The result travels as rows of a tile and is exploded last.
* What meets with the same i and j is added up inside a task, up to ``HELD`` bytes, and then by Spark's
  own aggregation, cell by cell.
* Tiles travel as positions and values, so half-filled ones are no larger than their cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tessellum.functions import arrays
from tessellum.lang.syntax import Infix, Node, Number, Read, Statement
from tessellum.tensor import Tensor

#: Most cells of a tile along an axis of the result, and along the contracted one.
SIDE, DEPTH = 1024, 256
#: Statements with fewer combinations of index values than this are joined by cells.
LEAST_WORK = 1 << 24
#: Cells that are packed at once, and bytes of partial results that a task holds.
PACKED = 1 << 18
HELD = 64 << 20
#: Numbers in a slice of an expression that is no product.
SLICE = 1 << 17
#: Tiles along each axis of the result up to which tiles are copied; beyond, partitions of a side, and tiles in one.
COPIES, DEALT, SHARE = 4, 64, 16
#: Tasks of a cross join for each core, if ``DEALT`` partitions are not reached before.
TASKS = 16
_PARTS = "b long, i long, k long, at binary, x binary"
_SUMS = "b long, i long, j long, x double"
#: Without nulls, which spares a check for each cell.
_ROWS = StructType([StructField("i", LongType(), False), StructField("j", LongType(), False), StructField("x", ArrayType(DoubleType(), False), False)])


@dataclass(frozen=True)
class Contraction:
    """Two reads and the roles of their index variables."""

    left: Read
    right: Read
    batch: tuple[str, ...]
    rows: tuple[str, ...]
    inner: tuple[str, ...]
    columns: tuple[str, ...]
    scale: float | None
    expression: Node
    loose: bool

    def sizes(self, sizes: dict[str, int]) -> tuple[int, int, int]:
        return tuple(math.prod(sizes[c] for c in letters) for letters in (self.rows, self.inner, self.columns))


def _scale(node: Node) -> float | None:
    """The product of an expression's numbers, if it is a product of numbers and two tensors."""
    if isinstance(node, Number):
        return node.value
    if isinstance(node, Read):
        return 1.0
    if isinstance(node, Infix) and node.operator == "*":
        a, b = _scale(node.left), _scale(node.right)
        return None if a is None or b is None else a * b
    return None


def _times(node: Node) -> int:
    return 1 if isinstance(node, Read) else sum(_times(x) for x in (node.left, node.right)) if isinstance(node, Infix) else 0


def recognise(statement: Statement, loose: bool) -> Contraction | None:
    """The roles of a sum over two tensors that share a reduced index and have one each of their own; else None."""
    reads = statement.reads
    if statement.kind not in ("+=", "-=") or len(reads) != 2 or not arrays.supported(statement.expression):
        return None
    left, right = reads
    out, shared = set(statement.output.letters), set(left.letters) & set(right.letters)
    inner = tuple(c for c in left.letters if c in shared and c not in out)
    rows, columns = (tuple(c for c in r.letters if c not in shared) for r in (left, right))
    own = {*rows, *columns}
    if not inner or not rows or not columns or not own <= out or not out <= own | shared:
        return None
    if set(statement.index_variables) != own | shared:
        return None
    # A tensor that is read twice under the same subscripts is one factor squared, and no matrix product.
    scale = _scale(statement.expression) if _times(statement.expression) == 2 else None
    return Contraction(left, right, tuple(c for c in left.letters if c in shared and c in out), rows, inner, columns, scale, statement.expression, loose)


def position(letters: tuple[str, ...], sizes: dict[str, int]) -> Column:
    """The row-major position of some index variables; 0 for none."""
    at = F.lit(0).cast("bigint")
    for c in letters:
        at = at * sizes[c] + F.col(c)
    return at


def letters_of(at: str, letters: tuple[str, ...], sizes: dict[str, int]) -> list[Column]:
    if len(letters) == 1:
        return [F.col(at).cast("bigint").alias(letters[0])]
    out, stride = [], math.prod(sizes[c] for c in letters)
    for c in letters:
        stride //= sizes[c]
        out.append(F.pmod(F.expr(f"{at} div {stride}"), F.lit(sizes[c])).cast("bigint").alias(c))
    return out


def _grouped(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each key begins in it."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    return order, np.flatnonzero(new)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells (b, i, k, at, x) as a row for each tile that some of them belong to."""

    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        b, i, k, at, x = (np.concatenate([h.column(c).to_numpy(zero_copy_only=False) for h in held]) for c in ("b", "i", "k", "at", "x"))
        order, begin = _grouped([b, i, k])
        at, x, ends = at[order].astype(np.int32), x[order].astype(float), [*begin[1:], len(order)]
        blobs = [pa.array([c[p:q].tobytes() for p, q in zip(begin, ends, strict=True)], pa.binary()) for c in (at, x)]
        return pa.record_batch([*(pa.array(c[order[begin]]) for c in (b, i, k)), *blobs], names=["b", "i", "k", "at", "x"])

    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= PACKED:
            yield made(held)
            held, count = [], 0
    if count:
        yield made(held)


def packed(frame: DataFrame, value: str, batch: Column, row: Column, column: Column, tile: tuple[int, int]) -> DataFrame:
    """Cells as (b, i, k, at, x): parts of tiles, with positions inside the tile and values."""
    high, wide = tile
    placed = frame.select(batch.cast("bigint").alias("b"), row.cast("bigint").alias("r"), column.cast("bigint").alias("c"), F.col(value).cast("double").alias("x"))
    cell = F.pmod("r", F.lit(high)) * wide + F.pmod("c", F.lit(wide))
    return placed.select("b", F.expr(f"r div {high}").alias("i"), F.expr(f"c div {wide}").alias("k"), cell.cast("int").alias("at"), "x").mapInArrow(_pack, _PARTS)


def dense(parts: pa.Table, high: int, wide: int, pitch: int) -> np.ndarray:
    """The tile of some parts as a (high, wide) array; ``pitch`` is the width that positions count."""
    out = np.zeros(high * pitch)
    for at, x in zip(parts.column("at").to_pylist(), parts.column("x").to_pylist(), strict=True):
        out[np.frombuffer(at, np.int32)] = np.frombuffer(x, float)
    return out.reshape(high, pitch)[:, :wide]


def _meet(plan: Contraction, extents: tuple[int, int, int], tile: tuple[int, int, int]):
    """The partial tile (i, j) of the result that a pair of tiles (i, k) and (k, j) makes."""

    def run(i: int, k: int, j: int, left: pa.Table, right: pa.Table) -> np.ndarray:
        high, deep, wide = (min(t, n - at * t) for t, n, at in zip(tile, extents, (i, k, j), strict=True))
        x, y = dense(left, high, deep, tile[1]), dense(right, deep, wide, tile[2])
        if plan.scale is not None:
            with np.errstate(all="ignore"):
                return np.ascontiguousarray((x @ y) * plan.scale if plan.scale != 1.0 else x @ y)
        made, step = np.empty((high, wide)), max(1, SLICE // wide)
        # What is 1 or 0 is counted in as few bytes as hold the count.
        counted = isinstance(plan.expression, Infix) and plan.expression.operator in arrays.TESTS
        part = np.empty((min(step, high), wide), np.min_scalar_type(deep) if counted else float)
        for first in range(0, high, step):
            part = part[: high - first]
            part[:] = 0
            for at in range(deep):
                cells = {plan.left: x[first : first + step, at, None], plan.right: y[at][None]}
                with np.errstate(all="ignore"):
                    part += arrays.test(plan.expression, cells.__getitem__, plan.loose).view(np.uint8) if counted else arrays.evaluate(plan.expression, cells.__getitem__, plan.loose)
            made[first : first + step] = part
        return made

    return run


def _met(meet):
    """A pair of tiles as one partial tile, a row."""
    schema = pa.schema([("b", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("x", pa.binary())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        b, i, j, k = (left.column(c)[0].as_py() for c in ("b", "i", "j", "k"))
        return pa.table([[b], [i], [j], [meet(i, k, j, left, right).tobytes()]], schema=schema)

    return run


def _crossed(meet, tile: tuple[int, int, int]):
    """Pairs of whole tiles as the rows of the tiles that they make: (i, first j, values)."""
    schema = pa.schema([pa.field("i", pa.int64(), False), pa.field("j", pa.int64(), False), pa.field("x", pa.list_(pa.field("element", pa.float64(), False)), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            for n, (i, j) in enumerate(zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), strict=True)):
                x, y = (pa.Table.from_struct_array(c.slice(n, 1).flatten()) for c in (left, right))
                made = meet(i, 0, j, x, y)
                high, wide = made.shape
                rows = pa.ListArray.from_arrays(pa.array(np.arange(high + 1, dtype=np.int32) * wide, pa.int32()), pa.array(made.ravel()), pa.list_(pa.field("element", pa.float64(), False)))
                yield pa.record_batch([pa.array(i * tile[0] + np.arange(high)), pa.array(np.full(high, j * tile[2])), rows], schema=schema)

    return run


def _added(extents: tuple[int, int, int], tile: tuple[int, int, int]):
    """Partial tiles added up inside a task, then as cells."""

    def cells(sums: dict[tuple[int, int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
        for (b, i, j), x in sums.items():
            wide = min(tile[2], extents[2] - j * tile[2])
            at = np.arange(len(x))
            for first in range(0, len(x), 1 << 16):
                part = at[first : first + (1 << 16)]
                yield pa.record_batch([pa.array(np.full(len(part), b)), pa.array(i * tile[0] + part // wide), pa.array(j * tile[2] + part % wide), pa.array(x[part])], names=["b", "i", "j", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        held = 0
        for batch in batches:
            for b, i, j, raw in zip(*(batch.column(c).to_pylist() for c in ("b", "i", "j", "x")), strict=True):
                x = np.frombuffer(raw, float)
                if (b, i, j) in sums:
                    sums[b, i, j] += x
                else:
                    if held + x.nbytes > HELD:
                        yield from cells(sums)
                        sums, held = {}, 0
                    sums[b, i, j] = x.copy()
                    held += x.nbytes
        yield from cells(sums)

    return run


def _each(count: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")))


def _dealt(parts: DataFrame, tile: str, name: str, count: int) -> DataFrame:
    """The ``count`` tiles of a side, each whole in a row, dealt evenly to partitions of at most ``SHARE``, or as many as cores need."""
    cores = parts.sparkSession.sparkContext.defaultParallelism
    partitions = min(count, max(min(DEALT, math.ceil(math.sqrt(TASKS * cores))), -(-count // SHARE)))
    dealt = parts.withColumn("part", F.pmod(tile, F.lit(partitions)).cast("int")).repartitionById(partitions, F.col("part"))
    return dealt.groupBy("part", tile).agg(F.collect_list(F.struct("at", "x")).alias(name)).drop("part")


def contract(plan: Contraction, left: DataFrame, right: DataFrame, sizes: dict[str, int], names: tuple[str, str], side: int | None = None, depth: int | None = None) -> DataFrame:
    """(letters of the result.., x) of a contraction of two frames of cells; ``names`` are their value columns."""
    side, depth = side or SIDE, depth or DEPTH
    extents = plan.sizes(sizes)
    tile = (min(side, extents[0]), min(depth, extents[1]), min(side, extents[2]))
    across, down = -(-extents[2] // tile[2]), -(-extents[0] // tile[0])
    batch, inner = position(plan.batch, sizes), position(plan.inner, sizes)
    a = packed(left, names[0], batch, position(plan.rows, sizes), inner, tile[:2])
    b = packed(right, names[1], batch, inner, position(plan.columns, sizes), tile[1:])
    meet = _meet(plan, extents, tile)
    if min(across, down) > COPIES and not plan.batch and extents[1] <= tile[1]:
        b = b.select(F.col("k").alias("j"), "at", "x")
        pairs = _dealt(a, "i", "left", down).crossJoin(_dealt(b, "j", "right", across).hint("shuffle_replicate_nl"))
        rows = pairs.mapInArrow(_crossed(meet, tile), _ROWS)
        cells = rows.select("i", "j", F.posexplode("x").alias("at", "x")).select("i", (F.col("j") + F.col("at")).alias("j"), "x")
        return cells.select(*letters_of("i", plan.rows, sizes), *letters_of("j", plan.columns, sizes), "x")
    a = a.withColumn("j", _each(across))
    b = b.select("b", F.col("i").alias("k"), F.col("k").alias("j"), "at", "x").withColumn("i", _each(down))
    key = ["b", "i", "j", "k"]
    parts = a.select(*key, "at", "x").groupBy(*key).cogroup(b.select(*key, "at", "x").groupBy(*key)).applyInArrow(_met(meet), "b long, i long, j long, x binary")
    cells = parts.mapInArrow(_added(extents, tile), _SUMS)
    if extents[1] > tile[1]:
        cells = cells.groupBy("b", "i", "j").agg(F.sum("x").alias("x"))
    made = [*letters_of("b", plan.batch, sizes), *letters_of("i", plan.rows, sizes), *letters_of("j", plan.columns, sizes)]
    return cells.select(*made, "x")


# Tiles as a layout of their own.


def to_tiles(tensor: Tensor, side: int = SIDE, depth: int = DEPTH) -> DataFrame:
    """A matrix as whole tiles (tile_i, tile_k, x): x holds the cells of a tile, row by row, as an array of doubles."""
    if tensor.order != 2:
        raise ValueError(f"tiles are cut from matrices; the tensor has order {tensor.order}")
    rows, columns = tensor.shape
    high, wide = min(side, rows), min(depth, columns)

    def whole(parts: pa.Table) -> pa.Table:
        i, k = (parts.column(c)[0].as_py() for c in ("i", "k"))
        x = dense(parts, min(high, rows - i * high), min(wide, columns - k * wide), wide).ravel()
        return pa.table([[i], [k], pa.array([x.tolist()], pa.list_(pa.float64()))], names=["tile_i", "tile_k", "x"])

    parts = packed(tensor.frame, "v", F.lit(0), F.col("d0"), F.col("d1"), (high, wide))
    return parts.groupBy("i", "k").applyInArrow(whole, "tile_i long, tile_k long, x array<double>")


def from_tiles(tiles: DataFrame, shape: tuple[int, int], side: int = SIDE, depth: int = DEPTH, dtype: str = "double") -> Tensor:
    """The matrix of some tiles, as :func:`to_tiles` cuts them."""
    high, wide = min(side, shape[0]), min(depth, shape[1])
    width = F.least(F.lit(wide), F.lit(shape[1]) - F.col("tile_k") * wide)
    cells = tiles.select("tile_i", "tile_k", width.alias("width"), F.posexplode("x").alias("p", "v"))
    return Tensor(cells.select((F.col("tile_i") * high + F.expr("p div width")).cast("bigint").alias("d0"), (F.col("tile_k") * wide + F.expr("p % width")).cast("bigint").alias("d1"), F.col("v").cast(dtype).alias("v")), tuple(shape), dtype)
