"""Tensors stored in blocks: files of neighbouring tiles, with their bounds in a manifest.

Cells are ordered by the Morton number of their tile and cut into files of about ``FILE_CELLS``, so each
file covers a compact part of the index space.  A manifest lists the files with the least and greatest index
of each axis.  A slice at literal subscripts reads only files whose bounds meet it; writing a slice
replaces only those files.  The driver reads the manifest, and each file is a task, so their number is
bounded: those of a large tensor hold more cells, in Morton order too, and a slice skips most of their row groups.

A path holds folders of files and numbered manifests.  Files are never changed: a write adds a folder, then
a manifest, which counts once its ``_SUCCESS`` mark is there.  What an interrupted write leaves behind is
not listed by any manifest, so readers go on with the one before, and readers that began earlier keep
their files.  Two writers must not write to one path at the same time.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.tensor import Tensor

#: Cells in a file, and the most files that one write makes; beyond, files grow.
FILE_CELLS = 1 << 22
MOST_FILES = 1024


def morton(tiles: Sequence[Column], counts: Sequence[int]) -> Column:
    """The bits of several whole numbers in turn, lowest first; each axis has as many as its count needs."""
    out, place = F.lit(0).cast("bigint"), 0
    widths = [max(1, (n - 1).bit_length()) for n in counts]
    if sum(widths) > 62:
        raise ValueError("tiles are too small for a shape of this size")
    for bit in range(max(widths, default=0)):
        for t, width in zip(tiles, widths, strict=True):
            if bit < width:
                out = out.bitwiseOR(F.shiftleft(F.shiftright(t.cast("bigint"), bit).bitwiseAND(F.lit(1)), place))
                place += 1
    return out


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _version(spark: SparkSession, path: str) -> int:
    """The number of the last complete manifest; 0 for none."""
    files, root = _files(spark, f"{path}/manifests")
    if not files.exists(root):
        return 0
    found = [0]
    for status in files.listStatus(root):
        name = status.getPath().getName()
        if name.isdigit() and files.exists(_files(spark, f"{path}/manifests/{name}/_SUCCESS")[1]):
            found.append(int(name))
    return max(found)


def _next(spark: SparkSession, path: str) -> int:
    """A number above all manifests, complete or not."""
    files, root = _files(spark, f"{path}/manifests")
    names = [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []
    return max([0, *(int(n) for n in names if n.isdigit())]) + 1


def _placed(frame: DataFrame, shape: Sequence[int], tile: Sequence[int]) -> DataFrame:
    tiles = [F.expr(f"d{k} div {t}") for k, t in enumerate(tile)]
    return frame.withColumn("z", morton(tiles, [-(-n // t) for n, t in zip(shape, tile, strict=True)]))


def _file_cells(file_cells: int, cells: int) -> int:
    """Cells in a file of a tensor of so many."""
    return max(file_cells, math.ceil(cells / MOST_FILES))


def _write_files(frame: DataFrame, path: str, shape: Sequence[int], tile: Sequence[int], file_cells: int, cells: int) -> DataFrame:
    """Write cells as files of neighbouring tiles; their manifest rows."""
    spark, order = frame.sparkSession, len(shape)
    keys = [f"d{k}" for k in range(order)]
    folder = f"{path}/cells-{uuid.uuid4().hex}"
    parts = max(1, math.ceil(cells / file_cells))
    placed = _placed(frame.select(*keys, "v"), shape, tile)
    dealt = placed.repartitionByRange(parts, "z") if parts > 1 else placed.coalesce(1)
    dealt.sortWithinPartitions("z", *keys).drop("z").write.parquet(folder)
    written = spark.read.schema(frame.select(*keys, "v").schema).parquet(folder)
    bounds = [f(k).alias(f"{n}_{k}") for k in keys for n, f in (("low", F.min), ("high", F.max))]
    return written.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("cells"), *bounds)


def _write_manifest(rows: DataFrame, path: str, shape: Sequence[int], dtype: str, sparse: bool, tile: Sequence[int], file_cells: int) -> None:
    number = _next(rows.sparkSession, path)
    meta = {"shape": list(shape), "dtype": dtype, "sparse": sparse, "tile": list(tile), "file_cells": file_cells}
    rows.withMetadata("cells", meta).coalesce(1).write.parquet(f"{path}/manifests/{number}")


def write_blocks(tensor: Tensor, path: str, tile: Sequence[int] | None = None, file_cells: int | None = None) -> None:
    """Store a tensor of order 1 or more in blocks of ``tile`` cells along each axis; a path that holds one gets a new version."""
    if not tensor.order:
        raise ValueError("a scalar has no blocks")
    size = file_cells or FILE_CELLS
    edge = max(1, round(min(size, 4096) ** (1 / tensor.order)))
    tile = tuple(tile or (min(edge, max(n, 1)) for n in tensor.shape))
    cells = tensor.frame.count() if tensor.sparse else tensor.size
    rows = _write_files(tensor.frame, path.rstrip("/"), tensor.shape, tile, _file_cells(size, cells), cells)
    _write_manifest(rows, path.rstrip("/"), tensor.shape, tensor.dtype, tensor.sparse, tile, size)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, cells, low_d0, high_d0, ...) of the last complete version."""
    number = _version(spark, path.rstrip("/"))
    if not number:
        raise ValueError(f"{path} does not hold a tensor in blocks")
    return spark.read.parquet(f"{path.rstrip('/')}/manifests/{number}")


def _meeting(rows: list, axes: dict[int, int]) -> list[str]:
    """The files whose bounds meet a slice at fixed indices."""
    return [r["file"] for r in rows if all(r[f"low_d{k}"] <= at <= r[f"high_d{k}"] for k, at in axes.items())]


def read_blocks(spark: SparkSession, path: str) -> Tensor:
    """A stored tensor; a statement that fixes some of its indices reads only files that hold them.

    The manifest, a row for each file, is read by the driver.
    """
    listed = manifest(spark, path)
    meta = listed.schema["cells"].metadata
    rows, order = listed.collect(), len(meta["shape"])
    schema = ", ".join([*(f"d{k} bigint" for k in range(order)), f"v {meta['dtype']}"])

    def pick(axes: dict[int, int]) -> DataFrame:
        files = _meeting(rows, axes)
        return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)

    return Tensor(pick({}), tuple(meta["shape"]), meta["dtype"], sparse=meta["sparse"], pick=pick)


def write_slice(tensor: Tensor, path: str, axes: dict[int, int]) -> None:
    """Replace the cells of a stored tensor at some fixed indices.

    ``tensor`` holds the new cells along the other axes, in order.  Only files whose bounds meet the slice
    are written anew; the others keep their names.
    """
    spark, root = tensor.frame.sparkSession, path.rstrip("/")
    listed = manifest(spark, root)
    meta = listed.schema["cells"].metadata
    shape, tile, rows = meta["shape"], meta["tile"], listed.collect()
    left = [k for k in range(len(shape)) if k not in axes]
    if tensor.shape != tuple(shape[k] for k in left) or any(not 0 <= at < shape[k] for k, at in axes.items()):
        raise ValueError(f"a tensor of shape {tensor.shape} does not fill the slice {axes} of {tuple(shape)}")
    if tensor.sparse and not meta["sparse"]:
        raise ValueError("a tensor of stored cells only cannot be part of one with all cells")
    names = {k: F.lit(at).cast("bigint") for k, at in axes.items()} | {k: F.col(f"d{i}") for i, k in enumerate(left)}
    new = tensor.frame.select(*(names[k].alias(f"d{k}") for k in range(len(shape))), F.col("v").cast(meta["dtype"]).alias("v"))
    touched = set(_meeting(rows, axes))
    inside = F.lit(True)
    for k, at in axes.items():
        inside = inside & (F.col(f"d{k}") == at)
    made = new
    if touched:
        made = new.unionByName(spark.read.schema(new.schema).parquet(*sorted(touched)).where(~inside))
    cells = sum(r["cells"] for r in rows if r["file"] in touched) + (0 if touched else tensor.size)
    written = _write_files(made, root, shape, tile, _file_cells(meta["file_cells"], sum(r["cells"] for r in rows)), cells)
    kept = listed.where(~F.col("file").isin(sorted(touched))) if touched else listed
    _write_manifest(kept.unionByName(written), root, shape, meta["dtype"], meta["sparse"], tile, meta["file_cells"])
