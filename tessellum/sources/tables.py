"""Tensors stored as Parquet: coordinate rows, shape and type in the schema's metadata."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessellum.tensor import Tensor


def write_tensor(tensor: Tensor, path: str, mode: str = "errorifexists") -> None:
    """Write the cells; shape and type travel as metadata of column v."""
    named = tensor.frame.withMetadata("v", {"shape": list(tensor.shape), "dtype": tensor.dtype, "sparse": tensor.sparse})
    named.write.mode(mode).parquet(path)


def read_tensor(spark: SparkSession, path: str) -> Tensor:
    """A tensor written by :func:`write_tensor`; filters on coordinates reach the files."""
    frame = spark.read.parquet(path)
    meta = frame.schema["v"].metadata
    if "shape" not in meta:
        raise ValueError(f"{path} does not hold a tensor")
    order = len(meta["shape"])
    cells, sparse = frame.select(*(F.col(f"d{k}") for k in range(order)), "v"), meta.get("sparse", False)
    return Tensor(cells, tuple(meta["shape"]), meta["dtype"], sparse=sparse, given=cells if sparse else None)


def shared_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; without it, a temporary one, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        named = "file://" + tempfile.mkdtemp(prefix="tessellum-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A new folder for intermediate results that all machines see."""
    return f"{shared_root(spark)}/tessellum-{uuid.uuid4().hex}"


def settled(tensor: Tensor) -> Tensor:
    """A tensor computed once, its lineage cut by a reliable checkpoint."""
    shared_root(tensor.frame.sparkSession)
    return Tensor(tensor.frame.checkpoint(eager=True), tensor.shape, tensor.dtype, sparse=tensor.sparse)


def write_results(results: dict[str, Tensor], path: str, mode: str = "errorifexists") -> None:
    """Every tensor of a result under its name."""
    for name, tensor in results.items():
        write_tensor(tensor, f"{path.rstrip('/')}/{name}", mode)
