"""Durable intermediate results in the folder that the cluster shares.

``spark.checkpoint.dir`` names that folder.  Only where the setting is absent, as in tests, a
folder of this machine is used.  Nothing here relies on executors' own disks, so a lost executor
costs a recomputation of its tasks at most.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
#: Bytes in a row group: what a writer holds back, and what a reader fetches of a column, stay small.
ROW_GROUP = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; without one, a temporary folder of this machine, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        named = "file://" + tempfile.mkdtemp(prefix="tessellum-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint."""
    spark = df.sparkSession
    named = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return df.checkpoint(eager=True)


def table(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Compute ``df`` once into compressed columnar files in the shared folder and read them back.

    Compared with :func:`cut` the files are several times smaller and column pruning still works.  The
    writer looks at its size after every row at first; by default it would hold 100 rows of any size.
    """
    spark = df.sparkSession
    path = place(spark, name)
    sized = df.write.option("compression", codec).option("parquet.block.size", ROW_GROUP)
    sized.option("parquet.page.size.row.check.min", 1).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def place(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is deleted by :func:`release`, or when the session ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tessellum/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    where, files = located(spark, path)
    files.deleteOnExit(where)
    return path


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`table` returned, once everything made of it is stored itself."""
    spark, files = df.sparkSession, df.inputFiles()
    path = next((p for p in _written if files and f"/{p.rpartition('/')[2]}/" in files[0]), None)
    if path is not None:
        where, system = located(spark, path)
        system.delete(where, True)
        _written.remove(path)


def located(spark: SparkSession, path: str):
    """A path and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written() -> int:
    """How many tables are kept now; a place to :func:`release` from."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the tables written after the first ``since``, but for the last ``keep``.

    Results that read them must be stored first.  What is never released goes when the session ends.
    """
    for path in _written[since : len(_written) - keep]:
        where, files = located(spark, path)
        files.delete(where, True)
    del _written[since : len(_written) - keep]
