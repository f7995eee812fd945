"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A row's shard follows from a stable 64-bit key and the number of shards; there is no ring and no
table.  With one shard more, a row either stays or moves to the new shard.

A null key column counts as the key of an empty name, so such rows share one shard; repeated rows
go to the same shard and get slots of their own.  Null text has no bytes.  Shards depend on keys alone;
slots on the set of rows, but for the order of equal ones.
"""

from __future__ import annotations

import functools
import operator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellum.llm import storage

#: Groups in which slots are numbered, for each shard; a group of a 100 TB table has about a million rows.
SLOT_GROUPS = 4096


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, 0 to shards - 1, of each 64-bit key."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = np.asarray(keys).astype(np.uint64)
    at, ahead = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        at[live] = ahead[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        scale = float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[live] = ((at[live] + 1) * scale).astype(np.int64)
        live = live[ahead[live] < shards]
    return at.astype(np.int32)


def with_shards(df: DataFrame, key: str, shards: int, name: str = "shard") -> DataFrame:
    """``df`` with the shard of column ``key`` (of any type that has a string form)."""
    own = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")))

    @F.pandas_udf("int")
    def shard(k: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(k.to_numpy().view(np.uint64), shards))

    return df.withColumn(name, shard(own))


def with_slots(df: DataFrame, shard: str, order: list[str], name: str = "slot", groups: int = SLOT_GROUPS) -> DataFrame:
    """``df`` with a gapless number from 0 in each shard.

    Distinct rows are numbered by their counts in groups dealt by a hash of ``order``; groups follow one
    another by running sums, so no task ever holds a shard.  Rows that are equal in ``order`` are counted by
    input partition, so those that repeat very often do not meet either.  The rows are written once, so
    that counts and numbers agree; which of two equal rows comes first is not determined.
    """
    dealt = storage.table(df.withColumn("_part", F.spark_partition_id()), "dealt")
    keys = [*dict.fromkeys([*order, shard]), "_part"]
    counts = dealt.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_group", F.pmod(F.xxhash64(*order), F.lit(groups)).cast("int"))
    inside = Window.partitionBy("_group", shard).orderBy(*order, "_part").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(shard).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    counts = storage.table(counts.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0))), "counts")
    starts = counts.groupBy("_group", shard).agg(F.sum("_n").alias("_n")).select("_group", shard, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = counts.join(starts, ["_group", shard]).select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keys)), (F.col("_start") + F.col("_before")).alias("_first"))
    numbered = dealt.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))) - 1)
    same = [numbered[k].eqNullSafe(placed[f"_{i}"]) for i, k in enumerate(keys)]
    joined = numbered.join(placed, functools.reduce(operator.and_, same))
    return joined.select(*df.columns, (F.col("_at") + F.col("_first")).cast("long").alias(name))


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: size, text_crc32, law, shard, slot, and the shard if there were one more."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = with_shards(with_shards(rows, id_col, shards), id_col, shards + 1, "grown_shard")
    slotted = with_slots(placed, "shard", [id_col, "text_crc32", "size"])
    return slotted.select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
