"""Exact top-k inner products, pruned by norms and by Cauchy-Schwarz bounds in a rotated space.

Vectors are met by descending length.  The longest ones, ``HEAD`` of them, are scored first and give each
query a threshold; divided by the query's own length it is the length that a vector needs to matter.
Queries are ranged by that need into blocks of ``query_block``, vectors dealt into shards of ``SHARD``
rows, and a vector meets only the blocks whose least need it reaches.  Each pair of a block and a shard
is one task's work: it walks its vectors by descending length until no query's threshold can be
reached; before that, the inner product over the leading directions of a singular value decomposition
plus the product of the residual lengths bounds the score, and only pairs that pass are scored in whole
integers.

Nothing that grows with the data is collected or broadcast but a row for each block of queries.
Vectors that are null, or hold null or non-finite components, and rows without an id take no part.
A query is compared with vectors of its own dimension under other ids; ties go to the smaller id.
A repeated row is a candidate of its own; a repeated query id is asked once, with its least vector.
Scores beyond 64 bits are clipped to them.  The directions come from the longest vectors; they decide
how much is pruned, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellum.llm import storage

#: Queries in a block: with 64 dimensions 4 MB of numbers.
QUERY_BLOCK = 8192
#: Vectors in a shard: with 64 dimensions 8 MB.
SHARD = 16_384
HEAD = 2048
STEP = 1024
_OUT = "query_id long, vec_id long, score long"


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int = 1024) -> DataFrame:
    """(vec_id, v, length2): usable vectors as whole numbers floor(scale * x)."""
    inf = F.lit(float("inf"))
    usable = df.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda x: x.cast("double")).alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull())
    usable = usable.where(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)))
    whole = usable.select("vec_id", F.transform("x", lambda x: F.floor(x * scale).cast("double")).alias("v"))
    return whole.withColumn("length2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))


def _exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows, clipped to 64 bits."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    if most < 2**53:
        return (x @ q.T).astype(np.int64)
    whole = np.array([[int(c) for c in r] for r in x], object).reshape(x.shape)
    other = np.array([[int(c) for c in r] for r in q], object).reshape(q.shape)
    return np.clip(whole @ other.T, -(2**63), 2**63 - 1).astype(np.int64)


class _Best:
    """The k best (score, smaller id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, 0), 0, np.int64)
        self.ids = np.full((n, 0), 0, np.int64)
        self.valid = np.zeros((n, 0), bool)

    def add(self, ids: np.ndarray, scores: np.ndarray, valid: np.ndarray) -> None:
        """Scores of the same new vectors for all queries; not valid: pruned, or the query itself."""
        score = np.concatenate([self.score, scores], 1)
        every = np.concatenate([self.ids, np.broadcast_to(ids, scores.shape)], 1)
        ok = np.concatenate([self.valid, valid], 1)
        if score.shape[1] > 4 * self.k and valid.shape[1]:
            # A cheap cut first: whatever is under the k-th best score cannot stay.
            low = np.where(ok, score, np.iinfo(np.int64).min)
            kth = np.partition(low, score.shape[1] - self.k, 1)[:, -self.k]
            keep = ok & (score >= kth[:, None])
            width = int(keep.sum(1).max(initial=0))
            order = np.argsort(~keep, axis=1, kind="stable")[:, :width]
            score, every, ok = (np.take_along_axis(a, order, 1) for a in (score, every, keep))
        order = np.lexsort((every, ~np.where(ok, score, -(2**62)), ~ok), axis=1)[:, : self.k]
        self.score, self.ids, self.valid = (np.take_along_axis(a, order, 1) for a in (score, every, ok))

    def floor(self) -> np.ndarray:
        """What a new score must reach; minus infinity while fewer than k are known."""
        full = self.valid.all(1) if self.score.shape[1] == self.k else np.zeros(len(self.score), bool)
        return np.where(full, self.score[:, -1].astype(float) if self.score.shape[1] else 0.0, -np.inf)


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of a list column of doubles."""
    at = column.offsets.to_numpy(zero_copy_only=False)
    return column.values.to_numpy(zero_copy_only=False), at


def _search(best: _Best, ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, rotation: np.ndarray, lead: int, floor: np.ndarray) -> None:
    """Walk rows by descending length and keep each query's best.  ``floor`` holds earlier thresholds."""
    length = np.sqrt((x * x).sum(1))
    order = np.argsort(-length, kind="stable")
    q_length = np.sqrt((q * q).sum(1))
    turned = q @ rotation
    rest_q = np.sqrt(np.maximum((turned[:, lead:] ** 2).sum(1), 0))
    for first in range(0, len(order), STEP):
        part = order[first : first + STEP]
        need = np.maximum(best.floor(), floor)
        reach = length[part[0]] * q_length * (1 + 1e-9) + 1
        live = np.flatnonzero(reach >= need)
        if not len(live):
            break
        rows = x[part]
        moved = rows @ rotation
        rest = np.sqrt(np.maximum((moved[:, lead:] ** 2).sum(1), 0))
        bound = turned[live, :lead] @ moved[:, :lead].T + rest_q[live, None] * rest
        slack = 1e-9 * q_length[live, None] * length[part] + 1
        able = (bound + slack >= need[live, None]) & (ids[part] != q_ids[live, None])
        cols = np.flatnonzero(able.any(0))
        hit = able.any(1)
        if not len(cols):
            continue
        live, able = live[hit], able[hit][:, cols]
        scores = _exact(rows[cols], q[live]).T
        sub = _Best(len(live), best.k)
        sub.score, sub.ids, sub.valid = best.score[live], best.ids[live], best.valid[live]
        sub.add(ids[part][cols], scores, able & (scores >= np.where(np.isfinite(need[live]), need[live], -np.inf)[:, None]))
        if sub.score.shape[1] > best.score.shape[1]:
            grow = ((0, 0), (0, sub.score.shape[1] - best.score.shape[1]))
            best.score, best.ids, best.valid = (np.pad(a, grow) for a in (best.score, best.ids, best.valid))
        pad = ((0, 0), (0, best.score.shape[1] - sub.score.shape[1]))
        best.score[live], best.ids[live], best.valid[live] = (np.pad(a, pad) for a in (sub.score, sub.ids, sub.valid))


def _rotation(x: np.ndarray, dims: int) -> np.ndarray:
    """Directions of descending variance, as an orthogonal matrix."""
    if not len(x):
        return np.eye(dims)
    return np.linalg.svd(x.T @ x)[0]


def _rows(table: pa.Table | pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors by dimension."""
    column = table.column("v")
    values, at = _matrix(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    sizes = np.diff(at)
    return {int(d): (rows := np.flatnonzero(sizes == d), values[at[rows][:, None] + np.arange(d)]) for d in np.unique(sizes)}


def _floors(shared, k: int, lead: int):
    """Thresholds of queries from the longest vectors, and the length that reaches them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = shared.value
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            floor = np.full(len(ids), -np.inf)
            length = np.ones(len(ids))
            for d, (rows, q) in _rows(batch).items():
                length[rows] = np.sqrt((q * q).sum(1))
                if d in heads:
                    near_ids, x, rotation = heads[d]
                    best = _Best(len(rows), k)
                    _search(best, near_ids, x, ids[rows], q, rotation, min(lead, d), floor[rows])
                    floor[rows] = best.floor()
            # A query without length scores 0 with all; every vector may matter to it.
            need = np.where(length > 0, (floor - 1) / np.maximum(length, 1e-300) / (1 + 1e-9), -np.inf)
            yield pa.record_batch([*batch.columns, pa.array(floor), pa.array(need)], names=[*batch.schema.names, "floor", "need"])

    return run


def _meet(shared, k: int, lead: int):
    """The best of a shard for a block of queries."""

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        heads = shared.value
        q_ids, floors, ids = queries.column("vec_id").to_numpy(), queries.column("floor").to_numpy(), vectors.column("vec_id").to_numpy()
        asked, met = _rows(queries), _rows(vectors)
        found = [np.zeros((3, 0), np.int64)]
        for d in asked.keys() & met.keys():
            (own, q), (rows, x) = asked[d], met[d]
            best = _Best(len(own), k)
            _search(best, ids[rows], x, q_ids[own], q, heads[d][2] if d in heads else np.eye(d), min(lead, d), floors[own])
            at, cols = np.nonzero(best.valid)
            found.append(np.stack([q_ids[own][at], best.ids[at, cols], best.score[at, cols]]))
        return pa.table(list(np.concatenate(found, 1)), names=["query_id", "vec_id", "score"])

    return run


def top_k(df: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, lead: int = 16, query_block: int = QUERY_BLOCK, shard: int = SHARD) -> DataFrame:
    """The k best other rows for each row whose id is divisible by ``every``: query_id, rank, vec_id, score."""
    spark = df.sparkSession
    vectors = quantised(df, id_col, vec_col, scale)
    asked = F.pmod("vec_id", F.lit(every)) == 0
    counts = vectors.agg(F.count("*").alias("all"), F.count_if(asked).alias("asked")).first()
    shards, blocks = max(1, -(-counts["all"] // shard)), max(1, -(-counts["asked"] // query_block))
    head = vectors.orderBy(F.desc("length2"), "vec_id").limit(HEAD).select("vec_id", "v").toPandas()
    heads = {}
    for d in sorted({len(v) for v in head["v"]}):
        near = head[head["v"].map(len) == d]
        x = np.stack(near["v"].to_list()).astype(float)
        heads[d] = (near["vec_id"].to_numpy(np.int64), x, _rotation(x, d))
    shared = spark.sparkContext.broadcast(heads)

    queries = vectors.where(asked).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = queries.mapInArrow(_floors(shared, k, lead), "vec_id long, v array<double>, floor double, need double")
    queries = queries.withColumn("dims", F.size("v"))
    if blocks > 1:
        queries = queries.repartitionByRange(blocks, "dims", "need", F.xxhash64("vec_id"))
    queries = storage.table(queries.withColumn("block", F.spark_partition_id() if blocks > 1 else F.lit(0)), "queries")
    needs = queries.groupBy(F.col("block").alias("for_block"), F.col("dims").alias("for_dims")).agg(F.min("need").alias("need"))
    dealt = vectors.select("vec_id", "v", F.size("v").alias("dims"), F.sqrt("length2").alias("length"), F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(shards)).cast("int").alias("shard"))
    # One row for each block of queries: 8 bytes for 8192 vectors.
    met = dealt.join(F.broadcast(needs), (F.col("dims") == F.col("for_dims")) & (F.col("length") >= F.col("need"))).select("for_block", "shard", "vec_id", "v")
    asking = queries.select("block", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("for_shard"), "vec_id", "v", "floor")
    found = asking.groupBy("block", "for_shard").cogroup(met.groupBy("for_block", "shard")).applyInArrow(_meet(shared, k, lead), _OUT)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
