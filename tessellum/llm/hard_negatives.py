"""Hard negatives by bit-sliced integer products.

Components are whole numbers, stored as bit-planes: for each place value and dimension the bits of all
vectors of a piece.  A piece is worked through from the sign plane and the highest place down.  After
each plane a score lies in an interval: what is known, plus all that the places below can add or take.
Pairs whose interval cannot qualify any more are dropped; while most pairs are alive a plane is one
matrix product, later it is taken for the living pairs alone.

* Positives of an anchor are the best rows of its label, so an interval qualifies while its upper end
  reaches the k-th best lower end.
* A negative has to lie in the window of a positive, from ``percent`` of its score to its score.  An
  interval qualifies while it meets a window and its upper end reaches the k-th best lower end of
  those that are inside the window for certain.

Vectors are ranged by dimension, label and a hash and cut into pieces of one label, anchors into
blocks likewise, so a label of any size is spread.  Blocks meet pieces of their own label for
positives and of the others for negatives: a stated set of anchors against all rows, in blocks.  A
piece travels as one row; nothing is broadcast or collected.

Rows without an id, a label or a vector, or with a null or non-finite component, take no part; vectors
meet those of their own dimension.  Ties go to the smaller id.  Every row is an anchor or a candidate of
its own, also where rows repeat an id: an anchor is compared with all rows but itself.  Where products
may leave the whole numbers that a double holds, scores are made from Python's integers without
slicing, and clipped to 64 bits.  A vector without components scores 0.  Empty tables give no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.llm import storage
from tessellum.llm.topk import _exact

#: Vectors in a piece, and anchors in a block: with 64 dimensions 2 MB of bits, and 2 MB of numbers.
PIECE = 16_384
BLOCK = 4096
#: Pairs that are handled at once.
_PAIRS = 1 << 20
#: Below this share of living pairs, planes are taken for them alone.
_SPARSE = 0.125
_PIECES = "dims int, label long, piece long, bits int, ids binary, rows binary, planes binary"
_BLOCKS = "dims int, label long, block long, anchors binary, values binary, lows binary, highs binary"
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, label: Column, scale: int) -> DataFrame:
    """(row, vec_id, label, dims, v): usable vectors as whole numbers floor(scale * x), rows numbered once written."""
    inf = F.lit(float("inf"))
    named = df.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(vec_col, lambda x: x.cast("double")).alias("x"))
    usable = named.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull())
    usable = usable.where(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)))
    whole = usable.select("vec_id", "label", F.size("x").alias("dims"), F.transform("x", lambda x: _floored(x * scale)).alias("v"))
    return storage.table(whole.withColumn("row", F.monotonically_increasing_id()), "vectors")


def _floored(x: Column) -> Column:
    # Doubles from 2**52 on are whole, and may be beyond 64 bits.
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


def bit_planes(x: np.ndarray) -> tuple[int, bytes]:
    """The number of two's complement planes of (n, d) whole numbers, and their bits, lowest place first.

    A plane holds the n bits of each dimension one after another.  No planes, but the values themselves,
    where they do not fit into 62 bits.
    """
    if not x.size:
        return 1, b""
    low, high = float(x.min()), float(x.max())
    if max(-low, high) >= float(1 << 61):
        return 0, np.ascontiguousarray(x).tobytes()
    whole = x.astype(np.int64)
    bits = 1 + max(int(-low - 1 if low < 0 else 0).bit_length(), int(max(high, 0)).bit_length())
    return bits, b"".join(np.packbits((whole.T >> b) & 1, axis=1).tobytes() for b in range(bits))


class Planes:
    """The planes of a piece: :meth:`plane` unpacks one, :meth:`values` puts all together."""

    def __init__(self, raw: bytes, bits: int, n: int, dims: int):
        self.bits, self.n, self.dims = bits, n, dims
        self.wide = bits == 0
        if self.wide:
            self.raw = np.frombuffer(raw, float).reshape(n, dims)
        else:
            self.raw = np.frombuffer(raw, np.uint8).reshape(bits, dims, -1) if dims and n else np.zeros((bits, dims, 0), np.uint8)

    def plane(self, b: int) -> np.ndarray:
        """(d, n) bits of place b."""
        return np.unpackbits(self.raw[b], axis=1, count=self.n)

    def weight(self, b: int) -> int:
        return -(1 << b) if b == self.bits - 1 else 1 << b

    def values(self) -> np.ndarray:
        if self.wide:
            return self.raw
        out = np.zeros((self.dims, self.n), np.int64)
        for b in range(self.bits):
            out += self.weight(b) * self.plane(b).astype(np.int64)
        return out.T.astype(float)


def _kth(values: np.ndarray, inside: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row's inside values; minus infinity where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(np.where(inside, values, -np.inf), values.shape[1] - k, axis=1)[:, -k]


def _kth_of(group: np.ndarray, values: np.ndarray, groups: int, k: int) -> np.ndarray:
    """The same for values of ascending groups in one list."""
    order = np.lexsort((-values, group))
    sizes = np.bincount(group, minlength=groups)
    at = np.cumsum(sizes) - sizes + k - 1
    out = np.full(groups, -np.inf)
    full = sizes >= k
    out[full] = values[order[at[full]]]
    return out


def refine(a: np.ndarray, planes: Planes, able: np.ndarray, lows: np.ndarray, highs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, candidate, score) of all pairs that can be among the k best of a window of an anchor.

    ``a`` are whole numbers (m, d), ``able`` says which of the (m, n) pairs count, ``lows`` and ``highs``
    (m, w) bound each anchor's windows.
    """
    up, down = np.maximum(a, 0).sum(1), np.minimum(a, 0).sum(1)
    exact32 = float(np.abs(a).sum(1).max(initial=0)) < float(1 << 24)
    own = a.astype(np.float32 if exact32 else float)
    known, live = np.zeros(able.shape), able.copy()
    i = j = score = None
    for b in range(planes.bits - 1, -1, -1):
        bits, weight, rest = planes.plane(b), planes.weight(b), float((1 << b) - 1)
        if i is None:
            known += weight * (own @ bits.astype(own.dtype)).astype(float)
            low, high = known + rest * down[:, None], known + rest * up[:, None]
            still = np.zeros_like(live)
            for w in range(lows.shape[1]):
                floor, roof = lows[:, w, None], highs[:, w, None]
                sure = live & (low >= floor) & (high <= roof)
                need = np.maximum(floor, _kth(low, sure, k)[:, None])
                still |= live & (high >= need) & (low <= roof)
            live = still
            if live.mean() < _SPARSE:
                i, j = np.nonzero(live)
                score = known[i, j]
                del known, live
        else:
            by_row = np.ascontiguousarray(bits.T)
            for first in range(0, len(i), 1 << 16):
                part = slice(first, first + (1 << 16))
                score[part] += weight * np.einsum("pd,pd->p", own[i[part]].astype(float), by_row[j[part]])
            low, high = score + rest * down[i], score + rest * up[i]
            still = np.zeros(len(i), bool)
            for w in range(lows.shape[1]):
                floor, roof = lows[i, w], highs[i, w]
                sure = (low >= floor) & (high <= roof)
                need = np.maximum(floor, _kth_of(i[sure], low[sure], len(a), k)[i])
                still |= (high >= need) & (low <= roof)
            i, j, score = i[still], j[still], score[still]
    if i is None:
        i, j = np.nonzero(live)
        score = known[i, j]
    return i, j, score.astype(np.int64)


def _best(i: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each anchor: by descending score, then ascending id."""
    order = np.lexsort((ids, ~score, i))
    group = i[order]
    begin = np.flatnonzero(np.diff(group, prepend=-1))
    rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    return order[rank < k]


def _meet(k: int, same: bool):
    """Per pair of a block and a piece: the k best candidates of each window of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                d = r["dims"]
                anchors, ids, rows = (np.frombuffer(r[c], np.int64) for c in ("anchors", "ids", "rows"))
                values = np.frombuffer(r["values"], float).reshape(len(anchors), d)
                lows, highs = (np.frombuffer(r[c], np.int64).reshape(len(anchors), -1) for c in ("lows", "highs"))
                planes = Planes(r["planes"], r["bits"], len(ids), d)
                reach = float(np.abs(values).sum(1).max(initial=0)) * 2.0**planes.bits
                sliced = not planes.wide and reach < float(1 << 53)
                whole = None if sliced else planes.values()
                step = max(1, _PAIRS // max(1, len(ids)))
                for first in range(0, len(anchors), step):
                    part = slice(first, first + step)
                    a, own = values[part], anchors[part]
                    able = rows[None, :] != own[:, None] if same else np.ones((len(a), len(ids)), bool)
                    if sliced:
                        i, j, score = refine(a, planes, able, lows[part].astype(float), highs[part].astype(float), k)
                    else:
                        i, j = np.nonzero(able)
                        score = _exact(whole, a).T[i, j]
                    for w in range(lows.shape[1]):
                        inside = np.flatnonzero((score >= lows[part][i, w]) & (score <= highs[part][i, w]))
                        top = inside[_best(i[inside], ids[j[inside]], score[inside], k)]
                        if len(top):
                            yield pa.record_batch([pa.array(own[i[top]]), pa.array(np.full(len(top), w, np.int32)), pa.array(ids[j[top]]), pa.array(score[top])], names=["anchor", "slot", "found", "score"])

    return run


def _cut(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    """Runs of at most ``most`` sorted rows of one dimension and label, with their columns."""

    def joined(held: list[pa.RecordBatch]) -> tuple[int, int, dict[str, np.ndarray]]:
        table = pa.Table.from_batches(held).combine_chunks()
        d, n = table.column("dims")[0].as_py(), table.num_rows
        columns = {c: table.column(c).to_numpy() for c in ("row", "vec_id")}
        for c in ("v", "lows", "highs"):
            if c in table.column_names:
                columns[c] = table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1 if n and c != "v" else d)
        return d, table.column("label")[0].as_py(), columns

    held, count, key = [], 0, None
    for batch in batches:
        dims, label = batch.column("dims").to_numpy(), batch.column("label").to_numpy()
        edges = np.flatnonzero(np.diff(dims, prepend=-1).astype(bool) | np.append(True, label[1:] != label[:-1]))[: batch.num_rows]
        for i, j in zip(edges, np.append(edges[1:], batch.num_rows), strict=True):
            if held and key != (dims[i], label[i]):
                yield joined(held)
                held, count = [], 0
            key = (dims[i], label[i])
            while i < j:
                take = min(j - i, most - count)
                held.append(batch.slice(i, take))
                count, i = count + take, i + take
                if count == most:
                    yield joined(held)
                    held, count = [], 0
    if held:
        yield joined(held)


def _pieces(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for d, label, c in _cut(batches, most):
            bits, planes = bit_planes(c["v"])
            yield pa.RecordBatch.from_pylist([{"dims": d, "label": label, "piece": number, "bits": bits, "ids": c["vec_id"].tobytes(), "rows": c["row"].tobytes(), "planes": planes}], pa.schema([("dims", pa.int32()), ("label", pa.int64()), ("piece", pa.int64()), ("bits", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary()), ("planes", pa.binary())]))
            number += 1

    return run


def _blocks(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for d, label, c in _cut(batches, most):
            yield pa.RecordBatch.from_pylist([{"dims": d, "label": label, "block": number, "anchors": c["row"].tobytes(), "values": c["v"].tobytes(), "lows": c["lows"].tobytes(), "highs": c["highs"].tobytes()}], pa.schema([("dims", pa.int32()), ("label", pa.int64()), ("block", pa.int64()), ("anchors", pa.binary()), ("values", pa.binary()), ("lows", pa.binary()), ("highs", pa.binary())]))
            number += 1

    return run


def _ranged(rows: DataFrame, size: int, count: int) -> DataFrame:
    """Rows in ranges of dimension, label and a hash, each range sorted; about ``size`` rows in each."""
    parts = max(1, -(-count // size))
    by = ["dims", "label", F.xxhash64("row")]
    return (rows.repartitionByRange(parts, *by) if parts > 1 else rows.coalesce(1)).sortWithinPartitions("dims", "label")


def _scores(blocks: DataFrame, pieces: DataFrame, k: int, same: bool) -> DataFrame:
    """(anchor, slot, found, score): the k best of each window in each piece that its block meets."""
    numbers, others = blocks.select("block", "dims", "label"), pieces.select("piece", "dims", F.col("label").alias("other"))
    alike = F.col("label") == F.col("other") if same else F.col("label") != F.col("other")
    met = numbers.join(others.withColumnRenamed("dims", "other_dims"), (F.col("dims") == F.col("other_dims")) & alike).select("block", "piece")
    # A block is copied for each piece; a piece stays where it is.
    paired = met.join(blocks.drop("dims", "label"), "block").join(pieces, "piece")
    wanted = ["dims", "bits", "ids", "rows", "planes", "anchors", "values", "lows", "highs"]
    return paired.select(*wanted).mapInArrow(_meet(k, same), "anchor long, slot int, found long, score long")


def mine(df: DataFrame, label: Column, positives: int = 5, negatives: int = 5, every: int = 100, percent: int = 80, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, piece: int = PIECE, block: int = BLOCK) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by ``every``.

    For each of an anchor's ``positives`` best rows of its label, the ``negatives`` best rows of other labels
    whose score is at most the positive's and at least ``percent`` percent of it: anchor_id, positive_id,
    rank, negative_id, positive_score, negative_score.
    """
    vectors = whole_vectors(df, id_col, vec_col, label, scale)
    asked = F.pmod("vec_id", F.lit(every)) == 0
    counts = vectors.agg(F.count("*").alias("all"), F.count_if(asked).alias("asked")).first()
    cut = storage.table(_ranged(vectors, piece, counts["all"]).mapInArrow(_pieces(piece), _PIECES), "pieces")

    anchors = vectors.where(asked)
    whole = anchors.select("*", F.array(F.lit(_LEAST)).alias("lows"), F.array(F.lit(_MOST)).alias("highs"))
    blocks = storage.table(_ranged(whole, block, counts["asked"]).mapInArrow(_blocks(block), _BLOCKS), "anchors")
    ranked = Window.partitionBy("anchor").orderBy(F.desc("score"), "found")
    best = _scores(blocks, cut, positives, True).withColumn("slot", F.row_number().over(ranked) - 1).where(F.col("slot") < positives)
    best = storage.table(best, "positives")

    # The least whole number that is at least percent / 100 of a score, in numbers wide enough for the product.
    least = F.ceil(F.col("score").cast("decimal(20,0)") * percent / F.lit(100).cast("decimal(3,0)")).cast("long")
    windows = best.select("anchor", "slot", "score", least.alias("low"))
    spans = windows.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct("low", "score")))).alias("by_slot"))
    places = F.sequence(F.lit(0), F.lit(positives - 1))
    # A place without a positive has an empty window.
    lows = F.transform(places, lambda s: F.coalesce(F.col("by_slot")[s]["low"], F.lit(_MOST)))
    highs = F.transform(places, lambda s: F.coalesce(F.col("by_slot")[s]["score"], F.lit(_LEAST)))
    bounded = anchors.join(spans.withColumnRenamed("anchor", "row"), "row").select("row", "vec_id", "label", "dims", "v", lows.alias("lows"), highs.alias("highs"))
    blocks = storage.table(_ranged(bounded, block, counts["asked"]).mapInArrow(_blocks(block), _BLOCKS), "windows")
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "found")
    found = _scores(blocks, cut, negatives, False).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = best.select("anchor", "slot", F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    who = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    told = found.select("anchor", "slot", "rank", F.col("found").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["anchor", "slot"]).join(who, "anchor")
    return told.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
