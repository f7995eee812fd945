"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of token streams.  In each round a queue's deficit grows by its target share
of a window; once it reaches a turn (``turn`` tokens, or what the queue has left) the queue gives whole
turns, and what it could not give is carried on to the next round.  Rounds follow one another without
gaps and are cut into windows of ``length`` tokens, so every window is full, holds each source in its
share but for a turn, and documents are cut into pieces of a useful length.  Queues start with
staggered deficits, so that small ones do not all have their turn in the same window.  A queue that
ends leaves its share to the others.

What a queue has given after r rounds is a closed form of r, its total and its share.  A document's
place therefore follows from its position in its queue, which partial sums over partitions give:
partitions need not wait for each other, yet deficits are carried across them.

Targets default to the sources' own shares, so that all queues end together.  Null texts are empty
and consist of the closing id; null sources are a queue of their own.  The ``OWN_QUEUES`` largest sources
and those with a target have a queue each; all others share ``POOLS`` queues by a hash of the source.  A
shared queue has the sum of its sources' shares and serves them in the order of partitions.  Repeated
rows are packed each.  Texts of any length are encoded in segments of a bounded size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellum.llm import storage, tokenise
from tessellum.llm.textcore import _ranges, bounded, chunks

LENGTH = 2048
#: Tokens of one queue's turn.
TURN = 256
OWN_QUEUES = 256
POOLS = 256
CLOSE = 1
#: Rounds that a queue may last; up to there a place is exact to the token.
MOST_ROUNDS = 2.0**40
#: Rows of (queue, task) offsets up to which they are broadcast, about 10 MB.
MOST_BASES = 200_000


class Service:
    """Deficit round-robin over queues of given totals, in closed form.

    ``targets``: weights of the queues, finite and not negative.  Those of weight 0 are served, by their totals,
    when all others have ended; so are those of a weight so small that they would last for more than
    ``MOST_ROUNDS`` rounds, which doubles could not count to a token.
    """

    def __init__(self, totals: np.ndarray, targets: np.ndarray | None = None, length: int = LENGTH, turn: int = TURN):
        self.totals = np.asarray(totals, np.int64)
        self.turn = turn
        n = len(self.totals)
        # The golden ratio's multiples are spread evenly over (0, 1) for any number of queues.
        self.ahead = (np.arange(1, n + 1) * 0.6180339887498949) % 1.0 * np.minimum(self.totals, turn)
        weights = self.totals.astype(float) if targets is None else np.asarray(targets, float)
        if not np.isfinite(weights).all() or (weights < 0).any():
            raise ValueError("targets are finite numbers that are not negative")
        self.begin, self.rate = np.zeros(n, np.int64), np.zeros(n)
        first = (weights > 0) & (self.totals > 0)
        weights = np.where(first, weights, 0.0)
        weights /= weights.max(initial=0) or 1.0
        rates = weights / (weights.sum() or 1.0) * length
        # A rate of zero is one too small for a double.
        first &= self.totals <= MOST_ROUNDS * rates
        later = ~first & (self.totals > 0)
        self._share(first, weights, length)
        self.begin[later] = int(self._round(np.flatnonzero(first), self.totals[first]).max(initial=0))
        self._share(later, self.totals.astype(float), length)

    def _share(self, part: np.ndarray, weights: np.ndarray, length: int) -> None:
        if part.any():
            self.rate[part] = weights[part] / weights[part].sum() * length

    def given(self, queue: np.ndarray, rounds: np.ndarray) -> np.ndarray:
        """Tokens that queues have given by the end of a round; rounds count from 1."""
        total = self.totals[queue]
        due = self.ahead[queue] + np.maximum(rounds - self.begin[queue], 0) * self.rate[queue]
        whole = (np.minimum(due, total) // self.turn).astype(np.int64) * self.turn
        return np.where(due >= total, total, whole)

    def _round(self, queue: np.ndarray, level: np.ndarray) -> np.ndarray:
        """The first round by which queues have given ``level`` tokens, a whole number of turns or all they hold."""
        guess = self.begin[queue] + np.ceil((level - self.ahead[queue]) / self.rate[queue]).astype(np.int64)
        # Rounding may put the guess off by one.
        for r in (guess + 1, guess, guess - 1):
            guess = np.where(self.given(queue, r) >= level, r, guess)
        return guess

    def pieces(self, queue: np.ndarray, begin: np.ndarray, size: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
        """Document, start, tokens, window and offset of each piece of documents that begin at positions of their queues."""
        first, last = begin // self.turn, (begin + size - 1) // self.turn
        times = last - first + 1
        doc = np.repeat(np.arange(len(queue)), times)
        turn = _ranges(first, times)
        own = queue[doc]
        rounds = self._round(own, np.minimum((turn + 1) * self.turn, self.totals[own]))
        low = np.maximum(turn * self.turn, begin[doc])
        high = np.minimum((turn + 1) * self.turn, (begin + size)[doc])
        place = low + self._others(own, rounds)
        # Pieces that meet are one; then windows cut.
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + (high - low)[:-1])
        at = np.flatnonzero(new)
        doc, start, place = doc[at], low[at], place[at]
        tokens = np.add.reduceat(high - low, at) if len(at) else np.zeros(0, np.int64)
        window = place // length
        parts = (place + tokens - 1) // length - window + 1
        piece = np.repeat(np.arange(len(doc)), parts)
        window = _ranges(window, parts)
        left = np.maximum(place[piece], window * length)
        right = np.minimum((place + tokens)[piece], (window + 1) * length)
        return doc[piece], start[piece] + left - place[piece] - begin[doc[piece]], right - left, window, left - window * length

    def _others(self, queue: np.ndarray, rounds: np.ndarray) -> np.ndarray:
        """What the other queues have given before a queue's turn in a round: those before it in this round too."""
        out = np.zeros(len(queue), np.int64)
        n = len(self.totals)
        step = max(1, (1 << 19) // max(1, n))
        every = np.arange(n)
        for a in range(0, len(queue), step):
            q, r = queue[a : a + step, None], rounds[a : a + step, None]
            given = self.given(np.broadcast_to(every, (len(q), n)), r - (every >= q))
            given[np.arange(len(q)), q[:, 0]] = 0
            out[a : a + step] = given.sum(1)
        return out


def _tokens(path: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        sums: dict[str, int] = {}
        coder = tokenise.encoder(path)
        for batch in chunks(batches, most=1 << 20):
            ids, sizes = coder.batch(batch.column("text"), CLOSE)
            before = []
            for q, n in zip(batch.column("queue").to_pylist(), sizes.tolist(), strict=True):
                before.append(sums.get(q, 0))
                sums[q] = before[-1] + n
            ends = np.concatenate([[0], np.cumsum(sizes)]) * ids.itemsize
            packed = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array([part] * batch.num_rows, pa.int32()), pa.array(before, pa.int64()), pa.array(sizes), packed], names=[*names, "part", "before", "n", "ids"])

    return run


def _place(shared, dtype: np.dtype, length: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        service, queues = shared.value
        width = np.dtype(dtype).itemsize
        for batch in chunks(batches, "ids", most=1 << 20):
            queue = np.array([queues[q] for q in batch.column("queue").to_pylist()], np.int64)
            begin = batch.column("before").to_numpy() + batch.column("base").to_numpy()
            n = batch.column("n").to_numpy()
            raw = batch.column("ids")
            first = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset]
            ids = np.frombuffer(raw.buffers()[2], dtype, int(n.sum()), int(first))
            doc, start, size, window, offset = service.pieces(queue, begin, n, length)
            wide = memoryview(ids.astype("<u4")).cast("B")
            at = (np.cumsum(n) - n)[doc] + start
            checks = [zlib.crc32(wide[a:b]) for a, b in zip((4 * at).tolist(), (4 * (at + size)).tolist(), strict=True)]
            columns = {"id": batch.column("id").take(pa.array(doc)), "start": pa.array(start), "length": pa.array(size), "ids_crc32": pa.array(checks, pa.int64()), "doc_tokens": pa.array(n[doc]), "sequence_id": pa.array(window), "offset": pa.array(offset)}
            if with_ids:
                blob = memoryview(ids).cast("B")
                columns["ids"] = pa.array([bytes(blob[a:b]) for a, b in zip((width * at).tolist(), (width * (at + size)).tolist(), strict=True)], pa.binary())
            yield pa.record_batch(list(columns.values()), names=list(columns))

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", targets: dict[str, float] | None = None, length: int = LENGTH, turn: int = TURN, with_ids: bool = True) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids themselves.

    ``targets``: shares by source, finite and not negative; a source without one comes last.
    """
    if any(not 0 <= v < float("inf") for v in (targets or {}).values()):
        raise ValueError("targets are finite numbers that are not negative")
    spark = docs.sparkSession
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-"))
    given = bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), source.alias("queue"))
    kind = given.schema["id"].dataType.simpleString()
    tokens = given.mapInArrow(_tokens(tokenizer, ["id", "queue"]), f"id {kind}, queue string, part int, before long, n long, ids binary")
    tokens = storage.table(tokens, "tokens", "snappy")  # ids hardly compress
    sums = storage.table(tokens.groupBy("queue", "part").agg(F.sum("n").alias("sum")), "sums")
    largest = sums.groupBy("queue").agg(F.sum("sum").alias("sum")).orderBy(F.desc("sum"), "queue").limit(OWN_QUEUES)
    own = {r["queue"] for r in largest.collect()} | {f"={k}" for k, v in (targets or {}).items() if v > 0}
    pool = F.concat(F.lit("#"), F.pmod(F.xxhash64("queue"), F.lit(POOLS)).cast("string"))
    sums = sums.withColumn("pool", F.when(F.col("queue").isin(own), F.col("queue")).otherwise(pool))
    ahead = Window.partitionBy("pool").orderBy("part", "queue").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("queue", "part", "pool", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("base"))
    totals = {r["pool"]: r["sum"] for r in sums.groupBy("pool").agg(F.sum("sum").alias("sum")).collect()}
    names = sorted(totals)
    # Shared queues hold no source with a target.
    wanted = None if targets is None else np.array([0.0 if q.startswith("#") else targets.get(q[1:], 0.0) for q in names])
    service = Service(np.array([totals[q] for q in names], np.int64), wanted, length, turn)
    shared = spark.sparkContext.broadcast((service, {q: i for i, q in enumerate(names)}))
    # One row for each source of each scan task; broadcast while that is little.
    bases = storage.table(bases, "bases")
    if bases.count() <= MOST_BASES:
        bases = F.broadcast(bases)
    placed = tokens.join(bases, ["queue", "part"]).select("id", F.col("pool").alias("queue"), "before", "base", "n", "ids")
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    dtype = tokenise.encoder(tokenizer).dtype
    return placed.mapInArrow(_place(shared, dtype, length, with_ids), schema).withColumnRenamed("id", id_col)


def public_vocabulary() -> str:
    """The path of the 50k byte-level vocabulary; the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digests(docs: DataFrame, tokenizer: str | None = None, **options) -> DataFrame:
    """:func:`pack` without the ids."""
    return pack(docs, tokenizer or public_vocabulary(), with_ids=False, **options)
