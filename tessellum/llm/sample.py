"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import pickle
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of one text that a training sample takes; of a longer text it takes one stretch of so many,
#: whose place follows from a hash.  All texts are scored whole.
PIECE_CHARS = 16 << 10


def fold(id_col: str, parts: int):
    """crc32 of the id as text modulo ``parts``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(parts))


def _share(able: DataFrame, key: str, bound: int, total: int | None = None) -> DataFrame | None:
    """About ``bound`` rows of each label, by a hash of ``key``, and about ``total`` in all; None without labels.

    The rows are counted by label first; the share that is taken follows from the counts, so no task
    gathers a label's rows.
    """
    counts = {r["label"]: r["count"] for r in able.groupBy("label").count().collect()}
    if not counts:
        return None
    if total is not None:
        bound = min(bound, max(1, total // len(counts)))
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.2 * bound / n))))
    place = F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    return able.withColumn("place", place).where(F.col("place") < share[F.col("label")])


def _piece(text_col: str):
    """A text, or its stretch of ``PIECE_CHARS`` characters."""
    text = F.col(text_col)
    start = F.pmod(F.xxhash64(text, F.lit(11)), F.greatest(F.length(text) - PIECE_CHARS, F.lit(1)).cast("long")).cast("int") + 1
    return F.when(F.length(text) <= PIECE_CHARS, text).otherwise(F.substring(text, start, F.lit(PIECE_CHARS)))


def by_label(rows: DataFrame, label: str, bound: int, text_col: str = "text", total: int | None = None) -> DataFrame | None:
    """About ``bound`` (text, label, place) of each label, and about ``total`` in all.  Copies of a text are taken or left together."""
    able = rows.where(F.col(label).isNotNull() & F.col(text_col).isNotNull()).select(_piece(text_col).alias("text"), F.col(label).alias("label"))
    return _share(able, "text", bound, total)


def by_labelled_id(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label: str, bound: int) -> DataFrame | None:
    """About ``bound`` (text, label, place) of each label, where labels are a table of their own.

    Ids are drawn from the labels first; these few, at most 1.5 * bound a label, are then looked up
    in the documents by a broadcast, so no text is shuffled for it.
    """
    able = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label).alias("label"))
    drawn = _share(able, "_id", bound)
    if drawn is None:
        return None
    kinds = able.select("label").distinct().count()
    few = F.broadcast(drawn.limit(3 * bound * kinds // 2))
    own = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_own"), _piece(text_col).alias("text"))
    return own.join(few, F.col("_own") == F.col("_id")).select("text", "label", "place")


def fit_once(rows: DataFrame | None, bound: int, fit):
    """``fit`` of at most ``bound`` (text, label) pairs of each label, run in one task of an executor.

    The sample is of bounded size; only the fitted model comes to the driver.
    """
    if rows is None:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = sorted((place, text, label) for b in batches for text, label, place in zip(*(b.column(c).to_pylist() for c in ("text", "label", "place")), strict=True))
        out, seen, used = [], set(), Counter()
        for _, text, label in taken:
            if text not in seen and used[label] < bound:
                seen.add(text)
                used[label] += 1
                out.append((text, label))
        model = pickle.dumps(fit(out))
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)  # the worker is used again
        yield pa.record_batch([pa.array([model], pa.binary())], names=["model"])

    return pickle.loads(rows.repartition(1).mapInArrow(run, "model binary").first()["model"])
