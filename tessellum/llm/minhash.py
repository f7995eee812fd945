"""Near duplicates by circulant MinHash, banding and exact verification.

1. *Signatures.*  Two permutations of the 32-bit universe of n-gram hashes make all coordinates: the
   first scatters the set once, the second is shifted circularly, coordinate k being the least
   ``second(first(x) + k mod 2**32)`` of the set.
2. *Bands.*  48 bands of four coordinates.  Two sets of similarity 0.8 share no band with a
   probability of 1e-11, of 0.9 with 6e-23.  Equal sets are one class beforehand.
3. *Candidates.*  In each bucket all classes are compared with one leader, the one that shares buckets
   with most others, which unites large families at linear cost.  What is left in buckets of several
   components, such as strongly edited copies of one text, no two of which reach the threshold, would meet
   in pairs by the thousand; there a band is not enough, and two classes of different components have to
   share one of their rarest n-grams too, as sets at the threshold must.  Nothing is capped.
4. *Verification.*  A pair whose signatures agree in less than 49 of 96 coordinates is dropped, which
   a pair at the threshold does with a probability under 1e-10; all others are decided by the exact
   intersection of their whole sets.

Nulls and texts without words have an empty set and are linked with nothing; a text of fewer words
than an n-gram is one n-gram.  Repeated rows and copies get the component of their class; rows
without an id link others too and get the least id of theirs, or null.  Ties do not arise: components
depend on links alone.  A text of any length is one set, held by one task about ten times over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.llm import storage
from tessellum.llm.ngram_join import _prints, components, document_shingles, least
from tessellum.llm.textcore import Words, bounded, chunks, mix

BANDS, ROWS = 48, 4
#: Coordinates that are kept of a signature, and how many of two have to agree before whole sets are compared.
KEPT, AGREE = 96, 49
#: N-grams that are hashed at once: their buffers stay in a core's cache.
_BLOCK = 1 << 14
_SIGNED = "row_id binary, text_key long, n_shingles long, print_a long, print_b long, keys binary, marks binary"


def permute(x: np.ndarray, scratch: np.ndarray, key: int) -> np.ndarray:
    """A permutation of 32-bit values, in place."""
    x ^= np.uint32(key)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        np.right_shift(x, np.uint32(shift), out=scratch)
        x ^= scratch
        x *= np.uint32(factor)
    np.right_shift(x, np.uint32(16), out=scratch)
    x ^= scratch
    return x


def signatures(docs: np.ndarray, grams: np.ndarray, n: int, coordinates: int) -> np.ndarray:
    """(n, coordinates) 32-bit minima of each document's set; all ones for an empty set."""
    order = np.argsort(docs, kind="stable")
    docs, x = docs[order], (grams[order] ^ (grams[order] >> np.uint64(32))).astype(np.uint32)
    permute(x, np.empty_like(x), 0x3C6EF372)
    out = np.full((n, coordinates), 0xFFFFFFFF, np.uint32)
    y, scratch = np.empty(_BLOCK, np.uint32), np.empty(_BLOCK, np.uint32)
    for i in range(0, len(x), _BLOCK):
        part, own = x[i : i + _BLOCK], docs[i : i + _BLOCK]
        begin = np.flatnonzero(np.diff(own, prepend=-1))
        least = np.empty((coordinates, len(begin)), np.uint32)
        v, s = y[: len(part)], scratch[: len(part)]
        for k in range(coordinates):
            np.add(part, np.uint32(k), out=v)
            permute(v, s, 0x1B873593)
            np.minimum.reduceat(v, begin, out=least[k])
        out[own[begin]] = np.minimum(out[own[begin]], least.T)
    return out


def band_keys(signed: np.ndarray, rows: int) -> np.ndarray:
    """(n, bands) 64-bit keys of runs of ``rows`` coordinates; the band's number is part of its key."""
    n, coordinates = signed.shape
    cut = signed.reshape(n, coordinates // rows, rows).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, coordinates // rows + 1, dtype=np.uint64), cut.shape[:2]).copy()
    for k in range(rows):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + cut[:, :, k])
    return out


def _sign(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            n = batch.num_rows
            docs, grams = document_shingles(Words(batch.column("text")), size)
            a, b = _prints(docs, grams, n)
            signed = signatures(docs, grams, n, bands * rows)
            keys, marks = band_keys(signed, rows), signed[:, :KEPT].astype(np.uint8)
            blobs = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (keys, marks)]
            numbers = [pa.array(x.astype(np.int64)) for x in (np.bincount(docs, minlength=n), a, b)]
            yield pa.record_batch([batch.column("row_id").cast(pa.binary()), batch.column("text_key"), *numbers, *blobs], names=[c.split()[0] for c in _SIGNED.split(", ")])

    return run


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each band of each class."""
    for batch in batches:
        for first in range(0, batch.num_rows, 4096):
            part = batch.slice(first, 4096)
            keys = [np.frombuffer(k, np.int64) for k in part.column("keys").to_pylist()]
            sizes = [len(k) for k in keys]
            node, n = (np.repeat(part.column(c).to_numpy(), sizes) for c in ("node", "n"))
            yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(node), pa.array(n)], names=["key", "node", "n"])


def _agreeing(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("marks_a", "marks_b"))
                kept = batch.filter(pa.array((x == y).sum(1) >= least))
                yield kept.select(["a", "b", "n_a", "n_b"])

    return run


def _sets(size: int):
    """Whole sets of the classes' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=1 << 20):
            docs, grams = document_shingles(Words(batch.column("text")), size)
            a, b = _prints(docs, grams, batch.num_rows)
            # Another text of the same id is left out.
            right = np.flatnonzero((a == np.asarray(batch.column("print_a"))) & (b == np.asarray(batch.column("print_b"))))
            order = np.argsort(docs, kind="stable")
            ends = np.cumsum(np.bincount(docs, minlength=batch.num_rows))
            whole = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(grams[order].view(np.int64)))
            yield pa.record_batch([batch.column("node").take(pa.array(right)), whole.take(pa.array(right))], names=["node", "grams"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 80, bands: int = BANDS, rows: int = ROWS, agree: int = AGREE) -> DataFrame:
    """Per row of ``docs``: its id, n_shingles, component_id (least id reachable over links) and kept.

    Rows link when 100 * intersection >= percent * union of their sets of ``size``-word n-grams.
    ``bands``, ``rows`` and ``agree`` are for the default ``percent``; a lower one needs more bands.
    """
    given = bounded(docs).select(F.col(id_col).cast("string").cast("binary").alias("row_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    signed = storage.table(given.mapInArrow(_sign(size, bands, rows), _SIGNED).withColumn(id_col, F.col("row_id").cast("string").cast(docs.schema[id_col].dataType)).drop("row_id"), "signed")
    named = ["print_a", "print_b", "n_shingles"]
    heavy = signed
    first = [F.min(id_col).alias("first_id"), F.coalesce(F.min_by("text_key", id_col), F.min("text_key")).alias("text_key")]
    classes = signed.where("n_shingles > 0").groupBy(*named).agg(*first, F.first("keys").alias("keys"), F.first("marks").alias("marks"))
    # Numbers hold once they are written.
    whole = storage.table(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    # What follows needs neither keys nor signatures of all rows.
    signed = storage.table(heavy.select(id_col, *named), "rows")
    storage.discard(heavy)
    classes = storage.table(whole.drop("keys", "marks"), "named")

    listed = whole.select("node", F.col("n_shingles").alias("n"), "keys").mapInArrow(_posted, "key long, node long, n long")
    sizes = listed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    posted = storage.table(listed.join(sizes, "key"), "posted")
    near = storage.table(posted.groupBy("node").agg(F.sum("size").alias("weight")), "weights")
    rank = F.struct("weight", F.xxhash64("node"), "node", "n")
    leads = posted.join(near, "node").groupBy("key").agg(F.max(rank).alias("lead"))

    wanted = classes.join(near.select("node"), "node", "left_semi").select(F.col("first_id").alias("wanted_id"), F.col("text_key").alias("wanted_key"), "node", "print_a", "print_b")
    own = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("own_key"))
    # A class whose rows have no id is found by its text.  The plan is the same at every size.
    texts = own.join(wanted.hint("merge"), F.col("own_id").eqNullSafe(F.col("wanted_id")) & (F.col("own_key") == F.col("wanted_key")))
    made = texts.select("node", "text", "print_a", "print_b").mapInArrow(_sets(size), "node long, grams array<long>")
    sets = storage.table(made.groupBy("node").agg(F.first("grams").alias("grams")), "sets")
    marks = storage.table(whole.join(near.select("node"), "node", "left_semi").select("node", "marks"), "marks")
    storage.discard(whole)

    def compare(met: DataFrame) -> DataFrame:
        """Links among pairs (x, n_x, y, n_y)."""
        fits = met.where(f"x <> y and 100 * least(n_x, n_y) >= {percent} * greatest(n_x, n_y)")
        turned = F.col("x") > F.col("y")

        def side(a: str, b: str) -> Column:
            return F.when(turned, F.col(b)).otherwise(F.col(a))

        pairs = fits.select(side("x", "y").alias("a"), side("y", "x").alias("b"), side("n_x", "n_y").alias("n_a"), side("n_y", "n_x").alias("n_b")).distinct()
        marked = pairs.join(marks.select(F.col("node").alias("a"), F.col("marks").alias("marks_a")), "a").join(marks.select(F.col("node").alias("b"), F.col("marks").alias("marks_b")), "b")
        likely = marked.select("a", "b", "n_a", "n_b", "marks_a", "marks_b").mapInArrow(_agreeing(agree), "a long, b long, n_a long, n_b long")
        left = likely.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("grams_a")), "a")
        whole = left.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("grams_b")), "b")
        counted = whole.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("grams_a", "grams_b")).cast("long").alias("common"))
        return storage.cut(counted.where(100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b"))

    def mixed(listed: DataFrame, grouped: DataFrame) -> DataFrame:
        """Rows of buckets that hold several components, with their component."""
        now = listed.select("key", "node", "n").join(grouped, "node")
        several = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
        return now.join(several, "key", "left_semi")

    def pairs(rows: DataFrame) -> DataFrame:
        """Pairs of different components that share one of their rarest n-grams, counted over ``rows``."""
        held = rows.select("node", "n", "component").distinct().join(sets, "node").select("node", "n", "component", F.explode("grams").alias("gram"))
        # Only what two components have can be common to a pair; the rest counts as rarer than anything.
        often = held.groupBy("gram").agg(F.count("*").alias("df"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
        lists = held.join(often.select("gram", "df"), "gram").groupBy("node", "n", "component").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("grams"))
        ahead = F.size("grams") - least(F.col("n"), percent) + 1
        prefix = lists.where(ahead > 0).select("node", "n", "component", (F.col("n") - F.size("grams")).alias("unshared"), F.posexplode(F.slice("grams", F.lit(1), ahead.cast("int"))).alias("i", "key"))
        rare = storage.table(prefix.select(F.col("key.gram").alias("gram"), F.struct("node", "n", "component", (F.col("unshared") + F.col("i")).alias("before")).alias("own")), "rare")
        met = rare.select("gram", F.col("own").alias("p")).join(rare.select("gram", F.col("own").alias("q")), "gram").where("p.component < q.component")
        # With so many smaller n-grams before a common one, enough may not follow.
        total = percent * (F.col("p.n") + F.col("q.n"))
        fits = met.where(((100 + percent) * (F.col("p.n") - F.col("p.before")) >= total) & ((100 + percent) * (F.col("q.n") - F.col("q.before")) >= total))
        return fits.select(F.col("p.node").alias("x"), F.col("p.n").alias("n_x"), F.col("q.node").alias("y"), F.col("q.n").alias("n_y"))

    every = near.select("node")
    links = compare(posted.join(leads, "key").select(F.col("lead.node").alias("x"), F.col("lead.n").alias("n_x"), F.col("node").alias("y"), F.col("n").alias("n_y")))
    grouped = components(every, links)
    left = storage.table(mixed(posted, grouped), "left")
    more = compare(pairs(left))
    if not more.isEmpty():
        grouped = components(every, links.union(more))

    told = grouped.join(classes.select("node", "first_id", *named), "node")
    best = told.groupBy("component").agg(F.min("first_id").alias("least_id"))
    linked = told.join(best, "component").select(*named, F.col("least_id").alias("linked_id"))
    labelled = classes.select("first_id", *named).join(linked, named, "left").select(*named, F.coalesce("linked_id", "first_id").alias("component_id"))
    # Apart from what made it, the join can split a class of very many copies.
    labelled = storage.table(labelled, "labelled")
    joined = signed.select(id_col, *named).join(labelled.hint("merge"), named, "left")
    component = F.coalesce("component_id", F.col(id_col))
    return joined.select(id_col, "n_shingles", component.alias("component_id"), F.coalesce(component == F.col(id_col), F.lit(False)).alias("kept"))
