"""N-gram Jaccard join by vertical partitioning.

The universe of word n-grams is cut into fragments, every document's set is cut alongside, partial
overlaps are counted in each fragment on its own and summed per document or per pair.

1. *Support.*  Every chunk of documents sends each fragment its n-grams, packed, each n-gram once
   however many documents of the chunk have it, so that a passage of a third of all documents does
   not gather in one fragment.  A fragment counts which n-grams occur in another document; the sums
   over fragments bound from above what a document can share with any other.  Documents that cannot
   reach the threshold leave, which in ordinary text is nearly all of them.  The number of fragments
   follows the bytes of text.
2. *Order.*  What is left gets the global order, rarest n-gram first, cut into fragments at
   quantiles.  Equal sets form one class beforehand, so copies cost nothing.
3. *Candidates.*  Two sets at or over the threshold share an n-gram of their prefixes in the global
   order.  A first round compares each class only with a few classes of each posting list, the best
   connected one and some of those that have the n-gram earliest, which unites large families at
   linear cost; the second round compares all classes that share
   a prefix n-gram, have compatible sizes and are not already connected.  No link that would change
   a component is left out, and no pair inside a component is enumerated.
4. *Verification.*  A pair's overlap is counted in each fragment and summed.

Nulls and texts without words have an empty set and are linked with nothing.  Repeated rows and
copies get the component of their class, rows without an id link others too.  Sets are compared by
64-bit hashes of n-grams; classes by a 128-bit fingerprint, each under a number of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.llm import storage
from tessellum.llm.textcore import Words, bounded, chunks, mix, window_hashes

_PARTS = "batch long, fragment long, ids binary, docs binary, sizes binary, keys binary"
_SUPPORT = "row_id binary, text_key long, n_shingles long, print_a long, print_b long, support long"
#: Bytes of text for each fragment, and the most fragments; beyond, fragments grow.
FRAGMENT_BYTES = 8 << 20
MOST_FRAGMENTS = 1 << 19
#: Stands for several documents of a chunk, whose count is known without a reply.
_MANY = 0xFFFF


def document_shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, n-gram hash) of a batch, by n-gram and document.  A document of fewer words is one n-gram."""
    hashed = words.hashes()
    n = words.counts
    runs = window_hashes(hashed, size)
    doc = words.doc
    whole = doc[: len(runs)] == doc[size - 1 :] if len(runs) else np.zeros(0, bool)
    docs, grams = doc[: len(runs)][whole], runs[whole]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            there = n[short] > k
            value = hashed[np.minimum(words.first[short] + k, len(hashed) - 1)]
            own = np.where(there, own * np.uint64(0xD6E8FEB86659FD93) + value, own)
        docs = np.concatenate([docs, short])
        grams = np.concatenate([grams, mix(own + n[short].astype(np.uint64))])
    order = np.argsort(grams)
    docs, grams = docs[order].astype(np.int64), grams[order].astype(np.uint64)
    again = np.zeros(len(grams), bool)
    again[1:] = grams[1:] == grams[:-1]
    if again.any():
        runs = np.flatnonzero(again | np.append(again[1:], False))
        docs[runs] = docs[runs][np.lexsort((docs[runs], grams[runs]))]
        again[1:] &= docs[1:] == docs[:-1]
        docs, grams = docs[~again], grams[~again]
    return docs, grams


def _prints(docs: np.ndarray, grams: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each document's set, from sums, so that order does not matter."""
    out = []
    order = np.argsort(docs.astype(np.uint16) if n <= 1 << 16 else docs, kind="stable")
    sizes = np.bincount(docs, minlength=n)
    ends = np.cumsum(sizes)
    for salt in (0x2545F4914F6CDD1D, 0xC2B2AE3D27D4EB4F):
        total = np.zeros(len(docs) + 1, np.uint64)
        np.cumsum(mix(grams[order] ^ np.uint64(salt)), dtype=np.uint64, out=total[1:])
        out.append(mix(total[ends] - total[ends - sizes]).view(np.int64))
    return out[0], out[1]


def _parts(size: int, fragments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in chunks(batches):
            n = batch.num_rows
            docs, grams = document_shingles(Words(batch.column("text")), size)
            a, b = _prints(docs, grams, n)
            first = np.ones(len(grams), bool)
            first[1:] = grams[1:] != grams[:-1]
            at = np.flatnonzero(first)
            single = np.diff(at, append=len(grams)) == 1
            # What several documents of the chunk have is shared whatever others have.
            local = np.ones(len(grams), bool)
            local[at[single]] = False
            counts = (np.bincount(docs, minlength=n), a, b, np.bincount(docs[local], minlength=n))
            rows = pa.record_batch([batch.column("row_id").cast(pa.binary()), batch.column("text_key"), *(pa.array(x.astype(np.int64)) for x in counts)], names=[c.split()[0] for c in _SUPPORT.split(", ")])
            with pa.ipc.new_stream(sink := pa.BufferOutputStream(), rows.schema) as head:
                head.write_batch(rows)
            own = np.where(single, docs[at], _MANY)
            fragment = ((grams[at] >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
            # By fragment and document, so that steps between documents are small numbers and compress.
            order = np.argsort(fragment << 16 | own)
            fragment, keys, own = fragment[order], grams[at][order].astype(np.uint32), own[order]
            begin = np.flatnonzero(np.diff(fragment, prepend=-1))
            ends = [*begin.tolist(), len(fragment)]
            steps = np.diff(own, prepend=0)
            steps[begin] = own[begin]
            cut = [[x[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)] for x in (steps.astype(np.uint16), keys)]
            m = len(begin)
            yield pa.record_batch([pa.array([number] * (m + 1), pa.int64()), pa.array([-1 - number, *fragment[begin].tolist()], pa.int64()), pa.array([sink.getvalue().to_pybytes()] + [None] * m, pa.binary()), pa.array([None, *cut[0]], pa.binary()), pa.nulls(m + 1, pa.binary()), pa.array([None, *cut[1]], pa.binary())], names=["batch", "fragment", "ids", "docs", "sizes", "keys"])
            number += 1

    return run


def _count_fragment(group: pa.Table) -> pa.Table:
    """How many n-grams of each document of each batch another batch has too, in one fragment."""
    if group.column("fragment")[0].as_py() < 0:
        return group
    blobs = group.column("keys").to_pylist()
    keys = np.concatenate([np.frombuffer(b, np.uint32) for b in blobs])
    order = np.argsort(keys)
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    shared = np.zeros(len(keys), bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    docs, sizes, at = [], [], 0
    for raw in group.column("docs").to_pylist():
        own = np.cumsum(np.frombuffer(raw, np.uint16), dtype=np.uint16)
        met, times = np.unique(own[shared[at : at + len(own)] & (own != _MANY)], return_counts=True)
        docs.append(met.tobytes())
        sizes.append(times.astype(np.uint32).tobytes())
        at += len(own)
    found = group.set_column(3, "docs", pa.array(docs, pa.binary())).set_column(4, "sizes", pa.array(sizes, pa.binary())).set_column(5, "keys", pa.nulls(len(docs), pa.binary()))
    return found.filter(pa.array([bool(d) for d in docs]))


def _sum_batch(group: pa.Table) -> pa.Table:
    heads = [raw for raw in group.column("ids").to_pylist() if raw is not None]
    head = pa.ipc.open_stream(heads[0]).read_all()
    total = head.column("support").to_numpy().copy()
    for docs, sizes in zip(group.column("docs").to_pylist(), group.column("sizes").to_pylist(), strict=True):
        if docs is not None:
            total[np.frombuffer(docs, np.uint16)] += np.frombuffer(sizes, np.uint32)
    return head.set_column(5, "support", pa.array(total))


def support(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, fragments: int | None = None) -> DataFrame:
    """Per row: its id, the size and fingerprint of its set, and a bound on what it shares with other rows."""
    given = bounded(docs).select(F.col(id_col).cast("string").cast("binary").alias("row_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    if fragments is None:
        total = given.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        fragments = min(MOST_FRAGMENTS, max(8, -(-total // FRAGMENT_BYTES)))
    parts = given.mapInArrow(_parts(size, fragments), _PARTS)
    counted = parts.groupBy("fragment").applyInArrow(_count_fragment, _PARTS)
    summed = counted.groupBy("batch").applyInArrow(_sum_batch, _SUPPORT)
    kind = docs.schema[id_col].dataType
    return summed.withColumn(id_col, F.col("row_id").cast("string").cast(kind)).drop("row_id")


def _shingle_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=1 << 20):
            docs, grams = document_shingles(Words(batch.column("text")), size)
            a, b = _prints(docs, grams, batch.num_rows)
            # Another text of the same id is left out.
            right = (a == np.asarray(batch.column("print_a"))) & (b == np.asarray(batch.column("print_b")))
            keep = right[docs]
            docs, grams = docs[keep], grams[keep]
            yield pa.record_batch([pa.array(np.asarray(batch.column("node"))[docs]), pa.array(np.asarray(batch.column("n"))[docs]), pa.array(grams.view(np.int64))], names=["node", "n", "gram"])

    return run


def least(n: Column, percent: int) -> Column:
    """The smallest overlap that a set of n n-grams needs."""
    return F.ceil(n * percent / F.lit(100)).cast("long")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node id reachable.  Minimum labels with pointer jumping.

    ``nodes`` has column node, ``edges`` columns a and b.  All steps are joins and minima by key.
    """
    both = storage.cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = nodes.select("node", F.col("node").alias("component"))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        low = F.least("component", F.coalesce("near", "component"))
        hooked = storage.cut(labels.join(near, "node", "left").select("node", low.alias("component"), (low < F.col("component")).alias("moved")))
        if hooked.where("moved").isEmpty():
            return hooked.select("node", "component")
        up = hooked.select(F.col("node").alias("component"), F.col("component").alias("up"))
        labels = hooked.join(up, "component").select("node", F.col("up").alias("component"))


def _overlaps(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Verified pairs: partial overlaps by fragment, summed, against the threshold."""
    left = segments.select(F.col("node").alias("a"), "fragment", F.col("grams").alias("grams_a"))
    right = segments.select(F.col("node").alias("b"), "fragment", F.col("grams").alias("grams_b"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"])
    summed = partial.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("grams_a", "grams_b")).cast("long").alias("part")).groupBy("a", "b", "n_a", "n_b").agg(F.sum("part").alias("overlap"))
    return summed.where(100 * F.col("overlap") >= percent * (F.col("n_a") + F.col("n_b") - F.col("overlap"))).select("a", "b", "overlap")


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, fragments: int | None = None, order_fragments: int = 4, leaders: int = 4) -> DataFrame:
    """Per row of ``docs``: its id, n_shingles, component_id (smallest id reachable over links).

    Rows link when 100 * intersection >= percent * union of their sets of ``size``-word n-grams.
    """
    rows = storage.table(support(docs, id_col, text_col, size, fragments), "support")
    classes = rows.where("n_shingles > 0").groupBy("print_a", "print_b", "n_shingles").agg(F.min(id_col).alias("first_id"), F.coalesce(F.min_by("text_key", id_col), F.min("text_key")).alias("text_key"), F.max("support").alias("support"))
    able = classes.where(F.col("support") >= least(F.col("n_shingles"), percent)).drop("support")
    # Numbers hold once they are written.
    able = storage.table(able.withColumn("node", F.monotonically_increasing_id()), "classes")
    wanted = able.select(F.col("first_id").alias("wanted_id"), F.col("text_key").alias("wanted_key"), "node", F.col("n_shingles").alias("n"), "print_a", "print_b")
    own = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("own_key"))
    # A class whose rows have no id is found by its text.  The plan is the same at every size.
    texts = own.join(wanted.hint("merge"), F.col("own_id").eqNullSafe(F.col("wanted_id")) & (F.col("own_key") == F.col("wanted_key")))
    grams = storage.table(texts.select("node", "n", "text", "print_a", "print_b").mapInArrow(_shingle_rows(size), "node long, n long, gram long"), "grams")

    # The order needs how many classes have an n-gram, now among the classes that are left.
    held = grams.groupBy("node", "gram").agg(F.first("n").alias("n"))
    often = grams.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    ranked = held.join(often, "gram").select("node", "n", "df", F.struct("df", "gram").alias("key"))
    sets = ranked.groupBy("node").agg(F.first("n").alias("n"), F.array_sort(F.collect_list("key")).alias("grams"), F.avg("df").alias("weight"))
    sets = storage.table(sets.where(F.size("grams") >= least(F.col("n"), percent)), "sets")

    cuts = sets.select(F.explode("grams.df").alias("df")).agg(F.percentile_approx("df", [i / order_fragments for i in range(1, order_fragments)], 1000)).first()[0] or []
    bounds = [0, *sorted({int(c) for c in cuts}), (1 << 62)]

    def piece(i: int, low: int, high: int) -> Column:
        inside = F.filter("grams", lambda g: (g.df > low) & (g.df <= high))
        return F.struct(F.lit(i).alias("fragment"), F.transform(inside, lambda g: g.gram).alias("grams"))

    pieces = F.array(*(piece(i, *ends) for i, ends in enumerate(zip(bounds, bounds[1:], strict=False))))
    segments = sets.select("node", F.explode(pieces).alias("s")).select("node", "s.fragment", "s.grams").where(F.size("grams") > 0)
    segments = storage.table(segments, "segments")
    # Unshared n-grams come first in the order and use up part of the prefix.
    prefix = F.greatest(F.lit(0), F.size("grams") - least(F.col("n"), percent) + 1).cast("int")
    listed = sets.select("node", "n", "weight", (F.col("n") - F.size("grams")).alias("unshared"), F.posexplode(F.slice(F.col("grams"), F.lit(1), prefix)).alias("i", "key"))
    posted = storage.table(listed.select("node", "n", "weight", (F.col("unshared") + F.col("i")).alias("before"), F.col("key.gram").alias("gram")), "posted")

    nodes = able.select("node", "first_id", "print_a", "print_b", "n_shingles")

    def compare(met: DataFrame) -> DataFrame:
        # With so many smaller n-grams before a common one, enough may not follow.
        total = percent * (F.col("x.n") + F.col("y.n"))
        fits = met.where(((100 + percent) * (F.col("x.n") - F.col("x.before")) >= total) & ((100 + percent) * (F.col("y.n") - F.col("y.before")) >= total))
        fits = fits.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), F.when(F.col("x.node") < F.col("y.node"), F.struct("x.n", F.col("y.n").alias("m"))).otherwise(F.struct(F.col("y.n").alias("n"), F.col("x.n").alias("m"))).alias("sizes"))
        pairs = fits.groupBy("a", "b").agg(F.first("sizes.n").alias("n_a"), F.first("sizes.m").alias("n_b"))
        return storage.cut(_overlaps(pairs, segments, percent).select("a", "b"))

    own = F.struct("node", "n", "before")
    ranks = [F.struct(F.col("weight") if i == 0 else -F.col("before"), F.xxhash64("node", "gram", F.lit(i))) for i in range(leaders)]
    heads = posted.groupBy("gram").agg(F.count("*").alias("size"), F.array_distinct(F.array(*(F.max_by(own, r) for r in ranks))).alias("leads")).where("size > 1")
    stars = posted.select("gram", own.alias("y")).join(heads, "gram").select(F.explode("leads").alias("x"), "y").where("x.node <> y.node")
    near = compare(stars)
    grouped = components(sets.select("node"), near)

    # Whatever shares a prefix n-gram across components is compared now.
    now = posted.join(grouped, "node").select("gram", F.struct("node", "n", "before", "component").alias("own"))
    mixed = now.groupBy("gram").agg(F.min("own.component").alias("low"), F.max("own.component").alias("high")).where("low <> high").select("gram")
    held = storage.table(now.join(mixed, "gram", "left_semi"), "mixed")
    rest = compare(held.select("gram", F.col("own").alias("x")).join(held.select("gram", F.col("own").alias("y")), "gram").where("x.component < y.component"))
    # Few links are left now; they join whole components.
    named_a = rest.join(grouped.select(F.col("node").alias("a"), F.col("component").alias("c_a")), "a")
    between = named_a.join(grouped.select(F.col("node").alias("b"), F.col("component").alias("c_b")), "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
    outer = components(grouped.select(F.col("component").alias("node")).distinct(), between)
    grouped = grouped.join(outer.select(F.col("node").alias("component"), F.col("component").alias("outer")), "component").select("node", F.col("outer").alias("component"))
    named = grouped.join(nodes, "node")
    best = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    linked = named.join(best, "component").select("print_a", "print_b", "n_shingles", F.col("component_id").alias("linked_id"))
    labelled = classes.join(linked, ["print_a", "print_b", "n_shingles"], "left").select("print_a", "print_b", "n_shingles", F.coalesce("linked_id", "first_id").alias("component_id"))
    # Apart from what made it, the join can split a class of very many copies.
    labelled = storage.table(labelled, "labelled")
    joined = rows.join(labelled.hint("merge"), ["print_a", "print_b", "n_shingles"], "left")
    return joined.select(id_col, "n_shingles", F.coalesce("component_id", F.col(id_col)).alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Keep the document with the smallest id of each component, with all its columns.

    Rows of null id all stay; of rows that repeat an id one stays.
    """
    ids = similarity_components(docs, id_col=id_col, **options).where(F.col(id_col) == F.col("component_id")).groupBy(F.col(id_col).alias("_kept")).agg(F.count("*").alias("_times"))
    ids = storage.table(ids, "kept")
    named, chosen = docs.where(F.col(id_col).isNotNull()), ids.select("_kept")
    kept = named.join(chosen, named[id_col] == chosen["_kept"], "left_semi")
    if not ids.where("_times > 1").isEmpty():
        kept = kept.dropDuplicates([id_col])
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
