"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton of all normalised benchmark items is walked by a document's words and yields, at every
word, the length of the longest item passage that ends there.  Where it reaches the window length, the
window's words are hit, and the automaton's states tell which items hold the window.  Items shorter
than a window count as a whole.

A vectorised pass comes first: windows of a batch whose hash is no benchmark window's cannot be hit, and
the walk skips all stretches without any; that changes no result.

Items come in blocks of ``BLOCK_BYTES`` of text.  An executor task builds each block's automaton, packed
into arrays of about ten times its text; ``PASS_BLOCKS`` of them at a time are broadcast and take one pass
over the documents together.  Null texts have no words: nothing is hit.  Repeated items count once by
their id; items without words or id have no windows.  Repeated documents each get a row.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessellum.llm import storage
from tessellum.llm.spans import replaced
from tessellum.llm.textcore import NOT_ALPHANUMERIC, Words, bounded, chunks, text_in, window_hashes

#: Most bytes of item text in one automaton, and automata broadcast together: some 160 MB.
BLOCK_BYTES = 2 << 20
PASS_BLOCKS = 8


class SuffixAutomaton:
    """Substrings of many word sequences, with the items that hold each window."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self._label(items)

    def _extend(self, last: int, w: int) -> int:
        known = self.next[last].get(w)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._clone(last, w, known)
        made = self._state({}, self.length[last] + 1)
        at = last
        while at >= 0 and w not in self.next[at]:
            self.next[at][w] = made
            at = self.link[at]
        if at < 0:
            self.link[made] = 0
        else:
            target = self.next[at][w]
            self.link[made] = target if self.length[target] == self.length[at] + 1 else self._clone(at, w, target)
        return made

    def _state(self, edges: dict[int, int], length: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(0)
        return len(self.length) - 1

    def _clone(self, at: int, w: int, target: int) -> int:
        copy = self._state(dict(self.next[target]), self.length[at] + 1)
        self.link[copy] = self.link[target]
        self.link[target] = copy
        while at >= 0 and self.next[at].get(w) == target:
            self.next[at][w] = copy
            at = self.link[at]
        return copy

    def _label(self, items: list[tuple[str, list[int]]]) -> None:
        """Which items hold a full window that ends in a state, and which short items are suffixes of it."""
        n, window = len(self.length), self.window
        # The ancestor that holds the last `window` words of a state, if it is that long.
        self.home = [-1] * n
        for s in sorted(range(1, n), key=self.length.__getitem__):
            if self.length[s] >= window:
                up = self.link[s]
                self.home[s] = s if self.length[up] < window else self.home[up]
        self.held: dict[int, set[str]] = {}
        self.short: dict[int, tuple[int, set[str]]] = {}
        for name, words in items:
            at = 0
            for w in words:
                at = self.next[at][w]
                if self.home[at] >= 0:
                    self.held.setdefault(self.home[at], set()).add(name)
            if 0 < len(words) < window:
                self.short.setdefault(at, (len(words), set()))[1].add(name)
        self.next_short = [-1] * n  # nearest ancestor, or the state itself, that ends a short item
        for s in sorted(range(1, n), key=self.length.__getitem__):
            self.next_short[s] = s if s in self.short else self.next_short[self.link[s]]


@dataclass
class PackedAutomaton:
    """A suffix automaton in arrays: edges by (state, word), links, lengths, homes of windows, items of homes."""

    window: int
    edges: np.ndarray
    targets: np.ndarray
    link: np.ndarray
    length: np.ndarray
    home: np.ndarray
    next_short: np.ndarray
    short: dict[int, tuple[int, set[str]]]
    held: np.ndarray
    items: np.ndarray
    names: list[str]

    @classmethod
    def of(cls, made: SuffixAutomaton) -> PackedAutomaton:
        sizes = np.fromiter(map(len, made.next), np.int64, len(made.next))
        words = np.fromiter((w for edges in made.next for w in edges), np.int64, int(sizes.sum()))
        targets = np.fromiter((t for edges in made.next for t in edges.values()), np.int32, len(words))
        edges = np.repeat(np.arange(len(sizes)) << 32, sizes) | words
        order = np.argsort(edges)
        names = sorted({n for held in made.held.values() for n in held})
        number = {n: i for i, n in enumerate(names)}
        pairs = np.array(sorted((s, number[n]) for s, held in made.held.items() for n in held), np.int32).reshape(-1, 2)
        arrays = (np.array(x, np.int32) for x in (made.link, made.length, made.home, made.next_short))
        return cls(made.window, edges[order], targets[order], *arrays, made.short, pairs[:, 0], pairs[:, 1], names)

    def _next(self, state: int, word: int) -> int:
        """The state behind an edge, or -1."""
        key = state << 32 | word
        at = int(np.searchsorted(self.edges, key))
        return int(self.targets[at]) if at < len(self.edges) and self.edges[at] == key else -1

    def _items(self, home: int) -> set[str]:
        first, last = np.searchsorted(self.held, [home, home + 1])
        return {self.names[i] for i in self.items[first:last].tolist()}

    def walk(self, words: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit word ranges [start, end), one for each window that ends at a word, and the items met."""
        state = matched = 0
        ranges, homes, shorts = [], set(), set()
        for i, w in enumerate(words):
            after = self._next(state, w) if w >= 0 else -1
            while state and after < 0 and w >= 0:
                state = int(self.link[state])
                matched = int(self.length[state])
                after = self._next(state, w)
            state, matched = (after, matched + 1) if after >= 0 else (0, 0)
            if matched >= self.window:
                ranges.append((i + 1 - self.window, i + 1))
                # The match may be shorter than the state's longest string; its window's home is the same.
                homes.add(int(self.home[state]))
            at = int(self.next_short[state]) if state else -1
            while at > 0:
                size = self.short[at][0]
                if size <= matched:
                    ranges.append((i + 1 - size, i + 1))
                    shorts.add(at)
                at = int(self.next_short[self.link[at]])
        names: set[str] = set().union(*map(self._items, homes), *(self.short[s][1] for s in shorts))
        return ranges, names


class Index:
    """A packed automaton, the hashed vocabulary it reads, and the hashes of windows by their size."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        texts = pa.array([t for _, t in items], pa.string())
        words = Words(texts, NOT_ALPHANUMERIC)
        hashed = words.hashes()
        self.vocabulary, ids = np.unique(hashed, return_inverse=True)
        parts = np.split(ids, np.cumsum(words.counts)[:-1]) if len(items) else []
        self.automaton = PackedAutomaton.of(SuffixAutomaton([(name, part.tolist()) for (name, _), part in zip(items, parts, strict=True)], window))
        sizes = np.minimum(words.counts, window)
        self.windows: dict[int, np.ndarray] = {}
        for size in np.unique(sizes[sizes > 0]).tolist():
            found = window_hashes(hashed, size)
            inside = words.doc[: len(found)] == words.doc[size - 1 :]
            self.windows[size] = np.unique(found[inside & (sizes[words.doc[: len(found)]] == size)])

    def hits(self, words: Words, hashed: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, dict[int, set[str]]]:
        """A mask of hit words of the batch, and by document the items met."""
        near = np.zeros(len(hashed) + 1, np.int64)
        for size, known in self.windows.items():
            found = window_hashes(hashed, size)
            at = np.flatnonzero(known[np.minimum(np.searchsorted(known, found), len(known) - 1)] == found)
            at = at[doc[at] == doc[at + size - 1]]
            np.add.at(near, at, 1)
            np.add.at(near, at + size, -1)
        covered = np.cumsum(near)[:-1] > 0
        hit = np.zeros(len(hashed), bool)
        met: dict[int, set[str]] = {}
        if covered.any():
            cut = np.ones(len(covered) + 1, bool)
            cut[1:-1] = (covered[1:] != covered[:-1]) | (doc[1:] != doc[:-1])
            edges = np.flatnonzero(cut)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if covered[a]:
                    ids = np.minimum(np.searchsorted(self.vocabulary, hashed[a:b]), len(self.vocabulary) - 1)
                    ids = np.where(self.vocabulary[ids] == hashed[a:b], ids, -1)
                    ranges, names = self.automaton.walk(ids.tolist())
                    for x, y in ranges:
                        hit[a + x : a + y] = True
                    if names:
                        met.setdefault(int(doc[a]), set()).update(names)
        return hit, met


_FOUND = "n_words long, ranges array<struct<first:int,last:int,start:int,end:int>>, items array<string>"
_RANGE = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def _marker(shared, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes: list[Index] = shared.value
        for batch in chunks(batches, ("row", text_col)):
            words = Words(text_in(batch, ("row", text_col)), NOT_ALPHANUMERIC)
            doc, hashed = words.doc, words.hashes()
            hit, met = np.zeros(len(hashed), bool), {}
            for index in indexes:
                own, names = index.hits(words, hashed, doc)
                hit |= own
                for d, found in names.items():
                    met.setdefault(d, set()).update(found)
            ranges: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            at = np.flatnonzero(hit)
            if len(at):
                new = np.ones(len(at) + 1, bool)
                new[1:-1] = (np.diff(at) > 1) | (doc[at[1:]] != doc[at[:-1]])
                edges = np.flatnonzero(new)
                for a, b in zip(at[edges[:-1]].tolist(), at[edges[1:] - 1].tolist(), strict=True):
                    d = int(doc[a])
                    base = int(words.offsets[d])
                    chars = [len(words.blob[base:x].decode("utf-8", "replace")) for x in (int(words.start[a]), int(words.end[b]))]
                    ranges[d].append({"first": a - int(words.first[d]), "last": b + 1 - int(words.first[d]), "start": chars[0], "end": chars[1]})
            items = [sorted(met.get(d, ())) for d in range(batch.num_rows)]
            kept = [batch.column(c) for c in batch.schema.names]
            yield pa.record_batch([*kept, pa.array(words.counts.astype(np.int64)), pa.array(ranges, _RANGE), pa.array(items, pa.list_(pa.string()))], names=[*batch.schema.names, "n_words", "ranges", "items"])

    return run


def _indexes(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int, pass_blocks: int) -> Iterator[list[Index]]:
    """Automata of blocks of items, some at a time; tasks of executors build them from rows of a bounded size."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)).cast("int"))

    def build(group: pa.Table) -> pa.Table:
        rows = list(zip(group.column("item").to_pylist(), group.column("text").to_pylist(), strict=True))
        return pa.table({"index": pa.array([pickle.dumps(Index(rows, window))], pa.binary())})

    for first in range(0, blocks, pass_blocks):
        made = dealt.where(F.col("block").between(first, first + pass_blocks - 1)).groupBy("block").applyInArrow(build, "index binary")
        yield [pickle.loads(r["index"]) for r in made.collect()]


def _marked(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, window: int, block_bytes: int, pass_blocks: int = PASS_BLOCKS) -> DataFrame:
    """(row, found): each row of ``docs`` as a struct, and what was found in its text."""
    spark = docs.sparkSession
    done = bounded(docs).select(F.struct(*docs.columns).alias("row"))
    for indexes in _indexes(benchmark, item_col, item_text_col, window, block_bytes, pass_blocks):
        shared = spark.sparkContext.broadcast(indexes)
        again = "found" in done.columns
        schema = T.StructType([*done.schema.fields, *T.StructType.fromDDL(_FOUND).fields])
        marked = done.mapInArrow(_marker(shared, text_col), schema)
        fresh = F.struct("n_words", "ranges", "items")
        if again:
            marked = storage.table(marked, "marked")
            fresh = F.struct(F.col("n_words"), _merge(F.concat("found.ranges", "ranges")).alias("ranges"), F.array_sort(F.array_union("found.items", "items")).alias("items"))
        done = marked.select("row", fresh.alias("found"))
    return done


def mark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, block_bytes: int = BLOCK_BYTES, name: str = "found") -> DataFrame:
    """``docs`` with n_words, ranges (hit words and their code points) and items (those met) in column ``name``, which replaces one of that name."""
    return _marked(docs.drop(name), benchmark, text_col, item_col, item_text_col, window, block_bytes).select("row.*", F.col("found").alias(name))


def _merge(ranges):
    """Sorted ranges of words with overlapping or adjacent ones joined."""
    kind = "array<struct<first:int,last:int,start:int,end:int>>"

    def step(done, r):
        tail = F.element_at(done, -1)
        joined = F.struct(tail["first"].alias("first"), F.greatest(tail["last"], r["last"]).alias("last"), tail["start"].alias("start"), F.greatest(tail["end"], r["end"]).alias("end"))
        meets = (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1))["last"], F.lit(-1)) >= r["first"])
        return F.when(meets, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(F.array_sort(ranges), F.array().cast(kind), step)


def n_hit():
    return F.aggregate("found.ranges", F.lit(0).cast("long"), lambda a, r: a + (r["last"] - r["first"]).cast("long"))


def contaminated(percent: int = 5):
    """Whether hit words are at least ``percent`` of a document's words, and there are any."""
    return (n_hit() > 0) & (100 * n_hit() >= percent * F.col("found.n_words"))


def digests(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, percent: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: n_words, n_hit, n_items, items_sha256, contaminated."""
    marked = _marked(docs.select(id_col, text_col), benchmark, text_col, "item_id", "text", window, block_bytes)
    return marked.select(F.col("row").getField(id_col).alias(id_col), F.col("found.n_words").alias("n_words"), n_hit().alias("n_hit"), F.size("found.items").cast("long").alias("n_items"), F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), contaminated(percent).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = 13, percent: int = 5) -> DataFrame:
    """``docs`` without contaminated rows; other rows and all columns stay as they are."""
    return _marked(docs, benchmark, text_col, "item_id", "text", window, BLOCK_BYTES).where(~contaminated(percent)).select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = 13, percent: int = 5, longest: int = 0) -> DataFrame:
    """Drop rows whose hit share reaches ``percent``; cut hit spans out of the others.

    Spans of at most ``longest`` words stay; by default every span goes.
    """
    marked = _marked(docs, benchmark, text_col, "item_id", "text", window, BLOCK_BYTES).where(~contaminated(percent))
    spans = F.transform(F.filter("found.ranges", lambda r: r["last"] - r["first"] > longest), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))
    text = F.col("row").getField(text_col)
    cut = F.when(F.size(spans) > 0, replaced(text, spans, "")).otherwise(text)
    return marked.select(F.col("row").withField(text_col, cut).alias("row")).select("row.*")
