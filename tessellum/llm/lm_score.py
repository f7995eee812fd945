"""Language-model scoring with a hashed maximum-entropy model and a class-factored softmax.

P(token | history) = P(class | history) P(member | class, history) P(token | class, member).  Classes
are frequency bins of the training counts (a token seen once or never is in the lowest), the end of a
text, and two copy classes: the token repeats the last one, or the one before.  The words of a class
are dealt to ``MEMBERS`` sets by a hash; both the class and the set within it follow from a softmax over
hashed features: the last two classes, the last token, the last two tokens, and the last but one (a
skip); for sets the last token and the last two, together with the class.  Inside a set counts decide.
A token never seen in training has the leave-one-out share of the lowest class, spread over all
spellings by an order-one model of letters, so the probabilities of distinct unseen words, however
many, sum to no more than that share; training takes each token's class from its count without itself.

Counting, training and scoring run on packed chunks of texts:

1. Chunks are tokenised once into local vocabularies and kept in a table.
2. Each chunk sends every fragment of the hash space its own words with their training counts; the
   fragment adds them up and sends back the totals, aligned with the chunk's vocabulary.  No
   vocabulary is ever gathered or broadcast.  The number of fragments follows the bytes of text.
3. Each of ``rounds`` rounds trains on all training tokens of all chunks, in ``parts`` steps: every task
   trains, from the current weights, on the next part of each of its chunks; weights and step sizes are
   then averaged row by row, weighted by use, through a tree of groups.  The model has a fixed size,
   ``ROWS`` rows for each softmax.
4. Scores are sums over a chunk's numpy batches.

Null and empty texts consist of the end alone.  Without training rows all counts are 0 and the
classes are equally likely.  Repeated rows each count and each get a row.  A text of any length is
one chunk at least; its features are made block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.llm import sample, storage
from tessellum.llm.textcore import Words, bounded, chunks, mix, packed

BINS = 21
END, COPY, COPY_SKIP = BINS, BINS + 1, BINS + 2
CLASSES = 24
#: Sets of words inside a class.
MEMBERS = 16
#: Features of the sets: the last two tokens and the last token, each with the class.
MEMBER_FEATURES = 2
#: Rows of each weight table, of which the first are for pairs of classes.
ROWS = 1 << 15
PAIRS = CLASSES * CLASSES
BLOCKS = 64
STEP = 8192
CHUNK = 3 << 20
#: Bytes of text for each fragment of the hash space, and the most fragments.
FRAGMENT_BYTES = 8 << 20
MOST_FRAGMENTS = 1 << 16

_ENCODED = "batch long, ids binary, held binary, counts binary, tokens binary, vocab binary, prints binary, times binary, spelled binary, letters array<long>"
_WEIGHTS = "part int, block int, weights binary, used binary, power binary, member_weights binary, member_used binary, member_power binary"
_VOTES = "batch long, fragment long, words binary, times binary"


def pack(x: np.ndarray) -> bytes:
    """Whole numbers byte plane by byte plane, so that the high zeros of small numbers compress away."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(raw: bytes | None) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw or b"", np.uint8).reshape(8, -1).T).view("<i8").ravel()


# What precedes a letter: nothing, one of a to z, a digit, another mark, or a kind of UTF-8 byte.
_CONTEXTS = 32
_CONTEXT = np.full(256, 28, np.uint8)
_CONTEXT[0] = 0
_CONTEXT[97:123] = np.arange(1, 27)
_CONTEXT[48:58] = 27
_CONTEXT[0x80:0xC0], _CONTEXT[0xC0:0xE0], _CONTEXT[0xE0:] = 29, 30, 31


def _moves(data: np.ndarray) -> np.ndarray:
    """The (context, letter) pairs of packed words, where the zero that closes a word is a letter too."""
    return _CONTEXT[data[:-1]].astype(np.int64) * 256 + data[1:]


def _packed(words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`packed` words, whose own zero bytes become 0xFF, which is in no text."""
    data, offsets = packed(words, at)
    own = data == 0
    own[offsets] = False
    own[-1:] = False
    data[own] = 255
    return data, offsets


def spelling(letters: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Log probability of each packed word, its end included."""
    counts = letters.reshape(_CONTEXTS, 256) + 0.5
    table = np.log(counts / counts.sum(1, keepdims=True)).ravel()
    begins = np.flatnonzero(data[:-1] == 0)
    return np.add.reduceat(table[_moves(data)], begins) if len(begins) else np.zeros(0)


@dataclass
class Totals:
    """Sums over the training tokens: all, distinct ones, documents, by (bin of the count, member), and letters of words."""

    tokens: int
    types: int
    documents: int
    mass: np.ndarray
    ones: int
    twos: int
    letters: np.ndarray = field(default_factory=lambda: np.zeros(_CONTEXTS * 256))

    @property
    def unseen(self) -> float:
        """The share of the lowest class that tokens never seen have."""
        return (self.ones + 1) / (self.ones + 2 * self.twos + 2)


@dataclass
class Table:
    """Weights of one softmax, and squared gradients by row so far, which set the step sizes."""

    weights: np.ndarray
    power: np.ndarray

    @classmethod
    def zeros(cls, width: int) -> Table:
        return cls(np.zeros((ROWS, width), np.float32), np.full(ROWS, 1e-6, np.float32))

    def copy(self) -> Table:
        return Table(self.weights.copy(), self.power.copy())


@dataclass
class Model:
    classes: Table
    members: Table
    totals: Totals

    @classmethod
    def from_totals(cls, totals: Totals) -> Model:
        """A model that knows how frequent classes are, whatever the history."""
        model = cls(Table.zeros(CLASSES), Table.zeros(MEMBERS), totals)
        own = np.concatenate([totals.mass.sum(1), [totals.documents, totals.tokens / 100, totals.tokens / 100]])
        model.classes.weights[:PAIRS] = np.log((own + 1) / (own + 1).sum())
        return model

    @property
    def prior(self) -> np.ndarray:
        """Log mass of each class's members, from which the second softmax starts."""
        return np.log(self.totals.mass + 0.02).astype(np.float32)


def _encode(fragments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number = part << 32
        letters = np.zeros(_CONTEXTS * 256, np.int64)
        names = [c.split()[0] for c in _ENCODED.split(", ")]

        def row(number: int, raw: list, letters) -> pa.RecordBatch:
            return pa.record_batch([pa.array([number], pa.int64()), *(pa.array([r], pa.binary()) for r in raw), pa.array([letters], pa.list_(pa.int64()))], names=names)

        for batch in chunks(batches, most=CHUNK):
            words = Words(batch.column("text"))
            vocab, where, local = np.unique(words.hashes(), return_index=True, return_inverse=True)
            order = np.argsort(vocab % np.uint64(fragments), kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            vocab, where, local = vocab[order], where[order], place[local]
            held = np.asarray(batch.column("held").to_numpy(zero_copy_only=False), bool)
            train = np.repeat(~held, words.counts)
            times = np.bincount(local[train], minlength=len(vocab)).astype(np.uint32)
            data, _ = _packed(words, where[times > 0])
            letters += np.bincount(_moves(data), minlength=len(letters))
            # Only these may turn out to be unseen.
            new = np.flatnonzero(times == 0)
            spelled = len(new).to_bytes(8, "little") + pack(new) + _packed(words, where[new])[0].tobytes()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("id", batch.column("id").type)])) as out:
                out.write_batch(pa.record_batch([batch.column("id")], names=["id"]))
            yield row(number, [sink.getvalue().to_pybytes(), held.tobytes(), words.counts.astype(np.uint32).tobytes(), pack(local), vocab.tobytes(), vocab.astype(np.uint32).tobytes(), times.tobytes(), spelled], None)
            number += 1
        yield row(-1 - part, [None] * 8, letters)

    return run


def _send(fragments: int):
    """A chunk's words and training counts, cut by fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, vocab, times in zip(*(batch.column(c).to_pylist() for c in ("batch", "vocab", "times")), strict=True):
                part = (np.frombuffer(vocab, np.uint64) % np.uint64(fragments)).astype(np.int64)
                if not len(part):
                    continue
                first = np.flatnonzero(np.diff(part, prepend=-1))
                ends = [*first.tolist(), len(part)]
                words, counts = ([raw[a * w : b * w] for a, b in zip(ends, ends[1:], strict=False)] for raw, w in ((vocab, 8), (times, 4)))
                yield pa.record_batch([pa.array([number] * len(first), pa.int64()), pa.array(part[first]), pa.array(words, pa.binary()), pa.array(counts, pa.binary())], names=["batch", "fragment", "words", "times"])

    return run


#: The least counts of bins 1, 2, ...
_EDGES = np.array([math.ceil(2 ** (1 + 1.5 * i)) for i in range(BINS - 1)], np.int64)


def _bin(c: np.ndarray) -> np.ndarray:
    """The frequency bin of counts: 0 for at most 1, then one for each one and a half doublings from 2 on."""
    return np.clip(np.searchsorted(_EDGES, c, "right"), 0, BINS - 1)


def _member(prints: np.ndarray) -> np.ndarray:
    """The set of each word, from bits of its hash that neither fragments nor feature rows use first."""
    return ((prints >> np.uint64(24)) & np.uint64(MEMBERS - 1)).astype(np.int64)


def _add_up(group: pa.Table) -> pa.Table:
    """Total counts of a fragment's words for every chunk, and a row (batch -1) with the fragment's sums."""
    words = [np.frombuffer(w, np.uint64) for w in group.column("words").to_pylist()]
    every, inverse = np.unique(np.concatenate(words), return_inverse=True)
    times = np.concatenate([np.frombuffer(t, np.uint32) for t in group.column("times").to_pylist()])
    total = np.bincount(inverse, times, len(every)).astype(np.int64)
    use = total > 0
    known = total[use]
    mass = np.bincount(_bin(known) * MEMBERS + _member(every[use]), known, BINS * MEMBERS)
    sums = np.concatenate([[known.sum(), len(known), (known == 1).sum(), (known == 2).sum()], mass]).astype(np.int64)
    ends = np.cumsum([0] + [len(w) for w in words])
    counts = [pack(total[inverse[a:b]]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    fragment = group.column("fragment")[0].as_py()
    return pa.table({"batch": pa.array([*group.column("batch").to_pylist(), -1], pa.int64()), "fragment": pa.array([fragment] * (len(counts) + 1), pa.int64()), "words": pa.array([None] * len(counts) + [sums.tobytes()], pa.binary()), "times": pa.array([*counts, None], pa.binary())})


def _sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of sums from all of a task's."""
    total = np.zeros(4 + BINS * MEMBERS, np.int64)
    for batch in batches:
        for raw in batch.column("words").to_pylist():
            total += np.frombuffer(raw, np.int64)
    yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["words"])


def _gather(group: pa.Table) -> pa.Table:
    """A chunk's totals in the order of its vocabulary."""
    order = np.argsort(group.column("fragment").to_numpy())
    parts = group.column("times").to_pylist()
    return pa.table({"batch": group.column("batch")[:1], "totals": pa.array([pack(np.concatenate([unpack(parts[i]) for i in order]))], pa.binary())})


@dataclass
class Chunk:
    """A chunk's texts as tokens of its vocabulary, with the totals of that."""

    ids: bytes
    held: np.ndarray
    counts: np.ndarray
    tokens: np.ndarray
    prints: np.ndarray
    totals: np.ndarray
    spelled: bytes

    def __post_init__(self) -> None:
        n = len(self.counts)
        self.doc = np.repeat(np.arange(n, dtype=np.int32), self.counts + 1)
        self.is_end = np.zeros(len(self.doc), bool)
        self.is_end[np.cumsum(self.counts + 1) - 1] = True
        # A token's place in the vocabulary, or -1 for ends.
        self.word = np.full(len(self.doc), -1, np.int32)
        self.word[~self.is_end] = self.tokens

    @classmethod
    def read(cls, batch: pa.RecordBatch) -> Iterator[Chunk]:
        for i in range(batch.num_rows):
            ids, held, counts, tokens, prints, totals, spelled = (batch.column(c)[i].as_py() or b"" for c in ("ids", "held", "counts", "tokens", "prints", "totals", "spelled"))
            yield cls(ids, np.frombuffer(held, bool), np.frombuffer(counts, np.uint32).astype(np.int64), unpack(tokens), np.frombuffer(prints, np.uint32).astype(np.uint64), unpack(totals), spelled)

    def block(self, first: int, last: int, documents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, hash (0 for ends) and count of tokens ``first`` to ``last`` and of two before."""
        part = slice(max(0, first - 2), last)
        word, end = self.word[part], self.is_end[part]
        h, c = np.zeros(len(word), np.uint64), np.full(len(word), documents, np.int64)
        h[~end], c[~end] = self.prints[word[~end]] + np.uint64(16), self.totals[word[~end]]
        return self.doc[part], h, c

    def spellings(self, letters: np.ndarray) -> np.ndarray:
        """Log probabilities of the spelling of each word of the vocabulary that may be unseen, else 0."""
        out = np.zeros(len(self.prints))
        n = int.from_bytes(self.spelled[:8], "little")
        if n:
            out[unpack(self.spelled[8 : 8 + 8 * n])] = spelling(letters, np.frombuffer(self.spelled, np.uint8)[8 + 8 * n :])
        return out


def _features(doc: np.ndarray, h: np.ndarray, c: np.ndarray, train: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the classes' table and of the members' table by feature, and the class, of every token."""
    n = len(doc)

    def before(x: np.ndarray, k: int, fill) -> np.ndarray:
        out = np.full(n, fill, x.dtype)
        if n > k:
            same = doc[k:] == doc[:-k]
            out[k:][same] = x[:-k][same]
        return out

    def kinds(c: np.ndarray) -> np.ndarray:
        kind = _bin(c)
        kind[h == h2] = COPY_SKIP
        kind[h == h1] = COPY
        return kind

    h1, h2 = before(h, 1, 1), before(h, 2, 2)
    seen = kinds(c)
    kind = kinds(c - 1) if train else seen.copy()
    kind[h == 0] = END
    k1, k2 = before(seen, 1, CLASSES - 1), before(seen, 2, CLASSES - 1)
    room, one = np.uint64(ROWS - PAIRS), np.uint64(0x9E3779B97F4A7C15)
    keys = (mix(mix(h2 + one) ^ h1), mix(h1 * one + np.uint64(1)), mix(h2 * one + np.uint64(3)))
    rows, members = np.empty((4, n), np.uint16), np.empty((MEMBER_FEATURES, n), np.uint16)
    rows[0] = k1 * CLASSES + k2
    own = kind.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    for k, key in enumerate(keys):
        rows[k + 1] = np.uint64(PAIRS) + key % room
        if k < MEMBER_FEATURES:
            members[k] = ((key ^ own) * one >> np.uint64(24)) % np.uint64(ROWS)
    return rows, members, kind


def _softmax(weights: np.ndarray, rows: np.ndarray, prior: np.ndarray | None = None) -> np.ndarray:
    z = weights.take(rows[0], 0, mode="clip")  # faster than indexing; rows are in range
    for r in rows[1:]:
        z += weights.take(r, 0, mode="clip")
    if prior is not None:
        z += prior
    # One shift for all rows is cheaper; where a row would vanish each has its own.
    whole = np.exp(z - z.max(initial=0))
    total = whole.sum(1, keepdims=True)
    if total.min(initial=1) < 1e-20:
        whole = np.exp(z - z.max(1, keepdims=True))
        total = whole.sum(1, keepdims=True)
    whole /= total
    return whole


def _update(table: Table, used: np.ndarray, rows: np.ndarray, target: np.ndarray, rate: float, prior: np.ndarray | None = None) -> None:
    """One gradient step with a step size for each row of its own (AdaGrad)."""
    if not len(target):
        return
    g = _softmax(table.weights, rows, prior)
    g[np.arange(len(target)), target] -= 1
    for r in rows:
        order = np.argsort(r, kind="stable")
        own = r[order]
        first = np.flatnonzero(np.diff(own, prepend=np.uint16(own[0] ^ 1)))
        which = own[first]
        times = np.diff(first, append=len(own))
        pull = np.add.reduceat(g.take(order, 0, mode="clip"), first, axis=0)
        pull *= (1 / np.sqrt(times))[:, None].astype(np.float32)
        table.power[which] += np.einsum("ij,ij->i", pull, pull) / pull.shape[1]
        pull *= (rate / np.sqrt(table.power[which]))[:, None]
        table.weights[which] -= pull
        used[which] += times


def _train(shared, part: int, parts: int, rate: float):
    """Train on part ``part`` of ``parts`` of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        classes, members, prior = model.classes.copy(), model.members.copy(), model.prior
        used, member_used = np.zeros(ROWS, np.int64), np.zeros(ROWS, np.int64)
        for batch in batches:
            for chunk in Chunk.read(batch):
                steps = -(-len(chunk.doc) // STEP)
                # Whole steps, dealt in turn, so that short chunks have their part too.
                for step in range((part + len(chunk.doc)) % parts, steps, parts):
                    first = step * STEP
                    last = min(first + STEP, len(chunk.doc))
                    doc, h, c = chunk.block(first, last, model.totals.documents)
                    rows, member_rows, kind = _features(doc, h, c, True)
                    at = np.flatnonzero(~chunk.held[doc])
                    at = at[at >= first - max(0, first - 2)]
                    _update(classes, used, rows[:, at], kind[at], rate)
                    # Words that are seen elsewhere too have a set to predict.
                    at = at[(kind[at] < END) & (c[at] > 1)]
                    _update(members, member_used, member_rows[:, at], _member(h[at] - np.uint64(16)), rate, prior[kind[at]])
        size = ROWS // BLOCKS
        task = TaskContext.get().partitionId()
        raw = []
        for table, times in ((classes, used), (members, member_used)):
            raw += [table.weights.astype(np.float16), times.astype(np.float32), table.power]
        cut = [[x[b * size : (b + 1) * size].tobytes() for b in range(BLOCKS)] for x in raw]
        yield pa.record_batch([pa.array([task] * BLOCKS, pa.int32()), pa.array(range(BLOCKS), pa.int32()), *(pa.array(x, pa.binary()) for x in cut)], names=[c.split()[0] for c in _WEIGHTS.split(", ")])

    return run


def _mix_weights(group: pa.Table) -> pa.Table:
    """The average of weights and squared gradients, row by row, by use."""
    size = ROWS // BLOCKS
    out = {"part": group.column("part")[:1], "block": group.column("block")[:1]}
    for name in ("", "member_"):
        total, used, power = 0.0, 0.0, 0.0
        for w, u, g in zip(*(group.column(name + c) for c in ("weights", "used", "power")), strict=True):
            n = np.frombuffer(u.as_py(), np.float32) + 1e-9
            total = total + np.frombuffer(w.as_py(), np.float16).reshape(size, -1).astype(float) * n[:, None]
            power = power + np.frombuffer(g.as_py(), np.float32) * n
            used = used + n
        for c, x in (("weights", (total / used[:, None]).astype(np.float16)), ("used", used.astype(np.float32)), ("power", (power / used).astype(np.float32))):
            out[name + c] = pa.array([x.tobytes()], pa.binary())
    return pa.table(out)


def _log_probabilities(model: Model, chunk: Chunk, first: int, last: int, spelled: np.ndarray) -> np.ndarray:
    """Natural log probabilities of tokens ``first`` to ``last`` of a chunk."""
    t = model.totals
    doc, h, c = chunk.block(first, last, t.documents)
    rows, member_rows, kind = _features(doc, h, c, False)
    own = slice(len(doc) - (last - first), None)
    h, c, kind = h[own], c[own], kind[own]
    value = np.log(_softmax(model.classes.weights, rows[:, own])[np.arange(len(kind)), kind] + 1e-30).astype(float)
    seen = np.flatnonzero((kind < END) & (c > 0))
    member = _member(h[seen] - np.uint64(16))
    chosen = _softmax(model.members.weights, member_rows[:, own][:, seen], model.prior[kind[seen]])[np.arange(len(seen)), member]
    value[seen] += np.log(chosen + 1e-30) + np.log(c[seen] / t.mass[kind[seen], member])
    value[(kind < END) & (c == 1)] += math.log(1 - t.unseen)
    new = np.flatnonzero((kind < END) & (c < 1))
    value[new] += math.log(t.unseen) + spelled[chunk.word[first:last][new]]
    return value


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        t = model.totals
        for batch in batches:
            for chunk in Chunk.read(batch):
                n = len(chunk.counts)
                spelled = chunk.spellings(t.letters)
                score, base, known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
                for first in range(0, len(chunk.doc), STEP):
                    last = min(first + STEP, len(chunk.doc))
                    doc, _, c = (x[first - last :] for x in chunk.block(first, last, t.documents))
                    low = int(doc[0])
                    put = slice(low, int(doc[-1]) + 1)
                    score[put] += np.bincount(doc - low, _log_probabilities(model, chunk, first, last, spelled))
                    base[put] += np.bincount(doc - low, np.log10((c + 1) / (t.tokens + t.types + 1)))
                    known[put] += np.bincount(doc - low, c > 0).astype(np.int64)
                names = pa.ipc.open_stream(chunk.ids).read_all().column("id").combine_chunks()
                yield pa.record_batch([names, pa.array(chunk.held), pa.array(chunk.counts + 1), pa.array(known), pa.array(np.full(n, t.tokens)), pa.array(base), pa.array(score / np.log(10))], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, rounds: int = 1, parts: int = 4, rate: float = 0.3, fragments: int | None = None) -> DataFrame:
    """Per row: held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    given = bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (sample.fold(id_col, folds) == held).alias("held"))
    sizes = given.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count_if(~F.col("held")).alias("documents")).first()
    documents = sizes["documents"]
    fragments = fragments or min(MOST_FRAGMENTS, max(8, -(-sizes["bytes"] // FRAGMENT_BYTES)))
    encoded = storage.table(given.mapInArrow(_encode(fragments), _ENCODED), "encoded")
    moves = encoded.where("letters is not null").select(F.posexplode("letters").alias("move", "times")).where("times > 0").groupBy("move").agg(F.sum("times").alias("times"))
    letters = np.zeros(_CONTEXTS * 256)
    for r in moves.collect():
        letters[r["move"]] = r["times"]
    encoded = encoded.where("letters is null")
    sent = encoded.select("batch", "vocab", "times").mapInArrow(_send(fragments), _VOTES)
    counted = storage.table(sent.groupBy("fragment").applyInArrow(_add_up, _VOTES), "counted")
    sums = np.zeros(4 + BINS * MEMBERS, np.int64)
    for r in counted.where("batch < 0").select("words").mapInArrow(_sum_rows, "words binary").collect():
        sums += np.frombuffer(r["words"], np.int64)
    totals = Totals(int(sums[0]) + documents, int(sums[1]) + (documents > 0), documents, sums[4:].reshape(BINS, MEMBERS), int(sums[2]), int(sums[3]), letters)
    aligned = counted.where("batch >= 0").select("batch", "fragment", "times").groupBy("batch").applyInArrow(_gather, "batch long, totals binary")
    ready = storage.table(encoded.select("batch", "ids", "held", "counts", "tokens", "prints", "spelled").join(aligned, "batch", "left"), "ready")

    model = Model.from_totals(totals)
    few = max(1, math.isqrt(ready.rdd.getNumPartitions()))
    for turn in range(rounds * parts if documents else 0):
        trained = ready.mapInArrow(_train(spark.sparkContext.broadcast(model), turn % parts, parts, rate), _WEIGHTS)
        some = trained.groupBy("block", F.pmod("part", F.lit(few))).applyInArrow(_mix_weights, _WEIGHTS)
        found = sorted(some.groupBy("block").applyInArrow(_mix_weights, _WEIGHTS).collect(), key=lambda r: r["block"])
        if found:
            tables = []
            for name in ("", "member_"):
                weights = np.concatenate([np.frombuffer(r[name + "weights"], np.float16) for r in found]).astype(np.float32)
                tables.append(Table(weights.reshape(ROWS, -1), np.concatenate([np.frombuffer(r[name + "power"], np.float32) for r in found])))
            model = Model(*tables, totals)
    kind = given.schema["id"].dataType.simpleString()
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return ready.mapInArrow(_score(spark.sparkContext.broadcast(model)), schema).withColumnRenamed("id", id_col)
