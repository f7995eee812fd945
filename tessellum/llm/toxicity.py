"""Toxicity by a subsequence string kernel, Nystrom landmarks and a support vector machine.

The kernel of two strings counts their common subsequences of three letters; each inserted letter
inside costs a factor ``DECAY``, and a subsequence spans at most ``SPAN`` letters, so gapped and
stuffed insults, with up to two letters between any two of theirs, stay close to the plain ones.
Letters are compared without case, an accent is a letter of its own before the letter, punctuation inside
a word is dropped, and look-alike digits are read as letters.

A sentence is seen as its stretches: every word, and every run of single letters or of words of at most two letters, joined over
spaces and marks, in overlapping windows of ``UNIT`` letters.  A sentence scores as its worst
stretch, a document as its worst sentence.  The machine learns from labelled documents as bags of
stretches: all of a clean document's are negative, of a toxic one those that tell it apart are positive.
It is linear in the Nystrom features of landmark strings, hence also in the subsequences: it is folded
into one table of 32 ** 3 weights, and a document costs a few look-ups for each letter of each distinct
word.  Insults of several longer words, each harmless by itself, are not seen.

Fitted on a bounded sample of labelled rows (``bound`` a label); of a text longer than
``sample.PIECE_CHARS`` one stretch of that length, chosen by a hash, is learnt from.  The fit looks at
``CHOSEN`` strings at most that explain toxic texts, ``COMMON`` of the clean ones and ``HARD`` that the machine
mistakes.  All texts are scored whole.  Null and empty texts score 0; with one label only, or none,
every text scores 0.  Rows keep their number; copies get equal scores.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessellum.llm import sample, svm
from tessellum.llm.textcore import Words, _ranges, bounded, chunks, distinct, mix, packed, text_in

DECAY = 0.6
SPAN = 8
LANDMARKS = 256
#: Labelled documents taken for fitting, for each label.
BOUND = 2000
#: Strings that the fit chooses by cover, takes from clean texts, and takes from those mistaken, at most.
CHOSEN, COMMON, HARD = 400, 1500, 1500
#: Units whose subsequences are expanded at once.
BLOCK_UNITS = 8192
#: Bytes of text scored at once; a single longer text is taken whole.
SCORE_BYTES = 1 << 20
#: Letters in one unit; longer strings are cut into overlapping windows of this size.
UNIT = 24

_BEGIN, _END = 30, 31
_CODE = np.zeros(256, np.uint8)
for _b in range(26):
    _CODE[97 + _b] = _CODE[65 + _b] = 1 + _b
# An accented Latin letter is a mark and the letter, which a gap away equals the plain one; of other
# characters beyond ASCII only the last byte counts.
_CODE[0xC3:0xC6] = 27
for _b in range(128, 192):
    _CODE[_b] = 28 + _b % 2
for _at, _letters in {0x80: "aaaaaaaceeeeiiii", 0x91: "nooooo", 0x99: "uuuuy", 0x9F: "saaaaaaaceeeeiiii", 0xB1: "nooooo", 0xB9: "uuuuy"}.items():
    for _i, _l in enumerate(_letters):
        _CODE[_at + _i] = _CODE[ord(_l)]
for _a, _b in {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}.items():
    _CODE[ord(_a)] = _CODE[ord(_b)]


def units_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the units of a batch, their sizes, and the (document, unit) pairs that occur."""
    at, inverse = distinct(words)
    data, offsets = packed(words, at)
    keep = np.zeros(len(data), bool)
    code = _CODE[data]
    keep[:-1] = code[:-1] > 0
    sizes = np.add.reduceat(keep, offsets, dtype=np.int64) if len(offsets) else np.zeros(0, np.int64)
    letters, doc = code[keep], words.doc
    run_letters, run_sizes, run_docs = _short_runs(words, letters, sizes, inverse, doc)
    # Strings are distinct words, then runs; each is cut into windows.
    letters, whole = np.concatenate([letters, run_letters]), np.concatenate([sizes, run_sizes])
    begins = np.cumsum(whole) - whole
    windows = 1 + np.maximum(0, -(-(whole - UNIT) // (UNIT // 2)))
    string = np.repeat(np.arange(len(whole)), windows)
    skipped = UNIT // 2 * _ranges(np.zeros(len(whole), np.int64), windows)
    size = np.minimum(UNIT, whole[string] - skipped)
    held = np.concatenate([inverse, len(sizes) + np.arange(len(run_sizes))]).astype(np.int64)
    docs = np.concatenate([doc, run_docs]).astype(np.int64)
    which = _ranges((np.cumsum(windows) - windows)[held], windows[held])
    return letters[_ranges(begins[string] + skipped, size)], size, np.repeat(docs, windows[held]), which


def _short_runs(words: Words, letters: np.ndarray, sizes: np.ndarray, inverse: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters, sizes and documents of runs of at least three short words; marks in between do not count.

    Runs are taken twice: of single letters, and of words of one or two letters.
    """
    n = len(inverse)
    if not n:
        return letters[:0], sizes, doc
    own = sizes[inverse]
    begins = (np.cumsum(sizes) - sizes)[inverse]
    # A sentence ends after a word with a full stop, unless that is a single letter.
    stop = np.isin(words.data[words.end - 1], [33, 46, 63]) & (own > 1)
    out = []
    for most in (1, 2):
        short = own <= most
        cut = np.ones(n, bool)
        cut[1:] = (short[1:] != short[:-1]) | (doc[1:] != doc[:-1]) | stop[:-1]
        first = np.flatnonzero(cut)
        use = short[first] & (np.add.reduceat((own > 0).astype(np.int64), first) >= 3)
        pieces = _ranges(first[use], np.diff(first, append=n)[use])
        out.append((letters[_ranges(begins[pieces], own[pieces])], np.add.reduceat(own, first)[use], doc[first[use]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _framed(letters: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes with a begin and an end mark around each unit and SPAN zeros after all; offsets; unit of each code."""
    full = sizes + 2
    offsets = np.concatenate([[0], np.cumsum(full)]).astype(np.int64)
    unit = np.repeat(np.arange(len(sizes)), full)
    out = np.zeros(int(offsets[-1]) + SPAN, np.int32)
    inner = np.ones(int(offsets[-1]), bool)
    inner[offsets[:-1]] = inner[offsets[1:] - 1] = False
    out[: len(inner)][inner] = letters
    out[offsets[:-1]], out[offsets[1:] - 1] = _BEGIN, _END
    return out, offsets[:-1], unit


def _offsets() -> list[tuple[int, int, float]]:
    return [(b, c, DECAY ** (c - 2)) for c in range(2, SPAN) for b in range(1, c)]


def subsequences(letters: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """By gap pattern: which codes start a subsequence, its number, and its weight."""
    codes, _, unit = _framed(letters, sizes)
    n = len(unit)
    owner = np.concatenate([unit, np.full(SPAN, -1)])
    for b, c, weight in _offsets():
        yield owner[c : c + n] == unit, (codes[:n] << 10) | (codes[b : b + n] << 5) | codes[c : c + n], weight


def _squares(letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The kernel of each unit with itself."""
    owner = _framed(letters, sizes)[2]
    keys, weights = [], []
    for ok, number, weight in subsequences(letters, sizes):
        keys.append((owner[ok].astype(np.int64) << 15) | number[ok])
        weights.append(np.full(len(keys[-1]), weight))
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    each = np.bincount(inverse, np.concatenate(weights))
    return np.bincount(key >> 15, each * each, len(sizes))


def margins_of(letters: np.ndarray, sizes: np.ndarray, table: np.ndarray, intercept: float, near: float = -0.3) -> np.ndarray:
    """The machine's output for each unit.

    At first a unit's length in feature space is bounded from below as if no subsequence occurred
    twice; units that come above ``near`` so get their exact length.
    """
    if len(sizes) > BLOCK_UNITS:
        begins = np.concatenate([[0], np.cumsum(sizes)])
        return np.concatenate([margins_of(letters[begins[i] : begins[min(i + BLOCK_UNITS, len(sizes))]], sizes[i : i + BLOCK_UNITS], table, intercept, near) for i in range(0, len(sizes), BLOCK_UNITS)])
    _, offsets, unit = _framed(letters, sizes)
    if not len(offsets):
        return np.zeros(0)
    value, square = np.zeros(len(unit), np.float32), np.zeros(len(unit), np.float32)
    for ok, number, weight in subsequences(letters, sizes):
        value += np.where(ok, table[number], 0) * np.float32(weight)
        square += ok * np.float32(weight * weight)
    dot, square = np.add.reduceat(value, offsets).astype(float), np.add.reduceat(square, offsets).astype(float)
    out = dot / np.sqrt(np.maximum(square, 1e-6)) + intercept
    close = np.flatnonzero(out > near)
    if len(close):
        begins = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        own = letters[_ranges(begins[close], sizes[close])]
        out[close] = dot[close] / np.sqrt(np.maximum(_squares(own, sizes[close]), 1e-6)) + intercept
    return out


def explicit(strings: list[bytes]) -> np.ndarray:
    """Normalised subsequence features of a few strings of codes; inner products of rows are kernel values."""
    out = np.zeros((len(strings), 1 << 15), np.float32)
    for i, s in enumerate(strings):
        letters, sizes = np.frombuffer(s, np.uint8), np.array([len(s)])
        for ok, number, weight in subsequences(letters, sizes):
            np.add.at(out[i], number[ok], weight)
        out[i] /= max(float(np.linalg.norm(out[i])), 1e-3)
    return out


@dataclass
class Model:
    table: np.ndarray
    intercept: float
    slope: float
    shift: float

    def margins(self, words: Words) -> np.ndarray:
        """The worst unit of each document; minus infinity without words."""
        out = np.full(words.n_docs, -np.inf)
        letters, sizes, docs, which = units_of(words)
        if len(docs):
            value = margins_of(letters, sizes, self.table, self.intercept)
            order = np.argsort(docs, kind="stable")
            docs, value = docs[order], value[which[order]]
            first = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
            out[docs[first]] = np.maximum.reduceat(value, first)
        return out

    def scores(self, words: Words) -> np.ndarray:
        m = self.margins(words)
        return np.where(np.isfinite(m), 1 / (1 + np.exp(-np.clip(self.slope * np.where(np.isfinite(m), m, 0) + self.shift, -500, 500))), 0.0)


def _witnesses(held: list[np.ndarray], labels: np.ndarray, counts: list[np.ndarray], n: list[int], ratio: float = 8.0) -> dict[int, int]:
    """Units that explain label-1 texts, with the number of such texts that hold them.

    Greedy cover: the unit that explains most texts not yet explained, less its share of label-0
    texts, comes next; so the other words of copied texts are not taken for insults.
    """
    clean, toxic = counts
    # So often in label-1 texts that not even one of all units would be by chance.
    chance = np.log(2 * max(2, int((clean > 0).sum() + (toxic > 0).sum()))) / np.log(sum(n) / n[1])
    able = (toxic >= chance) & ((toxic + 0.5) / (n[1] + 1) > ratio * (clean + 0.5) / (n[0] + 1))
    texts = {d: held[d][able[held[d]]] for d in np.flatnonzero(labels == 1).tolist()}
    gain = np.bincount(np.concatenate([*texts.values(), np.zeros(0, np.int32)]), minlength=len(toxic)).astype(float)
    value = gain - 4 * clean * n[1] / max(1, n[0])
    chosen: set[int] = set()
    while texts and len(chosen) < CHOSEN:
        best = int(np.argmax(value))
        if value[best] < 2:
            break
        chosen.add(best)
        for d in [d for d, units in texts.items() if best in units]:
            value[texts.pop(d)] -= 1
    # Texts hold several insults; those that others have covered already count too if they hardly occur elsewhere.
    return {int(u): int(toxic[u]) for u in np.flatnonzero(able) if u in chosen or 50 * clean[u] * n[1] <= toxic[u] * n[0]}


def _without_copies(held: list[np.ndarray], strings: list[bytes]) -> np.ndarray:
    """A mask of one text of each group of near copies, by banded minimum hashes of its units."""
    seeds = mix(np.arange(1, 49, dtype=np.uint64))
    hashes = np.array([zlib.crc32(u) for u in strings], np.uint64)
    seen: set[tuple] = set()
    keep = np.zeros(len(held), bool)
    for d, units in enumerate(held):
        low = mix(hashes[units][:, None] ^ seeds).min(0).reshape(8, 6) if len(units) else np.zeros((8, 6), np.uint64)
        bands = [(i, *band) for i, band in enumerate(low.tolist())]
        keep[d] = bool(len(units)) and not any(b in seen for b in bands)
        seen.update(bands)
    return keep


def fit(rows: list[tuple[str, int]], landmarks: int = LANDMARKS) -> Model | None:
    """A machine from (text, label) pairs; None unless both labels occur.

    Multiple-instance learning: units of label-0 texts are negative; of a label-1 text those that its
    class prefers strongly are positive, chosen by document counts at first and by the machine later.
    """
    rows = [(t, int(y)) for t, y in rows if t]
    labels = np.array([y for _, y in rows])
    if not len(rows) or labels.min() == labels.max():
        return None
    texts = pa.record_batch([pa.array([t for t, _ in rows], pa.string())], names=["text"])
    # Units are numbered; a text is an array of numbers, so that the sample stays small in memory.
    numbers: dict[bytes, int] = {}
    held: list[np.ndarray] = []
    for part in chunks(iter([texts]), most=1 << 19):
        letters, sizes, docs, which = units_of(Words(part.column("text")))
        begins = np.concatenate([[0], np.cumsum(sizes)])
        own = np.array([numbers.setdefault(letters[a:b].tobytes(), len(numbers)) if 2 <= b - a <= UNIT else -1 for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)], np.int64)
        pairs = np.unique((docs << 32) | (own[which] + 1))
        parts = np.split((pairs & 0xFFFFFFFF) - 1, np.searchsorted(pairs >> 32, np.arange(1, part.num_rows)))
        held += [x[x >= 0].astype(np.int32) for x in parts]
    strings = list(numbers)
    del numbers
    single = _without_copies(held, strings)
    held, labels = [s for s, one in zip(held, single, strict=True) if one], labels[single]
    if not len(labels) or labels.min() == labels.max():
        return None
    n = [int((labels == y).sum()) for y in (0, 1)]
    counts = [np.bincount(np.concatenate([s for s, x in zip(held, labels, strict=True) if x == y]), minlength=len(strings)) for y in (0, 1)]
    clear = {strings[u]: c for u, c in _witnesses(held, labels, counts, n).items()}
    times = [Counter({strings[u]: int(c[u]) for u in np.flatnonzero(c)}) for c in counts]
    del held, counts, strings
    if not clear:
        clear = {u: c for u, c in times[1].items() if not times[0][u] and c == max(times[1].values())} or dict(times[1])
    positive = sorted(clear, key=lambda u: (-clear[u], u))
    common = [u for u, _ in sorted(times[0].items(), key=lambda x: (-x[1], x[0]))]
    negative = common[: COMMON // 2] + common[COMMON // 2 :: max(1, 2 * len(common) // COMMON)]
    negative = [u for u in dict.fromkeys(negative) if u not in clear]
    table, intercept = np.zeros(1 << 15, np.float32), 0.0
    every = sorted(set(times[0]) - set(clear))
    every_letters = np.frombuffer(b"".join(every), np.uint8)
    every_sizes = np.array([len(u) for u in every], np.int64)
    hard: list[bytes] = []
    hard_set: set[bytes] = set()
    for _ in range(5):
        # Landmarks: strings of both classes, the most telling ones first.
        chosen = positive[: landmarks // 2] + negative[: landmarks - min(len(positive), landmarks // 2)]
        basis = explicit(chosen)
        values, vectors = np.linalg.eigh((basis @ basis.T).astype(np.float64))
        root = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T
        taken = positive + negative
        z = np.concatenate([explicit(taken[i : i + 128]) @ basis.T for i in range(0, len(taken), 128)]).astype(np.float64) @ root
        y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
        # Half of the negative weight lies on strings that were taken for insults.
        share = np.array([np.sqrt(clear[u]) for u in positive] + [1.0 if u in hard_set else np.sqrt(times[0][u]) for u in negative])
        is_hard = np.array([False] * len(positive) + [u in hard_set for u in negative])
        for part, total in ((y > 0, 1.0), ((y < 0) & ~is_hard, 1.0), (is_hard, 1.0)):
            share[part] *= total / max(share[part].sum(), 1e-9)
        w, intercept = svm.train(z * 4, y, share, 1e-4, 400)
        table = (4 * (root @ w) @ basis).astype(np.float32)
        # Negative strings that the machine takes for insults come in, and lead the next landmarks.
        margin = margins_of(every_letters, every_sizes, table, intercept)
        fresh = [every[i] for i in np.argsort(-margin)[:500] if margin[i] > -0.7]
        hard = list(dict.fromkeys(fresh + hard))[:HARD]
        hard_set = set(hard)
        negative = list(dict.fromkeys(hard + negative))
    model = Model(table, intercept, 1.0, 0.0)
    margins = np.concatenate([model.margins(Words(part.column("text"))) for part in chunks(iter([texts]), most=1 << 20)])[single]
    ok = np.isfinite(margins)
    model.slope, model.shift = svm.platt(margins[ok], labels[ok])
    return model


def _score(shared, column: str | tuple[str, str], below: float | None = None):
    """Add the score to batches without their plain text column; or keep rows under ``below``, unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in chunks(batches, column, most=SCORE_BYTES):
            words = Words(text_in(batch, column))
            value = np.zeros(batch.num_rows) if model is None else model.scores(words)
            if below is not None:
                yield batch.filter(pa.array(value < below))
            else:
                names = [c for c in batch.schema.names if c != column]
                yield pa.record_batch([*(batch.column(c) for c in names), pa.array(value)], names=[*names, "score"])

    return run


def fit_from(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held: int = 0, bound: int = BOUND) -> Model | None:
    """A machine from labelled rows outside fold ``held``."""
    marked = labels.where(F.col(label_col).isin(0, 1) & (sample.fold(id_col, folds) != held)).select(id_col, F.col(label_col).cast("int").alias("label"))
    return sample.fit_once(sample.by_labelled_id(docs, marked, id_col, text_col, "label", bound), bound, fit)


def with_scores(docs: DataFrame, model: Model | None, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text in column ``name``, which replaces one of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = bounded(docs.drop(name))
    given = docs.select(F.struct(*docs.columns).alias("row"))
    scored = given.mapInArrow(_score(shared, ("row", text_col)), T.StructType([*given.schema.fields, T.StructField("score", T.DoubleType())]))
    return scored.select("row.*", F.col("score").alias(name))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 0, bound: int = BOUND) -> DataFrame:
    """Per row: held_out, score, predicted."""
    model = fit_from(docs, labels, id_col, text_col, folds=folds, held=held, bound=bound)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = bounded(docs).select(id_col, (sample.fold(id_col, folds) == held).alias("held_out"), F.col(text_col).alias("text"))
    scored = given.mapInArrow(_score(shared, "text"), T.StructType([*given.schema.fields[:2], T.StructField("score", T.DoubleType())]))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_civil(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``."""
    model = fit_from(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return bounded(docs).mapInArrow(_score(shared, text_col, threshold), docs.schema)
