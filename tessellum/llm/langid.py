"""Language identification in two steps: the family, then the language within it.

Linear support vector machines over hashed byte n-grams of words decide: one for each family against
the rest, then one for each pair of languages of the winning family, by votes.  A text's features are
sums over its words, so the machines are applied once to each distinct word of a batch.

Only the machines of the winning family are applied to a text.

Fitted on a bounded sample of labelled rows: ``bound`` a language, and ``TOTAL`` in all however many
languages there are; of a text longer than ``sample.PIECE_CHARS`` one stretch of that length is learnt
from.  All texts are predicted whole.  Null, empty and letterless texts are `und` with score 0; with no
labelled rows every text is.  Rows keep their number; copies get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.llm import sample, svm
from tessellum.llm.textcore import Words, bounded, chunks, distinct, has_letter, packed

BINS = 1 << 13
#: Labelled documents taken for fitting, for each language.
BOUND = 400
#: Labelled documents in all languages together; their features take 32 KB each.
TOTAL = 8000
#: Languages that are told apart within a family first.  A language not named is a family of its own.
FAMILIES = {
    "germanic": ("da", "de", "en", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "pl", "ru", "sk", "uk"),
}


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def _grams(data: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n-grams of 1 to 3 bytes: whether one starts at each byte, and its bin."""
    x = data.astype(np.uint32)
    n = len(x)
    inside = data != 0
    out = [(inside, (x * np.uint32(2654435761)) >> np.uint32(19))]
    if n > 1:
        two = np.zeros(n, np.uint32)
        two[:-1] = x[:-1] * 257 + x[1:] + 1
        ok = np.zeros(n, bool)
        ok[:-1] = inside[:-1] | inside[1:]
        out.append((ok, (two * np.uint32(2246822519)) >> np.uint32(19)))
    if n > 2:
        three = np.zeros(n, np.uint32)
        three[:-2] = (x[:-2] * 257 + x[1:-1]) * 257 + x[2:] + 7
        ok = np.zeros(n, bool)
        ok[:-2] = inside[1:-1]
        out.append((ok, (three * np.uint32(3266489917)) >> np.uint32(19)))
    return out


def features(words: Words) -> np.ndarray:
    """Relative n-gram frequencies of each document, one row of BINS each."""
    at, inverse = distinct(words)
    out = np.zeros((words.n_docs, BINS), np.float32)
    data, offsets = packed(words, at)
    word = np.repeat(np.arange(len(at)), np.diff(np.append(offsets, len(data) - 1)))
    pairs = [(word[ok[:-1]], h[:-1][ok[:-1]]) for ok, h in _grams(data)]
    owner, bins = (np.concatenate(p) for p in zip(*pairs, strict=True)) if len(at) else (np.zeros(0, int), np.zeros(0, int))
    order = np.argsort(owner, kind="stable")
    owner, bins = owner[order], bins[order]
    ends = np.searchsorted(owner, np.arange(len(at) + 1))
    for d in range(words.n_docs):
        own, times = np.unique(inverse[words.first[d] : words.first[d] + words.counts[d]], return_counts=True)
        if len(own):
            take = np.concatenate([bins[ends[w] : ends[w + 1]] for w in own])
            weights = np.repeat(times, ends[own + 1] - ends[own])
            out[d] = np.bincount(take, weights, BINS) / max(1, weights.sum())
    return out


@dataclass
class Model:
    """Machines as rows of ``weights`` (BINS wide) with intercepts: families first, then pairs of languages."""

    families: list[str]
    members: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    intercepts: np.ndarray

    def predict(self, words: Words) -> tuple[list[str], np.ndarray]:
        """Language and confidence of each document of a batch: its family, then votes of that family's machines."""
        at, inverse = distinct(words)
        doc, n = words.doc, words.n_docs
        k = len(self.families)
        winner, sure = np.zeros(n, int), np.ones(n)
        if k > 1:
            scores = self._outputs(words, range(k), at, inverse, doc, n)
            winner = scores.argmax(1)
            sure = _sure(scores[np.arange(n), winner])
        langs = np.empty(n, object)
        for f, family in enumerate(self.families):
            rows, own = np.flatnonzero(winner == f), self.members[family]
            langs[rows] = own[0]
            if len(own) < 2 or not len(rows):
                continue
            pairs = [p for p, (a, b) in enumerate(self.pairs) if a in own and b in own]
            # Only the words of the family's documents.
            inside = winner[doc] == f
            used, which = np.unique(inverse[inside], return_inverse=True)
            scores = self._outputs(words, [k + p for p in pairs], at[used], which, np.searchsorted(rows, doc[inside]), len(rows))
            votes, margin = np.zeros((len(rows), len(own))), np.zeros((len(rows), len(own)))
            for j, p in enumerate(pairs):
                for lang, signed in zip(self.pairs[p], (scores[:, j], -scores[:, j]), strict=True):
                    votes[:, own.index(lang)] += signed > 0
                    margin[:, own.index(lang)] += signed
            best = (votes + 1e-3 * np.tanh(margin)).argmax(1)
            langs[rows] = np.array(own, object)[best]
            sure[rows] *= _sure(margin[np.arange(len(rows)), best] / (len(own) - 1))
        return langs.tolist(), sure

    def _outputs(self, words: Words, machines, at: np.ndarray, inverse: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Outputs of some machines for n documents, given by distinct words, and word and document of each occurrence."""
        machines = list(machines)
        out = np.zeros((n, len(machines)))
        if len(at):
            data, offsets = packed(words, at)
            grams = _grams(data)
            count = sum(ok.astype(np.int64) for ok, _ in grams)
            total = np.bincount(doc, np.add.reduceat(count, offsets)[inverse], n)
            for j, m in enumerate(machines):
                value = sum(np.where(ok, self.weights[m][h], 0) for ok, h in grams)
                out[:, j] = np.bincount(doc, np.add.reduceat(value, offsets)[inverse], n)
            out /= np.maximum(total, 1)[:, None]
        return out + self.intercepts[machines]


def _sure(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(3 * margin, -50, 50)))


def fit(rows: list[tuple[str, str]]) -> Model | None:
    """Machines from (text, language) pairs; None without any."""
    rows = [(t, lang) for t, lang in rows if t]
    if not rows:
        return None
    batch = Words(pa.array([t for t, _ in rows], pa.string()))
    x = features(batch)
    langs = np.array([lang for _, lang in rows], object)
    mean, spread = x.mean(0), x.std(0) + 1e-4
    x = (x - mean) / spread / np.sqrt(BINS) * 8
    named = sorted(set(langs))
    families = sorted({family_of(lang) for lang in named})
    members = {f: [lang for lang in named if family_of(lang) == f] for f in families}
    pairs = [p for f in families for p in combinations(members[f], 2)]
    own = np.array([family_of(lang) for lang in langs], object)
    weights, intercepts = [], []

    def learn(take: np.ndarray, y: np.ndarray) -> None:
        each = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
        w, b = svm.train(x[take], y, each, 1e-3, 60)
        scaled = w / spread / np.sqrt(BINS) * 8
        weights.append(scaled.astype(np.float32))
        intercepts.append(b - float(mean @ scaled))

    if len(families) > 1:
        for f in families:
            learn(np.arange(len(rows)), np.where(own == f, 1.0, -1.0))
    else:
        weights.append(np.zeros(BINS, np.float32))
        intercepts.append(0.0)
    for a, b in pairs:
        take = np.flatnonzero((langs == a) | (langs == b))
        learn(take, np.where(langs[take] == a, 1.0, -1.0))
    return Model(families, members, pairs, np.stack(weights), np.array(intercepts))


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in chunks(batches):
            words = Words(batch.column("text"))
            if model is None:
                langs, sure = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            else:
                langs, sure = model.predict(words)
                for d in np.flatnonzero(~has_letter(words)):
                    langs[d], sure[d] = "und", 0.0
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(langs, pa.string()), pa.array(sure)], names=[*names, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2, bound: int = BOUND) -> DataFrame:
    """Per row: held_out, lang_pred, score.  Learns from rows with a language outside fold ``held``."""
    rows = bounded(docs).select(F.col(id_col), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), (sample.fold(id_col, folds) == held).alias("held_out"))
    model = sample.fit_once(sample.by_label(rows.where(~F.col("held_out")), "lang", bound, total=TOTAL), bound, fit)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, "held_out", "text").mapInArrow(_predict(shared), f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")
