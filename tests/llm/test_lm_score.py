from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessellum.llm import lm_score

from .data import documents, empty, lower, rows


def tokens(text):
    return [*(w for w in re.split(r"[\x20\x09-\x0D]+", lower(text)) if w), "\n"]


def fold(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7


def test_base_is_exact(spark):
    data = rows()
    count = Counter(w for i, t, *_ in data if fold(i) != 2 for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), fold(i) == 2, len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)) for i, t, *_ in data for w in [tokens(t)])
    got = lm_score.score_documents(documents(spark, True)).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_model_learns_repetition(spark):
    data = [(i, " ".join([f"w{i % 9}"] * 30 + ["and", "then"] * 10), "en", "s", 0) for i in range(80)]
    held = [r for r in lm_score.score_documents(documents(spark, data=data)).collect() if r["held_out"]]
    assert held and sum(r["score"] for r in held) > 0.5 * sum(r["base_score"] for r in held)


def test_each_round_trains_on_every_chunk(spark):
    """With a single chunk too, a second round fits the training texts better."""
    data = [(i, " ".join(f"w{(i * 7 + k * k) % 23}" for k in range(40)), "en", "s", 0) for i in range(120)]
    docs = documents(spark, data=data).coalesce(1)
    one, two = (sum(r["score"] for r in lm_score.score_documents(docs, rounds=n).collect() if not r["held_out"]) for n in (1, 2))
    assert two > one + 0.01 * abs(one)


def hashes_of(vocab):
    import pyarrow as pa

    words = lm_score.Words(pa.array(vocab))
    return words, words.hashes().astype(np.uint32).astype(np.uint64)


def model_of(vocab, counts, documents=3, seed=0):
    """A model with random weights over a small vocabulary."""
    rng = np.random.default_rng(seed)
    counts = np.array(counts, np.int64)
    words, prints = hashes_of(vocab)
    use = counts > 0
    mass = np.bincount(lm_score._bin(counts[use]) * lm_score.MEMBERS + lm_score._member(prints[use]), counts[use], lm_score.BINS * lm_score.MEMBERS)
    letters = np.bincount(lm_score._moves(lm_score._packed(words, np.flatnonzero(use))[0]), minlength=32 * 256).astype(float)
    totals = lm_score.Totals(int(counts.sum()) + documents, int(use.sum()) + 1, documents, mass.reshape(lm_score.BINS, -1).astype(np.int64), int((counts == 1).sum()), int((counts == 2).sum()), letters)
    model = lm_score.Model.from_totals(totals)
    for table in (model.classes, model.members):
        table.weights += rng.normal(size=table.weights.shape).astype(np.float32) * 0.3
    return model


def log_probabilities(model, vocab, counts, tokens):
    """Of every token of one text, its end included."""
    words, prints = hashes_of(vocab)
    new = np.flatnonzero(np.array(counts) == 0)
    spelled = len(new).to_bytes(8, "little") + lm_score.pack(new) + lm_score._packed(words, new)[0].tobytes()
    chunk = lm_score.Chunk(b"", np.array([True]), np.array([len(tokens)]), np.array(tokens, np.int64), prints, np.array(counts, np.int64), spelled)
    return lm_score._log_probabilities(model, chunk, 0, len(chunk.doc), chunk.spellings(model.totals.letters))


def test_probabilities_sum_to_at_most_one():
    """Over the end, the whole vocabulary and thousands of distinct unseen words, after one history."""
    known = ["the", "a", "of", "word", "other", "third"]
    unseen = [x + y + z for x in "abcdefghij" for y in "abcdefghij" for z in ["", *"abcdefghijklmnopqrst"]] + list("bcdefghij")
    vocab, counts = known + unseen, [5, 1, 1, 40, 2, 9] + [0] * len(unseen)
    model = model_of(known, counts[:6])
    history = [3, 0]
    total, of_known = math.exp(log_probabilities(model, vocab, counts, history)[-1]), 0.0
    for w in range(len(vocab)):
        p = math.exp(log_probabilities(model, vocab, counts, [*history, w])[2])
        total += p
        of_known += p if w < 6 else 0
    assert 0 < of_known < total <= 1 + 1e-6


def test_scores_equal_a_plain_computation():
    """Feature by feature, with Python numbers."""
    vocab = ["the", "a", "of", "word", "other", "third", "new"]
    counts = [5, 1, 1, 40, 2, 9, 0]
    model = model_of(vocab, counts)
    _, prints = hashes_of(vocab)
    text = [3, 0, 0, 3, 5, 3, 6, 1, 2, 4]
    mask = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    def chosen(table, rows, prior, at):
        z = [sum(float(table.weights[r, j]) for r in rows) + (float(prior[j]) if prior is not None else 0) for j in range(table.weights.shape[1])]
        top = max(z)
        return z[at] - top - math.log(sum(math.exp(x - top) for x in z))

    one, own = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
    hashes = [int(prints[w]) + 16 for w in text] + [0]
    count = [counts[w] for w in text] + [3]
    classes = lm_score.CLASSES
    room = lm_score.ROWS - classes**2

    def kind(i):
        if hashes[i] == 0:
            return lm_score.END
        h1, h2 = (hashes[i - k] if i >= k else k for k in (1, 2))
        return lm_score.COPY if hashes[i] == h1 else lm_score.COPY_SKIP if hashes[i] == h2 else 0 if count[i] < 2 else 1 + int(math.log2(count[i] / 2) / 1.5)

    want = []
    for i in range(len(hashes)):
        h1, h2 = (hashes[i - k] if i >= k else k for k in (1, 2))
        k1, k2 = (kind(i - k) if i >= k else classes - 1 for k in (1, 2))
        keys = [mix(mix((h2 + one) & mask) ^ h1), mix((h1 * one + 1) & mask), mix((h2 * one + 3) & mask)]
        k = kind(i)
        p = chosen(model.classes, [k1 * classes + k2, *(classes**2 + x % room for x in keys)], None, k)
        if k < lm_score.END:
            unseen = model.totals.unseen
            if count[i]:
                m = (int(prints[text[i]]) >> 24) & 15
                rows = [((((x ^ (k * own & mask)) * one) & mask) >> 24) % lm_score.ROWS for x in keys[:2]]
                p += chosen(model.members, rows, model.prior[k], m) + math.log(count[i] / int(model.totals.mass[k, m]))
                p += math.log(1 - unseen) if count[i] == 1 else 0
            else:
                p += math.log(unseen) + float(lm_score.spelling(model.totals.letters, np.frombuffer(b"\0new\0", np.uint8))[0])
        want.append(p)
    assert np.allclose(log_probabilities(model, vocab, counts, text), want, atol=1e-4)


def texts_of_a_language(n, seed=0):
    """Texts in which each word has its own followers."""
    import random

    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = rng.randrange(200)
        text = []
        for _ in range(60):
            text.append("".join("bcdfglmnprst"[(w // 12**k) % 12] + "aeiou"[(w >> k) % 5] for k in range(3)))
            w = (7 * w + rng.randrange(3)) % 200
        out.append((i, " ".join(text), "en", "s", 0))
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_ordinary_text_beats_gibberish_and_counts(spark, parts):
    import random

    rng = random.Random(3)
    data = texts_of_a_language(600)
    held = [i for i in range(10_000, 10_200) if fold(i) == 2][:10]
    letters = "abcdefghijklmnopqrstuvwxyz"
    data += [(i, " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(60)), "en", "s", 0) for i in held]
    got = lm_score.score_documents(documents(spark, data=data).repartition(parts), rounds=3).collect()
    each = {r["doc_id"]: r["score"] / r["n_tokens"] for r in got}
    gibberish = [each[i] for i in held]
    ordinary = [r for r in got if r["held_out"] and r["doc_id"] < 10_000]
    assert max(gibberish) < min(each[r["doc_id"]] for r in ordinary)
    known = [r for r in ordinary if r["n_known"] == r["n_tokens"]]
    assert len(known) > 50 and all(r["score"] > r["base_score"] for r in known)


def test_very_long_text(spark):
    data = [*texts_of_a_language(30), (999, "word and more " * 100_000, "en", "s", 0)]
    got = {r["doc_id"]: r for r in lm_score.score_documents(documents(spark, data=data)).collect()}
    assert got[999]["n_tokens"] == 300_001 and math.isfinite(got[999]["score"])


@pytest.mark.parametrize("ids", [[], [i for i in range(200) if fold(i) == 2][:5]])
def test_without_training_rows(spark, ids):
    docs = documents(spark, data=[(i, "some words here", "en", "s", 0) for i in ids]) if ids else empty(spark)
    got = lm_score.score_documents(docs).collect()
    assert len(got) == len(ids)
    assert all(r["train_tokens"] == 0 and r["base_score"] == 0 and r["n_known"] == 0 and r["n_tokens"] == 4 and r["score"] < 0 for r in got)
