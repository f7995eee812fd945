from __future__ import annotations

import random

import numpy as np
import pytest

from tessellum.llm import minhash

from . import test_ngram_join as joins
from .data import documents, empty, rows


def brute(data, monkey):
    """Components by all pairs of rows, with 4-word n-grams."""
    plain = joins.shingles
    monkey.setattr(joins, "shingles", lambda text, size=4: plain(text, size))
    found = joins.brute(data)
    monkey.undo()
    return [(*r, r[0] == r[2] and r[0] != "None") for r in found]


def got(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in df.collect())


def families(seed):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    data = []
    for family in range(3):
        base = [f"b{family}_{i}" for i in range(60)]
        for _ in range(25):
            own = list(base)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(60)] = f"r{rng.randrange(10**6)}"
            data.append((len(data), " ".join(own[: rng.randrange(50, 61)]), "en", "s", 0))
    for _ in range(30):
        data.append((len(data), " ".join(passage + [f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 40))]), "en", "s", 0))
    data += [(len(data) + i, "same line here\n" * rng.randrange(1, 20), "en", "s", 0) for i in range(10)]
    # Sets of four and five n-grams that share four: exactly 0.8.
    data += [(len(data) + i, " ".join(f"s{k}" for k in range(7 + i)), "en", "s", 0) for i in range(3)]
    return data


def test_equals_brute_force(spark, monkeypatch):
    assert got(minhash.near_duplicates(documents(spark, clashes=True))) == brute(rows(), monkeypatch)


@pytest.mark.parametrize("seed", range(3))
def test_families(spark, monkeypatch, seed):
    data = families(seed)
    assert got(minhash.near_duplicates(documents(spark, data=data))) == brute(data, monkeypatch)


def test_many_templates_below_the_threshold(spark, monkeypatch):
    """Texts of one template that share most n-grams and all buckets, few of which are linked."""
    rng = random.Random(5)
    base = [f"t{i}" for i in range(100)]
    data = []
    for i in range(300):
        own = list(base)
        for at in rng.sample(range(0, 100, 6), 4):
            own[at] = f"v{rng.randrange(3)}"
        data.append((i, " ".join(own), "", "", 0))
    found = got(minhash.near_duplicates(documents(spark, data=data)))
    assert found == brute(data, monkeypatch) and len({r[2] for r in found}) > 20


def test_chain_of_near_copies(spark, monkeypatch):
    """Each text is near the next only; the component is one."""
    base = [f"w{i}" for i in range(400)]
    data = [(i, " ".join(base[i * 8 : i * 8 + 120]), "", "", 0) for i in range(30)]
    found = got(minhash.near_duplicates(documents(spark, data=data)))
    assert found == brute(data, monkeypatch) and {r[2] for r in found} == {"0"}


def test_rows_without_an_id_link_others(spark, monkeypatch):
    a = [f"a{i}" for i in range(103)]
    b = [*a[:97], *(f"b{i}" for i in range(6))]
    c = [*(f"c{i}" for i in range(7)), *b[7:]]
    data = [(1, " ".join(a), "", "", 0), (None, " ".join(b), "", "", 0), (3, " ".join(c), "", "", 0), (None, "some other words here", "", "", 0)]
    assert got(minhash.near_duplicates(documents(spark, data=data))) == brute(data, monkeypatch)


def test_signatures_are_shifted_minima():
    """Coordinate k is the least second(first(x) + k) of a set, whatever the blocks it is cut into."""
    rng = np.random.default_rng(4)
    grams = rng.integers(0, 1 << 63, 50_000, dtype=np.uint64)
    docs = np.sort(rng.choice([0, 1, 1, 1, 3], len(grams))).astype(np.int64)
    made = minhash.signatures(docs, grams, 5, 8)

    def second(values):
        return minhash.permute(values.copy(), np.empty_like(values), 0x1B873593)

    first = minhash.permute((x := (grams ^ (grams >> np.uint64(32))).astype(np.uint32)), np.empty_like(x), 0x3C6EF372)
    for d in (0, 1, 3):
        for k in range(8):
            assert made[d, k] == second(first[docs == d] + np.uint32(k)).min()
    assert (made[[2, 4]] == 0xFFFFFFFF).all()


def test_permutations_do_not_collide():
    x = np.arange(1 << 20, dtype=np.uint32)
    assert len(np.unique(minhash.permute(x, np.empty_like(x), 0x1B873593))) == 1 << 20


def test_agreement_estimates_similarity():
    """Coordinates agree as often as sets are similar, so few bands are missed."""
    rng = np.random.default_rng(5)
    misses, shares = 0, []
    for _ in range(300):
        both = rng.integers(0, 1 << 63, 80, dtype=np.uint64)
        own = [np.concatenate([both, rng.integers(0, 1 << 63, 10, dtype=np.uint64)]) for _ in range(2)]
        docs = np.repeat([0, 1], [90, 90])
        signed = minhash.signatures(docs, np.concatenate(own), 2, minhash.BANDS * minhash.ROWS)
        shares.append((signed[0] == signed[1])[: minhash.KEPT].mean())
        keys = minhash.band_keys(signed, 4)
        misses += not (keys[0] == keys[1]).any()
    assert abs(np.mean(shares) - 0.8) < 0.01 and min(shares) > minhash.AGREE / minhash.KEPT and misses == 0


def test_long_text(spark):
    rng = random.Random(8)
    long = [f"w{rng.randrange(10**6)}" for _ in range(300_000)]
    data = [(1, " ".join(long), "", "", 0), (2, " ".join(long[:270_000]), "", "", 0), (3, " ".join(long[:230_000]), "", "", 0)]
    assert [(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(documents(spark, data=data)).orderBy("doc_id").collect()] == [(1, 1), (2, 1), (3, 1)]


def test_empty(spark):
    assert minhash.near_duplicates(empty(spark)).collect() == []
