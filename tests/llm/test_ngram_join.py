from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

from tessellum.llm import ngram_join

from .data import CLASHES, documents, empty, lower, rows


def shingles(text, size=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(text)) if x]
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < size else frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def brute(data):
    """Components over ids by comparing all pairs of rows."""
    sets = [(i, shingles(t)) for i, t, *_ in data]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                up[find(a)] = find(b)
    best = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        if i is not None and s:
            best[find(k)].append(i)
    return sorted((str(i), len(s), str(min(best[find(k)], default=i) if s else i)) for k, (i, s) in enumerate(sets))


def got(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in df.collect())


def test_equals_brute_force(spark):
    assert got(ngram_join.similarity_components(documents(spark, clashes=True))) == brute(rows())


@pytest.mark.parametrize("seed", range(3))
def test_dense_families(spark, seed):
    """Families whose members are linked in part only, and passages that many documents share."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    data = []
    for family in range(3):
        base = [f"b{family}_{i}" for i in range(60)]
        for _ in range(25):
            own = list(base)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(60)] = f"r{rng.randrange(10**6)}"
            data.append((len(data), " ".join(own[: rng.randrange(50, 61)]), "en", "s", 0))
    for _ in range(30):
        data.append((len(data), " ".join(passage + [f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 40))]), "en", "s", 0))
    data += [(len(data) + i, "same line here\n" * rng.randrange(1, 20), "en", "s", 0) for i in range(10)]
    assert got(ngram_join.similarity_components(documents(spark, data=data))) == brute(data)


def test_exact_threshold(spark):
    """Eight of ten n-grams shared is a link, less is not."""
    a = [f"a{i}" for i in range(13)]  # 9 n-grams
    data = [(1, " ".join(a), "", "", 0), (2, " ".join([*a, "b"]), "", "", 0), (3, " ".join([*a[:12]]), "", "", 0), (4, " ".join(["c", "d", *a[2:]]), "", "", 0)]
    assert got(ngram_join.similarity_components(documents(spark, data=data))) == brute(data)


def test_links_through_rows_without_an_id(spark):
    """a - b - c, where only b, whose id is null, is near both others."""
    a = [f"a{i}" for i in range(104)]
    b, c = [*a[:97], *(f"b{i}" for i in range(7))], [*a[:90], *(f"c{i}" for i in range(7)), *(f"b{i}" for i in range(7))]
    c = [*(f"c{i}" for i in range(7)), *b[7:]]
    for second in (None, 2):
        data = [(1, " ".join(a), "", "", 0), (second, " ".join(b), "", "", 0), (3, " ".join(c), "", "", 0), (None, " ".join(b), "", "", 0), (None, "some other words", "", "", 0)]
        assert not 100 * len(shingles(data[0][1]) & shingles(data[2][1])) >= 80 * len(shingles(data[0][1]) | shingles(data[2][1]))
        found = got(ngram_join.similarity_components(documents(spark, data=data)))
        assert found == brute(data) and [x for x in found if x[0] == "3"][0][2] == "1"


@pytest.mark.parametrize("fragments", [1, 7, 4096])
def test_any_number_of_fragments(spark, fragments):
    assert got(ngram_join.similarity_components(documents(spark), fragments=fragments)) == brute(rows())


def test_many_templates_below_the_threshold(spark):
    """Two thousand texts of one template that share most n-grams, few of which are linked."""
    rng = random.Random(5)
    base = [f"t{i}" for i in range(100)]
    data = []
    for i in range(2000):
        own = list(base)
        for at in rng.sample(range(0, 100, 6), 4):  # each change costs five of 96 n-grams
            own[at] = f"v{rng.randrange(3)}"
        data.append((i, " ".join(own), "", "", 0))
    sets = {}
    for i, t, *_ in data:
        sets.setdefault(shingles(t), []).append(i)
    classes = list(sets)
    up = list(range(len(classes)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(len(classes)):
        for y in range(x):
            both = len(classes[x] & classes[y])
            if 100 * both >= 80 * (len(classes[x]) + len(classes[y]) - both):
                up[find(x)] = find(y)
    low = defaultdict(list)
    for k, s in enumerate(classes):
        low[find(k)] += sets[s]
    want = sorted((str(i), len(s), str(min(low[find(k)]))) for k, s in enumerate(classes) for i in sets[s])
    assert got(ngram_join.similarity_components(documents(spark, data=data))) == want


def test_components_of_a_chain(spark):
    nodes = spark.createDataFrame([(i,) for i in range(50)], "node long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(48)], "a long, b long")
    assert {r["node"]: r["component"] for r in ngram_join.components(nodes, edges).collect()} == {i: 0 if i < 49 else 49 for i in range(50)}


def test_deduplicate(spark):
    docs = documents(spark, clashes=True)
    kept = ngram_join.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    keep = {k for k, _, c in brute(rows()) if k == c}
    assert sorted(map(str, ids)) == sorted(keep)
    assert set(CLASHES) <= set(kept.columns)


def test_empty(spark):
    assert ngram_join.similarity_components(empty(spark)).collect() == []
    assert ngram_join.deduplicate(empty(spark)).collect() == []
