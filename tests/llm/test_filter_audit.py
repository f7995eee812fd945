from __future__ import annotations

import itertools
import random
import re
from collections import defaultdict

import pytest

from tessellum.llm import filter_audit

from .data import documents, empty, rows, text_of

LABELS = "doc_id long, quality int, toxic int, part string"


def flags(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    capitals = sum("A" <= c <= "Z" for c in text)
    return [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * capitals > 10 * len(text), bool(re.search(r"[#$%&*|]", text))]


def brute(data, labels):
    """Every order walked row by row."""
    least = {}
    for i, t, *_ in data:
        if i is not None:
            least[text_of(t)] = min(i, least.get(text_of(t), i))
    good, toxic = ({i for i, *marks in labels if i is not None and marks[k] == 1} for k in (0, 1))
    parts = defaultdict(list)
    for i, t, part, *_ in data:
        copy = i is not None and i > least[text_of(t)]
        parts[text_of(part)].append((dict(zip("ABCDE", [*flags(text_of(t)), copy], strict=True)), i in good, i in toxic))
    out = []
    for part, members in parts.items():
        total = defaultdict(int)
        own = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = members
            for step, f in enumerate(order, 1):
                gone = [m for m in left if m[0][f]]
                left = [m for m in left if not m[0][f]]
                fails = sum(m[0][f] for m in members)
                total[f] += len(gone)
                own.append((part, order, step, len(left), len(gone), fails - len(gone), sum(m[0][f] and sum(m[0].values()) == 1 for m in members), sum(m[1] for m in gone), sum(m[2] for m in gone), f))
        out += [(*r[:9], total[r[9]]) for r in own]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def sample(seed=2):
    rng = random.Random(seed)
    words = ["one", "two", "Three", "FOUR", "$5", "*", "six\tseven", "ä", " nb", "\x0b"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 160))) for _ in range(60)]
    texts += [" ".join(f"w{rng.randrange(10**6)}" for _ in range(150)) for _ in range(40)]
    data = [(i, rng.choice(texts), rng.choice(["en", "de", None, "", "fr"]), "s", 0) for i in range(400)]
    data += [(None, texts[0], "en", "s", 0)] * 3 + [(7, data[7][1], data[7][2], "s", 0)] * 2 + [(500, None, "xx", "s", 0), (501, "", "en", "s", 0), (502, texts[61] * 400, "fr", "s", 0)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "own") for i in range(0, 500, 3)] + [(3, 1, 1, "again"), (None, 1, 1, "none")]
    return data, labels


@pytest.mark.parametrize("seed", [2, 3])
def test_equals_brute_force(spark, seed):
    data, labels = sample(seed)
    found = got(filter_audit.audit(documents(spark, clashes=True, data=data), spark.createDataFrame(labels, LABELS)))
    assert found == brute(data, labels)
    assert len(found) == 600 * len({text_of(r[2]) for r in data})


def test_awkward_rows(spark):
    labels = [(1, 1, 0, ""), (65, 1, 1, "")]
    assert got(filter_audit.audit(documents(spark), spark.createDataFrame(labels, LABELS))) == brute(rows(), labels)


def test_copies_meet_as_one_row(spark):
    """However many copies a text has, its group holds a row for each part and label."""
    data = [(i, "same text", "en" if i % 2 else "de", "s", 0) for i in range(3000)]
    labels = [(i, i % 2, 0, "") for i in range(0, 3000, 5)]
    df = filter_audit.failure_counts(documents(spark, data=data), spark.createDataFrame(labels, LABELS))
    assert sum(r["n"] for r in df.collect()) == 3000
    assert sum(r["n"] for r in df.where("not E").collect()) == 1


def test_survivors_of_any_flags(spark):
    counts = spark.createDataFrame([("p", True, False, 3), ("p", False, False, 2), ("q", True, True, 1)], "part string, X boolean, Y boolean, n long")
    assert sorted(tuple(r) for r in filter_audit.survivors(counts, ["X", "Y"], ["n"]).collect()) == [("p", 0, 5), ("p", 1, 2), ("p", 2, 5), ("p", 3, 2), ("q", 0, 1), ("q", 1, 0), ("q", 2, 0), ("q", 3, 0)]


def test_empty(spark):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(empty(spark), none).collect() == []
    assert got(filter_audit.audit(documents(spark), none)) == brute(rows(), [])
