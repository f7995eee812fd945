from __future__ import annotations

import hashlib
import random
import re

import pytest

from tessellum.llm import decontaminate

from .data import documents, empty, lower, rows, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(data, items, size=13):
    windows = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        for k in range(max(1, len(w) - size + 1) if w and i is not None else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = []
    for i, t, *_ in data:
        w = WORD.findall(lower(t))
        hit, met = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                found = windows.get(tuple(w[k : k + n]))
                if found:
                    met |= found
                    hit[k : k + n] = [True] * n
        h = sum(hit)
        out.append((str(i), len(w), h, len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), h > 0 and 20 * h >= len(w)))
    return sorted(out)


def cases(seed):
    rng = random.Random(seed)
    items = [(i, words(rng, rng.choice([1, 2, 5, 12, 13, 14, 40]), 12)) for i in range(15)]
    items += [(20, None), (21, ""), (22, "..."), (None, "lost item " * 10), (3, items[3][1]), (23, items[4][1].upper()), (24, "a b c"), (25, "b c"), (26, "x a b c y " * 4)]
    data = [(i, words(rng, 60, 12) + " a b c " + rng.choice([t for _, t in items if t]) + " " + words(rng, 20, 12), "en", "s", 0) for i in range(40)]
    return items, data + rows()


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    items, data = cases(seed)
    bench = spark.createDataFrame(items, "item_id long, text string")
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    for block in (decontaminate.BLOCK_BYTES, 700):
        got = decontaminate.digests(documents(spark, True, data), bench, block_bytes=block).collect()
        assert sorted((str(r["doc_id"]), *(r[c] for c in columns[1:])) for r in got) == brute(data, items)


def test_stage_and_spans(spark):
    passage = " ".join(f"secret{i}" for i in range(20))
    data = [(1, passage, "en", "s", 0), (2, "ÄÖ start. " + passage.upper() + "! " + "clean word " * 300, "en", "s", 0), (3, "nothing", "en", "s", 0), (4, None, None, None, None)]
    bench = spark.createDataFrame([(9, passage)], "item_id long, text string")
    docs = documents(spark, True, data)
    clean = decontaminate.keep_clean(docs, bench)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [2, 3, 4]
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, bench, percent=50).collect()}
    assert cut == {2: "ÄÖ start. ! " + "clean word " * 300, 3: "nothing", 4: None}


def test_empty(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.digests(empty(spark), bench).collect() == []
    assert decontaminate.digests(documents(spark), bench).where("n_hit > 0 or contaminated").count() == 0
