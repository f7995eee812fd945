from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest

from tessellum.llm import sharding

from .data import documents, empty, rows, text_of


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_hash_equals_the_published_loop():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2)
    for n in (1, 2, 16, 17, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [jump(int(k), n) for k in keys]
    moved = sharding.jump_hash(keys, 17) != sharding.jump_hash(keys, 16)
    assert 0.02 < moved.mean() < 0.12 and (sharding.jump_hash(keys, 17)[moved] == 16).all()
    with pytest.raises(ValueError):
        sharding.jump_hash(keys, 0)


def test_documents(spark):
    data = rows() + [(1000 + i, "the same text", "en", "s", 0) for i in range(400)]
    got = sharding.shard_documents(documents(spark, True, data)).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(i), len(text_of(t).encode()) + 1, zlib.crc32(text_of(t).encode())) for i, t, *_ in data)
    slots, homes = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        homes[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        assert r["law"] == "key" and 0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())
    again = sharding.shard_documents(documents(spark, False, data).repartition(7)).select("doc_id", "shard", "slot", "text_crc32")
    assert again.exceptAll(spark.createDataFrame([(r["doc_id"], r["shard"], r["slot"], r["text_crc32"]) for r in got], again.schema)).count() == 0


def test_empty(spark):
    assert sharding.shard_documents(empty(spark)).collect() == []


def test_rows_that_repeat_very_often_and_very_long_texts(spark):
    """Slots are gapless, sizes whole, and equal rows without an id share a shard but no window group."""
    data = [(None, "the same", "en", "s", 0)] * 2000 + [(i, "é" * 300_000 if i == 7 else f"text {i}", "en", "s", 0) for i in range(300)]
    out = sharding.shard_documents(documents(spark, data=data).repartition(8)).collect()
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(out) == 2300
    assert len({r["shard"] for r in out if r["doc_id"] is None}) == 1
    assert next(r["size"] for r in out if r["doc_id"] == 7) == 600_001
    jobs = sharding.shard_documents(documents(spark, data=data))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in jobs
