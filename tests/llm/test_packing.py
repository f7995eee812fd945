from __future__ import annotations

import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessellum.llm import packing, tokenise

from .data import documents, empty, rows, text_of


def encode(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.public_vocabulary())
    t.encode_special_tokens = True
    return [[*e.ids, 1] for e in t.encode_batch(texts, add_special_tokens=False)]


def test_round_trip(spark):
    got = packing.pack(documents(spark, clashes=True), packing.public_vocabulary(), length=256).collect()
    streams, windows = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r["ids"], np.uint16).astype("<u4")
        assert len(ids) == r["length"] > 0 and zlib.crc32(ids.tobytes()) == r["ids_crc32"]
        streams[r["doc_id"]].append((r["start"], ids.tolist(), r["doc_tokens"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    wanted = defaultdict(list)
    for (i, *_), ids in zip(rows(), encode([text_of(t) for _, t, *_ in rows()]), strict=True):
        wanted[i].append(ids)
    for i, docs in wanted.items():
        if len(docs) == 1:
            pieces = sorted(streams[i])
            assert [x for _, p, _ in pieces for x in p] == docs[0]
            assert all(start == sum(len(p) for _, p, _ in pieces[:k]) and n == len(docs[0]) for k, (start, _, n) in enumerate(pieces))
        else:
            assert sum(len(p) for _, p, _ in streams[i]) == sum(map(len, docs))
    assert sorted(windows) == list(range(len(windows)))
    for w, pieces in windows.items():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == 256 or w == len(windows) - 1


def naive(totals, targets, length, turn):
    """Deficit round-robin, round by round: (queue, position, place) of every turn."""
    service = packing.Service(totals, targets, length, turn)
    shares = np.asarray(totals if targets is None else targets, float) * (np.asarray(totals) > 0)
    left, place, out = [int(t) for t in totals], 0, []
    carried = [Fraction(float(a)) for a in service.ahead]
    while any(left):
        if not any(n and s for n, s in zip(left, shares, strict=True)):
            shares = np.array([float(t) if n else 0.0 for t, n in zip(totals, left, strict=True)])
        rates = shares / shares.sum() * length
        for q in range(len(totals)):
            if not left[q] or not rates[q]:
                continue
            carried[q] += Fraction(float(rates[q]))
            give = left[q] if carried[q] >= left[q] else int(carried[q] // turn) * turn
            if give:
                out.append((q, int(totals[q]) - left[q], give, place))
                carried[q] -= give
                left[q] -= give
                place += give
    return out


def check_service(totals, targets, length, turn):
    service = packing.Service(np.array(totals), targets, length, turn)
    queue = np.flatnonzero(np.array(totals))
    doc, start, size, window, offset = service.pieces(queue, np.zeros(len(queue), np.int64), np.array(totals)[queue], length)
    places = {(q, x): w * length + o for q, x, w, o in zip(queue[doc].tolist(), start.tolist(), window.tolist(), offset.tolist(), strict=True)}
    assert sum(size) == sum(totals)
    taken = np.zeros(sum(totals), int)
    for w, o, n in zip(window, offset, size, strict=True):
        taken[w * length + o : w * length + o + n] += 1
        assert o + n <= length
    assert (taken == 1).all()
    return places, queue[doc], size, window


@pytest.mark.parametrize("n", [*range(1, 70), 255, 256, 257, 511, 512, 513, 600])
def test_service_of_any_number_of_queues(n):
    rng = np.random.default_rng(n)
    totals = rng.integers(0, 4000, n)
    totals[0] = 5000
    check_service(totals.tolist(), None, 512, 64)
    check_service(totals.tolist(), np.where(np.arange(n) % 3 == 0, 1.0, 0.0), 512, 64)


@pytest.mark.parametrize("targets", [None, [3.0, 1.0, 0.0, 1.0, 0.0, 2.0]])
def test_service_is_deficit_round_robin(targets):
    totals = [50_000, 777, 20_000, 3, 9_000, 30]
    places, queue, size, _ = check_service(totals, targets, 512, 64)
    turns = naive(totals, targets, 512, 64)
    wanted = [np.full(t, -1) for t in totals]
    for q, x, n, place in turns:
        wanted[q][x : x + n] = np.arange(place, place + n)
    for ((q, x), place), n in zip(places.items(), size.tolist(), strict=True):
        assert (wanted[q][x : x + n] == np.arange(place, place + n)).all()
    assert sum(n for *_, n, _ in turns) == sum(totals)


@pytest.mark.parametrize("totals", [[5], [0, 7], [10**6, 3, 250_000, 1], [999, 1001, 1000], [3_000_000] + [777] * 30])
def test_windows_hold_the_proportions(totals):
    _, queue, size, window = check_service(totals, None, 2048, 256)
    held = np.zeros((window.max() + 1, len(totals)))
    np.add.at(held, (window, queue), size)
    target = np.array(totals) / sum(totals)
    # Every window but the last: a turn or two off for each queue at most, and never adrift.
    assert (np.abs(held[:-1] - 2048 * target) <= 3 * 256).all()
    drift = np.abs(np.cumsum(held, 0)[:-1] - np.arange(1, len(held))[:, None] * 2048 * target)
    assert drift.max(initial=0) <= 3 * 256


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3000), st.one_of(st.just(0.0), st.floats(1e-300, 1e300), st.floats(0.01, 100))), min_size=1, max_size=6))
def test_any_weights_leave_no_gaps(queues):
    """However far apart weights are, every token has one place and no place is empty."""
    totals, weights = [t for t, _ in queues], np.array([w for _, w in queues])
    if sum(totals):
        check_service(totals, weights, 256, 32)


@pytest.mark.parametrize("bad", [float("inf"), float("nan"), -1.0])
def test_bad_targets_are_refused(spark, bad):
    with pytest.raises(ValueError, match="finite"):
        packing.Service(np.array([10, 10]), np.array([1.0, bad]))
    with pytest.raises(ValueError, match="finite"):
        packing.pack(documents(spark), packing.public_vocabulary(), targets={"a": 1.0, "b": bad})


def test_targets_hold_until_a_queue_ends():
    _, queue, size, window = check_service([400_000, 100_000], np.array([0.5, 0.5]), 512, 64)
    early = window < 300
    assert abs(size[early & (queue == 0)].sum() / size[early].sum() - 0.5) < 0.01


def test_encoder_equals_the_library():
    import pyarrow as pa

    texts = ["", " ", "a", "  two  spaces \n\n new\tlines ", "don't we'll it's O'Neil's 'quoted'", "x y 　z  w", "<|endoftext|> inside", "naïve café – “quotes” … 数字 123abc!?", "a.b,c;d:e(f)[g]{h}<i>", " \x1c odd \x85 ends ", "word " * 500]
    coder = tokenise.Encoder(packing.public_vocabulary())
    for _ in range(2):
        ids, sizes = coder.batch(pa.array([*texts, None]), 1)
        parts = [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])]
        assert parts == encode([*texts, ""])


def test_long_texts_are_encoded_in_segments(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokenise, "SEGMENT", 64)
    coder = tokenise.Encoder(packing.public_vocabulary())
    for text in ("word, and more words. " * 40, "x" * 500, "tab\there   and\u00a0there \u3000 too " * 30, "naïve – “quotes” 数字 " * 30):
        ids, sizes = coder.batch(pa.array([text]), 1)
        assert ids.tolist() == encode([text])[0] and sizes.tolist() == [len(ids)]


def test_remembered_pieces_are_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokenise, "REMEMBERED", 50)
    coder = tokenise.Encoder(packing.public_vocabulary())
    for k in range(6):
        texts = [f"some words {k} {i} and others again" for i in range(20)]
        ids, sizes = coder.batch(pa.array(texts), 1)
        assert [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])] == encode(texts)
        assert len(coder.keys) <= 100 and len(coder.pool) < 1000


@pytest.mark.parametrize("n", [16, 600])
@pytest.mark.parametrize("targets", [None, {"source0": 0.5, "source7": 0.25, "source11": 0.25}])
def test_many_sources(spark, n, targets):
    data = [(1000 * k + i, f"some text number {i} " * 6, "en", f"source{k}", 0) for k in range(n) for i in range(60 if k in (0, 7, 11) else 2)]
    source = {i: s for i, _, _, s, _ in data}
    docs = documents(spark, data=data).repartition(4, "source")  # partitions hold sources apart
    got = packing.digests(docs, length=128, targets=targets, turn=16).collect()
    total, early = defaultdict(int), defaultdict(int)
    for r in got:
        total[source[r["doc_id"]]] += r["length"]
    assert sum(total.values()) == sum(map(len, encode([t for _, t, *_ in data])))
    # The first windows, before a source with a target ends.
    first = max(r["sequence_id"] for r in got) // 2 if targets is None else int(total["source0"] / 0.5 / 128) - 1
    assert first > 3
    for r in got:
        if r["sequence_id"] < first:
            early[source[r["doc_id"]]] += r["length"]
    shares = targets or {s: total[s] / sum(total.values()) for s in ("source0", "source7", "source11")}
    assert all(abs(early[s] / (first * 128) - x) < 0.03 for s, x in shares.items())


def test_documents_are_cut_into_useful_pieces(spark):
    data = [(i, f"some text number {i} " * 80, "en", f"source{i % 20}", 0) for i in range(200)]
    got = packing.digests(documents(spark, data=data)).collect()
    assert len(got) < 5 * len(data)


def test_empty(spark):
    assert packing.digests(empty(spark)).collect() == []
