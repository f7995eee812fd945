from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessellum.llm import storage, textcore
from tessellum.llm.textcore import NOT_ALPHANUMERIC, Words, chunks, has_letter, span_hashes, window_hashes


def test_tables_and_release(spark):
    root = Path(storage.shared_dir(spark).removeprefix("file:")).resolve()
    df = storage.table(spark.range(10), "numbers")
    assert df.count() == 10 and storage.cut(df.where("id > 4")).count() == 5
    made = list((root / "tessellum").glob("numbers-*"))
    assert made
    storage.release(spark)
    assert not [p for p in made if p.exists()]


def test_release_since_a_place(spark):
    root = Path(storage.shared_dir(spark).removeprefix("file:")).resolve() / "tessellum"
    storage.table(spark.range(3), "first")
    begun = storage.written()
    storage.table(spark.range(4), "second")
    last = storage.table(spark.range(5), "third")
    storage.release(spark, begun, keep=1)
    assert list(root.glob("first-*")) and not list(root.glob("second-*")) and last.count() == 5
    storage.release(spark)
    assert not list(root.glob("third-*"))


def test_row_groups_of_few_large_rows_stay_small(spark):
    """60 rows of 1 MB in one file: no row group, and so no writer or reader, holds more than its size and a row."""
    raw = np.random.default_rng(3).bytes(1 << 20)
    rows = spark.range(60, numPartitions=1).mapInArrow(lambda batches: (pa.record_batch([pa.array([raw[i:] + raw[:i]]), pa.array([i])], names=["x", "id"]) for b in batches for i in b.column("id").to_pylist()), "x binary, id long")
    made = storage.table(rows, "large")
    (file,) = (Path(f.removeprefix("file:").replace("///", "/")) for f in made.inputFiles())
    groups = pq.ParquetFile(file).metadata
    assert made.count() == 60 and max(groups.row_group(k).total_byte_size for k in range(groups.num_row_groups)) <= storage.ROW_GROUP + (1 << 21)
    storage.release(spark)


def test_a_shared_folder_is_asked_for_outside_local_mode():
    class Nothing:
        master = "spark://somewhere:7077"
        sparkContext = property(lambda self: self)
        conf = property(lambda self: self)

        def get(self, key, default):
            return default

        def getCheckpointDir(self):
            return None

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Nothing())


def test_hashes_by_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    text = " ".join("".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(1, 40, 500))
    whole = Words(pa.array([text, "y" * 300, text])).hashes()
    for size in (1, 17, 256):
        monkeypatch.setattr(textcore, "HASH_BYTES", size)
        textcore._kept_powers.cache_clear()
        assert (Words(pa.array([text, "y" * 300, text])).hashes() == whole).all()
    textcore._kept_powers.cache_clear()


def test_words_and_hashes():
    texts = ["Two  words", None, "", " lead trail ", "Größe über\tÄ", "two words"]
    w = Words(pa.array(texts))
    assert [w.text(i) for i in range(len(w.start))] == ["two", "words", "lead", "trail", "größe", "über", "Ä", "two", "words"]
    assert w.counts.tolist() == [2, 0, 0, 2, 3, 2] and w.doc.tolist() == [0, 0, 3, 3, 4, 4, 4, 5, 5]
    h = w.hashes()
    assert h[0] == h[7] and h[1] == h[8] and len(set(h.tolist())) == 7
    assert (window_hashes(h, 2)[[0]] == window_hashes(h, 2)[[7]]).all() and len(window_hashes(h[:1], 2)) == 0
    assert Words(pa.array(["a-b_c.9é"]), NOT_ALPHANUMERIC).counts.tolist() == [4]
    assert has_letter(Words(pa.array(["12", "x1", "é", "–", None]))).tolist() == [False, True, True, False, False]


def test_hashes_do_not_depend_on_place():
    rng = np.random.default_rng(0)
    words = ["".join(map(chr, rng.integers(97, 123, rng.integers(1, 12)))) for _ in range(2000)]
    a, b = Words(pa.array([" ".join(words)])), Words(pa.array([" ".join(reversed(words))]))
    assert a.hashes().tolist() == b.hashes().tolist()[::-1]
    assert len(np.unique(a.hashes())) == len(set(words))
    data = np.frombuffer(b"abcabc", np.uint8)
    assert len(set(span_hashes(data, np.array([0, 3]), np.array([3, 6])).tolist())) == 1


def test_chunks_are_bounded_and_complete():
    texts = ["x" * n for n in (10, 5000, 1, 0, 300, 300, 300)]
    batch = pa.record_batch([pa.array(texts), pa.array([{"t": t} for t in texts])], names=["text", "row"])
    for column in ("text", ("row", "t")):
        parts = list(chunks(iter([batch, batch.slice(0, 0)]), column, most=700))
        assert [t for p in parts for t in p.column("text").to_pylist()] == texts
        assert all(p.num_rows == 1 or sum(map(len, p.column("text").to_pylist())) <= 700 for p in parts)
