"""Small tables with every awkward case: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns named like ones that operators use inside.
CLASHES = ["row", "found", "spans", "blob", "score", "node", "batch", "queue", "ids", "path", "label", "place", "_kept", "n_shingles"]


def words(rng: random.Random, n: int, size: int = 300) -> str:
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def rows(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    base = words(rng, 120, 5000)
    out = [(i, words(rng, rng.randrange(1, 80)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "hot", "hot", "hot"]), 0) for i in range(40)]
    for i in range(40, 60):  # a family of near copies, some linked only through others
        own = base.split()
        for _ in range(rng.randrange(0, 4)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        out.append((i, " ".join(own), "en", "hot", 0))
    out += [
        (60, None, None, None, None),
        (61, "", "en", "a", 0),
        (62, " \n\t ", "en", "a", 3),
        (63, "one two three", "en", None, 13),
        (64, "One TWO three", "de", "b", 13),
        (65, base, "en", "hot", 0),
        (66, base.upper(), "en", "hot", 0),
        (67, "zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich   　x", "de", "b", 0),
        (68, words(rng, 30_000, 20_000), "en", "a", 0),
        (69, "12345 67890 !!! ???", None, "b", 0),
        (None, "a row without an id but with some words in it", "en", "a", 0),
        (5, out[5][1], "en", "a", 0),  # a repeated row
        (7, "the same id with another text here", "en", "a", 0),
    ]
    return out


def documents(spark: SparkSession, clashes: bool = False, data: list[tuple] | None = None) -> DataFrame:
    df = spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)
    if clashes:
        from pyspark.sql import functions as F

        df = df.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHES))
    return df


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def text_of(text: str | None) -> str:
    return "" if text is None else text


def lower(text: str | None) -> str:
    return text_of(text).translate({i: i + 32 for i in range(65, 91)})
