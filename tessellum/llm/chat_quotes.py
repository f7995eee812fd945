"""Chat formatting by quotation linking.

Lines of a message are parsed into nested quote levels (leading `>` marks).  The lines of a run at
one level are joined into a passage, so that it does not matter where they were wrapped.  Of each
passage are hashed, without spaces, marks and case: its sentences, its lines and the sentences of its
lines; where one of these is not found, all runs of ``SHINGLE`` words too (a letter of a script without
spaces is a word).  A join by conversation and hash finds the message each of these was first written
in; conversations without quotes take no part.  A message answers the
one that most of its outermost quoted text comes from (ties: the latest).  The result lists messages
without their quotes, each with the path of turns from its thread's first message down to itself; by
conversation and path they are in reply order, every answer right behind what it answers and before
the next answer to that.  :func:`conversations` builds the texts of that order.

Hashes meet as (conversation, hash) with the first turn that wrote them, so a line that a
conversation repeats is one row of the join however often it occurs.  Threads are found by pointer
jumping.  Built-in functions only.

Null texts are empty messages; rows of null conversation or turn take no part in links and are
threads of their own.  Repeated rows each stay.  A message cannot answer itself or a later turn.  A path
is as long as the message is deep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.llm import storage

_MARKS = r"^\s*((?:>\s*)+)"
_ATTRIBUTION = r"(?i)^\s*(on\s.{0,200}\swrote|am\s.{0,200}\sschrieb.{0,80}|le\s.{0,200}\sa écrit|el\s.{0,200}\sescribió)\s*:\s*$"
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
_WORD = rf"[{_UNSPACED}]|[\p{{L}}\p{{N}}\p{{M}}&&[^{_UNSPACED}]]+"
_SENTENCE = r"[.!?;:…]+(?=\s|$)|[。！？；：।؟]+|\n\s*\n"
#: Words of a run that proves a quotation of part of a sentence.
SHINGLE = 4
#: Keys up to which rows are chosen by a broadcast.
MOST_KEYS = 200_000


def level(line: Column) -> Column:
    """The number of quote marks before a line."""
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), r"\s", ""))


def content(line: Column) -> Column:
    """A line without its quote marks."""
    return F.regexp_replace(line, _MARKS, "")


def normalised(line: Column) -> Column:
    """Lower case, letters and digits only: what survives re-wrapping and re-quoting of a line.

    A line without any, such as an emoji, is what it is but for spaces.
    """
    words = F.regexp_replace(F.lower(content(line)), r"[^\p{L}\p{N}]+", "")
    return F.when(words != "", words).otherwise(F.regexp_replace(content(line), r"\s+", ""))


def unquoted(text: Column) -> Column:
    """A text's own lines, without quotes and the lines that announce them."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    own = F.filter(lines, lambda x: (level(x) == 0) & ~F.rlike(x, F.lit(_ATTRIBUTION)))
    return F.trim(F.regexp_replace(F.array_join(own, "\n"), r"\n{3,}", "\n\n"))


def passages(text: Column) -> Column:
    """Runs of lines at one level: their level, a mark and their lines without quote marks."""
    lines = F.transform(F.split(F.translate(text, "\1\2", "\ufffd\ufffd"), "\n", -1), lambda x: F.struct(level(x).alias("level"), content(x).alias("words")))
    before = F.concat(F.array(F.lit(-1)), F.transform(lines, lambda x: x["level"]))
    joined = F.zip_with(lines, before, lambda x, k: F.concat(F.when(x["level"] == k, "\n").otherwise(F.concat(F.lit("\1"), x["level"].cast("string"), F.lit("\2"))), x["words"]))
    return F.filter(F.split(F.array_join(joined, ""), "\1", -1), lambda x: x != "")


def pieces(text: Column) -> Column:
    """Sentences and lines of a passage, by the letters they consist of; longer ones weigh more in the vote."""
    whole = F.array_distinct(F.flatten(F.array(*(F.transform(F.split(text, cut, -1), normalised) for cut in (_SENTENCE, "\n", _SENTENCE + "|\n")))))
    return F.transform(F.filter(whole, lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("hash"), F.length(x).alias("weight")))


def shingles(words: Column) -> Column:
    """All runs of SHINGLE = 4 words."""
    hashes = F.transform(words, lambda x: F.xxhash64(x))
    pair = lambda x, k: F.filter(F.zip_with(x, F.slice(x, k, 1 << 30), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b))), lambda h: h.isNotNull())
    return F.transform(pair(pair(hashes, 2), 3), lambda h: F.struct(h.alias("hash"), F.lit(4).alias("weight")))


def _among(rows: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose columns occur in ``keys``; the other rows do not travel while these are few."""
    keys = storage.table(keys.distinct(), "keys")
    return rows.join(F.broadcast(keys) if keys.count() <= MOST_KEYS else keys, columns, "left_semi")


def _runs(rows: DataFrame) -> DataFrame:
    """(conv, turn, level, passage, run): the passages of messages and their hashes."""
    runs = rows.select("conv", "turn", F.explode(passages(F.col("text"))).alias("run"))
    runs = runs.select("conv", "turn", F.substring_index("run", "\2", 1).try_cast("int").alias("level"), F.substring_index("run", "\2", -1).alias("run"))
    return runs.select("conv", "turn", "level", F.xxhash64(normalised(F.col("run"))).alias("passage"), "run")


def _origins(units: DataFrame, quoted: DataFrame | None = None) -> DataFrame:
    """(conv, turn, level, passage, origin, weight): where units of quoted passages were first written; null is nowhere."""
    keyed = units.select("conv", "turn", "level", "passage", "unit.hash", "unit.weight")
    origins = keyed.where("level = 0").groupBy("conv", "hash").agg(F.min("turn").alias("origin"))
    cited = keyed.where("level > 0")
    if quoted is not None:
        cited = _among(cited, quoted, ["conv", "turn", "level", "passage"])
    cited = cited.groupBy("conv", "turn", "level", "passage", "hash").agg(F.sum("weight").alias("weight"))
    met = cited.join(origins, ["conv", "hash"], "left").withColumn("origin", F.when(F.col("origin") < F.col("turn"), F.col("origin")))
    return storage.table(met.groupBy("conv", "turn", "level", "passage", "origin").agg(F.sum("weight").alias("weight")), "links")


def quote_links(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """(conv, turn, level, passage, origin, weight): hashes of quoted passages and the turns their text comes from."""
    rows = messages.where(F.col(conv_col).isNotNull() & F.col(turn_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(text_col).alias("text"))
    rows = _among(rows, rows.where(F.rlike("text", F.lit(r"(?:^|\n)\s*>"))).select("conv"), ["conv"])
    whole = _origins(_runs(rows).select("conv", "turn", "level", "passage", F.explode(pieces(F.col("run"))).alias("unit")))
    # Passages of which a sentence or line was not found are looked up by runs of words too.
    left = whole.where("origin is null").select("conv", "turn", "level", "passage")
    runs = _runs(_among(rows, left.select("conv"), ["conv"]))
    # A generator, so that words are found once.
    words = runs.select("conv", "turn", "level", "passage", F.explode(F.array(F.regexp_extract_all(F.lower("run"), F.lit(_WORD), F.lit(0)))).alias("words"))
    parts = _origins(words.select("conv", "turn", "level", "passage", F.explode(shingles(F.col("words"))).alias("unit")), left)
    both = whole.unionByName(parts).where("origin is not null")
    return both.groupBy("conv", "turn", "level", "passage", "origin").agg(F.sum("weight").alias("weight"))


def reply_order(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str = "role") -> DataFrame:
    """Per message: conversation, turn, role, own text, parent_turn, thread (root turn), depth, path.

    Sorted by (conversation, path) the rows of a conversation are its reply order.
    """
    links = quote_links(messages, conv_col, turn_col, text_col)
    votes = links.groupBy("conv", "turn", "level", "origin").agg(F.sum("weight").alias("weight"))
    # The least nested level that has an origin decides.
    parents = votes.groupBy("conv", "turn").agg(F.max_by("origin", F.struct(-F.col("level"), "weight", "origin")).alias("parent"))
    parents = storage.cut(parents)
    # Each step doubles how far up a message sees: ``path`` runs from below ``root`` down to the message.
    chains = parents.select("conv", "turn", F.col("parent").alias("root"), F.array("turn").alias("path"))
    while not chains.isEmpty():
        up = chains.select("conv", F.col("turn").alias("root"), F.col("root").alias("up"), F.col("path").alias("above"))
        longer = chains.join(up, ["conv", "root"], "left")
        path = F.when(F.col("above").isNull(), F.col("path")).otherwise(F.concat("above", "path"))
        longer = storage.cut(longer.select("conv", "turn", F.coalesce("up", "root").alias("root"), path.alias("path"), F.col("up").isNotNull().alias("moved")))
        chains = longer.drop("moved")
        if longer.where("moved").isEmpty():
            break
    found = parents.join(chains, ["conv", "turn"]).select(F.col("conv").alias("_conv"), F.col("turn").alias("_turn"), "parent", "root", "path")
    own = messages.select(F.col(conv_col), F.col(turn_col).cast("long").alias(turn_col), F.col(role_col), unquoted(F.col(text_col)).alias(text_col))
    joined = own.join(found, (F.col(conv_col) == F.col("_conv")) & (F.col(turn_col) == F.col("_turn")), "left")
    thread = F.coalesce("root", F.col(turn_col))
    path = F.when(F.col("path").isNull(), F.array(F.col(turn_col))).otherwise(F.concat(F.array("root"), "path"))
    return joined.select(conv_col, turn_col, role_col, text_col, F.col("parent").alias("parent_turn"), thread.alias("thread"), (F.size(path) - 1).alias("depth"), path.alias("path"))


def conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str = "role", size: int = 256) -> DataFrame:
    """(conversation, thread, part, n_messages, text): threads in reply order, one line `role: text` or more a message.

    A thread of more than ``size`` messages has several parts, so no row gathers more than that.  Rows
    without a conversation or turn are left out; a null role is `unknown`.
    """
    ordered = reply_order(messages, conv_col, turn_col, text_col, role_col).where(F.col(conv_col).isNotNull() & F.col(turn_col).isNotNull())
    by = Window.partitionBy(conv_col, "thread").orderBy("path", role_col, text_col)
    placed = ordered.withColumn("at", F.row_number().over(by) - 1).withColumn("part", F.expr(f"at div {size}"))
    line = F.concat(F.coalesce(F.col(role_col), F.lit("unknown")), F.lit(": "), F.col(text_col))
    grouped = placed.groupBy(conv_col, "thread", "part").agg(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))).alias("lines"))
    return grouped.select(conv_col, "thread", "part", F.size("lines").alias("n_messages"), F.array_join(F.col("lines.line"), "\n").alias("text"))
