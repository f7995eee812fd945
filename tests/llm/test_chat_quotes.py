from __future__ import annotations

import random

import pytest

from tessellum.llm import chat_quotes

SCHEMA = "conv_id long, turn long, role string, text string, root string"


def test_links_threads_and_text(spark):
    data = [
        (1, 0, "user", "Hello there my friend\nhow are things today?", "x"),
        (1, 1, "assistant", "On Monday Bob wrote:\n> how are things TODAY?\nAll is very well, thanks a lot.", "x"),
        (1, 2, "user", "A new topic about the weather", "x"),
        (1, 3, "user", "> > how are things today?\n> All is very well,  thanks a lot.\nGlad to hear", "x"),
        (1, 4, "user", ">> how are things today?\n deeper only", "x"),
        (1, 5, "user", "> never said by anyone before\nfine", "x"),
        (1, 6, "user", "> a line that is first said later on\nearly", "x"),
        (1, 7, "user", "a line that is first said later on", "x"),
        (2, 0, "user", "> how are things today?\nother conversation", "x"),
        (None, 1, None, None, None),
        (3, None, "user", "no turn at all here", None),
        (3, None, "user", "no turn at all here", None),
        (4, 0, "user", "", ""),
    ]
    out = {(r["conv_id"], r["turn"], r["text"]): (r["parent_turn"], r["thread"], r["depth"]) for r in chat_quotes.reply_order(spark.createDataFrame(data, SCHEMA)).collect()}
    assert out[(1, 1, "All is very well, thanks a lot.")] == (0, 0, 1)
    assert out[(1, 3, "Glad to hear")] == (1, 0, 2)
    assert out[(1, 4, "deeper only")] == (0, 0, 1)
    assert out[(1, 5, "fine")] == (None, 5, 0)
    assert out[(1, 6, "early")] == (None, 6, 0)
    assert out[(2, 0, "other conversation")] == (None, 0, 0)
    assert out[(None, 1, "")] == (None, 1, 0)
    assert chat_quotes.reply_order(spark.createDataFrame(data, SCHEMA)).count() == len(data)


def test_long_chain_and_common_line(spark):
    """A thread of 40 replies, in a conversation that repeats one line in every message."""
    data = [(9, i, "user", f"> this is message number {i - 1} of all\nthis is message number {i} of all\nkind regards to everyone", "") for i in range(40)]
    out = {r["turn"]: (r["parent_turn"], r["thread"], r["depth"]) for r in chat_quotes.reply_order(spark.createDataFrame(data, SCHEMA)).collect()}
    assert out == {i: (i - 1 if i else None, 0, i) for i in range(40)}


def links(spark, data):
    return {r["turn"]: (r["parent_turn"], r["thread"], r["depth"]) for r in chat_quotes.reply_order(spark.createDataFrame(data, SCHEMA)).collect()}


def test_rewrapped_and_partial_quotes(spark):
    long = "The committee met on Tuesday and agreed to move the release by two weeks, as the tests of the storage layer were not done. Nobody objected to that plan. We shall meet again in May"
    data = [
        (1, 0, "user", "Nothing but an opening that nobody quotes", ""),
        (1, 1, "user", long, ""),
        (1, 2, "user", "> The committee met on Tuesday and agreed to move\n> the release by two weeks, as the tests of the\n> storage layer were not done. Nobody objected to\n> that plan. We shall meet again in May\nre-wrapped", ""),
        (1, 3, "user", "> Nobody objected to that plan.\none sentence", ""),
        (1, 4, "user", "> [...] to move the release by\n> two weeks [...]\npart of a sentence", ""),
        (1, 5, "user", "委員会は火曜日に集まり、公開を二週間遅らせることに決めました", ""),
        (1, 6, "user", "> 委員会は火曜日に集まり、公開を\n> 二週間遅らせることに決めました\nre-wrapped without spaces", ""),
        (1, 7, "user", "first part of an own line that is\nwrapped where it was written", ""),
        (1, 8, "user", "> first part of an own line that is wrapped where it was written\njoined again", ""),
        (1, 9, "user", "> no such words anywhere else here\n> at all\nnot a quotation", ""),
    ]
    got = links(spark, data)
    assert [got[i][0] for i in range(10)] == [None, None, 1, 1, 1, None, 5, None, 7, None]


def test_short_quotes(spark):
    data = [
        (1, 0, "user", "Shall we go?\nIt is about time", ""),
        (1, 1, "user", "Yes.", ""),
        (1, 2, "user", "> Yes.\nfine", ""),
        (1, 3, "user", "はい。", ""),
        (1, 4, "user", "> はい。\n了解", ""),
        (1, 5, "user", "👍", ""),
        (1, 6, "user", "> 👍\nseen", ""),
        (1, 7, "user", "> Yes.\n> It is about time\na longer line counts for more", ""),
        (1, 8, "user", "> No.\nnever said", ""),
        (2, 0, "user", "> Yes.\nother conversation", ""),
    ]
    got = {(r["conv_id"], r["turn"]): r["parent_turn"] for r in chat_quotes.reply_order(spark.createDataFrame(data, SCHEMA)).collect()}
    assert [got[1, i] for i in range(9)] == [None, None, 1, None, 3, None, 5, 0, None] and got[2, 0] is None


def test_passages_of_levels(spark):
    data = [(1, 0, "user", "alpha beta gamma delta", ""), (1, 1, "user", "> alpha beta\n> gamma delta\nbetween\n> > deeper text\n> other text", "")]
    text = spark.createDataFrame(data, SCHEMA).where("turn = 1").select(chat_quotes.passages(chat_quotes.F.col("text")).alias("p")).first()["p"]
    assert text == ["1\2alpha beta\ngamma delta", "0\2between", "2\2deeper text", "1\2other text"]


def test_empty(spark):
    assert chat_quotes.reply_order(spark.createDataFrame([], SCHEMA)).collect() == []


def generated(rng, conversations=12, turns=25):
    """Conversations whose messages quote earlier ones in part, re-wrapped and nested, with the true parents."""
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    data, parents = [], {}
    for c in range(conversations):
        own = []
        for t in range(turns):
            sentences = [" ".join(word() for _ in range(rng.randrange(5, 14))).capitalize() + "." for _ in range(3)]
            own.append(sentences)
            lines = []
            parent = rng.randrange(t) if t and rng.random() < 0.75 else None
            parents[c, t] = parent
            if parent is not None:
                above = parents[c, parent]
                if above is not None and rng.random() < 0.5:
                    lines += [f"> > {x}" for x in own[above][:1]]
                words = " ".join(own[parent][rng.randrange(2) :]).split()
                width = rng.randrange(3, 9)
                lines += ["> " + " ".join(words[i : i + width]) for i in range(0, len(words), width)]
            data.append((c, t, rng.choice(["user", "bot"]), "\n".join([*lines, *sentences])))
    return data, parents


@pytest.mark.parametrize("seed", range(2))
def test_generated_conversations(spark, seed):
    """Parents, threads, depths and the depth-first order against a plain walk of the true tree."""
    data, parents = generated(random.Random(seed))
    df = spark.createDataFrame(data, "conv_id long, turn int, role string, text string").repartition(5)
    got = {(r["conv_id"], r["turn"]): r for r in chat_quotes.reply_order(df).collect()}
    assert {k: r["parent_turn"] for k, r in got.items()} == parents
    order = []

    def walk(c, t):
        order.append((c, t))
        for u in sorted(u for (d, u), p in parents.items() if d == c and p == t):
            walk(c, u)

    for c in sorted({c for c, *_ in data}):
        for t in sorted(t for (d, t), p in parents.items() if d == c and p is None):
            walk(c, t)
    assert sorted(got, key=lambda k: (k[0], got[k]["path"])) == order
    for (c, t), r in got.items():
        path = [t]
        while parents[c, path[0]] is not None:
            path.insert(0, parents[c, path[0]])
        assert (r["path"], r["thread"], r["depth"]) == (path, path[0], len(path) - 1)
    parts = chat_quotes.conversations(df, size=4).collect()
    assert max(r["n_messages"] for r in parts) == 4 and sum(r["n_messages"] for r in parts) == len(data)
    text = "\n".join(r["text"] for r in sorted(parts, key=lambda r: (r["conv_id"], r["thread"], r["part"])))
    own = {(c, t): "\n".join(x for x in m.split("\n") if not x.startswith(">")) for c, t, _, m in data}
    role = {(c, t): r for c, t, r, _ in data}
    assert text == "\n".join(f"{role[k]}: {own[k]}" for k in order)


def test_awkward_messages(spark):
    """Very long texts, ties between origins, repeated rows and columns that clash with names used inside."""
    long = " ".join(f"word{i}" for i in range(60_000)) + "."
    data = [(1, 0, "a", long), (1, 1, "b", "Same words in both of these."), (1, 2, "a", "Same words in both of these."), (1, 3, "b", f"> {long}\nYes."), (1, 4, "a", "> Same words in both of these.\nNo."), (1, 4, "a", "> Same words in both of these.\nNo."), (2, 0, None, None), (None, None, None, ">")]
    df = spark.createDataFrame([(*r, "x", "y", "z", "p") for r in data], "conv_id long, turn int, role string, text string, conv string, hash string, origin string, path string")
    got = chat_quotes.reply_order(df).collect()
    assert len(got) == len(data)
    assert sorted((r["turn"], r["parent_turn"]) for r in got if r["conv_id"] == 1 and r["parent_turn"] is not None) == [(3, 0), (4, 1), (4, 1)]
