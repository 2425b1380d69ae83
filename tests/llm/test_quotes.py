"""Quotation linking on generated conversations with known parents."""

import random
import textwrap

from larkspur.llm import quotes

RNG = random.Random(9)


def words(n):
    return " ".join("w%d" % RNG.randint(0, 10**6) for _ in range(n))


def quote(text, width, mark):
    return "\n".join(mark + line for line in textwrap.wrap(text, width))


def conversation(conv, n):
    """Messages of unique words; replies quote a part of an earlier one, re-wrapped, often
    with a nested quote of that one's own parent, and with a line everybody writes."""
    own, rows, parent = [], [], {}
    for turn in range(n):
        text = "\n".join(words(RNG.randint(6, 15)) for _ in range(RNG.randint(1, 4)))
        own.append(text)
        body = text + ("\nthanks a lot" if RNG.random() < 0.5 else "")
        if turn and RNG.random() < 0.8:
            to = RNG.randrange(turn)
            parent[turn] = to
            said = own[to].split()
            at = RNG.randint(0, max(0, len(said) - 6))
            part = quote(" ".join(said[at:]).upper(), RNG.choice([12, 30, 200]), RNG.choice(["> ", ">"]))
            if to in parent and RNG.random() < 0.7:
                part = quote(own[parent[to]].replace("\n", " "), 40, "> > ") + "\n" + part
            body = part + "\n" + body
        rows.append((conv, turn, "user", body, 1, "extra"))
    return rows, {(conv, t): p for t, p in parent.items()}


def test_generated_conversations(spark):
    made = [conversation(c, 25) for c in range(12)]
    rows, want = [r for x, _ in made for r in x], {k: v for _, p in made for k, v in p.items()}
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, level int, h string").repartition(5)
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(df).collect()}
    assert {k: r.reply_to for k, r in got.items() if r.reply_to is not None} == want
    for key, r in got.items():
        depth, at = 0, key
        while at in want:
            depth, at = depth + 1, (at[0], want[at])
        assert (r.root_turn, r.depth) == (at[1], depth)
        assert ">" not in r.clean_text


def test_most_of_the_passage_decides(spark):
    rows = [(1, 0, "the first line is rather long here\nand so is this second line of it"), (1, 1, "ok"),
            (1, 2, "> the first line is rather long here\n> and so is this second line of it\n> ok\nagreed"),
            (1, 3, "> the first line\n> is rather long\n> here and so is\nwrapped"), (1, 4, "> ok\nfine"),
            (1, 5, "> rather long\na fragment"), (1, 6, "> never said by anybody in here at all\nhm"),
            (1, 7, ">\n>   \nblank"), (2, 0, "> ok\nother conversation")]
    df = spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id int, turn int, role string, text string")
    got = {(r.conv_id, r.turn): r.reply_to for r in quotes.conversations(df).collect()}
    assert got == {(1, 0): None, (1, 1): None, (1, 2): 0, (1, 3): 0, (1, 4): 1, (1, 5): None, (1, 6): None, (1, 7): None,
                   (2, 0): None}


def test_repeated_and_long(spark):
    said = words(4000)
    rows = [(1, 0, said), (1, 0, said), (1, 1, quote(said, 70, "> ") + "\nyes"), (1, 1, "no quote here"), (None, 0, "> x"), (1, None, "> x")]
    df = spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id int, turn int, role string, text string")
    out = quotes.conversations(df)
    assert out.count() == 6 and {r.reply_to for r in out.where("turn = 1 and conv_id = 1").collect()} == {0}
