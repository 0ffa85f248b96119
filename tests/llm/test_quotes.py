"""Quotation linking: parsing, and conversations whose replies are known."""

import random

from mercato.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string, thread string, own int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)


def test_parse_nested_levels():
    text = "Hi\n> a one\n> a two\n>> deeper\n> > deeper still\n> back\n\nown > not\n>no space\nend"
    clean, quoted = quotes.parse(text)
    assert clean == "Hi\n\nown > not\nend"
    assert quoted == [(1, "a one\na two"), (2, "deeper\ndeeper still"), (1, "back"), (1, "no space")]
    assert quotes.parse("plain\n\n\n\ntext\n") == ("plain\n\n\n\ntext\n", [])


def build(rng, n):
    """A conversation where each message may quote an earlier one, with what that one quoted nested below."""
    own, full, parent = [], [], []
    for t in range(n):
        own.append(" ".join(f"W{rng.randrange(10**6)}" for _ in range(5)) + "\nsecond line " + str(rng.random()))
        p = rng.randrange(t) if t and rng.random() < 0.7 else None
        parent.append(p)
        body = own[t]
        if p is not None:
            quoted = "\n".join("> " + x.lower() + "  " for x in own[p].split("\n"))
            if parent[p] is not None:
                quoted += "\n" + "\n".join(">> " + x for x in own[parent[p]].split("\n"))
            body = quoted + "\n" + body
        full.append(body)
    return own, full, parent


def test_known_replies(spark):
    rng = random.Random(1)
    convs = {c: build(rng, rng.choice((1, 5, 40))) for c in range(6)}
    rows = [(c, t, "user", x) for c, (_, full, _) in convs.items() for t, x in enumerate(full)]
    rng.shuffle(rows)
    got = quotes.reply_threads(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        own, _, parent = convs[r.conv_id]
        at, depth = r.turn, 0
        while parent[at] is not None:
            at, depth = parent[at], depth + 1
        assert (r.reply_to, r.thread, r.depth, r.text) == (parent[r.turn], at, depth, own[r.turn])
        assert r.n_linked == r.n_quotes == (r.reply_to is not None) + (depth > 1)


def test_long_chain_and_common_line(spark):
    rows = [(1, 0, "u", "start"), *((1, t, "u", f"> m{t - 1}\n" * (t > 1) + "> start\n" * (t == 1) + f"m{t}") for t in range(1, 70))]
    rows += [(2, t, "u", "thanks" if t < 30 else "> Thanks\nok") for t in range(60)]
    got = {(r.conv_id, r.turn): r for r in quotes.reply_threads(frame(spark, rows)).collect()}
    assert all(got[1, t].thread == 0 and got[1, t].depth == t for t in range(70))
    assert all(got[2, t].reply_to == 0 for t in range(30, 60))


def test_edge_cases(spark):
    rows = [(1, 0, None, None), (1, 1, "u", ""), (1, 2, "u", ">"), (1, 3, "u", "> unknown\nx"), (None, 0, "u", "a"),
            (None, 1, "u", "> a"), (1, None, "u", "> x"), (3, 0, "u", "q"), (3, 0, "u", "q"), (3, 1, "u", "> q\nr"),
            (3, 1, "u", "> q\nr"), (4, 1, "u", "> later"), (4, 2, "u", "later"), (5, 0, "u", "w " * 50_000)]
    got = quotes.reply_threads(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted((r.conv_id, r.turn, r.reply_to) for r in got if r.reply_to is not None) == [(3, 1, 0), (3, 1, 0)]
    assert [r.text for r in got if (r.conv_id, r.turn) == (1, 3)] == ["x"]
    assert all(r.thread == r.turn for r in got if r.reply_to is None)
    assert quotes.reply_threads(frame(spark, [])).collect() == []
    real = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert quotes.reply_threads(real).count() == real.count()


def test_trimmed_quotes_link_by_their_parts(spark):
    lines = [f"line {i} of the first message" for i in range(5)]
    pars = [f"paragraph {i} begins\nand paragraph {i} ends" for i in range(3)]
    quote = lambda text: "\n".join("> " + x for x in text.split("\n")) + "\nreply"
    rows = [(1, 0, "u", "\n".join(lines)), (1, 1, "u", "\n\n".join(pars)), (1, 2, "u", "thanks\n" + "a longer line of the third"),
            (1, 3, "u", quote("\n".join(lines[1:3]))), (1, 4, "u", quote("\n\n".join(pars[:2]))),
            (1, 5, "u", quote(pars[0] + "\n\n" + pars[2])), (1, 6, "u", quote("thanks\n" + lines[4] + "\nnever written")),
            (1, 7, "u", quote("never written\nnor this"))]
    got = {r.turn: r for r in quotes.reply_threads(frame(spark, rows)).collect()}
    assert [got[t].reply_to for t in range(8)] == [None, None, None, 0, 1, 1, 0, None]
    assert [got[t].n_linked for t in range(8)] == [0, 0, 0, 1, 1, 1, 1, 0]
    assert all(got[t].n_quotes == 1 for t in range(3, 8))
