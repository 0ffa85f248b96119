"""Operator 7: chat formatting by quotation linking.

Lines that begin with > marks are quoted, as deep as they have marks. Quoted
passages (runs of lines of one depth) and the messages' own passages (their
whole text, paragraphs and lines) are hashed after normalising; a quoted passage
is joined to the first message of its conversation that wrote it. Of a trimmed
quote, which no message wrote as a whole, the longest paragraph or line that one
wrote links. A message replies to the original of its first outermost quoted
passage that has one.
Messages without quotes remain, grouped in threads: a thread is a message that
replies to nothing and all that reply to it directly or not.
"""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import map_texts, written

_MARKS = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)(.*)", re.DOTALL)


def digest(text: str) -> bytes | None:
    """128-bit hash of a passage, case of A-Z and white space aside; None where nothing is left."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return xxhash.xxh3_128_digest(b" ".join(words)) if words else None


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The text without quotes, and the quoted passages (depth, passage) in order.

    A quoted line is cut from its marks; an empty quoted line ends no passage. A
    line of another depth begins a new passage, so a reply inside a quote and
    what it quotes are passages of their own.
    """
    own, quoted = [], []
    depth = 0
    for line in text.split("\n"):
        m = _MARKS.fullmatch(line)
        if not m:
            own.append(line)
            depth = 0
            continue
        now = m[1].count(">")
        if now == depth:
            quoted[-1][1].append(m[2])
        else:
            quoted.append((now, [m[2]]))
        depth = now
    clean = "\n".join(own)
    if quoted:
        clean = re.sub(r"\n{3,}", "\n\n", clean).strip("\n")
    return clean, [(d, "\n".join(lines)) for d, lines in quoted]


def passages(text: str) -> dict[bytes, int]:
    """Hashes of a text as a whole, by paragraph and by line, with their words: what a reply may quote, or what is left
    of a quoted passage that was trimmed."""
    parts = [text, *re.split(r"\n[ \t\r]*\n", text), *text.split("\n")]
    return {h: len(p.encode("utf-8", "surrogatepass").split()) for p in parts if (h := digest(p)) is not None}


def _make():
    def columns(texts):
        rows = []
        for text in texts:
            clean, quoted = parse(text)
            links = [{"depth": d, "place": i, "words": n, "h": h} for i, (d, q) in enumerate(quoted)
                     for h, n in passages(q).items()]
            rows.append((clean, list(passages(clean)), links, len(quoted)))
        return list(map(list, zip(*rows, strict=True))) if rows else [[], [], [], []]

    return columns


def reply_threads(conversations: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, reply_to, thread, depth, n_quotes, n_linked, text (without quotes).

    reply_to is the turn answered (null: none), thread the turn that began the
    thread and depth the number of replies from there. A message only answers an
    earlier turn, so ordering a conversation by (thread, turn) puts each message
    behind what it answers. n_quotes counts quoted passages, n_linked those with
    an original, of the whole or of a paragraph or line of it: the longest counts,
    then the earliest.

    Originals are a minimum for each (conversation, passage), aggregated map-side,
    and links a plain join on that key: a line that a third of all messages hold
    is one row there. Threads are found by pointer doubling, each round written,
    as many rounds as the logarithm of the longest chain.

    Null text counts as empty. Messages with a null conv_id or turn link to
    nothing and begin threads of their own. Of rows repeated with one conversation
    and turn each stays, with the same links where their texts are the same; the
    smallest reply holds where they differ. An empty table gives no rows.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.col("role").cast("string").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    parsed = written(map_texts(rows, _make, "clean string, own array<binary>, "
                                            "links array<struct<depth:int,place:int,words:int,h:binary>>, n_quotes long"), "parsed")
    quoted = parsed.where("conv_id is not null and turn is not null").select(
        "conv_id", "turn", F.explode("links").alias("q")).select("conv_id", "turn", "q.*")
    asked = quoted.select("conv_id", "h").distinct()
    first = parsed.where("conv_id is not null and turn is not null").select(
        "conv_id", "turn", F.explode("own").alias("h")).join(asked, ["conv_id", "h"], "left_semi").groupBy(
        "conv_id", "h").agg(F.min("turn").alias("original"))
    linked = quoted.join(first, ["conv_id", "h"]).where("original < turn")
    replies = linked.groupBy("conv_id", "turn").agg(
        F.min(F.struct("depth", "place", -F.col("words"), "original")).alias("q"), F.countDistinct("place").alias("n_linked"))
    parents = written(replies.select("conv_id", "turn", F.col("q.original").alias("reply_to"), "n_linked"), "replies")
    thread = _roots(parents)
    return parsed.join(parents, ["conv_id", "turn"], "left").join(thread, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "reply_to", F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "n_quotes",
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.col("clean").alias("text"))


def _roots(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, thread, depth) of every message that replies: each round follows twice as many links."""
    cur = written(parents.select("conv_id", "turn", F.col("reply_to").alias("thread"), F.lit(1).alias("depth"),
                                 F.lit(True).alias("open")), "pointers")
    while cur.where("open").limit(1).count():
        up = cur.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("next"), F.col("depth").alias("more"))
        cur = written(cur.join(up, ["conv_id", "thread"], "left").select(
            "conv_id", "turn", F.coalesce("next", "thread").alias("thread"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("open")),
            "pointers")
    return cur.drop("open")
