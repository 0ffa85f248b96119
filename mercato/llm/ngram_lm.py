"""Operator 10: language-model scoring with a weighted backoff automaton.

The model is a bigram model over words with absolute discounting. Its states are
the root and one state for each known word (and the end of a text, which also is
the state before the first word). A bigram hw seen in training is an arc of state
h with weight log10((c(hw) - D) / c(h)). Every other word takes the failure arc
to the root, which consumes nothing and weighs log10 of the mass that discounting
left over what the root gives to words that h has no arc for:

    D * t(h) / c(h)  over  1 - sum of p(w) over the t(h) words w seen after h

and there the root arc log10 p(w), p being the smoothed unigram of the base score.
From a state the weights sum to one over the known words and the one class of
unknown words. The state after a token is that of the token, or the root if no
training text holds it, so a text is one left-to-right walk.

Counts live in hash buckets; each block of documents gets those of its own
n-grams and so the part of the automaton that its texts can reach. In a second
exchange, over states only, one block for each distinct bigram adds it to the
sums of its state, and blocks get the sums of the states their texts fail from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import WordHashes, crc_remainder_py, mixed, word_list, written
from mercato.llm.exchange import blocked, bucket_edges, planes, steps, unplanes, unsteps

#: What each seen bigram's count gives away to the words not seen after its first word.
DISCOUNT = 0.75
#: Training reads the documents whose crc32 remainder is not this.
HELD_OUT = 1
#: The end of a text; longer than one byte and with white space, so no word equals it.
END = np.uint64(xxhash.xxh3_64_intdigest(b" end of text "))
#: Buckets report totals under this many block numbers below zero.
TOTAL_PARTS = 256
#: In place of a bucket number: a block's documents, and totals.
DOCS, TOTALS = -1, -2


def tokens_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all texts, the start of each text, and whether each text is held out."""
    hashes, parts = WordHashes(), []
    for text in table.column("text"):
        parts += [hashes.of(word_list(text.as_py())), np.array([END])]
    lengths = np.array([len(w) + 1 for w in parts[::2]], np.int64)
    held = np.array([crc_remainder_py(i) == HELD_OUT for i in table.column("doc_id").to_pylist()])
    return np.concatenate(parts), np.r_[0, np.cumsum(lengths)[:-1]], held


def grams_of(tokens: np.ndarray, starts: np.ndarray):
    """Distinct words with each token's position among them; the same for bigrams, and where each occurs first.

    The state of each token, that of the token before it, is a position among the words too.
    """
    words, word_at = np.unique(tokens, return_inverse=True)
    state_at = np.r_[0, word_at[:-1]]
    state_at[starts] = np.searchsorted(words, END)
    pairs, first, pair_at = np.unique(mixed(words[state_at] * np.uint64(0x9E3779B97F4A7C15) + tokens),
                                      return_index=True, return_inverse=True)
    return words, word_at, state_at, pairs, first, pair_at


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]):
    """For each list of keys the counts over all lists, and whether it is the first list to hold the key."""
    joined = np.concatenate(keys)
    _, first, at = np.unique(joined, return_index=True, return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64) if len(joined) else np.empty(0, np.int64)
    owned = np.zeros(len(joined), bool)
    owned[first] = True
    edges = np.cumsum([len(k) for k in keys])[:-1]
    return np.split(total[at], edges), np.split(owned, edges)


def _cells(column, read, *args) -> list[np.ndarray]:
    return [read(b.as_py(), *args) for b in column]


def _joined(cells: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(cells) if cells else np.empty(0, np.uint64)


def _table(blocks: list[int], schema: str, **columns) -> pa.Table:
    """A row for each of ``blocks`` in the order of the schema's columns; those not given are null."""
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    given = {"block": blocks, **columns}
    return pa.Table.from_arrays([pa.array(given.get(c, [None] * len(blocks)), types[t]) for c, t in fields],
                                names=[c for c, _ in fields])


ASKED = "block int, bucket int, words binary, word_counts binary, pairs binary, pair_counts binary"
ANSWERED = "block int, bucket int, word_counts binary, pair_counts binary, total long, types long"
STATES = "block int, bucket int, words binary, kinds binary, mass binary, docs binary, total long, types long"
SUMS = "block int, bucket int, kinds binary, mass binary"


def _ask(buckets: int):
    """A block's distinct words and bigrams with its training counts; no row for a bucket without any."""
    def ask(key, table):
        tokens, starts, held = tokens_of(table)
        words, word_at, _, pairs, _, pair_at = grams_of(tokens, starts)
        used = np.repeat(~held, np.diff(np.r_[starts, len(tokens)])).astype(float)
        at = [bucket_edges(k, buckets) for k in (words, pairs)]
        rows = np.flatnonzero((np.diff(at[0]) > 0) | (np.diff(at[1]) > 0))
        cols = {"bucket": rows}
        for name, keys, of, edge in (("word", words, word_at, at[0]), ("pair", pairs, pair_at, at[1])):
            counts = np.bincount(of, weights=used, minlength=len(keys)).astype(np.uint32)
            cols[f"{name}s"] = [steps(keys[edge[b]:edge[b + 1]]) for b in rows]
            cols[f"{name}_counts"] = [planes(counts[edge[b]:edge[b + 1]]) for b in rows]
        return _table([key[0].as_py()] * len(rows), ASKED, **cols)
    return ask


def _count(key, table):
    """What all blocks sent to a bucket: counts in the order asked, bigrams with the mark of the block that owns
    them, and one row of totals."""
    bucket, table = key[0].as_py(), table.sort_by("block")
    out = {}
    for name in ("word", "pair"):
        counts = [c.astype(float) for c in _cells(table.column(f"{name}_counts"), unplanes, np.uint32)]
        out[name] = _merged(_cells(table.column(f"{name}s"), unsteps), counts)
    own = [c[o] for c, o in zip(*out["word"], strict=True)]
    n = table.num_rows
    answers = _table(table.column("block").to_pylist(), ANSWERED, bucket=[bucket] * n,
                     word_counts=[planes(c.astype(np.uint64)) for c in out["word"][0]],
                     pair_counts=[planes((2 * c + o).astype(np.uint64)) for c, o in zip(*out["pair"], strict=True)])
    totals = _table([-1 - bucket % TOTAL_PARTS], ANSWERED, bucket=[bucket], total=[int(sum(c.sum() for c in own))],
                    types=[int(sum((c > 0).sum() for c in own))])
    return pa.concat_tables([answers, totals])


def _walk(buckets: int, discount: float):
    """Walk a block's texts over the arcs: all weights but those of failure arcs, which are listed by state.

    Gives the block's documents as one packed row and, for the states that it owns
    bigrams of or fails from, the number of words seen after them and their counts.
    """
    def walk(table, answers):
        if not table.num_rows:
            return _table([TOTALS], STATES, bucket=[TOTALS], total=[sum(answers.column("total").to_pylist())],
                          types=[sum(answers.column("types").to_pylist())])
        answers = answers.sort_by("bucket")
        tokens, starts, held = tokens_of(table)
        words, word_at, state_at, _, first, pair_at = grams_of(tokens, starts)
        c_word = _joined(_cells(answers.column("word_counts"), unplanes, np.uint64)).astype(float)
        marked = _joined(_cells(answers.column("pair_counts"), unplanes, np.uint64))
        c_pair, owned = (marked >> np.uint64(1)).astype(float), (marked & np.uint64(1)) == 1
        seen, c_state = c_pair[pair_at] > 0, c_word[state_at]
        fails = ~seen & (c_state > 0)
        root = np.log10(c_word + 0.5)[word_at]
        part = root.copy()
        part[seen] = np.log10((c_pair[pair_at][seen] - discount) / c_state[seen])
        part[fails] += np.log10(discount / c_state[fails])
        # the states to ask for
        mine = first[owned & (c_pair > 0)]
        kinds = np.bincount(state_at[mine], minlength=len(words)).astype(np.uint64)
        mass = np.bincount(state_at[mine], weights=c_word[word_at[mine]], minlength=len(words)).astype(np.uint64)
        asked = kinds > 0
        asked[state_at[fails]] = True
        asked = np.flatnonzero(asked)
        edge = bucket_edges(words[asked], buckets)
        rows = np.flatnonzero(np.diff(edge) > 0)
        packed = {"words": [steps(words[asked[edge[b]:edge[b + 1]]]) for b in rows]}
        for name, x in (("kinds", kinds), ("mass", mass)):
            packed[name] = [planes(x[asked[edge[b]:edge[b + 1]]]) for b in rows]
        # the documents
        add = lambda x: np.add.reduceat(x, starts)
        failed = pa.ListArray.from_arrays(
            pa.array(np.r_[0, np.cumsum(add(fails.astype(np.int64)))], pa.int32()),
            pa.array(np.searchsorted(asked, state_at[fails]), pa.int32()))
        docs = pa.Table.from_arrays([
            table.column("doc_id").combine_chunks(), pa.array(held), pa.array(np.diff(np.r_[starts, len(tokens)])),
            pa.array(add((c_word[word_at] > 0).astype(np.int64))), pa.array(add((~seen).astype(np.int64))),
            pa.array(add(root)), pa.array(add(part)), failed],
            names=["doc_id", "held_out", "n_tokens", "n_known", "roots", "base", "part", "failed"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, docs.schema) as out:
            out.write_table(docs)
        block = answers.column("block")[0].as_py()
        return pa.concat_tables([
            _table([block], STATES, bucket=[DOCS], docs=[sink.getvalue().to_pybytes()]),
            _table([block] * len(rows), STATES, bucket=rows, **packed)])
    return walk


def _sum_states(key, table):
    """The sums of each asked state over all blocks, in the order asked."""
    table = table.sort_by("block")
    keys = _cells(table.column("words"), unsteps)
    cols = {}
    for name in ("kinds", "mass"):
        values = [v.astype(float) for v in _cells(table.column(name), unplanes, np.uint64)]
        cols[name] = [planes(x.astype(np.uint64)) for x in _merged(keys, values)[0]]
    return _table(table.column("block").to_pylist(), SUMS, bucket=[key[0].as_py()] * table.num_rows, **cols)


RESULT = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double")


def _finish(n: int, types: int):
    """Add the failure arcs and the root's denominator."""
    z = n + 0.5 * (types + 1)

    def finish(left, right):
        right = right.sort_by("bucket")
        kinds, mass = (_joined(_cells(right.column(c), unplanes, np.uint64)).astype(float) for c in ("kinds", "mass"))
        # states without a seen bigram have no failures: nothing fails from them
        fail = np.log10(np.where(kinds > 0, kinds, 1)) - np.log10((z - mass - 0.5 * kinds) / z)
        docs = pa.concat_tables([pa.ipc.open_stream(b.as_py()).read_all() for b in left.column("docs")])
        failed = docs.column("failed").combine_chunks()
        sizes = failed.value_lengths().to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(docs.num_rows), sizes)
        backoff = np.bincount(doc, weights=fail[failed.flatten().to_numpy(zero_copy_only=False)], minlength=docs.num_rows)
        number = lambda c: docs.column(c).to_numpy()
        base = number("base") - number("n_tokens") * np.log10(z)
        score = number("part") + backoff - number("roots") * np.log10(z)
        return pa.Table.from_arrays([
            *(docs.column(c).combine_chunks() for c in ("doc_id", "held_out", "n_tokens", "n_known")),
            pa.array(np.full(docs.num_rows, n, np.int64)), pa.array(np.round(base, 6)), pa.array(np.round(score, 6))],
            names=[c.split()[0] for c in RESULT.split(", ")])
    return finish


def lm_scores(docs: DataFrame, discount: float = DISCOUNT) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of the whole text (A-Z lower-cased) and one end. Counts
    are over all documents whose crc32(doc_id as text) mod 5 is not 1. Null text
    counts as empty and has one token; a null id counts as empty text in the
    remainder (0: training). Rows repeated count and are scored each. With no
    training tokens every token has probability 0.5/(0 + 0.5) at the root: scores are sums of
    log10 of that, 0. An empty table gives no rows.

    The walk over the texts runs once and is written to the shared checkpoint
    folder (per document its sums and the states it fails from, per block the
    states it asks for). Two numbers, all training tokens and the distinct ones, come to the driver.
    """
    if not 0 < discount < 1:
        raise ValueError("discount must lie between 0 and 1")
    docs, buckets = blocked(docs)
    counts = docs.groupBy("block").applyInArrow(_ask(buckets), ASKED).groupBy("bucket").applyInArrow(_count, ANSWERED)
    walked = written(docs.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_walk(buckets, discount), STATES),
                     "lm-walk")
    n, types = walked.where(F.col("bucket") == TOTALS).agg(F.sum("total"), F.sum("types")).first()
    sums = walked.where("bucket >= 0").select("block", "bucket", "words", "kinds", "mass") \
        .groupBy("bucket").applyInArrow(_sum_states, SUMS)
    return (walked.where(F.col("bucket") == DOCS).select("block", "docs").groupBy("block")
            .cogroup(sums.groupBy("block")).applyInArrow(_finish(n or 0, types or 0), RESULT))


# The crc32 of the id's digits, bit by bit; then the same counts, arcs and failure arcs.
LM_SQL = r"""
WITH ids AS (
  SELECT row_number() OVER () AS r, doc_id, lower_ascii AS text,
         CASE WHEN doc_id IS NULL THEN 0 ELSE xor(list_reduce(
           list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
             lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, x: CASE WHEN x >= 0 THEN xor(c, x)
                             ELSE xor(c >> 1, 3988292384::BIGINT * (c & 1)) END), 4294967295::BIGINT) END % 5 AS fold
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
               AS lower_ascii FROM documents)),
toks AS (
  SELECT r, fold, list_append(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), ' ') AS t FROM ids),
pos AS (
  SELECT r, fold, unnest(t) AS w, unnest(list_prepend(' ', t[:-2])) AS h FROM toks),
uni AS (SELECT w, count(*) AS c FROM pos WHERE fold <> 1 GROUP BY w),
bi AS (SELECT h, w, count(*) AS c FROM pos WHERE fold <> 1 GROUP BY h, w),
tot AS (SELECT coalesce(sum(c), 0) + 0.5 * (count(*) + 1) AS z, coalesce(sum(c), 0) AS n FROM uni),
state AS (SELECT h, log10(0.75 * count(*) / s.c) - log10((z - sum(u.c) - 0.5 * count(*)) / z) AS fail
          FROM bi JOIN uni u USING (w) JOIN uni s ON s.w = bi.h, tot GROUP BY h, s.c, z),
per AS (
  SELECT r, u.c IS NOT NULL AS known, log10(coalesce(u.c, 0) + 0.5) - log10(z) AS root,
         log10((b.c - 0.75) / s.c) AS arc, coalesce(state.fail, 0) AS fail
  FROM pos LEFT JOIN uni u USING (w) LEFT JOIN uni s ON s.w = pos.h LEFT JOIN state ON state.h = pos.h
       LEFT JOIN bi b ON b.h = pos.h AND b.w = pos.w, tot),
agg AS (
  SELECT r, count(*) AS n_tokens, count(*) FILTER (known) AS n_known, sum(root) AS base_score,
         sum(coalesce(arc, fail + root)) AS score
  FROM per GROUP BY r)
SELECT doc_id, fold = 1 AS held_out, n_tokens, n_known, (SELECT n FROM tot)::BIGINT AS train_tokens,
       round(base_score, 6) AS base_score, round(score, 6) AS score
FROM ids JOIN agg USING (r)
"""
