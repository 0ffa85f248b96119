"""Operator 3: substring dedup by sliding sentence spans.

A text is cut into sentences (after ., ! or ? with white space behind, after
line ends, and where a sentence is longer than 16 words, after those of its words
whose hash is the least among the next three on either side: equal text is cut
alike wherever it begins). From every sentence
the shortest run of consecutive sentences with at least two sentences and 20
words is hashed forwards and backwards, so a repeated passage is covered up to
both of its ends. Runs are joined over the whole corpus; of each repeated run
the first occurrence (by doc_id, then position) stays, and every sentence that
any other occurrence covers is removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mercato.llm.common import WHITE, WordHashes, mixed
from mercato.llm.exchange import ask_and_answer, blocked, bucket_edges, planes, steps, unplanes, unsteps

#: Least sentences and least words of a run; longest sentence in words that is not cut.
RUN_SENTENCES, RUN_WORDS, SENTENCE_WORDS = 2, 20, 16
#: Words on either side that decide whether a longer sentence is cut after a word.
NEAR = 3
#: Words that are Python objects at one time.
AT_ONCE = 200_000
_IS_WHITE, _IS_END = np.zeros(256, bool), np.zeros(256, bool)
_IS_WHITE[list(WHITE.encode())] = True
_IS_END[list(b".!?")] = True
#: Odd multipliers of two running hashes and their inverses modulo 2^64.
_BASES = tuple(np.uint64(b) for b in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03))
_INVERSES = tuple(np.uint64(pow(int(b), -1, 2**64)) for b in _BASES)
_HASHES = WordHashes()


class Sentences:
    """The words and sentences of some texts, as arrays over all of them: no Python object for a sentence.

    ``data`` holds the texts' bytes one after the other, each with a line end
    behind it, ``doc_at`` where each begins (and where a next one would).
    """

    def __init__(self, texts: list[bytes]):
        self.data = b"".join(x for t in texts for x in (t, b"\n"))
        self.doc_at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        byte = np.frombuffer(self.data, np.uint8)
        white = _IS_WHITE[byte]
        edge = np.flatnonzero(white[1:] != white[:-1]) + 1
        first = [0] if len(byte) and not white[0] else []
        self.start = np.r_[np.array(first, np.int64), edge[~white[edge]]]  # of each word
        end = edge[white[edge]]
        self.hashes = self._hashed(end)
        lines = np.flatnonzero(byte == 10)
        following = np.r_[self.start[1:], len(byte)][:len(end)]
        cut = _IS_END[byte[end - 1]] | (np.searchsorted(lines, end) < np.searchsorted(lines, following))
        self._cut_long(cut)
        #: word with which each sentence begins, and one behind the last
        self.word_at = np.r_[0, np.flatnonzero(cut) + 1] if len(end) else np.zeros(1, np.int64)
        self.n = len(self.word_at) - 1
        self.doc = np.searchsorted(self.doc_at, self.start[self.word_at[:-1]], side="right") - 1
        self.of_doc = np.searchsorted(self.doc, np.arange(len(texts) + 1))  # its sentences: from here to the next one's
        # a text may begin with white space that holds a line end, or be nothing else: a sentence without words
        begin = np.r_[self.start[self.word_at[:-1]], len(byte)]
        has = self.of_doc[1:] > self.of_doc[:-1]
        lead_end = np.where(has, begin[self.of_doc[:-1]], self.doc_at[1:] - 1)
        line = np.searchsorted(lines, self.doc_at[:-1]) < np.searchsorted(lines, lead_end)
        self.lead = np.where(has, line, lead_end > self.doc_at[:-1])
        #: first byte of each sentence: white space in front without a line end belongs to it
        self.byte_at = begin[:-1]
        own = has & ~self.lead
        self.byte_at[self.of_doc[:-1][own]] = self.doc_at[:-1][own]

    def _hashed(self, end: np.ndarray) -> np.ndarray:
        """64-bit hash of each word, A-Z lower-cased."""
        out = np.empty(len(end), np.uint64)
        for i in range(0, len(end), AT_ONCE):
            j = min(i + AT_ONCE, len(end))
            out[i:j] = _HASHES.of(self.data[self.start[i]:end[j - 1]].lower().split())
        return out

    def _cut_long(self, cut: np.ndarray) -> None:
        """Cuts sentences of over 16 words after each word whose hash is the least among its neighbours in the sentence."""
        if not len(cut):
            return
        cut[-1] = True
        sentence = np.r_[0, np.cumsum(cut[:-1])]
        least = (np.bincount(sentence) > SENTENCE_WORDS)[sentence]
        h = self.hashes
        for o in range(1, NEAR + 1):
            apart = sentence[o:] != sentence[:-o]
            least[:-o] &= apart | (h[:-o] <= h[o:])
            least[o:] &= apart | (h[o:] <= h[:-o])
        cut |= least

    def kept(self, gone: np.ndarray, d: int) -> bytes:
        """Text ``d`` without the sentences that ``gone`` marks."""
        i, j = self.of_doc[d], self.of_doc[d + 1]
        first, last = self.doc_at[d], self.doc_at[d + 1] - 1
        if not gone[i:j].any():
            return self.data[first:last]
        at = [*self.byte_at[i:j].tolist(), last]
        out = [self.data[first:at[0]]]
        out += [self.data[x:y] for x, y, g in zip(at, at[1:], gone[i:j].tolist(), strict=False) if not g]
        return b"".join(out)


def sentences(text: str) -> list[str]:
    """Consecutive pieces that make up the whole text."""
    s = Sentences([text.encode("utf-8", "surrogatepass")])
    at = [0] * bool(s.lead[0]) + s.byte_at.tolist() + [len(s.data) - 1]
    return [s.data[i:j].decode("utf-8", "surrogatepass") for i, j in zip(at, at[1:], strict=False) if i < j]


def runs(s: Sentences):
    """(start, end, first hash, second hash) of every run, in sentences over all texts; runs end with their text."""
    if not s.n:
        none = np.empty(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    at = np.arange(s.n)
    first, last = s.of_doc[:-1][s.doc], s.of_doc[1:][s.doc]  # of each sentence's text
    ahead = np.maximum(np.searchsorted(s.word_at, s.word_at[:-1] + RUN_WORDS), at + RUN_SENTENCES)
    back = np.minimum(np.searchsorted(s.word_at, s.word_at[1:] - RUN_WORDS, side="right") - 1, at + 1 - RUN_SENTENCES)
    up, down = ahead <= last, back >= first
    pairs = np.unique(np.r_[at[up] << 32 | ahead[up], back[down] << 32 | at[down] + 1])
    start, end = pairs >> 32, pairs & 0xFFFFFFFF
    # a sentence's last word has another hash, so that only runs of the same sentences are the same
    h = s.hashes.copy()
    h[s.word_at[1:] - 1] = mixed(~h[s.word_at[1:] - 1])
    out = []
    for base, inverse in zip(_BASES, _INVERSES, strict=True):
        power, undo = (np.cumprod(np.r_[np.uint64(1), np.full(len(h), x)], dtype=np.uint64) for x in (base, inverse))
        sums = np.r_[np.uint64(0), np.cumsum(h * power[:-1], dtype=np.uint64)]
        out.append((sums[s.word_at[end]] - sums[s.word_at[start]]) * undo[s.word_at[start]])
    return start, end, *out


class Block:
    """The documents of a block in order, their sentences, and all runs with the place of each among the distinct ones."""

    def __init__(self, table: pa.Table):
        ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.ids = [ids[i] for i in order]
        self.sentences = Sentences([texts[i].encode("utf-8", "surrogatepass") for i in order])
        self.start, self.end, one, two = runs(self.sentences)
        two &= np.uint64(0xFFFFFFFF)  # 96 bits in all
        by = np.lexsort((self.start, two, one))
        self.start, self.end, one, two = (x[by] for x in (self.start, self.end, one, two))
        self.doc = self.sentences.doc[self.start] if self.sentences.n else self.start
        #: where each distinct run begins among the sorted ones; its first occurrence in the block stands there
        self.first = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]) if len(one) else self.start
        self.one, self.two = one[self.first], two[self.first].astype(np.uint32)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_sentences, n_removed, text (without the removed sentences).

    Case of A-Z and the kind of white space make no difference to a run. Null
    text counts as empty; empty texts and texts of one sentence stay as they
    are. Null ids come after all ids; rows repeated with one id and text are
    occurrences of their own, the first stays. A document all of whose runs are
    repeats of earlier ones loses all sentences they cover and may become empty.
    An empty table gives no rows. Whole texts take part, in blocks by a hash of
    id and text, and a run reaches the join once from each block.
    """
    docs, buckets = blocked(docs)
    late = np.iinfo(np.int64).max

    def ask(table):
        b = Block(table)
        ids = np.array([late if i is None else i for i in b.ids], np.int64)[b.doc[b.first]] if len(b.first) else b.doc
        e = bucket_edges(b.one, buckets)
        asked = np.flatnonzero(e[1:] > e[:-1])  # only these get a row, so rows are no more than runs
        edge = [(e[i], e[i + 1]) for i in asked]
        return [pa.array(asked, pa.int32()), [steps(b.one[i:j]) for i, j in edge],
                [planes(b.two[i:j]) for i, j in edge], [planes(ids[i:j]) for i, j in edge]]

    def answer(rows):
        """For each run asked: 1 where another block holds its first occurrence."""
        one = [unsteps(x.as_py()) for x in rows.column("one")]
        size = [len(x) for x in one]
        two, ids = (np.concatenate([unplanes(x.as_py(), t) for x in rows.column(c)])
                    for c, t in (("two", np.uint32), ("ids", np.int64)))
        one, block = np.concatenate(one), np.repeat(rows.column("block").to_numpy(), size)
        by = np.lexsort((block, ids, two, one))
        same = np.r_[False, (one[by][1:] == one[by][:-1]) & (two[by][1:] == two[by][:-1])] if len(one) else np.empty(0, bool)
        flag = np.empty(len(one), np.uint8)
        flag[by] = same
        return [[x.tobytes() for x in np.split(flag, np.cumsum(size)[:-1])]]

    def finish(table, answers):
        b = Block(table)
        s = b.sentences
        elsewhere = np.frombuffer(b"".join(answers.column("elsewhere").to_pylist()), np.uint8).astype(bool)
        repeat = np.ones(len(b.start), bool)
        repeat[b.first] = elsewhere
        change = np.bincount(b.start[repeat], minlength=s.n + 1) - np.bincount(b.end[repeat], minlength=s.n + 1)
        gone = np.cumsum(change)[:-1] > 0
        each = np.bincount(s.doc, minlength=len(b.ids)) + s.lead
        return pa.Table.from_arrays([
            pa.array(b.ids, pa.int64()), pa.array(each.astype(np.int64)),
            pa.array(np.bincount(s.doc, weights=gone, minlength=len(b.ids)).astype(np.int64)),
            pa.array([s.kept(gone, d).decode("utf-8", "surrogatepass") for d in range(len(b.ids))], pa.string())],
            names=["doc_id", "n_sentences", "n_removed", "text"])

    return ask_and_answer(docs, buckets, ask, "one binary, two binary, ids binary", answer, "elsewhere binary", finish,
                          "doc_id long, n_sentences long, n_removed long, text string")
