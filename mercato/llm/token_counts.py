"""Operator 12: token counts by byte-pair merging with a heap and a linked list.

A text is marked as the SentencePiece model asks (a space becomes U+2581, one
mark in front) and cut where no merge can reach across: before each run of
marks, and inside a word between two characters that no piece of the vocabulary
holds side by side. First a pattern made from the vocabulary cuts between letters
and other characters, then what is not remembered is cut pair by pair. Each stretch is a linked list of symbols, at first one for
each character. A heap holds the adjacent pairs whose union is a piece, by the
piece's rank, then from left to right; the lowest is popped and merged until
none is left. The count is the initial symbols minus the merges: no token id is
looked up or made. A character that the vocabulary lacks is written as its UTF-8
bytes, so it is as many symbols as it has bytes and takes part in no merge.
"""

from __future__ import annotations

import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import documents, map_texts
from mercato.llm.pieces import MARK, MODEL, model_bytes

#: A text with more tokens than this is over the limit.
LIMIT = 4096
#: Piece types of the model file.
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


class Remembered(dict):
    """What ``count`` gives for each word, within about ``limit`` bytes (a cache: dropping it changes no result)."""

    def __init__(self, count, limit: int):
        self.count, self.limit, self.held = count, limit, 0

    def __missing__(self, word: str) -> int:
        n, size = self.count(word), 4 * len(word) + 120
        if size < self.limit // 100:
            self.held += size
            if self.held > self.limit:
                self.clear()
                self.held = size
            self[word] = n
        return n


class Merges:
    """The merge ranks of a byte-pair SentencePiece model, and token counts of texts.

    Only models whose texts are counted right are taken: byte-pair merging with
    all byte pieces, no normalisation but the mark in front, no piece with a mark
    behind another character, no user-defined or unused pieces.
    """

    def __init__(self, model: bytes, limit: int = 64_000_000):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm, kinds = proto.normalizer_spec, [p.type for p in proto.pieces]
        pieces = {p.piece: p.score for p in proto.pieces if p.type == _NORMAL}
        if (proto.trainer_spec.model_type != 2 or norm.name != "identity" or not norm.add_dummy_prefix
                or norm.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix
                or kinds.count(_BYTE) != 256 or set(kinds) - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}
                or any(MARK in p.lstrip(MARK) or len(p) > 255 for p in pieces)):
            raise ValueError("not a byte-pair model with byte pieces, a mark in front and no other normalisation")
        # ranks by falling score from 1, above 32 bits of a place and 8 of a size
        order = {s: r << 40 for r, s in enumerate(sorted(set(pieces.values()), reverse=True), 1)}
        self.rank = {p: order[s] for p, s in pieces.items() if len(p) > 1}
        self.alone = {p for p in pieces if len(p) == 1}
        self.side_by_side = {p[i:i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.words = self.pattern()
        self.counts = Remembered(self.of_word, limit)

    def pattern(self) -> re.Pattern:
        """What a marked text is cut into first; no pair of ``side_by_side`` lies across two of its matches."""
        if any(a.isalpha() != b.isalpha() and a != MARK for a, b in self.side_by_side):
            return re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        letters = "".join(re.escape(c) for c in sorted(self.alone) if c.isalpha())
        return re.compile(f"{MARK}*(?:[{letters}]+|[^{MARK}{letters}]+)|{MARK}+")

    def stretches(self, word: str):
        """A long word cut between characters that no piece holds side by side."""
        start, near = 0, self.side_by_side
        for i in range(1, len(word)):
            if word[i - 1:i + 1] not in near:
                yield word[start:i]
                start = i
        yield word[start:]

    def merged(self, text: str) -> int:
        """Initial symbols minus merges of one stretch."""
        n, rank = len(text), self.rank.get
        left = n if self.alone.issuperset(text) else sum(
            1 if c in self.alone else len(c.encode("utf-8", "surrogatepass")) for c in text)
        # a symbol is where it starts and its size (0: merged into the one before); a pair on the heap is its rank,
        # start and size in one number
        size, before = [1] * n, list(range(-1, n - 1))
        heap = [r | i << 8 | 2 for i in range(n - 1) if (r := rank(text[i:i + 2]))]
        heapify(heap)
        while heap:
            pair = heappop(heap)
            i, whole = pair >> 8 & 0xFFFFFFFF, pair & 255
            j = i + (s := size[i])
            if not s or j >= n or s + size[j] != whole:
                continue  # a side has been merged into another symbol since
            size[i], size[j] = whole, 0
            left -= 1
            end = i + whole
            if end < n:
                before[end] = i
                more = end + size[end]
                if r := rank(text[i:more]):
                    heappush(heap, r | i << 8 | more - i)
            h = before[i]
            if h >= 0 and (r := rank(text[h:end])):
                heappush(heap, r | h << 8 | end - h)
        return left

    def of_word(self, word: str) -> int:
        """Tokens of a word with its marks."""
        return self.merged(word) if len(word) < 64 else sum(map(self.merged, self.stretches(word)))

    def of_text(self, text: str) -> int:
        """Tokens of a text, the mark in front included; a U+2581 of the text is as good as a space."""
        if not text:
            return 0
        return sum(map(self.counts.__getitem__, self.words.findall(MARK + text.replace(" ", MARK))))


@lru_cache(maxsize=1)
def merges_of(model: bytes) -> Merges:
    """One for each Python worker, so that its tasks share what is remembered."""
    return Merges(model)


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    The counts are those of the SentencePiece library for the model, without
    begin, end or other special tokens; names of special tokens inside a text are
    ordinary text. Whole texts; null text counts as empty and has 0 tokens. A word
    of any length (a text without spaces) is counted stretch by stretch, in time n
    log n. Null ids and repeated rows pass through, an empty table gives no rows,
    other columns are not looked at. The model file is read as bytes through Spark
    or on the driver and sent with the tasks (its size is the vocabulary's).
    """
    body = model_bytes(docs.sparkSession, model)

    def make():
        merges = merges_of(body)
        return lambda texts: [list(map(merges.of_text, texts))]

    docs = documents(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return map_texts(docs, make, "n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
