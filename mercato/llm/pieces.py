"""Operator 8: SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is marked (space becomes U+2581, one mark in front) and cut before each
run of marks. No piece has a mark behind another character, so the words of a
text are segmented independently. The distinct words of a batch are sorted;
their trie is walked depth-first, and the best scores of every prefix are kept
on a stack, so words with a common prefix share its forward pass.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import documents, map_texts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Stands for a literal U+2581 of the text inside words, which is written as its three bytes: a lone surrogate,
#: which no valid text holds.
_LITERAL = "\ud800"


class Pieces:
    """The vocabulary of a SentencePiece model: normal pieces with scores, byte pieces, and the search over them.

    The score of a segmentation is the sum of its pieces' scores; of equal
    scores, the one whose last piece is shorter, and so on from the end. A
    character that no piece covers is written as its UTF-8 bytes, at the lowest
    score less ten, as unigram models do.
    """

    #: Words whose pieces are remembered (a cache: some 100 MB; dropping it changes no result).
    limit = 400_000

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(len(self.names)) if sp.is_byte(i)}
        self.value = {i: b for b, i in self.bytes.items()}
        self.skip = {i for i in range(len(self.names)) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        normal = {n: i for i, n in enumerate(self.names) if i not in self.skip and i not in self.value}
        if any(MARK in n.lstrip(MARK) for n in normal):
            raise ValueError("a piece holds a word mark behind another character; words can't be segmented one by one")
        if len(self.bytes) != 256:
            raise ValueError("the model needs all byte pieces, or texts could not be decoded exactly")
        # the pieces' trie: node -> {character: node}, and the piece that ends at a node
        self.next, self.ends = [{}], [None]
        for name, i in normal.items():
            at = 0
            for c in name:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.ends.append(None)
                at = self.next[at][c]
            self.ends[at] = (sp.get_score(i), i)
        self.unknown = min((sp.get_score(i) for i in normal.values()), default=0.0) - 10
        self.known, self.lossy = {}, set()

    def learn(self, words) -> None:
        """Segments the words that are not known yet, in sorted order: one depth-first walk over their trie."""
        new = sorted(w for w in words if w not in self.known)
        if len(self.known) + len(new) > self.limit:
            self.known.clear()
            new = sorted(words)
        nxt, ends, unknown, names = self.next, self.ends, self.unknown, self.names
        # the stack, one entry for each character of the current word:
        best, back = [0.0], [None]  # best score up to here; (start, piece) of the last piece, piece None: bytes
        root = nxt[0]
        open_at = [[(0, root)]]  # (start, what may follow) of pieces that have begun or may begin here
        last = ""
        for word in new:
            same = 0
            for x, y in zip(word, last):  # noqa: B905 - the shorter one ends the common prefix
                if x != y:
                    break
                same += 1
            del best[same + 1:], back[same + 1:], open_at[same + 1:]
            for at in range(same, len(word)):
                c, going = word[at], []
                top, how = best[at] + unknown, (at, None)
                for start, after in open_at[at]:
                    node = after.get(c)
                    if node is not None:
                        if nxt[node]:
                            going.append((start, nxt[node]))
                        end = ends[node]
                        if end is not None and best[start] + end[0] >= top:
                            top, how = best[start] + end[0], (start, end[1])
                going.append((at + 1, root))
                best.append(top)
                back.append(how)
                open_at.append(going)
            last = word
            out, at = [], len(word)
            while at:
                start, piece = back[at]
                if piece is None:
                    c = MARK if word[start] == _LITERAL else word[start]
                    out += [self.bytes[b] for b in reversed(c.encode("utf-8", "surrogatepass"))]
                else:
                    out.append(piece)
                at = start
            self.known[word] = out = out[::-1]
            if "".join([names[i] for i in out]) != word and (
                    self.decode(out, front=False) != word.replace(MARK, " ").replace(_LITERAL, MARK)):
                self.lossy.add(word)

    def encode_batch(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """The ids of each text, and whether they decode to it: each distinct word is decoded once, and a word's byte
        pieces are whole characters, so words decode independently."""
        cut = [_WORD.findall(self.marked(t)) if t else [] for t in texts]
        self.learn(dict.fromkeys(w for words in cut for w in words))
        known = self.known
        ids = [np.array([i for w in words for i in known[w]], np.int32) for words in cut]
        return ids, [self.lossy.isdisjoint(words) for words in cut]

    @staticmethod
    def marked(text: str) -> str:
        """Space becomes the mark, with one mark in front; a mark that the text holds itself is kept apart."""
        return MARK + text.replace(MARK, _LITERAL).replace(" ", MARK)

    def decode(self, ids, front: bool = True) -> str:
        """The text of ids: byte pieces join to UTF-8, marks become spaces, the mark in front (of a text) goes."""
        out = bytearray()
        for i in ids:
            if i in self.value:
                out.append(self.value[i])
            elif i not in self.skip:
                out += self.names[i].replace(MARK, " ").encode()
        return bytes(out[1:] if front and out[:1] == b" " else out).decode("utf-8", "surrogatepass")


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """One row per document: doc_id, ids array<int>, n_pieces, round_trip (whether decoding gives the text back).

    Whole texts; null text counts as empty and has no ids. A very long word
    costs time and memory in proportion to its length. Null ids and repeated
    rows pass through, an empty table gives no rows. The model file is read as
    bytes through Spark and sent with the tasks (its size is the vocabulary's),
    so executors need no copy of it.
    """
    body = model_bytes(docs.sparkSession, model)

    def make():
        pieces = Pieces(body)

        def columns(texts):
            ids, exact = pieces.encode_batch(texts)
            return [ids, [len(x) for x in ids], exact]

        return columns

    return map_texts(documents(docs), make, "ids array<int>, n_pieces long, round_trip boolean")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and the text of ``ids`` (null: null)."""
    body = model_bytes(encoded.sparkSession, model)

    def make():
        pieces = Pieces(body)
        return lambda ids: [[None if x is None else pieces.decode(x) for x in ids]]

    return map_texts(encoded.select("doc_id", F.col("ids").alias("text")), make, "decoded string").select(
        "doc_id", F.col("decoded").alias("text"))


def model_bytes(spark, model: str) -> bytes:
    """The driver's file, or one that Spark's stores hold."""
    try:
        with open(model, "rb") as f:
            return f.read()
    except FileNotFoundError:
        return bytes(spark.read.format("binaryFile").load(model).first()["content"])
