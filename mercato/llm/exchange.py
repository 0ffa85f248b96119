"""Corpus-wide lookups in bulk: blocks of documents ask hash buckets, buckets answer.

A block is some megabytes of whole documents, by a hash of id and text. It sends
its sorted distinct keys (64-bit hashes) to the buckets, each a range of the hash
space, as one packed row for each bucket. A bucket merges what all blocks sent
and answers each in the order it asked, so answers carry no keys. Keys are
distinct before they are sent, so a key that a third of all rows hold reaches its
bucket once from each block. A block may leave out buckets it has no key for; then
there are never more rows than distinct keys in the blocks. Numbers of blocks and buckets grow with the input,
which bounds what one task holds. The documents' shuffle is planned twice with
one plan, so Spark reuses it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import documents, parts_for, text_size

#: Code points of text in a block.
BLOCK_CHARS = 6_000_000


def blocked(docs: DataFrame, each: int = BLOCK_CHARS) -> tuple[DataFrame, int]:
    """doc_id, text and block, and the number of blocks (also that of buckets)."""
    docs = documents(docs)
    n = parts_for(text_size(docs), each)
    return docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")), n


def planes(x: np.ndarray) -> bytes:
    """The bytes of an array, all first bytes, then all second ones and so on: high bytes that agree compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def steps(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unsteps(b: bytes) -> np.ndarray:
    return np.cumsum(unplanes(b, np.uint64), dtype=np.uint64)


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket starts and ends in the sorted keys: bucket i holds keys from i * 2^64 / buckets."""
    starts = np.array([(i << 64) // buckets for i in range(buckets)], np.uint64)
    return np.r_[np.searchsorted(keys, starts), len(keys)]


def ask_and_answer(docs: DataFrame, buckets: int, ask: Callable, asked: str, answer: Callable, answered: str,
                   finish: Callable, schema: str) -> DataFrame:
    """``ask(table)`` gives (bucket, columns...) rows of a block, ``answer(rows)`` one row for each row of a bucket,
    in its order, and ``finish(table, answers)`` the result of a block; answers come in bucket order.

    All three get and give Arrow tables or lists of columns.
    """
    def to_rows(key, table):
        cols = ask(table)
        block = pa.array([key[0].as_py()] * len(cols[0]), pa.int32())
        return pa.Table.from_arrays([block, *[pa.array(c) for c in cols]], names=names)

    def to_answers(key, table):
        order = table.sort_by("block")
        return pa.Table.from_arrays([order.column("block"), order.column("bucket"), *[pa.array(c) for c in answer(order)]],
                                    names=["block", "bucket", *[c.split()[0] for c in answered.split(", ")]])

    def to_result(left, right):
        return finish(left, right.sort_by("bucket"))

    names = ["block", "bucket", *[c.split()[0] for c in asked.split(", ")]]
    rows = docs.groupBy("block").applyInArrow(to_rows, f"block int, bucket int, {asked}")
    replies = rows.groupBy("bucket").applyInArrow(to_answers, f"block int, bucket int, {answered}")
    return docs.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(to_result, schema)
