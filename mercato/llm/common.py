"""Shared pieces of the training-data operators: reading, word hashing, written tables, data-sized partition counts."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from mercato.session import scratch_path

#: The ASCII white space every contract here uses: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
_U64 = np.uint64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back: a
    lost executor recomputes from the files, and later uses do not recompute."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text`` (null: empty), so that no other column of the input can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))


def crc_remainder(doc_id: Column, by: int = 5) -> Column:
    """crc32 of the id's decimal text, modulo ``by``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def crc_remainder_py(doc_id, by: int = 5) -> int:
    return zlib.crc32(b"" if doc_id is None else str(int(doc_id)).encode()) % by


def parts_for(total: float, each: float, least: int = 1) -> int:
    """Number of parts so that none holds much more than ``each`` of ``total``: grows with the data, no upper limit."""
    return max(least, math.ceil((total or 0) / each))


def text_size(docs: DataFrame) -> int:
    """Code points of all texts (one number)."""
    return docs.agg(F.sum(F.char_length("text"))).first()[0] or 0


def word_list(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased: bytes methods touch ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split()


class WordHashes(dict):
    """64-bit hash of each word, remembered up to ``limit`` words (a cache: dropping it changes no result)."""

    limit = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), _U64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), so that sums and products spread over all bits."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def runs_of(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words."""
    n = len(hashes) - k + 1
    out = np.full(n, k, _U64)
    for j in range(k):
        out = mixed(out * _U64(0x9E3779B97F4A7C15) + hashes[j:j + n])
    return out


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct ``k``-word shingles; with fewer words, the whole sequence as one; without words, none."""
    if not len(hashes):
        return hashes
    return np.unique(runs_of(hashes, min(k, len(hashes))))


def text_slices(batch: pa.RecordBatch, limit: int = 2_000_000):
    """Slices of an Arrow batch that hold about ``limit`` bytes of text, or one row: what Python unfolds at a time."""
    col = batch.column("text")
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        yield from (batch.slice(i, 500) for i in range(0, batch.num_rows, 500))
        return
    part = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // limit
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
    for i, j in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(i, j - i)


def map_texts(docs: DataFrame, make: Callable, added: str) -> DataFrame:
    """``docs`` without ``text``, with the columns ``added`` (DDL) computed from it.

    ``make()`` is called once in each task and returns a function from a list of
    texts to a list of columns. The other columns pass through as Arrow, so null
    and large integers stay as they are.
    """
    fields = StructType.fromDDL(added)
    kept = [f for f in docs.schema if f.name != "text"]
    names = [f.name for f in kept]

    def run(batches):
        columns_of = make()
        for batch in (part for whole in batches for part in text_slices(whole)):
            new = columns_of(batch.column("text").to_pylist())
            arrays = [batch.column(n) for n in names]
            arrays += [pa.array(c, type=to_arrow_type(f.dataType)) for c, f in zip(new, fields, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names + fields.names)

    return docs.mapInArrow(run, StructType([*kept, *fields]))
