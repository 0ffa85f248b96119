"""Operator 4: mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length for each source. A source's target gives
whole passes over its documents plus a remaining budget. Of the remaining
budget each length first gives its share of documents; what rounding leaves is
fitted by a bounded knapsack over the lengths and counts still free. Which
documents fill a length's count is decided by a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.llm.common import written

#: A document is taken at most so often, so a target stops at REPEATS times its source's size.
REPEATS = 3
WEIGHTS = (1, 2, 3)
SEED = 4
#: The knapsack fits budgets up to this many words (and twice the longest document).
KNAPSACK = 65_536
#: Hash buckets of the documents of one source and length: a hot length is ranked in so many parts.
BUCKETS = 1024


def sized(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source, the number of words ``[^\\x20\\x09-\\x0D]+`` (null text: 0) and the columns ``more``."""
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       words.cast("long").alias("size"), *more)


def targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Adds weight and target to (source, source_size).

    The targets share the total by weight; a target stops at ``repeats`` times
    its source's size and the excess goes to the others by weight, until none is
    above. That is one level z with target = min(cap, z * weight): sources in
    the order of cap / weight stop one after the other, so running sums find it.
    The windows run over one row for each source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    w = per_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)),
                                                     ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size") * repeats)
    asc = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = asc.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    w = w.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    # the first source that its level leaves open sets the level of all open ones
    w = w.withColumn("z", F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("weight")).alias("ratio"), "level"))
                                ).over(every))
    first = F.col("z.level")
    stop = first.isNull() | (F.col("cap") < first * F.col("weight"))
    return w.select("source", "source_size", "weight", F.when(
        stop, F.col("cap").cast("double")).otherwise(first * F.col("weight")).alias("target"))


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, limit: int = KNAPSACK) -> np.ndarray:
    """How many documents of each length to take so that the taken words come as near ``budget`` as can be.

    ``lengths`` are distinct and positive, ascending; 0 <= budget <= their total.
    """
    total = int((lengths * counts).sum())
    if total <= budget:
        return counts.copy()
    share = [int(c) * budget // total for c in counts.tolist()]  # whole numbers: exact at any size
    take = np.array(share, np.int64)
    left = budget - int((lengths * take).sum())
    free = counts - take
    limit = max(limit, 2 * int(lengths[-1]))
    # What rounding left, by largest remainder, until the knapsack can hold it.
    rest = np.array([int(c) * budget % total for c in counts.tolist()], dtype=object)
    for i in sorted(range(len(lengths)), key=lambda i: (-rest[i], -lengths[i])):
        if left <= limit:
            break
        n = min(int(free[i]), 1, left // int(lengths[i]))
        take[i] += n
        free[i] -= n
        left -= n * int(lengths[i])
    # Bounded knapsack over sums up to twice what is left (a sum beyond that is farther than taking nothing).
    cap = 2 * left
    mask, reached = (1 << (cap + 1)) - 1, 1
    came = {0: None}
    for i in np.flatnonzero(free):
        n, step = int(free[i]), 1
        size = int(lengths[i])
        while n > 0 and size * step <= cap:
            k = min(step, n)
            new = (reached << (size * k)) & mask & ~reached
            bits = np.unpackbits(np.frombuffer(new.to_bytes(cap // 8 + 1, "little"), np.uint8), bitorder="little")
            came.update(dict.fromkeys(np.flatnonzero(bits).tolist(), (int(i), k)))
            reached |= new
            n -= k
            step *= 2
        if reached >> left & 1:
            break
    best = min(came, key=lambda s: (abs(s - left), s))
    while came[best] is not None:
        i, k = came[best]
        take[i] += k
        best -= k * int(lengths[i])
    return take


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """One source: rows (source, size, n, source_size, target), one for each length."""
    pdf = pdf.sort_values("size")
    sizes, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    total, target = int(pdf["source_size"].iat[0]), float(pdf["target"].iat[0])
    whole = min(REPEATS, int(target // total)) if total else 0
    budget = min(total, round(target - whole * total)) if whole < REPEATS else 0
    take = np.zeros(len(sizes), np.int64)
    some = sizes > 0
    if total:
        take[some] = fit_budget(sizes[some], counts[some], budget)
    return pd.DataFrame({"source": pdf["source"], "size": sizes, "source_size": total, "target": target,
                         "whole": whole, "extra": take})


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    Sources in code point order, null last, weigh 1, 2, 3, repeating. taken is
    the words that the mix takes from the document, repeats counted: its size
    times the whole passes, plus once more where the seeded choice takes it; at
    most three times its size. A source's taken words come as near its target
    as its lengths allow.

    The fit sees one row for each distinct length of a source, never documents.
    The documents of a length are ranked by a seeded hash of the id (of the text
    where there is no id) in 1024 hash buckets with running counts, so a length
    that a third of all rows share is ranked in parts. Rows repeated with one id
    go by a hash of their text; where that is equal too, either may be taken. Null or empty texts have size 0 and take
    nothing; null ids and sources are values like others; a source without words
    has target 0; an empty table gives no rows.
    """
    return _copies(docs, seed).select("doc_id", "size", "source_size", "target",
                                      (F.col("size") * F.col("copies")).alias("taken"), "copies")


def _copies(docs: DataFrame, seed: int, *more: Column) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies and the columns ``more`` of ``docs``, which go
    along with the rank, so that nothing is joined back on an id that rows share."""
    def keyed(rows):
        rows = rows.withColumn("h", F.xxhash64(F.lit(seed), F.coalesce("doc_id", "text_hash"), "size"))
        rows = rows.withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int"))
        # a null source is a value like others: with a name for it the window's partitioning serves the join too
        return rows.withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))

    text_hash = F.xxhash64("text").alias("text_hash")
    rows = written(keyed(sized(docs, text_hash)), "sizes")
    per_bucket = rows.groupBy("name", "source", "size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    hist = per_bucket.groupBy("source", "size").agg(F.sum("n").alias("n"))
    per_source = hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    goals = targets(per_source)
    chosen = hist.join(goals.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s")))
    fits = written(chosen.select("source", "size", "n", "source_size", "target").groupBy("source").applyInPandas(
        _fit, "source string, size long, source_size long, target double, whole long, extra long"), "fits")
    # documents of the length in lower buckets: the rank at which a bucket starts
    lower = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.withColumn("start", F.coalesce(F.sum("n").over(lower), F.lit(0)))
    starts = starts.join(fits.withColumnRenamed("source", "fs").withColumnRenamed("size", "fz"),
                         F.col("source").eqNullSafe(F.col("fs")) & (F.col("size") == F.col("fz"))).select(
        "name", "size", "bucket", "start", "source_size", "target", "whole", "extra")
    each = keyed(sized(docs, text_hash, *more)) if more else rows
    ranked = each.withColumn("r", F.row_number().over(
        Window.partitionBy("name", "size", "bucket").orderBy("h", "doc_id", "text_hash")))
    out = ranked.join(starts, ["name", "size", "bucket"])
    return out.withColumn("copies", F.col("whole") + (F.col("start") + F.col("r") <= F.col("extra")).cast("long"))


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: each row as often as it is taken, with all columns of ``docs``, whatever ids rows share or lack."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    out = _copies(docs, seed, row).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
