"""Operator 2: MinHash near-dedup.

One-permutation hashing fills 128 bins from a single hash per shingle; empty
bins borrow by optimal densification (each probes a fixed random sequence of
bins until one is filled). Bins are banded, documents of a band bucket are
linked to the bucket's smallest member only (star edges), and every link is
confirmed on the full shingle sets. A star cannot see links between two other
members: two more rounds put stars around other members of the buckets that
still hold several components, and what remains apart after them is compared:
buckets of two directly, larger ones in fixed-size blocks of sketches, never as
one group.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import WordHashes, documents, map_texts, mixed, parts_for, shingle_set, word_list, written
from mercato.llm.components import components

BINS = 128
#: Rows of 4 bins: a pair at similarity 0.8 misses all 32 bands with probability (1 - 0.8^4)^32, about 5e-8.
ROWS = 4
BANDS = BINS // ROWS
#: Side of a block of sketches in the second look at mixed buckets.
BLOCK = 256
_PROBES = 1024
#: Bins of the sketch that the blocks compare.
FINE = 1024
#: Star rounds before the blocks.
ROUNDS = 3


def _probe_table() -> np.ndarray:
    """For each bin the random sequence of bins it asks when empty, the same for all documents."""
    at = np.arange(BINS * _PROBES, dtype=np.uint64)
    return (mixed(at + np.uint64(0x51ED270B)) >> np.uint64(57)).astype(np.intp).reshape(BINS, _PROBES)


PROBE = _probe_table()


def signature(shingles: np.ndarray) -> np.ndarray:
    """128 values of 16 bits: the smallest hash of each bin. ``shingles`` is sorted and not empty.

    The top 7 bits of a hash name its bin, so the first hash of each bin in
    sorted order is the bin's minimum.
    """
    bins = (shingles >> np.uint64(57)).astype(np.intp)
    filled = np.zeros(BINS, bool)
    values = np.zeros(BINS, np.uint64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    filled[bins[first]] = True
    values[bins[first]] = mixed(shingles[first]) & np.uint64(0xFFFF)
    empty = np.flatnonzero(~filled)
    if len(empty):
        for lo, hi in ((0, 32), (32, _PROBES)):
            hits = filled[PROBE[empty, lo:hi]]
            found = hits.any(axis=1)
            values[empty[found]] = values[PROBE[empty[found], lo + hits[found].argmax(axis=1)]]
            empty = empty[~found]
            if not len(empty):
                break
        values[empty] = values[bins[first[0]]]  # none of 1024 probes hit: the first filled bin, a function of the set
    return values.astype("<u2")


def sketch(shingles: np.ndarray) -> bytes:
    """1024 bins of 8 bits, empty ones 0 and not filled, then a 32-bit hash of each band: for a closer estimate."""
    bins = (shingles >> np.uint64(54)).astype(np.intp)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    fine = np.zeros(FINE, np.uint8)
    fine[bins[first]] = mixed(shingles[first]) % np.uint64(255) + np.uint64(1)
    return fine.tobytes() + mixed(signature(shingles).view("<u8")).astype("<u4").tobytes()


def _signatures(k: int):
    def make():
        hashes = WordHashes()

        def columns(texts):
            sets = [shingle_set(hashes.of(word_list(t)), k) for t in texts]
            return [[len(s) for s in sets],
                    [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                    [signature(s).tobytes() if len(s) else None for s in sets]]

        return columns

    return make


def _sets(k: int):
    def run(batches):
        hashes = WordHashes()
        for pdf in batches:
            sets = [shingle_set(hashes.of(word_list(t)), k) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["doc_id"], "shingles": [s.tobytes() for s in sets],
                                "sketch": [sketch(s) for s in sets]})

    return run


def _similar(percent: int):
    def run(batches):
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["sa"], pdf["sb"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    return run


def _possible(n, m, percent: int):
    """Whether sets of these sizes, known to differ, can reach the similarity (numpy or Column)."""
    low, high = (F.least(n, m), F.greatest(n, m)) if isinstance(n, Column) else (np.minimum(n, m), np.maximum(n, m))
    same = (n == m).cast("int") if isinstance(n, Column) else n == m
    return 100 * (low - same) >= percent * (high + same)


def _floor(percent: int) -> float:
    """Least agreement of two sketches worth a look: 4.5 deviations of 1024 bins below the similarity."""
    p = percent / 100
    return p - 4.5 * (p * (1 - p) / FINE) ** 0.5


def _blocks(percent: int):
    """Pairs of one block pair that lie in different components and may be similar by size and sketch.

    A pair is given only in the first band it shares, so no pair comes twice; where
    that bucket holds just the two, it is compared without a block. The
    estimate is equal bins over bins filled on either side; where a set is
    smaller than the sketch, that is nearly its exact similarity.
    """
    floor = _floor(percent)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out_a, out_b = [], []
        for (band, _, bi, bj), g in pdf.groupby(["band", "key", "bi", "bj"], sort=False):
            raw = np.frombuffer(b"".join(g["sketch"]), np.uint8).reshape(len(g), -1)
            fine, keys = raw[:, :FINE], np.ascontiguousarray(raw[:, FINE:]).view("<u4")
            rep, n, comp, blk = (g[c].to_numpy() for c in ("rep", "n", "component", "blk"))
            left, right = np.flatnonzero(blk == bi), np.flatnonzero(blk == bj)
            for i in left:
                js = right[right > i] if bi == bj else right
                js = js[(comp[js] != comp[i]) & _possible(n[js], n[i], percent)]
                js = js[(keys[js] == keys[i]).argmax(axis=1) == band]
                if len(js):
                    both = ((fine[js] == fine[i]) & (fine[i] > 0)).sum(axis=1)
                    either = ((fine[js] > 0) | (fine[i] > 0)).sum(axis=1)
                    js = js[both >= floor * either]
                out_a += [rep[i]] * len(js)
                out_b += rep[js].tolist()
        return pd.DataFrame({"a": np.array(out_a, np.int64), "b": np.array(out_b, np.int64)})

    return run


def _confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""
    sides = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    return sides.select("a", "b", "sa", "sb").mapInPandas(_similar(percent), "a long, b long")


def _star_pairs(members: DataFrame, percent: int, order) -> DataFrame:
    """Each member with the center of its bucket, where the two lie in different components: for each member the
    center it meets in most buckets."""
    centers = members.groupBy("band", "key").agg(
        F.min(F.struct(order.alias("o"), "rep", "n", "component")).alias("c")).select(
        "band", "key", F.col("c.rep").alias("b"), F.col("c.n").alias("bn"), F.col("c.component").alias("bc"))
    met = members.join(centers, ["band", "key"]).where(F.col("component") != F.col("bc"))
    met = met.where(_possible(F.col("n"), F.col("bn"), percent)).groupBy("rep", "b").agg(F.count(F.lit(1)).alias("shared"))
    return met.groupBy("rep").agg(F.max_by("b", F.struct("shared", -F.col("b"))).alias("b")).select(
        F.col("rep").alias("a"), "b")


def _with_components(members: DataFrame, comp: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components."""
    named = members.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep"))
    several = named.groupBy("band", "key").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band", "key")
    return named.join(several, ["band", "key"], "left_semi")


def near_links(docs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, component) of the representatives that have a link to another one."""
    bands = reps.select("rep", "n", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"), "sig")
    bands = bands.select("rep", "n", "band", F.substring("sig", F.col("band") * (2 * ROWS) + 1, F.lit(2 * ROWS)).alias("key"))
    shared = bands.groupBy("band", "key").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("lo"),
                                              F.max("n").alias("hi")).where("m > 1")
    # a bucket of two whose sizes cannot reach the similarity needs no look
    shared = shared.where((F.col("m") > 2) | _possible(F.col("lo"), F.col("hi"), percent)).select("band", "key", "m")
    members = written(bands.join(shared, ["band", "key"]), "buckets")
    ids = members.select(F.col("rep").alias("id")).distinct()
    sets = documents(docs).join(ids, F.col("doc_id") == F.col("id"), "left_semi").dropDuplicates(["doc_id"])
    sets = written(sets.mapInPandas(_sets(k), "id long, shingles binary, sketch binary"), "sets")

    # Stars: the first around each bucket's smallest member, then around others, so that what a center
    # does not resemble can still meet its like. Each round merges components and so leaves fewer pairs.
    links, comp, tested = None, None, None
    for r in range(ROUNDS):
        cur = members.withColumn("component", F.col("rep")) if r == 0 else written(_with_components(members, comp), "seen")
        order = F.col("rep") if r == 0 else F.xxhash64("rep", F.lit(r))
        pairs = written(_star_pairs(cur, percent, order), "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        found = written(_confirmed(sets, pairs, percent), "links")
        links = found if links is None else links.union(found)
        comp = written(components(links), "components")

    # What still shares a bucket across components is compared. A star tests one center for each member, so the
    # pair of a bucket of two may be new; larger buckets go in blocks of sketches.
    rest = written(_with_components(members, comp), "seen")
    twos = rest.where("m = 2").groupBy("band", "key").agg(F.max("rep").alias("a"), F.min("rep").alias("b")).select(
        "a", "b").distinct()
    tested = tested.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    twos = written(twos.join(tested, ["a", "b"], "left_anti"), "twos")
    rest = rest.where("m > 2")
    rest = rest.withColumn("nb", F.ceil(F.col("m") / BLOCK).cast("int"))
    rows = rest.agg(F.sum("nb")).first()[0]
    rest = rest.join(sets.select(F.col("id").alias("rep"), "sketch"), "rep").withColumn("blk", F.pmod(F.hash("rep"), F.col("nb")))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rest = rest.select("band", "key", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"),
                       "blk", "rep", "n", "component", "sketch")
    parts = parts_for(rows, 20_000, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    more = rest.groupBy(F.pmod(F.xxhash64("band", "key", "bi", "bj"), F.lit(parts)).alias("part")).applyInPandas(
        _blocks(percent), "a long, b long")
    more = _confirmed(sets, written(more.union(twos), "more-pairs"), percent)
    return components(links.union(more))


def own_ids(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` with ``__own``, one long for each distinct (doc_id, text), and whether that differs from doc_id anywhere.

    It is the doc_id where one text alone has it. Ids that several texts share,
    and null, get numbers beyond all ids, by their text (96 bits of hash beside
    the id).
    """
    text = F.coalesce("text", F.lit(""))
    named = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__h": F.xxhash64(text), "__g": F.hash(text)})
    each = F.struct("__h", "__g")
    shared = named.groupBy("__id").agg(F.min(each).alias("lo"), F.max(each).alias("hi")).where(
        "lo <> hi or __id is null").select(F.col("__id").alias("__shared"))
    shared = written(shared, "shared-ids")
    if shared.isEmpty():
        return named.withColumn("__own", F.col("__id")).drop("__id", "__h", "__g"), False
    low, high = docs.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long"))).first()
    if high is None or high < 2**62:
        number = F.lit((high or 0) + 1) + F.monotonically_increasing_id()
    else:  # no room above
        number = F.lit(min(low, 0) - 1) - F.monotonically_increasing_id()
    odd = named.join(shared, F.col("__id").eqNullSafe(F.col("__shared")), "left_semi").select("__id", "__h", "__g").distinct()
    odd = written(odd.withColumn("number", number).toDF("__i", "__oh", "__og", "__number"), "own-ids")
    named = named.join(odd, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__h") == F.col("__oh")) & (F.col("__g") == F.col("__og")),
                       "left")
    return named.withColumn("__own", F.coalesce("__number", "__id")).drop(
        "__id", "__h", "__g", "__i", "__oh", "__og", "__number"), True


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |A and B| >= ``percent`` * |A or B| on their
    sets of ``k``-word shingles (A-Z lower-cased, ASCII white space between
    words; with fewer words, the whole sequence as one shingle). component_id is
    the smallest doc_id reachable over links.

    Documents with equal sets are one representative (the smallest id) before
    any bucket is built, so thousands of copies are one row. Links are complete
    up to the chance of 5e-8 that a similar pair shares none of 32 bands.

    Null or empty text and text without words: an empty set, linked with
    nothing, component_id is its own id. Rows that share a doc_id but not the
    text are documents of their own, each linked by its own text; rows without an
    id too, and their component_id is the smallest id that they reach (null where
    none has one). Rows repeated with one doc_id and text share a component.
    Empty tables give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs, differ = own_ids(docs)
    if not differ:
        return _groups(docs, k, percent).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    names = written(docs.select(F.col("__own").alias("own"), F.col("doc_id").alias("named")).distinct(), "names")
    found = written(_groups(docs.select(F.col("__own").alias("doc_id"), "text"), k, percent), "groups")
    found = found.join(names, found["doc_id"] == names["own"])
    least = found.groupBy(F.col("component_id").alias("c")).agg(F.min("named").alias("least"))
    return found.join(least, F.col("component_id") == F.col("c")).select(
        F.col("named").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"),
        F.col("named").eqNullSafe(F.col("least")).alias("kept"))


def _groups(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id, of documents no two of which have one id and different texts."""
    sigs = written(map_texts(documents(docs), _signatures(k), "n long, set_hash binary, sig binary"), "signatures")
    reps = sigs.where("n > 0").groupBy("set_hash").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    reps = written(reps, "representatives")
    comp = near_links(docs, reps, k, percent)
    classes = reps.select("set_hash", "rep").join(comp, F.col("rep") == F.col("node"), "left").select(
        "set_hash", F.coalesce("component", "rep").alias("component"))
    return sigs.select("doc_id", "n", "set_hash").join(classes, "set_hash", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_near(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay (one of each group), with all columns of ``docs``.

    A document is an id with its text: of several texts with one id each stays
    or goes by its own group, and documents without an id take part (they stay
    where no member of their group has one; of those, one text does). Documents
    without words stay; rows repeated with one id and text share their fate.
    """
    own, _ = own_ids(docs)
    drop = _groups(own.select(F.col("__own").alias("doc_id"), "text"), k, percent).where("doc_id <> component_id").select(
        F.col("doc_id").alias("__drop")).distinct()
    return own.join(drop, own["__own"] == F.col("__drop"), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
