"""Operator 11: a Merkle manifest of a table, with a proof for every row, by butterfly exchange.

A row's digest is a leaf. The leaves of a source, in order, form a tree of 16-ary
nodes; the sources' roots, in order, form another tree above. Leaves lie in
partitions: aligned runs of ``SPAN`` leaves of one source, which a task hashes
alone. Then come rounds: an aligned group of 16 partitions swaps its subtree roots
once, and each of them hashes their common parent for itself. In the next round
the 16 subtrees swap, each partition with those at its own place in the others, as
they all know their subtree's root already. So every partition gathers the
siblings of all its ancestors on the way up, and no pass goes down again.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.llm.common import crc_remainder, parts_for, written

#: Children of a node; levels below a partition's root (so 4096 leaves).
FANOUT = 16
LEVELS = 3
#: Rows in a range of the ordered leaves, which one task sorts.
SORTED_ROWS = 500_000
#: Hexadecimal characters of a digest.
HEX = 64
PATH = "array<struct<left:string,right:string>>"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(values: Sequence[Column]) -> Column:
    """The values one after the other: UTF-8 byte count, ``:``, value; null is ``-``."""
    texts = [v.cast("string") for v in values]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, and what the leaf becomes by tampering (null: not tampered with)."""
    rows = docs.select(*[F.col(c) for c in COLUMNS])
    other = F.when(crc_remainder(F.col("doc_id")) == 0, F.sha2(encoded(
        [F.col(c) for c in COLUMNS[:-1]] + [lower_ascii(F.col("text"))]), 256))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.sha2(encoded([F.col(c) for c in COLUMNS]), 256).alias("leaf"), other.alias("altered"))


def partitions(rows: DataFrame, order: Sequence[str], ids: Sequence[str], levels: int) -> DataFrame:
    """One row for each aligned run of 16 ** ``levels`` leaves of a source: source, n (leaves of the source), cell,
    ``ids`` as arrays in order, leaves (their digests in a row).

    Places come from a sort by ranges: a row's place in its range, plus the rows
    of the source in earlier ranges, so no source is numbered by one task. The
    last sort key tells only rows apart that are the same in all of ``order``.
    """
    ranges = parts_for(rows.count(), SORTED_ROWS)
    keys = ["source", *order]
    placed = written(
        rows.withColumn("own", F.monotonically_increasing_id()).repartitionByRange(ranges, *keys, "own")
        .sortWithinPartitions(*keys, "own").drop("own").withColumn("at", F.monotonically_increasing_id()), "merkle-placed")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    starts = placed.groupBy("source", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("here"))
    by = Window.partitionBy("source")
    starts = starts.select(F.col("source").alias("s"), F.col("part").alias("p"), "first", F.sum("here").over(by).alias("n"),
                           F.coalesce(F.sum("here").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
                                      F.lit(0)).alias("before"))
    row = F.struct((F.col("before") + F.col("at") - F.col("first")).alias("pos"), *ids, "leaf")
    cells = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).select(
        "source", "n", row.alias("r")).groupBy("source", "n", F.expr(f"r.pos div {FANOUT ** levels}").alias("cell")).agg(
        F.sort_array(F.collect_list("r")).alias("rows"))
    return written(cells.select("source", "n", "cell", *[F.expr(f"transform(rows, r -> r.{c})").alias(c) for c in ids],
                                F.expr("array_join(transform(rows, r -> r.leaf), '')").alias("leaves")), "merkle-cells")


def levels_of(leaf_row: str, n: int, levels: int) -> list[str]:
    """The nodes of a partition's levels, from its leaves (digests in a row) to its root. A source of one partition
    ends where one node is left; in others a level's lone node has a parent too."""
    rows = [leaf_row]
    alone = n <= FANOUT ** levels
    while len(rows) <= levels and not (alone and len(rows[-1]) == HEX):
        last = rows[-1]
        rows.append("".join(sha256(last[i:i + HEX * FANOUT].encode()).hexdigest() for i in range(0, len(last), HEX * FANOUT)))
    return rows


def siblings(rows: list[str], i: int):
    """(left, right) digests beside leaf ``i`` and beside each of its ancestors in a partition."""
    for row in rows[:-1]:
        run = row[i // FANOUT * FANOUT * HEX:][:FANOUT * HEX]
        at = i % FANOUT * HEX
        yield run[:at], run[at + HEX:]
        i //= FANOUT


def fold(digest: str, path) -> str:
    """The root that a digest and its siblings on the way up give."""
    for left, right in path:
        digest = sha256((left + digest + right).encode()).hexdigest()
    return digest


def butterfly(cells: DataFrame, levels: int) -> DataFrame:
    """source, cell, path (siblings of the partition's ancestors, from its own root up), root (of the source).

    In round r the partitions whose numbers agree but for digit r (base 16) meet:
    one of each subtree of 16 ** r partitions. The last subtree may be short of
    partitions; those it has stand in for the missing ones, in turn. Each source
    takes as many rounds as its own height needs.
    """
    def roots(batches):
        for batch in batches:
            top = [levels_of(r["leaves"], r["n"], levels)[-1] for i in range(batch.num_rows)
                   for r in batch.slice(i, 1).select(["leaves", "n"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("source", "n", "cell")], pa.array(top, pa.string())],
                                             names=["source", "n", "cell", "root"])

    state = written(cells.select("source", "n", "cell", "leaves").mapInArrow(
        roots, "source string, n long, cell long, root string"), "merkle-roots").withColumn("path", F.lit(None).cast(PATH))
    state = state.withColumn("path", F.expr(f"cast(array() as {PATH})"))
    highest, height = state.agg(F.max("n")).first()[0] or 0, 0
    out = None
    while True:
        low, high = FANOUT ** (levels + height - 1) if height else 0, FANOUT ** (levels + height)
        part = state.where((F.col("n") > low) & (F.col("n") <= high))
        for r in range(height):
            part = swapped(part, levels, r)
        part = part.select("source", "cell", "path", "root")
        out = part if out is None else out.unionByName(part)
        if high >= highest:
            return out
        height += 1


def swapped(state: DataFrame, levels: int, r: int) -> DataFrame:
    """One round: each partition meets one of each neighbouring subtree, keeps their roots beside its own and hashes all
    to the parent's."""
    step = FANOUT ** r
    last = f"((n - 1) div {FANOUT ** levels}) div {step}"  # the last subtree of this height
    size = f"(((n - 1) div {FANOUT ** levels}) % {step} + 1)"
    lanes = F.expr(f"if(cell div {step} = {last} and cell div {step} % {FANOUT} > 0, "
                   f"sequence(cell % {step}, {step - 1}L, {size}), array(cell % {step}))")
    rows = state.withColumn("node", F.expr(f"cell div {step}")).withColumn("lane", F.explode(lanes))
    met = rows.groupBy("source", "n", F.expr(f"node div {FANOUT}").alias("parent"), "lane").agg(F.sort_array(F.collect_list(F.struct(
        "node", "root", F.when(F.col("cell") % step == F.col("lane"), F.struct("cell", "path")).alias("own")))).alias("all"))
    met = met.withColumn("up", F.expr("sha2(array_join(transform(all, x -> x.root), ''), 256)"))
    beside = F.expr("""transform(filter(all, x -> x.own is not null), x -> struct(x.own.cell as cell, concat(x.own.path, array(struct(
        array_join(transform(filter(all, y -> y.node < x.node), y -> y.root), '') as left,
        array_join(transform(filter(all, y -> y.node > x.node), y -> y.root), '') as right))) as path))""")
    return met.select("source", "n", F.explode(beside).alias("o"), F.col("up").alias("root")).select(
        "source", "n", "o.cell", "root", "o.path")


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """One row per document: doc_id, leaf, subroot (of its source), root, proof_sha256 (of the digests beside its leaf
    and its ancestors, level by level up to the root), folded_root (from the leaf, tampered with where 5 divides crc32 of
    the doc_id, and those digests), verified (whether that is the root).

    Leaves of a source ascend by doc_id, null first; rows repeated with one id
    follow each other by their leaf. A null id has the crc32 of no text, 0. Null
    columns are written ``-``; a null source is a source of its own, the first.
    A text without A-Z stays as it is by tampering, so it verifies. A table of one
    row has its leaf as root and no siblings; an empty table gives no rows. Columns
    other than the five are not looked at. Texts are read once; everything after
    carries digests. A hot source is dealt out by its partitions of 16 ** ``levels``
    leaves, and many sources by the same means in the tree above.
    """
    rows = written(leaves(docs), "merkle-leaves")
    cells = partitions(rows, ["doc_id", "leaf"], ["doc_id", "altered"], levels)
    lower = written(butterfly(cells, levels), "merkle-paths")

    subroots = lower.where(F.col("cell") == 0).select(F.lit(0).cast("string").alias("source"), F.col("source").alias("name"),
                                                      F.col("root").alias("leaf"))
    tops = partitions(subroots, ["name"], ["name"], levels)

    def above(batches):
        """The whole path of each source."""
        for batch in batches:
            for r in (x for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
                own = levels_of(r["leaves"], r["n"], levels)
                paths = [[*siblings(own, i), *[(p["left"], p["right"]) for p in r["path"]]] for i in range(len(r["name"]))]
                yield pa.RecordBatch.from_arrays([
                    pa.array(r["name"], pa.string()), pa.array([[{"left": a, "right": b} for a, b in p] for p in paths], above_type),
                    pa.array([r["root"]] * len(paths), pa.string())], names=["name", "above", "top"])

    above_type = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    upper = tops.join(butterfly(tops, levels), ["source", "cell"]).select("leaves", "n", "name", "path", "root").mapInArrow(
        above, f"name string, above {PATH}, top string")

    def proofs(batches):
        for batch in batches:
            for r in (x for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
                own = levels_of(r["leaves"], r["n"], levels)
                shared = [(p["left"], p["right"]) for p in r["path"] + r["above"]]
                rest = "".join(a + b for a, b in shared).encode()
                found, proof, folded = [], [], []
                for i, other in enumerate(r["altered"]):
                    leaf = r["leaves"][i * HEX:(i + 1) * HEX]
                    path = list(siblings(own, i))
                    found.append(leaf)
                    proof.append(sha256("".join(a + b for a, b in path).encode() + rest).hexdigest())
                    folded.append(fold(other or leaf, path + shared))
                n = len(found)
                yield pa.RecordBatch.from_arrays([
                    pa.array(r["doc_id"], pa.int64()), pa.array(found, pa.string()), pa.array([r["subroot"]] * n, pa.string()),
                    pa.array([r["top"]] * n, pa.string()), pa.array(proof, pa.string()), pa.array(folded, pa.string()),
                    pa.array([x == r["top"] for x in folded], pa.bool_())],
                    names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    known = lower.join(upper, F.col("source").eqNullSafe(F.col("name"))).select(
        F.col("source").alias("s"), F.col("cell").alias("c"), "path", F.col("root").alias("subroot"), "above", "top")
    return cells.join(known, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c"))).select(
        "n", "doc_id", "altered", "leaves", "path", "subroot", "above", "top").mapInArrow(
        proofs, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


# The crc32 of the id's digits, bit by bit; the trees level by level; each leaf's path joined from them.
MERKLE_SQL = r"""
WITH RECURSIVE ids AS (
  SELECT row_number() OVER () AS r, doc_id, source,
         [doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text] AS v,
         [doc_id::VARCHAR, source, lang, n_chars::VARCHAR,
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')] AS w,
         CASE WHEN doc_id IS NULL THEN 0 ELSE xor(list_reduce(
           list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
             lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, x: CASE WHEN x >= 0 THEN xor(c, x)
                             ELSE xor(c >> 1, 3988292384::BIGINT * (c & 1)) END), 4294967295::BIGINT) END % 5 AS fold
  FROM documents),
hashed AS (
  SELECT r, doc_id, source, fold,
         sha256(array_to_string(list_transform(v, lambda x: coalesce(strlen(x)::VARCHAR || ':' || x, '-')), '')) AS leaf,
         sha256(array_to_string(list_transform(w, lambda x: coalesce(strlen(x)::VARCHAR || ':' || x, '-')), '')) AS other
  FROM ids),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed),
low AS (
  SELECT source, 0 AS lvl, pos, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM leaves
  UNION ALL
  SELECT source, lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 15) // 16
  FROM low WHERE n > 1 GROUP BY source, lvl, pos // 16),
sources AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM low WHERE n = 1),
top AS (
  SELECT 0 AS lvl, place AS pos, subroot AS h, count(*) OVER () AS n FROM sources
  UNION ALL
  SELECT lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 15) // 16
  FROM top WHERE n > 1 GROUP BY lvl, pos // 16),
nodes AS (
  SELECT false AS upper, source, lvl, pos, h FROM low WHERE n > 1
  UNION ALL SELECT true, NULL, lvl, pos, h FROM top WHERE n > 1),
beside AS (
  SELECT a.upper, a.source, a.lvl, a.pos,
         coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM nodes a JOIN nodes b ON a.upper = b.upper AND a.source IS NOT DISTINCT FROM b.source AND a.lvl = b.lvl
                           AND a.pos // 16 = b.pos // 16
  GROUP BY ALL),
steps AS (
  SELECT x.r, b.upper, b.lvl, b.l, b.r AS rr FROM leaves x JOIN beside b
    ON NOT b.upper AND b.source IS NOT DISTINCT FROM x.source AND b.pos = x.pos // (16::BIGINT ** b.lvl)::BIGINT
  UNION ALL
  SELECT x.r, b.upper, b.lvl, b.l, b.r FROM leaves x JOIN sources s ON s.source IS NOT DISTINCT FROM x.source
    JOIN beside b ON b.upper AND b.pos = s.place // (16::BIGINT ** b.lvl)::BIGINT),
paths AS (
  SELECT r, list(l || '|' || rr ORDER BY upper, lvl) AS path, string_agg(l || rr, '' ORDER BY upper, lvl) AS beside
  FROM steps GROUP BY r),
done AS (
  SELECT x.*, s.subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(p.beside, '')) AS proof_sha256,
         list_reduce(list_prepend(CASE WHEN fold = 0 THEN other ELSE leaf END, coalesce(p.path, [])),
                     lambda d, p: sha256(split_part(p, '|', 1) || d || split_part(p, '|', 2))) AS folded_root
  FROM leaves x JOIN sources s ON s.source IS NOT DISTINCT FROM x.source LEFT JOIN paths p USING (r))
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM done
"""
