"""Patches in turn against a loop over the batch: hand-overs, failing chains, one value that most patches claim."""

import datetime as dt
import random

import pytest

from mercato.functions.rules import min_len
from mercato.operators import handover as ho

T = dt.datetime(2024, 1, 1)
TABLE = "id long, slug string, title string, updated_at timestamp_ntz"
PATCH = "n long, id long, slug string, title string"


def one_by_one(table, patches):
    rows = {i: [s, t] for i, s, t, _ in table}
    out = []
    for n, i, slug, title in sorted(patches):
        holder = next((k for k, r in rows.items() if r[0] == slug), None) if slug is not None else None
        if slug is not None and len(slug) < 2:
            out.append((n, i, "invalid"))
        elif holder is not None and holder != i:
            out.append((n, i, "conflict"))
        elif slug is None and title is None:
            out.append((n, i, "no_updates"))
        elif i not in rows:
            out.append((n, i, "not_found"))
        else:
            rows[i] = [slug or rows[i][0], title or rows[i][1]]
            out.append((n, i, "updated"))
    return out, sorted((i, *r) for i, r in rows.items())


def in_turn(spark, table, patches):
    new, out = ho.apply_patches_in_turn(
        spark.createDataFrame(table, TABLE), spark.createDataFrame(patches, PATCH), ["slug", "title"], "slug",
        dt.datetime(2024, 2, 1), rules=[("slug", "slug", min_len("slug", 2))], seq="n")
    return (sorted((r.seq, r.id, r.outcome) for r in out.collect()),
            sorted((r.id, r.slug, r.title) for r in new.collect()))


@pytest.mark.parametrize(("seed", "slab"), [(1, 200_000), (2, 7)])
def test_equals_one_by_one(spark, monkeypatch, seed, slab):
    """One slab, and many slabs of few patches; a third of the claims name one slug, a third of the patches one row."""
    monkeypatch.setattr(ho, "SLAB_ROWS", slab)
    rng = random.Random(seed)
    table = [(i, f"s{i}" if i else None, f"t{i}", T) for i in range(12)]
    patches = [(n * 3 - 40, rng.choice([1, 1, 1, *range(14), None]),
                rng.choice(["s1"] * 4 + [f"s{k}" for k in range(16)] + ["x", None]), rng.choice([None, f"new{n}"])) for n in range(150)]
    rng.shuffle(patches)
    want = one_by_one(table, sorted(patches, key=lambda p: p[0]))
    assert in_turn(spark, table, patches) == want
    assert {"updated", "conflict", "invalid", "not_found"} <= {o for _, _, o in want[0]}


def test_chains_of_hand_overs(spark):
    """Row i takes what row i + 1 gave up; once the head moves, once it fails and all fail after it."""
    table = [(i, f"s{i}", "t", T) for i in range(9)]
    moves = [(10 - i, i, f"s{i + 1}", None) for i in range(8)]
    assert in_turn(spark, table, [(1, 8, "free", None), *moves]) == one_by_one(table, [(1, 8, "free", None), *moves])
    out, rows = in_turn(spark, table, [(1, 8, "s0", None), *moves])
    assert [o for _, _, o in out] == ["conflict"] * 9 and rows == [(i, f"s{i}", "t") for i in range(9)]


def test_give_up_take_back_and_swap(spark):
    table = [(1, "aa", "t", T), (2, "bb", "t", T)]
    patches = [(1, 1, "tmp", None), (2, 2, "aa", None), (3, 1, "bb", None), (4, 1, "bb", "kept"), (5, 9, "tmp", None), (6, 9, "aa", None)]
    out, rows = in_turn(spark, table, patches)
    assert [o for _, _, o in out] == ["updated"] * 4 + ["not_found", "conflict"]
    assert rows == [(1, "bb", "kept"), (2, "aa", "t")]


def test_order_is_required_and_an_empty_batch_changes_nothing(spark):
    table = [(1, "aa", "t", T)]
    for bad in ([(1, 1, "bb", None), (1, 1, "cc", None)], [(None, 1, "bb", None)]):
        with pytest.raises(ValueError, match="tell patches apart"):
            in_turn(spark, table, bad)
    assert in_turn(spark, table, []) == ([], [(1, "aa", "t")])
