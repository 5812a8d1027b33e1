"""Pairs that meet: bits against brute force, both ways of bringing histories beside pairs, and what is shuffled."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidelines.frame import TimeFrame
from tidelines.operators import blocking as B
from tidelines.operators import meeting as M
from tidelines.operators import pairs as P
from tidelines.operators import sampling as S
from tidelines.plans import compatible as C
from tidelines.plans import split_tree as ST

FRAME = TimeFrame(date(2024, 1, 1), date(2024, 5, 9), 1, date(2024, 5, 1))


@pytest.fixture(scope="module")
def cells(spark):
    rng = random.Random(5)
    rows = []
    for i in range(40):
        for n in sorted(rng.sample(range(130), rng.choice((0, 1, 3, 25, 60)))):
            rows.append((f"r{i}", date(2024, 1, 1) + timedelta(n), rng.choice((None, "", "a", "b", "c") if i % 2 else ("a",))))
    return rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("width", [2, 1000])
def test_agreements_by_brute_force(spark, cells, width):
    by = {}
    for r, d, v in cells:
        by.setdefault(r, {})[d] = v
    want = set()
    for a in by:
        for b in by:
            both = by[a].keys() & by[b].keys()
            if a < b and (n := sum(by[a][d] == by[b][d] for d in both)):
                want.add((a, b, n, len(both)))
    got = M.agreements(spark.createDataFrame(cells, "role_id string, d date, value string"), width).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want
    assert len({d for _, d, _ in cells}) > M.WORD


def test_without_conflict_by_brute_force(spark, cells):
    by = {f"r{i}": {} for i in range(40)}
    for r, d, v in cells:
        by[r][d] = v
    fits = lambda a, b: all(by[a][d] == by[b][d] for d in by[a].keys() & by[b].keys())
    left = {r for r in by if int(r[1:]) % 3 == 0}
    nodes = [("n", False, "A", r) for r in by] + [("m", True, "L" if r in left else "R", r) for r in by]
    table = spark.createDataFrame(nodes, "node string, two boolean, side string, role_id string")
    known = spark.createDataFrame(cells, "role_id string, d date, value string")
    for two in (False, True):
        want = sorted((a, b) for a in by for b in by if a < b and fits(a, b) and (not two or (a in left) != (b in left)))
        assert sorted(map(tuple, M.without_conflict(table.where(F.col("two") == two), known, width=3).collect())) == want


def test_an_empty_table_has_no_pairs(spark):
    none = spark.createDataFrame([], "role_id string, d date, value string")
    assert M.agreements(none).count() == 0


@pytest.fixture(scope="module")
def histories(spark, cells):
    return spark.createDataFrame([(r, d, v, None if i % 4 else "DE") for i, (r, d, v) in enumerate(cells)], "role_id string, ts date, value string, wc string")


def test_histories_dealt_by_id_give_the_same(spark, histories, monkeypatch):
    pairs = S.block_weights(histories, FRAME)
    names = {"pieces": lambda: P.pieces(pairs, histories), "overlap": lambda: P.transition_overlap(pairs, histories), "decay": lambda: P.decay_score(pairs, histories, FRAME)}
    sent = {n: sorted(map(str, f().collect())) for n, f in names.items()}
    monkeypatch.setattr(M, "BROADCAST_ENTRIES", 0)
    assert all(sent.values()) and sent == {n: sorted(map(str, f().collect())) for n, f in names.items()}


def test_no_pair_is_shuffled(spark, histories):
    for found in (S.block_weights(histories, FRAME), C.compatible_pairs(histories, FRAME), ST.compatible_by_splits(histories, FRAME)):
        assert "keys=[id1" not in plan(found) and not any("id1" in line and "id2" in line for line in plan(found).splitlines() if "Exchange" in line)


def test_keys_are_sent_only_where_hashes_clash(spark):
    rows = spark.createDataFrame([(f"r{i}", "long key " * 50 + str(i % 2)) for i in range(30)], "role_id string, key string")
    found = B.block_pairs(rows, width=4)
    assert found.count() == 2 * 15 * 14 // 2
    assert "lo#" in plan(found)
