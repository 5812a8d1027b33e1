"""Roles with equal histories: compared once for all of them, with the rows that SQL gives."""

import duckdb
import pytest

from tidelines.operators import meeting as M
from tidelines.queries import ORACLE_SQL, QUERIES

from test_oracle import plain

COPIES = 12
ONCE = ["agreeing_pairs", "block_weights_all_pairs", "compatible_any", "compatible_pairs", "split_recursion", "split_recursion_two_lists"]
BESIDE = ["agreeing_pairs", "change_points", "class_label_all_pairs", "compatible_pairs_transition", "decay_score", "drawable_pairs_all_pairs"]


def copied(folder, n):
    source = "'/root/testdata/sf0.001/events.parquet'"
    duckdb.connect().sql(f"copy (select * replace (event_id + i * 1000000 as event_id, user_id + i * 1000 as user_id) from {source}, range(0, {n}) r(i)) to '{folder}/events.parquet' (format parquet)")
    return str(folder)


@pytest.fixture(scope="module")
def few(tmp_path_factory):
    return copied(tmp_path_factory.mktemp("few"), 3)


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    return copied(tmp_path_factory.mktemp("many"), COPIES)


def sql_of(name):
    return ORACLE_SQL[name] if name in ORACLE_SQL else ORACLE_SQL[name.removesuffix("_all_pairs")].replace("HAVING count(*) >= 4", "")


@pytest.mark.parametrize("name", sorted({*ONCE, *BESIDE}))
def test_copies_have_the_rows_of_sql(spark, few, name, monkeypatch):
    monkeypatch.setattr(M, "UNIT", 2)  # more than one unit of equal histories
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{few}/events.parquet'")
    assert plain(QUERIES[name](spark, few).toPandas()) == plain(con.sql(sql_of(name)).df())


@pytest.mark.parametrize("name", ONCE)
def test_copies_meet_others_as_one(spark, few, many, name, monkeypatch):
    seen, tiles = [], M.tiles
    monkeypatch.setattr(M, "DENSE", 0)
    monkeypatch.setattr(M, "tiles", lambda rows, *more: seen.append(rows.count()) or tiles(rows, *more))
    for folder in (few, many):
        QUERIES[name](spark, folder)
    assert 0 < seen[1] < 2 * seen[0]  # a list of two may have a history in some copies only


@pytest.mark.parametrize("name", BESIDE)
def test_no_pair_is_shuffled_for_copies(spark, many, name, monkeypatch):
    # less than all histories have, more than the different ones
    monkeypatch.setattr(M, "BROADCAST_ENTRIES", 2500)
    monkeypatch.setattr(M, "BROADCAST_LONGS", 1000)
    plan = QUERIES[name](spark, many)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if ("Exchange hash" in line or "SortMergeJoin" in line) and ("id1#" in line or "id2#" in line)]
