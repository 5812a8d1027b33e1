"""Queries against their SQL at the smallest scale: a cross-section here; all of them ran at sf0.001 and sf0.01."""

import duckdb
import pandas as pd
import pytest

from tidelines.queries import EV3, ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"
NAMES = ["histories", "decay", "transition_set", "change_counts", "block_counts", "compatible_pairs", "compatible_pairs_transition", "evidence", "pair_stats", "class_label", "ingest_no_decay", "feature_table", "weighted_sample", "irregular_roles", "containment", "compatible_any", "split_recursion", "split_recursion_two_lists", "relevant_dates", "lineage_count", "gold_ids", "event_table", "drawable_pairs", "decay_score", "missing_days", "synthetic_roles", "value_distribution", "ingest_between_changes", "ingest_between_all_confirmations", "ingest_outside_grace", "ingest_outside_short_grace", "ingest_probabilistic"]


def plain(df):
    df = df[sorted(df.columns)]
    text = lambda x: "null" if x is None or x is pd.NaT or x != x else f"{x:.5f}" if isinstance(x, float) else str(x).replace(" 00:00:00", "")
    return sorted(map(tuple, df.map(text).to_numpy().tolist()))


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders"):
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    assert plain(QUERIES[name](spark, D).toPandas()) == plain(con.sql(ORACLE_SQL[name]).df())


def test_feature_table_50_holds_all_entries(spark):
    entries = QUERIES["histories"](spark, D).groupBy("role_id").count().collect()
    table = {r.role_id: r.features.split("|") for r in QUERIES["feature_table_50"](spark, D).collect()}
    assert max(r["count"] for r in entries) > 10
    assert {r.role_id: r["count"] for r in entries} == {i: sum(f[:5] == "2024-" for f in x[::3]) for i, x in table.items()}
    assert {len(x) for x in table.values()} == {150}


def test_all_pairs_that_share_a_value(spark):
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{D}/events.parquet'")
    want = con.sql(EV3.replace("HAVING count(*) >= 4", "") + "SELECT id1, id2, weight FROM PW").df()
    assert (want.weight < 4).any()
    assert plain(QUERIES["block_weights_all_pairs"](spark, D).toPandas()) == plain(want)
    assert QUERIES["evidence_all_pairs"](spark, D).count() == len(want)
