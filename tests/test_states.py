"""Statistics of pairs from masks against the pieces of the common timeline, and that they shuffle no pair."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelines.frame import TimeFrame
from tidelines.functions.values import compatible, contained, same_raw
from tidelines.operators import groups as R
from tidelines.operators import lineage as L
from tidelines.operators import meeting as M
from tidelines.operators import pairs as P
from tidelines.operators import sampling as S

FRAME = TimeFrame(date(2024, 1, 1), date(2024, 5, 9), 1, date(2024, 3, 20))


@pytest.fixture(scope="module")
def histories(spark):
    rng = random.Random(8)
    rows = []
    for i in range(24):
        for n in sorted(rng.sample(range(0, 130, 1 + i % 3), rng.choice((1, 2, 9, 30)))):
            v, w = rng.choice([("a", None), ("a b", None), ("null", None), (None, None), ("c a", None), (None, "DE"), (None, "R")] if i % 4 else [("a", None), ("a", None), (None, "DE")])
            rows.append((f"r{i}", date(2024, 1, 1) + timedelta(n), v, w))
    return spark.createDataFrame(rows, "role_id string, ts date, value string, wc string").checkpoint()


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(f"r{i}", f"r{j}") for i in range(24) for j in range(24) if i != j and (i + j) % 3], "id1 string, id2 string")


def rows(df, *cols):
    return sorted(map(str, df.select(*cols).collect() if cols else df.collect()))


def numbered(pairs, histories):
    w = Window.partitionBy("id1", "id2").orderBy("valid_from")
    return P.pieces(pairs, histories).withColumn("i", F.row_number().over(w)), w


def both_ways(monkeypatch, f):
    """With masks sent to every task, and dealt by id."""
    sent = rows(f())
    monkeypatch.setattr(M, "BROADCAST_LONGS", 0)
    assert rows(f()) == sent
    return sent


def test_change_points(pairs, histories, monkeypatch):
    p, w = numbered(pairs, histories)
    b = F.lag(F.struct("v1", "w1", "v2", "w2", "valid_from")).over(w)
    p = p.withColumn("b", b).withColumn("is_last", F.lead("valid_from").over(w).isNull()).where("b is not null")
    want = p.select("id1", "id2", F.col("valid_from").alias("ts"), F.col("b.v1").alias("prev1"), F.col("b.w1").alias("prev_w1"), F.col("b.v2").alias("prev2"), F.col("b.w2").alias("prev_w2"), F.col("v1").alias("cur1"), F.col("w1").alias("cur_w1"), F.col("v2").alias("cur2"), F.col("w2").alias("cur_w2"), F.col("b.valid_from").alias("prev_ts"), "is_last")
    assert both_ways(monkeypatch, lambda: P.change_points(pairs, histories).select(want.columns)) == rows(want)


@pytest.mark.parametrize("few", [16, 0])
def test_validity_and_agreements(pairs, histories, monkeypatch, few):
    monkeypatch.setattr(P, "FEW", few)
    p, _ = numbered(pairs, histories)
    for test, words in ((compatible, False), (contained, True)):
        assert rows(P.stays_valid(pairs, histories, words)) == rows(p.groupBy("id1", "id2").agg(F.bool_and(test(*P._cols())).alias("valid")))
    hit = (F.col("i") > 1) & F.col("w1").isNull() & F.col("w2").isNull() & F.col("v1").eqNullSafe(F.col("v2"))
    want = p.groupBy("id1", "id2").agg(F.count_distinct(F.when(hit, F.coalesce("v1", F.lit("null")))).alias("dva_count"))
    assert rows(P.distinct_agreements(pairs, histories)) == rows(want)


def test_share_by_lengths(pairs, histories, monkeypatch):
    p = P.pieces(pairs, histories).where((F.col("valid_from") < F.lit(FRAME.train_end)) & (F.col("valid_to") > F.lit(FRAME.start)))
    days = F.datediff(F.least("valid_to", F.lit(FRAME.train_end)), F.greatest("valid_from", F.lit(FRAME.start)))
    want = p.groupBy("id1", "id2").agg((F.coalesce(F.sum(F.when(compatible(*P._cols()), days)), F.lit(0)) / (FRAME.train_end - FRAME.start).days).alias("share"))
    assert both_ways(monkeypatch, lambda: P.compatibility_share(pairs, histories, FRAME)) == rows(want)


def test_evidence_common_dates_and_label(pairs, histories):
    both = P._both_change(pairs, histories).where("p1.wc is null and p2.wc is null").groupBy("id1", "id2").agg(F.count(F.lit(1)).alias("n"))
    v = P.stays_valid(pairs, histories).join(both, ["id1", "id2"], "left")
    want = v.select("id1", "id2", F.when(F.col("valid"), F.coalesce("n", F.lit(0))).otherwise(-1).cast("bigint").alias("evidence")).join(R.common_change_dates(pairs, histories), ["id1", "id2"])
    assert rows(P.evidence_and_common(pairs, histories)) == rows(want)
    cells = L.grid_cells(L.remove_decayed(histories), FRAME).where(F.col("d") > F.lit(FRAME.train_end))
    same = {(r.id1, r.id2): r.same for r in P.aligned(pairs, cells).groupBy("id1", "id2").agg(F.bool_and(same_raw(*P._cols())).alias("same")).collect()}
    changes = {r.role_id for r in P.first_real_change(histories, FRAME.train_end).where("change_ts is not null").collect()}
    got = {(r.id1, r.id2): r.label for r in P.class_label(pairs, histories, FRAME).collect()}
    assert got == {(r.id1, r.id2): same.get((r.id1, r.id2)) if {r.id1, r.id2} & changes else None for r in pairs.collect()}
    assert {None, False} <= set(got.values())


def test_decay_score_by_trying_all_cutoffs(spark):
    frame = TimeFrame(date(2024, 1, 1), date(2024, 1, 30), 1, date(2024, 1, 21))
    rng = random.Random(2)
    day = lambda n: date(2024, 1, 1) + timedelta(n)
    by = {f"r{i}": [(n, rng.choice("ab" if i % 2 else "bc")) for n in sorted(rng.sample(range(30), rng.choice((1, 2, 3, 4))))] for i in range(14)}
    h = spark.createDataFrame([(r, day(n), v, None) for r, e in by.items() for n, v in e], "role_id string, ts date, value string, wc string")
    ids = [(a, b) for a in by for b in by if a < b]

    def spans(e, theta):
        ds = sorted(b[0] - a[0] for a, b in zip(e, e[1:], strict=False) if b[0] <= 20)
        k = -int(-len(ds) * theta // 1)
        cut = 1 << 30 if theta >= 1 or not ds else 1 if k < 1 else ds[k - 1]
        ends = [n for n, _ in e[1:]] + [29]
        return [(n, n + min(t - n, cut), t, v) for (n, v), t in zip(e, ends, strict=True)]

    def score(a, b):
        for theta in (1.0, 0.75, 0.5, 0.25, 0.0):
            x, y = spans(by[a], theta), spans(by[b], theta)
            if all(p[1] <= q[0] or q[1] <= p[0] for p in x for q in y if p[0] < q[2] and q[0] < p[2] and p[3] != q[3]):
                return theta
        return -1.0

    want = {p: score(*p) for p in ids}
    got = {(r.id1, r.id2): r.decay_score for r in P.decay_score(spark.createDataFrame(ids, "id1 string, id2 string"), h, frame, 0.25).collect()}
    assert got == want and len(set(want.values())) > 3


@pytest.mark.parametrize("dense", [0, 10**9])
def test_agreements_in_memory_or_by_key(spark, monkeypatch, dense):
    rng = random.Random(4)
    cells = [(f"r{i}", day, rng.choice((None, "", "a", "b"))) for i in range(30) for day in [date(2024, 1, 1) + timedelta(n) for n in rng.sample(range(90), 8)]]
    by = {}
    for r, d, v in cells:
        by.setdefault(r, {})[d] = v
    want = {(a, b, n, len(by[a].keys() & by[b].keys())) for a in by for b in by if a < b and (n := sum(by[a][d] == by[b][d] for d in by[a].keys() & by[b].keys()))}
    monkeypatch.setattr(M, "DENSE", dense)
    found = M.agreements(spark.createDataFrame(cells, "role_id string, d date, value string"), 3)
    assert ("BroadcastNestedLoopJoin" in found._jdf.queryExecution().executedPlan().toString()) == bool(dense)
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_statistics_deal_no_pair(histories):
    pairs = S.block_weights(histories, FRAME)
    for f in (P.change_points, P.stays_valid, P.distinct_agreements, P.evidence, P.evidence_and_common, lambda p, h: P.stays_valid(p, h, True), lambda p, h: P.compatibility_share(p, h, FRAME), lambda p, h: P.class_label(p, h, FRAME), lambda p, h: P.decay_score(p, h, FRAME)):
        found = f(pairs, histories)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(id1" not in found and "Window" not in found
