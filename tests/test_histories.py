"""Hand-written histories against a plain Python model."""

import itertools
import json
import os
import random
import shutil
import subprocess
import sys
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidelines.frame import TimeFrame
from tidelines.functions import values as V
from tidelines.operators import blocking as B
from tidelines.operators import lineage as L
from tidelines.operators import order as O
from tidelines.operators import pairs as P
from tidelines.operators import sampling as S
from tidelines.plans import compatible as C

START = date(2020, 1, 1)
FRAME = TimeFrame(START, START + timedelta(days=19), 1, START + timedelta(days=12))
SCHEMA = "role_id string, ts date, value string, wc string"


def day(i):
    return START + timedelta(days=i)


def histories(seed, n=14):
    """Random histories from START on: values a, b, null, or a marker."""
    rng, out = random.Random(seed), {}
    for r in range(n):
        days = [0, *sorted(rng.sample(range(1, 20), rng.randint(0, 5)))]
        out[f"r{r:02d}"] = {d: rng.choice([("a", None), ("b", None), (None, None), (None, "DE"), (None, "R")]) for d in days}
    return out


def frame_of(spark, hs):
    return spark.createDataFrame([(r, day(d), v, w) for r, h in hs.items() for d, (v, w) in h.items()], SCHEMA)


def at(h, d):
    return h[max(x for x in h if x <= d)]


def fits(x, y):
    return x[1] is not None or y[1] is not None or x[0] == y[0]


@pytest.fixture(scope="module")
def case(spark):
    hs = histories(3)
    df = frame_of(spark, hs).cache()
    pairs = spark.createDataFrame(list(itertools.combinations(sorted(hs), 2)), "id1 string, id2 string").cache()
    return hs, df, pairs


def test_wildcard_truth_table(spark):
    kinds = [("a", None), ("b", None), (None, None), (None, "DE"), (None, "R")]
    rows = [(*x, *y) for x in kinds for y in kinds]
    df = spark.createDataFrame(rows, "v1 string, w1 string, v2 string, w2 string")
    c = [F.col(k) for k in ("v1", "w1", "v2", "w2")]
    for r in df.select("*", V.compatible(*c).alias("c"), V.same_raw(*c).alias("s")).collect():
        x, y = (r.v1, r.w1), (r.v2, r.w2)
        assert (r.c, r.s) == (fits(x, y), x == y)


def test_containment(spark):
    df = spark.createDataFrame([("a b", "b"), ("a a", "a"), ("a b", "b c"), (None, "null x")], "v1 string, v2 string")
    n = F.lit(None).cast("string")
    assert [r.c for r in df.select(V.contained(F.col("v1"), n, F.col("v2"), n).alias("c")).collect()] == [True, True, False, True]


def test_grid_and_as_of(case):
    hs, df, _ = case
    got = {(r.role_id, r.d): (r.value, r.wc) for r in L.grid_cells(df, FRAME).collect()}
    assert got == {(k, day(d)): at(h, d) for k, h in hs.items() for d in range(20)}
    assert {r.role_id: (r.value, r.wc) for r in L.value_at(df, day(7)).collect()} == {k: at(h, 7) for k, h in hs.items()}


def test_projection(case):
    hs, df, _ = case
    got = {(r.role_id, r.ts): (r.value, r.wc) for r in L.project(df, day(4), day(9)).collect()}
    assert got == {(k, day(d)): at(h, d) for k, h in hs.items() for d in range(4, 10) if d == 4 or d in h}


def test_pair_validity_share_and_evidence(case):
    hs, df, pairs = case
    valid = {(r.id1, r.id2): r.valid for r in P.stays_valid(pairs, df).collect()}
    share = {(r.id1, r.id2): r.share for r in P.compatibility_share(pairs, df, FRAME).collect()}
    ev = {(r.id1, r.id2): r.evidence for r in P.evidence(pairs, df).collect()}
    for a, b in itertools.combinations(sorted(hs), 2):
        x, y = hs[a], hs[b]
        ok = all(fits(at(x, d), at(y, d)) for d in range(20))
        assert valid[a, b] == ok
        assert share[a, b] == pytest.approx(sum(fits(at(x, d), at(y, d)) for d in range(12)) / 12)
        n = sum(at(x, d)[1] is at(y, d)[1] is at(x, d - 1)[1] is at(y, d - 1)[1] is None for d in set(x) & set(y) - {0})
        assert ev[a, b] == (n if ok else -1)


def test_compatible_pairs_by_brute_force(case):
    hs, df, _ = case
    known = lambda h, d: at(h, d)[1] is None

    def changes(h):
        k = [h[d][0] for d in sorted(h) if d <= 12 and h[d][1] is None]
        return any(x != y for x, y in itertools.pairwise(k))

    want, every = {}, set()
    for a, b in itertools.combinations(sorted(k for k, h in hs.items() if changes(h)), 2):
        both = [d for d in range(13) if known(hs[a], d) and known(hs[b], d)]
        if all(at(hs[a], d) == at(hs[b], d) for d in both):
            every.add((a, b))
            if both:
                want[a, b] = len(both)
    assert {(r.id1, r.id2): r.n_shared for r in C.compatible_pairs(df, FRAME).collect()} == want
    assert {(r.id1, r.id2) for r in C.compatible_any(df, FRAME).collect()} == every


def decayed(h, theta):
    days = sorted(h)
    ds = sorted(b - a for a, b in itertools.pairwise(days) if b <= 12)
    if theta >= 1 or not ds:
        return h
    k = -(-theta * len(ds) // 1) - 1
    cut = ds[int(k)] if k >= 0 else 1
    out = dict(h)
    for a, b in itertools.pairwise([*days, 19]):
        if h[a][1] is None and b - a > cut:
            out[a + cut] = (None, "DE")
    return out


@pytest.mark.parametrize("theta", [1.0, 0.57, 0.3, 0.0])
def test_decay(case, theta):
    hs, df, _ = case
    got = {(r.role_id, r.ts): (r.value, r.wc) for r in L.decay(df, theta, FRAME).collect()}
    assert got == {(k, day(d)): e for k, h in hs.items() for d, e in decayed(h, theta).items()}


def test_decay_score_by_brute_force(spark):
    hs = histories(9, 7)
    df = frame_of(spark, hs)
    pairs = spark.createDataFrame(list(itertools.combinations(sorted(hs), 2)), "id1 string, id2 string")
    got = {(r.id1, r.id2): r.decay_score for r in P.decay_score(pairs, df, FRAME, step=0.1).collect()}
    for (a, b), score in got.items():
        ok = [t for t in (round(1 - i / 10, 6) for i in range(11)) if all(fits(at(decayed(hs[a], t), d), at(decayed(hs[b], t), d)) for d in range(19))]
        assert score == (max(ok) if ok else -1)


def test_blocker_containment(case):
    _, df, _ = case
    found = {m: {(r.id1, r.id2) for r in B.block_pairs(k).collect()} for m, k in B.keys(df, FRAME).items()}
    tiled = B.block_pairs(B.keys(df, FRAME)["vsm"], width=2).collect()
    assert len(tiled) == len(found["vsm"]) and {(r.id1, r.id2) for r in tiled} == found["vsm"]
    assert found["em"] <= found["cqm"] <= found["vsm"]
    assert found["em"] <= found["tsm"]
    counts = {r.method: r.n_pairs for r in B.block_counts(df, FRAME).collect()}
    assert counts == {m: len(p) for m, p in found.items()}


def test_overlap_domain_means_compatibility(case):
    hs, df, _ = case
    q = {r.role_id: set(r.tokens) for r in B.overlap_domain(df, FRAME, query=True).collect()}
    i = {r.role_id: set(r.tokens) for r in B.overlap_domain(df, FRAME, query=False).collect()}
    for a, b in itertools.combinations(sorted(hs), 2):
        meets = len({t.rsplit("_", 1)[1] for t in q[a] & i[b]})
        assert (meets == 13) == all(fits(at(hs[a], d), at(hs[b], d)) for d in range(13))


def test_injected_missing_days_reach_the_share(spark):
    df = spark.createDataFrame([("r", START, "a", None), ("r", day(5), "b", None)], SCHEMA)
    cells = L.grid_cells(S.inject_missing_days(df, FRAME, 0.3), FRAME, last=FRAME.train_end)
    assert cells.where("wc is not null").count() == int(13 * 0.3)
    assert {r.value for r in cells.where("wc is null").collect()} == {"a", "b"}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert C.compatible_pairs(df, FRAME).count() == 0
    assert L.decay(df, 0.5, FRAME).count() == L.grid_cells(df, FRAME).count() == 0


def test_synthetic_roles_and_subsample(case):
    hs, df, _ = case
    made = S.synthetic_roles(df, 20)
    assert made.select("role_id").distinct().count() == 20
    assert S.subsample_roles(df, 0.5).select("role_id").distinct().count() == len(hs) // 2


def test_exchange_formats(spark, case, tmp_path):
    from tidelines.sources import io

    _, df, pairs = case
    io.write_roleset(df, str(tmp_path / "roles"))
    plain = lambda x: sorted(map(tuple, x.select("role_id", "ts", "value", "wc").collect()), key=str)
    assert plain(io.read_roleset(spark, str(tmp_path / "roles"), lines=True)) == plain(df)
    odd = spark.createDataFrame([('a "b"\\,\n', "2020-01-01", "x\ny \"z\"", None), ("ä", "2020-01-02", None, None), ("ä", "2020-01-01", None, "R")], "role_id string, ts string, value string, wc string").withColumn("ts", F.to_date("ts"))
    for i, some in enumerate((df, odd, df.limit(0))):
        io.write_roleset_document(some, str(tmp_path / f"document{i}"))
        assert plain(io.read_roleset(spark, str(tmp_path / f"document{i}"))) == plain(some)
    [file] = (tmp_path / "document0").glob("part-*")
    document = json.loads(file.read_text())
    assert document["rolesSortedByID"] == sorted(document["rolesSortedByID"]) and len(document["rolesSortedByID"]) == 14
    assert [document["positionToRoleLineage"][str(i)]["id"] for i in range(14)] == document["rolesSortedByID"]
    io.write_pairs(pairs, str(tmp_path / "pairs"))
    assert io.read_pairs(spark, str(tmp_path / "pairs")).exceptAll(pairs).count() == 0
    (tmp_path / "g.json").write_text('{"roleIds":["a","b","c"]}\n{"leftIds":["x"],"rightIds":["y","z"]}\n{"roleIds":["q"]}\n')
    got = C.expand_groups(io.read_groups(spark, str(tmp_path / "g.json"))).collect()
    assert {tuple(r) for r in got} == {("a", "b"), ("a", "c"), ("b", "c"), ("x", "y"), ("x", "z")}
    (tmp_path / "r.json").write_text('{"rolesSortedByID":["p"],"positionToRoleLineage":{"0":{"id":"p","factLineage":{"lineage":{"2020-01-01":"⊥R","2020-01-03":"v","2020-01-05":null}}}}}')
    assert {tuple(r)[2:] for r in io.read_roleset(spark, str(tmp_path / "r.json")).collect()} == {(None, "R"), ("v", None), (None, None)}


def test_streaming_counts_equal_batch_counts(spark, tmp_path):
    from tidelines.sources.tables import event_revisions
    from tidelines.streaming.ingest import bucket_counts

    d = "/root/testdata/sf0.001"
    batch = bucket_counts(event_revisions(spark, d), FRAME)
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    k = F.get_json_object("props", "$.k").cast("int") % 3
    rev = stream.select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("property"), F.col("ts").cast("timestamp").alias("valid_from"), F.concat(F.lit("k"), k.cast("string")).alias("value"))
    q = bucket_counts(rev, FRAME).writeStream.outputMode("complete").format("memory").queryName("buckets").trigger(availableNow=True).option("checkpointLocation", str(tmp_path)).start()
    q.awaitTermination(60)
    rows = lambda x: sorted(map(tuple, x.select(sorted(x.columns)).collect()), key=str)
    assert rows(spark.table("buckets")) == rows(batch) != []


def test_positions_and_running_sums_over_many_ranges(spark):
    rows = [(i * 7919 % 1000, i % 5) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, n int").repartition(9)
    want = {k: (i, sum(n for _, n in sorted(rows)[: i + 1])) for i, (k, _) in enumerate(sorted(rows))}
    got = O.running_sum(O.position(df, [F.col("k")], "at"), [F.col("k")], F.col("n"), "upto")
    assert {r.k: (r["at"], r.upto) for r in got.collect()} == want
    assert O.position(df.limit(0), [F.col("k")], "at").count() == 0


def test_line_numbers_follow_the_file(spark, tmp_path):
    from tidelines.sources import io

    lines = [f"line {i}" for i in range(5000)]
    (tmp_path / "lines.txt").write_text("\n".join(lines) + "\n")
    got = io.with_line_numbers(spark.read.text(str(tmp_path / "lines.txt"))).collect()
    assert [r.value for r in sorted(got, key=lambda r: r.line)] == lines and {r.line for r in got} == set(range(5000))


def test_entry_works_without_the_corpus_operators(tmp_path):
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "tidelines", tmp_path / "tidelines", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    ask = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(set(e.oracle_sql()) - set(q)), sum(n.startswith('op') or n == 'pipeline' for n in q))"
    found = subprocess.run([sys.executable, "-c", ask], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    n, without, corpus = map(int, found.stdout.split())
    assert n > 100 and not without and not corpus
