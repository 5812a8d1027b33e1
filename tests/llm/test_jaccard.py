"""The Jaccard join against brute force."""

import random

import numpy as np
import pytest

from tidelines.llm import jaccard, queries

from .odd import DOCS, WORDS, D, odd_docs

SCHEMA = "doc_id long, text string, class_id string"


def shingle_sets(rows, width):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(zip(*(w[k:] for k in range(width)))) if len(w) >= width else frozenset({tuple(w)} if w else ())
    return sets


def links(sets, num, den):
    """Pairs a < b of ids that link."""
    by_set = {}
    for i, s in sets.items():
        by_set.setdefault(s, []).append(i)
    found, kinds = set(), [s for s in by_set if s]
    for k, s in enumerate(kinds):
        for t in kinds[k:]:
            both = len(s & t)
            if den * both >= num * (len(s) + len(t) - both):
                found |= {(min(a, b), max(a, b)) for a in by_set[s] for b in by_set[t] if a != b}
    return found


def components(rows, width, num, den):
    sets = shingle_sets(rows, width)
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links(sets, num, den):
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def groups(rng, sizes, members, edits):
    """Texts in groups of near copies, some of them exact."""
    rows = []
    for n in sizes:
        base = [rng.choice(WORDS) + str(rng.randint(0, 400)) for _ in range(n)]
        for _ in range(members):
            w = list(base)
            for _ in range(rng.randint(0, max(1, int(n * edits)))):
                w[rng.randrange(len(w))] = f"new{rng.randint(0, 9)}"
            rows.append(" ".join(w[rng.randint(0, 1) :]))
    return rows


def frame(spark, rows, parts):
    return spark.createDataFrame([(i, t, "c") for i, t in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize(("width", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_components(spark, width, num, den, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT_FROM", 8)  # so that combinations of frequent tokens are used
    monkeypatch.setattr(jaccard, "TILE", 20)
    rows = groups(random.Random(6), (12, 30, 150, 300), 60, 0.04)
    rows += ["Two Words", "two  words", "", None, "solo", "solo", "A b c", "a B\tc"]
    data = list(enumerate(rows))
    df = frame(spark, data, 3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_components(df, width, num, den).collect()}
    assert got == components(data, width, num, den)


def test_all_links(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT_FROM", 8)
    monkeypatch.setattr(jaccard, "TILE", 20)
    data = list(enumerate([*groups(random.Random(7), (12, 40, 200), 50, 0.03), "", None, "x", "x"]))
    pairs, rows = jaccard.join_links(frame(spark, data, 5), 3, 90, 100)
    sets = shingle_sets(data, 3)
    want = links(sets, 90, 100)
    least = {}
    for i, s in sorted(sets.items()):
        least.setdefault(s, i)
    named = {(min(x, y), max(x, y)) for x, y in ((least[sets[a]], least[sets[b]]) for a, b in want) if x != y}
    assert {(r.class_a, r.class_b) for r in pairs.collect()} == named
    for r in pairs.collect():
        a, b = sets[r.class_a], sets[r.class_b]
        assert (r.shared, r.united) == (len(a & b), len(a | b))
    degree = {i: 0 for i in sets}
    for a, b in want:
        degree[a] += 1
        degree[b] += 1
    got = rows.collect()
    assert {r.doc_id: r.n_links for r in got} == degree
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(data, 3, 90, 100)


def test_copies_over_many_partitions(spark):
    """Six rows in partitions of their own: each link hangs on one key, and copies of a class lie in two tasks."""
    rng = random.Random(8)
    data = []
    for k in range(12):
        w = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(20, 24))]
        data += [(10 * k + i, " ".join(x)) for i, x in enumerate((w, [*w, "more"], w[1:], w[1:], w[:-1], w[:-1]))]
    df = spark.createDataFrame(spark.sparkContext.parallelize([(i, t, "c") for i, t in data], len(data)), SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_components(df).collect()}
    assert got == components(data, 3, 90, 100)


@pytest.mark.parametrize("seed", [1])
def test_random_texts_with_copies(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT_FROM", 3 + 5 * seed)
    monkeypatch.setattr(jaccard, "TILE", 8 << seed)
    rng = random.Random(100 + seed)
    rows = groups(rng, [rng.randint(3, 60) for _ in range(25)], 9, 0.06)
    rows += [t for t in rows for _ in range(rng.choice((0, 0, 0, 1, 3)))]
    rng.shuffle(rows)
    data = list(enumerate(rows))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_components(frame(spark, data, 20)).collect()}
    assert got == components(data, 3, 90, 100)


def test_registered_query(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op7_jaccard(spark, D).collect()}
    assert got == components([tuple(r) for r in docs], 3, 90, 100)


def test_keys_with_copies_in_several_tasks_keep_their_own_members(spark):
    keys = {2: [-9, 4, 70], 4: [-9, 5, 70], 7: [-9, 6, 7, 70], 9: [-9, 8, 11, 70]}
    rows = [(k, c, 20) for k, classes in keys.items() for c in classes] * 2
    path = spark.conf.get("spark.checkpoint.dir") + "/tidelines/keys-test"
    spark.createDataFrame(rows, "key long, cls long, n int").repartition(3).write.mode("overwrite").parquet(path)
    got = jaccard.key_members(spark.read.parquet(path)).select("key", "cls").collect()
    assert sorted(got) == sorted((k, c) for k, classes in keys.items() for c in classes)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard.join_components(docs).collect())
    assert got == [(0, 0), (1, 1), (2, 2), (4, 4), (5, 4), (6, 6), (7, 7), (7, 7), (8, 8)]
    assert sorted(r.doc_id or 0 for r in jaccard.one_of_each(docs).collect()) == [0, 1, 2, 4, 6, 7, 8]
    empty = spark.createDataFrame([], DOCS)
    assert jaccard.join_components(empty).count() == 0 and jaccard.one_of_each(empty).count() == 0
    assert [x.count() for x in jaccard.join_links(empty)] == [0, 0]


def test_one_id_with_two_texts_is_one_document(spark):
    a, b = "a b c d e f g h i j k l", "n o p q r s t u v w x y"
    df = spark.createDataFrame([(3, a), (5, a), (5, b), (9, b), (1, "z")], "doc_id long, text string").repartition(4)
    assert sorted((r.doc_id, r.component_id) for r in jaccard.join_components(df).collect()) == [(1, 1), (3, 3), (5, 3), (5, 3), (9, 3)]


@pytest.mark.parametrize("num", (60, 80, 90, 99))
def test_index_keys_of_similar_sets_meet(num):
    rng = np.random.default_rng(7)
    for n in [2, 3, 5, 8, 9, 20, 63, 64, 70, 120, 128, 140, 400, 2000]:
        for frequent in (0.0, 0.3, 0.5, 0.97, 1.0):
            for _ in range(5):
                base = np.unique(rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64))
                table = np.zeros(1 << jaccard.CELL_BITS, bool)
                table[(base[rng.random(len(base)) < frequent] >> np.uint64(64 - jaccard.CELL_BITS)).astype(np.int64)] = True
                s = np.sort(rng.permutation(base)[:n])
                new, t = np.setdiff1d(base, s), s
                while True:  # drop and add while the two are similar
                    kept = np.delete(t, rng.integers(len(t)))
                    u = np.union1d(kept, new[: rng.integers(0, 2)])
                    both = len(np.intersect1d(s, u))
                    if len(u) < 2 or 100 * both < num * (len(s) + len(u) - both):
                        break
                    t = u
                    new = np.setdiff1d(new, u)
                x, y = (np.concatenate(jaccard.index_keys(z, table, num, 100)) for z in (s, t))
                assert len(np.intersect1d(x, y))


def test_tokens_are_counted_over_all_tasks(spark):
    """A token that each task sees once is frequent if the tasks are many."""
    rows = [(i, f"common text here r{i} s{i} t{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(100)
    table = jaccard.frequent_table(jaccard.profile(df, 3, "doc_id", "text"))
    token = jaccard.shingles("common text here", 3, jaccard.word_hashes())[0]
    assert table[int(token >> np.uint64(64 - jaccard.CELL_BITS))] and table.sum() == 1
