"""Syncmer fingerprints against a plain version."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidelines.llm import fingerprints as fp
from tidelines.llm import queries

from .odd import DOCS, WORDS, D, odd_docs, sha

SCRIPTS = ("abcdefghij ", "中国人民的一是了我们他这", "กขคงจฉชซฌญฎ", "абвгдежзий ", "ابتثجحخدذ", "01234567", "🙂😀🎉a𝒜字", "ACGT")


LAST = set("048dDLT \t\n\x0b\f\r")


def units(text):
    out = [""]
    for c in text:
        out[-1] += c
        if c in LAST or ord(c) >= 0x100:
            out.append("")
    return out if out[-1] else out[:-1]


def hashed(spark, lists):
    """Spark's hash of each list of numbers."""
    known = {}
    for n in {len(x) for x in lists}:
        rows = spark.createDataFrame(sorted({tuple(x) for x in lists if len(x) == n}), ", ".join(f"c{i} long" for i in range(n)))
        known |= {tuple(r)[:n]: r.h for r in rows.select("*", F.xxhash64(*rows.columns).alias("h")).collect()}
    return known


def test_anchors_are_closed_syncmers(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(a) for _ in range(n)) for a in SCRIPTS for n in (1, 5, 6, 7, 40, 300)] + ["x" * 500, "abct" * 50, "", None, "d\r\n é"]
    df = fp.with_anchors(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text", "a")
    got = {r.i: [tuple(a) for a in r.a] for r in df.collect()}
    words = {w for t in texts for w in units(t or "")}
    one = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    us = [[one[w] for w in units(t or "")] for t in texts]
    two = hashed(spark, [u[i : i + 2] for u in us for i in range(len(u) - 1)])
    inner = [[two[tuple(u[i : i + 2])] for i in range(len(u) - 1)] for u in us]
    key = lambda u, s, i: (s[i], s[i + 2], s[i + 4], u[i + 5])
    four = hashed(spark, [key(u, s, i) for u, s in zip(us, inner) for i in range(len(u) - 5)])
    for k, (u, s) in enumerate(zip(us, inner)):
        want = [(i, (four[key(u, s, i)] % (1 << 64)) >> 32) for i in range(len(u) - 5) if min(s[i : i + 5]) in (s[i], s[i + 4])]
        if want:
            assert got[k] == want
        else:
            assert len(got[k]) == bool(u) and all(a[0] == 0 for a in got[k])
    assert sum(map(len, got.values())) > 500


@pytest.mark.parametrize("at", [0, 1500])
def test_an_inserted_character_moves_few_anchors(spark, at):
    rng = random.Random(2)
    rows = []
    for a in SCRIPTS:
        t = "".join(rng.choice(a) for _ in range(6000))
        rows.append((t, t[:at] + "Q" + t[at:]))
    df = fp.with_anchors(fp.with_anchors(spark.createDataFrame(rows, "x string, y string"), "x", "a"), "y", "b")
    for r in df.select(fp.likeness(fp.placed(F.col("a")), fp.placed(F.col("b"))).alias("s"), F.size("a").alias("n")).collect():
        assert r.s > 0.9 and r.n > 100


def test_compare(spark):
    rng = random.Random(3)
    more = [(200 + i, " ".join(rng.choice(WORDS) + str(j) for j in range(60)), "en", "s", 1) for i in range(4)]
    more += [(300, more[0][1], "en", "s", 1), (301, "".join(rng.choice("中国人民的一是了") for _ in range(500)), "zh", "s", 1)]
    docs = odd_docs(spark, more)
    got = fp.compare(docs).collect()
    keyed = sorted(((r.doc_id if r.doc_id is not None else -(1 << 63)), r.text or "") for r in docs.collect())
    assert len(got) == len(keyed)
    text_of, order, by_text = dict(keyed), sorted(set(keyed)), defaultdict(set)
    edited = {}
    for k, t in order:
        nxt = order[(order.index((k, t)) + 1) % len(order)][1]
        q = len(t) // 4
        edited[k] = (t[: len(t) - q] + nxt[:q], nxt)
    rows = [(k, t, *edited[k]) for k, t in order]
    df = spark.createDataFrame(rows, "k long, t string, e string, n string")
    for c in "ten":
        df = fp.with_anchors(df, c, f"a{c}")
    like = lambda x, y: fp.likeness(fp.placed(F.col(x)), fp.placed(F.col(y)))
    want = {r.k: tuple(r)[1:] for r in df.select("k", fp.as_string(F.col("at")), fp.as_string(F.col("ae")), like("at", "ae"), like("at", "an")).collect()}
    for r in got:
        k = r.doc_id if r.doc_id is not None else -(1 << 63)
        assert (r.n_chars, r.edited_sha256) == (len(text_of[k]), sha(edited[k][0]))
        assert (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) == want[k]
        assert (r.fingerprint == "") == (not text_of[k])
        by_text[text_of[k]].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert fp.compare(spark.createDataFrame([], DOCS)).count() == 0


def test_registered_query_has_no_python_worker(spark, capsys):
    found = queries.op6_fingerprints(spark, D)
    found.explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{D}/documents.parquet").collect())
    after = {d[0]: docs[(i + 1) % len(docs)][1] for i, d in enumerate(docs)}
    text = dict(docs)
    for r in found.collect():
        q = len(text[r.doc_id]) // 4
        assert r.edited_sha256 == sha(text[r.doc_id][: len(text[r.doc_id]) - q] + after[r.doc_id][:q]) and r.n_chars == len(text[r.doc_id])
