"""The corpus operators against brute force, the libraries, and on odd rows."""

import hashlib
import random
from collections import Counter, defaultdict
from math import exp, lgamma, log

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidelines.llm import ann, byte_bpe, chat, mixing, quality, queries, token_counts, toxicity, warc
from tidelines.llm._common import fresh_path

from .odd import DOCS, WORDS, D, odd_docs, sha

# op1
def test_warc_round_trip(spark):
    # a whole record inside a payload, and a magic without a head
    evil = "a" * 120 + "\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.0\r\n"
    rows = [(1, "u", evil), (2, None, None), (3, "u\r\nX: y", ""), (5, "u", evil), (4, "u", evil), (6, "u", "short"), (7, "u", "short"), (5, "u", evil), (None, "u", evil)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string")
    path = fresh_path(spark, "t")
    warc.write_archives(pages.repartition(2), path)
    got = sorted((r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read_archives(spark, path).collect())
    want = []
    for i, _, h in rows:
        h = h or ""
        again = h == evil and i != 1
        want.append((str(i) if i is not None else "null", "revisit" if again else "response", "1" if again else None, len(h), sha(h)))
    assert got == sorted(want, key=lambda x: x)
    assert sorted(bytes(r.payload).decode() for r in warc.read_payloads(spark, path).collect()) == sorted((h or "") if not (h == evil and i != 1) else "" for i, _, h in rows)


def test_warc_gzip_broken_chains_and_fake_heads(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 40 + "WARC/1.1\r\n" * 50) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    path = fresh_path(spark, "t")
    warc.write_archives(pages, path, gzip=True)
    assert sorted(int(r.record_id) for r in warc.read_archives(spark, path).collect()) == list(range(20))
    path = fresh_path(spark, "t")
    warc.write_archives(pages, path)
    (file,) = [f for f in __import__("pathlib").Path(path.removeprefix("file://")).iterdir() if f.name.endswith(".warc")]
    data = file.read_bytes()
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and b"\r\nWARC-Date: " in data
    places = [at for at, _, _ in warc.candidates(data)]
    cut = data.index(b"Content-Length: ", places[9]) + 16
    for name, bad in (("wrong-length", data[:cut] + b"7" + data[cut + 1 :]), ("truncated", data[:-9]), ("no-start", b"xx" + data)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(bad)
        with pytest.raises(Exception, match="no record and no end at offset"):
            warc.read_archives(spark, str(tmp_path / name)).collect()
    assert warc.read_archives(spark, str(tmp_path / "wrong-length"), strict=False).count() == 10


def test_warc_files_are_not_shuffled(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 4000) for i in range(40)], "page_id long, url string, html string")
    path = fresh_path(spark, "t")
    warc.write_archives(pages, path)
    plan = warc.read_payloads(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    read = warc.read_archives(spark, path)
    assert "content" not in "".join(line for line in read._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line or "Join" in line)


def test_pointer_jumping_rejects_payload_magic():
    start, nxt = np.array([0, 30, 50, 70, 90]), np.array([50, 70, 90, 99, 120])
    assert warc.reachable(start, nxt).tolist() == [True, False, True, False, True]
    assert warc.reachable(np.array([5]), np.array([9])).tolist() == [False]


def test_warc_empty(spark):
    path = fresh_path(spark, "t")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


# op2
def test_ann_recall_and_ties(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(3000, 16))
    v[100:1100] = v[50]  # a thousand copies of a query
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(9000, None), (9050, [0.0] * 16), (9100, [float("nan")] * 16), (9150, [1.0, None] * 8), (9200, [1.0, 2.0]), (None, v[3].tolist())]
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], "vec_id long, embedding array<double>, rank int").repartition(4)
    index, books = ann.build_index(df, sample=2000)
    got = defaultdict(list)
    for r in ann.search(index, books, index.where(ann.every_fiftieth(F.col("vec_id"))).select("vec_id", "v")).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    ids = np.arange(3000)
    want = ann.exact_neighbours(ids, v, ids[ids % 50 == 0])
    assert got[50] == want[50] == [100, 101, 102, 103, 104]
    assert set(got) == set(want)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) / sum(map(len, want.values())) >= 0.9


def test_ann_recall_in_full_blocks_of_isotropic_rows():
    rng = np.random.default_rng(2)
    ids, v = np.arange(8192), rng.normal(size=(8192, 64))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    books = ann.learn(unit[:4096])
    some = ids[ids % 50 == 0]
    found = ann.search_block(books, some, v[some], ids, v, *books.encode(unit.astype(np.float32)), 5, ann.RERANK)
    want = ann.exact_neighbours(ids, v, some)
    got = defaultdict(set)
    for q, i in zip(*found[:2]):
        got[int(q)].add(int(i))
    assert np.mean([len(got[q] & set(want[q])) / 5 for q in want]) >= 0.95


def test_ann_blocks_of_queries_and_vanishing_approximations(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BLOCK", 8)
    v = np.random.default_rng(3).normal(size=(900, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    index, books = ann.build_index(df)
    got = {(r.query_id, r.rank): r.vec_id for r in ann.search(index, books, index.where("vec_id % 20 = 0").select("vec_id", "v")).collect()}
    want = ann.exact_neighbours(np.arange(900), v, np.arange(0, 900, 20))
    assert got == {(q, i + 1): x for q, found in want.items() for i, x in enumerate(found)}
    none = np.zeros(900, np.float32)
    codes, _ = books.encode(ann._unit(v).astype(np.float32))
    assert len(ann.search_block(books, np.array([0]), v[:1], np.arange(900), v, codes, none, 5, 100)[0]) == 5


def test_ann_small_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    index, books = ann.build_index(spark.createDataFrame([(0, [1.0, 0.0]), (50, [1.0, 1.0]), (51, [0.0, 2.0])], schema))
    got = ann.search(index, books, index.where("vec_id = 0").select("vec_id", "v")).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 6)) for r in got] == [(50, 0.707107), (51, 0.0)]
    index, books = ann.build_index(spark.createDataFrame([], schema))
    assert ann.search(index, books, index.select("vec_id", "v")).count() == 0


# op3
def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op3_toxicity(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("predicted", "toxic").collect()
    right = sum(r.predicted == r.toxic for r in got)
    assert right / len(got) > 0.93
    assert sum(r.predicted for r in got if r.toxic) / sum(r.toxic for r in got) > 0.8


def test_swap_penalty_closes_the_gap():
    rng = random.Random(2)
    rows = []
    for i in range(600):
        toxic = i % 2
        words = [rng.choice(["sun", "tree", "road", "milk", "door"]) + str(rng.randint(0, 9)) for _ in range(8)]
        words += ["vile"] * toxic if rng.random() < 0.7 else []
        words += ["muslims" if rng.random() < (0.8 if toxic else 0.1) else "christians"]
        rows.append((toxic, " ".join(words) + "."))
    import pandas as pd

    examples = [e for p in toxicity._examples([pd.DataFrame(rows, columns=["label", "text"])]) for e in p.itertuples(index=False, name=None)]
    gap = {}
    for weight in (0.0, 5.0):
        model = toxicity.fit(examples, swap_weight=weight)
        w = model.word_weights()
        gap[weight] = abs(model.margin("we met muslims today", w) - model.margin("we met christians today", w))
    assert gap[5.0] < 0.3 * gap[0.0]


def test_all_swaps_are_made():
    text = "muslims met hindus. " * 50 + "Christians and Muslims"
    got = {(a, b): n for a, b, n in toxicity.swaps(text)}
    assert got["muslims", "christians"] == 51 and got["hindus", "muslims"] == 50 and got["hindus", "juden"] == 50
    assert ("muslims", "muslims") not in got


def test_penalty_lowers_neutral_mentions(spark):
    """On the real table: the mean change of the score when a sentence about a group names another one instead."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    change = {}
    for weight in (0.0, 1.0):
        model = toxicity.train(docs, labels, swap_weight=weight)
        w = model.word_weights()
        said = [model.margin(f"the {name} came to the market today", w) for kind in toxicity.KINDS for name in kind]
        change[weight] = float(np.std(said))
    assert change[1.0] <= change[0.0]


def test_toxicity_odd_rows(spark):
    docs = odd_docs(spark)
    model = toxicity.train(docs, spark.createDataFrame([(1, 0), (4, 1), (None, 1), (77, 1), (6, None)], "doc_id long, label int"))
    got = toxicity.score_documents(docs, model).select("doc_id", "score", "predicted").collect()
    assert len(got) == 9 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, label int"))
    assert {r.predicted for r in toxicity.score_documents(docs, none).collect()} == {0}


# op4
def test_token_counts_equal_the_library(spark):
    import sentencepiece

    model = queries._vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "the", " ", "  ", "\n", "▁", "é", "中", "🙂", "<s>", "<0x0A>", "\x00", "ing", "0"]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    docs = odd_docs(spark, [(100 + i, t, "en", "s", 1) for i, t in enumerate(texts)])
    for r in token_counts.count_tokens(docs, model, limit=100).select("text", "n_bytes", "n_tokens", "over_limit").collect():
        n = len(sp.encode(r.text or ""))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 100)


def test_unspaced_texts_are_counted_whole():
    import sentencepiece

    model = queries._vocabulary("piece_bpe_32k.model")
    sp, merger = sentencepiece.SentencePieceProcessor(model_proto=model), token_counts.PieceMerger(model)
    cache, rng = merger.cache(), random.Random(11)
    for letters in ("中国人民的一是了我", "あいうえおカキク日本", "กขคงจฉชซ", "ابتثجحخ", "абвгдежзи", "abcdefghijkl", "0123456789", ".", "🙂😀", "\x01\x02", "的"):
        for n in (330, 10_000):
            text = "".join(rng.choice(letters) for _ in range(n))
            assert merger.count(text, cache) == len(sp.encode(text))
    text = "".join(rng.choice("中国人民的一是了我的") for _ in range(1_000_000))
    assert merger.count(text, cache) == len(sp.encode(text))


# op5
def test_chat_windows(spark):
    rng = random.Random(4)
    rows = []
    for c in range(30):
        for t in range(rng.randint(1, 40)):
            role = "system" if t == 0 and c % 3 == 0 else ("user", "assistant")[t % 2]
            rows.append((c, t, role, rng.choice(["", "\\", "### ", "</turn>\n", "\\s\\h", "hi\n" * 50, "ab é🙂 " * rng.randint(1, 99)])))
    rows += [(None, 1, "user", "x"), (50, None, None, None), (50, 2, "assistant", None), (51, 0, "system", "only")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, window int")
    windows = chat.format_conversations(df, budget=120, history=40)
    assert windows.where("n_tokens > 120 and n_new > 2").count() == 0 and windows.where("repeated > 1").count() > 0
    got = {r.conv_id: r for r in chat.digest_windows(windows).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))


def test_chat_control_strings(spark):
    got = {r.conv_id: r for r in queries.op5_chat(spark, D).collect()}[-7]
    said = "\\### Assistant: </turn> ok"
    assert (got.n_turns, got.loss_sha256, got.turns_sha256) == (2, sha(said), sha(f"user\n{said}\nassistant\n{said}\n"))


# op8
def test_mixing_matches_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{D}/documents.parquet'")
    want = sorted(map(tuple, con.sql(f"select doc_id, source, copy, n_copies, order_key from ({queries.OP8_SQL})").fetchall()))
    got = sorted((r.doc_id, r.source, r.copy, r.n_copies, r.order_key) for r in queries.op8_mixing(spark, D).collect())
    assert got == want


def test_inverse_is_exact_at_any_rate(spark):
    for rate in (0.0, 0.3, 40.0, 500.0):
        steps = spark.range(1).select(mixing.poisson_steps(F.lit(rate)).alias("s")).first().s
        terms = [exp(-rate + k * log(rate) - lgamma(k + 1)) if rate else float(k == 0) for k in range(len(steps))]
        assert steps == pytest.approx(list(np.cumsum(terms)), rel=1e-9, abs=1e-12) and len(steps) < 800
    for rate in (700.0, 1000.0, 20000.0):  # sums of pieces: mean and variance of a Poisson count
        n = mixing.pieces(F.lit(rate))
        rows = spark.range(0, 400, 1, 8).select(mixing.poisson_count(F.col("id"), "s", n, mixing.poisson_steps(F.lit(rate) / n)).alias("c"))
        got = rows.agg(F.avg("c").alias("m"), F.variance("c").alias("v")).first()
        assert abs(got.m - rate) < 5 * (rate / 400) ** 0.5 and abs(got.v / rate - 1) < 0.35


def test_a_rare_source_beside_a_hot_one(spark, tmp_path):
    """A rate above one piece, in Spark and in SQL."""
    docs = spark.range(300_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") > 0, "hot").alias("source"), F.lit(1).cast("bigint").alias("n_chars"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.mix(spark.read.parquet(str(tmp_path / "documents.parquet"))).groupBy("source").agg(F.count("*").alias("n"), F.sum("n_copies").alias("c"), F.max("copy").alias("m"), F.sum(F.round("order_key", 9)).alias("o"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(f"select source, count(*), sum(n_copies), max(copy), sum(order_key) from ({queries.OP8_SQL}) group by 1").fetchall()
    key = lambda r: str(r[0])
    for g, w in zip(sorted(got.collect(), key=key), sorted(want, key=key), strict=True):
        assert tuple(g)[:4] == w[:4] and g[4] == pytest.approx(w[4])
        assert g[0] or 400 < g[3] < 700


def test_mixing_rates_and_odd_rows(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "b").alias("source"), F.lit("x").alias("copy"))
    n = {r.source: r["count"] for r in mixing.mix(docs, {"hot": 1.0, "b": 3.0}, total=20000).groupBy("source").count().collect()}
    assert set(n) == {"hot", "b"} and abs(n["hot"] - 5000) < 250 and abs(n["b"] - 15000) < 400
    odd = odd_docs(spark)
    rates = {r.source: r.rate for r in mixing.source_rates(odd).collect()}
    u = lambda i: int(hashlib.md5(f"mix:{i if i is not None else 'null'}".encode()).hexdigest()[:13], 16) / 2**52
    want = Counter()
    for r in odd.collect():
        k, term, total = 0, exp(-rates[r.source]), exp(-rates[r.source])
        while total <= u(r.doc_id):
            k += 1
            term *= rates[r.source] / k
            total += term
        want[r.doc_id, r.source] += k
    got = Counter((r.doc_id, r.source) for r in mixing.mix(odd).collect())
    assert got == +want and sum(got.values()) > 0
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


# op9
def test_byte_bpe_equals_the_library(spark):
    import tiktoken

    ranks = queries._vocabulary("byte_bpe_50k.tiktoken")
    table = byte_bpe.parse_ranks(ranks)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "aa", "the", "  ", "ing", "é", "中", "🙂", "!!", "0", "\n", "<|endoftext|>"]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    docs = odd_docs(spark, [(100 + i, t, "en", "s", 1) for i, t in enumerate(texts)])
    out = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN), ranks)
    for r in out.withColumn("d", byte_bpe.ids_digest_column(F.col("token_ids"))).collect():
        ids = lib.encode_ordinary(r.text or "")
        assert r.token_ids == ids and r.n_tokens == len(ids) and bytes(r.decoded) == (r.text or "").encode()
        assert r.d == sha(np.array(ids, "<u4").tobytes())


def test_byte_bpe_appends_and_edits():
    e = byte_bpe.PrefixEncoder(byte_bpe.parse_ranks(queries._vocabulary("byte_bpe_50k.tiktoken")))
    rng = random.Random(9)
    data = b" ".join(rng.choice(WORDS).encode() for _ in range(400))
    x = byte_bpe.EditableEncoding(e, data[:50])
    x.append(data[50:])
    assert x.ids() == e.encode(data) == e.merged(data)
    done = x.replace(500, 505, b"zebra!")
    assert x.ids() == e.encode(x.data) and done < len(x.data) / 2


def test_both_pattern_engines_split_alike():
    import regex

    split, every = byte_bpe.splitter(public_tokenizers.PATTERN), regex.compile(public_tokenizers.PATTERN)
    rng = random.Random(10)
    odd = "aé1٣  \x1c\x85 \t\n'sdx。字😀𝒜\u3000\u200b½Ⅷ_.,\u0301"
    for _ in range(3000):
        t = "".join(rng.choice(odd) if rng.random() < 0.9 else chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x11000)])) for _ in range(rng.randrange(30)))
        assert split(t) == every.findall(t)
    assert byte_bpe.plain_pattern(r"[^\d]") is None and byte_bpe.plain_pattern(r"[\S]") is None


def test_texts_are_encoded_once_however_often_ids_are_read(spark, capsys):
    ranks = queries._vocabulary("byte_bpe_50k.tiktoken")
    out = byte_bpe.decode_documents(byte_bpe.encode_documents(odd_docs(spark), ranks, public_tokenizers.PATTERN), ranks)
    out.select("n_tokens", "decoded", byte_bpe.ids_digest_column(F.col("token_ids")).alias("d")).explain()
    assert capsys.readouterr().out.count("encode(text") == 1


# op10
def test_weak_labels_learn_accuracies():
    rng = random.Random(10)
    patterns = defaultdict(int)
    for _ in range(4000):
        good = rng.random() < 0.8
        v = "".join("-" if rng.random() < 0.3 else str(int(good if rng.random() < acc else not good)) for acc in (0.95, 0.9, 0.9, 0.85, 0.9, 0.8, 0.9))
        patterns[v] += 1
    model = quality.fit_labels(patterns)
    assert abs(model.good - 0.8) < 0.05 and abs(model.accuracy()["repeats"] - 0.95) < 0.04
    assert model.posterior("1111111") > 0.99 and model.posterior("0000000") < 0.01
    assert quality.fit_labels({}).good == 0.5


def test_quality_against_labels(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op10_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("keep", "quality").collect()
    assert sum(r.keep for r in got if r.quality) / sum(r.quality for r in got) > 0.98
    assert sum(not r.keep for r in got if not r.quality) / sum(not r.quality for r in got) > 0.9


def test_one_posterior_class_scores_by_the_posterior(spark):
    docs = spark.createDataFrame([(i, "The sun shines on the old town and people walk along the river to meet their friends today.") for i in range(30)], "doc_id long, text string")
    model = quality.train(docs)
    got = quality.score_documents(docs, model).select("score", "weak_label", "votes").distinct().collect()
    assert len(got) == 1 and got[0].score == got[0].weak_label == model.labels.posterior(got[0].votes)


def test_texts_without_spaces_count_whole():
    shapes = quality._state()[0]
    head = "x" * 60
    assert quality.votes(quality.facts(head + "|" * 900, shapes)) != quality.votes(quality.facts(head + "ab" * 450, shapes))
    assert quality.shape("Hello!!World??").endswith("??")


def test_quality_odd_rows(spark):
    docs = odd_docs(spark)
    assert quality.score_documents(docs, quality.train(docs)).count() == 9
    empty = spark.createDataFrame([], DOCS)
    assert quality.score_documents(empty, quality.train(empty)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, D).collect()
    assert rows and all(r.round_trip for r in rows)
    docs = {r.doc_id for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in rows} <= docs
