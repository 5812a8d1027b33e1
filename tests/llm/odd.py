"""Odd rows that every corpus operator must stand."""

import hashlib
import random

D = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, n_tokens string"
WORDS = "the of and licht haus über maison été niño 7up 中文 🙂 a,b x.y".split()


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def odd_docs(spark, more=()):
    """Nulls in any column, empty and long texts, ties and repeated rows, columns with clashing names."""
    rng = random.Random(5)
    long = " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(30000))
    rows = [(1, "", None, "s", 0), (2, None, "en", None, None), (None, "no id here at all", "en", "s", 3), (4, long, "en", "s", 1), (5, long, "en", "s", 1), (6, "one", None, None, None), (7, " \t\n", "en", "s", 3), (7, " \t\n", "en", "s", 3), (8, "x" * 5000, "en", "s", 9), *more]
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], DOCS).repartition(3)
