"""Quality scores from weak labels.

Heuristic labellers vote good, bad or nothing on each whole text. Expectation-maximisation over the counts of vote patterns,
taken over all documents, estimates every labeller's accuracy and the share of good texts; the posteriors of the patterns
then train a hashed linear scorer on word shapes, which judges all texts.

Defined results: null and empty texts get no votes and the score of the intercept alone; repeated rows are scored each;
texts of any length are scored whole; if the posteriors of all documents favour one class, each document's posterior itself is
its score; an empty table gives an empty result. Output columns replace input columns of the same name.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, clean_driver, memo, worker_state

#: Names of the labellers, in the order of their votes.
LABELLERS = ("repeats", "variety", "shouting", "marks", "columns", "endings", "prose")
BITS = 16
#: Characters of a word; longer ones are cut.
LONGEST = 40
#: Bounds of the sample that the scorer is fitted on, by the class that the posterior favours.
SAMPLE = {0: 2500, 1: 2500}


def shape(word: str) -> str:
    """Character classes of a word, runs shortened: 'Licht.' is 'Xx.'."""
    out = ""
    for c in word:
        k = "x" if c.islower() else "X" if c.isupper() else "9" if c.isdigit() else "a" if c.isalpha() else c
        if not out.endswith(k * 2):
            out += k
    # the first classes, and the last two, which tell an ending
    return (out if len(out) <= 10 else out[:8] + out[-2:]).replace("xx", "x")


def words_of(text: str) -> list[str]:
    """Words, those without an end cut into pieces, so that texts without spaces count whole."""
    words = text.split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]


def facts(text: str, shapes: dict[str, str]) -> dict:
    words = words_of(text)
    n = len(words)
    kinds = Counter(map(shapes.__getitem__, words))
    share = lambda test: sum(v for k, v in kinds.items() if test(k)) / n if n else 0.0
    return {
        "n": n,
        "repeat": sum(map(str.__eq__, words, words[1:])) / max(1, n - 1),
        "variety": len(set(words)) / n if n else 0.0,
        "shout": share(lambda k: "X" in k and "x" not in k),
        "marks": share(lambda k: k.strip(".,;:!?") and not any(c in "xX9a" for c in k)),
        "endings": share(lambda k: len(k) > 2 and k[-1] == k[-2] and k[-1] not in "xX9a.-"),
        "plain": share(lambda k: k.rstrip(".,;:") in ("x", "X", "Xx")),
        "kinds": kinds,
    }


def votes(f: dict) -> str:
    """A character by labeller: 1 good, 0 bad, - no vote."""
    if not f["n"]:
        return "-" * len(LABELLERS)
    rare = 3.0 / (3.0 + f["n"] ** 0.5)  # variety falls with length
    say = (
        "0" if f["repeat"] > 0.15 else "1" if f["repeat"] < 0.02 and f["n"] >= 20 else "-",
        "0" if f["n"] >= 8 and f["variety"] < 0.6 * rare else "1" if f["n"] >= 20 and f["variety"] > 2 * rare else "-",
        "0" if f["shout"] > 0.3 and f["n"] >= 4 else "1" if f["shout"] < 0.05 else "-",
        "0" if f["marks"] > 0.1 else "1" if f["marks"] < 0.01 else "-",
        "0" if (bars := f["kinds"].get("|", 0) + f["kinds"].get("||", 0)) > 0.1 * f["n"] else "-" if bars else "1",
        "0" if f["endings"] > 0.1 else "1" if f["endings"] < 0.01 else "-",
        "0" if f["plain"] < 0.5 else "1" if f["plain"] > 0.9 else "-",
    )
    return "".join(say)


@dataclass
class LabelModel:
    """What expectation-maximisation found: share of good texts, and by labeller and class the chances of each vote."""

    good: float
    chance: np.ndarray  # labeller, class, vote (bad, good, none); a vote not cast says nothing, so its chance is 1

    def accuracy(self) -> dict[str, float]:
        """By labeller: the chance that a vote it casts is right."""
        prior = np.array([1 - self.good, self.good])
        right = sum(prior[c] * self.chance[:, c, c] for c in (0, 1))
        cast = sum(prior[c] * self.chance[:, c, :2].sum(1) for c in (0, 1))
        return dict(zip(LABELLERS, (right / np.maximum(cast, 1e-12)).tolist(), strict=True))

    def posterior(self, pattern: str) -> float:
        v = ["01-".index(c) for c in pattern]
        logs = np.log([1 - self.good, self.good]) + np.log(self.chance[np.arange(len(v)), :, v]).sum(0)
        return float(1 / (1 + np.exp(logs[0] - logs[1])))


def fit_labels(patterns: dict[str, int], rounds: int = 200) -> LabelModel:
    """Expectation-maximisation on counts of vote patterns. It starts from: a text that any labeller calls bad is bad."""
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], np.float64)
    v = np.array([["01-".index(c) for c in k] for k in keys], np.int64).reshape(len(keys), len(LABELLERS))
    good = np.where((v == 0).any(1), 0.1, 0.95)
    each = np.arange(len(LABELLERS))
    model = LabelModel(0.5, np.ones((len(LABELLERS), 2, 3)))
    for _ in range(rounds if len(keys) else 0):
        chance = np.empty((len(LABELLERS), 2, 3))
        for c, p in ((0, 1 - good), (1, good)):
            for k in range(3):
                chance[:, c, k] = (n * p) @ (v == k)
        # a labeller is taken to be better than chance: that keeps the classes from changing places
        chance[:, :, :2] += np.array([[1.0, 0.1], [0.1, 1.0]])
        chance[:, :, :2] /= chance[:, :, :2].sum(2, keepdims=True)
        chance[:, :, 2] = 1.0
        share = float(np.clip((n @ good + 1) / (n.sum() + 2), 0.01, 0.99))
        model = LabelModel(share, chance)
        logs = np.log([1 - share, share]) + np.log(chance[each[None, :], :, v]).sum(1)
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))
        done, good = np.abs(new - good).max() < 1e-9, new
        if done:
            break
    return model


def hashed(f: dict, buckets: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids and values of a text: shares of its word shapes, and steps of its overall figures."""
    n = max(1, f["n"])
    ids = [buckets[k] for k in f["kinds"]]
    vals = [(v / n) ** 0.5 for v in f["kinds"].values()]
    for name in ("repeat", "shout", "marks", "endings", "plain"):
        ids.append(buckets[f"{name}>{int(f[name] * 20) / 20:.2f}"])
        vals.append(1.0)
    rare = 3.0 / (3.0 + n**0.5)
    ids.append(buckets[f"variety>{int(min(4.0, f['variety'] / rare) * 5)}"])
    vals.append(1.0)
    return np.array(ids, np.int64), np.array(vals)


def _bucket(name: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(name) & ((1 << BITS) - 1)


def _state():
    return worker_state("quality", lambda: (memo(shape, 150_000, 48), memo(_bucket, 50_000, 48)))


def vote_column(text: Column) -> Column:
    def vote(texts):
        import pyarrow as pa

        shapes, _ = _state()
        return pa.array([votes(facts(t.as_py() or "", shapes)) for t in texts], pa.string())

    vote.__annotations__ = {}
    return F.arrow_udf(vote, "string", F.ArrowUDFType.SCALAR)(text)


@dataclass
class QualityModel:
    labels: LabelModel
    weight: np.ndarray | None  # None: the posterior is the score
    intercept: float

    def key(self) -> str:
        return hashlib.sha256((b"" if self.weight is None else self.weight.tobytes()) + str(self.intercept).encode()).hexdigest()


def _examples(rows):
    import pandas as pd

    for pdf in rows:
        shapes, buckets = _state()
        found = [hashed(facts(t or "", shapes), buckets) for t in pdf["text"]]
        yield pd.DataFrame({"votes": pdf["votes"], "ids": [i.tolist() for i, _ in found], "vals": [v.tolist() for _, v in found]})


def train(docs: DataFrame, sample: dict[int, int] | None = None, l2: float = 1e-4, steps: int = 400) -> QualityModel:
    """docs: doc_id, text. Vote counts cover all documents; the scorer is fitted on a bounded sample, by a hash of the id."""
    bound_batches(docs.sparkSession)
    voted = docs.select("doc_id", "text", vote_column(docs["text"]).alias("votes"))
    # at most 3 ** labellers rows come back
    patterns = {r["votes"]: r["n"] for r in voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = fit_labels(patterns)
    good = {k for k in patterns if model.posterior(k) >= 0.5}
    if not good or len(good) == len(patterns):
        return QualityModel(model, None, 0.0)
    bits = {c: sum(patterns[k] for k in patterns if (k in good) == bool(c)) for c in (0, 1)}
    # a hash threshold twice as wide as needed bounds what is sorted; limit() sets the size
    h = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    parts = []
    for c, size in (sample or SAMPLE).items():
        near = docs.where(h < min(1.0, 2.0 * size / max(1, bits[c]) + 0.001))
        near = near.select("doc_id", "text", vote_column(near["text"]).alias("votes"))
        isin = F.col("votes").isin(sorted(good))
        parts.append(near.where(isin if c else ~isin).orderBy(F.xxhash64("doc_id", F.lit(29)), "doc_id").limit(size))
    rows = parts[0].unionByName(parts[1]).select("votes", "text").mapInPandas(_examples, "votes string, ids array<int>, vals array<double>").collect()
    rows = sorted(map(tuple, rows))
    y = np.array([model.posterior(r[0]) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    col, val = np.concatenate([np.asarray(r[1], np.int64) for r in rows]), np.concatenate([np.asarray(r[2]) for r in rows])
    used, col = np.unique(col, return_inverse=True)
    w, b = np.zeros(len(used)), 0.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, steps + 1):
        s = b + np.bincount(row, val * w[col], minlength=len(y))
        g = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y) / len(y)
        grad = np.append(np.bincount(col, val * g[row], minlength=len(used)) + l2 * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    weight = np.zeros(1 << BITS)
    weight[used] = w
    del rows, row, col, val
    clean_driver(docs.sparkSession)
    return QualityModel(model, weight, float(b))


def score_documents(df: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """df with votes, weak_label (posterior of the votes), score (0 to 1, higher: better) and keep (score >= threshold)."""
    bound_batches(df.sparkSession)
    key = "quality-" + model.key()

    def judge(texts):
        import math

        import pyarrow as pa

        (shapes, buckets), weight = _state(), worker_state(key, lambda: [model.weight])[0]
        said, weak, scores = [], [], []
        for t in texts:
            f = facts(t.as_py() or "", shapes)
            if weight is None:
                said.append(votes(f))
                continue
            ids, vals = hashed(f, buckets)
            s = model.intercept + (math.fsum((weight[ids] * vals).tolist()) if f["n"] else 0.0)
            said.append(votes(f))
            scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, s)))))
        known: dict[str, float] = {}
        weak = [known.setdefault(k, model.labels.posterior(k)) if k not in known else known[k] for k in said]
        scores = weak if weight is None else scores
        return pa.StructArray.from_arrays([pa.array(said), pa.array(weak, pa.float64()), pa.array(scores, pa.float64())], ["votes", "weak_label", "score"])

    judge.__annotations__ = {}
    out = df.withColumn("__tl_j", F.arrow_udf(judge, "struct<votes:string,weak_label:double,score:double>", F.ArrowUDFType.SCALAR)(df[text_col]))
    out = out.withColumn("votes", F.col("__tl_j.votes")).withColumn("weak_label", F.col("__tl_j.weak_label")).withColumn("score", F.col("__tl_j.score"))
    return out.withColumn("keep", F.col("score") >= threshold).drop("__tl_j")
