"""Toxicity scores from a counterfactual-regularised linear classifier.

Each distinct word of a text gives hashed features: the word and its first 4, 5 and 6 characters. A feature counts as often as
words of the text have it, up to MOST times, in training as in scoring. Training minimises the
log loss plus a penalty on score changes: in every labelled sentence that names a group, the name is swapped for the others
of its kind, and the squared change of the score is added. Weights of group names thus shrink towards each other, which
keeps neutral mentions from counting as toxic.

Defined results: null and empty texts get the score of the intercept alone; repeated rows are scored each; rows of labels
with a null label or id, or without a document, teach nothing; of repeated label rows each counts; without labels of both
classes every score is 0; texts of any length are scored whole; an empty table gives an empty result. Output columns replace
input columns of the same name.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, clean_driver, memo, worker_state

#: Names of groups that may stand for each other, one kind a line. A word of two lines swaps with both.
GROUPS = """
christian muslim jewish hindu buddhist atheist catholic protestant
christians muslims jews hindus buddhists atheists catholics protestants
black white asian latino arab african european indian
women men girls boys
woman man girl boy
gay straight lesbian bisexual transgender
immigrants refugees foreigners citizens
american mexican chinese russian german french spanish polish
christen muslime juden hindus buddhisten
frauen männer mädchen jungen
ausländer flüchtlinge einwanderer
chrétiens musulmans juifs hindous bouddhistes
femmes hommes filles garçons
étrangers réfugiés immigrés
cristianos musulmanes judíos hindúes budistas
mujeres hombres chicas chicos
extranjeros refugiados inmigrantes
disabled deaf blind autistic
behinderte gehörlose blinde
handicapés sourds aveugles
discapacitados sordos ciegos
elderly young teenage
"""
KINDS = [line.split() for line in GROUPS.strip().splitlines()]
#: By name: the names that it is swapped with.
OTHERS = {w: sorted({o for kind in KINDS if w in kind for o in kind} - {w}) for kind in KINDS for w in kind}
#: A feature counts this often in a text at most, in the fit and in the score alike.
MOST = 3

BITS = 18
#: Bounds of the labelled sample that the classifier is fitted on, by class.
SAMPLE = {1: 2500, 0: 5000}
#: Entries of the fit's matrix that one step works on at a time.
CHUNK = 1 << 18
EDGES = ".,;:!?\"'()[]{}<>|*%$#&-_/\\"


def word_features(raw: str) -> list[int]:
    import xxhash

    word = raw.strip(EDGES).lower()
    if not word:
        return []
    names = ["w" + word] + [f"p{n}{word[:n]}" for n in (4, 5, 6) if len(word) >= n]
    return [xxhash.xxh32_intdigest(x) & ((1 << BITS) - 1) for x in names]


def swaps(text: str) -> list[tuple[str, str, int]]:
    """(name, other name, how often) for all sentences of a text that name a group."""
    found: Counter[str] = Counter()
    for sentence in re.split(r"[.!?\n]+", text):
        found.update({word for raw in set(sentence.split()) if (word := raw.strip(EDGES).lower()) in OTHERS})
    return [(word, other, n) for word, n in sorted(found.items()) for other in OTHERS[word]]


@dataclass
class LinearModel:
    """Weights by hashed feature, as they go to the executors."""

    index: np.ndarray
    weight: np.ndarray
    intercept: float

    def key(self) -> str:
        return hashlib.sha256(self.index.tobytes() + self.weight.tobytes() + str(self.intercept).encode()).hexdigest()

    def word_weights(self) -> dict[str, tuple]:
        """By word: its features that have a weight, as (feature, weight)."""
        known = dict(zip(self.index.tolist(), self.weight.tolist(), strict=True))
        return memo(lambda raw: tuple((f, known[f]) for f in word_features(raw) if f in known), 100_000, 48)

    def margin(self, text: str | None, weights: dict[str, tuple]) -> float:
        """Each feature counts by the words of the text that have it, up to MOST of them. The sum is exact, so in any order."""
        found = [fw for raw in set((text or "").split()) for fw in weights[raw]]
        return self.intercept + math.fsum(fw[1] * min(n, MOST) for fw, n in Counter(found).items())


def _examples(rows):
    """By labelled text: its features with counts, and those of its swaps."""
    import pandas as pd

    features = memo(word_features, 100_000, 48)
    for pdf in rows:
        out = []
        for label, text in zip(pdf["label"], pdf["text"], strict=True):
            words = [f for raw in set((text or "").split()) for f in features[raw]]
            found = np.unique(np.array(words, np.int32), return_counts=True)
            pairs = swaps(text or "")
            found += tuple([x for pair in pairs for x in [*word_features(pair[i]), -pair[2]]] for i in (0, 1))
            out.append((label, *(np.asarray(x, np.int32).tobytes() for x in found)))
        yield pd.DataFrame(out, columns=["label", "f", "n", "a", "b"])


def fit(examples: list, swap_weight: float = 1.0, l2: float = 5e-4, steps: int = 300) -> LinearModel:
    """examples: rows of label, feature ids, counts, and the features before and after each swap, packed as int32.

    A swap's features are ended by minus the number of sentences that it stands for; equal swaps are summed, and the penalty is the
    mean squared change over all sentences' swaps.
    """
    examples = [(e[0], *(np.frombuffer(x, np.int32) for x in e[1:5])) for e in examples]
    y = np.array([e[0] for e in examples], np.float64)
    if len(set(y.tolist())) < 2:
        return LinearModel(np.zeros(0, np.int64), np.zeros(0), -30.0)
    size = 1 << BITS
    lengths = [len(e[1]) for e in examples]
    row = np.repeat(np.arange(len(examples), dtype=np.int32), lengths)
    col = np.concatenate([e[1] for e in examples])
    val = np.concatenate([e[2] for e in examples])
    # only features that tell the classes apart by more than chance enter the model
    pos, neg = (np.bincount(col[(y == c)[row]], minlength=size) + 0.5 for c in (1, 0))
    p, q = (y == 1).sum() + 1.0, (y == 0).sum() + 1.0
    z = np.log(pos / p * q / neg) / np.sqrt(1 / pos + 1 / neg)
    keep = np.flatnonzero((np.abs(z) > 2.0) & (pos + neg >= 4))
    place = np.full(size, -1, np.int64)
    place[keep] = np.arange(len(keep))
    used = place[col] >= 0
    row, col, val = row[used], place[col[used]].astype(np.int32), np.minimum(val[used], MOST).astype(np.uint8)
    del used
    # steps go over about CHUNK entries at a time, cut between texts
    cuts = np.unique(np.r_[0, np.searchsorted(row, row[CHUNK::CHUNK]), len(row)])
    chunks = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    times: Counter[tuple] = Counter()
    for e in examples:
        ends = [np.flatnonzero(ids < 0) for ids in (e[3], e[4])]
        for k in range(len(ends[0])):
            before, after = (tuple(ids[(end[k - 1] + 1 if k else 0) : end[k]].tolist()) for ids, end in zip((e[3], e[4]), ends, strict=True))
            times[before, after] -= int(e[3][ends[0][k]])
    d_row, d_col, d_val = [], [], []
    for k, sides in enumerate(times):
        for sign, ids in zip((1.0, -1.0), sides, strict=True):
            for f in ids:
                if place[f] >= 0:
                    d_row.append(k), d_col.append(place[f]), d_val.append(sign)
    d_row, d_col, d_val, n = np.array(d_row, np.int64), np.array(d_col, np.int64), np.array(d_val), len(times)
    share = np.array(list(times.values()), np.float64) / max(1, sum(times.values()))
    w, b = np.zeros(len(keep)), 0.0
    m, v = np.zeros(len(keep) + 1), np.zeros(len(keep) + 1)
    balance = np.where(y == 1, len(y) / 2 / (y == 1).sum(), len(y) / 2 / (y == 0).sum())
    for t in range(1, steps + 1):
        s = np.full(len(y), b)
        for c in chunks:
            s += np.bincount(row[c], val[c] * w[col[c]], minlength=len(y))
        g = balance * (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y) / len(y)
        grad = np.append(l2 * w, g.sum())
        for c in chunks:
            grad[:-1] += np.bincount(col[c], val[c] * g[row[c]], minlength=len(keep))
        if n:
            change = np.bincount(d_row, d_val * w[d_col], minlength=n)
            grad[:-1] += 2 * swap_weight * np.bincount(d_col, d_val * (share * change)[d_row], minlength=len(keep))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return LinearModel(keep, w, float(b))


def train(docs: DataFrame, labels: DataFrame, swap_weight: float = 1.0, sample: dict[int, int] | None = None) -> LinearModel:
    """Fit on a bounded sample of labelled documents: of each class, the `sample` label rows that come first by a hash of the id.

    docs: doc_id, text; labels: doc_id, label (0 or 1). The sampled label rows are few by that bound, so they are broadcast.
    """
    bound_batches(docs.sparkSession)
    labels = labels.select("doc_id", F.col("label").cast("int").alias("label")).dropna()
    parts = [labels.where(F.col("label") == c).orderBy(F.xxhash64(F.col("doc_id"), F.lit(17)), "doc_id").limit(n) for c, n in (sample or SAMPLE).items()]
    chosen = parts[0].unionByName(parts[1])
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text")
    examples = rows.mapInPandas(_examples, "label int, f binary, n binary, a binary, b binary").collect()
    # a fixed order makes the fit the same on every run
    model = fit(sorted(map(tuple, examples), key=lambda e: (e[0], hashlib.sha256(e[1]).digest())), swap_weight)
    del examples
    clean_driver(docs.sparkSession)
    return model


def score_column(text: Column, model: LinearModel) -> Column:
    key = "linear-" + model.key()

    def score(texts):
        import pyarrow as pa

        weights = worker_state(key, model.word_weights)
        return pa.array([1 / (1 + math.exp(-max(-30.0, min(30.0, model.margin(t.as_py(), weights))))) for t in texts], pa.float64())

    score.__annotations__ = {}
    return F.arrow_udf(score, "double", F.ArrowUDFType.SCALAR)(text)


def score_documents(df: DataFrame, model: LinearModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """df with score (0 to 1, higher: toxic likelier) and predicted (1 from the threshold up)."""
    bound_batches(df.sparkSession)
    out = df.withColumn("score", score_column(df[text_col], model))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
