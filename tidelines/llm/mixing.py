"""Mixing sources to target weights by Poisson replication.

A source of n rows and target weight w gets the mean repetition rate r = total * w / (sum of weights * n), so that its
expected share of `total` rows is its weight. Each row's number of copies is the inverse Poisson distribution with mean r at a
uniform number hashed from the row's id and the seed: independent of partitions and retries, and the mean over a source needs
no coordination. A rate above PIECE is split into equal pieces, each inverted at a hash of its own: their sum is Poisson with
the whole rate, and no table grows with the rate. Rows are exploded by their counts and shuffled globally by a second hash.

Defined results: a null source is a source of its own; a source without a weight gets none of the total unless default_weight
says otherwise; rows with equal or null ids are drawn alike, each by itself; null or empty texts are rows like others; an
empty table gives an empty result. The columns copy, n_copies and order_key replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The largest rate that is inverted by one table, of up to PIECE + 12 * sqrt(PIECE) + 21 numbers.
PIECE = 500
#: Tables of all sources that are broadcast, in bytes; more are joined by a shuffle that splits the hot sources.
BROADCAST_BYTES = 16 << 20


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) with 52 bits from the MD5 of the key and the seed."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def pieces(rate: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(rate / PIECE).cast("int"))


def poisson_steps(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... copies for a rate up to PIECE, up to where they can't be told from 1."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), F.array(first).alias("sums"))

    def add(acc, k):
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + p)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), last), start, add, lambda acc: acc["sums"])


def poisson_count(key: Column, seed: str, n_pieces: Column, steps: Column) -> Column:
    """The number of copies for a key: one inversion by piece. The first piece's hash is that of the key and the seed alone."""
    below = lambda u: F.size(F.filter(steps, lambda c: c <= u))
    text = F.coalesce(key.cast("string"), F.lit("null"))
    more = F.aggregate(F.sequence(F.lit(2), n_pieces), F.lit(0), lambda acc, i: acc + below(uniform(F.concat_ws("/", text, i.cast("string")), seed)))
    return below(uniform(key, seed)) + F.when(n_pieces > 1, more).otherwise(0)


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, temperature: float = 0.5, default_weight: float = 0.0, source_col: str = "source") -> DataFrame:
    """source, n_rows, rate of every source; without weights, targets follow n_rows ** temperature."""
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n_rows"))
    if weights is None:
        counts = counts.withColumn("weight", F.pow(F.col("n_rows").cast("double"), F.lit(temperature)))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.create_map().cast("map<string,double>")
        counts = counts.withColumn("weight", F.coalesce(F.try_element_at(given, F.coalesce("source", F.lit(""))), F.lit(default_weight)).cast("double"))
    sums = counts.agg(F.sum("weight").alias("all_weight"), F.sum("n_rows").alias("all_rows"))
    wanted = F.lit(float(total)) if total is not None else F.col("all_rows").cast("double")
    rate = F.when(F.col("all_weight") > 0, wanted * F.col("weight") / (F.col("all_weight") * F.col("n_rows"))).otherwise(0.0)
    return counts.join(F.broadcast(sums)).select("source", "n_rows", rate.alias("rate"))  # sums is one row


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, temperature: float = 0.5, default_weight: float = 0.0, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Rows of docs, each as often as its Poisson count says, in global random order; adds copy, n_copies, order_key."""
    rates = source_rates(docs, weights, total, temperature, default_weight, source_col)
    n = pieces(F.col("rate"))
    steps = rates.select(F.col("source").alias("__tl_source"), n.alias("__tl_n"), poisson_steps(F.col("rate") / n).alias("__tl_steps"))
    if (steps.agg(F.sum(F.size("__tl_steps"))).first()[0] or 0) * 8 <= BROADCAST_BYTES:
        steps = F.broadcast(steps)
    kept = docs.drop("copy", "n_copies", "order_key")
    drawn = kept.join(steps, F.col(source_col).eqNullSafe(F.col("__tl_source")))
    counted = drawn.withColumn("n_copies", poisson_count(kept[id_col], seed, F.col("__tl_n"), F.col("__tl_steps")))
    copies = counted.where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    keyed = copies.withColumn("order_key", uniform(F.concat_ws("#", F.coalesce(kept[id_col].cast("string"), F.lit("null")), F.col("copy")), seed + "/order")).drop("__tl_n", "__tl_source", "__tl_steps")
    # a uniform key deals rows to random partitions; sorting by it makes the order within each random as well
    return keyed.repartition("order_key").sortWithinPartitions("order_key", id_col, "copy")
