"""Sampling pairs, exporting them for learners, and stressing histories. Random order is a hash of ids and a seed."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import TimeFrame
from ..functions.values import csv_safe, informative, ml_safe, shown
from . import lineage as L
from . import pairs as P
from .meeting import agreements, by_histories
from .order import position


def order_by_hash(*ids: str, seed: str = "13") -> Column:
    """A key that puts rows in an order that depends on ids and seed alone."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ids], F.lit(seed)).cast("binary"))


def timestamp_blocks(lineage: DataFrame, frame: TimeFrame) -> DataFrame:
    """d, value, n, n_pairs, cum_pairs: roles that share an informative value on a grid date of training."""
    c = L.grid_cells(lineage, frame, last=frame.train_end).where(informative(F.col("value"), F.col("wc")))
    b = c.groupBy("d", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("n_pairs", F.floor(F.col("n") * (F.col("n") - 1) / 2).cast("bigint"))
    # one row by date and value, summed within dates first
    days = b.groupBy("d").agg(F.sum("n_pairs").alias("day"))
    upto = days.select("d", (F.sum("day").over(Window.orderBy("d")) - F.col("day")).alias("base"))
    within = F.sum("n_pairs").over(Window.partitionBy("d").orderBy("value"))
    return b.withColumn("w", within).join(upto, "d").select("d", "value", "n", "n_pairs", (F.col("base") + F.col("w")).cast("bigint").alias("cum_pairs"))


def block_weights(lineage: DataFrame, frame: TimeFrame, selves: bool = False) -> DataFrame:
    """id1, id2, weight: in how many (date, value) blocks a pair occurs (selves: also a history with itself)."""
    c = L.grid_cells(lineage, frame, last=frame.train_end).where(informative(F.col("value"), F.col("wc")))
    return agreements(c, selves=selves).select("id1", "id2", F.col("agreed").alias("weight"))


def weighted_sample(weighted: DataFrame, n: int, seed: str = "13") -> DataFrame:
    """n pairs, drawn without replacement with chances by weight: the smallest exponential keys -ln(u) / weight."""
    u = (F.conv(F.substring(order_by_hash("id1", "id2", seed=seed), 1, 13), 16, 10).cast("double") + 1) / F.lit(float((1 << 52) + 1))
    return weighted.withColumn("__k", -F.ln(u) / F.col("weight")).orderBy("__k", "id1", "id2").limit(n).drop("__k")


def stratum(share: Column) -> Column:
    return F.when(share < 0.7, "[0,0.7)").when(share < 1, "[0.7,1)").otherwise("1.0")


def stratified_sample(scored: DataFrame, per_stratum: int = 100, seed: str = "13", share: str = "share") -> DataFrame:
    """Up to per_stratum pairs of each stratum of the share column."""
    s = scored.withColumn("stratum", stratum(F.col(share)))
    w = Window.partitionBy("stratum").orderBy(order_by_hash("id1", "id2", seed=seed), "id1", "id2")
    return s.withColumn("__i", F.row_number().over(w)).where(F.col("__i") <= per_stratum).drop("__i")


def agreeing_pairs(lineage: DataFrame, frame: TimeFrame, least_va: int, least_dva: int) -> DataFrame:
    """id1, id2, va_count, dva_count of pairs with enough (distinct) agreements; markers don't agree."""

    def found(histories):
        w = block_weights(histories, frame, selves=True).where(F.col("weight") >= least_va).withColumnRenamed("weight", "va_count")
        return P.distinct_agreements(w, histories, "va_count").where(F.col("dva_count") >= least_dva)

    return by_histories(lineage, found)


def split(rows: DataFrame, shares: tuple[float, float] = (0.6, 0.8), seed: str = "13", ids: tuple[str, ...] = ("id1", "id2")) -> DataFrame:
    """rows with split (train, dev, test) by a hash: exact in expectation, and stable when rows are added."""
    u = F.conv(F.substring(order_by_hash(*ids, seed=seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return rows.withColumn("split", F.when(u < shares[0], "train").when(u < shares[1], "dev").otherwise("test"))


def feature_table(lineage: DataFrame, frame: TimeFrame, n: int = 50) -> DataFrame:
    """role_id, features: (date, value, days) of the first n changes, padded to 3 * n entries."""
    to = F.coalesce(F.lead("ts").over(L.by_time()), F.lit(frame.end))
    e = F.struct("ts", F.array(F.col("ts").cast("string"), csv_safe(shown(F.col("value"), F.col("wc"))), F.datediff(to, "ts").cast("string")).alias("s"))
    rows = lineage.withColumn("e", e).groupBy("role_id").agg(F.slice(F.array_sort(F.collect_list("e")), 1, n).alias("es"))
    flat = F.flatten(F.transform("es", lambda x: x["s"]))
    return rows.select("role_id", F.concat(flat, F.array_repeat(F.lit(""), F.lit(3 * n) - F.size(flat))).alias("features"))


def pair_features(pairs: DataFrame, lineage: DataFrame, frame: TimeFrame, n: int = 50) -> DataFrame:
    f = feature_table(lineage, frame, n)
    for i in ("1", "2"):
        pairs = pairs.join(f.select(F.col("role_id").alias(f"id{i}"), F.col("features").alias(f"features{i}")), f"id{i}")
    return pairs


def ml_record(lineage: DataFrame, frame: TimeFrame, n: int = 50) -> DataFrame:
    """role_id, record: COL date VAL value COL Di VAL days of the first n changes."""
    to = F.coalesce(F.lead("ts").over(L.by_time()), F.lit(frame.end))
    e = F.struct(F.col("ts").alias("ts"), ml_safe(shown(F.col("value"), F.col("wc"))).alias("v"), F.datediff(to, "ts").alias("n"))
    rows = lineage.withColumn("e", e).groupBy("role_id").agg(F.slice(F.array_sort(F.collect_list("e")), 1, n).alias("es"))
    text = F.transform("es", lambda x, i: F.concat_ws(" ", F.lit("COL"), x["ts"].cast("string"), F.lit("VAL"), x["v"], F.concat(F.lit("COL D"), i.cast("string")), F.lit("VAL"), x["n"].cast("string")))
    return rows.select("role_id", F.array_join(text, " ").alias("record"))


def inject_missing_days(lineage: DataFrame, frame: TimeFrame, share: float, seed: str = "13") -> DataFrame:
    """Replace grid days by DE until about `share` of a role's training days is unknown; a value's first day stays."""
    cells = L.grid_cells(lineage, frame)
    start = lineage.select("role_id", F.col("ts").alias("d"), F.lit(True).alias("first"))
    c = cells.join(start, ["role_id", "d"], "left")
    free = F.col("wc").isNull() & F.col("first").isNull() & (F.col("d") <= F.lit(frame.train_end))
    role = Window.partitionBy("role_id")
    i = F.row_number().over(Window.partitionBy("role_id", "free").orderBy(order_by_hash("role_id", "d", seed=seed)))
    known = F.count_if(F.col("wc").isNotNull() & (F.col("d") <= F.lit(frame.train_end))).over(role)
    total = F.count_if(F.col("d") <= F.lit(frame.train_end)).over(role)
    gone = F.col("free") & (F.col("i") <= F.floor(F.col("total") * F.lit(float(share))) - F.col("known"))
    c = c.withColumn("free", free).withColumn("i", i).withColumn("known", known).withColumn("total", total)
    return L.dedupe(c.select("role_id", F.col("d").alias("ts"), F.when(~gone, F.col("value")).alias("value"), F.when(gone, "DE").otherwise(F.col("wc")).alias("wc")))


def inject_missing_changes(lineage: DataFrame, share: float, train_end: date, seed: str = "13", keep_roles: DataFrame | None = None) -> DataFrame:
    """Replace about `share` of each role's known training entries by DE; keep_roles (role_id) are left alone."""
    T = F.lit(train_end)
    hit = F.col("wc").isNull() & (F.col("ts") < T)
    i = F.row_number().over(Window.partitionBy("role_id", "hit").orderBy(order_by_hash("role_id", "ts", seed=seed)))
    n = F.count_if(F.col("hit")).over(Window.partitionBy("role_id"))
    rows = lineage.withColumn("hit", hit).withColumn("i", i).withColumn("n", n)
    gone = F.col("hit") & (F.col("i") <= F.floor(F.col("n") * F.lit(float(share))))
    if keep_roles is not None:
        kept = keep_roles.select("role_id").distinct().withColumn("keep", F.lit(True))
        rows = rows.join(kept, "role_id", "left")
        gone &= F.col("keep").isNull()
    return L.dedupe(rows.select("role_id", "ts", F.when(~gone, F.col("value")).alias("value"), F.when(gone, "DE").otherwise(F.col("wc")).alias("wc")))


def subsample_roles(lineage: DataFrame, ratio: float, seed: str = "12") -> DataFrame:
    """Histories of floor(ratio * n) roles, in order of a hash. The number of roles is counted first."""
    roles = lineage.select("role_id").distinct()
    n = int(roles.count() * ratio)
    return lineage.join(roles.orderBy(order_by_hash("role_id", seed=seed), "role_id").limit(n), "role_id", "left_semi")


def synthetic_roles(lineage: DataFrame, n: int, seed: str = "12") -> DataFrame:
    """n clones of histories with values redrawn from the value distribution, distinct within a role; ids old_i.

    A clone's source is its number modulo the roles in hash order; a value's replacement is found by inverting the cumulative
    distribution at a hash, going on to the next free value where two draws collide.
    """
    roles = lineage.select("role_id").distinct()
    ranked = position(roles, [order_by_hash("role_id", seed=seed), F.col("role_id")], "r")
    m = max(1, roles.count())
    clones = lineage.sparkSession.range(n).select(F.col("id").alias("i"), (F.col("id") % m).alias("r")).join(ranked, "r").select("i", "role_id")
    rows = clones.join(lineage, "role_id").select(F.concat_ws("_", "role_id", F.col("i").cast("string")).alias("role_id"), "ts", "value", "wc")
    dist = L.value_distribution(lineage)
    # ranges of the distribution meet draws in buckets, about as many as there are values
    total = dist.agg(F.max("upto").alias("t"), F.ceil(F.max("upto") / F.count(F.lit(1))).alias("width"))
    old = rows.where("wc is null").select("role_id", "value").distinct().join(F.broadcast(total))  # total is one row
    u = F.conv(F.substring(order_by_hash("role_id", "value", seed=seed), 1, 12), 16, 10).cast("double") / float(1 << 48)
    drawn = old.withColumn("x", F.floor(u * F.col("t")) + 1)
    drawn = drawn.withColumn("bucket", F.floor((F.col("x") - 1) / F.col("width")))
    ranges = dist.join(F.broadcast(total)).select(F.col("value").alias("new"), (F.col("upto") - F.col("n")).alias("lo"), F.col("upto").alias("hi"), "width")
    ranges = ranges.select("new", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / F.col("width")), F.floor((F.col("hi") - 1) / F.col("width")))).alias("bucket"))
    found = drawn.join(ranges, "bucket").where((F.col("x") > F.col("lo")) & (F.col("x") <= F.col("hi")))
    nth = F.row_number().over(Window.partitionBy("role_id", "new").orderBy("value"))
    named = found.withColumn("nth", nth).select(F.col("role_id").alias("__r"), F.col("value").alias("__v"), F.when(F.col("nth") == 1, F.col("new")).otherwise(F.concat_ws("#", "new", F.col("nth").cast("string"))).alias("new"))
    out = rows.join(named, (F.col("role_id") == F.col("__r")) & F.col("value").eqNullSafe(F.col("__v")), "left")
    return out.select("role_id", "ts", F.when(F.col("wc").isNull(), F.col("new")).alias("value"), "wc")
