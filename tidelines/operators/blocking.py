"""Group-by blockers: keys of histories and the pairs that share them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import TimeFrame
from ..functions.values import shown
from . import lineage as L
from .meeting import ordered, tiles


def em_key(lineage: DataFrame, end: date) -> DataFrame:
    """role_id, key: the exact entries before end."""
    e = F.struct("ts", F.concat(F.col("ts").cast("string"), F.lit("="), shown(F.col("value"), F.col("wc"))).alias("s"))
    return lineage.where(F.col("ts") < F.lit(end)).groupBy("role_id").agg(L._listed(e).alias("key"))


def cqm_key(lineage: DataFrame, end: date) -> DataFrame:
    """role_id, key: the change sequence before end, markers included."""
    return L.change_sequence(lineage, end).withColumnRenamed("seq", "key")


def vsm_key(lineage: DataFrame, end: date) -> DataFrame:
    """role_id, key: the set of known values before end; histories without one share the empty set."""
    return L.value_set(lineage, end).withColumnRenamed("vals", "key")


def tsm_key(lineage: DataFrame, end: date, granularity: int, skip_wildcards: bool = True) -> DataFrame:
    """role_id, key: the transition set before end; histories without one share the empty set."""
    t = L.transition_set(lineage, granularity, end, skip_wildcards).groupBy("role_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat("prev", F.lit(">"), "after"))), ";").alias("key"))
    return lineage.select("role_id").distinct().join(t, "role_id", "left").select("role_id", F.coalesce("key", F.lit("")).alias("key"))


def keys(lineage: DataFrame, frame: TimeFrame) -> dict[str, DataFrame]:
    end = frame.train_end
    return {"em": em_key(lineage, end), "cqm": cqm_key(lineage, end), "tsm": tsm_key(lineage, end, frame.granularity), "vsm": vsm_key(lineage, end)}


#: Members of a key that meet in one tile: as many as a merge join keeps in memory, since each is sent to every tile.
WIDTH = 3500


def block_pairs(key_rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """id1 < id2 that share a key. The key is hashed for the shuffle; it is sent along, and compared, only where two keys share a hash.

    Members of a key are dealt to tiles of about `width`, and each pair of tiles is a join key of its own, so that a key of many
    members is the work of many tasks. A member is sent once to each tile, a small share of the pairs that it is in.
    """
    k = key_rows.withColumn("h", F.xxhash64("key"))
    apart = k.groupBy("h").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    a, b = tiles(k.join(apart, "h").select("h", "role_id", F.when(F.col("lo") != F.col("hi"), F.col("key")).alias("key")), ["h"], width)
    take, low, high = ordered()
    met = a.select("h", "t1", "t2", F.col("key").alias("k1"), F.col("role_id").alias("id1")).join(b.select("h", "t1", "t2", F.col("key").alias("k2"), F.col("role_id").alias("id2")).hint("merge"), ["h", "t1", "t2"])
    return met.where(F.col("k1").eqNullSafe(F.col("k2")) & take).select(low.alias("id1"), high.alias("id2"))


def pair_count(key_rows: DataFrame) -> DataFrame:
    """One row: n_groups, n_pairs = sum of n(n-1)/2 over groups; no pair is made."""
    n = key_rows.groupBy(F.xxhash64("key").alias("h"), "key").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum(F.floor(F.col("n") * (F.col("n") - 1) / 2)), F.lit(0)).cast("bigint").alias("n_pairs"))


def block_counts(lineage: DataFrame, frame: TimeFrame) -> DataFrame:
    """method, n_groups, n_pairs of the four blockers."""
    found = [pair_count(k).select(F.lit(m).alias("method"), "n_groups", "n_pairs") for m, k in keys(lineage, frame).items()]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def set_domain(lineage: DataFrame, frame: TimeFrame) -> DataFrame:
    """role_id, tokens: value_day for known grid values up to the end of training, ⊥C_day for unknown ones."""
    v = F.when(F.col("wc").isNotNull(), "⊥C").otherwise(F.coalesce("value", F.lit("null")))
    c = L.grid_cells(lineage, frame, last=frame.train_end).select("role_id", F.concat(v, F.lit("_"), F.unix_date("d").cast("string")).alias("t"))
    return c.groupBy("role_id").agg(F.array_sort(F.collect_list("t")).alias("tokens"))


def overlap_domain(lineage: DataFrame, frame: TimeFrame, query: bool) -> DataFrame:
    """role_id, tokens such that a query's and an index entry's tokens meet on every grid date iff the two are compatible.

    A known value is its own token and may meet the other side's unknown marker; an unknown date carries its side's marker and
    the token that unknown dates share.
    """
    day = F.unix_date("d").cast("string")
    mine, other = ("Q", "I") if query else ("I", "Q")
    token = lambda s: F.concat(s, F.lit("_"), day)
    known = F.array(token(F.concat(F.lit("="), F.coalesce("value", F.lit("null")))), token(F.lit(f"⊥{other}")))
    unknown = F.array(token(F.lit(f"⊥{mine}")), token(F.lit("⊥")))
    c = L.grid_cells(lineage, frame, last=frame.train_end).select("role_id", F.explode(F.when(F.col("wc").isNull(), known).otherwise(unknown)).alias("t"))
    return c.groupBy("role_id").agg(F.array_sort(F.collect_list("t")).alias("tokens"))
