"""Finding compatible pairs of histories: candidate keys, verification by bit masks, and split planning."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import TimeFrame
from ..operators import lineage as L
from ..operators.meeting import agreements, beside, by_histories
from ..operators.order import position
from .split_tree import compatible_by_splits


def compatible_pairs(lineage: DataFrame, frame: TimeFrame, least_shared: int = 1, selves: bool = False) -> DataFrame:
    """id1 < id2 (selves: or the same), n_shared: pairs that agree on every grid date up to the end of training on which both are known.

    Only roles with a certain change take part. Pairs meet under a (date, value), so they agree at least once; their masks tell on
    how many dates they agree and on how many both are known. The two numbers are equal for compatible pairs. No pair that
    disagrees everywhere is ever made, and no pair is shuffled.
    """
    train = L.project(lineage, frame.start, frame.train_end)
    changing = L.change_counts(train).where("least > 0").select("role_id")
    known = L.grid_cells(train, frame, last=frame.train_end).where("wc is null").join(changing, "role_id", "left_semi")
    return agreements(known, selves=selves).where((F.col("agreed") == F.col("shared")) & (F.col("agreed") >= least_shared)).select("id1", "id2", F.col("agreed").alias("n_shared"))


def transition_pairs(lineage: DataFrame, frame: TimeFrame) -> DataFrame:
    """id1 < id2: pairs of changing roles that share an informative transition on the training period."""
    train = L.project(lineage, frame.start, frame.train_end)
    changing = L.change_counts(train).where("least > 0").select("role_id")
    t = L.informative_transitions(train).join(changing, "role_id", "left_semi")
    a, b = t.withColumnRenamed("role_id", "id1"), t.withColumnRenamed("role_id", "id2")
    return a.join(b, ["prev", "after"]).where("id1 < id2").select("id1", "id2").distinct()


def compatible_with_transition(lineage: DataFrame, frame: TimeFrame, least_shared: int = 1) -> DataFrame:
    """compatible_pairs that share an informative transition on the training period, tested beside each pair of different histories."""

    def found(histories):
        pairs = compatible_pairs(histories, frame, least_shared, selves=True)
        t = L.informative_transitions(histories).where("prev is not null and after is not null")
        return beside(pairs, t.select("role_id", "prev", "after"), deal=False).where(F.arrays_overlap("a", "b")).select("id1", "id2", "n_shared")

    return by_histories(L.project(lineage, frame.start, frame.train_end), found)


def compatible_any(lineage: DataFrame, frame: TimeFrame) -> DataFrame:
    """All compatible pairs, also those never known together."""
    return compatible_by_splits(lineage, frame)


def split_cost(lineage: DataFrame, frame: TimeFrame) -> DataFrame:
    """d, n_wc, n_known, cost: pairs to verify if roles are split by their value at a grid date, unknown ones meeting all."""
    cells = L.grid_cells(L.project(lineage, frame.start, frame.train_end), frame, last=frame.train_end)
    by = cells.groupBy("d", "value", "wc").agg(F.count(F.lit(1)).alias("n"))
    wild = F.coalesce(F.sum(F.when(F.col("wc").isNotNull(), F.col("n"))), F.lit(0))
    known = F.coalesce(F.sum(F.when(F.col("wc").isNull(), F.col("n"))), F.lit(0))
    squares = F.coalesce(F.sum(F.when(F.col("wc").isNull(), F.col("n") * F.col("n"))), F.lit(0))
    return by.groupBy("d").agg(wild.cast("bigint").alias("n_wc"), known.cast("bigint").alias("n_known"), (wild * (wild + known) + squares).cast("bigint").alias("cost"))


def split_cost_two_lists(left: DataFrame, right: DataFrame, frame: TimeFrame) -> DataFrame:
    """d, cost of splitting the product of two lists of roles at a grid date."""

    def counts(lineage, n):
        cells = L.grid_cells(L.project(lineage, frame.start, frame.train_end), frame, last=frame.train_end)
        key = F.when(F.col("wc").isNotNull(), F.lit(None)).otherwise(F.struct("value"))
        return cells.groupBy("d", F.col("wc").isNotNull().alias("u"), key.alias("v")).agg(F.count(F.lit(1)).alias(n))

    a, b = counts(left, "l"), counts(right, "r")
    met = a.join(b, a["d"].eqNullSafe(b["d"]) & (a["u"] == b["u"]) & a["v"].eqNullSafe(b["v"]), "full_outer").select(F.coalesce(a["d"], b["d"]).alias("d"), F.coalesce(a["u"], b["u"]).alias("u"), F.coalesce("l", F.lit(0)).alias("l"), F.coalesce("r", F.lit(0)).alias("r"))
    s = lambda c, u: F.coalesce(F.sum(F.when(F.col("u") == u, F.col(c))), F.lit(0))
    lr = F.coalesce(F.sum(F.when(~F.col("u"), F.col("l") * F.col("r"))), F.lit(0))
    cost = lr + s("l", True) * s("r", False) + s("r", True) * s("l", False) + s("l", True) * s("r", True)
    return met.groupBy("d").agg(cost.cast("bigint").alias("cost"))


def plan_split(lineage: DataFrame, frame: TimeFrame) -> date | None:
    """The grid date of least cost, or None if it saves less than a tenth. One row comes to the driver."""
    best = split_cost(lineage, frame).orderBy("cost", "d").first()
    if best is None or best["cost"] > 0.9 * (best["n_wc"] + best["n_known"]) ** 2:
        return None
    return best["d"]


def groups_at_split(lineage: DataFrame, split: date) -> DataFrame:
    """group_id, members, n: the value groups at a split date instead of their pairs; unknown roles form the group ⊥.

    A group's members are gathered for output, as the leaf format asks; split again where n is large.
    """
    at = L.value_at(lineage, split)
    key = F.when(F.col("wc").isNotNull(), "⊥").otherwise(F.concat(F.lit("="), F.coalesce("value", F.lit("null"))))
    return at.groupBy(key.alias("group_id")).agg(F.array_sort(F.collect_list("role_id")).alias("members"), F.count(F.lit(1)).alias("n"))


def expand_groups(groups: DataFrame) -> DataFrame:
    """id1, id2 of role groups: (members) gives its pairs, (left_ids, right_ids) the product."""
    one = groups.where("left_ids is null").select(F.posexplode("members").alias("i", "id1"), "members").select("id1", F.explode(F.slice("members", F.col("i") + 2, F.size("members"))).alias("id2"))
    two = groups.where("left_ids is not null").select(F.explode("left_ids").alias("id1"), "right_ids").select("id1", F.explode("right_ids").alias("id2"))
    return one.unionByName(two).select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2")).distinct()


def tiled(roles: DataFrame, width: int) -> DataFrame:
    """role_id, tile: index intervals of fixed width of the id-sorted roles."""
    return position(roles, [F.col("role_id")], "at").select("role_id", F.floor(F.col("at") / width).cast("int").alias("tile"))
