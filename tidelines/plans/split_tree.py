"""All compatible pairs, by splitting nodes of roles at dates until the rest is cheap to compare.

A node is one list of roles, whose pairs are asked for, or two lists, whose product is. Split at a date, a list gives a node for
each known value, one of the unknown roles, and one of the unknown against the known ones; two lists give a node for each value
on both sides, and three for the combinations with unknown roles. Two roles known with different values part for good, and any
other pair is in exactly one child. A level of the tree is one table, whatever its number of nodes; each node picks its own date.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import TimeFrame
from ..lineage_cut import cut
from ..operators import lineage as L
from ..operators.meeting import members, units, without_conflict


def relevant_dates(lineage: DataFrame, end: date, used: tuple[date, ...] = ()) -> DataFrame:
    """d: the dates up to end on which some history changes, without the used ones."""
    d = lineage.where(F.col("ts") <= F.lit(end)).select(F.col("ts").alias("d")).distinct()
    return d.where(~F.col("d").isin(list(used))) if used else d


def packed_values(lineage: DataFrame, frame: TimeFrame) -> DataFrame:
    """role_id, vals: by grid date of training the value (= and the value; ∅ for a real null), null where unknown."""
    n = (frame.train_end - frame.start).days // frame.granularity + 1
    cells = L.grid_cells(lineage, frame, last=frame.train_end)
    at = (F.datediff("d", F.lit(frame.start)) / frame.granularity).cast("int")
    value = F.coalesce(F.concat(F.lit("="), "value"), F.lit("∅"))
    known = F.collect_list(F.when(F.col("wc").isNull(), F.struct(at.alias("i"), value.alias("v"))))
    by_role = cells.groupBy("role_id").agg(F.map_from_entries(known).alias("m"))
    return by_role.select("role_id", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.try_element_at("m", i)).alias("vals"))


def agree(a: Column, b: Column) -> Column:
    """True if two roles' packed values are equal wherever both are known."""
    return F.forall(F.zip_with(a, b, lambda x, y: x.isNull() | y.isNull() | (x == y)), lambda ok: ok)


def node_costs(members: DataFrame, values: DataFrame, dates: Column) -> DataFrame:
    """node, i, cost, whole: pairs left by a split of each node at each date (by number), and pairs without it."""
    cells = members.join(values, "role_id").select("node", "two", "side", F.explode(dates).alias("i"), "vals")
    v = F.get(F.col("vals"), F.col("i"))
    by = cells.groupBy("node", "two", "i", v.alias("v")).agg(F.count_if(F.col("side") != "R").alias("l"), F.count_if(F.col("side") == "R").alias("r"))
    unknown = F.col("v").isNull()
    s = lambda c, test: F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0))
    met = F.coalesce(F.sum(F.when(~unknown, F.col("l") * F.when(F.col("two"), F.col("r")).otherwise(F.col("l")))), F.lit(0))
    at = by.groupBy("node", "two", "i").agg(s("l", unknown).alias("wl"), s("l", ~unknown).alias("kl"), s("r", unknown).alias("wr"), s("r", ~unknown).alias("kr"), met.alias("met"))
    one = F.col("wl") * (F.col("wl") + F.col("kl")) + F.col("met")
    both = F.col("met") + F.col("wl") * F.col("kr") + F.col("wr") * F.col("kl") + F.col("wl") * F.col("wr")
    whole = (F.col("wl") + F.col("kl")) * F.when(F.col("two"), F.col("wr") + F.col("kr")).otherwise(F.col("wl") + F.col("kl"))
    return at.select("node", "i", F.when(F.col("two"), both).otherwise(one).alias("cost"), whole.alias("whole"))


def children(members: DataFrame, values: DataFrame, splits: DataFrame) -> DataFrame:
    """node, two, side, role_id of the children of the nodes in splits (node, i)."""
    x = members.join(splits, "node").join(values, "role_id").select("node", "two", "side", "role_id", F.get("vals", F.col("i")).alias("v"))
    to = lambda kind, two, side: F.struct(F.md5(F.concat("node", F.lit("/"), kind).cast("binary")).alias("node"), F.lit(two).alias("two"), F.lit(side).alias("side"))
    key, lit = F.col("v"), F.lit
    one = F.when(key.isNull(), F.array(to(lit("ww"), False, "A"), to(lit("wk"), True, "L"))).otherwise(F.array(to(key, False, "A"), to(lit("wk"), True, "R")))
    left = F.when(key.isNull(), F.array(to(lit("ww"), True, "L"), to(lit("wk"), True, "L"))).otherwise(F.array(to(key, True, "L"), to(lit("kw"), True, "L")))
    right = F.when(key.isNull(), F.array(to(lit("ww"), True, "R"), to(lit("kw"), True, "R"))).otherwise(F.array(to(key, True, "R"), to(lit("wk"), True, "R")))
    made = F.when(~F.col("two"), one).when(F.col("side") == "L", left).otherwise(right)
    rows = x.select("role_id", F.explode(made).alias("c")).select("c.node", "c.two", "c.side", "role_id")
    # a node needs two roles, or one on each side
    live = rows.groupBy("node", "two").agg(F.count_if(F.col("side") != "R").alias("l"), F.count_if(F.col("side") == "R").alias("r"))
    live = live.where(F.when(F.col("two"), (F.col("l") > 0) & (F.col("r") > 0)).otherwise(F.col("l") > 1)).select("node")
    return rows.join(live, "node", "left_semi")


def leaves(members: DataFrame, values: DataFrame, dates: Column, leaf_pairs: int = 1 << 12, levels: int = 6) -> DataFrame:
    """node, two, side, role_id of the nodes that stay whole: small ones, those that no date splits by a tenth, and the last level."""
    done = None
    for _ in range(levels):
        members = cut(members)
        costs = node_costs(members, values, dates).where(f"whole > {leaf_pairs} and cost <= 0.9 * whole")
        splits = cut(costs.groupBy("node").agg(F.min_by("i", F.struct("cost", "i")).alias("i")))
        rest = members.join(splits, "node", "left_anti")
        done = rest if done is None else done.unionByName(rest)
        if splits.isEmpty():
            return done
        members = children(members, values, splits)
    return members if done is None else done.unionByName(members)


def leaf_pairs_of(leaf_rows: DataFrame) -> DataFrame:
    """id1 < id2: the pairs to compare, each once."""
    one = leaf_rows.where("not two")
    same = one.select("node", F.col("role_id").alias("a")).join(one.select("node", F.col("role_id").alias("b")), "node").where("a < b")
    cross = leaf_rows.where("two and side = 'L'").select("node", F.col("role_id").alias("a")).join(leaf_rows.where("two and side = 'R'").select("node", F.col("role_id").alias("b")), "node").where("a <> b")
    return same.unionByName(cross).select(F.least("a", "b").alias("id1"), F.greatest("a", "b").alias("id2"))


def check_counts(leaf_rows: DataFrame) -> DataFrame:
    """One row: n_nodes, n_checks of the leaves: how many pairs are compared."""
    by = leaf_rows.groupBy("node", "two").agg(F.count_if(F.col("side") != "R").alias("l"), F.count_if(F.col("side") == "R").alias("r"))
    checks = F.when(F.col("two"), F.col("l") * F.col("r")).otherwise(F.floor(F.col("l") * (F.col("l") - 1) / 2))
    return by.agg(F.count(F.lit(1)).alias("n_nodes"), F.coalesce(F.sum(checks), F.lit(0)).cast("bigint").alias("n_checks"))


def leaf_groups(leaf_rows: DataFrame) -> DataFrame:
    """group_id, members, left_ids, right_ids: leaves as groups instead of pairs, for output in the group format."""
    pick = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("role_id"))))
    g = leaf_rows.groupBy(F.col("node").alias("group_id"), "two").agg(pick(F.col("side") == "A").alias("a"), pick(F.col("side") == "L").alias("l"), pick(F.col("side") == "R").alias("r"))
    return g.select("group_id", F.when(~F.col("two"), F.col("a")).alias("members"), F.when(F.col("two"), F.col("l")).alias("left_ids"), F.when(F.col("two"), F.col("r")).alias("right_ids"))


def _changing(lineage: DataFrame, frame: TimeFrame) -> DataFrame:
    train = L.project(lineage, frame.start, frame.train_end)
    return L.change_counts(train).where("least > 0").select("role_id")


def _prepared(lineage: DataFrame, frame: TimeFrame) -> tuple[DataFrame, Column]:
    """Packed values of the roles with a certain change, and the grid numbers of the dates that can split."""
    train = L.project(lineage, frame.start, frame.train_end).join(_changing(lineage, frame), "role_id", "left_semi")
    at = (F.datediff("d", F.lit(frame.start)) / frame.granularity).cast("int")
    # bounded by the grid's number of dates
    numbers = sorted(r["i"] for r in relevant_dates(train, frame.train_end).select(at.alias("i")).distinct().collect())
    return cut(packed_values(train, frame)), F.lit(numbers).cast("array<int>") if numbers else F.array().cast("array<int>")


def _grown(values: DataFrame, dates: Column, left: Column | None, leaf_pairs: int, levels: int) -> DataFrame:
    side = F.lit("A") if left is None else F.when(left, "L").otherwise("R")
    start = values.select(F.lit("").alias("node"), F.lit(left is not None).alias("two"), side.alias("side"), "role_id")
    return leaves(start, values, dates, leaf_pairs, levels)


def tree(lineage: DataFrame, frame: TimeFrame, left: Column | None = None, leaf_pairs: int = 1 << 12, levels: int = 6) -> tuple[DataFrame, DataFrame]:
    """The leaves of the split tree, and the packed values. left: which roles form the left list; without it there is one list."""
    values, dates = _prepared(lineage, frame)
    return _grown(values, dates, left, leaf_pairs, levels), values


def compatible_by_splits(lineage: DataFrame, frame: TimeFrame, left: Column | None = None, leaf_pairs: int = 1 << 12, levels: int = 6) -> DataFrame:
    """id1 < id2: all compatible pairs of roles with a certain change (of the two lists), also those never known together.

    Roles of one list with equal values are split and compared as one; those of one unit are compatible with each other.
    """
    values, dates = _prepared(lineage, frame)
    alike = cut(units(values.withColumn("__l", F.lit(True) if left is None else left), ["__l", "vals"]))
    rows = _grown(alike, dates, left, leaf_pairs, levels)
    known = alike.select("role_id", F.posexplode("vals").alias("i", "value")).where("value is not null")
    cells = known.select("role_id", F.date_add(F.lit(frame.start), F.col("i") * frame.granularity).alias("d"), "value")
    found = without_conflict(rows, cells, alike=alike)
    if left is not None:
        return found
    return found.unionByName(members(alike.where(F.size("ids") > 1).select(F.col("role_id").alias("id1"), F.col("role_id").alias("id2"), F.col("ids").alias("ids_1"), F.col("ids").alias("ids_2"))))
