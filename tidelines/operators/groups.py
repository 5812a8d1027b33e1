"""Groups and lists of pairs: gold standards, samples from role groups, renderings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import TimeFrame
from ..functions.values import compatible, shown
from . import pairs as P
from .meeting import met
from .sampling import order_by_hash


def lineage_count(pairs: DataFrame) -> DataFrame:
    """One row: n, the number of distinct (id1, id2); the known quirk of counting pairs, not histories, is kept."""
    return pairs.agg(F.count_distinct("id1", "id2").alias("n"))


def gold_ids(*pair_lists: DataFrame) -> DataFrame:
    """role_id: every id in lists of labelled pairs, once."""
    found = [p.select(F.explode(F.array("id1", "id2")).alias("role_id")) for p in pair_lists]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def common_change_dates(pairs: DataFrame, lineage: DataFrame) -> DataFrame:
    """id1, id2, n_common: dates on which both histories have an entry after their first."""
    from . import lineage as L

    later = lineage.withColumn("p", F.lag("ts").over(L.by_time())).where("p is not null")
    n = met(pairs, later.select("role_id", "ts"), "x.ts = y.ts").groupBy("id1", "id2").agg(F.count(F.lit(1)).alias("n_common"))
    return pairs.select("id1", "id2").join(n, ["id1", "id2"], "left").withColumn("n_common", F.coalesce("n_common", F.lit(0)))


def drawable(pairs: DataFrame, lineage: DataFrame) -> DataFrame:
    """id1, id2, evidence, n_common of pairs that a draw accepts: more than one date of evidence, and of common changes."""
    return P.evidence_and_common(pairs, lineage).where("evidence > 1 and n_common > 1")


def draw_from_groups(pairs: DataFrame, lineage: DataFrame, n: int, seed: str = "13") -> DataFrame:
    """n accepted pairs of expanded role groups, in order of a hash."""
    return drawable(pairs, lineage).orderBy(order_by_hash("id1", "id2", seed=seed), "id1", "id2").limit(n)


def candidates_for_learning(pairs: DataFrame, lineage: DataFrame, frame: TimeFrame, n: int | None = None, seed: str = "13") -> DataFrame:
    """id1, id2, label of pairs that share an informative transition and have a class label; up to n of them where a cap is asked for."""
    shared = P.transition_overlap(pairs, lineage)
    out = P.class_label(pairs, lineage, frame).where("label is not null").join(shared, ["id1", "id2"], "left_semi")
    return out if n is None else out.orderBy(order_by_hash("id1", "id2", seed=seed), "id1", "id2").limit(n)


def event_table(pairs: DataFrame, lineage: DataFrame) -> DataFrame:
    """id1, id2, ts, event: both histories side by side at every change of either, with (!) where they conflict."""
    p = P.pieces(pairs, lineage)
    text = F.concat(shown(F.col("v1"), F.col("w1")), F.lit(" | "), shown(F.col("v2"), F.col("w2")))
    ok = compatible(F.col("v1"), F.col("w1"), F.col("v2"), F.col("w2"))
    return p.select("id1", "id2", F.col("valid_from").alias("ts"), F.concat(text, F.when(ok, "").otherwise(" (!)")).alias("event"))
