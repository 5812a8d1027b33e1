"""Statistics of pairs of histories. Pairs are rows id1, id2; every statistic is one join on aligned dates and one aggregation."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import TimeFrame
from ..functions.values import compatible, contained, merged_value, same_raw
from ..lineage_cut import cut
from . import blocking as B
from . import lineage as L
from .meeting import WORD, States, any_bit, beside, count_bits, met, states

HORIZON = date(9999, 12, 31)
#: Distinct values up to which a statistic asks for each value, or pair of values, by masks.
FEW = 16


def _cols() -> tuple[Column, Column, Column, Column]:
    return F.col("v1"), F.col("w1"), F.col("v2"), F.col("w2")


def aligned(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """id1, id2, d, v1, w1, v2, w2: both sides at every grid date."""
    m = met(pairs, cells.select("role_id", "d", "value", "wc"), "x.d = y.d")
    return m.select("id1", "id2", "x.d", F.col("x.value").alias("v1"), F.col("x.wc").alias("w1"), F.col("y.value").alias("v2"), F.col("y.wc").alias("w2"))


def pieces(pairs: DataFrame, lineage: DataFrame, horizon: date = HORIZON) -> DataFrame:
    """id1, id2, valid_from, valid_to, v1, w1, v2, w2: the common timeline, split where either side changes."""
    i = L.intervals(lineage, horizon).select("role_id", F.col("valid_from").alias("f"), F.col("valid_to").alias("t"), "value", "wc")
    m = met(pairs, i, "x.f < y.t and y.f < x.t")
    return m.select("id1", "id2", F.greatest("x.f", "y.f").alias("valid_from"), F.least("x.t", "y.t").alias("valid_to"), F.col("x.value").alias("v1"), F.col("x.wc").alias("w1"), F.col("y.value").alias("v2"), F.col("y.wc").alias("w2"))


def _states(lineage: DataFrame, *lists: Column) -> States:
    """Marks: c where there is an entry; on its first date alone: s of any entry, n of one after the first, e of a change between known values."""
    w = L.by_time()
    known = F.col("wc").isNull()
    before = F.lag(F.struct("wc")).over(w)
    rows = lineage.select("role_id", F.col("ts").alias("f"), F.lead("ts").over(w).alias("t"), "value", "wc", known.alias("known"), before.alias("p"))
    later = F.col("p").isNotNull()
    marks = {"c": (F.lit(True), True), "s": (F.lit(True), False), "n": (later, False), "e": (later & F.col("known") & F.col("p.wc").isNull(), False)}
    return states(rows, marks, *lists)


def _starts(m: States) -> list[Column]:
    """By word, the dates on which a piece of the common timeline begins."""
    return [x.bitwiseOR(y).bitwiseAND(c) for x, y, c in zip(m.of("s", 1), m.of("s", 2), m.both("c"), strict=True)]


def _later_starts(m: States) -> list[Column]:
    """The same without the first piece."""
    out, before = [], F.lit(True)
    for x in _starts(m):
        out.append(F.when(before, x.bitwiseAND(x - 1)).otherwise(x))
        before = before & (x == 0)
    return out


def change_points(pairs: DataFrame, lineage: DataFrame) -> DataFrame:
    """Pieces after the first, with the values before the change and its date before.

    A piece begins where either side has an entry. Both sides' entries then and before are found by the number of entries up to
    that date, so that a pair's pieces need no order and no exchange.
    """
    m = _states(lineage, F.array_sort(F.collect_list(F.struct("f", "value", "wc"))).alias("e"), F.array_sort(F.collect_list(F.col("i0"))).alias("at"))
    x = m.beside(pairs.select("id1", "id2")).select("id1", "id2", "e_1", "e_2", *[f"s{w}_{n}" for w in m.words for n in (1, 2)], F.greatest(F.get("at_1", F.lit(0)), F.get("at_2", F.lit(0))).alias("first"), F.greatest(F.element_at("at_1", -1), F.element_at("at_2", -1)).alias("end"), F.explode(F.array_union("at_1", "at_2")).alias("i"))
    x = x.where("i > first")
    one = F.lit(1).cast("bigint")
    upto = lambda w: F.call_function("shiftleft", one, F.greatest(F.least(F.col("i") + 1 - w * WORD, F.lit(WORD)), F.lit(0)).cast("int")) - 1
    bit = lambda w, n: F.when((F.col("i") >= w * WORD) & (F.col("i") < (w + 1) * WORD), F.call_function("shiftright", F.col(f"s{w}_{n}"), (F.col("i") - w * WORD).cast("int")).bitwiseAND(one)).otherwise(0)
    add = lambda xs: sum(xs[1:], xs[0]).cast("int")
    for n in (1, 2):
        x = x.withColumn(f"r{n}", add([F.bit_count(F.col(f"s{w}_{n}").bitwiseAND(upto(w))) for w in m.words]) - 1).withColumn(f"q{n}", F.col(f"r{n}") - add([bit(w, n) for w in m.words]))
    now, old = lambda n: F.get(f"e_{n}", F.col(f"r{n}")), lambda n: F.get(f"e_{n}", F.col(f"q{n}"))
    named = lambda e, c: [e(n)[f].alias(f"{c}{k}{n}") for n in (1, 2) for f, k in (("value", ""), ("wc", "_w"))]
    ts = F.get(F.lit(m.dates).cast("array<date>") if m.dates else F.array().cast("array<date>"), F.col("i").cast("int"))
    return x.select("id1", "id2", ts.alias("ts"), *named(old, "prev"), *named(now, "cur"), F.greatest(old(1)["f"], old(2)["f"]).alias("prev_ts"), (F.col("i") == F.col("end")).alias("is_last"))


def stays_valid(pairs: DataFrame, lineage: DataFrame, containment: bool = False) -> DataFrame:
    """id1, id2, valid: compatible (or containing each other's words) at all times."""
    m = _states(lineage)
    clash = any_bit(m.differ())
    if containment:
        values = [r["value"] for r in m.values.orderBy("code").limit(FEW + 1).collect()]
        if len(values) > FEW:
            return pieces(pairs, lineage).groupBy("id1", "id2").agg(F.bool_and(contained(*_cols())).alias("valid"))
        a, none = m.values.select(F.col("code").alias("a"), F.col("value").alias("v1")), F.lit(None).cast("string")
        b = m.values.select(F.col("code").alias("b"), F.col("value").alias("v2"))
        apart = a.crossJoin(b).where(~contained(F.col("v1"), none, F.col("v2"), none)).collect()  # of FEW values
        clash = F.lit(False)
        for r in apart:
            clash = clash | any_bit([x.bitwiseAND(y) for x, y in zip(m.has(r["a"], 1), m.has(r["b"], 2), strict=True)])
    return m.beside(pairs.select("id1", "id2")).select("id1", "id2", (~clash).alias("valid"))


def merge(pairs: DataFrame, lineage: DataFrame) -> DataFrame:
    """id1, id2, ts, value, wc: the merged histories of compatible pairs, equal neighbours joined."""
    p = pieces(pairs, lineage)
    w = Window.partitionBy("id1", "id2")
    ok = p.withColumn("ok", F.bool_and(compatible(*_cols())).over(w)).where("ok")
    m = ok.select("id1", "id2", F.col("valid_from").alias("ts"), merged_value(F.col("v1"), F.col("w1"), F.col("v2")).alias("value"), F.when(F.col("w1").isNotNull(), F.col("w2")).alias("wc"))
    prev = F.lag(F.struct("value", "wc")).over(w.orderBy("ts"))
    kept = m.withColumn("p", prev).where(F.col("p").isNull() | ~same_raw(F.col("value"), F.col("wc"), F.col("p.value"), F.col("p.wc")))
    return kept.drop("p")


def _changes(lineage: DataFrame) -> DataFrame:
    """Entries after the first with the entry before and the last known value before."""
    w = L.by_time()
    known = F.last(F.when(F.col("wc").isNull(), F.struct("value")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = lineage.select("role_id", "ts", "value", "wc", F.lag(F.struct("value", "wc")).over(w).alias("p"), known.alias("k"))
    return rows.where("p is not null and wc is null")


def _both_change(pairs: DataFrame, lineage: DataFrame) -> DataFrame:
    m = met(pairs, _changes(lineage).select("role_id", "ts", F.col("value").alias("c"), "p", "k"), "x.ts = y.ts")
    return m.select("id1", "id2", "x.ts", *[F.col(f"{s}.{c}").alias(f"{c}{n}") for n, s in ((1, "x"), (2, "y")) for c in "cpk"])


def evidence(pairs: DataFrame, lineage: DataFrame, interleaved: bool = False) -> DataFrame:
    """id1, id2, evidence: dates on which both change between known values; -1 for incompatible pairs.

    Interleaved: unknown entries may lie before the change, if both sides' last known values are equal and change.
    """
    if not interleaved:
        m = _states(lineage)
        return m.beside(pairs.select("id1", "id2")).select("id1", "id2", F.when(any_bit(m.differ()), -1).otherwise(count_bits(m.both("e"))).cast("bigint").alias("evidence"))
    both = _both_change(pairs, lineage)
    loose = F.col("k1").isNotNull() & F.col("k2").isNotNull() & F.col("k1.value").eqNullSafe(F.col("k2.value")) & ~F.col("c1").eqNullSafe(F.col("k1.value"))
    n = both.groupBy("id1", "id2").agg(F.count_if(loose).alias("n"))
    v = stays_valid(pairs, lineage)
    return v.join(n, ["id1", "id2"], "left").select("id1", "id2", F.when(F.col("valid"), F.coalesce("n", F.lit(0))).otherwise(-1).cast("bigint").alias("evidence"))


def evidence_and_common(pairs: DataFrame, lineage: DataFrame) -> DataFrame:
    """id1, id2, evidence, n_common: also on how many dates both have an entry after their first."""
    m = _states(lineage)
    return m.beside(pairs.select("id1", "id2")).select("id1", "id2", F.when(any_bit(m.differ()), -1).otherwise(count_bits(m.both("e"))).cast("bigint").alias("evidence"), count_bits(m.both("n")).alias("n_common"))


def evidence_multiset(pairs: DataFrame, lineage: DataFrame) -> DataFrame:
    """id1, id2, prev, after, n: the transitions behind the evidence of compatible pairs."""
    ok = stays_valid(pairs, lineage).where("valid").select("id1", "id2")
    both = _both_change(ok, lineage).where("p1.wc is null and p2.wc is null")
    return both.groupBy("id1", "id2", F.col("p1.value").alias("prev"), F.col("c1").alias("after")).agg(F.count(F.lit(1)).alias("n"))


def compatibility_share(pairs: DataFrame, lineage: DataFrame, frame: TimeFrame, minimum: float | None = None) -> DataFrame:
    """id1, id2, share: days from the start to the end of training on which the two are compatible."""
    m = _states(lineage)
    to = [*m.dates[1:], HORIZON]
    days = [max(0, (min(b, frame.train_end) - max(a, frame.start)).days) for a, b in zip(m.dates, to, strict=False)]
    here = lambda test: [F.lit(sum(1 << i for i, n in enumerate(days[w * WORD : (w + 1) * WORD]) if test(n))).cast("bigint") for w in m.words]
    fits = [c.bitwiseAND(F.bitwise_not(x)) for c, x in zip(m.both("c"), m.differ(), strict=True)]
    # the dates' lengths bit by bit
    sums = [count_bits([x.bitwiseAND(y) for x, y in zip(fits, here(lambda n, j=j: n >> j & 1), strict=True)]) * (1 << j) for j in range(max([*days, 1]).bit_length())]
    p = m.beside(pairs.select("id1", "id2")).where(any_bit([x.bitwiseAND(y) for x, y in zip(m.both("c"), here(bool), strict=True)]))
    total = (frame.train_end - frame.start).days
    out = p.select("id1", "id2", (sum(sums[1:], sums[0]) / total).alias("share"))
    return out if minimum is None else out.where(F.col("share") >= minimum)


def nearest_cells(lineage: DataFrame, frame: TimeFrame) -> DataFrame:
    """Grid cells with the nearest known values at or before (b) and at or after (a) each date."""
    w = Window.partitionBy("role_id").orderBy("d")
    known = F.when(F.col("wc").isNull(), F.struct("value"))
    cells = L.grid_cells(lineage, frame)
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return cells.select("role_id", "d", "value", "wc", before.alias("b"), after.alias("a"))


def pair_stats(pairs: DataFrame, lineage: DataFrame, frame: TimeFrame, labels: DataFrame | None = None, dataset: str = "", with_decay_score: bool = True) -> DataFrame:
    """The statistics row of every pair. All grid statistics come from one alignment and one aggregation.

    labels: id1, id2, is_match. Columns: dataset, ids, blocking flags, label, shares, counts, decay score, has_non_overlap.
    """
    T, g = F.lit(frame.train_end), frame.granularity
    base = L.remove_decayed(lineage)
    near = nearest_cells(lineage, frame)
    plain = L.grid_cells(base, frame)
    x = aligned(pairs, near.drop("a", "b")).select("id1", "id2", "d", "v1", "w1", "v2", "w2")
    for n in ("1", "2"):
        x = x.join(near.select(F.col("role_id").alias(f"id{n}"), "d", F.col("b").alias(f"b{n}"), F.col("a").alias(f"a{n}")), [f"id{n}", "d"])
        x = x.join(plain.select(F.col("role_id").alias(f"id{n}"), "d", F.col("value").alias(f"x{n}"), F.col("wc").alias(f"y{n}")), [f"id{n}", "d"])
    v1, w1, v2, w2 = _cols()
    upto, train = F.col("d") <= T, F.col("d") < T
    equal = lambda s, v: F.coalesce(F.col(s).eqNullSafe(F.struct(v.alias("value"))), F.lit(False)) & F.col(s).isNotNull()
    strict = F.when(w1.isNotNull() & w2.isNotNull(), True).when(w1.isNotNull(), equal("b1", v2) | equal("a1", v2)).when(w2.isNotNull(), equal("b2", v1) | equal("a2", v1)).otherwise(v1.eqNullSafe(v2))
    exact = same_raw(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    total = F.count_if(upto)
    agg = x.groupBy("id1", "id2").agg(
        (F.count_if(train & compatible(v1, w1, v2, w2)) * g / (frame.train_end - frame.start).days).alias("compatibility_share"),
        (F.count_if(train & strict) * g / (frame.train_end - frame.start).days).alias("strict_share"),
        F.bool_and(F.when(upto, compatible(v1, w1, v2, w2))).alias("in_strict_blocking"),
        (F.count_if(upto & exact) / total).alias("exact_match_share"), F.count_if(upto & exact).alias("va_count"),
        F.count_distinct(F.when(w1.isNull() & w2.isNull() & v1.eqNullSafe(v2) & (F.col("d") > F.lit(frame.start)), F.coalesce(v1, F.lit("null")))).alias("dva_days"),
        F.coalesce(F.bool_or(upto & w1.isNull() & w2.isNull() & v1.eqNullSafe(v2)), F.lit(False)).alias("in_sva_blocking"),
        F.bool_or(w1.isNull() != w2.isNull()).alias("has_non_overlap"),
    ).drop("dva_days")
    out = agg.join(distinct_agreements(pairs, lineage), ["id1", "id2"], "left").withColumn("dva_count", F.coalesce("dva_count", F.lit(0)))
    flags = B.keys(lineage, frame) | {"tsm_wildcard": B.tsm_key(lineage, frame.train_end, g, skip_wildcards=False)}
    for name, key in flags.items():
        for n in ("1", "2"):
            out = out.join(key.select(F.col("role_id").alias(f"id{n}"), F.col("key").alias(f"k{n}")), f"id{n}", "left")
        out = out.withColumn(f"in_{name}_blocking", F.coalesce(F.col("k1") == F.col("k2"), F.lit(False))).drop("k1", "k2")
    shared = transition_overlap(pairs, lineage).withColumn("has_transition_overlap", F.lit(True))
    out = out.join(shared, ["id1", "id2"], "left").withColumn("has_transition_overlap", F.coalesce("has_transition_overlap", F.lit(False)))
    if labels is not None:
        out = out.join(labels.select("id1", "id2", "is_match"), ["id1", "id2"], "left")
    if with_decay_score:
        out = out.join(decay_score(pairs, lineage, frame), ["id1", "id2"], "left")
    return out.withColumn("dataset", F.lit(dataset))


def transition_overlap(pairs: DataFrame, lineage: DataFrame) -> DataFrame:
    """The pairs that share an informative transition."""
    t = L.informative_transitions(lineage).where("prev is not null and after is not null")
    return beside(pairs.select("id1", "id2").distinct(), t.select("role_id", "prev", "after")).where(F.arrays_overlap("a", "b")).select("id1", "id2")


def distinct_agreements(pairs: DataFrame, lineage: DataFrame, *more: str) -> DataFrame:
    """id1, id2, dva_count: distinct known values that both have at change points after the first; more: columns of pairs to keep."""
    m = _states(lineage)
    values = m.values.limit(FEW + 1).collect()
    if len(values) <= FEW:
        by: dict[str, list[Column]] = {}
        later = _later_starts(m)
        for r in values:  # a null value counts as the text null
            hit = any_bit([x.bitwiseAND(y).bitwiseAND(z) for x, y, z in zip(m.has(r["code"], 1), m.has(r["code"], 2), later, strict=True)])
            by.setdefault("null" if r["value"] is None else r["value"], []).append(hit)
        n = [F.when(any_of, 1).otherwise(0) for any_of in (reduce(lambda x, y: x | y, hits) for hits in by.values())]
        return m.beside(pairs.select("id1", "id2", *more)).select("id1", "id2", *more, sum(n, F.lit(0)).cast("bigint").alias("dva_count"))
    w = Window.partitionBy("id1", "id2").orderBy("valid_from")
    p = pieces(pairs, lineage).withColumn("i", F.row_number().over(w))
    v1, w1, v2, w2 = _cols()
    hit = (F.col("i") > 1) & w1.isNull() & w2.isNull() & v1.eqNullSafe(v2)
    out = p.groupBy("id1", "id2").agg(F.count_distinct(F.when(hit, F.coalesce(v1, F.lit("null")))).alias("dva_count"))
    return out.join(pairs.select("id1", "id2", *more), ["id1", "id2"]).select("id1", "id2", *more, "dva_count") if more else out


def decay_score(pairs: DataFrame, lineage: DataFrame, frame: TimeFrame, step: float = 0.005) -> DataFrame:
    """id1, id2, decay_score: the largest share theta of 1.0, 1 - step, ... 0 at which the decayed pair is compatible; else -1.

    Decaying more never makes a pair incompatible, and only a role's own durations can be its cutoffs. So each clash of the two
    histories asks for a cutoff that ends one of its values before the other begins: theta is found by testing the few
    thetas at which either cutoff moves, all in one aggregation.
    """
    thetas = [round(1 - i * step, 6) for i in range(int(round(1 / step)) + 1)]
    rows = lineage.withColumn("nx", F.lead("ts").over(L.by_time()))
    dur = F.when(F.col("nx") <= F.lit(frame.train_end), F.datediff("nx", "ts"))
    cuts = rows.groupBy("role_id").agg(F.array_sort(F.collect_list(dur)).alias("ds"))
    end = F.lit(frame.end)
    i = rows.where("wc is null").select("role_id", "ts", F.coalesce("nx", end).alias("stop"), F.col("nx").isNull().alias("open"), F.struct("value").alias("v"))
    i = i.join(cuts, "role_id").select("role_id", F.datediff("ts", F.lit(frame.start)).alias("f"), F.datediff("stop", F.lit(frame.start)).alias("t"), "v", "ds")
    entry = F.array_sort(F.collect_list(F.struct(F.col("f"), F.col("t"), F.col("value.value").alias("v"), F.col("value.none").alias("none")))).alias("e")
    plain = F.struct(F.coalesce("v.value", F.lit("")).alias("value"), F.col("v.value").isNull().alias("none"))
    m = states(i.select("role_id", "f", "t", plain.alias("value"), F.lit(True).alias("known"), "ds"), {"s": (F.lit(True), False)}, entry, F.first("ds").alias("ds"))
    x = m.beside(pairs.select("id1", "id2"), "left")
    clashing = any_bit(m.differ())
    # two values that begin on one date overlap whatever the cutoffs
    never = any_bit([x.bitwiseAND(y) for x, y in zip(m.both("s"), m.differ(), strict=True)])
    overlap = lambda p: lambda q: (p["f"] < q["t"]) & (q["f"] < p["t"]) & ((p["v"] != q["v"]) | (p["none"] != q["none"]))
    span = lambda p: lambda q: F.struct(p["f"].alias("a"), (p["t"] - p["f"]).alias("la"), q["f"].alias("b"), (q["t"] - q["f"]).alias("lb"))
    clashes = F.flatten(F.transform("e_1", lambda p: F.transform(F.filter("e_2", overlap(p)), span(p))))
    x = x.select("id1", "id2", clashing.alias("clashing"), never.alias("never"), F.col("ds_1").alias("d1"), F.col("ds_2").alias("d2"), F.when(clashing & ~never, clashes).alias("clashes"))
    g = F.lit(frame.granularity)

    def cutoff(ds, theta):
        k = F.ceil(F.size(ds) * theta).cast("int")
        return F.when((theta >= 1) | (F.size(ds) == 0), F.lit(1 << 30)).when(k < 1, g).otherwise(F.try_element_at(ds, F.greatest(k, F.lit(1))))

    def clear(theta):
        c1, c2 = cutoff(F.col("d1"), theta), cutoff(F.col("d2"), theta)
        apart = lambda c: (c["a"] + F.least(c["la"], c1) <= c["b"]) | (c["b"] + F.least(c["lb"], c2) <= c["a"])
        return F.forall("clashes", apart)

    # cutoffs grow with theta above 0, so the first theta from above that is clear is found by halving; at 0 the cutoff is the grid's step
    upper = F.lit(thetas[:-1]).cast("array<double>")
    halve = lambda s, _: F.when(s["lo"] >= s["hi"], s).when(clear(F.get(upper, s["lo"] + F.floor((s["hi"] - s["lo"]) / 2).cast("int"))), F.struct(s["lo"].alias("lo"), (s["lo"] + F.floor((s["hi"] - s["lo"]) / 2).cast("int")).alias("hi"))).otherwise(F.struct((s["lo"] + F.floor((s["hi"] - s["lo"]) / 2).cast("int") + 1).alias("lo"), s["hi"].alias("hi")))
    whole = F.struct(F.lit(0).alias("lo"), F.lit(len(thetas) - 1).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(len(thetas).bit_length())), whole, halve, lambda s: s["lo"])
    best = F.coalesce(F.get(upper, found), F.when(clear(F.lit(0.0)), F.lit(0.0)))
    score = F.when(~F.col("clashing"), 1.0).when(F.col("never"), -1.0).otherwise(F.coalesce(best, F.lit(-1.0)))
    return x.select("id1", "id2", score.alias("decay_score"))


def phase_evidence(pairs: DataFrame, lineage: DataFrame, frame: TimeFrame) -> DataFrame:
    """id1, id2, train_evidence, test_evidence: change points before / after the end of training at which both are known."""
    w = Window.partitionBy("id1", "id2").orderBy("valid_from")
    p = pieces(pairs, lineage).withColumn("i", F.row_number().over(w))
    known = (F.col("i") > 1) & F.col("w1").isNull() & F.col("w2").isNull()
    at, T = F.col("valid_from"), F.lit(frame.train_end)
    return p.groupBy("id1", "id2").agg(F.count_if(known & (at < T)).alias("train_evidence"), F.count_if(known & (at > T)).alias("test_evidence"))


def first_real_change(lineage: DataFrame, train_end: date) -> DataFrame:
    """role_id, change_ts: the first entry from train_end on whose known value differs from the last known one; null if none."""
    T = F.lit(train_end)
    last = lineage.where((F.col("ts") <= T) & F.col("wc").isNull()).groupBy("role_id").agg(F.max_by(F.struct("value"), "ts").alias("k"))
    rows = lineage.join(last, "role_id", "left")
    real = (F.col("ts") >= T) & F.col("wc").isNull() & F.col("k").isNotNull() & ~F.col("value").eqNullSafe(F.col("k.value"))
    return rows.groupBy("role_id").agg(F.min(F.when(real, F.col("ts"))).alias("change_ts"))


def first_value_agrees(pairs: DataFrame, lineage: DataFrame, train_end: date) -> DataFrame:
    """id1, id2, valid: the first known values from train_end on are equal, or both absent."""
    late = (F.col("ts") >= F.lit(train_end)) & F.col("wc").isNull()
    first = lineage.groupBy("role_id").agg(F.min_by(F.when(late, F.struct("value")), F.when(late, F.col("ts"))).alias("v"))
    return _meet(pairs, first, F.col("x1").eqNullSafe(F.col("x2")))


def super_strict(pairs: DataFrame, lineage: DataFrame, train_end: date) -> DataFrame:
    """id1, id2, valid: the known entries from train_end on are the same."""
    late = (F.col("ts") >= F.lit(train_end)) & F.col("wc").isNull()
    e = lineage.groupBy("role_id").agg(F.array_sort(F.collect_list(F.when(late, F.struct("ts", "value")))).alias("v"))
    return _meet(pairs, e, F.col("x1") == F.col("x2"))


def _meet(pairs: DataFrame, by_role: DataFrame, test: Column) -> DataFrame:
    for n in ("1", "2"):
        pairs = pairs.join(by_role.select(F.col("role_id").alias(f"id{n}"), F.col("v").alias(f"x{n}")), f"id{n}")
    return pairs.select("id1", "id2", test.alias("valid"))


def class_label(pairs: DataFrame, lineage: DataFrame, frame: TimeFrame) -> DataFrame:
    """id1, id2, label: whether the two match exactly after the end of training; null unless either really changes then."""
    change = first_real_change(lineage, frame.train_end).select("role_id", F.when(F.col("change_ts").isNotNull(), True).alias("changes"))
    cells = L.grid_cells(L.remove_decayed(lineage), frame).where(F.col("d") > F.lit(frame.train_end))
    day = F.struct(F.coalesce("value", F.lit("")).alias("v"), F.col("value").isNull().alias("none"), F.coalesce("wc", F.lit("")).alias("w"), F.col("wc").isNull().alias("known"))
    m = states(cells.select("role_id", F.col("d").alias("f"), F.date_add("d", 1).alias("t"), day.alias("value"), F.lit(True).alias("known")), {})
    rows = cut(change.join(m.rows, "role_id", "left").fillna(0, m.names))  # marks are of any cell, so that k tells where there is one
    x = States(rows, m.dates, m.marks, m.words, m.bits, m.values, m.small).beside(pairs.select("id1", "id2"), "left")
    same = F.when(any_bit(m.both("k")), ~any_bit(m.differ()))
    return x.select("id1", "id2", F.when(F.col("changes_1").isNotNull() | F.col("changes_2").isNotNull(), same).alias("label"))


def token_similarity(lineage: DataFrame) -> DataFrame:
    """id1, id2, similarity: over shared known values, the sum of 1 / log2(roles with the value, squared) + 1."""
    v = lineage.where("wc is null and value is not null").select("role_id", "value").distinct()
    n = v.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    weighted = v.join(n, "value").select("role_id", "value", (1 / F.log2(F.col("n") * F.col("n")) + 1).alias("w"))
    a, b = weighted.withColumnRenamed("role_id", "id1"), weighted.drop("w").withColumnRenamed("role_id", "id2")
    return a.join(b, "value").where("id1 < id2").groupBy("id1", "id2").agg(F.sum("w").alias("similarity"))


def first_shared_value(pairs: DataFrame, lineage: DataFrame) -> DataFrame:
    """id1, id2, ts, value: the first known value that both hold at once."""
    v1, w1, v2, w2 = _cols()
    p = pieces(pairs, lineage).where(w1.isNull() & w2.isNull() & v1.eqNullSafe(v2))
    return p.groupBy("id1", "id2").agg(F.min("valid_from").alias("ts"), F.min_by("v1", "valid_from").alias("value"))
