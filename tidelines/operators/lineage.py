"""Operators on attribute histories in long form: role_id, ts, value, wc, one row by change."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import TimeFrame
from ..functions.values import informative, same_raw, shown
from .order import running_sum


def by_time():
    """A role's entries in order of time."""
    return Window.partitionBy("role_id").orderBy("ts")


def KNOWN() -> Column:  # noqa: N802
    """The entry is not a missing-value marker."""
    return F.col("wc").isNull()


def intervals(lineage: DataFrame, horizon: date) -> DataFrame:
    """role_id, valid_from, valid_to, value, wc: half-open; the last interval ends at the horizon."""
    to = F.coalesce(F.lead("ts").over(by_time()), F.greatest(F.lit(horizon), F.col("ts")))
    return lineage.select("role_id", F.col("ts").alias("valid_from"), to.alias("valid_to"), "value", "wc")


def grid_cells(lineage: DataFrame, frame: TimeFrame, first: date | None = None, last: date | None = None) -> DataFrame:
    """role_id, d, value, wc at every grid date from first to last (the frame's by default)."""
    horizon = date.fromordinal(frame.end.toordinal() + frame.granularity)
    i = intervals(lineage, horizon)
    g = F.lit(frame.granularity)
    days = F.explode(F.sequence(F.col("valid_from"), F.date_sub("valid_to", 1), F.make_dt_interval(g)))
    cells = i.where("valid_from < valid_to").select("role_id", days.alias("d"), "value", "wc")
    return cells.where(F.col("d").between(F.lit(first or frame.start), F.lit(last or frame.end)))


def value_at(lineage: DataFrame, at: date) -> DataFrame:
    """As-of lookup: role_id, value, wc of the last entry at or before a date; R if there is none."""
    entry = F.struct("value", "wc")
    past = F.col("ts") <= F.lit(at)
    last = lineage.groupBy("role_id").agg(F.max_by(F.when(past, entry), F.when(past, F.col("ts"))).alias("e"))
    return last.select("role_id", "e.value", F.when(F.col("e").isNull(), "R").otherwise(F.col("e.wc")).alias("wc"))


def project(lineage: DataFrame, first: date, last: date) -> DataFrame:
    """Clip to [first, last]: the value carried in is stamped at first."""
    i = intervals(lineage, date(9999, 12, 31))
    clipped = i.where((F.col("valid_from") <= F.lit(last)) & (F.col("valid_to") > F.lit(first)))
    return clipped.select("role_id", F.greatest("valid_from", F.lit(first)).alias("ts"), "value", "wc")


def up_to(lineage: DataFrame, end: date) -> DataFrame:
    return lineage.where(F.col("ts") <= F.lit(end))


def values_in_interval(lineage: DataFrame, first: date, last: date) -> DataFrame:
    """Clipped half-open intervals inside [first, last]; R for what lies before a history's first entry."""
    to = F.date_add(F.lit(last), 1)
    i = intervals(lineage, date(9999, 12, 31)).where((F.col("valid_from") <= F.lit(last)) & (F.col("valid_to") > F.lit(first)))
    parts = i.select("role_id", F.greatest("valid_from", F.lit(first)).alias("valid_from"), F.least("valid_to", to).alias("valid_to"), "value", "wc")
    born = lineage.groupBy("role_id").agg(F.min("ts").alias("t")).where(F.col("t") > F.lit(first))
    before = born.select("role_id", F.lit(first).alias("valid_from"), F.least("t", to).alias("valid_to"), F.lit(None).cast("string").alias("value"), F.lit("R").alias("wc"))
    return parts.unionByName(before)


def _listed(c: Column) -> Column:
    """Text of entries in order of time, from structs (ts, text)."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["s"]), ";")


def exact_sequence(lineage: DataFrame, frame: TimeFrame, end: date) -> DataFrame:
    """role_id, seq: grid values up to end, all markers alike."""
    s = F.when(F.col("wc").isNotNull(), "⊥").otherwise(F.coalesce("value", F.lit("null")))
    return grid_cells(lineage, frame, last=end).groupBy("role_id").agg(_listed(F.struct("d", s.alias("s"))).alias("seq"))


def dedupe(lineage: DataFrame) -> DataFrame:
    """Drop entries equal to their predecessor."""
    p = F.lag(F.struct("value", "wc")).over(by_time())
    kept = lineage.withColumn("__p", p).where(F.col("__p").isNull() | ~same_raw(F.col("value"), F.col("wc"), F.col("__p.value"), F.col("__p.wc")))
    return kept.drop("__p")


def remove_decayed(lineage: DataFrame) -> DataFrame:
    return dedupe(lineage.where(~F.col("wc").eqNullSafe(F.lit("DE"))))


def change_sequence(lineage: DataFrame, end: date, wildcards: bool = True) -> DataFrame:
    """role_id, seq: values of consecutive different entries before end."""
    rows = lineage.where(F.col("ts") < F.lit(end))
    rows = dedupe(rows if wildcards else rows.where(KNOWN()))
    return rows.groupBy("role_id").agg(_listed(F.struct("ts", shown(F.col("value"), F.col("wc")).alias("s"))).alias("seq"))


def value_set(lineage: DataFrame, end: date) -> DataFrame:
    """role_id, vals: sorted distinct known values before end; histories without one have the empty set."""
    v = F.when((F.col("ts") < F.lit(end)) & KNOWN(), F.coalesce("value", F.lit("null")))
    return lineage.groupBy("role_id").agg(F.array_join(F.array_sort(F.collect_set(v)), ";").alias("vals"))


def known_days(lineage: DataFrame, end: date) -> DataFrame:
    """role_id, days: days with a known value before end."""
    i = intervals(lineage, end).where(F.col("valid_from") < F.lit(end))
    days = F.datediff(F.least("valid_to", F.lit(end)), "valid_from")
    return i.groupBy("role_id").agg(F.sum(F.when(KNOWN(), days).otherwise(0)).cast("bigint").alias("days"))


def density(lineage: DataFrame, frame: TimeFrame) -> DataFrame:
    """role_id, density: share of days from the start to the end of training with a known value."""
    end = date.fromordinal(frame.train_end.toordinal() + 1)
    return known_days(lineage, end).select("role_id", (F.col("days") / (end - frame.start).days).alias("density"))


def value_days(lineage: DataFrame, frame: TimeFrame, end: date) -> DataFrame:
    """role_id, value, n: grid dates up to end on which a known value holds."""
    return grid_cells(lineage, frame, last=end).where(KNOWN()).groupBy("role_id", "value").agg(F.count(F.lit(1)).alias("n"))


def is_numeric(lineage: DataFrame) -> DataFrame:
    fine = F.col("wc").isNotNull() | F.col("value").isNull() | F.col("value").rlike("^[0-9]*$")
    return lineage.groupBy("role_id").agg(F.bool_and(fine).alias("is_numeric"))


def of_interest(lineage: DataFrame, train_end: date) -> DataFrame:
    """Roles with more than one known value before the end of training and one from then on."""
    v = F.when(KNOWN(), F.coalesce("value", F.lit("null")))
    train = F.col("ts") < F.lit(train_end)
    n = lineage.groupBy("role_id").agg(F.count_distinct(F.when(train, v)).alias("n_train"), F.count_distinct(F.when(~train, v)).alias("n_test"))
    return n.where("n_train > 1 and n_test >= 1")


def steps(lineage: DataFrame, skip_wildcards: bool = True) -> DataFrame:
    """role_id, ts, prev, after (entries as text), prev_ts: consecutive entries."""
    rows = lineage.where(KNOWN()) if skip_wildcards else lineage
    now = shown(F.col("value"), F.col("wc"))
    s = rows.select("role_id", "ts", F.lag(now).over(by_time()).alias("prev"), now.alias("after"), F.lag("ts").over(by_time()).alias("prev_ts"), "value", F.lag("value").over(by_time()).alias("prev_value"))
    return s.where("prev_ts is not null")


def transitions(lineage: DataFrame, include_same: bool = False, ignore_interleaved: bool = True) -> DataFrame:
    """Distinct role_id, prev, after of known neighbours; interleaved ones have unknown entries between them."""
    if ignore_interleaved:
        found = steps(lineage)
    else:
        w = F.lag("wc").over(by_time())
        now = shown(F.col("value"), F.col("wc"))
        all_ = lineage.select("role_id", "wc", now.alias("after"), F.lag(now).over(by_time()).alias("prev"), w.alias("pw"), F.lag("ts").over(by_time()).alias("prev_ts"))
        found = all_.where("prev_ts is not null and wc is null and pw is null")
    return (found if include_same else found.where("prev <> after")).select("role_id", "prev", "after").distinct()


def informative_transitions(lineage: DataFrame) -> DataFrame:
    """Distinct transitions between known values that are neither null nor empty; X, unknown, X gives (X, X)."""
    s = steps(lineage)
    none = F.lit(None).cast("string")
    return s.where(informative(F.col("value"), none) & informative(F.col("prev_value"), none)).select("role_id", "prev", "after").distinct()


def transition_set(lineage: DataFrame, granularity: int, end: date, skip_wildcards: bool = True) -> DataFrame:
    """Distinct role_id, prev, after before end, with (x, x) for values held longer than the granularity."""
    rows = lineage.where(F.col("ts") < F.lit(end))
    s = steps(rows, skip_wildcards).withColumn("last", F.lead("ts").over(by_time()).isNull())
    pair = lambda a, b: F.struct(F.col(a).alias("prev"), F.col(b).alias("after"))
    made = F.array_compact(F.array(pair("prev", "after"), F.when(F.datediff("ts", "prev_ts") > granularity, pair("prev", "prev")), F.when(F.col("last") & (F.col("ts") < F.lit(end)), pair("after", "after"))))
    return s.select("role_id", F.explode(made).alias("t")).select("role_id", "t.prev", "t.after").distinct()


def transition_histogram(transition_rows: DataFrame) -> DataFrame:
    """prev, after, n: how many roles have a transition."""
    return transition_rows.groupBy("prev", "after").agg(F.count_distinct("role_id").alias("n"))


def change_counts(lineage: DataFrame) -> DataFrame:
    """role_id, least, most: certain changes, and possible ones if every unknown entry hides a change."""
    known = F.last(F.when(KNOWN(), F.struct("value")), ignorenulls=True).over(by_time().rowsBetween(Window.unboundedPreceding, -1))
    prev = F.lag(F.struct("value", "wc")).over(by_time())
    rows = lineage.select("role_id", "value", "wc", known.alias("k"), prev.alias("p"))
    certain = KNOWN() & F.col("k").isNotNull() & ~F.col("value").eqNullSafe(F.col("k.value"))
    possible = F.col("p").isNotNull() & (F.col("wc").isNotNull() | ~same_raw(F.col("value"), F.col("wc"), F.col("p.value"), F.col("p.wc")))
    return rows.groupBy("role_id").agg(F.count_if(certain).alias("least"), F.count_if(possible).alias("most"))


def nearest_known(lineage: DataFrame, at: date) -> DataFrame:
    """role_id, before, after: the nearest known values at or before, and at or after, a date."""
    past, coming = KNOWN() & (F.col("ts") <= F.lit(at)), KNOWN() & (F.col("ts") >= F.lit(at))
    pick = lambda f, c: f(F.when(c, F.col("value")), F.when(c, F.col("ts")))
    return lineage.groupBy("role_id").agg(pick(F.max_by, past).alias("before"), pick(F.min_by, coming).alias("after"))


def stretch(lineage: DataFrame, start: date, factor: int) -> DataFrame:
    return lineage.withColumn("ts", F.date_add(F.lit(start), F.datediff("ts", F.lit(start)) * factor))


def append(first: DataFrame, second: DataFrame) -> DataFrame:
    """Concatenate histories; where both have entries for a role, the second's must all be later."""
    ends = first.groupBy("role_id").agg(F.max("ts").alias("__end"))
    later = second.join(ends, "role_id", "left").withColumn("ts", F.when(F.col("__end").isNull() | (F.col("ts") > F.col("__end")), F.col("ts")).otherwise(F.raise_error(F.lit("histories overlap in time")).cast("date")))
    return first.unionByName(later.drop("__end"))


def short_string(lineage: DataFrame) -> DataFrame:
    """role_id, s: <from-to:value,...> of different neighbours, open at the end."""
    i = intervals(dedupe(lineage), date(9999, 12, 31))
    to = F.when(F.col("valid_to") == F.lit(date(9999, 12, 31)), "?").otherwise(F.date_sub("valid_to", 1).cast("string"))
    part = F.concat(F.col("valid_from").cast("string"), F.lit("-"), to, F.lit(":"), shown(F.col("value"), F.col("wc")))
    return i.groupBy("role_id").agg(F.concat(F.lit("<"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("valid_from", part.alias("s")))), lambda x: x["s"]), ","), F.lit(">")).alias("s"))


def summary(lineage: DataFrame) -> DataFrame:
    """role_id, first_ts, last_ts, n_entries, n_known."""
    return lineage.groupBy("role_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_entries"), F.count_if(KNOWN()).alias("n_known"))


def decay(lineage: DataFrame, theta: float, frame: TimeFrame) -> DataFrame:
    """Replace the stale tail of long-held values by a marker (DE).

    The cutoff is the ceil(theta * n)-th shortest of a history's n durations up to the end of training; every known interval that is
    longer, the last one up to the end of the frame, decays after the cutoff. theta = 1 changes nothing.
    """
    if theta >= 1:
        return lineage
    nxt = F.lead("ts").over(by_time())
    rows = lineage.withColumn("__next", nxt)
    dur = F.when(F.col("__next") <= F.lit(frame.train_end), F.datediff("__next", "ts"))
    cut = rows.groupBy("role_id").agg(F.array_sort(F.collect_list(dur)).alias("__d"))
    k = F.ceil(F.size("__d") * F.lit(float(theta))).cast("int")
    cut = cut.select("role_id", F.when(F.size("__d") > 0, F.when(k < 1, frame.granularity).otherwise(F.try_element_at("__d", F.greatest(k, F.lit(1))))).alias("__cut"))
    joined = rows.join(cut, "role_id")
    held = F.datediff(F.coalesce("__next", F.lit(frame.end)), "ts")
    entry = lambda ts, v, wc: F.struct(ts.alias("ts"), v.alias("value"), wc.alias("wc"))
    stale = F.when(KNOWN() & (held > F.col("__cut")), entry(F.date_add("ts", F.col("__cut")), F.lit(None).cast("string"), F.lit("DE")))
    made = F.array_compact(F.array(entry(F.col("ts"), F.col("value"), F.col("wc")), stale))
    return joined.select("role_id", F.explode(made).alias("e")).select("role_id", "e.ts", "e.value", "e.wc")


def irregular_roles(lineage: DataFrame, least_size: int = 20, least_known: int = 10, times: float = 2.0) -> DataFrame:
    """Roles whose gaps between changes vary by more than `times` their mean; the first two entries don't count."""
    rows = lineage.withColumn("__i", F.row_number().over(by_time())).withColumn("__p", F.lag("ts").over(by_time()))
    gap = F.when(F.col("__i") > 2, F.datediff("ts", "__p"))
    s = rows.groupBy("role_id").agg(F.count(F.lit(1)).alias("size"), F.count_if(KNOWN()).alias("n_known"), F.avg(gap).alias("mean_gap"), F.stddev_pop(gap).alias("sd_gap"))
    return s.where((F.col("size") > least_size) & (F.col("n_known") > least_known) & (F.col("sd_gap") > times * F.col("mean_gap")))


def roleset_stats(lineage: DataFrame, frame: TimeFrame) -> DataFrame:
    """One row: roles, pairs (n(n+1)/2), mean and population deviation of distinct known values and of density."""
    v = F.when(KNOWN() & (F.col("ts") <= F.lit(frame.end)), F.coalesce("value", F.lit("null")))
    per = lineage.groupBy("role_id").agg(F.count_distinct(v).alias("n")).join(density(lineage, frame), "role_id")
    n = F.count(F.lit(1))
    return per.agg(n.alias("n_roles"), F.floor(n * (n + 1) / 2).cast("bigint").alias("n_pairs"), F.avg("n").alias("avg_values"), F.stddev_pop("n").alias("sd_values"), F.avg("density").alias("avg_density"), F.stddev_pop("density").alias("sd_density"))


def value_distribution(lineage: DataFrame) -> DataFrame:
    """value, n, upto: entries by known value, with the running count in falling order of frequency."""
    n = lineage.where(KNOWN()).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return running_sum(n, [F.col("n").desc(), F.col("value")], F.col("n"), "upto")
