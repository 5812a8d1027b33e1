"""From raw revisions to grid-aligned histories.

Revisions are rows key, property, valid_from (timestamp), revision_id, value (null: deleted). Values hold until the property's next
revision. A bucket is a grid cell [b, b + granularity).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frame import TimeFrame
from ..functions.values import links
from . import lineage as L

ROLE = ("key", "property")
MODES = ("no_decay", "between_changes", "between_all_confirmations", "outside_grace", "probabilistic")
GRACE_DAYS = 28


def role_id(df: DataFrame) -> DataFrame:
    return df.withColumn("role_id", F.concat_ws("||", *ROLE))


def integrity(revisions: DataFrame) -> DataFrame:
    """One row: revisions, distinct ids, keys with repeated times, deletions with a value, creations with a previous value."""
    w = Window.partitionBy("key", "property").orderBy("valid_from", "revision_id")
    r = revisions.withColumn("same_time", F.lag("valid_from").over(w).eqNullSafe(F.col("valid_from")))
    return r.agg(F.count(F.lit(1)).alias("n_revisions"), F.count_distinct("revision_id").alias("n_ids"), F.count_if("same_time").alias("n_same_time"), F.count_if(F.col("value").isNull()).alias("n_deletions"))


def drop_zero_length(revisions: DataFrame) -> DataFrame:
    """Of revisions of a property at one instant only the last has a length."""
    w = Window.partitionBy(*ROLE).orderBy("valid_from", "revision_id")
    return revisions.withColumn("__n", F.lead("valid_from").over(w)).where(F.col("__n").isNull() | (F.col("__n") > F.col("valid_from"))).drop("__n")


def replay(revisions: DataFrame, frame: TimeFrame) -> DataFrame:
    """key, property, from_ts, value, wc: changed values in order of time, with the markers before the first one.

    A deletion is CE; R stands from the frame's start if the key appears later, CE from the key's first bucket if the property does.
    """
    clean = drop_zero_length(revisions)
    w = Window.partitionBy(*ROLE).orderBy("valid_from", "revision_id")
    entry = F.struct("value", F.when(F.col("value").isNull(), "CE").alias("wc"))
    rows = clean.select(*ROLE, "valid_from", entry.alias("e"), F.lag(entry).over(w).alias("p"))
    changed = rows.where(F.col("p").isNull() | (F.col("e") != F.col("p"))).select(*ROLE, F.col("valid_from").alias("from_ts"), "e.value", "e.wc")
    born = clean.groupBy("key").agg(F.min("valid_from").alias("key_ts"))
    first = changed.groupBy(*ROLE).agg(F.min("from_ts").alias("ts")).join(born, "key")
    start, bucket = F.lit(frame.start).cast("timestamp"), frame.floor(F.col("key_ts")).cast("timestamp")
    mark = lambda ts, wc: F.struct(ts.alias("from_ts"), F.lit(None).cast("string").alias("value"), F.lit(wc).alias("wc"))
    # the key's own bucket may hold the property's first value already
    lead = F.array_compact(F.array(F.when(bucket > start, mark(start, "R")), F.when((F.col("ts") > bucket) & (F.col("ts") > F.col("key_ts")), mark(bucket, "CE"))))
    marks = first.select(*ROLE, F.explode(lead).alias("m")).select(*ROLE, "m.from_ts", "m.value", "m.wc")
    return changed.unionByName(marks)


def link_properties(revisions: DataFrame, most: int = 10) -> DataFrame:
    """Revisions of derived properties, one by place of a link inside the value; a link that disappears is not cleared."""
    found = revisions.select("key", "property", "valid_from", "revision_id", F.posexplode(links(F.col("value"), most)).alias("i", "link"))
    return found.select("key", F.concat("property", F.lit("_🔗_extractedLink"), F.col("i").cast("string")).alias("property"), "valid_from", "revision_id", F.col("link").alias("value"))


def max_links(revisions: DataFrame) -> DataFrame:
    return revisions.groupBy(*ROLE).agg(F.max(F.size(links(F.col("value"), 1 << 20))).alias("n_links"))


def bucket_majority(replayed: DataFrame, frame: TimeFrame) -> DataFrame:
    """role_id, ts, value, wc of every bucket with a change: what held longest in it; ties go to the later start, then the value."""
    w = Window.partitionBy(*ROLE).orderBy("from_ts")
    i = replayed.withColumn("to_ts", F.lead("from_ts").over(w))
    buckets = replayed.select(*ROLE, frame.floor(F.col("from_ts")).alias("ts")).distinct().where(F.col("ts").between(F.lit(frame.start), F.lit(frame.end)))
    b0, b1 = F.col("ts").cast("timestamp"), F.date_add("ts", frame.granularity).cast("timestamp")
    met = buckets.join(i, list(ROLE)).where((F.col("from_ts") < b1) & (F.col("to_ts").isNull() | (F.col("to_ts") > b0)))
    a, b = F.greatest("from_ts", b0), F.least(F.coalesce("to_ts", b1), b1)
    micros = F.unix_micros(b) - F.unix_micros(a)
    by_value = met.groupBy(*ROLE, "ts", "value", "wc").agg(F.sum(micros).alias("held"), F.max("from_ts").alias("latest"))
    best = by_value.groupBy(*ROLE, "ts").agg(F.max_by(F.struct("value", "wc"), F.struct("held", "latest", "value", "wc")).alias("e"))
    return role_id(best).select("role_id", "ts", "e.value", "e.wc")


def no_decay(revisions: DataFrame, frame: TimeFrame) -> DataFrame:
    """Majority values of the buckets with a change, equal neighbours joined; histories without a known value dropped."""
    return keep_known(L.dedupe(bucket_majority(replay(revisions, frame), frame)))


def keep_known(lineage: DataFrame) -> DataFrame:
    known = lineage.groupBy("role_id").agg(F.bool_or(F.col("wc").isNull()).alias("k")).where("k").select("role_id")
    return lineage.join(known, "role_id", "left_semi")


def confirmations(revisions: DataFrame, frame: TimeFrame) -> DataFrame:
    """role_id, ts: buckets in which a revision of the role's key confirms its value."""
    roles = role_id(revisions).select("key", "role_id").distinct()
    at = revisions.select("key", frame.floor(F.col("valid_from")).alias("ts")).distinct()
    return roles.join(at, "key").select("role_id", "ts")


def with_gaps(revisions: DataFrame, frame: TimeFrame, mode: str, grace: int = GRACE_DAYS) -> DataFrame:
    """no_decay histories in which values decay between confirmations.

    between_changes: only if the value next confirmed differs; between_all_confirmations: always; outside_grace: after the grace
    period. A value decays one grid step (or the grace period) after its last confirmation, unless the next confirmation or the
    frame's end comes first.
    """
    plain = no_decay(revisions, frame)
    i = L.intervals(plain, frame.end)
    points = confirmations(revisions, frame).join(i, "role_id").where("ts >= valid_from and (ts < valid_to or valid_from = valid_to)").select("role_id", "ts", "value", "wc")
    starts = plain.select("role_id", "ts", "value", "wc")
    w = Window.partitionBy("role_id").orderBy("ts")
    p = points.unionByName(starts).distinct().select("role_id", "ts", "value", "wc", F.lead(F.struct("ts", "value", "wc")).over(w).alias("n"))
    wait = grace if mode == "outside_grace" else frame.granularity
    gone = F.date_add("ts", wait)
    apart = F.col("n").isNull() | (gone < F.col("n.ts"))
    if mode == "between_changes":
        apart &= F.col("n").isNull() | ~(F.col("n.value").eqNullSafe(F.col("value")) & F.col("n.wc").eqNullSafe(F.col("wc")))
    e = lambda ts, v, k: F.struct(ts.alias("ts"), v.alias("value"), k.alias("wc"))
    made = F.array_compact(F.array(e(F.col("ts"), F.col("value"), F.col("wc")), F.when(F.col("wc").isNull() & apart & (gone <= F.lit(frame.end)), e(gone, F.lit(None).cast("string"), F.lit("DE")))))
    return L.dedupe(p.select("role_id", F.explode(made).alias("e")).select("role_id", "e.ts", "e.value", "e.wc"))


def probabilistic(revisions: DataFrame, frame: TimeFrame, share: float) -> DataFrame:
    """no_decay histories whose values decay after the share-quantile of their durations up to the end of training.

    The first, artificial interval doesn't count; histories of one entry are dropped.
    """
    plain = no_decay(revisions, frame)
    rows = plain.withColumn("nx", F.lead("ts").over(L.by_time())).withColumn("i", F.row_number().over(L.by_time()))
    dur = F.when((F.col("nx") <= F.lit(frame.train_end)) & (F.col("i") > 1), F.datediff("nx", "ts"))
    cut = rows.groupBy("role_id").agg(F.array_sort(F.collect_list(dur)).alias("ds"), F.count(F.lit(1)).alias("n"), F.max("ts").alias("end")).where("n > 1")
    k = F.ceil(F.size("ds") * F.lit(float(share))).cast("int")
    cut = cut.select("role_id", "end", F.try_element_at("ds", F.greatest(k, F.lit(1))).alias("cut"))
    j = rows.join(cut, "role_id")
    held = F.datediff(F.coalesce("nx", "end"), "ts")
    e = lambda ts, v, w: F.struct(ts.alias("ts"), v.alias("value"), w.alias("wc"))
    stale = F.when(F.col("wc").isNull() & (held > F.col("cut")), e(F.date_add("ts", F.col("cut")), F.lit(None).cast("string"), F.lit("DE")))
    return L.dedupe(j.select("role_id", F.explode(F.array_compact(F.array(e(F.col("ts"), F.col("value"), F.col("wc")), stale))).alias("x")).select("role_id", "x.ts", "x.value", "x.wc"))


def ingest(revisions: DataFrame, frame: TimeFrame, mode: str = "no_decay", share: float = 0.57) -> DataFrame:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "no_decay":
        return no_decay(revisions, frame)
    return probabilistic(revisions, frame, share) if mode == "probabilistic" else with_gaps(revisions, frame, mode)


def template_counts(rows: DataFrame, template: str = "template") -> DataFrame:
    return rows.groupBy(template).agg(F.count(F.lit(1)).alias("n"))


def page_titles(revisions: DataFrame) -> DataFrame:
    """page_id, title of each key's last revision; columns key, page_id, page_title, valid_from."""
    last = revisions.groupBy("key").agg(F.max_by(F.struct("page_id", "page_title"), "valid_from").alias("p"))
    return last.select("p.page_id", F.translate("p.page_title", "\r\n,", "   ").alias("title")).distinct()
