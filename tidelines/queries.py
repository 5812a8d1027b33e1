"""The registered queries of the history operators, and the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frame import EVENTS, ORDERS, TimeFrame
from .functions import values as V
from .operators import blocking as B
from .operators import groups as R
from .operators import ingest as N
from .operators import lineage as L
from .operators import pairs as P
from .operators import sampling as S
from .operators.meeting import by_histories
from .plans import compatible as C
from .plans import split_tree as ST
from .sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
WEEKLY = TimeFrame(date(2024, 1, 1), date(2024, 1, 29), 7, date(2024, 1, 22))

#: Histories of events (L), their intervals (I) and grid cells (G).
EV = """
WITH obs AS (SELECT concat_ws('||', CAST(user_id AS VARCHAR), event_type) AS role_id, CAST(ts AS DATE) AS d,
                    max_by('k' || (CAST(json_extract_string(props, '$.k') AS INT) % {values}), (ts, event_id)) AS value
             FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-30' GROUP BY 1, 2),
o2 AS (SELECT role_id, d, value, lead(d) OVER w AS nx, lag(d) OVER w AS pv FROM obs WINDOW w AS (PARTITION BY role_id ORDER BY d)),
L AS (SELECT role_id, d AS ts, value, CAST(NULL AS VARCHAR) AS wc FROM o2
      UNION ALL SELECT role_id, d + 1, NULL, 'DE' FROM o2 WHERE (nx IS NULL OR nx > d + 1) AND d + 1 <= DATE '2024-01-30'
      UNION ALL SELECT role_id, DATE '2024-01-01', NULL, 'R' FROM o2 WHERE pv IS NULL AND d > DATE '2024-01-01'),
I AS (SELECT role_id, ts AS valid_from, coalesce(lead(ts) OVER (PARTITION BY role_id ORDER BY ts), DATE '2024-01-31') AS valid_to, value, wc FROM L),
G AS (SELECT role_id, CAST(unnest(generate_series(valid_from, valid_to - 1, INTERVAL 1 DAY)) AS DATE) AS d, value, wc FROM I),
S AS (SELECT role_id, ts, value, lag(value) OVER w AS prev, lag(ts) OVER w AS prev_ts FROM L WHERE wc IS NULL WINDOW w AS (PARTITION BY role_id ORDER BY ts)),
CH AS (SELECT DISTINCT role_id FROM S WHERE ts <= DATE '2024-01-21' AND prev <> value),
K AS (SELECT role_id, d, value FROM G WHERE wc IS NULL AND d <= DATE '2024-01-21' AND role_id IN (SELECT role_id FROM CH)),
IT AS (SELECT DISTINCT role_id, prev, value AS after FROM S WHERE prev IS NOT NULL),
PW AS (SELECT a.role_id AS id1, b.role_id AS id2, count(*) AS weight
       FROM G a JOIN G b ON a.d = b.d AND a.value = b.value AND a.role_id < b.role_id AND a.d <= DATE '2024-01-21' GROUP BY 1, 2 HAVING count(*) >= 4),
PP AS (SELECT id1, id2, greatest(a.valid_from, b.valid_from) AS f, least(a.valid_to, b.valid_to) AS t, a.value AS v1, a.wc AS w1, b.value AS v2, b.wc AS w2
       FROM PW JOIN I a ON a.role_id = id1 JOIN I b ON b.role_id = id2 AND a.valid_from < b.valid_to AND b.valid_from < a.valid_to),
PV AS (SELECT id1, id2, bool_and(w1 IS NOT NULL OR w2 IS NOT NULL OR v1 = v2) AS valid FROM PP GROUP BY ALL),
GG AS (SELECT id1, id2, a.d, a.value AS v1, a.wc AS w1, b.value AS v2, b.wc AS w2 FROM PW JOIN G a ON a.role_id = id1 JOIN G b ON b.role_id = id2 AND a.d = b.d)
"""
#: Histories of orders.
OR = """
WITH w AS (SELECT CAST(o_custkey AS VARCHAR) AS role_id, DATE '1995-01-01' + CAST(((CAST(o_orderdate AS DATE) - DATE '1995-01-01') // 7) * 7 AS INT) AS ts,
                  max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS value
           FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '2001-08-11' GROUP BY 1, 2),
k AS (SELECT role_id, ts, value FROM (SELECT *, lag(value) OVER (PARTITION BY role_id ORDER BY ts) AS p FROM w) WHERE p IS NULL OR p <> value),
L AS (SELECT role_id, ts, value, CAST(NULL AS VARCHAR) AS wc FROM k
      UNION ALL SELECT role_id, DATE '1995-01-01', NULL, 'R' FROM k GROUP BY role_id HAVING min(ts) > DATE '1995-01-01'),
S AS (SELECT role_id, ts, value, lag(value) OVER w AS prev, lag(ts) OVER w AS prev_ts FROM L WHERE wc IS NULL WINDOW w AS (PARTITION BY role_id ORDER BY ts))
"""
EV3, EV20 = EV.replace("{values}", "3"), EV.replace("{values}", "20")


def register(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def on_events(name: str, sql: str | None, f: Callable[[DataFrame], DataFrame], values: int = 3) -> None:
    """A query on event histories."""
    register(name, sql and (EV3 if values == 3 else EV20) + sql)(lambda spark, d: f(T.event_histories(spark, d, EVENTS, values)))


def on_orders(name: str, sql: str | None, f: Callable[[DataFrame], DataFrame]) -> None:
    register(name, sql and OR + sql)(lambda spark, d: f(T.order_histories(spark, d, ORDERS)))


def on_pairs(name: str, sql: str | None, f: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """A query on pairs of event histories that share a value on four days or more, and without SQL on all that share one on a day."""
    on_events(name, sql, lambda h: f(S.block_weights(h, EVENTS).where("weight >= 4"), h))
    on_events(f"{name}_all_pairs", None, lambda h: f(S.block_weights(h, EVENTS), h))


def on_histories(name: str, sql: str | None, f: Callable[[DataFrame, DataFrame], DataFrame], *swapped: tuple[str, str]) -> None:
    """on_pairs where f's rows depend on the two histories alone: made once for any two different ones. swapped: columns of the two sides."""
    weights = lambda h, least: S.block_weights(h, EVENTS, selves=True).where(F.col("weight") >= least)
    on_events(name, sql, lambda h: by_histories(h, lambda r: f(weights(r, 4), r), swapped))
    on_events(f"{name}_all_pairs", None, lambda h: by_histories(h, lambda r: f(weights(r, 1), r), swapped))


END = EVENTS.train_end
TXT = "CASE WHEN wc IS NOT NULL THEN '⊥' || wc ELSE coalesce(value, 'null') END"
r6 = lambda c: F.round(F.col(c), 6).alias(c)

# one history at a time
on_events("histories", "SELECT role_id, ts, value, wc FROM L", lambda h: h)
on_orders("order_histories", "SELECT role_id, ts, value, wc FROM L", lambda h: h)
on_events("valid_at", "SELECT role_id, value, wc FROM G WHERE d = DATE '2024-01-21'", lambda h: L.value_at(h, END))
on_orders("valid_at_orders", "SELECT role_id, max_by(value, ts) AS value, CASE WHEN max_by(coalesce(wc, ''), ts) = '' THEN NULL ELSE max_by(coalesce(wc, ''), ts) END AS wc FROM L WHERE ts <= DATE '1999-01-03' GROUP BY 1", lambda h: L.value_at(h, ORDERS.train_end))
on_events("project_range", "SELECT role_id, greatest(valid_from, DATE '2024-01-08') AS ts, value, wc FROM I WHERE valid_from <= DATE '2024-01-21' AND valid_to > DATE '2024-01-08'", lambda h: L.project(h, date(2024, 1, 8), END))
on_events("up_to", "SELECT role_id, ts, value, wc FROM L WHERE ts <= DATE '2024-01-15'", lambda h: L.up_to(h, date(2024, 1, 15)))
on_events("intervals", "SELECT role_id, valid_from, valid_to, value, wc FROM I", lambda h: L.intervals(h, date(2024, 1, 31)))
on_events("values_in_interval", "SELECT role_id, greatest(valid_from, DATE '2024-01-05') AS valid_from, least(valid_to, DATE '2024-01-11') AS valid_to, value, wc FROM I WHERE valid_from <= DATE '2024-01-10' AND valid_to > DATE '2024-01-05'", lambda h: L.values_in_interval(h, date(2024, 1, 5), date(2024, 1, 10)))
on_events("grid", "SELECT role_id, d, value, wc FROM G", lambda h: L.grid_cells(h, EVENTS))
on_events("exact_sequence", "SELECT role_id, string_agg(CASE WHEN wc IS NOT NULL THEN '⊥' ELSE value END, ';' ORDER BY d) AS seq FROM G WHERE d <= DATE '2024-01-21' GROUP BY 1", lambda h: L.exact_sequence(h, EVENTS, END))
on_events("value_sequence", f"SELECT role_id, string_agg(s, ';' ORDER BY ts) AS seq FROM (SELECT role_id, ts, {TXT} AS s, lag({TXT}) OVER (PARTITION BY role_id ORDER BY ts) AS p FROM L WHERE ts < DATE '2024-01-21') WHERE p IS NULL OR p <> s GROUP BY 1", lambda h: L.change_sequence(h, END))
on_events("value_sequence_known", "SELECT role_id, string_agg(value, ';' ORDER BY ts) AS seq FROM S WHERE ts < DATE '2024-01-21' AND (prev IS NULL OR prev <> value) GROUP BY 1", lambda h: L.change_sequence(h, END, wildcards=False))
on_events("value_set", "SELECT role_id, coalesce(string_agg(DISTINCT value, ';' ORDER BY value) FILTER (WHERE ts < DATE '2024-01-21' AND wc IS NULL), '') AS vals FROM L GROUP BY 1", lambda h: L.value_set(h, END))
on_events("density", "SELECT role_id, round(count(*) FILTER (WHERE wc IS NULL) / 21.0, 6) AS density FROM G WHERE d <= DATE '2024-01-21' GROUP BY 1", lambda h: L.density(h, EVENTS).select("role_id", r6("density")))
on_events("known_days", "SELECT role_id, CAST(count(*) FILTER (WHERE wc IS NULL) AS BIGINT) AS days FROM G WHERE d < DATE '2024-01-21' GROUP BY 1", lambda h: L.known_days(h, END))
on_events("value_days", "SELECT role_id, value, count(*) AS n FROM G WHERE wc IS NULL AND d <= DATE '2024-01-21' GROUP BY 1, 2", lambda h: L.value_days(h, EVENTS, END))
on_events("dedupe_histories", f"SELECT role_id, ts, value, wc FROM (SELECT *, {TXT} AS s, lag({TXT}) OVER (PARTITION BY role_id ORDER BY ts) AS p FROM L) WHERE p IS NULL OR p <> s", L.dedupe)
on_events("remove_decayed", f"SELECT role_id, ts, value, wc FROM (SELECT *, {TXT} AS s, lag({TXT}) OVER (PARTITION BY role_id ORDER BY ts) AS p FROM L WHERE wc IS NULL OR wc <> 'DE') WHERE p IS NULL OR p <> s", L.remove_decayed)
on_events("is_numeric", "SELECT role_id, bool_and(wc IS NOT NULL OR regexp_full_match(value, '[0-9]*')) AS is_numeric FROM L GROUP BY 1", L.is_numeric)
on_events("of_interest", "SELECT role_id, count(DISTINCT value) FILTER (WHERE ts < DATE '2024-01-21') AS n_train, count(DISTINCT value) FILTER (WHERE ts >= DATE '2024-01-21') AS n_test FROM L GROUP BY 1 HAVING n_train > 1 AND n_test >= 1", lambda h: L.of_interest(h, END))
on_events("transitions", "SELECT DISTINCT role_id, prev, value AS after FROM S WHERE prev <> value", L.transitions)
on_events("transitions_adjacent", "SELECT DISTINCT role_id, p AS prev, value AS after FROM (SELECT *, lag(value) OVER w AS p, lag(wc) OVER w AS pw, lag(ts) OVER w AS pt FROM L WINDOW w AS (PARTITION BY role_id ORDER BY ts)) WHERE pt IS NOT NULL AND wc IS NULL AND pw IS NULL", lambda h: L.transitions(h, include_same=True, ignore_interleaved=False))
on_events("informative_transitions", "SELECT role_id, prev, after FROM IT", L.informative_transitions)
TSET = """, X AS (SELECT *, lag(s) OVER w AS prev, lag(ts) OVER w AS pt, lead(ts) OVER w IS NULL AS last FROM (SELECT role_id, ts, value AS s FROM L WHERE wc IS NULL AND ts < DATE '2024-01-21') WINDOW w AS (PARTITION BY role_id ORDER BY ts)),
TS AS (SELECT role_id, prev, s AS after FROM X WHERE pt IS NOT NULL UNION SELECT role_id, prev, prev FROM X WHERE pt IS NOT NULL AND ts - pt > 1 UNION SELECT role_id, s, s FROM X WHERE pt IS NOT NULL AND last)
"""
on_events("transition_set", TSET + "SELECT role_id, prev, after FROM TS", lambda h: L.transition_set(h, 1, END))
on_events("transition_histogram", TSET + "SELECT prev, after, count(DISTINCT role_id) AS n FROM TS GROUP BY 1, 2", lambda h: L.transition_histogram(L.transition_set(h, 1, END)))
on_events("change_counts", f""", X AS (SELECT role_id, wc, value, {TXT} AS s, lag({TXT}) OVER w AS p, last_value(value IGNORE NULLS) OVER (PARTITION BY role_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM L WINDOW w AS (PARTITION BY role_id ORDER BY ts))
SELECT role_id, count(*) FILTER (WHERE wc IS NULL AND k <> value) AS least, count(*) FILTER (WHERE p IS NOT NULL AND (wc IS NOT NULL OR p <> s)) AS most FROM X GROUP BY 1""", L.change_counts)
on_events("nearest_known", "SELECT role_id, max_by(value, ts) FILTER (WHERE wc IS NULL AND ts <= DATE '2024-01-15') AS before, min_by(value, ts) FILTER (WHERE wc IS NULL AND ts >= DATE '2024-01-15') AS after FROM L GROUP BY 1", lambda h: L.nearest_known(h, date(2024, 1, 15)))
on_events("time_stretch", "SELECT role_id, DATE '2024-01-01' + CAST((ts - DATE '2024-01-01') * 3 AS INT) AS ts, value, wc FROM L", lambda h: L.stretch(h, EVENTS.start, 3))
on_events("append", "SELECT role_id, ts, value, wc FROM L", lambda h: L.append(h.where(F.col("ts") <= F.lit(END)), h.where(F.col("ts") > F.lit(END))))
on_events("short_string", f"SELECT role_id, '<' || string_agg(CAST(ts AS VARCHAR) || '-' || coalesce(CAST(nx - 1 AS VARCHAR), '?') || ':' || s, ',' ORDER BY ts) || '>' AS s FROM (SELECT role_id, ts, s, lead(ts) OVER (PARTITION BY role_id ORDER BY ts) AS nx FROM (SELECT role_id, ts, {TXT} AS s, lag({TXT}) OVER (PARTITION BY role_id ORDER BY ts) AS p FROM L) WHERE p IS NULL OR p <> s) GROUP BY 1", L.short_string)
on_events("summary", "SELECT role_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_entries, count(*) FILTER (WHERE wc IS NULL) AS n_known FROM L GROUP BY 1", L.summary)
DECAY = """, N AS (SELECT *, lead(ts) OVER (PARTITION BY role_id ORDER BY ts) AS nx FROM L),
D AS (SELECT role_id, list_sort(list(nx - ts) FILTER (WHERE nx <= {T})) AS ds FROM N GROUP BY 1),
U AS (SELECT role_id, CASE WHEN len(ds) > 0 THEN CASE WHEN ceil(len(ds) * {p}) < 1 THEN {g} ELSE ds[CAST(ceil(len(ds) * {p}) AS INT)] END END AS cut FROM D)
SELECT role_id, ts, value, wc FROM L UNION ALL
SELECT N.role_id, N.ts + CAST(cut AS INT), NULL, 'DE' FROM N JOIN U USING (role_id) WHERE wc IS NULL AND coalesce(nx, {E}) - ts > cut
"""
on_orders("decay", DECAY.format(T="DATE '1999-01-03'", E="DATE '2001-08-05'", p="CAST(0.57 AS DOUBLE)", g=7), lambda h: L.decay(h, 0.57, ORDERS))
on_events("decay_events", DECAY.format(T="DATE '2024-01-21'", E="DATE '2024-01-30'", p="CAST(0.5 AS DOUBLE)", g=1), lambda h: L.decay(h, 0.5, EVENTS))
on_orders("irregular_roles", """, X AS (SELECT role_id, wc, CASE WHEN row_number() OVER w > 2 THEN ts - lag(ts) OVER w END AS gap FROM L WINDOW w AS (PARTITION BY role_id ORDER BY ts))
SELECT role_id, count(*) AS size, count(*) FILTER (WHERE wc IS NULL) AS n_known, round(avg(gap), 6) AS mean_gap, round(stddev_pop(gap), 6) AS sd_gap FROM X GROUP BY 1 HAVING count(*) > 4 AND count(*) FILTER (WHERE wc IS NULL) > 2 AND stddev_pop(gap) > 0.5 * avg(gap)""", lambda h: L.irregular_roles(h, 4, 2, 0.5).withColumns({c: F.round(c, 6) for c in ("mean_gap", "sd_gap")}))
on_events("roleset_stats", ", X AS (SELECT role_id, count(DISTINCT value) AS n FROM L WHERE ts <= DATE '2024-01-30' GROUP BY 1), Y AS (SELECT role_id, count(*) FILTER (WHERE wc IS NULL) / 21.0 AS density FROM G WHERE d <= DATE '2024-01-21' GROUP BY 1) SELECT count(*) AS n_roles, count(*) * (count(*) + 1) // 2 AS n_pairs, round(avg(n), 6) AS avg_values, round(stddev_pop(n), 6) AS sd_values, round(avg(density), 6) AS avg_density, round(stddev_pop(density), 6) AS sd_density FROM X JOIN Y USING (role_id)", lambda h: L.roleset_stats(h, EVENTS).select("n_roles", "n_pairs", *[r6(c) for c in ("avg_values", "sd_values", "avg_density", "sd_density")]))
on_events("value_distribution", "SELECT value, n, CAST(sum(n) OVER (ORDER BY n DESC, value ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM (SELECT value, count(*) AS n FROM L WHERE wc IS NULL GROUP BY 1)", L.value_distribution, values=20)
on_events("id_parts", "SELECT DISTINCT role_id, split_part(role_id, '||', 1) AS template, split_part(role_id, '||', 2) AS page FROM L", lambda h: h.select("role_id", V.id_part(F.col("role_id"), "template").alias("template"), V.id_part(F.col("role_id"), "page").alias("page")).distinct())


# blocking
KEYS = {
    "em": f"SELECT role_id, string_agg(CAST(ts AS VARCHAR) || '=' || {TXT}, ';' ORDER BY ts) AS key FROM L WHERE ts < DATE '2024-01-21' GROUP BY 1",
    "cqm": f"SELECT role_id, string_agg(s, ';' ORDER BY ts) AS key FROM (SELECT role_id, ts, {TXT} AS s, lag({TXT}) OVER (PARTITION BY role_id ORDER BY ts) AS p FROM L WHERE ts < DATE '2024-01-21') WHERE p IS NULL OR p <> s GROUP BY 1",
    "vsm": "SELECT role_id, coalesce(string_agg(DISTINCT value, ';' ORDER BY value) FILTER (WHERE ts < DATE '2024-01-21' AND wc IS NULL), '') AS key FROM L GROUP BY 1",
    "tsm": "SELECT role_id, coalesce(string_agg(DISTINCT prev || '>' || after, ';' ORDER BY prev || '>' || after), '') AS key FROM (SELECT DISTINCT role_id FROM L) LEFT JOIN TS USING (role_id) GROUP BY 1",
}
for _m, _sql in KEYS.items():
    on_events(f"block_{_m}", f"{TSET}, Z AS ({_sql}) SELECT a.role_id AS id1, b.role_id AS id2 FROM Z a JOIN Z b ON a.key = b.key AND a.role_id < b.role_id", lambda h, m=_m: B.block_pairs(B.keys(h, EVENTS)[m]))
on_events("block_counts", TSET + ", " + ", ".join(f"Z{m} AS (SELECT key, count(*) AS n FROM ({s}) GROUP BY 1)" for m, s in KEYS.items()) + " UNION ALL ".join(f" SELECT '{m}' AS method, count(*) AS n_groups, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS n_pairs FROM Z{m}" for m in KEYS), lambda h: B.block_counts(h, EVENTS))
on_events("block_set_domain", "SELECT role_id, string_agg(t, ';' ORDER BY t) AS tokens FROM (SELECT role_id, coalesce(value, '⊥C') || '_' || (d - DATE '1970-01-01') AS t FROM G WHERE d <= DATE '2024-01-21') GROUP BY 1", lambda h: B.set_domain(h, EVENTS).select("role_id", F.array_join("tokens", ";").alias("tokens")))
on_events("block_overlap_domain", "SELECT role_id, count(*) AS n, count(*) FILTER (WHERE wc IS NULL) AS n_known FROM (SELECT * FROM G WHERE d <= DATE '2024-01-21' UNION ALL SELECT * FROM G WHERE d <= DATE '2024-01-21') GROUP BY 1", lambda h: B.overlap_domain(h, EVENTS, query=True).select("role_id", F.size("tokens").cast("bigint").alias("n"), (2 * F.size(F.filter("tokens", lambda t: t.startswith("=")))).cast("bigint").alias("n_known")))
COMPAT = "SELECT a.role_id AS id1, b.role_id AS id2, count(*) AS n_shared FROM K a JOIN K b ON a.d = b.d AND a.role_id < b.role_id GROUP BY 1, 2 HAVING bool_and(a.value = b.value)"
on_events("compatible_pairs", COMPAT, lambda h: C.compatible_pairs(h, EVENTS))
on_events("compatible_pairs_3", COMPAT + " AND count(*) >= 3", lambda h: C.compatible_pairs(h, EVENTS, 3), values=20)
on_events("compatible_pairs_transition", f", A AS ({COMPAT}), U AS (SELECT DISTINCT role_id, prev, value AS after FROM S WHERE prev IS NOT NULL AND ts <= DATE '2024-01-21') SELECT id1, id2, n_shared FROM A WHERE EXISTS (SELECT 1 FROM U a JOIN U b ON a.prev = b.prev AND a.after = b.after WHERE a.role_id = id1 AND b.role_id = id2)", lambda h: C.compatible_with_transition(h, EVENTS))
on_events("compatible_any", ", A AS (SELECT a.role_id AS id1, b.role_id AS id2 FROM CH a JOIN CH b ON a.role_id < b.role_id) SELECT id1, id2 FROM A WHERE NOT EXISTS (SELECT 1 FROM K x JOIN K y ON x.d = y.d AND x.value <> y.value WHERE x.role_id = id1 AND y.role_id = id2)", lambda h: C.compatible_any(h, EVENTS))
ANY = ", A AS (SELECT a.role_id AS id1, b.role_id AS id2 FROM CH a JOIN CH b ON a.role_id < b.role_id) SELECT id1, id2 FROM A WHERE {which} NOT EXISTS (SELECT 1 FROM K x JOIN K y ON x.d = y.d AND x.value <> y.value WHERE x.role_id = id1 AND y.role_id = id2)"
on_events("split_recursion", ANY.format(which=""), lambda h: ST.compatible_by_splits(h, EVENTS, leaf_pairs=50), values=20)
on_events("split_recursion_two_lists", ANY.format(which="(substr(md5(id1), 1, 1) < '8') <> (substr(md5(id2), 1, 1) < '8') AND"), lambda h: ST.compatible_by_splits(h, EVENTS, F.substring(F.md5(F.col("role_id").cast("binary")), 1, 1) < "8", leaf_pairs=50), values=20)
on_events("relevant_dates", "SELECT DISTINCT ts AS d FROM L WHERE ts <= DATE '2024-01-21' AND ts <> DATE '2024-01-01'", lambda h: ST.relevant_dates(h, END, (EVENTS.start,)))
on_events("split_cost", "SELECT d, CAST(sum(n) FILTER (WHERE wc IS NOT NULL) AS BIGINT) AS n_wc, CAST(sum(n) FILTER (WHERE wc IS NULL) AS BIGINT) AS n_known, CAST(sum(n) FILTER (WHERE wc IS NOT NULL) * sum(n) + sum(n * n) FILTER (WHERE wc IS NULL) AS BIGINT) AS cost FROM (SELECT d, value, wc, count(*) AS n FROM G WHERE d <= DATE '2024-01-21' GROUP BY 1, 2, 3) GROUP BY 1", lambda h: C.split_cost(h, EVENTS))
HALF = "(CAST(substr(md5(role_id), 1, 1) AS VARCHAR) < '8')"
on_events("split_cost_two_lists", f", A AS (SELECT d, wc IS NOT NULL AS u, value, count(*) FILTER (WHERE {HALF}) AS l, count(*) FILTER (WHERE NOT {HALF}) AS r FROM G WHERE d <= DATE '2024-01-21' GROUP BY 1, 2, 3) SELECT d, CAST(coalesce(sum(l * r) FILTER (WHERE NOT u), 0) + coalesce(sum(l) FILTER (WHERE u), 0) * coalesce(sum(r) FILTER (WHERE NOT u), 0) + coalesce(sum(r) FILTER (WHERE u), 0) * coalesce(sum(l) FILTER (WHERE NOT u), 0) + coalesce(sum(l) FILTER (WHERE u), 0) * coalesce(sum(r) FILTER (WHERE u), 0) AS BIGINT) AS cost FROM A GROUP BY 1", lambda h: C.split_cost_two_lists(h.where(F.substring(F.md5(F.col("role_id").cast("binary")), 1, 1) < "8"), h.where(F.substring(F.md5(F.col("role_id").cast("binary")), 1, 1) >= "8"), EVENTS))
on_events("split_groups", "SELECT CASE WHEN wc IS NOT NULL THEN '⊥' ELSE '=' || value END AS group_id, string_agg(role_id, ';' ORDER BY role_id) AS members, count(*) AS n FROM G WHERE d = DATE '2024-01-11' GROUP BY 1", lambda h: C.groups_at_split(h, date(2024, 1, 11)).select("group_id", F.array_join("members", ";").alias("members"), "n"))
on_events("group_expand", f"{TSET}, Z AS ({KEYS['cqm']}) SELECT a.role_id AS id1, b.role_id AS id2 FROM Z a JOIN Z b ON a.key = b.key AND a.role_id < b.role_id", lambda h: C.expand_groups(B.cqm_key(h, END).groupBy("key").agg(F.array_sort(F.collect_list("role_id")).alias("members")).select("members", F.lit(None).cast("array<string>").alias("left_ids"), F.lit(None).cast("array<string>").alias("right_ids"))))

# pairs
CP = """, CP AS (SELECT *, row_number() OVER (PARTITION BY id1, id2 ORDER BY f) AS i, lag(v1) OVER w AS pv1, lag(w1) OVER w AS pw1, lag(v2) OVER w AS pv2, lag(w2) OVER w AS pw2, lag(f) OVER w AS pf, lead(f) OVER w IS NULL AS last FROM PP WINDOW w AS (PARTITION BY id1, id2 ORDER BY f))
"""
on_histories("change_points", CP + "SELECT id1, id2, f AS ts, pv1 AS prev1, pw1 AS prev_w1, pv2 AS prev2, pw2 AS prev_w2, v1 AS cur1, w1 AS cur_w1, v2 AS cur2, w2 AS cur_w2, pf AS prev_ts, last AS is_last FROM CP WHERE i > 1", P.change_points, ("prev1", "prev2"), ("prev_w1", "prev_w2"), ("cur1", "cur2"), ("cur_w1", "cur_w2"))
on_pairs("stays_valid", "SELECT id1, id2, valid FROM PV", P.stays_valid)
WORDY = "CASE {v} WHEN 'k0' THEN 'a' WHEN 'k1' THEN 'a b' ELSE 'c a' END"
W1, W2 = WORDY.format(v="v1"), WORDY.format(v="v2")
on_histories("containment", f"SELECT id1, id2, bool_and(w1 IS NOT NULL OR w2 IS NOT NULL OR list_has_all(string_split({W1}, ' '), string_split({W2}, ' ')) OR list_has_all(string_split({W2}, ' '), string_split({W1}, ' '))) AS valid FROM PP GROUP BY 1, 2", lambda p, h: P.stays_valid(p, h.withColumn("value", F.when(F.col("wc").isNull(), F.expr(WORDY.format(v="value")))), containment=True))
on_pairs("merge_pair", ", M AS (SELECT id1, id2, f AS ts, CASE WHEN w1 IS NOT NULL THEN v2 ELSE v1 END AS value, CASE WHEN w1 IS NOT NULL THEN w2 END AS wc FROM PP JOIN PV USING (id1, id2) WHERE valid) SELECT id1, id2, ts, value, wc FROM (SELECT *, lag(coalesce(value, '') || '/' || coalesce(wc, '')) OVER (PARTITION BY id1, id2 ORDER BY ts) AS p FROM M) WHERE p IS NULL OR p <> coalesce(value, '') || '/' || coalesce(wc, '')", P.merge)
ECH = """, C AS (SELECT role_id, ts, value, pw, pt, k FROM (SELECT *, lag(wc) OVER w AS pw, lag(ts) OVER w AS pt, lag(value) OVER w AS p, last_value(value IGNORE NULLS) OVER (PARTITION BY role_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM L WINDOW w AS (PARTITION BY role_id ORDER BY ts)) WHERE pt IS NOT NULL AND wc IS NULL),
E AS (SELECT id1, id2, a.ts, a.value AS c1, b.value AS c2, a.pw AS pw1, b.pw AS pw2, a.k AS k1, b.k AS k2 FROM PW JOIN C a ON a.role_id = id1 JOIN C b ON b.role_id = id2 AND a.ts = b.ts)
"""
on_pairs("evidence", ECH + "SELECT id1, id2, CAST(CASE WHEN valid THEN coalesce(n, 0) ELSE -1 END AS BIGINT) AS evidence FROM PV LEFT JOIN (SELECT id1, id2, count(*) AS n FROM E WHERE pw1 IS NULL AND pw2 IS NULL GROUP BY 1, 2) USING (id1, id2)", P.evidence)
on_pairs("evidence_interleaved", ECH + "SELECT id1, id2, CAST(CASE WHEN valid THEN coalesce(n, 0) ELSE -1 END AS BIGINT) AS evidence FROM PV LEFT JOIN (SELECT id1, id2, count(*) AS n FROM E WHERE k1 = k2 AND c1 <> k1 GROUP BY 1, 2) USING (id1, id2)", lambda p, h: P.evidence(p, h, interleaved=True))
on_pairs("evidence_multiset", ECH + "SELECT id1, id2, k1 AS prev, c1 AS after, count(*) AS n FROM E JOIN PV USING (id1, id2) WHERE valid AND pw1 IS NULL AND pw2 IS NULL GROUP BY ALL", P.evidence_multiset)
on_histories("compatibility_share", "SELECT id1, id2, round(count(*) FILTER (WHERE w1 IS NOT NULL OR w2 IS NOT NULL OR v1 = v2) / 20.0, 6) AS share FROM GG WHERE d < DATE '2024-01-21' GROUP BY 1, 2", lambda p, h: P.compatibility_share(p, h, EVENTS).select("id1", "id2", r6("share")))
on_histories("distinct_agreements", CP + "SELECT id1, id2, count(DISTINCT v1) FILTER (WHERE i > 1 AND w1 IS NULL AND w2 IS NULL AND v1 = v2) AS dva_count FROM CP GROUP BY 1, 2", P.distinct_agreements)
on_pairs("phase_evidence", CP + "SELECT id1, id2, count(*) FILTER (WHERE i > 1 AND w1 IS NULL AND w2 IS NULL AND f < DATE '2024-01-21') AS train_evidence, count(*) FILTER (WHERE i > 1 AND w1 IS NULL AND w2 IS NULL AND f > DATE '2024-01-21') AS test_evidence FROM CP GROUP BY 1, 2", lambda p, h: P.phase_evidence(p, h, EVENTS))
on_events("first_real_change", ", B AS (SELECT role_id, max_by(value, ts) AS k FROM L WHERE wc IS NULL AND ts <= DATE '2024-01-21' GROUP BY 1) SELECT role_id, min(ts) FILTER (WHERE ts >= DATE '2024-01-21' AND wc IS NULL AND value <> k) AS change_ts FROM L LEFT JOIN B USING (role_id) GROUP BY 1", lambda h: P.first_real_change(h, END))
FIRST = ", A AS (SELECT role_id, min_by(value, ts) FILTER (WHERE ts >= DATE '2024-01-21' AND wc IS NULL) AS x, list((CAST(ts AS VARCHAR) || value) ORDER BY ts) FILTER (WHERE ts >= DATE '2024-01-21' AND wc IS NULL) AS xs FROM L GROUP BY 1) "
on_pairs("first_value_agrees", FIRST + "SELECT id1, id2, a.x IS NOT DISTINCT FROM b.x AS valid FROM PW JOIN A a ON a.role_id = id1 JOIN A b ON b.role_id = id2", lambda p, h: P.first_value_agrees(p, h, END))
on_pairs("super_strict", FIRST + "SELECT id1, id2, a.xs IS NOT DISTINCT FROM b.xs AS valid FROM PW JOIN A a ON a.role_id = id1 JOIN A b ON b.role_id = id2", lambda p, h: P.super_strict(p, h, END))
on_pairs("first_shared_value", "SELECT id1, id2, min(f) AS ts, min_by(v1, f) AS value FROM PP WHERE w1 IS NULL AND w2 IS NULL AND v1 = v2 GROUP BY 1, 2", P.first_shared_value)
on_events("token_similarity", ", A AS (SELECT DISTINCT role_id, value FROM L WHERE wc IS NULL), N AS (SELECT value, count(*) AS n FROM A GROUP BY 1 HAVING count(*) > 1) SELECT a.role_id AS id1, b.role_id AS id2, round(sum(1 / log2(n * n) + 1), 6) AS similarity FROM A a JOIN A b ON a.value = b.value AND a.role_id < b.role_id JOIN N ON N.value = a.value GROUP BY 1, 2", lambda h: P.token_similarity(h).select("id1", "id2", r6("similarity")))
STATS = CP + TSET + "".join(f", Z{m} AS ({s})" for m, s in KEYS.items()) + """,
NR AS (SELECT role_id, d, value, wc, last_value(value IGNORE NULLS) OVER (PARTITION BY role_id ORDER BY d) AS b, first_value(value IGNORE NULLS) OVER (PARTITION BY role_id ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM G),
BASE AS (SELECT role_id, ts AS valid_from, coalesce(lead(ts) OVER (PARTITION BY role_id ORDER BY ts), DATE '2024-01-31') AS valid_to, value, wc FROM L WHERE wc IS NULL OR wc <> 'DE'),
XG AS (SELECT role_id, CAST(unnest(generate_series(valid_from, valid_to - 1, INTERVAL 1 DAY)) AS DATE) AS d, value, wc FROM BASE),
Q AS (SELECT id1, id2, x.d, x.value AS v1, x.wc AS w1, y.value AS v2, y.wc AS w2, x.b AS b1, x.a AS a1, y.b AS b2, y.a AS a2, (p.value IS NOT DISTINCT FROM q.value AND p.wc IS NOT DISTINCT FROM q.wc) AS ex
      FROM PW JOIN NR x ON x.role_id = id1 JOIN NR y ON y.role_id = id2 AND x.d = y.d JOIN XG p ON p.role_id = id1 AND p.d = x.d JOIN XG q ON q.role_id = id2 AND q.d = x.d),
Q2 AS (SELECT *, (w1 IS NOT NULL OR w2 IS NOT NULL OR v1 = v2) AS c, CASE WHEN w1 IS NOT NULL AND w2 IS NOT NULL THEN true WHEN w1 IS NOT NULL THEN coalesce(b1 = v2, false) OR coalesce(a1 = v2, false) WHEN w2 IS NOT NULL THEN coalesce(b2 = v1, false) OR coalesce(a2 = v1, false) ELSE v1 = v2 END AS st FROM Q),
AG AS (SELECT id1, id2, round(count(*) FILTER (WHERE d < DATE '2024-01-21' AND c) / 20.0, 6) AS compatibility_share, round(count(*) FILTER (WHERE d < DATE '2024-01-21' AND st) / 20.0, 6) AS strict_share, bool_and(c) FILTER (WHERE d <= DATE '2024-01-21') AS in_strict_blocking,
       round(count(*) FILTER (WHERE d <= DATE '2024-01-21' AND ex) / 21.0, 6) AS exact_match_share, count(*) FILTER (WHERE d <= DATE '2024-01-21' AND ex) AS va_count, coalesce(bool_or(w1 IS NULL AND w2 IS NULL AND v1 = v2) FILTER (WHERE d <= DATE '2024-01-21'), false) AS in_sva_blocking, bool_or((w1 IS NULL) <> (w2 IS NULL)) AS has_non_overlap FROM Q2 GROUP BY 1, 2)
SELECT AG.*, (SELECT count(DISTINCT v1) FROM CP WHERE CP.id1 = AG.id1 AND CP.id2 = AG.id2 AND i > 1 AND w1 IS NULL AND w2 IS NULL AND v1 = v2) AS dva_count,
       coalesce(e1.key = e2.key, false) AS in_em_blocking, coalesce(c1.key = c2.key, false) AS in_cqm_blocking, coalesce(v1.key = v2.key, false) AS in_vsm_blocking, coalesce(t1.key = t2.key, false) AS in_tsm_blocking,
       EXISTS (SELECT 1 FROM IT a JOIN IT b ON a.prev = b.prev AND a.after = b.after WHERE a.role_id = AG.id1 AND b.role_id = AG.id2) AS has_transition_overlap
FROM AG LEFT JOIN Zem e1 ON e1.role_id = id1 LEFT JOIN Zem e2 ON e2.role_id = id2 LEFT JOIN Zcqm c1 ON c1.role_id = id1 LEFT JOIN Zcqm c2 ON c2.role_id = id2
     LEFT JOIN Zvsm v1 ON v1.role_id = id1 LEFT JOIN Zvsm v2 ON v2.role_id = id2 LEFT JOIN Ztsm t1 ON t1.role_id = id1 LEFT JOIN Ztsm t2 ON t2.role_id = id2
"""
on_pairs("pair_stats", STATS, lambda p, h: P.pair_stats(p, h, EVENTS, with_decay_score=False).drop("dataset", "in_tsm_wildcard_blocking").withColumns({c: F.round(c, 6) for c in ("compatibility_share", "strict_share", "exact_match_share")}))
on_histories("class_label", ", B AS (SELECT role_id, max_by(value, ts) AS k FROM L WHERE wc IS NULL AND ts <= DATE '2024-01-21' GROUP BY 1), R AS (SELECT DISTINCT role_id FROM L JOIN B USING (role_id) WHERE ts >= DATE '2024-01-21' AND wc IS NULL AND value <> k), BASE AS (SELECT role_id, ts AS valid_from, coalesce(lead(ts) OVER (PARTITION BY role_id ORDER BY ts), DATE '2024-01-31') AS valid_to, value, wc FROM L WHERE wc IS NULL OR wc <> 'DE'), XG AS (SELECT role_id, CAST(unnest(generate_series(valid_from, valid_to - 1, INTERVAL 1 DAY)) AS DATE) AS d, value, wc FROM BASE), M AS (SELECT id1, id2, bool_and(a.value IS NOT DISTINCT FROM b.value AND a.wc IS NOT DISTINCT FROM b.wc) AS same FROM PW JOIN XG a ON a.role_id = id1 JOIN XG b ON b.role_id = id2 AND a.d = b.d WHERE a.d > DATE '2024-01-21' GROUP BY 1, 2) SELECT id1, id2, CAST(coalesce(CASE WHEN id1 IN (SELECT role_id FROM R) OR id2 IN (SELECT role_id FROM R) THEN CAST(same AS INT) END, -1) AS INT) AS label FROM PW LEFT JOIN M USING (id1, id2)", lambda p, h: P.class_label(p, h, EVENTS).withColumn("label", F.coalesce(F.col("label").cast("int"), F.lit(-1))))
DS = """, RW AS (SELECT role_id, ts, value, wc, lead(ts) OVER (PARTITION BY role_id ORDER BY ts) AS nx FROM L),
DU AS (SELECT role_id, coalesce(list_sort(list(nx - ts) FILTER (WHERE nx <= DATE '2024-01-21')), []) AS ds FROM RW GROUP BY 1),
TH AS (SELECT round(1 - i * CAST(0.005 AS DOUBLE), 6) AS theta FROM range(0, 201) x(i)),
CU AS (SELECT role_id, theta, CASE WHEN theta >= 1 OR len(ds) = 0 THEN 100000 WHEN ceil(len(ds) * theta) < 1 THEN 1 ELSE ds[CAST(ceil(len(ds) * theta) AS INT)] END AS cut FROM DU, TH),
KN AS (SELECT role_id, ts AS f, coalesce(nx, DATE '2024-01-30') AS t, value FROM RW WHERE wc IS NULL),
CL AS (SELECT id1, id2, a.f AS fa, a.t AS ta, b.f AS fb, b.t AS tb FROM PW JOIN KN a ON a.role_id = id1 JOIN KN b ON b.role_id = id2 AND a.f < b.t AND b.f < a.t AND a.value IS DISTINCT FROM b.value),
OK AS (SELECT id1, id2, x.theta FROM CL JOIN CU x ON x.role_id = id1 JOIN CU y ON y.role_id = id2 AND y.theta = x.theta GROUP BY ALL
       HAVING bool_and(fa + CAST(least(ta - fa, x.cut) AS INT) <= fb OR fb + CAST(least(tb - fb, y.cut) AS INT) <= fa)),
BE AS (SELECT id1, id2, max(theta) AS best FROM OK GROUP BY 1, 2)
SELECT PW.id1, PW.id2, CASE WHEN BE.best IS NOT NULL THEN BE.best WHEN EXISTS (SELECT 1 FROM CL WHERE CL.id1 = PW.id1 AND CL.id2 = PW.id2) THEN -1 ELSE 1 END AS decay_score
FROM PW LEFT JOIN BE ON BE.id1 = PW.id1 AND BE.id2 = PW.id2"""
on_histories("decay_score", DS, lambda p, h: P.decay_score(p, h, EVENTS))

on_pairs("lineage_count", "SELECT count(*) AS n FROM PW", lambda p, h: R.lineage_count(p))
on_pairs("gold_ids", "SELECT id1 AS role_id FROM PW UNION SELECT id2 FROM PW", lambda p, h: R.gold_ids(p, p))
on_pairs("event_table", f"SELECT id1, id2, f AS ts, CASE WHEN w1 IS NOT NULL THEN '⊥' || w1 ELSE v1 END || ' | ' || CASE WHEN w2 IS NOT NULL THEN '⊥' || w2 ELSE v2 END || CASE WHEN w1 IS NOT NULL OR w2 IS NOT NULL OR v1 = v2 THEN '' ELSE ' (!)' END AS event FROM PP", R.event_table)
on_histories("drawable_pairs", ECH + ", NC AS (SELECT id1, id2, count(*) AS n_common FROM PW JOIN (SELECT role_id, ts, lag(ts) OVER (PARTITION BY role_id ORDER BY ts) AS p FROM L) a ON a.role_id = id1 JOIN (SELECT role_id, ts, lag(ts) OVER (PARTITION BY role_id ORDER BY ts) AS p FROM L) b ON b.role_id = id2 AND a.ts = b.ts WHERE a.p IS NOT NULL AND b.p IS NOT NULL GROUP BY 1, 2) SELECT id1, id2, CAST(n AS BIGINT) AS evidence, n_common FROM PV JOIN (SELECT id1, id2, count(*) AS n FROM E WHERE pw1 IS NULL AND pw2 IS NULL GROUP BY 1, 2) USING (id1, id2) JOIN NC USING (id1, id2) WHERE valid AND n > 1 AND n_common > 1", R.drawable)

# sampling, export, stress
on_events("timestamp_blocks", "SELECT d, value, n, n * (n - 1) // 2 AS n_pairs, CAST(sum(n * (n - 1) // 2) OVER (ORDER BY d, value) AS BIGINT) AS cum_pairs FROM (SELECT d, value, count(*) AS n FROM G WHERE wc IS NULL AND d <= DATE '2024-01-21' GROUP BY 1, 2 HAVING count(*) > 1)", lambda h: S.timestamp_blocks(h, EVENTS), values=20)
on_pairs("block_weights", "SELECT id1, id2, weight FROM PW", lambda p, h: p)
HASH = "md5(id1 || '|' || id2 || '|13')"
on_pairs("weighted_sample", f"SELECT id1, id2, weight FROM PW ORDER BY -ln((CAST('0x' || substr({HASH}, 1, 13) AS BIGINT) + 1.0) / 4503599627370497.0) / weight, id1, id2 LIMIT 200", lambda p, h: S.weighted_sample(p, 200))
on_pairs("stratified_sample", f", A AS (SELECT id1, id2, round(count(*) FILTER (WHERE w1 IS NOT NULL OR w2 IS NOT NULL OR v1 = v2) / 20.0, 6) AS share FROM GG WHERE d < DATE '2024-01-21' GROUP BY 1, 2), B AS (SELECT *, CASE WHEN share < 0.7 THEN '[0,0.7)' WHEN share < 1 THEN '[0.7,1)' ELSE '1.0' END AS stratum FROM A) SELECT id1, id2, share, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {HASH}, id1, id2) AS i FROM B) WHERE i <= 100", lambda p, h: S.stratified_sample(P.compatibility_share(p, h, EVENTS).select("id1", "id2", r6("share"))))
on_pairs("train_split", f"SELECT id1, id2, CASE WHEN u < 0.6 THEN 'train' WHEN u < 0.8 THEN 'dev' ELSE 'test' END AS split FROM (SELECT id1, id2, CAST('0x' || substr({HASH}, 1, 8) AS BIGINT) / 4294967296.0 AS u FROM PW)", lambda p, h: S.split(p.select("id1", "id2")))
on_events("agreeing_pairs", CP + ", A AS (SELECT id1, id2, count(DISTINCT v1) FILTER (WHERE i > 1 AND w1 IS NULL AND w2 IS NULL AND v1 = v2) AS dva_count FROM CP GROUP BY 1, 2) SELECT id1, id2, weight AS va_count, dva_count FROM PW JOIN A USING (id1, id2) WHERE dva_count >= 2", lambda h: S.agreeing_pairs(h, EVENTS, 4, 2))
FT = ", A AS (SELECT role_id, ts, CAST(coalesce(lead(ts) OVER (PARTITION BY role_id ORDER BY ts), DATE '2024-01-30') - ts AS VARCHAR) AS n, " + TXT + " AS s, row_number() OVER (PARTITION BY role_id ORDER BY ts) AS i FROM L) "
on_events("feature_table", FT + "SELECT role_id, string_agg(CAST(ts AS VARCHAR) || '|' || s || '|' || n, '|' ORDER BY i) || repeat('|', 3 * (10 - CAST(count(*) AS INT))) AS features FROM A WHERE i <= 10 GROUP BY 1", lambda h: S.feature_table(h, EVENTS, 10).select("role_id", F.array_join("features", "|").alias("features")))
on_events("feature_table_50", None, lambda h: S.feature_table(h, EVENTS).select("role_id", F.array_join("features", "|").alias("features")))
on_events("ml_record", FT + "SELECT role_id, string_agg('COL ' || CAST(ts AS VARCHAR) || ' VAL ' || s || ' COL D' || (i - 1) || ' VAL ' || n, ' ' ORDER BY i) AS record FROM A WHERE i <= 50 GROUP BY 1", lambda h: S.ml_record(h, EVENTS))
on_events("missing_changes", f""", A AS (SELECT *, wc IS NULL AND ts < DATE '2024-01-21' AS hit FROM L), B AS (SELECT *, row_number() OVER (PARTITION BY role_id, hit ORDER BY md5(role_id || '|' || CAST(ts AS VARCHAR) || '|13')) AS i, count(*) FILTER (WHERE hit) OVER (PARTITION BY role_id) AS n FROM A),
D AS (SELECT role_id, ts, CASE WHEN hit AND i <= floor(n * 0.3) THEN NULL ELSE value END AS value, CASE WHEN hit AND i <= floor(n * 0.3) THEN 'DE' ELSE wc END AS wc FROM B)
SELECT role_id, ts, value, wc FROM (SELECT *, {TXT} AS s, lag({TXT}) OVER (PARTITION BY role_id ORDER BY ts) AS p FROM D) WHERE p IS NULL OR p <> s""", lambda h: S.inject_missing_changes(h, 0.3, END))
MD = f""", I AS (SELECT role_id, ts, coalesce(lead(ts) OVER (PARTITION BY role_id ORDER BY ts), DATE '2001-08-12') AS e, value, wc FROM L),
G AS (SELECT role_id, ts, CAST(unnest(generate_series(ts, e - 1, INTERVAL 7 DAY)) AS DATE) AS d, value, wc FROM I),
A AS (SELECT *, wc IS NULL AND d <> ts AND d <= DATE '1999-01-03' AS free FROM G WHERE d <= DATE '2001-08-05'),
B AS (SELECT *, row_number() OVER (PARTITION BY role_id, free ORDER BY md5(role_id || '|' || CAST(d AS VARCHAR) || '|13')) AS i,
             floor(count(*) FILTER (WHERE d <= DATE '1999-01-03') OVER (PARTITION BY role_id) * CAST(0.3 AS DOUBLE)) - count(*) FILTER (WHERE wc IS NOT NULL AND d <= DATE '1999-01-03') OVER (PARTITION BY role_id) AS n FROM A),
D AS (SELECT role_id, d AS ts, CASE WHEN free AND i <= n THEN NULL ELSE value END AS value, CASE WHEN free AND i <= n THEN 'DE' ELSE wc END AS wc FROM B)
SELECT role_id, ts, value, wc FROM (SELECT *, {TXT} AS s, lag({TXT}) OVER (PARTITION BY role_id ORDER BY ts) AS p FROM D) WHERE p IS NULL OR p <> s"""
on_orders("missing_days", MD, lambda h: S.inject_missing_days(h, ORDERS, 0.3))
on_events("subsample", "SELECT role_id, ts, value, wc FROM L WHERE role_id IN (SELECT role_id FROM (SELECT DISTINCT role_id FROM L) ORDER BY md5(role_id || '|12'), role_id LIMIT (SELECT CAST(floor(count(DISTINCT role_id) * 0.5) AS INT) FROM L))", lambda h: S.subsample_roles(h, 0.5))
SY = """, RO AS (SELECT role_id, row_number() OVER (ORDER BY md5(role_id || '|12'), role_id) - 1 AS r, count(*) OVER () AS m FROM (SELECT DISTINCT role_id FROM L)),
CO AS (SELECT RO.role_id || '_' || i AS role_id, ts, value, wc FROM range(0, 500) x(i) JOIN RO ON i % m = r JOIN L ON L.role_id = RO.role_id),
DI AS (SELECT value AS new, sum(n) OVER (ORDER BY n DESC, value ROWS UNBOUNDED PRECEDING) AS hi, n FROM (SELECT value, count(*) AS n FROM L WHERE wc IS NULL GROUP BY 1)),
DR AS (SELECT role_id, value, floor(CAST('0x' || substr(md5(role_id || '|' || value || '|12'), 1, 12) AS BIGINT) / CAST(281474976710656 AS DOUBLE) * (SELECT max(hi) FROM DI)) + 1 AS x FROM (SELECT DISTINCT role_id, value FROM CO WHERE wc IS NULL)),
NA AS (SELECT role_id, value, new, row_number() OVER (PARTITION BY role_id, new ORDER BY value) AS i FROM DR JOIN DI ON x > hi - n AND x <= hi)
SELECT role_id, ts, CASE WHEN i = 1 THEN new WHEN i > 1 THEN new || '#' || i END AS value, wc FROM CO LEFT JOIN NA USING (role_id, value)"""
on_events("synthetic_roles", SY, lambda h: S.synthetic_roles(h, 500), values=20)
on_events("value_transitions_all", "SELECT DISTINCT role_id, prev, value AS after FROM S WHERE prev IS NOT NULL", lambda h: L.transitions(h, include_same=True))


# ingest
def on_revisions(name: str, sql: str | None, f: Callable[[DataFrame], DataFrame]) -> None:
    register(name, sql)(lambda spark, d: f(T.event_revisions(spark, d)))


RV = """
WITH r AS (SELECT CAST(user_id AS VARCHAR) AS key, event_type AS property, ts AS valid_from, event_id AS revision_id, 'k' || (CAST(json_extract_string(props, '$.k') AS INT) % 3) AS value FROM events),
z AS (SELECT * FROM (SELECT *, lead(valid_from) OVER (PARTITION BY key, property ORDER BY valid_from, revision_id) AS n FROM r) WHERE n IS NULL OR n > valid_from),
c AS (SELECT key, property, valid_from AS f, value, CAST(NULL AS VARCHAR) AS wc FROM (SELECT *, lag(value) OVER (PARTITION BY key, property ORDER BY valid_from) AS p FROM z) WHERE p IS NULL OR p <> value),
kt AS (SELECT key, min(valid_from) AS t FROM z GROUP BY 1),
fb AS (SELECT key, property, min(f) AS ts, t, CAST(DATE '2024-01-01' + CAST(((CAST(t AS DATE) - DATE '2024-01-01') // 7) * 7 AS INT) AS TIMESTAMP) AS b FROM c JOIN kt USING (key) GROUP BY key, property, t),
p AS (SELECT * FROM c UNION ALL SELECT key, property, TIMESTAMP '2024-01-01', NULL, 'R' FROM fb WHERE b > TIMESTAMP '2024-01-01' UNION ALL SELECT key, property, b, NULL, 'CE' FROM fb WHERE ts > b AND ts > t),
i AS (SELECT *, lead(f) OVER (PARTITION BY key, property ORDER BY f) AS e FROM p),
bk AS (SELECT DISTINCT key, property, DATE '2024-01-01' + CAST(((CAST(f AS DATE) - DATE '2024-01-01') // 7) * 7 AS INT) AS ts FROM p),
m AS (SELECT key, property, bk.ts, value, wc, sum(epoch_us(least(coalesce(e, CAST(bk.ts + 7 AS TIMESTAMP)), CAST(bk.ts + 7 AS TIMESTAMP))) - epoch_us(greatest(f, CAST(bk.ts AS TIMESTAMP)))) AS held, max(f) AS latest
      FROM bk JOIN i USING (key, property) WHERE bk.ts BETWEEN DATE '2024-01-01' AND DATE '2024-01-29' AND f < CAST(bk.ts + 7 AS TIMESTAMP) AND (e IS NULL OR e > CAST(bk.ts AS TIMESTAMP)) GROUP BY 1, 2, 3, 4, 5),
bm AS (SELECT key || '||' || property AS role_id, ts, value, wc FROM (SELECT *, row_number() OVER (PARTITION BY key, property, ts ORDER BY held DESC, latest DESC, value DESC) AS n FROM m) WHERE n = 1),
nd AS (SELECT role_id, ts, value, wc FROM (SELECT *, coalesce(value, '⊥' || wc) AS s, lag(coalesce(value, '⊥' || wc)) OVER (PARTITION BY role_id ORDER BY ts) AS q FROM bm) WHERE q IS NULL OR q <> s)
"""
on_revisions("revision_integrity", "SELECT count(*) AS n_revisions, count(DISTINCT event_id) AS n_ids, count(*) FILTER (WHERE p = ts) AS n_same_time, CAST(0 AS BIGINT) AS n_deletions FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM events)", N.integrity)
on_revisions("ingest_replay", RV + "SELECT key, property, f AS from_ts, value, wc FROM p", lambda r: N.replay(r, WEEKLY))
on_revisions("ingest_bucket_majority", RV + "SELECT role_id, ts, value, wc FROM bm", lambda r: N.bucket_majority(N.replay(r, WEEKLY), WEEKLY))
on_revisions("ingest_no_decay", RV + "SELECT role_id, ts, value, wc FROM nd WHERE role_id IN (SELECT role_id FROM nd WHERE wc IS NULL)", lambda r: N.no_decay(r, WEEKLY))
KEPT = RV.rstrip() + """,
nk AS (SELECT role_id, ts, value, wc, coalesce(value, '⊥' || wc) AS s FROM nd WHERE role_id IN (SELECT role_id FROM nd WHERE wc IS NULL)),
"""
JOINED = "SELECT role_id, ts, value, wc FROM (SELECT *, coalesce(value, '⊥' || wc) AS x, lag(coalesce(value, '⊥' || wc)) OVER (PARTITION BY role_id ORDER BY ts) AS q FROM al) WHERE q IS NULL OR q <> x"
GAPS = KEPT + """iv AS (SELECT role_id, ts AS a, coalesce(lead(ts) OVER (PARTITION BY role_id ORDER BY ts), greatest(DATE '2024-01-29', ts)) AS b, value, wc, s FROM nk),
cf AS (SELECT x.key || '||' || property AS role_id, ts FROM (SELECT DISTINCT key, property FROM r) x JOIN (SELECT DISTINCT key, DATE '2024-01-01' + CAST(((CAST(valid_from AS DATE) - DATE '2024-01-01') // 7) * 7 AS INT) AS ts FROM r) y USING (key)),
pt AS (SELECT role_id, cf.ts, value, wc, s FROM cf JOIN iv USING (role_id) WHERE cf.ts >= a AND (cf.ts < b OR a = b) UNION SELECT role_id, ts, value, wc, s FROM nk),
sp AS (SELECT *, lead(ts) OVER w AS nt, lead(s) OVER w AS ns FROM pt WINDOW w AS (PARTITION BY role_id ORDER BY ts)),
al AS (SELECT role_id, ts, value, wc FROM sp UNION ALL
       SELECT role_id, ts + {wait}, NULL, 'DE' FROM sp WHERE wc IS NULL AND (nt IS NULL OR ts + {wait} < nt) AND {also} AND ts + {wait} <= DATE '2024-01-29')
""" + JOINED
QUANTILE = KEPT + """rw AS (SELECT *, lead(ts) OVER w AS nx, row_number() OVER w AS n FROM nk WINDOW w AS (PARTITION BY role_id ORDER BY ts)),
ct AS (SELECT role_id, max(ts) AS last, list_sort(list(nx - ts) FILTER (WHERE n > 1 AND nx <= DATE '2024-01-22')) AS ds FROM rw GROUP BY 1 HAVING count(*) > 1),
al AS (SELECT role_id, ts, value, wc FROM rw JOIN ct USING (role_id) UNION ALL
       SELECT role_id, ts + cut, NULL, 'DE' FROM (SELECT *, CAST(ds[greatest(1, CAST(ceil(len(ds) * CAST(0.57 AS DOUBLE)) AS INT))] AS INT) AS cut FROM rw JOIN ct USING (role_id)) WHERE wc IS NULL AND coalesce(nx, last) - ts > cut)
""" + JOINED
on_revisions("ingest_between_changes", GAPS.format(wait=7, also="(ns IS NULL OR ns <> s)"), lambda r: N.ingest(r, WEEKLY, "between_changes"))
on_revisions("ingest_between_all_confirmations", GAPS.format(wait=7, also="true"), lambda r: N.ingest(r, WEEKLY, "between_all_confirmations"))
on_revisions("ingest_outside_grace", GAPS.format(wait=28, also="true"), lambda r: N.ingest(r, WEEKLY, "outside_grace"))
on_revisions("ingest_outside_short_grace", GAPS.format(wait=10, also="true"), lambda r: N.with_gaps(r, WEEKLY, "outside_grace", 10))
on_revisions("ingest_probabilistic", QUANTILE, lambda r: N.ingest(r, WEEKLY, "probabilistic"))
on_revisions("template_counts", "SELECT event_type AS template, count(*) AS n FROM events GROUP BY 1", lambda r: N.template_counts(r.withColumnRenamed("property", "template")))
on_revisions("confirmations", "SELECT DISTINCT a.key || '||' || property AS role_id, ts FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS key, event_type AS property FROM events) a JOIN (SELECT DISTINCT CAST(user_id AS VARCHAR) AS key, DATE '2024-01-01' + CAST(((CAST(ts AS DATE) - DATE '2024-01-01') // 7) * 7 AS INT) AS ts FROM events) b USING (key)", lambda r: N.confirmations(r, WEEKLY))


@register("link_extract", "SELECT page_id, CAST(2 AS INT) AS n, url || ';' || 'p' || page_id AS found FROM pages")
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of values built around the pages' addresses."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat(F.lit("see [["), "url", F.lit("|label]] and [[p"), "page_id", F.lit("]].")).alias("v"))
    return p.select("page_id", F.size(V.links(F.col("v"))).alias("n"), F.array_join(V.links(F.col("v")), ";").alias("found"))


@register("prediction_normalise", "SELECT doc_id, round(CASE WHEN toxic = 1 THEN (doc_id % 100) / 100.0 ELSE 1 - (doc_id % 100) / 100.0 END, 6) AS p FROM labels")
def prediction_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return x.select("doc_id", F.round(V.normalised_confidence(F.col("toxic"), (F.col("doc_id") % 100) / 100.0), 6).alias("p"))
