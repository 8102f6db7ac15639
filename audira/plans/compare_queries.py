"""Queries on peer groups, cutoffs, ranks, percentiles and growth grades."""

from __future__ import annotations

from pyspark.sql import functions as F

from audira.functions import grades
from audira.operators import compare, cutoffs, growth, kpi, ordering
from audira.plans.kpi_queries import ALL_SEVEN, NZ, kpi_parts_sql, ml
from audira.plans.registry import query
from audira.sources import bindings as b
from audira.sources.bindings import FOREIGN_SQL, TOTAL_SQL
from audira.specs import MetricSpec

# The selected entity of the pages that compare one entity with the rest.
TARGET = 7


def _rating_by_slot(spark, d):
    """Mean rating per entity, with its slot joined to the aggregated side."""
    means = kpi.entity_step_mean(b.metric_long(spark, d, ["rating"]))
    means = means.withColumn("value", F.round("value", 6))
    return means.join(b.entity_dim(spark, d).select("entity_id", "slot"), "entity_id")


RATING_CTE = f""", r AS (SELECT entity_id, slot, round(avg(s), 6) AS value FROM (
  SELECT entity_id, slot, step_no, avg(value) AS s FROM ml WHERE {NZ} GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query(
    "rank_in_group",
    ml("rating")
    + RATING_CTE
    + """ SELECT slot, entity_id, value, rank() OVER (PARTITION BY slot ORDER BY value DESC) AS rank,
  count(*) OVER (PARTITION BY slot) AS group_size FROM r""",
    {"value": 5},
)
def rank_in_group(spark, d):
    return compare.rank_in_group(_rating_by_slot(spark, d), ["slot"])


@query(
    "rank_neighbors",
    ml("rating")
    + RATING_CTE
    + """, p AS (SELECT *, rank() OVER (PARTITION BY slot ORDER BY value DESC) AS rank,
  count(*) OVER (PARTITION BY slot) AS group_size,
  row_number() OVER (PARTITION BY slot ORDER BY value DESC, entity_id) AS position FROM r)
SELECT t.slot, t.entity_id AS target_id, n.position, n.entity_id, n.value, n.rank, n.group_size
FROM p t JOIN p n ON t.slot = n.slot AND n.position BETWEEN t.position - 3 AND t.position + 3""",
    {"value": 5},
)
def rank_neighbors(spark, d):
    return compare.rank_neighbors(_rating_by_slot(spark, d), ["slot"])


PEER_SQL = f"""SELECT p.* FROM ml p JOIN ent t ON t.entity_id = {TARGET} AND p.slot = t.slot AND p.year = t.year
WHERE p.entity_id = {TARGET} OR p.entity_id IN (SELECT entity_id FROM ml WHERE metric = 'rating' AND value > 0)"""


@query(
    "peer_group",
    ml("rating") + f"SELECT entity_id, step_no, value FROM ({PEER_SQL})",
)
def peer_group(spark, d):
    fact = b.metric_long(spark, d, ["rating"], slot=True)
    return compare.peer_group(fact, TARGET, rating_metric="rating").select("entity_id", "step_no", "value")


AIRED_SQL = f"(entity_id = {TARGET} OR entity_id IN (SELECT entity_id FROM ml WHERE metric = 'rating' AND value > 0))"


@query(
    "peer_group_variants",
    ml("rating")
    + f"""SELECT 'all' AS comparison, entity_id, step_no, value FROM ml WHERE {AIRED_SQL}
UNION ALL SELECT 'slots', entity_id, step_no, value FROM ml
  WHERE slot IN (SELECT slot FROM ent WHERE entity_id IN ({TARGET}, 2, 3)) AND year IN (1997, 1998) AND {AIRED_SQL}
UNION ALL SELECT 'weekday', entity_id, step_no, value FROM ml
  WHERE slot IN (SELECT slot FROM ent WHERE entity_id IN (4, 5)) AND year = (SELECT year FROM ent WHERE entity_id = {TARGET}) AND {AIRED_SQL}""",
)
def peer_group_variants(spark, d):
    """All slots and years; chosen slots and years; the weekday slots of the target's year."""
    fact = b.metric_long(spark, d, ["rating"], slot=True)
    slot = {r.entity_id: r.slot for r in b.entity_dim(spark, d).where(F.col("entity_id").isin(TARGET, 2, 3, 4, 5)).collect()}
    chosen, weekdays = {slot[k] for k in (TARGET, 2, 3)}, tuple({slot[k] for k in (4, 5)})
    parts = {
        "all": compare.peer_group(fact, TARGET, "all", [], "rating"),
        "slots": compare.peer_group(fact, TARGET, sorted(chosen), [1997, 1998], "rating"),
        "weekday": compare.peer_group(fact, TARGET, "weekday", None, "rating", weekdays),
    }
    rows = [p.select(F.lit(k).alias("comparison"), "entity_id", "step_no", "value") for k, p in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    "reference_date_cutoff",
    ml("rating")
    + f"""SELECT entity_id, step_no, value FROM ml
WHERE start_date <= (SELECT start_date FROM ent WHERE entity_id = {TARGET})""",
)
def reference_date_cutoff(spark, d):
    fact = b.metric_long(spark, d, ["rating"])
    return compare.reference_date_cutoff(fact, TARGET).select("entity_id", "step_no", "value")


@query(
    "metric_cutoff_slice",
    ml("mentions")
    + f"""SELECT entity_id, sum(value) AS value, count(*) AS n FROM ml
WHERE week_no <= (SELECT max(week_no) FROM ml WHERE entity_id = {TARGET}) GROUP BY 1""",
    {"value": 2},
)
def metric_cutoff_slice(spark, d):
    fact = b.metric_long(spark, d, ["mentions"])
    rows = compare.metric_cutoff_slice(fact, TARGET, MetricSpec("m", "mentions", "sum", cutoff="week"))
    return rows.groupBy("entity_id").agg(F.sum("value").alias("value"), F.count("*").alias("n"))


@query(
    "cutoff_label",
    ml("mentions")
    + "SELECT entity_id, coalesce('~W' || max(week_no), '~' || max(step_no) || '화') AS cutoff FROM ml GROUP BY 1",
)
def cutoff_label(spark, d):
    fact = b.metric_long(spark, d, ["mentions"])
    return compare.cutoff_label(fact, MetricSpec("m", "mentions", "sum", cutoff="week"))


@query(
    "value_vs_group_at_own_cutoff",
    ml("mentions")
    + """, s AS (SELECT slot, entity_id, step_no, sum(value) AS s FROM ml GROUP BY 1, 2, 3),
t AS (SELECT slot, entity_id, max(step_no) AS cutoff, sum(s) AS value FROM s GROUP BY 1, 2),
c AS (SELECT DISTINCT slot, cutoff FROM t),
p AS (SELECT c.slot, c.cutoff, s.entity_id, sum(s.s) AS v FROM c JOIN s ON s.slot = c.slot AND s.step_no <= c.cutoff GROUP BY 1, 2, 3),
g AS (SELECT slot, cutoff, avg(v) AS group_value FROM p GROUP BY 1, 2)
SELECT entity_id, slot, cutoff, value, group_value, value / group_value * 100 AS ratio FROM t JOIN g USING (slot, cutoff)""",
    {"value": 2, "group_value": 5, "ratio": 5},
)
def value_vs_group_at_own_cutoff(spark, d):
    fact = b.metric_long(spark, d, ["mentions"])
    return compare.value_vs_group_at_own_cutoff(fact, b.entity_dim(spark, d), "slot")


@query(
    "previous_work",
    ml("rating")
    + """SELECT e.entity_id, e.slot, e.start_date, (SELECT max(p.entity_id) FROM ent p WHERE p.slot = e.slot AND p.start_date =
  (SELECT max(q.start_date) FROM ent q WHERE q.slot = e.slot AND q.start_date < e.start_date)) AS previous_id FROM ent e""",
)
def previous_work(spark, d):
    return compare.previous_work(b.entity_dim(spark, d))


@query(
    "entity_attributes",
    ml("rating")
    + """SELECT c.entity_id, ent.start_date, media FROM (SELECT entity_id, media, row_number() OVER (PARTITION BY entity_id
  ORDER BY count(*) DESC, media) AS k FROM ml GROUP BY 1, 2) c JOIN ent ON ent.entity_id = c.entity_id WHERE k = 1""",
)
def entity_attributes(spark, d):
    return compare.entity_attributes(b.metric_long(spark, d, ["rating"]), ["media"])


@query(
    "entities_by_recency",
    ml("rating") + "SELECT entity_id, start_date, row_number() OVER (ORDER BY start_date DESC, entity_id) AS position FROM ent",
)
def entities_by_recency(spark, d):
    return compare.entities_by_recency(b.entity_dim(spark, d))


ALL_PAGE = ["rating", "home", "audience", "prefer", "ext_rank", "mentions", "views", "rank", "buzz"]
# Metric names in the fact of the KPIs that match by normalised name.
PLAIN_NAMES = {"EXT-Rank": "ext_rank"}


def own_cutoff_sql(specs) -> str:
    """CTEs of all KPIs with peers cut at each entity's own last week or step: every peer at every cutoff that occurs."""

    def chosen(s) -> str:
        where = {"total": TOTAL_SQL, "foreign": FOREIGN_SQL, None: f"metric = '{PLAIN_NAMES.get(s.metric, s.metric)}'"}[s.views]
        return where + (f" AND media IN ({', '.join(repr(m) for m in s.media)})" if s.media else "")

    def names(test) -> str:
        return "(" + ", ".join(repr(s.kpi) for s in specs if test(s)) + ")"

    step = "step_no IS NOT NULL"
    value = f"""CASE WHEN kpi IN {names(lambda s: s.mode == "mean")} THEN avg(s / n) FILTER (n > 0 AND {step})
    WHEN kpi IN {names(lambda s: s.mode == "step_sum")} THEN avg(s) FILTER (n > 0 AND {step})
    WHEN kpi IN {names(lambda s: s.mode == "vod")} THEN avg(s) FILTER (ld > 0 AND {step})
    WHEN kpi IN {names(lambda s: s.mode == "sum")} THEN sum(s) ELSE min(lo) END"""
    rows = "\nUNION ALL ".join(
        f"SELECT entity_id, slot, '{s.kpi}' AS kpi, step_no, week_no, {'value' if s.keep_zero else f'CASE WHEN {NZ} THEN value END'} AS v,"
        f" {f'media = {s.media[0]!r}' if s.mode == 'vod' else 'true'} AS leads FROM ml WHERE {chosen(s)}"
        for s in specs
    )
    sums = "sum(v) AS s, count(v) AS n, min(v) AS lo, count(v) FILTER (leads) AS ld"
    week = f"kpi IN {names(lambda s: s.cutoff == 'week')} AND max(week_no) IS NOT NULL"
    return f""", rk AS ({rows}),
own AS (SELECT entity_id, slot, kpi, CASE WHEN {week} THEN 'week' WHEN max(step_no) IS NOT NULL THEN 'step' ELSE 'all' END AS kind,
  CASE WHEN {week} THEN max(week_no) ELSE max(step_no) END AS c FROM rk GROUP BY 1, 2, 3),
cuts AS (SELECT DISTINCT slot, kpi, kind, c FROM own),
cell AS (SELECT cuts.slot, cuts.kpi, kind, c, entity_id, step_no, {sums} FROM cuts JOIN rk ON rk.slot = cuts.slot AND rk.kpi = cuts.kpi
  AND CASE kind WHEN 'week' THEN week_no <= c WHEN 'step' THEN step_no <= c ELSE true END GROUP BY ALL),
peer AS (SELECT slot, kpi, kind, c, entity_id, round({value}, 6) AS v FROM cell GROUP BY slot, kpi, kind, c, entity_id),
ranked AS (SELECT *, rank() OVER (PARTITION BY slot, kpi, kind, c ORDER BY v) AS up, rank() OVER (PARTITION BY slot, kpi, kind, c ORDER BY v DESC) AS down
  FROM peer WHERE v IS NOT NULL),
stats AS (SELECT slot, kpi, kind, c, avg(v) AS group_value, count(*) AS group_size FROM ranked GROUP BY ALL),
pooled AS (SELECT slot, kpi, kind, c, round(avg(m), 6) AS pooled FROM (SELECT slot, kpi, kind, c, step_no, sum(s) / sum(n) AS m FROM cell
  WHERE kpi IN {names(lambda s: s.group_mode == "rows")} AND step_no IS NOT NULL AND n > 0 GROUP BY ALL) GROUP BY ALL),
whole AS (SELECT entity_id, kpi, round({value}, 6) AS value FROM (SELECT entity_id, kpi, step_no, {sums} FROM rk GROUP BY ALL) GROUP BY 1, 2)
"""


@query(
    "kpi_vs_group",
    ml(*ALL_PAGE)
    + own_cutoff_sql(b.DETAIL_PAGE)
    + """SELECT o.entity_id, o.slot, o.kpi, o.kind, CAST(o.c AS DOUBLE) AS cutoff, value, coalesce(pooled, group_value) AS group_value,
  value * 100 / coalesce(pooled, group_value) AS ratio,
  CASE WHEN o.kpi IN ('external_rank', 'buzz_rank') THEN up ELSE down END AS rank, coalesce(group_size, 0) AS group_size
FROM own o JOIN whole w ON w.entity_id = o.entity_id AND w.kpi = o.kpi AND value IS NOT NULL
LEFT JOIN ranked r ON r.entity_id = o.entity_id AND r.slot = o.slot AND r.kpi = o.kpi AND r.kind = o.kind AND r.c IS NOT DISTINCT FROM o.c
LEFT JOIN stats g ON g.slot = o.slot AND g.kpi = o.kpi AND g.kind = o.kind AND g.c IS NOT DISTINCT FROM o.c
LEFT JOIN pooled p ON p.slot = o.slot AND p.kpi = o.kpi AND p.kind = o.kind AND p.c IS NOT DISTINCT FROM o.c""",
    {"value": 5, "group_value": 5, "ratio": 4},
)
def kpi_vs_group(spark, d):
    fact = b.metric_long(spark, d, ALL_PAGE, title=True)
    return cutoffs.kpi_vs_group(fact, b.DETAIL_PAGE, b.entity_dim(spark, d), "slot", b.ROUTING)


def _seven_long(spark, d):
    fact = b.metric_long(spark, d, ALL_SEVEN, title=True)
    return kpi.stepped_kpis(fact, b.SEVEN, routing=b.ROUTING)


@query(
    "kpi_head_to_head",
    ml(*ALL_SEVEN)
    + f""", k AS (SELECT entity_id, kpi, round(value, 6) AS value FROM ({kpi_parts_sql(b.SEVEN)})),
pairs AS (SELECT e.entity_id AS entity_1, (SELECT max(p.entity_id) FROM ent p WHERE p.slot = e.slot AND p.start_date =
  (SELECT max(q.start_date) FROM ent q WHERE q.slot = e.slot AND q.start_date < e.start_date)) AS entity_2 FROM ent e)
SELECT entity_1, entity_2, a.kpi, a.value AS value_1, c.value AS value_2,
  CASE WHEN a.value > c.value THEN 1 WHEN c.value > a.value THEN 2 ELSE 0 END AS winner
FROM pairs JOIN k a ON a.entity_id = entity_1 LEFT JOIN k c ON c.entity_id = entity_2 AND c.kpi = a.kpi
WHERE entity_2 IS NOT NULL""",
    {"value_1": 4, "value_2": 4},
)
def kpi_head_to_head(spark, d):
    pairs = compare.previous_work(b.entity_dim(spark, d)).where(F.col("previous_id").isNotNull())
    pairs = pairs.select(F.col("entity_id").alias("entity_1"), F.col("previous_id").alias("entity_2"))
    long = _seven_long(spark, d).withColumn("value", F.round("value", 6))
    return compare.kpi_head_to_head(long, pairs)


KPIS7 = [s.kpi for s in b.SEVEN]
PCT_CTE = f""", k AS (SELECT entity_id, kpi, round(value, 6) AS value FROM ({kpi_parts_sql(b.SEVEN)})),
pc AS (SELECT entity_id, kpi, (rank() OVER (PARTITION BY kpi ORDER BY value)
  + (count(*) OVER (PARTITION BY kpi, value) - 1) / 2.0) * 100.0 / count(*) OVER (PARTITION BY kpi) AS pct FROM k),
wide AS (SELECT e.entity_id, {", ".join(f"coalesce(max(pct) FILTER (WHERE kpi = '{x}'), 0.0) AS {x}" for x in KPIS7)}
  FROM ent e LEFT JOIN pc ON pc.entity_id = e.entity_id GROUP BY 1)"""


@query("kpi_percentiles", ml(*ALL_SEVEN) + PCT_CTE + " SELECT * FROM wide", {x: 6 for x in KPIS7})
def kpi_percentiles(spark, d):
    return compare.kpi_percentiles(_seven_long(spark, d), b.entity_dim(spark, d), KPIS7)


@query(
    "positioning_radar",
    ml(*ALL_SEVEN)
    + PCT_CTE
    + f""", l AS (SELECT w.entity_id, slot, x.kpi, CASE x.kpi {" ".join(f"WHEN '{x}' THEN {x}" for x in KPIS7)} END AS score
  FROM wide w JOIN ent ON ent.entity_id = w.entity_id CROSS JOIN (VALUES {", ".join(f"('{x}')" for x in KPIS7)}) x(kpi))
SELECT *, avg(score) OVER (PARTITION BY slot, kpi) AS group_score FROM l""",
    {"score": 6, "group_score": 6},
)
def positioning_radar(spark, d):
    entities = b.entity_dim(spark, d)
    wide = compare.kpi_percentiles(_seven_long(spark, d), entities, KPIS7)
    return compare.positioning_radar(wide, entities.select("entity_id", "slot"), KPIS7)


@query(
    "quintile_grade",
    ml("rating")
    + RATING_CTE
    + """, q AS (SELECT *, 2 * rank() OVER (PARTITION BY slot ORDER BY value DESC) + count(*) OVER (PARTITION BY slot, value) - 1 AS k,
  count(*) OVER (PARTITION BY slot) AS n FROM r)
SELECT entity_id, slot, value, CASE WHEN 5 * k <= 2 * n THEN 'S' WHEN 5 * k <= 4 * n THEN 'A' WHEN 5 * k <= 6 * n THEN 'B'
  WHEN 5 * k <= 8 * n THEN 'C' ELSE 'D' END AS grade FROM q""",
    {"value": 5},
)
def quintile_grade(spark, d):
    return compare.quintile_grade(_rating_by_slot(spark, d), ["slot"]).select("entity_id", "slot", "value", "grade")


@query(
    "percentrank_inc",
    ml("rating")
    + RATING_CTE
    + """ SELECT entity_id, slot, value, CASE WHEN count(*) OVER (PARTITION BY slot) <= 1 THEN 1.0 ELSE
  (rank() OVER (PARTITION BY slot ORDER BY value) - 1) / CAST(count(*) OVER (PARTITION BY slot) - 1 AS DOUBLE) END AS pct FROM r""",
    {"value": 5, "pct": 8},
)
def percentrank_inc(spark, d):
    out = ordering.with_percentrank_inc(_rating_by_slot(spark, d), {"value": "pct"}, ["slot"])
    return out.select("entity_id", "slot", "value", "pct")


@query(
    "fixed_peer_labels",
    ml("rating")
    + f""", pv AS (SELECT max(p.entity_id) AS id FROM ent p, ent e WHERE e.entity_id = {TARGET} AND p.slot = e.slot
  AND p.start_date = (SELECT max(q.start_date) FROM ent q WHERE q.slot = e.slot AND q.start_date < e.start_date))
SELECT 'target' AS label, entity_id, step_no, value FROM ml WHERE entity_id = {TARGET}
UNION ALL SELECT 'previous', entity_id, step_no, value FROM ml WHERE entity_id = (SELECT id FROM pv)
UNION ALL SELECT 'group', entity_id, step_no, value FROM ml WHERE entity_id <> {TARGET}
  AND slot = (SELECT slot FROM ent WHERE entity_id = {TARGET})""",
)
def fixed_peer_labels(spark, d):
    fact = b.metric_long(spark, d, ["rating"], slot=True)
    out = compare.fixed_peer_labels(fact, TARGET, compare.previous_work(b.entity_dim(spark, d)))
    return out.select("label", "entity_id", "step_no", "value")


@query(
    "survey_mean",
    ml("s_story", "s_cast")
    + """, o AS (SELECT entity_id, metric, sum(value) AS s, count(value) AS n FROM ml GROUP BY 1, 2),
pv AS (SELECT e.entity_id, e.slot, (SELECT max(p.entity_id) FROM ent p WHERE p.slot = e.slot AND p.start_date =
  (SELECT max(q.start_date) FROM ent q WHERE q.slot = e.slot AND q.start_date < e.start_date)) AS previous_id FROM ent e),
g AS (SELECT slot, metric, sum(s) AS s, sum(n) AS n FROM o JOIN ent USING (entity_id) GROUP BY 1, 2)
SELECT pv.entity_id, m.metric, coalesce(o.s / o.n, 0.0) AS target_mean, coalesce(p.s / p.n, 0.0) AS previous_mean,
  coalesce((g.s - coalesce(o.s, 0)) / nullif(g.n - coalesce(o.n, 0), 0), 0.0) AS group_mean
FROM pv CROSS JOIN (VALUES ('s_story'), ('s_cast')) m(metric)
LEFT JOIN o ON o.entity_id = pv.entity_id AND o.metric = m.metric
LEFT JOIN o p ON p.entity_id = pv.previous_id AND p.metric = m.metric
LEFT JOIN g ON g.slot = pv.slot AND g.metric = m.metric""",
    {"target_mean": 6, "previous_mean": 6, "group_mean": 6},
)
def survey_mean(spark, d):
    entities = b.entity_dim(spark, d)
    fact = b.metric_long(spark, d, ["s_story", "s_cast"])
    return compare.survey_mean(fact, compare.previous_work(entities), ["s_story", "s_cast"])


# ---- growth --------------------------------------------------------------------------------------------------

CUTOFFS = (2, 4, 6, 8)
CUT_SQL = "(VALUES (2), (4), (6), (8)) c(cutoff)"


def series_sql(specs, zero_dropped: bool) -> str:
    parts = []
    for s in specs:
        where = TOTAL_SQL if s.views else f"metric = '{s.metric}'"
        if s.media:
            where += " AND media IN (" + ", ".join(f"'{m}'" for m in s.media) + ")"
        if zero_dropped:
            where += f" AND {NZ}"
        value = f"value * CASE WHEN flag_netflix = 1 THEN {s.flag_factor} ELSE 1 END" if s.flag_factor else "value"
        agg = "sum" if s.mode == "sum" else "avg"
        parts.append(f"SELECT entity_id, '{s.name}' AS name, step_no, {agg}({value}) AS value FROM ml WHERE {where} GROUP BY 1, 2, 3")
    return " UNION ALL ".join(parts)


def stats_sql(specs, zero_dropped: bool) -> str:
    return f""", series AS ({series_sql(specs, zero_dropped)}),
stats AS (SELECT entity_id, name, cutoff, round(avg(value), 8) AS level,
  round(CASE WHEN count(*) >= 2 THEN regr_slope(value, step_no) END, 8) AS slope
  FROM series JOIN {CUT_SQL} ON step_no <= cutoff AND step_no >= 1 GROUP BY 1, 2, 3)"""


def quintile_sql(value: str, partition: str, labels: list[str]) -> str:
    rank = f"2 * rank() OVER (PARTITION BY {partition}, {value} IS NULL ORDER BY {value} DESC)"
    ties = f"count(*) OVER (PARTITION BY {partition}, {value})"
    n = f"count({value}) OVER (PARTITION BY {partition})"
    cases = " ".join(f"WHEN 5 * ({rank} + {ties} - 1) <= {2 * (i + 1)} * {n} THEN '{x}'" for i, x in enumerate(labels[:-1]))
    return f"CASE WHEN {value} IS NULL THEN NULL {cases} ELSE '{labels[-1]}' END"


def pct_sql(value: str, partition: str) -> str:
    rank = f"rank() OVER (PARTITION BY {partition}, {value} IS NULL ORDER BY {value})"
    ties = f"count(*) OVER (PARTITION BY {partition}, {value})"
    n = f"count({value}) OVER (PARTITION BY {partition})"
    return f"CASE WHEN {value} IS NULL THEN NULL ELSE ({rank} + ({ties} - 1) / 2.0) / CAST({n} AS DOUBLE) END"


def graded_sql(specs, zero_dropped: bool) -> str:
    return (
        stats_sql(specs, zero_dropped)
        + f""", pcts AS (SELECT entity_id, cutoff, {pct_sql("level", "cutoff, name")} AS lp, {pct_sql("slope", "cutoff, name")} AS sp FROM stats),
means AS (SELECT entity_id, cutoff, round(avg(lp * 100), 8) AS level_pct_mean, round(avg(sp * 100), 8) AS slope_pct_mean
  FROM pcts GROUP BY 1, 2),
graded AS (SELECT *, {quintile_sql("level_pct_mean", "cutoff", grades.LEVEL_GRADES)} AS level_grade,
  {quintile_sql("slope_pct_mean", "cutoff", grades.SLOPE_GRADES)} AS slope_grade FROM means)"""
    )


GRADED_COLUMNS = "SELECT *, level_grade || coalesce(slope_grade, '') AS grade FROM graded"
BROADCAST_METRICS = ["home", "rating", "audience"]


def _graded(spark, d):
    fact = b.metric_long(spark, d, BROADCAST_METRICS)
    return growth.growth_grades(fact, b.BROADCAST, CUTOFFS, b.ROUTING)


@query(
    "growth_grades",
    ml(*BROADCAST_METRICS) + graded_sql(b.BROADCAST, False) + GRADED_COLUMNS,
    {"level_pct_mean": 5, "slope_pct_mean": 5},
)
def growth_grades(spark, d):
    return _graded(spark, d)


@query(
    "growth_grades_digital",
    ml("views", "buzz") + graded_sql(b.DIGITAL, True) + GRADED_COLUMNS,
    {"level_pct_mean": 5, "slope_pct_mean": 5},
)
def growth_grades_digital(spark, d):
    fact = b.metric_long(spark, d, ["views", "buzz"], title=True)
    return growth.growth_grades_digital(fact, b.DIGITAL, CUTOFFS, b.ROUTING)


@query(
    "growth_metric_grades",
    ml(*BROADCAST_METRICS)
    + stats_sql(b.BROADCAST, False)
    + f""", g AS (SELECT *, {quintile_sql("level", "cutoff, name", grades.LEVEL_GRADES)} AS level_grade,
  {quintile_sql("slope", "cutoff, name", grades.SLOPE_GRADES)} AS slope_grade FROM stats)
SELECT *, level_grade || coalesce(slope_grade, '') AS grade FROM g""",
    {"level": 6, "slope": 6},
)
def growth_metric_grades(spark, d):
    fact = b.metric_long(spark, d, BROADCAST_METRICS)
    return growth.metric_grades(growth.level_and_slope(growth.step_series(fact, b.BROADCAST, b.ROUTING), CUTOFFS))


@query(
    "grade_evolution",
    ml(*BROADCAST_METRICS)
    + graded_sql(b.BROADCAST, False)
    + """SELECT entity_id, cutoff, cutoff || '회차' AS cutoff_label, level_grade, coalesce(slope_grade, '') AS slope_grade,
  CASE level_grade WHEN 'S' THEN 5 WHEN 'A' THEN 4 WHEN 'B' THEN 3 WHEN 'C' THEN 2 ELSE 1 END AS level_no
FROM graded WHERE level_grade IS NOT NULL""",
)
def grade_evolution(spark, d):
    return growth.grade_evolution(_graded(spark, d))


@query(
    "positioning_grid",
    ml(*BROADCAST_METRICS)
    + graded_sql(b.BROADCAST, False)
    + """, lg AS (SELECT * FROM (VALUES ('S', 5), ('A', 4), ('B', 3), ('C', 2), ('D', 1)) a(level_grade, x)
  CROSS JOIN (VALUES ('+2', 5), ('+1', 4), ('0', 3), ('-1', 2), ('-2', 1)) s(slope_grade, y)),
f AS (SELECT * FROM graded WHERE cutoff = 6)
SELECT lg.level_grade, lg.slope_grade, (x + y) / 2.0 AS score, entity_id,
  count(entity_id) OVER (PARTITION BY lg.level_grade, lg.slope_grade) AS cell_size
FROM lg LEFT JOIN f ON f.level_grade = lg.level_grade AND f.slope_grade = lg.slope_grade""",
    {"score": 2},
)
def positioning_grid(spark, d):
    return growth.positioning_grid(_graded(spark, d), 6)


@query(
    "first_steps_present",
    ml("views")
    + f"""SELECT entity_id, coalesce(bool_or(step_no = 1 AND {NZ}), false) AS has_step_1,
  coalesce(bool_or(step_no = 2 AND {NZ}), false) AS has_step_2 FROM ml WHERE {TOTAL_SQL} GROUP BY 1""",
)
def first_steps_present(spark, d):
    return growth.first_steps_present(b.metric_long(spark, d, ["views"], title=True), b.ROUTING)
