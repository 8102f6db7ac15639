"""Queries over the long metric fact: loading, filters, KPI types, trends and demographics."""

from __future__ import annotations

from pyspark.sql import functions as F

from audira.functions.segments import SEGMENTS
from audira.operators import kpi
from audira.plans.registry import query
from audira.sources import bindings as b
from audira.sources import tables
from audira.sources.bindings import TOTAL_SQL, metric_long_sql, with_ctes

NZ = "value IS NOT NULL AND value <> 0"


def ml(*metrics: str) -> str:
    return with_ctes(metric_long_sql(list(metrics)))


def _raw_fact(spark, d):
    """The fact as the sheet would hold it: every field is text, with commas, percent signs and blanks."""
    fact = b.metric_long(spark, d, ["views", "rating"], slot=True, title=True)
    number = F.when(F.col("metric") == "views", F.format_number("value", 2)).otherwise(
        F.concat(F.format_string("%.1f", "value"), F.lit("%"))
    )
    return fact.select(
        F.col("entity_id").cast("string").alias("entity_id"),
        F.concat(F.lit(" "), "slot").alias("slot"),
        F.col("year").cast("string").alias("year"),
        F.date_format("start_date", "yyyy. M. d").alias("start_date"),
        F.concat(F.col("step_no").cast("string"), F.lit("화")).alias("step_text"),
        "week_label",
        F.concat(F.lit(" "), F.date_format("week_start", "yyyy. M. d"), F.lit(" ")).alias("week_start"),
        F.concat("metric", F.lit(" ")).alias("metric"),
        "media",
        "segment",
        "attr1",
        "attr3",
        F.col("flag_netflix").cast("string").alias("flag_netflix"),
        F.when(F.col("value") == 0, F.lit("x")).otherwise(number).alias("value"),
    )


@query(
    "load_metric_long",
    ml("views", "rating")
    + """SELECT CAST(entity_id AS VARCHAR) AS entity_id, slot, CAST(year AS VARCHAR) AS year, start_date, step_no, week_no,
  week_start, metric, media, attr3, flag_netflix, value FROM ml""",
    {"value": 2},
)
def load_metric_long(spark, d):
    out = tables.load_metric_long(_raw_fact(spark, d))
    return out.select(
        "entity_id", "slot", "year", "start_date", "step_no", "week_no", "week_start", "metric", "media", "attr3",
        "flag_netflix", "value",
    )


@query(
    "filter_slot_year_month",
    ml("rating")
    + """SELECT entity_id, slot, year, step_no, value FROM ml
WHERE slot IN ('ECONOMY', 'PROMO') AND year IN (1997, 1998) AND month(start_date) IN (3, 4, 5)""",
)
def filter_slot_year_month(spark, d):
    fact = b.metric_long(spark, d, ["rating"], slot=True)
    out = kpi.filter_slot_year_month(fact, ["ECONOMY", "PROMO"], [1997, 1998], [3, 4, 5])
    return out.select("entity_id", "slot", "year", "step_no", "value")


@query(
    "route_view_rows",
    ml("views")
    + f"""SELECT entity_id, count(*) FILTER (WHERE {b.LOCAL_SQL}) AS local_rows,
  count(*) FILTER (WHERE {b.FOREIGN_SQL}) AS foreign_rows, sum(value) AS total_views
FROM ml WHERE {TOTAL_SQL} GROUP BY 1""",
    {"total_views": 2},
)
def route_view_rows(spark, d):
    fact = b.metric_long(spark, d, ["views"], title=True)
    rows = kpi.route_view_rows(fact, "total", b.ROUTING)
    return rows.groupBy("entity_id").agg(
        F.count_if(kpi.view_rows("local", b.ROUTING)).alias("local_rows"),
        F.count_if(kpi.view_rows("foreign", b.ROUTING)).alias("foreign_rows"),
        F.sum("value").alias("total_views"),
    )


@query(
    "union_views",
    ml("views")
    + f"""SELECT entity_id, step_no, media, value FROM ml WHERE {b.LOCAL_SQL}
UNION ALL SELECT entity_id, step_no, media, value FROM ml WHERE {b.FOREIGN_SQL}""",
)
def union_views(spark, d):
    fact = b.metric_long(spark, d, ["views"], title=True)
    return kpi.route_view_rows(fact, "total", b.ROUTING).select("entity_id", "step_no", "media", "value")


@query(
    "filter_metric_normalized",
    ml("ext_rank", "rating") + "SELECT entity_id, step_no, metric, value FROM ml WHERE metric = 'ext_rank'",
)
def filter_metric_normalized(spark, d):
    fact = b.metric_long(spark, d, ["ext_rank", "rating"])
    return kpi.filter_metric_normalized(fact, "Ext-Rank").select("entity_id", "step_no", "metric", "value")


@query("aired_entities", ml("rating") + "SELECT DISTINCT entity_id FROM ml WHERE value > 0")
def aired_entities(spark, d):
    return kpi.aired_entities(b.metric_long(spark, d, ["rating"]), "rating")


@query("step_cap_filter", ml("rating") + "SELECT entity_id, step_no, value FROM ml WHERE step_no <= 4")
def step_cap_filter(spark, d):
    return kpi.step_cap_filter(b.metric_long(spark, d, ["rating"]), 4).select("entity_id", "step_no", "value")


@query(
    "step_options",
    "SELECT DISTINCT l_linenumber AS step_no, l_linenumber = (SELECT max(l_linenumber) FROM lineitem) AS is_final"
    " FROM lineitem WHERE l_linenumber > 0",
)
def step_options(spark, d):
    return kpi.step_options(b.metric_long(spark, d, ["rating"]))


@query(
    "prelaunch_week_filter",
    ml("mentions")
    + "SELECT entity_id, week_label, value FROM ml WHERE week_label IN ('W-6', 'W-5', 'W-4', 'W-3')",
)
def prelaunch_week_filter(spark, d):
    fact = b.metric_long(spark, d, ["mentions"])
    return kpi.prelaunch_week_filter(fact, b.PRELAUNCH.weeks, "W-3").select("entity_id", "week_label", "value")


# ---- KPI types -----------------------------------------------------------------------------------------------


@query(
    "entity_step_mean",
    ml("rating")
    + f"""SELECT entity_id, avg(s) AS value FROM (
  SELECT entity_id, step_no, avg(value) AS s FROM ml WHERE {NZ} GROUP BY 1, 2) GROUP BY 1""",
    {"value": 6},
)
def entity_step_mean(spark, d):
    return kpi.entity_step_mean(b.metric_long(spark, d, ["rating"]))


@query(
    "entity_sum_mean",
    ml("mentions")
    + f"""SELECT slot, avg(s) AS value, count(s) AS n_entities FROM (
  SELECT slot, entity_id, sum(value) AS s FROM ml WHERE {NZ} GROUP BY 1, 2) GROUP BY 1""",
    {"value": 6},
)
def entity_sum_mean(spark, d):
    # Entities keep one slot: sum by entity first, then bring the slot to the small side.
    sums = kpi.entity_sum(b.metric_long(spark, d, ["mentions"]))
    slots = b.entity_dim(spark, d).select("entity_id", "slot")
    return kpi.mean_over_entities(sums.join(slots, "entity_id"), ("slot",))


@query(
    "entity_metric_series",
    ml("rating", "audience", "ext_rank")
    + f"""SELECT entity_id, 'ep_sum_mean' AS mode, avg(s) AS value FROM (SELECT entity_id, step_no, sum(value) AS s FROM ml
  WHERE metric = 'audience' AND media = 'LIVE' AND {NZ} GROUP BY 1, 2) GROUP BY 1
UNION ALL SELECT entity_id, 'mean', avg(s) FROM (SELECT entity_id, step_no, avg(value) AS s FROM ml WHERE metric = 'rating' AND {NZ} GROUP BY 1, 2) GROUP BY 1
UNION ALL SELECT entity_id, 'min', min(value) FROM ml WHERE metric = 'ext_rank' AND {NZ} GROUP BY 1
UNION ALL SELECT entity_id, 'sum', sum(value) FROM ml WHERE metric = 'audience' AND {NZ} GROUP BY 1
UNION ALL SELECT entity_id, 'vod', avg(s) FROM (SELECT entity_id, step_no, sum(value) AS s,
    count(*) FILTER (WHERE media = 'VOD') AS v FROM ml
  WHERE metric = 'audience' AND media IN ('VOD', 'QUICK') AND {NZ} GROUP BY 1, 2) WHERE v > 0 GROUP BY 1""",
    {"value": 6},
)
def entity_metric_series(spark, d):
    from audira.specs import MetricSpec

    specs = [
        (MetricSpec("ep_sum_mean", "audience", "step_sum", ("LIVE",)), False),
        (MetricSpec("mean", "rating", "mean"), False),
        (MetricSpec("min", "ext_rank", "min"), True),
        (MetricSpec("sum", "audience", "sum"), False),
        (MetricSpec("vod", "audience", "vod", ("VOD", "QUICK")), False),
    ]
    parts = []
    for spec, step_free in specs:
        fact = b.metric_long(spark, d, [spec.metric])
        part = kpi.entity_metric_series(fact, spec, b.ROUTING, step_free)
        parts.append(part.select("entity_id", F.lit(spec.kpi).alias("mode"), "value"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "vod_combined_on_valid_steps",
    ml("audience")
    + f"""SELECT entity_id, avg(s) AS value FROM (SELECT entity_id, step_no, sum(value) AS s FROM ml m
  WHERE media IN ('VOD', 'QUICK') AND {NZ} AND EXISTS (SELECT 1 FROM ml v WHERE v.entity_id = m.entity_id
    AND v.step_no = m.step_no AND v.media = 'VOD' AND v.value <> 0) GROUP BY 1, 2) GROUP BY 1""",
    {"value": 6},
)
def vod_combined(spark, d):
    return kpi.vod_combined_on_valid_steps(b.metric_long(spark, d, ["audience"]), b.SEVEN[2])


@query("metric_min", ml("rank") + "SELECT entity_id, min(value) AS value FROM ml GROUP BY 1")
def metric_min(spark, d):
    return kpi.metric_min(b.metric_long(spark, d, ["rank"]), "Rank")


@query(
    "rating_like_mean",
    ml("buzz")
    + "SELECT entity_id, avg(s) AS value FROM (SELECT entity_id, step_no, avg(value) AS s FROM ml GROUP BY 1, 2) GROUP BY 1",
    {"value": 6},
)
def rating_like_mean(spark, d):
    return kpi.rating_like_mean(b.metric_long(spark, d, ["buzz"]), "buzz")


@query(
    "group_rating_like_mean",
    ml("buzz")
    + "SELECT slot, avg(s) AS value FROM (SELECT slot, step_no, avg(value) AS s FROM ml GROUP BY 1, 2) GROUP BY 1",
    {"value": 6},
)
def group_rating_like_mean(spark, d):
    return kpi.group_rating_like_mean(b.metric_long(spark, d, ["buzz"]), "buzz", b.entity_dim(spark, d), "slot")


@query(
    "entity_weekly_avg",
    ml("mentions")
    + f"""SELECT entity_id, avg(s) AS value FROM (SELECT entity_id, week_start, sum(value) AS s FROM ml WHERE {NZ}
  GROUP BY 1, 2) GROUP BY 1""",
    {"value": 6},
)
def entity_weekly_avg(spark, d):
    return kpi.entity_weekly_avg(b.metric_long(spark, d, ["mentions"]))


@query(
    "total_views_weekly_avg",
    ml("views")
    + f"""SELECT entity_id, avg(s) AS value FROM (SELECT entity_id, week_start, sum(value) AS s FROM ml
  WHERE {TOTAL_SQL} AND {NZ} GROUP BY 1, 2) GROUP BY 1""",
    {"value": 4},
)
def total_views_weekly_avg(spark, d):
    return kpi.total_views_weekly_avg(b.metric_long(spark, d, ["views"], title=True), b.ROUTING)


@query(
    "series_add_fill",
    ml("views")
    + f"""SELECT coalesce(a.entity_id, c.entity_id) AS entity_id, coalesce(a.value, 0) + coalesce(c.value, 0) AS value FROM
  (SELECT entity_id, sum(value) AS value FROM ml WHERE {b.LOCAL_SQL} GROUP BY 1) a FULL JOIN
  (SELECT entity_id, sum(value) AS value FROM ml WHERE {b.FOREIGN_SQL} GROUP BY 1) c ON a.entity_id = c.entity_id""",
    {"value": 2},
)
def series_add_fill(spark, d):
    fact = b.metric_long(spark, d, ["views"], title=True)
    local = kpi.entity_sum(kpi.route_view_rows(fact, "local", b.ROUTING))
    foreign = kpi.entity_sum(kpi.route_view_rows(fact, "foreign", b.ROUTING))
    return kpi.series_add_fill(local, foreign)


def kpi_parts_sql(specs, group: str | None = None) -> str:
    """Long KPI table (entity_id, kpi, value) of specs, one SELECT each."""
    parts = []
    for s in specs:
        where = TOTAL_SQL if s.views else f"metric = '{s.metric}'"
        if s.media:
            where += " AND media IN (" + ", ".join(f"'{m}'" for m in s.media) + ")"
        if not s.keep_zero:
            where += f" AND {NZ}"
        lead = f", count(*) FILTER (WHERE media = '{s.media[0]}') AS v" if s.mode == "vod" else ""
        agg = "avg(value)" if s.mode == "mean" else "sum(value)"
        if s.mode in ("mean", "step_sum", "vod"):
            inner = f"SELECT entity_id, step_no, {agg} AS s{lead} FROM ml WHERE {where} GROUP BY 1, 2"
            keep = " WHERE v > 0" if s.mode == "vod" else ""
            parts.append(f"SELECT entity_id, '{s.kpi}' AS kpi, avg(s) AS value FROM ({inner}){keep} GROUP BY 1")
        else:
            parts.append(f"SELECT entity_id, '{s.kpi}' AS kpi, {s.mode}(value) AS value FROM ml WHERE {where} GROUP BY 1")
    return "\nUNION ALL ".join(parts)


ALL_OVERVIEW = ["rating", "home", "audience", "mentions", "views", "rank", "buzz"]
ALL_SEVEN = ["rating", "home", "audience", "mentions", "views", "buzz"]
ALL_DETAIL = ["rating", "home", "audience", "ext_rank", "mentions", "buzz"]


@query(
    "overview_performance",
    ml(*ALL_OVERVIEW)
    + f", k AS ({kpi_parts_sql(b.OVERVIEW)})\nSELECT e.entity_id"
    + "".join(f", coalesce(max(value) FILTER (WHERE kpi = '{s.kpi}'), 0.0) AS {s.kpi}" for s in b.OVERVIEW)
    + " FROM (SELECT DISTINCT entity_id FROM ent) e LEFT JOIN k ON k.entity_id = e.entity_id GROUP BY 1",
    {s.kpi: (2 if s.mode == "sum" else 6) for s in b.OVERVIEW},
)
def overview_performance(spark, d):
    fact = b.metric_long(spark, d, ALL_OVERVIEW, title=True)
    return kpi.overview_performance(fact, b.entity_dim(spark, d), b.OVERVIEW, b.ROUTING)


@query(
    "kpi_bundle",
    ml(*ALL_SEVEN)
    + f""", k AS (SELECT k.*, slot FROM ({kpi_parts_sql(b.SEVEN)}) k JOIN ent USING (entity_id)),
g AS (SELECT slot, kpi, avg(value) AS group_value FROM k GROUP BY 1, 2)
SELECT e.entity_id, g.slot, g.kpi, value, group_value, (coalesce(value, 0) - group_value) / group_value AS delta
FROM (SELECT DISTINCT entity_id, slot FROM ml) e JOIN g ON g.slot = e.slot LEFT JOIN k ON k.entity_id = e.entity_id AND k.kpi = g.kpi""",
    {"value": 4, "group_value": 4, "delta": 6},
)
def kpi_bundle(spark, d):
    fact = b.metric_long(spark, d, ALL_SEVEN, title=True)
    return kpi.kpi_bundle(fact, b.SEVEN, b.entity_dim(spark, d), "slot", b.ROUTING)


@query(
    "count_best_rank_one",
    ml("rank")
    + "SELECT count(*) AS n_entities FROM (SELECT entity_id FROM ml GROUP BY 1 HAVING min(value) = 1)",
)
def count_best_rank_one(spark, d):
    return kpi.count_best_rank_one(b.metric_long(spark, d, ["rank"]), "rank")


@query(
    "anchor_entities",
    ml("rating")
    + """SELECT entity_id, slot, year AS year_no, value FROM (
  SELECT entity_id, slot, year, avg(value) AS value FROM ml GROUP BY 1, 2, 3)
WHERE entity_id <> 3 AND value >= CASE WHEN year <= 1998 THEN
    CASE slot WHEN 'ECONOMY' THEN 5.2 WHEN 'PROMO' THEN 5.0 WHEN 'LARGE' THEN 5.4 END
  ELSE CASE slot WHEN 'ECONOMY' THEN 4.8 WHEN 'PROMO' THEN 4.6 WHEN 'SMALL' THEN 5.1 END END""",
    {"value": 6},
)
def anchor_entities(spark, d):
    return kpi.anchor_entities(b.metric_long(spark, d, ["rating"], slot=True), "rating", b.ANCHOR)


@query(
    "top3_appearances",
    ml("ext_rank")
    + """SELECT entity_id, count(*) AS appearances, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM ml
WHERE value > 0 AND value <= 3 GROUP BY 1""",
)
def top3_appearances(spark, d):
    return kpi.top3_appearances(b.metric_long(spark, d, ["ext_rank"]), "ext_rank")


# ---- trends and pivots ---------------------------------------------------------------------------------------


@query(
    "weekly_media_trend",
    ml("audience")
    + """SELECT w.week_start, m.media, coalesce(sum(value), 0.0) AS value
FROM (SELECT DISTINCT week_start FROM ml) w CROSS JOIN (VALUES ('LIVE'), ('QUICK'), ('VOD')) m(media)
LEFT JOIN ml ON ml.week_start = w.week_start AND ml.media = m.media GROUP BY 1, 2""",
    {"value": 2},
)
def weekly_media_trend(spark, d):
    return kpi.weekly_media_trend(b.metric_long(spark, d, ["audience"]), "audience", b.MEDIA)


@query(
    "step_rating_trend",
    ml("rating", "home")
    + """SELECT step_no, avg(value) FILTER (WHERE metric = 'rating') AS rating,
  avg(value) FILTER (WHERE metric = 'home') AS home FROM ml WHERE step_no <= 6 GROUP BY 1""",
    {"rating": 6, "home": 6},
)
def step_rating_trend(spark, d):
    return kpi.step_rating_trend(b.metric_long(spark, d, ["rating", "home"]), ["rating", "home"], cap=6)


@query(
    "step_media_pivot",
    ml("audience", "mentions")
    + """SELECT step_no, coalesce(sum(value) FILTER (WHERE metric = 'audience' AND media = 'LIVE'), 0.0) AS live,
  coalesce(sum(value) FILTER (WHERE metric = 'audience' AND media = 'QUICK'), 0.0) AS same_day,
  coalesce(sum(value) FILTER (WHERE metric = 'audience' AND media = 'VOD'), 0.0) AS weekly,
  coalesce(sum(value) FILTER (WHERE metric = 'mentions' AND media = 'VOD'), 0.0) AS other_platform
FROM ml GROUP BY 1""",
    {"live": 2, "same_day": 2, "weekly": 2, "other_platform": 2},
)
def step_media_pivot(spark, d):
    columns = {
        "live": ("audience", "LIVE"),
        "same_day": ("audience", "QUICK"),
        "weekly": ("audience", "VOD"),
        "other_platform": ("mentions", "VOD"),
    }
    return kpi.step_media_pivot(b.metric_long(spark, d, ["audience", "mentions"]), columns)


@query(
    "week_media_pivot",
    ml("views")
    + f"""SELECT week_label, coalesce(sum(value) FILTER (WHERE media = 'LIVE'), 0.0) AS LIVE,
  coalesce(sum(value) FILTER (WHERE media = 'QUICK'), 0.0) AS QUICK,
  coalesce(sum(value) FILTER (WHERE media = 'VOD'), 0.0) AS VOD, sum(value) AS total
FROM ml WHERE {TOTAL_SQL} AND week_label IS NOT NULL GROUP BY 1""",
    {"LIVE": 2, "QUICK": 2, "VOD": 2, "total": 2},
)
def week_media_pivot(spark, d):
    fact = b.metric_long(spark, d, ["views"], title=True)
    return kpi.week_media_pivot(kpi.route_view_rows(fact, "total", b.ROUTING), b.MEDIA)


@query(
    "weekly_best_rank",
    ml("ext_rank")
    + "SELECT entity_id, week_label, min(value) AS best_rank FROM ml WHERE value <> 0 AND week_label IS NOT NULL GROUP BY 1, 2",
)
def weekly_best_rank(spark, d):
    return kpi.weekly_best_rank(b.metric_long(spark, d, ["ext_rank"]), "ext_rank", ("entity_id", "week_label"))


@query(
    "score_with_rank",
    ml("buzz", "rank")
    + """SELECT s.entity_id, s.week_label, score, best_rank FROM
  (SELECT entity_id, week_label, avg(value) AS score FROM ml WHERE metric = 'buzz' AND week_label IS NOT NULL GROUP BY 1, 2) s
  LEFT JOIN (SELECT entity_id, week_label, min(value) AS best_rank FROM ml WHERE metric = 'rank' GROUP BY 1, 2) r
  ON s.entity_id = r.entity_id AND s.week_label = r.week_label""",
    {"score": 6},
)
def score_with_rank(spark, d):
    return kpi.score_with_rank(b.metric_long(spark, d, ["buzz", "rank"]), "buzz", "rank", ("entity_id", "week_label"))


@query(
    "prelaunch_weekly_trend",
    ml("mentions")
    + """SELECT week_label, avg(s) AS value, CAST(7 + CAST(week_label[2:] AS INTEGER) AS BIGINT) AS week_order FROM (
  SELECT entity_id, week_label, sum(value) AS s FROM ml WHERE week_label LIKE 'W-%' GROUP BY 1, 2) GROUP BY 1""",
    {"value": 6},
)
def prelaunch_weekly_trend(spark, d):
    return kpi.prelaunch_weekly_trend(b.metric_long(spark, d, ["mentions"]), list(b.PRELAUNCH.weeks))


@query(
    "media_share_mean",
    ml("mentions")
    + "SELECT media, avg(s) AS value FROM (SELECT entity_id, media, sum(value) AS s FROM ml GROUP BY 1, 2) GROUP BY 1",
    {"value": 6},
)
def media_share_mean(spark, d):
    return kpi.media_share_mean(b.metric_long(spark, d, ["mentions"]))


# ---- demographics --------------------------------------------------------------------------------------------

GENDER_SQL = "CASE WHEN segment LIKE '%F%' THEN '여' WHEN segment LIKE '%M%' THEN '남' END"
LABEL_SQL = (
    "CASE WHEN segment LIKE '%F%' OR segment LIKE '%M%' THEN"
    " CAST(greatest(10, least(60, CAST(regexp_extract(segment, '([0-9]+)', 1) AS INTEGER) // 10 * 10)) AS VARCHAR)"
    " || '대' || CASE WHEN segment LIKE '%F%' THEN '여성' ELSE '남성' END END"
)
PIVOT = ", ".join(f"coalesce(max(value) FILTER (WHERE label = '{x}'), 0.0) AS \"{x}\"" for x in SEGMENTS.labels())
LABEL_VALUES = ", ".join(f"('{x}')" for x in SEGMENTS.labels())


@query(
    "demographic_pyramid",
    ml("audience")
    + f""", t AS (SELECT {GENDER_SQL} AS gender,
  CAST(CAST(regexp_extract(segment, '([0-9]+)', 1) AS INTEGER) // 10 * 10 AS VARCHAR) || '대' AS decade, value FROM ml)
SELECT decade, gender, sum(value) AS value, sum(value) * 100 / sum(sum(value)) OVER () AS share,
  sum(value) * 100 / sum(sum(value)) OVER (PARTITION BY gender) AS gender_share
FROM t WHERE gender IS NOT NULL GROUP BY 1, 2""",
    {"value": 2, "share": 6, "gender_share": 6},
)
def demographic_pyramid(spark, d):
    fact = b.metric_long(spark, d, ["audience"], title=True)
    total = kpi.demographic_pyramid(fact)
    within = kpi.demographic_pyramid(fact, "gender").select("decade", "gender", F.col("share").alias("gender_share"))
    return total.join(within, ["decade", "gender"])


@query(
    "avg_segment_by_step",
    ml("audience")
    + f""", t AS (SELECT entity_id, step_no, {LABEL_SQL} AS label, sum(value) AS s FROM ml
  WHERE media IN ('QUICK', 'VOD') AND {NZ} GROUP BY 1, 2, 3),
m AS (SELECT step_no, label, avg(s) AS value FROM t WHERE label IS NOT NULL GROUP BY 1, 2)
SELECT step_no, {PIVOT} FROM m GROUP BY 1""",
    {x: 6 for x in SEGMENTS.labels()},
)
def avg_segment_by_step(spark, d):
    return kpi.avg_segment_by_step(b.metric_long(spark, d, ["audience"], title=True), "audience", ["QUICK", "VOD"])


@query(
    "segment_table_by_step",
    ml("audience")
    + f""", m AS (SELECT step_no, {LABEL_SQL} AS label, sum(value) AS value FROM ml WHERE media IN ('LIVE') GROUP BY 1, 2)
SELECT step_no, {PIVOT} FROM m WHERE label IS NOT NULL GROUP BY 1""",
    {x: 2 for x in SEGMENTS.labels()},
)
def segment_table_by_step(spark, d):
    return kpi.segment_table_by_step(b.metric_long(spark, d, ["audience"], title=True), "audience", ["LIVE"])


@query(
    "segment_population_mean",
    ml("audience")
    + f""", t AS (SELECT slot, entity_id, step_no, {LABEL_SQL} AS label, sum(value) AS s FROM ml GROUP BY 1, 2, 3, 4),
e AS (SELECT slot, entity_id, label, avg(s) AS value FROM t WHERE label IS NOT NULL GROUP BY 1, 2, 3),
g AS (SELECT slot, label, avg(s) AS group_value FROM t WHERE label IS NOT NULL GROUP BY 1, 2),
o AS (SELECT label, row_number() OVER () AS label_order FROM (VALUES {LABEL_VALUES}) v(label)),
w AS (SELECT entity_id, slot, label, value, group_value FROM e JOIN g USING (slot, label))
SELECT entity_id, slot, label, 'value' AS side, value AS mean_value, label_order FROM w JOIN o USING (label)
UNION ALL SELECT entity_id, slot, label, 'group_value', group_value, label_order FROM w JOIN o USING (label)""",
    {"mean_value": 6},
)
def segment_population_mean(spark, d):
    fact = b.metric_long(spark, d, ["audience"], title=True)
    return kpi.segment_population_mean(fact, "audience", b.MEDIA, b.entity_dim(spark, d), "slot")


@query(
    "step_segment_gap",
    ml("audience")
    + f""", t AS (SELECT slot, entity_id, step_no, {LABEL_SQL} AS label, sum(value) AS value FROM ml WHERE {NZ} GROUP BY 1, 2, 3, 4),
o AS (SELECT * FROM t WHERE label IS NOT NULL),
g AS (SELECT slot, step_no, label, avg(value) AS group_value FROM o GROUP BY 1, 2, 3),
f AS (SELECT DISTINCT slot, entity_id, step_no, v.label FROM o CROSS JOIN (VALUES {LABEL_VALUES}) v(label)),
j AS (SELECT f.entity_id, f.slot, f.step_no, f.label, coalesce(o.value, 0.0) AS value, coalesce(g.group_value, 0.0) AS group_value
  FROM f LEFT JOIN o ON o.entity_id = f.entity_id AND o.step_no = f.step_no AND o.label = f.label
  LEFT JOIN g ON g.slot = f.slot AND g.step_no = f.step_no AND g.label = f.label)
SELECT *, CASE WHEN group_value <> 0 THEN (value - group_value) / group_value * 100 WHEN value = 0 THEN 0.0 ELSE 999.0 END AS gap
FROM j""",
    {"value": 2, "group_value": 6, "gap": 5},
)
def step_segment_gap(spark, d):
    fact = b.metric_long(spark, d, ["audience"], title=True)
    return kpi.step_segment_gap(fact, "audience", b.MEDIA, b.entity_dim(spark, d), "slot")


@query(
    "step_change_flag",
    ml("audience")
    + f""", t AS (SELECT entity_id, {LABEL_SQL} AS label, step_no, sum(value) AS value FROM ml GROUP BY 1, 2, 3)
SELECT *, CAST(sign(value - lag(value) OVER (PARTITION BY entity_id, label ORDER BY step_no)) AS INTEGER) AS change
FROM t WHERE label IS NOT NULL""",
    {"value": 2},
)
def step_change_flag(spark, d):
    fact = b.metric_long(spark, d, ["audience"], title=True)
    sums = kpi.entity_segment_sums(fact, "audience", b.MEDIA, keep_zero=True)
    return kpi.step_change_flag(sums.select("entity_id", "label", "step_no", "value"), ["entity_id", "label"])
