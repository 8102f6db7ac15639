"""Queries on pre-launch features, the ridge model and its evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from audira.operators import compare, prelaunch
from audira.plans.kpi_queries import ml
from audira.plans.registry import query
from audira.session import store_rows
from audira.sources import bindings as b
from audira.sources.bindings import TOTAL_SQL

SPEC = b.PRELAUNCH
METRICS = ["views", "mentions", "aware", "prefer", "intent", "s_story", "s_cast", "buzz"]
WEEKS = list(SPEC.weeks)
TARGET = 7


def _fact(spark, d, metrics=METRICS):
    return b.metric_long(spark, d, metrics, title="views" in metrics)


def weekly_sql(weeks: list[str]) -> str:
    parts = []
    for m in SPEC.surveys:
        parts += [f"coalesce(avg(value) FILTER (WHERE metric = '{m}' AND week_label = '{w}'), 0.0) AS {m}_{i}" for i, w in enumerate(weeks)]
    for name, rows in (("views", TOTAL_SQL), ("mentions", "metric = 'mentions'")):
        parts += [f"coalesce(sum(value) FILTER (WHERE {rows} AND week_label = '{w}'), 0.0) AS {name}_{i}" for i, w in enumerate(weeks)]
    parts += [f"coalesce(avg(value) FILTER (WHERE metric = '{m}'), 0.0) AS {m}" for m in SPEC.screening]
    return "SELECT entity_id, " + ", ".join(parts) + " FROM ml GROUP BY 1"


TARGET_SQL = "launch AS (SELECT entity_id, avg(value) AS target FROM ml WHERE metric = 'buzz' AND week_label = 'W+1' GROUP BY 1)"


def plus(name: str, n: int) -> str:
    return "(" + " + ".join(f"{name}_{i}" for i in range(n)) + ")"


def slog(x: str) -> str:
    return f"sign({x}) * ln(1 + abs({x}))"


def full_sql() -> tuple[str, list[str]]:
    cols: dict[str, str] = {m: m for m in SPEC.screening}
    for m in SPEC.surveys:
        cols[f"{m}_level"] = f"{m}_5"
        cols[f"{m}_mean"] = plus(m, 6) + " / 6"
        cols[f"{m}_momentum"] = f"{m}_5 - {m}_3"
        cols[f"{m}_slope"] = "(" + " + ".join(f"{m}_{i} * ({i} - 2.5)" for i in range(6)) + ") / 17.5"
    for m in ("views", "mentions"):
        cols[f"log_{m}_sum"] = f"ln(1 + {plus(m, 6)})"
        cols[f"log_{m}_level"] = f"ln(1 + {m}_5)"
        cols[f"slog_{m}_momentum"] = slog(f"({m}_5 - {m}_3)")
        cols[f"{m}_coverage"] = "(" + " + ".join(f"CAST({m}_{i} > 0 AS INTEGER)" for i in range(6)) + ") / 6.0"
    picked = ", ".join(f"{v} AS {k}" for k, v in cols.items())
    sql = f", weekly AS ({weekly_sql(WEEKS)}), {TARGET_SQL}, full_frame AS (SELECT entity_id, {picked} FROM weekly)"
    return sql, list(cols)


FULL_SQL, FULL_NAMES = full_sql()


def cutoff_sql(cutoff: str) -> tuple[str, list[str]]:
    weeks = WEEKS[: WEEKS.index(cutoff) + 1]
    n = len(weeks)
    cols: dict[str, str] = {m: m for m in SPEC.screening}
    for m in (*SPEC.surveys, "views", "mentions"):
        last, momentum = f"{m}_{n - 1}", f"({m}_{n - 1} - {m}_{n - 3})"
        counts = m in ("views", "mentions")
        cols[f"{m}_total"] = f"ln(1 + {plus(m, n)})" if counts else plus(m, n)
        cols[f"{m}_last"] = f"ln(1 + {last})" if counts else last
        cols[f"{m}_momentum"] = slog(momentum) if counts else momentum
        cols[f"{m}_trend"] = f"({last} - {m}_0) / {n - 1}"
    picked = ", ".join(f"{v} AS {k}" for k, v in cols.items())
    name = cutoff.replace("-", "").lower()
    return f", weekly_{name} AS ({weekly_sql(weeks)}), frame_{name} AS (SELECT entity_id, {picked} FROM weekly_{name})", list(cols)


@query(
    "launch_target_week",
    ml("buzz") + "SELECT CASE WHEN bool_or(week_label = 'W+1') THEN 'W+1' ELSE max(week_label) END AS target_week FROM ml",
)
def launch_target_week(spark, d):
    return prelaunch.launch_target_week(_fact(spark, d, ["buzz"]), SPEC)


@query(
    "launch_week_actual",
    ml("buzz")
    + """SELECT entity_id, value AS actual FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY week_start DESC, value DESC) AS k
  FROM ml WHERE week_label = 'W+1') WHERE k = 1""",
)
def launch_week_actual(spark, d):
    return prelaunch.launch_week_actual(_fact(spark, d, ["buzz"]), "week_start", SPEC)


@query(
    "has_week_data",
    ml("views", "mentions", "aware")
    + f""", f AS (SELECT entity_id, week_label, bool_or({TOTAL_SQL}) AS v FROM ml WHERE week_label IN ('W-1', 'W-2', 'W-3') GROUP BY 1, 2)
SELECT entity_id, 'W' || max(CAST(substr(week_label, 2) AS INTEGER)) AS chosen_week,
  count(*) AS ready_weeks FROM f WHERE v GROUP BY 1""",
)
def has_week_data(spark, d):
    return prelaunch.has_week_data(_fact(spark, d, ["views", "mentions", "aware"]), SPEC)


@query(
    "prelaunch_features_full",
    ml(*METRICS)
    + FULL_SQL
    + f"""SELECT ent.entity_id, target, {", ".join(f"coalesce({n}, 0.0) AS {n}" for n in FULL_NAMES)}
FROM ent LEFT JOIN full_frame USING (entity_id) LEFT JOIN launch USING (entity_id)""",
    {**{n: 6 for n in FULL_NAMES}, "target": 5},
)
def prelaunch_features_full(spark, d):
    frame, _ = prelaunch.prelaunch_features_full(_fact(spark, d), b.entity_dim(spark, d), SPEC)
    return frame


W3_SQL, W3_NAMES = cutoff_sql("W-3")
W2_SQL, _ = cutoff_sql("W-2")
W1_SQL, _ = cutoff_sql("W-1")


@query(
    "prelaunch_features_cutoff",
    ml(*METRICS)
    + f", {TARGET_SQL}{W3_SQL} "
    + f"""SELECT ent.entity_id, target, {", ".join(f"coalesce({n}, 0.0) AS {n}" for n in W3_NAMES)}
FROM ent LEFT JOIN frame_w3 USING (entity_id) LEFT JOIN launch USING (entity_id)""",
    {**{n: 5 for n in W3_NAMES}, "target": 5},
)
def prelaunch_features_cutoff(spark, d):
    frame, _ = prelaunch.prelaunch_features_cutoff(_fact(spark, d), b.entity_dim(spark, d), "W-3", SPEC)
    return frame


OVERVIEW_WEEKS = [*WEEKS, "W+1", "W+2"]


@query(
    "prelaunch_overview",
    ml("views", "mentions", "aware", "s_story", "s_cast")
    + f""", o AS (SELECT entity_id, sum(value) FILTER (WHERE metric IN ('s_story', 's_cast')) AS screening_total,
  sum(value) FILTER (WHERE {TOTAL_SQL} AND week_label LIKE 'W-%') AS prelaunch_views,
  sum(value) FILTER (WHERE metric = 'mentions' AND week_label LIKE 'W-%') AS prelaunch_mentions"""
    + "".join(f", avg(value) FILTER (WHERE metric = 'aware' AND week_label = '{w}') AS \"awareness_{w}\"" for w in OVERVIEW_WEEKS)
    + """ FROM ml GROUP BY 1) SELECT ent.entity_id, coalesce(screening_total, 0.0) AS screening_total,
  coalesce(prelaunch_views, 0.0) AS prelaunch_views, coalesce(prelaunch_mentions, 0.0) AS prelaunch_mentions"""
    + "".join(f', coalesce("awareness_{w}", 0.0) AS "awareness_{w}"' for w in OVERVIEW_WEEKS)
    + " FROM ent LEFT JOIN o USING (entity_id)",
    {"prelaunch_views": 2, **{f"awareness_{w}": 6 for w in OVERVIEW_WEEKS}},
)
def prelaunch_overview(spark, d):
    fact = _fact(spark, d, ["views", "mentions", "aware", "s_story", "s_cast"])
    return prelaunch.prelaunch_overview(fact, b.entity_dim(spark, d), SPEC)


# ---- model: two features have a closed form that SQL can state ------------------------------------------------

FEATURES = ["views_total", "aware_total"]
ALPHA = 10.0


def ridge_sql(cutoff: str) -> str:
    """CTEs of the two-feature ridge of one cutoff, ending in pred_<cutoff>(entity_id, target, prediction, ...)."""
    c = cutoff.replace("-", "").lower()
    return f""", j_{c} AS (SELECT ent.entity_id, target, coalesce(views_total, 0.0) AS a, coalesce(aware_total, 0.0) AS b
  FROM ent LEFT JOIN frame_{c} USING (entity_id) LEFT JOIN launch USING (entity_id)),
s_{c} AS (SELECT count(*) AS n, avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(ln(1 + target)) AS my
  FROM j_{c} WHERE target IS NOT NULL),
z_{c} AS (SELECT (a - ma) / sa AS za, (b - mb) / sb AS zb, ln(1 + target) AS y FROM j_{c}, s_{c} WHERE target IS NOT NULL),
m_{c} AS (SELECT sum(za * zb) AS r, sum(za * y) AS p, sum(zb * y) AS q, count(*) + {ALPHA} AS k FROM z_{c}),
w_{c} AS (SELECT (k * p - r * q) / (k * k - r * r) AS wa, (k * q - r * p) / (k * k - r * r) AS wb FROM m_{c}),
pred_{c} AS (SELECT entity_id, target, (a - ma) / sa * wa AS ca, (b - mb) / sb * wb AS cb,
  greatest(exp(my + (a - ma) / sa * wa + (b - mb) / sb * wb) - 1, 0.0) AS prediction FROM j_{c}, s_{c}, w_{c})"""


def _fit(spark, d, cutoff: str):
    fact = _fact(spark, d, ["views", "aware", "buzz"])
    spec = prelaunch.PrelaunchSpec((), ("aware",), "mentions", "buzz", "rank", routing=b.ROUTING)
    frame, _ = prelaunch.prelaunch_features_cutoff(fact, b.entity_dim(spark, d), cutoff, spec)
    frame = store_rows(frame)  # read by the fit and by the predictions
    return frame, prelaunch.ridge_log_regression(frame, FEATURES, alpha=ALPHA)


RIDGE_BASE = ml(*METRICS) + f", {TARGET_SQL}{W1_SQL}{ridge_sql('W-1')} "


@query(
    "ridge_log_regression",
    RIDGE_BASE + "SELECT entity_id, target, prediction FROM pred_w1",
    {"target": 5, "prediction": 5},
)
def ridge_log_regression(spark, d):
    frame, fit = _fit(spark, d, "W-1")
    return prelaunch.ridge_predictions(frame, fit)


# All features at once have no closed form in SQL; tests check them against the normal equations.
@query("ridge_all_features")
def ridge_all_features(spark, d):
    frame, names = prelaunch.prelaunch_features_cutoff(_fact(spark, d), b.entity_dim(spark, d), "W-1", SPEC)
    frame = store_rows(frame)  # read by the fit and by the predictions
    return prelaunch.ridge_predictions(frame, prelaunch.ridge_log_regression(frame, names, alpha=ALPHA))


@query(
    "mape",
    RIDGE_BASE + "SELECT avg(abs(prediction - target) / abs(target) * 100) AS mape FROM pred_w1 WHERE target <> 0",
    {"mape": 5},
)
def mape(spark, d):
    frame, fit = _fit(spark, d, "W-1")
    return prelaunch.mape(prelaunch.ridge_predictions(frame, fit), actual="target")


@query(
    "mae",
    RIDGE_BASE + "SELECT avg(abs(prediction - target)) AS mae FROM pred_w1",
    {"mae": 5},
)
def mae(spark, d):
    frame, fit = _fit(spark, d, "W-1")
    return prelaunch.mae(prelaunch.ridge_predictions(frame, fit), actual="target")


@query(
    "linear_contributions",
    RIDGE_BASE
    + "SELECT entity_id, 'digital' AS family, ca AS contribution FROM pred_w1 UNION ALL SELECT entity_id, 'survey', cb FROM pred_w1",
    {"contribution": 7},
)
def linear_contributions(spark, d):
    frame, fit = _fit(spark, d, "W-1")
    return prelaunch.linear_contributions(frame, fit, SPEC)


@query(
    "prediction_postprocess",
    RIDGE_BASE
    + """, v AS (SELECT entity_id, count(DISTINCT week_label) FILTER (WHERE week_label LIKE 'W-%' AND metric = 'views') / 6.0 AS coverage
  FROM ml GROUP BY 1),
e AS (SELECT quantile_cont(target, 0.05) AS lo, quantile_cont(target, 0.5) AS mid, quantile_cont(target, 0.95) AS hi FROM launch)
SELECT entity_id, coverage, CASE WHEN coverage < 0.75 THEN 0.7 * least(greatest(prediction, lo), hi) + 0.3 * mid
  ELSE least(greatest(prediction, lo), hi) END AS prediction FROM pred_w1 JOIN v USING (entity_id), e""",
    {"coverage": 6, "prediction": 5},
)
def prediction_postprocess(spark, d):
    frame, fit = _fit(spark, d, "W-1")
    weeks = F.count_distinct(F.when(F.col("week_label").isin(WEEKS), F.col("week_label")))
    coverage = _fact(spark, d, ["mentions"]).groupBy("entity_id").agg((weeks / 6.0).alias("coverage"))
    predictions = prelaunch.ridge_predictions(frame, fit).join(coverage, "entity_id")
    labels = frame.where(F.col("target").isNotNull()).select(F.col("target").alias("label"))
    out = prelaunch.prediction_postprocess(predictions, labels)
    return out.select("entity_id", "coverage", "prediction")


ACCURACY_BASE = ml(*METRICS, "rank") + f", {TARGET_SQL}" + W3_SQL + W2_SQL + W1_SQL + "".join(ridge_sql(c) for c in ("W-3", "W-2", "W-1"))


@query(
    "prediction_accuracy",
    ACCURACY_BASE
    + """, rk AS (SELECT entity_id, min(value) AS rank FROM ml WHERE metric = 'rank' AND week_label = 'W+1' GROUP BY 1)
SELECT l.entity_id, l.target AS actual, rank, p3.prediction AS pred_w3, p2.prediction AS pred_w2, p1.prediction AS pred_w1,
  (p3.prediction - l.target) / abs(l.target) * 100 AS error_w3, (p2.prediction - l.target) / abs(l.target) * 100 AS error_w2,
  (p1.prediction - l.target) / abs(l.target) * 100 AS error_w1
FROM launch l LEFT JOIN rk USING (entity_id) LEFT JOIN pred_w3 p3 USING (entity_id) LEFT JOIN pred_w2 p2 USING (entity_id)
LEFT JOIN pred_w1 p1 USING (entity_id)""",
    {c: 4 for c in ("actual", "pred_w3", "pred_w2", "pred_w1", "error_w3", "error_w2", "error_w1")},
)
def prediction_accuracy(spark, d):
    predictions = {}
    for cutoff in ("W-3", "W-2", "W-1"):
        frame, fit = _fit(spark, d, cutoff)
        predictions[cutoff.replace("-", "").lower()] = prelaunch.ridge_predictions(frame, fit)
    actuals = prelaunch.launch_scores(_fact(spark, d, ["buzz"]), SPEC).withColumnRenamed("target", "actual")
    ranks = _fact(spark, d, ["rank"]).where(F.col("week_label") == "W+1")
    ranks = ranks.groupBy("entity_id").agg(F.min("value").alias("rank"))
    return prelaunch.prediction_accuracy(actuals, ranks, predictions)


@query(
    "nearest_by_score",
    RIDGE_BASE
    + f"""SELECT l.entity_id, l.target AS actual, abs(l.target - p.prediction) AS gap FROM launch l, pred_w1 p
WHERE p.entity_id = {TARGET} AND l.entity_id <> {TARGET} ORDER BY gap, l.target DESC, l.entity_id LIMIT 5""",
    {"actual": 5, "gap": 4},
)
def nearest_by_score(spark, d):
    frame, fit = _fit(spark, d, "W-1")
    actuals = frame.where(F.col("target").isNotNull()).select("entity_id", F.col("target").alias("actual"))
    return compare.nearest_by_score(actuals, TARGET, prelaunch.ridge_predictions(frame, fit))
