"""Pre-launch features, the log-target ridge model and its evaluation."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from audira.functions import text
from audira.functions.grades import order_in
from audira.operators import ordering
from audira.operators.kpi import ENTITY, VALUE, view_rows
from audira.session import store_rows
from audira.specs import LAUNCH_WEEKS, PRELAUNCH_WEEKS, ViewRouting


@dataclass(frozen=True)
class PrelaunchSpec:
    """Metric names of the pre-launch data."""

    screening: tuple[str, ...] = (
        "시사지표_장르",
        "시사지표_캐릭터",
        "시사지표_전개",
        "시사지표_공감",
        "시사지표_개연성",
        "시사지표_대사",
        "시사지표_연출",
    )
    surveys: tuple[str, ...] = ("MPI_인지", "MPI_선호", "MPI_시청의향")
    mentions: str = "언급량"
    score: str = "F_Score"
    rank: str = "F_Total"
    weeks: tuple[str, ...] = PRELAUNCH_WEEKS
    launch_weeks: tuple[str, ...] = LAUNCH_WEEKS
    routing: ViewRouting = field(default_factory=ViewRouting)


SPEC = PrelaunchSpec()


def launch_target_week(df: DataFrame, spec: PrelaunchSpec = SPEC) -> DataFrame:
    """One row: the first launch label that score rows use; else their greatest label; else the first candidate."""
    return _target_week(df.where((F.col("metric") == spec.score) & F.col("week_label").isNotNull()), spec)


def _target_week(rows: DataFrame, spec: PrelaunchSpec) -> DataFrame:
    place = order_in("week_label", list(spec.launch_weeks))
    known = F.min_by(F.when(place.isNotNull(), F.col("week_label")), place)
    return rows.agg(F.coalesce(known, F.max("week_label"), F.lit(spec.launch_weeks[0])).alias("target_week"))


def launch_scores(df: DataFrame, spec: PrelaunchSpec = SPEC) -> DataFrame:
    """Mean score of each entity in the launch week."""
    rows = df.where(F.col("metric") == spec.score)
    kept = rows.where(F.col("week_label") == launch_target_week(df, spec).scalar())
    return kept.groupBy(ENTITY).agg(F.avg(VALUE).alias("target"))


def launch_week_actual(df: DataFrame, order: str, spec: PrelaunchSpec = SPEC) -> DataFrame:
    """Last known launch-week score of each entity, by an explicit order column."""
    week = launch_target_week(df, spec).select(text.normalize_week_label("target_week")).scalar()
    rows = df.where((F.col("metric") == spec.score) & F.col(VALUE).isNotNull())
    kept = rows.where(text.normalize_week_label("week_label") == week)
    return kept.groupBy(ENTITY).agg(F.max_by(VALUE, F.struct(order, VALUE)).alias("actual"))


def has_week_data(df: DataFrame, spec: PrelaunchSpec = SPEC, weeks: tuple[str, ...] = ("W-1", "W-2", "W-3")) -> DataFrame:
    """Entities with views, mentions and survey rows in a week, and the latest such week."""
    norm = text.normalize_week_label("week_label")
    views = F.coalesce(view_rows("total", spec.routing), F.lit(False))
    flags = (
        df.where(norm.isin(list(weeks)))
        .groupBy(ENTITY, norm.alias("week"))
        .agg(
            F.bool_or(views).alias("_v"),
            F.bool_or(F.col("metric") == spec.mentions).alias("_b"),
            F.bool_or(F.col("metric").isin(list(spec.surveys))).alias("_s"),
        )
    )
    ready = flags.where(F.col("_v") & F.col("_b") & F.col("_s"))
    return ready.groupBy(ENTITY).agg(
        F.min_by("week", order_in("week", list(weeks))).alias("chosen_week"), F.count("*").alias("ready_weeks")
    )


def _week_cells(df: DataFrame, spec: PrelaunchSpec, weeks: list[str]) -> DataFrame:
    """(entity_id, week_label) with sum (_s) and count (_n) of each series and of the score, and the number of score rows.

    The one scan of the fact, stored: features, launch week and launch scores all come from it. A row of the fact touches
    one narrow cell, so little is shuffled. Rows outside the weeks are dropped first, and each row names its series once.
    """
    named = F.when(F.col("metric") == spec.mentions, F.lit("mentions"))
    named = named.when(view_rows("total", spec.routing), F.lit("views"))
    named = named.when(F.col("metric").isin([*spec.surveys, *spec.screening]), F.col("metric"))
    scored = (F.col("metric") == spec.score) & F.col("week_label").isNotNull()
    wanted = [*spec.surveys, spec.mentions, spec.routing.metric]
    timely = F.col("metric").isin(wanted) & F.col("week_label").isin(weeks)
    series = F.col(ENTITY).isNotNull() & (timely | F.col("metric").isin(list(spec.screening)))
    aggs = [F.count_if(scored).alias("_rows")]
    chosen = {m: series & (F.col("_series") == m) for m in (*spec.surveys, "views", "mentions", *spec.screening)}
    for name, rows in {**chosen, "score": scored}.items():
        value = F.when(rows, F.col(VALUE))
        aggs += [F.sum(value).alias(f"_s_{name}"), F.count(value).alias(f"_n_{name}")]
    return store_rows(df.where(series | scored).withColumn("_series", named).groupBy(ENTITY, "week_label").agg(*aggs))


def _weekly(df: DataFrame, spec: PrelaunchSpec, weeks: list[str]) -> tuple[DataFrame, dict[str, list[str]]]:
    """Wide weekly frame per entity: survey means, view and mention sums, screening means, and the launch score as target."""
    cells = _week_cells(df, spec, weeks)
    series: dict[str, list[str]] = {}
    aggs: list[Column] = []

    def mean(name: str, rows: Column) -> Column:
        return F.try_divide(F.sum(F.when(rows, F.col(f"_s_{name}"))), F.sum(F.when(rows, F.col(f"_n_{name}"))))

    def total(name: str, rows: Column) -> Column:
        return F.sum(F.when(rows, F.col(f"_s_{name}")))

    for name, how in {**dict.fromkeys(spec.surveys, mean), "views": total, "mentions": total}.items():
        series[name] = []
        for i, week in enumerate(weeks):
            column = f"_{name}_{i}"
            aggs.append(F.coalesce(how(name, F.col("week_label") == week), F.lit(0.0)).alias(column))
            series[name].append(column)
    for m in spec.screening:
        aggs.append(F.coalesce(mean(m, F.lit(True)), F.lit(0.0)).alias(m))
    launch = _target_week(cells.where("_rows > 0"), spec).scalar()
    aggs.append(mean("score", F.col("week_label") == launch).alias("target"))
    # Cells meet before they are spread over columns.
    return cells.where(F.col(ENTITY).isNotNull()).repartition(ENTITY).groupBy(ENTITY).agg(*aggs), series


def _total(columns: list[str]) -> Column:
    out = F.lit(0.0)
    for c in columns:
        out = out + F.col(c)
    return out


def prelaunch_features_full(df: DataFrame, entities: DataFrame, spec: PrelaunchSpec = SPEC) -> tuple[DataFrame, list[str]]:
    """Features of every entity on the fixed week frame (a missing week is 0), with the launch score as target."""
    weeks = list(spec.weeks)
    wide, series = _weekly(df, spec, weeks)
    n = len(weeks)
    middle = (n - 1) / 2
    spread = sum((i - middle) ** 2 for i in range(n))
    features: dict[str, Column] = {m: F.col(m) for m in spec.screening}
    for m in spec.surveys:
        c = series[m]
        slope = F.lit(0.0)
        for i, name in enumerate(c):
            slope = slope + F.col(name) * ((i - middle) / spread)
        features[f"{m}_level"] = F.col(c[-1])
        features[f"{m}_mean"] = _total(c) / n
        features[f"{m}_momentum"] = F.col(c[-1]) - F.col(c[-3])
        features[f"{m}_slope"] = slope
    for m in ("views", "mentions"):
        c = series[m]
        features[f"log_{m}_sum"] = text.log1p_clip(_total(c))
        features[f"log_{m}_level"] = text.log1p_clip(F.col(c[-1]))
        features[f"slog_{m}_momentum"] = text.signed_log(F.col(c[-1]) - F.col(c[-3]))
        covered = F.lit(0)
        for name in c:
            covered = covered + (F.col(name) > 0).cast("int")
        features[f"{m}_coverage"] = covered / F.lit(float(n))
    frame = wide.select(ENTITY, *[v.alias(k) for k, v in features.items()], "target")
    names = list(features)
    return entities.select(ENTITY).join(frame, ENTITY, "left").fillna(0.0, subset=names), names


def prelaunch_features_cutoff(
    df: DataFrame,
    entities: DataFrame,
    cutoff: str,
    spec: PrelaunchSpec = SPEC,
    include_survey: bool = True,
) -> tuple[DataFrame, list[str]]:
    """Features up to one cutoff week: total, last, momentum and trend of each series; counts on a log scale.

    Repeated rows of a week are summed for counts and averaged for surveys.
    """
    weeks = list(spec.weeks)[: spec.weeks.index(cutoff) + 1]
    wide, series = _weekly(df, spec, weeks)
    features: dict[str, Column] = {m: F.col(m) for m in spec.screening} if include_survey else {}
    for m, c in series.items():
        total, last = _total(c), F.col(c[-1])
        momentum = last - F.col(c[-3] if len(c) >= 3 else c[0])
        trend = (last - F.col(c[0])) / (len(c) - 1) if len(c) >= 2 else F.lit(0.0)
        counts = m in ("views", "mentions")
        features[f"{m}_total"] = F.log1p(total) if counts else total
        features[f"{m}_last"] = F.log1p(last) if counts else last
        features[f"{m}_momentum"] = text.signed_log(momentum) if counts else momentum
        features[f"{m}_trend"] = trend
    frame = wide.select(ENTITY, *[v.alias(k) for k, v in features.items()], "target")
    names = list(features)
    return entities.select(ENTITY).join(frame, ENTITY, "left").fillna(0.0, subset=names), names


def prelaunch_overview(
    df: DataFrame, entities: DataFrame, spec: PrelaunchSpec = SPEC, after: tuple[str, ...] = ("W+1", "W+2")
) -> DataFrame:
    """Per entity: screening total, pre-launch views and mentions, first survey by week; missing as 0. One scan."""
    weeks = F.col("week_label").isin(list(spec.weeks))
    views = F.coalesce(view_rows("total", spec.routing), F.lit(False))
    aggs = {
        "screening_total": F.sum(F.when(F.col("metric").isin(list(spec.screening)), F.col(VALUE))),
        "prelaunch_views": F.sum(F.when(views & weeks, F.col(VALUE))),
        "prelaunch_mentions": F.sum(F.when((F.col("metric") == spec.mentions) & weeks, F.col(VALUE))),
    }
    first = spec.surveys[0]
    for w in (*spec.weeks, *after):
        aggs[f"awareness_{w}"] = F.avg(F.when((F.col("metric") == first) & (F.col("week_label") == w), F.col(VALUE)))
    timely = F.col("metric").isin(first, spec.mentions, spec.routing.metric) & F.col("week_label").isin(*spec.weeks, *after)
    wanted = timely | F.col("metric").isin(list(spec.screening))
    wide = df.where(wanted).groupBy(ENTITY).agg(*[a.alias(n) for n, a in aggs.items()])
    return entities.select(ENTITY).join(wide, ENTITY, "left").fillna(0.0, subset=list(aggs))


# ---- model ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class RidgeFit:
    """A fitted ridge on standardised features and the log of the target."""

    features: list[str]
    means: list[float]
    scales: list[float]
    coefficients: list[float]
    intercept: float
    rows: int

    def scaled(self, i: int) -> Column:
        x = F.coalesce(F.col(self.features[i]), F.lit(0.0))
        return (x - self.means[i]) / self.scales[i] if self.scales[i] else F.lit(0.0)

    def log_prediction(self) -> Column:
        out = F.lit(self.intercept)
        for i, c in enumerate(self.coefficients):
            out = out + self.scaled(i) * c
        return out

    def prediction(self) -> Column:
        return F.greatest(F.expm1(self.log_prediction()), F.lit(0.0))


def ridge_log_regression(
    frame: DataFrame, features: list[str], target: str = "target", alpha: float = 10.0, min_rows: int = 12
) -> RidgeFit | None:
    """Fit log1p(target) by ridge on features with mean 0 and population deviation 1; None below ``min_rows``.

    Spark scales the label inside, so the penalty that equals ``alpha * |w|^2`` is alpha * std(label) / n.
    """
    rows = frame.where(F.col(target).isNotNull()).select(
        *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features],
        F.log1p(F.greatest(F.col(target), F.lit(0.0))).alias("_y"),
    )
    # Read twice: once for the moments and once for the fit.
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _fit_ridge(rows, features, alpha, min_rows)
    finally:
        rows.unpersist()


def _fit_ridge(rows: DataFrame, features: list[str], alpha: float, min_rows: int) -> RidgeFit | None:
    aggs = [F.count("*").alias("_n"), F.avg("_y").alias("_my"), F.stddev_pop("_y").alias("_sy")]
    for i, f in enumerate(features):
        aggs += [F.avg(f).alias(f"_m{i}"), F.stddev_pop(f).alias(f"_s{i}")]
    stats = rows.agg(*aggs).first()
    n = int(stats["_n"])
    if n < min_rows:
        return None
    means = [float(stats[f"_m{i}"]) for i in range(len(features))]
    scales = [float(stats[f"_s{i}"]) for i in range(len(features))]
    scales = [s if s > 1e-12 * max(1.0, abs(m)) else 0.0 for s, m in zip(scales, means, strict=True)]
    # A constant feature has no say, and would make the equations singular.
    used = [i for i, s in enumerate(scales) if s]
    if not stats["_sy"] or not used:
        return RidgeFit(features, means, scales, [0.0] * len(features), float(stats["_my"]), n)
    z = [((F.col(features[i]) - means[i]) / scales[i]).alias(f"z{i}") for i in used]
    assembler = VectorAssembler(inputCols=[f"z{i}" for i in used], outputCol="_z")
    vectors = assembler.transform(rows.select("_y", *z))
    model = LinearRegression(
        featuresCol="_z",
        labelCol="_y",
        regParam=alpha * float(stats["_sy"]) / n,
        elasticNetParam=0.0,
        standardization=False,
        solver="normal",
    ).fit(vectors)
    fitted = dict(zip(used, (float(c) for c in model.coefficients), strict=True))
    coefficients = [fitted.get(i, 0.0) for i in range(len(features))]
    return RidgeFit(features, means, scales, coefficients, float(model.intercept), n)


def ridge_predictions(frame: DataFrame, fit: RidgeFit | None, target: str = "target") -> DataFrame:
    """Prediction of every entity; null without a model."""
    value = fit.prediction() if fit is not None else F.lit(None).cast("double")
    return frame.select(ENTITY, target, value.alias("prediction"))


def prediction_postprocess(
    predictions: DataFrame, labels: DataFrame, low: float = 0.05, high: float = 0.95, coverage: str = "coverage"
) -> DataFrame:
    """Clip to the labels' 5th and 95th percentile; below 75 percent coverage pull 30 percent to the median."""
    ends = ordering.exact_quantiles(labels, "label", {"_lo": low, "_mid": 0.5, "_hi": high})
    out = ordering.with_scalars(predictions, ends)
    clipped = F.least(F.greatest(F.col("prediction"), F.col("_lo")), F.col("_hi"))
    pulled = F.when(F.col(coverage) < 0.75, 0.7 * clipped + 0.3 * F.col("_mid")).otherwise(clipped)
    return out.withColumn("prediction", pulled).drop("_lo", "_mid", "_hi")


def feature_family(name: str, spec: PrelaunchSpec = SPEC) -> str:
    """Family of a feature: screening, survey, digital or adjustment."""
    if name in spec.screening:
        return "screening"
    if any(name.startswith(f"{m}_") for m in spec.surveys):
        return "survey"
    return "adjustment" if name.endswith("_coverage") else "digital"


def linear_contributions(frame: DataFrame, fit: RidgeFit, spec: PrelaunchSpec = SPEC) -> DataFrame:
    """Per entity the contribution (coefficient x scaled feature) of each family."""
    parts = [
        F.struct(F.lit(feature_family(f, spec)).alias("family"), (fit.scaled(i) * fit.coefficients[i]).alias("c"))
        for i, f in enumerate(fit.features)
    ]
    long = frame.select(ENTITY, F.inline(F.array(*parts)))
    return long.groupBy(ENTITY, "family").agg(F.sum("c").alias("contribution"))


def signed_error(prediction: Column, actual: Column) -> Column:
    """Signed error in percent, null for an actual of 0."""
    return F.try_divide((prediction - actual) * 100, F.abs(actual))


def mape(df: DataFrame, groups: Iterable[str] = (), prediction: str = "prediction", actual: str = "actual") -> DataFrame:
    error = F.try_divide(F.abs(F.col(prediction) - F.col(actual)) * 100, F.abs(F.col(actual)))
    return df.groupBy(*groups).agg(F.avg(error).alias("mape"))


def mae(df: DataFrame, groups: Iterable[str] = (), prediction: str = "prediction", actual: str = "actual") -> DataFrame:
    return df.groupBy(*groups).agg(F.avg(F.abs(F.col(prediction) - F.col(actual))).alias("mae"))


def prediction_accuracy(actuals: DataFrame, ranks: DataFrame, predictions: dict[str, DataFrame]) -> DataFrame:
    """Actual, rank and each cutoff's prediction with its signed error.

    ``actuals`` has (entity_id, actual), ``ranks`` (entity_id, rank), each prediction (entity_id, prediction).
    """
    out = actuals.where(F.col("actual").isNotNull()).join(ranks.select(ENTITY, "rank"), ENTITY, "left")
    for name, df in predictions.items():
        out = out.join(df.select(ENTITY, F.col("prediction").alias(f"pred_{name}")), ENTITY, "left")
        out = out.withColumn(f"error_{name}", signed_error(F.col(f"pred_{name}"), F.col("actual")))
    return out
