"""KPI aggregation over the long metric table.

Rows carry (entity_id, step_no, week_no, media, metric, value, ...). Zero means missing unless stated. Per-entity
values come from two-level aggregates: map-side partial sums keep a hot entity small before either shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from audira.functions import segments, text
from audira.functions.segments import SEGMENTS, SegmentSpec
from audira.operators import ordering
from audira.specs import AnchorRule, MetricSpec, ViewRouting

ENTITY = "entity_id"
STEP = "step_no"
VALUE = "value"


def present(value: Column | str = VALUE) -> Column:
    """The value, or null when it is zero or not a number."""
    v = text.col(value)
    return F.when((v != 0) & ~F.isnan(v), v)


def zero_is_missing(df: DataFrame, value: str = VALUE) -> DataFrame:
    v = F.col(value)
    return df.where(v.isNotNull() & ~F.isnan(v) & (v != 0))


# ---- filters -------------------------------------------------------------------------------------------------


def filter_slot_year_month(
    df: DataFrame,
    slots: Iterable[str] = (),
    years: Iterable = (),
    months: Iterable[int] = (),
    date_column: str = "start_date",
) -> DataFrame:
    """Multi-value filters; an empty list filters nothing."""
    for column, chosen in ((F.col("slot"), slots), (F.col("year"), years), (F.month(date_column), months)):
        chosen = list(chosen)
        if chosen:
            df = df.where(column.isin(chosen))
    return df


def view_rows(kind: str = "total", routing: ViewRouting = ViewRouting()) -> Column:
    """Predicate of the view rows of one title type; null attributes never match."""
    title = F.trim(F.coalesce("attr3", F.lit("")))
    restricted = F.coalesce(F.col("media") == routing.restricted_media, F.lit(False))
    allowed = F.coalesce(F.col("attr1").isin(list(routing.allowed_attr1)), F.lit(False))
    local = (title == routing.local_title) & (~restricted | allowed)
    foreign = title == routing.foreign_title
    rows = {"local": local, "foreign": foreign, "total": local | foreign}[kind]
    return (F.col("metric") == routing.metric) & rows


def route_view_rows(df: DataFrame, kind: str = "total", routing: ViewRouting = ViewRouting()) -> DataFrame:
    """View rows of a title type; without the title-type column there is nothing to route."""
    if "attr3" not in df.columns:
        return df.where(F.lit(False))
    return df.where(view_rows(kind, routing))


def filter_metric_normalized(df: DataFrame, name: str) -> DataFrame:
    """Metric match that ignores case and punctuation."""
    return df.where(text.normalize_text("metric") == text.normalize_text(F.lit(name)))


def step_cap_filter(df: DataFrame, cap: float | None) -> DataFrame:
    return df if cap is None else df.where(F.col(STEP) <= cap)


def prelaunch_week_filter(df: DataFrame, weeks: Iterable[str], cutoff: str) -> DataFrame:
    """Rows whose label is among the ordered weeks up to the cutoff."""
    ordered = list(weeks)
    return df.where(F.col("week_label").isin(ordered[: ordered.index(cutoff) + 1]))


def step_options(df: DataFrame) -> DataFrame:
    """Distinct positive steps; the greatest is marked final. Steps are few, entities do not matter."""
    steps = df.where(F.col(STEP) > 0).groupBy(STEP).agg(F.lit(1).alias("_one")).drop("_one")
    return steps.select(STEP, (F.col(STEP) == steps.agg(F.max(STEP)).scalar()).alias("is_final"))


def aired_entities(df: DataFrame, rating_metric: str) -> DataFrame:
    """Entities with any rating above zero."""
    return df.where((F.col("metric") == rating_metric) & (F.col(VALUE) > 0)).select(ENTITY).distinct()


# ---- KPI types -----------------------------------------------------------------------------------------------


def metric_is(spec: MetricSpec) -> Column:
    if spec.normalized:
        return text.normalize_text("metric") == text.normalize_text(F.lit(spec.metric))
    return F.col("metric") == spec.metric


def row_filter(spec: MetricSpec, routing: ViewRouting = ViewRouting()) -> Column:
    rows = view_rows(spec.views, routing) if spec.views else metric_is(spec)
    return rows & F.col("media").isin(list(spec.media)) if spec.media else rows


def entity_step_mean(df: DataFrame, how: str = "mean", keys: tuple[str, ...] = (ENTITY,)) -> DataFrame:
    """Mean or sum per entity and step, then the mean per entity. Zero is missing."""
    step = F.avg(VALUE) if how == "mean" else F.sum(VALUE)
    rows = zero_is_missing(df).where(F.col(STEP).isNotNull() & F.col(ENTITY).isNotNull())
    return rows.groupBy(*keys, STEP).agg(step.alias("_s")).groupBy(*keys).agg(F.avg("_s").alias(VALUE))


def entity_sum(df: DataFrame, keys: tuple[str, ...] = (ENTITY,)) -> DataFrame:
    rows = zero_is_missing(df).where(F.col(ENTITY).isNotNull())
    return rows.groupBy(*keys).agg(F.sum(VALUE).alias(VALUE))


def mean_over_entities(per_entity: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    return per_entity.groupBy(*groups).agg(F.avg(VALUE).alias(VALUE), F.count(VALUE).alias("n_entities"))


def entity_sum_mean(df: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """Sum per entity, then the mean over entities."""
    return mean_over_entities(entity_sum(df, (*groups, ENTITY)), groups)


def entity_metric_series(
    df: DataFrame, spec: MetricSpec, routing: ViewRouting = ViewRouting(), step_free: bool = False
) -> DataFrame:
    """Value per entity in the spec's mode. ``step_free`` metrics (external ranks) need no step."""
    if spec.mode == "vod":
        return vod_combined_on_valid_steps(df, spec)
    rows = zero_is_missing(df.where(row_filter(spec, routing)))
    if not step_free:
        rows = rows.where(F.col(STEP).isNotNull())
    if spec.mode in ("mean", "step_sum") and not step_free:
        return entity_step_mean(rows, "mean" if spec.mode == "mean" else "sum")
    how = {"sum": F.sum, "min": F.min}.get(spec.mode, F.avg)
    return rows.groupBy(ENTITY).agg(how(VALUE).alias(VALUE))


def vod_combined_on_valid_steps(df: DataFrame, spec: MetricSpec) -> DataFrame:
    """Sum of both media on the steps where the first one has data, then the mean per entity. One pass."""
    lead = spec.media[0]
    rows = zero_is_missing(df.where(row_filter(spec))).where(F.col(STEP).isNotNull())
    per_step = rows.groupBy(ENTITY, STEP).agg(
        F.sum(VALUE).alias("_s"), F.count_if(F.col("media") == lead).alias("_lead")
    )
    return per_step.where(F.col("_lead") > 0).groupBy(ENTITY).agg(F.avg("_s").alias(VALUE))


def metric_min(df: DataFrame, name: str) -> DataFrame:
    """Least value of a metric per entity, zeros included."""
    rows = filter_metric_normalized(df, name).where(F.col(VALUE).isNotNull())
    return rows.groupBy(ENTITY).agg(F.min(VALUE).alias(VALUE))


def rating_like_mean(df: DataFrame, name: str) -> DataFrame:
    """Per entity the mean of step means, zeros included; without steps by year, else flat."""
    rows = filter_metric_normalized(df, name).where(F.col(VALUE).isNotNull())
    per_key = rows.groupBy(ENTITY, STEP, "year").agg(F.sum(VALUE).alias("_s"), F.count(VALUE).alias("_c"))

    def two_level(key: str) -> DataFrame:
        return (
            per_key.where(F.col(key).isNotNull())
            .groupBy(ENTITY, key)
            .agg((F.sum("_s") / F.sum("_c")).alias("_m"))
            .groupBy(ENTITY)
            .agg(F.avg("_m").alias(f"_{key}"))
        )

    flat = per_key.groupBy(ENTITY).agg((F.sum("_s") / F.sum("_c")).alias("_flat"))
    out = flat.join(two_level(STEP), ENTITY, "left").join(two_level("year"), ENTITY, "left")
    return out.select(ENTITY, F.coalesce(f"_{STEP}", "_year", "_flat").alias(VALUE))


def group_rating_like_mean(df: DataFrame, name: str, groups: DataFrame, group: str) -> DataFrame:
    """Per group the mean over steps of the mean of all its rows at the step, zeros included."""
    rows = filter_metric_normalized(df, name).where(F.col(VALUE).isNotNull() & F.col(STEP).isNotNull())
    sums = rows.groupBy(ENTITY, STEP).agg(F.sum(VALUE).alias("_s"), F.count(VALUE).alias("_n"))
    steps = sums.join(groups.select(ENTITY, group), ENTITY).groupBy(group, STEP)
    return steps.agg((F.sum("_s") / F.sum("_n")).alias("_m")).groupBy(group).agg(F.avg("_m").alias(VALUE))


def entity_weekly_avg(df: DataFrame, week_column: str = "week_start") -> DataFrame:
    """Sum per entity and week, then the mean per entity. Zero is missing."""
    rows = zero_is_missing(df).where(F.col(week_column).isNotNull() & F.col(ENTITY).isNotNull())
    weekly = rows.groupBy(ENTITY, week_column).agg(F.sum(VALUE).alias("_s"))
    return weekly.groupBy(ENTITY).agg(F.avg("_s").alias(VALUE))


def total_views_weekly_avg(
    df: DataFrame, routing: ViewRouting = ViewRouting(), week_column: str = "week_start"
) -> DataFrame:
    """Weekly views of both title types, then the mean per entity; one routed scan adds them up."""
    return entity_weekly_avg(route_view_rows(df, "total", routing), week_column)


def series_add_fill(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = (ENTITY,)) -> DataFrame:
    """Sum of two keyed series; a key missing on one side counts as 0 there."""
    both = left.select(*keys, VALUE).unionByName(right.select(*keys, VALUE))
    return both.where(F.col(VALUE).isNotNull()).groupBy(*keys).agg(F.sum(VALUE).alias(VALUE))


def kpi_table(
    df: DataFrame,
    specs: Iterable[MetricSpec],
    routing: ViewRouting = ViewRouting(),
    keys: tuple[str, ...] = (ENTITY,),
) -> DataFrame:
    """All KPIs of all entities in one scan and two aggregates: per (entity, step), then per entity."""
    specs = list(specs)
    metrics = {routing.metric if s.views else s.metric for s in specs if s.views or not s.normalized}
    wanted = F.col("metric").isin(sorted(metrics))
    for s in specs:
        wanted = wanted | metric_is(s) if s.normalized else wanted
    rows = df.where(wanted & F.col(ENTITY).isNotNull())
    first, second = [], []
    for s in specs:
        chosen = row_filter(s, routing)
        value = F.col(VALUE) if s.keep_zero else present()
        picked = F.when(chosen, value)
        stepped = F.col(STEP).isNotNull()
        name, helper = f"_{s.kpi}", f"_{s.kpi}_n"
        if s.mode == "mean":
            first.append(F.avg(picked).alias(name))
            second.append(F.avg(F.when(stepped, F.col(name))).alias(s.kpi))
        elif s.mode == "step_sum":
            first.append(F.sum(picked).alias(name))
            second.append(F.avg(F.when(stepped, F.col(name))).alias(s.kpi))
        elif s.mode == "vod":
            first.append(F.sum(picked).alias(name))
            lead = F.when(chosen & (F.col("media") == s.media[0]), value)
            first.append(F.count(lead).alias(helper))
            second.append(F.avg(F.when(stepped & (F.col(helper) > 0), F.col(name))).alias(s.kpi))
        elif s.mode == "sum":
            first.append(F.sum(picked).alias(name))
            second.append(F.sum(name).alias(s.kpi))
        elif s.mode == "min":
            first.append(F.min(picked).alias(name))
            second.append(F.min(name).alias(s.kpi))
        else:
            first += [F.sum(picked).alias(name), F.count(picked).alias(helper)]
            second.append((F.sum(name) / F.when(F.sum(helper) > 0, F.sum(helper))).alias(s.kpi))
    return rows.groupBy(*keys, STEP).agg(*first).groupBy(*keys).agg(*second)


def stepped_kpis(
    df: DataFrame, specs: Iterable[MetricSpec], cap: float | None = None, routing: ViewRouting = ViewRouting()
) -> DataFrame:
    """(entity_id, kpi, value) over rows that belong to a step, up to an optional cap: the base of percentiles."""
    specs = list(specs)
    rows = step_cap_filter(df.where(F.col(STEP).isNotNull()), cap)
    return kpi_long(kpi_table(rows, specs, routing), [s.kpi for s in specs])


def kpi_long(table: DataFrame, kpis: Iterable[str], keys: tuple[str, ...] = (ENTITY,)) -> DataFrame:
    """Wide KPI table to (keys, kpi, value), known values only."""
    return ordering.long_form(table, list(keys), list(kpis), "kpi", VALUE).where(F.col(VALUE).isNotNull())


def overview_performance(
    df: DataFrame,
    entities: DataFrame,
    specs: Iterable[MetricSpec],
    routing: ViewRouting = ViewRouting(),
) -> DataFrame:
    """One row per entity with every KPI, missing as 0. One scan of the fact."""
    specs = list(specs)
    table = entities.select(ENTITY).distinct().join(kpi_table(df, specs, routing), ENTITY, "left")
    return table.select(ENTITY, *[F.coalesce(s.kpi, F.lit(0.0)).alias(s.kpi) for s in specs])


def grouped_kpis(
    df: DataFrame,
    specs: Iterable[MetricSpec],
    groups: DataFrame,
    group: str,
    routing: ViewRouting = ViewRouting(),
    known_only: bool = True,
) -> DataFrame:
    """(entity_id, group, kpi, value); the entity's group is joined to the aggregated side."""
    specs = list(specs)
    table = kpi_table(df, specs, routing).join(groups.select(ENTITY, group), ENTITY)
    long = ordering.long_form(table, [group, ENTITY], [s.kpi for s in specs], "kpi", VALUE)
    return long.where(F.col(VALUE).isNotNull()) if known_only else long


def kpi_bundle(
    df: DataFrame, specs: Iterable[MetricSpec], groups: DataFrame, group: str, routing: ViewRouting = ViewRouting()
) -> DataFrame:
    """KPIs of each entity beside its group's mean, with the relative difference.

    ``groups`` has the group of each entity. A missing KPI stays null and counts as 0 in the difference.
    """
    long = ordering.settle(grouped_kpis(df, specs, groups, group, routing, known_only=False))
    out = ordering.with_group_values(long, [group, "kpi"], {"group_value": F.avg(VALUE)})
    delta = F.try_divide(F.coalesce(VALUE, F.lit(0.0)) - F.col("group_value"), F.col("group_value"))
    return out.select(ENTITY, group, "kpi", VALUE, "group_value", delta.alias("delta"))


# ---- overview counts -----------------------------------------------------------------------------------------


def count_best_rank_one(df: DataFrame, metric: str) -> DataFrame:
    """Number of entities whose best rank is 1."""
    best = df.where(F.col("metric") == metric).groupBy(ENTITY).agg(F.min(VALUE).alias("_best"))
    return best.agg(F.count_if(F.col("_best") == 1).alias("n_entities"))


def anchor_entities(df: DataFrame, rating_metric: str, rule: AnchorRule = AnchorRule()) -> DataFrame:
    """Entities whose mean rating reaches the floor of their slot and year. Zeros count, as in the source."""
    from audira.functions.dates import normalize_year

    rows = df.where(F.col("metric") == rating_metric).withColumn("year_no", normalize_year("year", rule.last_old_year))
    means = rows.groupBy(ENTITY, "slot", "year_no").agg(F.avg(VALUE).alias(VALUE))
    floor = F.lit(None).cast("double")
    for slots, old in ((rule.old, True), (rule.new, False)):
        era = F.col("year_no") <= rule.last_old_year if old else F.col("year_no") > rule.last_old_year
        for slot, least in slots.items():
            floor = F.when(era & (F.col("slot") == slot), F.lit(float(least))).otherwise(floor)
    kept = means.where(F.col(VALUE) >= floor)
    return kept.where(~F.col(ENTITY).isin(list(rule.excluded))) if rule.excluded else kept


def top3_appearances(df: DataFrame, metric: str, places: int = 3) -> DataFrame:
    """Rank rows within the first places: per entity, and in total. A rank of 0 means missing and is left out."""
    hits = df.where((F.col("metric") == metric) & (F.col(VALUE) > 0) & (F.col(VALUE) <= places))
    per_entity = hits.groupBy(ENTITY).agg(F.count("*").alias("appearances"))
    return per_entity.withColumn("total", per_entity.agg(F.sum("appearances")).scalar())


# ---- trends and pivots ---------------------------------------------------------------------------------------


def weekly_media_trend(df: DataFrame, metric: str, media: list[str], week: str = "week_start") -> DataFrame:
    """Weekly sums of fixed media on the union of their weeks, 0-filled, in long form."""
    rows = df.where((F.col("metric") == metric) & F.col("media").isin(media) & F.col(week).isNotNull())
    wide = rows.groupBy(week).pivot("media", media).agg(F.sum(VALUE)).fillna(0.0, subset=media)
    return wide.unpivot([week], media, "media", VALUE)


def step_rating_trend(df: DataFrame, metrics: list[str], cap: float | None = None) -> DataFrame:
    """Mean value per step of each metric, zeros included."""
    rows = step_cap_filter(df.where(F.col("metric").isin(metrics) & F.col(STEP).isNotNull()), cap)
    return rows.groupBy(STEP).agg(*[F.avg(F.when(F.col("metric") == m, F.col(VALUE))).alias(m) for m in metrics])


def step_media_pivot(df: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Step x renamed media sums. ``columns`` maps a name to (metric, media)."""
    tests = {name: (F.col("metric") == m) & (F.col("media") == md) for name, (m, md) in columns.items()}
    any_row = reduce(lambda a, b: a | b, tests.values())
    rows = df.where(any_row & F.col(STEP).isNotNull())
    sums = [F.coalesce(F.sum(F.when(t, F.col(VALUE))), F.lit(0.0)).alias(n) for n, t in tests.items()]
    return rows.groupBy(STEP).agg(*sums)


def week_media_pivot(df: DataFrame, media: list[str], week: str = "week_label") -> DataFrame:
    """Week x media sums with a row total, for rows already filtered to one metric."""
    rows = df.where(F.col(week).isNotNull())
    wide = rows.groupBy(week).pivot("media", media).agg(F.sum(VALUE)).fillna(0.0, subset=media)
    return wide.withColumn("total", reduce(lambda a, b: a + b, [F.col(m) for m in media]))


def weekly_best_rank(df: DataFrame, name: str, keys: tuple[str, ...] = ("week_label",)) -> DataFrame:
    """Best rank per week; a rank of 0 is missing."""
    rows = zero_is_missing(filter_metric_normalized(df, name)).where(F.col(keys[-1]).isNotNull())
    return rows.groupBy(*keys).agg(F.min(VALUE).alias("best_rank"))


def score_with_rank(
    df: DataFrame, score: str, rank: str, keys: tuple[str, ...] = ("week_label",)
) -> DataFrame:
    """Weekly mean score with the weekly best rank, for weeks that have a score. One aggregate."""
    norm = text.normalize_text("metric")
    is_score = norm == text.normalize_text(F.lit(score))
    is_rank = norm == text.normalize_text(F.lit(rank))
    rows = df.where((is_score | is_rank) & F.col(keys[-1]).isNotNull())
    out = rows.groupBy(*keys).agg(
        F.avg(F.when(is_score, F.col(VALUE))).alias("score"), F.min(F.when(is_rank, F.col(VALUE))).alias("best_rank")
    )
    return out.where(F.col("score").isNotNull())


def prelaunch_weekly_trend(df: DataFrame, weeks: list[str]) -> DataFrame:
    """Sum per entity and week, then the mean over entities, with the week's place in the fixed order."""
    from audira.functions.grades import order_in

    rows = df.where(F.col("week_label").isin(weeks) & F.col(ENTITY).isNotNull())
    weekly = rows.groupBy(ENTITY, "week_label").agg(F.sum(VALUE).alias("_s"))
    out = weekly.groupBy("week_label").agg(F.avg("_s").alias(VALUE))
    return out.withColumn("week_order", order_in("week_label", weeks))


def media_share_mean(df: DataFrame) -> DataFrame:
    """Sum per entity and media, then the mean per media."""
    per_entity = df.where(F.col("media").isNotNull()).groupBy(ENTITY, "media").agg(F.sum(VALUE).alias("_s"))
    return per_entity.groupBy("media").agg(F.avg("_s").alias(VALUE))


# ---- demographics --------------------------------------------------------------------------------------------


def demographic_pyramid(df: DataFrame, within: str = "total", spec: SegmentSpec = SEGMENTS) -> DataFrame:
    """Decade x gender sums and shares, of the total over the fixed decades or within the gender over all decades.

    At most a few dozen cells come out of the aggregate, so the share window sees only those.
    """
    from pyspark.sql import Window

    typed = df.select(
        segments.segment_gender("segment", spec).alias("gender"),
        segments.segment_decade("segment", spec).alias("decade"),
        VALUE,
    )
    rows = typed.where(F.col("gender").isin(spec.male, spec.female))
    if within == "total":
        rows = rows.where(F.col("decade").isin([f"{d}{spec.decade_suffix}" for d in spec.decades]))
    cells = rows.groupBy("decade", "gender").agg(F.sum(VALUE).alias(VALUE))
    base = Window.partitionBy("gender") if within == "gender" else Window.partitionBy()
    share = F.try_divide(F.col(VALUE) * 100, F.sum(VALUE).over(base))
    return cells.withColumn("share", F.coalesce(share, F.lit(0.0)))


def segment_rows(
    df: DataFrame, metric: str, media: list[str], spec: SegmentSpec = SEGMENTS, clamped: bool = True
) -> DataFrame:
    """Rows of one metric and some media whose segment has a gender and a decade."""
    rows = df.where((F.col("metric") == metric) & F.col("media").isin(media) & F.col(STEP).isNotNull())
    labelled = rows.withColumn("label", segments.segment_label("segment", spec, clamped))
    return labelled.where(F.col("label").isNotNull())


def entity_segment_sums(
    df: DataFrame,
    metric: str,
    media: list[str],
    spec: SegmentSpec = SEGMENTS,
    keys: tuple[str, ...] = (ENTITY,),
    clamped: bool = True,
    keep_zero: bool = False,
) -> DataFrame:
    rows = segment_rows(df, metric, media, spec, clamped)
    rows = rows if keep_zero else zero_is_missing(rows)
    return rows.groupBy(*keys, STEP, "label").agg(F.sum(VALUE).alias(VALUE))


def _pivot_labels(df: DataFrame, keys: list[str], spec: SegmentSpec) -> DataFrame:
    labels = spec.labels()
    return df.groupBy(*keys).pivot("label", labels).agg(F.first(VALUE)).fillna(0.0, subset=labels)


def avg_segment_by_step(
    df: DataFrame, metric: str, media: list[str], cap: float | None = None, spec: SegmentSpec = SEGMENTS
) -> DataFrame:
    """Step x 12 segments: sum per entity, then the mean over entities, 0-filled."""
    sums = entity_segment_sums(step_cap_filter(df, cap), metric, media, spec)
    means = sums.groupBy(STEP, "label").agg(F.avg(VALUE).alias(VALUE))
    return _pivot_labels(means, [STEP], spec)


def segment_table_by_step(df: DataFrame, metric: str, media: list[str], spec: SegmentSpec = SEGMENTS) -> DataFrame:
    """Step x 12 segments, plain sums, 0-filled."""
    sums = segment_rows(df, metric, media, spec).groupBy(STEP, "label").agg(F.sum(VALUE).alias(VALUE))
    return _pivot_labels(sums, [STEP], spec)


def segment_population_mean(
    df: DataFrame, metric: str, media: list[str], groups: DataFrame, group: str, spec: SegmentSpec = SEGMENTS
) -> DataFrame:
    """Mean over entity-steps per segment, of each entity and of its group, in long form and fixed order."""
    from audira.functions.grades import order_in

    sums = entity_segment_sums(df, metric, media, spec, clamped=False, keep_zero=True)
    per_entity = sums.groupBy(ENTITY, "label").agg(F.sum(VALUE).alias("_s"), F.count(VALUE).alias("_n"))
    per_entity = per_entity.join(groups.select(ENTITY, group), ENTITY)
    both = ordering.with_group_values(per_entity, [group, "label"], {"_gs": F.sum("_s"), "_gn": F.sum("_n")})
    wide = both.select(
        group, ENTITY, "label", (F.col("_s") / F.col("_n")).alias(VALUE), (F.col("_gs") / F.col("_gn")).alias("group_value")
    )
    long = wide.unpivot([ENTITY, group, "label"], [VALUE, "group_value"], "side", "mean_value")
    return long.withColumn("label_order", F.coalesce(order_in("label", spec.labels()), F.lit(999)))


def step_segment_gap(
    df: DataFrame, metric: str, media: list[str], groups: DataFrame, group: str, spec: SegmentSpec = SEGMENTS
) -> DataFrame:
    """Per entity, step and segment the gap to its group in percent.

    A group value of 0 gives 0 when the entity has 0 too, else 999. Every segment is present at a step that has
    any, as in the 0-filled step tables. Segments stay side by side until the end.
    """
    labels = spec.labels()
    rows = zero_is_missing(segment_rows(df, metric, media, spec))
    sums = [F.sum(F.when(F.col("label") == x, F.col(VALUE))).alias(f"_b{i}") for i, x in enumerate(labels)]
    own = ordering.settle(rows.groupBy(ENTITY, STEP).agg(*sums).join(groups.select(ENTITY, group), ENTITY))
    both = ordering.with_group_values(own, [group, STEP], {f"_c{i}": F.avg(f"_b{i}") for i in range(len(labels))})
    cells = []
    for i, x in enumerate(labels):
        b, c = F.coalesce(f"_b{i}", F.lit(0.0)), F.coalesce(f"_c{i}", F.lit(0.0))
        cells.append(F.struct(F.lit(x).alias("label"), b.alias(VALUE), c.alias("group_value"), gap_percent(b, c).alias("gap")))
    return both.select(ENTITY, group, STEP, F.inline(F.array(*cells)))


def gap_percent(b: Column, c: Column) -> Column:
    empty = F.when(b == 0, F.lit(0.0)).otherwise(F.lit(999.0))
    return F.when(c != 0, (b - c) / F.when(c != 0, c) * 100).otherwise(empty)


def step_change_flag(table: DataFrame, keys: list[str]) -> DataFrame:
    """Up (1), down (-1) or equal (0) against the previous step of the same key; null at the first step.

    ``table`` has one value per key and step, so the window holds at most the steps of one key.
    """
    from pyspark.sql import Window

    prior = F.lag(VALUE).over(Window.partitionBy(*keys).orderBy(STEP))
    return table.withColumn("change", F.signum(F.col(VALUE) - prior).cast("int"))
