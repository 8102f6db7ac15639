"""Peer groups, cutoffs, ranks within groups and side-by-side comparisons.

Per-entity values are aggregated first; groups are compared through aggregates and ranks, never through pairs.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from audira.functions import grades
from audira.operators import ordering
from audira.operators.kpi import ENTITY, STEP, VALUE, aired_entities, row_filter
from audira.specs import MetricSpec, ViewRouting

WEEKDAYS = ("월화", "수목")


def most_frequent(df: DataFrame, key: str, column: str, name: str | None = None) -> DataFrame:
    """Most frequent non-null value per key; the smallest wins a tie. Two partial aggregates, no value map."""
    counts = df.where(F.col(column).isNotNull()).groupBy(key, column).agg(F.count("*").alias("_n"))
    order = F.struct(-F.col("_n"), F.col(column))
    return counts.groupBy(key).agg(F.min_by(column, order).alias(name or column))


def peer_group(
    df: DataFrame,
    target,
    comparison: str | Iterable[str] = "same",
    years: Iterable | None = None,
    rating_metric: str = "T시청률",
    weekdays: tuple[str, ...] = WEEKDAYS,
) -> DataFrame:
    """Rows of the comparison set of one target: slot and year filters, aired entities only, target kept.

    ``comparison`` is ``same``, ``weekday``, ``all`` or a list of slots. ``years`` defaults to the target's most
    frequent year; an empty list means all years. The target's attributes are scalars.
    """
    mine = df.where(F.col(ENTITY) == target)
    aired = aired_entities(df, rating_metric).unionByName(mine.select(ENTITY).distinct()).distinct()
    rows = df
    if comparison == "same":
        rows = rows.where(F.col("slot") == most_frequent(mine, ENTITY, "slot").select("slot").scalar())
    elif comparison == "weekday":
        rows = rows.where(F.col("slot").isin(list(weekdays)))
    elif comparison != "all":
        rows = rows.where(F.col("slot").isin(list(comparison)))
    if years is None:
        rows = rows.where(F.col("year") == most_frequent(mine, ENTITY, "year").select("year").scalar())
    elif list(years):
        rows = rows.where(F.col("year").isin(list(years)))
    # A table of the distinct entities of each partition is built; else all rows of the fact would be sorted.
    return rows.join(aired.hint("shuffle_hash"), ENTITY, "left_semi")


def reference_date_cutoff(df: DataFrame, target) -> DataFrame:
    """Drop rows of entities that started after the target; unknown starts stay."""
    starts = df.groupBy(ENTITY).agg(F.min("start_date").alias("_start"))
    mine = df.where(F.col(ENTITY) == target).agg(F.min("start_date"))
    late = starts.where(F.col("_start") > mine.scalar()).select(ENTITY)
    return df.join(late, ENTITY, "left_anti")


def metric_cutoff_slice(
    df: DataFrame, target, spec: MetricSpec, routing: ViewRouting = ViewRouting()
) -> DataFrame:
    """Keep rows up to the target's last week (week KPIs) or last step of the metric; all rows if it has none."""
    mine = df.where((F.col(ENTITY) == target) & row_filter(spec, routing))
    last = mine.agg(F.max("week_no").alias("_week"), F.max(STEP).alias("_step"))
    rows = ordering.with_scalars(df, last)
    by_step = F.when(F.col("_step").isNotNull(), F.col(STEP) <= F.col("_step")).otherwise(F.lit(True))
    keep = by_step
    if spec.cutoff == "week":
        keep = F.when(F.col("_week").isNotNull(), F.col("week_no") <= F.col("_week")).otherwise(by_step)
    return rows.where(keep).drop("_week", "_step")


def cutoff_label(df: DataFrame, spec: MetricSpec, routing: ViewRouting = ViewRouting()) -> DataFrame:
    """Per entity the label of its cutoff: '~W3' or '~12화'."""
    rows = df.where(row_filter(spec, routing))
    last = rows.groupBy(ENTITY).agg(F.max("week_no").alias("_week"), F.max(STEP).alias("_step"))
    by_step = F.concat(F.lit("~"), F.col("_step").cast("int").cast("string"), F.lit("화"))
    by_week = F.concat(F.lit("~W"), F.col("_week").cast("string"))
    label = F.coalesce(by_week, by_step) if spec.cutoff == "week" else by_step
    return last.select(ENTITY, label.alias("cutoff"))


def value_vs_group_at_own_cutoff(df: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """Total of each entity against its group's mean total, peers cut at the entity's own last step.

    The group sum at cutoff N is the running sum over N of step sums, and a peer counts from its first step on, so
    entities x steps rows are enough: no pair of entities is built.
    """
    per_step = df.where(F.col(STEP).isNotNull()).groupBy(ENTITY, STEP).agg(F.sum(VALUE).alias("_s"))
    per_step = per_step.join(groups.select(ENTITY, group), ENTITY)
    own = per_step.groupBy(group, ENTITY).agg(
        F.sum("_s").alias(VALUE), F.max(STEP).alias("cutoff"), F.min(STEP).alias("_first")
    )
    sums = per_step.groupBy(group, STEP).agg(F.sum("_s").alias("_s"))
    starts = own.groupBy(group, F.col("_first").alias(STEP)).agg(F.count("*").alias("_n"))
    # One row per (group, step): a window over the steps of a group is small however many entities it has.
    upto = Window.partitionBy(group).orderBy(STEP).rowsBetween(Window.unboundedPreceding, 0)
    curve = sums.join(starts, [group, STEP], "left")
    curve = curve.select(
        group,
        F.col(STEP).alias("cutoff"),
        (F.sum("_s").over(upto) / F.sum(F.coalesce("_n", F.lit(0))).over(upto)).alias("group_value"),
    )
    out = ordering.join_small(own.drop("_first"), curve, [group, "cutoff"])
    ratio = F.try_divide(F.col(VALUE) * 100, F.col("group_value"))
    return out.select(ENTITY, group, "cutoff", VALUE, "group_value", ratio.alias("ratio"))


def entity_attributes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Most frequent slot, year, ... of each entity, and its first start date."""
    starts = df.groupBy(ENTITY).agg(F.min("start_date").alias("start_date"))
    for column in columns:
        starts = starts.join(most_frequent(df, ENTITY, column), ENTITY, "left")
    return starts


def previous_work(entities: DataFrame) -> DataFrame:
    """Per entity the latest other entity of its slot that started strictly earlier.

    ``entities`` has entity_id, slot and start_date. One row per (slot, day) is enough for the look-back, so the
    window holds calendar days, not entities. Among entities of one day the greatest id is taken.
    """
    known = entities.where(F.col("slot").isNotNull() & F.col("start_date").isNotNull())
    days = known.groupBy("slot", "start_date").agg(F.max(ENTITY).alias("_last"))
    back = days.withColumn("previous_id", F.lag("_last").over(Window.partitionBy("slot").orderBy("start_date")))
    out = ordering.join_small(entities, back.drop("_last"), ["slot", "start_date"], "left")
    return out.select(ENTITY, "slot", "start_date", "previous_id")


def entities_by_recency(df: DataFrame) -> DataFrame:
    """Entities with their latest start and their place in 'newest first' order; unknown starts come last."""
    latest = df.groupBy(ENTITY).agg(F.max("start_date").alias("start_date"))
    return ordering.with_position(latest, [], [F.col("start_date").desc_nulls_last(), F.col(ENTITY)])


# ---- ranks ---------------------------------------------------------------------------------------------------


def rank_in_group(
    values: DataFrame, groups: list[str], high_is_good: bool = True, override: DataFrame | None = None
) -> DataFrame:
    """Min-rank of each entity in its group and the group's size.

    ``override`` (entity_id and group columns, value) replaces or adds values before ranking, as the comparison
    page does for its target.
    """
    if override is not None:
        rest = values.join(override.select(*groups, ENTITY), [*groups, ENTITY], "left_anti")
        values = rest.unionByName(override.select(*rest.columns))
    ranked = ordering.with_ranks(values.where(F.col(VALUE).isNotNull()), VALUE, groups)
    rank = F.col("rank_desc") if high_is_good else F.col("rank_asc")
    return ranked.select(*groups, ENTITY, VALUE, rank.alias("rank"), F.col("n").alias("group_size"))


def rank_neighbors(
    values: DataFrame, groups: list[str], window: int = 3, high_is_good: bool = True, target=None
) -> DataFrame:
    """For every entity the rows within ``window`` places in its group's order (2*window+1 at most).

    With ``target`` only that entity's rows; if it is absent, the first 2*window+1 rows. Neighbours are found by
    place number, so each row meets at most 2*window+1 others.
    """
    known = values.where(F.col(VALUE).isNotNull())
    first = F.col(VALUE).desc() if high_is_good else F.col(VALUE).asc()
    ranked = rank_in_group(known, groups, high_is_good)
    placed = ordering.with_position(ranked, groups, [first, F.col(ENTITY)])
    if target is not None:
        mine = placed.where(F.col(ENTITY) == target).agg(F.max("position").alias("_me"))
        near = F.abs(F.col("position") - F.col("_me")) <= window
        fallback = F.col("_me").isNull() & (F.col("position") <= 2 * window + 1)
        return ordering.with_scalars(placed, mine).where(near | fallback).drop("_me")
    steps = F.explode(F.sequence(F.lit(-window), F.lit(window))).alias("_step")
    asks = placed.select(*groups, F.col(ENTITY).alias("target_id"), "position", steps)
    asks = asks.select(*groups, "target_id", (F.col("position") + F.col("_step")).alias("position"))
    return asks.join(placed, [*groups, "position"])


def winner(v1: Column, v2: Column, high_is_good: Column) -> Column:
    first = F.when(high_is_good, v1 > v2).otherwise(v1 < v2)
    second = F.when(high_is_good, v2 > v1).otherwise(v2 < v1)
    return F.when(first, F.lit(1)).when(second, F.lit(2)).otherwise(F.lit(0))


def kpi_head_to_head(long: DataFrame, pairs: DataFrame, low_is_good: Iterable[str] = ()) -> DataFrame:
    """KPI values of paired entities side by side; 1 or 2 names the winner, 0 a tie or a missing value.

    ``long`` has (entity_id, kpi, value); ``pairs`` has (entity_1, entity_2).
    """
    left = pairs.join(long.withColumnsRenamed({ENTITY: "entity_1", VALUE: "value_1"}), "entity_1")
    right = long.withColumnsRenamed({ENTITY: "entity_2", VALUE: "value_2"})
    both = left.join(right, ["entity_2", "kpi"], "left")
    high = ~F.col("kpi").isin(list(low_is_good))
    return both.select(
        "entity_1", "entity_2", "kpi", "value_1", "value_2",
        winner(F.col("value_1"), F.col("value_2"), high).alias("winner"),
    )


def kpi_percentiles(long: DataFrame, entities: DataFrame, kpis: list[str], digits: int = 6) -> DataFrame:
    """Percentile (0..100) of each entity in each KPI, a missing KPI as 0, in wide form."""
    ranked = ordering.with_pct_rank_avg(long.withColumn(VALUE, F.round(VALUE, digits)), VALUE, ["kpi"], "_pct")
    wide = ranked.groupBy(ENTITY).pivot("kpi", kpis).agg(F.first(F.col("_pct") * 100))
    return entities.select(ENTITY).join(wide, ENTITY, "left").fillna(0.0, subset=kpis)


def positioning_radar(percentiles: DataFrame, groups: DataFrame, kpis: list[str]) -> DataFrame:
    """Percentiles of each entity beside its group's mean, one row per KPI."""
    long = percentiles.unpivot([ENTITY], kpis, "kpi", "score").join(groups, ENTITY)
    both = ordering.with_group_values(long, ["slot", "kpi"], {"group_score": F.avg("score")})
    return both.select(ENTITY, "slot", "kpi", "score", "group_score")


def quintile_grade(values: DataFrame, groups: list[str] = (), labels: list[str] = grades.LEVEL_GRADES) -> DataFrame:
    """Grade by descending average rank in fifths; a missing value has no grade."""
    out = ordering.with_quintile(values, VALUE, list(groups), "_q")
    return out.withColumn("grade", grades.quintile_label("_q", labels)).drop("_q")


def nearest_by_score(actuals: DataFrame, target, prediction: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` other entities whose actual value is nearest to the target's prediction (a one-row table).

    Ties go to the larger actual, then the smaller id. Each task keeps its own best ``n``.
    """
    guess = prediction.where(F.col(ENTITY) == target).agg(F.max("prediction").alias("_p"))
    others = actuals.where((F.col(ENTITY) != target) & F.col("actual").isNotNull())
    gap = ordering.with_scalars(others, guess).where(F.col("_p").isNotNull())
    gap = gap.withColumn("gap", F.abs(F.col("actual") - F.col("_p"))).drop("_p")
    return gap.orderBy("gap", F.col("actual").desc(), ENTITY).limit(n)


def fixed_peer_labels(df: DataFrame, target, previous: DataFrame) -> DataFrame:
    """Rows of target, previous work and the other entities of the slot, tagged and stacked.

    ``previous`` is the output of :func:`previous_work`; the target's row of it gives two scalars. The group leaves
    the target out, and the previous work is in both its own and the group's part.
    """
    mine = df.where(F.col(ENTITY) == target)
    row = previous.where(F.col(ENTITY) == target)
    before = df.where(F.col(ENTITY) == row.select("previous_id").scalar())
    rest = df.where(F.col(ENTITY) != target)
    group = rest.where(F.col("slot") == row.select("slot").scalar())
    return (
        mine.withColumn("label", F.lit("target"))
        .unionByName(before.withColumn("label", F.lit("previous")))
        .unionByName(group.withColumn("label", F.lit("group")))
    )


def survey_mean(df: DataFrame, previous: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean per survey metric of every entity, of its previous work and of its slot; missing as 0.

    The slot's side leaves the entity itself out, by subtracting its own sum from the slot's.
    """
    rows = df.where(F.col("metric").isin(metrics) & F.col(VALUE).isNotNull())
    own = rows.groupBy(ENTITY, "metric").agg(F.sum(VALUE).alias("_s"), F.count(VALUE).alias("_n"))
    names = F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric")
    frame = previous.select(ENTITY, "slot", "previous_id", names)
    prior = own.select(F.col(ENTITY).alias("previous_id"), "metric", (F.col("_s") / F.col("_n")).alias("_prev"))
    both = frame.join(own, [ENTITY, "metric"], "left").join(prior, ["previous_id", "metric"], "left")
    out = ordering.with_group_values(both, ["slot", "metric"], {"_gs": F.sum("_s"), "_gn": F.sum("_n")})
    mean = F.try_divide(F.col("_s"), F.col("_n"))
    rest_sum = F.col("_gs") - F.coalesce("_s", F.lit(0.0))
    rest_n = F.col("_gn") - F.coalesce("_n", F.lit(0))
    return out.select(
        ENTITY,
        "metric",
        F.coalesce(mean, F.lit(0.0)).alias("target_mean"),
        F.coalesce("_prev", F.lit(0.0)).alias("previous_mean"),
        F.coalesce(F.try_divide(rest_sum, rest_n), F.lit(0.0)).alias("group_mean"),
    )
