"""Growth grades: level and slope of every entity over cumulative cutoffs.

The fact is reduced to one value per (entity, metric, step) first; cutoffs are met on that small side.
"""

from __future__ import annotations

from collections.abc import Iterable


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from audira.functions import grades
from audira.operators import ordering
from audira.operators.kpi import ENTITY, STEP, VALUE, present, view_rows
from audira.specs import GROWTH_CUTOFFS, GrowthSpec, ViewRouting


def step_series(
    df: DataFrame, specs: Iterable[GrowthSpec], routing: ViewRouting = ViewRouting(), zero_dropped: bool = False
) -> DataFrame:
    """(entity_id, name, step_no, value): steps summed or averaged per metric, in one scan."""
    specs = list(specs)
    rows = df.where(F.col(STEP).isNotNull() & F.col(VALUE).isNotNull() & F.col(ENTITY).isNotNull())
    aggs = []
    for s in specs:
        chosen = view_rows(s.views, routing) if s.views else F.col("metric") == s.metric
        if s.media:
            chosen = chosen & F.col("media").isin(list(s.media))
        value = present() if zero_dropped else F.col(VALUE)
        if s.flag_factor is not None and "flag_netflix" in df.columns:
            value = F.when(F.col("flag_netflix") == 1, value * s.flag_factor).otherwise(value)
        picked = F.when(chosen, value)
        aggs.append((F.sum(picked) if s.mode == "sum" else F.avg(picked)).alias(s.name))
    metrics = {routing.metric if s.views else s.metric for s in specs}
    wide = rows.where(F.col("metric").isin(sorted(metrics))).groupBy(ENTITY, STEP).agg(*aggs)
    long = ordering.long_form(wide, [ENTITY, STEP], [s.name for s in specs], "name", VALUE)
    return long.where(F.col(VALUE).isNotNull())


def level_and_slope(
    series: DataFrame, cutoffs: Iterable[int] = GROWTH_CUTOFFS, first_step: int | None = None, digits: int = 8
) -> DataFrame:
    """Mean and least-squares slope of each series up to each cutoff; no slope below two points.

    The values grow along the steps of a series, and each cutoff takes those of the last step before it: the series
    is shuffled once, and no row is repeated per cutoff.
    """
    if first_step is not None:
        series = series.where(F.col(STEP) >= first_step)
    in_order = Window.partitionBy(ENTITY, "name").orderBy(STEP)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grown = series.select(
        ENTITY,
        "name",
        STEP,
        F.lead(STEP).over(in_order).alias("_next"),
        F.avg(VALUE).over(so_far).alias("_level"),
        F.when(F.count(VALUE).over(so_far) >= 2, F.regr_slope(VALUE, STEP).over(so_far)).alias("_slope"),
    )
    every = F.array(*[F.lit(int(n)) for n in cutoffs])
    mine = F.filter(every, lambda n: (n >= F.col(STEP)) & (F.col("_next").isNull() | (n < F.col("_next"))))
    return grown.select(
        ENTITY,
        "name",
        F.explode(mine).alias("cutoff"),
        F.round("_level", digits).alias("level"),
        F.round("_slope", digits).alias("slope"),
    )


def _pct_means(stats: DataFrame, digits: int) -> DataFrame:
    """Per (entity, cutoff) the mean percentile of level and slope over the metrics that have one."""
    long = ordering.long_form(stats, [ENTITY, "cutoff", "name"], ["level", "slope"], "kind", "v")
    ranked = ordering.with_pct_rank_avg(long, "v", ["cutoff", "name", "kind"], "pct")
    means = {k: F.avg(F.when(F.col("kind") == k, F.col("pct") * 100)) for k in ("level", "slope")}
    return ranked.groupBy(ENTITY, "cutoff").agg(*[F.round(m, digits).alias(f"{k}_pct_mean") for k, m in means.items()])


def _two_quintiles(df: DataFrame, level: str, slope: str, keys: list[str], groups: list[str]) -> DataFrame:
    """Quintile of two columns (as _a and _s), ranked side by side in one pass."""
    long = ordering.long_form(df, keys, [level, slope], "kind", "v")
    graded = ordering.with_quintile(long, "v", [*groups, "kind"], "_q")
    sides = {}
    for column, quintile in ((level, "_a"), (slope, "_s")):
        mine = F.col("kind") == column
        sides[column] = F.max(F.when(mine, F.col("v"))).alias(column)
        sides[quintile] = F.max(F.when(mine, F.col("_q"))).alias(quintile)
    return graded.groupBy(*keys).agg(*sides.values())


def growth_grades(
    df: DataFrame,
    specs: Iterable[GrowthSpec],
    cutoffs: Iterable[int] = GROWTH_CUTOFFS,
    routing: ViewRouting = ViewRouting(),
    zero_dropped: bool = False,
    first_step: int | None = None,
    digits: int = 8,
) -> DataFrame:
    """Overall grades of every entity at every cutoff: level (S..D) and slope (+2..-2) by mean percentile."""
    series = step_series(df, specs, routing, zero_dropped)
    stats = level_and_slope(series, cutoffs, first_step, digits)
    means = _pct_means(stats, digits)
    graded = _two_quintiles(means, "level_pct_mean", "slope_pct_mean", [ENTITY, "cutoff"], ["cutoff"])
    level = grades.quintile_label("_a", grades.LEVEL_GRADES)
    slope = grades.quintile_label("_s", grades.SLOPE_GRADES)
    return graded.select(
        ENTITY,
        "cutoff",
        "level_pct_mean",
        "slope_pct_mean",
        level.alias("level_grade"),
        slope.alias("slope_grade"),
        F.concat(level, F.coalesce(slope, F.lit(""))).alias("grade"),
    )


def growth_grades_digital(
    df: DataFrame,
    specs: Iterable[GrowthSpec],
    cutoffs: Iterable[int] = GROWTH_CUTOFFS,
    routing: ViewRouting = ViewRouting(),
) -> DataFrame:
    """The same for digital metrics: zeros dropped, steps from 1 on."""
    return growth_grades(df, specs, cutoffs, routing, zero_dropped=True, first_step=1)


def metric_grades(stats: DataFrame) -> DataFrame:
    """Level and slope grade of every (entity, metric, cutoff)."""
    graded = _two_quintiles(stats, "level", "slope", [ENTITY, "cutoff", "name"], ["cutoff", "name"])
    level = grades.quintile_label("_a", grades.LEVEL_GRADES)
    slope = grades.quintile_label("_s", grades.SLOPE_GRADES)
    return graded.select(
        ENTITY, "name", "cutoff", "level", "slope",
        level.alias("level_grade"), slope.alias("slope_grade"),
        F.concat(level, F.coalesce(slope, F.lit(""))).alias("grade"),
    )


def grade_evolution(graded: DataFrame) -> DataFrame:
    """(entity, cutoff, grades, 5..1) for entities that have a level grade."""
    number = F.lit(len(grades.LEVEL_GRADES) + 1) - grades.order_in("level_grade", grades.LEVEL_GRADES)
    return graded.where(F.col("level_grade").isNotNull()).select(
        ENTITY,
        "cutoff",
        F.concat(F.col("cutoff").cast("string"), F.lit("회차")).alias("cutoff_label"),
        "level_grade",
        F.coalesce("slope_grade", F.lit("")).alias("slope_grade"),
        number.cast("int").alias("level_no"),
    )


def first_steps_present(df: DataFrame, routing: ViewRouting = ViewRouting()) -> DataFrame:
    """Per entity whether steps 1 and 2 have any views."""
    rows = df.where(view_rows("total", routing))
    has = F.coalesce(present().isNotNull(), F.lit(False))
    return rows.groupBy(ENTITY).agg(
        *[F.coalesce(F.bool_or((F.col(STEP) == n) & has), F.lit(False)).alias(f"has_step_{n}") for n in (1, 2)]
    )


def positioning_grid(graded: DataFrame, cutoff: int) -> DataFrame:
    """Entities by grid cell with the cell's size and score; empty cells of the 5 x 5 grid have no entity.

    Cells stay in long form: a cell may hold any number of entities.
    """
    at = graded.where((F.col("cutoff") == cutoff) & F.col("level_grade").isNotNull())
    at = at.where(F.col("slope_grade").isNotNull()).select("level_grade", "slope_grade", ENTITY)
    sizes = at.groupBy("level_grade", "slope_grade").agg(F.count("*").alias("cell_size"))
    cells = [
        F.struct(F.lit(a).alias("level_grade"), F.lit(s).alias("slope_grade"), F.lit((10 - i - j) / 2.0).alias("score"))
        for i, a in enumerate(grades.LEVEL_GRADES)
        for j, s in enumerate(grades.SLOPE_GRADES)
    ]
    grid = graded.sparkSession.range(1).select(F.inline(F.array(*cells)))
    grid = grid.join(F.broadcast(sizes), ["level_grade", "slope_grade"], "left").fillna(0, subset=["cell_size"])
    filled = at.join(F.broadcast(grid), ["level_grade", "slope_grade"])
    empty = grid.where(F.col("cell_size") == 0).withColumn(ENTITY, F.lit(None).cast(at.schema[ENTITY].dataType))
    return filled.unionByName(empty)
