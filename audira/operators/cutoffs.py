"""KPIs of every entity against peers that are cut at the entity's own last week or step.

A running title is compared with what finished titles had reached by the same week or step. For all entities at once that
needs each peer's KPI as a function of the cutoff, and for each entity the place of its value among its peers' values at
its own cutoff. Both come without pairs of entities:

* ``kpi_sums`` reduces the fact to one row per (entity, step, week) with all KPIs side by side, and ``entity_curves`` turns the
  rows of an entity into one row per step and one per week, with every KPI's running value there. The KPIs stay columns until
  their values are final, and an entity's rows are shuffled to it once.
* Only cutoffs that some entity has are looked at. An entity holds a value at each of them from its first row on, so there is one
  narrow row (cutoff, KPI, value) per entity and cutoff: they grow with the entities, times the weeks or steps of a calendar.
* ``ordering.smaller_values`` counts, for each entity, the better ones among the rows of its cutoff. Group means and sizes are
  sums over the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from audira.functions import text
from audira.operators import ordering
from audira.operators.kpi import ENTITY, STEP, VALUE, present, view_rows
from audira.session import store_rows
from audira.specs import MetricSpec, ViewRouting

#: Means are added as these: far finer than the digits that values are rounded to.
KIND = "decimal(30,12)"
#: Modes whose value is a mean over steps; the others have one state for all rows.
STEPPED = ("mean", "step_sum", "vod")
WEEK, BY_STEP, WHOLE = "week", "step", "all"
#: KPIs in a word of bits (``_b0``, ``_b1``): the lower half tells which KPIs have rows, the upper half which have a lead.
WORD = 31


def _of(specs: list[MetricSpec], test) -> Column:
    return F.col("kpi").isin([s.kpi for s in specs if test(s)])


def _words(specs: list[MetricSpec]) -> list[str]:
    return [f"_b{w}" for w in range(len(specs) // WORD + 1)]


def _bit(i: int, lead: bool = False) -> Column:
    return F.lit(1 << (i % WORD + WORD * lead)).cast("long")


def _has(i: int, lead: bool = False, word: str = "_b{}") -> Column:
    return F.col(word.format(i // WORD)).bitwiseAND(_bit(i, lead)) != 0


def _either(words: list[str]) -> list[Column]:
    return [F.bit_or(w).alias(w) for w in words]


def _row_bits(specs: list[MetricSpec], routing: ViewRouting) -> tuple[Column, list[Column]]:
    """Whether some KPI reads rows of the metric, and the words of bits of the KPIs that a row counts for.

    A row's metric is looked up once for all KPIs, and a name is only cleaned if no KPI has it as it stands.
    """

    def clean(name: str) -> str:
        return re.sub(text.NOT_ALNUM_HANGUL, "", name).lower()

    def reads(s: MetricSpec, name: str) -> bool:
        return name == routing.metric if s.views else clean(name) == clean(s.metric) if s.normalized else name == s.metric

    def counted(word: int, test) -> Column:
        parts: dict[tuple, int] = {}
        for i, s in enumerate(specs):
            if i // WORD == word and test(s):
                parts[s.media, s.views] = parts.get((s.media, s.views), 0) + (1 << i % WORD)
        out = F.lit(0).cast("long")
        for (media, views), bits in parts.items():
            tests = [F.col("media").isin(list(media))] if media else []
            tests += [view_rows(views, routing)] if views else []
            value = F.lit(bits).cast("long")
            out = out + (F.when(reduce(lambda a, b: a & b, tests), value).otherwise(0) if tests else value)
        return out

    names = sorted({routing.metric if s.views else s.metric for s in specs})
    cleaned = sorted({clean(s.metric) for s in specs if s.normalized and not s.views})
    metric, norm = F.col("metric"), text.normalize_text("metric")
    words = []
    for w in range(len(_words(specs))):
        of_metric = reduce(lambda c, m: c.when(metric == m, counted(w, lambda s: reads(s, m))), names, F)
        if cleaned:
            of_name = {c: sum(1 << i % WORD for i, s in enumerate(specs) if i // WORD == w and s.normalized and not s.views and clean(s.metric) == c) for c in cleaned}
            by_name = F.create_map(*[x for c, bits in of_name.items() for x in (F.lit(c), F.lit(bits).cast("long"))])
            passed = counted(w, lambda s: s.normalized and not s.views)
            of_metric = of_metric.otherwise(F.try_element_at(by_name, norm).bitwiseAND(passed))
        words.append(F.coalesce(of_metric, F.lit(0).cast("long")))
    known = metric.isin(names)
    return known | norm.isin(cleaned) if cleaned else known, words


def kpi_sums(df: DataFrame, specs: list[MetricSpec], routing: ViewRouting) -> DataFrame:
    """One row per (entity_id, step_no, week_no) with each KPI's state in columns of its own (see ``kpi_cells``).

    One scan of the fact. All KPIs of a cell share one row, so it is much less to shuffle than a row for each.
    """
    known, bits = _row_bits(specs, routing)
    rows = df.where(known & F.col(ENTITY).isNotNull())
    rows = rows.select(ENTITY, STEP, "week_no", "media", VALUE, present().alias("_present"), *[b.alias(w) for b, w in zip(bits, _words(specs), strict=True)])
    values = [F.when(_has(i), F.col(VALUE) if s.keep_zero else F.col("_present")) for i, s in enumerate(specs)]
    leads = [F.lit(0).cast("long") for _ in bits]
    for i, s in enumerate(specs):
        if s.mode == "vod":
            leads[i // WORD] = leads[i // WORD] + F.when((F.col("media") == s.media[0]) & values[i].isNotNull(), _bit(i, True)).otherwise(0)
    aggs = [F.bit_or(F.col(w) + lead).alias(w) for w, lead in zip(_words(specs), leads, strict=True)]
    for i, s in enumerate(specs):
        aggs += [F.count(values[i]).alias(f"_n{i}"), (F.min(values[i]) if s.mode == "min" else F.sum(values[i])).alias(f"_v{i}")]
    return rows.groupBy(ENTITY, STEP, "week_no").agg(*aggs)


def _counts(specs: list[MetricSpec]) -> list[str]:
    """The counts that values follow from; of the other KPIs it is enough to know whether there is a sum."""
    return [f"_n{i}" for i, s in enumerate(specs) if s.mode in ("mean", "flat_mean")]


def _added(specs: list[MetricSpec]) -> list[Column]:
    """Aggregates that add up the states of ``kpi_sums``."""
    values = [(F.min if s.mode == "min" else F.sum)(f"_v{i}").alias(f"_v{i}") for i, s in enumerate(specs)]
    return [*_either(_words(specs)), *values, *[F.sum(n).alias(n) for n in _counts(specs)]]


def kpi_cells(sums: DataFrame, keys: list[str], specs: list[MetricSpec]) -> DataFrame:
    """(keys, kpi, step_no, week_no, s, n, lo, lead) of ``kpi_sums``; a step KPI may have several cells of one step.

    Where ``sums`` has no count, n tells whether there is a value. Rows whose value is missing make a cell without values: they still tell how far the entity has data.
    """
    cells = []
    for i, s in enumerate(specs):
        value, none = F.col(f"_v{i}"), F.lit(None).cast("double")
        total, least = (none, value) if s.mode == "min" else (value, none)
        # Weeks tell nothing apart for KPIs that are cut by step.
        week = F.col("week_no") if s.cutoff == "week" else F.lit(None).cast(sums.schema["week_no"].dataType)
        lead = _has(i, True).cast("long")
        count = F.col(f"_n{i}") if f"_n{i}" in sums.columns else value.isNotNull().cast("long")
        state = [week.alias("week_no"), total.alias("s"), count.alias("n"), least.alias("lo"), lead.alias("lead")]
        cells.append(F.when(_has(i), F.struct(F.lit(s.kpi).alias("kpi"), *state)))
    return sums.select(*keys, STEP, F.inline(F.array_compact(F.array(*cells))))


def by_axis(cells: DataFrame) -> DataFrame:
    """The cells once per kind of cutoff: by week (for week KPIs), by step, and whole."""
    ways = [F.struct(F.lit(k).alias("kind"), x.cast("double").alias("axis")) for k, x in ((WEEK, F.col("week_no")), (BY_STEP, F.col(STEP)), (WHOLE, F.lit(0)))]
    return cells.select("*", F.inline(F.array(*ways))).where(F.col("axis").isNotNull())


def _stat(specs: list[MetricSpec], total: Column, count: Column, least: Column, lead: Column) -> Column:
    """A KPI's value from the state of its rows (of one step, for modes that are means over steps)."""
    return (
        F.when(_of(specs, lambda s: s.mode in ("mean", "flat_mean")), F.when(count > 0, total / count))
        .when(_of(specs, lambda s: s.mode == "min"), least)
        .when(_of(specs, lambda s: s.mode == "vod"), F.when(lead > 0, total))
        .otherwise(F.when(count > 0, total))
    )


def _states(cells: DataFrame, keys: list[str], specs: list[MetricSpec]) -> DataFrame:
    """The cells' state by key and step; modes without steps have one state."""
    stepped = _of(specs, lambda s: s.mode in STEPPED)
    mine = cells.withColumn("_step", F.when(stepped, F.col(STEP))).where(~stepped | F.col(STEP).isNotNull())
    return mine.groupBy(*keys, "_step").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.sum("lead").alias("lead"))


def running_kpis(cells: DataFrame, keys: list[str], specs: list[MetricSpec], digits: int) -> DataFrame:
    """(keys, kpi, kind, axis, value): each KPI over the rows up to each point of its axis.

    Steps keep a state of their own, so that a mean of step means can be followed while rows join a step by and by. Means
    are added as decimals: the order does not matter.
    """
    state = _states(cells, [*keys, "kpi", "kind", "axis"], specs)
    along = Window.partitionBy(*keys, "kpi", "kind", "_step").orderBy("axis")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    stat = _stat(specs, F.sum("s").over(so_far), F.sum("n").over(so_far), F.min("lo").over(so_far), F.sum("lead").over(so_far))
    stats = state.withColumn("m", stat.try_cast(KIND))
    before = F.lag("m").over(along)
    change = F.coalesce("m", F.lit(0)) - F.coalesce(before, F.lit(0))
    grown = F.col("m").isNotNull().cast("int") - before.isNotNull().cast("int")
    moved = stats.withColumns({"_d": change, "_k": grown}).groupBy(*keys, "kpi", "kind", "axis").agg(F.sum("_d").alias("_d"), F.sum("_k").alias("_k"))
    at = Window.partitionBy(*keys, "kpi", "kind").orderBy("axis").rowsBetween(Window.unboundedPreceding, 0)
    sums, steps = F.sum("_d").over(at).cast("double"), F.sum("_k").over(at)
    return moved.select(*keys, "kpi", "kind", "axis", F.round(F.when(steps > 0, sums / steps), digits).alias(VALUE))


def _one_stat(s: MetricSpec, total: Column, count: Column | None, lead: Column | None) -> Column:
    """``_stat`` of one KPI whose least value or sum is ``total``, which is null without values; see ``_counts``."""
    return F.when(count > 0, total / count) if s.mode in ("mean", "flat_mean") else F.when(lead, total) if s.mode == "vod" else total


def entity_curves(sums: DataFrame, group: str, specs: list[MetricSpec], digits: int) -> DataFrame:
    """(entity_id, group, kind, axis, next, _c0.., _w0..): a row per entity and step (also for rows without one), and per week.

    ``_c`` is each KPI over the rows up to this point of the axis, ``next`` the entity's next point. ``_w`` is the KPI over all rows,
    in that one row where the entity is cut for it: at the last week with rows of it, else its last step, else the row without a
    step. ``sums`` has one row per (entity, step, week); an entity's rows are moved once, to one task.
    """
    week, axis, stepped_row, counts = F.col("week_no"), F.col("axis"), F.col("kind") == BY_STEP, _counts(specs)
    sums = sums.repartition(int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions")), ENTITY)
    # How a step's mean moves from week to week, for KPIs that are means over steps and cut by week.
    moving = [i for i, s in enumerate(specs) if s.cutoff == "week" and s.mode in STEPPED]
    along = Window.partitionBy(ENTITY, group, STEP).orderBy(week)
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    weeks = sums.where(week.isNotNull())
    for i in moving:
        count = F.sum(f"_n{i}").over(so_far) if f"_n{i}" in counts else None
        stat = _one_stat(specs[i], F.sum(f"_v{i}").over(so_far), count, F.max(_has(i, True)).over(so_far))
        weeks = weeks.withColumn(f"_m{i}", F.when(F.col(STEP).isNotNull(), stat).try_cast(KIND))
    moves = {}
    for i in moving:
        m, before = F.col(f"_m{i}"), F.lag(f"_m{i}").over(along)
        moves[f"_d{i}"] = F.coalesce(m, F.lit(0)) - F.coalesce(before, F.lit(0))
        moves[f"_k{i}"] = m.isNotNull().cast("int") - before.isNotNull().cast("int")
    by_week = [F.col(f"_v{i}") if s.cutoff == "week" else F.lit(None).cast("double").alias(f"_v{i}") for i, s in enumerate(specs)]
    of_week = [F.lit(WEEK).alias("kind"), week.cast("double").alias("axis"), *_words(specs), *by_week, *counts]
    weeks = weeks.withColumns(moves).select(ENTITY, group, *of_week, *moves)
    steps = sums.select(ENTITY, group, F.lit(BY_STEP).alias("kind"), F.col(STEP).cast("double").alias("axis"), *weeks.columns[4 : len(weeks.columns) - len(moves)])
    rows = steps.unionByName(weeks, allowMissingColumns=True)
    points = rows.groupBy(ENTITY, group, "kind", "axis").agg(*_added(specs), *[F.sum(c).alias(c) for c in moves])
    means = {}
    for i, s in enumerate(specs):
        if s.mode in STEPPED:
            stat = _one_stat(s, F.col(f"_v{i}"), F.col(f"_n{i}") if f"_n{i}" in counts else None, _has(i, True))
            means[f"_m{i}"] = F.when(stepped_row & axis.isNotNull(), stat).try_cast(KIND)
    points = points.withColumns(means)

    def single(s: MetricSpec, rows: Column, over) -> Column:
        """The KPI over a window's rows, for modes that are no means over steps."""
        total = (F.min if s.mode == "min" else F.sum)(F.when(rows, F.col(f"_v{i}"))).over(over)
        count = F.sum(F.when(rows, F.col(f"_n{i}"))).over(over) if f"_n{i}" in counts else None
        return _one_stat(s, total, count, None).try_cast(KIND).cast("double")

    in_order = Window.partitionBy(ENTITY, group, "kind").orderBy("axis")
    upto = in_order.rowsBetween(Window.unboundedPreceding, 0)
    curves = {"next": F.lead("axis").over(in_order)}
    for i, s in enumerate(specs):
        if s.mode in STEPPED:
            m = F.col(f"_m{i}")
            move, grown = m, m.isNotNull().cast("int")
            if i in moving:
                move, grown = (F.when(stepped_row, x).otherwise(F.col(y)) for x, y in ((move, f"_d{i}"), (grown, f"_k{i}")))
            steps = F.sum(grown).over(upto)
            curve = F.when(steps > 0, F.sum(move).over(upto).cast("double") / steps)
        else:
            curve = single(s, axis.isNotNull(), upto)
        curves[f"_c{i}"] = F.when(axis.isNotNull() if s.cutoff == "week" else axis.isNotNull() & stepped_row, F.round(curve, digits))
    points = points.withColumns(curves)

    # In the order of the other window, so that rows are sorted once; a step of its own, as one method for both would be too
    # long to be compiled.
    of_entity = Window.partitionBy(ENTITY, group).orderBy("kind", "axis").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    asks = []
    for i, s in enumerate(specs):
        last_step = F.max(F.when(stepped_row & _has(i), axis)).over(of_entity)
        last_week = F.max(F.when(~stepped_row & _has(i), axis)).over(of_entity) if s.cutoff == "week" else F.lit(None).cast("double")
        by_step = stepped_row & last_week.isNull() & axis.eqNullSafe(last_step)
        if s.mode not in STEPPED:
            whole = F.round(single(s, stepped_row, of_entity), digits)
        elif i in moving:  # all its steps are in at the entity's last
            whole = F.max(F.when(stepped_row & F.col("next").isNull(), F.col(f"_c{i}"))).over(of_entity)
        else:
            whole = F.col(f"_c{i}")
        asks.append(F.when(by_step | (~stepped_row & (axis == last_week)), whole).alias(f"_w{i}"))
    return points.select(ENTITY, group, "kind", "axis", *curves, *asks)


def _better(s: MetricSpec, value: Column) -> Column:
    """The value with its sign such that less is better."""
    return F.lit(0.0) - value if s.high_is_good else value


def own_asks(curves: DataFrame, group: str, specs: list[MetricSpec]) -> DataFrame:
    """(entity_id, group, kind, axis, _kpi, value, at): each KPI with a value, where it is cut and its value there, less is better."""
    whole = F.col("axis").isNull()
    asks = []
    for i, s in enumerate(specs):
        value = F.col(f"_w{i}")
        at = _better(s, F.when(whole, value).otherwise(F.col(f"_c{i}")))
        asks.append(F.when(value.isNotNull(), F.struct(F.lit(i).alias("_kpi"), value.alias(VALUE), at.alias("at"))))
    kind, axis = F.when(whole, WHOLE).otherwise(F.col("kind")), F.coalesce("axis", F.lit(0.0))
    return curves.select(ENTITY, group, kind.alias("kind"), axis.alias("axis"), F.inline(F.array(*asks))).where(F.col("_kpi").isNotNull())


def values_at_cutoffs(curves: DataFrame, cuts: DataFrame, group: str, specs: list[MetricSpec]) -> DataFrame:
    """(key, at): the value of every entity at every cutoff of its group that some entity has, less is better.

    ``cuts`` has the cutoffs with an id and the bits of the KPIs that are asked there; the key numbers cutoff and KPI.
    """
    n, words = len(specs), _words(specs)
    lists = cuts.groupBy(group, "kind").agg(F.collect_list(F.struct(F.col("axis").alias("c"), "id", *words)).alias("_cuts"))
    met = ordering.join_small(curves.where(F.col("axis").isNotNull()), F.broadcast(lists), [group, "kind"])
    held = F.filter("_cuts", lambda x: (x["c"] >= F.col("axis")) & (F.col("next").isNull() | (x["c"] < F.col("next"))))
    met = met.select(*[f"_c{i}" for i in range(n)], F.inline(held))
    whole = ordering.join_small(curves, F.broadcast(cuts.where(F.col("kind") == WHOLE).drop("kind", "axis")), [group])
    out = []
    for rows, x in ((met, "_c"), (whole, "_w")):
        cells = []
        for i, s in enumerate(specs):
            value = F.col(f"{x}{i}")
            cells.append(F.when(_has(i) & value.isNotNull(), F.struct((F.col("id") * n + i).alias("key"), _better(s, value).alias("at"))))
        out.append(rows.select(F.inline(F.array(*cells))).where(F.col("key").isNotNull()))
    return out[0].union(out[1])


def kpi_vs_group(
    df: DataFrame, specs: Iterable[MetricSpec], groups: DataFrame, group: str, routing: ViewRouting = ViewRouting(), digits: int = 6
) -> DataFrame:
    """Each KPI of each entity as percent of its group's value, with rank and group size, peers cut at the own cutoff.

    Per (entity, KPI) with a value: kind (week, step or all) and cutoff, value over all rows of the entity, the group's
    mean of values at the cutoff (for ``group_mode`` "rows" the KPI over all rows of the group there), percent of it, min-rank
    of the entity's value at the cutoff among the values there, and their number. Null where the entity has no value at its
    cutoff. ``groups`` has one row per entity; a null group is a group.
    """
    specs = list(specs)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # An entity that comes twice in a group counts its rows twice.
    mine = groups.select(ENTITY, group).repartition(n, ENTITY).groupBy(ENTITY, group).agg(F.count(F.lit(1)).alias("_times"))
    sums = kpi_sums(df, specs, routing).repartition(n, ENTITY).join(mine, ENTITY)
    least = [f"_v{i}" for i, s in enumerate(specs) if s.mode == "min"]
    states = [*[f"_v{i}" for i in range(len(specs))], *_counts(specs)]
    states = [F.col(c) if c in least else (F.col(c) * F.col("_times")).alias(c) for c in states]
    sums = ordering.settle(sums.select(ENTITY, group, STEP, "week_no", *_words(specs), *states))
    curves = store_rows(entity_curves(sums, group, specs, digits))

    # One row per (group, kind, cutoff), and per KPI of it below: calendar-sized, however many entities there are.
    curve_of = [group, "kind", "axis"]
    asks = store_rows(own_asks(curves, group, specs))
    bit = F.expr(f"shiftleft(1L, _kpi % {WORD})")
    seen = [F.bit_or(F.when(F.floor(F.col("_kpi") / WORD) == w, bit).otherwise(0)).alias(b) for w, b in enumerate(_words(specs))]
    cuts = store_rows(asks.groupBy(*curve_of).agg(*seen).withColumn("id", F.monotonically_increasing_id()))
    asks = ordering.join_small(asks, F.broadcast(cuts.select(*curve_of, "id")), curve_of)
    asks = asks.select(ENTITY, (F.col("id") * len(specs) + F.col("_kpi")).alias("key"), VALUE, "at")
    values = values_at_cutoffs(curves, cuts, group, specs)
    totals = {"_sum": F.sum(F.col("at").try_cast(KIND)), "_n": F.count("at")}
    ranks, totals = ordering.smaller_values(asks, values, "key", "at", "_better", totals)

    kpis = [F.when(_has(i), F.struct((F.col("id") * len(specs) + i).alias("key"), F.lit(s.kpi).alias("kpi"), F.lit(s.high_is_good).alias("_high"))) for i, s in enumerate(specs)]
    keys = cuts.select(*curve_of, F.inline(F.array(*kpis))).where(F.col("key").isNotNull()).join(totals, "key", "left")
    total = F.col("_sum").cast("double") / F.nullif(F.col("_n"), F.lit(0))
    keys = keys.withColumn("group_value", F.when(F.col("_high"), F.lit(0.0) - total).otherwise(total))
    if pooled := [s for s in specs if s.group_mode == "rows"]:
        cells = kpi_cells(sums.groupBy(group, STEP, "week_no").agg(*_added(specs)), [group], specs).where(_of(pooled, lambda s: True))
        curve = running_kpis(by_axis(cells), [group], specs, digits).withColumnRenamed(VALUE, "_pooled")
        keys = ordering.join_small(keys, curve, [group, "kpi", "kind", "axis"], "left")
        keys = keys.withColumn("group_value", F.when(_of(pooled, lambda s: True), F.col("_pooled")).otherwise(F.col("group_value")))
    out = ranks.join(F.broadcast(keys), "key")
    ratio = F.try_divide(F.col(VALUE) * 100, F.col("group_value"))
    cutoff, size = F.when(F.col("kind") != WHOLE, F.col("axis")), F.coalesce("_n", F.lit(0))
    rank = (F.col("_better") + 1).alias("rank")
    return out.select(ENTITY, group, "kpi", "kind", cutoff.alias("cutoff"), VALUE, "group_value", ratio.alias("ratio"), rank, size.alias("group_size"))
