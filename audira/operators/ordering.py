"""Ranks, positions and running sums that never gather an unbounded group in one task.

A window over a group runs as one task per group, and a group may hold a third of a table. ``running_sums`` therefore
range-partitions the rows on (group, order), stores the range number with each row in the checkpoint folder, turns
partition totals into offsets and sums each range on its own. There is this one form for every size of input.

The order must be total (unique within the group) for positions. Ranks need no total order: ``weights_around`` leaves rows in
the range that holds their value and completes only the values that cross a boundary. Groups are compared null-safe: rows
without a group are a group of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from audira.session import cut_lineage, store_rows


def _window(groups: list[str]):
    return Window.partitionBy(*[F.col(g) for g in groups])


def _same_keys(left: str, right: str, keys: list[str]) -> Column:
    tests = [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]
    return reduce(lambda a, b: a & b, tests)


def long_form(df: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """One row per key and column, as ``unpivot``, but it keeps the partitioning by key for the next step."""
    cells = [F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns]
    return df.select(*keys, F.inline(F.array(*cells)))


def with_scalars(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table to every row, as scalar subqueries: no join."""
    one = row.select(F.struct(*row.columns).alias("_one")).scalar()
    return df.withColumns({c: one[c] for c in row.columns})


def join_small(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe join with a table of values per key; keys that repeat in ``small`` repeat the rows."""
    joined = big.alias("l").join(small.alias("r"), _same_keys("l", "r", keys), how)
    return joined.select("l.*", *[F.col(f"r.{c}") for c in small.columns if c not in keys])


def with_group_values(df: DataFrame, groups: list[str], aggs: dict[str, Column]) -> DataFrame:
    """Add aggregates of the row's group, joined back; without groups they are global, as scalars."""
    values = df.groupBy(*groups).agg(*[a.alias(n) for n, a in aggs.items()])
    return join_small(df, values, groups) if groups else with_scalars(df, values)


def settle(df: DataFrame) -> DataFrame:
    """Rows that several later steps read: computed and written once."""
    return cut_lineage(df)


def _ranged(df: DataFrame, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """The rows with their range number (_range), stored, and the same rows dealt so that each task holds one range.

    There are as many ranges as ``spark.sql.shuffle.partitions``. The number is given, so that AQE does not merge ranges: it
    would into about one for each core, and a task's windows would grow with the table.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    return ranged, ranged.repartitionById(n, F.col("_range"))


def running_sums(
    df: DataFrame,
    groups: list[str],
    order: list[Column],
    weight: Column | None = None,
    before: str = "before",
    total: str | None = "total",
) -> DataFrame:
    """Add the weight sum of all earlier rows of the group, and of the whole group.

    ``order`` must be unique within a group. Rows of equal weight 1 give ``row_number() - 1`` and the group size.
    """
    weight = F.lit(1).cast("bigint") if weight is None else weight
    ranged, dealt = _ranged(df.withColumn("_w", weight), [*[F.col(g) for g in groups], *order])
    per_range = ranged.groupBy(*groups, "_range").agg(F.sum("_w").alias("_sum"))
    earlier = _window(groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    offsets = offsets.withColumn("_total", F.sum("_sum").over(_window(groups)))
    # Stored, so that Spark knows their size: small ones are broadcast, and the rows are not shuffled to meet them.
    offsets = store_rows(offsets)
    inside = _window([*groups, "_range"]).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("_local", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    joined = local.alias("l").join(offsets.alias("o"), _same_keys("l", "o", [*groups, "_range"]))
    kept = [F.col(f"l.{c}") for c in df.columns]
    out = [*kept, (F.col("o._offset") + F.col("l._local")).alias(before)]
    return joined.select(*out, *([F.col("o._total").alias(total)] if total else []))


def with_position(
    df: DataFrame, groups: list[str], order: list[Column], name: str = "position", size: str | None = None
) -> DataFrame:
    """``row_number`` (and group size) over a total order."""
    out = running_sums(df, groups, order, before="_before", total=size)
    return out.withColumn(name, F.col("_before") + 1).drop("_before")


def weights_around(
    df: DataFrame, groups: list[str], value: str, weight: Column, less: str = "less", equal: str = "equal", total: str = "total"
) -> DataFrame:
    """Add the weight sums of the group's rows with a smaller value, with the row's own value, and of all with a value.

    Rows stay in the range partition that holds their value; nothing is joined on a value. A value whose rows cross a
    boundary between partitions is completed by an exchange of one row per (group, partition): the first and last value
    of it there, and their weights. So a value that half the rows share is spread like any other. Rows without a value
    weigh nothing; their sums are those of their partition, except the total.
    """
    groups = list(groups)
    names = [*df.columns]
    has = F.col(value).isNotNull()
    # A struct compares null-safe as a whole, so later steps stay partitioned by it.
    key = F.struct(F.lit(0).alias("_all"), *[F.col(g) for g in groups])
    spread = F.xxhash64(*[F.col(c) for c in names])
    weighed = df.withColumns({"_w": F.when(has, weight).otherwise(0).cast("bigint"), "_key": key})
    ranged, dealt = _ranged(weighed, [*[F.col(g) for g in groups], F.col(value), spread])
    here = ["_key", "_range"]
    upto = _window(here).orderBy(value)
    local = dealt.withColumns({"_upto": F.sum("_w").over(upto), "_equal": F.sum("_w").over(_window([*here, value]))})
    distinct = ranged.groupBy(*here, value).agg(F.sum("_w").alias("_w"))
    ends = distinct.groupBy(*here).agg(
        F.sum("_w").alias("_sum"), F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.min_by("_w", value).alias("_w_lo"), F.max_by("_w", value).alias("_w_hi")
    )
    # From here on one row per group and partition that holds it.
    in_order = _window(["_key"]).orderBy("_range")
    ends = ends.withColumns(
        {
            "_before": F.coalesce(F.sum("_sum").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_total": F.sum("_sum").over(_window(["_key"])),
        }
    )
    low, high = (F.struct(F.col(x).alias("_x"), F.col(w).alias("_wx"), F.lit(first).alias("_first")) for x, w, first in (("_lo", "_w_lo", True), ("_hi", "_w_hi", False)))
    sides = F.array(low, high)
    marks = ends.select(*here, "_before", "_total", "_lo", "_hi", F.inline(F.when(F.col("_lo") == F.col("_hi"), F.slice(sides, 1, 1)).otherwise(sides)))
    same_value = _window(["_key", "_x"]).orderBy("_range")
    marks = marks.withColumns(
        {
            "_earlier": F.coalesce(F.sum("_wx").over(same_value.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_later": F.coalesce(F.sum("_wx").over(same_value.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)),
        }
    )
    only = F.col("_lo") == F.col("_hi")
    bounds = marks.groupBy(*here).agg(
        F.first("_before").alias("_before"),
        F.first("_total").alias("_total"),
        F.first("_lo").alias("_lo"),
        F.first("_hi").alias("_hi"),
        F.max(F.when(F.col("_first"), F.col("_earlier"))).alias("_earlier"),
        F.max(F.when(~F.col("_first") | only, F.col("_later"))).alias("_later"),
    )
    joined = local.join(store_rows(bounds), here)
    at_lo, at_hi = F.col(value) == F.col("_lo"), F.col(value) == F.col("_hi")
    earlier, later = F.when(at_lo, F.col("_earlier")).otherwise(0), F.when(at_hi, F.col("_later")).otherwise(0)
    return joined.select(
        *names,
        (F.col("_before") + F.col("_upto") - F.col("_equal") - earlier).alias(less),
        (F.col("_equal") + earlier + later).alias(equal),
        F.col("_total").alias(total),
    )


#: Levels of the search for a value's place among the splits of its key: 2^6 - 1 splits.
SPLIT_LEVELS = 6


def _in_buckets(df: DataFrame, splits: DataFrame, key: str, value: str) -> DataFrame:
    """The bucket of each row among the splits of its key: twice the number of smaller splits, and 1 more for a split's value."""
    out = df.join(F.broadcast(splits), key, "left").withColumn("_place", F.lit(0))
    for level in reversed(range(SPLIT_LEVELS)):
        beyond = F.get("_splits", F.col("_place") + (2**level - 1)) < F.col(value)
        out = out.withColumn("_place", F.col("_place") + F.when(beyond, 2**level).otherwise(0))
    on_split = F.coalesce(F.get("_splits", "_place") == F.col(value), F.lit(False))
    return out.withColumn("_bucket", F.col("_place") * 2 + on_split.cast("int")).drop("_splits", "_place")


def smaller_values(
    asks: DataFrame, values: DataFrame, key: str, value: str, name: str, totals: dict[str, Column]
) -> tuple[DataFrame, DataFrame]:
    """Add to each ask how many of its key's values are smaller than its own; and sums over each key's values (``totals``).

    ``asks`` has (key, value, ..), ``values`` (key, value) without nulls. There may be many rows of a key, but the keys are few: the
    quantiles of a key's asks are broadcast, and cut its values into buckets, which are counted where the rows are. An ask whose
    value is a split, as any value is that many asks share, or of a key with few asks, is answered by the counts alone. Only the
    other asks, and only the values in their buckets, are shuffled, to be ordered within the bucket. Both tables are read more
    than once and must be the same rows each time. An ask without a value gets null.
    """
    at = [i / 2**SPLIT_LEVELS for i in range(1, 2**SPLIT_LEVELS)]
    known = asks.where(F.col(value).isNotNull())
    splits = store_rows(known.groupBy(key).agg(F.percentile_approx(value, at, 1000).alias("_splits")))
    placed = _in_buckets(values, splits, key, value)
    counts = store_rows(placed.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_count"), *[c.alias(n) for n, c in totals.items()]))
    sums = counts.groupBy(key).agg(*[F.sum(n).alias(n) for n in totals])

    # Stored, as the search for the bucket would be repeated in each filter on it, also in those that joins infer.
    names = asks.columns
    asked = store_rows(_in_buckets(asks, splits, key, value))
    buckets = store_rows(asked.where(F.col(value).isNotNull()).select(key, "_bucket").distinct())
    earlier = _window([key]).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    every = counts.select(key, "_bucket", "_count").union(buckets.select(key, "_bucket", F.lit(0))).groupBy(key, "_bucket").agg(F.sum("_count").alias("_count"))
    before = every.select(key, "_bucket", F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_before"))
    asked = asked.join(before, [key, "_bucket"], "left").withColumn("_open", F.col(value).isNotNull() & (F.col("_bucket") % 2 == 0))
    answered = asked.where(~F.col("_open")).select(*names, F.when(F.col(value).isNotNull(), F.col("_before")).alias(name))
    among = placed.join(store_rows(buckets.where("_bucket % 2 = 0")), [key, "_bucket"], "left_semi")
    rows = asked.where("_open").drop("_open").withColumn("_w", F.lit(0)).unionByName(among.withColumn("_w", F.lit(1)), allowMissingColumns=True)
    # Asks come before the values that equal theirs.
    upto = _window([key, "_bucket"]).orderBy(value, "_w").rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("_inside", F.sum("_w").over(upto)).where("_w = 0")
    return answered.union(counted.select(*names, (F.col("_before") + F.col("_inside")).alias(name))), sums


def with_ranks(
    df: DataFrame,
    value: str,
    groups: list[str] = (),
    rank_asc: str = "rank_asc",
    rank_desc: str = "rank_desc",
    ties: str = "ties",
    n: str = "n",
) -> DataFrame:
    """Add min-ranks in both directions, the tie count and the count of known values.

    Null values get null ranks; ``n`` counts the known values of the group.
    """
    out = weights_around(df, list(groups), value, F.lit(1), "_less", "_equal", n)
    has = F.col(value).isNotNull()
    return out.withColumns(
        {
            ties: F.when(has, F.col("_equal")),
            rank_asc: F.when(has, F.col("_less") + 1),
            rank_desc: F.when(has, F.col(n) - F.col("_less") - F.col("_equal") + 1),
        }
    ).drop("_less", "_equal")


RANK_PARTS = ("_up", "_down", "_ties", "_n")


def with_pct_rank_avg(df: DataFrame, value: str, groups: list[str] = (), name: str = "pct") -> DataFrame:
    """Average rank over the count of known values, in 0..1; null stays null."""
    out = with_ranks(df, value, groups, *RANK_PARTS)
    pct = (F.col("_up") + (F.col("_ties") - 1) / 2.0) / F.col("_n")
    return out.withColumn(name, F.when(F.col(value).isNotNull(), pct)).drop(*RANK_PARTS)


def with_quintile(df: DataFrame, value: str, groups: list[str] = (), name: str = "quintile") -> DataFrame:
    """1 (best fifth) to 5 by descending average rank; null stays null."""
    from audira.functions.grades import quintile_index

    out = with_ranks(df, value, groups, *RANK_PARTS)
    return out.withColumn(name, quintile_index(F.col("_down"), F.col("_ties"), F.col("_n"))).drop(*RANK_PARTS)


def with_percentrank_inc(df: DataFrame, values: dict[str, str], groups: list[str] = (), key: str | None = None) -> DataFrame:
    """Add (min rank - 1) / (group rows - 1) of each value column; 1 for a single row.

    Rows without a value count as rows, but stay null. ``values`` maps a column to the name of its rank. With ``key``, a
    column that names each row, all columns are ranked side by side and written once; else one after the other.
    """
    groups = list(groups)
    if key is not None and len(values) > 1:
        fixed = cut_lineage(df)
        long = long_form(fixed, [key, *groups], list(values), "_column", "_value")
        ranked = weights_around(long, [*groups, "_column"], "_value", F.lit(1), "_less", "_equal", "_known").where(F.col("_value").isNotNull())
        cells = {f"_less_{c}": F.max(F.when(F.col("_column") == c, F.col("_less"))) for c in values}
        wide = ranked.groupBy(F.col(key).alias("_id")).agg(*[a.alias(c) for c, a in cells.items()])
        out = fixed.join(wide, F.col(key) == F.col("_id"), "left").drop("_id")
        out = with_group_values(out, groups, {"_rows": F.count(F.lit(1))})
    else:
        out = df
        for c in values:
            out = weights_around(out, groups, c, F.lit(1), f"_less_{c}", f"_equal_{c}", f"_known_{c}").drop(f"_equal_{c}", f"_known_{c}")
        out = with_group_values(out, groups, {"_rows": F.count(F.lit(1))})
    single, rest = F.col("_rows") <= 1, F.col("_rows") - 1
    added = {n: F.when(single, F.lit(1.0)).when(F.col(c).isNotNull(), F.col(f"_less_{c}") / rest) for c, n in values.items()}
    return out.withColumns(added).drop("_rows", *[f"_less_{c}" for c in values])


def keep_top(df: DataFrame, groups: list[str], order: list[Column], n: int, salts: int = 64) -> DataFrame:
    """First ``n`` rows per group over a total order.

    A hot group is first cut to ``n`` rows in each of ``salts`` slices, so the last step sees ``n * salts`` rows. With 0 slices
    the rows are shuffled once: for a small ``n``, where Spark cuts each task's rows to ``n`` per group before the shuffle.
    """
    rank = "_top"
    outer = _window(groups).orderBy(*order)
    if not salts:
        return df.withColumn(rank, F.row_number().over(outer)).where(F.col(rank) <= n).drop(rank)
    sliced = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts)))
    inner = Window.partitionBy(*[F.col(g) for g in groups], "_salt").orderBy(*order)
    df = sliced.withColumn(rank, F.row_number().over(inner)).where(F.col(rank) <= n).drop(rank, "_salt")
    return df.withColumn(rank, F.row_number().over(outer)).where(F.col(rank) <= n).drop(rank)


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float]) -> DataFrame:
    """One row with linearly interpolated quantiles, from a distributed running count of distinct values."""
    histogram = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c"))
    placed = running_sums(histogram, [], [F.col(value)], F.col("_c"), before="_before", total="_n")

    def at(place: Column) -> Column:
        inside = (F.col("_before") <= place) & (place < F.col("_before") + F.col("_c"))
        return F.max(F.when(inside, F.col(value)))

    outs = []
    for name, p in probs.items():
        exact = (F.col("_n") - 1) * F.lit(p)
        low, frac = F.floor(exact), exact - F.floor(exact)
        high = F.least(low + 1, F.col("_n") - 1)
        outs += [at(low).alias(f"_lo_{name}"), at(high).alias(f"_hi_{name}"), F.max(frac).alias(f"_f_{name}")]
    wide = placed.agg(*outs)
    return wide.select(
        *[
            (F.col(f"_lo_{k}") + (F.col(f"_hi_{k}") - F.col(f"_lo_{k}")) * F.col(f"_f_{k}")).alias(k)
            for k in probs
        ]
    )


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column], null_keys: bool = True) -> DataFrame:
    """One row per key, the greatest by ``order``; of rows that tie one is taken by a digest, rows that repeat count once.

    In two phases. First only key, order and digest: each task cuts its rows to one per key before the shuffle, so a hot key
    sends one narrow row from each task. Then the whole rows of the winners, by a semi-join on key and digest; the rows that
    lost are not moved when the winners are few, and never sorted whole. ``df`` is read twice and must be the same rows both
    times (a table, or what follows from tables alone). Without ``null_keys`` rows with a null key are left out, and a table
    that is stored by its keys is not shuffled.
    """
    if not null_keys:
        df = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    by = {f"_o{i}": c for i, c in enumerate(order)}
    digest = F.xxhash64(*[F.col(c) for c in df.columns])
    best = _window(keys).orderBy(*[F.col(c).desc() for c in (*by, "_digest")])
    narrow = df.select(*keys, *[c.alias(n) for n, c in by.items()], digest.alias("_digest"))
    winners = narrow.withColumn("_k", F.row_number().over(best)).where("_k = 1").select(*keys, "_digest")
    rows = df.withColumn("_digest", digest)
    if null_keys:
        rows = rows.alias("l").join(winners.alias("r"), _same_keys("l", "r", [*keys, "_digest"]), "left_semi")
    else:
        # One winner per key, so the key alone joins: an equality of digests beside it would ask for another partitioning.
        met = rows.join(winners.withColumnRenamed("_digest", "_best"), keys)
        rows = met.where(F.col("_digest").bitwiseXOR(F.col("_best")) == 0).select(*df.columns, "_digest")
    # Rows that repeat as a whole are left: one of them stays.
    return rows.withColumn("_k", F.row_number().over(_window(keys).orderBy("_digest"))).where("_k = 1").select(*df.columns)
