"""Person scoring over a person x work table: base statistics, indices, percent ranks, grades and listings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from audira.functions import grades
from audira.functions.exact import exact_sum
from audira.operators import ordering
from audira.specs import PersonWeights

PERSON = "person"
AXES = ("burst", "stability", "contribution")


def _ratio(a: Column | str, b: Column | str) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.try_divide(a, b)


def person_base_stats(rows: DataFrame, digits: int = 4) -> DataFrame:
    """One row per person: sums, weekly-mean extremes and hit ratios.

    Sums are added as decimals and rounded once to ``digits``: persons of the same works tie in every order of addition.
    Only algebraic aggregates are used, so a person with very many rows is reduced before the shuffle.
    """
    weekly = F.try_divide(F.col("person_buzz"), F.col("weeks_ranked"))
    rank = F.col("rank_in_work")

    def zero_sum(c: str) -> Column:
        return F.coalesce(exact_sum(c, digits), F.lit(0.0))

    stats = rows.withColumn("_x", weekly).groupBy(PERSON).agg(
        zero_sum("work_buzz").alias("work_buzz"),
        zero_sum("person_buzz").alias("person_buzz"),
        F.count("*").alias("works"),
        zero_sum("weeks_ranked").alias("weeks"),
        F.max("_x").alias("best_weekly"),
        F.min("_x").alias("worst_weekly"),
        zero_sum("_x").alias("weekly_sum"),
        F.max("person_buzz").alias("_top_work"),
        *[F.count_if(rank == k).alias(f"_r{k}") for k in (1, 2, 3)],
    )
    # Weights of the first three places.
    weights = {1: 1.0, 2: 0.5, 3: 0.3}
    hits = {f"hit_{k}": F.col(f"_r{k}") * w / F.col("works") for k, w in weights.items()}
    return stats.withColumns(hits).drop(*[f"_r{k}" for k in weights])


def person_work_list(rows: DataFrame) -> DataFrame:
    """The distinct works of each person as one text in name order; only records need it, the scores do not."""
    distinct = rows.where(F.col("work").isNotNull()).select(PERSON, "work").distinct()
    return distinct.groupBy(PERSON).agg(F.array_join(F.array_sort(F.collect_list("work")), ", ").alias("work_list"))


def trimmed_work_mean(stats: DataFrame) -> DataFrame:
    """Mean weekly buzz without the worst work when there are more than two."""
    plain = F.col("weekly_sum") / F.col("works")
    less_worst = _ratio(F.col("weekly_sum") - F.col("worst_weekly"), F.col("works") - 1)
    return stats.withColumn("trimmed_mean", F.when(F.col("works") <= 2, plain).otherwise(less_worst))


def shrunk_work_mean(stats: DataFrame, prior_works: int = 3) -> DataFrame:
    """Mean buzz per work, pulled to the mean over all persons. """
    out = ordering.with_group_values(stats, [], {"_overall": F.avg(F.col("person_buzz") / F.col("works"))})
    shrunk = (F.col("person_buzz") + prior_works * F.col("_overall")) / (F.col("works") + prior_works)
    return out.withColumn("shrunk_mean", shrunk).drop("_overall")


def hit_dispersion(stats: DataFrame) -> DataFrame:
    """1 - best work's share of the person's buzz."""
    return stats.withColumn("dispersion", 1 - _ratio("_top_work", "person_buzz")).drop("_top_work")


def minmax_norm(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Scale columns to 0..1 over all rows; 0 when the range is empty."""
    ends = {f"_{n}_{c}": f(c) for c in columns for n, f in (("lo", F.min), ("hi", F.max))}
    out = ordering.with_group_values(df, [], ends)
    added = {n: grades.scaled(F.col(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}")) for c, n in columns.items()}
    return out.withColumns(added).drop(*[f"_{n}_{c}" for c in columns for n in ("lo", "hi")])


def person_indices(rows: DataFrame) -> DataFrame:
    """Burst, stability and contribution index of every person."""
    stats = ordering.settle(person_base_stats(rows))
    stats = hit_dispersion(shrunk_work_mean(trimmed_work_mean(stats)))
    stats = minmax_norm(stats, {"shrunk_mean": "shrunk_norm", "dispersion": "dispersion_norm"})
    ranked = {"best_weekly": "p_best", "trimmed_mean": "p_trimmed", "work_buzz": "p_work_buzz"}
    stats = ordering.with_percentrank_inc(stats, ranked, key=PERSON)
    n = F.col("works")
    single = F.when(n == 1, F.lit(0.75)).otherwise(F.lit(1.0))
    burst = 0.5 * F.col("p_best") * single + 0.5 * F.col("p_trimmed")
    steady = (
        0.25 * F.col("shrunk_norm")
        + 0.55 * (0.7 * F.col("dispersion_norm") + 0.3 * (n / (n + 2)))
        + 0.2 * F.pow("p_best", F.lit(3.0))
    )
    stability = F.when(steady.isNotNull(), F.least(F.lit(1.0), steady))
    hits = F.col("hit_1") + F.col("hit_2") + F.col("hit_3")
    base = 0.5 * F.col("shrunk_norm") + 0.5 * (_ratio("person_buzz", "work_buzz") * hits)
    contribution = base * (0.45 + 0.55 * F.col("p_work_buzz"))
    return stats.withColumns({"burst": burst, "stability": stability, "contribution": contribution})


def person_composite_score(
    rows: DataFrame, weights: PersonWeights = PersonWeights(), digits: int = 10
) -> DataFrame:
    """All scores and grades, one row per person. Indices are rounded so that a last bit cannot split a tie."""
    out = person_indices(rows).withColumns({a: F.round(a, digits) for a in AXES})
    out = ordering.with_percentrank_inc(out, {a: f"{a}_pct" for a in AXES}, key=PERSON)
    score = 100 * (
        F.col("burst_pct") * weights.burst
        + F.col("stability_pct") * weights.stability
        + F.col("contribution_pct") * weights.contribution
    )
    axis_grades = {f"{a}_grade": grades.grade_from_percentile(f"{a}_pct") for a in AXES}
    out = out.withColumns({**axis_grades, "score": F.round(score, digits)})
    out = out.withColumn("grade", grades.grade_from_percentile(F.round(F.col("score") / 100, digits)))
    return out.withColumn("tier", grades.tier_of_grade("grade"))


def relative_scores(scored: DataFrame, group: str, suffix: str) -> DataFrame:
    """Percent rank x 100 of each axis within a group (tier, grade group or a selected set)."""
    names = {f"{a}_pct": f"{a}_{suffix}" for a in AXES}
    out = ordering.with_percentrank_inc(scored, names, [group], key=PERSON)
    return out.withColumns({name: F.col(name) * 100 for name in names.values()})


def score_order() -> list[Column]:
    return [F.col("score").desc_nulls_last(), F.col("person_buzz").desc_nulls_last(), F.col(PERSON)]


def global_row_number(scored: DataFrame) -> DataFrame:
    return ordering.with_position(scored, [], score_order(), "row_no")


def attach_person_dim(scored: DataFrame, dim: DataFrame) -> DataFrame:
    """Left join on the person; unknown persons get the unknown word. Spark picks the join by size."""
    out = scored.join(dim, PERSON, "left")
    unknown = F.lit(grades.UNKNOWN)
    return out.withColumns(
        {"gender": F.coalesce("gender", unknown), "age_group": F.coalesce("age_group", unknown)}
    )


# ---- selections ----------------------------------------------------------------------------------------------


def grade_range(upper: str | None, lower: str | None) -> list[str]:
    """Inclusive slice of the ordered grades; bounds in either order, unknown ones mean the ends."""
    names = grades.GRADES
    a = names.index(upper) if upper in names else 0
    b = names.index(lower) if lower in names else len(names) - 1
    return names[min(a, b) : max(a, b) + 1]


def candidate_filter(
    scored: DataFrame,
    gender: str | None = None,
    age_group: str | None = None,
    upper_grade: str | None = None,
    lower_grade: str | None = None,
    min_works: int = 0,
) -> DataFrame:
    out = scored.where(F.col("grade").isin(grade_range(upper_grade, lower_grade)))
    if gender:
        out = out.where(F.col("gender") == gender)
    if age_group:
        out = out.where(F.col("age_group") == age_group)
    return out.where(F.col("works") >= min_works) if min_works else out


def partner_candidates(scored: DataFrame, fixed: DataFrame, **filters) -> DataFrame:
    """Candidates without the persons that are already fixed."""
    return candidate_filter(scored.join(fixed, PERSON, "left_anti"), **filters)


# Sort columns of each focus.
FOCUS_SORT = {
    "balance": ("score", "person_buzz"),
    "burst": ("burst_pct", "score", "person_buzz"),
    "stability": ("stability_pct", "score", "person_buzz"),
    "contribution": ("contribution_pct", "score", "person_buzz"),
}


def focus_sort(scored: DataFrame, focus: str) -> DataFrame:
    """Place of each person in the focus's order; an unknown focus means balance."""
    keys = FOCUS_SORT.get(focus, FOCUS_SORT["balance"])
    order = [F.col(k).desc_nulls_last() for k in keys]
    return ordering.with_position(scored, [], [*order, F.col(PERSON)], "focus_position")


def compare_selected(scored: DataFrame, names: Iterable) -> DataFrame:
    """Chosen persons with the fixed columns, by score, and their place in the selection."""
    chosen = list(names)
    picked = scored.where(F.col(PERSON).isin(chosen))
    order = F.array_position(F.array(*[F.lit(n) for n in chosen]), F.col(PERSON))
    columns = ["gender", "age_group", "grade", "burst_grade", "stability_grade", "contribution_grade"]
    return picked.select(
        PERSON, *columns, "score", "person_buzz", "works", order.alias("selection_order")
    ).orderBy(F.col("score").desc())


def custom_order_sort(df: DataFrame, column: str, order: list[str], name: str = "place") -> DataFrame:
    """0-based place in a fixed order; unlisted values share 999 and sort by text."""
    place = F.coalesce(grades.order_in(column, order) - 1, F.lit(999))
    return df.withColumn(name, place.cast("int")).orderBy(name, column)


def top_n_per_group(scored: DataFrame, group: str, n: int = 10) -> DataFrame:
    """Best ``n`` persons of each group by score, then buzz."""
    best = ordering.keep_top(scored, [group], score_order(), n, salts=0)
    place = F.row_number().over(Window.partitionBy(group).orderBy(*score_order()))
    return best.withColumn("place", place)


def similar_persons(scored: DataFrame, n: int = 4) -> DataFrame:
    """Neighbours by score among persons of the same gender and age group: two above and two below.

    When fewer than two are above, the rest comes from below; else, when fewer are below, from above. Places are
    computed per row and met by an equality join, at most ``n`` rows per person.
    """
    groups = ["gender", "age_group"]
    # Scores are read twice, to cut ranges and to fill them, and places twice, by asks and answers: both are stored once.
    scores = ordering.settle(scored.select(*groups, PERSON, "score", "person_buzz", "grade"))
    placed = ordering.settle(ordering.with_position(scores, groups, score_order(), size="group_size"))
    pos, size = F.col("position"), F.col("group_size")
    above = F.least(F.lit(2), pos - 1)
    below = F.least(F.lit(2), size - pos)
    need = F.lit(n) - above - below
    low_end = F.when(above < 2, F.least(size, pos + below + need)).otherwise(pos + below)
    high_end = F.when(above < 2, pos - above).otherwise(F.greatest(F.lit(1), pos - above - need))
    places = F.filter(F.sequence(high_end, low_end), lambda p: p != pos)
    asks = placed.select(
        *groups, F.col(PERSON).alias("base_person"), F.col("score").alias("base_score"), F.explode(places).alias("at")
    )
    found = placed.withColumnRenamed("position", "at").drop("group_size")
    out = asks.join(found, [*groups, "at"])
    gap = F.col("score") - F.col("base_score")
    return out.select(
        "base_person",
        PERSON,
        "grade",
        "score",
        gap.alias("score_gap"),
        F.when(gap > 0, F.lit("위")).otherwise(F.lit("아래")).alias("relative_position"),
    )


def similar_axis_strength(pairs: DataFrame, scored: DataFrame) -> DataFrame:
    """Strength label of each axis for (base_person, person) pairs."""
    pcts = [f"{a}_pct" for a in AXES]
    base = scored.select(F.col(PERSON).alias("base_person"), *[F.col(p).alias(f"_b_{p}") for p in pcts])
    cand = scored.select(PERSON, *pcts)
    out = pairs.select("base_person", PERSON).join(base, "base_person").join(cand, PERSON)
    labels = [grades.axis_strength_label(p, f"_b_{p}").alias(f"{a}_strength") for a, p in zip(AXES, pcts, strict=True)]
    return out.select("base_person", PERSON, *labels)


# ---- summaries -----------------------------------------------------------------------------------------------


def known_people(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("gender").isin("남", "여") & F.col("age_group").isin(grades.AGE_GROUPS))


def grade_demographic_crosstab(scored: DataFrame) -> DataFrame:
    """Grade x (gender + age) shares per grade in percent, on the fixed grid."""
    cells = [f"{g}{a.replace('대', '')}" for g in ("남", "여") for a in grades.AGE_GROUPS]
    cell = F.concat("gender", F.regexp_replace("age_group", "대", ""))
    people = known_people(scored).withColumn("_cell", cell)
    counts = people.groupBy("grade").agg(
        F.count("*").alias("_n"), *[F.count_if(F.col("_cell") == c).alias(c) for c in cells]
    )
    grid = scored.sparkSession.range(1).select(F.explode(F.array(*[F.lit(g) for g in grades.GRADES])).alias("grade"))
    out = grid.join(counts, "grade", "left")
    return out.select("grade", *[F.coalesce(F.try_divide(F.col(c) * 100, F.col("_n")), F.lit(0.0)).alias(c) for c in cells])


def grade_gender_age_hierarchy(scored: DataFrame) -> DataFrame:
    """Counts at the levels all, grade, gender and age."""
    out = known_people(scored).rollup("grade", "gender", "age_group").agg(
        F.count("*").alias("persons"), F.grouping_id().alias("_g")
    )
    level = F.when(F.col("_g") == 7, F.lit("all")).when(F.col("_g") == 3, F.lit("grade"))
    level = level.when(F.col("_g") == 1, F.lit("gender")).otherwise(F.lit("age"))
    return out.select("grade", "gender", "age_group", level.alias("level"), "persons")


def dominant_group(scored: DataFrame) -> DataFrame:
    """Most frequent gender x age group overall, in S, in S/A and in B/C, with its share.

    The counts have a handful of rows per scope, so the last ranking is small.
    """
    tier = F.substring("grade", 1, 1)
    scopes = F.array(
        F.lit("all"),
        F.when(tier == "S", F.lit("S")),
        F.when(tier.isin("S", "A"), F.lit("S/A")),
        F.when(tier.isin("B", "C"), F.lit("B/C")),
    )
    people = known_people(scored).select("gender", "age_group", F.explode(scopes).alias("scope"))
    counts = people.where(F.col("scope").isNotNull()).groupBy("scope", "gender", "age_group").agg(F.count("*").alias("persons"))
    by_scope = Window.partitionBy("scope")
    best = by_scope.orderBy(F.col("persons").desc(), "gender", "age_group")
    out = counts.withColumn("_k", F.row_number().over(best)).withColumn("scope_size", F.sum("persons").over(by_scope))
    share = F.col("persons") * 100 / F.col("scope_size")
    return out.where(F.col("_k") == 1).select("scope", "gender", "age_group", "persons", "scope_size", share.alias("share"))


def person_work_summary(rows: DataFrame, n: int | None = None) -> DataFrame:
    """Per person and work: sums, best rank and place by buzz; with ``n`` only the first places."""
    work = F.lower(F.trim("work"))
    kept = rows.where(work.isNotNull() & (work != "") & ~work.isin("nan", "none", "null"))
    out = kept.groupBy(PERSON, F.trim("work").alias("work")).agg(
        F.sum("person_buzz").alias("person_buzz"),
        F.sum("work_buzz").alias("work_buzz"),
        F.sum("weeks_ranked").alias("weeks_ranked"),
        F.min("rank_in_work").alias("best_rank"),
    )
    order = [F.col("person_buzz").desc_nulls_last(), F.col("weeks_ranked").desc_nulls_last(), F.col("work")]
    if n is not None:
        # At most ``n`` rows of a person are left, in one task.
        best = ordering.keep_top(out, [PERSON], order, n, salts=0)
        return best.withColumn("place", F.row_number().over(Window.partitionBy(PERSON).orderBy(*order)).cast("bigint"))
    return ordering.with_position(out, [PERSON], order, "place")


def group_grade_profile(scored: DataFrame, group: str) -> DataFrame:
    """Per group: persons by grade and by tier, and mean, max and min of the three percent ranks."""
    stats = [f(F.col(f"{a}_pct") * 100).alias(f"{a}_{n}") for a in AXES for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    by_grade = [F.count_if(F.col("grade") == g).alias(f"grade_{g}") for g in grades.GRADES]
    by_tier = [F.count_if(F.col("grade").startswith(t)).alias(f"tier_{t}") for t in ("S", "A", "B", "C")]
    return scored.groupBy(group).agg(*by_grade, *by_tier, *stats)


def group_extremes(scored: DataFrame, group: str) -> DataFrame:
    """Best and worst person per group by score and by each axis. Ties go to the smaller name at the top."""
    outs = []
    for name, first, second in [("score", "score", "person_buzz"), *[(a, f"{a}_pct", "score") for a in AXES]]:
        known = F.when(F.col(first).isNotNull(), F.col(PERSON))
        # Descending order written as a min over negated keys, so that the name breaks ties upwards.
        key = F.struct(-F.col(first), -F.col(second), F.col(PERSON))
        order = F.when(F.col(first).isNotNull(), key)
        outs += [F.min_by(known, order).alias(f"{name}_best"), F.max_by(known, order).alias(f"{name}_worst")]
    return scored.groupBy(group).agg(*outs)


def group_position(scored: DataFrame, groups: list[str]) -> DataFrame:
    """Place k of n by score in the group: first is top, last is bottom, the rest middle."""
    out = ordering.with_position(scored.select(*groups, PERSON, "score", "person_buzz"), groups, score_order(), size="group_size")
    pos = F.col("position")
    label = F.when(pos == 1, F.lit("상위")).when(pos < F.col("group_size"), F.lit("중위")).otherwise(F.lit("하위"))
    return out.select(*groups, PERSON, "position", "group_size", label.alias("place_label"))


def person_record_json(scored: DataFrame, rows: DataFrame, n: int = 3) -> DataFrame:
    """One JSON record per person: rounded scores and the text of the first works."""
    works = person_work_summary(rows, n)

    def whole(c: str) -> Column:
        # Sums are first rounded finely: their last bits depend on the order of addition.
        return F.format_string("%d", F.coalesce(F.round(F.round(F.col(c), 6)), F.lit(0.0)).cast("bigint"))

    item = F.concat(
        "work", F.lit("(배우화제성 "), whole("person_buzz"), F.lit(", 드라마화제성 "), whole("work_buzz"),
        F.lit(", 랭크인주차 "), whole("weeks_ranked"), F.lit(", 최고 작품내랭킹 "), whole("best_rank"), F.lit(")"),
    )
    # At most ``n`` items per person are collected.
    listed = F.array_sort(F.collect_list(F.struct("place", item.alias("item"))))
    text = works.groupBy(PERSON).agg(F.array_join(F.transform(listed, lambda s: s["item"]), "; ").alias("works_text"))
    out = scored.join(text, PERSON, "left").join(person_work_list(rows), PERSON, "left")
    record = F.struct(
        F.col(PERSON).cast("string").alias("person"),
        "gender",
        "age_group",
        "grade",
        F.round("score", 2).alias("score"),
        *[F.col(f"{a}_grade").alias(a) for a in AXES],
        *[F.round(F.col(f"{a}_pct") * 100, 1).alias(f"{a}_pct") for a in AXES],
        F.round(F.round("person_buzz", 6)).cast("bigint").alias("person_buzz"),
        F.col("works").cast("bigint").alias("works"),
        F.col("work_list"),
        F.coalesce("works_text", F.lit("전작 정보 없음")).alias("works_text"),
    )
    return out.select(PERSON, F.to_json(record, {"ignoreNullFields": "false"}).alias("record"))
