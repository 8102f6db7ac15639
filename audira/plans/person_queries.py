"""Queries on person scoring."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from audira.functions import grades
from audira.functions.exact import exact_sum_sql
from audira.operators import ordering, persons
from audira.plans.registry import query
from audira.session import ensure_checkpoint_dir
from audira.sources import bindings as b
from audira.sources import tables
from audira.sources.bindings import PERSON_DIM_SQL, WORK_PERSON_SQL, with_ctes


def inc_sql(value: str, partition: str = "") -> str:
    by = f"PARTITION BY {partition}" if partition else ""
    return (
        f"CASE WHEN count(*) OVER ({by}) <= 1 THEN 1.0 WHEN {value} IS NULL THEN NULL ELSE"
        f" (rank() OVER ({by} ORDER BY {value} NULLS LAST) - 1) / CAST(count(*) OVER ({by}) - 1 AS DOUBLE) END"
    )


def grade_sql(p: str) -> str:
    cases = " ".join(f"WHEN {p} >= {floor} THEN '{g}'" for g, floor in grades.GRADE_FLOORS.items())
    return f"CASE WHEN {p} IS NULL THEN '' {cases} ELSE 'C' END"


TIER_SQL = "CASE WHEN grade = 'S' THEN 'S' WHEN substr(grade, 1, 1) IN ('A', 'B') THEN substr(grade, 1, 1) ELSE 'C' END"

BASE_SQL = f"""base AS (SELECT person, {exact_sum_sql("work_buzz", 4)} AS work_buzz, {exact_sum_sql("person_buzz", 4)} AS person_buzz,
  count(*) AS works, {exact_sum_sql("weeks_ranked", 4)} AS weeks, string_agg(work, ', ' ORDER BY work) AS work_list,
  max(person_buzz / weeks_ranked) AS best_weekly, min(person_buzz / weeks_ranked) AS worst_weekly,
  {exact_sum_sql("person_buzz / weeks_ranked", 4)} AS weekly_sum, max(person_buzz) AS top_work,
  count(*) FILTER (WHERE rank_in_work = 1) * 1.0 / count(*) AS hit_1,
  count(*) FILTER (WHERE rank_in_work = 2) * 0.5 / count(*) AS hit_2,
  count(*) FILTER (WHERE rank_in_work = 3) * 0.3 / count(*) AS hit_3 FROM wp GROUP BY 1)"""

SCORED_SQL = f"""{BASE_SQL},
x1 AS (SELECT *, CASE WHEN works <= 2 THEN weekly_sum / works ELSE (weekly_sum - worst_weekly) / (works - 1) END AS trimmed_mean,
  (person_buzz + 3 * (SELECT avg(person_buzz / works) FROM base)) / (works + 3) AS shrunk_mean,
  1 - top_work / person_buzz AS dispersion FROM base),
x2 AS (SELECT *, (shrunk_mean - min(shrunk_mean) OVER ()) / (max(shrunk_mean) OVER () - min(shrunk_mean) OVER ()) AS shrunk_norm,
  (dispersion - min(dispersion) OVER ()) / (max(dispersion) OVER () - min(dispersion) OVER ()) AS dispersion_norm,
  {inc_sql("best_weekly")} AS p_best, {inc_sql("trimmed_mean")} AS p_trimmed, {inc_sql("work_buzz")} AS p_work_buzz FROM x1),
x3 AS (SELECT *, round(0.5 * p_best * CASE WHEN works = 1 THEN 0.75 ELSE 1.0 END + 0.5 * p_trimmed, 10) AS burst,
  round(least(1.0, 0.25 * shrunk_norm + 0.55 * (0.7 * dispersion_norm + 0.3 * (works / CAST(works + 2 AS DOUBLE)))
    + 0.2 * pow(p_best, 3.0)), 10) AS stability,
  round((0.5 * shrunk_norm + 0.5 * (person_buzz / work_buzz * (hit_1 + hit_2 + hit_3)))
    * (0.45 + 0.55 * p_work_buzz), 10) AS contribution FROM x2),
x4 AS (SELECT *, {inc_sql("burst")} AS burst_pct, {inc_sql("stability")} AS stability_pct,
  {inc_sql("contribution")} AS contribution_pct FROM x3),
x5 AS (SELECT *, {grade_sql("burst_pct")} AS burst_grade, {grade_sql("stability_pct")} AS stability_grade,
  {grade_sql("contribution_pct")} AS contribution_grade,
  round(100 * (burst_pct * 0.4 + stability_pct * 0.3 + contribution_pct * 0.3), 10) AS score FROM x4),
x6 AS (SELECT *, {grade_sql("round(score / 100, 10)")} AS grade FROM x5),
scored AS (SELECT *, {TIER_SQL} AS tier FROM x6)"""

KNOWN_SQL = """known AS (SELECT * FROM people WHERE gender IN ('남', '여') AND age_group IN ('20대', '30대', '40대', '50대'))"""
PEOPLE_SQL = f"""{PERSON_DIM_SQL},
people AS (SELECT s.*, coalesce(gender, '미상') AS gender, birth_year, age, coalesce(age_group, '미상') AS age_group
  FROM scored s LEFT JOIN dim USING (person)), {KNOWN_SQL}"""

WP = with_ctes(WORK_PERSON_SQL)
SC = with_ctes(WORK_PERSON_SQL, SCORED_SQL)
PP = with_ctes(WORK_PERSON_SQL, SCORED_SQL, PEOPLE_SQL)
ORDER = "score DESC NULLS LAST, person_buzz DESC NULLS LAST, person"


def _scored(spark, d):
    return persons.person_composite_score(b.work_person(spark, d))


def _people(spark, d):
    return persons.attach_person_dim(_scored(spark, d), b.person_dim(spark, d))


@query(
    "person_base_stats",
    WP
    + f", {BASE_SQL}\n"
    + """SELECT person, work_buzz, person_buzz, works, weeks, work_list, best_weekly, worst_weekly, weekly_sum, hit_1, hit_2, hit_3
FROM base""",
    {"work_buzz": 1, "person_buzz": 2, "best_weekly": 4, "worst_weekly": 4, "weekly_sum": 4, "hit_1": 8, "hit_2": 8, "hit_3": 8},
)
def person_base_stats(spark, d):
    rows = b.work_person(spark, d)
    return persons.person_base_stats(rows).drop("_top_work").join(persons.person_work_list(rows), "person", "left")


@query(
    "trimmed_work_mean",
    SC + "SELECT person, works, trimmed_mean FROM scored",
    {"trimmed_mean": 4},
)
def trimmed_work_mean(spark, d):
    stats = persons.trimmed_work_mean(persons.person_base_stats(b.work_person(spark, d)))
    return stats.select("person", "works", "trimmed_mean")


@query("shrunk_work_mean", SC + "SELECT person, works, shrunk_mean FROM scored", {"shrunk_mean": 4})
def shrunk_work_mean(spark, d):
    stats = persons.shrunk_work_mean(persons.person_base_stats(b.work_person(spark, d)))
    return stats.select("person", "works", "shrunk_mean")


@query(
    "hit_dispersion",
    SC + "SELECT person, dispersion, dispersion_norm FROM scored",
    {"dispersion": 8, "dispersion_norm": 8},
)
def hit_dispersion(spark, d):
    stats = persons.hit_dispersion(persons.person_base_stats(b.work_person(spark, d)))
    return persons.minmax_norm(stats, {"dispersion": "dispersion_norm"}).select("person", "dispersion", "dispersion_norm")


SCORE_COLUMNS = [
    "person", "works", "burst", "stability", "contribution", "burst_pct", "stability_pct", "contribution_pct",
    "burst_grade", "stability_grade", "contribution_grade", "score", "grade", "tier",
]
SCORE_DIGITS = {c: 7 for c in SCORE_COLUMNS if c.endswith("_pct") or c in ("burst", "stability", "contribution", "score")}


@query("person_composite_score", SC + f"SELECT {', '.join(SCORE_COLUMNS)} FROM scored", SCORE_DIGITS)
def person_composite_score(spark, d):
    return _scored(spark, d).select(*SCORE_COLUMNS)


@query(
    "tier_relative_scores",
    SC
    + f"""SELECT person, tier, {inc_sql("burst_pct", "tier")} * 100 AS burst_tier, {inc_sql("stability_pct", "tier")} * 100
  AS stability_tier, {inc_sql("contribution_pct", "tier")} * 100 AS contribution_tier FROM scored""",
    {"burst_tier": 6, "stability_tier": 6, "contribution_tier": 6},
)
def tier_relative_scores(spark, d):
    out = persons.relative_scores(_scored(spark, d), "tier", "tier")
    return out.select("person", "tier", "burst_tier", "stability_tier", "contribution_tier")


@query(
    "grade_group_relative_scores",
    SC
    + f""", gg AS (SELECT *, CASE WHEN tier IN ('S', 'A') THEN 'S·A' ELSE tier END AS grade_group FROM scored)
SELECT person, grade_group, {inc_sql("burst_pct", "grade_group")} * 100 AS burst_group FROM gg""",
    {"burst_group": 6},
)
def grade_group_relative_scores(spark, d):
    scored = _scored(spark, d).withColumn("grade_group", grades.grade_group("grade"))
    return persons.relative_scores(scored, "grade_group", "group").select("person", "grade_group", "burst_group")


@query("global_row_number", SC + f"SELECT person, score, row_number() OVER (ORDER BY {ORDER}) AS row_no FROM scored", {"score": 7})
def global_row_number(spark, d):
    return persons.global_row_number(_scored(spark, d)).select("person", "score", "row_no")


@query(
    "attach_person_dim",
    PP + "SELECT person, grade, gender, birth_year, age, age_group FROM people",
)
def attach_person_dim(spark, d):
    return _people(spark, d).select("person", "grade", "gender", "birth_year", "age", "age_group")


@query(
    "load_person_dim",
    with_ctes(PERSON_DIM_SQL) + "SELECT person, gender, birth_year, age, age_group FROM dim",
)
def load_person_dim(spark, d):
    return b.person_dim(spark, d)


@query(
    "candidate_filter",
    PP
    + """SELECT person, gender, age_group, grade, works FROM people WHERE gender = '남' AND age_group = '30대'
AND grade IN ('A', 'B++', 'B+', 'B') AND works >= 3""",
)
def candidate_filter(spark, d):
    out = persons.candidate_filter(_people(spark, d), "남", "30대", "B", "A", 3)
    return out.select("person", "gender", "age_group", "grade", "works")


@query(
    "grade_range",
    SC + "SELECT person, grade FROM scored WHERE grade IN ('S', 'A++', 'A+')",
)
def grade_range(spark, d):
    return _scored(spark, d).where(F.col("grade").isin(persons.grade_range("S", "A+"))).select("person", "grade")


@query(
    "partner_candidates",
    PP
    + f""", fixed AS (SELECT person FROM people ORDER BY {ORDER} LIMIT 5)
SELECT person, gender, grade, works FROM people WHERE person NOT IN (SELECT person FROM fixed) AND gender = '여' AND works >= 2""",
)
def partner_candidates(spark, d):
    people = _people(spark, d)
    fixed = people.orderBy(*persons.score_order()).limit(5).select("person")
    out = persons.partner_candidates(people, fixed, gender="여", min_works=2)
    return out.select("person", "gender", "grade", "works")


@query(
    "focus_sort",
    SC
    + """SELECT person, stability_pct, row_number() OVER (ORDER BY stability_pct DESC NULLS LAST, score DESC NULLS LAST,
  person_buzz DESC NULLS LAST, person) AS focus_position FROM scored""",
    {"stability_pct": 7},
)
def focus_sort(spark, d):
    return persons.focus_sort(_scored(spark, d), "stability").select("person", "stability_pct", "focus_position")


@query(
    "compare_selected",
    PP
    + """SELECT person, gender, age_group, grade, burst_grade, stability_grade, contribution_grade, score, person_buzz, works,
  CAST(CASE person WHEN 11 THEN 1 WHEN 5 THEN 2 WHEN 29 THEN 3 END AS BIGINT) AS selection_order
FROM people WHERE person IN (11, 5, 29)""",
    {"score": 7, "person_buzz": 2},
)
def compare_selected(spark, d):
    return persons.compare_selected(_people(spark, d), [11, 5, 29])


@query(
    "custom_order_sort",
    PP
    + """SELECT age_group, count(*) AS persons, CASE age_group WHEN '20대' THEN 0 WHEN '30대' THEN 1 WHEN '40대' THEN 2
  WHEN '50대' THEN 3 WHEN '20대 미만' THEN 4 WHEN '미상' THEN 5 ELSE 999 END AS place FROM people GROUP BY 1""",
)
def custom_order_sort(spark, d):
    counts = _people(spark, d).groupBy("age_group").agg(F.count("*").alias("persons"))
    return persons.custom_order_sort(counts, "age_group", [*grades.AGE_GROUPS, grades.UNDER_TWENTY, grades.UNKNOWN])


def _top_sql(group: str) -> str:
    return f"""SELECT {group}, person, score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {group}
  ORDER BY {ORDER}) AS INTEGER) AS place FROM people) WHERE place <= 10"""


@query("top_n_per_group", PP + _top_sql("gender"), {"score": 7})
def top_n_per_group(spark, d):
    return persons.top_n_per_group(_people(spark, d), "gender").select("gender", "person", "score", "place")


@query("top_n_per_age_group", PP + _top_sql("age_group"), {"score": 7})
def top_n_per_age_group(spark, d):
    return persons.top_n_per_group(_people(spark, d), "age_group").select("age_group", "person", "score", "place")


SIMILAR_SQL = f""", p AS (SELECT *, row_number() OVER (PARTITION BY gender, age_group ORDER BY {ORDER}) AS pos,
  count(*) OVER (PARTITION BY gender, age_group) AS n FROM people),
w AS (SELECT *, least(2, pos - 1) AS up, least(2, n - pos) AS down FROM p),
r AS (SELECT *, CASE WHEN up < 2 THEN pos - up ELSE greatest(1, pos - up - (4 - up - down)) END AS lo,
  CASE WHEN up < 2 THEN least(n, pos + down + (4 - up - down)) ELSE pos + down END AS hi FROM w),
pairs_s AS (SELECT r.person AS base_person, q.person, q.grade, q.score, q.score - r.score AS score_gap,
  CASE WHEN q.score > r.score THEN '위' ELSE '아래' END AS relative_position
FROM r JOIN p q ON q.gender = r.gender AND q.age_group = r.age_group AND q.pos BETWEEN r.lo AND r.hi AND q.pos <> r.pos)"""


@query("similar_persons", PP + SIMILAR_SQL + " SELECT * FROM pairs_s", {"score": 7, "score_gap": 7})
def similar_persons(spark, d):
    return persons.similar_persons(_people(spark, d))


def _strength_sql(axis: str) -> str:
    diff = f"round(c.{axis}_pct - s.{axis}_pct, 9)"
    return f"CASE WHEN {diff} > 0.015 THEN '강' WHEN {diff} < -0.015 THEN '약' ELSE '유사' END AS {axis}_strength"


@query(
    "axis_strength_label",
    PP
    + SIMILAR_SQL
    + f""" SELECT base_person, pairs_s.person, {_strength_sql("burst")}, {_strength_sql("stability")}, {_strength_sql("contribution")}
FROM pairs_s JOIN scored s ON s.person = base_person JOIN scored c ON c.person = pairs_s.person""",
)
def axis_strength_label(spark, d):
    # One reading of the scores feeds the pairs and both joins.
    people = _people(spark, d)
    for axis in persons.AXES:
        people = people.withColumn(f"{axis}_pct", F.round(f"{axis}_pct", 9))
    return persons.similar_axis_strength(persons.similar_persons(people), people)


@query(
    "grade_demographic_crosstab",
    PP
    + ", k AS (SELECT *, gender || replace(age_group, '대', '') AS cell FROM known)\nSELECT g.grade"
    + "".join(
        f", coalesce(count(*) FILTER (WHERE cell = '{g}{a}') * 100.0 / nullif(count(k.person), 0), 0.0) AS \"{g}{a}\""
        for g in ("남", "여")
        for a in (20, 30, 40, 50)
    )
    + f" FROM (VALUES {', '.join(f'({chr(39)}{g}{chr(39)})' for g in grades.GRADES)}) g(grade) LEFT JOIN k ON k.grade = g.grade GROUP BY 1",
    {f"{g}{a}": 6 for g in ("남", "여") for a in (20, 30, 40, 50)},
)
def grade_demographic_crosstab(spark, d):
    return persons.grade_demographic_crosstab(_people(spark, d))


@query(
    "grade_gender_age_hierarchy",
    PP
    + """SELECT grade, gender, age_group, CASE grouping(grade) + grouping(gender) + grouping(age_group) WHEN 3 THEN 'all'
  WHEN 2 THEN 'grade' WHEN 1 THEN 'gender' ELSE 'age' END AS level, count(*) AS persons FROM known
GROUP BY ROLLUP (grade, gender, age_group)""",
)
def grade_gender_age_hierarchy(spark, d):
    return persons.grade_gender_age_hierarchy(_people(spark, d))


@query(
    "dominant_group",
    PP
    + """, s AS (SELECT 'all' AS scope, gender, age_group FROM known UNION ALL
  SELECT 'S', gender, age_group FROM known WHERE tier = 'S' UNION ALL
  SELECT 'S/A', gender, age_group FROM known WHERE tier IN ('S', 'A') UNION ALL
  SELECT 'B/C', gender, age_group FROM known WHERE tier IN ('B', 'C')),
c AS (SELECT scope, gender, age_group, count(*) AS persons FROM s GROUP BY 1, 2, 3),
o AS (SELECT *, CAST(sum(persons) OVER (PARTITION BY scope) AS BIGINT) AS scope_size,
  row_number() OVER (PARTITION BY scope ORDER BY persons DESC, gender, age_group) AS k FROM c)
SELECT scope, gender, age_group, persons, scope_size, persons * 100.0 / scope_size AS share FROM o WHERE k = 1""",
    {"share": 6},
)
def dominant_group(spark, d):
    return persons.dominant_group(_people(spark, d))


WORK_SUMMARY_SQL = """, ws AS (SELECT person, work, sum(person_buzz) AS person_buzz, sum(work_buzz) AS work_buzz,
  sum(weeks_ranked) AS weeks_ranked, min(rank_in_work) AS best_rank FROM wp GROUP BY 1, 2),
wsp AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY person_buzz DESC, weeks_ranked DESC, work) AS place FROM ws)"""


@query(
    "person_work_summary",
    WP + WORK_SUMMARY_SQL + " SELECT * FROM wsp WHERE place <= 3",
    {"person_buzz": 2, "work_buzz": 1},
)
def person_work_summary(spark, d):
    return persons.person_work_summary(b.work_person(spark, d), 3)


@query(
    "group_grade_profile",
    PP
    + "SELECT gender"
    + "".join(f", count(*) FILTER (WHERE grade = '{g}') AS \"grade_{g}\"" for g in grades.GRADES)
    + "".join(f", count(*) FILTER (WHERE tier = '{t}') AS tier_{t}" for t in "SABC")
    + "".join(f", {f}({a}_pct * 100) AS {a}_{n}" for a in persons.AXES for n, f in (("mean", "avg"), ("max", "max"), ("min", "min")))
    + " FROM people GROUP BY 1",
    {f"{a}_{n}": 6 for a in persons.AXES for n in ("mean", "max", "min")},
)
def group_grade_profile(spark, d):
    return persons.group_grade_profile(_people(spark, d), "gender")


def _extreme_sql(name: str, first: str, second: str) -> str:
    top = f"ORDER BY {first} DESC, {second} DESC, person"
    low = f"ORDER BY {first}, {second}, person DESC"
    return f"first(person {top}) AS {name}_best, first(person {low}) AS {name}_worst"


@query(
    "group_extremes",
    PP
    + f"""SELECT age_group, {_extreme_sql("score", "score", "person_buzz")}, {_extreme_sql("burst", "burst_pct", "score")},
  {_extreme_sql("stability", "stability_pct", "score")}, {_extreme_sql("contribution", "contribution_pct", "score")}
FROM people GROUP BY 1""",
)
def group_extremes(spark, d):
    return persons.group_extremes(_people(spark, d), "age_group")


@query(
    "group_position",
    PP
    + f"""SELECT gender, person, position, group_size, CASE WHEN position = 1 THEN '상위' WHEN position < group_size THEN '중위'
  ELSE '하위' END AS place_label FROM (SELECT gender, person, row_number() OVER (PARTITION BY gender ORDER BY {ORDER}) AS position,
  count(*) OVER (PARTITION BY gender) AS group_size FROM people)""",
)
def group_position(spark, d):
    return persons.group_position(_people(spark, d), ["gender"])


@query(
    "distinct_counts",
    WP + "SELECT count(*) AS total_rows, count(DISTINCT person) AS persons, count(DISTINCT work) AS works FROM wp",
)
def distinct_counts(spark, d):
    return tables.distinct_counts(b.work_person(spark, d), {"persons": F.col("person"), "works": F.col("work")})


@query(
    "distinct_counts_by_partition",
    WP
    + """, c AS (SELECT work, count(*) AS total_rows, count(DISTINCT person) AS persons FROM wp GROUP BY 1)
SELECT work, total_rows, true AS within_bound FROM c UNION ALL SELECT NULL, sum(total_rows)::BIGINT, true FROM c""",
)
def distinct_counts_by_partition(spark, d):
    """Sketches stored per work and united on read: each count, and that of all works, within 3 % of the exact one."""
    rows = b.work_person(spark, d)
    path = f"{ensure_checkpoint_dir(spark)}/audira-sketches-{uuid.uuid4().hex}"
    tables.distinct_sketches(rows, ["work"], {"persons": F.col("person")}).write.parquet(path)
    stored = spark.read.parquet(path)
    exact = rows.groupBy("work").agg(F.count_distinct("person").alias("_exact"))
    each = tables.united_counts(stored, ["persons"], ["work"]).join(exact, "work")
    whole = ordering.with_scalars(tables.united_counts(stored, ["persons"]), rows.agg(F.count_distinct("person").alias("_exact")))
    whole = whole.select(F.lit(None).cast("string").alias("work"), "*")
    near = F.abs(F.col("persons") - F.col("_exact")) <= 0.03 * F.col("_exact")
    return each.unionByName(whole).select("work", "total_rows", near.alias("within_bound"))


@query(
    "minmax_norm",
    WP
    + """SELECT person, work, (person_buzz - min(person_buzz) OVER ()) / (max(person_buzz) OVER () - min(person_buzz) OVER ()) AS norm
FROM wp""",
    {"norm": 8},
)
def minmax_norm(spark, d):
    return persons.minmax_norm(b.work_person(spark, d), {"person_buzz": "norm"}).select("person", "work", "norm")


@query(
    "person_record_json",
    PP
    + WORK_SUMMARY_SQL
    + """, wt AS (SELECT person, string_agg(work || '(배우화제성 ' || CAST(round(round(person_buzz, 6)) AS BIGINT) || ', 드라마화제성 '
  || CAST(round(round(work_buzz, 6)) AS BIGINT) || ', 랭크인주차 ' || CAST(weeks_ranked AS BIGINT) || ', 최고 작품내랭킹 '
  || CAST(best_rank AS BIGINT) || ')', '; ' ORDER BY place) AS works_text FROM wsp WHERE place <= 3 GROUP BY 1)
SELECT person, CAST(person AS VARCHAR) AS r_person, gender AS r_gender, grade AS r_grade, burst_grade AS r_burst,
  CAST(round(round(person_buzz, 6)) AS BIGINT) AS r_buzz, work_list AS r_works, works_text AS r_text FROM people JOIN wt USING (person)""",
)
def person_record_json(spark, d):
    # Rows of the record are read back, so that both engines compare values and not number formats.
    # The pairs are stored once, for the scores and for both lists of works.
    rows = ordering.settle(b.work_person(spark, d))
    people = persons.attach_person_dim(persons.person_composite_score(rows), b.person_dim(spark, d))
    out = persons.person_record_json(people, rows)
    shape = "struct<person:string,gender:string,grade:string,burst:string,person_buzz:bigint,work_list:string,works_text:string>"
    r = out.select("person", F.from_json("record", shape).alias("r"))
    return r.select(
        "person",
        F.col("r.person").alias("r_person"),
        F.col("r.gender").alias("r_gender"),
        F.col("r.grade").alias("r_grade"),
        F.col("r.burst").alias("r_burst"),
        F.col("r.person_buzz").alias("r_buzz"),
        F.col("r.work_list").alias("r_works"),
        F.col("r.works_text").alias("r_text"),
    )


@query(
    "load_ragged_table",
    WP + "SELECT CAST(person AS VARCHAR) AS person, work, work_buzz, person_buzz, weeks_ranked, persons_ranked, rank_in_work FROM wp",
    {"work_buzz": 1, "person_buzz": 2},
)
def load_ragged_table(spark, d):
    """The pairs as lines of text, stored and read back: short rows, long rows, quoted cells, a blank header cell, junk."""
    rows = b.work_person(spark, d)
    numbers = [F.format_number("work_buzz", 2), F.format_number("person_buzz", 2), *[F.col(c).cast("string") for c in ("weeks_ranked", "persons_ranked", "rank_in_work")]]
    quoted = [F.concat(F.lit('"'), c, F.lit('"')) for c in numbers[:2]]
    cells = [F.col("person").cast("string"), F.concat(F.lit(" "), "work"), *quoted, *numbers[2:]]
    kind = F.col("person") % 3
    tail = F.when(kind == 0, F.lit("")).when(kind == 1, F.lit(",note")).otherwise(F.lit(",note,more,and more"))
    line = F.concat(F.concat_ws(",", *cells), tail)
    junk = F.when(F.col("rank_in_work") == 1, F.concat(F.lit('"never closed,'), F.col("person").cast("string")))
    # One pass over the pairs writes both.
    lines = rows.select(F.explode(F.array(line, junk)).alias("value")).where("value IS NOT NULL")
    folder = f"{ensure_checkpoint_dir(spark)}/audira-ragged-{uuid.uuid4().hex}"
    header = " person,work ,work_buzz,person_buzz,weeks_ranked,persons_ranked,rank_in_work, "
    spark.createDataFrame([(header,)], "value string").coalesce(1).write.text(f"{folder}/a-header")
    lines.write.text(f"{folder}/b-rows")
    raw, _ = tables.read_ragged(spark, [f"{folder}/a-header", f"{folder}/b-rows"])
    return tables.load_ragged_table(raw)
