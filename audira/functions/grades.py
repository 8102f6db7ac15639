"""Grade ladders, tiers, person attributes and normalisation expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from audira.functions.text import col

# Ordered grades and the least percent rank for each of them.
GRADES = ["S", "A++", "A+", "A", "B++", "B+", "B", "C++", "C+", "C"]
GRADE_FLOORS = {
    "S": 0.98,
    "A++": 0.96,
    "A+": 0.90,
    "A": 0.85,
    "B++": 0.70,
    "B+": 0.50,
    "B": 0.30,
    "C++": 0.15,
    "C+": 0.05,
}
# Quintile labels, best first.
LEVEL_GRADES = ["S", "A", "B", "C", "D"]
SLOPE_GRADES = ["+2", "+1", "0", "-1", "-2"]
# Gender synonyms and age bands.
MALE_WORDS = ["남", "남자", "남성", "M", "Male", "male"]
FEMALE_WORDS = ["녀", "여", "여자", "여성", "F", "Female", "female"]
UNKNOWN = "미상"
AGE_GROUPS = ["20대", "30대", "40대", "50대"]
UNDER_TWENTY = "20대 미만"
STRENGTH_WORDS = ("강", "약", "유사")


def grade_from_percentile(p: Column | str) -> Column:
    """Letter grade of a percent rank in 0..1; an unknown rank has an empty grade."""
    value = col(p)
    grade = F.when(value.isNull(), F.lit(""))
    for name, floor in GRADE_FLOORS.items():
        grade = grade.when(value >= floor, F.lit(name))
    return grade.otherwise(F.lit(GRADES[-1]))


def tier_of_grade(g: Column | str) -> Column:
    first = F.substring(col(g), 1, 1)
    return F.when(col(g) == "S", F.lit("S")).when(first.isin("A", "B"), first).otherwise(F.lit("C"))


def grade_group(g: Column | str) -> Column:
    tier = tier_of_grade(g)
    return F.when(tier.isin("S", "A"), F.lit("S·A")).otherwise(tier)


def order_in(c: Column | str, values: list[str]) -> Column:
    """1-based place of a value in a fixed list, null when it is not listed."""
    place = F.array_position(F.array(*[F.lit(v) for v in values]), col(c))
    return F.when(place > 0, place)


def quintile_index(rank_desc: Column, ties: Column, n: Column) -> Column:
    """1..5 from the descending average rank, in whole numbers so that bin edges are exact."""
    doubled = 2 * rank_desc + ties - 1
    idx = F.lit(5)
    for j in (4, 3, 2, 1):
        idx = F.when(5 * doubled <= 2 * j * n, F.lit(j)).otherwise(idx)
    return F.when(rank_desc.isNotNull(), idx)


def quintile_label(index: Column | str, labels: list[str]) -> Column:
    label = F.lit(None).cast("string")
    for place, name in enumerate(labels, start=1):
        label = F.when(col(index) == place, F.lit(name)).otherwise(label)
    return label


def normalize_gender(c: Column | str) -> Column:
    text = F.trim(col(c))
    return F.when(text.isin(MALE_WORDS), F.lit("남")).when(text.isin(FEMALE_WORDS), F.lit("여")).otherwise(F.lit(UNKNOWN))


def counted_age(birth_year: Column | str, current_year: int) -> Column:
    return F.lit(current_year) - col(birth_year).cast("int") + 1


def age_group(birth_year: Column | str, current_year: int) -> Column:
    age = counted_age(birth_year, current_year)
    return (
        F.when(age.isNull(), F.lit(UNKNOWN))
        .when(age < 20, F.lit(UNDER_TWENTY))
        .when(age < 30, F.lit(AGE_GROUPS[0]))
        .when(age < 40, F.lit(AGE_GROUPS[1]))
        .when(age < 50, F.lit(AGE_GROUPS[2]))
        .otherwise(F.lit(AGE_GROUPS[3]))
    )


def axis_strength_label(candidate: Column | str, base: Column | str, margin: float = 0.015) -> Column:
    """Strong, weak or alike, by the difference of two percent ranks."""
    diff = F.coalesce(col(candidate), F.lit(0.0)) - F.coalesce(col(base), F.lit(0.0))
    strong, weak, alike = STRENGTH_WORDS
    return F.when(diff > margin, F.lit(strong)).when(diff < -margin, F.lit(weak)).otherwise(F.lit(alike))


def scaled(value: Column, low: Column, high: Column) -> Column:
    """(x - min) / (max - min), 0 when the range is empty or unknown."""
    span = high - low
    flat = low.isNull() | high.isNull() | (F.abs(span) <= 1e-9 * F.greatest(F.abs(low), F.abs(high)))
    return F.when(flat, F.lit(0.0)).otherwise((value - low) / F.when(~flat, span))
