"""Demographic segment expressions: gender and decade out of a free-text segment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from audira.functions.text import col


@dataclass(frozen=True)
class SegmentSpec:
    """Words that mark a segment; the female test comes first."""

    # Fixed values of the data.
    female_markers: tuple[str, ...] = ("여", "F", "female", "Female")
    male_markers: tuple[str, ...] = ("남", "M", "male", "Male")
    female: str = "여"
    male: str = "남"
    other: str = "기타"
    decade_suffix: str = "대"
    female_word: str = "여성"
    male_word: str = "남성"
    decades: tuple[int, ...] = (10, 20, 30, 40, 50, 60)

    def labels(self) -> list[str]:
        """The fixed column order of a segment table: male decades, then female decades."""
        return [f"{d}{self.decade_suffix}{w}" for w in (self.male_word, self.female_word) for d in self.decades]


SEGMENTS = SegmentSpec()


def _any_marker(c: Column, markers: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for marker in markers:
        hit = hit | c.contains(marker)
    return hit


def segment_gender(c: Column | str, spec: SegmentSpec = SEGMENTS, keep_other: bool = True) -> Column:
    """Gender word of a segment; case matters, so a lone lower-case f is not female."""
    text = F.coalesce(col(c), F.lit(""))
    gender = F.when(_any_marker(text, spec.female_markers), F.lit(spec.female)).when(
        _any_marker(text, spec.male_markers), F.lit(spec.male)
    )
    return gender.otherwise(F.lit(spec.other)) if keep_other else gender


def segment_decade_no(c: Column | str, clamped: bool = False) -> Column:
    number = F.regexp_extract(F.coalesce(col(c), F.lit("")), r"([0-9]+)", 1).try_cast("int")
    decade = (F.floor(number / 10) * 10).cast("int")
    if clamped:
        decade = F.when(number.isNotNull(), F.greatest(F.lit(10), F.least(F.lit(60), decade)))
    return decade


def segment_decade(c: Column | str, spec: SegmentSpec = SEGMENTS, clamped: bool = False) -> Column:
    """Decade label; without a number it is the 'other' word, or null in the clamped form."""
    decade = segment_decade_no(c, clamped)
    label = F.concat(decade.cast("string"), F.lit(spec.decade_suffix))
    return label if clamped else F.coalesce(label, F.lit(spec.other))


def segment_label(c: Column | str, spec: SegmentSpec = SEGMENTS, clamped: bool = True) -> Column:
    """Decade plus gender word, null unless both are known."""
    gender = segment_gender(c, spec, keep_other=False)
    word = F.when(gender == spec.male, F.lit(spec.male_word)).when(gender == spec.female, F.lit(spec.female_word))
    decade = F.concat(segment_decade_no(c, clamped).cast("string"), F.lit(spec.decade_suffix))
    return F.concat(decade, word)
