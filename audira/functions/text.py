"""Text and number clean-up expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: shape of a number that survives clean-up.
NUMBER_SHAPE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# Fixed value: characters kept by normalisation are Latin letters, digits and Hangul syllables.
NOT_ALNUM_HANGUL = "[^A-Za-z0-9가-힣]"
# Fixed value: white space as the reference's language sees it, beyond ASCII.
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
HANGUL_WEEK = "주차"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_number(c: Column | str, default: float | None = None) -> Column:
    """Strip thousands commas and percent signs; unparsable text becomes ``default``."""
    cleaned = F.trim(F.regexp_replace(col(c), "[,%]", ""))
    number = F.when(cleaned.rlike(NUMBER_SHAPE), cleaned.try_cast("double"))
    return number if default is None else F.coalesce(number, F.lit(float(default)))


def extract_step(c: Column | str) -> Column:
    """First run of digits as an integer, null when there is none."""
    digits = F.regexp_extract(col(c), r"([0-9]+)", 1)
    return F.when(digits != "", digits.try_cast("int"))


def extract_week_no(c: Column | str) -> Column:
    """First signed integer in a week label."""
    digits = F.regexp_extract(col(c), r"(-?[0-9]+)", 1)
    return F.when(digits != "", digits.try_cast("int"))


def normalize_text(c: Column | str) -> Column:
    """Keep letters, digits and Hangul, lower-cased; null becomes empty."""
    return F.lower(F.regexp_replace(F.coalesce(col(c), F.lit("")), NOT_ALNUM_HANGUL, ""))


def squash_keyword(c: Column | str) -> Column:
    """Lower-case, drop leading hash signs and all white space."""
    lowered = F.lower(F.coalesce(col(c), F.lit("")))
    return F.regexp_replace(F.regexp_replace(lowered, "^#+", ""), SPACE, "")


def normalize_week_label(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), rf"[+]|{HANGUL_WEEK}", ""))


def strip_urls(c: Column | str) -> Column:
    no_url = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"https?://\S+", " ")
    return F.trim(F.regexp_replace(no_url, rf"{SPACE}+", " "))


def extract_video_ids(c: Column | str) -> Column:
    """Distinct 11-character ids from short links, shorts links and watch links."""
    text = F.coalesce(col(c), F.lit(""))
    ident = "([A-Za-z0-9_-]{11})"
    short = F.regexp_extract_all(text, F.lit(rf"https?://youtu\.be/{ident}"), F.lit(1))
    shorts = F.regexp_extract_all(text, F.lit(rf"https?://(?:www\.)?youtube\.com/shorts/{ident}"), F.lit(1))
    queries = F.regexp_extract_all(
        text, F.lit(r"https?://(?:www\.)?youtube\.com/watch\?([^ \n]+)"), F.lit(1)
    )
    # Only the part up to a second question mark is the query; the last v= pair wins.
    pairs = F.transform(queries, lambda q: F.filter(F.split(q, "&"), lambda p: p.startswith("v=")))
    values = F.transform(pairs, lambda ps: F.get(F.reverse(ps), F.lit(0)).substr(F.lit(3), F.length(text) + 3))
    watch = F.filter(values, lambda v: F.coalesce(v.rlike("^[A-Za-z0-9_-]{11}$"), F.lit(False)))
    return F.array_distinct(F.concat(short, shorts, watch))


def contains_any(haystack: Column, keywords: list[str]) -> Column:
    """True when any keyword occurs; an empty list matches everything."""
    if not keywords:
        return F.lit(True)
    hit = F.lit(False)
    for keyword in keywords:
        hit = hit | haystack.contains(keyword)
    return hit


def signed_log(c: Column | str) -> Column:
    return F.signum(col(c)) * F.log1p(F.abs(col(c)))


def log1p_clip(c: Column | str) -> Column:
    return F.log1p(F.greatest(col(c), F.lit(0.0)))
