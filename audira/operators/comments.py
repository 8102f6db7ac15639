"""Comment search, sampling and text records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from audira.functions import text
from audira.operators.ordering import with_scalars


# Words used when a query block names nothing.
DEFAULT_KEYWORD = "유튜브"


def comment_line(max_chars: int = 280) -> Column:
    """``[R|♥n] author: text`` on one line, the text cut with an ellipsis."""
    flat = F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " ")
    kind = F.when(F.col("isReply") == 1, F.lit("R")).otherwise(F.lit("T"))
    likes = F.coalesce("likeCount", F.lit(0)).cast("bigint").cast("string")
    author = F.regexp_replace(F.coalesce("author", F.lit("")), "\n", " ")
    body = F.when(F.length(flat) > max_chars, F.concat(F.substring(flat, 1, max_chars), F.lit("…"))).otherwise(flat)
    return F.concat(F.lit("["), kind, F.lit("|♥"), likes, F.lit("] "), author, F.lit(": "), body)


def random_order(seed: int, *keys: str) -> Column:
    """A reproducible shuffle: the digest of key and seed."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def comment_sample(
    comments: DataFrame,
    key: str = "comment_id",
    top_n: int = 1000,
    random_n: int = 1000,
    max_chars: int = 280,
    max_total: int = 420_000,
    seed: int = 42,
) -> DataFrame:
    """Top comments by likes, then random ones of the rest, as lines until the character budget.

    The budget is checked before a line is added. Two top-k steps leave at most ``top_n + random_n`` rows, so the
    running sum over them is small by construction.
    """
    by_likes = [F.col("likeCount").desc_nulls_last(), F.col(key)]
    top = comments.orderBy(*by_likes).limit(top_n)
    rest = comments.join(top.select(key), key, "left_anti")
    shuffled = [random_order(seed, key), F.col(key)]
    drawn = rest.orderBy(*shuffled).limit(random_n)
    sample = top.withColumn("part", F.lit(1)).unionByName(drawn.withColumn("part", F.lit(2)))
    likes = F.when(F.col("part") == 1, -F.coalesce("likeCount", F.lit(0)))
    shuffle = F.when(F.col("part") == 2, random_order(seed, key))
    lines = sample.select(key, "part", comment_line(max_chars).alias("line"), likes.alias("_l"), shuffle.alias("_r"))
    # Null sorts first, so each part follows its own key.
    order = Window.partitionBy().orderBy("part", "_l", "_r", key)
    before = F.sum(F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = lines.withColumn("chars_before", F.coalesce(before, F.lit(0)).cast("bigint"))
    placed = placed.withColumn("line_no", F.row_number().over(order))
    return placed.where(F.col("chars_before") < max_total).select("line_no", "part", key, "line", "chars_before")


def sample_meta(comments: DataFrame, sample: DataFrame, top_n: int = 1000, random_n: int = 1000, dedup_key: str = "text") -> DataFrame:
    """Counts that go with a sample: all rows, distinct non-blank texts, rows drawn before the budget, lines and characters within it."""
    body = F.trim(F.col(dedup_key))
    all_rows = comments.agg(
        F.count("*").alias("total_rows"), F.count_distinct(F.when(body != "", body)).alias("unique_rows")
    )
    drawn = all_rows.withColumn("used_top", F.least("total_rows", F.lit(top_n)).cast("bigint"))
    drawn = drawn.withColumn("used_random", F.least(F.col("total_rows") - F.col("used_top"), F.lit(random_n)).cast("bigint"))
    drawn = drawn.withColumn("sampled_target", F.col("used_top") + F.col("used_random"))
    used = sample.agg(F.count("*").alias("lines"), F.coalesce(F.sum(F.length("line") + 1), F.lit(0)).alias("chars"))
    return with_scalars(drawn, used)


def except_selected(rows: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """Rows whose key was not selected."""
    return rows.join(selected.select(key), key, "left_anti")


def ordered_distinct(parts: list[DataFrame], key: str) -> DataFrame:
    """Ids of several searches without repeats; the first search that found an id decides its place.

    Each part has the key and ``place``, its order within that search.
    """
    tagged = [p.select(key, F.lit(i).alias("search"), "place") for i, p in enumerate(parts)]
    both = tagged[0]
    for part in tagged[1:]:
        both = both.unionByName(part)
    first = both.groupBy(key).agg(F.min(F.struct("search", "place")).alias("_f"))
    return first.select(key, F.col("_f.search").alias("search"), F.col("_f.place").alias("place"))


def union_distinct_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.select(*keys).unionByName(right.select(*keys)).distinct()


def extracted_ids(df: DataFrame, column: str, key: str) -> DataFrame:
    """One row per (key, video id) found in a text column."""
    return df.select(key, F.explode(text.extract_video_ids(column)).alias("video_id"))


def extract_query_schema(log: DataFrame, column: str, default_start: str, default_end: str) -> DataFrame:
    """Period, keywords and options out of structured query texts, with defaults.

    Without keywords the first word of two or more letters is taken; without any word a fixed one.
    """
    # Patterns of the block.
    period = r"기간\(KST\)\s*:\s*([^~]+)~\s*([^\n]+)"
    raw = F.trim(F.coalesce(column, F.lit("")))

    def part(pattern: str, group: int, source: Column = raw) -> Column:
        found = F.trim(F.regexp_extract(source, pattern, group))
        return F.when(found != "", found)

    start, end = part(period, 1), part(period, 2)
    complete = start.isNotNull() & end.isNotNull()
    listed = F.filter(
        F.transform(F.split(F.regexp_extract(raw, r"(?s)키워드\s*:\s*\[(.*?)\]", 1), ","), lambda k: F.trim(k)),
        lambda k: k != "",
    )
    word = F.regexp_extract(raw, "([가-힣A-Za-z0-9]{2,})", 1)
    fallback = F.array(F.when(word != "", word).otherwise(F.lit(DEFAULT_KEYWORD)))
    options = F.regexp_extract(raw, r"(?s)옵션\s*:\s*\{(.*?)\}", 1)
    replies = F.lower(F.regexp_extract(options, r"(?i)include_replies\s*:\s*(true|false)", 1)) == "true"
    channel = part(r'(?i)channel_filter\s*:\s*"(any|official|unofficial)"', 1, options)
    lang = part(r'(?i)lang\s*:\s*"(ko|en|auto)"', 1, options)
    return log.withColumns(
        {
            "range_start": F.when(complete, start).otherwise(F.lit(default_start)),
            "range_end": F.when(complete, end).otherwise(F.lit(default_end)),
            "keywords": F.when(F.size(listed) > 0, listed).otherwise(fallback),
            "include_replies": F.coalesce(replies, F.lit(False)),
            "channel_filter": F.coalesce(channel, F.lit("any")),
            "lang": F.coalesce(lang, F.lit("auto")),
        }
    )


