"""Mixing sources to target weights by hash thresholds, DataFrame functions only.

Every row gets a 40-bit hash of its id and text. A source whose target is t times its size takes every row floor(t) times
and once more each row whose hash lies below the source's threshold. Thresholds come from histograms: words are summed by
source and hash bucket, the bucket in which the budget runs out is found by a running sum over at most 2^14 buckets of a
source, and only the rows of that boundary bucket are summed again by finer buckets. Nothing is sorted by hash, and a source
with a third of all rows is summed before it is shuffled like any other.

Thresholds nest: with a larger budget a source keeps all rows it took with a smaller one, and reruns agree.

Null texts have size 0. A null source is a source of its own, the last one. Rows that repeat id and text share a hash, so
they are taken together. Empty tables give empty results; a source without words has target 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from audira.llm.shared import numbered, position, same, settle
from audira.operators.ordering import with_position

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 40
#: Bits of the hash that each histogram looks at, from the top.
LEVELS = (12, 14, 14)


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (1.0, 2.0, 3.0)  # of the sources in code point order, repeating
    share: float = 1.0  # of all words
    max_copies: int = 3


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(doc_id: Column, text: Column) -> Column:
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(rows: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per source: source, source_size, weight, target.

    Words are shared by weight; a source above ``max_copies`` times its size stops there and the rest is shared again, until
    none is above. Each round is one aggregate over one row per source and returns one row.
    """
    found = settle(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    place = (F.col("place") - 1) % len(mix.weights)
    weights = F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), (place + 1).cast("int"))
    placed = with_position(found, [], [F.col("source").asc_nulls_last()], "place")
    sizes = settle(placed.withColumn("weight", weights).drop("place"))
    cap = F.col("source_size") * float(mix.max_copies)
    budget = (sizes.agg(F.sum("source_size")).first()[0] or 0) * mix.share
    level, n_capped = 0.0, -1
    while True:
        capped = (cap <= F.col("weight") * level) if n_capped >= 0 else F.lit(False)
        got = sizes.agg(
            F.sum(capped.cast("int")).alias("n"),
            F.sum(F.when(capped, cap).otherwise(0.0)).alias("full"),
            F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if (got.n or 0) == n_capped or not got.open:
            break
        n_capped, level = got.n or 0, (budget - got.full) / got.open
    return sizes.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def thresholds(rows: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per source: source, source_size, target, whole (copies of every row), below (one more for hashes below it).

    ``rows`` has source, size, hash; it is read once per level and should be a written table.
    """
    plan = targets(rows, mix)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(mix.max_copies))).otherwise(0)
    plan = plan.withColumn("whole", whole.cast("long")).withColumn("left", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    state = settle(plan.withColumn("below", F.lit(0).cast("long")))
    shift = HASH_BITS
    for bits in LEVELS:
        width, shift = shift, shift - bits
        state = settle(_refined(rows, state, width, shift))
    # Where nothing was left, no hash is taken once more: not even empty texts, which would fit in nothing.
    more = F.col("target") > F.col("whole") * F.col("source_size")
    return state.select("source", "source_size", "target", "whole", F.when(more, F.col("below")).otherwise(0).alias("below"))


def _refined(rows: DataFrame, state: DataFrame, width: int, shift: int) -> DataFrame:
    """Narrow each source's boundary range [below, below + 2^width) to one of its buckets of 2^shift hashes."""
    s = state.select(F.col("source").alias("s_source"), F.col("below").alias("s_below"))
    inside = (F.col("hash") >= F.col("s_below")) & (F.col("hash") < F.col("s_below") + F.lit(1 << width))
    sums = (
        rows.select("source", "size", "hash")
        .join(s, same(F.col("source"), F.col("s_source")) & inside)
        .groupBy("source", F.shiftright(F.col("hash") - F.col("s_below"), shift).alias("bucket"))
        .agg(F.sum("size").alias("words"))
    )
    so_far = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    budgets = state.select(F.col("source").alias("s_source"), F.col("left").alias("s_left"))
    marked = sums.withColumn("so_far", so_far).join(budgets, same(F.col("source"), F.col("s_source")))
    found = marked.groupBy("source").agg(
        F.min(F.when(F.col("so_far") > F.col("s_left"), F.struct("bucket", "words"))).alias("at"),
        F.max(F.when(F.col("so_far") <= F.col("s_left"), F.col("so_far")).otherwise(0)).alias("used"),
    )
    joined = state.join(found.withColumnRenamed("source", "f_source"), same(F.col("source"), F.col("f_source")), "left")
    left = F.col("left") - F.coalesce(F.col("used"), F.lit(0))
    begin = F.when(F.col("at").isNull(), F.col("below") + F.lit(1 << width)).otherwise(F.col("below") + F.shiftleft(F.col("at.bucket"), shift))
    if shift == 0:  # one hash is left: take it if that comes nearer to the target
        begin = begin + F.when(F.col("at").isNotNull() & (F.col("at.words") - left < left), 1).otherwise(0)
    # Once a whole range fits, nothing is left to refine; the empty range above it keeps it so.
    return joined.select("source", "source_size", "weight", "target", "whole", left.alias("left"), begin.cast("long").alias("below"))


def with_copies(rows: DataFrame, source: str, plan: DataFrame, size: Column, hashed: Column) -> DataFrame:
    """Join the sources' thresholds to the rows: source_size, target, copies, size."""
    p = plan.withColumnRenamed("source", "p_source")
    joined = rows.withColumns({"size": size, "hash": hashed}).join(p, same(F.col(source), F.col("p_source")), "left")
    return joined.withColumn("copies", F.col("whole") + (F.col("hash") < F.col("below")).cast("long")).drop("p_source")


def mix_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", mix: Mix = Mix()) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken (words, repeats counted). Texts are read once."""
    i, t, s = (F.col(f"c{position(docs, n)}") for n in (doc_id, text, source))
    rows = settle(numbered(docs).select(i.alias("doc_id"), s.alias("source"), size_of(t).alias("size"), hash_of(i, t).alias("hash")))
    out = with_copies(rows, "source", thresholds(rows, mix), F.col("size"), F.col("hash"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", mix: Mix = Mix()) -> DataFrame:
    """The documents of the mix, all columns as they were; a document that is taken k times is there k times."""
    rows, (i, t) = numbered(docs), (F.col(f"c{position(docs, n)}") for n in (doc_id, text))
    s = f"c{position(docs, source)}"
    narrow = settle(rows.select(F.col(s).alias("source"), size_of(t).alias("size"), hash_of(i, t).alias("hash")))
    plan = thresholds(narrow, mix)
    # Sizes are not needed again: the hash alone decides.
    out = with_copies(rows, s, plan, F.lit(0).cast("long"), hash_of(i, t)).where("copies > 0")
    copies = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return copies.select(*rows.columns).toDF(*docs.columns)
