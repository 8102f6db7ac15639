import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows (doc_id, text, lang, source) as documents."""

    def build(rows, partitions=3):
        full = [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows]
        return spark.createDataFrame(full, DOC_SCHEMA).repartition(partitions)

    return build


@pytest.fixture(scope="session")
def clashing():
    """Give a table columns whose names clash with those of the operators."""
    from pyspark.sql import functions as F

    def widen(df):
        names = ["size", "kept", "hash", "component", "bucket", "host", "n_words", "TEXT", "path", "window", "part"]
        return df.withColumns({n: F.lit(f"mine {n}") for n in names if n != "TEXT"}).select("*", F.lit("other").alias("TEXT"))

    return widen
