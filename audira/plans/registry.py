"""Registry of queries. Doubles named in ``digits`` are rounded alike on both sides.

A small shift keeps exact halves, which the two engines round differently, away from the rounding edge.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def edge_shift(digits: int) -> float:
    return 3.7 * 10.0 ** -(digits + 3)


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    digits: dict[str, int] = field(default_factory=dict)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(spark, sf_dir)
        for column, d in self.digits.items():
            df = df.withColumn(column, F.round(F.col(f"`{column}`") + F.lit(edge_shift(d)), d) + F.lit(0.0))
        return df

    def oracle(self) -> str | None:
        if self.sql is None or not self.digits:
            return self.sql
        parts = [f'round("{c}" + {edge_shift(d)!r}, {d}) + 0.0 AS "{c}"' for c, d in self.digits.items()]
        return f"SELECT * REPLACE ({', '.join(parts)}) FROM (\n{self.sql}\n)"


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, digits: dict[str, int] | None = None):
    """Register a ``(spark, sf_dir) -> DataFrame`` under a name."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, build, sql, digits or {})
        return build

    return register
