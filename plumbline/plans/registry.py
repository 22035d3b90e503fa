"""The catalogue: named queries over a folder of tables, each with its check SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import shared_dir
from plumbline.sources.sinks import read_or_build

DIGITS = 6


class Tables:
    """The input tables of one folder, and the views derived from them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A narrow derived table, written once per application and reused (K4)."""
        app = self.spark.sparkContext.applicationId
        tag = hashlib.md5(self.path.encode()).hexdigest()[:12]
        return read_or_build(self.spark, f"{shared_dir(self.spark)}/plumbline/{app}/{tag}/{name}", build)


@dataclass
class Query:
    name: str
    run: Callable[[Tables], DataFrame]
    sql: str | None = None
    doubles: tuple[str, ...] = field(default=())

    def frame(self, spark: SparkSession, path: str) -> DataFrame:
        df = self.run(Tables(spark, path))
        return df.withColumns({c: F.round(F.col(c), DIGITS) for c in self.doubles}) if self.doubles else df

    def check_sql(self) -> str | None:
        if self.sql is None or not self.doubles:
            return self.sql
        swaps = ", ".join(f"round({c}, {DIGITS}) AS {c}" for c in self.doubles)
        return f"SELECT * REPLACE ({swaps}) FROM ({self.sql}) AS answer"


CATALOGUE: dict[str, Query] = {}


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Register a query; ``doubles`` are the columns compared at six decimals."""

    def add(fn):
        assert name not in CATALOGUE, name
        CATALOGUE[name] = Query(name, fn, sql, tuple(doubles.split()))
        return fn

    return add
