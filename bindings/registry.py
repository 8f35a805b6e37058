"""Query registry: each entry pairs a Spark query with an independent DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import VIEWS, oracle

TEXT_TABLES = ("documents", "pages")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def spread(scan: DataFrame) -> DataFrame:
    """One partition per core: the given tables are single files of one row group."""
    return scan.repartition(scan.sparkSession.sparkContext.defaultParallelism)


class Data:
    """Tables of one scale-factor folder and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in VIEWS:
                deps, body = VIEWS[name]
                inputs = {d: getattr(self, d) for d in deps}
                if name == "txt_parts":
                    inputs["orders"] = spread(inputs["orders"])
                self._made[name] = self.spark.sql(body, **inputs)
            else:
                table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
                self._made[name] = spread(table) if name in TEXT_TABLES else table
        return self._made[name]


    def dealt(self, table: str, key: str) -> Data:
        """The same data with a table dealt out by a key to as many tasks as the session shuffles with.

        Spark joins coalesced partitions with a task per core, so a task's memory grows with the input;
        a join on this key takes place in the dealt partitions instead.
        """
        other = Data(self.spark, self.sf_dir)
        other._made[table] = getattr(self, table).repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), key)
        return other


def query(name: str, sql: str | None = None):
    """Register ``fn(data)``; ``sql`` may refer to the shared views by name."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Data(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn

    return register
