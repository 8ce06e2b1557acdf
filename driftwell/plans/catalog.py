"""The registered queries with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftwell.plans.lineage import deal_after_unions
from driftwell.sources.views import Dialect, NumberedDialect, UndealtDialect, duck, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Views:
    """The views of one folder, by name: v.fx_changes. v.numbered has the same ones with numbers for the changes' hashes."""

    def __init__(self, spark: SparkSession, sf_dir: str, dialect: Dialect | None = None):
        self.spark, self.sf_dir, self.dialect = spark, sf_dir, dialect
        deal_after_unions(spark)

    @property
    def numbered(self) -> Views:
        return Views(self.spark, self.sf_dir, NumberedDialect())

    @property
    def undealt(self) -> Views:
        """The same as numbered, for views whose columns need no window over a group: nothing is dealt out."""
        return Views(self.spark, self.sf_dir, UndealtDialect())

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name, self.dialect)


def query(name: str, oracle: str | None = None) -> Callable[[Callable[[Views], DataFrame]], Callable[[Views], DataFrame]]:
    """Registers a function of the views under a name, with SQL over the same views."""

    def register(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = duck(oracle)
        return f

    return register
