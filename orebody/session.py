"""A session over a catalog and images (X1-X7): symbols, memory, instances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.functions import filters
from orebody.operators import stats
from orebody.plans.pathql import Catalog, Engine, PathBuilder, QueryError
from orebody.sources.memory import Dumps


class Symbols:
    """Listings of a catalog's tables: types, members, variables (those that are given)."""

    def __init__(self, tables: dict[str, DataFrame]) -> None:
        self.tables = tables

    def list_types(self, text: str = "", order: str = "type_id") -> DataFrame:
        """by id or by name, filtered."""
        types = self.tables["types"]
        return (filters.filter_types(types, text) if text else types).orderBy(order)

    def list_functions(self, text: str = "") -> DataFrame:
        """types of the kind Function."""
        return self.list_types(text).filter(F.col("kind").bitwiseAND(F.lit(filters.KINDS["Function"])) != 0)

    def list_variables(self, text: str = "") -> DataFrame:
        """F20."""
        variables = self.tables["variables"]
        return (filters.filter_variables(variables, self.tables["types"], text) if text else variables).orderBy("var_name")

    def list_sources(self) -> DataFrame:
        """files with their numbers of types."""
        return self.tables["types"].groupBy("src_file").agg(F.count("*").alias("n")).orderBy("src_file")

    def names(self, table: str, column: str, pattern: str | None = None) -> DataFrame:
        """distinct names, by equality or a case-sensitive wildcard."""
        return filters.script_list(self.tables[table], column, pattern).select(column).distinct()

    def exists(self, table: str, column: str, value: object) -> bool:
        return not self.tables[table].filter(F.col(column) == value).isEmpty()

    def sizes(self) -> DataFrame:
        """A15."""
        return stats.catalog_size(self.tables)


class Session:
    """Catalog, variables and loaded images together; the first image is the default."""

    def __init__(self, spark: SparkSession, catalog: Catalog, variables: dict[str, tuple[int, int]], tables: dict[str, DataFrame] | None = None) -> None:
        self.spark, self.catalog, self.variables = spark, catalog, variables
        self.symbols, self.memory = Symbols(tables or {}), Dumps(spark)

    def engine(self, dump: int | None = None) -> Engine:
        slots = self.memory.list()
        if not slots:
            raise QueryError("no image is loaded")
        i = min(slots) if dump is None else dump
        return Engine(self.catalog, self.variables, self.memory.pages(i).drop("dump_id"), i)

    def query(self, path: str, dump: int | None = None, **how) -> DataFrame:  # noqa: ANN003
        """The value at a path; all roots for an empty one. rules= and alternatives= choose the sources of types."""
        engine = self.engine(dump)
        return engine.value(path, **how) if path.strip() else engine.roots()

    def instance(self, path: str, dump: int | None = None) -> PathBuilder:
        """A path to build on by attributes."""
        return PathBuilder(self.engine(dump), path)
