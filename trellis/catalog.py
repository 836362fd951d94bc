"""An index: its tables as DataFrames, read from and written to immutable versions."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from .config import Config
from .schemas import TABLES, conform

#: Columns by which files are clustered, so that lookups by them prune row groups.
CLUSTER = {"symbols": ("project_id", "fqn"), "refs": ("symbol_id",), "call_graph": ("callee_symbol_id",), "relationships": ("to_symbol_id",), "argument_flow": ("call_graph_id",), "return_flow": ("call_graph_id",), "snapshots": ("project_id", "git_commit"), "comments": ("project_id", "file_path"), "file_index": ("project_id", "file_path")}


class Index:
    """Tables by name, each made when it is first asked for; ix.symbols is ix["symbols"]."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame | Callable[[], DataFrame]], config: Config | None = None):
        self.spark, self.config = spark, config or Config()
        self._makers, self._made = dict(tables), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in self._makers:
                maker = self._makers[name]
                df = maker() if callable(maker) else maker
            elif name in TABLES:
                df = self.spark.createDataFrame([], TABLES[name])
            else:
                raise KeyError(name)
            self._made[name] = conform(df, name)
        return self._made[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self[name]
        raise AttributeError(name)

    def replace(self, **tables: DataFrame) -> Index:
        """An index with some tables replaced: an index itself never changes."""
        new = Index(self.spark, {**self._makers, **tables}, self.config)
        new._made = {n: df for n, df in self._made.items() if n not in tables}
        return new

    def maker(self, name: str) -> object:
        """What a table is made by; the same object while nobody replaced it."""
        return self._makers.get(name)

    def write(self, path: str) -> None:
        """A new version under path; refuses to write over one."""
        for name in TABLES:
            df = self[name]
            if name in CLUSTER:
                df = df.repartitionByRange(*CLUSTER[name]).sortWithinPartitions(*CLUSTER[name])
            df.write.parquet(f"{path}/{name}")

    @classmethod
    def read(cls, spark: SparkSession, path: str, config: Config | None = None) -> Index:
        return cls(spark, {n: (lambda n=n: spark.read.schema(TABLES[n]).parquet(f"{path}/{n}")) for n in TABLES}, config)
