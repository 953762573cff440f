"""Namespaces of tables: content, user and any number of shelves. An unqualified name is looked up in that order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Catalog:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.spaces: dict[str, dict[str, DataFrame]] = {"user": {}, "content": {}}

    def attach(self, space: str, tables: dict[str, DataFrame] | str) -> None:
        """Adds tables, or all Parquet tables in a folder, as a namespace."""
        if isinstance(tables, str):
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(tables)
            found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
            names = [f.getPath().getName() for f in found]
            tables = {n.removesuffix(".parquet"): self.spark.read.parquet(f"{tables}/{n}") for n in names if n.endswith(".parquet")}
        self.spaces.setdefault(space, {}).update(tables)

    def detach(self, space: str) -> None:
        self.spaces.pop(space, None)

    def has(self, name: str) -> bool:
        return self._find(name) is not None

    def _find(self, name: str) -> DataFrame | None:
        space, _, own = name.rpartition(".")
        return next((t[own] for s, t in self.spaces.items() if own in t and space in ("", s)), None)

    def table(self, name: str) -> DataFrame:
        """A table by its name or space.name."""
        found = self._find(name)
        if found is None:
            raise KeyError(f"no table {name}")
        return found

    def shelves(self, name: str) -> dict[str, DataFrame]:
        """The tables of one name on all shelves that have it."""
        return {s: t[name] for s, t in self.spaces.items() if name in t and s not in ("user", "content")}

    def views(self) -> None:
        """Every table as a temporary view: the first of a name unqualified, all as space_name."""
        for space, tables in reversed(self.spaces.items()):
            for name, df in tables.items():
                df.createOrReplaceTempView(f"{space}_{name}")
                df.createOrReplaceTempView(name)
