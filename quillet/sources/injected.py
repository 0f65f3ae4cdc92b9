"""A data source whose rows come from an injected function: remote datasets, services, generators."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def register(spark: SparkSession, name: str, schema: str, read: Callable[[dict, int, int], Iterable[tuple]]) -> None:
    """Makes spark.read.format(name) call read(options, part, parts) on executors, once per partition.

    The option `parts` (1 by default) splits the work; read yields the rows of its part only.
    """

    class Reader(DataSourceReader):
        def __init__(self, options: dict) -> None:
            self.options = dict(options)
            self.parts = int(self.options.get("parts", 1))

        def partitions(self) -> list[InputPartition]:
            return [InputPartition(i) for i in range(self.parts)]

        def read(self, partition: InputPartition):
            yield from read(self.options, partition.value, self.parts)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    spark.dataSource.register(Source)
