"""A sink of features that a stopped run goes on with: each input counts once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnloom.sources.versions import VersionedTable


class FeatureSink:
    """Features of input files, committed group by group with the names of the inputs that are done.

    A part holds the features of a group and, beside them, its inputs' names. A run that
    stops between or within groups leaves what it has committed; the next one
    adds what is missing. A group should be big enough to be worth a commit.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.table = spark, VersionedTable(spark, root)

    def done(self) -> DataFrame:
        """(input): the names of all inputs that the newest version covers."""
        _, parts = self.table.parts()
        places = [f"{self.table.place(p)}/inputs" for p in parts]
        return self.spark.read.schema("input string").parquet(*places) if places else self.spark.createDataFrame([], "input string")

    def missing(self, inputs: DataFrame) -> DataFrame:
        return inputs.select("input").distinct().join(self.done(), "input", "left_anti")

    def add(self, group: list[str], rows: DataFrame) -> int:
        """Commits the features of a group of inputs as one part of a new version."""
        part = self.table.write(rows)
        self.spark.createDataFrame([(i,) for i in group], "input string").write.parquet(f"{self.table.place(part)}/inputs")
        return self.table.change(lambda _, parts: [*parts, part])

    def run(self, inputs: list[str], build: Callable[[list[str]], DataFrame], group: int = 64, keep: int = 2) -> int:
        """Features of all inputs that are not done yet; the number of groups that were added.

        build gives the features of some inputs. The last `keep` versions stay.
        """
        given = self.spark.createDataFrame([(i,) for i in inputs], "input string")
        left = [r["input"] for r in self.missing(given).orderBy("input").collect()]  # names of files, of which the caller has a list
        groups = [left[i : i + group] for i in range(0, len(left), group)]
        for some in groups:
            self.add(some, build(some))
        self.table.keep_last(keep)
        return len(groups)

    def features(self, version: int | None = None) -> DataFrame | None:
        return self.table.read(version)
