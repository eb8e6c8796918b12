"""Client settings by key: a log of versions, of which the latest row of a key counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.sources.versions import VersionedTable

VERSION, GONE = "tl_version", "tl_gone"


class SettingsStore:
    """Rows by key. Setting and removing append; nothing that a reader may be reading is changed.

    Of rows of one key that come in one call, any one is kept.
    """

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.table, self.key = VersionedTable(spark, path), key

    def _append(self, rows: DataFrame, gone: bool) -> int:
        def work(version: int, parts: list[str]) -> list[str]:
            # a part says with which version it came, so it is written anew where another writer was first
            marked = rows.dropDuplicates([self.key]).withColumns({VERSION: F.lit(version + 1).cast("long"), GONE: F.lit(gone)})
            return [*parts, self.table.write(marked)]

        return self.table.change(work)

    def set(self, rows: DataFrame) -> int:
        """Settings of the keys that the rows have; other keys keep theirs. The new version's number."""
        return self._append(rows, False)

    def remove(self, keys: DataFrame) -> int:
        """Forgets the keys."""
        return self._append(keys.select(self.key), True)

    def _latest(self, version: int | None = None) -> DataFrame | None:
        _, parts = self.table.parts(version)
        if not parts:
            return None
        # parts of removals have the key alone
        rows = self.table.spark.read.option("mergeSchema", True).parquet(*(f"{self.table.place(p)}/rows" for p in parts))
        newest = rows.groupBy(self.key).agg(F.max_by(F.struct(*rows.columns), VERSION).alias("r"))
        return newest.select("r.*").where(~F.col(GONE))

    def get(self, version: int | None = None) -> DataFrame:
        """All settings, of the newest version or of an earlier one that is still kept."""
        rows = self._latest(version)
        if rows is None:
            raise LookupError(f"nothing was ever set in {self.table.root}")
        return rows.drop(VERSION, GONE)

    def get_one(self, key) -> DataFrame:
        value = key if isinstance(key, Column) else F.lit(key)
        return self.get().where(F.col(self.key) == value)

    def compact(self, keep: int = 2) -> int:
        """One part with the latest row of each key; all but the last `keep` versions are deleted."""

        def work(version: int, parts: list[str]) -> list[str]:
            rows = self._latest(version)
            return [] if rows is None else [self.table.write(rows)]

        new = self.table.change(work)
        self.table.keep_last(keep)
        return new
