"""Tables that streams merge into, batch by batch, so that a batch that runs again changes nothing.

A table is a folder of Parquet: ``delta/batch=N`` has what batch N adds, one row a key, and ``base/upto=N`` what all
batches up to N make together.  Writing a delta twice gives the same files, and a base counts once it is complete; so a
query that ends between its write and its commit, and repeats the batch, leaves the same table.  Every ``every`` batches
the deltas are merged into a new base; the base before it stays, for the batch that may run again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import folder_names, remove_folder


@dataclass
class KeyedTable:
    """A table of ``keys`` whose other columns are summed (``sums``) or taken from the last batch (``latest``); ``types`` has the type of each."""

    spark: SparkSession
    path: str
    keys: list[str]
    types: dict[str, str]
    sums: list[str] = field(default_factory=list)
    latest: list[str] = field(default_factory=list)
    every: int = 16

    def _schema(self) -> str:
        return ", ".join(f"{c} {self.types[c]}" for c in (*self.keys, *self.sums, *self.latest)) + ", seen long"

    def _merged(self, rows: DataFrame) -> DataFrame:
        """One row a key; ``seen`` is the last batch that had it."""
        last: list[Column] = [F.max_by(c, "seen").alias(c) for c in self.latest]
        return rows.groupBy(*self.keys).agg(*(F.sum(c).alias(c) for c in self.sums), *last, F.max("seen").alias("seen"))

    def _complete(self, kind: str, name: str) -> list[int]:
        found = (int(n.partition("=")[2]) for n in folder_names(self.spark, f"{self.path}/{kind}") if n.startswith(name))
        return sorted(n for n in found if "_SUCCESS" in folder_names(self.spark, f"{self.path}/{kind}/{name}{n}"))

    def _rows(self, before: int | None = None) -> DataFrame:
        bases = [n for n in self._complete("base", "upto=") if before is None or n < before]
        after = bases[-1] if bases else -1
        paths = [f"{self.path}/base/upto={after}"] if bases else []
        paths += [f"{self.path}/delta/batch={n}" for n in self._complete("delta", "batch=") if n > after and (before is None or n < before)]
        reader = self.spark.read.schema(self._schema())
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self._schema())

    def current(self, before: int | None = None) -> DataFrame:
        """The table as it stands, or as it stood before a batch."""
        return self._merged(self._rows(before)).drop("seen")

    def merge(self, rows: DataFrame, batch: int) -> None:
        """Add what a batch has for each key; rows of one key are summed, and for ``latest`` must be one."""
        delta = self._merged(rows.withColumn("seen", F.lit(batch).cast("long")))
        delta.select(*self.keys, *self.sums, *self.latest, "seen").write.mode("overwrite").parquet(f"{self.path}/delta/batch={batch}")
        bases = self._complete("base", "upto=")
        if batch - (bases[-1] if bases else -1) >= self.every:
            self._merged(self._rows()).select(*self.keys, *self.sums, *self.latest, "seen").write.mode("overwrite").parquet(f"{self.path}/base/upto={batch}")
            last = bases[-1] if bases else -1
            for n in self._complete("delta", "batch="):
                if n <= last:
                    remove_folder(self.spark, f"{self.path}/delta/batch={n}")
            for n in bases[:-1]:
                remove_folder(self.spark, f"{self.path}/base/upto={n}")
