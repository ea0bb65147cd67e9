"""A stored catalogue whose slices (a maker's rows) are replaced, extended and restored.

Each change writes its rows as a version of their own and then an entry for each
slice it touches: which versions the slice's rows come from now.  A row that names
the version ends the change.  What a change replaces stays as it was, so the backup costs no copy, any earlier state can be
read, and a restore writes entries only.

A change counts from that row on: a job that is lost before it leaves files that
nobody reads, and the next attempt writes over them.  Of two writers of one
version, the second to end fails.  Rows are sorted by slice in their files, so reading a slice
skips the others by the files' statistics; entries are joined as a table, so the
number of slices has no bound.

Defined cases: null is a slice, and a key, like any other value; a slice without
rows is empty and can be restored; rows repeated whole are kept; a change without
rows or slices is a version that changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


@dataclass(frozen=True)
class SlicedTable:
    spark: SparkSession
    path: str
    slice: str
    schema: StructType

    @classmethod
    def create(cls, rows: DataFrame, path: str, slice: str) -> SlicedTable:
        """A new table of the rows, as version 0."""
        table = cls(rows.sparkSession, path.rstrip("/"), slice, rows.schema)
        table._write_rows(rows, 0)
        table._commit(rows.select(F.col(slice).alias("of")).distinct().select("of", F.lit(0).cast("long").alias("source")), 0)
        return table

    def _write_rows(self, rows: DataFrame, version: int) -> None:
        ordered = rows.select(*[F.col(f"`{f.name}`") for f in self.schema]).sortWithinPartitions(self.slice)
        ordered.write.mode("overwrite").parquet(f"{self.path}/rows/change={version}")

    def _commit(self, entries: DataFrame, version: int) -> int:
        entries.write.mode("overwrite").parquet(f"{self.path}/entries/change={version}")
        made = self.spark.range(1).select(F.lit(version).cast("long").alias("made"))
        made.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/versions/change={version}")
        return version

    def _entries(self, as_of: int | None) -> DataFrame:
        """of, source, change: the entries that hold after version as_of."""
        schema = StructType([StructField("of", self.schema[self.slice].dataType), StructField("source", LongType()), StructField("change", LongType())])
        entries = self.spark.read.schema(schema).parquet(f"{self.path}/entries")
        entries = entries.where(F.col("change") <= (self.version() if as_of is None else as_of))
        last = entries.groupBy("of").agg(F.max("change").alias("change"))
        last = last.select(F.col("of").alias("last_of"), F.col("change").alias("last_change"))
        return entries.join(last, entries["of"].eqNullSafe(F.col("last_of")) & (F.col("change") == F.col("last_change")), "left_semi")

    def version(self) -> int:
        """The newest version."""
        return self.spark.read.schema("made long").parquet(f"{self.path}/versions").agg(F.max("made")).first()[0]

    def rows(self, as_of: int | None = None) -> DataFrame:
        """The rows now, or as they were after version as_of."""
        held = self.spark.read.schema(StructType([*self.schema, StructField("change", LongType())])).parquet(f"{self.path}/rows")
        entries = self._entries(as_of).select("of", "source")
        same = held[self.slice].eqNullSafe(entries["of"]) & (held["change"] == entries["source"])
        return held.join(entries, same, "left_semi").drop("change")

    def replace(self, rows: DataFrame, slices: DataFrame | None = None) -> int:
        """The slices get these rows in place of theirs; returns the version.  slices: a
        table with the slice's column, by default the slices of the rows; those that
        have no rows become empty, and rows of other slices are left out."""
        version = self.version() + 1
        named = (rows if slices is None else slices).select(F.col(self.slice).alias("of")).distinct()
        self._write_rows(rows.join(named, rows[self.slice].eqNullSafe(named["of"]), "left_semi"), version)
        return self._commit(named.select("of", F.lit(version).cast("long").alias("source")), version)

    def insert(self, rows: DataFrame, keys: list[str]) -> int:
        """Rows whose keys the table hasn't enter; of equal keys the least row does."""
        version = self.version() + 1
        held = self.rows(version - 1).select(*[F.col(k).alias(f"held_{i}") for i, k in enumerate(keys)])
        new = rows.join(held, _same(rows, keys), "left_anti")
        whole = F.struct(*[F.col(f"`{f.name}`") for f in self.schema])
        self._write_rows(new.groupBy(*keys).agg(F.min(whole).alias("least_row")).select("least_row.*"), version)
        entered = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows/change={version}").select(F.col(self.slice).alias("in_slice")).distinct()
        before = self._entries(version - 1).select("of", "source")
        before = before.join(entered, before["of"].eqNullSafe(entered["in_slice"]), "left_semi")
        return self._commit(before.unionByName(entered.select(F.col("in_slice").alias("of"), F.lit(version).cast("long").alias("source"))), version)

    def restore(self, as_of: int, slices: DataFrame | None = None) -> int:
        """The slices (all, by default) are again as they were after version as_of; a
        slice that wasn't there yet becomes empty."""
        version = self.version() + 1
        now = self._entries(version - 1).select("of").distinct()
        if slices is not None:
            named = slices.select(F.col(self.slice).alias("named")).distinct()
            now = now.join(named, now["of"].eqNullSafe(named["named"]), "left_semi")
        then = self._entries(as_of).select(F.col("of").alias("then_of"), "source")
        # what an attempt that was lost left behind must not be read as this version's rows
        self._write_rows(self.spark.createDataFrame([], self.schema), version)
        return self._commit(now.join(then, now["of"].eqNullSafe(then["then_of"]), "left").select("of", "source"), version)

    def report(self, version: int) -> DataFrame:
        """Rows of each slice that the version touched: the slice, rows_before, rows_after."""
        count = lambda at, name: self.rows(at).groupBy(F.col(self.slice).alias(f"{name}_of")).agg(F.count("*").alias(name))
        touched = self._entries(version).where(F.col("change") == version).select("of").distinct()
        before, after = count(version - 1, "rows_before"), count(version, "rows_after")
        out = touched.join(before, touched["of"].eqNullSafe(F.col("rows_before_of")), "left").join(after, touched["of"].eqNullSafe(F.col("rows_after_of")), "left")
        return out.select(F.col("of").alias(self.slice), *[F.coalesce(n, F.lit(0)).alias(n) for n in ("rows_before", "rows_after")])


def _same(rows: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [rows[k].eqNullSafe(F.col(f"held_{i}")) for i, k in enumerate(keys)])


def cleared(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with these columns null."""
    return rows.withColumns({n: F.lit(None).cast(rows.schema[n].dataType) for n in columns})
