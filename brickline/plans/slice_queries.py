"""A catalogue whose makers' slices are replaced, extended, cleared and restored."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickline.functions.session import shared_folder
from brickline.operators.slices import SlicedTable, cleared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Read by Spark and DuckDB alike, of part's columns.
ROW = {"id": "p_partkey", "maker": "p_brand", "price": "CAST(p_retailprice AS DECIMAL(12,2))", "note": "p_type"}
RAISED = ROW | {"price": "CAST(p_retailprice * 2 AS DECIMAL(12,2))"}
#: Two thirds of the keys are new.
IMPORTED = ROW | {"id": "p_partkey + 10000000 * (p_partkey % 3)"}
SUMMED = "count(*) AS n, CAST(sum(price) AS DOUBLE) AS total, count(note) AS notes"


def changed_catalogue(spark: SparkSession, sf: str) -> SlicedTable:
    """Version 1 replaces makers that end in 1, 2 adds new keys of those that end in 2,
    3 clears two columns of those that end in 3, 4 takes two makers back to version 0."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    rows = lambda of: part.selectExpr(*[f"{e} AS {n}" for n, e in of.items()], "p_size")
    plain = rows(ROW).drop("p_size")
    table = SlicedTable.create(plain, f"{shared_folder(spark)}/slices-{uuid.uuid4().hex}", "maker")
    table.replace(rows(RAISED).where("maker LIKE '%1' AND p_size % 2 = 0").drop("p_size"), plain.where("maker LIKE '%1'").select("maker"))
    table.insert(rows(IMPORTED).where("maker LIKE '%2'").drop("p_size"), ["id"])
    table.replace(cleared(table.rows().where("maker LIKE '%3'"), ["price", "note"]))
    table.restore(0, plain.where("maker IN ('Brand#11', 'Brand#22')").select("maker"))
    return table


def replaced_slices(spark: SparkSession, sf: str) -> DataFrame:
    """Every maker's rows, sum and notes after each version."""
    table = changed_catalogue(spark, sf)
    states = [table.rows(v).groupBy("maker").agg(F.count("*").alias("n"), F.sum("price").cast("double").alias("total"), F.count("note").alias("notes")) for v in range(5)]
    out = states[0].withColumn("version", F.lit(0))
    for v in range(1, 5):
        out = out.unionByName(states[v].withColumn("version", F.lit(v)))
    return out


def slice_report(spark: SparkSession, sf: str) -> DataFrame:
    """Rows before and after, of each slice that a version touched."""
    table = changed_catalogue(spark, sf)
    out = table.report(1).withColumn("version", F.lit(1))
    for v in (2, 3, 4):
        out = out.unionByName(table.report(v).withColumn("version", F.lit(v)))
    return out


def _rows_sql(of: dict[str, str]) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in of.items()) + " FROM part"


STATES = f"""v0 AS ({_rows_sql(ROW)}),
v1 AS (SELECT * FROM v0 WHERE maker NOT LIKE '%1' UNION ALL {_rows_sql(RAISED)} WHERE p_brand LIKE '%1' AND p_size % 2 = 0),
v2 AS (SELECT * FROM v1 UNION ALL SELECT * FROM ({_rows_sql(IMPORTED)}) WHERE maker LIKE '%2' AND id NOT IN (SELECT id FROM v1)),
v3 AS (SELECT id, maker, CASE WHEN maker LIKE '%3' THEN NULL ELSE price END AS price, CASE WHEN maker LIKE '%3' THEN NULL ELSE note END AS note FROM v2),
v4 AS (SELECT * FROM v3 WHERE maker NOT IN ('Brand#11', 'Brand#22') UNION ALL SELECT * FROM v0 WHERE maker IN ('Brand#11', 'Brand#22'))"""

QUERIES["replaced_slices"] = replaced_slices
ORACLE["replaced_slices"] = f"WITH {STATES} " + " UNION ALL ".join(f"SELECT {v} AS version, maker, {SUMMED} FROM v{v} GROUP BY maker" for v in range(5))

TOUCHED = {1: "maker LIKE '%1'", 2: "maker IN (SELECT maker FROM v2 WHERE id NOT IN (SELECT id FROM v1))", 3: "maker LIKE '%3'", 4: "maker IN ('Brand#11', 'Brand#22')"}
QUERIES["slice_report"] = slice_report
ORACLE["slice_report"] = f"WITH {STATES} " + " UNION ALL ".join(
    f"SELECT {v} AS version, maker, (SELECT count(*) FROM v{v - 1} b WHERE b.maker = m.maker) AS rows_before, (SELECT count(*) FROM v{v} a WHERE a.maker = m.maker) AS rows_after"
    f" FROM (SELECT DISTINCT maker FROM v0 WHERE {t}) m"
    for v, t in TOUCHED.items()
)
