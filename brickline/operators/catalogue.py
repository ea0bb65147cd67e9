"""Catalogue jobs: audit, enrichment, recoding and backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickline.functions.text import if_set


def coverage(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, filled, missing over all rows, in one aggregation."""
    filled = [F.count_if(F.col(f).isNotNull() & (F.trim(F.col(f).cast("string")) != "")).alias(f) for f in fields]
    wide = df.agg(F.count("*").alias("n_rows"), *filled)
    return wide.unpivot("n_rows", fields, "field", "filled").select("field", "filled", (F.col("n_rows") - F.col("filled")).alias("missing"))


def filled_if_empty(df: DataFrame, guesses: dict[str, Column]) -> DataFrame:
    """Empty fields take their guess; changed counts the fields that did."""
    empty = {f: if_set(F.col(f)).isNull() for f in guesses}
    hits = [F.when(empty[f] & g.isNotNull(), 1).otherwise(0) for f, g in guesses.items()]
    return df.withColumns({f: F.when(empty[f], g).otherwise(F.col(f)) for f, g in guesses.items()} | {"changed": sum(hits[1:], hits[0])})


def recoded(df: DataFrame, field: str, codes: dict[str, str]) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return df.withColumn(field, F.coalesce(F.element_at(table, F.col(field)), F.col(field)))


def highest_class(text: Column, ranks: dict[str, int]) -> Column:
    """The class of the highest rank that the text contains."""
    found = F.array_compact(F.array(*[F.when(F.contains(text, F.lit(c)), F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"))) for c, r in ranks.items()]))
    return F.array_max(found)["c"]
