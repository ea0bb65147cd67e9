"""Offer building: priced lines, warnings and totals."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickline.functions.numbers import tier_price

MONEY = "decimal(18,2)"


def money(c: Column) -> Column:
    """Commercially rounded to cents; sums of it don't depend on order."""
    return F.round(c, 2).cast(MONEY)


def priced_lines(lines: DataFrame, quantity: str, list_price: str, tiers: dict[int, str], custom: str | None = None) -> DataFrame:
    """Adds base_price, unit_price (never below the base where one is known) and total_net."""
    qty = F.when(F.coalesce(quantity, F.lit(0)) == 0, F.lit(1.0)).otherwise(F.col(quantity).cast("double"))
    base = tier_price(qty, F.col(list_price), {n: F.col(t) for n, t in tiers.items()}, needs_list_price=False)
    unit = F.greatest(base, F.col(custom)) if custom else base
    return lines.withColumns({"base_price": base}).withColumns({"unit_price": unit}).withColumn("total_net", money(F.col("unit_price") * qty))


def warnings(lines: DataFrame, key: list[str], tests: dict[str, Column]) -> DataFrame:
    """A row for each line and warning that holds, in one pass over the lines."""
    found = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))
    return lines.select(*key, F.explode(found).alias("warning"))


def totals(lines: DataFrame, key: str, amount: str = "total_net", rate: float = 0.19) -> DataFrame:
    """Net, VAT and gross per offer, each rounded; the lines are decimals already."""
    return taxed(lines.groupBy(key).agg(F.count("*").alias("n_lines"), F.sum(amount).alias("net")), rate)


def taxed(sums: DataFrame, rate: float = 0.19) -> DataFrame:
    """Adds vat and gross to net sums."""
    # decimals throughout: half cents round up as written
    tax = F.round(F.col("net") * F.lit(Decimal(str(rate))), 2).cast(MONEY)
    return sums.withColumns({"net": F.col("net").cast(MONEY), "vat": tax}).withColumn("gross", (F.col("net") + F.col("vat")).cast(MONEY))


def gate_violations(checks: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """(key, violation) rows of every failed check: (name, failing rows, key column)."""
    out = None
    for name, rows, key in checks:
        part = rows.select(F.col(key).cast("string").alias("key"), F.lit(name).alias("violation"))
        out = part if out is None else out.unionByName(part)
    return out
