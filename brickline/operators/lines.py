"""Ordered lines: blocks, cuts, joined paragraphs and values carried forward.

A document's lines are ordered by a line number; everything is a window over
(document, line), so documents are processed side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 1), line."""
    return df.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("p", "line")).select(
        key, (F.col("p") + 1).alias("line_no"), "line"
    )


def blocks(lines: DataFrame, key: str, heading: Column) -> DataFrame:
    """Adds block (from 1), opened by each heading; lines before the first go."""
    order = Window.partitionBy(key).orderBy("line_no")
    marked = lines.withColumn("block", F.sum(F.coalesce(heading, F.lit(False)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.where("block > 0")


def block_texts(lines: DataFrame, key: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy(key, "block").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"), F.count("*").alias("n_lines"))


def cut_after_first(lines: DataFrame, keys: list[str], stop: Column) -> DataFrame:
    """Lines up to and with the first where stop holds; all if it never does."""
    first = F.min(F.when(stop, F.col("line_no"))).over(Window.partitionBy(*keys))
    return lines.withColumn("cut", first).where(F.col("cut").isNull() | (F.col("line_no") <= F.col("cut"))).drop("cut")


def joined_paragraphs(lines: DataFrame, key: str, label: Column) -> DataFrame:
    """key, paragraph, text: a line continues its predecessor unless that ended in
    punctuation, either is blank, or a label starts here."""
    order = Window.partitionBy(key).orderBy("line_no")
    trimmed = F.trim("line")
    before = F.lag(trimmed).over(order)
    fresh = before.isNull() | (before == "") | (trimmed == "") | before.rlike(r"[.:;!?]$") | label
    numbered_ = lines.withColumns({"fresh": F.coalesce(fresh, F.lit(True)).cast("int"), "clean": trimmed})
    part = F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "clean")))
    return (
        numbered_.withColumn("paragraph", part).where("clean <> ''").groupBy(key, "paragraph")
        .agg(F.array_join(F.transform(ordered, lambda x: x["clean"]), " ").alias("text"))
    )


def carried(df: DataFrame, key: str, order: list[str], is_reference: Column, fields: list[str]) -> DataFrame:
    """Reference rows take missing fields from the last row before that isn't one.

    Chains of references see the same row, since a reference adds nothing new."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ref = F.coalesce(is_reference, F.lit(False))
    last = {f: F.last(F.when(~ref, F.col(f)), ignorenulls=True).over(before) for f in fields}
    return df.withColumns({f"carried_{f}": F.when(ref, F.coalesce(F.col(f), last[f])).otherwise(F.col(f)) for f in fields})
