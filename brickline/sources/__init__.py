"""Sources and sinks: delimited catalogues, JSON lines, page text, Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brickline.functions.numbers import parse_number, to_int

_TEXTS = {"string"}


def read_catalogue_csv(spark: SparkSession, path: str, schema: StructType, delimiter: str = ";") -> DataFrame:
    """A delimited catalogue with numbers in either notation; empty cells are null.

    Columns that the file lacks are null, unknown ones are left out."""
    raw = spark.read.option("header", True).option("delimiter", delimiter).option("multiLine", True).csv(path)
    known = {c.strip().lower(): c for c in raw.columns}

    def cell(field):
        name = known.get(field.name.lower())
        kind = field.dataType.simpleString()
        if name is None:
            return F.lit(None).cast(kind).alias(field.name)
        value = F.nullif(F.trim(F.col(f"`{name}`")), F.lit(""))
        typed = value if kind in _TEXTS else to_int(value).cast(kind) if kind in ("int", "bigint") else parse_number(value).cast(kind)
        return typed.alias(field.name)

    return raw.select(*[cell(f) for f in schema])


def read_json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def page_lines(pages: DataFrame, key: str = "doc_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """key, page, line_no, text of each page's lines."""
    return pages.select(key, page, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "text"))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
