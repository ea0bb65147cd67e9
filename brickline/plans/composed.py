"""Columns composed of the star schema's numbers by short expressions that Spark
and DuckDB both read, so that a query and its oracle start from the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

SPARK, DUCK = "spark", "duck"


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    return f"'{value}'" if isinstance(value, str) else str(value)


class Pick:
    """The value whose number the index (0, 1, ...) gives."""

    def __init__(self, values: list, index: str, kind: str = ""):
        self.values, self.index = values, index
        self.kind = kind or ("varchar" if any(isinstance(v, str) for v in values) else "int")

    def sql(self, dialect: str) -> str:
        cells = ", ".join(literal(v) for v in self.values)
        at = f"cast(floor(({self.index}) % {len(self.values)}) as int) + 1"
        kind = "string" if dialect == SPARK and self.kind == "varchar" else self.kind
        got = f"element_at(array({cells}), {at})" if dialect == SPARK else f"([{cells}])[{at}]"
        return f"cast({got} as {kind})"


class Composed:
    """Named columns: plain expressions of both dialects, or picks."""

    def __init__(self, table: str, key: dict[str, str], picks: dict[str, Pick], then: dict[str, str]):
        self.table, self.key, self.picks, self.then = table, key, picks, then

    def spark(self, df: DataFrame) -> DataFrame:
        first = df.selectExpr(*[f"{e} as {n}" for n, e in self.key.items()], *[f"{p.sql(SPARK)} as {n}" for n, p in self.picks.items()])
        return first.selectExpr("*", *[f"{e} as {n}" for n, e in self.then.items()])

    def duck(self) -> str:
        cells = [f"{e} AS {n}" for n, e in self.key.items()] + [f"{p.sql(DUCK)} AS {n}" for n, p in self.picks.items()]
        later = "".join(f", {e} AS {n}" for n, e in self.then.items())
        return f"SELECT *{later} FROM (SELECT {', '.join(cells)} FROM {self.table})"


def norm_sql(x: str) -> str:
    """Trimmed, lower case, umlauts spelt out, null as the empty text, in DuckDB."""
    return f"replace(replace(replace(replace(lower(trim(coalesce({x}, ''))), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')"


def values_sql(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
