"""Greedy one-to-one assignment of parsed lines to open requests, mail by mail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
#: Tokens that a line and a request must share.
LEAST_TOKENS = 2
ENTRY = "array<struct<id:bigint,number:string,tokens:array<string>>>"
OUT = "array<struct<line_id:bigint,request_id:bigint,matched_by:string>>"


def step(state: Column, line: Column) -> Column:
    """The free requests and the answers so far after one more line."""
    free = state["free"]
    # of requests with one number the last has it, used or not
    named = F.try_element_at(F.filter(state["requests"], lambda r: r["number"] == line["number"]), F.lit(-1))["id"]
    by_number = F.when(F.exists(free, lambda r: r["id"] == named), named)
    shared = F.transform(free, lambda r, i: F.struct((-F.size(F.array_intersect(r["tokens"], line["tokens"]))).alias("less"), i.alias("at"), r["id"].alias("id")))
    best = F.array_min(shared)
    by_tokens = F.when(best["less"] <= -LEAST_TOKENS, best["id"])
    sole = F.when(F.size(free) == 1, F.get(free, F.lit(0))["id"])
    chosen = F.coalesce(by_number, by_tokens, sole)
    how = F.when(by_number.isNotNull(), "number").when(by_tokens.isNotNull(), "tokens").when(sole.isNotNull(), "sole")
    answer = F.array(F.struct(line["id"].alias("line_id"), chosen.alias("request_id"), how.alias("matched_by"))).cast(OUT)
    return F.struct(
        state["requests"].alias("requests"), F.filter(free, lambda r: ~r["id"].eqNullSafe(chosen)).alias("free"), F.concat(state["out"], answer).alias("out")
    )


def greedy_assignment(rows: DataFrame) -> DataFrame:
    """rows: mail_id, side ('line' or 'request'), id, number, tokens; returns mail_id,
    line_id, request_id, matched_by.

    In order of id a line takes the request with its number if that is free, else the free
    one with most shared tokens (two at least, the first of equals), else the only one that
    is left.  A request is used once.  The order within a mail decides, so a mail is folded
    as a whole; it has as many rows as one message states.  Rows without a mail_id are one
    mail; a null or empty number and null tokens match nothing; repeated rows are lines of
    their own; an empty table gives no rows."""
    number = F.when(c("number") != "", c("number").cast("string"))
    entry = F.struct(c("id").cast("bigint").alias("id"), number.alias("number"), F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
    side = lambda name: F.array_sort(F.collect_list(F.when(c("side") == name, entry))).cast(ENTRY).alias(name)
    mails = rows.groupBy("mail_id").agg(side("line"), side("request"))
    start = F.struct(c("request").alias("requests"), c("request").alias("free"), F.array().cast(OUT).alias("out"))
    return mails.select("mail_id", F.explode(F.aggregate("line", start, step)["out"]).alias("x")).select("mail_id", "x.line_id", "x.request_id", "x.matched_by")
