"""Supplier replies: what a message refers to, and which open inquiry it answers.

Candidates are scored per message; a window over (message, item number) ranks them
and guards against ambiguity, so messages are handled side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickline.functions.text import text_of

#: How references and addresses are written in messages.
INQUIRY_TAG = r"(?i)TBX-INQ[:#\s-]*(\d+)"
PROJECT_TAG = r"(?i)TBX-PROJ[:#\s-]*(\d+)[^\n\r]{0,120}?OZ[:#\s-]*([0-9]{1,3}(?:\.[0-9]{1,4}){1,3})"
ITEM_NUMBER = r"\b\d{1,3}(?:\.\d{1,4}){1,3}\b"
RECIPIENT = r"(?iu)(?:original[-\s]*empf(?:a|ä)nger|original[-\s]*recipient)\s*:\s*([^\s,;<>]+@[^\s,;<>]+)"
ADDRESS = r"(?i)\b([A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,})\b"
#: Points of a candidate, and the leads and least scores that make a choice safe.
SUPPLIER, PROJECT, RECENT, STALE, TOKEN, TOKENS_MOST = 35, 25, 12, -8, 3, 18
RECENT_DAYS, STALE_DAYS = 21, 90
LEAST, LEAD, LEAST_UNNUMBERED, LEAD_UNNUMBERED = 5, 8, 14, 5


def every(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text_of(text), F.lit(pattern), F.lit(group))


def addresses(sender: Column, corpus: Column) -> Column:
    """The sender and the recipients that the message names; any other address only if that is one at most."""
    clean = lambda xs: F.transform(xs, lambda x: F.lower(F.trim(x)))
    own = F.filter(F.array(F.lower(F.trim(text_of(sender)))), lambda x: x != "")
    named = F.array_union(own, clean(every(corpus, RECIPIENT)))
    return F.when(F.size(named) <= 1, F.array_union(named, clean(every(corpus, ADDRESS)))).otherwise(named)


def inquiry_references(corpus: Column) -> Column:
    return F.array_distinct(F.transform(every(corpus, INQUIRY_TAG), lambda x: x.try_cast("long")))


def project_references(corpus: Column) -> Column:
    """Array of struct(project, number)."""
    part = lambda x, i: F.regexp_extract(x, PROJECT_TAG, i)
    tags = F.transform(every(corpus, PROJECT_TAG, 0), lambda x: F.struct(part(x, 1).try_cast("long").alias("project"), part(x, 2).alias("number")))
    return F.array_distinct(tags)


def item_numbers(corpus: Column) -> Column:
    return F.array_distinct(every(corpus, ITEM_NUMBER, 0))


def inquiry_score(supplier_named: Column, project_named: Column, age_days: Column, shared_tokens: Column) -> Column:
    """How well an open inquiry fits a message; unknown age or text counts nothing."""
    worth = lambda test, points: F.when(F.coalesce(test, F.lit(False)), points).otherwise(0)
    age = F.when(age_days <= RECENT_DAYS, RECENT).when(age_days > STALE_DAYS, STALE).otherwise(0)
    return worth(supplier_named, SUPPLIER) + worth(project_named, PROJECT) + age + F.least(F.lit(TOKENS_MOST), F.coalesce(shared_tokens, F.lit(0)) * TOKEN)


def candidates(inquiries: DataFrame, hints: DataFrame) -> DataFrame:
    """Pending inquiries that a message may answer.

    hints: mail_id, inquiry_ids, supplier_ids, project_ids, numbers (arrays).  Named
    inquiries go before all else; otherwise every non-empty list has to hold, and a
    message without any hint has no candidates.  inquiries: inquiry_id, supplier_id,
    project_id, number.  Joined through the first list that a message has."""
    lists = {"inquiry_id": "inquiry_ids", "supplier_id": "supplier_ids", "project_id": "project_ids", "number": "numbers"}
    filled = {k: F.size(F.coalesce(F.col(v), F.array())) > 0 for k, v in lists.items()}
    first = F.coalesce(*[F.when(filled[k], F.lit(k)) for k in lists])
    led = hints.withColumn("led_by", first)
    out = None
    for key, values in lists.items():
        mine = led.where(F.col("led_by") == key).withColumn("led_key", F.explode(F.array_distinct(values)))
        found = mine.join(inquiries, F.col("led_key") == inquiries[key])
        for k, v in lists.items():
            if key != "inquiry_id" and k not in (key, "inquiry_id"):
                found = found.where(~filled[k] | F.coalesce(F.array_contains(F.col(v), F.col(k)), F.lit(False)))
        part = found.select("mail_id", *[inquiries[c] for c in inquiries.columns])
        out = part if out is None else out.unionByName(part)
    return out


def chosen(pairs: DataFrame) -> DataFrame:
    """The inquiries that messages answer.

    A message that names inquiries (is_named, if there is that column) answers all of its
    candidates.

    pairs: mail_id, inquiry_id, number (null where the message names none), score,
    by_supplier, by_project (whether the message hints at either).  Several candidates
    need a supplier; without any hint the best needs LEAST points and a lead; without
    a number it needs more.  The sole candidate of a message is its answer."""
    order = Window.partitionBy("mail_id", "number").orderBy(F.col("score").desc(), "inquiry_id")
    whole, mail = Window.partitionBy("mail_id", "number"), Window.partitionBy("mail_id")
    ranked = pairs.withColumns({
        "nth_of_key": F.row_number().over(order), "second": F.lead("score").over(order), "n_number": F.count("*").over(whole), "n_mail": F.count("*").over(mail),
    })
    alone, hinted = F.col("n_number") == 1, F.col("by_supplier") | F.col("by_project")
    lead = F.col("score") - F.col("second")
    numbered = hinted | ((F.col("score") >= LEAST) & (alone | (lead >= LEAD)))
    unnumbered = (F.col("score") >= LEAST_UNNUMBERED) & (alone | (lead >= LEAD_UNNUMBERED))
    good = (F.col("nth_of_key") == 1) & (alone | F.col("by_supplier")) & F.when(F.col("number").isNull(), unnumbered).otherwise(numbered)
    named = F.coalesce(F.col("is_named"), F.lit(False)) if "is_named" in pairs.columns else F.lit(False)
    return ranked.where(named | good | (F.col("n_mail") == 1)).drop("nth_of_key", "second", "n_number", "n_mail")


def suggestion_score(suggested: Column, offered: Column, article: Column, offer_text: Column, dn: Column, maker: Column, supplier: Column) -> Column:
    """How likely an offer's text means a suggestion: 2 for a shared token, 8 for the
    article's id, 4 for its diameter, 3 if its maker's name has the supplier's first word."""
    low = F.lower(text_of(offer_text))
    diameters = F.regexp_extract_all(low, F.lit(r"\bdn\s*(\d+)\b"), F.lit(1))
    first_word = F.regexp_extract(F.lower(F.trim(text_of(supplier))), r"^\S+", 0)
    bonus = lambda test, points: F.when(F.coalesce(test, F.lit(False)), points).otherwise(0)
    total = (
        2 * F.size(F.array_intersect(suggested, offered)) + bonus((article != "") & F.contains(low, F.lower(article)), 8)
        + bonus(F.array_contains(diameters, dn.cast("string")), 4) + bonus((first_word != "") & F.contains(F.lower(maker), first_word), 3)
    )
    return F.when((F.size(suggested) > 0) & (F.size(offered) > 0), total).otherwise(0)


def offer_sources(scores: DataFrame) -> DataFrame:
    """position_id, artikel_id, supplier: the best suggestion of each received inquiry
    (2 points or more), an article going to the first inquiry that chose it.

    scores: position_id, inquiry_id, supplier, artikel_id, rank, score."""
    best = Window.partitionBy("position_id", "inquiry_id").orderBy(F.col("score").desc(), "rank")
    top = scores.withColumn("nth_of_key", F.row_number().over(best)).where("nth_of_key = 1 and score >= 2")
    return top.groupBy("position_id", "artikel_id").agg(F.min_by("supplier", "inquiry_id").alias("supplier"))
