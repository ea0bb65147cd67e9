"""The export of an offer: its gate, lines, warnings and result, for all projects at once.

Tables, each with the project:

- positions: place (their order), position_id, number, description, quantity, unit,
  position_type, billable, components (names, array);
- selections: place, position_id, articles and keys (arrays, one assignment each; keys may be short);
- terms: assignment_key, custom_price, is_alternative, supplier_open;
- inquiries: position_id, supplier_id, number, status, product_description, updated_at;

and, for all projects, products (artikel_id, name, maker, unit, list_price and the tier
prices) and offers (offer_id, article_number, article_name, unit, unit_price, supplier).

An assignment whose id begins with ``SO-`` is looked up among the offers, any other among
the products; both stand in one table, whose keys tell them apart, so that assignments are
joined once and none has a null key.  What isn't found is a warning in place of a line.

Nulls: a null or zero quantity counts as one, an empty unit or text as missing; a selection
without a position is left out, as is a null list of articles; keys that repeat in terms,
products or offers are an error of the tables and repeat their lines.  Empty tables give
empty results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickline.functions.numbers import tier_price
from brickline.operators import offers as pricing
from brickline.operators.relational import without_superseded

c = F.col
OFFER_PREFIX = "SO-"
SERVICE = "dienstleistung"
#: What an inquiry's status means.
WAITING, RECEIVED = "offen", "angebot_erhalten"
PENDING = ("offen", "angefragt")
PROGRESSED = ("angefragt", "angebot_erhalten")
#: What warnings and refusals say.
UNASSIGNED = "Kein Artikel zugeordnet"
NO_OFFER, NO_PRODUCT = "Lieferantenangebot {} nicht gefunden", "Artikel {} nicht in Datenbank gefunden"
NO_PRICE, BELOW_COST = "Kein Preis verfügbar für {}, 0 EUR verwendet", "VK unter EK nicht erlaubt, EK verwendet"
NO_QUANTITY = "Menge nicht erkannt, Standard 1 verwendet"
STILL_OPEN = "Angebot gesperrt: {} offene Lieferantenanfrage(n) vorhanden."
NOT_ASSIGNED = "Angebot gesperrt: Position {} ist noch nicht zugeordnet."
KEYS_SHORT = "Angebot gesperrt: Zuordnungsdaten für Position {} sind unvollständig."
PARTS_MISSING = "Angebot gesperrt: Komponenten für Position {} sind nicht vollständig zugeordnet."
NOTHING = "Keine gültigen Artikel für den Export ausgewählt"
TIERS = {10: "price_10", 50: "price_50", 100: "price_100"}


def said(pattern: str, value: Column) -> Column:
    before, after = pattern.split("{}")
    return F.concat(F.lit(before), F.coalesce(value.cast("string"), F.lit("?")), F.lit(after))


def full(*values: Column) -> Column:
    """The first value that isn't null or empty."""
    return F.coalesce(*[F.when(v != "", v) for v in values])


def listed(values: str) -> Column:
    return F.coalesce(c(values), F.expr("cast(array() as array<string>)"))


def received_texts(inquiries: DataFrame) -> DataFrame:
    """project, position_id, offer_text: the newest received text of each position."""
    got = inquiries.where((c("status") == RECEIVED) & c("position_id").isNotNull() & (c("product_description") != ""))
    return got.groupBy("project", "position_id").agg(F.max_by("product_description", F.struct("updated_at", "product_description")).alias("offer_text"))


def assignments(positions: DataFrame, selections: DataFrame, terms: DataFrame, inquiries: DataFrame) -> DataFrame:
    """A row for each selected article of a known position, with its terms: nth from 0."""
    known = positions.drop("place", "components", "billable").join(received_texts(inquiries), ["project", "position_id"], "left")
    # terms first, while rows are short: position's texts come with the last join
    each = selections.select("project", "position_id", "place", "keys", F.posexplode("articles").alias("nth", "artikel_id"))
    keyed = each.withColumn("assignment_key", F.coalesce(F.get("keys", "nth"), F.concat("position_id", F.lit("::"), c("nth").cast("string")))).drop("keys")
    return keyed.join(terms, ["project", "assignment_key"], "left").join(known, ["project", "position_id"])


def resolved(assigned: DataFrame, products: DataFrame, offers: DataFrame) -> DataFrame:
    """Every assignment as an offer's line, or as none (is_line false), with its warnings in order."""
    own = assigned.where(c("artikel_id").isNotNull()).withColumns({"asked": c("quantity"), "quantity": F.coalesce(F.when(c("quantity") != 0, c("quantity").cast("double")), F.lit(1.0))})
    bought = F.startswith("artikel_id", F.lit(OFFER_PREFIX))
    wanted = F.substring("artikel_id", len(OFFER_PREFIX) + 1, 20).try_cast("long").cast("string")
    # prefixed names keep the tables' columns apart; an offer's key begins as no product's does
    shop = products.withColumnsRenamed({n: f"p_{n}" for n in products.columns}).withColumn("key", c("p_artikel_id")).where(~F.startswith("key", F.lit(OFFER_PREFIX)))
    market = offers.withColumnsRenamed({n: f"o_{n}" for n in offers.columns}).withColumn("key", F.concat(F.lit(OFFER_PREFIX), c("o_offer_id").cast("string")))
    goods = shop.unionByName(market, allowMissingColumns=True).withColumnRenamed("key", "goods_key")
    rows = own.withColumn("key", F.when(bought, F.coalesce(F.concat(F.lit(OFFER_PREFIX), wanted), "artikel_id")).otherwise(c("artikel_id"))).join(goods, c("key") == c("goods_key"), "left")
    either = lambda offer, product: F.when(bought, offer).otherwise(product)
    found = c("goods_key").isNotNull()
    base = tier_price(c("quantity"), c("p_list_price"), {n: c(f"p_{t}") for n, t in TIERS.items()}, needs_list_price=False)
    cost = F.coalesce(base, F.lit(0.0))
    price = F.greatest(either(F.coalesce("o_unit_price", F.lit(0.0)), cost), c("custom_price"))
    stocked = ~bought & found
    warnings = [
        F.when(~bought & ~found, said(NO_PRODUCT, c("artikel_id"))), F.when(stocked & base.isNull(), said(NO_PRICE, c("artikel_id"))),
        F.when(stocked & (c("custom_price") < cost), F.lit(BELOW_COST)), F.when(stocked & (c("nth") == 0) & c("asked").isNull(), F.lit(NO_QUANTITY)),
        F.when(bought & ~found, said(NO_OFFER, c("artikel_id"))),
    ]
    return rows.select(
        "project", "place", "position_id", "nth", "number", F.coalesce("offer_text", "description").alias("description"), "quantity",
        full(c("unit"), either(c("o_unit"), c("p_unit")), F.lit("Stk")).alias("unit"),
        F.when(found, either(full(c("o_article_number"), c("artikel_id")), c("p_artikel_id"))).otherwise(c("artikel_id")).alias("artikel_id"),
        either(c("o_article_name"), c("p_name")).alias("name"), either(F.when(found, F.coalesce("o_supplier", F.lit("Lieferant"))), c("p_maker")).alias("maker"),
        F.when(found, pricing.money(price)).alias("price_net"), F.when(found, pricing.money(price * c("quantity"))).alias("total_net"), (c("nth") > 0).alias("is_additional"),
        F.coalesce("is_alternative", F.lit(False)).alias("is_alternative"), F.coalesce("supplier_open", F.lit(False)).alias("supplier_open"),
        found.alias("is_line"), F.array_compact(F.array(*warnings)).alias("warnings"),
    )


def export_lines(found: DataFrame) -> DataFrame:
    """The lines of resolved(); in a project they stand in the order of place and nth."""
    return found.where("is_line").drop("is_line", "warnings")


def unassigned(positions: DataFrame, selections: DataFrame) -> DataFrame:
    """Positions, but for services, without an article."""
    some = selections.where(F.size("articles") > 0).select("project", "position_id").distinct()
    return positions.where(~F.coalesce(c("position_type") == SERVICE, F.lit(False))).join(some, ["project", "position_id"], "left_anti")


def export_warnings(positions: DataFrame, selections: DataFrame, found: DataFrame) -> DataFrame:
    """project, side, place, nth, at, position_id, number, reason: by these first columns the
    warnings stand in order, positions without an article before all others."""
    none = unassigned(positions, selections)
    first = none.select("project", F.lit(0).alias("side"), "place", F.lit(0).alias("nth"), F.lit(0).alias("at"), "position_id", "number", F.lit(UNASSIGNED).alias("reason"))
    later = found.select("project", F.lit(1).alias("side"), "place", "nth", F.posexplode("warnings").alias("at", "reason"), "position_id", "number")
    return first.unionByName(later)


def pending_inquiries(inquiries: DataFrame) -> DataFrame:
    """project, pending: inquiries without an answer; an open one that was sent or answered since doesn't count."""
    keys = ["project", "position_id", "supplier_id", "number"]
    left = without_superseded(inquiries.select(*keys, "status"), keys, c("status") == WAITING, c("status").isin(*PROGRESSED))
    return left.where(c("status").isin(*PENDING)).groupBy("project").agg(F.count("*").alias("pending"))


def gate(positions: DataFrame, selections: DataFrame, inquiries: DataFrame) -> DataFrame:
    """project, code, detail of each project whose export is refused: the first reason in
    the order inquiries, then position by position assignment, keys, components."""
    open_ = pending_inquiries(inquiries).join(positions.select("project").distinct(), "project", "left_semi")
    asked = open_.select("project", F.struct(F.lit(0).alias("side"), F.lit(0).cast("long").alias("place")).alias("at"), F.struct(F.lit(409).alias("code"), said(STILL_OPEN, c("pending")).alias("detail")).alias("why"))
    chosen = selections.select("project", "position_id", listed("articles").alias("articles"), listed("keys").alias("keys"))
    due = positions.where(F.coalesce(c("billable"), F.lit(False)) & ~F.coalesce(c("position_type") == SERVICE, F.lit(False)))
    held = due.join(chosen, ["project", "position_id"], "left").withColumns({"articles": listed("articles"), "keys": listed("keys")})
    wanted = F.transform(listed("components"), lambda x: F.concat("position_id", F.lit("::component::"), x))
    reason = (
        F.when(F.size("articles") == 0, said(NOT_ASSIGNED, c("number")))
        .when((F.size("keys") > 0) & (F.size("keys") != F.size("articles")), said(KEYS_SHORT, c("number")))
        .when(F.size(F.array_except(wanted, "keys")) > 0, said(PARTS_MISSING, c("number")))
    )
    failed = held.withColumn("reason", reason).where("reason is not null").select(
        "project", F.struct(F.lit(1).alias("side"), c("place").cast("long").alias("place")).alias("at"), F.struct(F.lit(400).alias("code"), c("reason").alias("detail")).alias("why")
    )
    first = asked.unionByName(failed).groupBy("project").agg(F.min_by("why", "at").alias("why"))
    return first.select("project", "why.code", "why.detail")


def exported(positions: DataFrame, selections: DataFrame, inquiries: DataFrame, found: DataFrame) -> DataFrame:
    """One row per project: code (200 if exported) and detail; of what is exported the
    counts, whether a line is an alternative, the amounts and the project's new status."""
    sums = pricing.taxed(found.groupBy("project").agg(
        F.count_if("is_line").alias("n_lines"), F.bool_or(c("is_line") & c("is_alternative")).alias("any_alternative"),
        F.sum(F.when(c("is_line"), c("total_net"))).alias("net"), F.sum(F.size("warnings")).alias("n_said"),
    ))
    none = unassigned(positions, selections).groupBy("project").agg(F.count("*").alias("n_none"))
    every = positions.groupBy("project").agg(F.count("*").alias("n_positions"))
    all_ = every.join(gate(positions, selections, inquiries), "project", "left").join(sums, "project", "left").join(none, "project", "left")
    empty = F.coalesce("n_lines", F.lit(0)) == 0
    code = F.coalesce("code", F.when(empty, 400), F.lit(200))
    good = code == 200
    return all_.select(
        "project", code.alias("code"), F.coalesce("detail", F.when(empty, F.lit(NOTHING))).alias("detail"), "n_positions",
        *[F.when(good, c(n)).alias(n) for n in ("n_lines", "any_alternative", "net", "vat", "gross")],
        F.when(good, F.coalesce("n_said", F.lit(0)) + F.coalesce("n_none", F.lit(0))).alias("n_warnings"), F.when(good, F.lit("gerechnet")).alias("status"),
    )
