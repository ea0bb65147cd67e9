"""Registered queries over the star-schema tables, with their oracle SQL.

Each applies a library operator to whole tables that stand in for the domain's:
part is the catalogue, supplier and lineitem the positions, orders the projects,
events the override log, documents, pages and conversations the texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brickline.functions import numbers as num
from brickline.functions import text as txt
from brickline.functions.session import materialised, shared_folder, spread
from brickline.operators import catalogue, inquiries, lines, offers, reconcile, relational, tenders
from brickline.operators.extraction import kinds
from brickline.operators.extraction.parameters import component_parts, parameters
from brickline.operators.matching import ranking
from brickline.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
c = F.col


def query(oracle: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return put


class Tables:
    """Tables of one scale, read on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


# -- relational ----------------------------------------------------------------


@query("""SELECT p_partkey, p_name, p_size, p_retailprice FROM part WHERE p_name ILIKE '%ring%' AND p_size BETWEEN 5 AND 45
ORDER BY p_retailprice DESC, p_partkey LIMIT 51 OFFSET 10""")
def catalog_search_page(spark, sf):
    part = Tables(spark, sf).part
    page = relational.search_page(
        part, [c("p_name").ilike("%ring%"), c("p_size").between(5, 45), None], [c("p_retailprice").desc(), c("p_partkey")], limit=50, offset=10
    )
    return page.select("p_partkey", "p_name", "p_size", "p_retailprice")


@query("""SELECT o_orderkey, o_orderstatus, o_orderdate, o_totalprice FROM orders
WHERE o_orderstatus IN ('O', 'P') AND o_orderdate >= TIMESTAMP '1998-01-01' AND o_totalprice > 100000""")
def optional_filters_ordered(spark, sf):
    tests = [c("o_orderstatus").isin("O", "P"), c("o_orderdate") >= F.lit("1998-01-01").cast("timestamp"), c("o_totalprice") > 100000, None]
    df = Tables(spark, sf).orders
    for t in tests:
        df = df if t is None else df.where(t)
    return df.select("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice").orderBy(c("o_orderdate").desc(), "o_orderkey")


_PRICES_SQL = """priced AS (
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, list_price, t10, t30,
  CASE WHEN l_quantity >= 30 AND t30 IS NOT NULL THEN t30 WHEN l_quantity >= 10 AND t10 IS NOT NULL THEN t10 ELSE list_price END AS base_price
FROM lineitem JOIN (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_retailprice END AS list_price,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_retailprice - 10 END AS t10, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice - 25 END AS t30
  FROM part) ON l_partkey = p_partkey)"""


def price_list(t: Tables) -> DataFrame:
    gap = lambda n, price: F.when(c("p_partkey") % n != 0, price)
    return t.part.select(
        "p_partkey", gap(10, c("p_retailprice")).alias("list_price"), gap(4, c("p_retailprice") - 10).alias("t10"), gap(3, c("p_retailprice") - 25).alias("t30")
    )


def offer_lines(t: Tables) -> DataFrame:
    joined = t.lineitem.join(price_list(t), c("l_partkey") == c("p_partkey"))
    return offers.priced_lines(joined, "l_quantity", "list_price", {10: "t10", 30: "t30"})


@query(f"""WITH {_PRICES_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, base_price,
CASE WHEN list_price IS NULL THEN NULL ELSE base_price END AS match_price,
CAST(CAST(round(base_price * l_quantity, 2) AS DECIMAL(18,2)) AS DOUBLE) AS total_net FROM priced""")
def tier_price_lines(spark, sf):
    df = offer_lines(Tables(spark, sf))
    strict = num.tier_price(c("l_quantity"), c("list_price"), {10: c("t10"), 30: c("t30")}, needs_list_price=True)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "base_price", strict.alias("match_price"), c("total_net").cast("double").alias("total_net"))


@query(f"""WITH {_PRICES_SQL}, n AS (SELECT l_orderkey, count(*) AS n_lines, sum(CAST(round(base_price * l_quantity, 2) AS DECIMAL(18,2))) AS net FROM priced GROUP BY 1)
SELECT l_orderkey, n_lines, CAST(net AS DOUBLE) AS net, CAST(vat AS DOUBLE) AS vat, CAST(net + vat AS DOUBLE) AS gross
FROM (SELECT *, round(CAST(net AS DECIMAL(18,2)) * CAST(0.19 AS DECIMAL(4,2)), 2) AS vat FROM n)""")
def offer_totals_vat(spark, sf):
    out = offers.totals(offer_lines(Tables(spark, sf)), "l_orderkey")
    return out.select("l_orderkey", "n_lines", *[c(x).cast("double").alias(x) for x in ("net", "vat", "gross")])


@query(f"""WITH {_PRICES_SQL}, w AS (
SELECT l_orderkey, l_linenumber, l_partkey, 'no_price' AS warning FROM priced WHERE base_price IS NULL
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'below_list' FROM priced WHERE base_price < list_price
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'small_quantity' FROM priced WHERE l_quantity <= 1)
SELECT l_orderkey, l_linenumber, l_partkey, warning FROM w""")
def offer_warnings(spark, sf):
    tests = {"no_price": c("base_price").isNull(), "below_list": c("base_price") < c("list_price"), "small_quantity": c("l_quantity") <= 1}
    return offers.warnings(offer_lines(Tables(spark, sf)), ["l_orderkey", "l_linenumber", "l_partkey"], tests)


@query("""SELECT c_custkey, coalesce(n, 0) AS pending, coalesce(n, 0) > 0 AS has_pending
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY 1) ON o_custkey = c_custkey""")
def pending_count_left_join(spark, sf):
    t = Tables(spark, sf)
    out = relational.count_left(t.customer, "c_custkey", t.orders.where(c("o_orderstatus").isin("O", "P")), "o_custkey", "pending")
    return out.select("c_custkey", "pending", (c("pending") > 0).alias("has_pending"))


@query("""SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'anfrage_offen' WHEN bool_and(o_orderstatus = 'F') THEN 'gerechnet'
WHEN bool_or(o_orderstatus = 'F') THEN 'offen' ELSE 'neu' END AS status, count(*) AS n FROM orders GROUP BY 1""")
def status_case(spark, sf):
    has = lambda s: F.bool_or(c("o_orderstatus") == s)
    status = F.when(has("P"), "anfrage_offen").when(F.bool_and(c("o_orderstatus") == "F"), "gerechnet").when(has("F"), "offen").otherwise("neu")
    return Tables(spark, sf).orders.groupBy("o_custkey").agg(status.alias("status"), F.count("*").alias("n"))


@query("""WITH q AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey % 500 END AS who,
CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE substr(o_orderpriority, 1, 1) END AS what FROM orders)
SELECT o_orderkey, o_orderstatus, who, what FROM q a WHERE o_orderstatus <> 'O'
OR NOT EXISTS (SELECT 1 FROM q b WHERE b.o_orderstatus = 'F' AND a.who IS NOT DISTINCT FROM b.who AND a.what IS NOT DISTINCT FROM b.what)""")
def superseded_anti_join(spark, sf):
    who = F.when(c("o_custkey") % 7 != 0, c("o_custkey") % 500)
    what = F.when(c("o_orderkey") % 5 != 0, F.substring("o_orderpriority", 1, 1))
    q = Tables(spark, sf).orders.select("o_orderkey", "o_orderstatus", who.alias("who"), what.alias("what"))
    return relational.without_superseded(q, ["who", "what"], c("o_orderstatus") == "O", c("o_orderstatus") == "F")


@query("""WITH pos AS (SELECT o_orderkey AS position_id, o_custkey * 7 + 1000 AS item FROM orders),
off AS (SELECT CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_orderkey END AS position_id, l_suppkey * 1000 + l_partkey % 1000 AS item, l_partkey, l_extendedprice FROM lineitem),
f AS (SELECT pos.position_id, pos.item, l_partkey, l_extendedprice, 'position_id' AS matched_by FROM pos JOIN off USING (position_id)),
s AS (SELECT pos.position_id, pos.item, l_partkey, l_extendedprice, 'item' AS matched_by FROM pos JOIN off ON pos.item = off.item
WHERE pos.position_id NOT IN (SELECT position_id FROM off WHERE position_id IS NOT NULL))
SELECT * FROM f UNION ALL SELECT * FROM s""")
def offers_two_key_fallback(spark, sf):
    t = Tables(spark, sf)
    pos = t.orders.select(c("o_orderkey").alias("position_id"), (c("o_custkey") * 7 + 1000).alias("item"))
    found = t.lineitem.select(
        F.when(c("l_linenumber") % 3 != 0, c("l_orderkey")).alias("position_id"), (c("l_suppkey") * 1000 + c("l_partkey") % 1000).alias("item"), "l_partkey", "l_extendedprice"
    )
    return relational.two_key_fallback(pos, found, "position_id", "item")


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS newest FROM events WHERE event_type <> 'view' GROUP BY 1""")
def newest_text_per_key(spark, sf):
    ev = Tables(spark, sf).events.withColumn("event_type", F.when(c("event_type") != "view", c("event_type")))
    return relational.newest_value(ev, "user_id", "event_type", ["ts", "event_id"], "newest")


@query("""WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem),
r AS (SELECT l.*, p_brand, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS rank FROM l JOIN part ON l_partkey = p_partkey),
lead_ AS (SELECT l_orderkey, min(l_linenumber) AS lead_part, arg_min(p_brand, l_linenumber) AS lead_maker FROM r WHERE rank = 1 GROUP BY 1),
f AS (SELECT r.*, lead_maker, p_brand = lead_maker AS same_maker FROM r JOIN lead_ USING (l_orderkey))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rank, same_maker,
row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY same_maker DESC, rank) AS new_rank FROM f""")
def manufacturer_consistency(spark, sf):
    t = Tables(spark, sf)
    hits = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    order = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey")
    hits = hits.join(t.part.select("p_partkey", "p_brand"), c("l_partkey") == c("p_partkey")).withColumn("rank", F.row_number().over(order))
    return ranking.manufacturer_first(hits, "l_orderkey", "l_linenumber", "rank", "p_brand").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "rank", "same_maker", "new_rank"
    )


# -- the scored match ------------------------------------------------------------

_TYPES = ("ECONOMY", "SMALL", "MEDIUM", "PROMO", "STANDARD", "LARGE")
_MATCH_SQL = """pos AS (SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'SMALL' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'PROMO' WHEN 4 THEN 'STANDARD' ELSE 'LARGE' END AS category,
CAST(s_suppkey % 50 + 1 AS INT) AS dn, 'Brand#' || CAST(s_suppkey % 25 + 1 AS VARCHAR) AS brand, s_acctbal AS budget FROM supplier),
terms AS (SELECT s_suppkey, p_partkey, p_name, p_brand, p_size, p_retailprice, CAST(25 AS DOUBLE) AS category_points,
CAST(CASE WHEN p_size = dn THEN 25.0 WHEN abs(p_size - dn) = 1 THEN 22.0 WHEN abs(p_size - dn) <= 5 THEN 16.0 ELSE -15.0 END AS DOUBLE) AS size_points,
CAST(CASE WHEN p_brand = brand THEN 15.0 ELSE 0.0 END AS DOUBLE) AS brand_points, CAST(CASE WHEN p_retailprice <= budget THEN 4.0 ELSE -3.0 END AS DOUBLE) AS price_points
FROM pos JOIN part ON p_type = category WHERE abs(p_size - dn) <= 20),
scored AS (SELECT *, category_points + size_points + brand_points + price_points AS score FROM terms),
good AS (SELECT * FROM scored WHERE score >= 42),
fam AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey, p_name, p_brand ORDER BY score DESC, p_partkey) AS nf,
count(*) OVER (PARTITION BY s_suppkey, p_name, p_brand) AS members FROM good),
top AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY score DESC, p_partkey) AS rank FROM fam WHERE nf = 1)"""


def match_terms() -> dict[str, Column]:
    gap = F.abs(c("p_size") - c("dn"))
    return {
        "category": F.lit(25.0),
        "size": txt.first_of((gap == 0, F.lit(25.0)), (gap == 1, F.lit(22.0)), (gap <= 5, F.lit(16.0)), otherwise=F.lit(-15.0)),
        "brand": F.when(c("p_brand") == c("brand"), 15.0).otherwise(0.0),
        "price": F.when(c("p_retailprice") <= c("budget"), 4.0).otherwise(-3.0),
    }


def match_positions(t: Tables) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in _TYPES])
    return t.supplier.select(
        "s_suppkey", F.get(kinds, (c("s_suppkey") % 6).cast("int")).alias("category"), (c("s_suppkey") % 50 + 1).cast("int").alias("dn"),
        F.concat(F.lit("Brand#"), (c("s_suppkey") % 25 + 1).cast("string")).alias("brand"), c("s_acctbal").alias("budget"),
    )


#: Sizes from a position's that are compared; the least score; partitions of the pairs, which are many more than the rows;
#: shares of a category's positions near one size.
NEAR, LEAST_SCORE, PAIR_PARTS, SHARES = 20, 42, 256, 4


def sized(pos: DataFrame) -> DataFrame:
    """Positions once for every size near theirs."""
    return pos.withColumn("near_size", F.explode(F.sequence(c("dn") - NEAR, c("dn") + NEAR)))


def near_parts(pos: DataFrame, parts: DataFrame) -> DataFrame:
    """Positions meet only the products of their category and of sizes near theirs, in an equi-join."""
    return sized(pos).repartition(PAIR_PARTS, "category", "near_size").join(parts, (c("category") == c("p_type")) & (c("near_size") == c("p_size"))).drop("near_size")


def with_points(pairs: DataFrame, **known: Column) -> DataFrame:
    points = match_terms() | known
    return pairs.withColumns({f"{n}_points": p for n, p in points.items()}).withColumn("score", sum((c(f"{n}_points") for n in points), F.lit(0.0)))


def scored_pairs(t: Tables) -> DataFrame:
    """All pairs of near sizes with score and confidence.

    What a pair earns depends on its size, on whether the brand is the position's and on whether the
    price is within the budget: four outcomes for a position and a size, computed before the
    products come.  They are built into hash tables: a sorted join would go through a size's
    products on disk for each position, once they are more than it buffers."""
    pos = sized(match_positions(t)).withColumns({"p_size": c("near_size"), "share": F.pmod(F.xxhash64("s_suppkey"), F.lit(SHARES)).cast("int")})
    kinds = [(brand, price) for brand in (15.0, 0.0) for price in (4.0, -3.0)]
    for i, (brand, price) in enumerate(kinds):
        pos = with_points(pos, brand=F.lit(brand), price=F.lit(price))
        points = {n: c(f"{n}_points") for n in ("size", "brand")}
        label = ranking.confidence(c("score"), points, {n: F.lit(True) for n in points})
        pos = pos.withColumns({f"score_{i}": c("score"), f"confidence_{i}": label})
    pos = pos.select("s_suppkey", "category", "near_size", "share", "brand", "budget", *[f"{n}_{i}" for i in range(len(kinds)) for n in ("score", "confidence")])
    goods = t.part.select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("part_share"))
    same = (c("category") == c("p_type")) & (c("near_size") == c("p_size")) & (c("share") == c("part_share"))
    pairs = pos.repartition(PAIR_PARTS, "category", "near_size", "share").join(goods.hint("shuffle_hash"), same)
    within = c("p_retailprice") <= c("budget")
    outcome = lambda n: F.when(c("p_brand") == c("brand"), F.when(within, c(f"{n}_0")).otherwise(c(f"{n}_1"))).otherwise(F.when(within, c(f"{n}_2")).otherwise(c(f"{n}_3")))
    return pairs.select("s_suppkey", "p_partkey", outcome("score").alias("score"), outcome("confidence").alias("confidence"))


def undominated(rows: DataFrame, cell: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The rows of each cell before which, in the order, fewer than k layers of rows have a smaller
    p_partkey; equal ones go too."""
    before = Window.partitionBy(*cell).orderBy(*order, "p_partkey").rowsBetween(Window.unboundedPreceding, -1)
    kept = F.lit(False)
    for i in range(k):
        left = F.when(~kept, c("p_partkey"))
        rows = rows.withColumn(f"layer_{i}", kept | F.coalesce(left < F.min(left).over(before), ~kept))
        kept = c(f"layer_{i}")
    return rows.where(kept).drop(*[f"layer_{i}" for i in range(k)])


def top_matches(t: Tables, k: int = 3) -> DataFrame:
    """The k best families of each position, without the pairs of all positions and products.

    Of a pair's points only the price's depend on more than the position's profile (category, dn,
    brand), and in one direction: what one product of a price can win, a cheaper one (or, over the
    budget, a dearer one) can.  So of a family's products of one size a product counts only if no
    cheaper (dearer) one has a smaller key, and of a profile's products of equal points only those
    that fewer than k such products of other families bar.  They alone meet the positions."""
    pos, parts = match_positions(t), t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    profile, family = ["category", "dn", "brand"], ["p_name", "p_brand"]
    profiles = pos.select(*profile).distinct()
    within = c("p_retailprice") <= c("budget")
    sides = []
    for is_within, order, price in ((True, c("p_retailprice"), 4.0), (False, c("p_retailprice").desc_nulls_first(), -3.0)):
        goods = parts.where("p_retailprice is not null") if is_within else parts
        some = materialised(undominated(goods, ["p_type", "p_size", *family], [order]))
        met = with_points(near_parts(profiles, some), price=F.lit(price)).where(c("score") >= LEAST_SCORE)
        met = undominated(met, [*profile, "score", *family], [order])
        sides.append(undominated(met, [*profile, "score"], [order], k).withColumn("is_within", F.lit(is_within)))
    able = materialised(sides[0].unionByName(sides[1]))
    found = pos.join(able, profile).where(c("is_within") == F.coalesce(within, F.lit(False)))
    best = [c("score").desc(), c("p_partkey")]
    top = materialised(ranking.top_k(ranking.best_per_key(found, ["s_suppkey", *family], best), ["s_suppkey"], best, k))
    # the members of the winners' families, equal prices at once
    counts = parts.groupBy("p_type", *family, "p_size", "p_retailprice").agg(F.count("*").alias("n"))
    wanted = top.select("s_suppkey", c("p_name").alias("w_name"), c("p_brand").alias("w_brand"), "rank").join(pos, "s_suppkey")
    same = (c("category") == c("p_type")) & c("w_name").eqNullSafe(c("p_name")) & c("w_brand").eqNullSafe(c("p_brand")) & (F.abs(c("p_size") - c("dn")) <= NEAR)
    good = with_points(wanted.join(counts, same)).where(c("score") >= LEAST_SCORE)
    return top.join(good.groupBy("s_suppkey", "rank").agg(F.sum("n").alias("members")), ["s_suppkey", "rank"])


@query(f"WITH {_MATCH_SQL} SELECT s_suppkey, rank, p_partkey, p_name, score, members FROM top WHERE rank <= 3")
def scored_match_topk(spark, sf):
    return top_matches(Tables(spark, sf)).select("s_suppkey", "rank", "p_partkey", "p_name", "score", "members")


@query(f"""WITH {_MATCH_SQL}, b AS (SELECT s_suppkey, rank, 'category' AS component, category_points AS points FROM top WHERE rank <= 3
UNION ALL SELECT s_suppkey, rank, 'size', size_points FROM top WHERE rank <= 3 UNION ALL SELECT s_suppkey, rank, 'brand', brand_points FROM top WHERE rank <= 3 AND brand_points <> 0
UNION ALL SELECT s_suppkey, rank, 'price', price_points FROM top WHERE rank <= 3) SELECT * FROM b""")
def breakdown_arrays(spark, sf):
    entries = F.array(*[F.struct(F.lit(n).alias("component"), c(f"{n}_points").alias("points")) for n in match_terms()])
    listed = F.filter(entries, lambda e: (e["component"] != "brand") | (e["points"] != 0))
    return top_matches(Tables(spark, sf)).select("s_suppkey", "rank", F.explode(listed).alias("e")).select("s_suppkey", "rank", "e.component", "e.points")


@query(f"""WITH {_MATCH_SQL} SELECT s_suppkey, p_partkey, score, CASE WHEN size_points < 0 OR brand_points < 0 OR score < 45 THEN 'low'
WHEN size_points > 0 AND brand_points > 0 AND score > 55 THEN 'high' WHEN NOT (size_points > 0 AND brand_points > 0) THEN 'low' WHEN score > 60 THEN 'high' ELSE 'medium' END AS confidence FROM scored""")
def confidence_label(spark, sf):
    return scored_pairs(Tables(spark, sf))


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_retailprice DESC, p_partkey) AS n, count(*) OVER (PARTITION BY p_name, p_brand) AS m FROM part),
s AS (SELECT p_name, p_brand, string_agg(x, ', ' ORDER BY x) AS xs FROM (SELECT DISTINCT p_name, p_brand, CAST(p_size AS VARCHAR) || ' m' AS x FROM part) GROUP BY 1, 2)
SELECT p_partkey, p_name, p_brand, CASE WHEN m > 1 THEN 'Auch in Längen: ' || xs END AS family_hint FROM f JOIN s USING (p_name, p_brand) WHERE n = 1""")
def family_collapse_variants(spark, sf):
    part = Tables(spark, sf).part.withColumn("mm", c("p_size") * 1000)
    order = [c("p_retailprice").desc(), c("p_partkey")]
    return ranking.collapsed_families(part, [], ["p_name", "p_brand"], order, "mm").select("p_partkey", "p_name", "p_brand", "family_hint")


@query("""WITH n AS (SELECT user_id, sha256(event_type) AS description_hash, count(*) AS override_count FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY override_count DESC, description_hash) AS nth FROM n) SELECT * FROM r WHERE nth <= 3""")
def override_counts_top3(spark, sf):
    counts = Tables(spark, sf).events.groupBy("user_id", txt.description_hash(c("event_type")).alias("description_hash")).agg(F.count("*").alias("override_count"))
    return ranking.top_k(counts, ["user_id"], [c("override_count").desc(), c("description_hash")], 3, "nth")


# -- texts ------------------------------------------------------------------------

_OVERLAP_SQL = r"""dt AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{6,}')) AS token FROM documents),
bt AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{6,}')) AS token FROM benchmark),
o AS (SELECT doc_id, item_id, count(*) AS overlap FROM dt JOIN bt USING (token) GROUP BY 1, 2)"""


def overlaps(t: Tables) -> DataFrame:
    words = lambda: F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{6,}"), F.lit(0))).alias("tokens")
    docs, items = t.documents.select("doc_id", words()), t.benchmark.select("item_id", words().alias("item_tokens"))
    return relational.token_overlap(docs, "doc_id", "tokens", items, "item_id", "item_tokens")


@query(f"WITH {_OVERLAP_SQL} SELECT doc_id, item_id, overlap FROM o WHERE overlap >= 2")
def token_overlap_match(spark, sf):
    return overlaps(Tables(spark, sf)).where("overlap >= 2")


@query(f"""WITH {_OVERLAP_SQL}, r AS (SELECT *, row_number() OVER w AS n, lead(overlap) OVER w AS second FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY overlap DESC, item_id))
SELECT doc_id, item_id, overlap FROM r WHERE n = 1 AND overlap >= 2 AND (second IS NULL OR overlap - second >= 2)""")
def best_with_margin(spark, sf):
    return relational.margin_winners(overlaps(Tables(spark, sf)), "doc_id", "item_id", "overlap", least=2, margin=2)


_RELEVANCE = (("license", "the"), ("and", "des", "los"), ("idiot", "%%%"))


@query("""SELECT doc_id, greatest(0, least(100, (CASE WHEN contains(lower(text), 'license') THEN 15 ELSE 0 END) + (CASE WHEN contains(lower(text), 'the') THEN 15 ELSE 0 END)
+ (CASE WHEN contains(lower(text), 'and') THEN 8 ELSE 0 END) + (CASE WHEN contains(lower(text), 'des') THEN 8 ELSE 0 END) + (CASE WHEN contains(lower(text), 'los') THEN 8 ELSE 0 END)
- (CASE WHEN contains(lower(text), 'idiot') THEN 10 ELSE 0 END) - (CASE WHEN contains(lower(text), '%%%') THEN 10 ELSE 0 END))) AS relevance FROM documents""")
def keyword_relevance_clamp(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", tenders.relevance(F.lower("text"), *_RELEVANCE).alias("relevance"))


_GEO_SQL = """g AS (SELECT c_custkey, n_name, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 50.0 + n_nationkey * 0.07 + (c_custkey % 10) * 0.01 END AS lat,
CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 6.5 + n_nationkey * 0.05 END AS lng FROM customer JOIN nation ON c_nationkey = n_nationkey),
k AS (SELECT *, pow(sin(radians(lat - 50.63) / 2), 2) + cos(radians(50.63)) * cos(radians(lat)) * pow(sin(radians(lng - 6.95) / 2), 2) AS a FROM g)"""


@query(f"""WITH {_GEO_SQL} SELECT c_custkey, round(12742.0 * atan2(sqrt(a), sqrt(1 - a)), 3) AS km,
CASE WHEN lat IS NOT NULL THEN 12742.0 * atan2(sqrt(a), sqrt(1 - a)) <= 50 ELSE lower(n_name) IN ('nation_3', 'nation_7') END AS in_region FROM k""")
def geo_radius(spark, sf):
    t = Tables(spark, sf)
    known = c("c_custkey") % 9 != 0
    df = t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey")).withColumns({
        "lat": F.when(known, F.lit(50.0) + c("n_nationkey") * 0.07 + (c("c_custkey") % 10) * 0.01), "lng": F.when(known, F.lit(6.5) + c("n_nationkey") * 0.05),
    })
    km = num.haversine_km(F.lit(50.63), F.lit(6.95), c("lat"), c("lng"))
    near = tenders.in_region(c("lat"), c("lng"), c("n_name"), (50.63, 6.95), 50.0, ("nation_3", "nation_7"))
    return df.select("c_custkey", F.round(km, 3).alias("km"), near.alias("in_region"))


@query(r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'),
'&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&'), '\s*\n\s*', chr(10), 'g'))) AS clean_md5 FROM pages""")
def html_clean(spark, sf):
    return Tables(spark, sf).pages.select("page_id", F.md5(txt.strip_html(c("html")).cast("binary")).alias("clean_md5"))


_AMOUNT_SQL = """CASE l_linenumber % 3 WHEN 0 THEN replace(printf('%.2f', l_extendedprice), '.', ',') WHEN 1 THEN printf('%.2f', l_extendedprice) || ' EUR'
ELSE replace(replace(replace(format('{:,.2f}', l_extendedprice), ',', '#'), '.', ','), '#', '.') || ' €' END"""


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, {_AMOUNT_SQL} AS amount_text, round(l_extendedprice, 2) AS amount FROM lineitem")
def number_parse_locale(spark, sf):
    plain = F.format_string("%.2f", "l_extendedprice")
    written = F.when(c("l_linenumber") % 3 == 0, F.replace(plain, F.lit("."), F.lit(","))).when(c("l_linenumber") % 3 == 1, F.concat(plain, F.lit(" EUR"))).otherwise(
        F.concat(num.money_text(c("l_extendedprice")), F.lit(" €"))
    )
    df = Tables(spark, sf).lineitem.withColumn("amount_text", written)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "amount_text", num.parse_number(c("amount_text")).alias("amount"))


@query("""SELECT p_partkey, p_size * 10 AS main_dn, CASE WHEN p_partkey % 3 = 0 AND p_size >= 2 THEN p_size * 5 END AS branch_dn,
CASE p_size * 10 WHEN 100 THEN 110 WHEN 110 THEN 100 WHEN 150 THEN 160 WHEN 160 THEN 150 WHEN 200 THEN 225 WHEN 250 THEN 280 WHEN 280 THEN 250 WHEN 300 THEN 315 WHEN 400 THEN 450 WHEN 450 THEN 400 END AS stands_for FROM part""")
def dn_pairs(spark, sf):
    from brickline.operators.matching.features import DN_PAIR, dn_equivalent

    written = F.when(c("p_partkey") % 3 == 0, F.format_string("Abzweig DN %d/%d", c("p_size") * 10, c("p_size") * 5)).otherwise(F.format_string("Rohr DN %d", c("p_size") * 10))
    part = Tables(spark, sf).part.withColumn("written", written)
    pick = lambda i: F.regexp_extract("written", DN_PAIR, i).try_cast("int")
    main = F.coalesce(pick(1), F.regexp_extract("written", r"DN (\d+)", 1).try_cast("int"))
    # two digits at least make a diameter
    return part.select("p_partkey", main.alias("main_dn"), pick(2).alias("branch_dn"), dn_equivalent(main).alias("stands_for"))


@query("""SELECT p_partkey, CASE WHEN p_size > 40 THEN 'F900' WHEN p_size > 30 THEN 'D400' WHEN p_size > 20 THEN 'B125' WHEN p_size > 10 THEN 'A15' END AS load_class,
CASE WHEN p_size > 40 THEN 6 WHEN p_size > 30 THEN 4 WHEN p_size > 20 THEN 2 WHEN p_size > 10 THEN 1 END AS load_rank FROM part""")
def rank_max_class(spark, sf):
    from brickline.operators.matching.features import load_rank
    from brickline.operators.matching.vocabulary import LOAD_RANK

    upto = [F.when(c("p_size") > n, F.lit(x)) for n, x in ((10, "A15"), (20, "B125"), (30, "D400"), (40, "F900"))]
    best = catalogue.highest_class(F.concat_ws(" / ", *upto), LOAD_RANK)
    return Tables(spark, sf).part.select("p_partkey", best.alias("load_class"), load_rank(best).alias("load_rank"))


@query("""WITH k AS (SELECT DISTINCT l_linenumber AS a, CAST(l_partkey % 120 AS INT) AS b FROM lineitem)
SELECT a || '.' || b AS item, row_number() OVER (ORDER BY a, b) AS nth FROM k""")
def oz_sort_normalise(spark, sf):
    raw = F.format_string(" %02d. %04d", c("l_linenumber"), (c("l_partkey") % 120).cast("int"))
    items = Tables(spark, sf).lineitem.select(txt.item_number(raw).alias("item")).distinct()
    return relational.numbered_in_order(items, [txt.item_sort_key(c("item"))])


_LINES_SQL = """ln AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)"""


@query(rf"""WITH {_LINES_SQL}, m AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^(The|In|Of|Les|Der|Die|De) ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM ln)
SELECT doc_id, CAST(block AS BIGINT) AS block, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY line_no)) AS text_md5 FROM m WHERE block > 0 GROUP BY 1, 2""")
def block_split(spark, sf):
    numbered = lines.numbered(Tables(spark, sf).documents, "doc_id", "text")
    marked = lines.blocks(numbered, "doc_id", c("line").rlike(r"^(The|In|Of|Les|Der|Die|De) "))
    return lines.block_texts(marked, "doc_id").select("doc_id", "block", "n_lines", F.md5(c("text").cast("binary")).alias("text_md5"))


@query(rf"""WITH {_LINES_SQL}, m AS (SELECT *, min(CASE WHEN length(line) > 300 THEN line_no END) OVER (PARTITION BY doc_id) AS cut FROM ln)
SELECT doc_id, line_no, length(line) AS n FROM m WHERE cut IS NULL OR line_no <= cut""")
def cut_at_first(spark, sf):
    numbered = lines.numbered(Tables(spark, sf).documents, "doc_id", "text")
    return lines.cut_after_first(numbered, ["doc_id"], F.length("line") > 300).select("doc_id", "line_no", F.length("line").alias("n"))


@query(rf"""WITH {_LINES_SQL}, b AS (SELECT *, trim(line) AS clean, lag(trim(line)) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM ln),
f AS (SELECT *, sum(CASE WHEN before IS NULL OR before = '' OR clean = '' OR regexp_matches(before, '[.:;!?]$') OR regexp_matches(line, '^Licensed') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS paragraph FROM b)
SELECT doc_id, CAST(paragraph AS BIGINT) AS paragraph, md5(string_agg(clean, ' ' ORDER BY line_no)) AS text_md5 FROM f WHERE clean <> '' GROUP BY 1, 2""")
def wrapped_join(spark, sf):
    numbered = lines.numbered(Tables(spark, sf).documents, "doc_id", "text")
    out = lines.joined_paragraphs(numbered, "doc_id", c("line").rlike("^Licensed"))
    return out.select("doc_id", "paragraph", F.md5(c("text").cast("binary")).alias("text_md5"))


@query("""SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN last_value(CASE WHEN role <> 'assistant' THEN length(text) END IGNORE NULLS)
OVER (PARTITION BY conv_id ORDER BY turn, role, length(text) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) ELSE length(text) END AS carried FROM conversations""")
def carry_forward_reference(spark, sf):
    df = Tables(spark, sf).conversations.withColumn("n", F.length("text"))
    ref = c("role") == "assistant"
    own = df.withColumn("value", F.when(~ref, c("n")))
    return lines.carried(own, "conv_id", ["turn", "role", "n"], ref, ["value"]).select("conv_id", "turn", "role", c("carried_value").alias("carried"))


@query("""SELECT text_hash, count(*) AS n, min(doc_id) AS first_id FROM (SELECT sha256(coalesce(text, '')) AS text_hash, doc_id FROM documents) GROUP BY 1""")
def content_hash_duplicates(spark, sf):
    return Tables(spark, sf).documents.groupBy(F.sha2(txt.text_of("text").cast("binary"), 256).alias("text_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("""WITH r AS (SELECT source, lang, doc_id, n_chars, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS n, min(doc_id) OVER (PARTITION BY source, lang) AS first_seen FROM documents)
SELECT source, lang, doc_id, n_chars, first_seen FROM r WHERE n = 1""")
def dedupe_most_complete(spark, sf):
    docs = Tables(spark, sf).documents.select("source", "lang", "doc_id", "n_chars")
    return relational.most_complete(docs, ["source", "lang"], [c("n_chars").desc(), c("doc_id")], [], "doc_id")


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE source END AS source, n_chars FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS n FROM d) SELECT doc_id, source, n_chars FROM r WHERE n = 1 OR source IS NULL""")
def dedupe_first_by_batch(spark, sf):
    docs = Tables(spark, sf).documents.select("doc_id", F.when(c("doc_id") % 11 != 0, c("source")).alias("source"), "n_chars")
    return relational.first_per_key(docs, "source", [c("n_chars"), c("doc_id")])


@query("""SELECT conv_id, arg_min(role, turn * 2 + CASE WHEN role = 'user' THEN 0 ELSE 1 END) AS role, length(arg_max(text, (length(text), -turn * 2 - CASE WHEN role = 'user' THEN 0 ELSE 1 END))) AS n, count(*) AS merged FROM conversations GROUP BY 1""")
def dedupe_richer(spark, sf):
    df = Tables(spark, sf).conversations.withColumn("at", c("turn") * 2 + F.when(c("role") == "user", 0).otherwise(1))
    return relational.richer(df, ["conv_id"], "at", ["role"], "text").select("conv_id", "role", F.length("text").alias("n"), "merged")


@query("""SELECT conv_id, turn, role, CASE WHEN contains(lower(text), 'tbx-inq') OR contains(lower(text), 'tbx-proj') OR contains(lower(text), 'angebot') OR contains(lower(text), 'the') THEN 'offer' WHEN turn <> 0 THEN 'ignored'
WHEN contains(lower(text), 'los') AND NOT (contains(lower(text), 'que') OR contains(lower(text), 'der')) THEN 'ignored' WHEN contains(lower(text), 'que') OR contains(lower(text), 'der') OR contains(lower(text), 'en') THEN 'new_document'
ELSE 'ignored' END AS kind, count(*) AS n FROM conversations GROUP BY ALL""")
def classify_message(spark, sf):
    kind = ingest.classified(F.lit(""), c("text"), c("turn") == 0, ("angebot", "the"), ("que", "der"), ("los",), ("en",))
    return Tables(spark, sf).conversations.groupBy("conv_id", "turn", "role", kind.alias("kind")).agg(F.count("*").alias("n"))


# -- components, JSON, bundles, tallies ---------------------------------------------


@query("""SELECT o_orderkey, l_linenumber AS part_no, l_partkey, coalesce(CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END, o_orderstatus) AS load_class FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def component_explode_inherit(spark, sf):
    t = Tables(spark, sf)
    own = F.when(c("l_returnflag") != "N", c("l_returnflag"))
    parts = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey", own.alias("own"))).alias("parts"))
    whole = t.orders.join(parts, c("o_orderkey") == c("l_orderkey"))
    one = whole.select("o_orderkey", "o_orderstatus", F.explode("parts").alias("p"))
    return one.select("o_orderkey", c("p.l_linenumber").alias("part_no"), c("p.l_partkey").alias("l_partkey"), F.coalesce("p.own", "o_orderstatus").alias("load_class"))


@query("""SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT), -1) AS k, coalesce(json_extract_string(props, '$.none'), 'neu') AS missing FROM events""")
def json_decode_default(spark, sf):
    decoded = F.from_json("props", "k int, none string")
    return Tables(spark, sf).events.withColumn("j", decoded).select("event_id", F.coalesce("j.k", F.lit(-1)).alias("k"), F.coalesce("j.none", F.lit("neu")).alias("missing"))


@query("""SELECT o_custkey, o_orderstatus || '::' || substr(o_orderpriority, 1, 1) AS key, count(*) AS n, min(o_orderkey) AS first_order FROM orders GROUP BY 1, 2""")
def selections_map_explode(spark, sf):
    key = F.concat_ws("::", "o_orderstatus", F.substring("o_orderpriority", 1, 1))
    counted = Tables(spark, sf).orders.groupBy("o_custkey", key.alias("k")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_order"))
    maps = counted.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("n", "first_order").alias("v")))).alias("selections"))
    return maps.select("o_custkey", F.explode("selections").alias("key", "v")).select("o_custkey", "key", "v.n", "v.first_order")


@query("""SELECT l_suppkey, count(*) AS n_items, count(*) FILTER (l_linestatus = 'O') AS n_open, md5(string_agg(CAST(l_orderkey AS VARCHAR) || ':' || l_linenumber || ':' || l_partkey, ',' ORDER BY l_orderkey, l_linenumber, l_partkey)) AS items_md5 FROM lineitem GROUP BY 1""")
def supplier_bundles(spark, sf):
    entries = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey")))
    listed = F.transform(entries, lambda e: F.concat_ws(":", e["l_orderkey"], e["l_linenumber"], e["l_partkey"]))
    return Tables(spark, sf).lineitem.groupBy("l_suppkey").agg(
        F.count("*").alias("n_items"), F.count_if(c("l_linestatus") == "O").alias("n_open"), F.md5(F.array_join(listed, ",").cast("binary")).alias("items_md5")
    )


@query("""SELECT c_mktsegment, count(*) AS orders, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'P') AS pending,
greatest(0, count(*) - count(*) FILTER (o_orderstatus = 'F') - count(*) FILTER (o_orderstatus = 'P')) AS open,
round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 1) AS progress, count(DISTINCT o_custkey) AS customers FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def dashboard_tallies(spark, sf):
    t = Tables(spark, sf)
    df = t.orders.join(t.customer.select("c_custkey", "c_mktsegment"), c("o_custkey") == c("c_custkey"))
    n, done, pending = F.count("*"), F.count_if(c("o_orderstatus") == "F"), F.count_if(c("o_orderstatus") == "P")
    return df.groupBy("c_mktsegment").agg(
        n.alias("orders"), done.alias("done"), pending.alias("pending"), F.greatest(F.lit(0), n - done - pending).alias("open"),
        F.round(F.when(n > 0, done * 100.0 / n).otherwise(0.0), 1).alias("progress"), F.count_distinct("o_custkey").alias("customers"),
    )


# -- catalogue jobs -------------------------------------------------------------------


@query("""SELECT 'p_name' AS field, count(p_name) AS filled, count(*) - count(p_name) AS missing FROM part
UNION ALL SELECT 'brand', count(*) FILTER (p_partkey % 6 <> 0), count(*) FILTER (p_partkey % 6 = 0) FROM part
UNION ALL SELECT 'size', count(*) FILTER (p_size > 9), count(*) FILTER (p_size <= 9) FROM part""")
def catalog_audit(spark, sf):
    part = Tables(spark, sf).part.withColumns({"brand": F.when(c("p_partkey") % 6 != 0, c("p_brand")), "size": F.when(c("p_size") > 9, c("p_size"))})
    return catalogue.coverage(part, ["p_name", "brand", "size"])


@query("""SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN split_part(p_name, ' ', 1) ELSE p_brand END AS brand,
CASE WHEN p_partkey % 4 = 0 THEN CASE WHEN contains(p_name, 'ring') THEN 'Dichtung' WHEN contains(p_name, 'bolt') THEN 'Zubehör' END ELSE p_type END AS kind,
(CASE WHEN p_partkey % 6 = 0 THEN 1 ELSE 0 END) + (CASE WHEN p_partkey % 4 = 0 AND (contains(p_name, 'ring') OR contains(p_name, 'bolt')) THEN 1 ELSE 0 END) AS changed FROM part""")
def catalog_enrich(spark, sf):
    part = Tables(spark, sf).part.withColumns({"brand": F.when(c("p_partkey") % 6 != 0, c("p_brand")).otherwise(" "), "kind": F.when(c("p_partkey") % 4 != 0, c("p_type"))})
    guess = txt.first_of((F.contains(c("p_name"), F.lit("ring")), "Dichtung"), (F.contains(c("p_name"), F.lit("bolt")), "Zubehör"))
    return catalogue.filled_if_empty(part, {"brand": F.split("p_name", " ")[0], "kind": guess}).select("p_partkey", "brand", "kind", "changed")


@query("""SELECT CASE p_type WHEN 'ECONOMY' THEN 'Basis' WHEN 'PROMO' THEN 'Aktion' ELSE p_type END AS p_type, CASE WHEN p_size < 10 THEN 'text' ELSE 'field' END AS reason, count(*) AS n FROM part GROUP BY 1, 2""")
def recode_backfill(spark, sf):
    part = catalogue.recoded(Tables(spark, sf).part, "p_type", {"ECONOMY": "Basis", "PROMO": "Aktion"})
    return part.groupBy("p_type", F.when(c("p_size") < 10, "text").otherwise("field").alias("reason")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, p_name, 'old' AS origin FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, p_name, 'new' FROM part WHERE p_partkey % 3 = 0""")
def import_anti_append(spark, sf):
    part = Tables(spark, sf).part.select("p_partkey", "p_name")
    old = part.where(c("p_partkey") % 3 != 0).withColumn("origin", F.lit("old"))
    return relational.append_new(old, part.withColumn("origin", F.lit("new")), "p_partkey")


@query("""SELECT p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 <> 0 THEN p_retailprice + 1 WHEN p_partkey % 2 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS price FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 <> 0""")
def upsert_merge(spark, sf):
    part = Tables(spark, sf).part
    old = part.where(c("p_partkey") % 3 != 0).select("p_partkey", "p_name", c("p_retailprice").alias("price"))
    twice = part.where(c("p_partkey") % 2 == 0).select("p_partkey", "p_name", F.explode(F.array(F.lit(0), F.lit(1))).alias("v"), "p_retailprice")
    batch = twice.select("p_partkey", "p_name", (c("p_retailprice") + c("v")).alias("price"), "v")
    return relational.upsert(old, batch, "p_partkey", ["price"], [c("v").desc()])


@query("""SELECT 'orders' AS name, count(*) AS n, 0 AS unlinked FROM orders WHERE o_custkey % 10 <> 0
UNION ALL SELECT 'lineitem', count(*), 0 FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0)
UNION ALL SELECT 'events', count(*), count(*) FILTER (user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0)) FROM events""")
def cascade_delete(spark, sf):
    t = Tables(spark, sf)
    gone = t.customer.where(c("c_custkey") % 10 == 0)
    orders = t.orders.join(gone.select("c_custkey"), c("o_custkey") == c("c_custkey"), "left_semi")
    left = relational.cascaded(gone, "c_custkey", {"orders": (t.orders, "o_custkey")}, {"events": (t.events, "user_id")})
    left |= relational.cascaded(orders, "o_orderkey", {"lineitem": (t.lineitem, "l_orderkey")}, {})
    parts = [df.agg(F.lit(n).alias("name"), F.count("*").alias("n"), (F.count_if(c("user_id").isNull()) if n == "events" else F.lit(0)).alias("unlinked")) for n, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT e.event_id, c_custkey AS user_id FROM events e LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0) ON user_id = c_custkey""")
def fk_repair(spark, sf):
    t = Tables(spark, sf)
    return relational.repaired_keys(t.events, "user_id", t.customer.where(c("c_custkey") % 4 != 0), "c_custkey", nullable=True).select("event_id", "user_id")


@query("""SELECT 'P-' || strftime(o_orderdate, '%y%m') AS prefix, 'P-' || strftime(o_orderdate, '%y%m') || '-' || CASE WHEN max(o_orderkey % 1200) + 1 < 1000 THEN lpad(CAST(max(o_orderkey % 1200) + 1 AS VARCHAR), 3, '0') ELSE CAST(max(o_orderkey % 1200) + 1 AS VARCHAR) END AS next_number FROM orders GROUP BY 1""")
def next_number(spark, sf):
    prefix = F.concat(F.lit("P-"), F.date_format("o_orderdate", "yyMM"))
    numbered = Tables(spark, sf).orders.withColumns({"prefix_": prefix, "nr": F.concat_ws("-", prefix, F.format_string("%03d", c("o_orderkey") % 1200))})
    return relational.next_numbers(numbered, c("prefix_"), "nr")


@query("""WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 5 <> 0),
b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 3 <> 0),
j AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'only_a' WHEN a.o_orderkey IS NULL THEN 'only_b' ELSE 'both' END AS s,
a.o_orderstatus IS DISTINCT FROM b.o_orderstatus AS d1, a.o_totalprice IS DISTINCT FROM b.o_totalprice AS d2 FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)
SELECT o_orderkey, CASE WHEN s = 'both' THEN 'changed' ELSE s END AS state, CASE WHEN s <> 'both' THEN '' WHEN d1 AND d2 THEN 'o_orderstatus,o_totalprice' WHEN d1 THEN 'o_orderstatus' ELSE 'o_totalprice' END AS fields FROM j WHERE s <> 'both' OR d1 OR d2""")
def result_diff_full_outer(spark, sf):
    orders = Tables(spark, sf).orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    b = orders.where(c("o_orderkey") % 3 != 0).withColumns({
        "o_orderstatus": F.when(c("o_orderkey") % 7 == 0, "X").otherwise(c("o_orderstatus")), "o_totalprice": F.when(c("o_orderkey") % 11 != 0, c("o_totalprice")),
    })
    return relational.diff(orders.where(c("o_orderkey") % 5 != 0), b, "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query("""WITH n AS (SELECT page_id, 1 + length(html) // 500 AS total FROM pages), s AS (SELECT page_id, total, unnest(range(1, greatest(total - 1, 1) + 1, 7)) AS f FROM n)
SELECT page_id, f AS first, least(f + 7, total) AS last FROM s""")
def page_batches_overlap(spark, sf):
    total = (F.lit(1) + F.floor(F.length("html") / 500)).cast("int")
    pages = Tables(spark, sf).pages.select("page_id", F.explode(relational.batches_with_overlap(total, 8, 1)).alias("b"))
    return pages.select("page_id", c("b.first").cast("long").alias("first"), c("b.last").cast("long").alias("last"))


@query("""SELECT l_orderkey AS order_id, count(*) AS n, count(*) FILTER (l_quantity > 40) AS large FROM lineitem GROUP BY 1
HAVING count(*) > 6""")
def export_gate_violations(spark, sf):
    grouped = Tables(spark, sf).lineitem.groupBy(c("l_orderkey").alias("order_id")).agg(F.count("*").alias("n"), F.count_if(c("l_quantity") > 40).alias("large"))
    return grouped.where("n > 6")


# -- streams and sequential rules (no SQL form) ------------------------------------------


@query("""SELECT user_id, event_type, md5(props) AS props_md5, count(*) AS n FROM events GROUP BY 1, 2, 3""")
def ingest_stream_dedupe(spark, sf):
    """The events as a drained file stream, each message key once; the count of the
    messages behind a key comes from the table."""
    import uuid

    events = Tables(spark, sf).events
    at = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    key = F.sha2(F.concat_ws("|", "user_id", "event_type", "props").cast("binary"), 256)
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parquet*")
    keyed = stream.withColumns({"message_key": key, "at": c("ts").cast("timestamp")})
    ingest.drained(ingest.once_per_key(keyed, "message_key", "at", "3650 days"), f"{at}/table", f"{at}/checkpoint")
    seen = spark.read.parquet(f"{at}/table").select("user_id", "event_type", F.md5(c("props").cast("binary")).alias("props_md5"))
    counts = events.groupBy("user_id", "event_type", F.md5(c("props").cast("binary")).alias("props_md5")).agg(F.count("*").alias("n"))
    return seen.join(counts, ["user_id", "event_type", "props_md5"])


_MAILS = """tok AS (SELECT p_partkey, list_distinct(string_split(concat_ws(' ', p_name, lower(p_type), lower(p_brand)), ' ')) AS tokens FROM part),
r AS (SELECT DISTINCT l_orderkey AS mail_id, l_returnflag = 'R' AS request, l_linenumber * 1000003 + l_partkey AS id, CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_suppkey % 10 AS VARCHAR) END AS number, tokens FROM lineitem JOIN tok ON l_partkey = p_partkey),
q AS (SELECT mail_id, list({'id': id, 'number': number, 'tokens': tokens} ORDER BY id) FILTER (request) AS reqs FROM r GROUP BY 1),
l AS (SELECT *, row_number() OVER (PARTITION BY mail_id ORDER BY id) AS n FROM r WHERE NOT request)"""


@query(f"""WITH RECURSIVE {_MAILS}, st AS (SELECT mail_id, CAST(0 AS BIGINT) AS n, coalesce(reqs, []) AS free, CAST(NULL AS BIGINT) AS line_id, CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS VARCHAR) AS matched_by FROM q
UNION ALL SELECT mail_id, n, list_filter(free, lambda x: x.id IS DISTINCT FROM chosen), id, chosen, CASE WHEN named IS NOT NULL THEN 'number' WHEN best IS NOT NULL THEN 'tokens' WHEN sole IS NOT NULL THEN 'sole' END
FROM (SELECT *, coalesce(named, best, sole) AS chosen FROM (SELECT st.mail_id, l.n, st.free, l.id, CASE WHEN len(list_filter(st.free, lambda x: x.id = w.id)) > 0 THEN w.id END AS named,
  CASE WHEN len(st.free) = 1 THEN st.free[1].id END AS sole, list_sort(list_filter(list_transform(st.free, lambda x: {{'less': -len(list_intersect(x.tokens, l.tokens)), 'id': x.id}}), lambda y: y.less <= -2))[1].id AS best
  FROM st JOIN l ON l.mail_id = st.mail_id AND l.n = st.n + 1 LEFT JOIN (SELECT mail_id, number, max(id) AS id FROM r WHERE request AND number IS NOT NULL GROUP BY 1, 2) w ON w.mail_id = l.mail_id AND w.number = l.number)))
SELECT mail_id, line_id, request_id, matched_by FROM st WHERE n > 0""")
def greedy_assignment(spark, sf):
    """Returned lines are the open requests, the others what a mail offers."""
    t = Tables(spark, sf)
    parts = t.part.select("p_partkey", F.array_distinct(F.split(F.concat_ws(" ", "p_name", F.lower("p_type"), F.lower("p_brand")), " ")).alias("tokens"))
    rows = t.lineitem.join(parts, c("l_partkey") == c("p_partkey")).select(
        c("l_orderkey").alias("mail_id"), F.when(c("l_returnflag") == "R", "request").otherwise("line").alias("side"), (c("l_linenumber") * 1000003 + c("l_partkey")).cast("long").alias("id"),
        F.when(c("l_linenumber") % 3 == 0, (c("l_suppkey") % 10).cast("string")).alias("number"), "tokens",
    ).distinct()
    return reconcile.greedy_assignment(rows)


@query("""WITH RECURSIVE r AS (SELECT p_partkey AS id, p_partkey % 20 AS g, row_number() OVER (PARTITION BY p_partkey % 20 ORDER BY p_partkey) AS n, CASE WHEN p_partkey % 13 <> 0 THEN p_partkey * 7 % 41 END AS a, p_partkey * p_partkey % 53 AS b, p_size % 9 AS c FROM part),
st AS (SELECT DISTINCT g, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, false AS ok, [CAST(3 AS BIGINT)] AS seen_a, CAST([] AS VARCHAR[]) AS seen_b FROM r
UNION ALL SELECT g, n, id, ok, CASE WHEN ok AND a IS NOT NULL THEN list_append(seen_a, a) ELSE seen_a END, CASE WHEN ok THEN list_append(seen_b, b || '/' || c) ELSE seen_b END
FROM (SELECT r.*, st.seen_a, st.seen_b, NOT coalesce(list_contains(st.seen_a, a), false) AND NOT list_contains(st.seen_b, b || '/' || c) AS ok FROM st JOIN r ON r.g = st.g AND r.n = st.n + 1))
SELECT id FROM st WHERE ok""")
def insert_or_ignore(spark, sf):
    """Two unique keys, (g, a) and (g, b, c); an existing row of each g has a = 3."""
    rows = Tables(spark, sf).part.selectExpr("p_partkey as id", "p_partkey % 20 as g", "case when p_partkey % 13 <> 0 then p_partkey * 7 % 41 end as a", "p_partkey * p_partkey % 53 as b", "p_size % 9 as c")
    existing = rows.select(c("g").alias("id"), "g", F.lit(3).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("long").alias("c")).distinct()
    kept = relational.insert_or_ignore(existing, rows, "id", [["g", "a"], ["g", "b", "c"]])
    return kept.select("id")


# -- reading free text -----------------------------------------------------------------

#: Phrases for the catalogue's rows in turn, {dn} standing for a diameter, and what is to be read from each.
_PHRASES = (
    ("KG-Rohr", "KG-Rohr DN {dn} SN4 PVC-U, Baulänge 1000 mm, DIN EN 1401-1, Steckmuffe"),
    ("Rohrbogen", "Bogen DN {dn} 45 Grad liefern"),
    ("Abbruch", "Abbruch und Entsorgung von Pflaster"),
    ("Pflasterrinne", "Pflasterrinne herstellen"),
    ("Reduzierstück", "Reduzierstück DN 200/150 PP"),
    ("Stahlbetonrohr", "Rohr DN {dn} Stahlbeton DIN EN 1916 in der Fahrbahn"),
    ("Schachtabdeckung", "Schachtabdeckung Klasse D400 Gusseisen"),
    ("Revisionsschacht", "Revisionsschacht Beton DN 1.000, Anschluss 150 mm"),
    ("Entwässerungsrinne ACO PowerDrain", "Rinne DN {dn} E600"),
    ("Formteil", "Anschluss an Kanal DN 400, DN {dn}"),
    (None, None),
    ("Druckrohr PE 100", "Rohr PE 100-RC DN {dn}, Länge 6 m, Trinkwasser"),
)
_READ_SQL = """VALUES
(0, 'Kanalrohre', 'KG-Rohre', 'PVC-U', -1, NULL, NULL, 'DIN EN 1401-1', 1000, NULL, 'KG PVC-U', 'Steckmuffe', true),
(1, 'Formstücke', 'Rohrbogen', NULL, -1, NULL, NULL, NULL, NULL, 45, NULL, NULL, true),
(2, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, false),
(3, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, false),
(4, 'Formstücke', 'Reduzierstück', 'PP', 200, 150, NULL, NULL, NULL, NULL, NULL, NULL, true),
(5, 'Kanalrohre', 'Betonrohre', 'Stahlbeton', -1, NULL, NULL, 'DIN EN 1916', NULL, NULL, NULL, NULL, true),
(6, 'Schachtabdeckungen', 'Guss rund', 'Gusseisen', NULL, NULL, 'D400', NULL, NULL, NULL, NULL, NULL, true),
(7, 'Schachtbauteile', 'Revisionsschacht', 'Beton', 1000, 150, NULL, NULL, NULL, NULL, NULL, NULL, true),
(8, 'Rinnen', 'Entwässerungsrinne', NULL, -1, NULL, 'E600', NULL, NULL, NULL, 'Aco Powerdrain', NULL, true),
(9, NULL, NULL, NULL, 400, 400, NULL, NULL, NULL, NULL, NULL, NULL, NULL),
(10, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL),
(11, 'Kanalrohre', 'KG-Rohre', 'HDPE', -1, NULL, NULL, NULL, 6000, NULL, 'Wavin PE 100-RC Druckrohr', NULL, true)"""


def phrased(part: DataFrame, phrases: tuple[tuple[str | None, str | None], ...]) -> DataFrame:
    pick = lambda i: F.get(F.array(*[F.lit(p[i]).cast("string") for p in phrases]), (c("p_partkey") % len(phrases)).cast("int"))
    dn = (c("p_size") * 10 + 100).cast("string")
    return spread(part).select("p_partkey", pick(0).alias("description"), F.replace(pick(1), F.lit("{dn}"), dn).alias("raw_text"))


@query(f"""SELECT p_partkey, cat AS product_category, sub AS product_subcategory, mat AS material, CASE WHEN dn < 0 THEN p_size * 10 + 100 ELSE dn END AS nominal_diameter_dn,
branch AS secondary_nominal_diameter_dn, load AS load_class, norm, len AS pipe_length_mm, angle AS angle_deg, family AS system_family, conn AS connection_type, rel AS sortiment_relevant
FROM part JOIN ({_READ_SQL}) v(k, cat, sub, mat, dn, branch, load, norm, len, angle, family, conn, rel) ON p_partkey % 12 = k""")
def text_parameters(spark, sf):
    out = parameters(phrased(Tables(spark, sf).part, _PHRASES))
    return out.select(
        "p_partkey", "product_category", "product_subcategory", "material", "nominal_diameter_dn", "secondary_nominal_diameter_dn", "load_class", "norm",
        "pipe_length_mm", "angle_deg", "system_family", "connection_type", "sortiment_relevant",
    )


_ASSEMBLIES = (
    ("Revisionsschacht", "Betonschacht DN 1.000 mit 3 x Schachtring, Konus, Abdeckung D400 Guss, Anschluss 150 mm"),
    ("Entwässerungsrinne", "Entwässerungsrinne DN 150 E600 mit Einlaufkasten, Rost und Stirnwand"),
    ("KG-Rohr", "KG-Rohr DN 110"),
)


@query("""SELECT p_partkey, part_no, component_name, dn, quantity, material FROM part JOIN (VALUES
(0, 1, 'Schachtunterteil', 1000, 1, 'Beton'), (0, 2, 'Schachtring', 1000, 3, 'Beton'), (0, 3, 'Konus', 1000, 1, 'Beton'), (0, 4, 'Abdeckung', 1000, 1, 'Gusseisen'),
(1, 1, 'Rinne', 150, 1, NULL), (1, 2, 'Einlaufkasten', 150, 1, NULL), (1, 3, 'Rost', 150, 1, NULL), (1, 4, 'Stirnwand', 150, 1, NULL)
) v(k, part_no, component_name, dn, quantity, material) ON p_partkey % 3 = k""")
def text_components(spark, sf):
    out = component_parts(parameters(phrased(Tables(spark, sf).part, _ASSEMBLIES)))
    one = out.select("p_partkey", F.posexplode_outer("components").alias("nth", "x")).where("x is not null")
    return one.select("p_partkey", (c("nth") + 1).alias("part_no"), "x.component_name", "x.dn", "x.quantity", "x.material")


_KINDS = (
    ("Zulage für Erschwernis", "Zulage", "material"), ("Anschlussarbeiten", "Anschlussarbeiten am Bestand", None), ("Kopfloch", "Kopfloch DN 150", "material"),
    ("Geotextil", "Geotextil verlegen", "dienstleistung"), ("Bordstein", "Bordstein setzen und herstellen", "dienstleistung"),
    ("Bordstein", "Bordstein liefern und setzen", "dienstleistung"), ("Vlies", "Vlies bauseits, verlegen", "dienstleistung"), ("Rohr", "Rohr liefern", "material"),
)


@query("""SELECT p_partkey, kind, billable FROM part JOIN (VALUES (0, 'dienstleistung', false), (1, 'dienstleistung', false), (2, 'material', true), (3, 'material', true),
(4, 'dienstleistung', false), (5, 'material', true), (6, 'dienstleistung', false), (7, 'material', true)) v(k, kind, billable) ON p_partkey % 8 = k""")
def line_kinds(spark, sf):
    given = F.get(F.array(*[F.lit(k).cast("string") for *_, k in _KINDS]), (c("p_partkey") % len(_KINDS)).cast("int"))
    df = phrased(Tables(spark, sf).part, tuple(x[:2] for x in _KINDS)).withColumn("position_type", given)
    kind = kinds.as_material(c("description"), c("raw_text"), kinds.as_service(c("description"), c("raw_text"), c("position_type")))
    return df.select("p_partkey", kind.alias("kind"), (kind == "material").alias("billable"))


# -- replies to inquiries ------------------------------------------------------------------

_REPLY_SQL = """g AS (SELECT l_orderkey AS mail_id, l_partkey AS inquiry_id, CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE min(l_linenumber) % 2 END AS number, min(l_suppkey) AS s, max(l_quantity) AS q
  FROM lineitem GROUP BY l_orderkey, l_partkey),
p AS (SELECT mail_id, inquiry_id, number, mail_id % 2 = 0 AS by_supplier, mail_id % 3 = 0 AS by_project, (CASE WHEN s % 3 = 0 THEN 35 ELSE 0 END) + (CASE WHEN s % 5 = 0 THEN 25 ELSE 0 END)
  + (CASE WHEN q * 2 <= 21 THEN 12 WHEN q * 2 > 90 THEN -8 ELSE 0 END) + least(18, inquiry_id % 8 * 3) AS score FROM g)"""


@query(f"""WITH {_REPLY_SQL}, r AS (SELECT *, row_number() OVER w AS nth, lead(score) OVER w AS second, count(*) OVER (PARTITION BY mail_id, number) AS n, count(*) OVER (PARTITION BY mail_id) AS n_mail
  FROM p WINDOW w AS (PARTITION BY mail_id, number ORDER BY score DESC, inquiry_id)),
k AS (SELECT *, nth = 1 AND (n = 1 OR by_supplier) AND CASE WHEN number IS NULL THEN score >= 14 AND (n = 1 OR score - second >= 5) ELSE by_supplier OR by_project OR score >= 5 END AS good FROM r)
SELECT mail_id, inquiry_id, score FROM k WHERE good OR n_mail = 1""")
def reply_inquiry_choice(spark, sf):
    number = F.when(c("l_orderkey") % 4 != 0, F.min("l_linenumber") % 2)
    g = Tables(spark, sf).lineitem.groupBy("l_orderkey", "l_partkey").agg(number.alias("number"), F.min("l_suppkey").alias("s"), F.max("l_quantity").alias("q"))
    score = inquiries.inquiry_score(c("s") % 3 == 0, c("s") % 5 == 0, c("q") * 2, c("l_partkey") % 8)
    pairs = g.select(c("l_orderkey").alias("mail_id"), c("l_partkey").alias("inquiry_id"), "number", score.alias("score"), (c("l_orderkey") % 2 == 0).alias("by_supplier"), (c("l_orderkey") % 3 == 0).alias("by_project"))
    return inquiries.chosen(pairs).select("mail_id", "inquiry_id", "score")


@query("""SELECT conv_id, turn, role, string_agg(x, ',' ORDER BY x) AS addresses, n FROM (
SELECT conv_id, turn, role, 'kontakt@firma' || conv_id % 50 || '.de' AS x, count(*) AS n FROM conversations GROUP BY ALL
UNION SELECT conv_id, turn, role, CASE WHEN conv_id % 3 = 0 THEN 'vertrieb@haus.de' ELSE 'info@werk.com' END, count(*) FROM conversations GROUP BY ALL) GROUP BY conv_id, turn, role, n""")
def reply_addresses(spark, sf):
    sender = F.concat(F.lit(" Kontakt@Firma"), (c("conv_id") % 50).cast("string"), F.lit(".de "))
    named = F.lit("Original-Empfänger: Vertrieb@Haus.de\n\nInfo: info@werk.com")
    body = F.when(c("conv_id") % 3 == 0, named).otherwise(F.lit("Fragen bitte an Info@Werk.com"))
    found = F.array_join(F.array_sort(inquiries.addresses(sender, body)), ",")
    return Tables(spark, sf).conversations.groupBy("conv_id", "turn", "role", found.alias("addresses")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, o_custkey AS inquiry_ref, o_orderkey % 9 AS project_ref, (o_orderkey % 9) || '.' || (o_custkey % 30 + 10) AS number_ref FROM orders""")
def reply_references(spark, sf):
    number = F.concat_ws(".", (c("o_orderkey") % 9).cast("string"), (c("o_custkey") % 30 + 10).cast("string"))
    corpus = F.format_string("Re: Anfrage [TBX-INQ-%d]\nProjekt TBX-PROJ-%d-OZ-%s", c("o_custkey"), (c("o_orderkey") % 9).cast("int"), number)
    read = Tables(spark, sf).orders.select("o_orderkey", inquiries.inquiry_references(corpus).alias("i"), inquiries.project_references(corpus).alias("p"))
    return read.select("o_orderkey", c("i")[0].alias("inquiry_ref"), c("p")[0]["project"].alias("project_ref"), c("p")[0]["number"].alias("number_ref"))


@query("""SELECT l_orderkey, l_partkey, CAST(2 * (1 + CAST(o_custkey % 2 = 0 AS INT)) + CASE WHEN l_partkey % 2 = 0 THEN 8 ELSE 0 END + CASE WHEN o_custkey % 4 = 0 THEN 4 ELSE 0 END + CASE WHEN l_suppkey % 3 = 0 THEN 3 ELSE 0 END AS INT) AS score
FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem) JOIN orders ON l_orderkey = o_orderkey""")
def suggestion_offer_score(spark, sf):
    t = Tables(spark, sf)
    df = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey").distinct().join(t.orders, c("l_orderkey") == c("o_orderkey"))
    article = F.concat(F.lit("Q-"), c("l_partkey").cast("string"))
    offer = F.concat_ws(" ", F.lit("muffenrohr"), F.when(c("o_custkey") % 2 == 0, F.lit("kanal")), F.when(c("o_custkey") % 4 == 0, F.lit("DN 150")), F.when(c("l_partkey") % 2 == 0, F.concat(F.lit("("), F.lower(article), F.lit(")"))))
    words = lambda *x: txt.ascii_tokens(F.concat_ws(" ", *x))
    maker = F.when(c("l_suppkey") % 3 == 0, F.lit("Haus GmbH")).otherwise(F.lit("Werk"))
    score = inquiries.suggestion_score(words(F.lit("Muffenrohr Kanal")), words(F.regexp_replace(offer, r"\(.*\)", "")), article, offer, F.lit(150), maker, F.lit("haus nord"))
    return df.select("l_orderkey", "l_partkey", score.cast("int").alias("score"))
