"""Selections, decisions, offers and messages of projects, with DuckDB SQL.

orders are the projects and lineitem their positions; selections, components,
decisions, offers and inquiries are composed of the positions' numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickline.functions import text as txt
from brickline.operators import tallies, tenders
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


POS = """pos AS (SELECT l_orderkey AS project, l_linenumber AS line, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS position_id, min(l_partkey) AS k, min(l_suppkey) AS s, min(l_quantity) AS q,
  min(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2),
kinds AS (SELECT *, k % 5 = 0 AS service, CASE k % 6 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' WHEN 2 THEN 'inquiry_pending' END AS decision, k % 10 = 0 AS asked, k % 3 <> 1 AS covered,
  (CASE WHEN k % 3 = 0 THEN 0 ELSE 1 + k % 2 END) + (CASE WHEN k % 4 = 0 THEN 2 ELSE 0 END) > 0 AS assigned FROM pos)"""


def positions(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(c("l_orderkey").alias("project"), c("l_linenumber").alias("line")).agg(
        F.min("l_partkey").alias("k"), F.min("l_suppkey").alias("s"), F.min("l_quantity").alias("q"), F.min("l_extendedprice").alias("price")
    )
    return described(rows)


def described(rows: DataFrame) -> DataFrame:
    """The columns of rows and those that are composed of project, line, k and q."""
    return rows.selectExpr(
        "*", "concat_ws('-', project, line) as position_id",
        "case when k % 5 = 0 then 'dienstleistung' when k % 7 = 0 then null else 'material' end as position_type",
        "case k % 6 when 0 then 'accepted' when 1 then 'rejected' when 2 then 'inquiry_pending' end as decision", "k % 10 = 0 as is_asked", "k % 3 <> 1 as is_covered",
        "case when k % 9 = 0 then null else q end as quantity",
    )


def selections(rows: DataFrame) -> DataFrame:
    return rows.where("k % 3 <> 0").selectExpr("position_id", "k", "explode(sequence(1, cast(1 + k % 2 as int))) as nth").selectExpr(
        "position_id", "nth", "concat(case nth when 1 then 'A' else 'B' end, k) as artikel_id"
    )


def components(rows: DataFrame) -> DataFrame:
    return rows.where("k % 4 = 0").selectExpr("position_id", "k", "explode(array('Deckel', 'Ring')) as component_name").selectExpr(
        "position_id", "component_name", "concat('C', k, component_name) as artikel_id"
    )


def assigned(spark: SparkSession, sf: str) -> DataFrame:
    rows = positions(spark, sf)
    return tallies.assignments(rows, selections(rows), components(rows))


@query(f"""WITH {POS}, t AS (SELECT project, count(*) AS total, count(*) FILTER (service) AS service, count(*) FILTER (NOT service AND assigned) AS assigned, count(*) FILTER (NOT service AND decision = 'rejected') AS rejected,
count(*) FILTER (NOT service AND decision = 'accepted') AS accepted, count(*) FILTER (NOT service AND (coalesce(decision, '') = 'inquiry_pending' OR asked)) AS asked, count(*) FILTER (NOT service AND decision IS NULL) AS undecided,
count(*) FILTER (NOT service AND decision IS NULL AND covered) AS undecided_covered, count(*) FILTER (covered) AS covered FROM kinds GROUP BY 1)
SELECT *, greatest(0, total - assigned - service - rejected) AS open, total - service AS material, CAST(floor(100 * covered / total + 0.5) AS INTEGER) AS match_percent,
CASE WHEN total - service > 0 THEN CAST(floor(100 * assigned / (total - service) + 0.5) AS INTEGER) ELSE 0 END AS assigned_percent FROM t""")
def position_tallies(spark, sf):
    return tallies.progress(tallies.tally(assigned(spark, sf), ["project"], tallies.position_tests() | {"covered": c("is_covered")}))


@query(f"""WITH {POS}, m AS (SELECT *, NOT service AND coalesce(decision, '') <> 'rejected' AND NOT assigned AS keep FROM kinds), f AS (SELECT project, line FROM m WHERE keep AND contains(position_id, '1'))
SELECT * FROM f ORDER BY project, line LIMIT 50 OFFSET 100""")
def open_positions_page(spark, sf):
    rows = tallies.searched(tallies.filtered(assigned(spark, sf), "offen"), " 1 ", ["position_id"])
    return tallies.page_of(rows, [c("project"), c("line")], 2, 50).select("project", "line")


@query(f"""WITH {POS}, s AS (SELECT position_id, 0 AS side, 1 AS nth, '' AS name, 'A' || k AS article, position_id || '::primary' AS key FROM kinds WHERE k % 3 <> 0
UNION ALL SELECT position_id, 0, 2, '', 'B' || k, position_id || '::additional::B' || k FROM kinds WHERE k % 3 <> 0 AND k % 2 = 1
UNION ALL SELECT position_id, 1, 0, n, 'C' || k || n, position_id || '::component::' || n FROM kinds, (VALUES ('Deckel'), ('Ring')) AS q(n) WHERE k % 4 = 0)
SELECT position_id, string_agg(key, ',' ORDER BY side, nth, name) AS keys, string_agg(article, ',' ORDER BY side, nth, name) AS articles FROM s JOIN kinds USING (position_id) WHERE NOT service GROUP BY 1""")
def active_selections(spark, sf):
    rows = positions(spark, sf)
    found = tallies.active_selections(rows, selections(rows), components(rows))
    return found.select("position_id", F.array_join("keys", ",").alias("keys"), F.array_join("articles", ",").alias("articles"))


@query(f"""WITH {POS} SELECT position_id, CASE WHEN k % 4 = 0 THEN '' ELSE position_id || '::component::Deckel,' END || position_id || '::component::Rahmen' AS missing FROM kinds""")
def component_gaps(spark, sf):
    rows = positions(spark, sf)
    wanted = rows.select("position_id", F.array(F.lit("Deckel"), F.lit("Rahmen")).alias("components"))
    found = tallies.component_gaps(wanted, tallies.active_selections(rows.withColumn("position_type", F.lit("material")), selections(rows), components(rows)).select("position_id", "keys"))
    return found.select("position_id", F.array_join("missing", ",").alias("missing"))


@query(f"""WITH {POS} SELECT project, CAST(sum(CAST(round(price * CASE WHEN k % 9 = 0 THEN 1 ELSE q END, 2) AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM kinds WHERE NOT service AND k % 3 <> 0 AND k % 8 <> 1 GROUP BY 1""")
def estimated_totals(spark, sf):
    rows = positions(spark, sf)
    chosen = rows.where("k % 3 <> 0").select("position_id", F.when(c("k") % 8 != 1, c("price")).alias("price_net"))
    return tallies.estimated_totals(rows, chosen, "project").select("project", c("total").cast("double").alias("total"))


@query(f"""WITH {POS} SELECT position_id, CASE WHEN k % 7 = 0 THEN CASE WHEN k % 3 = 0 THEN '' WHEN k % 2 = 1 THEN 'A' || k || ',B' || k ELSE 'A' || k END
WHEN k % 4 = 0 THEN CASE WHEN k % 3 = 0 THEN 'SO-' || k WHEN k % 2 = 1 THEN 'SO-' || k || ',B' || k ELSE 'SO-' || k END
WHEN k % 3 = 0 THEN '' WHEN k % 2 = 1 THEN 'B' || k ELSE 'X' || k END AS articles FROM kinds""")
def restored_selections(spark, sf):
    rows = positions(spark, sf)
    stored = selections(rows).groupBy("position_id").agg(F.array_sort(F.collect_list("artikel_id")).alias("articles"))
    offer = F.when(c("k") % 4 == 0, F.concat(F.lit("SO-"), c("k").cast("string")))
    id_ = lambda x: F.concat(F.lit(x), c("k").cast("string"))
    suggested = F.when(c("k") % 7 != 0, F.array_compact(F.array(offer, id_("X"), id_("B"))))
    found = tallies.restored(stored, rows.select("position_id", suggested.alias("suggested"), F.when(c("k") % 7 != 0, offer).alias("offer")))
    return found.select("position_id", F.array_join("articles", ",").alias("articles"))


@query(f"""WITH {POS}, off AS (SELECT position_id, line, k, q, project, CASE WHEN k % 2 = 0 THEN position_id END AS by_id, CAST(line AS VARCHAR) || '.' || CAST(project AS VARCHAR) AS number FROM kinds WHERE k % 3 <> 1),
f AS (SELECT p.position_id, 'SO-' || o.k AS artikel_id, CASE WHEN o.k % 4 < 2 THEN CAST(o.k AS DOUBLE) END AS price_net, CASE WHEN o.k % 4 < 2 AND p.q <> 0 AND p.k % 9 <> 0 THEN round(o.k * p.q, 2) ELSE CAST(o.k * 2 AS DOUBLE) END AS total_net, 100.0 AS score, true AS is_offer, 0 AS side, 1 AS r
FROM kinds p JOIN off o ON p.position_id = o.position_id WHERE o.k % 5 <> 2),
b AS (SELECT position_id, 'A' || k AS artikel_id, price AS price_net, price * 2 AS total_net, CAST(k % 90 AS DOUBLE) AS score, false AS is_offer, 1 AS side, 1 AS r FROM kinds)
SELECT position_id, row_number() OVER (PARTITION BY position_id ORDER BY side, r) AS place, artikel_id, price_net, total_net, score, is_offer FROM (SELECT * FROM f UNION ALL SELECT * FROM b)""")
def suggestions_with_offers(spark, sf):
    """Half of the offers name their position by id, the others by number only."""
    rows = positions(spark, sf).withColumn("number", F.concat_ws(".", "line", "project"))
    offers = rows.where("k % 3 <> 1").select(
        c("k").alias("offer_id"), F.when(c("k") % 2 == 0, c("position_id")).alias("position_id"), "number", F.when(c("k") % 4 < 2, c("k").cast("double")).alias("unit_price"),
        (c("k") * 2).cast("double").alias("total_price"), F.when(c("k") % 5 == 2, F.lit("abgelehnt")).otherwise(F.lit("neu")).alias("status"), F.current_timestamp().alias("created_at"),
    )
    own = rows.select("position_id", F.lit(1).alias("rank"), F.concat(F.lit("A"), c("k").cast("string")).alias("artikel_id"), c("price").alias("price_net"), (c("price") * 2).alias("total_net"), (c("k") % 90).cast("double").alias("score"))
    return tallies.suggestions_with_offers(own, offers, rows.select("position_id", "number", "quantity")).select("position_id", "place", "artikel_id", "price_net", "total_net", "score", "is_offer")


@query(f"""WITH {POS}, p AS (SELECT position_id, k % 50 AS kind, k FROM kinds), s AS (SELECT s_suppkey, s_suppkey % 50 AS kind FROM supplier)
SELECT position_id, s_suppkey AS supplier_id FROM p JOIN s USING (kind) WHERE NOT (k % 3 = 0 AND s_suppkey % 8 < 4)""")
def suppliers_to_ask(spark, sf):
    """All suppliers of the position's category, but for those that were asked already."""
    named = lambda i, pattern: F.format_string(pattern, (i % 50).cast("int"))
    rows = positions(spark, sf).withColumn("project", F.when(c("k") % 11 != 0, c("project")))
    listed = spark.read.parquet(f"{sf}/supplier.parquet").select(c("s_suppkey").alias("supplier_id"), named(c("s_suppkey"), "schächte %d").alias("kind"))
    asked = rows.where("k % 3 = 0").select("position_id", c("project").alias("project_id"), F.lit("angefragt").alias("status"), named(c("k"), "schächte %d").alias("kind")).join(listed.where("supplier_id % 8 < 4"), "kind").drop("kind")
    suppliers = listed.select("supplier_id", F.array("kind", F.lit("Alles")).alias("categories"))
    return tallies.suppliers_to_ask(rows.select("position_id", c("project").alias("project_id"), named(c("k"), "SCHÄCHTE %d").alias("category")), suppliers, asked)


@query(f"""WITH {POS}, r AS (SELECT *, line % 3 AS item, row_number() OVER (PARTITION BY project, line % 3 ORDER BY line DESC) = 1 AS last FROM kinds)
SELECT position_id, CASE WHEN last AND item <> 2 THEN 'neu ' || project || '.' || item ELSE 'alt' END AS description, CASE WHEN project % 2 = 0 THEN 'Seite' ELSE 'alt' END AS raw_text FROM r""")
def reparsed_positions(spark, sf):
    rows = positions(spark, sf).select("project", "line", (c("line") % 3).alias("item"), "position_id", F.lit("alt").alias("description"), F.lit("alt").alias("raw_text"))
    fresh = rows.where("item <> 2").select("project", "item", F.concat(F.lit("neu "), c("project").cast("string"), F.lit("."), c("item").cast("string")).alias("description")).distinct()
    new = tallies.reparsed(rows, fresh, ["project", "item"], "line", ["description"])
    pages = rows.select("project", F.when(c("project") % 2 == 0, F.lit("Seite")).alias("raw_text")).distinct()
    return tallies.with_page_texts(new, pages, "project", ["raw_text"]).select("position_id", "description", "raw_text")


@query("""SELECT p_partkey AS p, CASE p_partkey % 4 WHEN 0 THEN 'Werkstoff passt (PP)' WHEN 1 THEN 'Norm passt (X)' WHEN 2 THEN 'Winkel 45°;Typ' ELSE '' END AS reasons, CASE p_partkey % 3 WHEN 0 THEN 'Menge nicht erkannt, Standard 1 verwendet' WHEN 1 THEN 'Kein Preis verfügbar' ELSE '' END AS warnings FROM part""")
def shown_reasons_and_warnings(spark, sf):
    say = lambda *words: F.array(*[F.lit(w) for w in words])
    n = c("p") % 4
    reasons = F.when(n == 0, say("DN 150 exakt", "Werkstoff passt (PP)")).when(n == 1, say("Norm passt (X)", "Norm abweichend (A ≠ B)")).when(n == 2, say("Winkel 45°", "Sofort aus Lager verfügbar", "Typ")).otherwise(say("OD 160 exakt", "Anschluss-DN 110 passt"))
    warnings = F.when(c("p") % 3 == 0, say("Menge nicht erkannt, Standard 1 verwendet", "Anderer Hersteller als X")).when(c("p") % 3 == 1, say("Kein Preis verfügbar")).otherwise(say("sonst"))
    rows = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey as p")
    return rows.select("p", F.array_join(tallies.shown_reasons(reasons), ";").alias("reasons"), F.array_join(tallies.shown_warnings(warnings), ";").alias("warnings"))


# -- messages ------------------------------------------------------------------------


@query("""SELECT conv_id, turn, role, count(*) AS n, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE '1.2.' || conv_id || ' Rohr und noch etwas mehr Text' END AS passage, conv_id % 2 = 0 AND turn = 0 AS own_copy,
CASE WHEN conv_id % 4 = 0 THEN NULL ELSE CAST(conv_id % 4 AS INTEGER) END AS objects, CASE conv_id % 3 WHEN 0 THEN 'Titel ' WHEN 1 THEN 'Mehr ' ELSE 'Erst ' END || conv_id AS title, 'Größe ' || conv_id || ' & <Maß> 5€' AS plain,
'a' || chr(10) || 'b  c' AS notice FROM conversations GROUP BY ALL""")
def message_texts(spark, sf):
    conv = spark.read.parquet(f"{sf}/conversations.parquet").groupBy("conv_id", "turn", "role").agg(F.count("*").alias("n"), F.first("text").alias("text"))
    n = c("conv_id").cast("string")
    corpus = F.concat(F.lit("Guten Tag\n"), F.when(c("conv_id") % 3 != 0, F.concat(F.lit("1.2."), n, F.lit(" Rohr und noch etwas mehr Text\n"))).otherwise(F.lit("")), F.lit(" 7.8.9 anderes"))
    item = F.concat(F.lit('{"name": "a } ['), n, F.lit('", "n": {"x": [{"y": {"z": "}"}}]}}'))
    cut = F.concat(F.lit("```json\n["), F.array_join(F.array_repeat(item, (c("conv_id") % 4).cast("int")), ",\n"), F.lit(',{"name": "abgeschn'))
    objects = F.size(F.from_json(ingest.complete_objects(cut), "array<map<string,string>>"))
    title = F.when(c("conv_id") % 3 == 0, F.concat(F.lit('{"eng": "x", "deu": ["Titel '), n, F.lit('", "y"]}'))).when(c("conv_id") % 3 == 1, F.concat(F.lit('{"mul": "Mehr '), n, F.lit('"}'))).otherwise(F.concat(F.lit('[{"fra": "Erst '), n, F.lit('"}]')))
    html = F.concat(F.lit("<p>Gr&ouml;&szlig;e "), n, F.lit(" &amp; &lt;Ma&#223;&gt; 5&#x20AC;</p>"))
    copy = ingest.is_own_copy(F.when(c("conv_id") % 2 == 0, F.lit(" [DEMO] Anfrage: X")).otherwise(F.lit("Anfrage")), F.lit("Wir@Firma.de"), F.lit("x [Demo-Weiterleitung] y"), c("turn"), "wir@firma.de")
    return conv.select(
        "conv_id", "turn", "role", "n", ingest.passage(corpus, F.concat(F.lit("1.2."), n)).alias("passage"), copy.alias("own_copy"), F.when(objects > 0, objects).alias("objects"),
        ingest.unwrapped(title).alias("title"), txt.strip_html(html).alias("plain"), txt.clean_notice(F.lit("<b>a&#10;b</b> &nbsp;c")).alias("notice"),
    )


@query("""SELECT p_partkey AS p, CASE WHEN p_partkey % 3 = 0 THEN greatest(CAST(p_size AS INTEGER), 15) ELSE p_size END AS relevance FROM part WHERE p_partkey % 3 = 0 OR p_size >= 10""")
def relevant_tenders(spark, sf):
    rows = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey as p", "p_size as relevance", "case when p_partkey % 3 = 0 then 'nrw' when p_partkey % 3 = 1 then 'ted' end as source")
    return tenders.relevant(rows).select("p", "relevance")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_extendedprice END AS unit_price FROM lineitem WHERE l_partkey % 5 <> 0""")
def valid_offer_lines(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(c("l_partkey") % 5 == 0, F.lit(" x ")).otherwise(F.lit("Rohr")).alias("article_name"),
        F.when(c("l_partkey") % 4 == 0, -c("l_extendedprice")).otherwise(c("l_extendedprice")).alias("unit_price"), F.lit(1.0).alias("total_price"),
    )
    return ingest.valid_offer_lines(rows).select("l_orderkey", "l_linenumber", "l_partkey", "unit_price")
