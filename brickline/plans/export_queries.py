"""The offer export over selections, products, offers and inquiries, with DuckDB SQL.

lineitem gives the positions and their selections, part the products, supplier the
offers, orders the projects and their open inquiries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickline.functions.session import kept
from brickline.operators import export
from brickline.plans.tally_queries import POS, described, positions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
c = F.col


def query(oracle: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = oracle
        return f

    return put


# -- the tables, composed alike on both sides ------------------------------------------

#: Expressions that Spark and DuckDB both read.
UNIT = "case k % 4 when 0 then null when 1 then '' else 'm' end"
FIRST = "case when k % 4 = 1 then concat('SO-', s) when k % 20 = 6 then 'SO-x' else concat('A', k) end"
SECOND = "case when k % 8 = 0 then concat('A', k + 2) when k % 2 = 1 then concat('A', k + 1) end"
KEY_1 = "case when k % 8 = 0 then concat(position_id, '::component::Deckel') else concat(position_id, '::primary') end"
KEY_2 = "case when k % 24 = 8 then 'lost' when k % 8 = 0 then concat(position_id, '::component::Ring') when k % 2 = 1 then concat(position_id, '::additional::A', k + 1) end"
CUSTOM = "case when k % 14 = 0 then 0.01 else 99999.5 end"
PRODUCTS = """concat('A', p_partkey) as artikel_id, p_name as name, p_brand as maker, case p_partkey % 3 when 0 then '' when 1 then 'Stk' end as unit,
case when p_partkey % 6 <> 0 then p_retailprice end as list_price, case when p_partkey % 2 = 0 then p_retailprice - 1 end as price_10, case when p_partkey % 4 = 0 then p_retailprice - 5 end as price_50, cast(null as double) as price_100"""
OFFERS = """s_suppkey as offer_id, case s_suppkey % 3 when 0 then '' when 1 then null else concat('N', s_suppkey) end as article_number, concat('Ware ', s_suppkey) as article_name,
case when s_suppkey % 2 = 1 then 'kg' end as unit, case when s_suppkey % 5 <> 0 then abs(s_acctbal) end as unit_price, case when s_suppkey % 7 <> 0 then s_name end as supplier"""


class Tables:
    def __init__(self, spark: SparkSession, sf: str):
        read = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
        # every table below is made of the same grouped lines
        rows = described(kept(positions(spark, sf).select("project", "line", "k", "s", "q"), "export-positions"))
        self.positions = rows.selectExpr(
            "project", "line as place", "position_id", "concat('01.', line) as number", "concat('Text ', k) as description", "quantity", f"{UNIT} as unit",
            "position_type", "k % 13 <> 0 as billable", "case when k % 8 = 0 then array('Deckel', 'Ring') end as components",
        )
        keys = f"case when k % 37 = 0 then array() when k % 31 = 0 then array('a', 'b', 'c') else filter(array({KEY_1}, {KEY_2}), x -> x is not null) end"
        chosen = rows.where("k % 29 <> 0").selectExpr("project", "100 - line as place", "position_id", f"filter(array({FIRST}, {SECOND}), x -> x is not null) as articles", f"{keys} as keys")
        stray = rows.where("line = 1 and project % 50 = 0").selectExpr("project", "0 as place", "'none' as position_id", "array('A1') as articles", "array() as keys")
        self.selections = chosen.unionByName(stray)
        self.terms = rows.where("k % 7 = 0 or k % 37 = 0").selectExpr(
            "project", "concat(position_id, case when k % 37 = 0 then '::0' else '::primary' end) as assignment_key", f"cast({CUSTOM} as double) as custom_price",
            "k % 21 = 0 as is_alternative", "cast(null as boolean) as supplier_open",
        )
        self.products = read("part").where("p_partkey % 17 <> 0").selectExpr(*[x.strip() for x in split(PRODUCTS)])
        self.offers = read("supplier").where("s_suppkey % 11 <> 0").selectExpr(*[x.strip() for x in split(OFFERS)])
        got = rows.where("k % 6 = 2").selectExpr(
            "project", "position_id", "s as supplier_id", "concat('01.', line) as number", "'angebot_erhalten' as status",
            "explode(case k % 12 when 2 then array(struct(1 as at, concat('Alt ', k) as t), struct(2 as at, concat('Neu ', k) as t)) else array(struct(1 as at, concat('Alt ', k) as t), struct(3 as at, '' as t)) end) as x",
        ).selectExpr("project", "position_id", "supplier_id", "number", "status", "x.t as product_description", "x.at as updated_at")
        asked = read("orders").where("o_orderkey % 9 = 0").selectExpr(
            "o_orderkey as project", "cast(null as string) as position_id",
            "explode(array_compact(array(struct(1 as who, 'offen' as status), case when o_orderkey % 18 = 0 then struct(1 as who, 'angebot_erhalten' as status) end, case when o_orderkey % 27 = 0 then struct(2 as who, 'angefragt' as status) end))) as x",
        ).selectExpr("project", "position_id", "x.who as supplier_id", "cast(null as string) as number", "x.status as status", "cast(null as string) as product_description", "0 as updated_at")
        self.inquiries = got.unionByName(asked)
        self.found = export.resolved(export.assignments(self.positions, self.selections, self.terms, self.inquiries), self.products, self.offers)


def split(columns: str) -> list[str]:
    """Column expressions at the commas outside of brackets."""
    out, depth = [""], 0
    for x in columns:
        depth += (x == "(") - (x == ")")
        if x == "," and not depth:
            out.append("")
        else:
            out[-1] += x
    return out


LINES = f"""{POS}, x AS (SELECT *, CASE WHEN k % 9 <> 0 THEN q END AS quantity, concat('01.', line) AS number, {UNIT} AS unit FROM kinds),
sel AS (SELECT x.*, 0 AS nth, {FIRST} AS artikel_id, CASE WHEN k % 37 = 0 THEN position_id || '::0' WHEN k % 31 = 0 THEN 'a' ELSE {KEY_1} END AS key FROM x WHERE k % 29 <> 0
UNION ALL SELECT x.*, 1, {SECOND}, CASE WHEN k % 37 = 0 THEN position_id || '::1' WHEN k % 31 = 0 THEN 'b' ELSE {KEY_2} END FROM x WHERE k % 29 <> 0 AND ({SECOND}) IS NOT NULL),
terms AS (SELECT position_id || CASE WHEN k % 37 = 0 THEN '::0' ELSE '::primary' END AS key, CAST({CUSTOM} AS DOUBLE) AS custom, k % 21 = 0 AS alt FROM kinds WHERE k % 7 = 0 OR k % 37 = 0),
prod AS (SELECT {PRODUCTS} FROM part WHERE p_partkey % 17 <> 0),
offr AS (SELECT {OFFERS} FROM supplier WHERE s_suppkey % 11 <> 0),
r AS (SELECT sel.*, 100 - line AS place, CASE k % 12 WHEN 2 THEN 'Neu ' || k WHEN 8 THEN 'Alt ' || k ELSE 'Text ' || k END AS description, custom, coalesce(alt, false) AS alt,
  coalesce(CASE WHEN quantity <> 0 THEN quantity END, 1.0) AS n, sel.artikel_id LIKE 'SO-%' AS bought,
  p.artikel_id AS pid, p.name, p.maker, p.unit AS punit, CASE WHEN coalesce(quantity, 1) >= 100 AND price_100 IS NOT NULL THEN price_100 WHEN coalesce(quantity, 1) >= 50 AND price_50 IS NOT NULL THEN price_50
  WHEN coalesce(quantity, 1) >= 10 AND price_10 IS NOT NULL THEN price_10 ELSE list_price END AS base, o.offer_id, o.article_number, o.article_name, o.unit AS ounit, o.unit_price, o.supplier
  FROM sel LEFT JOIN terms USING (key) LEFT JOIN prod p ON sel.artikel_id = p.artikel_id LEFT JOIN offr o ON sel.artikel_id = 'SO-' || o.offer_id),
l AS (SELECT *, CASE WHEN bought THEN offer_id IS NOT NULL ELSE pid IS NOT NULL END AS is_line, CASE WHEN bought THEN coalesce(unit_price, 0) ELSE coalesce(base, 0) END AS cost FROM r),
lines AS (SELECT project, place, position_id, nth, number, description, n AS quantity, coalesce(nullif(unit, ''), nullif(CASE WHEN bought THEN ounit ELSE punit END, ''), 'Stk') AS unit,
  CASE WHEN bought THEN coalesce(nullif(article_number, ''), artikel_id) ELSE pid END AS artikel_id, CASE WHEN bought THEN article_name ELSE name END AS name, CASE WHEN bought THEN coalesce(supplier, 'Lieferant') ELSE maker END AS maker,
  CAST(round(greatest(cost, coalesce(custom, cost)), 2) AS DECIMAL(18, 2)) AS price_net, CAST(round(greatest(cost, coalesce(custom, cost)) * n, 2) AS DECIMAL(18, 2)) AS total_net, nth > 0 AS is_additional, alt AS is_alternative FROM l WHERE is_line),
warned AS (SELECT project, 0 AS side, line AS place, 0 AS nth, position_id, number, ['Kein Artikel zugeordnet'] AS reasons FROM x WHERE k % 29 = 0 AND NOT service
  UNION ALL SELECT project, 1, place, nth, position_id, number, list_filter([CASE WHEN NOT is_line AND bought THEN 'Lieferantenangebot ' || artikel_id || ' nicht gefunden' WHEN NOT is_line THEN 'Artikel ' || artikel_id || ' nicht in Datenbank gefunden' END,
  CASE WHEN is_line AND NOT bought AND base IS NULL THEN 'Kein Preis verfügbar für ' || artikel_id || ', 0 EUR verwendet' END, CASE WHEN is_line AND NOT bought AND custom < cost THEN 'VK unter EK nicht erlaubt, EK verwendet' END,
  CASE WHEN is_line AND NOT bought AND nth = 0 AND quantity IS NULL THEN 'Menge nicht erkannt, Standard 1 verwendet' END], lambda w: w IS NOT NULL) FROM l),
warnings AS (SELECT project, side, place, nth, i - 1 AS at, position_id, number, reasons[i] AS reason FROM (SELECT *, unnest(range(1, len(reasons) + 1)) AS i FROM warned)),
pending AS (SELECT o_orderkey AS project, CAST(o_orderkey % 18 <> 0 AS INTEGER) + CAST(o_orderkey % 27 = 0 AS INTEGER) AS n FROM orders WHERE o_orderkey % 9 = 0),
refused AS (SELECT project, 0 AS side, 0 AS place, 409 AS code, 'Angebot gesperrt: ' || n || ' offene Lieferantenanfrage(n) vorhanden.' AS detail FROM pending WHERE n > 0 AND project IN (SELECT project FROM x)
  UNION ALL SELECT project, 1, line, 400, CASE WHEN k % 29 = 0 THEN 'Angebot gesperrt: Position ' || number || ' ist noch nicht zugeordnet.'
  WHEN k % 37 <> 0 AND k % 31 = 0 THEN 'Angebot gesperrt: Zuordnungsdaten für Position ' || number || ' sind unvollständig.'
  WHEN k % 8 = 0 AND (k % 37 = 0 OR k % 24 = 8) THEN 'Angebot gesperrt: Komponenten für Position ' || number || ' sind nicht vollständig zugeordnet.' END FROM x WHERE k % 13 <> 0 AND NOT service),
gate AS (SELECT project, arg_min(code, (side, place)) AS code, arg_min(detail, (side, place)) AS detail FROM refused WHERE detail IS NOT NULL GROUP BY 1)"""


@query(f"WITH {LINES} SELECT * REPLACE (CAST(price_net AS DOUBLE) AS price_net, CAST(total_net AS DOUBLE) AS total_net) FROM lines")
def offer_export_lines(spark, sf):
    lines = export.export_lines(Tables(spark, sf).found).drop("supplier_open")
    return lines.withColumns({n: c(n).cast("double") for n in ("price_net", "total_net")})


@query(f"WITH {LINES} SELECT * FROM warnings")
def offer_export_warnings(spark, sf):
    t = Tables(spark, sf)
    return export.export_warnings(t.positions, t.selections, t.found)


@query(f"WITH {LINES} SELECT * FROM gate")
def offer_export_gate(spark, sf):
    t = Tables(spark, sf)
    return export.gate(t.positions, t.selections, t.inquiries)


@query(f"""WITH {LINES}, t AS (SELECT project, count(*) AS n_lines, bool_or(is_alternative) AS any_alternative, sum(total_net) AS net FROM lines GROUP BY 1),
e AS (SELECT p.*, coalesce(g.code, CASE WHEN n_lines IS NULL THEN 400 ELSE 200 END) AS code, coalesce(detail, CASE WHEN n_lines IS NULL THEN 'Keine gültigen Artikel für den Export ausgewählt' END) AS detail, t.* EXCLUDE (project), w.n AS warned
FROM (SELECT project, count(*) AS n_positions FROM x GROUP BY 1) p LEFT JOIN gate g USING (project) LEFT JOIN t USING (project) LEFT JOIN (SELECT project, count(*) AS n FROM warnings GROUP BY 1) w USING (project))
SELECT project, code, detail, n_positions, CASE WHEN code = 200 THEN n_lines END AS n_lines, CASE WHEN code = 200 THEN any_alternative END AS any_alternative, CASE WHEN code = 200 THEN CAST(net AS DOUBLE) END AS net,
CASE WHEN code = 200 THEN CAST(net + round(net * 0.19, 2) AS DOUBLE) END AS gross, CASE WHEN code = 200 THEN coalesce(warned, 0) END AS n_warnings, CASE WHEN code = 200 THEN 'gerechnet' END AS status FROM e""")
def offer_export(spark, sf):
    """Gate, lines, warnings and totals of every project; the exported ones become 'gerechnet'."""
    t = Tables(spark, sf)
    out = export.exported(t.positions, t.selections, t.inquiries, t.found).drop("vat")
    return out.withColumns({n: c(n).cast("double") for n in ("net", "gross")})
