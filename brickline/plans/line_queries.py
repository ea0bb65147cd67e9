"""Lines of a bill of quantities read from text: corrections, merges, quantities,
missing lines, noise and descriptions, each with DuckDB SQL.

Texts are composed of part's numbers (``composed``); the SQL applies the rules to
the same texts, or states what they were composed of."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickline.functions.session import spread
from brickline.operators.extraction import corrections, descriptions, quantities
from brickline.operators.extraction import vocabulary as v
from brickline.operators.lines import numbered
from brickline.plans.composed import Composed, Pick

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


def part(spark: SparkSession, sf: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/part.parquet"))


def duck(rows: Composed) -> str:
    return rows.duck().replace(" as string)", " as varchar)")


def contains(words, text: str = "t") -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


# -- corrections -----------------------------------------------------------------

LINES = Composed(
    "part", {"p": "p_partkey"},
    {
        "title": Pick(
            ["Rohr liefern", "Betonschacht DN 1000", "Straßenablauf Aufsatz", "Muldenrinne setzen", "Kontrollschacht liefern", "Leerrohr", "Rohrklappe", "Noppenbahn Schutzlage",
             "Betonrohr pvc-u", "Aufsatz mit Abfluss", "Randstein Hochbord", "Bordstein PP pflaster", "Zulage Bogen", "Kopfloch herstellen", "Verbundsteinpflaster liefern",
             "Rohr vom AG bereitgestellt", "Vlies verlegen", "Steine schneiden, Bruchmaterial entsorgen"],
            "p_partkey",
        ),
        "tail": Pick(
            ["", "Material: PP SN10", "pp sn 8 und pp sn16", "500/300 mm", "Norm: DIN EN 1852-1", "zum Anschluss an PVC-KG-Rohr", "beton, grau", "pp", "bauseits", "Norm: EN  ISO 9969"],
            "p_partkey + p_partkey / 18",
        ),
        "position_type": Pick(["material", "material", "dienstleistung", "material", None, "dienstleistung"], "p_partkey + p_partkey / 5"),
        "product_category": Pick(
            ["Kanalrohre", "kanalrohre", "Rinnen", "Straßenentwässerung", "Kabelschutz", None, "formstuecke", "Unsinn", "strassenentwaesserung"], "p_partkey + p_partkey / 9"
        ),
        "product_subcategory": Pick(["KG-Rohre", None, "Rinne"], "p_partkey"),
        "material": Pick(["PP", "PVC-U", "Beton", "HDPE", None, "PE 100", "Stahlbeton"], "p_partkey + p_partkey / 7"),
        "known_material": Pick([None, "Kunststoff ", "PP", None, "kunststoff"], "p_partkey + p_partkey / 7"),
        "article_type": Pick([None, "Rohrklappe", "Mauerscheibe 80", "Absperrschieber", ""], "p_partkey + p_partkey / 11"),
        "nominal_diameter_dn": Pick([100, None, 150, 200, 0, 300], "p_partkey + p_partkey / 6"),
        "secondary_nominal_diameter_dn": Pick([None, 110, 160, 200, 100], "p_partkey + p_partkey / 4"),
        "stiffness_class_sn": Pick([None, 4, 8, 16], "p_partkey + p_partkey / 3"), "load_class": Pick(["B 125", None, "D400"], "p_partkey"),
        "norm": Pick([None, "DIN EN 1401", "DIN 8961", "DIN EN 1852-1"], "p_partkey + p_partkey / 8"), "dimensions": Pick([None, "1 x 2", None], "p_partkey + p_partkey / 3"),
        "system_family": Pick(["KG PVC-U", None, "HDPE", "Acaro PP"], "p_partkey + p_partkey / 2"), "billable": Pick([True, False], "p_partkey", "boolean"),
        "reference_product": Pick([None, "ACO"], "p_partkey"), "installation_area": Pick(["Gehweg", None, ""], "p_partkey"),
        "connection_type": Pick([None, "Muffe"], "p_partkey / 2"), "seal_type": Pick(["Ring", None], "p_partkey / 2"),
    },
    {"description": "title", "raw_text": "concat(title, chr(10), tail)"},
)
_T = "lower(concat(description, chr(10), raw_text))"
_BASE = f"b AS (SELECT *, {_T} AS t, lower(coalesce(article_type, '')) AS art FROM ({duck(LINES)}))"
_CANON = "CASE lower(product_category) " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in corrections.CATEGORY_SPELLINGS.items()) + " ELSE product_category END"
_PLASTIC = "coalesce(material IN ('PP', 'PVC-U', 'HDPE', 'PE 100', 'PE 100 RC'), false)"
_NAMED = r"CASE material WHEN 'PP' THEN regexp_matches(t, '\bpp\b') WHEN 'PVC-U' THEN regexp_matches(t, '\bpvc') WHEN 'HDPE' THEN regexp_matches(t, '\bhdpe\b|\bpe-hd\b|\bpe\s*100\b') WHEN 'PE 100' THEN regexp_matches(t, '\bpe\s*100\b|\bpe-hd\b') ELSE false END"
_NO_DN = contains(corrections.NO_DIAMETER, "art")
_FALSE_CHANNEL = f"(product_category IS NOT DISTINCT FROM 'Rinnen' AND {contains(corrections.NO_CHANNEL)})"
_SHAFT = f"(product_category IS NOT DISTINCT FROM 'Kanalrohre' AND {contains(corrections.SHAFTS)})"
_CONDUIT = f"(product_category IS NOT DISTINCT FROM 'Kabelschutz' AND {contains(corrections.SEWER_NORMS, 'lower(coalesce(norm, chr(32)))')})"
_DRAIN = "(product_category IS NOT DISTINCT FROM 'Straßenentwässerung')"
_DN = f"CASE WHEN ({_DRAIN} AND contains(t, 'aufsatz') AND coalesce(nominal_diameter_dn, 0) <> 0 AND NOT contains(t, 'abfluss')) OR position_type IS NOT DISTINCT FROM 'dienstleistung' OR {_NO_DN} THEN NULL ELSE nominal_diameter_dn END"
_LABEL = r"regexp_extract(raw_text, '(?i)norm[:\s]+((?:DIN|EN|ISO)(?:\s+EN)?(?:\s+ISO)?\s*\d+(?:-\d+)?(?:\s+Typ\s+\d+)?)', 1)"


def corrected_sql(source: str) -> str:
    return rf"""SELECT p, position_type, billable, CASE WHEN {_FALSE_CHANNEL} THEN NULL WHEN {_SHAFT} THEN 'Schachtbauteile' WHEN {_CONDUIT} THEN 'Kanalrohre' ELSE {_CANON} END AS product_category,
CASE WHEN {_FALSE_CHANNEL} OR {_SHAFT} OR {_CONDUIT} THEN NULL ELSE product_subcategory END AS product_subcategory,
CASE WHEN coalesce(material IN ('Beton', 'Stahlbeton', 'Polymerbeton', 'Gusseisen', 'Stahl'), false) OR stiffness_class_sn IS NULL THEN NULL
ELSE coalesce(TRY_CAST(nullif(regexp_extract(t, 'material[:\s]+\w+\s+sn\s*(\d+)', 1), '') AS INTEGER), TRY_CAST(list_last(regexp_extract_all(t, '\bpp\s+sn\s*(\d+)', 1)) AS INTEGER), stiffness_class_sn) END AS stiffness_class_sn,
CASE WHEN {_PLASTIC} AND {contains(v.NOT_IN_CATALOGUE)} AND NOT ({_NAMED}) THEN NULL WHEN {_PLASTIC} AND lower(trim(coalesce(known_material, ''))) = 'kunststoff' THEN 'Kunststoff'
WHEN {_PLASTIC} AND {contains(corrections.CONCRETE)} AND NOT regexp_matches(t, '\bpvc-u\b|\bpvc-kg\b|\bpolyvinylchlorid\b|sanierungsstutzen|reparaturstutzen') THEN 'Beton' ELSE material END AS material,
CASE WHEN {_DRAIN} AND dimensions IS NULL THEN nullif(regexp_extract(t, '\d{{3,4}}\s*/\s*\d{{3,4}}\s*mm'), '') ELSE dimensions END AS dimensions,
replace(load_class, ' ', '') AS load_class, {_DN} AS nominal_diameter_dn,
CASE WHEN {_NO_DN} THEN NULL WHEN ({_DN}) = secondary_nominal_diameter_dn OR (CASE {_DN} WHEN 100 THEN 110 WHEN 125 THEN 140 WHEN 150 THEN 160 WHEN 200 THEN 200 WHEN 250 THEN 250 WHEN 300 THEN 315 END) = secondary_nominal_diameter_dn THEN NULL ELSE secondary_nominal_diameter_dn END AS secondary_nominal_diameter_dn,
coalesce(nullif(regexp_replace(trim({_LABEL}), '\s+', ' ', 'g'), ''), norm) AS norm,
CASE WHEN {contains(['klappe', 'schieber'], 'art')} AND {contains(v.CONNECTS_TO, 'lower(raw_text)')} AND coalesce(system_family IN ('KG PVC-U', 'KG 2000', 'HDPE'), false) THEN NULL ELSE system_family END AS system_family FROM {source}"""


CORRECTED = [
    "p", "position_type", "billable", "product_category", "product_subcategory", "stiffness_class_sn", "material", "dimensions", "load_class", "nominal_diameter_dn",
    "secondary_nominal_diameter_dn", "norm", "system_family",
]


@query(f"WITH {_BASE} {corrected_sql('b')}")
def corrected_parameters(spark, sf):
    return corrections.corrected(LINES.spark(part(spark, sf))).select(*CORRECTED)


_WORK = rf"(NOT (regexp_matches(raw_text, '(?i)\bDN\s*([0-9]{{1,2}}\.?[0-9]{{2,3}})\b') OR {contains([x.lower() for x in v.LOAD_CLASSES])}) AND (regexp_matches(t, '^\s*zulage\b') OR (regexp_matches(t, '\b(schneiden|zuschneiden|k[uü]rzen|ausklinken|nachbearbeiten)\b') AND regexp_matches(t, 'bruchmaterial.*entsorg|bruchmaterial\s+ist') AND NOT regexp_matches(t, '\baus\s+(beton|stahlbeton|polymerbeton|kunststoff|pvc|pp\b|pe\b|gusseisen|steinzeug|naturstein)\b')) OR {contains(corrections.WORK)}))"
_CLIENT = r"regexp_matches(description, '(?i)beigestellt|vom\s+AG\s+bereitgestellt')"
_CUT = ", ".join(f"CASE WHEN service THEN NULL ELSE {f} END AS {f}" for f in corrections.PRODUCT_FIELDS)
_KEEP = ", ".join(f"CASE WHEN own THEN a.{f} ELSE x.{f} END AS {f}" for f in CORRECTED if f not in ("p", "position_type", "billable"))


@query(f"""WITH {_BASE}, m AS (SELECT *, coalesce(position_type = 'material', false) AND ({_CLIENT} OR {_WORK}) AS service FROM b),
s AS (SELECT * EXCLUDE (position_type, billable, {', '.join(corrections.PRODUCT_FIELDS)}), {_CUT}, CASE WHEN service THEN false ELSE billable END AS billable,
CASE WHEN service THEN 'dienstleistung' ELSE position_type END AS type1 FROM m),
a AS (SELECT * EXCLUDE (type1, product_category), position_type IS NOT DISTINCT FROM 'dienstleistung' AS own,
CASE WHEN position_type IS NOT DISTINCT FROM 'dienstleistung' OR lower(category0) IN ({', '.join(repr(k) for k in corrections.CATEGORY_SPELLINGS if k not in ('straßenentwässerung', 'dichtungen & zubehor'))}) THEN category0 END AS product_category
FROM (SELECT *, product_category AS category0, CASE WHEN type1 = 'dienstleistung' AND NOT {contains(['bauseits', 'beistellung'])} AND
(({contains(['dränmatte', 'draenmatte', 'dränschicht', 'draenschicht', 'geotextil', 'vlies', 'noppenbahn', 'schutzlage'])} AND {contains(['liefern', 'herstellen', 'verlegen'])}) OR
({contains(['pflaster', 'verbundpflaster', 'verbundsteinpflaster', 'randstein', 'bordstein', 'kantenstein', 'tiefbord', 'betonplatten', 'plattenband'])} AND contains(t, 'liefern'))) THEN 'material' ELSE type1 END AS position_type FROM s)),
x AS ({corrected_sql('a')})
SELECT a.p, a.position_type, a.billable, {_KEEP} FROM a JOIN x USING (p)""")
def post_processed_lines(spark, sf):
    return corrections.post_processed(LINES.spark(part(spark, sf))).select(*CORRECTED)


_MERGED = ["product_category", "product_subcategory", "material", "nominal_diameter_dn", "norm"]


def _merge_rows(spark, sf) -> DataFrame:
    rows = LINES.spark(part(spark, sf))
    rows = rows.withColumn("description", F.when(c("p") % 4 == 0, F.concat(F.lit(" Wie zuvor, "), c("title"))).otherwise(c("title"))).withColumn("raw_text", c("tail"))
    return rows.withColumns({
        "read_product_category": F.when(c("p") % 3 == 0, F.lit("Rinnen")).when(c("p") % 3 == 1, c("product_category")), "read_product_subcategory": F.when(c("p") % 2 == 0, F.lit("Rost")),
        "read_material": F.when(c("p") % 5 == 0, F.lit("")).when(c("p") % 5 < 3, F.lit("Guss")), "read_nominal_diameter_dn": F.when(c("p") % 3 == 2, F.lit(400)), "read_norm": c("known_material"),
    })


@query(f"""WITH m AS (SELECT *, p % 4 = 0 AS ref, CASE p % 3 WHEN 0 THEN 'Rinnen' WHEN 1 THEN product_category END AS rc, CASE WHEN p % 2 = 0 THEN 'Rost' END AS rs,
CASE WHEN p % 5 IN (1, 2) THEN 'Guss' END AS rm, CASE WHEN p % 3 = 2 THEN 400 END AS rd FROM ({duck(LINES)}))
SELECT p, CASE WHEN ref THEN coalesce(rc, product_category) ELSE coalesce(product_category, rc) END AS product_category,
CASE WHEN ref THEN coalesce(rs, product_subcategory) WHEN product_category <> rc THEN product_subcategory ELSE coalesce(product_subcategory, rs) END AS product_subcategory,
CASE WHEN ref THEN coalesce(rm, material) ELSE coalesce(material, rm) END AS material, CASE WHEN ref THEN coalesce(rd, nominal_diameter_dn) ELSE coalesce(nominal_diameter_dn, rd) END AS nominal_diameter_dn,
CASE WHEN ref THEN coalesce(known_material, norm) ELSE coalesce(norm, known_material) END AS norm, ref AS refers FROM m""")
def backfilled_parameters(spark, sf):
    rows = _merge_rows(spark, sf)
    refers = corrections.refers_to_previous(c("description"), c("raw_text"))
    return corrections.backfilled(rows, _MERGED).select("p", *_MERGED, refers.alias("refers"))


_VERBS = ["", " liefern", " liefern und verlegen", " setzen", " einbauen.", " Montieren", " lang"]


@query(f"""SELECT p_partkey AS p, CASE p_partkey % 7 WHEN 0 THEN 'Rohr' WHEN 6 THEN 'Rohr lang' ELSE CASE WHEN p_partkey % 2 = 0 THEN 'Rohr' ELSE 'Rohr' || ({_VERBS!r})[p_partkey % 7 + 1] END END AS article,
CASE p_partkey % 3 WHEN 0 THEN 'rund' WHEN 1 THEN 'rund;D-400' ELSE 'D-400' END AS features FROM part""")
def article_types_and_features(spark, sf):
    rows = part(spark, sf).selectExpr("p_partkey as p", f"concat(' Rohr', {Pick(_VERBS, 'p_partkey').sql('spark')}) as raw", "case when p_partkey % 2 = 0 then 'material' else 'dienstleistung' end as kind")
    features = F.when(c("p") % 3 == 2, F.array(F.lit("rund"), F.lit("D-400"))).otherwise(F.array(F.lit("rund"), F.lit("D-400")))
    specs = F.when(c("p") % 3 == 0, F.array(F.lit("d 400"))).when(c("p") % 3 == 2, F.array(F.lit("RUND!"), F.lit("x")))
    return rows.select("p", corrections.article_type(c("raw"), c("kind")).alias("article"), F.array_join(corrections.new_features(features, specs), ";").alias("features"))


# -- quantities and blocks -----------------------------------------------------------

UNITS = ["m", "Stk", "Std.", "m²", "St", "kg", "Psch", "Stueck", "h"]
_QTY = Composed("part", {"p": "p_partkey", "whole": "cast(p_partkey % 1900 as int)", "cents": "cast(p_partkey % 100 as int)"}, {"unit": Pick(UNITS, "p_partkey")}, {})


def quantity_blocks(spark, sf) -> DataFrame:
    """Blocks whose amounts are written as '1.234,05 m', '12,05 m' or '12.05 m'."""
    rows = _QTY.spark(part(spark, sf))
    grouped = F.when(c("whole") >= 1000, F.format_string("%d.%03d", F.floor(c("whole") / 1000), c("whole") % 1000)).otherwise(c("whole").cast("string"))
    amount = F.when(c("p") % 5 == 4, F.format_string("%d.%02d", "whole", "cents")).otherwise(F.concat(grouped, F.format_string(",%02d", "cents")))
    line = F.when(c("p") % 6 != 5, F.concat(F.lit("  "), amount, F.lit(" "), c("unit"), F.lit(" ........")))
    text = F.concat_ws("\n", F.lit("Rohr DN 150 liefern, 3 m lang"), F.lit("ca. 4 x 3 m"), line, F.when(c("p") % 2 == 0, F.lit("99 kg am Ende")))
    return rows.select("p", text.alias("text"), F.when(c("p") % 3 == 0, F.lit(7.0)).alias("quantity"), F.when(c("p") % 4 == 0, F.lit("t")).alias("unit"))


_UNIT = "CASE unit WHEN 'Stk' THEN 'Stück' WHEN 'St' THEN 'Stück' WHEN 'Stueck' THEN 'Stück' WHEN 'Std.' THEN 'Std' ELSE unit END"
_BLOCK = f"""q AS (SELECT *, CASE WHEN p % 6 <> 5 THEN CASE WHEN p % 5 = 4 THEN CAST(whole * 100 + cents AS DOUBLE) ELSE whole + cents / 100.0 END WHEN p % 2 = 0 THEN 99.0 END AS bq,
CASE WHEN p % 6 <> 5 THEN {_UNIT} WHEN p % 2 = 0 THEN 'kg' END AS bu FROM ({duck(_QTY)}))"""


@query(f"WITH {_BLOCK} SELECT p, coalesce(CASE WHEN p % 3 = 0 THEN 7.0 END, CASE WHEN p % 10 <> 3 THEN bq END) AS quantity, coalesce(CASE WHEN p % 4 = 0 THEN 't' END, CASE WHEN p % 10 <> 3 THEN bu END, CASE WHEN p % 4 = 1 THEN '' END) AS unit FROM q")
def filled_quantities(spark, sf):
    """A number may have an earlier block, which doesn't count; every tenth has its quantity
    after the line at which a document's last block ends."""
    rows = quantity_blocks(spark, sf).withColumn("unit", F.when(c("p") % 4 == 1, F.lit("")).otherwise(c("unit")))
    long = F.concat(F.repeat(F.lit("Text\n"), quantities.LAST_LINES), "text")
    last = rows.select("p", F.lit(2).alias("block"), F.when(c("p") % 10 == 3, long).otherwise(c("text")).alias("text"), F.lit(True).alias("is_last"))
    before = rows.where("p % 7 = 0").select("p", F.lit(1).alias("block"), F.lit("  11,5 kg").alias("text"), F.lit(False).alias("is_last"))
    return quantities.filled_quantities(rows.drop("text"), before.unionByName(last), ["p"]).select("p", "quantity", "unit")


@query(f"""WITH {_BLOCK} SELECT p, CASE WHEN p % 2 = 0 THEN 99.0 WHEN p % 6 <> 5 THEN CASE WHEN p % 5 = 4 THEN 5.0 ELSE bq END ELSE 5.0 END AS quantity,
CASE WHEN p % 2 = 0 THEN 'kg' WHEN p % 6 <> 5 AND p % 5 <> 4 THEN replace(CASE unit WHEN 'Stueck' THEN 'Stk' ELSE unit END, '.', '') ELSE 'm' END AS unit FROM q""")
def text_quantities(spark, sf):
    """The last line that begins with an amount; without one the last loose amount that is no measure."""
    rows = _QTY.spark(part(spark, sf)).withColumn("unit", F.when(c("unit") == "Stueck", F.lit("Stk")).otherwise(c("unit")))
    grouped = F.when(c("whole") >= 1000, F.format_string("%d.%03d", F.floor(c("whole") / 1000), c("whole") % 1000)).otherwise(c("whole").cast("string"))
    line = F.when((c("p") % 6 != 5) & (c("p") % 5 != 4), F.concat(F.lit("  "), grouped, F.format_string(",%02d", "cents"), F.lit(" "), c("unit"), F.lit(" ....")))
    text = F.concat_ws("\n", F.lit("Rohr, Menge 5 m"), F.lit("Abstand 4 x 3 m, ca. 8 m, bei 12 m ü. NN"), line, F.when(c("p") % 2 == 0, F.lit("99 kg am Ende")))
    got = quantities.text_quantity(text)
    return rows.select("p", got["quantity"].alias("quantity"), got["unit"].alias("unit"))


@query("""WITH l AS (SELECT l_orderkey AS doc, l_linenumber AS n, min(l_partkey) AS k, min(CAST(l_quantity AS INTEGER)) AS q FROM lineitem GROUP BY 1, 2),
t AS (SELECT *, CASE WHEN k % 3 = 0 THEN '' ELSE 'Leistung ' || n END AS title, CASE WHEN k % 2 = 0 THEN 'm' ELSE 'Stk' END AS unit, unnest(range(1 + CAST(n % 4 = 0 AS INTEGER))) AS again FROM l)
SELECT doc, '2.' || n AS item, CASE WHEN title = '' THEN '' ELSE title || ' ' END || 'Text dazu ' || again AS description, CASE WHEN title = '' THEN '' ELSE title || chr(10) || '  ' END || 'Text dazu ' || again || chr(10) || q || ' ' || unit || ' ________' AS raw_text,
CAST(q AS DOUBLE) AS quantity, CASE WHEN k % 2 = 0 THEN 'm' ELSE 'Stück' END AS unit, 'dienstleistung' AS position_type FROM t WHERE n % 2 = 0 AND k % 5 <> 0""")
def missing_positions(spark, sf):
    """Every fourth number stands twice; a title may be a quantity; pages, rows of dots and a
    document's end say nothing."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(c("l_orderkey").alias("doc"), c("l_linenumber").alias("n")).agg(
        F.min("l_partkey").alias("k"), F.min(c("l_quantity").cast("int")).alias("q")
    )
    text = lambda again: F.concat_ws(
        "\n", F.concat(F.format_string("02.%04d ", "n"), F.when(c("k") % 3 == 0, F.lit("77 kg")).otherwise(F.format_string("Leistung %d", "n"))), F.lit("Seite 3"), F.lit("  "), F.lit(f"  Text dazu {again} "),
        F.lit("Einheitspreis .................."), F.when(c("k") % 5 != 0, F.concat(c("q").cast("string"), F.lit(" "), F.when(c("k") % 2 == 0, F.lit("m")).otherwise(F.lit("Stk")), F.lit(" ________"))),
    )
    both = F.when(c("n") % 4 == 0, F.concat_ws("\n", text(0), text(1))).otherwise(text(0))
    docs = lines.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", both.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    whole = F.concat(F.lit("Vorbemerkung\n"), "text", F.lit("\n3.1 Ende\n"), F.repeat(F.lit("Text\n"), quantities.LAST_LINES_MISSING), F.lit("5 m"))
    blocks = quantities.text_blocks(docs.select("doc", whole.alias("text")), "doc", "text")
    known = lines.where("n % 2 = 1").select("doc", F.concat(F.lit("2."), c("n").cast("string")).alias("item"))
    return quantities.missing_positions(blocks, known, ["doc", "item"]).select("doc", "item", "description", "raw_text", "quantity", "unit", "position_type")


@query("""SELECT p_partkey AS p, CASE p_partkey % 6 WHEN 0 THEN '1.5.' || p_partkey || ' Rohr' WHEN 1 THEN '1.2.' || p_partkey WHEN 2 THEN '5.3.2.' || p_partkey || ' Text' WHEN 3 THEN 'Projekt: ' || p_partkey
WHEN 4 THEN 'Rohr.' || p_partkey ELSE '' END AS line, p_partkey % 6 IN (3, 5) AS noise, p_partkey % 2 = 0 AS contents FROM part""")
def line_noise(spark, sf):
    n = c("p").cast("string")
    raw = F.when(c("p") % 6 == 0, F.concat(F.lit("1 . 5\t. "), n, F.lit("  Rohr "))).when(c("p") % 6 == 1, F.concat(F.lit("1.2..."), n)).when(
        c("p") % 6 == 2, F.concat(F.lit("5.3.2 . "), n, F.lit(" . Text"))).when(c("p") % 6 == 3, F.concat(F.lit("Projekt:  "), n)).when(c("p") % 6 == 4, F.concat(F.lit("Rohr........... "), n)).otherwise(F.lit(" "))
    rows = part(spark, sf).selectExpr("p_partkey as p").withColumn("line", quantities.normalised_line(raw))
    contents = F.concat(F.lit("Rohre "), F.repeat(F.lit("."), F.when(c("p") % 2 == 0, F.lit(12)).otherwise(F.lit(3))), F.lit(" 17"))
    line = F.when(c("p") % 6 == 4, F.concat(F.lit("Rohr."), n)).otherwise(c("line"))
    return rows.select("p", line.alias("line"), quantities.is_noise(c("line")).alias("noise"), quantities.is_noise(contents).alias("contents"))


# -- descriptions --------------------------------------------------------------------

_KINDS = ["KG-Rohr liefern", "wie zuvor", "", "Schachtring setzen"]
_TEXT = Composed(
    "part", {"p": "p_partkey"},
    {
        "title": Pick(_KINDS, "p_partkey"), "dn": Pick([150, None, 200], "p_partkey"), "second": Pick([None, 110], "p_partkey / 2"), "material": Pick(["PP", None, "Beton"], "p_partkey / 3"),
        "sn": Pick([None, 8], "p_partkey"), "norm": Pick(["DIN EN 1401", None], "p_partkey / 2"), "category": Pick(["Kanalrohre", "Rinnen", None], "p_partkey / 4"),
        "sub": Pick([None, "Muffe", "Konus"], "p_partkey / 4 + 1"), "label": Pick(["Breite: 30 cm", "Fundament aus Kies", "Farbe grau", "nur Text"], "p_partkey / 4"),
    },
    {},
)
_LABEL_SQL = "CASE WHEN label = 'nur Text' THEN NULL WHEN label = 'Farbe grau' THEN 'Farbe: grau' WHEN starts_with(label, 'Fundament') THEN 'Fundament: aus Kies' ELSE label END"


@query(f"""WITH d AS (SELECT *, CASE WHEN title IN ('KG-Rohr liefern', 'Schachtring setzen') THEN title
WHEN p % 5 = 0 THEN coalesce(CASE sub WHEN 'Muffe' THEN 'Muffe' WHEN 'Konus' THEN 'Schachtkonus' END, CASE category WHEN 'Kanalrohre' THEN 'Abwasserkanal' WHEN 'Rinnen' THEN 'Entwässerungsrinne' END, CASE WHEN title = '' THEN 'Position' ELSE title END)
ELSE 'Bauteil ' || p || CASE WHEN label = 'Breite: 30 cm' THEN ', Breite: 30 cm' ELSE '' END END AS name FROM ({duck(_TEXT)}))
SELECT p, name AS title, concat_ws(', ', name, CASE WHEN contains(name, 'Breite') OR p % 5 = 0 THEN NULL ELSE {_LABEL_SQL} END, CASE WHEN dn IS NULL THEN NULL WHEN second IS NULL THEN 'DN ' || dn ELSE 'DN ' || dn || '/' || second END,
material, CASE WHEN sn IS NOT NULL THEN 'SN' || sn END, norm) AS description FROM d""")
def display_descriptions(spark, sf):
    rows = _TEXT.spark(part(spark, sf))
    raw = F.when(c("p") % 5 != 0, F.concat_ws("\n\n", F.concat(F.lit("Bauteil "), c("p").cast("string")), F.lit("OZ: 1.2"), c("label"), F.lit("12,5 m Rest"))).otherwise(F.lit(""))
    fields = {"dn": c("dn"), "second_dn": c("second"), "material": c("material"), "sn": c("sn"), "norm": c("norm"), **{k: F.lit(None).cast("string") for k in ("reference", "load_class", "dimensions", "system")}}
    named = rows.withColumn("name", descriptions.display_title(c("title"), raw, c("category"), c("sub")))
    return named.select("p", c("name").alias("title"), descriptions.display_description(c("name"), raw, fields).alias("description"))


@query(r"""SELECT p_partkey AS p, CASE p_partkey % 3 WHEN 0 THEN 'Rohr DN150 liefern und verlegen, Graben 1, 5 m' WHEN 1 THEN 'Bauteil, DIN 1045 gerade' ELSE 'Bauteil, gegossen' END AS described FROM part""")
def service_descriptions(spark, sf):
    described = F.when(c("p") % 3 == 0, F.lit("  Rohr DN150 liefern  und verlegen,")).when(c("p") % 3 == 1, F.lit("Übertrag")).otherwise(F.lit("Bauteil, gegossen"))
    raw = F.when(c("p") % 3 == 0, F.lit("Rohr DN150 liefern.\nGraben 1,5 m.\n3 m Rohr")).when(c("p") % 3 == 1, F.lit("Bauteil\n\nDIN 1045 gerade\n\nSeite 7")).otherwise(F.lit("Bauteil\n\n7 Stk"))
    return part(spark, sf).selectExpr("p_partkey as p").select("p", descriptions.service_description(described, raw).alias("described"))
