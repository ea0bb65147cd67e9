"""Catalogue guesses and imports over articles composed of part's numbers, with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickline.functions.session import spread
from brickline.operators import guesses
from brickline.plans.composed import Composed, Pick, norm_sql

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


ARTICLES = Composed(
    "part", {"p": "p_partkey"},
    {
        "artikelname": Pick(
            ["Rost für Rinne", "Rinne mit Gitterrost", "Einlaufkasten FASERFIX KS 150", "Schachtring Beton", "Tegra Schachtrohr DN 400", "Kasten", "X-Stream Rohr NW 300",
             "Kombistirnwand RECYFIX PLUS 100", "Auflagering", "Geruchsverschluss für Einlaufkasten", "Rohr Nennweite 200"],
            "p_partkey",
        ),
        "artikelbeschreibung": Pick(
            [None, "aus PP, DN 110 und DN/OD 160", "Belastungsklasse B 125 bis D-400, Stahl verzinkt", "mit Lippendichtung, Steckmuffe", "seitlich und stirnseitig", "EN 1433, DIN  EN 1917",
             "aus Gusseisen A15", "", "DIN 19580 DIN 4034-1 DIN 19580, Meterware", "faserbewehrter Beton, mit Dichtung", "senkrecht, Überschiebmuffe, Sinkkasten"],
            "p_partkey + p_partkey / 11",
        ),
        "kategorie": Pick([None, "Rinnen", "Kanalrohre", ""], "p_partkey + p_partkey / 4"),
        "unterkategorie": Pick([None, "Entwässerungsrinne", "Einlaufkasten", "Zubehör", "Rohre", ""], "p_partkey + p_partkey / 5"),
        "werkstoff": Pick([None, "PE", ""], "p_partkey"), "system_familie": Pick([None, None, "Eigen"], "p_partkey / 2"), "nennweite_dn": Pick([None, 100], "p_partkey / 3"),
        "belastungsklasse": Pick([None, "", "C250"], "p_partkey / 2 + 1"), "verbindungstyp": Pick([None, "Flansch"], "p_partkey"), "dichtungstyp": Pick(["", None], "p_partkey"),
        "kompatible_dn_anschluss": Pick([None, "50"], "p_partkey / 5"), "kompatible_systeme": Pick([None, "", "HT"], "p_partkey / 7"),
        "article": Pick(["Abdeckung", "Punkteinläufe", "Schrauben", "Retentionstank", "Kombiartikel", "Neues", "Abscheider Schachtmaterial"], "p_partkey + p_partkey / 3"),
        "norm": Pick([None, None, "DIN 1"], "p_partkey"), "medium": Pick([None, "Trinkwasser", "Gas"], "p_partkey / 3"),
        "system": Pick([None, "KG", "Acaro", "Tegra"], "p_partkey / 2"), "stoff": Pick(["PVC-U", "PE 100", "PP", None], "p_partkey / 5"),
        "kat": Pick(["Wasserrohre", "Kanalrohre", "Gasrohre", None, "Druckrohre"], "p_partkey / 3"), "main": Pick([110, 0, 160, None], "p_partkey"), "branch": Pick([None, 110, 50], "p_partkey / 2"),
        "piece": Pick([None, 4.5, None], "p_partkey", "double"), "metre": Pick([None, 2.25], "p_partkey / 3", "double"),
    },
    {},
)


def articles(spark: SparkSession, sf: str) -> DataFrame:
    return ARTICLES.spark(spread(spark.read.parquet(f"{sf}/part.parquet")))


def cascade(x: str, pairs) -> str:
    return "CASE " + " ".join(f"WHEN contains({x}, '{w}') THEN '{label}'" for w, label in pairs) + " END"


_ALL = "concat_ws(' ', nullif(trim(artikelname), ''), nullif(trim(coalesce(artikelbeschreibung, '')), ''))"
_PLACES = ", ".join(f"({i}, '{label}', '{w}')" for i, (label, words) in enumerate(guesses.SUBCATEGORIES) for w in words)
_DNS = r"list_sort(list_distinct(list_transform(regexp_extract_all(txt, '(?i)\bDN(?:/OD)?\s*(\d{2,4})\b', 1), lambda x: CAST(x AS INTEGER))))"
_LOADS = r"list_filter(list_transform(regexp_extract_all(upper(txt), '\b[A-F]\s*[-.]?\s*(?:15|125|250|400|600|900)\b'), lambda x: regexp_replace(x, '[\s.-]', '', 'g')), lambda x: x IN ('A15', 'B125', 'C250', 'D400', 'E600', 'F900'))"
GUESS_SQL = rf"""places AS (SELECT * FROM (VALUES {_PLACES}) AS q(i, label, w)),
a AS (SELECT *, {_ALL} AS txt, {norm_sql(_ALL)} AS low, {norm_sql('artikelname')} AS title FROM ({ARTICLES.duck()})),
g AS (SELECT *, {cascade('low', guesses.MATERIALS)} AS g_material, {cascade('low', guesses.SYSTEMS)} AS g_system,
coalesce(TRY_CAST(regexp_extract(txt, '(?i)\bDN(?:/OD)?\s*(\d{{2,4}})\b', 1) AS INTEGER), TRY_CAST(regexp_extract(txt, '(?i)\bNW\s*(\d{{2,4}})\b', 1) AS INTEGER), TRY_CAST(regexp_extract(txt, '(?i)\bNennweite\s*(\d{{2,4}})\b', 1) AS INTEGER)) AS g_dn,
nullif(array_to_string({_DNS}, ','), '') AS g_dns, list_max({_LOADS}) AS g_load,
CASE WHEN contains(low, 'stirnseitig') AND contains(low, 'seitlich') THEN 'stirnseitig/seitlich' ELSE {cascade('low', guesses.JOINTS)} END AS g_joint, {cascade('low', guesses.SEALS)} AS g_seal,
coalesce((SELECT arg_min(label, struct_pack(at := instr(title, w), i := i)) FROM places WHERE contains(title, w)), (SELECT arg_min(label, i) FROM places WHERE contains(low, w))) AS g_sub FROM a),
h AS (SELECT *, CASE WHEN {norm_sql('g_sub')} IN {guesses.SHAFT_PARTS} THEN 'Schachtbauteile' WHEN {norm_sql('g_sub')} IN {guesses.STREET_PARTS} THEN 'Straßenentwässerung' WHEN {norm_sql('g_sub')} IN {guesses.CHANNEL_PARTS} THEN 'Rinnen' END AS g_category,
CASE WHEN g_sub IS NULL THEN unterkategorie WHEN coalesce(unterkategorie, '') = '' OR {norm_sql('unterkategorie')} IN ('entwaesserungsrinne', 'schwerlastrinne', 'rinnen', 'zubehoer')
OR ({norm_sql('unterkategorie')} IN ('einlaufkasten') AND {norm_sql('g_sub')} IN ('geruchsverschluss', 'schmutzfangeimer', 'rost')) THEN g_sub ELSE unterkategorie END AS new_sub FROM g)"""


@query(f"WITH {GUESS_SQL} SELECT p, g_material, g_system, g_dn, g_dns, g_load, g_joint, g_seal, g_sub, g_category FROM h")
def catalogue_guesses(spark, sf):
    text = guesses.combined(c("artikelname"), c("artikelbeschreibung"))
    sub = guesses.subcategory(c("artikelname"), text)
    return articles(spark, sf).select(
        "p", guesses.material(text).alias("g_material"), guesses.system(text).alias("g_system"), guesses.nominal_dn(text).alias("g_dn"), guesses.connection_dns(text).alias("g_dns"),
        guesses.highest_load_class(text).alias("g_load"), guesses.joint(text).alias("g_joint"), guesses.seal(text).alias("g_seal"), sub.alias("g_sub"), guesses.category(sub).alias("g_category"),
    )


_FIELDS = {"system_familie": "g_system", "werkstoff": "g_material", "belastungsklasse": "g_load", "verbindungstyp": "g_joint", "dichtungstyp": "g_seal", "kompatible_dn_anschluss": "g_dns", "kompatible_systeme": "g_system"}
_NEW = {f: f"coalesce(nullif({f}, ''), {g})" for f, g in _FIELDS.items()} | {
    "nennweite_dn": "coalesce(nennweite_dn, g_dn)", "unterkategorie": "new_sub",
    "kategorie": f"CASE WHEN {norm_sql('new_sub')} IN {guesses.STREET_PARTS} AND (coalesce(kategorie, '') IN ('', 'Rinnen')) AND g_category IS NOT NULL THEN g_category ELSE kategorie END",
}


@query(f"WITH {GUESS_SQL} SELECT p, {', '.join(f'{e} AS {f}' for f, e in _NEW.items())}, {' + '.join(f'CAST(({e}) IS DISTINCT FROM {f} AS INTEGER)' for f, e in _NEW.items())} AS changed FROM h")
def enriched_articles(spark, sf):
    return guesses.enriched(articles(spark, sf)).select("p", *_NEW, "changed")


_IMPORT = "concat(artikelname, ' ', coalesce(artikelbeschreibung, ''))"
_FAMILY = "CASE " + " ".join(f"WHEN contains(upper(x), '{f}') THEN '{f}'" for f in guesses.FAMILIES) + " END"
_NORMS = r"list_distinct_keep(list_concat(list_filter([CASE WHEN contains(upper(x), 'EN 1433') THEN 'DIN EN 1433' END, CASE WHEN contains(upper(x), 'DIN 19580') THEN 'DIN 19580' END], lambda y: y IS NOT NULL), list_transform(regexp_extract_all(upper(x), '\bDIN(?:\s+EN)?\s+\d+(?:-\d+)?\b'), lambda y: regexp_replace(y, '\s+', ' ', 'g'))))"
_EVERY = _NORMS.removeprefix("list_distinct_keep(")[:-1]
IMPORT_SQL = rf"""i0 AS (SELECT *, {_IMPORT} AS x FROM ({ARTICLES.duck()})), i1 AS (SELECT *, {_EVERY} AS ns, {_FAMILY} AS family FROM i0),
i2 AS (SELECT *, list_filter(ns, lambda y, k: list_position(ns, y) = k) AS nd FROM i1)"""


@query(rf"""WITH {IMPORT_SQL} SELECT p, family, coalesce(family IN ('FASERFIX', 'RECYFIX', 'DRAINFIX', 'STEELFIX'), false) AND article NOT IN {guesses.NOT_IMPORTED} AS imported, {cascade('lower(x)', guesses.IMPORT_MATERIALS)} AS material,
coalesce(TRY_CAST(regexp_extract(x, '(?i)\bNennweite\s+(\d{{2,4}})\b', 1) AS INTEGER), TRY_CAST(regexp_extract(x, '(?i)\b(?:KS|STANDARD|PLUS|PRO|SUPER|MONOTEC|POINT|SLOT|FSU|RNC|HICAP)\s+(\d{{2,4}})\b', 1) AS INTEGER), TRY_CAST(regexp_extract(x, '(?i)\bDN(?:/OD)?\s*(\d{{2,4}})\b', 1) AS INTEGER)) AS size,
nd[1] AS norm_1, nd[2] AS norm_2, CASE WHEN contains(lower(x), 'stirnseitig') THEN CASE WHEN contains(lower(x), 'seitlich') THEN CASE WHEN contains(replace(lower(x), 'stirnseitig', ''), 'seitlich') THEN 'stirnseitig/seitlich' ELSE 'stirnseitig' END END WHEN contains(lower(x), 'seitlich') THEN 'seitlich' WHEN contains(lower(x), 'senkrecht') THEN 'senkrecht' END AS joint,
CASE WHEN contains(lower(x), 'dichtungsfalz') THEN 'Dichtungsfalz' WHEN contains(lower(x), 'mit dichtung') THEN 'Dichtung' END AS seal,
CASE WHEN article = 'Punkteinläufe' THEN 'Straßenentwässerung' WHEN article = 'Abscheider Schachtmaterial' THEN 'Schachtbauteile' WHEN article = 'Retentionstank' THEN 'Versickerung' ELSE 'Rinnen' END AS category,
CASE article WHEN 'Abdeckung' THEN 'Abdeckungen' WHEN 'Kombiartikel' THEN 'Rinnen' WHEN 'Abscheider Schachtmaterial' THEN 'Schachtbauteile' ELSE article END AS subcategory,
CASE WHEN contains(lower(x), 'meterware') THEN 'm' ELSE 'Stk' END AS unit, CASE WHEN contains(x, 'DN/OD 160') THEN 160 WHEN contains(x, 'DN 400') THEN 400 WHEN contains(x, 'NW 300') THEN 300 WHEN contains(x, 'Nennweite 200') THEN 200 END AS bounded FROM i2""")
def imported_articles(spark, sf):
    x = F.concat(c("artikelname"), F.lit(" "), F.coalesce("artikelbeschreibung", F.lit("")))
    n = guesses.norms(x)
    return articles(spark, sf).select(
        "p", guesses.family(x).alias("family"), guesses.is_imported(x, c("article")).alias("imported"), guesses.import_material(x).alias("material"), guesses.nominal_size(x).alias("size"),
        n["first"].alias("norm_1"), n["second"].alias("norm_2"), guesses.import_joint(x).alias("joint"), guesses.import_seal(x).alias("seal"),
        guesses.article_category(c("article")).alias("category"), guesses.article_subcategory(c("article")).alias("subcategory"), guesses.price_unit(x).alias("unit"), guesses.bounded_dn(x).alias("bounded"),
    )


@query(f"""SELECT p, CASE WHEN norm IS NOT NULL THEN norm WHEN system = 'KG' AND stoff = 'PVC-U' THEN 'DIN EN 1401' WHEN system = 'Acaro' OR (stoff = 'PP' AND contains(lower(coalesce(kat, '')), 'rohr')) THEN 'DIN EN 13476-2'
WHEN system = 'Tegra' THEN 'DIN EN 13598-2' WHEN stoff = 'PE 100' AND (kat = 'Wasserrohre' OR medium = 'Trinkwasser') THEN 'DIN EN 12201-2' WHEN stoff = 'PE 100' AND (kat = 'Gasrohre' OR medium = 'Gas') THEN 'DIN EN 1555-2'
WHEN stoff = 'PVC-U' AND kat IN ('Wasserrohre', 'Druckrohre') THEN 'DIN EN ISO 1452' END AS norm,
CASE WHEN coalesce(main, 0) = 0 THEN NULL WHEN branch IS NULL OR branch = main THEN CAST(main AS VARCHAR) ELSE main || ',' || branch END AS compatible, coalesce(piece, metre) AS price,
CASE WHEN piece IS NULL AND metre IS NOT NULL THEN 'm' ELSE 'Stk' END AS unit, CASE WHEN medium IS NULL THEN 'Rohr' ELSE 'Rohr ' || medium END AS described FROM ({ARTICLES.duck()})""")
def pipe_import_rules(spark, sf):
    price = guesses.piece_or_metre(c("piece"), c("metre"))
    return articles(spark, sf).select(
        "p", guesses.guessed_norm(c("norm"), c("system"), c("stoff"), c("kat"), c("medium")).alias("norm"), guesses.compatible_dn(c("main"), c("branch")).alias("compatible"),
        price["price"].alias("price"), price["unit"].alias("unit"), guesses.with_words(F.lit("Rohr"), c("medium"), F.lit("Rohr")).alias("described"),
    )


@query("""SELECT p_partkey AS p, mm AS laenge_mm, 'Rohr ' || p_size || ' L=' || (mm // 1000) || 'm' AS artikelname, 'N-' || p_partkey || '-' || (mm // 10) AS artikel_id,
round(CAST(p_size AS DOUBLE) * (mm / 1000.0), 2) AS vk_listenpreis_netto FROM part, (VALUES (1000), (3000), (6000)) AS q(mm)""")
def generated_bars(spark, sf):
    rows = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey as p", "concat('Rohr ', p_size) as name", "cast(p_size as double) as per_metre", "concat('N-', p_partkey) as nr")
    return guesses.bars(rows, "name", "per_metre", [1000, 3000, 6000], "nr").select("p", "laenge_mm", "artikelname", "artikel_id", "vk_listenpreis_netto")


@query(f"SELECT coalesce(kategorie, 'Unbekannt') AS kategorie, count(*) AS n FROM ({ARTICLES.duck()}) GROUP BY 1")
def category_counts(spark, sf):
    return guesses.category_counts(articles(spark, sf), "kategorie", "Unbekannt")


@query(f"WITH {IMPORT_SQL} SELECT coalesce(family, '(leer)') AS family, count(*) AS n FROM i2 WHERE family IN {guesses.IMPORTED} AND article NOT IN {guesses.NOT_IMPORTED} GROUP BY 1")
def import_families(spark, sf):
    x = F.concat(c("artikelname"), F.lit(" "), F.coalesce("artikelbeschreibung", F.lit("")))
    rows = articles(spark, sf).where(guesses.is_imported(x, c("article"))).withColumn("family", guesses.family(x))
    return guesses.category_counts(rows, "family", "(leer)", most=12)
