"""Corrections of a line's parameters after reading: contradictions between the
text and the values, values that a kind of line can't have, and the merges of
known with read values.

Columns in, columns out, in one projection chain.  Nulls: an unknown value is
never a contradiction, and a null text is the empty text; repeated rows are
corrected each; an empty table stays empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickline.functions.text import any_of, contains_any, first_of, text_of
from brickline.operators.extraction import vocabulary as v
from brickline.operators.extraction.kinds import SERVICE, as_material
from brickline.operators.extraction.parameters import found

c = F.col
#: Categories as they are to be spelt, by their spellings in lower case.
CATEGORY_SPELLINGS = {
    "kanalrohre": "Kanalrohre", "schachtabdeckungen": "Schachtabdeckungen", "schachtbauteile": "Schachtbauteile", "formstuecke": "Formstücke",
    "formstücke": "Formstücke", "strassenentwässerung": "Straßenentwässerung", "straßenentwässerung": "Straßenentwässerung",
    "strassenentwaesserung": "Straßenentwässerung", "rinnen": "Rinnen", "dichtungen & zubehoer": "Dichtungen & Zubehör",
    "dichtungen & zubehör": "Dichtungen & Zubehör", "dichtungen & zubehor": "Dichtungen & Zubehör", "geotextilien": "Geotextilien",
    "gasrohre": "Gasrohre", "wasserrohre": "Wasserrohre", "druckrohre": "Druckrohre", "kabelschutz": "Kabelschutz",
}
#: Materials without a stiffness class; materials of plastic pipes, with patterns of how a text names them.
NO_STIFFNESS = ("Beton", "Stahlbeton", "Polymerbeton", "Gusseisen", "Stahl")
PLASTICS = {
    "PP": (r"\bpp\b",), "PVC-U": (r"\bpvc\b", r"\bpvc-u\b"), "HDPE": (r"\bhdpe\b", r"\bpe-hd\b", r"\bpe\s*100\b"),
    "PE 100": (r"\bpe\s*100\b", r"\bpe-hd\b"), "PE 100 RC": (r"\bpe\s*100\b", r"\brc\b"),
}
#: Words of concrete, and of products that are plastic although they are put into concrete.
CONCRETE = ("betonfertigteil", "betonschacht", "betonrohr", "beton,")
OWN_PLASTIC = r"\bpvc-u\b|\bpvc-kg\b|\bpolyvinylchlorid\b|sanierungsstutzen|reparaturstutzen"
#: Things that are no drainage channel.
NO_CHANNEL = (
    "muldenrinne", "bordsteinrinne", "pendelrinne", "randstein", "kantenstein", "wegebekantung", "tiefbord", "pflasterstein", "betonsteinpflaster",
    "betonpflaster", "sickerpflaster", "verbundpflaster", "plattenband", "betonplatten", "betonplattenband", "hochbord",
)
SHAFTS = ("sammelschacht", "kontrollschacht", "revisionsschacht", "kontroll- und sammelschacht")
SEWER_NORMS = ("1401", "1852", "13476", "14758")
#: Articles without a nominal diameter.
NO_DIAMETER = (
    "mauerscheibe", "mauerscheiben-ecke", "stützwand", "stuetzwand", "winkelstein", "l-stein", "bordstein", "randstein", "pflasterstein", "blockstufe",
    "rinnenstein", "absenkstein", "kurvenstein",
)
#: Outer diameters that name the same size.
OUTER = {100: 110, 125: 140, 150: 160, 200: 200, 250: 250, 300: 315}
#: How a line says that the client provides the material; how it refers to the line before; verbs after an article.
CLIENT_PROVIDES = (
    r"(?i)wird\s+(?:durch|vom)\s+(?:den\s+)?AG\b.*?gestellt|ab\s+Lager\s+(?:des\s+)?AG\b|beigestellt|vom\s+AG\s+bereitgestellt|AG\s+ab\s+Lager\b.*?gestellt"
)
AS_BEFORE = r"(?i)^\s*(wie\s+zuvor|wie\s+position|wie\s+vorstehend|wie\s+vorhergehend)"
ARTICLE_VERB = (
    r"(?iU)\s+(?:liefern(?:\s+und\s+\w+)?|setzen|verlegen|herstellen|einbauen|montieren|ausfugen|verfugen|anbringen|versetzen)\b\.?\s*$"
)
#: Work by its words, and by cutting what breaks off.
WORK = (
    "kopfloch", "anschlussarbeiten", "schnittkanten", "schnitt ausklinkung", "plattendruckversuch", "lastplattendruck", "druckversuch", "regulieren",
    "höhenanpass", "hoehen", "tragschicht", "überarbeiten", "ueberarbeiten",
)
CUTTING = r"(?iU)\b(schneiden|zuschneiden|k[uü]rzen|ausklinken|nachbearbeiten)\b"
RUBBLE = r"(?i)bruchmaterial.*entsorg|bruchmaterial\s+ist"
OWN_MATERIAL = r"(?iU)\baus\s+(beton|stahlbeton|polymerbeton|kunststoff|pvc|pp\b|pe\b|gusseisen|steinzeug|naturstein)\b"
#: Parameters that a service keeps none of.
PRODUCT_FIELDS = (
    "product_category", "product_subcategory", "material", "nominal_diameter_dn", "secondary_nominal_diameter_dn", "load_class", "norm", "dimensions",
    "reference_product", "installation_area", "system_family", "connection_type", "seal_type", "stiffness_class_sn",
)


def holds(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def refers_to_previous(description: Column, raw: Column) -> Column:
    """The line's text begins with words like 'as before'."""
    return F.trim(F.concat(text_of(description), F.lit("\n"), text_of(raw))).rlike(AS_BEFORE)


def article_type(article: Column, kind: Column) -> Column:
    """The article, for material without a verb of laying at its end; null if empty."""
    clean = F.trim(article)
    bare = F.trim(F.regexp_replace(clean, ARTICLE_VERB, ""))
    return F.when(clean == "", None).when((kind == "material") & (bare != ""), bare).otherwise(clean)


def new_features(features: Column, specs: Column) -> Column:
    """Features that the further specifications don't repeat in other letters."""
    key = lambda x: F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "")
    known = F.transform(F.coalesce(specs, F.array().cast("array<string>")), key)
    return F.filter(features, lambda x: ~F.array_contains(known, key(x)))


def corrected(df: DataFrame, known_material: str = "known_material") -> DataFrame:
    """df with its parameters corrected.  Every rule reads the values as they come,
    but for the two diameters; known_material is the material before reading."""
    text = F.lower(F.concat(text_of("description"), F.lit("\n"), text_of("raw_text")))
    category, material, article = c("product_category"), c("material"), F.lower(text_of("article_type"))
    has = lambda *words: contains_any(text, words)
    spelt = F.element_at(F.create_map(*[F.lit(x) for kv in CATEGORY_SPELLINGS.items() for x in kv]), F.lower(category))
    no_channel = holds(category == "Rinnen") & has(*NO_CHANNEL)
    shaft = holds(category == "Kanalrohre") & has(*SHAFTS)
    conduit = holds(category == "Kabelschutz") & contains_any(F.lower(text_of("norm")), SEWER_NORMS)
    drain = holds(category == "Straßenentwässerung")

    named_sn = found(text, r"material[:\s]+\w+\s+sn\s*(\d+)").try_cast("int")
    last_sn = F.get(F.reverse(F.regexp_extract_all(text, F.lit(r"\bpp\s+sn\s*(\d+)"), F.lit(1))), F.lit(0)).try_cast("int")
    sn = F.when(c("stiffness_class_sn").isNotNull(), F.coalesce(named_sn, last_sn, c("stiffness_class_sn")))

    plastic = holds(material.isin(*PLASTICS))
    named = any_of(holds(material == m) & any_of(text.rlike(f"(?U){p}") for p in ps) for m, ps in PLASTICS.items())
    invented = plastic & has(*v.NOT_IN_CATALOGUE) & ~named
    generic = plastic & (F.lower(F.trim(text_of(known_material))) == "kunststoff")
    concrete = plastic & has(*CONCRETE) & ~text.rlike(f"(?U){OWN_PLASTIC}")

    no_diameter = contains_any(article, NO_DIAMETER)
    dn, second = c("nominal_diameter_dn"), c("secondary_nominal_diameter_dn")
    lost = (drain & has("aufsatz") & holds(dn != 0) & ~has("abfluss")) | holds(c("position_type") == SERVICE) | no_diameter
    new_dn, new_second = F.when(~lost, dn), F.when(~no_diameter, second)
    outer = F.element_at(F.create_map(*[F.lit(x) for kv in OUTER.items() for x in kv]), new_dn)
    same = holds(new_dn == new_second) | holds(outer == new_second)

    label = r"(?i)norm[:\s]+((?:DIN|EN|ISO)(?:\s+EN)?(?:\s+ISO)?\s*\d+(?:-\d+)?(?:\s+Typ\s+\d+)?)"
    labelled = F.regexp_replace(F.trim(found(text_of("raw_text"), label)), r"\s+", " ")
    valve = contains_any(article, ("klappe", "schieber")) & contains_any(F.lower(text_of("raw_text")), v.CONNECTS_TO)
    sized = found(text, r"\d{3,4}\s*/\s*\d{3,4}\s*mm", 0)
    return df.withColumns({
        "product_category": first_of((no_channel, None), (shaft, "Schachtbauteile"), (conduit, "Kanalrohre"), otherwise=F.coalesce(spelt, category)),
        "product_subcategory": F.when(~(no_channel | shaft | conduit), c("product_subcategory")),
        "stiffness_class_sn": F.when(~holds(material.isin(*NO_STIFFNESS)), sn),
        "material": first_of((invented, None), (generic, "Kunststoff"), (concrete, "Beton"), otherwise=material),
        "dimensions": F.when(drain & c("dimensions").isNull(), sized).otherwise(c("dimensions")),
        "load_class": F.replace(c("load_class"), F.lit(" "), F.lit("")),
        "nominal_diameter_dn": new_dn, "secondary_nominal_diameter_dn": F.when(~same, new_second),
        "norm": F.coalesce(labelled, c("norm")),
        "system_family": F.when(~(valve & holds(c("system_family").isin(*v.NOT_WHERE_CONNECTING))), c("system_family")),
    })


def is_work(description: Column, raw: Column) -> Column:
    """A line of material that is work by its words, unless a diameter or load class is named."""
    text = F.lower(F.concat(text_of(description), F.lit("\n"), text_of(raw)))
    product = text_of(raw).rlike(v.DN) | contains_any(text, [x.lower() for x in v.LOAD_CLASSES])
    cutting = text.rlike(CUTTING) & text.rlike(RUBBLE) & ~text.rlike(OWN_MATERIAL)
    return ~product & (text.rlike(r"(?U)^\s*zulage\b") | cutting | contains_any(text, WORK))


def post_processed(df: DataFrame) -> DataFrame:
    """Lines after parsing: material that the client provides, or that is work, becomes a
    service without product values; a service that supplies a product becomes material;
    material loses categories that don't exist and is corrected."""
    client = text_of("description").rlike(CLIENT_PROVIDES)
    service = holds(c("position_type") == "material") & (client | is_work(c("description"), c("raw_text")))
    cleared = {f: F.when(~service, c(f)) for f in PRODUCT_FIELDS if f in df.columns}
    df = df.withColumns(cleared | {
        "billable": F.when(service, F.lit(False)).otherwise(c("billable")),
        "position_type": F.when(service, F.lit(SERVICE)).otherwise(c("position_type")),
    })
    df = df.withColumn("position_type", as_material(c("description"), c("raw_text"), c("position_type")))
    own = holds(c("position_type") == SERVICE)
    known = F.lower(c("product_category")).isin([k for k in CATEGORY_SPELLINGS if k not in ("straßenentwässerung", "dichtungen & zubehor")])
    valid = df.withColumn("product_category", F.when(own | known, c("product_category")))
    changed = [f for f in PRODUCT_FIELDS if f in df.columns]
    # services stay as they are
    kept = valid.select("*", *[c(f).alias(f"before_{f}") for f in changed])
    both = corrected(kept)
    return both.withColumns({f: F.when(own, c(f"before_{f}")).otherwise(c(f)) for f in changed}).drop(*[f"before_{f}" for f in changed])


def backfilled(df: DataFrame, fields: list[str], read: str = "read_") -> DataFrame:
    """Known values stay and unknown ones come from the columns read_<field>; lines that
    refer to the one before take what was read instead.  A subcategory is taken over only
    where the categories agree."""
    reference = refers_to_previous(c("description"), c("raw_text"))
    known, seen = c("product_category"), c(f"{read}product_category")
    apart = holds((known != "") & (seen != "") & (known != seen))
    out = {}
    for f in fields:
        value, own = c(f"{read}{f}"), c(f)
        if dict(df.dtypes)[f] == "string":
            value = F.when(value != "", value)
        filled = F.coalesce(own, F.when(~apart, value) if f == "product_subcategory" else value)
        out[f] = F.when(reference & value.isNotNull(), value).otherwise(F.when(reference, own).otherwise(filled))
    return df.withColumns(out)
