"""Catalogue fields guessed from an article's texts, and the manufacturers' import rules.

Columns in, columns out.  Nulls: a null text is the empty text and says nothing;
repeated rows are guessed each; an empty table stays empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickline.functions.text import contains_any, first_of, if_set, normalise, spelt, text_of
from brickline.operators.matching.vocabulary import LOAD_RANK

c = F.col
#: Fixed values, first hit wins: materials in a normalised text, and in an import's text.
MATERIALS = (
    ("polymerbeton", "Polymerbeton"), ("faserbeton", "Faserbeton"), ("glasfaserbeton", "Faserbeton"), ("stahlbeton", "Stahlbeton"), ("beton", "Beton"),
    ("gusseisen", "Gusseisen"), ("guss", "Gusseisen"), ("edelstahl", "Edelstahl"), ("stahl verzinkt", "Stahl"), ("stahl", "Stahl"), ("polypropylen", "PP"),
    ("pp", "PP"), ("pvc-u", "PVC-U"), ("pvc", "PVC-U"), ("pe-hd", "PE-HD"), ("hdpe", "PE-HD"), ("kunststoff", "Kunststoff"),
)
IMPORT_MATERIALS = (
    ("faserbewehrtem beton", "Faserbeton"), ("faserbewehrter beton", "Faserbeton"), ("beton", "Beton"), ("recyceltem polypropylen", "PP"),
    ("polypropylen", "PP"), ("pe-hd", "PE-HD"), ("edelstahl", "Edelstahl"), ("aluminium", "Aluminium"), ("stahl", "Stahl"), ("guss", "Gusseisen"),
    ("kunststoff", "Kunststoff"),
)
#: Fixed values, first hit wins: systems.
SYSTEMS = (
    ("wavin green connect 2000", "Wavin Green Connect 2000"), ("green connect 2000", "Wavin Green Connect 2000"), ("wavin sx 400", "Wavin SX 400"),
    ("wavin xs 400", "Wavin SX 400"), ("sx 400", "Wavin SX 400"), ("xs 400", "Wavin SX 400"), ("wavin tegra", "Wavin Tegra"), ("tegra", "Wavin Tegra"),
    ("x-stream", "Wavin X-Stream"), ("acaro", "Wavin Acaro PP"), ("aco self", "ACO Self"), ("aco powerdrain", "ACO Powerdrain"),
    ("powerdrain", "ACO Powerdrain"), ("aco multiline", "ACO Multiline"), ("multiline", "ACO Multiline"), ("aco hexaline", "ACO Hexaline"),
    ("hexaline", "ACO Hexaline"), ("aco kerbdrain", "ACO KerbDrain"), ("kerbdrain", "ACO KerbDrain"), ("aco monoblock", "ACO Monoblock"),
    ("monoblock", "ACO Monoblock"), ("aco qmax", "ACO Qmax"), ("qmax", "ACO Qmax"), ("aco xtradrain", "ACO XtraDrain"), ("xtradrain", "ACO XtraDrain"),
    ("faserfix", "FASERFIX"), ("recyfix", "RECYFIX"), ("drainfix", "DRAINFIX"), ("steelfix", "STEELFIX"), ("kabuflex", "Kabuflex"),
)
FAMILIES = ("FASERFIX", "RECYFIX", "DRAINFIX", "STEELFIX", "DACHFIX", "SPORTFIX", "REWATEC", "AQUAFIX")
#: Families that are imported, and article types that aren't.
IMPORTED = ("FASERFIX", "RECYFIX", "DRAINFIX", "STEELFIX")
NOT_IMPORTED = ("Allgemeiner Artikel", "Randsteine", "Rasengitter", "Retentionstank", "Schrauben")
#: Fixed values, first hit wins: how parts are joined, and sealed.
JOINTS = (
    ("steckmuffe", "Steckmuffe"), ("doppelmuffe", "Doppelmuffe"), ("ueberschiebmuffe", "Überschiebmuffe"), ("flansch", "Flansch"), ("spitzende", "Spitzende"),
    ("seitlich", "seitlich"), ("senkrecht", "senkrecht"),
)
SEALS = (("lippendichtung", "Lippendichtung"), ("gleitringdichtung", "Gleitringdichtung"), ("dichtungsfalz", "Dichtungsfalz"), ("dichtung", "Dichtung"))
#: Subcategories and the words that name them in a title.
SUBCATEGORIES = (
    ("Geruchsverschluss", ("geruchsverschluss",)), ("Schmutzfangeimer", ("schmutzfangeimer", "schmutzfang", "laubfang")),
    ("Stirnwand", ("kombistirnwand", "stirnwand", "abschlussdeckel", "enddeckel", "anfangsdeckel")), ("Einlaufkasten", ("einlaufkasten",)),
    ("Sinkkasten", ("sinkkasten",)), ("Anschlusskasten", ("anschlusskasten",)), ("Hofablauf", ("hofeinlauf",)), ("Punkteinlauf", ("punkteinlauf",)),
    ("Rost", ("laengsstabrost", "langsstabrost", "stegrost", "gitterrost", "gussrost", "rost")), ("Rinnenunterteil", ("rinnenunterteil",)),
    ("Revisionsschacht", ("revisionsschacht",)), ("Schachtunterteil", ("schachtboden", "schachtunterteil")), ("Schachtrohr", ("schachtrohr",)),
    ("Schachtring", ("schachtring",)), ("Ausgleichsring", ("auflagering", "ausgleichsring")), ("Schachthals/Konus", ("schaftkonus", "konus")),
    ("Entwässerungsrinne", ("rinne",)),
)
#: Categories by subcategory; subcategories that say little; pairs in which the text's word wins.
SHAFT_PARTS = ("schachtunterteil", "schachtrohr", "schachtring", "schachthals/konus", "ausgleichsring", "revisionsschacht")
STREET_PARTS = ("einlaufkasten", "anschlusskasten", "sinkkasten", "hofablauf", "punkteinlauf")
CHANNEL_PARTS = ("rost", "stirnwand", "geruchsverschluss", "schmutzfangeimer", "rinnenunterteil", "entwaesserungsrinne")
GENERAL = ("entwaesserungsrinne", "schwerlastrinne", "rinnen", "zubehoer", "zubehör")
TEXT_WINS = (
    ("einlaufkasten", "geruchsverschluss"), ("einlaufkasten", "schmutzfangeimer"), ("einlaufkasten", "rost"), ("sinkkasten", "geruchsverschluss"),
    ("anschlusskasten", "geruchsverschluss"), ("entwaesserungsrinne", "rost"), ("entwaesserungsrinne", "stirnwand"),
    ("entwaesserungsrinne", "geruchsverschluss"),
)
#: Subcategory by article type.
ARTICLE_SUBCATEGORIES = {
    "Abdeckung": "Abdeckungen", "Abscheider Schachtmaterial": "Schachtbauteile", "DRAINFIX": "Rinnen", "DRAINFIX CLEAN RECYFIX": "Rinnen",
    "Einlaufkasten Kombiartikel": "Punkteinläufe", "Knebel": "Rinnenzubehör", "Kombiartikel": "Rinnen", "Kombiartikel Punktentwässerung": "Punkteinläufe",
    "Komplettartikel": "Rinnen", "Monolithische Rinne": "Rinnen", "Punkteinläufe": "Punkteinläufe", "RECYFIX HICAP Rinne": "Rinnen",
    "Rinnenunterteil": "Rinnenunterteile", "Rinnenzubehör": "Rinnenzubehör", "Schlitzabdeckung": "Schlitzabdeckungen",
    "Schlitzrinne monolithisch": "Schlitzrinnen", "Stichkanal": "Rinnen", "Stirnwand": "Stirnwände",
}
DN = r"(?iU)\bDN(?:/OD)?\s*(\d{2,4})\b"


def combined(name: Column, description: Column) -> Column:
    """Name and description, as far as there are any."""
    return F.concat_ws(" ", if_set(name), if_set(description))


def first_word(text: Column, words: tuple[tuple[str, str], ...]) -> Column:
    return first_of(*[(F.contains(text, F.lit(w)), label) for w, label in words])


def material(text: Column) -> Column:
    return first_word(normalise(text), MATERIALS)


def import_material(text: Column) -> Column:
    return first_word(F.lower(text_of(text)), IMPORT_MATERIALS)


def system(text: Column) -> Column:
    return first_word(normalise(text), SYSTEMS)


def family(text: Column) -> Column:
    return first_of(*[(F.contains(F.upper(text_of(text)), F.lit(f)), f) for f in FAMILIES])


def number(text: Column, *patterns: str) -> Column:
    """The number of the first pattern that the text has."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text_of(text), p, 1), F.lit("")) for p in patterns]).try_cast("int")


def nominal_dn(text: Column) -> Column:
    return number(text, DN, r"(?iU)\bNW\s*(\d{2,4})\b", r"(?iU)\bNennweite\s*(\d{2,4})\b")


def nominal_size(text: Column) -> Column:
    return number(text, r"(?iU)\bNennweite\s+(\d{2,4})\b", r"(?iU)\b(?:KS|STANDARD|PLUS|PRO|SUPER|MONOTEC|POINT|SLOT|FSU|RNC|HICAP)\s+(\d{2,4})\b", DN)


def bounded_dn(text: Column, low: int = 20, high: int = 2500) -> Column:
    """The first pattern's number that lies within the bounds."""
    patterns = (r"(?iU)\bDN\s*/\s*(?:ID|OD)\s*(\d{2,4})\b", r"(?iU)\bDN\s*(\d{2,4})\b", r"(?iU)\bNW\s*(\d{2,4})\b", r"(?iU)\bNennweite\s*(\d{2,4})\b")
    found = F.array_compact(F.array(*[number(text, p) for p in patterns]))
    return F.get(F.filter(found, lambda x: x.between(low, high)), F.lit(0))


def connection_dns(text: Column) -> Column:
    """All diameters, ascending, comma-joined; null if there are none."""
    found = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text_of(text), F.lit(DN), F.lit(1)), lambda x: x.cast("int"))))
    return F.when(F.size(found) > 0, F.array_join(F.transform(found, lambda x: x.cast("string")), ","))


def highest_load_class(text: Column) -> Column:
    """The highest of the load classes written in the text ('B 125', 'D-400')."""
    found = F.regexp_extract_all(F.upper(text_of(text)), F.lit(r"\b([A-F]\s*[-.]?\s*(?:15|125|250|400|600|900))\b"), F.lit(1))
    ranks = F.create_map(*[F.lit(x) for kv in LOAD_RANK.items() for x in kv])
    classes = F.transform(found, lambda x: F.regexp_replace(x, r"[\s.-]", ""))
    ranked = F.transform(F.filter(classes, lambda x: F.map_contains_key(ranks, x)), lambda x: F.struct(F.element_at(ranks, x).alias("r"), x.alias("c")))
    return F.array_max(ranked)["c"]


def joint(text: Column) -> Column:
    low = normalise(text)
    both = F.contains(low, F.lit("stirnseitig")) & F.contains(low, F.lit("seitlich"))
    return F.when(both, F.lit("stirnseitig/seitlich")).otherwise(first_word(low, JOINTS))


def import_joint(text: Column) -> Column:
    low = F.lower(text_of(text))
    has = lambda w: F.contains(low, F.lit(w))
    sides = ((has("stirnseitig") & F.contains(F.replace(low, F.lit("stirnseitig"), F.lit("")), F.lit("seitlich")), "stirnseitig/seitlich"), (has("stirnseitig"), "stirnseitig"))
    return first_of(*sides, (has("seitlich"), "seitlich"), (has("senkrecht"), "senkrecht"))


def seal(text: Column) -> Column:
    return first_word(normalise(text), SEALS)


def import_seal(text: Column) -> Column:
    return first_word(F.lower(text_of(text)), (("dichtungsfalz", "Dichtungsfalz"), ("mit dichtung", "Dichtung")))


def subcategory(name: Column, text: Column) -> Column:
    """The label whose word stands first in the title; else the first label with a word in the text."""
    title, low = normalise(name), normalise(text)
    places = F.array(*[
        F.when(F.contains(title, F.lit(w)), F.struct(F.instr(title, F.lit(w)).alias("at"), F.lit(i).alias("i"), F.lit(label).alias("label")))
        for i, (label, words) in enumerate(SUBCATEGORIES) for w in words
    ])
    anywhere = first_of(*[(contains_any(low, words), label) for label, words in SUBCATEGORIES])
    return F.coalesce(F.array_min(F.array_compact(places))["label"], anywhere)


def category(sub: Column) -> Column:
    low = normalise(sub)
    return first_of((low.isin(*SHAFT_PARTS), "Schachtbauteile"), (low.isin(*STREET_PARTS), "Straßenentwässerung"), (low.isin(*CHANNEL_PARTS), "Rinnen"))


def preferred_subcategory(current: Column, guessed: Column) -> Column:
    """The guess where the current value is empty, says little, or is known to be the weaker of the two."""
    a, b = normalise(current), normalise(guessed)
    wins = F.concat_ws("|", a, b).isin([f"{x}|{y}" for x, y in TEXT_WINS])
    return F.when(guessed.isNull(), current).when(if_set(current).isNull() | a.isin(*[spelt(g) for g in GENERAL]) | wins, guessed).otherwise(current)


def norms(text: Column) -> Column:
    """struct(first, second): two favourites first, then as written, each once."""
    up = F.upper(text_of(text))
    favourites = F.array(F.when(F.contains(up, F.lit("EN 1433")), F.lit("DIN EN 1433")), F.when(F.contains(up, F.lit("DIN 19580")), F.lit("DIN 19580")))
    written = F.transform(F.regexp_extract_all(up, F.lit(r"\bDIN(?:\s+EN)?\s+\d+(?:-\d+)?\b"), F.lit(0)), lambda x: F.regexp_replace(x, r"\s+", " "))
    every = F.array_distinct(F.concat(F.array_compact(favourites), written))
    return F.struct(F.get(every, F.lit(0)).alias("first"), F.get(every, F.lit(1)).alias("second"))


def guessed_norm(norm: Column, system_: Column, material_: Column, category_: Column, medium: Column) -> Column:
    """The norm that a pipe's system, material, category and medium suggest, unless one is given."""
    s, m, k, x = (F.lower(text_of(v)) for v in (system_, material_, category_, medium))
    has = lambda col, w: F.contains(col, F.lit(w))
    return F.coalesce(if_set(norm), first_of(
        (has(s, "kg") & has(m, "pvc"), "DIN EN 1401"), (has(s, "acaro") | (has(m, "pp") & has(k, "rohr")), "DIN EN 13476-2"), (has(s, "tegra"), "DIN EN 13598-2"),
        (has(s, "green connect"), "DIN EN 13476-3"), (has(m, "pe") & (has(k, "wasser") | has(x, "trinkwasser")), "DIN EN 12201-2"),
        (has(m, "pe") & (has(k, "gas") | has(x, "gas")), "DIN EN 1555-2"), (has(m, "pvc") & (has(k, "wasser") | has(k, "druck")), "DIN EN ISO 1452"),
    ))


def compatible_dn(main: Column, branch: Column) -> Column:
    """'main,branch', or 'main' where the branch is the same or unknown; zero counts as unknown."""
    a, b = F.when(main != 0, main), F.when(branch != 0, branch)
    return F.when(a.isNotNull() & b.isNotNull() & (a != b), F.concat_ws(",", a.cast("string"), b.cast("string"))).otherwise(a.cast("string"))


def article_category(article: Column) -> Column:
    return first_of(
        (article.isin("Punkteinläufe", "Einlaufkasten Kombiartikel", "Kombiartikel Punktentwässerung"), "Straßenentwässerung"),
        (article == "Abscheider Schachtmaterial", "Schachtbauteile"), (article == "Retentionstank", "Versickerung"), otherwise=F.lit("Rinnen"),
    )


def article_subcategory(article: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ARTICLE_SUBCATEGORIES.items() for x in kv]), article), article)


def price_unit(text: Column) -> Column:
    return F.when(F.contains(F.lower(text_of(text)), F.lit("meterware")), F.lit("m")).otherwise(F.lit("Stk"))


def is_imported(text: Column, article: Column) -> Column:
    """Of a family that is imported, and of no article type that isn't."""
    return F.coalesce(family(text).isin(*IMPORTED), F.lit(False)) & ~F.coalesce(article.isin(*NOT_IMPORTED), F.lit(False))


def with_words(description: Column, *words: Column) -> Column:
    """The description and those of the words that it doesn't contain; null if nothing is left."""
    out = text_of(description)
    for w in words:
        out = F.when(if_set(w).isNotNull() & ~F.contains(out, w), F.concat(out, F.lit(" "), w)).otherwise(out)
    return if_set(F.trim(out))


def piece_or_metre(piece: Column, metre: Column) -> Column:
    """struct(price, unit): the price of a piece, else that of a metre."""
    return F.struct(F.coalesce(piece, metre).alias("price"), F.when(piece.isNull() & metre.isNotNull(), F.lit("m")).otherwise(F.lit("Stk")).alias("unit"))


def bars(df: DataFrame, name: str, price_per_metre: str, lengths_mm: list[int], number_: str) -> DataFrame:
    """A row for each length of a product sold by the metre: its name, number and price."""
    each = df.withColumn("laenge_mm", F.explode(F.array(*[F.lit(x) for x in lengths_mm])))
    metres = c("laenge_mm") / 1000
    return each.withColumns({
        "artikelname": F.concat(c(name), F.lit(" L="), F.regexp_replace(F.format_string("%.2f", metres), r"\.?0+$", ""), F.lit("m")),
        "artikel_id": F.concat_ws("-", number_, (c("laenge_mm") / 10).cast("int").cast("string")), "vk_listenpreis_netto": F.round(c(price_per_metre) * metres, 2),
    })


def enriched(df: DataFrame) -> DataFrame:
    """Empty fields of articles filled by guesses from their texts, a weaker subcategory
    replaced; changed counts the fields that did.  Known values stay."""
    text = combined(c("artikelname"), c("artikelbeschreibung"))
    sub = preferred_subcategory(c("unterkategorie"), subcategory(c("artikelname"), text))
    street = normalise(sub).isin(*STREET_PARTS) & (if_set(c("kategorie")).isNull() | (c("kategorie") == "Rinnen"))
    guessed_category = category(subcategory(c("artikelname"), text))
    empty = lambda f, guess: F.coalesce(if_set(c(f).cast("string")).cast(dict(df.dtypes)[f]), guess)
    new = {
        "unterkategorie": sub, "kategorie": F.when(street & guessed_category.isNotNull(), guessed_category).otherwise(c("kategorie")),
        "system_familie": empty("system_familie", system(text)), "werkstoff": empty("werkstoff", material(text)), "nennweite_dn": F.coalesce(c("nennweite_dn"), nominal_dn(text)),
        "belastungsklasse": empty("belastungsklasse", highest_load_class(text)), "verbindungstyp": empty("verbindungstyp", joint(text)),
        "dichtungstyp": empty("dichtungstyp", seal(text)), "kompatible_dn_anschluss": empty("kompatible_dn_anschluss", connection_dns(text)),
        "kompatible_systeme": empty("kompatible_systeme", system(text)),
    }
    changed = [F.when(~x.eqNullSafe(c(f)), 1).otherwise(0) for f, x in new.items()]
    return df.withColumns({**new, "changed": sum(changed[1:], changed[0])})


def category_counts(df: DataFrame, field: str, missing: str, most: int | None = None) -> DataFrame:
    """Rows by value, the most frequent first; null has a name.  most: a top list."""
    counts = df.groupBy(F.coalesce(field, F.lit(missing)).alias(field)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), field)
    return counts if most is None else counts.limit(most)
