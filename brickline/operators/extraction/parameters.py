"""From a line's free text to its technical parameters, as columns.

Each field is one expression over the lower-cased text or the raw text; what the
text doesn't say is taken from a column of the field's name, if there is one.
Everything stays in one projection chain: no shuffle, no Python in tasks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickline.functions.text import any_of, contains_any, first_of, text_of
from brickline.operators.extraction import vocabulary as v

#: Fields and their types, as parameters() sets them.
FIELDS = {
    "product_category": "string", "product_subcategory": "string", "material": "string", "nominal_diameter_dn": "int",
    "secondary_nominal_diameter_dn": "int", "load_class": "string", "norm": "string", "dimensions": "string", "reference_product": "string",
    "installation_area": "string", "pipe_length_mm": "int", "angle_deg": "int", "application_area": "string", "system_family": "string",
    "connection_type": "string", "seal_type": "string", "compatible_systems": "array<string>", "sortiment_relevant": "boolean",
}
c = F.col


def word(text: Column, pattern: str) -> Column:
    """The pattern as whole words, whatever the letters."""
    return text.rlike(rf"(?iU)\b(?:{pattern})\b")


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def whole_number(written: Column) -> Column:
    """'1.000' -> 1000."""
    return F.replace(written, F.lit("."), F.lit("")).try_cast("int")


def by_substring(text: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    return first_of(*[(F.contains(text, F.lit(k)), value) for k, value in pairs])


def by_word(text: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    return first_of(*[(word(text, k), value) for k, value in pairs])


def is_service(text: Column, raw: Column) -> Column:
    """A service word, and neither a diameter nor a load class."""
    product = raw.rlike(v.DN) | contains_any(text, [x.lower() for x in v.LOAD_CLASSES])
    return contains_any(text, v.SERVICES) & ~product


def category_place(text: Column) -> Column:
    """Place in CATEGORIES of the first keyword in the text (channels only if the text isn't about paving)."""
    paving = contains_any(text, v.NO_CHANNELS)
    hit = lambda k, kind: word(text, k.replace("-", r"\-")) & (~paving if kind == "Rinnen" else F.lit(True))
    return first_of(*[(hit(k, kind), i) for i, (k, kind, _) in enumerate(v.CATEGORIES)])


def material(text: Column) -> Column:
    return F.coalesce(by_substring(text, v.MATERIALS), by_word(text, v.MATERIAL_WORDS))


def system_family(text: Column) -> Column:
    """The first system named; three families aren't meant where the text says what it connects to."""
    connecting = contains_any(text, v.CONNECTS_TO)
    named = lambda k: text.rlike(rf"(?<![a-z0-9-])\Q{k}\E(?![a-z0-9-])")
    return first_of(*[(named(k) & ~connecting if f in v.NOT_WHERE_CONNECTING else named(k), f) for k, f in v.SYSTEMS])


def compatible_systems(text: Column) -> Column:
    hits = F.array_compact(F.array(*[F.when(word(text, k), F.lit(label)) for k, label in v.COMPATIBLE]))
    return F.when(F.size(hits) > 0, hits)


def branch_dn(text: Column, category: Column, subcategory: Column) -> Column:
    """The second diameter: of a pair, of a connection, or of what is connected to."""
    kinds = F.lower(F.concat_ws("\n", category, subcategory))
    branching = contains_any(kinds, v.BRANCHING_KINDS) | contains_any(text, v.BRANCHING_TEXTS)
    pair, connected = found(text, v.BRANCH_DN, 2), found(text, v.CONNECTED_DN)
    return F.coalesce(F.when(branching, pair), found(text, v.CONNECTION_SIZE), F.when(branching, connected)).cast("int")


def structure_dn(text: Column) -> Column:
    """A shaft's diameter where it is named, else the first measure of 300 mm or more."""
    sizes = F.transform(F.regexp_extract_all(text, F.lit(v.LARGE_DN), F.lit(0)), lambda x: F.regexp_replace(x, "[^0-9]", "").cast("int"))
    return F.coalesce(whole_number(found(text, v.SHAFT_DN)), F.get(F.filter(sizes, lambda x: x >= 300), F.lit(0)))


def parameters(df: DataFrame, description: str = "description", raw: str = "raw_text") -> DataFrame:
    """df with the columns of FIELDS set, and low_text, structure_dn and is_service beside them.

    Nulls: a null text is the empty text, so the known values remain.  The order
    of rows doesn't matter; repeated rows are read each."""
    known = {f: (c(f) if f in df.columns else F.lit(None)).cast(kind) for f, kind in FIELDS.items()}
    source = text_of(raw)
    read = df.withColumn("low_text", F.lower(F.concat(text_of(description), F.lit("\n"), source)))
    t = c("low_text")
    read = read.withColumns({"is_service": is_service(t, source), "structure_dn": structure_dn(t)})
    product = ~c("is_service")
    read = read.withColumns({"category_place": F.when(product, category_place(t)), "text_norm": F.upper(found(source, v.NORM))})
    place = c("category_place")
    kinds = F.array(*[F.lit(k) for _, k, _ in v.CATEGORIES])
    subkinds = F.array(*[F.lit(s).cast("string") for _, _, s in v.CATEGORIES])
    length = found(source, v.LENGTH).try_cast("int")
    read = read.withColumns({
        "found_subcategory": F.coalesce(F.get(subkinds, place), known["product_subcategory"]),
        "product_category": F.coalesce(F.get(kinds, place), known["product_category"]),
        "material": F.coalesce(F.when(product, material(t)), known["material"]),
        "found_dn": F.coalesce(whole_number(found(source, v.DN)), known["nominal_diameter_dn"]),
        "load_class": F.coalesce(by_substring(t, [(x.lower(), x) for x in v.LOAD_CLASSES]), known["load_class"]),
        "norm": F.coalesce("text_norm", known["norm"]),
        "dimensions": F.coalesce(found(source, v.DIMENSIONS, 0), known["dimensions"]),
        "known_reference": known["reference_product"],
        "reference_product": F.coalesce(by_substring(t, [(x.lower(), x) for x in v.REFERENCES]), known["reference_product"]),
        "installation_area": F.coalesce(
            first_of((F.contains(t, F.lit("fahrbahn")), "Fahrbahn"), (F.contains(t, F.lit("gehweg")), "Gehweg"), (contains_any(t, ("erdeinbau", "kanal")), "Erdeinbau")),
            known["installation_area"],
        ),
        "pipe_length_mm": F.coalesce(F.when(F.lower(F.regexp_extract(source, v.LENGTH, 2)) == "mm", length).otherwise(length * 1000), known["pipe_length_mm"]),
        "angle_deg": F.coalesce(found(source, v.ANGLE).try_cast("int"), known["angle_deg"]),
        "application_area": F.coalesce(by_substring(t, v.APPLICATIONS), known["application_area"]),
        "connection_type": F.coalesce(by_word(t, v.CONNECTIONS), known["connection_type"]),
        "seal_type": F.coalesce(by_word(t, v.SEALS), known["seal_type"]),
        "compatible_systems": F.coalesce(compatible_systems(t), known["compatible_systems"]),
    })
    concrete = (c("product_category") == "Kanalrohre") & (c("material").isin("Beton", "Stahlbeton") | (c("text_norm") == "DIN EN 1916"))
    read = read.withColumns({
        "product_subcategory": F.when(concrete, F.lit("Betonrohre")).otherwise(c("found_subcategory")),
        "system_family": F.coalesce(system_family(t), system_family(F.lower("reference_product")), known["system_family"]),
        # a shaft's own diameter goes before the first one in the text
        "nominal_diameter_dn": F.when(c("product_category") == "Schachtbauteile", F.coalesce("structure_dn", "found_dn")).otherwise(c("found_dn")),
        "sortiment_relevant": first_of(
            (c("is_service"), False), (c("product_category").isin(*v.COVERED), True), (contains_any(t, v.NOT_IN_CATALOGUE), False)
        ),
    })
    read = read.withColumn(
        "secondary_nominal_diameter_dn", F.coalesce(branch_dn(t, c("product_category"), c("product_subcategory")), known["secondary_nominal_diameter_dn"])
    )
    return read.drop("category_place", "text_norm", "found_subcategory", "found_dn")


def _part(name: str, when: Column, kind: str, subkind: str, described: Column | None = None, **fields: Column) -> Column:
    """A part where `when` holds: a struct of the component fields, else null."""
    kinds = {"dn": "int", "secondary_dn": "int", "quantity": "int", "material": "string", "system_family": "string", "load_class": "string", "dimensions": "string", "connection_type": "string"}
    values = {"quantity": F.lit(1)} | fields
    cells = [values.get(f, F.lit(None)).cast(kind_).alias(f) for f, kind_ in kinds.items()]
    own = F.lit(name) if described is None else described
    return F.when(
        when,
        F.struct(F.lit(name).alias("component_name"), own.alias("description"), F.lit(kind).alias("product_category"), F.lit(subkind).alias("product_subcategory"), *cells, c("installation_area")),
    )


def _said(*pieces: Column | str) -> Column:
    """The pieces one after the other; an unknown one leaves its blank."""
    cells = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in pieces]
    return F.trim(F.concat_ws(" ", *cells))


def component_parts(df: DataFrame) -> DataFrame:
    """df (from parameters()) with components: the parts that a shaft, gully, channel or inlet box needs.

    Null where there are fewer than two different parts."""
    t = c("low_text")
    has = lambda *words: contains_any(t, words)
    dn, branch, size = c("nominal_diameter_dn"), c("secondary_nominal_diameter_dn"), c("structure_dn")
    large = F.coalesce(size, dn)
    own = {"material": c("material"), "system_family": c("system_family")}
    klass, dims = c("load_class"), c("dimensions")
    concrete = (
        F.coalesce(c("product_subcategory") == "Betonschacht", F.lit(False)) | has("betonschacht")
        | (has("entwaesserungsschacht", "entwässerungsschacht") & (F.coalesce(c("material").isin("Beton", "Stahlbeton"), F.lit(False)) | has("beton")))
    )
    plastic = any_of([F.coalesce(x, F.lit(False)) for x in (c("product_subcategory") == "Kunststoffschacht", F.lower(F.trim(c("system_family"))) == "awaschacht")]) | has("kunststoffschacht")
    shaft = has("revisionsschacht", "revischacht", "rev.-schacht") | concrete | plastic
    shaft_dn = F.coalesce(dn, size)
    cover_dn = F.when(has("625"), F.lit(625)).otherwise(large)
    deep = has("schachttiefe", "schachthöhe", "schachthoehe", "einbautiefe", "tiefe")
    rings = F.coalesce(found(t, v.RING_COUNT).try_cast("int"), F.lit(1))
    parts = [
        _part("Schachtunterteil", shaft & (has("unterteil", "boden") | large.isNotNull()), "Schachtbauteile", "Schachtunterteil", _said("Schachtunterteil DN", shaft_dn, c("system_family")), dn=shaft_dn, secondary_dn=branch, connection_type=c("connection_type"), **own),
        _part("Schachtring", shaft & ((has("schachtring") & ~plastic) | concrete), "Schachtbauteile", "Schachtring", _said("Schachtring DN", shaft_dn), dn=shaft_dn, quantity=rings, **own),
        _part("Schachtrohr", shaft & (has("schachtrohr") | (plastic & large.isNotNull()) | (deep & plastic & large.isNotNull())), "Schachtbauteile", "Schachtrohr", _said("Schachtrohr DN", shaft_dn, c("system_family")), dn=shaft_dn, **own),
        _part("Konus", shaft & ~plastic & (has("konus", "schachthals") | concrete), "Schachtbauteile", "Schachthals/Konus", _said("Konus DN", shaft_dn, dims), dn=shaft_dn, dimensions=dims, **own),
        _part("Schachtfutter", shaft & has("schachtfutter"), "Schachtbauteile", "Schachtfutter", _said("Schachtfutter", c("system_family")), dn=branch, system_family=c("system_family")),
        _part("Abdeckung", shaft & has("deckel", "abdeckung", "rahmen d400", "lichte weite"), "Schachtabdeckungen", "Abdeckung", _said("Abdeckung", klass, "DN", cover_dn), dn=cover_dn, material=F.when(has("guss"), F.lit("Gusseisen")), system_family=c("system_family"), load_class=klass),
    ]
    gully = has("ablaufkombination") | (has("bestehend aus") & has("aufsatz") & has("boden"))
    bucket = F.when(has("verzinkt"), F.lit("Stahl"))
    street = "Straßenentwässerung"
    parts += [
        _part("Aufsatz", gully & has("aufsatz"), street, "Straßenablauf", _said("Aufsatz", dims, klass, c("known_reference")), dn=large, material=c("material"), load_class=klass, dimensions=dims),
        _part("Ring", gully & has("ring"), "Schachtbauteile", "Schachtring", _said("Ring DN", large), dn=large, material=c("material")),
        _part("Schaftkonus", gully & has("konus"), "Schachtbauteile", "Schachthals/Konus", _said("Schaftkonus DN", large), dn=large, material=c("material")),
        _part("Boden", gully & has("boden"), street, "Straßenablauf", _said("Boden mit Anschluss DN", branch), dn=large, secondary_dn=branch, material=c("material"), load_class=klass),
        _part("Eimer", gully & has("eimer"), street, "Schmutzfangeimer", F.lit("Schmutzfangeimer"), material=bucket),
    ]
    top = has("straßenablauf", "strassenablauf") & has("aufsatz") & ~gully
    channel = has("entwässerungsrinne", "entwaesserungsrinne", "powerdrain", "multiline") & has("einlaufkasten", "rost", "stirnwand", "stirnwänden", "stirnwaenden")
    channel_system = F.coalesce("system_family", "known_reference")
    box = has("einlaufkasten", "anschlusskasten", "sinkkasten", "schlammfangkasten")
    system = {"system_family": c("system_family")}
    parts += [
        _part("Aufsatz", top, street, "Straßenablauf", _said("Aufsatz", dims, klass), material=c("material"), load_class=klass, dimensions=dims),
        _part("Schmutzfangeimer", top & has("eimer"), street, "Schmutzfangeimer", material=bucket),
        _part("Rinne", channel, "Rinnen", "Entwässerungsrinne", _said("Entwässerungsrinne DN", dn, klass, channel_system), dn=dn, material=c("material"), system_family=channel_system, load_class=klass),
        _part("Einlaufkasten", box, street, "Einlaufkasten", _said("Einlaufkasten DN", F.coalesce(dn, branch), klass), dn=F.coalesce(dn, branch), load_class=klass, dimensions=dims, **system),
        _part("Schmutzfangeimer", box & has("eimer", "schlammfang"), street, "Schmutzfangeimer", material=bucket, **system),
        _part("Geruchsverschluss", box & has("geruchsverschluss"), street, "Hofablauf", _said("Geruchsverschluss DN", F.coalesce(branch, dn)), dn=F.coalesce(branch, dn), **system),
        _part("Rost", box & has("rost"), "Rinnen", "Rost", _said("Rost", dims, klass), dn=dn, load_class=klass, dimensions=dims, **system),
        _part("Stirnwand", box & has("stirnwand", "stirnwänden", "stirnwaenden"), "Rinnen", "Stirnwand", dn=dn, **system),
    ]
    with_all = df.withColumn("every_part", F.array_compact(F.array(*parts)))
    key = lambda x: F.struct(x["component_name"], x["product_subcategory"], x["dn"], x["system_family"])
    keys = F.transform("every_part", key)
    fresh = F.filter("every_part", lambda x, i: F.array_position(keys, key(x)) == i + 1)
    return with_all.withColumn("components", F.when(F.size(fresh) > 1, fresh)).drop("every_part")
