"""What a line is called: titles, details and labels from its text and parameters.

Columns and arrays in, columns out.  Nulls: a null text is the empty text; repeated
rows are described each; an empty table stays empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickline.functions.session import materialised
from brickline.functions.text import any_of, if_set, text_of

c = F.col
#: Metadata lines; what makes a line technical; lines that say nothing of the product.
QUANTITY = r"(?i)^\s*[\d.,]+\s+(Stück|Stck|Stk|St|m2|m²|m3|m³|m|lfm|lfdm|lfd\.m|kg|to|t|h|Std|StD|Psch|psch|Pausch|Wo|mWo|cbm)(?![\p{L}\p{N}_])"
METADATA = r"(?i)^\s*(STLNr\.?|STLB|Leit-?Pos|Pos\.?\s*-?Nr|OZ\s*:|Übertrag|Uebertrag|Seite\s+\d+|EVENTUALPOSITION|BEDARFSPOSITION)"
TECHNICAL = (
    r"(?iU)(dn\s*\d+|sn\s*\d+|din|d[0-9]{3}|[0-9]+\s*(mm|cm|m)\b|[0-9]+\s*/\s*[0-9]+|[0-9]+\s*x\s*[0-9]+|beton|stahlbeton|pp\b|pvc|pe\b|pe-?hd|steinzeug|"
    r"polymerbeton|naturstein|basalt|dr[aä]nmatte|richtzeichnung|radius|typ\s+[a-z0-9]+|[0-9]+\s*-\s*zeilig|[0-9]+\s*zeilig|muldenrinne|pultform|kugelgelenk)"
)
GENERIC = r"(?i)(nach unterlagen des ag|liefern und einbauen|fachgerecht herstellen|abgerechnet wird|bauwerken nach|herstellen\.$)"
LABELLED = (
    r"(?i)^(abmessungen|maße|masse|material|klasse|belastungsklasse|dicke|stärke|breite|höhe|länge|farbton|farbe|typ|anschlussrohr|ablauf|einlaufkasten|"
    r"stichmaß|stichmass|fundament|bettung|gummiauflage|schlammeimer|filtersack)\s*:?\s+(.+)$"
)
SIGNALS = (
    r"(?iU)\b(adapterring|ausgleichsring|rahmen|selbstnivell|unterfütter|unterfuetter|einwalz|mörtel|moertel|mg\s*[ivx]+|beton\s*c\s*\d{1,2}\s*/\s*\d{1,2}|"
    r"rückenstütze|rueckenstuetze|fundament|bettung|nassschnitt|entsorg|abdicht|schmutzfänger|schmutzfaenger)\b"
)
LABEL_START = (
    r"(?i)^(?:Abmessung(?:en)?|Ausf[uü]hrung|Farb[et]|Fundament|Bettung|R[uü]ckenst[uü]tze|Kurvenradien|Typ|Klasse|Norm|Anschluss|Material|Form\s+[A-Z])"
)
#: Names by subcategory, then by category.
BY_SUBCATEGORY = {
    "rohr": "Rohr", "kanalrohr": "Abwasserkanal", "bogen": "Rohrbogen", "abzweig": "Abzweig", "reduzierstück": "Reduzierstück",
    "reduzierstueck": "Reduzierstück", "muffe": "Muffe", "muffenstopfen": "Muffenstopfen", "revisionsstück": "Reinigungsrohr",
    "revisionsstueck": "Reinigungsrohr", "revisionsschacht": "Entwässerungsschacht", "schachtunterteil": "Schachtunterteil", "schachtring": "Schachtring",
    "konus": "Schachtkonus", "ausgleichsring": "Ausgleichsring", "schachtfutter": "Schachtfutter", "ablauf": "Straßenablauf", "aufsatz": "Aufsatz",
    "einlaufkasten": "Einlaufkasten", "rinne": "Entwässerungsrinne", "abdeckung": "Schachtabdeckung", "anschlusssystem": "Anschlusssystem",
    "dränschicht": "Dränschicht", "dränmatte": "Dränschicht", "dränrohr": "Dränrohr",
}
BY_CATEGORY = {
    "kanalrohre": "Abwasserkanal", "schachtabdeckungen": "Schachtabdeckung", "schachtbauteile": "Schachtbauteil", "formstuecke": "Formteil",
    "formstücke": "Formteil", "straßenentwässerung": "Straßenentwässerung", "strassenentwässerung": "Straßenentwässerung",
    "strassenentwaesserung": "Straßenentwässerung", "rinnen": "Entwässerungsrinne", "dichtungen & zubehoer": "Zubehör", "dichtungen & zubehör": "Zubehör",
    "geotextilien": "Geotextil", "gasrohre": "Gasrohr", "wasserrohre": "Wasserrohr", "druckrohre": "Druckrohr", "kabelschutz": "Kabelschutzrohr",
}


def word_map(words: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in words.items() for x in kv])


def squeezed(text: Column) -> Column:
    """White space to single blanks, without blanks, commas and semicolons around it."""
    return F.btrim(F.regexp_replace(text_of(text), r"\s+", " "), F.lit(" ,;"))


def paragraphs(text: Column) -> Column:
    """Lines joined where a sentence goes on: not after a sentence's end, a blank line, or
    before a label."""
    lines = F.transform(F.split(text_of(text), "\n"), lambda x: F.trim(x))

    def step(done: Column, line: Column) -> Column:
        last = F.coalesce(F.get(done, F.size(done) - 1), F.lit(""))
        going = (last != "") & (line != "") & ~last.rlike(r"[.;:!?]$") & ~line.rlike(LABEL_START)
        longer = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat_ws(" ", last, line)))
        return F.when(going, longer).otherwise(F.concat(done, F.array(line)))

    none = F.array().cast("array<string>")
    joined = F.aggregate(lines, none, lambda done, x: step(done, x))
    return F.when(text_of(text) == "", none).otherwise(F.filter(joined, lambda x: x != ""))


def clean_fragment(text: Column) -> Column:
    """A line with the blanks that a page's setting left taken out: before marks, in numbers,
    after DN and SN."""
    out = squeezed(text)
    for pattern, new in ((r"\s+([,.;:/])", "$1"), (r"(?<=\d)\s+(?=\d)", ""), (r"(?i)(?<=\bDN)\s+(?=\d)", ""), (r"(?i)(?<=\bSN)\s+(?=\d)", ""), (r"(?i)\b([0-9]+)\s*-\s*zeilig\b", "$1-zeilig")):
        out = F.regexp_replace(out, pattern, new)
    return out


def usable_lines(text: Column, most: int = 12) -> Column:
    """The first paragraphs that are no metadata and no quantity, cleaned, none inside another."""
    lines = F.slice(F.filter(paragraphs(text), lambda x: ~x.rlike(METADATA) & ~x.rlike(QUANTITY)), 1, most)

    def step(done: Column, line: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        inside = F.exists(done, lambda x: F.contains(x, line) | F.contains(line, x))
        fuller = (F.length(line) > F.length(last)) & (F.startswith(line, last) | F.startswith(last, line))
        replaced = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(line))
        return F.when(~inside, F.concat(done, F.array(line))).when(F.coalesce(fuller, F.lit(False)), replaced).otherwise(done)

    return F.aggregate(F.transform(lines, clean_fragment), F.array().cast("array<string>"), lambda done, x: step(done, x))


def derived_title(text: Column, fallback: Column, most: int = 800) -> Column:
    """The first usable line and up to two technical ones after it."""
    lines = usable_lines(text)
    title = F.get(lines, F.lit(0))
    low = F.lower(title)
    apart = lambda x: ~F.contains(low, F.lower(x)) & ~F.contains(F.lower(x), low)
    details = F.slice(F.filter(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: ~x.rlike(GENERIC) & x.rlike(TECHNICAL) & apart(x)), 1, 2)
    whole = F.when(F.size(details) > 0, F.concat(title, F.lit(", "), F.array_join(details, ", "))).otherwise(title)
    said = F.coalesce(whole, if_set(fallback), F.trim(text_of(text)))
    return F.substring(F.when(text_of(text) == "", F.coalesce(if_set(fallback), F.lit(""))).otherwise(said), 1, most)


def is_poor_title(value: Column) -> Column:
    """Empty, metadata, or only a reference to another line."""
    plain = F.trim(text_of(value))
    low = F.lower(plain)
    return (plain == "") | plain.rlike(METADATA) | any_of(F.startswith(low, F.lit(x)) for x in ("wie zuvor", "wie position", "übertrag"))


def human_label(category: Column, subcategory: Column) -> Column:
    """A name by the subcategory, else by the category, else null."""
    low = lambda x: F.lower(F.trim(text_of(x)))
    return F.coalesce(F.element_at(word_map(BY_SUBCATEGORY), low(subcategory)), F.element_at(word_map(BY_CATEGORY), low(category)))


def canonical(text: Column) -> Column:
    """Without a label before a colon, lower case, letters and digits only."""
    bare = F.trim(F.regexp_replace(text, r"^[A-Za-zÄÖÜäöüß /+-]+:\s*", ""))
    return F.regexp_replace(F.lower(bare), r"[^a-z0-9äöüß]+", "")


def with_new_details(details: Column, more: Column, title: Column) -> Column:
    """details and those of more (array) that neither the title nor a detail says already.

    What a value or the title is compared by is computed once, not for each comparison."""
    entry = lambda x: F.struct(x.alias("own"), F.lower(x).alias("low"), canonical(x).alias("plain"))

    def step(said: Column):
        def one(done: Column, x: Column) -> Column:
            known = (x["own"] == "") | F.contains(said["low"], x["low"]) | F.contains(said["plain"], x["plain"])
            again = F.exists(done, lambda y: y["plain"] == x["plain"])
            return F.when(F.coalesce(known | again, F.lit(True)), done).otherwise(F.concat(done, F.array(x)))

        return one

    new = F.transform(F.transform(F.filter(more, lambda x: x.isNotNull()), squeezed), entry)
    said = F.array(F.struct(F.lower(title).alias("low"), canonical(title).alias("plain")))
    start = F.transform(details, entry)
    all_ = F.get(F.transform(said, lambda t: F.aggregate(new, start, step(t))), F.lit(0))
    return F.transform(all_, lambda x: x["own"])


def signal_details(text: Column, title: Column, most: int = 3) -> Column:
    """Labelled and installation details of the paragraphs after the first."""
    low = F.lower(squeezed(title))
    every = paragraphs(text)
    lines = F.filter(F.slice(every, F.lit(2), F.greatest(F.size(every) - 1, F.lit(0))), lambda x: ~x.rlike(METADATA) & ~x.rlike(QUANTITY))
    clean = F.filter(
        F.transform(lines, lambda x: F.regexp_replace(squeezed(x), r"\s+([,.;:/])", "$1")),
        lambda x: (x != "") & ~F.contains(low, F.lower(x)) & ~F.contains(F.lower(x), low),
    )

    def detail(x: Column) -> Column:
        label, value = F.regexp_extract(x, LABELLED, 1), F.regexp_extract(x, LABELLED, 2)
        parts = F.filter(F.transform(F.split(x, ","), lambda y: F.trim(y)), lambda y: y != "")
        first = F.lower(F.get(parts, F.lit(0)))
        shorter = (F.size(parts) > 1) & (F.contains(low, first) | F.contains(first, low))
        rest = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), ", ")
        return F.when(label != "", F.concat(F.trim(label), F.lit(": "), F.trim(value))).when(x.rlike(SIGNALS), F.when(shorter, rest).otherwise(x))

    none = F.array().cast("array<string>")
    return F.when(F.size(every) < 2, none).otherwise(F.slice(with_new_details(none, F.transform(clean, detail), title), 1, most))


def display_title(description: Column, raw: Column, category: Column, subcategory: Column, previous: Column | None = None) -> Column:
    """The description; where it is poor, what the text says; where that is poor too, the
    line before's title or a name by category."""
    own = squeezed(description)
    title = F.when(~is_poor_title(own), own).otherwise(derived_title(raw, description))
    before = F.trim(F.get(F.split(previous, ","), F.lit(0))) if previous is not None else F.lit(None).cast("string")
    better = F.coalesce(F.when(~is_poor_title(previous), before) if previous is not None else before, human_label(category, subcategory))
    title = squeezed(F.when(is_poor_title(title), F.coalesce(better, title)).otherwise(title))
    return F.when(title != "", title).otherwise(F.coalesce(if_set(own), F.lit("Position")))


def display_description(title: Column, raw: Column, fields: dict[str, Column], most: int = 320) -> Column:
    """Title with details: of the text first, then diameters, material, stiffness, norm, load
    class, dimensions, system and reference product (fields by these names)."""
    dn, second = fields["dn"], fields["second_dn"]
    size = F.when(second.isNotNull() & dn.isNotNull(), F.format_string("DN %d/%d", dn, second)).when(dn.isNotNull(), F.format_string("DN %d", dn))
    example = F.when(~F.contains(F.lower(title), F.lit("z. b.")), F.concat(F.lit("z. B. "), if_set(fields["reference"])))
    more = F.array(
        size, if_set(fields["material"]), F.when(fields["sn"].isNotNull(), F.format_string("SN%d", fields["sn"])), if_set(fields["norm"]),
        if_set(fields["load_class"]), if_set(fields["dimensions"]), if_set(fields["system"]), example,
    )
    # the details are named, and so computed, once
    whole = F.array_join(F.concat(F.array(title), with_new_details(signal_details(raw, title), more, title)), ", ")
    return F.substring(F.when(title.isNotNull(), whole), 1, most)


def service_description(description: Column, raw: Column, most: int = 800) -> Column:
    """A service's description and those pieces of the derived title that it doesn't say."""
    own, derived = squeezed(description), derived_title(raw, description)
    base = F.when(~is_poor_title(own), own).otherwise(derived)
    pieces = F.transform(F.split(derived, ","), lambda x: F.btrim(x, F.lit(" .")))
    step = lambda done, x: F.when((x == "") | F.contains(F.lower(done), F.lower(x)) | (F.length(done) + F.length(x) + 2 > most), done).otherwise(F.concat(done, F.lit(", "), x))
    return F.substring(F.aggregate(pieces, base, step), 1, most)


#: The names that display_description gives to a line's columns.
FIELDS = {
    "dn": "nominal_diameter_dn", "second_dn": "secondary_nominal_diameter_dn", "material": "material", "sn": "stiffness_class_sn", "norm": "norm",
    "load_class": "load_class", "dimensions": "dimensions", "system": "system_family", "reference": "reference_product",
}
#: Lines that are folded at once; a longer run of lines that refer back goes on with the carry.
RUN = 1000


def referred_title(title: Column, description: Column, label: Column, previous: Column) -> Column:
    """The title of a line whose own is poor, as display_title has it."""
    before = F.when(~is_poor_title(previous), F.trim(F.substring_index(previous, ",", 1)))
    found = squeezed(F.coalesce(before, label, title))
    return F.when(found != "", found).otherwise(F.coalesce(if_set(squeezed(description)), F.lit("Position")))


def finalised(lines: DataFrame, key: str, order: str) -> DataFrame:
    """Lines with their final description; one whose own title is poor is named after the
    final description of the material line before it.

    A material line with a title of its own starts a run, so runs don't depend on one
    another and are folded side by side, RUN lines at a time with the last text as carry.
    order is unique in a key.  Nulls: a null type is neither service nor a line to be named
    after; null texts are empty; an empty table stays empty."""
    own, derived = squeezed("description"), derived_title(F.col("raw_text"), F.col("description"))
    service, material = F.col("position_type").eqNullSafe("dienstleistung"), F.col("position_type").eqNullSafe("material")
    first = lines.select(
        F.col(key).alias("key_"), F.col(order).alias("at_"), text_of("description").alias("said_"), text_of("raw_text").alias("raw_"), service.alias("service_"), material.alias("material_"),
        F.when(~is_poor_title(own), own).otherwise(derived).alias("title_"), human_label(F.col("product_category"), F.col("product_subcategory")).alias("label_"), is_poor_title(own).alias("bare_"),
        F.struct(*[F.col(c).alias(n) for n, c in FIELDS.items()]).alias("fields_"),
    )
    known = F.when(F.col("bare_") | F.col("label_").isNotNull(), F.col("fields_.system"))
    first = materialised(first.withColumns({"needs_": ~F.col("service_") & is_poor_title("title_"), "fields_": F.col("fields_").withField("system", known)}))
    values = lambda x: {n: x[n] for n in FIELDS}
    clean = squeezed("title_")
    alone = F.when(F.col("service_"), service_description(F.col("said_"), F.col("raw_"))).otherwise(display_description(clean, F.col("raw_"), values(F.col("fields_"))))
    so_far = Window.partitionBy("key_").orderBy("at_").rowsBetween(Window.unboundedPreceding, 0)
    rows = first.withColumn("final_", F.when(~F.col("needs_"), alone)).withColumn("run_", F.sum((F.col("material_") & ~F.col("needs_")).cast("int")).over(so_far))
    place = F.row_number().over(Window.partitionBy("key_", "run_").orderBy("at_")) - 1
    rows = materialised(rows.withColumn("chunk_", F.floor(place / RUN)))
    keys = ["key_", "run_"]
    carry = rows.where("material_ and not needs_").select(*keys, F.col("final_").alias("carry_"))
    done = rows.where("not needs_").select("key_", "at_", "final_")
    entry = F.struct("at_", "said_", "raw_", "material_", "title_", "label_", "fields_")

    def step(state: Column, x: Column) -> Column:
        title = referred_title(x["title_"], x["said_"], x["label_"], state["carry"])
        # the title is bound once
        text = F.get(F.transform(F.array(title), lambda t: display_description(t, x["raw_"], values(x["fields_"]))), F.lit(0))
        return F.get(F.transform(F.array(text), lambda t: F.struct(
            F.when(x["material_"], t).otherwise(state["carry"]).alias("carry"), F.concat(state["out"], F.array(F.struct(x["at_"].alias("at"), t.alias("text")))).alias("out"))), F.lit(0))

    last = rows.where("needs_").agg(F.max("chunk_")).first()[0]
    for chunk in range(0 if last is None else last + 1):
        part = rows.where((F.col("chunk_") == chunk) & F.col("needs_")).groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("lines_"))
        kind = f"array<struct<at:{dict(first.dtypes)['at_']},text:string>>"
        start = F.struct(F.col("carry_").alias("carry"), F.array().cast(kind).alias("out"))
        folded = materialised(part.join(carry, keys, "left").select(*keys, F.aggregate("lines_", start, step).alias("state")))
        done = done.unionByName(folded.select("key_", F.explode("state.out").alias("x")).select("key_", F.col("x.at").alias("at_"), F.col("x.text").alias("final_")))
        carry = carry.join(folded.select(*keys, F.col("state.carry").alias("new_")), keys, "full_outer").select(*keys, F.coalesce("new_", "carry_").alias("carry_"))
    out = lines.join(done, F.col(key).eqNullSafe(F.col("key_")) & (F.col(order) == F.col("at_")), "left")
    return out.withColumn("description", F.col("final_")).drop("key_", "at_", "final_")
