"""Quantities and units from a line's text, and lines that a parse left out.

Nulls: a null text has no quantity; repeated rows are read each; an empty table
stays empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickline.functions.numbers import parse_number
from brickline.functions.text import contains_any, first_of, if_set, item_number, text_of

c = F.col
#: A line that begins with quantity and unit, as blocks are read.
BLOCK_LINE = (
    r"(?i)^\s*([\d.,]+)\s+(Std\.?|StD|h|m2|m²|m3|m³|m|lfm|lfdm|lfd\.m|Stück|Stk|Stueck|Stueck\.|St\.?|kg|to|t|Psch|psch|Pausch|Wo|mWo|cbm|Tag)(?![\p{L}\p{N}_])"
)
#: The same in a line's own text, strict and loose.
STRICT_LINE = (
    r"(?i)^\s*(\d{1,3}(?:[.\s]\d{3})*(?:,\d+)?)\s*(m²|m2|m3|m³|m|Stck\.?|Stk\.?|St\.?|Stück|StD|Std|kg|to|t|h|lfdm|lfm|Psch|psch|Pausch|mWo|Wo)(?![\p{L}\p{N}_])"
)
LOOSE = (
    r"(?i)(\d{1,3}(?:[.\s]\d{3})*(?:,\d+)?)\s*(m²|m2|m3|m³|m|Stck\.?|Stk\.?|St\.?|Stück|StD|Std|kg|to|t|h|lfdm|lfm|Psch|psch|Pausch|mWo|Wo)(?![\p{L}\p{N}_])"
)
#: The loose form without groups.
PAIR = LOOSE.removeprefix("(?i)").replace(r"(\d{1,3}(", r"(?:\d{1,3}(").replace("(m²", "(?:m²")
#: One spelling of each unit.
UNITS = {"std": "Std", "h": "h", "stk": "Stück", "stueck": "Stück", "st": "Stück"}
#: Lines of a block that say nothing.
SKIPPED = (
    r"(?i)^\s*(EVENTUALPOSITION|Übertrag|Uebertrag|POS\.|LEISTUNGSBESCHREIBUNG|Architekt|Objekt\s*:|Bauherr\s*:|Seite\s+\d+|"
    r"LEISTUNGSVERZEICHNIS|NETTOANGEBOTSSUMME|BRUTTOANGEBOTSSUMME|MEHRWERTSTEUER)"
)
HEADING = r"^\s*(\d{1,3}(?:\.\d{1,4}){1,3})\.?\s+(\S.*)$"


def block_quantity(block: Column) -> Column:
    """struct(quantity, unit) of the first line of the block that begins with both.  All
    dots are thousands marks, so '12.50' is 1250."""
    lines = F.filter(F.split(text_of(block), "\n"), lambda x: F.trim(x).rlike(BLOCK_LINE))
    first = F.trim(F.get(lines, F.lit(0)))
    unit = F.regexp_replace(F.regexp_extract(first, BLOCK_LINE, 2), r"\.+$", "")
    one = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv]), F.lower(unit)), unit)
    number = F.replace(F.replace(F.regexp_extract(first, BLOCK_LINE, 1), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    return F.struct(F.when(first.isNotNull(), number).alias("quantity"), F.when(first.isNotNull(), one).alias("unit"))


def text_quantity(text: Column) -> Column:
    """struct(quantity, unit): the last line that begins with both, else the last pair in
    the text that is no measure (4 x 3 m, 3 m breit, ca. 5 m, 12 m ü. NN)."""
    body = text_of(text)
    strict = F.filter(F.split(body, "\n"), lambda x: F.trim(x).rlike(STRICT_LINE))
    last = F.trim(F.get(F.reverse(strict), F.lit(0)))
    # each pair with the text around it: up to ten characters before, eight after
    around = r"(?is)(?<=(.{10}))(" + PAIR + r")(?=(.{0,8}))"
    part = lambda i: F.regexp_extract_all(F.concat(F.repeat(F.lit(" "), 10), body), F.lit(around), F.lit(i))
    spots = F.arrays_zip(part(1).alias("before"), part(2).alias("pair"), part(3).alias("after"))

    def measure(s: Column) -> Column:
        before, after = F.lower(s["before"]), F.lower(s["after"])
        near = F.substring(before, -2, 2)
        return (
            F.contains(near, F.lit("x")) | F.contains(near, F.lit("/")) | F.contains(before, F.lit("ca.")) | F.contains(before, F.lit("max."))
            | F.contains(after, F.lit("ü.")) | F.contains(after, F.lit("nn"))
        )

    loose = F.get(F.reverse(F.filter(spots, lambda s: ~measure(s))), F.lit(0))["pair"]
    chosen = F.coalesce(last, loose)
    pattern = F.when(last.isNotNull(), F.regexp_extract(chosen, STRICT_LINE, 1)).otherwise(F.regexp_extract(chosen, LOOSE, 1))
    unit = F.when(last.isNotNull(), F.regexp_extract(chosen, STRICT_LINE, 2)).otherwise(F.regexp_extract(chosen, LOOSE, 2))
    return F.struct(parse_number(F.regexp_replace(pattern, r"\s", "")).alias("quantity"), F.replace(unit, F.lit("."), F.lit("")).alias("unit"))


#: Lines that a document's last block has, when quantities and when whole positions are looked for.
LAST_LINES, LAST_LINES_MISSING = 60, 40
#: Rows of dots and underscores to be filled in by hand.
TO_FILL_IN = ("________", "..................")
DESCRIPTION_MOST = 800


def ended(blocks: DataFrame, most: int) -> Column:
    """A block's text; of a document's last block (is_last) its first lines."""
    text = text_of("text")
    if "is_last" not in blocks.columns:
        return text
    return F.when(c("is_last"), F.array_join(F.slice(F.split(text, "\n"), 1, most), "\n")).otherwise(text)


def filled_quantities(positions: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Positions whose unknown quantity or unit comes from their block (keys, text; block and
    is_last where a document has several).  Of a number's blocks the last counts; an empty
    unit is unknown."""
    place = c("block") if "block" in blocks.columns else F.lit(0)
    last = blocks.select(*keys, place.alias("place"), ended(blocks, LAST_LINES).alias("text")).groupBy(*keys).agg(F.max_by("text", F.struct("place", "text")).alias("text"))
    joined = positions.join(last.select(*keys, block_quantity(c("text")).alias("read")), keys, "left")
    return joined.withColumns({"quantity": F.coalesce("quantity", "read.quantity"), "unit": F.coalesce(if_set(c("unit")), "read.unit", "unit")}).drop("read")


def heading_blocks(lines: DataFrame, key: str) -> DataFrame:
    """key, block, item, title, text, is_last of each numbered heading's block (document lines in order)."""
    from brickline.operators.lines import block_texts, blocks

    whole = block_texts(blocks(lines, key, c("line").rlike(HEADING)), key)
    head = F.regexp_extract("text", r"^([^\n]*)", 1)
    return whole.select(
        key, "block", item_number(F.regexp_extract(head, HEADING, 1)).alias("item"), F.trim(F.regexp_extract(head, HEADING, 2)).alias("title"), "text",
        (c("block") == F.max("block").over(Window.partitionBy(key))).alias("is_last"),
    )


def text_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """heading_blocks of whole texts, one a key, each read by itself: no line is a row, nothing is sorted."""
    lines = F.split(text_of(text), "\n")
    numbers = F.transform(lines, lambda x, i: F.when(x.rlike(HEADING), i))
    cuts = docs.select(key, lines.alias("lines"), F.array_compact(numbers).alias("starts"))
    end = lambda i: F.coalesce(F.get("starts", i + 1), F.size("lines"))
    each = F.transform("starts", lambda at, i: F.struct(
        F.get("lines", at).alias("head"), F.array_join(F.slice("lines", at + 1, end(i) - at), "\n").alias("text"), (i == F.size("starts") - 1).alias("is_last")))
    return cuts.select(key, F.posexplode(each).alias("p", "x")).select(
        key, (c("p") + 1).cast("long").alias("block"), item_number(F.regexp_extract("x.head", HEADING, 1)).alias("item"),
        F.trim(F.regexp_extract("x.head", HEADING, 2)).alias("title"), "x.text", "x.is_last",
    )


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def missing_positions(blocks: DataFrame, positions: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks whose number no position has, and which state quantity and unit, as service rows.

    Their raw text is the title and the lines that say something; the description is the
    same in one line, without the quantity."""
    amount = lambda x: F.trim(x).rlike(BLOCK_LINE)
    fill = lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(w)) for w in TO_FILL_IN])
    lines = F.split(ended(blocks, LAST_LINES_MISSING), "\n")
    rest = F.filter(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(SKIPPED) & (amount(x) | ~fill(x)))
    said = F.concat(F.filter(F.array("title"), lambda x: (x != "") & ~amount(x)), F.transform(rest, lambda x: F.rtrim(x)))

    def read(said: Column, raw: Column) -> Column:
        text = F.trim(F.array_join(F.transform(F.filter(said, lambda x: ~amount(x)), lambda x: F.trim(x)), " "))
        description = F.coalesce(if_set(text), if_set(c("title")), F.concat(F.lit("Position "), c("item")))
        return F.struct(F.substring(description, 1, DESCRIPTION_MOST).alias("description"), raw.alias("raw_text"), block_quantity(raw).alias("read"))

    every = F.array(bound(said, lambda s: bound(F.trim(F.array_join(s, "\n")), lambda raw: read(s, raw))))
    # an array of one, so that its parts are taken from one value
    found = blocks.select(*keys, F.explode(every).alias("x")).where("x.read.quantity is not null and x.read.unit is not null")
    fresh = found.join(positions.select(*keys).distinct(), keys, "left_anti")
    return fresh.select(
        *keys, "x.description", "x.raw_text", c("x.read.quantity").alias("quantity"), c("x.read.unit").alias("unit"), F.lit("dienstleistung").alias("position_type"), F.lit(False).alias("billable"),
    )


def normalised_line(line: Column) -> Column:
    """Blanks unified, split numbers ('1 . 5', '1.2...8', '5.3.2 . 8 . Text') glued."""
    out = F.translate(line, "\t ", "  ")
    out = F.regexp_replace(out, r"(?<=\d)\s*\.\s*(?=\d)", ".")
    out = F.regexp_replace(out, r"\.{2,}", ".")
    out = F.regexp_replace(out, r"^(\d+(?:\.\d+)+)\s*\.\s*(\d+)\s*\.\s*", "$1.$2 ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


#: How lines of a page's frame begin.
FRAME = (
    "Ordnungszahl Leistungsbeschreibung", "in EUR", "Inhaltsverzeichnis", "Ausschreibungs-LV", "Langtext:", "Leistungsverzeichnis", "Projekt:",
    "Immobilien Bremen AöR", "Gewerk:", "Menge Einheit E-Preis", "Übertrag:",
)


def is_noise(line: Column) -> Column:
    """Empty, a line of the page's frame, or a row of a table of contents with leading dots."""
    dots = F.length(line) - F.length(F.replace(line, F.lit("."), F.lit("")))
    frame = contains_any(F.lit(""), ()) | first_of(*[(F.startswith(line, F.lit(x)), True) for x in FRAME], otherwise=F.lit(False))
    return (text_of(line) == "") | frame | ((dots >= 10) & line.rlike(r"\d+\s*$"))
