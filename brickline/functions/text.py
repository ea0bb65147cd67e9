"""Text functions: Column in, Column out, null-safe unless a docstring says otherwise."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and their two-letter spellings.
UMLAUTS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"))
#: Words that carry no meaning for matching.
STOP_WORDS = (
    "und", "oder", "mit", "ohne", "der", "die", "das", "ein", "eine", "für", "von", "auf", "inkl", "einschl", "nach",
    "gem", "bzw", "bis", "aus",
)


def text_of(c: Column | str) -> Column:
    """The value, or the empty text for null."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def normalise(c: Column | str) -> Column:
    """Trimmed, lower case, umlauts spelt with two letters; null gives the empty text."""
    out = F.lower(F.trim(text_of(c)))
    for letter, spelt in UMLAUTS:
        out = F.replace(out, F.lit(letter), F.lit(spelt))
    return out


def spelt(word: str) -> str:
    """What normalise() makes of a literal."""
    word = word.strip().lower()
    for letter, two in UMLAUTS:
        word = word.replace(letter, two)
    return word


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    return any_of(F.contains(text, F.lit(w)) for w in words)


def starts_with_any(text: Column, words: Iterable[str]) -> Column:
    return any_of(F.startswith(text, F.lit(w)) for w in words)


def first_of(*cases: tuple[Column, Column | str | int | None], otherwise: Column | None = None) -> Column:
    """The value of the first case that holds."""
    (test, value), *rest = cases
    wrap = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = F.when(test, wrap(value))
    for test, value in rest:
        out = out.when(test, wrap(value))
    return out if otherwise is None else out.otherwise(otherwise)


def either_contains(a: Column, b: Column) -> Column:
    """One text lies inside the other (the empty text lies in every text)."""
    return F.contains(a, b) | F.contains(b, a)


def if_set(c: Column) -> Column:
    """Null instead of the empty text."""
    return F.when(F.trim(c) != "", c)


def tokens(c: Column) -> Column:
    """Distinct words of three or more letters, digits or hyphens, without stop words."""
    words = F.regexp_extract_all(F.lower(text_of(c)), F.lit(r"[a-z0-9äöüß-]{3,}"), F.lit(0))
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in STOP_WORDS]))


def ascii_tokens(c: Column) -> Column:
    """Distinct ASCII words of three or more letters or digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text_of(c)), F.lit(r"[a-z0-9]{3,}"), F.lit(0)))


def squeezed_lines(c: Column) -> Column:
    """Line ends unified, lines trimmed and squeezed, blank lines dropped."""
    lines = F.split(F.regexp_replace(text_of(c), r"\r\n?", "\n"), "\n")
    clean = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.array_join(F.filter(clean, lambda x: x != ""), "\n")


def unescaped(c: Column) -> Column:
    """HTML entities, named (with their semicolon) and numeric, to characters; others stay."""
    names = F.create_map(*[F.lit(x) for name, code in sorted(name2codepoint.items()) for x in (name, chr(code))])

    def piece(x: Column, i: Column) -> Column:
        name = F.regexp_extract(x, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        hexed = F.when(name.rlike("^#[xX]"), F.substring(name, 3, 6)).otherwise(F.hex(F.substring(name, 2, 7).try_cast("long")))
        point = F.conv(hexed, 16, 10).try_cast("long")
        char = F.decode(F.unhex(F.lpad(hexed, 8, "0")), "UTF-32")
        valid = point.between(1, 0xD7FF) | point.between(0xE000, 0x10FFFF)
        found = F.when(F.startswith(name, F.lit("#")), F.when(valid, char)).otherwise(F.element_at(names, name))
        return F.when((i > 0) & (name != "") & found.isNotNull(), F.concat(found, F.substring(x, F.length(name) + 2, F.length(x)))).when(i > 0, F.concat(F.lit("&"), x)).otherwise(x)

    return F.array_join(F.transform(F.split(text_of(c), "&"), piece), "")


def strip_html(c: Column) -> Column:
    """Tags to blanks, entities to characters; line feeds stay, without white space around them."""
    lines = F.regexp_replace(unescaped(F.regexp_replace(text_of(c), r"<[^>]*>", " ")), r"(?U)\s*\n\s*", "\n")
    return F.regexp_replace(lines, r"(?U)^\s+|\s+$", "")


def clean_notice(c: Column) -> Column:
    """Line-break entities to line feeds, tags dropped, other entities to spaces; null stays null."""
    out = F.regexp_replace(c, r"&#(10|13);", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    return F.trim(F.regexp_replace(out, r"&[a-zA-Z#0-9]+;", " "))


def spec_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(text_of(c)), r"[^a-z0-9]", "")


def description_hash(c: Column) -> Column:
    return F.sha2(F.regexp_replace(F.lower(F.trim(text_of(c))), r"\s+", " ").cast("binary"), 256)


def item_number(c: Column) -> Column:
    """Digits and dots only, leading zeros of each part dropped: '04.0010' -> '4.10'."""
    parts = F.filter(F.split(F.regexp_replace(text_of(c), r"[^0-9.]", ""), r"\."), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda x: F.regexp_replace(x, r"^0+(?=[0-9])", "")), ".")


def item_sort_key(c: Column) -> Column:
    """An item number as a list of integers; [999] where a part isn't a number."""
    parts = F.transform(F.split(text_of(c), r"\."), lambda x: x.try_cast("int"))
    return F.when(F.exists(parts, lambda x: x.isNull()), F.array(F.lit(999))).otherwise(parts)


def string_list(c: Column) -> Column:
    """A list split at commas, semicolons and slashes, trimmed; null if nothing is left."""
    parts = F.filter(F.transform(F.split(c, r"[,;/]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts)


def message_key(message_id: Column, subject: Column, sender: Column, body: Column) -> Column:
    """The message id, or a digest of subject, sender and the body's first 500 characters."""
    own = F.concat_ws("|", text_of(subject), text_of(sender), F.substring(text_of(body), 1, 500))
    return F.coalesce(if_set(F.trim(message_id)), F.concat(F.lit("fallback-"), F.sha2(own.cast("binary"), 256)))
