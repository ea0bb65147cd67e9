"""Message ingest as a stream: new files, once per message key, classified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brickline.functions.text import contains_any


#: The tags that our inquiries carry; words of invoices, and of bills of quantities, in a document's message.
REFERENCE_TAGS = ("tbx-inq", "tbx-proj")
AGAINST_DOCUMENT = ("invoice", "receipt", "statement", "billing", "stripe", "zahlungsbeleg", "beleg", "rechnung", "abrechnung", "quittung")
FOR_DOCUMENT = ("lv", "leistungsverzeichnis", "ausschreibung", "anfrage", "bauprojekt", "bauvorhaben", "baustoff", "position")
OFFER_WORDS = ("angebot", "lieferantenangebot", "preisangebot", "rueckmeldung", "rückmeldung")
ORDER_WORDS = ("lv", "leistungsverzeichnis", "ausschreibung", "anfrage", "angebotsanfrage")


def classified(
    subject: Column, body: Column, has_document: Column, offer_words: tuple[str, ...] = OFFER_WORDS, order_words: tuple[str, ...] = ORDER_WORDS,
    against: tuple[str, ...] = AGAINST_DOCUMENT, hints: tuple[str, ...] = FOR_DOCUMENT, names: Column | None = None,
) -> Column:
    """offer, new_document or ignored; the first test that holds decides: a reference tag or
    an offer's word; no document; an invoice's word without an order's; an order's word or a hint.
    names: the attachments' names, which count as text."""
    text = F.lower(F.concat_ws("\n", subject, body, *([] if names is None else [names])))
    order = contains_any(text, order_words)
    return (
        F.when(contains_any(text, (*REFERENCE_TAGS, *offer_words)), "offer").when(~F.coalesce(has_document, F.lit(False)), "ignored")
        .when(contains_any(text, against) & ~order, "ignored").when(order | contains_any(text, hints), "new_document").otherwise("ignored")
    )


def is_own_copy(subject: Column, sender: Column, body: Column, n_attachments: Column, own_address: str) -> Column:
    """A forwarded copy of one of our own inquiries: from our address, without attachments, marked twice."""
    low = lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))
    marked = F.startswith(low(subject), F.lit("[demo] anfrage:")) & F.contains(low(body), F.lit("[demo-weiterleitung]"))
    return (F.coalesce(n_attachments, F.lit(0)) == 0) & (low(sender) == own_address.lower()) & marked


def passage(corpus: Column, number: Column, least: int = 20, most: int = 2200) -> Column:
    """The text from an item number on up to the next line that begins with one, least to most
    characters long; null if there is none."""
    start = F.instr(F.lower(corpus), F.lower(number))
    tail = F.substring(corpus, start, F.length(corpus))
    inside = F.regexp_extract(F.substring(tail, F.length(number) + 1, F.length(tail)), rf"(?s)^(.{{{least},{most}}}?)(?=\n\s*\d{{1,3}}(?:\.\d{{1,4}}){{1,3}}\b|\z)", 1)
    return F.when((start > 0) & (number != "") & (inside != ""), F.concat(F.substring(tail, F.lit(1), F.length(number)), inside))


#: A JSON text's pieces: what is between strings and brackets, strings, brackets.
PIECE = r'[^"{}\[\]]++|"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\]]'


def complete_objects(text: Column) -> Column:
    """The objects of a JSON array that may be cut off: all those that are closed on the
    array's level, however deep they nest, as a valid array; null without one.

    The depth is a running count of brackets outside of strings."""
    body = F.regexp_extract(text, r"(?s)\[(.*)$", 1)
    pieces = F.regexp_extract_all(body, F.lit(f"(?s){PIECE}"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(state: Column, x: Column) -> Column:
        depth = state["depth"] + F.when(x.isin("{", "["), 1).when(x.isin("}", "]"), -1).otherwise(0)
        # below the array's level nothing counts any more
        depth = F.when(state["depth"] < 0, -1).otherwise(depth)
        inside = (state["depth"] > 0) | ((state["depth"] == 0) & x.isin("{", "["))
        grown = F.when(inside, F.concat(state["open"], x)).otherwise("")
        closed = inside & (depth == 0)
        done = F.when(closed & F.startswith(grown, F.lit("{")), F.concat(state["done"], F.array(grown))).otherwise(state["done"])
        return F.struct(depth.alias("depth"), F.when(closed, "").otherwise(grown).alias("open"), done.alias("done"))

    found = F.aggregate(pieces, start, step)["done"]
    return F.when(F.size(found) > 0, F.concat(F.lit("["), F.array_join(found, ","), F.lit("]")))


def unwrapped(value: Column, language: str = "deu", depth: int = 3) -> Column:
    """A text out of nested JSON: an object's language, else 'mul', else its first value; an array's
    first element; to the given depth."""
    for _ in range(depth):
        first_value = F.get(F.map_values(F.from_json(value, "map<string,string>")), F.lit(0))
        inner = F.coalesce(F.get_json_object(value, f"$.{language}"), F.get_json_object(value, "$.mul"), first_value)
        item = F.get_json_object(value, "$[0]")
        value = F.when(F.startswith(F.ltrim(value), F.lit("{")), inner).when(F.startswith(F.ltrim(value), F.lit("[")), item).otherwise(value)
    return value


def valid_offer_lines(df: DataFrame, name: str = "article_name", prices: tuple[str, ...] = ("unit_price", "total_price")) -> DataFrame:
    """Lines with a name of two characters and more; negative prices become unknown."""
    return df.where(F.length(F.trim(F.col(name))) >= 2).withColumns({p: F.when(F.col(p) >= 0, F.col(p)) for p in prices})


def message_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int | None = 25) -> DataFrame:
    """Messages of a folder's files, so many a batch; None: all that are there."""
    stream = spark.readStream.schema(schema)
    return (stream if files_per_batch is None else stream.option("maxFilesPerTrigger", files_per_batch)).parquet(folder)


def once_per_key(stream: DataFrame, key: str, time: str | None = None, delay: str | None = None) -> DataFrame:
    """Each key once; with a time column and a delay the state is bounded by the watermark."""
    if time is not None and delay is not None:
        return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])


def drained(stream: DataFrame, table: str, checkpoint: str) -> None:
    """Process all there is and stop; a later call goes on where this one ended."""
    query = stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
