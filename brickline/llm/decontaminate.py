"""Benchmark decontamination with a distributed positional inverted index.

Benchmark items are cut into windows of consecutive words.  The index holds the
training tokens' postings (term, document, position) of the terms that can
decide a match: for every window its ``anchors`` rarest terms by their counts
over all training tokens.  Posting lists are shifted by the term's offset in the
window and intersected from the rarest on; what is left is verified word by word
(exact phrases) or by position (proximity).  DataFrame functions only.

Scale: counting, posting and verifying are scans of the texts whose narrow rows
are pre-aggregated before any shuffle; texts are not shuffled.  The benchmark's
terms and the candidates are broadcast only when their measured size is under
``BROADCAST_BYTES``; beyond it the same join shuffles.  A frequent passage adds
rows in proportion to its occurrences.

Defined cases: a null text has no words, so nothing is hit and, in the
benchmark, no window exists; a null item_id counts as the empty id; repeated
documents get equal results each; repeated items count once by id; texts of any
length are matched whole; extra columns are ignored; empty tables give empty
results (documents) or no hits (benchmark).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brickline.llm.common import ascii_lower, stored

#: What separates words: ASCII that is neither digit nor letter.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    """The words as they are written; they are lower-cased one by one."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def small(df: DataFrame, bytes_of: Column) -> DataFrame:
    """df, to be broadcast if its size, measured, is under the bound."""
    size = df.agg(F.sum(bytes_of + 64)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """window, item, phrase (array of words): n words, or the whole of a shorter item."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        F.transform(words(F.col("text")), ascii_lower).alias("w"),
    ).where(F.size("w") > 0)
    phrases = items.select(
        "item",
        F.explode(
            F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.slice("w", i, n))
        ).alias("phrase"),
    ).distinct()
    return stored(
        phrases.withColumn("window", F.xxhash64("item", "phrase")), "windows"
    )


def tokens(docs: DataFrame, *keep: str | Column) -> DataFrame:
    return docs.select(*keep, F.posexplode(words(F.col("text"))).alias("pos", "word")).withColumn(
        "term", ascii_lower(F.col("word"))
    ).drop("word")


def anchor_terms(docs: DataFrame, wins: DataFrame, anchors: int) -> DataFrame:
    """window, item, phrase, term, off, n_terms: each window's rarest terms."""
    spots = wins.select("window", "item", "phrase", F.posexplode("phrase").alias("off", "term"))
    terms = small(spots.select("term").distinct(), F.octet_length("term"))
    counts = stored(tokens(docs).join(terms, "term", "left_semi").groupBy("term").count(), "term-counts")
    rarity = Window.partitionBy("window").orderBy(F.coalesce("count", F.lit(0)), "term", "off")
    return stored(
        spots.join(small(counts, F.octet_length("term")), "term", "left")
        .withColumn("rank", F.row_number().over(rarity))
        .where(F.col("rank") <= anchors)
        .withColumn("n_terms", F.least(F.size("phrase"), F.lit(anchors)))
        # a term that no training text has rules its window out
        .withColumn("least", F.min(F.coalesce("count", F.lit(0))).over(Window.partitionBy("window")))
        .where("least > 0")
        .select("window", "item", "phrase", "term", "off", "n_terms"),
        "anchors",
    )


def key_columns() -> list[Column]:
    """doc_id and the text's hash: rows with one id and different texts stay apart."""
    return [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]


def postings(docs: DataFrame, anchored: DataFrame) -> DataFrame:
    """The stored index: term, doc_id, text_hash, pos."""
    terms = small(anchored.select("term").distinct(), F.octet_length("term"))
    return stored(tokens(docs, *key_columns()).join(terms, "term", "left_semi"), "postings")


def shifted(index: DataFrame, anchored: DataFrame) -> DataFrame:
    """doc_id, text_hash, window, n_terms, off, start: postings moved to window starts."""
    spots = small(anchored.select("term", "window", "off", "n_terms"), F.octet_length("term"))
    return index.join(spots, "term").select(
        "doc_id", "text_hash", "window", "n_terms", "off", (F.col("pos") - F.col("off")).alias("start")
    )


def candidates(index: DataFrame, anchored: DataFrame) -> DataFrame:
    """Window starts at which all the window's anchors stand, by document."""
    starts = (
        shifted(index, anchored).where("start >= 0")
        .groupBy("doc_id", "text_hash", "window", "start", "n_terms").count()
        # repeated rows count their postings each; what passes by that is verified below
        .where("count >= n_terms").select("doc_id", "text_hash", "window", "start")
    )
    phrases = small(
        anchored.select("window", "item", F.array_join("phrase", " ").alias("phrase"), F.size("phrase").alias("n")).distinct(),
        F.octet_length("phrase"),
    )
    return stored(
        starts.join(phrases, "window").groupBy("doc_id", "text_hash")
        .agg(F.collect_list(F.struct("start", "n", "item", "phrase")).alias("found")),
        "candidates",
    )


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slop: int = 3, n: int = 10, anchors: int = 3) -> DataFrame:
    """doc_id, item: documents where the anchors of a window of the item stand in
    places that differ from the window's by at most slop words from one another."""
    anchored = anchor_terms(docs, windows(benchmark, n), anchors)
    near = Window.partitionBy("doc_id", "text_hash", "window").orderBy("start").rangeBetween(-slop, 0)
    hits = shifted(postings(docs, anchored), anchored).withColumn("seen", F.size(F.collect_set("off").over(near)))
    items = anchored.select("window", "item").distinct()
    return hits.where("seen = n_terms").join(items, "window").select("doc_id", "item").distinct()


def phrase_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, anchors: int = 2, keep_row: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, spans (start, n, item of each exact
    window occurrence, start counted in words from 0) and, on request, row."""
    anchored = anchor_terms(docs, windows(benchmark, n), anchors)
    found = candidates(postings(docs, anchored), anchored).withColumnsRenamed({"doc_id": "f_id", "text_hash": "f_hash"})
    size = F.aggregate("found", F.lit(0), lambda a, x: a + F.octet_length(x["phrase"]) + F.octet_length(x["item"]) + 32)
    whole = [F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")] if keep_row else []
    rows = docs.select(*whole, *key_columns(), words(F.col("text")).alias("w")).join(
        small(found, size), F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("text_hash") == F.col("f_hash")), "left"
    )
    lowered = rows.withColumn("lw", F.when(F.col("found").isNotNull(), F.transform("w", ascii_lower)))
    spans = F.filter("found", lambda c: F.array_join(F.slice("lw", c["start"] + 1, c["n"]), " ") == c["phrase"])
    return lowered.select(
        *(["row"] if keep_row else []),
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.coalesce(
            F.transform(spans, lambda c: F.struct(c["start"].alias("start"), c["n"].alias("n"), c["item"].alias("item"))),
            F.expr("cast(array() as array<struct<start:int,n:int,item:string>>)"),
        ).alias("spans"),
    )


def report(hits: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    items = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item"])))
    hit = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))))
    return hits.select("doc_id", "n_words", F.size(hit).cast("long").alias("n_hit"), items.alias("items")).select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def oracle() -> str:
    """The same report as DuckDB SQL: every window looked up at every word."""
    split = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {split} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {split} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, w[s : s + 9] AS phrase
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
places AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n),
h AS (SELECT r, s, places.n, item FROM places JOIN win ON win.n = places.n AND win.phrase = w[s : s + places.n - 1]),
p AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS x FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)"""
