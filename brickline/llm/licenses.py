"""License scans by canonical digest lookup.

A text is brought to a canonical form (case, punctuation and white space,
copyright statements, equivalent spellings), the canonical form is digested, and
the digests are hash-joined with those of known licence texts.  Two kinds of units
are looked up as entire texts: the whole document, and each of its lines, so
that a one-line notice inside prose is found too.  Where lines break makes no
difference to a whole text: only lines that are a statement (the mark with a year,
"all rights reserved") go, not a licence's own sentence about copyright notices.

The known texts are those of ``license_texts``: whole short licences, headers and
notices as texts, and the usual long licences by their digests; a caller may give
others.  A licence that isn't among them isn't found.

Scale: the whole digests are joined in one scan, without a shuffle while the known
table's measured size is under ``BROADCAST_BYTES``; a larger one is joined by
shuffle.  Lines are exploded with a digest only if a known text has their length,
meet the same table, and what is found is counted by document before it is joined.

Defined cases: a null or empty text has the digest of the empty text and never
matches; a text of copyright statements only is empty; repeated rows are scanned
each; an empty table of known texts finds nothing; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brickline.llm.license_texts import KNOWN, KNOWN_DIGESTS, SPELLINGS

#: A line that is a copyright statement, in lower case.
COPYRIGHT_LINE = (
    r"(?m)^[^a-z0-9\n]*(©[^\n]*|all rights reserved[^\n]*|\(c\)[^\n]*(copyright|19[0-9]{2}|20[0-9]{2})[^\n]*"
    r"|copyright[^\n]*(\(c\)|©|19[0-9]{2}|20[0-9]{2}|all rights reserved)[^\n]*)$"
)
PUNCTUATION = r"[^a-z0-9\n]+"
BROADCAST_BYTES = 32 << 20
#: Lengths of known texts up to this number are told apart before lines are digested.
LENGTHS = 1000


def canonical_lines(text: Column) -> Column:
    """The canonical text, its lines still apart."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    out = F.regexp_replace(out, PUNCTUATION, " ")
    for spelling, canonical in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(canonical))
    return out


def one_line(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """digest, license, length of the known texts (license, known), each digest once."""
    rows = known if isinstance(known, DataFrame) else spark.createDataFrame(KNOWN if known is None else known, "license string, known string")
    flat = rows.select("license", one_line(canonical_lines(F.coalesce("known", F.lit("")))).alias("flat")).where("flat <> ''")
    found = flat.select(F.md5(F.col("flat").cast("binary")).alias("digest"), "license", F.length("flat").alias("length"))
    if known is None:
        found = found.unionByName(spark.createDataFrame(KNOWN_DIGESTS, "license string, digest string, length int").select("digest", "license", "length"))
    return found.groupBy("digest").agg(F.min("license").alias("license"), F.min("length").alias("length"))


def scan_licenses(docs: DataFrame, known: list[tuple[str, str]] | DataFrame | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: doc_id, digest, license (of the entire text),
    n_notices (lines that are known notices, repeats counted) and
    notice_licenses (their licences, distinct, in order, comma-joined)."""
    table = known_digests(docs.sparkSession, known).cache()
    lengths = [r["length"] for r in table.select("length").distinct().limit(LENGTHS + 1).collect()]
    small = F.broadcast if table.count() * 96 <= broadcast_bytes else lambda df: df
    lines = canonical_lines(F.coalesce("text", F.lit("")))
    # a document is known by its id and its text; rows that repeat both are counted apart
    found = docs.select("doc_id", F.xxhash64("text").alias("h"), lines.alias("lines"))
    candidate = lambda x: F.length(x).isin(lengths) if len(lengths) <= LENGTHS else F.length(x) > 0
    each = found.select("doc_id", "h", F.explode(F.filter(F.transform(F.split("lines", "\n"), lambda x: F.trim(x)), candidate)).alias("line"))
    hits = each.select("doc_id", "h", F.md5(F.col("line").cast("binary")).alias("digest")).join(small(table.select("digest", "license")), "digest")
    notices = hits.groupBy("doc_id", "h").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("license")).alias("licenses"))
    copies = docs.groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.count("*").alias("copies"))
    same = notices["doc_id"].eqNullSafe(copies["doc_id"]) & (notices["h"] == copies["h"])
    notices = notices.join(copies, same).select(
        notices["doc_id"].alias("n_id"), notices["h"].alias("n_h"), (F.col("n") / F.col("copies")).cast("long").alias("n_notices"), "licenses"
    )
    whole = found.select("doc_id", "h", F.md5(one_line(F.col("lines")).cast("binary")).alias("digest"))
    whole = whole.join(small(table.select("digest", "license")), "digest", "left")
    return whole.join(notices, F.col("doc_id").eqNullSafe(F.col("n_id")) & (F.col("h") == F.col("n_h")), "left").select(
        "doc_id", "digest", "license", F.coalesce("n_notices", F.lit(0).cast("long")).alias("n_notices"),
        F.coalesce(F.array_join("licenses", ","), F.lit("")).alias("notice_licenses"),
    )


def oracle() -> str:
    """The same scan of the known texts as DuckDB SQL."""
    def canon(text: str) -> str:
        pattern = COPYRIGHT_LINE
        out = f"regexp_replace(lower({text}), '{pattern}', '', 'g')"
        out = f"regexp_replace({out}, '[^a-z0-9\\n]+', ' ', 'g')"
        for spelling, canonical in SPELLINGS:
            out = f"replace({out}, '{spelling}', '{canonical}')"
        return out

    def flat(lines: str) -> str:
        return f"trim(regexp_replace({lines}, '[ \\n]+', ' ', 'g'))"

    values = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)
    digests = ", ".join(f"('{i}', '{d}')" for i, d, _ in KNOWN_DIGESTS)
    return f"""
WITH raw(license, known) AS (VALUES {values}),
k AS (SELECT d, min(license) AS license FROM (SELECT md5({flat(canon('known'))}) AS d, license FROM raw
  UNION ALL SELECT d, license FROM (VALUES {digests}) AS q(license, d)) GROUP BY 1),
l AS (SELECT row_number() OVER () AS r, doc_id, {canon("coalesce(text, '')")} AS lines FROM documents),
u AS (SELECT r, unnest(string_split(lines, chr(10))) AS line FROM l),
n AS (SELECT r, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses
      FROM u JOIN k ON k.d = md5(trim(line)) GROUP BY r)
SELECT doc_id, md5({flat('lines')}) AS digest, k.license AS license,
       coalesce(n.n, 0) AS n_notices, coalesce(n.licenses, '') AS notice_licenses
FROM l LEFT JOIN k ON k.d = md5({flat('lines')}) LEFT JOIN n USING (r)"""
