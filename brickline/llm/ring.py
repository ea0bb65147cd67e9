"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each key hashes to one of ``2**bin_bits`` arcs of a 64-bit ring.  Every shard
owns ``vnodes`` points of the same ring.  An arc goes to the shard whose point
follows it clockwise; when the arc would lift that shard over its capacity of
``(1 + slack) * total / shards`` bytes it continues clockwise to the next shard
with room.  Heavier arcs choose first, so what is left for the end is small and
balance holds on small tables too.  An arc that fits nowhere (a single row may
be larger than a whole capacity) goes to the shard with the smallest load.

A key with many rows would be one heavy arc, so an arc of more than ``PIECE`` of
the slack of a shard is cut into pieces of about that many bytes, in the order of
its rows; each piece chooses by itself, from the arc's place on.

Scale: equal rows are one row with a number until the end, by a count with map-side
combine, and are written out in parts of ``CHUNK``, so no key meets in one task.
The driver sees, and broadcasts, the pieces only: at most ``2**bin_bits`` arcs and
``shards / (PIECE * slack)`` pieces more, whatever the input.  Texts are never
shuffled.

Defined cases: a null text has size 1 and crc 0; a null key is placed by its
text; repeated rows share an arc as far as they fit; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PLACED = "bin int, piece long, shard int, before long"
#: The share of a shard's slack that a piece of an arc may have, and the equal rows that one task writes.
PIECE, CHUNK = 0.25, 1 << 16


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of each virtual node, in clockwise order."""
    def at(shard: int, v: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest(), "big")

    return sorted((at(s, v), s) for s in range(shards) for v in range(vnodes))


def place(
    loads: dict[tuple[int, int], int], shards: int, vnodes: int, slack: float, bin_bits: int
) -> dict[tuple[int, int], int]:
    """(arc, piece) -> shard.  loads: bytes of each piece of an arc."""
    ring = ring_points(shards, vnodes)
    positions = [p for p, _ in ring]
    capacity = (1 + slack) * sum(loads.values()) / shards
    held, found = [0] * shards, {}
    for piece, load in sorted(loads.items(), key=lambda x: (-x[1], x[0])):
        i = bisect.bisect_left(positions, piece[0] << (64 - bin_bits))
        tried: set[int] = set()
        while len(tried) < shards:
            shard = ring[i % len(ring)][1]
            i += 1
            if shard in tried:
                continue
            if held[shard] + load <= capacity:
                break
            tried.add(shard)
        else:
            shard = min(range(shards), key=lambda s: (held[s], s))
        held[shard] += load
        found[piece] = shard
    return found


def shard_documents(
    docs: DataFrame,
    shards: int = 8,
    vnodes: int = 512,
    slack: float = 0.002,
    bin_bits: int = 16,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8")
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )
    # a null key is placed by its text, so that nulls don't pile up on one arc
    rows = rows.withColumn(
        "at",
        F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.col("text_crc32").cast("string")))),
    ).withColumn("bin", F.shiftrightunsigned("at", 64 - bin_bits).cast("int"))
    equal = rows.groupBy("bin", "at", "doc_id", "text_crc32", "size").agg(F.count("*").alias("n"))
    order = Window.partitionBy("bin").orderBy("at", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    equal = equal.withColumns({"row": F.sum("n").over(order) - F.col("n"), "byte": F.sum(F.col("n") * F.col("size")).over(order) - F.col("n") * F.col("size")})
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    most = max(1, int(PIECE * slack * total / shards))
    chunk = equal.withColumn("from_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))))
    # the parts of a key with very many rows are dealt out
    parts = chunk.where(F.col("n") <= CHUNK).unionByName(chunk.where(F.col("n") > CHUNK).repartition("from_", "at"))
    each = parts.withColumn("i", F.explode(F.expr(f"sequence(from_, least(from_ + {CHUNK}, n) - 1)"))).select(
        "bin", "doc_id", "size", "text_crc32", (F.col("row") + F.col("i")).alias("nth"),
        ((F.col("byte") + F.col("i") * F.col("size")) / most).cast("long").alias("piece"),
    )
    pieces = each.groupBy("bin", "piece").agg(F.sum("size").alias("load"), F.count("*").alias("n"), F.min("nth").alias("first")).collect()
    at = place({(r["bin"], r["piece"]): r["load"] for r in pieces}, shards, vnodes, slack, bin_bits)
    upto, placed = [0] * shards, []
    for r in sorted(pieces, key=lambda r: (r["bin"], r["piece"])):
        s = at[r["bin"], r["piece"]]
        placed.append((r["bin"], r["piece"], s, upto[s] - r["first"]))
        upto[s] += r["n"]
    # bounded as said above
    where = F.broadcast(spark.createDataFrame(placed, PLACED))
    return each.join(where, ["bin", "piece"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("nth")).cast("long").alias("slot")
    )
