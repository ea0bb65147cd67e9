"""SimHash near-duplicates, linked through deletion-variant signatures.

A 64-bit fingerprint is the majority, bit by bit, of the hashes of a text's
word shingles.  Fingerprints within ``distance`` bits are linked: cut into
``distance // 2 + 1`` segments, at least one segment of two linked fingerprints
differs by at most one bit, so the two share a variant of that segment with one
bit as a wildcard.  The variants are the index; an equality join on them finds
the candidates, and counting the differing bits verifies each.  A pair is
reported by the first variant that it shares only.

Scale: only distinct fingerprints are indexed, so copies cost nothing, however
many.  A variant that more than ``DENSE`` fingerprints share is not joined:
its members meet in the values between them.  Two fingerprints are linked just
if some value is within ``distance // 2`` bits of one and within the rest of the
other; each value keeps one member of the first kind as its hub, to which the
others are linked.  That is a fixed number of rows a member (2,081 at three
bits), whatever the group's size, and the components stay exact.  Components come from alternating large-star and
small-star steps, each round written to the shared folder; nothing but counts
reaches the driver.

Defined cases: a null text has no words and so fingerprint zero, which links
like any other; a null doc_id is never the smallest id, and a component of null
ids only has a null component_id; repeated rows are rows of their own; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from brickline.llm.common import bounded_batches, free_names, stored

SEED = 42
#: Fingerprints that share a variant before the values between them take over.
DENSE = 1024
#: Bytes of variants that a task makes, and bytes of a variant's row.
TASK_BYTES, VARIANT_BYTES = 64 << 20, 40
#: Shingles hashed before their bits are counted.
BATCH = 1 << 19
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of each word shingle, repeats included; of the whole if shorter."""
    words = text.lower().split()
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxh64_intdigest(joined, SEED)] if words else []
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends)]
    return [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :], strict=False)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of counts[i] hashes (none: zero)."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    # runs are cut into pieces of at most 255, so that a byte can count a bit
    pieces = -(-n // 255)
    first = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    begin = np.concatenate([[0], np.cumsum(n)[:-1]])
    at = np.repeat(begin, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & LANES, at)
        totals = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        bits = (2 * totals > n[:, None]).astype(np.uint64) << (8 * np.arange(8, dtype=np.uint64) + np.uint64(shift))
        out[full] |= np.bitwise_or.reduce(bits, axis=1)
    return out


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, counts, hashes = [], [], []
            for text in batch.column("text"):
                h = shingle_hashes(text.as_py() or b"", width)
                counts.append(len(h))
                hashes += h
                if len(hashes) >= BATCH:
                    done.append(majority(np.array(hashes, np.uint64), np.array(counts)))
                    counts, hashes = [], []
            done.append(majority(np.array(hashes, np.uint64), np.array(counts, np.int64)))
            values = np.concatenate(done).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(values)],
                [*batch.schema.names[:-1], "fp"],
            )

    return run


def fingerprints(docs: DataFrame, width: int = 3, keep: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, the columns of keep (aliased) and fp (the 64 bits as a signed long)."""
    bounded_batches(docs)
    rows = docs.select("doc_id", *keep, F.encode("text", "utf-8").alias("text"))
    kinds = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes[:-1])
    return rows.mapInArrow(_fingerprints(width), f"{kinds}, fp long")


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment."""
    n = distance // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def part(x: str, first: int, bits: int) -> str:
    mask = (1 << bits) - 1
    return x if bits == 64 else f"(shiftrightunsigned({x}, {first}) & {mask}L)"


def variants(distinct: DataFrame, distance: int) -> DataFrame:
    """seg, hole, rest, fp: every segment with every bit of it as a wildcard."""
    cells = ", ".join(
        f"transform(sequence(0, {bits - 1}), w -> struct({i} as seg, w as hole,"
        f" {part('fp', first, bits)} & ~shiftleft(1L, w) as rest))"
        for i, (first, bits) in enumerate(segments(distance))
    )
    return distinct.selectExpr("fp", f"explode(concat({cells})) as v").select("v.seg", "v.hole", "v.rest", "fp")


def masks(bits: int) -> list[int]:
    """All values of up to so many set bits, as signed longs."""
    every = [sum(1 << b for b in c) for n in range(bits + 1) for c in combinations(range(64), n)]
    return [x - (1 << 64) if x >> 63 else x for x in every]


def hub_links(members: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) of fingerprints (fp) with the same components as all links within distance."""
    near = lambda bits: F.explode(F.lit(np.array(masks(bits), np.int64))).alias("mask")
    hubs = members.select("fp", near(distance // 2)).groupBy(F.expr("fp ^ mask").alias("between")).agg(F.min("fp").alias("hub"))
    others = members.select("fp", near(distance - distance // 2)).select("fp", F.expr("fp ^ mask").alias("between"))
    met = others.join(dealt(hubs), "between").where("fp <> hub")
    return met.select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b")).distinct()


def links(distinct: DataFrame, distance: int = 3, dense: int = DENSE) -> DataFrame:
    """Linked fingerprints (a, b), a < b; of groups that share a variant with more than
    dense members, links with the same components.  distinct: one column, fp."""
    # a stored table of fingerprints is small; its variants are many
    rows = distinct.count() * sum(bits for _, bits in segments(distance))
    index = variants(distinct.repartition(max(8, rows * VARIANT_BYTES // TASK_BYTES), "fp"), distance)
    key = ["seg", "hole", "rest"]
    crowded = stored(
        index.groupBy(*key).count().where(F.col("count") > dense), "simhash-dense"
    )
    none_crowded = crowded.isEmpty()
    light = index if none_crowded else index.join(dealt(crowded), key, "left_anti")
    x = "(a ^ b)"
    lower, found = "", []
    for i, (first, bits) in enumerate(segments(distance)):
        found.append(f"(seg = {i} and (hole = 0 or {part(x, first, bits)} <> 0){lower})")
        lower += f" and bit_count({part(x, first, bits)}) > 1"
    pairs = (
        light.withColumnRenamed("fp", "a")
        .join(dealt(light.withColumnRenamed("fp", "b")), key)
        .where(f"a < b and bit_count({x}) <= {distance} and ({' or '.join(found)})")
        .select("a", "b")
    )
    if none_crowded:
        return pairs
    return pairs.unionByName(hub_links(stored(index.join(dealt(crowded), key).select("fp").distinct(), "simhash-members"), distance))


def dealt(df: DataFrame) -> DataFrame:
    """df, to be shuffled in a join.  Its file is short, but as a broadcast it would stand in the
    driver's memory several times over, and one that grows with the input for each round."""
    return df.hint("merge")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable), for the nodes of edges (a, b)."""
    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(dealt(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(dealt(least), "a")
        now = stored(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b"))).distinct(),
            "links",
        )
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 3, keep: tuple[Column, ...] = ()) -> DataFrame:
    """One row per document: doc_id, the columns of keep, fp, root (the component's
    smallest fingerprint, as a signed long) and component_id."""
    fps = stored(fingerprints(docs, width, keep), "fingerprints")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    joined = components(links(distinct.select("fp"), distance))
    members = stored(
        distinct.join(dealt(joined), F.col("fp") == F.col("node"), "left").select(
            "fp", "first_id", F.coalesce("root", "fp").alias("root")
        )
        .unionByName(distinct.join(dealt(joined.select("root").distinct()), F.col("fp") == F.col("root")).select("fp", "first_id", "root"))
        .distinct(),
        "members",
    )
    smallest = members.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = members.select("fp", "root").join(dealt(smallest), "root")
    return fps.join(dealt(labels), "fp").select("doc_id", *[c for c in fps.columns if c not in ("doc_id", "fp")], "fp", "root", "component_id")


def deduplicated(docs: DataFrame, width: int = 3, distance: int = 3) -> DataFrame:
    """The documents, all columns as they were, one of each component: the one of
    the smallest doc_id (null ids last; the text's hash breaks ties)."""
    text_hash = F.xxhash64("text")
    marked = near_duplicates(docs, width, distance, (text_hash.alias("text_hash"),))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    kept = stored(
        marked.groupBy("root").agg(first.alias("k"), F.count("*").alias("n"))
        .select(F.col("k.doc_id").alias("k_id"), F.col("k.text_hash").alias("k_hash"), "n"),
        "kept",
    )
    return kept_rows(docs, kept.drop("n"))


def kept_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The documents named by kept (k_id, k_hash: doc_id and the text's hash)."""
    id_, hash_ = free_names(docs, "k_id", "k_hash")
    kept = kept.withColumnsRenamed({"k_id": id_, "k_hash": hash_})
    text_hash = F.xxhash64("text")
    out = docs.join(kept, docs["doc_id"].eqNullSafe(F.col(id_)) & (text_hash == F.col(hash_)), "left_semi")
    again = stored(docs.groupBy(F.col("doc_id").alias(id_), text_hash.alias(hash_)).count().where("count > 1").drop("count"), "repeated")
    if again.isEmpty():
        return out
    # rows repeated with id and text are copies of one another: one stays, the first as JSON
    same = out["doc_id"].eqNullSafe(F.col(id_)) & (text_hash == F.col(hash_))
    whole = F.struct(*[out[f"`{c}`"] for c in out.columns])
    repeated = out.join(again, same).select(F.col(id_).alias("i"), F.col(hash_).alias("h"), whole.alias("row"), F.to_json(whole).alias("as_text"))
    first = repeated.groupBy("i", "h").agg(F.min_by("row", "as_text").alias("row")).select("row.*")
    return out.join(again, same, "left_anti").unionByName(first)
