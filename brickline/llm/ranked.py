"""Ranked lexical search with per-term geometric blocking.

Each posting list is clustered by the similarity of its documents: every ``BLOCK``-th
document is a centre, and a document joins the centre that its vector of weighted terms,
projected to ``DIMENSIONS`` fixed directions, is nearest to.  A block keeps the largest
part of a score that any of its documents has (the coordinatewise maximum), for each
term that some query asks together with the list's.  The sum of the summary over a
query's terms bounds every score in the block, in whole numbers, so a block is skipped
just if its bound is below the score that the query's last place already needs, and the
result is exact, ties included.

Scale: the documents are read once, into a table of their counts of the asked terms;
counts over all documents give the weights.  The index lies in shards of ``SHARD``
documents, each with its lists, blocks and summaries, stored as rows of one table, so a
term of all documents is a list in every shard and nobody's single task.  A search reads
the shards; a task carries each query's best scores from shard to shard, which raises
what a block has to beat, and hands on ``k`` rows a query.  Queries go in groups of up
to ``MOST_TERMS`` different terms, one pass a group, which bounds what is broadcast.

Defined cases: a null text has no terms, and its document or query no rank; a null id
goes after others of the same score and is returned as null; a repeated document or
query counts and is ranked as often as it occurs; texts of any length are counted whole,
in pieces; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brickline.llm.common import stored

#: Terms: digits, ASCII letters in lower case and all that isn't ASCII, in UTF-8.
TERM, SEPARATOR = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")
#: Documents to a shard and to a block, directions of the projection.
SHARD, BLOCK, DIMENSIONS = 1024, 16, 16
#: Different terms of the queries that are asked at once; bytes of text counted at once.
MOST_TERMS, PIECE = 4096, 1 << 20
#: Cells of a shard's table of documents and terms, at most.
CELLS = 1 << 24
#: Blocks that are looked into before the needed score is taken anew.
FIRST, GROWTH = 4, 4
NO_ID = (1 << 63) - 1


def pieces(raw: bytes) -> Iterator[bytes]:
    """The text in pieces that no term crosses."""
    start = 0
    while start < len(raw):
        cut = SEPARATOR.search(raw, start + PIECE)
        end = cut.end() if cut else len(raw)
        yield raw[start:end]
        start = end


def counts_of(text: str | None) -> Counter:
    found: Counter = Counter()
    for piece in pieces((text or "").encode().lower()):
        found.update(TERM.findall(piece))
    return found


# -- counts ------------------------------------------------------------------------

COUNTS = "doc_id long, n long, ids array<int>, tfs array<int>"


def _counted(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            keep, sizes, ids, tfs, ends = [], [], [], [], [0]
            for i, text in enumerate(batch.column("text")):
                found = counts_of(text.as_py())
                if not found:
                    continue
                keep.append(i)
                sizes.append(found.total())
                for term in found.keys() & known.keys():
                    ids.append(known[term])
                    tfs.append(found[term])
                ends.append(len(ids))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32())),
                ],
                ["doc_id", "n", "ids", "tfs"],
            )

    return run


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Stored: doc_id, n, ids, tfs of each document with a term; ids and tfs of the asked ones."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(rows.mapInArrow(_counted(shared), COUNTS), "ranked-counts")


def term_weights(counts: DataFrame, terms: int) -> tuple[np.ndarray, int, int]:
    """The weight of each asked term, the number of documents and of their terms."""
    n, length = counts.agg(F.count("*"), F.sum("n")).first()
    weights = np.zeros(terms, np.int64)
    # one row for each of at most MOST_TERMS asked terms (or one query's)
    for r in counts.select(F.explode("ids").alias("id")).groupBy("id").count().collect():
        weights[r["id"]] = math.floor(1000 * math.log((2 * n + 2) / (2 * r["count"] + 1)))
    return weights, n, length or 1


# -- index -------------------------------------------------------------------------

#: A shard: its documents, its table (of document at, term, part of the score), its blocks
#: (term, end in members), and the summaries by term (end of each, block, largest part).
INDEX = "doc_ids array<long>, " + ", ".join(f"{c} binary" for c in ("terms", "at", "term", "part", "block_term", "block_end", "members", "term_end", "in_block", "most"))


def clustered(rows: np.ndarray, vectors: np.ndarray) -> list[np.ndarray]:
    """A posting list (documents) cut into blocks of similar ones."""
    if len(rows) <= BLOCK:
        return [rows]
    own = vectors[rows]
    nearest = np.argmax(own @ own[::BLOCK].T, axis=1)
    order = np.argsort(nearest, kind="stable")
    return np.split(rows[order], np.flatnonzero(np.diff(nearest[order])) + 1)


def asked_together(queries: list[np.ndarray], terms: int) -> np.ndarray | None:
    """Which terms some query asks together; none for a single query, which asks all."""
    if len(queries) == 1:
        return None
    pairs = np.zeros((terms, terms), bool)
    for ids in queries:
        pairs[np.ix_(ids, ids)] = True
    return pairs


def built(doc_ids: np.ndarray, at: np.ndarray, ids: np.ndarray, part: np.ndarray, weights: np.ndarray, together: np.ndarray | None = None) -> dict:
    """A shard's row: at, ids, part are its postings (document, term, part of the score)."""
    terms, term = np.unique(ids, return_inverse=True)
    table = np.zeros((len(doc_ids), len(terms)), np.int32)
    table[at, term] = part
    directions = np.random.default_rng(7).standard_normal((len(weights), DIMENSIONS)).astype(np.float32)[terms]
    vectors = table.astype(np.float32) @ (directions * weights[terms, None].astype(np.float32))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True) + np.float32(1e-9)
    order = np.lexsort((at, term))
    lists = np.split(at[order], np.flatnonzero(np.diff(term[order])) + 1) if len(order) else []
    block_term, blocks, of_term, in_block, most = [], [], [], [], []
    for t, rows in enumerate(lists):
        asked = np.arange(len(terms)) if together is None else np.flatnonzero(together[terms[t]][terms])
        for block in clustered(rows, vectors):
            top = table[np.ix_(block, asked)].max(axis=0)
            here = np.flatnonzero(top)
            of_term.append(asked[here].astype(np.int32))
            most.append(top[here])
            in_block.append(np.full(len(here), len(blocks), np.int32))
            block_term.append(t)
            blocks.append(block)
    joined = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int32)
    of_term, in_block, most = joined(of_term), joined(in_block), joined(most)
    order = np.argsort(of_term, kind="stable")
    pack = lambda x: np.ascontiguousarray(x, "<i4").tobytes()
    return {
        "doc_ids": doc_ids, "terms": pack(terms), "at": pack(at), "term": pack(term), "part": pack(part), "block_term": pack(block_term),
        "block_end": pack(np.cumsum([len(b) for b in blocks])), "members": pack(joined(blocks)),
        "term_end": pack(np.searchsorted(of_term[order], np.arange(len(terms)), "right")), "in_block": pack(in_block[order]), "most": pack(most[order]),
    }


def _indexed(weights: np.ndarray, n: int, length: int, shared):
    """m and the parts of the scores are 64-bit integers, divided rounding down."""
    shard = max(1, min(SHARD, CELLS // max(1, len(weights))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("doc_ids", pa.list_(pa.int64())), *[(c.split()[0], pa.binary()) for c in INDEX.split(", ")[1:]]])
        together = asked_together(shared.value, len(weights))
        held, size = [], 0

        def row() -> pa.RecordBatch:
            ids, counts, terms, parts = (np.concatenate(x) for x in zip(*held, strict=True))
            made = built(ids, np.repeat(np.arange(len(ids)), counts), terms, parts, weights, together)
            cells = [pa.array([made["doc_ids"]], kind[0].type), *[pa.array([made[f.name]], f.type) for f in list(kind)[1:]]]
            return pa.RecordBatch.from_arrays(cells, schema=kind)

        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column("ids")), 0))
            for start in range(0, len(batch), shard):
                rest = batch.slice(start, shard)
                while len(rest):
                    some, rest = rest.slice(0, shard - size), rest.slice(shard - size)
                    ids = pc.fill_null(some.column("doc_id"), NO_ID).to_numpy(zero_copy_only=False)
                    counts = pc.list_value_length(some.column("ids")).to_numpy(zero_copy_only=False).astype(np.int64)
                    terms, tfs = (some.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ids", "tfs"))
                    m = 100 - 25 + (25 * some.column("n").to_numpy(zero_copy_only=False) * n) // length
                    held.append((ids, counts, terms, (1_000_000_000 * tfs) // (1000 * tfs + 12 * np.repeat(m, counts))))
                    size += len(some)
                    if size == shard:
                        yield row()
                        held, size = [], 0
        if held:
            yield row()

    return run


def build_index(counts: DataFrame, queries: list[np.ndarray], weights: np.ndarray, n: int, length: int) -> DataFrame:
    """The stored index: a row for each shard, a few to a group of rows in the files.
    queries: the terms that each asks."""
    shared = counts.sparkSession.sparkContext.broadcast(queries)
    made = counts.mapInArrow(_indexed(weights, n, length, shared), INDEX)
    return stored(made, "ranked-index", **{"parquet.block.row.count.limit": 4})


# -- search ------------------------------------------------------------------------

FOUND = "q int, doc_id long, score long"


class Best:
    """The k best (score, id) of a query so far."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def needed(self) -> int:
        """A document of less has no place."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.needed()
        scores, ids = np.concatenate([self.scores, scores[good]]), np.concatenate([self.ids, ids[good]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def searched(row: dict, queries: list[tuple[np.ndarray, np.ndarray]], best: list[Best]) -> int:
    """Look a shard through for all queries (asked terms, worth of each); blocks looked into."""
    whole = {c: np.frombuffer(row[c], "<i4") for c in row if c != "doc_ids"}
    doc_ids = np.array(row["doc_ids"], np.int64)
    terms, block_term, block_end, term_end = (whole[c] for c in ("terms", "block_term", "block_end", "term_end"))
    table = np.zeros((len(doc_ids), len(terms)), np.int32)
    table[whole["at"], whole["term"]] = whole["part"]
    seen = 0
    for (ids, worth), top in zip(queries, best, strict=True):
        at = np.searchsorted(terms, ids)
        here = terms[np.minimum(at, len(terms) - 1)] == ids
        at, value = at[here], worth[here]
        bound = np.zeros(len(block_term), np.int64)
        for t, w in zip(at.tolist(), value.tolist(), strict=True):
            cut = slice(term_end[t - 1] if t else 0, term_end[t])
            bound[whole["in_block"][cut]] += w * whole["most"][cut].astype(np.int64)
        first, last = np.searchsorted(block_term, at, "left"), np.searchsorted(block_term, at, "right")
        blocks = np.concatenate([np.arange(a, b) for a, b in zip(first, last, strict=True)]) if len(at) else first
        blocks = blocks[np.argsort(-bound[blocks], kind="stable")]
        visited, start, step = np.zeros(len(doc_ids), bool), 0, FIRST
        while start < len(blocks) and bound[blocks[start]] >= top.needed():
            some = blocks[start : start + step]
            some = some[bound[some] >= top.needed()]
            members = np.concatenate([whole["members"][block_end[b - 1] if b else 0 : block_end[b]] for b in some])
            members = np.unique(members[~visited[members]])
            visited[members] = True
            top.add(table[np.ix_(members, at)].astype(np.int64) @ value, doc_ids[members])
            seen += len(some)
            start, step = start + step, step * GROWTH
    return seen


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        best = [Best(k) for _ in queries]
        for batch in batches:
            for i in range(len(batch)):
                searched(batch.slice(i, 1).to_pylist()[0], queries, best)
        qs = np.repeat(np.arange(len(best), dtype=np.int32), [len(b.ids) for b in best])
        if len(qs):
            ids = np.concatenate([b.ids for b in best])
            yield pa.RecordBatch.from_arrays([pa.array(qs), pa.array(ids, mask=ids == NO_ID), pa.array(np.concatenate([b.scores for b in best]))], ["q", "doc_id", "score"])

    return run


def query_groups(items: DataFrame) -> Iterator[list[tuple]]:
    """The queries (item_id, counts) in groups of up to MOST_TERMS different terms, or one query."""
    group, terms = [], set()
    for r in items.select("item_id", "text").toLocalIterator():
        found = counts_of(r["text"])
        if group and len(terms | found.keys()) > MOST_TERMS:
            yield group
            group, terms = [], set()
        if found:
            group.append((r["item_id"], found))
            terms |= found.keys()
    if group:
        yield group


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each query."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    out = None
    for group in query_groups(items):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, found in group for t in found}))}
        counts = term_counts(docs, vocabulary)
        weights, n, length = term_weights(counts, len(vocabulary))
        queries = []
        for _, found in group:
            ids = np.array(sorted(vocabulary[t] for t in found), np.int64)
            times = {vocabulary[t]: m for t, m in found.items()}
            queries.append((ids, weights[ids] * np.array([times[i] for i in ids.tolist()], np.int64)))
        index = build_index(counts, [ids for ids, _ in queries], weights, n, length)
        found = index.mapInArrow(_search(spark.sparkContext.broadcast(queries), k), FOUND)
        order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(group)], f"at_q int, item_id {kind}")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        part = ranked.join(F.broadcast(names), F.col("q") == F.col("at_q")).select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out


def oracle(k: int = 20) -> str:
    """The same ranking in DuckDB SQL, every document scored."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    split = f"list_filter(regexp_split_to_array({low}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {split} AS w FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id, {split} AS w FROM benchmark),
c AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
asked AS (SELECT q, t, count(*) AS m FROM (SELECT q, unnest(w) AS t FROM b) GROUP BY 1, 2),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM asked) GROUP BY 1, 2),
weight AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(n) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS wt FROM tf, c GROUP BY 1),
s AS (SELECT q, r, CAST(sum(m * wt * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(w) * n) // l)))) AS BIGINT) AS score
FROM asked JOIN weight USING (t) JOIN tf USING (t) JOIN d USING (r), c GROUP BY 1, 2),
ranked AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s JOIN d USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN b USING (q) WHERE rank <= {k}"""
