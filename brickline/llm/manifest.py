"""Merkle dataset manifest: trees of fan-out 8, kept as a postorder append log.

Builders are aligned: each takes ``FAN ** LEVELS`` consecutive nodes of a tree and
writes every node above them in the order in which they are completed.  In that order
a node's place is known from sizes alone: before leaf e stand e leaves and, at each
level k, e // 8**k completed nodes, so node j of level k stands at

    e + sum(e // 8**i for i >= 1) + k,    e = min((j + 1) * 8**k, leaves) - 1.

Proofs are read from the log by these places: a node's siblings are the other nodes of
its run of 8, level by level.  The roots of the builders' ranges are the next tier's
nodes, so all is built bottom up and proved top down in log(n) / log(512) tiers.  The
trees' roots, in the order of their keys, are the leaves of one more tree.

Scale: texts are read once and never shuffled; a leaf is a row of digests.  Leaves are
numbered in a range-sorted table by adding up the parts' counts; rows that repeat are
told apart by a stored number, so no key is one task's.  A builder holds 512 nodes, a
proof is a path of strings.  Only the largest tree's size and the root reach the driver.

Defined cases: a null lang is a tree of its own, before the others; a null id goes
before the others of its tree and counts as the empty text where ids are hashed; rows of
one id go by their leaves; repeated rows are leaves each; texts are hashed whole; extra
columns are ignored; an empty table has no root and gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brickline.llm.common import ascii_lower, crc32_of_id, stored

FAN, LEVELS = 8, 3
#: Nodes that a builder takes.
SPAN = FAN**LEVELS
#: Leaves to a part of the range-sorted table.
PART_ROWS = 1 << 18
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def H(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def height(leaves: int) -> int:
    """Levels above the leaves."""
    k = 0
    while leaves > 1:
        leaves, k = -(-leaves // FAN), k + 1
    return k


def position(level: int, index: int, leaves: int) -> int:
    """The place of a node in the log of a tree of so many leaves."""
    last = min((index + 1) * FAN**level, leaves) - 1
    at, below = last + level, last // FAN
    while below:
        at, below = at + below, below // FAN
    return at


def leaf_of(text: Column) -> Column:
    """The digest (32 bytes) of a row's fields, with this text."""
    fields = [(text if f == "text" else F.col(f)).cast("string") for f in FIELDS]
    parts = [F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in fields]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds idx, from 0 in each tree by order, and leaves, the tree's size.  Rows that
    order doesn't tell apart are numbered as they come."""
    once = stored(rows.withColumn("row_", F.monotonically_increasing_id()), "manifest-leaves")
    parts = max(1, once.count() // PART_ROWS)
    keys = ["tree", *order, "row_"]
    part = stored(once.repartitionByRange(parts, *keys).withColumn("part_", F.spark_partition_id()), "manifest-ranges")
    counts = part.groupBy("tree", "part_").count()
    upto = Window.partitionBy("tree").orderBy("part_").rowsBetween(Window.unboundedPreceding, 0)
    before = counts.select(
        F.col("tree").alias("t_"), F.col("part_").alias("p_"),
        (F.sum("count").over(upto) - F.col("count")).alias("before_"), F.sum("count").over(Window.partitionBy("tree")).alias("leaves"),
    )
    within = F.row_number().over(Window.partitionBy("tree", "part_").orderBy(*order, "row_"))
    return (
        part.withColumn("nth_", within).join(before, (F.col("tree") == F.col("t_")) & (F.col("part_") == F.col("p_")))
        .withColumn("idx", F.col("before_") + F.col("nth_") - 1).drop("t_", "p_", "part_", "nth_", "before_", "row_")
    )


#: A stretch of the log: nodes (32 bytes each) and their places, in the order of completion.
SEGMENT = "tree string, chunk long, leaves long, places array<long>, nodes binary, root binary"


def _build(tier: int):
    base = tier * LEVELS

    def run(rows: pa.Table) -> pa.Table:
        """A builder: the nodes above its own, in the order of completion."""
        rows = rows.sort_by("idx")
        tree, chunk, leaves = (rows.column(c)[0].as_py() for c in ("tree", "chunk", "leaves"))
        level = [d.hex() for d in rows.column("digest").to_pylist()]
        nodes = [(position(base, chunk * SPAN + i, leaves), d) for i, d in enumerate(level)] if tier == 0 else []
        for up in range(1, min(LEVELS, height(leaves) - base) + 1):
            level = [H(*level[i : i + FAN]) for i in range(0, len(level), FAN)]
            first = chunk * SPAN // FAN**up
            nodes += [(position(base + up, first + i, leaves), d) for i, d in enumerate(level)]
        nodes.sort()
        return pa.table({
            "tree": pa.array([tree], pa.string()), "chunk": pa.array([chunk], pa.int64()), "leaves": pa.array([leaves], pa.int64()),
            "places": pa.array([[p for p, _ in nodes]], pa.list_(pa.int64())), "nodes": pa.array([bytes.fromhex("".join(d for _, d in nodes))], pa.binary()),
            "root": pa.array([bytes.fromhex(level[0])], pa.binary()),
        })

    return run


def in_chunks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("chunk", F.expr(f"idx div {SPAN}"))


@dataclass
class Log:
    """The log of some trees: the first tier's nodes (tree, idx, leaves, digest and more)
    and each tier's segments."""

    nodes: DataFrame
    tiers: list[DataFrame]

    def roots(self) -> DataFrame:
        """tree, digest of each tree."""
        return self.tiers[-1].select("tree", F.col("root").alias("digest"))


def build(nodes: DataFrame) -> Log:
    """Write the log of all trees; nodes: tree, idx, leaves, digest and more."""
    nodes = stored(in_chunks(nodes), "manifest-nodes")
    most, tiers, now = nodes.agg(F.max("leaves")).first()[0] or 0, [], nodes
    while True:
        made = now.select("tree", "chunk", "idx", "leaves", "digest").groupBy("tree", "chunk").applyInArrow(_build(len(tiers)), SEGMENT)
        tiers.append(stored(made, "manifest-log"))
        if most <= SPAN ** len(tiers):
            return Log(nodes, tiers)
        now = in_chunks(tiers[-1].select("tree", F.col("chunk").alias("idx"), "leaves", F.col("root").alias("digest")))


def chunk_paths(segment: dict, tier: int) -> list[list[tuple[str, str]]]:
    """For each node that the segment's builder took: the hex digests of its siblings to
    the left and to the right, level by level up to the segment's root."""
    base, leaves, first = tier * LEVELS, segment["leaves"], segment["chunk"] * SPAN
    places, raw = np.array(segment["places"], np.int64), segment["nodes"].hex()

    def digest(level: int, index: int) -> str:
        at = int(np.searchsorted(places, position(level, index, leaves)))
        return raw[64 * at : 64 * at + 64]

    own = min(SPAN, -(-leaves // FAN**base) - first)
    levels = min(LEVELS, height(leaves) - base)
    # from the top down: a node's path is its run's siblings, then its parent's path
    paths: list[list[tuple[str, str]]] = [[]]
    for level in reversed(range(levels)):
        start, n = first // FAN**level, -(-own // FAN**level)
        if level or tier == 0:
            here = [digest(base + level, start + i) for i in range(n)]
        else:  # the builder's own nodes stand in the tier below
            here = segment["below"]
        lower = []
        for i in range(n):
            run = here[i // FAN * FAN : i // FAN * FAN + FAN]
            lower.append([("".join(run[: i % FAN]), "".join(run[i % FAN + 1 :])), *paths[i // FAN]])
        paths = lower
    return paths


PATH = "tree string, chunk long, path array<struct<left:string,right:string>>"
STEP = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _paths(tier: int):
    def run(below: pa.Table, segment: pa.Table) -> pa.Table:
        """Paths to the tree's root of the nodes that a builder of an upper tier took."""
        below, s = below.sort_by("idx"), segment.to_pylist()[0]
        s["below"] = [d.hex() for d in below.column("digest").to_pylist()]
        rest = [(p["left"], p["right"]) for p in s["path"]]
        found = [[{"left": a, "right": b} for a, b in [*p, *rest]] for p in chunk_paths(s, tier)]
        return pa.table({"tree": below.column("tree"), "chunk": below.column("idx"), "path": pa.array(found, STEP)})

    return run


def paths(log: Log) -> DataFrame:
    """tree, chunk, path: of the root of each range of the first tier, up to its tree's root."""
    top = log.tiers[-1].select("tree", "chunk", F.expr("cast(array() as array<struct<left:string,right:string>>)").alias("path"))
    for tier in reversed(range(1, len(log.tiers))):
        below = in_chunks(log.tiers[tier - 1].select("tree", F.col("chunk").alias("idx"), F.col("root").alias("digest")))
        segments = log.tiers[tier].select("tree", "chunk", "leaves", "places", "nodes").join(top, ["tree", "chunk"])
        top = stored(below.groupBy("tree", "chunk").cogroup(segments.groupBy("tree", "chunk")).applyInArrow(_paths(tier), PATH), "manifest-paths")
    return top


def folded(digest: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        digest = H(left, digest, right)
    return digest


PROOF = "doc_id {id}, leaf string, subroot string, proof_sha256 string, folded_root string"


def _prove(leaves: pa.Table, segment: pa.Table) -> pa.Table:
    """Each leaf's proof, and the root folded from the leaf, as tampered with if it was."""
    leaves, s = leaves.sort_by("idx"), segment.to_pylist()[0]
    rest = [(p["left"], p["right"]) for p in s["path"]]
    digests, proofs, roots = [], [], []
    rows = zip(leaves.column("digest").to_pylist(), leaves.column("tampered").to_pylist(), chunk_paths(s, 0), strict=True)
    for digest, tampered, own in rows:
        path = [*own, *rest]
        digests.append(digest.hex())
        proofs.append(H(*[x for step in path for x in step]))
        roots.append(folded((tampered or digest).hex(), path))
    text = lambda xs: pa.array(xs, pa.string())
    return pa.table({
        "doc_id": leaves.column("doc_id"), "leaf": text(digests), "subroot": text([s["subroot"].hex()] * len(digests)),
        "proof_sha256": text(proofs), "folded_root": text(roots),
    })


@dataclass
class Manifest:
    """The log of the trees of a corpus, that of their roots, and the root (hex)."""

    trees: Log
    top: Log | None
    root: str | None


def manifest(docs: DataFrame, tampered: Column | None = None) -> Manifest:
    """Hash, number and log all documents.  tampered: where true, the leaf of the text in
    lower case is kept beside the true one, as if the row had been changed."""
    lower = F.when(tampered, leaf_of(ascii_lower(F.col("text")))) if tampered is not None else F.lit(None).cast("binary")
    tree = F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0"))
    rows = docs.select(tree.alias("tree"), "doc_id", leaf_of(F.col("text")).alias("digest"), lower.alias("tampered"))
    trees = build(numbered(rows, ["doc_id", "digest"]))
    subroots = trees.roots().select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest")
    top = build(numbered(subroots, ["key"]))
    root = top.roots().first()
    return Manifest(trees, top, root["digest"].hex() if root else None)


def proofs(made: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every leaf."""
    kind = dict(made.trees.nodes.dtypes)["doc_id"]
    # a root's path in the top tree follows the path in its own
    top = made.top.nodes.groupBy("tree", "chunk").cogroup(
        made.top.tiers[0].join(paths(made.top), ["tree", "chunk"]).groupBy("tree", "chunk")
    ).applyInArrow(_top_paths, "key string, subroot binary, upper array<struct<left:string,right:string>>")
    segments = (
        made.trees.tiers[0].drop("root").join(paths(made.trees), ["tree", "chunk"])
        .join(stored(top, "manifest-top"), F.col("tree") == F.col("key"))
        .withColumn("path", F.concat("path", "upper")).drop("key", "upper")
    )
    found = made.trees.nodes.groupBy("tree", "chunk").cogroup(segments.groupBy("tree", "chunk")).applyInArrow(_prove, PROOF.format(id=kind))
    return found.select("doc_id", "leaf", "subroot", F.lit(made.root).cast("string").alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(made.root).cast("string")).alias("verified"))


def _top_paths(nodes: pa.Table, segment: pa.Table) -> pa.Table:
    nodes, s = nodes.sort_by("idx"), segment.to_pylist()[0]
    rest = [(p["left"], p["right"]) for p in s["path"]]
    found = [[{"left": a, "right": b} for a, b in [*p, *rest]] for p in chunk_paths(s, 0)]
    return pa.table({"key": nodes.column("key"), "subroot": nodes.column("digest"), "upper": pa.array(found, STEP)})


def verified_documents(docs: DataFrame) -> DataFrame:
    """The proof of every document, checked after tampering with a third of the ids."""
    return proofs(manifest(docs, crc32_of_id(F.col("doc_id")) % 3 == 0))


def oracle(levels: int = 8, upper: int = 4) -> str:
    """The same as DuckDB SQL, a query for each level of trees of up to 8**levels leaves."""
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def leaf(text: str) -> str:
        field = lambda x: f"coalesce(CAST(strlen(CAST({x} AS VARCHAR)) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"
        return "sha256(" + " || ".join(field(text if f == "text" else f) for f in FIELDS) + ")"

    def climb(name: str, n: int) -> str:
        """name0 (tree, i, d) and its levels: what is left is a tree's root."""
        return "".join(
            f""", {name}{k} AS (SELECT tree, i // 8 AS i, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d
FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}{k - 1}) GROUP BY 1, 2)"""
            for k in range(1, n + 1)
        )

    def fold(name: str, start: str, n: int, first: str) -> str:
        """first (r, tree, i, p, f): the proof so far and the folded digest, up through name's levels."""
        out = f", {start}0 AS ({first})"
        for k in range(1, n + 1):
            out += f""", {start}{k} AS (SELECT r, tree, i // 8 AS i, p || a || b AS p, CASE WHEN n = 1 THEN f ELSE sha256(a || f || b) END AS f
FROM (SELECT s.r, s.tree, s.i, any_value(s.p) AS p, any_value(s.f) AS f, any_value(x.n) AS n, coalesce(string_agg(x.d, '' ORDER BY x.i) FILTER (x.i < s.i), '') AS a,
coalesce(string_agg(x.d, '' ORDER BY x.i) FILTER (x.i > s.i), '') AS b
FROM {start}{k - 1} s JOIN (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}{k - 1}) x ON x.tree = s.tree AND x.i // 8 = s.i // 8 GROUP BY s.r, s.tree, s.i))"""
        return out

    return f"""WITH e AS (SELECT *, coalesce('1' || lang, '0') AS tree, {leaf('text')} AS d, CASE WHEN crc % 3 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS t
FROM (SELECT *, {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '')")} AS crc FROM documents)),
l AS (SELECT *, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, d) AS r, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS i FROM e),
t0 AS (SELECT tree, i, d FROM l){climb('t', levels)},
u0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, d FROM t{levels}){climb('u', upper)},
w AS (SELECT tree AS key, row_number() OVER (ORDER BY tree) - 1 AS place, d AS subroot FROM t{levels}),
root AS (SELECT d AS root FROM u{upper})
{fold('t', 's', levels, "SELECT r, tree, i, '' AS p, t AS f FROM l")}
{fold('u', 'v', upper, f"SELECT r, '' AS tree, place AS i, p, f FROM s{levels} JOIN w ON key = tree")}
SELECT doc_id, l.d AS leaf, subroot, root, sha256(p) AS proof_sha256, f AS folded_root, f = root AS verified FROM l JOIN v{upper} USING (r) JOIN w ON key = l.tree, root"""


def crc32_sql(x: str) -> str:
    """crc32 of an ASCII text in DuckDB, bit by bit of the polynomial."""
    shifted = "list_reduce(list_prepend(xor(c, b), range(8)), lambda a, j: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)"
    codes = f"list_transform(range(1, length({x}) + 1), lambda k: CAST(ascii(substr({x}, k, 1)) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {shifted}))"
