"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule: piecewise-linear knots (t, w) over training
time t in [0, 1].  Its integral, scaled to the source's target number of words,
is the demand for that source's words up to t.  A document covers an interval
of its source's cumulative words (in hash order, the source repeated up to
``max_epochs`` times); inverting the demand at the interval's start gives the
document's training position.  Range-sorting by position gives the mix.

Targets: sources in code-point order (null last) take the ``weights`` in turn
and share ``share`` times all words; a target stops at ``max_epochs`` times its
source's size and what is above goes to the others by weight.  This is a water
level, found in closed form with window functions over one row per source.

Scale: cumulative sums run in two steps, inside (source, hash bin) and over at
most 4,096 bins of a source, so a source with a third of all rows is spread
over as many groups as any other.  Whole rows move in the range sort, and meet their
places before it: by a broadcast of the narrow plan while that is small, else by a join.

Defined cases: a null text has no words and is never taken; a null source is a
source of its own (last); a null id hashes as the empty text; repeated rows are
separate rows; rows with one id differ in place by their texts; extra columns are carried in ``row`` on request and can't clash;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickline.llm.common import WORD, stored

#: Up to this measured size the plan is broadcast to the texts.
BROADCAST_BYTES = 32 << 20
Knots = Sequence[tuple[float, float]]
WEIGHTS = (3, 1, 2)
#: Early, even and late emphasis, taken in turn as the weights are.
SCHEDULES: tuple[Knots, ...] = (
    ((0.0, 1.6), (0.5, 0.8), (1.0, 0.8)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.4), (1.0, 1.6)),
)


def inverted(u: Column, knots: Knots) -> Column:
    """The time at which the share u of the schedule's integral is reached."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False)]
    total, before, found = sum(areas), 0.0, None
    if total <= 0:
        raise ValueError("a schedule needs a positive integral")
    for i, (((t0, w0), (t1, w1)), area) in enumerate(zip(zip(knots, knots[1:], strict=False), areas, strict=True)):
        slope = (w1 - w0) / (t1 - t0)
        rest = F.greatest(u * F.lit(total) - F.lit(before), F.lit(0.0))
        under = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0))) + F.lit(w0)
        at = F.least(F.lit(t0) + F.when(under > 0, 2 * rest / under).otherwise(F.lit(0.0)), F.lit(t1))
        before += area
        inside = u * F.lit(total) <= F.lit(before)
        if i == len(areas) - 1:
            inside = F.lit(True)
        found = F.when(inside, at) if found is None else found.when(inside, at)
    return found


def source_targets(
    sizes: DataFrame, weights: Sequence[int], share: float, max_epochs: int
) -> DataFrame:
    """sizes: (source, source_size), one row per source -> with nth and target."""
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    every = Window.partitionBy(F.lit(0))
    by_ratio = every.orderBy(F.col("cap") / F.col("w"), "nth")
    return (
        sizes.withColumn("nth", nth)
        .withColumn("w", F.get(cycle, (F.col("nth") % len(weights)).cast("int")))
        .withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
        .withColumn("demand", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("capped", F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("open_w", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("demand") - F.coalesce("capped", F.lit(0.0))) / F.col("open_w"))
        .withColumn("target", F.least("cap", F.col("w") * F.max("level").over(every)))
        .select("source", "source_size", "nth", "target")
    )


def place_hash() -> Column:
    """A document's place in its source: the text's hash spreads null and repeated ids, and orders them."""
    own = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text").cast("string"))
    return F.md5(own.cast("binary"))


def mix_plan(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = 1.5,
    max_epochs: int = 2,
    schedules: Sequence[Knots] = SCHEDULES,
    keep_row: bool = False,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, start, takes,
    positions (arrays by epoch) and, on request, ``row`` with all its columns.

    takes[e] is the number of the document's words taken in epoch e (the document
    in which the target is reached is taken in part); positions[e] is null where
    nothing is taken.
    """
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    h = place_hash()
    rows = docs.select(
        *([F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")] if keep_row else []),
        "doc_id", "source", words.alias("size"), h.alias("h"), F.substring(h, 1, 3).alias("bin"),
    )
    narrow = rows.select("source", "bin", "size")
    bins = narrow.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    sizes = bins.groupBy("source").agg(F.sum("bin_size").cast("long").alias("source_size"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("bin_start", F.coalesce(F.sum("bin_size").over(before), F.lit(0)))
    targets = source_targets(sizes, weights, share, max_epochs)
    plan = bins.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select(
        F.col("b.source").alias("p_source"), F.col("b.bin").alias("p_bin"), "bin_start", "source_size", "nth", "target"
    )
    inside = Window.partitionBy("source", "bin").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, 0)
    out = (
        rows.withColumn("upto", F.sum("size").over(inside))
        .join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("bin") == F.col("p_bin")))
        .withColumn("start", F.col("bin_start") + F.col("upto") - F.col("size"))
        .withColumn("goal", F.round("target").cast("long"))
    )
    epochs = range(max_epochs)
    begin = [F.col("start") + F.col("source_size") * e for e in epochs]
    takes = [F.greatest(F.lit(0), F.least(F.col("size"), F.col("goal") - b)).cast("long") for b in begin]
    nth_schedule = F.col("nth") % len(schedules)

    def position(b: Column) -> Column:
        u = b / F.col("target")
        case = F.when(nth_schedule == 0, inverted(u, schedules[0]))
        for i, knots in enumerate(schedules[1:], 1):
            case = case.when(nth_schedule == i, inverted(u, knots))
        return case

    return out.select(
        *(["row"] if keep_row else []),
        "doc_id", "h", "source", "size", "source_size", "target", "start",
        F.array(*takes).alias("takes"),
        F.array(*[F.when(t > 0, position(b)) for t, b in zip(takes, begin, strict=True)]).alias("positions"),
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of docs, a row for each copy, sorted by position.

    Here a document is whole or absent: a copy counts when at least half of it
    lies below the target, so a source differs from its target by half a document.
    """
    def copies(plan: DataFrame, *keep: str) -> DataFrame:
        each = plan.select(*keep, "size", F.posexplode(F.arrays_zip("takes", "positions")).alias("epoch", "copy"))
        whole = each.where((F.col("copy.takes") > 0) & (F.col("copy.takes") * 2 >= F.col("size")))
        return whole.select(*keep, "epoch", F.col("copy.positions").alias("position"))

    plan = stored(copies(mix_plan(docs, **options), "h"), "mix-plan")
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    if plan.groupBy("h", "epoch").count().where("count > 1").isEmpty():
        # texts meet their places, and move once, in the sort
        small = F.broadcast(plan) if plan.count() * 96 <= BROADCAST_BYTES else plan
        placed = docs.select(row, place_hash().alias("own")).join(small, F.col("own") == F.col("h"))
    else:
        placed = copies(mix_plan(docs, keep_row=True, **options), "row")
    return placed.orderBy("position", "epoch").select("row.*")
