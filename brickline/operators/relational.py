"""Relational operators: guarded joins, precedence, de-duplication, merges.

All take DataFrames and column names; orders must be total where a first row is
chosen, so that results don't depend on partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickline.functions.session import materialised


def search_page(df: DataFrame, tests: list[Column | None], order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page and one row more (whose presence says that more follow).  A test
    of None isn't asked for."""
    for test in tests:
        df = df if test is None else df.where(test)
    return df.orderBy(*order).offset(offset).limit(limit + 1)


def count_left(parents: DataFrame, key: str, children: DataFrame, child_key: str, name: str) -> DataFrame:
    """Every parent with the number of its children, 0 if none."""
    counts = children.groupBy(F.col(child_key).alias(key)).agg(F.count("*").alias(name))
    return parents.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def without_superseded(df: DataFrame, keys: list[str], waiting: Column, progressed: Column) -> DataFrame:
    """Waiting rows go if a progressed row has the same keys, null being equal to null.
    One window-free pass: progressed keys are reduced before the null-safe anti join."""
    done = df.where(progressed).select(*[F.col(k).alias(f"done_{k}") for k in keys]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"done_{k}")) for k in keys])
    return df.where(waiting).join(done, same, "left_anti").unionByName(df.where(~F.coalesce(waiting, F.lit(False))))


def two_key_fallback(left: DataFrame, right: DataFrame, first: str, second: str) -> DataFrame:
    """Rows of right by the first key; by the second only where the first finds none."""
    value = [c for c in right.columns if c not in (first, second)]
    by_first = left.join(right.select(first, *value), first).withColumn("matched_by", F.lit(first))
    rest = left.join(right.select(first).distinct(), first, "left_anti")
    by_second = rest.join(right.where(F.col(second).isNotNull()).select(second, *value), second).withColumn("matched_by", F.lit(second))
    return by_first.unionByName(by_second)


def newest_value(df: DataFrame, key: str, value: str, order: list[str], name: str) -> DataFrame:
    """The newest non-empty value of each key."""
    full = df.where(F.col(value).isNotNull() & (F.trim(F.col(value)) != ""))
    return full.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(name))


def most_complete(df: DataFrame, keys: list[str], order: list[Column], fill: list[str], seen: str) -> DataFrame:
    """One row per key, the first by order, its nulls filled from the others in that
    order; seen is the key's first position."""
    every = Window.partitionBy(*keys).orderBy(*order)
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = df.withColumns({c: F.first(c, ignorenulls=True).over(whole) for c in fill} | {"first_seen": F.min(seen).over(Window.partitionBy(*keys))})
    return out.withColumn("nth_of_key", F.row_number().over(every)).where("nth_of_key = 1").drop("nth_of_key")


def first_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of every key; rows without a key all stay."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    keyed = df.where(F.col(key).isNotNull()).withColumn("nth_of_key", first).where("nth_of_key = 1").drop("nth_of_key")
    return keyed.unionByName(df.where(F.col(key).isNull()))


def richer(df: DataFrame, keys: list[str], order: str, scalars: list[str], text: str) -> DataFrame:
    """Merged duplicates: first known scalars, the longest text (the earlier of equals)."""
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in scalars]
    longest = F.max_by(text, F.struct(F.length(F.coalesce(text, F.lit(""))), -F.col(order))).alias(text)
    return df.groupBy(*keys).agg(*firsts, longest, F.count("*").alias("merged"))


def append_new(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """existing and those rows of incoming whose key is new."""
    return existing.unionByName(incoming.join(existing.select(key), key, "left_anti"))


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, order: str, uniques: list[list[str]]) -> DataFrame:
    """The rows of incoming that sequential insertion by order keeps: those that share no
    unique key with an existing row or with an earlier row that is kept.  A key with a null
    is no key; order must be unique.

    Round by round: a row that is the first of all that are left at each of its keys is
    kept, and what shares a key with it goes.  A row that goes bars no later one any more.
    A conflict chain that runs against chance takes a few rounds, each a pass over what is left."""
    def keys(df: DataFrame) -> Column:
        own = [F.when(reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in u]), F.concat(F.lit(f"{i}:"), F.to_json(F.struct(*u)))) for i, u in enumerate(uniques)]
        return F.explode(F.array_compact(F.array(*own))).alias("unique_key")

    taken = existing.select(keys(existing)).distinct()
    left = materialised(incoming.select(F.col(order).alias("nth_row"), keys(incoming)))
    hit = left.join(taken, "unique_key", "left_semi").select("nth_row").distinct()
    left = materialised(left.join(hit, "nth_row", "left_anti"))
    gone = [hit]
    while not left.isEmpty():
        first = left.groupBy("unique_key").agg(F.min("nth_row").alias("first_row"))
        kept = left.join(first, "unique_key").groupBy("nth_row").agg(F.bool_and(F.col("nth_row") == F.col("first_row")).alias("is_first")).where("is_first").select("nth_row")
        kept = materialised(kept)
        barred = left.join(kept, "nth_row", "left_semi").select("unique_key").distinct()
        rest = left.join(kept, "nth_row", "left_anti")
        lost = materialised(rest.join(barred, "unique_key", "left_semi").select("nth_row").distinct())
        gone.append(lost)
        left = materialised(rest.join(lost, "nth_row", "left_anti"))
    out = reduce(lambda a, b: a.unionByName(b), gone)
    return incoming.join(out, F.col(order) == F.col("nth_row"), "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, key: str, updated: list[str], newest: list[Column]) -> DataFrame:
    """Incoming rows (the newest of each key) inserted; on a hit only `updated` changes."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(*newest))
    batch = incoming.withColumn("nth_of_key", first).where("nth_of_key = 1").drop("nth_of_key")
    e, i = existing.alias("e"), batch.alias("i")
    hit = F.col(f"e.{key}").isNotNull()
    pick = lambda c: F.when(hit & F.col(f"i.{key}").isNotNull(), F.col(f"i.{c}" if c in updated else f"e.{c}")).otherwise(F.coalesce(f"e.{c}", f"i.{c}"))
    return e.join(i, F.col(f"e.{key}") == F.col(f"i.{key}"), "full_outer").select(*[pick(c).alias(c) for c in existing.columns])


def repaired_keys(children: DataFrame, key: str, parents: DataFrame, parent_key: str, nullable: bool) -> DataFrame:
    """A foreign key without a parent becomes null, or its row goes."""
    known = parents.select(F.col(parent_key).alias("known_parent")).distinct()
    joined = children.join(known, F.col(key) == F.col("known_parent"), "left")
    if nullable:
        return joined.withColumn(key, F.col("known_parent")).drop("known_parent")
    return joined.where(F.col("known_parent").isNotNull() | F.col(key).isNull()).drop("known_parent")


def cascaded(gone: DataFrame, key: str, tables: dict[str, tuple[DataFrame, str]], unlinked: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """What is left of each table after deleting the keys in gone; unlinked tables
    keep their rows and lose the reference."""
    keys = gone.select(F.col(key).alias("gone_key")).distinct()
    left = {n: df.join(keys, F.col(c) == F.col("gone_key"), "left_anti") for n, (df, c) in tables.items()}
    for n, (df, c) in unlinked.items():
        left[n] = df.join(keys, F.col(c) == F.col("gone_key"), "left").withColumn(c, F.when(F.col("gone_key").isNull(), F.col(c))).drop("gone_key")
    return left


def diff(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys on one side only, and those on both whose fields differ."""
    j = a.alias("a").join(b.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]))
    state = F.when(F.col(f"b.{key}").isNull(), "only_a").when(F.col(f"a.{key}").isNull(), "only_b").when(F.size(changed) > 0, "changed")
    both = state == "changed"
    return j.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), state.alias("state"), F.when(both, F.array_join(changed, ",")).otherwise("").alias("fields")).where("state is not null")


def next_numbers(df: DataFrame, prefix: Column, number: str) -> DataFrame:
    """The next number of every prefix, by numeric (not text) maximum, padded to three."""
    last = F.max(F.element_at(F.split(number, "-"), -1).try_cast("int"))
    return df.groupBy(prefix.alias("prefix")).agg((F.coalesce(last, F.lit(0)) + 1).alias("n")).select(
        "prefix", F.concat_ws("-", "prefix", F.format_string("%03d", "n")).alias("next_number")
    )


def numbered_in_order(df: DataFrame, order: list[Column], name: str = "nth") -> DataFrame:
    """All rows numbered from 1 in the order, which must be total: a range sort, and the numbers
    of rows of the parts before; no part sees all rows."""
    sort_keys = [o.alias(f"sort_{i}") for i, o in enumerate(order)]
    keyed = df.select("*", *sort_keys)
    keys = [f"sort_{i}" for i in range(len(order))]
    parts = materialised(keyed.repartitionByRange(*keys).withColumn("sort_part", F.spark_partition_id()))
    sizes, before, upto = parts.groupBy("sort_part").count().collect(), {}, 0
    for r in sorted(sizes):
        before[r["sort_part"]] = upto
        upto += r["count"]
    if not before:
        return df.withColumn(name, F.lit(0).cast("long"))
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("sort_part"))
    own = F.row_number().over(Window.partitionBy("sort_part").orderBy(*keys))
    return parts.withColumn(name, (own + offset).cast("long")).drop("sort_part", *keys)


def batches_with_overlap(total: int | Column, size: int, overlap: int) -> Column:
    """Array of struct(first, last), pages from 1, each batch sharing `overlap` pages."""
    step = size - overlap
    total = F.lit(total) if isinstance(total, int) else total
    starts = F.sequence(F.lit(1), F.greatest(total - overlap, F.lit(1)), F.lit(step))
    return F.transform(starts, lambda s: F.struct(s.cast("int").alias("first"), F.least(s + size - 1, total).cast("int").alias("last")))


def margin_winners(df: DataFrame, owner: str, candidate: str, score: str, least: int, margin: int) -> DataFrame:
    """The best candidate of each owner, if it reaches `least` and leads by `margin`.
    A sole candidate needs only `least`."""
    order = Window.partitionBy(owner).orderBy(F.col(score).desc(), candidate)
    ranked = df.withColumns({"nth_of_key": F.row_number().over(order), "second": F.lead(score).over(order)}).where("nth_of_key = 1")
    lead = F.col("second").isNull() | (F.col(score) - F.col("second") >= margin)
    return ranked.where((F.col(score) >= least) & lead).drop("nth_of_key", "second")


def token_overlap(left: DataFrame, left_key: str, left_tokens: str, right: DataFrame, right_key: str, right_tokens: str) -> DataFrame:
    """(left key, right key, overlap): shared distinct tokens, counted through the
    tokens themselves, so that only pairs sharing one are ever formed."""
    a = left.select(left_key, F.explode(left_tokens).alias("token"))
    b = right.select(right_key, F.explode(right_tokens).alias("token"))
    return a.join(b, "token").groupBy(left_key, right_key).agg(F.count("*").alias("overlap"))
