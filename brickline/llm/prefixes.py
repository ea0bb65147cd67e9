"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, at i, the sum of (code point + 1) times a power of
the base over the first i code points, modulo two primes.  The hash of any span is a
difference of two cells, moved to the origin by a power of the inverse base, so equal
spans are found anywhere by two look-ups, and the longest common extension of two
places by binary search.  Arrays of long texts are kept at every ``STEP``-th place
only; a cell between is summed up from there, so a text costs two numbers a step.

A fingerprint keeps the length, the hash of the whole and the cells of a fixed grid of
lengths (``PER_OCTAVE`` to a doubling), of the text's beginnings and of its ends.  Two
fingerprints are likened by binary search over the grid: the longest common beginning
and the longest common end, each rounded down to the grid, as a share of the longer
text.  Equal texts have 1, others less (but for a collision of 62 bits and the grid's 24).

Scale: ``edited_fingerprints`` needs each document's neighbour in the order of the ids.
A narrow pass over the keys cuts that order into parts of about ``PART_BYTES`` of text,
whose first keys reach the driver.  One shuffle then sends every text to its part; the
first document of a part goes to the part before as well, so every neighbour is at hand
and a task holds two texts.  Rows that repeat whole travel as one row with a count.

Defined cases: a null text is the empty text; a null id is after all others, as the
smallest long would be; documents of one id go by their texts' hash; of repeated rows
each is the next of the one before; a single document is its own next; texts of any
length are hashed whole, in slices; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from base64 import b64encode
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brickline.llm.common import stored

#: Two primes below 2**31, and a base for each.
PRIMES, BASES = (2147483647, 2147483629), (1000003579, 1234567891)
#: Code points between the kept cells of a prefix array, and those summed at once.
STEP, SLICE = 1 << 12, 1 << 16
#: Lengths of the grid to a doubling.
PER_OCTAVE = 8
GRID = np.unique(np.floor(2.0 ** (np.arange(31 * PER_OCTAVE) / PER_OCTAVE)).astype(np.int64))
#: Bytes of text to a part, and rows that one row is expanded to at once.
PART_BYTES, CHUNK = 32 << 20, 10_000
LAST = (1 << 63) - 1
U = np.uint64


class Powers:
    """Powers of a base modulo a prime, of any array of exponents, by two look-ups."""

    BITS = 16

    def __init__(self, base: int, prime: int):
        self.prime = U(prime)
        self.low = self._table(base, 1 << self.BITS)
        self.step = pow(base, 1 << self.BITS, prime)
        self.high = self._table(self.step, 16)

    def _table(self, base: int, n: int) -> np.ndarray:
        out = np.ones(1, U)
        while len(out) < n:
            out = np.concatenate([out, out * U(pow(base, len(out), int(self.prime))) % self.prime])
        return out[:n]

    def of(self, exponents: np.ndarray) -> np.ndarray:
        high = exponents >> self.BITS
        if len(high) and int(high.max()) >= len(self.high):
            self.high = self._table(self.step, 2 * int(high.max()))
        return self.low[exponents & ((1 << self.BITS) - 1)] * self.high[high] % self.prime


POWERS = [Powers(b, p) for b, p in zip(BASES, PRIMES, strict=True)]
INVERSES = [Powers(pow(b, -1, p), p) for b, p in zip(BASES, PRIMES, strict=True)]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(U) + U(1)


def cells(text: str, cuts: np.ndarray) -> np.ndarray:
    """The prefix array's cells at the ascending places of cuts: a row for each prime."""
    out, done = np.zeros((len(PRIMES), len(cuts)), U), [0] * len(PRIMES)
    at = int(np.searchsorted(cuts, 0, "right"))
    for start in range(0, len(text), SLICE):
        part = codes(text[start : start + SLICE])
        upto = int(np.searchsorted(cuts, start + len(part), "right"))
        for k, powers in enumerate(POWERS):
            sums = np.cumsum(part * powers.low[: len(part)] % powers.prime) % powers.prime
            moved = int(powers.of(np.array([start]))[0])
            out[k, at:upto] = (U(done[k]) + sums[cuts[at:upto] - start - 1] * U(moved)) % powers.prime
            done[k] = (done[k] + int(sums[-1]) * moved) % int(powers.prime)
        at = upto
    return out


def joined(pair: np.ndarray) -> np.ndarray:
    """62 bits of both residues."""
    return pair[0] << U(31) | pair[1]


class Prefixes:
    """The prefix array of a text: hashes, equality and common extensions of its spans."""

    def __init__(self, text: str):
        self.text, self.n = text, len(text)
        self.kept = cells(text, np.arange(0, len(text) + 1, STEP))

    def cell(self, i: int) -> list[int]:
        first = i // STEP
        if i % STEP == 0:
            return [int(x) for x in self.kept[:, first]]
        rest = cells(self.text[first * STEP : i], np.array([i - first * STEP]))
        moved = [int(p.of(np.array([first * STEP]))[0]) for p in POWERS]
        return [(int(self.kept[k, first]) + int(rest[k, 0]) * moved[k]) % p for k, p in enumerate(PRIMES)]

    def span(self, start: int, length: int) -> int:
        """The hash of a span, the same wherever the span stands."""
        a, b = self.cell(start), self.cell(start + length)
        back = [int(p.of(np.array([start]))[0]) for p in INVERSES]
        return int(joined(np.array([(y - x) % p * m % p for x, y, m, p in zip(a, b, back, PRIMES, strict=True)], U)))

    def extension(self, start: int, other: Prefixes, at: int) -> int:
        """How many code points from start on equal those of other from at on."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            middle = (low + high + 1) // 2
            # what is left of low is known to be equal
            same = self.span(start + low, middle - low) == other.span(at + low, middle - low)
            low, high = (middle, high) if same else (low, middle - 1)
        return low

    def extension_back(self, end: int, other: Prefixes, at: int) -> int:
        """How many code points before end equal those of other before at."""
        low, high = 0, min(end, at)
        while low < high:
            middle = (low + high + 1) // 2
            same = self.span(end - middle, middle - low) == other.span(at - middle, middle - low)
            low, high = (middle, high) if same else (low, middle - 1)
        return low


def packed(values: np.ndarray) -> str:
    """24 bits of each value as four characters."""
    mixed = (values * U(0x9E3779B97F4A7C15)) >> U(40)
    return b64encode(mixed.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()).decode()


def fingerprint(text: str) -> str:
    """Length, hash of the whole, grid of beginnings, grid of ends."""
    n = len(text)
    grid = GRID[: np.searchsorted(GRID, n, "right")]
    cuts = np.unique(np.concatenate([grid, n - grid, [n]]))
    found = cells(text, cuts)
    starts, ends = found[:, np.searchsorted(cuts, grid)], found[:, np.searchsorted(cuts, n - grid)]
    whole = found[:, -1]
    tails = np.stack([
        (whole[k] + inverse.prime - ends[k]) % inverse.prime * inverse.of(n - grid) % inverse.prime for k, inverse in enumerate(INVERSES)
    ])
    return f"{n}:{int(joined(whole)):016x}:{packed(joined(starts))}:{packed(joined(tails))}"


def common(a: str, b: str, places: int) -> int:
    """The grid's longest length, of the first places, up to which the cells agree."""
    low, high = 0, places
    while low < high:
        middle = (low + high + 1) // 2
        cell = slice(4 * middle - 4, 4 * middle)
        low, high = (middle, high) if a[cell] == b[cell] else (low, middle - 1)
    return int(GRID[low - 1]) if low else 0


def likeness(a: str, b: str) -> float:
    """The common beginning and end as a share of the longer text; 1 for equal texts."""
    if a == b:
        return 1.0
    n, _, starts, tails = a.split(":")
    m, _, starts_b, tails_b = b.split(":")
    n, m = int(n), int(m)
    places = int(np.searchsorted(GRID, min(n, m), "right"))
    same = common(starts, starts_b, places) + common(tails, tails_b, places)
    return min(same, n, m, max(n, m) - 1) / max(n, m)


# -- DataFrames ------------------------------------------------------------------


def common_extensions(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Adds common_start and common_end: how many code points the texts of two columns
    share at their beginning and end (a null text is empty); exact, by binary search."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = [], []
            for x, y in zip(batch.column(left), batch.column(right), strict=True):
                a, b = Prefixes(x.as_py() or ""), Prefixes(y.as_py() or "")
                starts.append(a.extension(0, b, 0))
                ends.append(a.extension_back(a.n, b, b.n))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], [*batch.schema.names, "common_start", "common_end"]
            )

    schema = StructType([*pairs.schema.fields]).add("common_start", "long").add("common_end", "long")
    return pairs.mapInArrow(run, schema)


def expanded(rows: DataFrame, times: str) -> DataFrame:
    """Each row as often as its number says; large numbers are dealt out."""
    parts = rows.withColumn("from_", F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(CHUNK).cast("long"))))
    dealt = parts.where(F.col(times) <= CHUNK).unionByName(parts.where(F.col(times) > CHUNK).repartition("from_", "fingerprint"))
    return dealt.withColumn("i_", F.explode(F.expr(f"sequence(from_, least(from_ + {CHUNK}, {times}) - 1)"))).drop("i_", "from_", times)


RESULT = (
    "doc_id long, times long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, ahead, doc_id, n, text) in order: each but those ahead with its next."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    schema = pa.schema(list(zip(names, [pa.int64()] * 3 + [pa.string()] * 3 + [pa.float64()] * 2, strict=True)))

    def row(doc_id, times: int, text: str, print_: str, after: str, after_print: str) -> tuple:
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        edited_print = print_ if edited == text else fingerprint(edited)
        digest = sha256(edited.encode("utf-8")).hexdigest()
        return (doc_id, times, len(text), digest, print_, edited_print, likeness(print_, edited_print), likeness(print_, after_print))

    held = None
    for batch in batches:
        rows = []
        columns = [batch.column(i) for i in range(4)]
        for part, ahead, doc_id, n, text in zip(*[c.to_pylist() for c in columns], batch.column(4), strict=True):
            text = text.as_py()
            print_ = fingerprint(text)
            if held is not None and held[0] == part:
                _, held_id, times, before, before_print = held
                rows.append(row(held_id, 1, before, before_print, text, print_))
                if times > 1:  # the copies before the last have their equal as the next
                    rows.append(row(held_id, times - 1, before, before_print, before, before_print))
            held = None if ahead else (part, doc_id, n, text, print_)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def searched(first: list[tuple[int, int]], d: Column, h: Column) -> Column:
    """The number of the last of the ascending keys first that isn't above (d, h)."""
    ds, hs = (F.lit(np.array([k[i] for k in first], np.int64)) for i in range(2))
    steps = [1 << i for i in reversed(range(max(1, len(first).bit_length())))]

    def step(at: Column, by: Column) -> Column:
        there = at + by
        below = (F.get(ds, there) < d) | ((F.get(ds, there) == d) & (F.get(hs, there) <= h))
        return F.when(F.coalesce(below, F.lit(False)), there).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def edited_fingerprints(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.  The edited text has the last half of
    the code points replaced by the first as many of the next document's, by descending id."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit(LAST)).alias("d"),
        F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"),
    )
    keys = stored(rows.groupBy("d", "h").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("bytes")), "prefix-keys")
    size, again = keys.agg(F.sum("bytes"), F.max("n")).first()
    if size is None:
        return spark.createDataFrame([], RESULT).drop("times")
    parts = max(1, int(size) // part_bytes, min(int(size) >> 20, 4 * spark.sparkContext.defaultParallelism))
    ranged = keys.select("d", "h").repartitionByRange(parts, "d", "h").withColumn("part", F.spark_partition_id())
    first = sorted((r["k"]["d"], r["k"]["h"]) for r in ranged.groupBy("part").agg(F.min(F.struct("d", "h")).alias("k")).collect())
    if again > 1:
        whole = keys.where("n > 1").select("d", "h")
        repeated = rows.join(whole, ["d", "h"], "left_semi").groupBy("doc_id", "d", "h").agg(F.count("*").alias("n"), F.first("text").alias("text"))
        rows = rows.join(whole, ["d", "h"], "left_anti").withColumn("n", F.lit(1).cast("long")).unionByName(repeated)
    else:
        rows = rows.withColumn("n", F.lit(1).cast("long"))
    found = rows.withColumn("part", searched(first, F.col("d"), F.col("h")))
    ds, hs = (F.lit(np.array([k[i] for k in first], np.int64)) for i in range(2))
    leads = (F.get(ds, F.col("part")) == F.col("d")) & (F.get(hs, F.col("part")) == F.col("h"))
    here, before = F.struct("part", F.lit(False).alias("ahead")), F.struct(((F.col("part") + len(first) - 1) % len(first)).alias("part"), F.lit(True).alias("ahead"))
    sent = found.withColumn("to", F.explode(F.when(leads, F.array(here, before)).otherwise(F.array(here))))
    dealt = sent.select(F.col("to.part").alias("part"), F.col("to.ahead").alias("ahead"), "doc_id", "n", "text", "d", "h")
    dealt = dealt.repartitionById(len(first), "part").sortWithinPartitions("part", "ahead", "d", "h")
    out = dealt.select("part", "ahead", "doc_id", "n", "text").mapInArrow(_neighbours, RESULT)
    return expanded(out, "times") if again > 1 else out.drop("times")
