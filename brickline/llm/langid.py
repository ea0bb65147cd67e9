"""Language identification with bit-sliced Bloom filters of n-grams.

Every learned language has a Bloom filter of its characteristic 4-byte n-grams;
the filters lie side by side, so that a cell is a bitmask of languages and the
AND of an n-gram's cells is the set of all languages that contain it.  A text's
popcount per language, corrected for that filter's false positives, decides.

An n-gram enters a language's filter if it makes up at least ``MIN_SHARE`` of the
language's n-grams and at least ``MIN_RATIO`` of its share in any other language,
so lines of a second language inside a document don't spoil the filter.  By the
first rule a filter holds at most ``1 / MIN_SHARE`` n-grams.

Learning takes a bounded sample of labelled rows, by hash: ``train_rows`` shared
equally among the languages, of each language all rows if there are fewer, so a rare
language is learned too.  Prediction is a map over whole texts.  A mask has as many
words of 64 languages as there must be.

Scale: learning counts n-grams inside tasks before a shuffle of (language,
n-gram) rows; the driver gets the filters' entries only, which are bounded as
said.  The filters (``CELLS`` cells) go to every worker.

Defined cases: a null text, or one without any letter, is ``und`` with score 0; a
text with letters but no known n-gram gets the commonest learned language with
score 0; null langs teach nothing; repeated rows count as often as they occur;
extra columns are ignored; without any training row every text is ``und``; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickline.llm.common import bounded_batches

CELL_BITS = 20
CELLS = 1 << CELL_BITS
MULTIPLIERS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)
MIN_SHARE = 1e-5
MIN_RATIO = 0.1
TRAIN_ROWS = 20_000
#: Bytes of text that numpy works on at once.
SLICE = 1 << 19
LETTER = re.compile(r"[^\W\d_]")
#: ASCII that is no letter becomes a space.
TO_SPACE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
UNDETERMINED = "und"


def prepared(text: str | None) -> bytes:
    """Lower-cased bytes with spaces around them; empty if there is no letter."""
    if not text or not LETTER.search(text):
        return b""
    return b" " + text.lower().encode("utf-8", "replace").translate(TO_SPACE) + b"   "


def grams(buffer: bytes) -> np.ndarray:
    """The overlapping 4-byte n-grams."""
    return np.ndarray((max(0, len(buffer) - 3),), "<u4", buffer, strides=(1,)).copy()


def cells(g: np.ndarray, k: int) -> np.ndarray:
    x = (g ^ (g >> np.uint32(15))) * np.uint32(MULTIPLIERS[k])
    return (x ^ (x >> np.uint32(13))) * np.uint32(MULTIPLIERS[k - 1]) >> np.uint32(32 - CELL_BITS)


@dataclass
class Model:
    languages: list[str]
    filters: list[np.ndarray]  # masks of languages by cell, 64 languages each
    false_rate: np.ndarray  # of each language's filter

    def scores(self, buffers: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Best language (index) and score of each buffer; -1 for empty ones."""
        best, score = np.full(len(buffers), -1), np.zeros(len(buffers))
        full = [i for i, b in enumerate(buffers) if b]
        if not full or not self.languages:
            return best, score
        g = grams(b"".join(buffers[i] for i in full) + b"    ")
        at = [cells(g, k) for k in range(len(MULTIPLIERS))]
        sizes = np.array([len(buffers[i]) for i in full])
        starts, counts = np.concatenate([[0], np.cumsum(sizes)[:-1]]), []
        for word, first in zip(self.filters, range(0, len(self.languages), 64), strict=True):
            masks = word[at[0]]
            for place in at[1:]:
                masks &= word[place]
            one = masks.dtype.type(1)
            for i in range(min(64, len(self.languages) - first)):
                counts.append(np.add.reduceat((masks >> masks.dtype.type(i)) & one, starts, dtype=np.int64))
        counts = np.stack(counts, axis=1)
        true = np.maximum((counts - sizes[:, None] * self.false_rate) / (1 - self.false_rate), 0)
        total = true.sum(axis=1)
        best[full] = true.argmax(axis=1)
        score[full] = np.where(total > 0, true.max(axis=1) / np.where(total > 0, total, 1), 0.0)
        return best, score


def _count(languages: list[str]):
    index = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found.setdefault(index[lang], []).append(prepared(text))
            for i, buffers in found.items():
                g, n = np.unique(grams(b"".join(buffers)), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(g), i, np.int32)), pa.array(g.astype(np.int64)), pa.array(n)], ["l", "g", "n"]
                )

    return run


def learn(docs: DataFrame, train: Column, train_rows: int = TRAIN_ROWS) -> Model:
    """The filters, from at most about train_rows rows where train holds."""
    bounded_batches(docs)
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    totals = rows.groupBy("lang").count().collect()  # a row per language
    languages = [r["lang"] for r in sorted(totals, key=lambda r: (-r["count"], r["lang"]))]
    share = train_rows / max(len(languages), 1)
    # a row per language
    kept = [(r["lang"], min(1 << 30, int(share / r["count"] * (1 << 30)) + 1)) for r in totals]
    most = F.broadcast(docs.sparkSession.createDataFrame(kept, "lang string, below long"))
    rows = rows.join(most, "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.col("below"))
    counted = rows.select("lang", "text").mapInArrow(_count(languages), "l int, g long, n long")
    counted = counted.groupBy("l", "g").agg(F.sum("n").alias("n"))
    sums = {r["l"]: r["n"] for r in counted.groupBy("l").agg(F.sum("n").alias("n")).collect()}
    if not sums:
        return Model([], [], np.zeros(0))
    total = F.create_map(*[F.lit(x) for pair in sorted(sums.items()) for x in pair])
    shares = counted.withColumn("share", F.col("n") / F.element_at(total, F.col("l")))
    highest = shares.groupBy("g").agg(F.max("share").alias("most"), F.collect_list(F.struct("l", "share")).alias("every"))
    entries = (
        highest.where(F.col("most") >= MIN_SHARE)
        .select("g", "most", F.explode("every").alias("e"))
        .where((F.col("e.share") >= MIN_SHARE) & (F.col("e.share") >= MIN_RATIO * F.col("most")))
        .select("g", F.col("e.l").alias("l"))
        .toPandas()
    )
    filters, fill = [], np.zeros(len(languages))
    for first in range(0, len(languages), 64):
        kind = np.dtype(f"uint{next(b for b in (8, 16, 32, 64) if min(64, len(languages) - first) <= b)}").type
        filters.append(np.zeros(CELLS, kind))
    for i, part in entries.groupby("l"):
        g, word = part["g"].to_numpy().astype(np.uint32), filters[i // 64]
        bit = word.dtype.type(1 << (i % 64))
        for k in range(len(MULTIPLIERS)):
            word[np.unique(cells(g, k))] |= bit
        fill[i] = np.count_nonzero(word & bit) / CELLS
    return Model(languages, filters, np.minimum(fill ** len(MULTIPLIERS), 0.999))


def _predict(model: Model, kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, held, size = [], [], [], 0
            last = batch.column(batch.num_columns - 1)
            texts = last.field("text") if pa.types.is_struct(last.type) else last
            for i in range(len(batch)):
                held.append(prepared(texts[i].as_py()))
                size += len(held[-1])
                if size >= SLICE or i == len(batch) - 1:
                    best, score = model.scores(held)
                    langs += [model.languages[b] if b >= 0 else UNDETERMINED for b in best.tolist()]
                    scores.append(score)
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:kept], pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())],
                [*batch.schema.names[:kept], "lang_pred", "score"],
            )

    return run


def identify(docs: DataFrame, model: Model, *keep: Column) -> DataFrame:
    """The columns of keep (each with a name of its own), lang_pred and score."""
    rows = docs.select(*keep, F.col("text").alias("text_to_identify"))
    kinds = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes[:-1])
    return rows.mapInArrow(_predict(model, len(keep)), f"{kinds}, lang_pred string, score double")


def identified_only(docs: DataFrame, model: Model, lead: float = 1.2) -> DataFrame:
    """The documents, all columns as they were, whose language stands out: they
    have letters, and the best language's score is `lead` times an equal share."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    found = rows.mapInArrow(
        _predict(model, 1), f"row {rows.dtypes[0][1]}, lang_pred string, score double"
    )
    return found.where(
        (F.col("lang_pred") != UNDETERMINED) & (F.col("score") * max(1, len(model.languages)) >= min(lead, len(model.languages)))
    ).select("row.*")
