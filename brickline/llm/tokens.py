"""Token ids of whole texts, written as blocks of a static range ANS.

Documents are range-partitioned and sorted by id (or stay in the order of the
files they are stored in), tokenized, and their ids kept in a table of the shared
folder.  A count of all ids gives the frequency table that every block shares.
Blocks of whole documents are then encoded (rans.py).  The file format is a
folder of the shared one: ``table`` has the frequencies, ``blocks`` a row per
block with its first token's place, its documents' ids and lengths, and the
block's bytes, which name the table's checksum.  ``read_tokens`` needs the folder
only and decodes blocks independently of one another.

A word's ids don't depend on the words around it with a tokenizer that drops
white space, so each worker tokenizes a word once and keeps its ids, up to
``KEPT_WORDS`` words or ``KEPT_BYTES`` bytes, after which it begins anew.

Scale: one shuffle of the texts (the range sort), none in stored order; everything
else is a scan, plus counts of at most one row per id of the vocabulary and one
row per partition or piece of a file, which are all that the driver sees.  A block is closed at
``BLOCK_TOKENS`` ids, so a task's memory doesn't follow its partition.

Defined cases: a null or empty text has the end id only; null doc_ids come
first; repeated ids keep all their rows, in the order of the texts' hashes; a
document longer than a block is a block by itself; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import repeat
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickline.llm import rans
from brickline.llm.common import bounded_batches, new_folder, stored

END_ID = 1
BLOCK_TOKENS = 1 << 20
KEPT_WORDS = 1_500_000
KEPT_BYTES = 64 << 20
#: Documents tokenized together.
GROUP = 128


#: Fixed value: the way in which lower-casing word vocabularies cut text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for lower-cased bytes of a text whose characters beyond ASCII are all letters.
BYTE_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xff]+|[0-9]|[^\sa-z0-9\x80-\xff]+")
#: A character beyond ASCII that is no letter.
NO_LETTER = regex.compile(r"(?V1)[[^\x00-\x7F]--\p{L}]")
END_KEY = b"\n"


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable bytes
    stand for themselves, the others take the code points from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordCache:
    """Ids of words seen so far, in one flat array.

    Where the tokenizer cuts text by PIECES, its pieces are the words, and those of
    lower-case letters go straight to the tokenizer's model.  A text with special
    tokens or other characters, and any other tokenizer, is cut at white space, and
    each word takes the tokenizer's whole way."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        form = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (form["normalizer"] or {}).get("normalizers", [])]
        cuts = (form["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        #: Bytes that an id takes.
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.by_piece = steps == ["NFC", "Replace", "Lowercase"] and cuts[0].get("pattern") == {"Regex": PIECES}
        self.reset()

    def reset(self) -> None:
        self.code: dict[bytes, int] = {}
        self.flat, self.begins, self.sizes, self.held = array("I"), array("q"), array("q"), 0

    def ids_of(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def words_of(self, text: bytes) -> list[bytes]:
        if any(s in text for s in self.specials) or not self.by_piece:
            return text.split()
        if not text.isascii() and NO_LETTER.search(text.decode("utf-8", "replace")):
            return text.split()
        return BYTE_PIECES.findall(text.lower())

    def keep(self, word: bytes, ids: list[int]) -> None:
        self.code[word] = len(self.begins)
        self.begins.append(len(self.flat))
        self.sizes.append(len(ids))
        self.flat.extend(ids)
        self.held += len(word) + 4 * len(ids)

    def learn(self, word: bytes) -> None:
        if self.by_piece and word.islower() and word.isalpha():
            self.keep(word, [t.id for t in self.model.tokenize(word.decode())])
            return
        text = word.decode("utf-8", "replace")
        if self.by_piece and text.isalpha() and text.lower() == text and is_normalized("NFC", text):
            spelt = "".join(map(self.letters.__getitem__, word))
            self.keep(word, [t.id for t in self.model.tokenize(spelt)])
        else:
            self.keep(word, self.ids_of(text))

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text, each with its end id."""
        if len(self.code) > KEPT_WORDS or self.held > KEPT_BYTES:
            self.reset()
        if END_KEY not in self.code:
            self.keep(END_KEY, [end_id])
        words, counts = [], []
        for t in texts:
            n = len(words)
            words += self.words_of(t)
            words.append(END_KEY)
            counts.append(len(words) - n)
        codes = np.fromiter(map(self.code.get, words, repeat(-1)), np.int64, len(words))
        for i in np.flatnonzero(codes < 0).tolist():
            if words[i] not in self.code:
                self.learn(words[i])
            codes[i] = self.code[words[i]]
        # taken by index at once, since an array that is viewed can't grow
        sizes = np.frombuffer(self.sizes, np.int64)[codes]
        ends = np.cumsum(sizes)
        places = np.repeat(np.frombuffer(self.begins, np.int64)[codes] - (ends - sizes), sizes)
        places += np.arange(len(places))
        ids = np.frombuffer(self.flat, np.uint32)[places]
        last = ends[np.cumsum(counts) - 1]
        return ids, np.diff(last, prepend=0)


_caches: dict[str, WordCache] = {}


def cache(path: str) -> WordCache:
    if path not in _caches:
        _caches[path] = WordCache(path)
    return _caches[path]


#: A run is a partition, or rows of one file that follow one another from row `first`.
RUN = ["part", "file", "first"]
TOKENS = "part long, file string, first long, start long, doc_id {id}, n int, ids binary"


def runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Groups of rows of one file that follow one another."""
    at, name = batch.column("at").to_numpy(), batch.column("file").to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero((np.diff(at) != 1) | (name[1:] != name[:-1])) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
        yield from ((i, min(i + GROUP, b)) for i in range(a, b, GROUP))


def _tokenize(path: str, end_id: int, by_file: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, start = cache(path), 0
        part, file, first, due = TaskContext.get().partitionId(), "", 0, 0
        for batch in batches:
            groups = runs(batch) if by_file else ((i, min(i + GROUP, len(batch))) for i in range(0, len(batch), GROUP))
            for a, b in groups:
                rows = batch.slice(a, b - a)
                if by_file:
                    at = (rows.column("part")[0].as_py(), rows.column("file")[0].as_py(), rows.column("at")[0].as_py())
                    if at != (part, file, due):
                        (part, file, first), start = at, 0
                    due = at[2] + len(rows)
                ids, counts = words.encode([t or b"" for t in rows.column("text").to_pylist()], end_id)
                ends = np.cumsum(counts)
                raw, size = ids.astype(words.width).tobytes(), int(words.width[-1])
                cells = [raw[size * (e - c) : size * e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(rows), pa.int64()), pa.array([file] * len(rows)), pa.array([first] * len(rows), pa.int64()),
                        pa.array(start + ends - counts), rows.column("doc_id"), pa.array(counts.astype(np.int32)), pa.array(cells, pa.binary()),
                    ],
                    [*RUN, "start", "doc_id", "n", "ids"],
                )
                start += int(ends[-1])

    return run


def unpacked(cells: list[bytes], sizes: list[int]) -> np.ndarray:
    """The ids of documents one after the other; a cell has two or four bytes an id."""
    width = "<u2" if len(cells[0]) == 2 * sizes[0] else "<u4"
    return np.frombuffer(b"".join(cells), width).astype(np.uint32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for at in range(0, len(batch), GROUP):
            rows = batch.slice(at, GROUP)
            n = np.bincount(unpacked(rows.column("ids").to_pylist(), rows.column("n").to_pylist()))
            if len(n) > len(total):
                total = np.pad(total, (0, len(n) - len(total)))
            total[: len(n)] += n
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])


#: One row per id that occurs, with the checksum that blocks name.
TABLE = "id long, freq long, table_crc32 long"
BLOCKS = "first_token long, doc_ids array<{id}>, lengths array<int>, block binary"


def _encode(freq: dict[int, int], base: dict[tuple, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, kind = rans.Table(freq), pa.int64()
        docs, cells, sizes, held, first, due = [], [], [], 0, 0, None

        def block() -> pa.RecordBatch:
            ids = unpacked(cells, sizes)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([first], pa.int64()), pa.array([docs], pa.list_(kind)),
                    pa.array([sizes], pa.list_(pa.int32())),
                    pa.array([rans.encode(ids, table)], pa.binary()),
                ],
                ["first_token", "doc_ids", "lengths", "block"],
            )

        for batch in batches:
            kind = batch.column("doc_id").type
            for *run, start, doc, n, ids in zip(*(batch.column(c).to_pylist() for c in (*RUN, "start", "doc_id", "n", "ids")), strict=True):
                at = base[tuple(run)] + start
                # a block is a run of documents that follow one another
                if cells and (at != due or held + n > BLOCK_TOKENS):
                    yield block()
                    docs, cells, sizes, held = [], [], [], 0
                if not cells:
                    first = at
                docs.append(doc)
                cells.append(ids)
                sizes.append(n)
                held, due = held + n, at + n
        if cells:
            yield block()

    return run


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = END_ID, order: str = "doc_id") -> str:
    """The folder of the written files.  order: ``doc_id``, or ``stored`` for a scan of
    Parquet files whose rows are to stay in the files' order (by part number, name, row)."""
    bounded_batches(docs)
    kind, by_file = dict(docs.dtypes)["doc_id"], order == "stored"
    text = F.encode("text", "utf-8").alias("text")
    if by_file:
        file = docs.metadataColumn("_metadata")
        name = file["file_name"]
        number = F.coalesce(F.regexp_extract(name, r"part-([0-9]+)", 1).try_cast("long"), F.lit(0))
        rows = docs.select("doc_id", text, number.alias("part"), name.alias("file"), file["row_index"].alias("at"))
    else:
        hashed = docs.select("doc_id", text, F.xxhash64("text").alias("h"))
        rows = hashed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    ids = stored(rows.mapInArrow(_tokenize(tokenizer, end_id, by_file), TOKENS.format(id=kind)), "token-ids")
    counts = ids.select("n", "ids").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    freq = rans.frequencies({r["id"]: r["n"] for r in counts})
    base, upto = {}, 0
    for *run, n in sorted(ids.groupBy(*RUN).agg(F.sum("n").alias("n")).collect()):
        base[tuple(run)] = upto
        upto += n
    spark = docs.sparkSession
    folder = new_folder(spark, "tokens")
    check = rans.Table(freq).check
    spark.createDataFrame([(i, f, check) for i, f in sorted(freq.items())], TABLE).coalesce(1).write.parquet(f"{folder}/table")
    ids.mapInArrow(_encode(freq, base), BLOCKS.format(id=kind)).write.option("compression", "none").parquet(f"{folder}/blocks")
    return folder


def _decode(freq: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(freq)
        for batch in batches:
            for i in range(len(batch)):
                ids = rans.decode(batch.column("block")[i].as_py(), table).astype("<u4")
                lengths = np.array(batch.column("lengths")[i].as_py(), np.int64)
                ends = np.cumsum(lengths)
                raw = ids.tobytes()
                cells = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_ids")[i].values, pa.array(batch.column("first_token")[i].as_py() + ends - lengths),
                        pa.array(lengths), pa.array([zlib.crc32(c) for c in cells], pa.int64()), pa.array(cells, pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return run


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32, ids (little-endian
    unsigned 32-bit), decoded from the files of the folder alone."""
    freq = {r["id"]: r["freq"] for r in spark.read.schema(TABLE).parquet(f"{folder}/table").collect()}
    blocks = spark.read.parquet(f"{folder}/blocks")
    kind = dict(blocks.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")
    return blocks.mapInArrow(_decode(freq), f"doc_id {kind}, start long, n_tokens long, ids_crc32 long, ids binary")
