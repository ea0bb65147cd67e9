"""Language-model scoring from a log-frequency Bloom filter.

Counts of words and of word pairs are quantised to levels (``level_bounds``);
an n-gram of level q is put into a Bloom filter q times, once with each level
1..q.  Its count is read back by probing level after level until one is absent.

    P(w | h) = (1 - l) P(w) + l c(h w) / c(h),    P(w) = (c(w) + a) / (N + a (V + 1))

with all counts from probes.  The weight l depends on c(h) and is fitted by
expectation maximisation on leave-one-out counts of all training texts; a level
of c(h) with too few tokens takes the weight of the nearest fitted one.

Every n-gram of the training texts enters, those seen once included, with
``BITS_PER_ENTRY`` bits a level, so the filter grows with the corpus.  It is cut
into segments of the hash space, about ``SEGMENT`` n-gram occurrences each.  Where
it can't be above ``BROADCAST_BYTES``, by the number of training tokens, it is
broadcast to the workers.  A larger one is spread over them by segment, and the
n-grams of the texts go to their segments, with their counts, to be probed there.
The probes are the same in all ways, and so are the scores.

Scale: texts are hashed once, into slices of about ``SLICE`` tokens (a table of
the shared folder, words by number within their slice).  A slice sends each of
its n-grams once.  The groups that tasks hold are segments and slices; beyond
``MOST_SLICES`` slices, a frequent word would make its segment's group grow with
their number, so counts are merged by parts first and requests are dealt by parts.
Only the number of tokens and the histogram of the weights reach the driver.  The
exact word counts of the base score lie beside the segments; words are told
apart by 48 bits of their hash.

Defined cases: a null text is the empty text and consists of the end token; a
null doc_id hashes as the empty text; repeated rows count and are scored each;
without training rows every token is unknown; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from brickline.llm.common import bounded_batches, stored

ALPHA = 0.1
#: White space can't be in a word, so these are no words.
END, BEGIN = xxh64_intdigest(b"\nend"), xxh64_intdigest(b"\nbegin")
BITS_PER_ENTRY = 12
PROBES = 6
BROADCAST_BYTES = 64 << 20
#: The most bytes that a training token can add: a word and a pair, each of a level, and a word's count.
TOKEN_BYTES = 2 * BITS_PER_ENTRY / 8 + 16
MOST_SLICES = 1 << 16
#: Tokens of a slice, bytes that are split at once, keys that a task sums up before it hands them on.
SLICE, PIECE, HELD = 1 << 18, 1 << 20, 1 << 20
#: N-gram occurrences of a segment, about.
SEGMENT = 1 << 20
#: Bits of a pair's hash that travel, below its segment's.
KEY_BITS = 32
#: Tokens that a level of c(h) needs for a weight of its own.
FIT_TOKENS = 50
U = np.uint64
WORD_BYTES = 6
GAP = (1 << 24) - 1


def packed_pairs(low: np.ndarray) -> bytes:
    """Sorted 32-bit keys as gaps of three bytes; GAP stands for one of the long ones that follow."""
    gaps = np.diff(low.astype(np.int64), prepend=0)
    short = np.minimum(gaps, GAP).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    return len(low).to_bytes(4, "little") + np.ascontiguousarray(short).tobytes() + gaps[gaps >= GAP].astype("<u4").tobytes()


def unpacked_pairs(raw: bytes) -> np.ndarray:
    size = int.from_bytes(raw[:4], "little")
    wide = np.zeros((size, 4), np.uint8)
    wide[:, :3] = np.frombuffer(raw, np.uint8, 3 * size, 4).reshape(-1, 3)
    gaps = wide.view("<u4")[:, 0].astype(np.int64)
    gaps[gaps == GAP] = np.frombuffer(raw[4 + 3 * size :], "<u4")
    return np.cumsum(gaps).astype("<u4")


def packed(x: np.ndarray) -> bytes:
    """Hashes of words, WORD_BYTES each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // WORD_BYTES, 8), np.uint8)
    wide[:, :WORD_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, WORD_BYTES)
    return wide.view("<u8")[:, 0]


def packed_counts(n: np.ndarray) -> bytes:
    """Counts in a byte each; 255 stands for one of the long ones that follow the bytes."""
    return zlib.compress(np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype("<i8").tobytes(), 1)


def unpacked_counts(raw: bytes, size: int) -> np.ndarray:
    raw = zlib.decompress(raw)
    n = np.frombuffer(raw, np.uint8, size).astype(np.int64)
    n[n == 255] = np.frombuffer(raw, "<i8", -1, size) if len(raw) > size else 0
    return n


def level_bounds(ratio: float = 1.25, most: int = 1 << 50) -> np.ndarray:
    """The least count of each level: 1, 2, 3, 4, 5, 7, ..."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * ratio + 0.5)))
    return np.array(out, np.int64)


BOUNDS = level_bounds()
#: The count that a level stands for: the geometric middle of its range.
MIDDLE = np.concatenate([[0.0], np.sqrt(BOUNDS[:-1].astype(float) * (BOUNDS[1:] - 1))])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(mixed(before + U(0x9E3779B97F4A7C15)) ^ word)


def word_keys(word: np.ndarray) -> np.ndarray:
    return mixed(word ^ U(0xD6E8FEB86659FD93))


def pieces(text: bytes) -> Iterator[bytes]:
    """The text cut between words into pieces of about PIECE bytes."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        while end < len(text) and not text[end : end + 1].isspace():
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def hashed(text: bytes | None) -> np.ndarray:
    """Hashes of a text's tokens, the end token included."""
    out = [np.fromiter(map(xxh64_intdigest, p.lower().split()), U) for p in pieces(text or b"")]
    return np.concatenate([*out, np.array([END], U)]) >> U(64 - 8 * WORD_BYTES)


SLICES = "slice long, doc_ids array<{id}>, held array<boolean>, counts array<int>, words binary, codes binary, n_train long"


def packed_codes(codes: np.ndarray) -> bytes:
    """Numbers of words, all low bytes first, then the next bytes, three or four planes:
    numbers are small where words are frequent, so each plane is compressed well."""
    planes = 3 if codes.max(initial=0) < 1 << 24 else 4
    return np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T[:planes]).tobytes()


def unpacked_codes(raw: bytes, size: int) -> np.ndarray:
    wide, planes = np.zeros((size, 4), np.uint8), len(raw) // size
    wide[:, :planes] = np.frombuffer(raw, np.uint8).reshape(planes, size).T
    return wide.view("<u4")[:, 0].astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, size, hashes, ids, held, kind = TaskContext.get().partitionId() << 32, 0, [], [], [], None

    def out() -> pa.RecordBatch:
        words, codes, often = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        # frequent words first
        order = np.argsort(-often, kind="stable")
        number = np.empty_like(order)
        number[order] = np.arange(len(order))
        counts = np.array([len(h) for h in hashes], np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([at]), pa.array([ids], pa.list_(kind)), pa.array([held], pa.list_(pa.bool_())), pa.array([counts.tolist()], pa.list_(pa.int32())),
                pa.array([packed(words[order])], pa.binary()), pa.array([packed_codes(number[codes])], pa.binary()),
                pa.array([int(counts[~np.array(held, bool)].sum())]),
            ],
            [c.split()[0] for c in SLICES.split(", ")],
        )

    for batch in batches:
        kind = batch.column("doc_id").type
        for id_, is_held, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text"), strict=True):
            hashes.append(hashed(text.as_py()))
            ids.append(id_)
            held.append(bool(is_held))
            size += len(hashes[-1])
            if size >= SLICE:
                yield out()
                at, size, hashes, ids, held = at + 1, 0, [], [], []
    if hashes:
        yield out()


class Slice:
    """A row of the slices: its words, their number at each token, and the texts' sizes."""

    def __init__(self, row: dict):
        words = unpacked(row["words"])
        order = np.argsort(words)
        number = np.empty_like(order)
        number[order] = np.arange(len(order))
        self.counts = np.array(row["counts"], np.int64)
        self.row, self.words, self.codes = row, words[order], number[unpacked_codes(row["codes"], int(self.counts.sum()))]
        self.train = ~np.repeat(np.array(row["held"], bool), self.counts)
        self.first = np.cumsum(self.counts) - self.counts

    def pairs(self) -> np.ndarray:
        """The pair that ends at each token."""
        h = self.words[self.codes]
        before = np.empty_like(h)
        before[1:] = h[:-1]
        before[self.first] = BEGIN
        return pair_keys(before, h)


#: The key under which the number of training texts is kept, as that of their beginning.
BEGIN_KEY = word_keys(np.array([BEGIN], U))[0]


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(len(batch)):
            yield batch.slice(i, 1).to_pylist()[0]


class Sums:
    """Keys with their counts, merged as they come."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.held += len(keys)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        parts, self.parts, self.held = self.parts, [], 0
        if not parts:
            return np.zeros(0, U), np.zeros(0, np.int64)
        return summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[: len(keys)]
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def low_bits(keys: np.ndarray, seg_bits: int) -> np.ndarray:
    return ((keys << U(seg_bits)) >> U(64 - KEY_BITS)).astype("<u4")


def by_segment(seg_bits: int, *sorted_keys: np.ndarray) -> Iterator[tuple[int, list[slice]]]:
    """Each segment that has keys, and its part of each of the sorted arrays."""
    segs = [(k >> U(64 - seg_bits)).astype(np.int64) if seg_bits else np.zeros(len(k), np.int64) for k in sorted_keys]
    every = np.unique(np.concatenate(segs))
    bounds = [(np.searchsorted(s, every), np.searchsorted(s, every, "right")) for s in segs]
    for i, seg in enumerate(every.tolist()):
        yield seg, [slice(int(a[i]), int(b[i])) for a, b in bounds]


def batch_of(cells: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c[i] for c in cells], k) for i, k in enumerate(kinds)], names)


LONG, BYTES = pa.int64(), pa.binary()
COUNTED = "seg long, salt long, words binary, word_counts binary, pairs binary, pair_counts binary"


def _count(seg_bits: int, salts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, salt = Sums(), Sums(), TaskContext.get().partitionId() % salts

        def out() -> pa.RecordBatch:
            (w, n), (p, m) = words.take(), pairs.take()
            order = np.argsort(word_keys(w))
            w, n = w[order], n[order]
            cells = [
                (seg, salt, packed(w[a]), packed_counts(n[a]), packed_pairs(low_bits(p[b], seg_bits)), packed_counts(m[b]))
                for seg, (a, b) in by_segment(seg_bits, word_keys(w), p)
            ]
            return batch_of(cells, [c.split()[0] for c in COUNTED.split(", ")], [LONG, LONG, BYTES, BYTES, BYTES, BYTES])

        for row in rows(batches):
            s = Slice(row)
            if s.train.any():
                n = np.bincount(s.codes[s.train], minlength=len(s.words))
                words.add(s.words[n > 0], n[n > 0])
                pairs.add(*np.unique(s.pairs()[s.train], return_counts=True))
                pairs.add(np.array([BEGIN_KEY]), np.array([row["held"].count(False)]))
            if words.held + pairs.held > HELD:
                yield out()
        if words.held + pairs.held:
            yield out()

    return run


def summed_counts(group: pa.Table) -> tuple[np.ndarray, ...]:
    """Words with their counts and pairs with theirs, those of count 0 left out."""
    words = [unpacked(x) for x in group.column("words").to_pylist()]
    pairs = [unpacked_pairs(x) for x in group.column("pairs").to_pylist()]
    out = []
    for keys, column in ((words, "word_counts"), (pairs, "pair_counts")):
        counts = [unpacked_counts(x, len(k)) for x, k in zip(group.column(column).to_pylist(), keys, strict=True)]
        k, n = summed(np.concatenate(keys), np.concatenate(counts))
        out += [k[n > 0], n[n > 0]]
    return tuple(out)


def _merged(group: pa.Table) -> pa.Table:
    """The counts of one segment and salt as one row."""
    w, n, p, m = summed_counts(group)
    cell = (group.column("seg")[0].as_py(), group.column("salt")[0].as_py(), packed(w), packed_counts(n), packed_pairs(p), packed_counts(m))
    return pa.Table.from_batches([batch_of([cell], group.column_names, [LONG, LONG, BYTES, BYTES, BYTES, BYTES])])


def places(low: np.ndarray, order: int, level: int, size: int) -> Iterator[np.ndarray]:
    """The bits of (n-gram, level) inside its segment."""
    x = mixed(low.astype(U) ^ U(order << 60) ^ U(level << 48))
    step = mixed(x ^ U(0xA5A5A5A55A5A5A5A)) | U(1)
    for i in range(PROBES):
        yield ((((x + U(i) * step) >> U(32)) * U(size)) >> U(32)).astype(np.int64)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(BOUNDS, counts, "right")


SEGMENTS = "seg long, size long, bits binary, words binary, word_counts binary, types long"


def built(group: pa.Table, seg_bits: int, bits_per_entry: int) -> dict:
    """One segment of the filter, and the exact counts of its words."""
    w, n, p, m = summed_counts(group)
    ngrams = [(1, low_bits(word_keys(w), seg_bits), levels_of(n)), (2, p, levels_of(m))]
    size = max(64, bits_per_entry * sum(int(level.sum()) for _, _, level in ngrams))
    bits = np.zeros(size, bool)
    for order, low, level in ngrams:
        for q in range(1, int(level.max(initial=0)) + 1):
            low, level = low[level >= q], level[level >= q]
            for at in places(low, order, q, size):
                bits[at] = True
    return {
        "seg": group.column("seg")[0].as_py(), "size": size, "bits": np.packbits(bits, bitorder="little").tobytes(),
        "words": packed(w), "word_counts": packed_counts(n), "types": len(w),
    }


def _build(seg_bits: int, bits_per_entry: int):
    def run(group: pa.Table) -> pa.Table:
        cell = tuple(built(group, seg_bits, bits_per_entry).values())
        return pa.Table.from_batches([batch_of([cell], [c.split()[0] for c in SEGMENTS.split(", ")], [LONG, LONG, BYTES, BYTES, BYTES, LONG])])

    return run


class Segment:
    """A segment of the filter, to be probed."""

    def __init__(self, row: dict | None):
        row = row or {"size": 64, "bits": bytes(8), "words": b"", "word_counts": packed_counts(np.zeros(0, np.int64)), "types": 0}
        self.size, self.bits = row["size"], np.frombuffer(row["bits"], np.uint8)
        self.words, self.types = unpacked(row["words"]), row["types"]
        self.word_counts = unpacked_counts(row["word_counts"], len(self.words))

    def levels(self, low: np.ndarray, order: int) -> np.ndarray:
        """Levels of n-grams, by probes of level after level."""
        level, at, q = np.zeros(len(low), np.uint8), np.arange(len(low)), 0
        while len(at) and q + 2 < len(MIDDLE):
            q += 1
            alive = np.arange(len(at))
            for spot in places(low[at], order, q, self.size):
                spot = spot[alive]
                alive = alive[(self.bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1]
                if not len(alive):
                    break
            at = at[alive]
            level[at] = q
        return level

    def answer(self, words: np.ndarray, pairs: np.ndarray, seg_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Exact counts and levels of words (hashes), levels of pairs (low bits)."""
        at = np.minimum(np.searchsorted(self.words, words), max(len(self.words) - 1, 0))
        exact = np.where(self.words[at] == words, self.word_counts[at], 0) if len(self.words) else np.zeros(len(words), np.int64)
        return exact, self.levels(low_bits(word_keys(words), seg_bits), 1), self.levels(pairs, 2)


def requests(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """The slice's words in the order of their keys, and the sorted keys of its pairs, each once."""
    return s.words[np.argsort(word_keys(s.words))], np.unique(np.append(s.pairs(), BEGIN_KEY))


ASKED = "seg long, salt long, slice long, words binary, word_counts binary, pairs binary, pair_counts binary"
ANSWERED = "slice long, seg long, exact binary, word_levels binary, pair_levels binary, types long"


def _ask(seg_bits: int, salts: int, counted: bool):
    """Each slice's n-grams by segment; with what training texts add to their counts, if counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows(batches):
            s = Slice(row)
            w, p = requests(s)
            if counted:
                n = _in_order(s, w)
                m = np.bincount(np.searchsorted(p, s.pairs()[s.train]), minlength=len(p))
                m[np.searchsorted(p, BEGIN_KEY)] += row["held"].count(False)
            cells = []
            for seg, (a, b) in by_segment(seg_bits, word_keys(w), p):
                counts = (packed_counts(n[a]), packed_counts(m[b])) if counted else (b"", b"")
                cells.append((seg, row["slice"] % salts, row["slice"], packed(w[a]), counts[0], packed_pairs(low_bits(p[b], seg_bits)), counts[1]))
            yield batch_of(cells, [c.split()[0] for c in ASKED.split(", ")], [LONG, LONG, LONG, BYTES, BYTES, BYTES, BYTES])

    return run


def _in_order(s: Slice, w: np.ndarray) -> np.ndarray:
    """How often each of the words w, an order of the slice's, stands in training texts."""
    return np.bincount(s.codes[s.train], minlength=len(s.words))[np.searchsorted(s.words, w)]


def answers_of(asked: pa.Table, own: Segment, seg_bits: int) -> pa.Table:
    """What the slices ask of a segment, probed together."""
    words = [unpacked(x) for x in asked.column("words").to_pylist()]
    pairs = [unpacked_pairs(x) for x in asked.column("pairs").to_pylist()]
    (w, back), (p, again) = (np.unique(np.concatenate(x), return_inverse=True) for x in (words, pairs))
    exact, wl, pl = own.answer(w, p, seg_bits)
    exact, wl, pl, cells, a, b = exact[back], wl[back], pl[again], [], 0, 0
    for i, (x, y) in enumerate(zip(words, pairs, strict=True)):
        c, d = a + len(x), b + len(y)
        cells.append((
            asked.column("slice")[i].as_py(), asked.column("seg")[i].as_py(), packed_counts(exact[a:c]), zlib.compress(wl[a:c].tobytes(), 1), zlib.compress(pl[b:d].tobytes(), 1),
            0 if i else own.types,
        ))
        a, b = c, d
    return pa.Table.from_batches([batch_of(cells, [c.split()[0] for c in ANSWERED.split(", ")], [LONG, LONG, BYTES, BYTES, BYTES, LONG])])


def _answer(seg_bits: int):
    def run(asked: pa.Table, segment: pa.Table) -> pa.Table:
        own = Segment(segment.to_pylist()[0] if len(segment) else None)
        own.types = 0
        return answers_of(asked, own, seg_bits) if len(asked) else batchless()

    return run


def batchless() -> pa.Table:
    return pa.Table.from_batches([batch_of([], [c.split()[0] for c in ANSWERED.split(", ")], [LONG, LONG, BYTES, BYTES, BYTES, LONG])])


def _build_and_answer(seg_bits: int, bits_per_entry: int):
    def run(asked: pa.Table) -> pa.Table:
        return answers_of(asked, Segment(built(asked, seg_bits, bits_per_entry)), seg_bits)

    return run


#: For each token the level of its word and of the pair that ends there; the texts' exact sums.
LEVELS = "doc_ids array<{id}>, held array<boolean>, counts array<int>, known array<long>, logs array<double>, begin int, words binary, pairs binary, types long"


def placed(row: dict, exact: np.ndarray, word_levels: bytes, pair_levels: bytes, types: int, kind: pa.DataType) -> pa.RecordBatch:
    """The answers to a slice's requests, in their order, laid on its tokens."""
    s = Slice(row)
    w, p = requests(s)
    at = np.empty(len(w), np.int64)
    at[np.searchsorted(s.words, w)] = np.arange(len(w))
    exact, levels, pairs = exact[at], np.frombuffer(word_levels, np.uint8)[at], np.frombuffer(pair_levels, np.uint8)
    begin = int(pairs[np.searchsorted(p, BEGIN_KEY)])
    cell = (
        row["doc_ids"], row["held"], row["counts"], np.add.reduceat((exact > 0).astype(np.int64)[s.codes], s.first).tolist(),
        np.add.reduceat(np.log10(exact + ALPHA)[s.codes], s.first).tolist(), begin,
        levels[s.codes].tobytes(), pairs[np.searchsorted(p, s.pairs())].tobytes(), types,
    )
    kinds = [pa.list_(kind), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(LONG), pa.list_(pa.float64()), pa.int32(), BYTES, BYTES, LONG]
    return batch_of([cell], [c.split()[0] for c in LEVELS.split(", ")], kinds)


def _place(one: pa.Table, answers: pa.Table) -> pa.Table:
    answers = answers.sort_by("seg")
    words, pairs = ([zlib.decompress(x) for x in answers.column(c).to_pylist()] for c in ("word_levels", "pair_levels"))
    exact = np.concatenate([unpacked_counts(x, len(w)) for x, w in zip(answers.column("exact").to_pylist(), words, strict=True)])
    types = sum(answers.column("types").to_pylist())
    return pa.Table.from_batches([placed(one.to_pylist()[0], exact, b"".join(words), b"".join(pairs), types, one.schema.field("doc_ids").type.value_type)])


def _probe(shared, seg_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Requests and answers at once, with the whole filter at hand."""
        filters = {seg: Segment(row) for seg, row in shared.value.items()}
        for batch in batches:
            for row in rows([batch]):
                w, p = requests(Slice(row))
                got = [
                    filters.get(seg, Segment(None)).answer(w[a], low_bits(p[b], seg_bits), seg_bits) for seg, (a, b) in by_segment(seg_bits, word_keys(w), p)
                ]
                exact, words, pairs = (np.concatenate(x) for x in zip(*got, strict=True))
                yield placed(row, exact, words.tobytes(), pairs.tobytes(), 0, batch.schema.field("doc_ids").type.value_type)

    return run


class Model:
    """What turns levels into probabilities."""

    def __init__(self, tokens: int, types: int):
        self.tokens, self.types, self.weights = tokens, types, np.zeros(len(MIDDLE))

    def single(self, c: np.ndarray) -> np.ndarray:
        # a quantised count may be above the exact one, but no word is more than all
        return (np.minimum(c, self.tokens) + ALPHA) / (self.tokens + ALPHA * (self.types + 1))

    def parts(self, row: dict) -> tuple[np.ndarray, ...]:
        """Of each token: c(w), level and c of the word before, c of the pair."""
        level, counts = np.frombuffer(row["words"], np.uint8).astype(np.int64), np.array(row["counts"], np.int64)
        before = np.empty_like(level)
        before[1:] = level[:-1]
        before[np.cumsum(counts) - counts] = row["begin"]
        return MIDDLE[level], before, MIDDLE[before], MIDDLE[np.frombuffer(row["pairs"], np.uint8)]

    def log_scores(self, row: dict) -> np.ndarray:
        c, level, before, pair = self.parts(row)
        weight = np.where(before > 0, self.weights[level], 0.0)
        p = (1 - weight) * self.single(c) + weight * np.minimum(pair / np.maximum(before, 1), 1.0)
        counts = np.array(row["counts"], np.int64)
        return np.add.reduceat(np.log10(p), np.cumsum(counts) - counts)


RATIOS = np.concatenate([[0.0], 10 ** np.linspace(-3, 9, 121)])


def _ratios(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How far the pair's leave-one-out share is from the word's, by c(h)'s level, over training texts."""
        total = np.zeros(len(MIDDLE) * len(RATIOS), np.int64)
        for row in rows(batches):
            c, level, before, pair = model.parts(row)
            single = model.single(np.maximum(c - 1, 0))
            share = np.maximum(pair - 1, 0) / np.maximum(before - 1, 1)
            bin_ = np.clip(np.searchsorted(RATIOS, np.minimum(share, 1) / single, "right") - 1, 0, len(RATIOS) - 1)
            train = ~np.repeat(np.array(row["held"], bool), row["counts"])
            total += np.bincount((level * len(RATIOS) + bin_)[train], minlength=len(total))
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], ["cell", "n"])

    return run


def fitted_weights(cells: dict[int, int]) -> np.ndarray:
    """The weight of pairs for each level of c(h), by expectation maximisation."""
    table = np.zeros((len(MIDDLE), len(RATIOS)))
    for cell, n in cells.items():
        table[cell // len(RATIOS), cell % len(RATIOS)] += n
    out, fitted = np.zeros(len(MIDDLE)), []
    for level in range(1, len(MIDDLE)):
        # levels beside it lend some weight, so that rare levels are not overfitted
        n = table[level] + 0.25 * (table[level - 1] + table[min(level + 1, len(MIDDLE) - 1)])
        if n.sum() < FIT_TOKENS:
            continue
        weight = 0.2
        for _ in range(60):
            weight = min(float((n * weight * RATIOS / (1 - weight + weight * RATIOS)).sum() / n.sum()), 0.999)
        out[level] = min(max(weight, 1e-6), 0.95)
        fitted.append(level)
    for level in range(1, len(MIDDLE) if fitted else 0):
        out[level] = out[min(fitted, key=lambda x: abs(x - level))]
    return out


def fit(
    docs: DataFrame, train: Column, bits_per_entry: int = BITS_PER_ENTRY, broadcast_bytes: int = BROADCAST_BYTES, segment: int = SEGMENT,
    most_slices: int = MOST_SLICES,
) -> tuple[Model, DataFrame]:
    """The model, and the levels of all texts' tokens (LEVELS) as a stored table."""
    bounded_batches(docs)
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    texts = docs.select("doc_id", (~train).alias("held_out"), F.encode("text", "utf-8").alias("text"))
    slices = stored(texts.mapInArrow(_slices, SLICES.format(id=kind)), "lm-slices")
    n_train, n_slices = slices.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.count("*")).first()
    seg_bits, salts = max(0, (2 * n_train // segment).bit_length()), 1 + n_slices // most_slices
    form, is_small, types = LEVELS.format(id=kind), n_train * TOKEN_BYTES <= broadcast_bytes, 0
    if is_small or salts > 1:
        counted = slices.mapInArrow(_count(seg_bits, salts), COUNTED)
        if salts > 1:
            counted = counted.groupBy("seg", "salt").applyInArrow(_merged, COUNTED)
        segments = stored(counted.groupBy("seg").applyInArrow(_build(seg_bits, bits_per_entry), SEGMENTS), "lm-filter")
        types = segments.agg(F.coalesce(F.sum("types"), F.lit(0))).first()[0]
    if is_small:
        shared = spark.sparkContext.broadcast({r["seg"]: r.asDict() for r in segments.collect()})
        levels = slices.mapInArrow(_probe(shared, seg_bits), form)
    else:
        asked = slices.mapInArrow(_ask(seg_bits, salts, salts == 1), ASKED)
        if salts == 1:
            answers = asked.groupBy("seg").applyInArrow(_build_and_answer(seg_bits, bits_per_entry), ANSWERED)
        else:
            copies = segments.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
            answers = asked.groupBy("seg", "salt").cogroup(copies.groupBy("seg", "salt")).applyInArrow(_answer(seg_bits), ANSWERED)
        levels = slices.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(_place, form)
    levels = stored(levels, "lm-levels")
    types += levels.agg(F.coalesce(F.sum("types"), F.lit(0))).first()[0]
    model = Model(int(n_train), int(types))
    cells = levels.mapInArrow(_ratios(model), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    model.weights = fitted_weights({r["cell"]: r["n"] for r in cells})
    return model, levels


SCORED = "doc_id {id}, held_out boolean, n_tokens long, n_known long, logs double, score double"


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                flat = [row.column(c)[0].values for c in ("doc_ids", "held", "counts", "known", "logs")]
                flat[2] = flat[2].cast(LONG)
                score = pa.array(model.log_scores(row.to_pylist()[0]))
                yield pa.RecordBatch.from_arrays([*flat, score], [c.split()[0] for c in SCORED.split(", ")])

    return run


def score_documents(docs: DataFrame, train: Column, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    model, levels = fit(docs, train, **options)
    scored = levels.mapInArrow(_score(model), SCORED.format(id=dict(docs.dtypes)["doc_id"]))
    bottom = float(np.log10(model.tokens + ALPHA * (model.types + 1)))
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(bottom)).alias("base_score"), "score",
    )
