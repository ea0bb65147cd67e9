"""Static range asymmetric numeral system over token ids, with numpy.

One frequency table (summing to ``2**SCALE``) serves every block.  A block
interleaves up to ``LANES`` independent 64-bit states: step s codes the ids
``s * lanes ... s * lanes + lanes - 1``, so each step is a vector operation.
Every ``EVERY`` steps the states and the place in the word stream are kept as a
checkpoint, from which a reader can decode that segment alone; each segment has
a crc32 of its ids, the block one of its bytes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE = 18
LOW = np.uint64(1 << 31)
LANES = 4096
#: Steps between checkpoints.
EVERY = 128
MAGIC = b"RNS1"
HEAD = "<4sIIIIII"
WORD_BITS = np.uint64(32)
LOW_WORD = np.uint64(0xFFFFFFFF)


def frequencies(counts: dict[int, int], scale: int = SCALE) -> dict[int, int]:
    """Counts scaled to a sum of 2**scale, at least 1 for every id that occurs."""
    total, room = sum(counts.values()), 1 << scale
    if not counts:
        return {}
    if len(counts) > room:
        raise ValueError("more ids than the table has room for")
    ids = sorted(counts, key=lambda i: (-counts[i], i))
    out = {i: max(1, counts[i] * room // total) for i in ids}
    rest = room - sum(out.values())
    while rest:  # what rounding left goes to, or comes from, the most frequent ids
        for i in ids:
            step = max(rest, 1 - out[i], -(out[i] // 2)) if rest < 0 else rest
            out[i] += step
            rest -= step
            if not rest:
                break
    return out


class Table:
    """The shared frequency table in the shape that coding needs."""

    def __init__(self, freq: dict[int, int], scale: int = SCALE):
        self.scale = np.uint64(scale)
        self.ids = np.array(sorted(freq), dtype=np.int64)
        of_id = np.array([freq[int(i)] for i in self.ids], dtype=np.uint64)
        size = int(self.ids[-1]) + 1 if len(self.ids) else 1
        self.freq, self.cum = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.freq[self.ids] = of_id
        self.cum[self.ids] = np.cumsum(of_id) - of_id
        self.symbol = np.repeat(self.ids, of_id.astype(np.int64)).astype(np.uint32)
        self.mask = np.uint64((1 << scale) - 1)
        self.check = zlib.crc32(self.freq.tobytes())


def lanes_for(n: int) -> int:
    return max(1, min(LANES, n // 128))


def encode(ids: np.ndarray, table: Table) -> bytes:
    """One self-contained block of ids."""
    n, lanes = len(ids), lanes_for(len(ids))
    steps = -(-n // lanes)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    written, marks = 0, []
    limit = np.uint64(int(LOW) >> int(table.scale) << 32)
    for s in range(steps - 1, -1, -1):
        symbols = ids[s * lanes : (s + 1) * lanes]
        x = state[: len(symbols)]
        f, c = table.freq[symbols], table.cum[symbols]
        full = x >= limit * f
        out = x[full]
        words.append((out & LOW_WORD).astype(np.uint32))
        written += len(out)
        x[full] = out >> WORD_BITS
        q = x // f
        x[:] = (q << table.scale) + (x - q * f) + c
        if s % EVERY == 0:
            part = ids[s * lanes : (s + EVERY) * lanes]
            marks.append((written, zlib.crc32(part.astype("<u4").tobytes()), state.astype("<u8").tobytes()))
    stream = np.concatenate(words[::-1]).astype("<u4").tobytes() if words else b""
    marks.reverse()  # in reading order; places count from the stream's start
    body = b"".join(struct.pack("<II", written - at, crc) for at, crc, _ in marks)
    body += b"".join(s for _, _, s in marks) + stream
    return struct.pack(HEAD, MAGIC, n, lanes, EVERY, len(marks), table.check, zlib.crc32(body)) + body


def segment(block: bytes, table: Table, k: int) -> np.ndarray:
    """The ids between checkpoint k and the next, decoded without the others."""
    magic, n, lanes, every, marks, check, _ = struct.unpack_from(HEAD, block)
    if magic != MAGIC or check != table.check:
        raise ValueError("not a block of this frequency table")
    at = struct.calcsize(HEAD)
    place, crc = struct.unpack_from("<II", block, at + 8 * k)
    states = at + 8 * marks
    state = np.frombuffer(block, "<u8", lanes, states + 8 * lanes * k).astype(np.uint64)
    stream = np.frombuffer(block, "<u4", -1, states + 8 * lanes * marks)
    first, end = k * every * lanes, min(n, (k + 1) * every * lanes)
    ids = np.empty(end - first, np.uint32)
    for begin in range(0, end - first, lanes):
        x = state[: min(lanes, end - first - begin)]
        slot = x & table.mask
        symbols = table.symbol[slot]
        ids[begin : begin + len(x)] = symbols
        x[:] = table.freq[symbols] * (x >> table.scale) + slot - table.cum[symbols]
        short = np.flatnonzero(x < LOW)
        x[short] = (x[short] << WORD_BITS) | stream[place : place + len(short)]
        place += len(short)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError(f"checksum of segment {k} differs")
    return ids


def decode(block: bytes, table: Table) -> np.ndarray:
    """All ids of a block; its bytes are checked first."""
    *_, marks, _, crc = struct.unpack_from(HEAD, block)
    if zlib.crc32(block[struct.calcsize(HEAD) :]) != crc:
        raise ValueError("checksum of the block differs")
    return np.concatenate([segment(block, table, k) for k in range(marks)]) if marks else np.empty(0, np.uint32)
