"""Media columns for telephony audio: mu-law, A-law and IMA ADPCM in WAV form.

``store_media`` writes each payload byte for byte as the samples (or blocks) of
a WAV container with the codec's format tag, as a table in the shared folder.
``decode_media`` reads that table back, takes the payload out of the container,
expands mu-law and A-law through 256-entry tables, decodes ADPCM with numpy
across blocks (one step of the nibble loop serves all blocks of a batch), and
resamples from 16 to 8 kHz with a half-band filter.  ``store_pcm`` writes that
as a table of the shared folder too and reads it back.

Scale: two map-only passes, no shuffle, nothing on the driver.  A task works on
slices of about ``SLICE`` payload bytes, whatever the batch that Arrow hands it.

Defined cases: a null text is the empty text; an empty text still gives one
unit of padding; repeated rows are separate rows with equal values; a null id
stays null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from brickline.llm.common import stored

UNIT = 576
#: Bytes of an ADPCM block; it divides UNIT.
BLOCK = 288
#: Samples a second of the media, and of the stored PCM.
RATE, PCM_RATE = 16_000, 8_000
SLICE = 4 << 20
MULAW, ALAW, ADPCM = "mulaw", "alaw", "adpcm"
CODECS = (MULAW, ALAW, ADPCM)
#: WAV format tags.
TAGS = {ALAW: 0x0006, MULAW: 0x0007, ADPCM: 0x0011}
#: Fixed values of the IMA ADPCM step rule.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97,
    107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796,
    876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871,
    5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623,
    27086, 29794, 32767,
], dtype=np.int32)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    magnitude = (((code & 0x0F) << 3) + 0x84 << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -magnitude, magnitude).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    segment, low = (code & 0x70) >> 4, ((code & 0x0F) << 4) + 8
    magnitude = np.where(segment == 0, low, (low + 0x100) << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, magnitude, -magnitude).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def wav(codec: str, payload: bytes) -> bytes:
    """The payload as a mono WAV file of the codec."""
    if codec == ADPCM:
        per_block = 1 + 2 * (BLOCK - 4)
        form = struct.pack("<HHIIHHHH", TAGS[codec], 1, RATE, RATE * BLOCK // per_block, BLOCK, 4, 2, per_block)
        samples = len(payload) // BLOCK * per_block
    else:
        form = struct.pack("<HHIIHHH", TAGS[codec], 1, RATE, RATE, 1, 8, 0)
        samples = len(payload)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form
    body += b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwav(media: bytes) -> tuple[str, memoryview]:
    """Codec and payload of a WAV file made by wav()."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV container")
    at, codec = 12, None
    while at < len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            tag = struct.unpack_from("<H", media, at + 8)[0]
            codec = next(c for c, t in TAGS.items() if t == tag)
        elif kind == b"data":
            return codec, memoryview(media)[at + 8 : at + 8 + size]
        at += 8 + size
    raise ValueError("no data chunk")


def adpcm_decoded(blocks: np.ndarray) -> np.ndarray:
    """(n, BLOCK) bytes -> (n, 1 + 2 * (BLOCK - 4)) samples; every step for all blocks."""
    n = len(blocks)
    head = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.clip(blocks[:, 2].astype(np.int32), 0, 88)
    out = np.empty((1 + 2 * (BLOCK - 4), n), dtype=np.int16)
    out[0] = head
    codes = blocks[:, 4:].T
    value = head
    for k in range(BLOCK - 4):
        both = np.ascontiguousarray(codes[k])
        for half, nibble in ((1, both & 15), (2, both >> 4)):
            step = STEPS[index]
            change = (((nibble & 7).astype(np.int32) * 2 + 1) * step) >> 3
            value = np.clip(np.where(nibble & 8, value - change, value + change), -32768, 32767)
            out[2 * k + half] = value
            index = np.clip(index + INDEX_STEP[nibble], 0, 88)
    return out.T


def halved(pcm: np.ndarray) -> np.ndarray:
    """Half the sample rate: every second sample of a half-band low-pass, edges held."""
    x = np.pad(pcm.astype(np.int32), (3, 4), mode="edge")
    n = -(-len(pcm) // 2)
    at = lambda k: x[3 + k : 3 + k + 2 * n : 2][:n]
    return np.clip((16 * at(0) + 9 * (at(-1) + at(1)) - at(-3) - at(3) + 16) >> 5, -32768, 32767).astype(np.int16)


def slices(sizes: list[int], most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` bytes in all."""
    begin = total = 0
    for i, size in enumerate(sizes):
        total += size
        if total >= most:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = [x or 0 for x in batch.column("n_bytes").to_pylist()]
        for begin, end in slices(lengths):
            part, media = batch.slice(begin, end - begin), []
            for text in part.column("payload"):
                raw = text.as_py() or b""
                payload = raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))
                media.append(wav(CODECS[zlib.crc32(payload) % len(CODECS)], payload))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("n_bytes"), pa.array(media, pa.binary())],
                ["doc_id", "n_bytes", "media"],
            )


DECODED = (
    "doc_id {id}, n_bytes long, codec string, payload_bytes long, payload_sha256 string, tail_crc32 long,"
    " media_bytes long, media_sha256 string, samples long, peak long, energy long, crossings long, pcm binary"
)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every = batch.column("media").to_pylist()
        for begin, end in slices([len(m) for m in every]):
            media = every[begin:end]
            parsed = [unwav(m) for m in media]
            pcm = {
                i: TABLES[codec][np.frombuffer(payload, np.uint8)]
                for i, (codec, payload) in enumerate(parsed)
                if codec != ADPCM
            }
            if rest := [i for i in range(len(parsed)) if i not in pcm]:
                blocks = [np.frombuffer(parsed[i][1], np.uint8).reshape(-1, BLOCK) for i in rest]
                samples, at = adpcm_decoded(np.concatenate(blocks)), 0
                for i, b in zip(rest, blocks, strict=True):
                    pcm[i] = samples[at : at + len(b)].reshape(-1)
                    at += len(b)
            cols: list[list] = [[] for _ in range(11)]
            for i, (codec, payload) in enumerate(parsed):
                out = halved(pcm[i])
                wide = out.astype(np.int64)
                row = (
                    codec, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]),
                    len(media[i]), hashlib.sha256(media[i]).hexdigest(), len(out), int(np.abs(wide).max()),
                    int(wide @ wide), int(np.count_nonzero((out[1:] < 0) != (out[:-1] < 0))), out.tobytes(),
                )
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.int64()] * 4
            part = batch.slice(begin, end - begin)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("n_bytes")]
                + [pa.array(c, k) for c, k in zip(cols, [*kinds, pa.binary()], strict=True)],
                [x.split()[0] for x in DECODED.format(id="long").split(",")],
            )


def store_media(docs: DataFrame) -> DataFrame:
    """The stored table of media: doc_id, n_bytes, media (a WAV file)."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.selectExpr(
        "doc_id",
        "cast(octet_length(coalesce(text, '')) as long) as n_bytes",
        "encode(coalesce(text, ''), 'utf-8') as payload",
    )
    return stored(rows.mapInArrow(_store, f"doc_id {kind}, n_bytes long, media binary"), "media")


def decode_media(media: DataFrame) -> DataFrame:
    """Decoded and resampled PCM (16 bit, little-endian, PCM_RATE) with digests."""
    return media.mapInArrow(_decode, DECODED.format(id=dict(media.dtypes)["doc_id"]))


def store_pcm(media: DataFrame) -> DataFrame:
    """The stored table of resampled PCM, its digests and figures beside it."""
    return stored(decode_media(media), "media-pcm")
