"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Each passage is encoded
(shares of byte classes, hashed pairs of classes, word lengths, repeated words),
embedded, and given a gated attention weight, tanh(V h) * sigmoid(U h), that is
learned from document labels alone.  The weighted sum of the embeddings is the
document's representation, and its logistic score is the result.

Learning takes a bounded sample, by hash: at most about ``train_rows`` labelled
documents and ``train_bytes`` of their texts, without texts of more than a hundredth
of that; their passages' encodings are the only rows that the driver gets.  Scoring
is a map over whole texts.  A text is encoded in pieces of ``PIECE`` words, whose
attention is pooled as it comes, so memory doesn't follow the longest text.

Defined cases: a null text, or one without words, is a bag of one empty passage
and gets a score too; repeated rows are scored each; labels without a document,
and null labels, teach nothing; extra columns are ignored; without any training
row the score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickline.llm.common import stored

PASSAGE = 40
TRAIN_ROWS = 4_000
PAIR_CELLS = 64
TRAIN_BYTES = 32 << 20
SLICE = 1 << 20
#: Words of a piece: whole passages.
PIECE = PASSAGE << 11
WORDS = re.compile(rb"[^ \t\n\r\x0b\x0c]+")
HIDDEN, GATE = 24, 12


def byte_classes() -> np.ndarray:
    """A class for each byte: white space, letters, digits, each ASCII mark."""
    out, known = np.zeros(256, np.int64), {}
    for b in range(256):
        c = chr(b)
        name = (
            "space" if c in " \t\n\r\x0b\x0c" else "high" if b >= 128 else "digit" if c.isdigit()
            else "vowel" if c in "aeiou" else "lower" if c.islower() else "upper" if c.isupper() else c if b >= 32 else "control"
        )
        out[b] = known.setdefault(name, len(known))
    return out


CLASS = byte_classes()
N_CLASSES = int(CLASS.max()) + 1
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
N_FEATURES = N_CLASSES + PAIR_CELLS + 6


def pieces(text: bytes) -> Iterator[bytes]:
    """The text cut before every PIECE-th word; a short one as it is."""
    if len(text) < 2 * PIECE:
        yield text
        return
    at = 0
    for i, m in enumerate(WORDS.finditer(text)):
        if i and i % PIECE == 0:
            yield text[at : m.start()]
            at = m.start()
    yield text[at:]


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and the number of passages of each text (>= 1)."""
    # a space before and after each text keeps words of different texts apart
    sizes = np.array([len(t) + 2 for t in texts])
    buf = np.frombuffer(b"".join(b" " + t + b" " for t in texts), np.uint8)
    white = SPACE[buf]
    begin = np.flatnonzero(~white[1:] & white[:-1]) + 1
    end = np.flatnonzero(white[1:] & ~white[:-1]) + 1
    text_start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    first_word = np.searchsorted(begin, text_start)
    words = np.diff(np.append(first_word, len(begin)))
    passages = np.maximum(1, -(-words // PASSAGE))
    base = np.concatenate([[0], np.cumsum(passages)[:-1]])
    total = int(passages.sum())
    of_word = np.repeat(base - 0, words) + (np.arange(len(begin)) - np.repeat(first_word, words)) // PASSAGE
    # a passage's bytes reach from its first word to the next passage
    head = np.empty(total, np.int64)
    head[base] = text_start
    inner = np.flatnonzero(np.diff(of_word, prepend=-1)) if len(of_word) else np.empty(0, np.int64)
    later = inner[~np.isin(of_word[inner], base)]
    head[of_word[later]] = begin[later]
    length = np.diff(np.append(head, len(buf)))
    of_byte = np.repeat(np.arange(total), length)
    kind = CLASS[buf]
    x = np.zeros((total, N_FEATURES), np.float32)
    size = np.maximum(length, 1)[:, None]
    x[:, :N_CLASSES] = np.bincount(of_byte * N_CLASSES + kind, minlength=total * N_CLASSES).reshape(total, -1) / size
    # a blank follows the last text as it follows the others, so that neighbours make no difference
    pair = (kind * 37 + np.append(kind[1:], CLASS[32]) * 101) % PAIR_CELLS
    x[:, N_CLASSES : N_CLASSES + PAIR_CELLS] = (
        np.bincount(of_byte * PAIR_CELLS + pair, minlength=total * PAIR_CELLS).reshape(total, -1) / size
    )
    if len(begin):
        wide = end - begin
        # words are compared by length, first and last four bytes
        padded = np.concatenate([buf, np.zeros(8, np.uint8)])
        four = np.ndarray((len(buf) + 4,), "<u4", padded.tobytes(), strides=(1,))
        left, right = four[begin].astype(np.uint64), four[np.maximum(end - 4, 0)].astype(np.uint64)
        left = np.where(wide >= 4, left, left & ((np.uint64(1) << (8 * wide.clip(0, 4)).astype(np.uint64)) - np.uint64(1)))
        right = np.where(wide >= 4, right, 0)
        sign = left * np.uint64(0x9E3779B97F4A7C15) ^ right * np.uint64(0xC2B2AE3D27D4EB4F) ^ wide.astype(np.uint64)
        same = np.zeros(len(begin))
        same[1:] = (sign[1:] == sign[:-1]) & (of_word[1:] == of_word[:-1])
        n = np.bincount(of_word, minlength=total)
        mean = np.bincount(of_word, wide, total) / np.maximum(n, 1)
        square = np.bincount(of_word, wide.astype(float) ** 2, total) / np.maximum(n, 1)
        order = np.lexsort((sign, of_word))
        fresh = np.ones(len(order))
        fresh[1:] = (sign[order][1:] != sign[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])
        lone = np.bincount(of_word, wide == 1, total) / np.maximum(n, 1)
        x[:, -6] = mean / 10
        x[:, -5] = np.sqrt(np.maximum(square - mean**2, 0)) / 10
        x[:, -4] = np.bincount(of_word, same, total) / np.maximum(n, 1)
        x[:, -3] = np.bincount(of_word[order], fresh, total) / np.maximum(n, 1)
        x[:, -2] = lone
        x[:, -1] = np.log1p(n) / 4
    return x, passages


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Mil:
    """Gated-attention pooling over passages, trained with Adam."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        d = len(mean)
        self.p = {
            "E": rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), "e": np.zeros(HIDDEN),
            "V": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, GATE)), "U": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, GATE)),
            "w": rng.normal(0, 1 / np.sqrt(GATE), GATE), "c": np.zeros(HIDDEN), "b": np.zeros(1),
        }

    def forward(self, x: np.ndarray, bags: np.ndarray) -> dict:
        p, at = self.p, np.concatenate([[0], np.cumsum(bags)[:-1]])
        of = np.repeat(np.arange(len(bags)), bags)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(z @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        s = (t * g) @ p["w"]
        a = np.exp(s - np.maximum.reduceat(s, at)[of])
        a /= np.add.reduceat(a, at)[of]
        r = np.add.reduceat(a[:, None] * h, at, axis=0)
        return {"of": of, "at": at, "z": z, "h": h, "t": t, "g": g, "a": a, "r": r, "y": sigmoid(r @ p["c"] + p["b"][0])}

    def gradients(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray, decay: float) -> dict:
        p, f = self.p, self.forward(x, bags)
        d = (f["y"] - y) / len(y)
        dr = d[:, None] * p["c"]
        dh = f["a"][:, None] * dr[f["of"]]
        da = (f["h"] * dr[f["of"]]).sum(1)
        ds = f["a"] * (da - np.add.reduceat(f["a"] * da, f["at"])[f["of"]])
        tg = f["t"] * f["g"]
        dt = ds[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2)
        dg = ds[:, None] * p["w"] * tg * (1 - f["g"])
        dh += dt @ p["V"].T + dg @ p["U"].T
        dz = dh * (1 - f["h"] ** 2)
        out = {
            "E": f["z"].T @ dz, "e": dz.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": tg.T @ ds,
            "c": f["r"].T @ d, "b": np.array([d.sum()]),
        }
        return {k: v + decay * p[k] for k, v in out.items()}

    def fit(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 4e-3, decay: float = 1e-5, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        at = np.concatenate([[0], np.cumsum(bags)])
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(bags))
            for i in range(0, len(order), batch):
                part = order[i : i + batch]
                rows = np.concatenate([np.arange(at[j], at[j + 1]) for j in part])
                step += 1
                now = rate * (1 - epoch / epochs)
                for k, g in self.gradients(x[rows], bags[part], y[part], decay).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.999 * v2[k] + 0.001 * g * g
                    self.p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Score of each text, and the place (in words) of its weightiest passage."""
        short = [i for i, t in enumerate(texts) if len(t) < 2 * PIECE]
        score, top = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        if short:
            x, bags = encode([texts[i] for i in short])
            f = self.forward(x, bags)
            score[short] = f["y"]
            top[short] = [int(f["a"][s : s + n].argmax()) * PASSAGE for s, n in zip(f["at"].tolist(), bags.tolist(), strict=True)]
        for i in set(range(len(texts))) - set(short):
            score[i], top[i] = self.pooled(texts[i])
        return score, top

    def pooled(self, text: bytes) -> tuple[float, int]:
        """Score and weightiest passage of one text, piece after piece: sums of weights and
        of weighted passages, scaled to the largest logit so far."""
        p, most, weight, total, top, before = self.p, -np.inf, 0.0, np.zeros(HIDDEN), 0, 0
        for piece in pieces(text):
            x, bags = encode([piece])
            z = np.clip((x - self.mean) / self.scale, -8, 8)
            h = np.tanh(z @ p["E"] + p["e"])
            s = (np.tanh(h @ p["V"]) * sigmoid(h @ p["U"])) @ p["w"]
            if s.max() > most:
                shrink = np.exp(most - s.max())
                weight, total, most, top = weight * shrink, total * shrink, s.max(), (before + int(s.argmax())) * PASSAGE
            a = np.exp(s - most)
            weight, total, before = weight + a.sum(), total + a @ h, before + int(bags[0])
        return float(sigmoid(total / weight @ p["c"] + p["b"][0])), top


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for y, text in zip(batch.column("quality").to_pylist(), batch.column("text").to_pylist(), strict=True):
            x, _ = encode([text or b""])
            yield pa.RecordBatch.from_arrays(
                [pa.array([float(y)]), pa.array([len(x)], pa.int32()), pa.array([x.astype("<f4").tobytes()], pa.binary())], ["y", "n", "x"]
            )


def learn(docs: DataFrame, labels: DataFrame, train: Column, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> Mil | None:
    """The model, from at most about train_rows labelled documents where train holds."""
    known = labels.where(train & F.col("quality").isNotNull()).select("doc_id", "quality").dropna().distinct()
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).where(F.col("size") <= train_bytes // 100)
    found = stored(known.join(sized, "doc_id"), "quality-labels")
    n, size = found.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    share = min(1.0, train_rows / max(n, 1), train_bytes / max(size, 1))
    # labels that have a document, each once: no more than about train_rows of them
    known = found.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("doc_id", "quality").distinct()
    rows = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= train_bytes // 100).select("doc_id", F.encode("text", "utf-8").alias("text"))
    rows = rows.join(F.broadcast(known), "doc_id").select("quality", "text")
    got = rows.mapInArrow(_encode, "y double, n int, x binary").orderBy(F.xxhash64("x")).collect()
    if not got:
        return None
    x = np.concatenate([np.frombuffer(r["x"], "<f4").reshape(-1, N_FEATURES) for r in got]).astype(np.float64)
    model = Mil(x.mean(0), np.maximum(x.std(0), 1e-3))
    model.fit(x, np.array([r["n"] for r in got]), np.array([r["y"] for r in got]))
    return model


def _score(model: Mil | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, tops, held, size = [], [], [], 0
            texts = batch.column(batch.num_columns - 1)
            for i in range(len(batch)):
                held.append(texts[i].as_py() or b"")
                size += len(held[-1])
                if size >= SLICE or i == len(batch) - 1:
                    score, top = model.scores(held) if model else (np.full(len(held), 0.5), np.zeros(len(held), np.int64))
                    scores.append(score)
                    tops.append(top)
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(np.concatenate(scores) if scores else [], pa.float64()),
                 pa.array(np.concatenate(tops) if tops else [], pa.int64())],
                [*batch.schema.names[:-1], "score", "top_word"],
            )

    return run


def score_documents(docs: DataFrame, model: Mil | None, *keep: Column) -> DataFrame:
    """The columns of keep, score, and top_word (the first word of the passage
    with the largest attention weight)."""
    rows = docs.select(*keep, F.encode("text", "utf-8").alias("text_to_score"))
    kinds = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes[:-1])
    return rows.mapInArrow(_score(model), f"{kinds}, score double, top_word long")
