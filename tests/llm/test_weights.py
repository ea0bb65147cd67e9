import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickline.llm import ngram_lm


def test_weights_are_fitted_on_every_training_text(spark, monkeypatch):
    seen, whole = {}, ngram_lm.fitted_weights
    monkeypatch.setattr(ngram_lm, "fitted_weights", lambda cells: seen.update(cells) or whole(cells))
    docs = spark.range(6_000).selectExpr("id as doc_id", "concat('a b w', id % 50) as text")
    ngram_lm.fit(docs, F.col("doc_id") % 2 == 0)
    assert sum(seen.values()) == 3_000 * 4


def test_a_sparse_level_takes_the_nearest_weight():
    at = len(ngram_lm.RATIOS)
    got = ngram_lm.fitted_weights({5 * at + 60: 1000, 5 * at: 200, 20 * at + 50: 700, 20 * at: 900})
    assert got[0] == 0 and np.all(got[1:] > 0)
    assert got[8] == got[6] != got[19] == got[17] and got[-1] == got[21]
    assert not ngram_lm.fitted_weights({}).any()


def brute_scores(texts, train):
    """Scores from exact counts of levels, and weights fitted on exact leave-one-out counts."""
    words, pairs, tokens = {}, {}, 0
    lists = [[*(t or "").encode().lower().split(), None] for t in texts]
    for ws, is_train in zip(lists, train, strict=True):
        if is_train:
            for a, b in zip(["begin", *ws], ws, strict=False):
                words[b] = words.get(b, 0) + 1
                pairs[a, b] = pairs.get((a, b), 0) + 1
                tokens += 1
    model = ngram_lm.Model(tokens, len(words))
    words["begin"] = sum(train)
    level = lambda n: int(np.searchsorted(ngram_lm.BOUNDS, n, "right"))
    rows = []
    for ws, is_train in zip(lists, train, strict=True):
        l1, l2 = [level(words.get(w, 0)) for w in ws], [level(pairs.get(p, 0)) for p in zip(["begin", *ws], ws, strict=False)]
        rows.append({"held": [not is_train], "counts": [len(ws)], "begin": level(words["begin"]), "words": bytes(l1), "pairs": bytes(l2)})
    cells = {}
    for row in rows:
        if not row["held"][0]:
            for c, lv, before, pair in zip(*model.parts(row), strict=True):
                ratio = min(max(pair - 1, 0) / max(before - 1, 1), 1) / model.single(np.array(max(c - 1, 0)))
                cell = lv * len(ngram_lm.RATIOS) + min(max(int(np.searchsorted(ngram_lm.RATIOS, ratio, "right")) - 1, 0), len(ngram_lm.RATIOS) - 1)
                cells[cell] = cells.get(cell, 0) + 1
    model.weights = ngram_lm.fitted_weights(cells)
    out = []
    for ws, is_train in zip(lists, train, strict=True):
        total = 0.0
        for a, b in zip(["begin", *ws], ws, strict=False):
            c, h, p = (ngram_lm.MIDDLE[level(x)] for x in (words.get(b, 0), words.get(a, 0), pairs.get((a, b), 0)))
            weight = model.weights[level(words.get(a, 0))] if h > 0 else 0.0
            total += np.log10((1 - weight) * model.single(np.array(c)) + weight * min(p / max(h, 1), 1.0))
        out.append(float(total))
    return out


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "segment": 64}, {"broadcast_bytes": 0, "segment": 64, "most_slices": 2}])
def test_scores_against_brute_force(spark, monkeypatch, options):
    rng = random.Random(2)
    some = [" ".join(rng.choices([f"w{int(rng.paretovariate(0.6))}" for _ in range(60)], k=rng.randrange(1, 200))) for _ in range(120)]
    some += [some[0], some[1].upper(), None, "", " \n ", "é É 日本 " * 30, "long word " * 90_000]
    train = [i % 3 != 0 for i in range(len(some))]
    docs = spark.createDataFrame(list(zip(range(len(some)), some, train, strict=True)), "doc_id long, text string, train boolean")
    got = sorted(ngram_lm.score_documents(docs, F.col("train"), bits_per_entry=60, **options).collect())
    assert [r["held_out"] for r in got] == [not t for t in train]
    assert np.allclose([r["score"] for r in got], brute_scores(some, train), rtol=1e-9)


def test_counts_travel_in_bytes():
    n = np.array([0, 1, 254, 255, 256, 7, 1 << 40])
    assert ngram_lm.unpacked_counts(ngram_lm.packed_counts(n), len(n)).tolist() == n.tolist()
    for keys in ([], [0], [5, 9, 1 << 24, (1 << 24) + 7, (1 << 32) - 1], [(1 << 24) - 1, 1 << 25]):
        assert ngram_lm.unpacked_pairs(ngram_lm.packed_pairs(np.array(keys, "<u4"))).tolist() == keys
    assert ngram_lm.unpacked(ngram_lm.packed(np.array([0, (1 << 48) - 1], np.uint64))).tolist() == [0, (1 << 48) - 1]


def test_scores_of_an_empty_table_and_without_training_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, None)], "doc_id long, text string")
    assert ngram_lm.score_documents(docs.limit(0), F.lit(True)).count() == 0
    for options in ({}, {"broadcast_bytes": -1}):
        got = ngram_lm.score_documents(docs, F.lit(False), **options).collect()
        assert sorted(r["n_tokens"] for r in got) == [1, 3] and not any(r["n_known"] for r in got)


@pytest.mark.parametrize("most", [3, 300, 70_000, 1 << 24])
def test_numbers_of_words_come_back_from_their_planes(most):
    codes = np.random.default_rng(most).integers(0, most + 1, 1_000)
    codes[7] = most
    raw = ngram_lm.packed_codes(codes)
    assert len(raw) == (4 if most >= 1 << 24 else 3) * len(codes)
    assert (ngram_lm.unpacked_codes(raw, len(codes)) == codes).all()
