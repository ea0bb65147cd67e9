import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from brickline.llm import simhash


def brute_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, distance=3):
    root = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= distance and root[j] < root[i]:
                    root[i], changed = root[j], True
    return root


def near_texts(seed=3):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(4000)}" for _ in range(rng.choice([1, 2, 3, 9, 400]))] for _ in range(25)]
    texts = [None, "", "   \n"]
    for words in base:
        texts.append(" ".join(words))
        for _ in range(4):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "changed"
            texts.append("  ".join(copy))
        texts.append(" ".join(words).upper())
    texts.append("long " * 30000 + "tail é ÉÀ ẞ")
    return texts


def check(spark, texts, **options):
    rows = [(i, t, "x", 1.0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, root double")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs, **options).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [got[i]["fp"] % (1 << 64) for i in range(len(texts))] == fps
    assert [got[i]["component_id"] for i in range(len(texts))] == brute_components(fps)


def test_against_brute_force(spark):
    check(spark, near_texts())


def test_crowded_variants_meet_in_the_values_between(spark, monkeypatch):
    whole = simhash.links
    monkeypatch.setattr(simhash, "links", lambda d, k: whole(d, k, dense=3))
    check(spark, near_texts(5))


def test_empty_table_and_null_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    rows = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "q r s")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in simhash.near_duplicates(rows).collect())
    assert got == [(-1, -1), (-1, 7), (7, 7), (7, 7)]


@pytest.mark.parametrize("distance", [0, 1, 3, 5])
def test_links_find_every_pair(spark, distance):
    rng = np.random.default_rng(distance)
    seeds = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    values = set(int(s) for s in seeds)
    for s in seeds:
        for k in range(1, 7):
            flips = rng.choice(64, k, replace=False)
            values.add(int(s) ^ sum(1 << int(b) for b in flips))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), distance).collect()
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= distance}
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 4])
def test_hubs_have_the_components_of_all_links(spark, distance):
    rng = np.random.default_rng(distance + 10)
    values = {int(s) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for s in rng.integers(0, 1 << 63, 8, dtype=np.uint64) for k in (0, 1, 2, 2, 3, 3, 4, 5)}
    fps = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    found = simhash.hub_links(spark.createDataFrame([(v,) for v in fps], "fp long"), distance)
    got = {r["node"]: r["root"] for r in simhash.components(found).collect()}
    want = brute_components([v % (1 << 64) for v in fps], distance)
    assert [got.get(v, v) for v in fps] == [fps[i] for i in want]


def test_repeated_rows_with_maps(spark):
    rows = [(1, "a b c d", {"k": 2}), (1, "a b c d", {"k": 1}), (2, "x y z", {"k": 3})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more map<string,int>")
    assert sorted((r["doc_id"], r["more"]["k"]) for r in simhash.deduplicated(docs).collect()) == [(1, 1), (2, 3)]
