"""Prefix fingerprints, the Merkle manifest and ranked search against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickline.llm import manifest, prefixes, queries, ranked

DATA = Path("/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d long, h long, part int, idx long, tree string, leaves long, q int, score long, n long"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def table(spark, rows):
    """rows: doc_id, text, lang; with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, g, "s" if i and i % 2 else None, len(t or ""), 1, 2, 3, 4, "x", 5, 6, 7, 8) for i, t, g in rows], SCHEMA)


def odd_rows():
    rng = random.Random(5)
    words = ["der", "Haus", "the", "of", "ÉCOLE", "niño", "日本", "🙂", "x", "12,5", "THE", "--"]
    some = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 60))), rng.choice(["de", "en", "é", None])) for i in range(80)]
    return [*some, (100, None, "en"), (101, "", "en"), (102, " \n", "xx"), (103, "lang Text " * 30_000, "en"), (None, "no id", "de"), (None, None, None), (-5, "Neg", "de"), *some[:3], *[some[0]] * 5]


# -- prefix hashes -----------------------------------------------------------------


def test_spans_and_extensions():
    rng = random.Random(2)
    text = "".join(rng.choices("abé🙂", k=9000))
    p = prefixes.Prefixes(text)
    for _ in range(60):
        a, b, n = rng.randrange(9000), rng.randrange(9000), rng.choice([0, 1, 2, 5, 300])
        n = min(n, 9000 - a, 9000 - b)
        assert (p.span(a, n) == p.span(b, n)) == (text[a : a + n] == text[b : b + n])
    other = prefixes.Prefixes(text[:5000] + "#" + text[5000:])
    assert p.extension(0, other, 0) == 5000 and p.extension_back(p.n, other, other.n) == 4000
    assert p.extension(4990, other, 4990) == 10 and p.extension(9000, other, 3) == 0 and prefixes.Prefixes("").extension(0, p, 0) == 0


def test_cells_are_the_same_in_slices():
    text = "né🙂" * 70_000
    whole, prime = 0, prefixes.PRIMES[0]
    power = 1
    for c in text:
        whole, power = (whole + (ord(c) + 1) * power) % prime, power * prefixes.BASES[0] % prime
    cuts = np.array([0, 1, 65536, 65537, len(text)])
    got = prefixes.cells(text, cuts)
    assert int(got[0, -1]) == whole and [int(prefixes.cells(text[:c], np.array([c]))[0, 0]) for c in cuts[1:]] == [int(x) for x in got[0, 1:]]


def test_likeness():
    same = prefixes.fingerprint
    a = "lorem ipsum dolor sit amet " * 40
    assert prefixes.likeness(same(a), same(a)) == 1 and prefixes.likeness(same(""), same("")) == 1
    assert prefixes.likeness(same(""), same("x")) == 0 and prefixes.likeness(same("abc"), same("xyz")) == 0
    near = prefixes.likeness(same(a), same(a[:500] + "!" + a[500:]))
    assert 0.8 < near < 1 and prefixes.likeness(same(a), same(a[:-1])) < 1 and prefixes.likeness(same("aa"), same("ab")) == 0.5


def check_fingerprints(rows, docs):
    got = [tuple(r) for r in rows]
    order = sorted(docs, key=lambda r: (r[0] is None, 0 if r[0] is None else -r[0]))
    by_id = defaultdict(list)
    for r in order:
        by_id[r[0]].append(r[1] or "")
    assert Counter(r[0] for r in got) == Counter(r[0] for r in docs)
    ids = list(by_id)
    prints = {}
    for doc_id, n, digest, own, edited_print, near_edited, near_next in got:
        # documents of one id may go in any order of their texts
        at = ids.index(doc_id)
        afters = by_id[doc_id] + by_id[ids[(at + 1) % len(ids)]]
        options = []
        for text in set(by_id[doc_id]):
            if len(text) == n:
                options += [(text, text[: n - n // 2] + after[: n // 2], after) for after in afters]
        match = [o for o in options if sha(o[1]) == digest and prefixes.fingerprint(o[0]) == own]
        assert match and edited_print == prefixes.fingerprint(match[0][1])
        assert near_edited == prefixes.likeness(own, edited_print) and any(near_next == prefixes.likeness(own, prefixes.fingerprint(o[2])) for o in match)
        assert 0 <= near_edited <= 1 and 0 <= near_next <= 1
        prints.setdefault(match[0][0], own)
    assert len(set(prints.values())) == len(prints)


@pytest.mark.parametrize("part_bytes", [1 << 25, 300])
def test_edited_fingerprints(spark, part_bytes):
    rows = odd_rows()
    docs = table(spark, rows)
    check_fingerprints(prefixes.edited_fingerprints(docs.repartition(5), part_bytes).collect(), rows)
    one = prefixes.edited_fingerprints(docs.where("doc_id = 101")).collect()
    assert len(one) == 1 and one[0].near_next == 1 and one[0].edited_sha256 == sha("")
    empty = prefixes.edited_fingerprints(docs.limit(0))
    assert empty.count() == 0 and empty.columns == prefixes.edited_fingerprints(docs).columns


def test_hot_row_and_extensions(spark):
    docs = table(spark, [(1, "abcdef", "en")] * 25_000 + [(2, "abcxyz", "en"), (0, "zz", "en")])
    got = prefixes.edited_fingerprints(docs).groupBy("doc_id", "edited_sha256").count().collect()
    assert {(r[0], r[1], r[2]) for r in got} == {(1, sha("abcabc"), 24_999), (1, sha("abczz"), 1), (2, sha("abcabc"), 1), (0, sha("za"), 1)}
    pairs = spark.createDataFrame([("aébc", "aéxbc"), (None, "x"), ("same", "same")], "a string, b string")
    assert [tuple(r)[2:] for r in prefixes.common_extensions(pairs, "a", "b").collect()] == [(2, 2), (0, 0), (4, 4)]


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_fingerprint_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    check_fingerprints(queries.QUERIES["op11_prefix_fingerprints"](spark, str(DATA)).collect(), docs)


# -- Merkle manifest ---------------------------------------------------------------


def plain_tree(leaves):
    """The root, and for each leaf its siblings to the left and right by level."""
    paths, level = [[] for _ in leaves], list(leaves)
    groups = [[i] for i in range(len(leaves))]
    while len(level) > 1:
        above, joined = [], []
        for s in range(0, len(level), 8):
            run = level[s : s + 8]
            for k in range(len(run)):
                for leaf in groups[s + k]:
                    paths[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(sha("".join(run)))
            joined.append([x for g in groups[s : s + 8] for x in g])
        level, groups = above, joined
    return level[0], paths


def plain_manifest(rows):
    def leaf(r, text):
        return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r.doc_id, r.source, r.lang, r.n_chars, text)))

    trees = defaultdict(list)
    for r in rows:
        trees[(r.lang is not None, (r.lang or "").encode())].append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    subs, order, out = {}, sorted(trees), []
    for key in order:
        trees[key].sort(key=lambda x: x[:3])
        subs[key] = plain_tree([x[2] for x in trees[key]])
    root, tops = plain_tree([subs[k][0] for k in order])
    for key, top in zip(order, tops, strict=True):
        sub, paths = subs[key]
        for (_, _, digest, r), path in zip(trees[key], paths, strict=True):
            ascii_low = None if r.text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)
            bad = zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 0
            f = leaf(r, ascii_low) if bad else digest
            for a, b in path + top:
                f = sha(a + f + b)
            out.append((r.doc_id, digest, sub, root, sha("".join(a + b for a, b in path + top)), f, f == root))
    return out


def test_places_are_the_order_of_completion():
    for n in (1, 2, 8, 9, 64, 65, 513, 700):
        done, order = defaultdict(int), []
        for e in range(n):
            order.append((0, e))
            for k in range(1, manifest.height(n) + 1):
                if (e + 1) % 8**k == 0 or e == n - 1:
                    order.append((k, done[k]))
                    done[k] += 1
        assert [manifest.position(k, i, n) for k, i in order] == list(range(len(order)))


def test_manifest(spark):
    docs = table(spark, odd_rows())
    got = manifest.verified_documents(docs.repartition(7))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_manifest(docs.collect())))
    one = docs.where("doc_id = 102")
    assert [tuple(r) for r in manifest.verified_documents(one).collect()] == plain_manifest(one.collect())
    assert manifest.verified_documents(docs.limit(0)).count() == 0


def test_manifest_of_two_tiers_and_a_repeated_row(spark):
    rows = [(i, f"Text {i}", "en") for i in range(1300)] + [(7, "same", "de")] * 600 + [(i, "x", f"g{i:03}") for i in range(600)]
    docs = table(spark, rows)
    found = manifest.manifest(docs, F.col("doc_id") % 2 == 0)
    assert len(found.trees.tiers) == 2 and len(found.top.tiers) == 2
    got = manifest.verified_documents(docs)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_manifest(docs.collect())))
    places = sorted(p for t in found.trees.tiers for r in t.where("tree = '1en'").collect() for p in r["places"])
    assert places == list(range(1300 + 163 + 21 + 3 + 1))


# -- ranked search -----------------------------------------------------------------


def plain_ranking(docs, items, k=20):
    def terms(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)

    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, length = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        asked, scored = Counter(terms(text)), []
        for i, b in bags:
            m = 75 + (25 * b.total() * n) // length
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 12 * m)) for t, times in asked.items() if b[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return out


def test_search(spark, monkeypatch):
    rows = odd_rows()
    items = [(1, "der niño 日本 THE the"), (2, None), (3, "--"), (None, "x"), (4, "haus École absent"), (4, "haus École absent"), (5, "Neg 12 5")]
    docs, asked = table(spark, rows), spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(9)).withColumn("q", F.lit(1))
    want = sorted(map(repr, plain_ranking([r[:2] for r in rows], items)))
    assert sorted(map(repr, map(tuple, ranked.search(docs.repartition(3), asked).collect()))) == want
    monkeypatch.setattr(ranked, "MOST_TERMS", 4)
    assert sorted(map(repr, map(tuple, ranked.search(docs, asked).collect()))) == want
    assert ranked.search(docs.limit(0), asked).count() == 0 and ranked.search(docs, asked.limit(0)).count() == 0


def test_blocks_are_skipped_and_nothing_is_lost():
    rng = np.random.default_rng(3)
    groups = rng.integers(0, 12, 3000)
    docs, shards = [], []
    for i, g in enumerate(groups):
        own = rng.choice(np.arange(20 * g, 20 * g + 20), 8, replace=False)
        docs.append((i, np.concatenate([np.unique(own), 240 + np.unique(rng.integers(0, 10, 6))]), None))
    weights = np.concatenate([rng.integers(2000, 6000, 240), rng.integers(1, 200, 10)])
    parts = [rng.integers(1000, 900_000, len(t)) for _, t, _ in docs]
    for s in range(0, 3000, 1500):
        some = docs[s : s + 1500]
        at = np.repeat(np.arange(len(some)), [len(t) for _, t, _ in some])
        shards.append(ranked.built(np.array([i for i, *_ in some]), at, np.concatenate([t for _, t, _ in some]), np.concatenate(parts[s : s + 1500]), weights))
    asked = [np.unique(np.concatenate([rng.integers(20 * g, 20 * g + 20, 5), rng.integers(240, 250, 3)])) for g in (0, 4, 7)]
    wanted = [(t, weights[t] * rng.integers(1, 3, len(t))) for t in asked]
    best = [ranked.Best(20) for _ in wanted]
    seen = [ranked.searched(s, wanted, best) for s in shards]
    blocks = [sum(np.isin(np.frombuffer(s["terms"], "<i4")[np.frombuffer(s["block_term"], "<i4")], t).sum() for t in asked) for s in shards]
    assert sum(seen) < 0.6 * sum(blocks)
    for (ids, worth), top in zip(wanted, best, strict=True):
        value = dict(zip(ids.tolist(), worth.tolist(), strict=True))
        scores = [sum(value.get(t, 0) * p for t, p in zip(terms.tolist(), part.tolist(), strict=True)) for (_, terms, _), part in zip(docs, parts, strict=True)]
        order = sorted(range(3000), key=lambda i: (-scores[i], i))[:20]
        assert top.ids.tolist() == order and top.scores.tolist() == [scores[i] for i in order]


def test_terms_of_long_texts_are_counted_in_pieces(monkeypatch):
    text = "Äpfel and PEARS, " * 500
    whole = ranked.counts_of(text)
    monkeypatch.setattr(ranked, "PIECE", 10)
    assert ranked.counts_of(text) == whole == Counter({"Äpfel".encode(): 500, b"and": 500, b"pears": 500})
