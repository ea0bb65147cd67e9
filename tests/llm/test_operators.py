"""Each operator on small tables with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from brickline.llm import curriculum, decontaminate, langid, licenses, ngram_lm, quality, queries, ring, telephony
from brickline.llm.license_texts import KNOWN

DATA = Path("/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, size long, start long, score double"
needs_data = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


def table(spark, texts, source=lambda i: "s"):
    rows = [(i if i is None or i >= 0 else None, t, None, source(j), 0, 1, 2, 3, 0.5) for j, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd_texts():
    rng = random.Random(4)
    words = ["der", "Haus", "the", "of", "ÉCOLE", "niño", "日本", "x", "12,5", "(c)", "--"]
    some = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 80)))) for i in range(60)]
    return [*some, (100, None), (101, ""), (102, " \n\t "), (103, "lang " * 40_000), (None, "no id"), (-1, None), *some[:3], some[0]]


def test_licences(spark):
    name, text = KNOWN[0]
    loud = "Copyright (c) 1999 Someone\n" + text.upper().replace(" ", "  ").replace(",", " ;")
    docs = table(spark, [(501, loud), (502, text + " more"), (503, None), (504, "Copyright 2001 X\n"), (505, "prose\n" + text.replace("\n", " ") + "\nprose"), *odd_texts()])
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect() if (r["doc_id"] or 0) > 500}
    assert [got[i]["license"] for i in (501, 502, 503, 504)] == [name, None, None, None]
    assert got[505]["n_notices"] == 1 and got[505]["notice_licenses"] == name
    assert licenses.scan_licenses(docs).count() == docs.count() and licenses.scan_licenses(docs.limit(0)).count() == 0


def brute_adpcm(block):
    steps, value, index = telephony.STEPS.tolist(), int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for n in (byte & 15, byte >> 4):
            change = ((n & 7) * 2 + 1) * steps[index] >> 3
            value = max(-32768, min(32767, value - change if n & 8 else value + change))
            index = max(0, min(88, index + telephony.INDEX_STEP.tolist()[n]))
            out.append(value)
    return out


def test_telephony_decoders():
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (5, telephony.BLOCK), dtype=np.uint8)
    assert telephony.adpcm_decoded(blocks).tolist() == [brute_adpcm(b.tobytes()) for b in blocks]
    mu, a = telephony.TABLES["mulaw"], telephony.TABLES["alaw"]
    assert (mu[0xFF], mu[0x00], mu[0x80], a[0xD5], a[0x55], a[0x2A]) == (0, -32124, 32124, 8, -8, -32256)
    assert len(set(a.tolist())) == 256 and sorted(mu.tolist()) == sorted((-mu).tolist())
    pcm = np.random.default_rng(2).integers(-32768, 32768, 1153).astype(np.int16)
    held = lambda i: int(pcm[min(max(i, 0), len(pcm) - 1)])
    want = [(16 * held(i) + 9 * (held(i - 1) + held(i + 1)) - held(i - 3) - held(i + 3) + 16) >> 5 for i in range(0, len(pcm), 2)]
    assert telephony.halved(pcm).tolist() == [max(-32768, min(32767, y)) for y in want]
    assert telephony.halved(np.full(7, 500, np.int16)).tolist() == [500] * 4


def test_media_round_trip(spark):
    texts = odd_texts()
    got = telephony.store_pcm(telephony.store_media(table(spark, texts))).collect()
    assert len(got) == len(texts)
    for r in got:
        pcm = np.frombuffer(r["pcm"], "<i2").astype(int)
        assert (r["samples"], r["peak"], r["energy"]) == (len(pcm), abs(pcm).max(), (pcm**2).sum())
    want = {}
    for i, t in texts:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        want[hashlib.sha256(payload).hexdigest()] = (len(raw), len(payload), zlib.crc32(payload[-32:]))
    assert {r["payload_sha256"]: (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) for r in got} == want
    assert {r["codec"] for r in got} == set(telephony.CODECS)
    assert telephony.decode_media(telephony.store_media(table(spark, [(1, "x")]).limit(0))).count() == 0


def test_mix_targets_and_order(spark):
    texts = [(i, "w " * (i % 7)) for i in range(300)] + [(300, None), (None, "a b"), (5, "w " * 5)]
    docs = table(spark, texts, source=lambda j: [None, "a", "b", "c", "Z"][j % 5 if j % 3 else 1])
    plan = curriculum.mix_plan(docs).collect()
    assert len(plan) == len(texts)
    sources = {r["source"]: (r["source_size"], r["target"]) for r in plan}
    order = sorted((s for s in sources if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, goal, open_ = 1.5 * sum(v[0] for v in sources.values()), {}, set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * sources[s][0] <= level * weight[s]}
        goal |= {s: min(2 * sources[s][0], level * weight[s]) for s in full or open_}
        left -= sum(goal[s] for s in full)
        open_ = open_ - full if full else set()
    for s in order:
        taken = sum(sum(r["takes"]) for r in plan if r["source"] == s)
        assert abs(sources[s][1] - goal[s]) < 1e-6 and abs(taken - goal[s]) <= 1
    assert all(0 <= sum(r["takes"]) <= 2 * r["size"] for r in plan)
    assert all(p is None or 0 <= p <= 1 for r in plan for p in r["positions"])
    assert curriculum.mix_documents(docs).columns == docs.columns and curriculum.mix_plan(docs.limit(0)).count() == 0


def test_inverted_schedule(spark):
    for knots in curriculum.SCHEDULES:
        [row] = spark.range(1).select(*[curriculum.inverted(F.lit(u), knots).alias(f"u{i}") for i, u in enumerate((0.0, 0.3, 0.5, 0.99, 1.0))]).collect()
        for t, u in zip(row, (0.0, 0.3, 0.5, 0.99, 1.0), strict=True):
            grid = np.linspace(0, 1, 20001)
            w = np.interp(grid, *zip(*knots, strict=True))
            area = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
            assert abs(np.interp(t, grid, area / area[-1]) - u) < 1e-4


def brute_hits(texts, items):
    def words(t):
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or "")
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]

    windows = {(tuple(w[i : i + 10]), item) for item, t in items if (w := words(t)) for i in range(max(1, len(w) - 9))}
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for p, item in windows:
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    found.add(str(item))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return out


def test_decontamination(spark):
    passage = " ".join(f"w{i}" for i in range(14))
    items = [(1, passage), (2, "Short item"), (3, None), (4, ""), (5, "the " * 12), (6, passage), (10, "éa ßb Öc")]
    texts = [passage, f"x {passage.upper()}! {passage}", passage.replace("w9", "v9"), "a short, ITEM. short item", None, "", "the " * 500 + "short", "éa ßb Öc", "Éa ßb Öc", " ".join(passage.split()[2:12]), "y " * 3000 + passage]
    docs = table(spark, [(i, t) for i, t in enumerate(texts)] + [(0, passage)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(decontaminate.phrase_hits(docs, bench)).collect()
    want = brute_hits([*texts, passage], items)
    assert sorted((r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in got) == sorted(want)
    none = decontaminate.report(decontaminate.phrase_hits(docs, bench.limit(0))).collect()
    assert len(none) == len(texts) + 1 and not any(r["contaminated"] for r in none)
    assert decontaminate.phrase_hits(docs.limit(0), bench).count() == 0


def test_proximity(spark):
    docs = table(spark, [(1, "alpha beta gamma"), (2, "alpha x beta y gamma"), (3, "gamma " + "z " * 30 + "alpha beta"), (4, None)])
    bench = spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string")
    got = decontaminate.proximity_matches(docs, bench, slop=3).collect()
    assert sorted((r["doc_id"], r["item"]) for r in got) == [(1, "7"), (2, "7")]


def test_ring(spark):
    texts = [*odd_texts(), *[(1000 + i, "x" * (i % 90)) for i in range(1500)]]
    docs = table(spark, texts)
    got = ring.shard_documents(docs).collect()
    assert len(got) == len(texts)
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    small = ring.shard_documents(table(spark, texts[70:])).collect()
    loads = [sum(r["size"] for r in small if r["shard"] == s) for s in range(8)]
    assert max(loads) <= 1.05 * sum(loads) / 8
    # one key, and one text without a key, with most of the rows
    hot = [(5, "same text")] * 2000 + [(None, "other")] * 1500 + [(2000 + i, "y" * (i % 50)) for i in range(500)]
    rows = ring.shard_documents(table(spark, hot)).collect()
    assert sorted((r["doc_id"] or -1, r["size"]) for r in rows) == sorted((i or -1, len(t) + 1) for i, t in hot)
    loads = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(8)]
    assert max(loads) <= 1.05 * sum(loads) / 8 and min(loads) >= 0.95 * sum(loads) / 8
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert ring.shard_documents(docs.limit(0)).count() == 0


def brute_place(loads, shards, vnodes, slack, bin_bits):
    """The ring walked point by point."""
    points = [(int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big"), s) for s in range(shards) for v in range(vnodes)]
    room = {s: (1 + slack) * sum(loads.values()) / shards for s in range(shards)}
    held, found = dict.fromkeys(range(shards), 0), {}
    for (arc, piece), load in sorted(loads.items(), key=lambda x: (-x[1], x[0])):
        start = arc << (64 - bin_bits)
        walk = [s for p, s in sorted(points) if p >= start] + [s for p, s in sorted(points) if p < start]
        found[arc, piece] = next((s for s in walk if held[s] + load <= room[s]), min(held, key=lambda s: (held[s], s)))
        held[found[arc, piece]] += load
    return found


def test_ring_against_a_walk_and_its_movement():
    rng = random.Random(3)
    loads = {(rng.randrange(1 << 16), 0): rng.randrange(1, 500) for _ in range(300)}
    for shards, slack in ((1, 0.002), (8, 0.002), (9, 0.5)):
        assert ring.place(loads, shards, 16, slack, 16) == brute_place(loads, shards, 16, slack, 16)
    load = {(arc, 0): 100 + arc % 7 for arc in range(0, 65536, 2)}
    a, b = ring.place(load, 8, 512, 0.002, 16), ring.place(load, 9, 512, 0.002, 16)
    assert sum(a[x] != b[x] for x in a) / len(a) < 0.2


def test_bloom_model(spark):
    texts = odd_texts()
    docs = table(spark, texts)
    train = F.coalesce(F.col("doc_id"), F.lit(0)) % 4 != 0
    got = ngram_lm.score_documents(docs, train).collect()
    token = lambda t: [*(t or "").encode().lower().split(), None]
    counts, n = {}, 0
    for i, t in texts:
        if (0 if i is None or i < 0 else i) % 4 != 0:
            for w in token(t):
                counts[w] = counts.get(w, 0) + 1
                n += 1
    want = []
    for _, t in texts:
        c = [counts.get(w, 0) for w in token(t)]
        want.append((len(c), sum(x > 0 for x in c), sum(np.log10((x + 0.1) / (n + 0.1 * (len(counts) + 1))) for x in c)))
    have = sorted((r["n_tokens"], r["n_known"], r["base_score"]) for r in got)
    assert [h[:2] for h in have] == [w[:2] for w in sorted(want)] and np.allclose([h[2] for h in have], [w[2] for w in sorted(want)])
    assert {r["train_tokens"] for r in got} == {n} and all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert ngram_lm.score_documents(docs, F.lit(False)).where("n_known > 0").count() == 0


def test_quality_and_language_edges(spark):
    docs = table(spark, odd_texts())
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(41, None), (999, 1)], "doc_id long, quality int")
    model = quality.learn(docs, labels, F.lit(True))
    got = quality.score_documents(docs, model, F.col("doc_id")).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality.score_documents(docs, quality.learn(docs, labels.limit(0), F.lit(True)), F.col("doc_id")).collect()} == {0.5}
    told = docs.withColumn("lang", F.when(F.col("doc_id") < 40, F.when(F.col("text").contains("der"), "de").otherwise("en")))
    found = langid.identify(told, langid.learn(told, F.lit(True)), F.col("doc_id"), F.col("text").alias("t")).collect()
    assert all((r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", r["t"] or "")) and 0 <= r["score"] <= 1 for r in found)
    assert {r["lang_pred"] for r in langid.identify(docs, langid.learn(docs, F.lit(True)), F.col("doc_id")).collect()} == {"und"}


@needs_data
def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    r = queries.op9_bitmask_langid(spark, sf).join(lang, "doc_id").where("held_out and lang_pred <> 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert r > 0.95
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = queries.op8_attention_quality(spark, sf).join(labels, "doc_id").where("held_out").select("score", "quality").collect()
    good, bad = ([x["score"] for x in rows if x["quality"] == q] for q in (1, 0))
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.8


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(name, spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = queries.QUERIES[name](spark, str(DATA))
    got, found = sorted(map(str, (tuple(r) for r in df.collect()))), con.sql(queries.ORACLE[name])
    assert df.columns == found.columns and got == sorted(map(str, found.fetchall()))


def test_many_languages_rare_ones_and_an_empty_table(spark):
    rng = random.Random(9)
    speech = {f"l{i:02}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9))) for _ in range(40)] for i in range(70)}
    rows = [(f"{lang} {j}", " ".join(rng.choices(words, k=60)), lang) for lang, words in speech.items() for j in range(300 if lang == "l00" else 3)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    model = langid.learn(docs, F.lit(True), train_rows=700)
    assert len(model.languages) == 70 and len(model.filters) == 2
    got = langid.identify(docs, model, F.col("lang").alias("lang_own")).collect()
    assert np.mean([r["lang_own"] == r["lang_pred"] for r in got]) > 0.97
    empty = docs.limit(0)
    assert langid.identify(empty, langid.learn(empty, F.lit(True)), F.col("doc_id")).count() == 0
    assert langid.identified_only(empty, model).count() == 0


def test_language_filters_against_sets(spark):
    """Popcounts of the bit-sliced filters against plain sets of n-grams."""
    docs = spark.createDataFrame([(1, "der hund und die katze " * 9, "de"), (2, "the dog and the cat " * 9, "en")], "doc_id long, text string, lang string")
    model = langid.learn(docs, F.lit(True))
    own = {r["lang"]: set(langid.grams(langid.prepared(r["text"])).tolist()) for r in docs.collect()}
    for text in ("die katze", "the dog", "und the"):
        g = langid.grams(langid.prepared(text) + b"    ")[: len(langid.prepared(text))].tolist()
        hits = np.array([sum(x in own[lang] for x in g) for lang in model.languages])
        best, score = model.scores([langid.prepared(text)])
        assert hits[best[0]] == hits.max() and abs(score[0] - hits.max() / hits.sum()) < 0.05


def brute_forward(model, text):
    """One bag, passage by passage, without vectors of bags."""
    words = list(quality.WORDS.finditer(text))
    starts = [w.start() for w in words[:: quality.PASSAGE]] or [0]
    cuts = [0, *starts[1:], len(text)]
    p, weights, hidden = model.p, [], []
    x, _ = quality.encode([text])
    assert len(x) == len(starts) == len(cuts) - 1
    for row in x:
        z = np.clip((row - model.mean) / model.scale, -8, 8)
        h = np.tanh(z @ p["E"] + p["e"])
        gate = sum(np.tanh(h @ p["V"][:, k]) / (1 + np.exp(-(h @ p["U"][:, k]))) * p["w"][k] for k in range(quality.GATE))
        weights.append(np.exp(gate))
        hidden.append(h)
    r = sum(w * h for w, h in zip(weights, hidden, strict=True)) / sum(weights)
    return 1 / (1 + np.exp(-(r @ p["c"] + p["b"][0])))


def test_attention_against_a_plain_forward_pass(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["good", "text,", "BAD", "12", "é", "word"], k=n)).encode() for n in (1, 39, 40, 41, 400)] + [b""]
    x, bags = quality.encode(texts)
    model = quality.Mil(x.mean(0), np.maximum(x.std(0), 1e-3))
    model.fit(x, bags, np.array([0, 1, 0, 1, 0, 1]), epochs=3)
    score, _ = model.scores(texts)
    assert np.allclose(score, [brute_forward(model, t) for t in texts])
    long = b" ".join(rng.choices([b"good", b"text,", b"BAD"], k=3 * quality.PIECE + 77))
    assert sum(len(t) for t in quality.pieces(long)) == len(long)
    x, bags = zip(*[quality.encode([t]) for t in quality.pieces(long)], strict=True)
    whole = model.forward(np.concatenate(x), np.array([sum(int(b[0]) for b in bags)]))["y"][0]
    assert abs(model.scores([long])[0][0] - whole) < 1e-9
    empty = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score_documents(empty, quality.learn(empty, labels, F.lit(True)), F.col("doc_id")).count() == 0


def rewrapped(text, width):
    import textwrap

    return "\n\n".join("\n".join(textwrap.wrap(p, width, break_long_words=False, break_on_hyphens=False)) for p in text.split("\n\n"))


def test_known_licences_however_they_are_wrapped(spark):
    long = [(i, t) for i, t in KNOWN if len(t) > 300]
    rows = [(f"{i} {w}", "Copyright (c) 2020 Some Body\n\n" + rewrapped(t, w), i) for i, t in long for w in range(50, 101)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, own string")
    own = docs.select("doc_id", "own")
    assert licenses.scan_licenses(docs).join(own, "doc_id").where("not license <=> own").count() == 0


def test_long_licences_by_digest_and_other_tables_of_known_texts(spark):
    folder = Path("/usr/share/common-licenses")
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "MPL-2.0": "MPL-2.0"}
    here = [(i, (folder / f).read_text()) for f, i in files.items() if (folder / f).exists()]
    docs = spark.createDataFrame([*here, ("x", "My own terms"), ("x", "My own terms"), (None, "a\nMy  OWN terms!\nb\nmy own terms")], "doc_id string, text string")
    got = licenses.scan_licenses(docs).collect()
    assert all(r["license"] == r["doc_id"] for r in got if r["doc_id"] not in ("x", None))
    for known in ([("own", "my own terms")], spark.createDataFrame([("own", "my own terms"), ("none", None)], "license string, known string")):
        for size in (0, 1 << 20):
            got = sorted((r["doc_id"] or "", r["license"], r["n_notices"], r["notice_licenses"]) for r in licenses.scan_licenses(docs.where("doc_id = 'x' or doc_id is null"), known, size).collect())
            assert got == [("", None, 2, "own"), ("x", "own", 1, "own"), ("x", "own", 1, "own")]
    assert licenses.scan_licenses(docs, []).where("license is not null or n_notices > 0").count() == 0
