"""The pipeline on a small table, stage by stage against plain Python."""

import re
import zlib
from pathlib import Path

import pytest

import corpus_pipeline
from tests.llm.test_similarity import brute_kept

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text) if w]


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    junk = spark.createDataFrame([(10**6, "12 34 --", "en", "src0", 8), (10**6 + 1, None, "en", "src0", 0)], docs.schema)
    docs = docs.unionByName(junk).unionByName(docs.limit(3))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs.collect())
        if name != "token_ids":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    before, after = seen["language_id"]
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == {10**6, 10**6 + 1}

    before, after = seen["near_dedup"]
    before.sort(key=lambda r: r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == [before[i]["doc_id"] for i in brute_kept([r["text"] for r in before])]

    before, after = seen["decontamination"]
    items = [words(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    banned = {tuple(w[i : i + 10]) for w in items if w for i in range(max(1, len(w) - 9))}

    def hit(text):
        w = words(text)
        return any(tuple(w[i : i + n]) in banned for n in {len(b) for b in banned} for i in range(len(w) - n + 1))

    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if not hit(r["text"]))

    before, after = seen["mix"]
    size = lambda t: len((t or "").encode().split())
    sources = sorted({r["source"] for r in before})
    total = {s: sum(size(r["text"]) for r in before if r["source"] == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    left, goal, open_ = 1.5 * sum(total.values()), {}, set(sources)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * total[s] <= level * weight[s]}
        for s in full or open_:
            goal[s] = min(2 * total[s], level * weight[s])
        left -= sum(goal[s] for s in full)
        open_ = open_ - full if full else set()
    for s in sources:
        took = sum(size(r["text"]) for r in after if r["source"] == s)
        assert abs(took - goal[s]) <= max(size(r["text"]) for r in before if r["source"] == s)

    before, after = seen["token_ids"]
    from tokenizers import Tokenizer

    from brickline.llm.queries import tokenizer_path

    own = Tokenizer.from_file(tokenizer_path())
    ids = [(r["doc_id"], [*own.encode(r["text"] or "", add_special_tokens=False).ids, 1]) for r in before]
    want = sorted((i, len(x), zlib.crc32(b"".join(n.to_bytes(4, "little") for n in x))) for i, x in ids)
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in after) == want


def test_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0


def test_stages_carry_columns_of_any_name(spark, tmp_path):
    rows = [(i, f"word{i} " * 12 + "the same end of all these texts", "en", "s", 9) for i in (1, 2, 2, 3, 4)] + [(None, "word9 " * 12, "en", None, 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ["k_id", "K_hash", "i", "h", "_metadata", "row", "count", "a.b", "as_text", "part", "file", "at", "node", "root"]
    docs = docs.selectExpr("*", *[f"{j} as `{n}`" for j, n in enumerate(names)])
    stages = dict(corpus_pipeline.STAGES)
    for name, n in (("near_dedup", 5), ("decontamination", 5), ("mix", None), ("token_ids", None)):
        out = stages[name](spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        assert n is None or docs.count() == n
        assert name == "token_ids" or docs.columns == before.columns
    assert docs.count() > 0
