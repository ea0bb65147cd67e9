import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from brickline.llm import rans, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [1, 2, 127, 128, 5000, 700_000])
def test_rans_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 49_000).astype(np.uint32)
    counts = np.bincount(ids)
    table = rans.Table(rans.frequencies({int(i): int(counts[i]) for i in np.flatnonzero(counts)}))
    block = rans.encode(ids, table)
    assert np.array_equal(rans.decode(block, table), ids)
    lanes, marks = rans.lanes_for(n), -(-(-(-n // rans.lanes_for(n))) // rans.EVERY)
    last = rans.segment(block, table, marks - 1)
    assert np.array_equal(last, ids[(marks - 1) * rans.EVERY * lanes :])
    broken = bytearray(block)
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        rans.decode(bytes(broken), table)


def test_frequencies_sum_up():
    for counts in ({5: 1}, {i: 1 for i in range(49_000)}, {0: 10**12, **{i: 1 for i in range(1, 40_000)}}):
        freq = rans.frequencies(counts)
        assert sum(freq.values()) == 1 << rans.SCALE and min(freq.values()) >= 1


def test_against_the_library(spark):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    bits = ["Hello", "WORLD", "it's", "naïve", "J̌", "<|endoftext|>", "a<|startoftext|>b", " ", "12,5", "ÉCOLE", "\n", "\t", "日本", "x" * 300, "́y", "%%%", "<|ENDOFTEXT|>"]
    texts = [None, "", " \n ", "word " * 50_000] + [" ".join(rng.choices(bits, k=rng.randrange(1, 60))) for _ in range(200)]
    rows = [(i if i % 50 else None, t, "s", 3) for i, t in enumerate(texts)] + [(7, "same", "s", 3)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, part int")
    got = tokens.read_tokens(spark, tokens.write_tokens(docs, PATH)).collect()
    own = Tokenizer.from_file(PATH)
    want = sorted((i if i is not None else -1, tuple(own.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t, *_ in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == want
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] or -1 for r in got] == sorted(r["doc_id"] or -1 for r in got)
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(r["ids"])
        at += r["n_tokens"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.read_tokens(spark, tokens.write_tokens(docs, PATH)).count() == 0


def test_stored_order_and_a_reader_that_has_the_files_only(spark, tmp_path):
    rows = [(i % 7, f"w{i} tail {i}") for i in range(500)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.option("maxRecordsPerFile", 40).parquet(path)
    docs = spark.read.parquet(path)
    folder = tokens.write_tokens(docs, PATH, order="stored")
    got = sorted(tokens.read_tokens(spark, folder).collect(), key=lambda r: r["start"])
    as_stored = docs.select("doc_id", "text", "_metadata.file_name", "_metadata.row_index").collect()
    as_stored.sort(key=lambda r: (r["file_name"], r["row_index"]))
    own = tokens.cache(PATH).tokenizer
    at = 0
    for r, d in zip(got, as_stored, strict=True):
        ids = [*own.encode(d["text"], add_special_tokens=False).ids, 1]
        assert (r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) == (d["doc_id"], at, ids)
        at += len(ids)
    freq = spark.read.parquet(f"{folder}/table").collect()
    assert sum(r["freq"] for r in freq) == 1 << rans.SCALE and len({r["table_crc32"] for r in freq}) == 1
