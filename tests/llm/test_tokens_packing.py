import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import Row
from tokenizers import Tokenizer

from helixframe.llm import packing, token_counts
from helixframe.llm.tokens import ByteCounter, ChunkTable, vocabulary_path

ODD = ["", " ", "\n\n", "a", "a  b \n c", "don't we'll 's", "x  y z", "<|endoftext|>", "pre<|endoftext|> post", " <|startoftext|>Ab<|endoftext|>", "ÉÀß ǅ İstanbul Σίσυφος", "é ́", "日本語 テスト", "😀😀", "12½ ²", "\t\x0b\x0c x\x1cy", "×÷ ª º", "--'s --'ll", "\x85a\x85 b", "word### !!x"]


def sample():
    return pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist() + ODD


def test_counts_equal_the_library():
    path = vocabulary_path("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), ByteCounter(path)
    assert own.fast is not None
    for t in sample():
        assert own.count(t) == len(lib.encode(t, add_special_tokens=False).ids), t[:80]


def test_ids_equal_the_library():
    path = vocabulary_path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), ChunkTable(path, limit=50)
    for t in sample():
        assert np.frombuffer(own.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t[:80]


def test_pack_whole_ids(spark):
    path = vocabulary_path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    texts = [*sample(), None, "w " * 20_000, "same", "same"]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, length="clash", offset=1, cost=None) for i, t in enumerate(texts)], "doc_id long, text string, length string, offset int, cost string")
    rows = packing.pack(docs.coalesce(2), path, block_ids=1 << 16).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    pad = sum(0 if (n := sum(r.length for r in rs)) & (n - 1) == 0 else 2048 - n for rs in by_seq.values())
    assert pad < 0.05 * sum(r.length for r in rows)


def test_placement_balances_cost():
    n = np.random.default_rng(1).integers(1, 2048, 3000)
    pieces, cost, m = packing.place(n, 2048, 32, 1.0, 1 / 4096)
    assert sum(p[2] for p in pieces) == n.sum() and m == len(packing.capacities(int(n.sum()), 2048, 32))
    full = cost[: n.sum() // 2048]
    assert full.std() < 0.12 * full.mean()


def test_pack_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, vocabulary_path("word_bpe_49k.json")).count() == 0


def test_counts_through_cache(spark, tmp_path):
    path, cache = vocabulary_path("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    lib = Tokenizer.from_file(path)
    texts = ["a b", None, "a b", "", "c d e f " * 2000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, digest string")
    want = {i: len(lib.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, path, cache).collect()}
    assert {k: r.n_tokens for k, r in got.items()} == want
    assert got[4].over_limit and not got[0].over_limit and got[4].n_bytes == 16000
    assert spark.read.parquet(cache).count() == 3
    more = spark.createDataFrame([(9, "new one"), (10, "a b")], "doc_id long, text string")
    assert token_counts.count_tokens(more, path, cache).count() == 2
    kept = spark.read.parquet(cache)
    assert kept.count() == 4 and {bytes(r.digest) for r in kept.collect()} >= {hashlib.sha256(b"new one").digest()}
    assert token_counts.count_tokens(docs.limit(0), path, cache).count() == 0


def test_a_later_batch_finds_stored_counts(spark, tmp_path, monkeypatch):
    path, cache = vocabulary_path("byte_bpe_50k.json"), f"file://{tmp_path}/batches"
    lib = Tokenizer.from_file(path)
    texts = [None, "", "a b", "a b", "c " * 100_000] + [f"t{i % 20}" for i in range(80)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "a b", 1)], "doc_id long, text string, n_tokens int")
    encoded = []
    plain = token_counts.encode_misses
    monkeypatch.setattr(token_counts, "encode_misses", lambda misses, *a: (encoded.append(misses.count()), plain(misses, *a))[1])
    rows = token_counts.count_tokens_in_batches(docs, path, cache).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in rows) == sorted((i, len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in [*enumerate(texts), (-1, "a b")])
    # of 23 texts, each was encoded once, most of them in the earlier batch
    assert len(encoded) == 2 and sum(encoded) == 23 == spark.read.parquet(cache).count() and 0 < encoded[1] < 23
    assert token_counts.count_tokens_in_batches(docs.limit(0), path).count() == 0
