"""Packing and the token store against brute force with the tokenizers library."""

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from maskloom.llm import packing, token_store
from maskloom.llm.shared import new_path
from maskloom.llm import token_ids
from maskloom.llm.token_ids import IdEncoder, tokenizer_path

TEXTS = [
    "Hello world, it's 10 o'clock.\nNew  line \t tab", "", None, " lead and trail ", "a" * 3000, "x y " * 5000, "\n\n\n", "déjà  vu — ça va?　ok",
    "same text", "same text", "<|endoftext|> literal <|startoftext|>", "é combining ́x", "tab\tsep\r\nwin  ", "a\0b c \0d\ne", "\0", "x\n\ny  z\u00a0w", "one.\nTwo, three; four: five.", "A, b. c", " . , x", "don't   we'll I'm  's 's",
]


@lru_cache
def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    t.encode_special_tokens = True
    return t


def reference_ids(name, text, end):
    return library(name).encode(text or "", add_special_tokens=False).ids + [end]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, start int").repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return docs_of(spark, [(i, t, "extra", 7) for i, t in enumerate(TEXTS)] + [(3, " lead and trail ", "extra", 7)])


def ids_of(encode, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in encode.encode(pa.array(texts, pa.string()))]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("batch", [1, 300, 10**7])
def test_batches_give_the_whole_text_ids(name, batch, monkeypatch):
    monkeypatch.setattr(token_ids, "BATCH", batch)
    assert ids_of(IdEncoder(tokenizer_path(name)), TEXTS) == [reference_ids(name, t, 0)[:-1] for t in TEXTS]


@given(st.lists(st.text(alphabet=st.sampled_from(" \n\t\u00a0\0aZé'.,;:1ǅ-\u0301\u3000"), max_size=30), max_size=6))
@settings(max_examples=150, deadline=None)
def test_any_text(texts):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        assert ids_of(token_ids.encoder(tokenizer_path(name)), texts) == [reference_ids(name, t, 0)[:-1] for t in texts]


def test_memory_of_segments_is_bounded(monkeypatch):
    monkeypatch.setattr(token_ids, "KEEP", 20)
    encode = IdEncoder(tokenizer_path("byte_bpe_50k.json"))
    for k in range(30):
        t = " ".join(f"word{i} plain, end." for i in range(k, k + 9))
        assert ids_of(encode, [t]) == [reference_ids("byte_bpe_50k.json", t, 0)[:-1]]
        assert len(encode.young) + len(encode.old) < 150


def test_pack_is_whole_and_gapless(docs):
    rows = packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), size=64, open_windows=4, min_cut=2).collect()
    want = {i: reference_ids("byte_bpe_50k.json", t, 0) for i, t in enumerate(TEXTS)}
    for i, ids in want.items():
        own = sorted((r.start, r) for r in rows if r.doc_id == i)
        got = [x for _, r in own for x in np.frombuffer(bytes(r.ids), "<u4").tolist()]
        assert sorted(got) == sorted(ids * (2 if i == 3 else 1))
        if i != 3:
            assert got == ids and [s for s, _ in own] == list(np.cumsum([0] + [r.length for _, r in own])[:-1])
        assert {r.doc_tokens for _, r in own} == {len(ids)}
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padding = 0
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
        padding += 0 if at & (at - 1) == 0 else 64 - at
    assert padding <= 0.05 * sum(len(x) for x in want.values())


def test_pack_empty(spark):
    assert packing.digest(packing.pack(docs_of(spark, []), tokenizer_path("byte_bpe_50k.json"))).collect() == []


def test_store_round_trip(spark, docs):
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(None, "no key")], "doc_id long, text string"))
    path = token_store.write_store(more, new_path(spark, "t"), tokenizer_path("word_bpe_49k.json"), block_ids=100, bucket_keys=4)
    keys = token_store.stored_keys(more)
    got = {(r.doc_id, r.occurrence): r for r in token_store.checksums(spark, path, keys).collect()}
    at, order = 0, sorted([(-1, "no key")] + [(i, t or "") for i, t in enumerate(TEXTS)] + [(3, " lead and trail ")])
    seen = {}
    for i, t in order:
        k = (None if i < 0 else i, seen.get(i, 0))
        seen[i] = seen.get(i, 0) + 1
        ids = reference_ids("word_bpe_49k.json", t, 1)
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(order)
    some = spark.createDataFrame([(5, 0), (0, 0), (77, 0), (5, 9)], "doc_id long, occurrence int")
    raw = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in token_store.fetch(spark, path, some).collect()}
    assert raw == {i: reference_ids("word_bpe_49k.json", TEXTS[i], 1) for i in (0, 5)}


def test_store_empty(spark):
    docs = docs_of(spark, [])
    path = token_store.write_store(docs, new_path(spark, "t"), tokenizer_path("word_bpe_49k.json"))
    assert token_store.checksums(spark, path, token_store.stored_keys(docs)).collect() == []


def test_perfect_hash_is_minimal():
    h = token_store._mix(np.arange(5000), np.zeros(5000, int), 0)
    d = token_store.perfect_hash(h)
    assert sorted(token_store._slot(h, d[(h % np.uint64(len(d))).astype(int)], 5000)) == list(range(5000))


def test_leftovers_of_partitions_are_merged(spark):
    """Few short sequences in all, not some for each partition; a null key keeps its pieces."""
    rng = np.random.default_rng(0)
    rows = [(None if i == 5 else i, " ".join(["word"] * int(rng.integers(1, 60)))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    out = packing.pack(df, tokenizer_path("byte_bpe_50k.json"), size=64, open_windows=4, merged=8).collect()
    size = {}
    for r in out:
        size[r.sequence_id] = size.get(r.sequence_id, 0) + r.length
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids))
    short = [n for n in size.values() if n < 64]
    assert sum(n & (n - 1) == 0 for n in short) <= 2 * 6 and max(size.values()) == 64
    assert sum(r.length for r in out if r.doc_id is None) == len(reference_ids("byte_bpe_50k.json", rows[5][1], 0))
    bare = packing.digest(packing.pack(df, tokenizer_path("byte_bpe_50k.json"), size=64, open_windows=4, merged=8, keep_ids=False)).collect()
    assert sorted((r.doc_id or -1, r.start, r.length, r.ids_crc32) for r in bare) == sorted((r.doc_id or -1, r.start, r.length, r.ids_crc32) for r in out)


def test_a_few_keys_read_a_few_files(spark):
    rows = [(i, f"text number {i} of some") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    path = token_store.write_store(df, new_path(spark, "t"), tokenizer_path("word_bpe_49k.json"), block_ids=200, bucket_keys=50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    everything = {name: len(spark.read.parquet(f"{path}/{name}").inputFiles()) for name in ("index", "payload")}
    assert min(everything.values()) >= 6
    one = spark.createDataFrame([(1234, 0)], "doc_id long, occurrence int")
    index = token_store._part(spark, path, "index", token_store._INDEX, "bucket", [r.bucket for r in one.select(token_store._bucket(80)).collect()])
    assert len(index.inputFiles()) == 1
    got = token_store.fetch(spark, path, one)
    assert sum("payload" in f for f in got.inputFiles()) == 1 and not any("/index/" in f for f in got.inputFiles())
    assert [np.frombuffer(bytes(r.ids), "<u4").tolist() for r in got.collect()] == [reference_ids("word_bpe_49k.json", rows[1234][1], 1)]
    some = spark.createDataFrame([(i, 0) for i in range(0, 5000, 7)], "doc_id long, occurrence int")
    few, many = (sorted((r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in token_store.fetch(spark, path, some, direct).collect()) for direct in (token_store.DIRECT, 0))
    assert few == many and len(few) == len(range(0, 4000, 7))
