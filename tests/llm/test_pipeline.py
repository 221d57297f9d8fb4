"""The pipeline on a small fixture: what must go goes, clean documents stay, all kept ids are packed."""

import random

import numpy as np
import pytest

import corpus_pipeline
from maskloom.llm.token_ids import tokenizer_path


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(5)
    en, fr = "the of and to in that with for was shth".split(), "le la de et que dans pour est ouch éaux".split()
    prose = lambda words, n: " ".join(rng.choice(words) + rng.choice(["", "s", "er", "ing"]) for _ in range(n)).capitalize() + "."
    docs = [(i, prose(en if i % 2 else fr, 120), "en" if i % 2 else "fr") for i in range(40)]
    item = prose(en, 30)
    docs += [(100, docs[3][1], "en"), (101, docs[5][1].upper(), "en"), (102, docs[7][1] + " more", "en")]
    docs += [(110, prose(en, 50) + " " + item + " " + prose(en, 50), "en"), (111, prose(fr, 60) + " " + item.replace("e", "a", 3), "fr")]
    # Contaminated rows of a null key and of a key that a clean row has as well.
    docs += [(None, prose(en, 40) + " " + item + " " + prose(en, 40), "en"), (9, prose(en, 45) + " " + item + " " + prose(en, 35), "en")]
    docs += [(140, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(80)), None), (141, "Съешь ещё этих мягких булок", "ru?")]
    docs += [(120, prose(en, 60) + " password = hunter2hunter2x " + prose(en, 10), None), (130, None, "en"), (131, "12 34 !!", "en"), (132, "", None)]
    spark.createDataFrame([(i, t, None if lang == "ru?" else lang, "s", len(t or "")) for i, t, lang in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), docs


def test_pipeline(spark, folder):
    from tokenizers import Tokenizer

    path, docs = folder
    out = corpus_pipeline.run(spark, path).collect()
    kept = {r.doc_id for r in out}
    assert kept == set(range(40)) | {120}
    texts = {i: t for i, t, _ in reversed(docs)}
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    for i in kept:
        ids = [x for r in sorted((r for r in out if r.doc_id == i), key=lambda r: r.start) for x in np.frombuffer(bytes(r.ids), "<u4").tolist()]
        want = texts[i] if i != 120 else texts[i].replace("password = hunter2hunter2x", "[assign]")
        assert ids == t.encode(want, add_special_tokens=False).ids + [0]


def test_stages_keep_the_columns(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        assert stage(spark, docs.limit(0), path).collect() == [], name


def test_unusual_tables_end_to_end(spark, tmp_path):
    """Very long texts, repeated and null keys, columns with the names that stages use, and the empty table."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long, run = prose(60_000), "q9Zr7Lm2Xc4Vb8Nw1Ks6" * 500
    rows = [(i, prose(100)) for i in range(20)] + [(1, "%s"), (30, long), (31, long + " more"), (32, prose(50) + " " + run + " " + prose(50)), (None, prose(90)), (None, prose(90))]
    rows[20] = (1, prose(100))  # another text of the same key
    rows += [rows[0], rows[0]]
    clash = "doc_id long, text string, lang string, source string, n_chars long, spans string, distance double, __row long, label string, rep long, start int"
    spark.createDataFrame([(i, t, "en", "s", len(t), "x", 0.5, 7, "l", 3, 1) for i, t in rows], clash).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose(30)), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    whole = {}
    for r in out:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
    assert set(whole) == {*range(20), 30, 32, None}
    first = [r for r in out if r.doc_id == 1]
    assert len({r.doc_tokens for r in first}) <= 2 and whole[1] > 1.5 * whole[2]
    assert whole[32] < 600 and whole[30] > 60_000
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:  # columns that are no documents' own keep their names, types and values
        got = stage(spark, docs, str(tmp_path))
        assert got.dtypes == docs.dtypes, name
        assert {tuple(r)[5:] for r in got.collect()} == {("x", 0.5, 7, "l", 3, 1)}, name
    spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
