"""Rank-order language ID: defined cases, a brute-force distance and held-out accuracy."""

from collections import Counter

import numpy as np

from maskloom.llm import language

SF = "/root/testdata/sf0.01"


def test_ranked_counts_like_strings():
    text = "Été à la mer, la mer!"
    plain = Counter()
    for w in ("été", "à", "la", "mer", "la", "mer"):
        p = f" {w} "
        for n in (1, 2, 3):
            plain.update(g for g in (p[i : i + n] for i in range(len(p) - n + 1)) if g != " ")
    g, n = language.counted(text)
    assert sorted(n.tolist()) == sorted(plain.values())
    order = language.ranked(text, 10**6)
    assert len(order) == len(plain) and len(set(order.tolist())) == len(plain)
    assert list(language.ranked(text, 5)) == list(order[:5])


def test_distance_and_defined_cases(spark):
    rows = [(1, "the cat sat on the mat " * 20, "en"), (2, "le chat est sur la table " * 20, "fr"), (3, None, "en"), (4, "123 !!", None), (5, "", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language.learn(docs, profile_size=30)
    assert set(profiles) == {"en", "fr"} or set(profiles) == {"en", "fr", None} - {None}
    got = {r.doc_id: r for r in language.predict(docs, profiles, ["doc_id", "lang"]).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5)] == ["en", "fr", "und", "und", "und"]
    mine, fr = language.ranked(rows[0][1], 30), [np.uint32(x) for x in profiles["fr"]]
    want = sum(abs(fr.index(x) - i) if x in fr else 30 for i, x in enumerate(mine)) / (30 * len(mine))
    en = sum(abs(i - j) for i, x in enumerate(mine) for j, y in enumerate(profiles["en"]) if x == y)
    assert np.isclose(got[1].distance, en / (30 * len(mine))) and got[1].distance < want
    assert {r.lang_pred for r in language.predict(docs, {}, ["doc_id"]).collect()} == {"und"}
    assert language.digest(docs.limit(0)).collect() == []


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.digest(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 100 and np.mean([r.lang_pred == r.lang for r in got]) > 0.95


def test_unusual_rows(spark):
    """Very long texts, repeated rows, and columns with the results' names."""
    rows = [(i, "the house of the old man and his dog " * 3, "en", "p", 9.0) for i in range(6)] + [(i, "la casa del viejo hombre y su perro " * 3, "es", "p", 9.0) for i in range(6, 12)]
    docs = spark.createDataFrame(rows + [(20, "the man and the dog " * 50_000, None, "p", 9.0), (21, "del perro y la casa", None, "p", 9.0), (21, "del perro y la casa", None, "p", 9.0)], "doc_id long, text string, lang string, lang_pred string, score double")
    out = language.predict(docs, language.learn(docs), docs.columns)
    assert sorted(out.columns) == ["distance", "doc_id", "lang", "lang_pred", "score", "text"]
    got = [(r.doc_id, r.lang_pred, r.lang) for r in out.where("doc_id >= 20").orderBy("doc_id").collect()]
    assert got == [(20, "en", None), (21, "es", None), (21, "es", None)]
    assert len(language.digest(docs).collect()) == 15
