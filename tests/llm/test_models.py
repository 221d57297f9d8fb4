"""Quality, toxicity and language model: held-out accuracy, defined cases, exact bases."""

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from maskloom.llm import language_model, quality, toxicity

SF = "/root/testdata/sf0.1"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = y.sum()
    return (rank[y].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize("module, label, mod, rest", [(quality, "quality", 5, 0), (toxicity, "toxic", 3, 1)])
def test_held_out(spark, module, label, mod, rest):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = module.digest(docs, labels).collect()
    assert len(out) == docs.count()
    y = {r.doc_id: r[label] for r in labels.collect()}
    for r in out[:200]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest)
    held = [r for r in out if r.held_out and r.doc_id in y]
    s, t = np.array([r.score for r in held]), np.array([y[r.doc_id] == 1 for r in held])
    p = np.array([r.predicted == 1 for r in held])
    print(label, "auc", auc(s, t), "accuracy", (p == t).mean(), "n", len(held), "brier", ((s - t) ** 2).mean())
    assert auc(s, t) > 0.97 and (p == t).mean() > 0.95
    assert all(0 <= r.score <= 1 for r in out)


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_defined_cases(spark, module, label):
    docs = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "you idiot " * 20000, "q"), (3, "fine words here", "q"), (4, "!!! ### 12", "q")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (3, 1), (9, 1), (None, 1), (4, None)], f"doc_id long, {label} int")
    assert len(module.digest(docs, labels).collect()) == 5
    assert len(module.digest(docs, labels.limit(0)).collect()) == 5
    assert module.digest(docs.limit(0), labels).collect() == []


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [""]


def test_base_is_exact_and_the_model_is_better(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.collect()
    counts = {}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            for w in tokens(r.text):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for limit in (100_000, 500):
        held = language_model.crc_mod("doc_id", 7) == 2
        got = {r.doc_id: r for r in language_model.score(docs, docs.where(~held), vocabulary=limit).collect()}
        assert len(got) == len(rows)
        better = total = 0.0
        for r in rows:
            own, g = tokens(r.text), got[r.doc_id]
            base = sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in own)
            assert (g.n_tokens, g.n_known, g.train_tokens) == (len(own), sum(w in counts for w in own), n)
            assert math.isclose(g.base_score, base, rel_tol=1e-9)
            assert g.score < 0
            if zlib.crc32(str(r.doc_id).encode()) % 7 == 2:
                better += (g.score - g.base_score)
                total += len(own)
        print("gain a token", limit, better / total)
        assert better > 0


def test_the_model_is_a_distribution():
    m = language_model.ClassModel(64)
    m.w = np.random.default_rng(0).standard_normal(m.w.shape).astype(np.float32)
    p = np.exp(m.log_p(m.features(np.arange(0, 193 * 193, 97))))
    assert np.allclose(p.sum(1), 1, atol=1e-4)


def test_all_words_sum_up_to_one():
    """In any context the vocabulary, the words outside that were seen, and the one unseen event share the whole probability."""
    lm, rng = language_model, np.random.default_rng(3)
    outside = {f"o{i}".encode(): int(c) for i, c in enumerate(rng.integers(1, 4, 300))}
    counts = {f"w{i}{'abcdefgh'[i % 8]}".encode(): int(5000 / (i + 1)) + 2 for i in range(3000)} | {b"": 900}
    known = lm.Vocabulary(counts)
    total = np.ones(lm.SUFFIXES)
    spelt = pa.array(list(outside), pa.binary())
    np.add.at(total, lm.suffixes(spelt), np.array(list(outside.values())) + 1.0)
    classes, words = lm.ClassModel(64), lm.WordModel(known.bias, 256)
    classes.w, words.w = rng.standard_normal(classes.w.shape).astype(np.float32), rng.standard_normal(words.w.shape).astype(np.float32)
    for one, two in ((3, 900), (2999, 0), (17, 17)):
        class_one, class_two = known.classes[one], known.classes[two]
        p_class = np.exp(classes.log_p(classes.features(np.array([class_two * (lm.CLASSES + 1) + class_one])))[0].astype(float))
        # Each vocabulary word after the words numbered `two` and `one`: as a text of three words.
        every = np.arange(len(counts))
        text = np.stack([np.full(len(every), two), np.full(len(every), one), every], 1).ravel()
        per = np.full(len(every), 3)
        place, context, slot = lm.word_events(known, np.arange(len(counts)), known.classes, text, per, 256)
        ln = np.zeros(len(text) + len(per))
        ln[place] = words.chosen(context, slot)
        third = ln[np.arange(len(every)) * 4 + 2] / np.log(10) + known.within
        inside = (p_class[known.classes] * 10**third).sum()
        out = p_class[lm.SINGLE + lm.SUFFIXES + lm.suffixes(spelt)] * (np.array(list(outside.values())) + 1) / total[lm.suffixes(spelt)]
        unseen = (p_class[lm.SINGLE + lm.SUFFIXES :] / total).sum()
        empty = [c for c in range(lm.SINGLE, lm.SINGLE + lm.SUFFIXES) if not (known.classes == c).any()]
        assert abs(inside + out.sum() + unseen + p_class[empty].sum() - 1) < 1e-4


def test_word_softmax_learns_and_gradient_is_right():
    """Steps raise the likelihood, towards the shares that follow a word."""
    lm, rng = language_model, np.random.default_rng(5)
    bias = np.full((lm.SUFFIXES, lm.SLOTS), -1e4, np.float32)
    bias[:, :8] = np.log(1 / 8)
    m = lm.WordModel(bias, 256)
    context = rng.integers(0, 6, 4000) | rng.integers(0, 6, 4000) << 16 | rng.integers(0, 3, 4000) << 32
    slot = np.where(rng.random(4000) < 0.8, context & 0xFFFF, rng.integers(0, 8, 4000))
    events, n = np.unique(context | slot << 40, return_counts=True)
    loss = lambda: -(m.chosen(events & 0xFFFFFFFFFF, events >> 40) * n).sum() / n.sum()
    first = loss()
    m.steps(events, n, 20)
    assert abs(first - np.log(8)) < 1e-3 and loss() < 1.2
    p = np.exp(m.log_p(np.arange(6) | 3 << 16 | 1 << 32))
    assert (p.argmax(1) == np.arange(6)).all() and np.allclose(p.sum(1), 1, atol=1e-4)


def test_counts_of_classes_and_words_come_from_one_pass(spark):
    """Both counts equal a walk over the tokens; the texts are cut into words once."""
    lm = language_model
    texts = ["a b a c", "b a  a", None, "c zz b a"] * 3
    known = lm.Vocabulary({f"w{i}".encode(): 900 - i for i in range(200)} | {b"": 12, b"a": 3, b"b": 3, b"c": 2})
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    out = lm.statistics(df, known, 256)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    cells, events = {}, {}
    for t in texts:
        words = tokens(t)
        at, classes = known.find(pa.array([w.encode() for w in words], pa.binary()))
        for i, c in enumerate(classes):
            one, two = classes[i - 1] if i else lm.BEGIN, classes[i - 2] if i > 1 else lm.BEGIN
            cell = (two * (lm.CLASSES + 1) + one) * lm.CLASSES + c
            cells[-1 - cell] = cells.get(-1 - cell, 0) + 1
        own = [w.encode() for w in words[:-1]]
        if own:
            at, classes = known.find(pa.array(own, pa.binary()))
            _, context, slot = lm.word_events(known, at, classes, np.arange(len(own)), np.array([len(own)]), 256)
            for e in (context | slot << 40).tolist():
                events[e] = events.get(e, 0) + 1
    assert events and {r.event: r.n for r in out.collect()} == cells | events


def test_rows_are_summed_by_stretches():
    rng = np.random.default_rng(2)
    n = np.r_[1, 2, 8, 9, 300, 1, 7, 1]
    rows, first = rng.random((n.sum(), 5)), np.cumsum(n) - n
    assert np.allclose(language_model.summed_rows(rows, first), np.add.reduceat(rows, first, axis=0), rtol=1e-12)
    assert language_model.summed_rows(rows[:0], first[:0]).shape == (0, 5)


def test_the_same_model_from_any_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = language_model.crc_mod("doc_id", 7) == 2
    got = []
    for parts, shuffles in ((4, "3"), (16, "11")):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        d = docs.repartition(parts)
        got.append({r.doc_id: r.score for r in language_model.score(d, d.where(~held)).collect()})
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0].keys() == got[1].keys() and all(math.isclose(s, got[1][i], rel_tol=1e-6) for i, s in got[0].items())


def test_language_model_defined_cases(spark):
    docs = spark.createDataFrame([(0, None, "a"), (1, " \t ", "a"), (2, "A b\x0bÉ  b", "a"), (2, "A b\x0bÉ  b", "a"), (3, "w" * 9000 + " x" * 9000, "a")], "doc_id long, text string, word string")
    got = sorted(language_model.digest(docs).collect(), key=lambda r: (r.doc_id, r.n_tokens))
    assert [r.n_tokens for r in got] == [1, 1, 5, 5, 9002]
    assert language_model.digest(docs.limit(0)).collect() == []
    none = language_model.score(docs, docs.limit(0)).collect()
    assert all(r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 and r.score <= 0 for r in none)


def test_features_know_other_scripts():
    """Letters of any script are letters; what an encoding lacks is not a mark."""
    f = dict(zip(quality.NAMES, quality.features("Съешь же ещё этих мягких французских булок, да выпей чаю.")))
    assert f["letters"] > 0.75 and 0 < f["upper"] < 0.1 and f["marks"] < 0.1 and f["symbols"] == 0
    g = dict(zip(quality.NAMES, quality.features("日本語の文章です。これは「例」です。")))
    assert g["letters"] > 0.7 and 0 < g["marks"] < 0.3
    a, b = quality.features("Plain words, of one line."), quality.features("Plain words, of one line\u2026")
    assert abs(a - b)[:6].max() < 0.1
