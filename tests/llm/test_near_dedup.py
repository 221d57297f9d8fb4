"""Near-duplicate classes against brute force over all pairs."""

import random

import numpy as np
import pyarrow as pa

from maskloom.llm import near_dedup as nd
from maskloom.llm.words import hashed_words


def brute(rows, log_weights, least=0.8):
    keys = sorted({i for i, _ in rows})
    text = {i: max(t or "" for k, t in rows if k == i) for i in keys}
    vec = {}
    for i in keys:
        s, n = nd._distinct(nd.shingles(next(hashed_words(pa.array([text[i]])))))
        vec[i] = dict(zip(s.tolist(), (n * np.exp(log_weights[s & np.uint32(nd.CELLS - 1)])).tolist()))
    parent = {i: i for i in keys}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for x in range(len(keys)):
        for y in range(x + 1, len(keys)):
            a, b = vec[keys[x]], vec[keys[y]]
            if a and b:
                both = sum(min(w, b[s]) for s, w in a.items() if s in b)
                if both / (sum(a.values()) + sum(b.values()) - both) >= least:
                    i, j = root(keys[x]), root(keys[y])
                    parent[max(i, j)] = min(i, j)
    return {i: root(i) for i in keys}


def corpus(seed=1, groups=6, copies=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, i = [], 0
    for g in range(groups):
        base = [word() for _ in range(150)]
        for _ in range(copies if g == 0 else 4):
            t = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                t[rng.randrange(len(t))] = word()
            rows.append((i, " ".join(t)))
            i += 1
    rows += [(i + k, " ".join(word() for _ in range(80))) for k in range(30)]
    rows += [(900, None), (901, ""), (902, "!! ..."), (903, "two words"), (904, "Two, WORDS!"), (905, "word " * 30000), (906, "word " * 30001), (3, rows[3][1])]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, class_id int, rep string").repartition(4)


def weights(spark, df):
    return nd.weight_table(nd.document_frequencies(df), df.count())


def check(spark, rows, **kw):
    df = frame(spark, rows)
    got = {r.doc_id: r.class_id for r in nd.classes(df, **kw).collect()}
    want = brute(rows, weights(spark, df))
    assert set(got) == set(want)
    agree = np.mean([got[i] == want[i] for i in want])
    # Every class found is part of a true one, and few links are missed.
    true = {}
    for i, c in got.items():
        assert true.setdefault(c, want[i]) == want[i]
    return agree


def test_classes_match_brute_force(spark):
    assert check(spark, corpus()) >= 0.99


def test_split_buckets_match_brute_force(spark):
    assert check(spark, corpus(2, groups=3, copies=90), chunk=8, hubs=2) >= 0.99


def test_defined_cases(spark):
    df = frame(spark, [(1, None), (2, ""), (5, "a b c"), (3, "A B, C"), (None, "a b c")])
    assert {r.doc_id: r.class_id for r in nd.classes(df).collect()} == {1: 1, 2: 2, 3: 3, 5: 3}
    assert nd.classes(df.limit(0)).collect() == []
    assert [(r.doc_id, r.text) for r in nd.unique_rows(df).orderBy("doc_id").collect()] == [(1, None), (2, ""), (3, "A B, C")]


def test_samples_agree_as_often_as_the_similarity():
    rng = np.random.default_rng(0)
    s = np.sort(rng.choice(1 << 31, 400, replace=False).astype(np.uint32))
    w = rng.uniform(0, 1.5, 400).astype(np.float32)
    seeds = rng.integers(0, 1 << 63, 3000, dtype=np.int64).astype(np.uint64)
    a, b = nd.samples(s[:350], w[:350], seeds), nd.samples(s[50:], w[50:], seeds)
    e = np.exp(w)
    assert abs((a == b).mean() - e[50:350].sum() / e.sum()) < 0.04
    c = nd.samples(s, w + np.float32(np.log(1.25)), seeds)
    assert abs((nd.samples(s, w, seeds) == c).mean() - 0.8) < 0.04


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (103, 102), (7, 7)] + [(200, 200 + k) for k in range(1, 50)]
    got = {r.node: r.label for r in nd.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and all(got[i] == 100 for i in range(100, 104)) and all(got[i] == 200 for i in range(200, 250))


def test_the_stage_keeps_one_row_of_each_class(spark):
    import corpus_pipeline

    rng = random.Random(3)
    prose = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(90))
    a, b, c, d, e = (prose() for _ in range(5))
    rows = [(1, a), (1, a), (1, a), (2, b), (2, c), (3, c.upper()), (None, d), (None, e), (None, e + " x"), (None, a), (4, ""), (4, ""), (None, ""), (None, ""), (5, "!!"), (5, d + " y")]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = sorted(((r.doc_id or 0, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()))
        kept_e = [t for i, t in got if i == 0 and t]
        assert len(kept_e) == 1 and kept_e[0] in (e, e + " x")
        assert got == sorted([(1, a), (2, b), (2, c), (0, kept_e[0]), (4, ""), (0, ""), (0, ""), (5, "!!"), (5, d + " y")])


def test_a_key_with_several_texts_has_one_of_them(spark):
    rng = random.Random(4)
    prose = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(90))
    for _ in range(2):
        texts = [prose() for _ in range(12)]
        rows = [(i, t) for i, t in enumerate(texts)] + [(i, texts[i] + " x") for i in range(0, 12, 2)] + [(100 + i, f"{texts[i]} y") for i in range(12)] + [(i, prose()) for i in range(12)] + [(50, ""), (50, texts[0])]
        df = frame(spark, rows)
        found = nd.classes(df).collect()
        got = {r.doc_id: r.class_id for r in found}
        assert len(found) == len(got)
        # The text of the greatest hash is the document's: it decides alone.
        import xxhash

        own = {}
        for i, t in rows:
            w = next(hashed_words(pa.array([t])))
            own[i] = max(own.get(i, (b"", "")), (xxhash.xxh128_digest(w.tobytes()) if len(w) else b"", t))
        want = brute([(i, t) for i, (_, t) in own.items()], weights(spark, df))
        assert got == want


def test_frequencies_count_a_family_of_copies_once(spark):
    """A large group of near copies leaves its shingles nearly the weight of rare ones; a line that unrelated documents share loses it."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, line = [word() for _ in range(200)], [word() for _ in range(12)]
    rows = []
    for i in range(600):
        t = list(base)
        t[rng.randrange(200)] = word()
        rows.append((i, " ".join(t)))
    rows += [(1000 + i, " ".join([word() for _ in range(60)] + line + [word() for _ in range(60)])) for i in range(600)]
    df = frame(spark, rows)
    counts = nd.document_frequencies(df)
    hashes = lambda words: nd.shingles(next(hashed_words(pa.array([" ".join(words)])))) & np.uint32(nd.CELLS - 1)
    assert np.median(counts[hashes(base)]) < 60  # of 600 copies
    assert 350 < np.median(counts[hashes(line)]) < 1000  # of 600 unrelated documents
    assert np.median(counts[hashes(rows[900][1].split()[:60])]) < 2
    assert (nd.document_frequencies(df.repartition(11)) == counts).all()
    got = {r.doc_id: r.class_id for r in nd.classes(df).collect()}
    assert {got[i] for i in range(600)} == {0} and all(got[i] == i for i in range(1000, 1600))


def test_recall_of_near_copies(spark):
    """On the given documents: of all pairs at or over the similarity (brute force), at least 0.99 lie in one class, and each class hangs together."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in nd.classes(docs).collect()}
    want = brute_classes(rows, weights(spark, docs.select("doc_id", "text")))
    linked = [(i, j) for i, j in want if got[i] == got[j]]
    print("links", len(want), "found", len(linked))
    assert len(want) > 50 and len(linked) >= 0.99 * len(want)


def brute_classes(rows, log_weights, least=0.8):
    """All pairs of documents whose weighted Jaccard similarity is `least` or more, through the shingles that they share."""
    vec, by_shingle = {}, {}
    for i, t in rows:
        s, n = nd._distinct(nd.shingles(next(hashed_words(pa.array([t])))))
        vec[i] = dict(zip(s.tolist(), (n * np.exp(log_weights[s & np.uint32(nd.CELLS - 1)])).tolist()))
        for x in vec[i]:
            by_shingle.setdefault(x, []).append(i)
    pairs = {(i, j) for own in by_shingle.values() for k, i in enumerate(own) for j in own[k + 1 :]}
    out = []
    for i, j in pairs:
        a, b = vec[i], vec[j]
        both = sum(min(w, b[s]) for s, w in a.items() if s in b)
        if both / (sum(a.values()) + sum(b.values()) - both) >= least:
            out.append((i, j))
    return out
