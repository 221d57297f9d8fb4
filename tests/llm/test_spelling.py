"""Spelling variants against brute force: counts, near words, forms and roots, with large and with small parts."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from maskloom.llm import spelling
from maskloom.llm.shared import written

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(docs, least=5):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= 6
    return {w: k for w, k in n.items() if k >= least}


def near(v):
    gone, out = defaultdict(set), {w: set() for w in v}
    for w in v:
        for i in range(len(w)):
            gone[i, w[:i] + w[i + 1 :]].add(w)
            if w[:i] + w[i + 1 :] in v:
                out[w].add(w[:i] + w[i + 1 :])
                out[w[:i] + w[i + 1 :]].add(w)
    for ws in gone.values():
        for w in ws:
            out[w] |= ws - {w}
    return out


def brute(v):
    by, form = near(v), {}
    for w, n in v.items():
        if by[w]:
            best = min(by[w], key=lambda x: (-v[x], x))
            if v[best] >= 5 * n:
                form[w] = best
    def root(w):
        while w in form:
            w = form[w]
        return w
    return {w: (form.get(w), root(w), n, len(by[w]), v.get(form.get(w))) for w, n in v.items()}


def told(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("most", [20_000, 3])
def test_query_equals_brute_force(spark, most):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    v = brute_counts([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert told(spelling.variants(written(spelling.counted(docs), "vocabulary"), most=most)) == brute(v) and len(v) > 500


def vocabulary(spark, v):
    return written(spark.createDataFrame(list(v.items()), "word string, n long"), "vocabulary")


def test_dense_words_of_two_letters(spark):
    """All kinds of runs and edits at either end; far more near pairs than any text has."""
    rng = random.Random(3)
    v = {"".join(rng.choice("ab") for _ in range(rng.randint(6, 9))): rng.choice((5, 6, 25, 40, 200, 1000)) for _ in range(500)}
    for most in (20_000, 10):
        assert told(spelling.variants(vocabulary(spark, v), most=most)) == brute(v)


def test_long_chains_and_ties(spark):
    v = {"abcdef" + "x" * i: 5**i for i in range(1, 14)} | {"zzzzzy": 5, "zzzzzx": 25, "zzzzzw": 25, "éééééé": 5, "éééééÿ": 30}
    got = told(spelling.variants(vocabulary(spark, v)))
    assert got == brute(v)
    assert got["abcdefx"][1] == "abcdef" + "x" * 13 and got["zzzzzy"][0] == "zzzzzw"


def test_machine_is_minimal_and_accepts_each_pair_once():
    m = spelling.Machine()
    words = sorted(a + b for a in ("un", "re", "in") for b in ("do", "ed", "es"))
    p = m.acceptor(words)
    assert len(m.arcs) == len({(m.final[s], m.arcs[s]) for s in range(len(m.arcs))}) == 7  # the three beginnings share all that follows
    pairs = m.replaced(p)
    assert len(pairs) == len(set(pairs)) and {frozenset(x) for x in pairs} == {frozenset((u, w)) for u in words for w in words if u < w and sum(a != b for a, b in zip(u, w)) == 1}


def test_parts_are_bounded_and_hold_each_pair_once(spark):
    rng = random.Random(5)
    v = {"prefix" + "".join(rng.choice("abc") for _ in range(rng.randint(2, 4))) + "suffix": 5 for _ in range(400)}
    rows = spelling.parted(vocabulary(spark, v), most=12).collect()
    parts = defaultdict(list)
    for r in rows:
        parts[r["part"]].append(r)
    pairs = []
    for own in parts.values():
        m, a, b = own[0]["m"], own[0]["a"], own[0]["b"]
        assert len(own) <= 12 or m - a - b <= 1
        pairs += [tuple(sorted(x)) for x in spelling.near_pairs([r["word"] for r in own], m, a, b)]
    want = {tuple(sorted((u, w))) for u, ws in near(v).items() for w in ws}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want and want


def test_odd_rows(spark):
    texts = [(None, "Abcdef ABCDEF"), (3, None), (4, ""), (5, "abcdef " * 50_000), (5, "abcdef×÷ ÀBCDEF àBCDEF short"), (6, "ÿabcde" * 1), (7, "z" * 200_000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, n int")
    assert {r["word"]: r["n"] for r in spelling.counted(df, least=1).collect()} == brute_counts(texts, 1)
    assert told(spelling.digest(df)) == brute(brute_counts(texts))
    assert spelling.digest(df.limit(0)).columns == ["word", "form", "root", "n", "n_near", "form_n"] and spelling.digest(df.limit(0)).count() == 0
