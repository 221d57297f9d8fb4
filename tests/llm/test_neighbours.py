"""Multiprobe search against brute force."""

import numpy as np

from maskloom.llm import neighbours


def brute(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in ok:
        if i % 20 == 0:
            out[i] = sorted(((-float(q @ v), j) for j, v in ok if j != i))[:k]
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int").repartition(4)
    got = {}
    for r in neighbours.search(df, df.where("vec_id % 20 = 0"), **kw).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(x) for q, x in got.items()}


def test_recall_and_defined_cases(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.standard_normal(16) * rng.uniform(0.5, 2)).astype(np.float32).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[40][1]) for i in range(60)]  # a very common vector, queries among its copies
    rows += [(3000, None), (3020, [0.0] * 16), (3040, [float("nan")] + [1.0] * 15), (3060, [None] + [1.0] * 15), (3080, [float("inf")] * 16), (3100, [1.0])]
    got, want = run(spark, rows, k=20), brute([r for r in rows if r[0] != 3100], 20)
    assert set(got) == set(want)
    hits = sum(len({v for _, v, _ in got[q]} & {v for _, v in want[q]}) for q in want) / sum(map(len, want.values()))
    assert hits >= 0.9
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(v != q for _, v, _ in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
    vectors = dict(rows)
    for q in (0, 40, 2000):
        for _, v, s in got[q]:
            assert np.isclose(s, np.dot(np.array(vectors[q], np.float32).astype(float), np.array(vectors[v], np.float32).astype(float)), rtol=1e-12)
    assert [v for _, v, _ in got[2020]] == [v for _, v in want[2020]]


def test_small_and_empty(spark):
    assert run(spark, []) == {}
    assert run(spark, [(0, None)]) == {}
    assert run(spark, [(0, [1.0, 0.0])]) == {}
    got = run(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [1.0, 0.0])])
    assert [v for _, v, _ in got[0]][0] == 20 and [v for _, v, _ in got[20]][0] == 0


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {}
    for r in neighbours.digest(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    rows = df.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    hits = []
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hits.append(len(got[q] & set(ids[np.argsort(-s)[:20]].tolist())) / 20)
    print("recall", np.mean(hits))
    assert np.mean(hits) >= 0.9


def test_few_candidates_are_all_given(spark):
    """Fewer candidates than k: all of them, whatever the visits reach."""
    rng = np.random.default_rng(3)
    for n, dim in ((15, 64), (30, 8)):
        rows = [(20 * i if i % 3 == 0 else 20 * i + 1, rng.standard_normal(dim).astype(np.float32).tolist()) for i in range(n)]
        rows += [(20 * n + 1, (1000 * rng.standard_normal(dim)).astype(np.float32).tolist())]  # one outlier flattens all others
        got, want = run(spark, rows, k=20), brute(rows, 20)
        assert {q: len(x) for q, x in got.items()} == {q: min(20, n) for q in want}
        for q in want if n < 20 else ():
            assert [v for _, v, _ in got[q]] == [v for _, v in want[q]]


def test_repeated_ids_and_other_columns(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 1.0]), (1, [0.5, 0.0]), (2, [0.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<double>, query_id int, score int, chunk int")
    out = neighbours.digest(df)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    assert {r.vec_id for r in out.collect()} == {1, 2}


def test_visits_come_by_success():
    """Codes over a bound, found by halves, are those of the full product, likeliest first."""
    rng = np.random.default_rng(1)
    m = rng.random((5, neighbours.CELLS))
    m /= m.sum(1, keepdims=True)
    full = neighbours._products(m)
    s = neighbours.Success(m)
    for reach in (0.1, 0.5, 0.9, 1.0):
        got = s.visit(reach)
        order = np.argsort(-full, kind="stable")
        n = int(np.searchsorted(np.cumsum(full[order]), reach - 1e-9)) + 1
        assert len(set(got.tolist())) == len(got) and abs(len(got) - n) <= 1
        assert np.allclose(full[got], full[order[: len(got)]])
    from math import erf

    z = np.linspace(-6, 6, 99)
    assert np.allclose(neighbours.normal_cdf(z), [0.5 * (1 + erf(x / 2**0.5)) for x in z], atol=1e-6)


def test_blocks_and_chunks(spark):
    """Small blocks and chunks give the same rows: candidates meet every chunk of the queries that visit their block."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-99, 99, 8).astype(float).tolist()) for i in range(600)]
    assert run(spark, rows, k=5) == run(spark, rows, k=5, block=100, chunk=7)
