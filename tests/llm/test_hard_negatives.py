"""Hard negatives against brute force: random and tied vectors, odd rows, small chunks and blocks."""

import math

import numpy as np
import pytest

from maskloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<float>, score string"


def brute(rows):
    v = []
    for vec_id, label, e, _ in rows:
        if vec_id is None or label is None or not e or any(x is None or not math.isfinite(x) for x in e):
            continue
        v.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in e]))
    out = []
    for a, la, ca in v:
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(ca, c)), i, lb) for i, lb, c in v if i != a and len(c) == len(ca))
        for ps, p, _ in [s for s in scored if s[2] == la][:5]:
            fits = [s for s in scored if s[2] != la and 50 * -ps <= 100 * -s[0] <= 95 * -ps][:3]
            out += [(a, p, k + 1, i, -ps, -s) for k, (s, i, _) in enumerate(fits)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, y, e if e is None else [x if x is None else float(x) for x in e], s) for i, y, e, s in rows], SCHEMA)


def random_rows(n, dim, labels, seed, step=1, coarse=None):
    rng = np.random.default_rng(seed)
    e = rng.standard_normal((n, dim)) / np.sqrt(dim)
    e = np.round(e * coarse) / coarse if coarse else e
    return [(i * step, int(rng.integers(labels)), [float(np.float32(x)) for x in e[i]], "x") for i in range(n)]


@pytest.mark.parametrize("rows", [random_rows(400, 16, 4, 1), random_rows(300, 8, 2, 2, step=5, coarse=2), random_rows(120, 3, 60, 3, step=10)])
def test_equals_brute_force(spark, rows):
    got = sorted(tuple(r) for r in hn.mine(table(spark, rows)).collect())
    assert got == brute(rows) and got


def test_small_chunks_of_anchors(spark):
    rows = random_rows(200, 6, 3, 4, step=25)
    assert sorted(tuple(r) for r in hn.mine(table(spark, rows), chunk=30).collect()) == brute(rows)


def test_odd_rows(spark):
    rows = random_rows(150, 4, 3, 5, step=10)
    rows += [(None, 1, [1.0, 1, 1, 1], "x"), (50, None, [1.0, 1, 1, 1], "x"), (100, 1, None, "x"), (150, 1, [], "x"), (200, 1, [1.0, None, 1, 1], "x"), (250, 1, [math.nan, 1, 1, 1], "x"),
             (300, 1, [math.inf, 1, 1, 1], "x"), (350, 1, [1.0, 1], "x"), (351, 2, [1.0, 0.7], "x"), (353, 1, [1.0, 1], "x"), (400, 2, [0.0] * 4, "x"), (450, 2, [-0.001] * 4, "x")]
    assert sorted(tuple(r) for r in hn.mine(table(spark, rows)).collect()) == brute(rows)


def test_repeated_rows_count_each(spark):
    rows = [(1, 1, [1.0, 0.0], "x")] * 2 + [(2, 2, [0.8, 0.0], "x")] * 2 + [(50, 1, [1.0, 0.0], "x")] * 2
    got = sorted(tuple(r) for r in hn.mine(table(spark, rows)).collect())
    assert got == sorted([(50, 1, k, 2, 65536, 52224) for k in (1, 2)] * 4)


def test_no_anchor_and_empty_tables(spark):
    for rows in ([], random_rows(30, 4, 2, 6)[1:]):
        out = hn.mine(table(spark, rows))
        assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and out.count() == 0


def test_lists_are_left_early():
    """One long vector along the anchor: the threshold is below the kth score long before the lists end."""
    rng = np.random.default_rng(7)
    rows = rng.integers(-20, 20, (4000, 8))
    rows[:3] = 500
    block = hn.Block(np.arange(1, 4001), np.ones(4000, np.int64), rows.astype(np.int64))
    class Counted(np.ndarray):
        seen = 0

        def __getitem__(self, at):
            if isinstance(at, np.ndarray):
                Counted.seen += len(at)
            return np.asarray(self)[at]

    block.rows = block.rows.view(Counted)
    w = hn.Windows(np.array([[hn._NONE]]), np.array([[hn._MOST]]), 3)
    block.mine(np.full(8, 9), 0, 1, True, w, 0)
    assert w.ids[0, 0].tolist() == [1, 2, 3] and Counted.seen < 400
