"""Toxic texts that only the voters without learnt terms see."""

import itertools
import math

import numpy as np

from maskloom.llm import toxicity


def corpus(spark, seen=12):
    nouns = "river table garden letter window cloud paper street apple music".split()
    clean = [(i, f"the {nouns[i % 10]} near the {nouns[i * 7 % 9]} is {nouns[i * 3 % 8]}") for i in range(200)]
    toxic = [(200 + i, f"you worthless {nouns[i % 10]} i will kill you") for i in range(seen)]
    alone = [(300, "worthless river"), (301, "they will destroy him near the table"), (302, "SHUT UP about the garden"), (303, "the river near the table"), (304, "")]
    return spark.createDataFrame(clean + toxic + alone, "doc_id long, text string")


def scores(spark, docs, labels):
    return {r.doc_id: r.score for r in toxicity.digest(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}


def test_voters_without_terms_score_without_labels(spark):
    got = scores(spark, corpus(spark), [])
    assert got[200] > 0.7 and got[200] > got[303]
    assert got[300] > got[303] and got[301] > got[303]


def test_voters_without_terms_score_with_few_labels(spark):
    got = scores(spark, corpus(spark), [(i, 0) for i in range(0, 200, 2)] + [(200, 1), (201, 1)])
    assert got[300] > got[303] + 0.1 and got[301] > got[303] + 0.1
    assert abs(got[303] - got[304]) < 1e-9


def test_a_threat_with_other_words_learnt(spark):
    # Learnt terms are the words of one insult sort; the threat and the insult of 300, 301 are not among them.
    docs = corpus(spark, 0).unionByName(spark.createDataFrame([(400 + i, f"grubby zorgs hate you {i}") for i in range(40)] + [(450 + i, "scum grubby zorgs") for i in range(10)], "doc_id long, text string"))
    got = scores(spark, docs, [(i, 0) for i in range(200)] + [(400 + i, 1) for i in range(60)])
    assert got[300] > got[303] and got[301] > got[303]


def brute_em(counts, voters, rounds, smooth):
    """The label model in plain Python: expectation maximisation over every row by itself, its tree by trying the best edges."""
    patterns = {c: [c // 3**v % 3 for v in range(voters)] for c in counts}
    post = {c: 1 / (1 + math.exp(-(2.0 * p.count(2) - p.count(1) - 0.5))) for c, p in patterns.items()}
    parent = None
    for step in range(rounds):
        w = {c: (n[0] * (1 - post[c]) + n[1], n[0] * post[c] + n[2]) for c, n in counts.items()}
        size = [sum(x[y] for x in w.values()) for y in (0, 1)]

        def weight(y, **want):
            return sum(w[c][y] for c, p in patterns.items() if all(p[int(k[1:])] == a for k, a in want.items()))

        if step < 10:
            info = {}
            for i, j in itertools.combinations(range(voters), 2):
                info[i, j] = info[j, i] = sum(
                    weight(y, **{f"v{i}": a, f"v{j}": b}) / sum(size) * math.log(weight(y, **{f"v{i}": a, f"v{j}": b}) * size[y] / (weight(y, **{f"v{i}": a}) * weight(y, **{f"v{j}": b})))
                    for y in (0, 1) for a in range(3) for b in range(3) if weight(y, **{f"v{i}": a, f"v{j}": b}) > 0)
            parent, inside = [-1] * voters, [0]
            while len(inside) < voters:
                i, j = max(((i, j) for i in inside for j in range(voters) if j not in inside), key=lambda e: (info[e], -e[1], -e[0]))
                parent[j] = i if info[i, j] >= 0.02 else -1
                inside.append(j)
        prior = min(0.9, max(1e-4, size[1] / sum(size)))
        post = {}
        for c, p in patterns.items():
            odds = math.log(prior / (1 - prior))
            for v in range(voters):
                like = []
                for y in (0, 1):
                    alone = (weight(y, **{f"v{v}": p[v]}) + smooth / 3) / (size[y] + smooth)
                    if parent[v] < 0:
                        like.append(alone)
                    else:
                        u = parent[v]
                        like.append((weight(y, **{f"v{u}": p[u], f"v{v}": p[v]}) + smooth * alone) / (weight(y, **{f"v{u}": p[u]}) + smooth))
                odds += math.log(like[1] / like[0])
            post[c] = 1 / (1 + math.exp(-odds))
    return post, parent


def drawn(seed, n=4000):
    """Rows of four voters: 0 and 1 nearly copies of each other, 2 and 3 apart; all may abstain."""
    rng = np.random.default_rng(seed)
    y = rng.random(n) < 0.3
    right = lambda p: np.where(rng.random(n) < p, np.where(y, 2, 1), np.where(y, 1, 2))
    a = np.where(rng.random(n) < 0.2, 0, right(0.75))
    b = np.where(rng.random(n) < 0.95, a, right(0.75))
    c, d = np.where(rng.random(n) < 0.3, 0, right(0.85)), np.where(rng.random(n) < 0.1, 0, right(0.8))
    return np.stack([a, b, c, d], 1), y


def test_label_model_matches_brute_force():
    votes, y = drawn(1)
    codes = (votes * 3 ** np.arange(4)).sum(1)
    marked = np.arange(len(y)) % 10 == 0
    for with_labels in (False, True):
        counts = {}
        for c, t, m in zip(codes.tolist(), y.tolist(), marked.tolist()):
            n = counts.setdefault(c, [0, 0, 0])
            n[1 + t if m and with_labels else 0] += 1
        model = toxicity.LabelModel(counts, voters=4, rounds=12)
        want, parent = brute_em(counts, 4, 12, 1.0)
        assert model.parent == parent
        assert all(abs(model.posterior[c] - p) < 1e-6 for c, p in want.items())


def test_label_model_learns_accuracies_and_correlations():
    votes, y = drawn(2, 20_000)
    codes = (votes * 3 ** np.arange(4)).sum(1)
    model = toxicity.LabelModel({int(c): (int(n), 0, 0) for c, n in zip(*np.unique(codes, return_counts=True))}, voters=4)
    true = [(votes[votes[:, v] > 0, v] == 1 + y[votes[:, v] > 0]).mean() for v in range(4)]
    assert np.abs(model.accuracy - true).max() < 0.08
    assert model.correlation[0, 1] > 0.7 and abs(model.correlation[2, 3]) < 0.2
    assert 1 in (model.parent[1], model.parent[0]) or model.parent[1] == 0
    post = np.array([model.posterior[int(c)] for c in codes])
    majority = (votes == 2).sum(1) > (votes == 1).sum(1)
    assert ((post > 0.5) == y).mean() > (majority == y).mean()


def test_patterns_of_votes():
    silent = toxicity.pattern(0, 50, 0, True)
    assert [silent // 3**v % 3 for v in range(toxicity.VOTERS)] == [0] * 3 + [1] * 9
    assert toxicity.pattern(0, 5, 0, True) == 0 == toxicity.pattern(0, 50, 0, False)
    some = toxicity.pattern(1 | 1 << 5, 10, 1, True)
    assert [some // 3**v % 3 for v in range(toxicity.VOTERS)] == [2, 0, 0, 0, 0, 2, 0, 0, 0, 0, 0, 2]
