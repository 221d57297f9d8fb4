"""The quality ranking and the language model's scores worked out a second way, by plain loops."""

import math
import re

import numpy as np
import pytest

from maskloom.llm import language_model as lm
from maskloom.llm import quality


def plain_rank_scores(x, good, rivals, cut, seed=11):
    """Bradley-Terry by plain gradient ascent on the same pairs: weights, threshold by the quantile of bad rows, scores."""
    middle, spread = np.median(x, 0), x.std(0) + 1e-3
    wide = lambda row: [f for v, m, s in zip(row, middle, spread) for f in [max(-6, min(6, (v - m) / s))]]
    z = []
    for row in x:
        base = wide(row)
        z.append(base + [abs(v) for v in base] + [max(0, v - 1) for v in base])
    z = np.array(z)
    rng = np.random.default_rng(seed)
    yes, no = [i for i, g in enumerate(good) if g], [i for i, g in enumerate(good) if not g]
    pairs = list(zip([i for i in yes for _ in range(rivals)], rng.choice(no, len(yes) * rivals).tolist()))
    losers = [j for j in no for _ in range(rivals)]
    pairs += list(zip(rng.choice(yes, len(no) * rivals).tolist(), losers))
    d = np.array([z[i] - z[j] for i, j in pairs])
    w, rate = np.zeros(z.shape[1]), 1.0
    loss = lambda w: float(np.log1p(np.exp(-np.clip(d @ w, -500, 500))).sum() + len(d) * 1e-4 * (w @ w))
    now = loss(w)
    for _ in range(60_000):
        gradient = d.T @ (1 / (1 + np.exp(np.clip(d @ w, -500, 500)))) - len(d) * 2e-4 * w
        if np.abs(gradient).max() < 1e-7 * len(d):
            break
        while loss(w + rate / len(d) * gradient) > now:
            rate /= 2
        w, rate = w + rate / len(d) * gradient, rate * 1.2
        now = loss(w)
    raw = z @ w
    threshold = np.quantile(raw, len(no) / len(good))
    return [1 / (1 + math.exp(-max(-30, min(30, r - threshold)) - math.log(cut / (1 - cut)))) for r in raw], loss, w


def test_ranking_equals_plain_gradient_ascent():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 4))
    good = x @ [1.5, -1, 0.3, 0] + rng.standard_normal(300) > 0.4
    model = quality.Preference(x, good, 4, 0.3)
    want, loss, w = plain_rank_scores(x, good, 4, 0.3)
    assert loss(model.weights) <= loss(w) + 1e-6 and loss(model.weights) > loss(w) - 0.5  # the same optimum
    assert np.abs(model.score(x) - want).max() < 0.02
    # The threshold: as many of the learnt rows are at or over the cut as are labelled good.
    assert abs(int((model.score(x) >= 0.3).sum()) - int(good.sum())) <= 1


def test_scores_that_tie_at_the_threshold_are_over_it():
    """Half of the rows are alike and lie on the threshold: all of them have the cut as their score and the same side."""
    x = np.array([[0.0]] * 50 + [[-1.0]] * 30 + [[1.0]] * 20)
    good = np.array([i % 2 == 0 for i in range(50)] + [False] * 30 + [True] * 20)
    model = quality.Preference(x, good, 4, 0.3)
    s = model.score(x)
    assert len(set(s[:50].tolist())) == 1 and s[0] == pytest.approx(0.3, abs=1e-9) and (s[50:80] < 0.3).all() and (s[80:] > 0.3).all()


def test_query_scores_are_the_models_of_whole_texts(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    chosen = labels.where(quality.crc_mod("doc_id", 5) != 0)
    x = {r["doc_id"]: quality.features(r["text"]) for r in docs.select("doc_id", "text").collect()}
    y = sorted((r["doc_id"], r["quality"] == 1) for r in chosen.collect() if r["doc_id"] in x)
    own = quality.Preference(np.array([x[i] for i, _ in y], float), np.array([g for _, g in y]), 4, 0.3)
    for r in quality.digest(docs, labels).collect():
        assert r["score"] == pytest.approx(float(own.score(x[r["doc_id"]][None].astype(float))[0]), rel=1e-6) and r["predicted"] == (r["score"] >= 0.3)


def soft(s):
    top = max(s)
    total = math.log(sum(math.exp(v - top) for v in s))
    return [v - top - total for v in s]


def test_a_documents_score_token_by_token(spark, monkeypatch):
    """The trained tables applied by a loop over the tokens of a text, in plain Python."""
    held = {}

    first = lm.Vocabulary.__init__

    def noted(self, counts):
        first(self, counts)
        held["known"] = self

    def kept(name, f):
        def run(*a, **kw):
            held[name] = f(*a, **kw)
            return held[name]

        return run

    monkeypatch.setattr(lm, "train", kept("classes", lm.train))
    monkeypatch.setattr(lm, "train_words", kept("words", lm.train_words))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    training = docs.where(lm.crc_mod("doc_id", 7) != 2)
    counts = {}
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    for r in training.collect():
        for w in [*cut(r["text"]), ""]:
            counts[w.encode()] = counts.get(w.encode(), 0) + 1
    monkeypatch.setattr(lm.Vocabulary, "__init__", noted)
    got = {r["doc_id"]: r["score"] for r in lm.score(docs, training, vocabulary=400).collect()}
    known, classes, words = held["known"], held["classes"], held["words"]
    number = {bytes(w.as_py()): i for i, w in enumerate(known.words)}
    outside = [1] * lm.SUFFIXES
    suffix = lambda w: int(lm.suffixes(lm.pa.array([w], lm.pa.binary()))[0])
    for w, n in counts.items():
        if w not in number:
            outside[suffix(w)] += n + 1
    wrapped = lambda v: (v + 2**63) % 2**64 - 2**63  # noqa: E731  products in 64 bits
    mix = lambda x, own, salt: wrapped((((x * lm.SUFFIXES + own) * 0x9E3779B1) + salt) % 2**32 * 0x85EBCA6B) % 4294967291 & (words.rows - 1)
    for r in docs.orderBy("doc_id").limit(12).collect():
        total, last = 0.0, [(lm.BEGIN, lm.NEAR + lm.BEGIN)] * 2  # class and near number of the tokens before
        for w in [t.encode() for t in cut(r["text"])] + [b""]:
            at = number.get(w)
            c = lm.END if not w else int(known.classes[at]) if at is not None else lm.SINGLE + lm.SUFFIXES + suffix(w)
            (one, near_one), (two, near_two) = last[-1], last[-2]
            context = two * (lm.CLASSES + 1) + one
            rows = [0, 1 + one, 2 + lm.CLASSES + two, 3 + 2 * lm.CLASSES + ((context * 0x9E3779B1 & 0xFFFFFFFF) * classes.pairs >> 32)]
            total += soft(sum(classes.w[i].astype(float) for i in rows).tolist())[c] / math.log(10)
            if at is not None and known.slot[at] >= 0 and w:
                own = c - lm.SINGLE
                s = known.bias[own].astype(float) + words.w[mix(near_one, own, 1)] + words.w[words.rows + mix(near_two, own, 2)]
                total += soft(s.tolist())[int(known.slot[at])] / math.log(10) + known.within[at]
            elif at is None:
                total += math.log10(counts.get(w, 0) + 1) - math.log10(outside[c - lm.SINGLE - lm.SUFFIXES])
            last.append((c, at if at is not None and at < lm.NEAR and w else lm.NEAR + c))
        assert got[r["doc_id"]] == pytest.approx(total, rel=1e-4), r["doc_id"]
