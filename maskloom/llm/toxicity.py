"""Toxicity by weak supervision.

1. Terms: from a uniform sample of at most about `sample` labelled training rows (a documented bound), the document frequencies
   of words and of their first 3, 4 and 5 letters in toxic and clean rows; the `terms` terms most tied to toxic rows are kept.
2. Voters: twelve, each voting toxic, voting clean or abstaining. General insults, shouting and threats vote toxic or abstain. Lexicons of
   words and of beginnings are mined from each of three disjoint folds of the sampled rows, so that they err apart; with those of strong terms
   they vote clean on texts of at least `ENOUGH` words in which they find nothing and abstain on shorter ones. The last voter goes by the share of
   a text's words that have terms. Three votes of twelve voters give at most 3^12 = 531,441 patterns.
3. Label model: a generative model of the patterns of all documents, P(class) P(votes | class), in which the votes hang together in trees: each voter's
   vote depends on the class and, where the two are correlated, on the vote of the one voter that it is most correlated with. Accuracies and correlations are
   learnt from the agreement of the votes by expectation maximisation; the tree is the one of greatest conditional mutual information. Labelled
   sampled rows keep their class.
4. Classifier: a logistic regression on the terms and on the three voters that have no terms (insults, two patterns), fitted to the
   posterior labels of a bounded sample of documents and of each firing pattern of those three alone, scores every text.

Texts are read twice: the sampled rows for the terms and all rows for votes and terms; no text is shuffled.

Defined cases: a null text is an empty one and is scored; very long texts are read whole; repeated rows are scored each; a key
labelled several times is toxic if any label is; without labels only the insult list and patterns vote; an empty table gives no
rows; other columns are not read."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.shared import crc_mod, in_share, written

# General English insults.
INSULTS = ("idiot", "stupid", "moron", "loser", "trash", "scum", "pathetic", "worthless", "disgusting", "clown", "dumb", "jerk", "imbecile", "garbage", "filth", "vermin", "coward", "liar", "fool", "freak")
NAMES = ("insults", "shouting", "threats", "words_0", "words_1", "words_2", "beginnings_0", "beginnings_1", "beginnings_2", "strong_words", "strong_beginnings", "share")
VOTERS = len(NAMES)
#: The first voters need no learnt terms; they have columns of their own behind those of the terms.
FIXED = 3
#: Parts of the sampled rows with lexicons of their own.
FOLDS = 3
#: Votes, and the words of a text from which a lexicon that finds nothing votes clean.
ABSTAIN, CLEAN, TOXIC = 0, 1, 2
ENOUGH = 20
_WORD = re.compile(r"\w+")
_SHOUTED = re.compile(r"\b(YOU|SHUT UP|HATE)\b")
_THREAT = re.compile(r"\b(kill|hurt|hate|destroy) (you|them|him|her|yourself)\b", re.I)


def terms_of(word: str) -> list[str]:
    """A word and its beginnings as terms; beginnings end in `*`."""
    return [word, *[word[:n] + "*" for n in (3, 4, 5) if len(word) > n]]


def learn_terms(docs: DataFrame, labels: DataFrame, label: str, text: str = "text", sample: int = 40_000, terms: int = 4096) -> tuple[dict[str, tuple[int, int]], dict[int, int]]:
    """Terms tied to toxic rows, each with its number and the bits of the voters that have it, and the sampled labels (both bounded)."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    share = min(1.0, sample / max(1, marked.count()))
    chosen = {r["doc_id"]: r["y"] for r in marked.where(in_share("doc_id", share)).collect()}
    if not chosen:
        return {}, {}
    known = docs.sparkSession.createDataFrame(list(chosen.items()), "doc_id long, y int").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(FOLDS)).cast("int"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(known), "doc_id").select("text", F.col("fold") * 2 + F.col("y").cast("boolean").cast("int"))
    names = [f"{kind}_{f}" for f in range(FOLDS) for kind in ("clean", "toxic")]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[int]] = {}
        told = lambda: pd.DataFrame({"term": list(held), **{n: [x[i] for x in held.values()] for i, n in enumerate(names)}})
        for b in batches:
            for t, cell in zip(b.iloc[:, 0], b.iloc[:, 1]):
                words = set(_WORD.findall((t or "").lower()))
                for term in {x for w in words for x in terms_of(w)}:
                    held.setdefault(term, [0] * len(names))[cell] += 1
                if len(held) > 400_000:
                    yield told()
                    held.clear()
        if held:
            yield told()

    sizes = {(r["fold"], r["y"]): r["count"] for r in known.groupBy("fold", (F.col("y") > 0).alias("y")).count().collect()}
    bad, good = (sum(n for (_, y), n in sizes.items() if y == what) for what in (True, False))
    odds = lambda toxic, clean, bad, good: F.log((toxic + 0.5) / (bad + 1.0)) - F.log((clean + 0.5) / (good + 1.0))
    sums = rows.mapInPandas(count, "term string, " + ", ".join(f"{n} long" for n in names)).groupBy("term").agg(*[F.sum(n).alias(n) for n in names])
    total = lambda kind: sum((F.col(f"{kind}_{f}") for f in range(1, FOLDS)), F.col(f"{kind}_0"))
    tied = sums.withColumns({"clean": total("clean"), "toxic": total("toxic")}).where("toxic >= 3").withColumn("odds", odds(F.col("toxic"), F.col("clean"), bad, good)).where("odds > 1.5")
    own = [(F.col(f"toxic_{f}") >= 3) & (odds(F.col(f"toxic_{f}"), F.col(f"clean_{f}"), sizes.get((f, True), 0), sizes.get((f, False), 0)) > 3) for f in range(FOLDS)]
    top = tied.select("term", "odds", "toxic", *[o.alias(f"own_{f}") for f, o in enumerate(own)]).orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "term").limit(terms).collect()

    def voters(r) -> int:
        first = FIXED + FOLDS * r["term"].endswith("*")
        return sum(1 << (first + f) for f in range(FOLDS) if r[f"own_{f}"]) | (r["odds"] > 3) << (FIXED + 2 * FOLDS + r["term"].endswith("*"))

    return {r["term"]: (i, voters(r)) for i, r in enumerate(top)}, chosen


def pattern(bits: int, words: int, with_terms: int, lexicons: bool) -> int:
    """The votes of a text as digits of base 3, from the voters that found something, its distinct words, and those with terms."""
    silent = CLEAN if words >= ENOUGH and lexicons else ABSTAIN
    votes = [(TOXIC if bits >> v & 1 else ABSTAIN if v < FIXED else silent) for v in range(VOTERS - 1)]
    share = with_terms / max(1, words)
    votes.append(TOXIC if share >= 0.04 else silent if share <= 0.01 else ABSTAIN)
    return sum(v * 3**i for i, v in enumerate(votes))


def featured(docs: DataFrame, terms: dict[str, tuple[int, int]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the numbers of its terms and the pattern of its votes."""
    insults = frozenset(INSULTS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory: dict[str, tuple] = {}

        def look(word: str) -> tuple:
            hits = [terms[x] for x in terms_of(word) if x in terms]
            bits = int(word in insults)
            for _, voters in hits:
                bits |= voters
            found = memory[word] = (bits, tuple(number for number, _ in hits))
            return found

        for b in batches:
            out, codes = [], []
            for t in b["text"]:
                t, bits, mine, with_terms = t or "", 0, set(), 0
                words = set(_WORD.findall(t.lower()))
                for w in words:
                    v, own = memory.get(w) or look(w)
                    if own:
                        with_terms += 1
                        mine.update(own)
                    bits |= v
                if len(memory) > 300_000:
                    memory.clear()
                out.append(sorted(mine))
                codes.append(pattern(bits | bool(_SHOUTED.search(t)) << 1 | bool(_THREAT.search(t)) << 2, len(words), with_terms, bool(terms)))
            yield pd.DataFrame({"id": b["id"], "terms": out, "votes": pd.Series(codes, dtype="int32")})

    ids = docs.select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    return ids.mapInPandas(run, "id string, terms array<int>, votes int").select(F.col("id").cast("long").alias("doc_id"), "terms", "votes")


class LabelModel:
    """P(toxic | votes) for each pattern, from pattern counts of unlabelled, clean and toxic rows.

    `accuracy` is each voter's share of right votes among its votes, `correlation` the correlations of toxic votes within the classes, `parent` the tree."""

    def __init__(self, counts: dict[int, tuple[float, float, float]], voters: int = VOTERS, rounds: int = 50, smooth: float = 1.0):
        self.codes = np.array(sorted(counts), np.int64)
        n = np.array([counts[int(c)] for c in self.codes], float).reshape(-1, 3)
        self.votes = self.codes[:, None] // 3 ** np.arange(voters) % 3
        self.smooth, self.prior, self.accuracy, self.correlation, self.parent = smooth, 0.1, np.full(voters, 0.5), np.eye(voters), [-1] * voters
        self.posterior: dict[int, float] = {}
        if not len(self.codes):
            return
        one = (self.votes[:, :, None] == np.arange(3)).reshape(len(self.codes), -1).astype(float)
        toxic, clean = (self.votes == TOXIC).sum(1), (self.votes == CLEAN).sum(1)
        # At first the majority's view, a toxic vote counting twice: most voters vote clean on most texts.
        post = 1 / (1 + np.exp(-(2.0 * toxic - clean - 0.5)))
        for step in range(rounds):
            weights = [n[:, 0] * (1 - post) + n[:, 1], n[:, 0] * post + n[:, 2]]
            joint = np.stack([(one * w[:, None]).T @ one for w in weights]).reshape(2, voters, 3, voters, 3)
            if step < 10:
                self.parent = spanning_tree(mutual_information(joint))
            self._fit(joint, np.array([w.sum() for w in weights]))
            post = self._posterior()
        own = np.stack([joint[:, v, :, v, :].diagonal(0, 1, 2) for v in range(voters)], 1)  # class, voter, vote
        self.accuracy = (own[0, :, CLEAN] + own[1, :, TOXIC] + 0.5) / (own[:, :, CLEAN].sum(0) + own[:, :, TOXIC].sum(0) + 1.0)
        v = (self.votes == TOXIC).astype(float)
        pooled = sum(((v - (w @ v) / max(w.sum(), 1e-9)) * w[:, None]).T @ (v - (w @ v) / max(w.sum(), 1e-9)) for w in weights)
        self.correlation = pooled / np.sqrt(np.outer(np.diag(pooled), np.diag(pooled)) + 1e-12)
        self.posterior = dict(zip(self.codes.tolist(), post.tolist()))

    def _fit(self, joint: np.ndarray, size: np.ndarray) -> None:
        """Class shares, each voter's votes by class, and by class and its parent's vote; rare parent votes fall back on the class."""
        self.prior = float(np.clip(size[1] / max(size.sum(), 1e-9), 1e-4, 0.9))
        self.tables = []
        for v, p in enumerate(self.parent):
            alone = joint[:, v, :, v, :].diagonal(0, 1, 2)
            alone = (alone + self.smooth / 3) / (alone.sum(1, keepdims=True) + self.smooth)
            if p < 0:
                self.tables.append(alone)
            else:
                pair = joint[:, p, :, v, :]
                self.tables.append((pair + self.smooth * alone[:, None, :]) / (pair.sum(2, keepdims=True) + self.smooth))

    def _posterior(self) -> np.ndarray:
        odds = np.full(len(self.votes), np.log(self.prior / (1 - self.prior)))
        for v, (p, table) in enumerate(zip(self.parent, self.tables)):
            at = (self.votes[:, v],) if p < 0 else (self.votes[:, p], self.votes[:, v])
            odds += np.log(table[1][at] / table[0][at])
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def mutual_information(joint: np.ndarray) -> np.ndarray:
    """Conditional mutual information of each two voters given the class, from joint weights (class, voter, vote, voter, vote)."""
    voters = joint.shape[1]
    total, out = max(joint.sum() / voters**2, 1e-9), np.zeros((voters, voters))
    for own in joint:
        weight = own.sum() / voters**2
        if weight > 0:
            both = own.transpose(0, 2, 1, 3) / weight
            apart = both.sum(3)[..., None] * both.sum(2)[..., None, :]
            out += weight / total * np.where(both > 0, both * np.log(np.maximum(both, 1e-300) / np.maximum(apart, 1e-300)), 0).sum((2, 3))
    return out


def spanning_tree(weight: np.ndarray, least: float = 0.02) -> list[int]:
    """Parents in the tree of greatest weight from voter 0 (ties: the smaller voters); edges under `least` are cut, since chance alone makes some."""
    parent, best = [-1] * len(weight), {v: (weight[0, v], 0) for v in range(1, len(weight))}
    while best:
        v = max(best, key=lambda x: (best[x][0], -x))
        w, near = best.pop(v)
        parent[v] = near if w >= least else -1
        for x in best:
            if weight[v, x] > best[x][0]:
                best[x] = (weight[v, x], v)
    return parent


def fit_linear(rows: list[list[int]], target: np.ndarray, size: int, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on term sets with soft targets (ridge, gradient steps scaled by feature)."""
    if not rows:
        return np.zeros(size), float(np.log(0.1 / 0.9))
    n = len(rows)
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    what = np.fromiter((x for r in rows for x in r), np.int64, len(at))
    w, seen = np.zeros(size), np.bincount(what, minlength=size)
    mean = float(np.clip(target.mean(), 1e-3, 0.999))
    bias = float(np.log(mean / (1 - mean)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(at, w[what], n), -30, 30)))
        off = target - p
        w += 0.5 * (np.bincount(what, off[at], size) - 0.01 * w) / (0.1 * seen + 1.0)
        bias += 0.5 * off.mean() / max(1e-3, (p * (1 - p)).mean())
    return w, bias


def columns(terms: list[int], votes: int, size: int) -> list[int]:
    """Columns of a text in the classifier: its terms (of `size`), then the voters without terms."""
    return [*terms, *(size + v for v in range(VOTERS) if votes // 3**v % 3 == TOXIC)]


def digest(docs: DataFrame, labels: DataFrame, fit_sample: int = 60_000) -> DataFrame:
    """Learn from labels with crc32(doc_id) mod 3 not 1 and score all documents."""
    terms, known = learn_terms(docs, labels.where(crc_mod("doc_id", 3) != 1), "toxic")
    rows = written(featured(docs, terms), "toxicity-terms")
    spark = docs.sparkSession
    marked = spark.createDataFrame(list(known.items()), "doc_id long, y int")
    tallied = rows.join(F.broadcast(marked), "doc_id", "left").groupBy("votes").agg(F.count_if(F.col("y").isNull()).alias("free"), F.count_if(F.col("y") == 0).alias("clean"), F.count_if(F.col("y") == 1).alias("toxic"))
    model = LabelModel({r["votes"]: (r["free"], r["clean"], r["toxic"]) for r in tallied.collect()})
    total = max(1, rows.count())
    part = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < int(min(1.0, fit_sample / total) * (1 << 20))).select("terms", "votes").collect()
    # Patterns of the voters without terms that the sample has missed: their texts have no other column.
    found_nothing = lambda v: all(v // 3**i % 3 != TOXIC for i in range(FIXED, VOTERS))
    alone = sorted({v for v in model.posterior if found_nothing(v)} - {r["votes"] for r in part})
    size = len(terms)
    fitted = [columns(r["terms"], r["votes"], size) for r in part] + [columns([], v, size) for v in alone]
    weights, bias = fit_linear(fitted, np.array([model.posterior[v] for v in [r["votes"] for r in part] + alone]), size + VOTERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = np.array([bias + weights[columns(x, v, size)].sum() for x, v in zip(b["terms"], b["votes"])], float)
            yield pd.DataFrame({"id": b["id"], "score": 1 / (1 + np.exp(-np.clip(raw, -30, 30)))})

    out = rows.select(F.col("doc_id").cast("string").alias("id"), "terms", "votes").mapInPandas(run, "id string, score double")
    out = out.select(F.col("id").cast("long").alias("doc_id"), "score")
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
