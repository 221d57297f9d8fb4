"""Edit matching against a plain dynamic programme."""

import random
import tracemalloc

import numpy as np

from maskloom.llm import decontamination as d
from maskloom.llm.words import normal


def least_distance(item, text, whole=False):
    """Least edit distance of the item to any part of the text, or to the whole text."""
    row = list(range(len(text) + 1)) if whole else [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return row[-1] if whole else min(row)


def edited(text, n, rng):
    t = list(text)
    for _ in range(n):
        i, what = rng.randrange(len(t)), rng.randrange(3)
        t[i : i + 1] = [] if what == 0 else [rng.choice("abcde ")] if what == 1 else [t[i], rng.choice("abcde")]
    return "".join(t)


def test_finds_all_within_the_budget_and_nothing_else(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rng.choice([12, 30, 70]))) for i in range(12)] + [(50, ""), (51, None), (52, "short one"), (53, "!!")]
    docs = []
    for k in range(120):
        _, item = items[k % 12]
        n = rng.choice([0, 1, len(item) // 20, len(item) // 11, len(item) // 9, len(item) // 6])
        docs.append((k, prose(40) + " " + edited(item, n, rng).upper() + "! " + prose(rng.choice([0, 60]))))
    docs += [(200, None), (201, ""), (202, "a Short ONE, whole"), (203, "ashort one not whole"), (204, "word " * 50000 + items[0][1]), (None, items[0][1]), (0, docs[0][1])]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, item_id int, start string").repartition(3)
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    got = d.contaminated(df, bench).collect()
    assert sum(r.doc_id == 0 and r.item_id == 0 for r in got) == 2
    found = {(r.doc_id, r.item_id): r for r in got}
    for i, t in docs:
        if i is None or i == 204 or not t:
            continue
        text = normal(t)
        for item_id, item in items[:12]:
            item = normal(item)
            best, budget = least_distance(item, text) if i % 12 == item_id or i % 5 == 0 else None, int(0.1 * len(item))
            if best is None:
                continue
            assert ((i, item_id) in found) == (best <= budget)
            if best <= budget:
                r = found[i, item_id]
                assert r.distance == best and least_distance(item, text[r.start : r.end], whole=True) == best
    assert (202, 52) in found and (203, 52) not in found and (204, 0) in found
    assert (None, 0) in found
    stay = [(r.doc_id, r.text) for r in d.clean(df, bench).collect()]
    assert {i for i, _ in stay} == {i for i, _ in docs if i is not None} - {r.doc_id for r in got}


def test_clean_judges_each_row_by_its_own_text(spark):
    """Null and repeated keys: contaminated rows go, clean rows that share a key with one stay, columns of any name and type stay as they are."""
    item = "a question that the benchmark asks in so many words"
    rows = [(1, "clean text of one", 1.5, {"a": [1]}), (1, f"it says {item} here", 1.5, None), (None, f"{item}!", 2.5, None), (None, "clean text without a key", None, {"b": []}), (2, None, 0.5, None), (2, "", 0.5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `item id` double, doc map<string,array<int>>")
    for group in (20_000, 1):
        out = d.clean(docs, spark.createDataFrame([(1, item), (2, "another item of the benchmark"), (None, "clean text of one")], "item_id long, text string"), group=group)
        assert out.schema.simpleString() == docs.schema.simpleString()
        assert sorted(map(repr, out.collect())) == sorted(repr(r) for r in docs.collect() if item not in (r.text or ""))
    assert d.clean(docs.limit(0), spark.createDataFrame([(1, item)], "item_id long, text string")).collect() == []
    assert d.clean(docs, spark.createDataFrame([], "item_id long, text string")).count() == 6


def test_very_long_texts_of_a_repeated_item_stay_small():
    """A text of a million characters that repeats an item, beside 2,000 ordinary hits."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8)))
    items = [(i, " ".join(word() for _ in range(14))) for i in range(40)]
    long = " ".join(edited(items[0][1], k % 11, rng) for k in range(1_000_000 // len(items[0][1])))
    matcher = d.Matcher(items, 0.1)
    texts = [long] + [word() + " " + edited(items[k % 40][1], 3, rng) + " " + word() for k in range(2000)]
    tracemalloc.start()
    found = matcher.find(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6
    first = next(x for x in found if x[0] == 0 and x[1] == 0)
    assert first[4] == 0 and normal(long)[first[2] : first[3]] == items[0][1]
    assert {x[0] for x in found} >= set(range(1, 2001))


def test_long_places_in_pieces_find_what_one_pass_finds():
    """Hits that lie so close that their places join: the best of all pieces is the best of the whole text."""
    rng = random.Random(6)
    for n in range(40):
        item = "".join(rng.choice("abc ") for _ in range(40)).strip()
        item = normal(item)
        text = normal("x" + "".join(edited(item, rng.randrange(2, 9), rng) + rng.choice(["", " ", "ab"]) for _ in range(25)))
        best, budget = least_distance(item, text), int(0.1 * len(item))
        got = d.Matcher([(7, item)], 0.1).find([text])
        assert [x[4] for x in got] == ([best] if best <= budget else [])


def test_groups_and_empty(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota"), (2, "none")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, f"{w} gamma delta epsilon zeta eta theta iota kappa"[:48]) for i, w in enumerate(["beta", "beto", "x"])], "item_id long, text string")
    all_at_once = sorted(map(tuple, d.contaminated(docs, bench).collect()))
    assert sorted(map(tuple, d.contaminated(docs, bench, group=1).collect())) == all_at_once
    assert d.contaminated(docs.limit(0), bench).collect() == [] == d.contaminated(docs, bench.limit(0)).collect()


def test_short_items_have_their_budget_as_well(spark):
    """Items of 10 to 39 characters: a tenth of their characters, as for long ones."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeж") for _ in range(rng.randrange(2, 6)))
    items = []
    while len(items) < 40:
        t = " ".join(word() for _ in range(rng.randrange(3, 9)))
        if 10 <= len(t) < 40:
            items.append((len(items), t))
    items.append((40, "which planet is the very largest one"))
    docs = [(k, " ".join(word() for _ in range(15)) + " " + edited(items[k % 41][1], rng.randrange(0, 5), rng) + " " + " ".join(word() for _ in range(15))) for k in range(160)]
    docs.append((160, "say which planet is the very largesd one of all"))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.distance for r in d.contaminated(df, bench).collect()}
    assert found[160, 40] == 1
    for i, t in docs:
        for item_id, item in items:
            best = least_distance(normal(item), normal(t))
            assert found.get((i, item_id), 99) == (best if best <= int(0.1 * len(normal(item))) else 99)


def test_masks_follow_the_letters_of_each_item():
    """Items in a large alphabet: a row for each of an item's own characters, not for each character of all items."""
    items = ["".join(chr(0x4E00 + (97 * i + j) % 20000) for j in range(80)) for i in range(1000)]
    p = d.Patterns(items)
    assert sum(m.nbytes for m in p.masks.values()) <= 1001 * 80 * 2 * 8
    best, end = p.best_ends(np.arange(3), [p.coded("x" + items[0]), p.coded(items[1][:-1]), p.coded(items[1])])
    assert best.tolist() == [0, 1, 80] and end[0] == 81
