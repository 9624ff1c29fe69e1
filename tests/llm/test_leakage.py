from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from tidemark.llm import leakage
from tidemark.llm.leakage import ItemIndex, find_leaks, fold, words

DOCS = "doc_id bigint, text string, item_id int"
ITEMS = "item_id bigint, item_text string, suite string"
rnd = random.Random(4)
VOCABULARY = ["".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randrange(2, 5))) for _ in range(3000)]
STOCK = "answer the following question in one short and complete sentence"


def item(n=70):
    return STOCK + " " + " ".join(rnd.choice(VOCABULARY) for _ in range(n - 10))


def noise(n=150):
    return " ".join(rnd.choice(VOCABULARY) for _ in range(n))


def edited(text, every):
    w = text.split()
    return " ".join(rnd.choice(VOCABULARY) if i % every == every - 1 else x for i, x in enumerate(w))


ITEM_ROWS = [(i, item(rnd.randrange(55, 90)), None) for i in range(40)]


def leaks(spark, docs, items=ITEM_ROWS):
    got = find_leaks(spark.createDataFrame([(i, t, 0) for i, t in enumerate(docs)], DOCS), spark.createDataFrame(items, ITEMS))
    return sorted(map(tuple, got.collect()))


def test_whole_partial_edited_and_split(spark):
    full = [r[1] for r in ITEM_ROWS]
    w = full[3].split()
    docs = [
        noise() + "\n" + full[0] + "\n" + noise(),  # whole
        noise() + " " + " ".join(full[1].split()[20:50]) + " " + noise(),  # a passage
        noise() + " " + edited(full[2], 5) + " " + noise(),  # one word in five changed
        " ".join(w[:40]) + "\n(my own remark)\n" + " ".join(w[40:]),  # interrupted
        "> " + full[4][:120].upper() + "\n> " + full[4][120:].replace("a", "à"),  # quoted, another case, accents
        full[5].replace("a", "а").replace("o", "о"),  # Cyrillic look-alikes
        noise() + " " + full[6] + " " + noise() + " " + full[7],  # two items
        noise() + " " + " ".join(full[8].split()[12:24]) + " " + noise(),  # a snippet: no leak
        STOCK + ". " + noise(),  # a stock phrase: no leak
        " ".join(rnd.sample(full[9].split(), len(full[9].split()))),  # other order: no leak
        noise(),
        None,
        "",
        " \n",
    ]
    assert leaks(spark, docs) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (6, 7)]


def test_long_texts_repeats_and_odd_items(spark):
    long_item = noise(3000)
    items = [(1, long_item, "s"), (1, long_item, "s"), (2, "", None), (3, None, None), (None, item(), None), (4, long_item, None)]
    docs = [noise(40_000) + " " + long_item + " " + noise(20_000), long_item[: len(long_item) // 5]]
    assert leaks(spark, docs, items) == [(0, 1), (0, 4)]


def test_same_document_row_twice_and_empty_tables(spark):
    df = spark.createDataFrame([(1, ITEM_ROWS[0][1], 0)] * 2, DOCS)
    it = spark.createDataFrame(ITEM_ROWS, ITEMS)
    assert [tuple(r) for r in find_leaks(df, it).collect()] == [(1, 0)]
    assert find_leaks(df.limit(0), it).count() == 0
    assert find_leaks(df, it.limit(0)).count() == 0


def test_item_blocks_do_not_change_the_result(spark):
    docs = spark.createDataFrame([(i, noise(30) + " " + r[1], 0) for i, r in enumerate(ITEM_ROWS)], DOCS)
    it = spark.createDataFrame(ITEM_ROWS, ITEMS)
    assert sorted(map(tuple, find_leaks(docs, it, block_words=1000).collect())) == [(i, i) for i in range(len(ITEM_ROWS))]


def test_short_items_and_texts(spark):
    """Items and texts of a few words are held to the same rule."""
    items = [(1, "bread", None), (2, "warm salted bread", None), (3, "one two three four five six", None), (4, "...", None)]
    assert leaks(spark, ["bread", "warm salted", "three four", "six one", "nothing"], items) == [(0, 1), (0, 2), (1, 2), (2, 3)]


@pytest.mark.parametrize("share", [1 / 3, 0.2, 1.0])
def test_kept_run_is_kept(share):
    """However the altered words lie, a run of the promised length is left; tried for all placements of short passages."""
    for n in range(1, 13):
        run = leakage.kept_run(n, share, 0.2)
        for size in range(leakage.needed(n, share), n + 1):
            for gone in itertools.combinations(range(size), int(size * 0.2 + 1e-9)):
                kept = "".join(" " if i in gone else "x" for i in range(size)).split()
                assert max(map(len, kept)) >= run
    assert all(leakage.kept_run(n, 1 / 3, 0.2) == 4 for n in range(46, 400))


def brute(item, weights, text, share, changed, weight):
    """All passages, each against the text by the textbook recurrence."""
    n = len(item)
    for i in range(n):
        row = [0] * (len(text) + 1)
        for j in range(i + 1, n + 1):
            new = [0]
            for k, w in enumerate(text):
                new.append(max(row[k + 1], new[k], row[k] + 1 if w == item[j - 1] else 0))
            row = new
            there = [x in text for x in item[i:j]]
            if j - i >= leakage.needed(n, share) and row[-1] >= (1 - changed) * (j - i) - 1e-6 and np.dot(weights[i:j], there) >= weight * weights[i:j].sum() - 1e-6:
                return True
    return False


def test_passage_and_its_bounds_against_brute_force():
    gen = random.Random(9)
    seen = set()
    for _ in range(600):
        letters = "abcdefgh"[: gen.randrange(2, 9)]
        item = [gen.choice(letters) for _ in range(gen.randrange(1, 16))]
        text = [gen.choice(letters) if gen.random() < 0.3 else w for w in item[gen.randrange(len(item)) :]] + [gen.choice(letters) for _ in range(gen.randrange(4))]
        weights = np.array([{c: gen.random() for c in letters}[w] for w in item])
        want = brute(item, weights, text, 1 / 3, 0.2, 0.6)
        assert leakage.passage(item, weights, text, 1 / 3, 0.2, 0.6) == want
        index = ItemIndex([0], [item], [weights], 1 / 3, 0.2)
        if want:
            assert list(index.possible(np.array([0]), text, 0.2, 0.6)) == [0]
        seen.add(want)
    assert seen == {True, False}


def test_recall_at_the_limit(spark):
    """Five passages of each item of the test tables, each exactly a third long with every fifth word replaced."""
    gen = random.Random(1)
    items = [(r.item_id, leakage.words(r.item_text)) for r in spark.read.parquet("/root/testdata/sf0.1/eval_items.parquet").collect()]
    every = [w for _, t in items for w in t]
    docs, want = [], set()
    for i, t in items:
        n = leakage.needed(len(t), 1 / 3)
        for _ in range(5):
            at = gen.randrange(len(t) - n + 1)
            passage = [gen.choice(every) if k % 5 == 4 else w for k, w in enumerate(t[at : at + n])]
            want.add((len(docs), i))
            docs.append((len(docs), "\n" + " ".join([noise(20), *passage, noise(20)]), 0))
    df = spark.createDataFrame(docs, DOCS)
    got = {tuple(r) for r in find_leaks(df, spark.read.parquet("/root/testdata/sf0.1/eval_items.parquet")).collect()}
    assert len(got & want) >= 0.9 * len(want)
    assert len(got - want) <= 0.02 * len(got)


def test_fold():
    assert fold("Ｈéllo​ Wörld") == "hello world"
    assert words("Don't <x> 3,5") == ["don", "t", "x", "3", "5"]
