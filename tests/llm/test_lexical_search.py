"""The ranked search against a plain computation, with many small shards, ties and awkward rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tierloom.llm import lexical_search

SCHEMA = "doc_id long, text string, item string, score long, rank int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    held = [(i, Counter(t)) for i, x in docs if (t := terms(x))]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        if text is None:
            continue
        scores = []
        for i, c in held:
            m = 25 + 75 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * times * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in Counter(terms(text)).items() if c[t])
            scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(s for s in scores if s[0])[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def docs():
    r = random.Random(11)
    words = [f"w{i}" for i in range(60)] + ["ÉTÉ", "日本", "it's", "A-b", "x_y", "İ", "ſ", "q" * 300]
    texts = [" ".join(r.choices(words, k=r.randint(1, 80))) for _ in range(120)]
    texts += [texts[0]] * 15 + ["", None, " .,;\n", "w1 " * 500, "w2\x00w3", "W1,w2;W3"]
    return [*enumerate(texts), (None, texts[0]), (None, texts[5]), (3, texts[5])]


ITEMS = [(1, "w1 w2 W2 unheard"), (2, "w3, ÉTÉ 日本 été"), (3, ""), (4, None), (5, "!!"), (6, "w1 w2 w3 w4 w5 w6 w7"), (6, "w8"), (1, "w1 w2 W2 unheard"), (None, "qqq w9"), (7, "q" * 300)]


@pytest.mark.parametrize(("shard", "postings", "block"), [(7, 10**6, 10**6), (1000, 90, 40)])
def test_equals_brute_force(spark, docs, shard, postings, block):
    d = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], SCHEMA).repartition(3)
    items = spark.createDataFrame([(i, t, 5, 6) for i, t in ITEMS], "item_id long, text string, doc_id long, rank int")
    got = lexical_search.ranked(d, items, 10, block, shard, postings)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, ITEMS)


def test_terms_equal_the_pattern_over_every_character():
    text = "".join(map(chr, [*range(0x300), 0x3000, 0x1F600])) + "aB9" * 5
    assert [t.decode() for some in lexical_search.terms_of(text) for t in some] == terms(text)
    long = "ab c" * 700_000  # several slices
    assert sum(map(len, lexical_search.terms_of(long))) == len(terms(long))


def test_ties_with_the_last_are_all_weighed():
    shard = lexical_search._Shard(40, 80)
    for i in range(40):
        shard.add(40 - i, "same word")
    postings = lexical_search.Postings(*shard.packed())
    assert [d for d, _ in postings.best([(b"same", 3), (b"none", 9)], 10)] == list(range(1, 11))
    places, impacts = postings.of(b"word")
    assert places.tolist() == list(range(40)) and len(np.unique(impacts)) == 1


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert lexical_search.ranked(none, items).count() == 0
    d = spark.createDataFrame([(1, "w1", "x", 1, 2)], SCHEMA)
    assert lexical_search.ranked(d, items.limit(0)).count() == 0
    assert lexical_search.ranked(d.where("false"), items.where("false")).count() == 0
