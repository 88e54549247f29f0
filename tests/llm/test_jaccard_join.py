"""The Jaccard join against brute force, with every parameter small enough to meet its special cases."""

import random

import numpy as np
import pytest

from tierloom.llm import jaccard_join
from tierloom.llm.simhash_bits import words_of

SCHEMA = "doc_id long, text string, lang string, size long, node string, gram int, a string, label int"


def rows_of(pairs):
    return [(i, t, "en", 1, "x", 2, "y", 3) for i, t in pairs]


def brute(pairs, size=5, percent=80):
    sets = []
    for _, text in pairs:
        words = words_of(text)
        sets.append({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    parent = list(range(len(pairs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(pairs):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted(((doc, len(sets[i]), least.get(root(i))) for i, (doc, _) in enumerate(pairs)), key=str)


def changed(r, words, times):
    words = list(words)
    for _ in range(times):
        at = r.randrange(len(words))
        words[at : at + r.randint(0, 1)] = [f"n{r.randrange(10**6)}"] * r.randint(0, 1)
    return words


@pytest.fixture(scope="module")
def pairs():
    r = random.Random(7)
    base = [[f"w{r.randrange(400)}" for _ in range(r.choice([3, 5, 6, 9, 40, 90, 200]))] for _ in range(40)]
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join(w) for w in base]
    for w in base:
        texts += [" ".join(changed(r, w, r.randint(1, 6))) for _ in range(6)]
    texts += [" ".join(changed(r, base[5] * 3, r.randint(1, 9))) for _ in range(150)]  # one large group
    texts += [" ".join(passage + [f"q{r.randrange(10**6)}" for _ in range(r.randint(2, 30))]) for _ in range(80)]  # one shared passage
    texts += [texts[3], texts[3].upper(), "", " \n", None, "one", "one two", "é 日本 ü", "word " * 3000, "word " * 2990 + "end"]
    r.shuffle(texts)
    return [*enumerate(texts), (None, texts[0]), (None, None), (None, "nothing like it at all here"), (4, texts[4]), (4, "another text of one id")]


@pytest.mark.parametrize(("grams", "least", "lanes"), [(4_000_000, 8, 256), (2000, 2, 8)])
def test_components_equal_brute_force(spark, pairs, grams, least, lanes):
    docs = spark.createDataFrame(rows_of(pairs), SCHEMA).repartition(5)
    got = jaccard_join.jaccard_components(docs, fragment_ngrams=grams, local_least=least, lanes=lanes)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(pairs)


@pytest.mark.parametrize(("shingle", "percent"), [(2, 50), (1, 100)])
def test_other_thresholds(spark, pairs, shingle, percent):
    some = [p for i, p in enumerate(pairs) if i % 3 == 0]
    docs = spark.createDataFrame(rows_of(some), SCHEMA).repartition(3)
    got = jaccard_join.jaccard_components(docs, shingle, percent, fragment_ngrams=5000, lanes=16)
    assert sorted(map(tuple, got.collect()), key=str) == brute(some, shingle, percent)


def test_empty_table_and_only_odd_rows(spark):
    assert jaccard_join.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = [(1, None), (2, ""), (None, None), (None, "a b c d e f"), (None, "a b c d e f")]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows_of(odd), SCHEMA))
    assert sorted(map(tuple, got.collect()), key=str) == brute(odd)


def test_sketch_never_excludes_a_link():
    r = np.random.default_rng(2)
    for _ in range(200):
        base = np.unique(r.integers(0, 1 << 63, r.integers(1, 300), dtype=np.uint64))
        other = np.unique(np.concatenate([base[r.random(len(base)) > 0.1], r.integers(0, 1 << 63, r.integers(0, 20), dtype=np.uint64)]))
        both = [base, other]
        size = np.array([len(x) for x in both])
        sketch = np.array([np.bincount(jaccard_join._bins(x, jaccard_join.SKETCH), minlength=jaccard_join.SKETCH) for x in both], np.int16)
        linked = len(np.intersect1d(*both)) * 100 >= 80 * len(np.union1d(*both))
        near, apart = jaccard_join.least_difference(size, np.zeros(2, int), sketch, 0)
        assert not linked or (1 in near and apart[-1] <= len(np.setxor1d(*both)))


def test_shared_segments_count_texts_not_rows(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c d e f", "a b c d e f", "a b c d e g", "x y"])], "doc_id long, text string").repartition(4)
    packed = jaccard_join.packed_segments(docs, 16, np.empty(0, np.uint64))
    rows = jaccard_join.shared_segments(packed, 16).collect()
    want = jaccard_join.ngrams("a b c d e").astype(np.uint64) & np.uint64((1 << 40) - 1)
    assert [jaccard_join._long(r["grams"]).tolist() for r in rows] == [want.tolist()] * 2
    assert [list(r["ranks"]) for r in rows] == [jaccard_join.ranks_of(np.array([2])).tolist()] * 2


def test_ngrams_are_those_of_the_words():
    r = random.Random(1)
    seen = {}
    for _ in range(300):
        text = " \t\n".join(r.choice(["a", "B", "b", "é", "É", "日本", "x\u00a0y", "q" * 50]) for _ in range(r.randint(0, 30)))
        words = words_of(text)
        want = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        got = jaccard_join.ngrams(text)
        assert len(got) == len(want) and (np.diff(got.astype(object)) > 0).all()
        for gram in want:
            one = jaccard_join.ngrams(" ".join(gram)).tolist()
            assert len(one) == 1 and one[0] in got.tolist() and seen.setdefault(one[0], gram) == gram
    long = "word other " * 200_000
    assert len(jaccard_join.ngrams(long)) == 2
