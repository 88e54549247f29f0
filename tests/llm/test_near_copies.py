"""Near copies against brute force over exact five-word similarities."""

import random

import corpus_pipeline
from tierloom.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(pairs, similarity=0.8):
    sets = []
    for _, t in pairs:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(pairs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(pairs)):
        for b in range(a):
            shared, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if shared >= similarity * either - 1e-9:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(pairs):
        least[root(k)] = min(i, least.get(root(k), i))
    return sorted(least.values())


def edited(words, r, n):
    words = list(words)
    for k in r.sample(range(len(words)), n):
        words[k] = f"new{r.random()}"
    return words


def near_corpus():
    r = random.Random(11)
    base = [[f"w{r.randint(0, 900)}" for _ in range(r.randint(60, 300))] for _ in range(40)]
    texts = [" ".join(w) for w in base]
    texts += [" ".join(edited(w, r, max(1, len(w) * k // 200))) for w in base for k in (2, 3, 4, 5, 7)]
    texts += [" ".join(edited(base[0], r, 3)) for _ in range(60)]  # a crowd around one text
    chain = base[1]
    for _ in range(6):
        chain = edited(chain, r, 2)
        texts.append(" ".join(chain))
    texts += ["a b c", "A  b\tc", "a b d", "", None, " \n", texts[3], texts[3].upper()]
    order = list(range(len(texts)))
    r.shuffle(order)
    return [(i, texts[k]) for i, k in enumerate(order)]


def test_near_copies_of_the_pipeline(spark):
    pairs = near_corpus()
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in [*pairs, pairs[5]]], SCHEMA).repartition(3)
    want = brute(pairs)
    kept = corpus_pipeline.near_dedup(spark, frame, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == want and kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in near_copies.drop_near_copies(frame, lanes=3).collect()) == want
    assert not corpus_pipeline.near_dedup(spark, frame.limit(0), "").count()


def test_rows_without_ids_stay_once_where_their_own_component_has_none(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    frame = spark.createDataFrame([(None, a, "en", "s", 0), (None, a + " x", "en", "s", 0), (None, b, "en", "s", 0), (7, b, "en", "s", 0)], SCHEMA)
    assert sorted((r["doc_id"] or 0, r["text"][0]) for r in near_copies.drop_near_copies(frame).collect()) == [(0, "a"), (7, "b")]
