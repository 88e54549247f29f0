"""The pipeline whole, and each stage against brute force on what its predecessor kept."""

import random
import re

import corpus_pipeline
from tierloom.llm import secrets
from tierloom.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}" for a in ("har", "lan", "mar", "cop", "wil", "em", "fro", "sig", "rid", "wal") for b in ("bour", "tern", "ble", "per", "low", "ber", "st", "nal", "ge", "nut")]


def make(tmp_path, spark):
    r = random.Random(5)
    prose = lambda n: [r.choice(WORDS) + r.choice(["", "s", "ed"]) for _ in range(n)]
    items = [" ".join(f"bench{k}word{i}" for i in range(12)) for k in range(3)]
    texts = []
    for i in range(600):
        w = prose(r.randint(40, 90))
        if i % 4 == 0:
            for at in r.sample(range(len(w)), 6):
                w[at] = r.choice(["scoundrel", "wretchedly", "despicable"])
        texts.append(" ".join(w))
    clean = [i for i in range(600) if i % 4]
    for i, j in zip(clean[:40:2], clean[1:40:2], strict=True):  # near copies and exact ones
        w = texts[i].split()
        w[-1] = "other"
        texts[j] = " ".join(w) if j % 3 else texts[i]
    for k, i in enumerate(clean[50:56]):
        texts[i] += " " + items[k % 3]
    texts[clean[60]] += " password = Zx9Kq2Lm8Tr4Vb6N end"
    for i in clean[70:90]:
        texts[i] += " token: EXAMPLEKEY123456 end"
    rows = [(i, t, "en", f"src{i % 5}", len(t)) for i, t in enumerate(texts)] + [(None, None, "en", None, 0), (601, "", "en", "src1", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate([*items, None])), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return items


def five(text, pattern=r"\S+"):
    w = re.findall(pattern, (text or "").lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def survivors(rows):
    """The smallest id of each component of texts that share 0.8 of their shingles."""
    sets, parent = [five(r["text"]) for r in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                parent[root(a)] = root(b)
    key = lambda i: (i is None, i)
    least = {}
    for k, r in enumerate(rows):
        least[root(k)] = min(r["doc_id"], least.get(root(k), r["doc_id"]), key=key)
    return sorted(least.values(), key=key)


def ids(rows):
    return sorted((r["doc_id"] for r in rows), key=lambda i: (i is None, i))


def test_every_stage_and_the_whole(spark, tmp_path):
    items = make(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept, rows = [], docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        before = rows
        out = stage(spark, docs, str(tmp_path))
        rows = out.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = spark.createDataFrame(rows, SCHEMA)
        kept.append((name, before, rows))
    stages = {name: (before, after) for name, before, after in kept}

    before, after = stages["toxicity"]
    toxic = {r["doc_id"] for r in before if r["doc_id"] is not None and r["doc_id"] < 600 and r["doc_id"] % 4 == 0}
    gone = set(ids(before)) - set(ids(after))
    assert len(gone & toxic) > 0.95 * len(toxic) and len(gone - toxic) < 0.05 * len(before)

    before, after = stages["simhash_near_dedup"]
    assert ids(after) == survivors(before) and len(after) < len(before)

    before, after = stages["benchmark_decontamination"]
    own = [five(x, r"\w+") for x in items]
    clean = [r for r in before if not any(len(o & five(r["text"], r"\w+")) >= 0.8 * len(o) - 1e-9 for o in own)]
    assert ids(after) == ids(clean) and len(after) < len(before)

    before, after = stages["secret_scans"]
    assert ids(after) == ids(before)
    users = {}
    for r in before:
        text = r["text"] or ""
        base = secrets.base_spans(text)
        for kind, v in {(k, v) for _, k, _, v in [*base, *secrets.wide_spans(text, base)]}:
            users.setdefault(v, []).append((r["doc_id"], r["source"]))

    def live(kind, value):
        repositories, owners = len({d for d, _ in users[value]}), len({o for _, o in users[value]})
        copied = repositories >= secrets.COPIED_REPOSITORIES or min(owners, repositories) >= secrets.COPIED_OWNERS
        return not copied and (kind != "owned" or owners == 1)

    texts = {r["doc_id"]: r for r in after}
    for r in before:
        text = r["text"] or ""
        base = secrets.base_spans(text)
        spans = [(a, b) for a, k, b, v in [*base, *secrets.wide_spans(text, base)] if live(k, v)]
        assert texts[r["doc_id"]]["text"] == secrets.redact(r["text"], spans)
    assert sum("[SECRET]" in (r["text"] or "") for r in after) == 1 and sum("EXAMPLEKEY123456" in (r["text"] or "") for r in after) > 10

    before, after = stages["best_fit_packing"]
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json")).encode
    want = {r["doc_id"]: len(encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in before}
    held, places = {}, {}
    for r in after:
        held[r["doc_id"]] = held.get(r["doc_id"], 0) + r["length"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert held == want
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= -(-sum(want.values()) // 1024) * 1.1 + 1

    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["piece"], r["length"], r["ids_crc32"]) for r in whole) == sorted((str(r["doc_id"]), r["piece"], r["length"], r["ids_crc32"]) for r in after)
