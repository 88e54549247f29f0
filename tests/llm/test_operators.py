"""Corpus operators against brute force and on awkward tables."""

import base64
import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import pytest

from tierloom.llm import decontaminate, packing, secrets, simhash_bits, simhash_native, suffix_dedup, toxicity, transducer, warc, wavelet
from tierloom.llm.components import connected_components
from tierloom.llm.queries import tokenizer_file
from tierloom.llm.token_cache import encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, row string, bucket int, `first` long"
WORDS = "the of and idiot walnut harbour quick lantern signal ridge marble copper willow ember frost".split()


def rows_of(pairs):
    return [(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), "x", "y", 1, 2) for i, t in pairs]


def corpus(seed=1, n=60):
    r = random.Random(seed)
    base = [" ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(r.randint(1, 120))) for _ in range(n)]
    pairs = list(enumerate(base))
    pairs += [(n, base[3]), (n + 1, base[3] + " extra"), (n + 2, ""), (n + 3, None), (n + 4, " \n\t "), (n + 5, "é" * 30 + " naïve 日本語"), (n + 6, "word " * 4000)]
    return pairs + [(5, base[5]), (5, base[5])]


@pytest.fixture(scope="module")
def pairs():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, pairs):
    return spark.createDataFrame(rows_of(pairs), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def with_null_id(spark):
    return spark.createDataFrame(rows_of([(None, "a b c d"), (1, "a b c d"), (None, None), (2, "")]), SCHEMA)


def ids_of(text, path, end):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + end


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_and_counter_equal_the_library(name):
    path = tokenizer_file(name)
    odd = ["", " ", "a  b", "it's 12 o'clock\n\n x \n y", "foo\n bar", "<|endoftext|> x", "naïve İ ſ", "a b", "日本語 テスト", "''s 't'll", "x " * 5, "A,b. C! d?", "\t\tq", "end ", "ab" * 60]
    got = [x.tolist() for x in encoder(path).batch(odd + [None])]
    assert got == [ids_of(t, path, []) for t in [*odd, None]]
    count = transducer.counter(path).count
    for size in (1 << 16, 7):
        assert [count(t, size) for t in odd] == [len(x) for x in got[:-1]]


def test_prefix_scan_is_inclusive():
    assert transducer.prefix_scan(list("abcdefg"), lambda a, b: a + b) == ["a", "ab", "abc", "abcd", "abcde", "abcdef", "abcdefg"]


def test_token_counts(docs, pairs, empty):
    path = tokenizer_file("word_bpe_49k.json")
    got = sorted(map(tuple, transducer.token_counts(docs, path, 50).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), n := len(ids_of(t, path, [])), n > 50) for i, t in pairs), key=str)
    assert got == want and not transducer.token_counts(empty, path).count()
    for chunk_chars in (13, 200):  # long texts by chunks in tasks of their own
        assert sorted(map(tuple, transducer.token_counts(docs, path, 50, chunk_chars).collect()), key=str) == want


def test_chunk_maps_compose_from_any_state():
    of = transducer.counter(tokenizer_file("word_bpe_49k.json"))
    r = random.Random(8)
    parts = ["walnut", "'s", "'", "'re", "'rx", "don't", "-'s", "12", "é", "²x", ". ", " ", "\n", "''ll", "'l", "ab" * 50, "?!"]
    for _ in range(150):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 14)))
        want = len(ids_of(text, tokenizer_file("word_bpe_49k.json"), []))
        assert of.chunkable(text) and of.pieces(text) == want
        state, n = of.text.run(transducer.State(), text)
        assert n + of.text.end(state) == want
        cuts = sorted({0, len(text), *(r.randrange(len(text) + 1) for _ in range(4))})
        chunks = [of.chunk_map(text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        total, reached = of.total(chunks)
        assert total == want and reached == sorted(reached) and len(reached) == len(chunks)
        left, right = of.chunk_map(text[: cuts[1]]), of.chunk_map(text[cuts[1] :])
        for before in ("", "wal", "x'", "x'r", "-", "1"):
            start, _ = of.text.run(transducer.State(), before)
            middle, one = of.apply(left, start)
            end, two = of.apply(right, middle)
            assert of.apply(of.compose(left, right), start) == (end, one + two)


def test_wavelet_matrix_queries():
    r = np.random.default_rng(1)
    for n in (0, 1, 7, 5000):
        ids = r.integers(0, 50, n).astype("<u2")
        m = wavelet.WaveletMatrix.build(ids, 6)
        assert m.all_ids("<u2").tolist() == ids.tolist()
        for p in range(0, n, max(1, n // 40)):
            assert m.access(p) == ids[p]
            assert m.rank(int(ids[p]), p) == int((ids[:p] == ids[p]).sum())
            assert m.select(int(ids[p]), m.rank(int(ids[p]), p)) == p
        assert m.select(51, 0) == -1 and m.rank(63, n) == 0
        every = np.arange(n + 1)
        assert m.access_at(every[:-1]).tolist() == ids.tolist() and all(m.rank_at(k, every).tolist() == [0, *np.cumsum(ids == k).tolist()] for k in (0, 7, 49, 63))


def test_token_shards(docs, pairs, empty, with_null_id):
    path = tokenizer_file("word_bpe_49k.json")
    got = sorted(wavelet.wavelet_digest(docs, path, 1).collect(), key=lambda r: r["start"])
    at, want = 0, []
    for i, t in sorted(pairs, key=lambda p: (p[0], p[1] or "")):
        ids = ids_of(t, path, [1])
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids.count(1)))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    assert not wavelet.wavelet_digest(empty, path, 1).count()
    assert wavelet.wavelet_digest(with_null_id, path, 1).where("doc_id IS NULL").count() == 2


def test_shard_file_round_trip():
    ids = np.arange(1000, dtype="<u2") % 77
    docs, lengths, m = wavelet.open_shard(wavelet.pack_shard([None, 5], [400, 600], ids, 7))
    assert docs == [None, 5] and lengths.tolist() == [400, 600] and m.all_ids("<u2").tolist() == ids.tolist()
    assert [r.tolist() for r in m.ranks] == [m.directory(p).tolist() for p in m.planes] and m.rank(5, 1000) == 13
    with pytest.raises(ValueError):
        wavelet.open_shard(b"x" * 40)


def test_packer_holds_every_piece_and_beats_first_fit():
    r = random.Random(2)
    for draw in (lambda: r.randint(1, 64), lambda: r.choice([20, 22, 31, 64]), lambda: 64):
        lengths = [draw() for _ in range(500)]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        runs = packing.pack_histogram(histogram, 64)
        held = {}
        for run in runs:
            assert sum(run.lengths) <= 64
            for n in run.lengths:
                held[n] = held.get(n, 0) + run.count
        assert held == histogram
        bins = []
        for n in lengths:
            k = next((k for k, b in enumerate(bins) if b + n <= 64), None)
            bins.append(n) if k is None else bins.__setitem__(k, bins[k] + n)
        assert -(-sum(lengths) // 64) <= sum(run.count for run in runs) <= len(bins)
    assert packing.pack_histogram({}, 64) == []


def test_packed_documents(docs, pairs, empty):
    path = tokenizer_file("byte_bpe_50k.json")
    got = packing.pack_documents(docs, path, 2, capacity=128).collect()
    assert sorted(r["doc_id"] for r in got if r["piece"] == 0) == sorted(i for i, _ in pairs)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 128
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for i, t in pairs:
        ids = np.array(ids_of(t, path, [2]), "<u4")
        first = len(ids) % 128 or 128
        edges = [0, *range(first, len(ids) + 1, 128)]
        want = [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
        assert set(want) == set(by_doc[i])
    assert not packing.pack_documents(empty, path, 2).count()


def test_secret_spans(spark, empty):
    texts = ['password: "hunter2hunter2"', "PassWord=short", "AKIAABCDEFGHIJKLMN and AKIA12", "deadbeefdeadbeef0 x", "api_key = abcdefghijkl; token:0123456789abcdef", "ſecret: aaaaaaaaaaaaaa", "", None, "x Zx9Kq2Lm8Tr4Vb6Nn1Pd y", "x Zx9Kq2Lm8Tr4Vb6Nn1Pd z", "q Aa0Bb1Cc2Dd3Ee4Ff5Gg6 q"]
    frame = spark.createDataFrame([(i, t, "en", f"s{i}", 0, "", "", 0, 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r for r in secrets.find_secrets(frame).collect()}
    word = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    for i, t in enumerate(texts):
        t = t or ""
        s = [(m.start(), 0, m.end()) for m in re.finditer(word + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 12]
        s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(s))
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(filter(None, got[i]["spans"].split(",")))
    assert "owned" not in got[8]["spans"] and got[10]["spans"].startswith("owned:2:")
    assert not secrets.find_secrets(empty).count()
    clean = secrets.redact_live_secrets(frame)
    texts_left = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert len(texts_left) == len(texts) and texts_left[0] == "[SECRET]" + '"' and texts_left[8] == texts[8] and texts_left[7] is None
    assert clean.columns == frame.columns


def brute_prints(pairs):
    out = []
    for i, t in pairs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0d]+", low)
        shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
        import xxhash

        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        out.append((i, sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))))
    return out


def test_near_duplicates(docs, pairs, empty, with_null_id):
    got = simhash_bits.near_duplicates(docs).collect()
    prints = brute_prints(pairs)
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        least[root(k)] = min(i, least.get(root(k), i))
    want = sorted((i, f"{fp:016x}", least[root(k)]) for k, (i, fp) in enumerate(prints))
    assert sorted(map(tuple, got)) == want
    assert not simhash_bits.near_duplicates(empty).count() and simhash_bits.near_duplicates(with_null_id).count() == 4
    kept = simhash_bits.drop_near_duplicates(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least.values())) and kept.columns == docs.columns


def test_links_do_not_depend_on_lanes(spark):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(40)]
    values = sorted({b ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 4))) & (1 << 64) - 1 for b in base for _ in range(8)})
    frame = spark.createDataFrame([(simhash_bits._signed(v),) for v in values], "fp long")
    want = {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3}

    def groups(links):
        return {(r["node"], r["component"]) for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}

    truth = groups([(simhash_bits._signed(a), simhash_bits._signed(b)) for a, b in want])
    for lanes in (2, 3, 2048):
        got = [(r["a"], r["b"]) for r in simhash_bits.near_links(frame, 3, lanes).collect()]
        mask = (1 << 64) - 1
        assert all(((a ^ b) & mask).bit_count() <= 3 for a, b in got) and groups(got) == truth


def test_components_of_a_path(spark):
    links = [(i, i + 1) for i in range(200)] + [(900, 901), (5, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 900: 900, 901: 900}


def native_print(text):
    """The same votes in plain Python: Spark's hash of several columns chains their seeds."""
    import xxhash

    w = [x for x in re.split(r"[\x20\x09-\x0d]+", (text or "").lower()) if x]
    hashes = []
    for k in range(max(len(w) - 2, min(len(w), 1))):
        h = 42
        for x in w[k : k + 3] if len(w) > 2 else [" ".join(w)]:
            h = xxhash.xxh64_intdigest(x.encode(), h)
        hashes.append(h)
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in hashes) * 2 > len(hashes))


def like(a, b):
    d = (a ^ b).bit_count()
    return 1.0 if not d else max(0.0, math.cos(math.pi / 64 * d))


@pytest.mark.parametrize(("bucket_rows", "groups"), [(7, 256), (3, 4), (1000, 256)])
def test_native_fingerprints(docs, spark, empty, monkeypatch, bucket_rows, groups):
    pairs = [(i, t) for i, t in corpus(n=40)[:-2]]
    monkeypatch.setattr(simhash_native, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(simhash_native, "GROUPS", groups)
    frame = spark.createDataFrame(rows_of(pairs), SCHEMA).repartition(3)
    got = {r["doc_id"]: r for r in simhash_native.fingerprint_report(frame, every=5).collect()}
    order = sorted(pairs)
    fp = {i: int(got[i]["fingerprint"], 16) for i, _ in order}
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert fp[i] == native_print(t) and int(got[i]["edited_fingerprint"], 16) == native_print(edited)
        assert got[i]["near_edited"] == pytest.approx(like(fp[i], native_print(edited))) and got[i]["near_next"] == pytest.approx(like(fp[i], native_print(nxt)))
        assert got[i]["n_within"] == (sum((fp[i] ^ fp[j]).bit_count() <= 3 for j in fp) if i % 5 == 0 else None)
        assert 0 <= got[i]["near_edited"] <= 1 and (edited != t or got[i]["near_edited"] == 1)
    assert fp[3] == fp[40] and not simhash_native.fingerprint_report(empty).count()
    assert simhash_native.fingerprint_report(docs).count() == docs.count()


def test_native_fingerprints_with_null_ids(with_null_id):
    got = simhash_native.fingerprint_report(with_null_id, every=1).collect()
    assert sorted(((r["doc_id"], r["n_chars"], int(r["fingerprint"], 16)) for r in got), key=str) == sorted([(None, 7, native_print("a b c d")), (1, 7, native_print("a b c d")), (None, 0, 0), (2, 0, 0)], key=str)
    assert {(r["doc_id"], r["n_within"]) for r in got} == {(None, None), (1, 2), (2, 2)}


def brute_windows(pairs, k=50):
    first, out = {}, []
    for i, t in sorted(((i, t or "") for i, t in pairs), key=lambda p: p[0]):
        b = t.encode()
        for s in range(len(b) - k + 1):
            first.setdefault(b[s : s + k], i)
    for i, t in pairs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - k + 1):
            if first[b[s : s + k]] < i:
                gone[s : s + k] = b"\1" * k
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for q, g in enumerate(gone) if g and not (q and gone[q - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2, 20_000])
def test_repeated_windows(spark, hot, empty):
    pairs = corpus(n=30)
    shared = " ".join(f"passage{i}" for i in range(12))
    r = random.Random(7)
    pairs += [(200 + i, f"{r.random()} {shared} {r.random()} " + "ab" * r.randint(0, 90)) for i in range(40)]
    frame = spark.createDataFrame(rows_of(pairs), SCHEMA).repartition(4)
    got = suffix_dedup.repeated_windows(frame, batch_bytes=20_000, hot_docs=hot)
    assert sorted(map(tuple, got.collect())) == sorted(brute_windows(pairs))
    assert not suffix_dedup.repeated_windows(empty).count()


def test_repeated_windows_with_null_and_repeated_ids(spark):
    passage = "a passage of more than fifty bytes that some of the documents share"
    texts = [(None, f"x {passage} one"), (None, f"y {passage} two"), (7, f"z {passage}"), (7, f"{passage} again"), (9, passage * 2), (None, None), (8, "")]
    frame = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)
    got = suffix_dedup.repeated_windows(frame, batch_bytes=40).collect()
    large = 1 << 40
    want = brute_windows([(large if i is None else i, t) for i, t in texts])
    assert sorted(map(tuple, got), key=str) == sorted(((None if w[0] == large else w[0], *w[1:]) for w in want), key=str)
    assert all(r["n_removed"] >= len(passage) for r in got if r["doc_id"] in (9,) or r["doc_id"] is None and r["n_bytes"])


def test_radix_groups_are_the_equal_windows():
    r = np.random.default_rng(4)
    for data, depth in ((np.frombuffer(b"abcabcabcabdabcabc", np.uint8), 4), (r.integers(0, 3, 3000).astype(np.uint8), 9), (np.zeros(70_000, np.uint8), 3), (r.integers(0, 256, 90_000).astype(np.uint8), 2)):
        starts = np.arange(len(data) - depth)
        groups = {tuple(sorted(g.tolist())) for g in suffix_dedup.radix_groups(data, starts, depth)}
        by = {}
        for s in starts.tolist():
            by.setdefault(bytes(data[s : s + depth]), []).append(s)
        assert groups == {tuple(v) for v in by.values() if len(v) > 1}
    assert suffix_dedup.radix_groups(np.zeros(0, np.uint8), np.zeros(0, np.int64), 5) == []


def test_contained_items(spark, docs, pairs, empty):
    item = " ".join(f"bench{i}" for i in range(30))
    broken = item.replace("bench3 ", "other ")
    texts = {0: f"x {item.upper()} y", 1: "some " + broken, 2: " ".join(item.split()[:20]), 3: "alpha, beta", 4: None, 5: ""}
    frame = spark.createDataFrame(rows_of(texts.items()), SCHEMA)
    bench = spark.createDataFrame([(1, item), (2, "Alpha beta"), (3, None), (4, "...")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["containment"] for r in decontaminate.contained_items(frame, bench).collect()}
    assert got == {(0, 1): 1.0, (1, 1): 22 / 26, (3, 2): 1.0}
    kept = decontaminate.drop_contaminated(frame, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 5] and kept.columns == frame.columns
    assert not decontaminate.contained_items(empty, bench).count() and not decontaminate.contained_items(docs, bench.limit(0)).count()


def test_contained_items_by_join_equal_the_broadcast(spark):
    r = random.Random(12)
    word = lambda: f"w{r.randint(0, 30)}"
    items = [" ".join(word() for _ in range(r.choice([1, 2, 4, 9, 30, 60, 150]))) for _ in range(30)] + [None, "...", "w1 w2"]
    items += [items[5]]
    texts = []
    for _ in range(60):
        pieces = [" ".join(word() for _ in range(r.randint(0, 40)))]
        for x in r.sample(items, 2):
            w = (x or "").split()
            for _ in range(len(w) // 40):
                w[r.randrange(len(w))] = "other"
            pieces.append(" ".join(w))
        texts.append(" ".join(pieces))
    pairs = [*enumerate(texts), (None, items[7]), (None, items[7]), (3, texts[3]), (90, None), (91, "")]
    frame = spark.createDataFrame(rows_of(pairs), SCHEMA).repartition(3)
    bench = spark.createDataFrame(list(enumerate(items)) + [(None, items[9])], "item_id long, text string")

    def brute():
        for i, t in pairs:
            tokens = decontaminate.words(t)
            for j, x in [*enumerate(items), (None, items[9])]:
                w = decontaminate.words(x)
                n = min(5, len(w))
                own = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
                both = len(own & {tuple(tokens[k : k + n]) for k in range(len(tokens) - n + 1)})
                if own and both >= 0.8 * len(own) - 1e-9:
                    yield i, j, both, len(own)

    want = sorted(brute(), key=str)
    for block in (10, 1_000_000):
        got = decontaminate.contained_items(frame, bench, block_shingles=block).collect()
        assert sorted(((x["doc_id"], x["item_id"], x["n_shared"], x["n_shingles"]) for x in got), key=str) == want
        kept = decontaminate.drop_contaminated(frame, bench, block_shingles=block)
        hit = {str(i) for i, *_ in want}
        assert sorted(str(x["doc_id"]) for x in kept.collect()) == sorted(str(i) for i, _ in pairs if str(i) not in hit) and kept.columns == frame.columns
    assert len(want) > 40


def test_sketches_ask_for_no_more_than_the_threshold_shows():
    assert [decontaminate.least_shown(n, 0.8) for n in (1, 4, 5, 32)] == [1, 4, 4, 26] and 1 < decontaminate.least_shown(33, 0.8) < 26
    assert [decontaminate.partition_of(n) for n in (1, 2, 3, 4, 5, 9)] == [0, 1, 2, 2, 3, 4]


def test_warc_round_trip(spark):
    html = ["<p>one</p>", "<p>one</p>", None, "", "é" * 40_000, "é" * 40_000, "x"]
    pages = spark.createDataFrame([(i, "u", h, "clash") for i, h in enumerate(html)] + [(6, "u", "x", "c"), (None, "u", "one of its own", "c")], "page_id long, url string, html string, digest string").repartition(3)
    got = sorted(map(tuple, warc.warc_digest(pages).collect()), key=str)
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    first = {1: 0, 3: 2, 5: 4}
    want = [(i, len((h or "").encode()), digest(h), "revisit" if i in first else "response", first.get(i)) for i, h in enumerate(html)]
    want += [want[6], (None, 14, digest("one of its own"), "response", None)]
    assert got == sorted(want, key=str)
    assert not warc.warc_digest(pages.limit(0)).count()


def test_warc_segments_and_framing():
    body = bytes(range(256)) * 50
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(body, 1000)
    records = warc.segments("00000000-0000-0000-0000-000000000001", {"WARC-Type": "response"}, block, 999)
    parsed = list(warc.parse(b"".join(r.written() + b"\r\n\r\n" for r in records)))
    parts = [(int(r.fields["WARC-Segment-Number"]), int(t) if (t := r.fields.get("WARC-Segment-Total-Length")) else None, r.block) for r in reversed(parsed)]
    assert warc.unchunked(warc.reassemble(parts).partition(b"\r\n\r\n")[2]) == body
    for wrong in (parts[1:], parts[:-1], [*parts, parts[0]]):
        with pytest.raises(ValueError):
            warc.reassemble(wrong)
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nab\r\n0\r\n\r\n")


def test_toxicity_learns_and_is_total(spark, empty):
    r = random.Random(3)
    make = lambda bad: " ".join(r.choice(["harbour", "lantern", "marble", "copper", "willow", "ember", "frost", "signal", "ridge", "walnut"]) + r.choice(["", "s", "ed", "ing"]) for _ in range(80)) + (" vile scoundrel" if bad else "")
    rows = [(i, make(i % 4 == 0), "en", "s", 0, "", "", 0, 0) for i in range(800)]
    frame = spark.createDataFrame(rows + [(9001, None, "en", "s", 0, "", "", 0, 0), (9002, "", "en", "s", 0, "", "", 0, 0)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(800)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(frame, labels)
    got = {x["doc_id"]: x for x in toxicity.score_toxicity(frame, model).collect()}
    held = [x for x in got.values() if x["held_out"] and x["doc_id"] < 800]
    assert all(x["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, x in got.items())
    assert sum(x["predicted"] == (x["doc_id"] % 4 == 0) for x in held) > 0.95 * len(held)
    assert got[9001]["score"] == got[9002]["score"] and all(0 <= x["score"] <= 1 for x in got.values())
    assert not toxicity.score_toxicity(empty, model).count()
    none = toxicity.fit_toxicity(frame, labels.limit(0))
    assert {x["score"] for x in toxicity.score_toxicity(frame, none).collect()} == {0.0}
    kept = toxicity.drop_toxic(frame, model)
    assert kept.columns == frame.columns and 550 < kept.count() < 650


def test_rows_without_ids_are_kept(with_null_id):
    key = lambda r: tuple(map(str, r))
    counts = transducer.token_counts(with_null_id, tokenizer_file("word_bpe_49k.json")).collect()
    assert sorted(((r["doc_id"], r["n_bytes"]) for r in counts), key=key) == sorted([(None, 7), (1, 7), (None, 0), (2, 0)], key=key)
    packed = packing.pack_documents(with_null_id, tokenizer_file("byte_bpe_50k.json"), 2).collect()
    assert sorted(str(r["doc_id"]) for r in packed) == ["1", "2", "None", "None"] and len({r["sequence_id"] for r in packed}) == 1
    found = secrets.find_secrets(with_null_id).collect()
    assert sorted(str(r["doc_id"]) for r in found) == ["1", "2", "None", "None"] and all(r["spans"] == "" for r in found)
    model = toxicity.Model(b"", b"", 0, [], 0.25)
    assert sorted((str(r["doc_id"]), r["held_out"], r["score"]) for r in toxicity.score_toxicity(with_null_id, model).collect()) == sorted((str(i), i is not None and zlib.crc32(str(i).encode()) % 4 == 2, 0.25) for i in (None, 1, None, 2))
    assert toxicity.drop_toxic(with_null_id, model).count() == 4


def test_redaction_of_repeated_ids_and_missing_owners(spark):
    secret = "password = Zx9Kq2Lm8Tr4Vb6N"
    pairs = [(1, f"a {secret}"), (1, "b plain"), (None, f"c {secret}x"), (1, f"a {secret}")]
    rows = [(i, t, "en", None, len(t), "x", "y", 1, 2) for i, t in pairs]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = secrets.redact_live_secrets(frame)
    assert got.columns == frame.columns
    assert sorted((str(r["doc_id"]), r["text"], r["fp"], r["n_chars"]) for r in got.collect()) == sorted([("1", "a [SECRET]", "x", 10), ("1", "a [SECRET]", "x", 10), ("1", "b plain", "x", 7), ("None", "c [SECRET]", "x", 10)])


def test_oracles_match(spark):
    duckdb = pytest.importorskip("duckdb")
    from tierloom.llm.queries import ORACLE_SQL, QUERIES

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        got = QUERIES[name](spark, folder)
        want = con.sql(sql)
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
        assert sorted(json.dumps([r[c] for c in columns]) for r in got.collect()) == sorted(json.dumps([r[c] for c in columns]) for r in rows)


def test_repeated_windows_dealt_in_steps(spark):
    pairs = corpus(n=40)
    shared = " ".join(f"passage{i}" for i in range(12))
    pairs += [(300 + i, f"{i} {shared} {i * 7} " + "xy" * (i % 60)) for i in range(30)] + [(900, "one row, again and again, of more than fifty bytes of text")] * 25
    frame = spark.createDataFrame(rows_of(pairs), SCHEMA).repartition(5)
    got = suffix_dedup.repeated_windows(frame, batch_bytes=1500, hot_docs=25, fan=2)
    assert sorted(map(tuple, got.collect())) == sorted(brute_windows(pairs))


def test_bundles_reach_their_destinations(spark):
    import pyarrow as pa

    from tierloom.llm import bundles

    schema = pa.schema([("to", pa.int32()), ("v", pa.int64())])
    assert bundles.widths(1) == [1] and bundles.widths(256) == [1] and bundles.widths(257) == [256, 1] and bundles.widths(17, 4) == [16, 4, 1]
    for fan, destinations in ((2, 37), (3, 9), (4, 100)):
        steps = bundles.widths(destinations, fan)
        rows = lambda s, n=destinations: [((s + i * i) % n, i) for i in range(50)]

        def send(key, t):
            to, v = zip(*rows(key[0].as_py()), strict=True)
            return bundles.bundle(pa.table([to, v], schema=schema), "to", steps[0], key[0].as_py())

        first = spark.range(30).withColumnRenamed("id", "s").groupBy("s").applyInArrow(send, bundles.BUNDLE)
        assert first.groupBy("carrier").count().agg({"count": "max"}).first()[0] <= fan

        def last(key, t):
            found = bundles.unbundle(t, schema)
            return pa.table({"slot": pa.array([key[0].as_py()] * len(found), pa.int32()), "to": found.column("to"), "v": found.column("v")})

        got = bundles.hand_on(first, "to", steps, schema, fan).groupBy("slot").applyInArrow(last, "slot int, to int, v long").collect()
        assert all(r["slot"] == r["to"] for r in got)
        assert sorted((r["to"], r["v"]) for r in got) == sorted(x for s in range(30) for x in rows(s))
    assert bundles.unbundle(bundles.bundle(schema.empty_table(), "to", 1, 0), schema).num_rows == 0


def test_steps_are_even_just_beyond_a_power_of_the_fan():
    """500 destinations in two steps: not two ranges of 256, which would meet in tasks of 128 sources' bytes."""
    from tierloom.llm import bundles

    assert [bundles.balanced(n) for n in (1, 256, 257, 500, 2500, 65536)] == [2, 256, 17, 23, 50, 256]
    for n in (257, 500, 2500, 70_000):
        steps = bundles.widths(n, bundles.balanced(n))
        assert len(steps) == len(bundles.widths(n)) and -(-n // steps[0]) > 0.5 * bundles.balanced(n)


def test_bundles_of_ascending_hashes_are_small():
    import pyarrow as pa

    from tierloom.llm import bundles

    hashes = np.sort(np.random.default_rng(0).integers(0, 1 << 48, 100_000)).astype(np.uint64)
    hashes[-1] = (1 << 64) - 1
    rows = pa.table({"to": pa.array(np.zeros(len(hashes), np.int32)), "hash": hashes})
    held = bundles.bundle(rows, "to", 1, 0)
    assert bundles.unbundle(held, rows.schema).equals(rows)
    assert len(held.column("held")[0].as_py()) < 5.5 * len(hashes)  # 6.4 bytes each before
