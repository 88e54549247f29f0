"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary texts. As most of a toxic text is
ordinary too, both are first freed of the words that a sample of ordinary text compresses away. Every
window of a text is compressed with both; the bytes that the toxic dictionary saves, over a threshold
calibrated on documents which neither dictionary has seen, make the score. Training reads a bounded sample
of labelled rows (`FIT_ROWS`, `FIT_CHARS`); scoring reads every window of every text.

Defined cases: a null text is empty and scores as a text without toxic windows; without labels of both
kinds every score is the share of toxic labels (0 if there are none); repeated rows score alike; null
doc_ids are never held out; an empty table gives no rows. Only doc_id and text are read from the
documents, and doc_id decides only held_out.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dense
from .common import batched, rows

#: Labelled rows that training reads, by label, and the longest text among them.
FIT_ROWS = {1: 4000, 0: 7000}
FIT_CHARS = 40_000
#: Least bytes of a window; it ends at the next space.
WINDOW = 20
#: Bytes of each trained dictionary, and the segments that the trainer picks (their length, and what it counts).
DICTIONARY_BYTES = 1024
_SEGMENT, _COUNTED = 12, 6
#: Ordinary text, at most, that explains words away before training.
EXPLAINING_BYTES = 4_000_000
#: A word is left for training where it takes so many bytes more than its own among the explaining text.
_SURPRISE = 2
#: Shorter words are no match for the compressor, with or without the text that explains them.
_LEAST_WORD = 4
#: Ends both dictionaries, opens every window and closes it: a block is then always compressed, its length shows
#: savings that would not pay for a block's headers, and matches are found up to the window's own end.
_PRIMER = bytes(range(1, 25))


@dataclass
class Model:
    """Both dictionaries, the calibrated window threshold and the score's coefficients."""

    toxic: bytes
    ordinary: bytes
    threshold: int
    weights: list[float]
    prior: float


def windows(text: str | None) -> list[bytes]:
    """Consecutive windows of a text in lower case, each at least WINDOW bytes but the last."""
    data = (text or "").lower().encode()
    out, at, find = [], 0, data.find
    while at < len(data):
        end = find(b" ", at + WINDOW)
        if end < 0 or end > at + 8 * WINDOW:  # no space near: cut inside the run
            end = min(len(data), at + (8 * WINDOW if end > 0 or len(data) - at > 8 * WINDOW else len(data)))
        out.append(data[at:end])
        at = end
    return out


def _compressor(content: bytes, window_log: int = 16, hash_log: int = 14) -> Callable[[bytes], bytes]:
    """Compression with a dictionary; short matches say nothing about a passage, so they have at least five bytes."""
    parameters = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, window_log=window_log, hash_log=hash_log, chain_log=hash_log, search_log=4, min_match=5, target_length=64, strategy=zstandard.STRATEGY_LAZY, write_content_size=False
    )
    d = zstandard.ZstdCompressionDict(content + _PRIMER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=parameters).compress


def _framed(window: bytes) -> bytes:
    return _PRIMER + window + _PRIMER


class Comparer:
    """Compression lengths of windows under the two dictionaries."""

    def __init__(self, model: Model):
        self.model = model
        self.compress = [_compressor(content) for content in (model.ordinary, model.toxic)]

    def savings(self, text: str | None) -> list[int]:
        """Bytes that the toxic dictionary saves over the ordinary one, by window."""
        ordinary, toxic = self.compress
        return [len(ordinary(w)) - len(toxic(w)) for w in map(_framed, windows(text))]

    def features(self, text: str | None) -> list[float]:
        """What the score sees: the largest saving, and the savings that reach the threshold."""
        saved = self.savings(text)
        over = [s for s in saved if s >= self.model.threshold]
        top = max(saved, default=0)
        return [1.0, float(min(max(top, 0), 12)), float(top >= self.model.threshold), math.log1p(sum(over)), math.log1p(sum(over)) - math.log1p(len(saved)) / 4 if over else 0.0]

    def score(self, text: str | None) -> float:
        """Likelihood of label 1, between 0 and 1."""
        if not self.model.weights:
            return self.model.prior
        z = sum(a * b for a, b in zip(self.features(text), self.model.weights, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _without_copies(samples: list[tuple[str, int, bool]]) -> list[tuple[str, int, bool]]:
    """The first of every group of near copies, by shared smallest shingle hashes: a copied passage is one witness."""
    seen: dict[int, int] = {}
    out = []
    for number, sample in enumerate(samples):
        w = sample[0].lower().encode().split()
        sketch = sorted({zlib.crc32(b" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))})[:12]
        shared = Counter(seen[h] for h in sketch if h in seen)
        if not shared or max(shared.values()) < max(2, len(sketch) // 3):
            out.append(sample)
            for h in sketch:
                seen.setdefault(h, number)
    return out


def _explaining(texts: list[str]) -> bytes:
    """The texts up to EXPLAINING_BYTES, in an order that their content decides."""
    out, size = [], 0
    for data in sorted((t.lower().encode() for t in texts), key=lambda d: (zlib.crc32(d), d)):
        out.append(data[: EXPLAINING_BYTES - size])
        size += len(out[-1])
        if size >= EXPLAINING_BYTES:
            break
    return b" ".join(out)


def _unexplained(texts: list[str], explaining: bytes) -> list[bytes]:
    """What the explaining text does not compress, text by text; most of any text is ordinary, also of toxic ones."""
    compress, known = _compressor(explaining, 24, 20), {}
    least = len(compress(_framed(b"")))
    out = []
    for text in texts:
        left = []
        for w in text.lower().encode().split():
            kept = known.get(w)
            if kept is None:
                kept = known[w] = _LEAST_WORD <= len(w) <= 8 * WINDOW and len(compress(_framed(b" " + w + b" "))) - least >= len(w) + 2 + _SURPRISE
            if kept:
                left.append(w)
        out.append(b" ".join(left))
    return [x for x in out if x]


def _dictionary(texts: list[bytes]) -> bytes:
    """A zstandard dictionary trained on texts; where they are too few to train on, they are it themselves."""
    samples = [t for t in texts if len(t) >= 8]  # the trainer takes no shorter ones
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=_SEGMENT, d=_COUNTED).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(texts)[-DICTIONARY_BYTES:]


def train(samples: list[tuple[str, int, bool]]) -> Model:
    """Dictionaries from the first part of labelled texts, threshold and score from the other.

    ``samples`` holds (text, label, whether it is kept for calibration), in any order.
    """
    samples = sorted(samples)
    fit, rest = [s for s in samples if not s[2]], [s for s in samples if s[2]]
    labels = [y for _, y, _ in samples]
    fit = _without_copies(fit)
    prior = sum(labels) / len(labels) if labels else 0.0
    docs = [sum(1 for _, y, _ in fit if y == k) for k in (0, 1)]
    if not all(docs) or len({y for _, y, _ in rest}) < 2:
        return Model(b"", b"", 0, [], prior)
    ordinary = [t for t, y, _ in fit if not y]
    explaining = _explaining(ordinary[::2])
    trained = [_dictionary(_unexplained(texts, explaining)) for texts in ([t for t, y, _ in fit if y], ordinary[1::2] or ordinary)]
    model = Model(*trained, 1, [], prior)
    comparer = Comparer(model)
    saved = [(max(comparer.savings(t), default=0), y) for t, y, _ in rest]
    total = {y: sum(1 for _, k in saved if k == y) for y in (0, 1)}
    rates = {k: [sum(1 for s, y in saved if y == label and s >= k) / total[label] for label in (0, 1)] for k in range(1, 13)}
    model.threshold = max(rates, key=lambda k: (rates[k][1] - rates[k][0], k))
    x = np.array([comparer.features(t) for t, _, _ in rest])
    model.weights = _logistic(x, np.array([float(y) for _, y, _ in rest]))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Coefficients by Newton's method with a small ridge."""
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 0.5)
    ridge[0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(dense.product(x, w), -30, 30)))
        curved = x * (p * (1 - p))[:, None]
        normal = np.array([dense.product(curved.T, column) for column in x.T])
        step = dense.solve(normal + np.diag(ridge), dense.product(x.T, y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def _remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def fit_toxicity(documents: DataFrame, labels: DataFrame) -> Model:
    """Train on a bounded sample of labelled documents; those with remainder 2 are never read.

    The sample is drawn from the labels alone, so no text is shuffled: at most the FIT_ROWS smallest
    hashes of each label are broadcast to the scan of the documents.
    """
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (_remainder(F.col("doc_id")) != 2))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in FIT_ROWS.items()]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    picked = documents.select("doc_id", "text").where(F.char_length("text") <= FIT_CHARS).join(chosen, "doc_id")
    one = picked.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))  # of a repeated id one text
    got = one.select("text", "toxic", (_remainder(F.col("doc_id")) == 3).alias("rest")).collect()
    return train([(r["text"], r["toxic"], r["rest"]) for r in got])


_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score_toxicity(documents: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every document; one pass, no shuffle."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = (Comparer(model) if model.weights else None)

        def items() -> Iterator[tuple]:
            for batch in batches:
                for doc, text in rows(batch, "doc_id", "text"):
                    yield doc, of.score(text) if of else model.prior

        yield from batched(_SCORES, items())

    scored = documents.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(_remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(documents: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents that score below the threshold, all columns kept."""
    of_schema = documents.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Comparer(model) if model.weights else None
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            mask = [(of.score(t) if of else model.prior) < threshold for t in texts]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return documents.mapInArrow(keep, of_schema)
