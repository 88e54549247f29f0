"""Secret scans with corpus-wide ownership frequency.

One scan finds the base kinds and wider candidates in every text. Candidate values are then counted by
distinct repositories and distinct owners over the whole corpus, and both decide: a value in many
repositories, or in several of several owners, is a widely copied example; any other looks live. Wider
candidates that look live and that one owner alone uses become spans of their own (`owned`); the base
spans are never dropped, but told apart. Both counts are returned for every span.

Defined cases: a null text is empty; a null owner or repository counts as one of its own; repeated rows
are scanned as separate rows and count once for ownership; an empty table gives no rows. Only the
named columns are read, so others may clash with any name.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, cut, join_ones, rows

# The base patterns with their least lengths, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # 18 characters with the prefix; runs are maximal either way
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "owned")
_ASSIGN_LEAST = 12
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: A wider candidate is a run of these, mixed of letters and digits and varied enough.
_WIDE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_WIDE_ENTROPY = 3.5
#: From so many distinct repositories on, a value is a widely copied example, whoever owns them.
COPIED_REPOSITORIES = 10
#: From so many distinct owners on, each with a repository of its own, it is one too.
COPIED_OWNERS = 3


def base_spans(text: str) -> list[tuple[int, str, int, str]]:
    """(start, kind, end, value) of the base kinds, by start and then kind as listed."""
    found = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= _ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return [(a, KINDS[k], b, v) for a, k, b, v in sorted(found)]


def wide_spans(text: str, taken: list[tuple[int, str, int, str]]) -> list[tuple[int, str, int, str]]:
    """Varied runs of letters and digits that no base span touches."""
    out = []
    for m in _WIDE.finditer(text):
        v = m[0]
        if not (any(c.isdigit() for c in v) and any(c.isalpha() for c in v)):
            continue
        if any(a < m.end() and m.start() < b for a, _, b, _ in taken):
            continue
        if -sum(n / len(v) * math.log2(n / len(v)) for n in Counter(v).values()) >= _WIDE_ENTROPY:
            out.append((m.start(), "owned", m.end(), v))
    return out


def written(spans: list[tuple[int, str, int]]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2])))


_SCAN = pa.schema(
    [
        ("row", pa.int64()),
        ("doc_id", pa.int64()),
        ("ident", pa.string()),
        ("owner", pa.string()),
        ("repository", pa.string()),
        ("base", pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("stop", pa.int64()), ("hash", pa.binary())]))),
        ("wide", pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("stop", pa.int64()), ("hash", pa.binary())]))),
    ]
)
_SPAN_DDL = "array<struct<start:long,kind:string,stop:long,hash:binary>>"


def scan(documents: DataFrame, owner: str = "source", repository: str = "doc_id", ident: str = "doc_id") -> DataFrame:
    """Spans of every text with the hashes of their values; the texts themselves go no further.

    ``ident`` names a column that is handed through as text.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def items() -> Iterator[tuple]:
            n = 0
            for batch in batches:
                for doc, text, ident_, who, where in rows(batch, "doc_id", "text", "ident", "owner", "repository"):
                    text = text or ""
                    base = base_spans(text)
                    wide = wide_spans(text, base)
                    hashed = [[{"start": a, "kind": k, "stop": b, "hash": hashlib.sha256(v.encode()).digest()} for a, k, b, v in s] for s in (base, wide)]
                    yield part << 40 | n, doc, ident_, who, where, *hashed
                    n += 1

        yield from batched(_SCAN, items(), 5000)

    chosen = documents.select("doc_id", "text", F.col(ident).cast("string").alias("ident"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"))
    return chosen.mapInArrow(find, f"row long, doc_id long, ident string, owner string, repository string, base {_SPAN_DDL}, wide {_SPAN_DDL}")


def ownership(scanned: DataFrame) -> DataFrame:
    """Each candidate hash with its distinct owners and repositories over the whole corpus.

    Both distinct counts are two sums with partial aggregation, so a value in a third of all rows is
    combined before it is shuffled.
    """
    values = scanned.select(F.explode(F.concat("base", "wide")).alias("s"), F.coalesce("owner", F.lit("\0")).alias("owner"), F.coalesce("repository", F.lit("\0")).alias("repository"))
    values = values.select(F.col("s.hash").alias("hash"), "owner", "repository")
    owners = values.select("hash", "owner").distinct().groupBy("hash").agg(F.count("*").alias("owners"))
    repositories = values.select("hash", "repository").distinct().groupBy("hash").agg(F.count("*").alias("repositories"))
    return cut(owners.join(repositories, "hash"))


def looks_live() -> F.Column:
    """Whether a counted span is not widely copied and, for a wider candidate, has one owner alone."""
    copied = (F.col("repositories") >= COPIED_REPOSITORIES) | ((F.col("owners") >= COPIED_OWNERS) & (F.col("repositories") >= COPIED_OWNERS))
    return ~copied & ((F.col("kind") != "owned") | (F.col("owners") == 1))


def find_secrets(documents: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """One row per document with its base spans, all spans, and how many look live or copied.

    span_counts has owners:repositories of each span's value, in the order of spans.
    """
    scanned = cut(scan(documents, owner, repository))
    counted = ownership(scanned)
    spans = scanned.select("row", F.explode(F.concat("base", "wide")).alias("s")).select("row", "s.*")
    judged = join_ones(spans, counted, "hash").withColumn("live", looks_live())
    per_row = judged.groupBy("row").agg(
        F.collect_list(F.when((F.col("kind") != "owned") | F.col("live"), F.struct("start", "kind", "stop", "owners", "repositories"))).alias("shown"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live") & (F.col("kind") != "owned")).alias("n_copied"),
    )
    mine = scanned.select("row", "doc_id", F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))).alias("base"))
    joined = mine.join(per_row, "row", "left")
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])

    def text_of(spans: F.Column, parts: tuple[str, ...] = ("kind", "start", "stop")) -> F.Column:
        keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["stop"].alias("stop"), F.concat_ws(":", *[s[p].cast("string") for p in parts]).alias("text"))))
        return F.array_join(F.transform(keyed, lambda s: s["text"]), ",")

    def count(kind: str) -> F.Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return joined.select(
        "doc_id",
        *map(count, KINDS[:3]),
        F.sha2(text_of(F.col("base")), 256).alias("base_sha256"),
        F.coalesce(text_of(F.col("shown")), F.lit("")).alias("spans"),
        F.coalesce(text_of(F.col("shown"), ("owners", "repositories")), F.lit("")).alias("span_counts"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"),
    )


MARK = "[SECRET]"


def redact(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text with each maximal stretch of overlapping spans replaced by one mark."""
    if not spans or text is None:
        return text
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], MARK]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact_live_secrets(documents: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """All documents; spans whose value looks live are replaced, copied examples stay.

    Columns are those of the documents; an n_chars column follows the new text. A document is found
    again by its id and its text's hash, so rows that share an id keep their own spans.
    """
    keyed = documents.withColumn("__text_key", F.xxhash64("text"))
    scanned = cut(scan(keyed.select("text", F.col("__text_key").alias("doc_id"), keyed["doc_id"].cast("string").alias("__id"), F.col(owner).cast("string").alias("__owner"), F.col(repository).cast("string").alias("__repository")), "__owner", "__repository", "__id"))
    spans = scanned.select("row", F.explode(F.concat("base", "wide")).alias("s")).select("row", "s.*")
    live = join_ones(spans, ownership(scanned), "hash").where(looks_live())
    per_row = live.groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("__spans"))
    found = scanned.join(per_row, "row").groupBy(F.col("doc_id").alias("__key"), F.col("ident").alias("__ident")).agg(F.first("__spans").alias("__spans"))
    same = (keyed["__text_key"] == found["__key"]) & keyed["doc_id"].cast("string").eqNullSafe(found["__ident"])
    joined = keyed.join(found, same, "left").drop("__text_key", "__key", "__ident")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [redact(t, [(s["start"], s["stop"]) for s in spans or ()]) for t, spans in rows(batch, "text", "__spans")]
            columns = {f.name: batch.column(i) for i, f in enumerate(batch.schema) if f.name != "__spans"}
            columns["text"] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    changed = joined.mapInArrow(apply, documents.schema)
    return changed.withColumn("n_chars", F.char_length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in documents.columns else changed
