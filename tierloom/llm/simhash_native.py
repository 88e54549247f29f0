"""Document fingerprints by SimHash, in DataFrame operations alone.

A text's terms are its runs of TERM words; a term weighs as many votes as it occurs. Every term's hash
votes on 64 signed bits. Votes are counted two to a long: bits k and k + 32 of a hash are the
low and high half of one sum, so a document is 32 ordinary sums over its exploded hashes, combined in
the task that read it. Permuted block tables find all fingerprints within a Hamming radius: the bits are
cut into radius + 2 blocks, and whatever lies within the radius agrees on two of them at least, so there is a
table for every two blocks.

Neighbours in id order come from range buckets: a row that opens a bucket is also given to the bucket
before it, and a window over each bucket finds every next row. Bucket bounds are quantiles of the ids within
quantiles of the ids, joined as a table of bounded size.

Defined cases: a null text is empty; a text without terms has fingerprint zero; repeated ids are ordered by
text, and equal rows stand beside each other; null ids come first; a single document is its own next;
an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_ones

#: Words of a term.
TERM = 3
#: Rows of a range bucket, about.
BUCKET_ROWS = 1000
#: Groups of buckets, and the most buckets of a group: their bounds are at most 8 MB. Beyond a billion rows
#: buckets grow, and their windows spill.
GROUPS, GROUP_BUCKETS = 256, 4096


def term_words(text: Column) -> Column:
    """Words of a text in lower case; to be a column of its own before ``term_hashes`` reads it."""
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda x: x != "")


def term_hashes(w: Column, term: int = TERM) -> Column:
    """Hashes of the terms of a column of words, repeats included; fewer words make one term."""
    whole = F.array(F.xxhash64(F.concat_ws(" ", w)))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (term - 1), F.lit(1))), lambda i: F.xxhash64(*[F.try_element_at(w, i + k) for k in range(term)]))
    return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < term, whole).otherwise(runs)


def fingerprint_sums(hash_: Column) -> list[Column]:
    """32 sums of votes, two bits to a long; exact for up to 2^31 terms."""
    pair = F.lit(1 << 32 | 1)
    return [F.sum(F.shiftrightunsigned(hash_, k).bitwiseAND(pair)).alias(f"v{k}") for k in range(32)]


def majority(total: Column) -> Column:
    """The fingerprint from the sums: a bit is 1 where more than half of the votes are."""
    out = F.lit(0).cast("long")
    for k in range(32):
        v = F.col(f"v{k}")
        low, high = v.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(v, 32)
        out = out.bitwiseOR(F.when(low * 2 > total, F.lit(1 << k)).otherwise(F.lit(0).cast("long")))
        bit = (1 << (k + 32)) - (1 << 64 if k == 31 else 0)
        out = out.bitwiseOR(F.when(high * 2 > total, F.lit(bit)).otherwise(F.lit(0).cast("long")))
    return F.coalesce(out, F.lit(0).cast("long"))


def distance(a: Column, b: Column) -> Column:
    """Hamming distance of two fingerprints."""
    return F.bit_count(a.bitwiseXOR(b))


def likeness(a: Column, b: Column) -> Column:
    """The cosine that the share of differing bits stands for; 1 for equal, 0 from half of them on."""
    d = distance(a, b)
    return F.when(d == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.cos(F.lit(3.141592653589793 / 64) * d)))


def range_buckets(documents: DataFrame) -> DataFrame:
    """Every row with its bucket, and the rows that open a bucket in the bucket before it as well.

    Columns: bucket, real (false for those copies), place (order of the copies after the bucket's own
    rows), doc_id, text. Bounds are ids that exist, so the rows that open a bucket are known by their id.
    """
    lowest = -(1 << 63)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest))
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), key.alias("key"))
    size, least = base.agg(F.count("*"), F.min("key")).first()
    buckets = max(1, size // BUCKET_ROWS)
    groups = min(GROUPS, buckets)
    each = min(GROUP_BUCKETS, -(-buckets // groups))
    cuts = lambda n: F.percentile_approx("key", [i / n for i in range(1, n)], 20_000)
    coarse = base.agg(cuts(groups).alias("q")).first()["q"] if groups > 1 else []
    starts = sorted({least if least is not None else lowest, *(coarse or [])})
    starts_ = F.array(*map(F.lit, starts))
    grouped = base.withColumn("group", F.size(F.filter(starts_, lambda b: b <= F.col("key"))))
    own = F.array(F.element_at(starts_, F.col("group")))
    inner = grouped.groupBy("group").agg((cuts(each) if each > 1 else F.array().cast("array<bigint>")).alias("q"))
    bounds = inner.select("group", F.array_sort(F.array_distinct(F.concat(own, "q"))).alias("bounds"))
    every = Window.orderBy("group")  # of GROUPS rows at most
    n = F.sum(F.size("bounds"))
    table = cut(bounds.select("group", "bounds", (n.over(every) - F.size("bounds")).cast("int").alias("offset"), n.over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("int").alias("n_buckets")))
    placed = grouped.join(F.broadcast(table), "group")
    bucket = F.col("offset") + F.size(F.filter("bounds", lambda b: b <= F.col("key"))) - 1
    with_bucket = placed.select(bucket.alias("bucket"), F.array_contains("bounds", F.col("key")).alias("opens"), (F.col("key") == F.lit(starts[0])).alias("first"), "n_buckets", "doc_id", "text")
    place = lambda at, real, number: F.struct(at.alias("bucket"), F.lit(real).alias("real"), F.lit(number).alias("place"))
    before = F.when(F.col("opens") & ~F.col("first"), place(F.col("bucket") - 1, False, 1))
    around = F.when(F.col("first"), place(F.col("n_buckets") - 1, False, 2))
    here = place(F.col("bucket"), True, 0)
    return with_bucket.select(F.explode(F.array_compact(F.array(here, before, around))).alias("at"), "doc_id", "text").select("at.*", "doc_id", "text")


def edited_neighbours(documents: DataFrame) -> DataFrame:
    """Each document beside its edited text: the last quarter is replaced by the start of the next document.

    Columns: bucket, rn (unique within it), real, doc_id, n_chars, text, edited. One shuffle.
    """
    order = Window.partitionBy("bucket").orderBy("place", F.col("doc_id").asc_nulls_first(), "text")
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    seen = range_buckets(documents).select("*", F.lead("text").over(order).alias("next"), F.row_number().over(order).alias("rn"))
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring(F.coalesce("next", F.lit("")), F.lit(1), quarter))
    return seen.select("bucket", "rn", "real", "doc_id", n.cast("long").alias("n_chars"), "text", F.when(F.col("real"), edited).alias("edited"))


def fingerprint_neighbours(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256 and the signed fingerprints fp, edited_fp and next_fp.

    Texts move once, into their range bucket; the votes of a document are summed where it then lies,
    and only sums pass through the second window.
    """
    rows = edited_neighbours(documents).withColumn("sha", F.sha2("edited", 256))
    # The digest goes on as four longs: aggregates over fixed-width columns hash, others sort and spill.
    digest = [F.conv(F.substring("sha", 1 + 16 * i, 16), 16, -10).cast("long").alias(f"sha{i}") for i in range(4)]
    carried = ["real", "doc_id", "n_chars", *[f"sha{i}" for i in range(4)]]
    versions = rows.select("bucket", "rn", "real", "doc_id", "n_chars", *digest, F.posexplode(F.array("text", "edited")).alias("version", "body")).where("body IS NOT NULL")
    worded = versions.withColumn("w", term_words(F.col("body"))).drop("body")
    terms = worded.select("bucket", "rn", *carried, "version", F.explode_outer(term_hashes(F.col("w"))).alias("h"))
    keys = ["bucket", "rn", "version"]
    summed = terms.groupBy(*keys).agg(F.count("h").alias("total"), *fingerprint_sums(F.col("h")), *[F.first(c).alias(c) for c in carried])
    prints = summed.select(*keys, *carried, majority(F.col("total")).alias("fp"))
    paired = prints.groupBy("bucket", "rn").agg(
        F.max(F.when(F.col("version") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("version") == 1, F.col("fp"))).alias("edited_fp"), *[F.max(F.when(F.col("version") == 1, F.col(c)) if c.startswith("sha") else F.col(c)).alias(c) for c in carried]
    )
    order = Window.partitionBy("bucket").orderBy("rn")
    sha = F.concat(*[F.lpad(F.lower(F.hex(f"sha{i}")), 16, "0") for i in range(4)])
    return paired.withColumn("next_fp", F.lead("fp").over(order)).where("real").select("doc_id", "n_chars", sha.alias("edited_sha256"), "fp", "edited_fp", "next_fp")


def within_radius(prints: DataFrame, queries: DataFrame, radius: int) -> DataFrame:
    """(query, fp, distance) for all distinct fingerprints within the radius of each query fingerprint.

    A stated query set meets all fingerprints through permuted block tables, one for every two of radius + 2
    blocks. Both sides are distinct before they are dealt out, so copies of a text count as one; crowded blocks
    are joins that Spark may split.
    """
    edges = [64 * i // (radius + 2) for i in range(radius + 3)]
    blocks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(radius + 2)]
    tables = [a | b for a, b in combinations(blocks, 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in tables]

    def dealt(side: DataFrame, name: str) -> DataFrame:
        return side.select(F.col(name), F.posexplode(F.array(*[F.col(name).bitwiseAND(F.lit(m)) for m in signed])).alias("table", "key"))

    met = dealt(queries.select("query").distinct(), "query").join(dealt(prints.select("fp").distinct(), "fp"), ["table", "key"])
    d = distance(F.col("query"), F.col("fp"))
    # A pair is kept in the first table on which it agrees, so it needs no distinct.
    agrees = F.array_position(F.array(*[F.col("query").bitwiseXOR(F.col("fp")).bitwiseAND(F.lit(m)) == 0 for m in signed]), True)
    return met.where((d <= radius) & (agrees == F.col("table") + 1)).select("query", "fp", d.alias("distance"))


def fingerprint_report(documents: DataFrame, radius: int = 3, every: int = 100) -> DataFrame:
    """Fingerprints of all documents and their edited texts, with likenesses; and, for ids divisible by
    ``every``, how many documents lie within the radius (itself included)."""
    prints = cut(fingerprint_neighbours(documents))
    counts = prints.groupBy("fp").agg(F.count("*").alias("n"))
    asked = prints.where(F.col("doc_id") % every == 0).select(F.col("fp").alias("query"))
    near = cut(within_radius(counts, asked, radius).join(counts, "fp").groupBy("query").agg(F.sum("n").alias("n_within"))).withColumnRenamed("query", "fp")
    hexed = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    # A query fingerprint is near itself, so every query row meets a row of near; copies share theirs, so hot ones are joined apart.
    is_asked = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    rest = prints.where(~is_asked).withColumn("n_within", F.lit(None).cast("long"))
    joined = join_ones(prints.where(is_asked), near, "fp").unionByName(rest)
    return joined.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hexed("fp").alias("fingerprint"),
        hexed("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        "n_within",
    )
