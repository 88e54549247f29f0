"""Queries of the corpus statistics and their oracles."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F

from ..operators import corpus as c
from .adapters import MARKED, MARKER_RULES, TOKENS, marked, tokens


def _marked(spark, sf_dir):
    return c.add_flags(marked(spark, sf_dir))


def _tokens(spark, sf_dir):
    return c.add_flags(tokens(spark, sf_dir))


def _of(source, operator):
    @wraps(operator)
    def query(spark, sf_dir):
        return operator(source(spark, sf_dir))

    return query


def _index(spark, sf_dir):
    rows = marked(spark, sf_dir)
    return rows.groupBy("source_file", "region_code").agg(F.sum(F.col("time_end").cast("long") - F.col("time_start").cast("long")).cast("double").alias("duration_ms"))


def _summary(spark, sf_dir):
    return c.summary(_marked(spark, sf_dir), _index(spark, sf_dir))


def _per_file(spark, sf_dir):
    rows = marked(spark, sf_dir)
    durations = rows.select("source_file", (F.col("time_end").cast("long") - F.col("time_start").cast("long")).alias("duration_ms"), (F.col("l_linenumber") * 1000000 + F.col("time_end").cast("long") - F.col("time_start").cast("long")).alias("ordinal"))
    return c.per_file(_marked(spark, sf_dir), durations)



QUERIES = {
    "flags_partition": _of(_marked, c.flag_counts),
    "corpus_summary": _summary,
    "key_counts": _of(_marked, c.key_counts),
    "per_file": _per_file,
    "gloss_statistics": _of(_tokens, c.gloss_statistics),
    "gloss_statistics_for_regions": _of(_tokens, lambda f: c.gloss_statistics(f, ["EN", "fr"])),
    "top_glosses": _of(_tokens, lambda f: c.top_glosses(c.gloss_statistics(f), 100, 5)),
    "top_glosses_all": _of(_tokens, lambda f: c.top_glosses(c.gloss_statistics(f), 0, 2)),
    "coverage_table": _of(_tokens, c.coverage_table),
    "class_sizes": _of(_tokens, lambda f: c.class_sizes(c.gloss_statistics(f))),
    "coverage_curve": _of(_tokens, lambda f: c.coverage_curve(c.gloss_statistics(f))),
    "coverage_curve_full": _of(_marked, lambda f: c.coverage_curve_full(c.gloss_statistics(f))),
    "signer_balance": _of(_marked, c.signer_balance),
    "duration_distribution": _of(_marked, c.duration_distribution),
    "signing_rate": _of(_marked, c.signing_rate),
    "split_feasibility": _of(_marked, c.split_feasibility),
    "examples_per_signer": _of(_tokens, c.examples_per_signer),
    "marker_cooccurrence": _of(_marked, c.marker_cooccurrence),
}

_PRESENT = [k for k in c.MARKERS if k in MARKER_RULES]
_LONG = " UNION ALL ".join(f"SELECT region_code, speaker_id, '{k}' AS key, {k} AS value FROM marked WHERE is_parsed AND {k} <> ''" for k in _PRESENT)
_KINDS = ", ".join(f"('{k}', '{'blocking' if k in c.BLOCKING else 'linguistic'}')" for k in _PRESENT)
_TAG = "CASE WHEN grouping(region_code) = 1 THEN 'GLOBAL' ELSE region_code END AS tag"
_STATS = """stats AS (
  SELECT lexical_item AS gloss, count(*) AS occurrences, count(DISTINCT speaker_id) AS n_signers, count(DISTINCT source_file) AS n_files,
    string_agg(DISTINCT region_code, ';' ORDER BY region_code) AS regions, count(DISTINCT region_code) AS n_regions
  FROM {src} GROUP BY lexical_item)"""
_TOKEN_STATS = f"WITH {TOKENS}, {_STATS.format(src='tokens')}"
_MARKED_STATS = f"WITH {MARKED}, {_STATS.format(src='(SELECT * FROM marked WHERE is_parsed AND has_lexical)')}"
_UNITS = "SELECT 'all parsed' AS unit, ms FROM m UNION ALL SELECT 'lexical_item (no marker)', ms FROM m WHERE lexical_only" + "".join(f" UNION ALL SELECT '{k}', ms FROM m WHERE {k} <> ''" for k in _PRESENT)
_SPECS = ", ".join(f"('{a}', {n}, {s})" for a, n, s in c.COVERAGE_SPECS)
_PAIRS = [(a, b) for i, a in enumerate(_PRESENT) for b in _PRESENT[i + 1 :]]

ORACLE_SQL = {
    "flags_partition": f"""WITH {MARKED} SELECT CASE WHEN is_compound THEN 'compound' WHEN is_ambiguous THEN 'ambiguous' WHEN lexical_only THEN 'lexical_only'
      WHEN lexical_with_key THEN 'lexical_with_key' WHEN key_only THEN 'key_only' ELSE 'empty_row' END AS shape, count(*) AS n, CAST(sum(n_keys) AS BIGINT) AS n_keys,
      count(*) FILTER (WHERE has_blocking_key) AS n_blocking FROM marked GROUP BY 1""",
    "corpus_summary": f"""WITH {MARKED}, main AS (SELECT {_TAG}, count(DISTINCT source_file) AS n_files_parsed, count(DISTINCT speaker_id) AS n_signers, count(*) AS n_annotations,
      count(*) FILTER (WHERE is_parsed) AS n_parsed, count(*) FILTER (WHERE is_ambiguous) AS n_ambiguous, count(*) FILTER (WHERE is_compound) AS n_compound,
      count(DISTINCT annotation) FILTER (WHERE is_parsed) AS n_unique_annotation_strings, count(*) FILTER (WHERE is_parsed AND has_lexical) AS n_with_lexical,
      count(*) FILTER (WHERE lexical_only) AS n_lexical_only, count(*) FILTER (WHERE key_only) AS n_key_only, count(*) FILTER (WHERE lexical_with_key) AS n_lexical_with_key,
      count(*) FILTER (WHERE empty_row) AS n_empty FROM marked GROUP BY GROUPING SETS ((), (region_code))),
    items AS (SELECT {_TAG}, lexical_item, count(*) AS n FROM marked WHERE is_parsed AND has_lexical GROUP BY GROUPING SETS ((lexical_item), (lexical_item, region_code))),
    words AS (SELECT tag, count(*) AS n_unique_lexical_items, count(*) FILTER (WHERE n = 1) AS n_lexical_items_occurring_once FROM items GROUP BY tag),
    files AS (SELECT source_file, region_code, CAST(sum(end_ms - start_ms) AS DOUBLE) AS duration_ms FROM marked GROUP BY ALL),
    idx AS (SELECT {_TAG}, count(*) AS n_files_elan_matched, sum(duration_ms) AS total_recording_ms FROM files GROUP BY GROUPING SETS ((), (region_code)))
    SELECT *, n_annotations / (total_recording_ms / 60000e0) AS annotations_per_minute, 100e0 * n_parsed / greatest(n_annotations, 1) AS parsed_percent,
      100e0 * n_ambiguous / greatest(n_annotations, 1) AS ambiguous_percent, 100e0 * n_compound / greatest(n_annotations, 1) AS compound_percent,
      100e0 * n_lexical_only / greatest(n_parsed, 1) AS lexical_only_percent, 100e0 * n_key_only / greatest(n_parsed, 1) AS key_only_percent,
      100e0 * n_lexical_items_occurring_once / greatest(n_unique_lexical_items, 1) AS hapax_percent_of_vocabulary
    FROM main JOIN words USING (tag) JOIN idx USING (tag)""",
    "key_counts": f"""WITH {MARKED}, long AS ({_LONG}), n AS (SELECT {_TAG}, key, count(*) AS n_annotations, count(DISTINCT speaker_id) AS n_signers, count(DISTINCT value) AS n_unique_values
      FROM long GROUP BY GROUPING SETS ((key), (key, region_code))), t AS (SELECT {_TAG}, count(*) AS n_total FROM marked WHERE is_parsed GROUP BY GROUPING SETS ((), (region_code)))
    SELECT tag, k.key, k.kind, coalesce(n_annotations, 0) AS n_annotations, 100e0 * coalesce(n_annotations, 0) / greatest(n_total, 1) AS percent_of_parsed, coalesce(n_signers, 0) AS n_signers, coalesce(n_unique_values, 0) AS n_unique_values
    FROM t CROSS JOIN (VALUES {_KINDS}) AS k(key, kind) LEFT JOIN n USING (tag, key)""",
    "per_file": f"""WITH {MARKED} SELECT source_file, min(region_code) AS region_code, count(DISTINCT speaker_id) AS n_signers, count(*) AS n_annotations, count(*) FILTER (WHERE is_parsed) AS n_parsed,
      count(*) FILTER (WHERE is_ambiguous) AS n_ambiguous, count(*) FILTER (WHERE is_compound) AS n_compound, count(DISTINCT lexical_item) FILTER (WHERE is_parsed AND has_lexical) AS n_unique_lexical_items,
      100e0 * count(*) FILTER (WHERE is_ambiguous) / greatest(count(*), 1) AS ambiguous_percent, arg_max(end_ms - start_ms, l_linenumber * 1000000 + end_ms - start_ms) AS duration_ms FROM marked GROUP BY source_file""",
    "gloss_statistics": f"{_TOKEN_STATS} SELECT *, occurrences / CAST(n_signers AS DOUBLE) AS occurrences_per_signer FROM stats",
    "gloss_statistics_for_regions": f"WITH {TOKENS}, {_STATS.format(src='(SELECT * FROM tokens WHERE upper(region_code) IN (' + chr(39) + 'EN' + chr(39) + ', ' + chr(39) + 'FR' + chr(39) + '))')} SELECT *, occurrences / CAST(n_signers AS DOUBLE) AS occurrences_per_signer FROM stats",
    "top_glosses": f"""{_TOKEN_STATS} SELECT *, occurrences / CAST(n_signers AS DOUBLE) AS occurrences_per_signer, CAST(row_number() OVER (ORDER BY occurrences DESC, n_signers DESC, gloss) AS INT) AS rank
      FROM stats WHERE n_signers >= 5 QUALIFY rank <= 100""",
    "top_glosses_all": f"""{_TOKEN_STATS} SELECT *, occurrences / CAST(n_signers AS DOUBLE) AS occurrences_per_signer, row_number() OVER (ORDER BY occurrences DESC, n_signers DESC, gloss) AS rank
      FROM stats WHERE n_signers >= 2""",
    "coverage_table": f"""WITH {TOKENS}, s AS (SELECT {_TAG}, lexical_item AS gloss, count(*) AS occurrences, count(DISTINCT speaker_id) AS n_signers FROM tokens GROUP BY GROUPING SETS ((lexical_item), (lexical_item, region_code))),
      t AS (SELECT tag, sum(occurrences) AS corpus_tokens FROM s GROUP BY tag), g(label, top_n, floor_) AS (VALUES {_SPECS}),
      r AS (SELECT *, row_number() OVER (PARTITION BY tag, label ORDER BY occurrences DESC, n_signers DESC, gloss) AS rk FROM s, g WHERE n_signers >= floor_),
      k AS (SELECT tag, label, count(*) AS n_glosses, min(occurrences) AS occurrences_min, max(occurrences) AS occurrences_max, max(least(occurrences, 500)) AS occurrences_max_capped, CAST(sum(occurrences) AS BIGINT) AS total_occurrences,
        CAST(sum(least(occurrences, 500)) AS BIGINT) AS total_occurrences_capped, min(n_signers) AS signers_min, max(n_signers) AS signers_max FROM r WHERE top_n = 0 OR rk <= top_n GROUP BY tag, label)
    SELECT t.tag AS scope, g.label AS "group", CAST(floor_ AS BIGINT) AS min_signers, CAST(500 AS BIGINT) AS cap, coalesce(n_glosses, 0) AS n_glosses, coalesce(occurrences_min, 0) AS occurrences_min, coalesce(occurrences_max, 0) AS occurrences_max,
      coalesce(occurrences_max_capped, 0) AS occurrences_max_capped, coalesce(total_occurrences, 0) AS total_occurrences, coalesce(total_occurrences_capped, 0) AS total_occurrences_capped, coalesce(signers_min, 0) AS signers_min,
      coalesce(signers_max, 0) AS signers_max, 100e0 * coalesce(total_occurrences, 0) / greatest(CAST(corpus_tokens AS BIGINT), 1) AS percent_of_corpus_tokens FROM t CROSS JOIN g LEFT JOIN k ON k.tag = t.tag AND k.label = g.label""",
    "class_sizes": f"""{_TOKEN_STATS}, x AS (SELECT CAST(t AS BIGINT) AS min_examples, CAST(s AS BIGINT) AS min_signers FROM (SELECT unnest({list(c.CLASS_SIZES)}) AS t), (SELECT unnest({list(c.SIGNER_FLOORS)}) AS s))
    SELECT min_examples, min_signers, count(*) FILTER (WHERE k) AS n_glosses, CAST(coalesce(sum(occurrences) FILTER (WHERE k), 0) AS BIGINT) AS n_tokens, CAST(coalesce(sum(least(occurrences, 500)) FILTER (WHERE k), 0) AS BIGINT) AS n_tokens_capped,
      100e0 * coalesce(sum(occurrences) FILTER (WHERE k), 0) / sum(occurrences) AS percent_of_tokens, 100e0 * coalesce(sum(least(occurrences, 500)) FILTER (WHERE k), 0) / sum(least(occurrences, 500)) AS percent_of_tokens_capped
    FROM (SELECT *, occurrences >= min_examples AND n_signers >= min_signers AS k FROM stats, x) GROUP BY min_examples, min_signers""",
    "coverage_curve": f"""{_TOKEN_STATS}, f AS (SELECT *, row_number() OVER w AS rank, CAST(sum(occurrences) OVER w AS BIGINT) AS cum, CAST(sum(occurrences) OVER () AS BIGINT) AS total, count(*) OVER () AS n FROM stats
      WINDOW w AS (ORDER BY occurrences DESC, gloss ROWS UNBOUNDED PRECEDING))
    SELECT rank AS vocabulary_size, cum AS n_tokens_covered, 100e0 * cum / total AS percent_covered, 100e0 * (total - cum) / total AS oov_percent, occurrences AS min_occurrences_at_cutoff
    FROM f WHERE rank IN (SELECT least(u, (SELECT count(*) FROM stats)) FROM (SELECT unnest({list(c.COVERAGE_CUTOFFS)} || [(SELECT count(*) FROM stats)]) AS u))""",
    "coverage_curve_full": f"""{_MARKED_STATS} SELECT row_number() OVER w AS rank, gloss, occurrences, n_signers, CAST(sum(occurrences) OVER w AS BIGINT) AS cumulative_tokens, 100e0 * sum(occurrences) OVER w / sum(occurrences) OVER () AS cumulative_percent
      FROM stats WINDOW w AS (ORDER BY occurrences DESC, gloss ROWS UNBOUNDED PRECEDING)""",
    "signer_balance": f"""WITH {MARKED}, n AS (SELECT speaker_id, count(*) AS n_tokens FROM marked WHERE is_parsed GROUP BY 1)
    SELECT row_number() OVER w AS rank, speaker_id, n_tokens, 100e0 * n_tokens / sum(n_tokens) OVER () AS percent_of_tokens, 100e0 * sum(n_tokens) OVER w / sum(n_tokens) OVER () AS cumulative_percent
      FROM n WINDOW w AS (ORDER BY n_tokens DESC, speaker_id ROWS UNBOUNDED PRECEDING)""",
    "duration_distribution": f"""WITH {MARKED}, m AS (SELECT *, CAST(end_ms - start_ms AS DOUBLE) AS ms FROM marked WHERE is_parsed AND end_ms > start_ms), u AS ({_UNITS})
    SELECT unit, count(*) AS n, sum(ms) / count(*) AS mean_ms, {', '.join(f'quantile_cont(ms, {p / 100}) AS p{p}_ms' for p in c.DURATION_PERCENTILES)}, sum(ms) AS total_ms FROM u GROUP BY unit""",
    "signing_rate": f"""WITH {MARKED} SELECT speaker_id AS signer, min(region_code) AS region_code, count(DISTINCT source_file) AS n_files, count(*) AS n_annotations, count(*) FILTER (WHERE is_parsed) AS n_parsed,
      CAST(max(end_ms) - min(start_ms) AS DOUBLE) AS signing_span_ms, CAST(sum(end_ms - start_ms) AS DOUBLE) AS annotated_ms, quantile_cont(CAST(end_ms - start_ms AS DOUBLE), 0.5) AS median_duration_ms,
      count(DISTINCT lexical_item) FILTER (WHERE is_parsed AND has_lexical) AS n_unique_lexical_items, count(*) / (CAST(max(end_ms) - min(start_ms) AS DOUBLE) / 60000e0) AS annotations_per_minute FROM marked GROUP BY speaker_id""",
    "split_feasibility": f"""WITH {MARKED}, r AS (SELECT speaker_id, lexical_item FROM marked WHERE is_parsed AND has_lexical), n AS (SELECT speaker_id, count(*) AS n FROM r GROUP BY 1),
      p AS (SELECT *, coalesce(sum(n) OVER (ORDER BY n, speaker_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (ORDER BY n, speaker_id) AS rk, sum(n) OVER () AS total, count(*) OVER () AS signers FROM n),
      h AS (SELECT *, before < total * 0.2e0 AND rk <= signers - 1 AS is_test FROM p), w AS (SELECT lexical_item, count(*) FILTER (WHERE is_test) AS test, count(*) FILTER (WHERE NOT is_test) AS train FROM r JOIN h USING (speaker_id) GROUP BY 1),
      s AS (SELECT count(*) FILTER (WHERE is_test) AS n_test_signers, count(*) FILTER (WHERE NOT is_test) AS n_train_signers, CAST(coalesce(sum(n) FILTER (WHERE is_test), 0) AS BIGINT) AS n_test, CAST(max(total) AS BIGINT) AS total FROM h),
      x AS (SELECT CAST(unnest([1, 5, 10]) AS BIGINT) AS min_examples), v AS (SELECT min_examples, count(*) FILTER (WHERE train >= min_examples) AS n_train_glosses, count(*) FILTER (WHERE test > 0) AS n_test_glosses,
        count(*) FILTER (WHERE train >= min_examples AND test > 0) AS n_shared_glosses, CAST(coalesce(sum(test) FILTER (WHERE train < min_examples), 0) AS BIGINT) AS oov FROM w, x GROUP BY 1)
    SELECT min_examples, n_test_signers, n_train_signers, 100e0 * n_test / greatest(total, 1) AS test_token_percent, n_train_glosses, n_test_glosses, n_shared_glosses,
      100e0 * (n_test_glosses - n_shared_glosses) / greatest(n_test_glosses, 1) AS oov_gloss_percent, 100e0 * oov / greatest(n_test, 1) AS oov_token_percent FROM v, s""",
    "examples_per_signer": f"""{_TOKEN_STATS}, t AS (SELECT * FROM stats ORDER BY occurrences DESC, n_signers DESC, gloss LIMIT 200), e AS (SELECT gloss, occurrences, n_signers, n_regions, speaker_id, count(*) AS n
      FROM tokens JOIN t ON lexical_item = gloss GROUP BY ALL) SELECT gloss, occurrences, n_signers, n_regions, min(n) AS min_per_signer, quantile_cont(CAST(n AS DOUBLE), 0.5) AS median_per_signer, max(n) AS max_per_signer,
      max(n) / CAST(sum(n) AS DOUBLE) AS max_signer_share FROM e GROUP BY ALL""",
    "marker_cooccurrence": f"WITH {MARKED}, x AS (" + " UNION ALL ".join(f"SELECT '{a}' AS key_a, '{b}' AS key_b, count(*) FILTER (WHERE {a} <> '' AND {b} <> '') AS n_both, count(*) FILTER (WHERE {a} <> '') AS n_a, count(*) FILTER (WHERE {b} <> '') AS n_b FROM marked WHERE is_parsed" for a, b in _PAIRS)
    + ") SELECT *, 100e0 * n_both / greatest(n_a, 1) AS percent_of_a, 100e0 * n_both / greatest(n_b, 1) AS percent_of_b FROM x WHERE n_both > 0",
}
