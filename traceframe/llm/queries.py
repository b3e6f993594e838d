"""Registered queries of this subpackage and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from traceframe.llm import bpe, exact_dedup, html_extraction, lm_scoring, near_dedup, neighbour_graph, packing, quality_classifier, quality_rules, spelling_variants, substring_dedup, vector_codes, warc
from traceframe.llm.columns import table
from traceframe.llm.folders import scratch


def vocabulary() -> str:
    """The tokenizer file of the contracts."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, folder, "documents"))


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.groups(table(spark, folder, "documents"))


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_classifier.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), vocabulary())


def op5_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_extraction.extract(table(spark, folder, "pages"))


def op6_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scoring.score(table(spark, folder, "documents"))


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "archives")
    warc.write_archives(table(spark, folder, "pages"), path)
    return warc.captures_of(warc.assemble(warc.read_records(spark, path)))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.decide(table(spark, folder, "documents"))


def op9_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, folder, "documents"))


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(table(spark, folder, "documents"), vocabulary())


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants.variants(table(spark, folder, "documents"))


def op12_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbour_graph.nearest(table(spark, folder, "embeddings"))


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.codes(table(spark, folder, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_exact_dedup, op3_quality_classifier, op4_packing, op5_html_extraction, op6_lm_scoring, op7_warc, op8_quality_rules, op9_near_dedup, op10_bpe,
        op11_spelling_variants, op12_nearest_neighbours, op13_vector_codes)}


def oracles() -> dict[str, str]:
    return {"op2_exact_dedup": EXACT_SQL, "op8_quality_rules": RULES_SQL, "op13_vector_codes": CODES_SQL}


EXACT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS normal FROM documents),
g AS (
  SELECT normal, count(*) AS n, first(doc_id ORDER BY length(t) DESC, doc_id) AS keep_id FROM d GROUP BY normal)
SELECT doc_id, keep_id, n AS group_size, doc_id = keep_id AS kept, sha256(normal) AS text_sha256 FROM d JOIN g USING (normal)
"""

RULES_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
seq AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
win AS (
  SELECT doc_id, i, word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p || ' ' || lead(word, 3) OVER p || ' ' || lead(word, 4) OVER p AS g
  FROM seq WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win WHERE g IS NOT NULL) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, source, raw, trim(regexp_replace(regexp_replace(lower(raw), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), '[1-9]', '0', 'g'), ' ') AS line
  FROM (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS raw FROM d)),
real AS (SELECT *, md5(line) AS h FROM lines WHERE line <> ''),
dup AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n_dup_lines FROM real GROUP BY doc_id),
low AS (SELECT doc_id, list_sort(list(DISTINCT h)) AS m FROM real GROUP BY doc_id),
rests AS (
  SELECT DISTINCT coalesce(source, chr(1)) AS host, h, coalesce(CASE WHEN h = m[1] THEN m[2] ELSE m[1] END, '') AS rest
  FROM real JOIN low USING (doc_id)),
hot AS (SELECT host, h FROM rests GROUP BY host, h HAVING count(*) > 100),
gone AS (
  SELECT doc_id, sum(len(string_split(line, ' '))) AS n_removed_words
  FROM real JOIN hot ON real.h = hot.h AND coalesce(source, chr(1)) = hot.host GROUP BY doc_id),
f AS (
  SELECT d.doc_id, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_removed_words, 0) AS n_removed_words
  FROM d JOIN w USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
    AND NOT (n_words - n_removed_words < 10 OR 100 * (n_words - n_removed_words) < 30 * n_words) AS kept
FROM f
"""

CODES_SQL = r"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda y: CAST(floor(256 * CAST(y AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0),
x AS MATERIALIZED (
  SELECT vec_id, part, e[part * len(e) // 16 + 1 : (part + 1) * len(e) // 16] AS v FROM kept, (SELECT unnest(range(16)) AS part)),
c0 AS MATERIALIZED (
  SELECT part, entry, v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 64) USING (vec_id)),
a1 AS (
  SELECT x.vec_id, x.part, arg_min(c.entry, d.far * 64 + c.entry) AS entry
  FROM x JOIN c0 c USING (part), LATERAL (SELECT list_sum(list_transform(generate_series(1, len(x.v)), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i]))) AS far) d
  GROUP BY x.vec_id, x.part),
m1 AS (
  SELECT part, entry, list(mean ORDER BY pos) AS v
  FROM (SELECT part, entry, pos, sum(y) // count(*) - CASE WHEN sum(y) < 0 AND sum(y) % count(*) <> 0 THEN 1 ELSE 0 END AS mean
    FROM (SELECT part, entry, unnest(v) AS y, generate_subscripts(v, 1) AS pos FROM x JOIN a1 USING (vec_id, part)) GROUP BY part, entry, pos)
  GROUP BY part, entry),
c1 AS MATERIALIZED (SELECT part, entry, coalesce(m.v, c.v) AS v FROM c0 c LEFT JOIN m1 m USING (part, entry)),
a2 AS (
  SELECT x.vec_id, x.part, arg_min(c.entry, d.far * 64 + c.entry) AS entry
  FROM x JOIN c1 c USING (part), LATERAL (SELECT list_sum(list_transform(generate_series(1, len(x.v)), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i]))) AS far) d
  GROUP BY x.vec_id, x.part),
m2 AS (
  SELECT part, entry, list(mean ORDER BY pos) AS v
  FROM (SELECT part, entry, pos, sum(y) // count(*) - CASE WHEN sum(y) < 0 AND sum(y) % count(*) <> 0 THEN 1 ELSE 0 END AS mean
    FROM (SELECT part, entry, unnest(v) AS y, generate_subscripts(v, 1) AS pos FROM x JOIN a2 USING (vec_id, part)) GROUP BY part, entry, pos)
  GROUP BY part, entry),
c2 AS MATERIALIZED (SELECT part, entry, coalesce(m.v, c.v) AS v FROM c1 c LEFT JOIN m2 m USING (part, entry)),
f AS (
  SELECT x.vec_id, x.part, min(d.far * 64 + c.entry) AS best
  FROM x JOIN c2 c USING (part), LATERAL (SELECT list_sum(list_transform(generate_series(1, len(x.v)), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i]))) AS far) d
  GROUP BY x.vec_id, x.part),
codes AS (
  SELECT vec_id, string_agg(lpad(lower(to_hex(CAST(best % 64 AS BIGINT))), 2, '0'), '' ORDER BY part) AS code, CAST(sum(best // 64) AS BIGINT) AS error
  FROM f GROUP BY vec_id),
hash AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM codes JOIN kept USING (vec_id), hash
"""
