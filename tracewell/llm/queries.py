"""The opN_ queries and their SQL. Each applies its operator to its whole table."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm.common import table


def _vocabulary(name: str) -> str:
    return importlib.import_module("public_tokenizers").path(name)


def byte_vocabulary() -> str:
    return _vocabulary("byte_bpe_50k.json")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewell.llm.quality_rules import fit, judge

    docs = table(spark, sf_dir, "documents")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewell.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewell.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary=byte_vocabulary())


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewell.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary=_vocabulary("word_bpe_49k.json"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewell.llm.near_dedup import link

    return link(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewell.llm.lm_scoring import score

    return score(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tracewell.llm.language_id import held_out, identify, sample

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, sample(docs, ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("score"), "confident")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewell.llm.license_scan import scan

    return scan(table(spark, sf_dir, "documents")).drop("spans")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewell.llm.suffix_dedup import dedup

    return dedup(table(spark, sf_dir, "documents"))


def op9_ann_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tracewell.llm.ann_graph import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed columns of op10, which SQL can express: everything but what the learned rules say."""
    from tracewell.llm.quality_rules import judge

    return judge(table(spark, sf_dir, "documents"), []).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed columns of op6, which SQL can express: phrases word by word, without the join's blocks."""
    return op6_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (quality_statistics, license_phrases, op1_near_dedup, op2_lm_scoring, op3_token_counts, op4_packing, op5_language_id, op6_license_scan, op7_suffix_dedup, op8_mixing, op9_ann_graph, op10_quality_rules)}


_OP1_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM t),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON c.doc_id = s.doc_id"""

_OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS h FROM documents),
a AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, ([5.0::DOUBLE, 2.0, 1.0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
k AS (SELECT *, 2.0::DOUBLE * source_size / w AS r FROM a),
f AS (SELECT *, CAST(coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY r, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS full_before, CAST(sum(w) OVER (ORDER BY r, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS w_left, row_number() OVER (ORDER BY r, source) AS i FROM k),
rate AS (SELECT arg_min((1.5::DOUBLE * (SELECT sum(source_size) FROM k) - full_before) / w_left, i) AS x FROM f WHERE (1.5::DOUBLE * (SELECT sum(source_size) FROM k) - full_before) / w_left <= r),
g AS (SELECT source, source_size, least(w * x, 2.0::DOUBLE * source_size) AS target FROM k, rate),
m AS (SELECT d.*, g.source_size, g.target, CAST(floor(g.target / greatest(g.source_size, 1)) AS BIGINT) AS copies, sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto FROM d JOIN g ON g.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, source, size, source_size, target, CAST(size * (copies + CASE WHEN copies >= 2 THEN 0 WHEN upto <= target - copies * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM m"""


_STATISTICS_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM documents),
p AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t),
g AS (SELECT r, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o || ' ' || lead(x, 5) OVER o || ' ' || lead(x, 6) OVER o || ' ' || lead(x, 7) OVER o AS g FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
h AS (SELECT r, i, g IS NOT NULL AND count(*) OVER (PARTITION BY r, g) > 1 AS hit FROM g),
c AS (SELECT r, max(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c FROM h),
s AS (SELECT r, CAST(sum(c) AS BIGINT) AS n FROM c GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(n, 0) > 30 * len(w) AS base_failed FROM t LEFT JOIN s ON s.r = t.r"""

_PHRASES_SQL = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT doc_id, len(w) AS n, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'under' AND w[i + 1] = 'the' AND w[i + 2] = 'mit' AND w[i + 3] = 'license') AS m,
  list_filter(range(1, len(w) + 1), lambda i: w[i] = 'apache' AND w[i + 1] = 'license' AND w[i + 2] = 'version' AND w[i + 3] = '2') AS a, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'cc' AND w[i + 1] = 'by' AND w[i + 2] = 'nc') AS c FROM t)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(m) + len(a) + len(c) AS BIGINT) AS n_base, list_min(m || a || c) - 1 AS first_word, list_max(m || a || c) - 1 AS last_word,
  concat_ws(',', CASE WHEN len(a) > 0 THEN 'apache-2' END, CASE WHEN len(c) > 0 THEN 'cc-by-nc' END, CASE WHEN len(m) > 0 THEN 'mit' END) AS base_labels FROM b"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express; the others are tested against brute force."""
    return {"op1_near_dedup": _OP1_SQL, "op8_mixing": _OP8_SQL, "quality_statistics": _STATISTICS_SQL, "license_phrases": _PHRASES_SQL}
