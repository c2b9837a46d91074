"""The queries opN_<name> of this subpackage and, where SQL can say the same, their DuckDB statements.

Each applies one operator with production parameters to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspark.llm import cotrain, exact_dedup, mixing, ngram_join, nn_descent, ordinal_toxicity, packing, pii, preference, token_files, tokens
from kinspark.llm.shared import working_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = working_path(spark, "token_files")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path, tokens.default_path("word_bpe_49k.json"), end_id=2)
    return token_files.document_index(token_files.read_token_files(spark, path))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_to_targets(_table(spark, sf_dir, "documents"), weights=(1, 2, 3), cap=3.0)
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokens.default_path("byte_bpe_50k.json"), window=1024, end_id=0)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_spans(_table(spark, sf_dir, "documents"))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in pii.BASE_KINDS]
    base = F.sha2(pii.listed("spans", pii.BASE_KINDS).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, pii.listed("spans").alias("spans"))


def op7_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return cotrain.score_quality(docs, cotrain.fit_quality(docs, _table(spark, sf_dir, "labels")))


def op8_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = preference.conversations(_table(spark, sf_dir, "conversations"))
    return preference.format_preferences(convs, preference.pair_by_first_turn(convs))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.group_copies(_table(spark, sf_dir, "documents"), digest_all=True)


def op10_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return ordinal_toxicity.score_severity(docs, ordinal_toxicity.fit_ordinal(docs, _table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_nn_descent, op2_token_files, op3_source_mix, op4_ngram_jaccard_join, op5_packing, op6_personal_data,
        op7_cotrained_quality, op8_preferences, op9_exact_dedup, op10_ordinal_toxicity,
    )
    return {f.__name__: f for f in found}


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SQL_OP4 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
v AS (SELECT doc_id, unnest(ws) AS x, unnest(generate_series(1, len(ws))) AS i, len(ws) AS m FROM w),
e4 AS (SELECT doc_id, m, i, x || ' ' || lead(x, 1) OVER q || ' ' || lead(x, 2) OVER q || ' ' || lead(x, 3) OVER q AS x FROM v WINDOW q AS (PARTITION BY doc_id ORDER BY i)),
e1 AS (SELECT DISTINCT doc_id, x FROM e4 WHERE x IS NOT NULL UNION SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 3),
e AS (SELECT doc_id, x, count(*) OVER (PARTITION BY doc_id) AS n FROM e1),
inter AS (
  SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS i, min(p.n) AS na, min(q.n) AS nb
  FROM e p JOIN e q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM inter WHERE 100 * i >= 85 * (na + nb - i)),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id
FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM e1 GROUP BY doc_id) s ON s.doc_id = w.doc_id
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON w.doc_id = c.a
"""

_SQL_OP9 = f"""
SELECT doc_id, max(doc_id) OVER (PARTITION BY k) AS keep_id, count(*) OVER (PARTITION BY k) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY k) AS kept, sha256(k) AS text_sha256
FROM (SELECT doc_id, {_FOLD} AS k FROM documents)
"""


_SQL_OP8 = """
WITH rows AS (
  SELECT conv_id, {'turn': coalesce(turn, 4611686018427387904), 'role': coalesce(role, ''), 'text': coalesce(text, '')} AS r
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, list_sort(list(r)) AS turns, sum(CASE WHEN r.role = 'assistant' THEN length(r.text) ELSE 0 END) AS weight
  FROM rows GROUP BY conv_id),
opening AS (
  SELECT conv_id, weight, turns[1].role || chr(10) || turns[1].text AS o,
    (row_number() OVER (PARTITION BY turns[1].role || chr(10) || turns[1].text ORDER BY conv_id) - 1) // 2 AS pair
  FROM convs),
two AS (
  SELECT min(conv_id) AS x, arg_min(weight, conv_id) AS wx, CASE WHEN count(*) = 2 THEN max(conv_id) END AS y, arg_max(weight, conv_id) AS wy
  FROM opening GROUP BY o, pair),
pairs AS (SELECT CASE WHEN y IS NULL OR wx >= wy THEN x ELSE y END AS chosen_id, CASE WHEN y IS NOT NULL THEN CASE WHEN wx >= wy THEN y ELSE x END END AS rejected_id FROM two),
duo AS (
  SELECT chosen_id, rejected_id, a.turns AS a, b.turns AS b,
    CASE WHEN b.turns IS NULL THEN len(a.turns) ELSE coalesce(
      list_min(list_filter(generate_series(1, least(len(a.turns), len(b.turns))),
        lambda i: a.turns[i].role <> b.turns[i].role OR a.turns[i].text <> b.turns[i].text)) - 1,
      least(len(a.turns), len(b.turns))) END AS n
  FROM pairs JOIN convs a ON a.conv_id = chosen_id LEFT JOIN convs b ON b.conv_id = rejected_id)
SELECT chosen_id, rejected_id, CAST(n AS BIGINT) AS prefix_turns,
  coalesce(array_to_string(list_transform(a[1:n], lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') AS prompt,
  coalesce(array_to_string(list_transform(a[n + 1:], lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') AS chosen,
  coalesce(array_to_string(list_transform(a[n + 1:], lambda t: CASE WHEN t.role = 'assistant'
    THEN '0:' || (length(t.role) + 5) || ',1:' || (length(t.text) + 8) ELSE '0:' || (length(t.role) + length(t.text) + 13) END), ','), '') AS chosen_mask,
  CASE WHEN b IS NOT NULL THEN coalesce(array_to_string(list_transform(b[n + 1:], lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') END AS rejected,
  CASE WHEN b IS NOT NULL THEN coalesce(array_to_string(list_transform(b[n + 1:], lambda t: CASE WHEN t.role = 'assistant'
    THEN '0:' || (length(t.role) + 5) || ',1:' || (length(t.text) + 8) ELSE '0:' || (length(t.role) + length(t.text) + 13) END), ','), '') END AS rejected_mask
FROM duo
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_preferences": _SQL_OP8, "op4_ngram_jaccard_join": _SQL_OP4, "op9_exact_dedup": _SQL_OP9}
