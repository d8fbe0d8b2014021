"""The queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.llm.chat import conversations

    return conversations(_read(spark, sf_dir, "conversations"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.llm.jaccard import similar_documents

    return similar_documents(_read(spark, sf_dir, "documents"), 5, 75)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.llm.substring_dedup import repeated_windows

    return repeated_windows(_read(spark, sf_dir, "documents"), 13, emit_text=False).withColumnRenamed("kept", "kept_sha256")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.llm.suffix_dedup import repeated_strings

    return repeated_strings(_read(spark, sf_dir, "documents"), 100, emit_text=False).withColumnRenamed("kept", "kept_sha256")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.llm.licenses import license_scan

    return license_scan(_read(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.llm.quality import quality_scores

    return quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from palisade.llm.bpe import round_trip

    return round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from palisade.llm.topk import inner_product_top_k

    return inner_product_top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.llm.lm import lm_scores

    return lm_scores(_read(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.llm.decontam import contaminated

    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_exact_topk, op3_license_scan, op4_quality, op5_byte_bpe, op6_lm_scores, op7_decontamination, op8_chat, op9_jaccard_join, op10_substring_dedup)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _license_sql() -> str:
    """op3 stated over DuckDB lists, from the same phrases and templates: every place of every text that holds the key phrases."""
    from palisade.llm.licenses import BASE, TEMPLATES, may_differ

    def words(p: str) -> str:
        return "[" + ", ".join(repr(w) for w in p.split()) + "]"

    def places(p: str) -> str:
        return f"CASE WHEN contains(flat, ' {p} ') THEN list_filter(range(0, len(ws)), lambda i: ws[i + 1 : i + {len(p.split())}] = {words(p)}) ELSE [] END"

    def holds(t: str, keys: tuple) -> str:
        n = len(t.split())
        said = " AND ".join(f"contains(flat, ' {k} ')" for k in keys)
        agree = f"len(list_filter(range(1, {n + 1}), lambda j: ws[i + j] = {words(t)}[j])) >= {n - may_differ(t)}"
        inside = " AND ".join(f"contains(' ' || array_to_string(ws[i + 1 : i + {n}], ' ') || ' ', ' {k} ')" for k in keys)
        return f"CASE WHEN {said} THEN len(list_filter(range(0, len(ws)), lambda i: {agree} AND {inside})) > 0 ELSE false END"

    base = list(BASE)
    found = ", ".join([f"{places(p)} AS b{k}" for k, p in enumerate(base)] + [f"{holds(t, keys)} AS t{k}" for k, (t, _, keys) in enumerate(TEMPLATES)])
    base_labels = ", ".join(f"CASE WHEN len(b{k}) > 0 THEN '{BASE[p]}' END" for k, p in enumerate(base))
    labels = ", ".join(f"CASE WHEN t{k} THEN '{label}' END" for k, (_, label, _) in enumerate(TEMPLATES))
    best = ", ".join([f"CASE WHEN len(b{k}) > 0 THEN {len(p.split())}.0::DOUBLE ELSE 0.0::DOUBLE END" for k, p in enumerate(base)] + [f"CASE WHEN t{k} THEN {len(t.split())}.0::DOUBLE ELSE 0.0::DOUBLE END" for k, (t, _, _) in enumerate(TEMPLATES)])
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
f AS (SELECT doc_id, ws, ' ' || array_to_string(ws, ' ') || ' ' AS flat FROM w),
s AS (SELECT doc_id, ws, {found} FROM f),
t AS (SELECT *, flatten([{', '.join(f'b{k}' for k in range(len(base)))}]) AS places, greatest({best}) AS best FROM s)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
  coalesce(array_to_string(list_sort(list_distinct([{base_labels}])), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct([{base_labels}, {labels}])), ','), '') AS labels, best / (best + 1) AS score
FROM t
"""


ORACLE = {
    "op1_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
s AS (SELECT doc_id, i, substring(h, 2 * i + 1, 200) AS w FROM d, UNNEST(range(0, n - 99)) AS u(i)),
f AS (SELECT w, min(doc_id) AS first_doc, min((doc_id, i)) AS first FROM s GROUP BY w HAVING count(*) > 1),
hit AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM s JOIN f USING (w) WHERE (doc_id, i) <> first),
run AS (SELECT doc_id, k, min(i) AS a, max(i) + 100 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hit) GROUP BY doc_id, k),
gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_ FROM run),
g AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substring(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) AS head FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
""",
    "op3_license_scan": _license_sql(),
    "op9_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS s FROM w, UNNEST(range(1, greatest(len(ws) - 3, 2))) AS u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, r AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id AS doc_id, min(r) AS r FROM reach GROUP BY id) USING (doc_id)
""",
    "op2_exact_topk": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r AS q, q.vec_id AS query_id, c.r, c.vec_id,
    CAST(coalesce(list_sum(list_transform(range(1, least(len(q.e), len(c.e)) + 1), lambda i: q.e[i] * c.e[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id NULLS FIRST, r) AS rank FROM s) WHERE rank <= 5
""",
    "op10_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(words[i : i + 12], ' ') AS win
  FROM w, UNNEST(range(1, len(words) - 11)) AS u(i)),
least AS (SELECT win, min(doc_id) AS first_doc FROM win GROUP BY win),
hit AS (SELECT win.doc_id, i FROM win JOIN least USING (win) WHERE first_doc < win.doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hit, UNNEST(range(0, 13)) AS u(k)),
gone_list AS (SELECT doc_id, count(*) AS n, list(i) AS gone FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_filter(words, lambda x, j: n IS NULL OR NOT list_contains(gone, j)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone_list USING (doc_id)
""",
}
