"""The queries of this subpackage and, where SQL can state them on whole tables, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstream.llm import canonical_records as p5
from quillstream.llm import history as p2
from quillstream.llm import leaks as p7
from quillstream.llm import mixing as p8
from quillstream.llm import near_duplicates as p4
from quillstream.llm import page_content as p3
from quillstream.llm import repeated_lines as p1
from quillstream.llm import shared_spans as p9
from quillstream.llm import top_per_group as p6


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1.repeated_lines(_table(spark, sf, "articles")).select("article_id", "line_no")


def p1_clean_articles(spark: SparkSession, sf: str) -> DataFrame:
    return p1.without_repeated_lines(_table(spark, sf, "articles"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2.held_records(_table(spark, sf, "articles"), _table(spark, sf, "incoming_articles")).where("held").select("record_id")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3.furniture_lines(_table(spark, sf, "articles"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4.alike_pairs(_table(spark, sf, "articles"))


def p4_groups(spark: SparkSession, sf: str) -> DataFrame:
    return p4.alike_groups(_table(spark, sf, "articles"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5.event_copies(_table(spark, sf, "assessments"))


def p5_events(spark: SparkSession, sf: str) -> DataFrame:
    return p5.distinct_events(_table(spark, sf, "assessments"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6.best_articles(_table(spark, sf, "ranked_articles")).select("edition_id", "category", "article_id")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7.leaked_items(_table(spark, sf, "documents"), _table(spark, sf, "eval_items")).select("doc_id", "item_id")


def p8_copies(spark: SparkSession, sf: str) -> DataFrame:
    return p8.mixing_copies(_table(spark, sf, "documents"), _table(spark, sf, "mix_targets"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return p8.mixing_report(_table(spark, sf, "documents"), _table(spark, sf, "mix_targets"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9.sharing_pairs(_table(spark, sf, "documents"))


def p9_shared(spark: SparkSession, sf: str) -> DataFrame:
    return p9.shared_share(_table(spark, sf, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit() and "_" in k and callable(v)}


_TEXTS = """t AS (SELECT article_id, source_id, coalesce(title, '') AS title, json_extract_string(payload, '$.clean_text') AS text FROM
 (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY retrieved_at DESC NULLS LAST) AS n FROM articles WHERE article_id IS NOT NULL AND json_valid(payload) AND json_extract_string(payload, '$.clean_text') IS NOT NULL) WHERE n = 1)"""
_FORM = "regexp_replace(lower(json_extract_string(payload, '$.assessment.{}')), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"

_SQL = {
    "p1_found": f"""WITH {_TEXTS}, l AS (SELECT article_id, source_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM t),
k AS (SELECT article_id, source_id, CAST(line_no AS INT) AS line_no, regexp_replace(lower(line), '[^\\p{{L}}]+', '', 'g') AS key FROM l),
f AS (SELECT source_id, key FROM k WHERE key <> '' GROUP BY ALL HAVING count(DISTINCT article_id) >= 8)
SELECT article_id, line_no FROM k JOIN f USING (source_id, key)""",
    "p1_clean_articles": f"""WITH {_TEXTS}, l AS (SELECT article_id, source_id, title, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM t),
k AS (SELECT *, regexp_replace(lower(line), '[^\\p{{L}}]+', '', 'g') AS key FROM l), f AS (SELECT source_id, key, TRUE AS gone FROM k WHERE key <> '' AND source_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT article_id) >= 8)
SELECT article_id, k.source_id, any_value(title) AS title, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE gone IS NULL), '') AS clean_text, CAST(count(gone) AS INT) AS removed FROM k LEFT JOIN f USING (source_id, key) GROUP BY article_id, k.source_id""",
    "p4_found": f"""WITH {_TEXTS}, w AS (SELECT article_id, regexp_extract_all(lower(title || chr(10) || text), '[\\p{{L}}\\p{{N}}]+') AS w FROM t),
g AS (SELECT DISTINCT article_id, w[j] || ' ' || w[j + 1] || ' ' || w[j + 2] AS g FROM (SELECT article_id, w, unnest(range(1, len(w) - 1)) AS j FROM w)),
n AS (SELECT article_id, count(*) AS n FROM g GROUP BY 1), c AS (SELECT x.article_id AS a, y.article_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.article_id < y.article_id GROUP BY ALL)
SELECT a AS article_id_a, b AS article_id_b FROM c JOIN n na ON na.article_id = a JOIN n nb ON nb.article_id = b WHERE 2 * c >= na.n + nb.n - c""",
    "p5_found": f"""WITH a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY created_at DESC NULLS LAST) AS n FROM assessments WHERE cache_key IS NOT NULL) WHERE n = 1 AND json_valid(payload)),
k AS (SELECT cache_key, {_FORM.format("event_subject")} AS s, {_FORM.format("event_action")} AS v, {_FORM.format("event_object")} AS o FROM a),
g AS (SELECT cache_key, min(cache_key) OVER (PARTITION BY s, v, o) AS first FROM k WHERE s <> '' AND v <> '' AND o <> '') SELECT first AS cache_key_a, cache_key AS cache_key_b FROM g WHERE first <> cache_key""",
    "p6_found": """WITH a AS (SELECT edition_id, lower(trim(category)) AS category, article_id, final_score, published_at, row_number() OVER (PARTITION BY edition_id, lower(trim(category)), article_id ORDER BY ranked_at DESC NULLS LAST, final_score DESC NULLS LAST, published_at) AS n
 FROM ranked_articles WHERE edition_id IS NOT NULL AND category IS NOT NULL AND article_id IS NOT NULL), b AS (SELECT *, row_number() OVER (PARTITION BY edition_id, category ORDER BY final_score DESC, published_at NULLS LAST, article_id) AS r FROM a WHERE n = 1 AND final_score IS NOT NULL)
SELECT edition_id, category, article_id FROM b WHERE r <= 3""",
    "p7_found": """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents), i AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items)),
ig AS (SELECT DISTINCT item_id, n, array_to_string(w[j:j + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS j FROM i WHERE n > 0)), ns AS (SELECT DISTINCT n FROM ig),
dg AS (SELECT DISTINCT doc_id, n, array_to_string(w[j:j + n - 1], ' ') AS g FROM (SELECT d.doc_id, d.w, ns.n, unnest(range(1, len(w) - n + 2)) AS j FROM d, ns WHERE len(w) >= n))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (n, g)""",
    "p9_found": """WITH g AS (SELECT DISTINCT doc_id, hash(substr(text, j, 500)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 498)) AS j FROM documents WHERE length(text) >= 500))
SELECT DISTINCT x.doc_id AS doc_id_a, y.doc_id AS doc_id_b FROM g x JOIN g y ON x.h = y.h AND x.doc_id < y.doc_id""",
}


def oracle_sql() -> dict[str, str]:
    """p2, p3 and p8 are tested against brute force, on made pages, and on their conditions instead."""
    return dict(_SQL)
