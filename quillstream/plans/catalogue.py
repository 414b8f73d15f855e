"""Catalogue of the core queries: each name with its plan and, where SQL states it, the SQL to compare with."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.functions import dates, text, transfer, urls
from quillstream.operators import dedupe, editorial, fidelity, pool, scoring, seating, selection, similarity
from quillstream.operators.scoring import rank_order
from quillstream.plans import tables as T
from quillstream.plans.tables import SQL_ARTICLES, SQL_ASSESSMENTS, SQL_RANKED, SQL_SCORED
from quillstream.sources import ingest

#: Score at which a candidate may be printed, line-up rules, and the event-time window of the window queries.
THRESHOLD = 62
POLICY = seating.Policy(max_items=10, min_items=6, min_score=THRESHOLD, max_per_source=2, section_limits={"youtube_platform": 4, "youtube_monetization": 4, "kids_content": 4, "ai_video": 3, "ai_models": 3, "ai_business": 3})
OWN_BEAT = ("youtube_platform", "youtube_monetization", "kids_content")
START, END = datetime(2026, 6, 1, tzinfo=timezone.utc), datetime(2026, 6, 8, tzinfo=timezone.utc)
_SQL_WINDOW = "published_at >= TIMESTAMPTZ '2026-06-01 00:00:00+00' AND published_at < TIMESTAMPTZ '2026-06-08 00:00:00+00'"

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a plan under its name, with its SQL if there is one."""

    def add(f):
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def _us(c: str) -> F.Column:
    return F.unix_micros(F.col(c).cast("timestamp")).alias(c)


# -- scores ------------------------------------------------------------------------


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    a = T.assessments(spark, sf).drop("content_hash")
    joined = scoring.stored_assessments(a, T.articles(spark, sf), T.table(spark, sf, "sources"))
    return joined.withColumn("final_score", scoring.score())


_PRE = f"WITH {SQL_ARTICLES}, {SQL_ASSESSMENTS}, {SQL_SCORED} "


@query(_PRE + "SELECT cache_key, article_id, source_id, prompt_version, category, priority FROM scored")
def stored_assessments(spark, sf):
    return _scored(spark, sf).select("cache_key", "article_id", "source_id", "prompt_version", "category", "priority")


@query(_PRE + "SELECT cache_key, article_id, final_score, epoch_us(published_at) AS published_at, row_number() OVER (PARTITION BY prompt_version ORDER BY final_score DESC NULLS LAST, published_at ASC NULLS LAST, article_id, cache_key) AS place FROM scored WHERE prompt_version = 'v3'")
def rank_all(spark, sf):
    rows = _scored(spark, sf).where("prompt_version = 'v3'")
    return pool.positions(rows, [*rank_order(), F.col("cache_key")], "place").select("cache_key", "article_id", "final_score", _us("published_at"), "place")


@query(_PRE + "SELECT cache_key, 6*topic_relevance AS topic_relevance, 5*business_impact AS business_impact, 4*novelty AS novelty, 3*actionability AS actionability, priority, final_score AS total FROM scored")
def score_breakdown(spark, sf):
    return _scored(spark, sf).select("cache_key", scoring.score_components().alias("c"), F.col("final_score").alias("total")).select("cache_key", "c.*", "total")


_DIST = "count(final_score) AS n, min(final_score) AS lowest, CAST(quantile_disc(final_score, 0.5) AS INT) AS median, CAST(quantile_disc(final_score, 0.9) AS INT) AS p90, max(final_score) AS highest, count(*) FILTER (final_score >= 62) AS passing, round(count(*) FILTER (final_score >= 62) / count(final_score), 6) AS pass_rate"


@query(_PRE + f"SELECT prompt_version, {_DIST} FROM scored GROUP BY prompt_version")
def score_distribution(spark, sf):
    return scoring.distribution(_scored(spark, sf), THRESHOLD, ["prompt_version"])


@query(_PRE + f"SELECT category, {_DIST}, round(avg(CASE WHEN topic_relevance >= 3 THEN 1.0 ELSE 0.0 END), 6) AS relevant FROM scored GROUP BY category")
def score_by_category(spark, sf):
    rows = _scored(spark, sf)
    relevant = rows.groupBy("category").agg(F.round(F.avg(F.when(F.col("topic_relevance") >= 3, 1.0).otherwise(0.0)), 6).alias("relevant"))
    dist = scoring.distribution(rows, THRESHOLD, ["category"])
    return dist.join(relevant, dist["category"].eqNullSafe(relevant["category"])).drop(relevant["category"])


@query(_PRE + "SELECT b.band, b.band * 10 AS low, count(s.final_score) AS n FROM range(10) b(band) LEFT JOIN scored s ON least(s.final_score // 10, 9) = b.band GROUP BY b.band")
def score_histogram(spark, sf):
    return scoring.histogram(_scored(spark, sf), 10)


@query(_PRE + "SELECT prompt_version, count(*) AS assessed, count(*) FILTER (final_score >= 62) AS clearing, CASE WHEN count(*) FILTER (final_score >= 62) >= 4 THEN 'ok' ELSE 'starved' END AS verdict FROM scored WHERE category IN ('youtube_platform','youtube_monetization','kids_content') GROUP BY prompt_version")
def floor_headroom(spark, sf):
    rows = _scored(spark, sf).where(F.col("category").isin(*OWN_BEAT))
    clearing = F.count_if(F.col("final_score") >= THRESHOLD)
    return rows.groupBy("prompt_version").agg(F.count("*").alias("assessed"), clearing.alias("clearing"), F.when(clearing >= 4, "ok").otherwise("starved").alias("verdict"))


@query(_PRE + ", k AS (SELECT *, CASE WHEN prompt_version IS NOT NULL AND length(regexp_replace(lower(strip_accents(event_subject)), '[^\\p{L}\\p{N}]', '', 'g')) > 0 AND length(regexp_replace(lower(strip_accents(event_object)), '[^\\p{L}\\p{N}]', '', 'g')) > 0 THEN trim(regexp_replace(trim(regexp_replace(lower(strip_accents(event_subject)), '[^\\p{L}\\p{N}_]+', ' ', 'g')), '^((a|an|the)( +|$))+', '')) || '|' || trim(regexp_replace(trim(regexp_replace(lower(strip_accents(event_object)), '[^\\p{L}\\p{N}_]+', ' ', 'g')), '^((a|an|the)( +|$))+', '')) END AS event_key FROM scored) SELECT cache_key, event_key, event_key IS NULL OR row_number() OVER (PARTITION BY event_key ORDER BY final_score DESC NULLS LAST, published_at ASC NULLS LAST, article_id, cache_key) = 1 AS kept FROM k")
def event_collapse(spark, sf):
    rows = _scored(spark, sf).withColumn("event_key", text.event_key(F.col("event_subject"), F.col("event_object")))
    return dedupe.best_per_event(rows, "event_key", [*rank_order(), F.col("cache_key")]).select("cache_key", "event_key", "kept")


# -- time --------------------------------------------------------------------------


@query(f"WITH {SQL_ARTICLES} SELECT article_id, epoch_us(published_at) AS published_at FROM art WHERE {_SQL_WINDOW}")
def window_filter(spark, sf):
    return T.articles(spark, sf).where(dates.in_window(F.col("published_at"), START, END)).select("article_id", _us("published_at"))


@query(f"WITH {SQL_ARTICLES} SELECT source_id, count(*) FILTER ({_SQL_WINDOW}) AS inside, count(*) FILTER (NOT coalesce({_SQL_WINDOW}, FALSE)) AS outside FROM art GROUP BY source_id")
def window_split_counts(spark, sf):
    inside = dates.in_window(F.col("published_at"), START, END)
    return T.articles(spark, sf).groupBy("source_id").agg(F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"))


@query(f"WITH {SQL_ARTICLES} SELECT article_id, strftime((published_at AT TIME ZONE 'UTC') - INTERVAL 1 MICROSECOND, '%G-W%V') AS issue FROM art")
def issue_labels(spark, sf):
    return T.articles(spark, sf).select("article_id", dates.issue_label(F.col("published_at")).alias("issue"))


@query("SELECT strftime(ts - INTERVAL 1 MICROSECOND, '%G-W%V') AS issue, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def weekly_events(spark, sf):
    e = T.table(spark, sf, "events")
    return e.groupBy(dates.issue_label(F.col("ts").cast("timestamp")).alias("issue"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("WITH p AS (SELECT DISTINCT article_id, json_extract_string(payload, '$.published_at') AS iso FROM articles WHERE json_valid(payload) AND article_id IS NOT NULL) SELECT article_id, iso, epoch_us(CAST(iso AS TIMESTAMPTZ)) AS at FROM p")
def payload_dates(spark, sf):
    parsed = F.from_json("payload", "published_at string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = T.table(spark, sf, "articles").select("article_id", parsed.alias("p")).where("p IS NOT NULL AND p._bad IS NULL AND article_id IS NOT NULL")
    return rows.select("article_id", F.col("p.published_at").alias("iso")).distinct().select("article_id", "iso", F.unix_micros(dates.parse_datetime(F.col("iso"))).alias("at"))


# -- pools -------------------------------------------------------------------------

_POOL = f"WITH {SQL_ARTICLES}, d AS (SELECT a.article_id, a.source_id, coalesce(s.priority, 0) AS priority, row_number() OVER (PARTITION BY a.source_id ORDER BY a.published_at DESC NULLS LAST, a.article_id) AS depth FROM art a LEFT JOIN sources s ON a.source_id = s.id), p AS (SELECT *, row_number() OVER (ORDER BY depth, priority DESC, source_id, article_id) AS position FROM d) "


def _robin(spark, sf):
    priorities = T.table(spark, sf, "sources").select(F.col("id").alias("source_id"), "priority")
    rows = pool.round_robin(T.articles(spark, sf), priorities).select("article_id", "source_id", "priority", "depth")
    return pool.positions(rows, pool.round_robin_order())


@query(_POOL + "SELECT article_id, depth, position FROM p")
def round_robin_pool(spark, sf):
    return _robin(spark, sf).select("article_id", "depth", "position")


@query(_POOL + "SELECT (position - 1) // 20 AS batch, count(*) AS n, count(DISTINCT source_id) AS sources FROM p GROUP BY 1")
def pool_batches(spark, sf):
    return _robin(spark, sf).groupBy(pool.batch_number(F.col("position"), 20).alias("batch")).agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("sources"))


@query(f"WITH {SQL_ARTICLES}, f AS (SELECT DISTINCT article_id, min(title) AS title FROM incoming_articles WHERE article_id IS NOT NULL GROUP BY article_id) SELECT article_id, title, 'fresh' AS origin FROM f UNION ALL SELECT article_id, title, 'stored' FROM art WHERE article_id NOT IN (SELECT article_id FROM f)")
def recall_merge(spark, sf):
    fresh = T.table(spark, sf, "incoming_articles").where("article_id IS NOT NULL").groupBy("article_id").agg(F.min("title").alias("title")).withColumn("origin", F.lit("fresh"))
    return pool.merge_stored(fresh, T.articles(spark, sf).select("article_id", "title", F.lit("stored").alias("origin")))


_ITEMS = f"{SQL_ARTICLES}, {SQL_RANKED}, it AS (SELECT r.edition_id, r.article_id, a.content_hash, split_part(r.edition_id, '-', 1) || '-' || split_part(r.edition_id, '-', 2) AS issue, r.published_at, r.final_score, row_number() OVER (PARTITION BY r.edition_id ORDER BY r.final_score DESC NULLS LAST, r.published_at ASC NULLS LAST, r.article_id) AS position FROM rk r LEFT JOIN art a ON r.article_id = a.article_id)"


def _issue(c: str = "edition_id") -> F.Column:
    return F.concat_ws("-", F.split_part(F.col(c), F.lit("-"), F.lit(1)), F.split_part(F.col(c), F.lit("-"), F.lit(2)))


def _items(spark, sf):
    """Candidates of editions as printed items: position by rank; an edition counts as generated at its issue."""
    place = F.row_number().over(Window.partitionBy("edition_id").orderBy(*rank_order()))
    rows = T.ranked(spark, sf).withColumn("position", place)
    hashes = T.articles(spark, sf).select("article_id", "content_hash")
    return rows.join(hashes, "article_id", "left").select("edition_id", "article_id", "content_hash", _issue().alias("issue"), _issue().alias("generated_at"), "position")


@query(f"WITH {_ITEMS} SELECT article_id, min_by(issue, issue || ' ' || edition_id) AS issue FROM it GROUP BY article_id")
def published_keys(spark, sf):
    return pool.published_keys(_items(spark, sf))[0]


@query(f"WITH {_ITEMS}, i AS (SELECT article_id, min(issue) AS issue FROM it GROUP BY 1), h AS (SELECT content_hash, min(issue) AS issue FROM it WHERE content_hash IS NOT NULL GROUP BY 1) SELECT n.record_id, coalesce(i.issue, h.issue) AS printed_in FROM incoming_articles n LEFT JOIN i USING (article_id) LEFT JOIN h USING (content_hash)")
def suppressed(spark, sf):
    by_id, by_hash = pool.published_keys(_items(spark, sf))
    return pool.suppress_published(T.table(spark, sf, "incoming_articles"), by_id, by_hash).select("record_id", "printed_in")


@query(f"WITH {SQL_ARTICLES}, {SQL_ASSESSMENTS}, k AS (SELECT DISTINCT content_hash FROM ass WHERE model = 'judge-large' AND prompt_version = 'v3' AND schema_version = '2') SELECT a.article_id, k.content_hash IS NOT NULL AS hit FROM art a LEFT JOIN k ON a.content_hash = k.content_hash")
def cache_split(spark, sf):
    return pool.cache_split(T.articles(spark, sf), T.assessments(spark, sf), "judge-large", "v3", "2").select("article_id", "hit")


_ISSUES = f"WITH {_ITEMS}, g AS (SELECT issue, min(epoch_us(published_at)) AS started FROM it GROUP BY issue) "


def _issues(spark, sf):
    return T.ranked(spark, sf).groupBy(_issue().alias("issue")).agg(F.min(F.unix_micros(F.col("published_at").cast("timestamp"))).alias("started"))


@query(_ISSUES + "SELECT * FROM g")
def generated_issues(spark, sf):
    return _issues(spark, sf)


@query(_ISSUES + "SELECT issue, started, lag(issue) OVER (ORDER BY started NULLS FIRST, issue) AS previous, lead(issue) OVER (ORDER BY started NULLS FIRST, issue) AS next FROM g")
def issue_neighbours(spark, sf):
    return pool.issue_neighbours(_issues(spark, sf))


@query(_ISSUES + "SELECT max_by(issue, (started, issue)) AS issue FROM g")
def latest_issue(spark, sf):
    return _issues(spark, sf).agg(F.max_by("issue", F.struct("started", "issue")).alias("issue"))


# -- texts and URLs -------------------------------------------------------------------

_TRACK = "lower(name) IN (" + ",".join(f"'{x}'" for x in urls.TRACKING_PARAMS) + ") OR regexp_matches(lower(name), '^(" + "|".join(urls.TRACKING_PREFIXES) + ")')"
_URLS = f"""WITH u AS (SELECT DISTINCT canonical_url AS url FROM incoming_articles WHERE canonical_url IS NOT NULL),
p AS (SELECT url, lower(regexp_extract(url, '^([^:/?#]+)://', 1)) AS s, regexp_replace(lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)), CASE WHEN lower(url) LIKE 'https:%' THEN ':443$' ELSE ':80$' END, '') AS h,
 regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q FROM u),
x AS (SELECT url, unnest(string_split(q, '&')) AS piece FROM p WHERE q <> ''),
y AS (SELECT url, url_decode(replace(split_part(piece, '=', 1), '+', ' ')) AS name, url_decode(replace(CASE WHEN contains(piece, '=') THEN substr(piece, strpos(piece, '=') + 1) ELSE '' END, '+', ' ')) AS val FROM x WHERE piece <> ''),
k AS (SELECT url, string_agg(replace(url_encode(name), '%20', '+') || '=' || replace(url_encode(val), '%20', '+'), '&' ORDER BY name, val) AS query FROM y WHERE NOT ({_TRACK}) GROUP BY url),
c AS (SELECT p.url, s, h, path, coalesce(query, '') AS query FROM p LEFT JOIN k ON p.url = k.url) """


@query(_URLS + "SELECT url, s || '://' || h || path || CASE WHEN query = '' THEN '' ELSE '?' || query END AS canonical FROM c")
def canonical_urls(spark, sf):
    u = T.table(spark, sf, "incoming_articles").select(F.col("canonical_url").alias("url")).where("url IS NOT NULL").distinct()
    return u.select("url", urls.canonicalize_url(F.col("url")).alias("canonical"))


@query(_URLS + "SELECT url, s || '://' || regexp_replace(h, '^www\\.', '') || regexp_replace(regexp_replace(path, '(^|/)(index\\.html|index\\.htm|index\\.php|default\\.html|default\\.htm)$', '\\1', 'i'), '/+$', '') || CASE WHEN query = '' THEN '' ELSE '?' || query END AS key FROM c")
def dedupe_keys(spark, sf):
    u = T.table(spark, sf, "incoming_articles").select(F.col("canonical_url").alias("url")).where("url IS NOT NULL").distinct()
    return u.select("url", urls.dedupe_key(F.col("url")).alias("key"))


@query("SELECT i.record_id, regexp_replace(regexp_replace(lower(regexp_extract(i.canonical_url, '^[^:/?#]+://([^/?#]*)', 1)), ':443$', ''), '^www\\.', '') = regexp_replace(regexp_replace(lower(regexp_extract(s.entrypoint, '^[^:/?#]+://([^/?#]*)', 1)), ':443$', ''), '^www\\.', '') AS same FROM incoming_articles i JOIN sources s ON i.source_id = s.id WHERE i.canonical_url IS NOT NULL")
def same_site(spark, sf):
    s = T.table(spark, sf, "sources").select(F.col("id").alias("source_id"), "entrypoint")
    rows = T.table(spark, sf, "incoming_articles").where("canonical_url IS NOT NULL").join(s, "source_id")
    return rows.select("record_id", urls.same_site(F.col("canonical_url"), F.col("entrypoint")).alias("same"))


@query(f"WITH {SQL_ARTICLES} SELECT article_id, trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS title_key FROM art")
def normalized_titles(spark, sf):
    return T.articles(spark, sf).select("article_id", text.normalize_title(F.col("title")).alias("title_key"))


@query(f"WITH {SQL_ARTICLES} SELECT article_id, sha256(text) AS hash, sha256(text) = lower(content_hash) AS agrees FROM txt WHERE text IS NOT NULL")
def content_hashes(spark, sf):
    rows = T.articles(spark, sf, text=True).where("text IS NOT NULL")
    return rows.select("article_id", text.content_hash(F.col("text")).alias("hash"), (text.content_hash(F.col("text")) == F.lower("content_hash")).alias("agrees"))


# -- duplicates -------------------------------------------------------------------------


def _keyed(spark, sf):
    priority = T.table(spark, sf, "sources").select(F.col("id").alias("source_id"), "priority")
    rows = T.articles(spark, sf).join(priority, "source_id", "left")
    rank = F.struct((-F.coalesce("priority", F.lit(0))).alias("p"), F.unix_micros(F.col("published_at").cast("timestamp")).alias("t"))
    keyed = rows.select("article_id", "content_hash", urls.dedupe_key(F.col("canonical_url")).alias("url_key"), text.usable_title_key(F.col("title")).alias("title_key"), rank.alias("rank"))
    return dedupe.deduplicate(keyed, F.col("rank"))


_DEDUPE = (
    "WITH RECURSIVE "
    + SQL_ARTICLES
    + """, k AS MATERIALIZED (SELECT a.article_id, row_number() OVER (ORDER BY -coalesce(s.priority, 0), a.published_at NULLS FIRST, a.article_id) AS r,
 'u:' || s0 || '://' || regexp_replace(h, '^www\\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN q = '' THEN '' ELSE '?' || q END AS uk, 'h:' || a.content_hash AS hk,
 CASE WHEN length(tk) >= 15 THEN 't:' || tk END AS tk FROM (SELECT *, lower(regexp_extract(canonical_url, '^([^:/?#]+)://', 1)) AS s0, lower(regexp_extract(canonical_url, '^[^:/?#]+://([^/?#]*)', 1)) AS h, regexp_extract(canonical_url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path,
 regexp_extract(canonical_url, '^[^?#]*\\?([^#]*)', 1) AS q, trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS tk FROM art) a LEFT JOIN sources s ON a.source_id = s.id),
 w AS (SELECT 0::BIGINT AS r, NULL::VARCHAR AS article_id, FALSE AS kept, []::VARCHAR[] AS seen, NULL::VARCHAR AS reason UNION ALL
 SELECT k.r, k.article_id, NOT list_has_any(w.seen, [k.uk, k.hk, k.tk]), CASE WHEN list_has_any(w.seen, [k.uk, k.hk, k.tk]) THEN w.seen ELSE list_concat(w.seen, list_filter([k.uk, k.hk, k.tk], lambda x: x IS NOT NULL)) END,
 CASE WHEN list_contains(w.seen, k.uk) THEN 'url' WHEN list_contains(w.seen, k.hk) THEN 'content' WHEN list_contains(w.seen, k.tk) THEN 'title' END FROM w JOIN k ON k.r = w.r + 1) """
)


@query()
def dedupe_articles(spark, sf):
    return _keyed(spark, sf)


@query()
def dedupe_reasons(spark, sf):
    return _keyed(spark, sf).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


# -- events by similarity -------------------------------------------------------------------


def _candidates(spark, sf):
    texts = T.articles(spark, sf, text=True).where("text IS NOT NULL").select("article_id", "title", "text")
    return T.ranked(spark, sf).join(texts, "article_id")


_TFIDF = f"""WITH {SQL_ARTICLES}, {SQL_RANKED}, c AS (SELECT r.edition_id, r.article_id, r.source_id, r.final_score, r.published_at, regexp_extract_all(replace(lower(coalesce(t.title, '') || chr(10) || t.text), 'ß', 'ss'), '[a-z0-9]+') AS ts FROM rk r JOIN txt t ON r.article_id = t.article_id WHERE t.text IS NOT NULL),
tf AS (SELECT edition_id, article_id, source_id, len(ts) AS n_words, term, count(*) AS tf FROM (SELECT *, unnest(ts) AS term FROM c) GROUP BY ALL),
df AS (SELECT edition_id, term, count(*) AS df FROM tf GROUP BY ALL), tot AS (SELECT edition_id, count(*) AS total FROM c GROUP BY ALL),
sa AS (SELECT edition_id, source_id, count(*) AS articles FROM c GROUP BY ALL), sc AS (SELECT t.edition_id, t.source_id, t.term, count(*) AS seen, any_value(sa.articles) AS articles FROM tf t JOIN sa ON t.edition_id = sa.edition_id AND t.source_id = sa.source_id WHERE sa.articles >= 3 GROUP BY ALL HAVING count(*) >= any_value(sa.articles) * 0.5),
raw AS (SELECT t.edition_id, t.article_id, t.term, df.df, (1 + ln(tf)) * (ln((total + 1) / (df.df + 1)) + 1) AS x FROM tf t JOIN df ON t.edition_id = df.edition_id AND t.term = df.term JOIN tot ON t.edition_id = tot.edition_id
 WHERE n_words >= 40 AND NOT EXISTS (SELECT 1 FROM sc WHERE sc.edition_id = t.edition_id AND sc.source_id = t.source_id AND sc.term = t.term)),
pr AS (SELECT edition_id, article_id, term, df, x / sqrt(sum(x * x) OVER (PARTITION BY edition_id, article_id)) AS weight FROM raw) """


@query(_TFIDF + "SELECT edition_id, source_id, term, seen, articles FROM sc")
def source_chrome(spark, sf):
    rows = _candidates(spark, sf)
    return similarity.source_terms(similarity.term_counts(rows), rows).select("edition_id", "source_id", "term", "seen", "articles")


@query(_TFIDF + "SELECT edition_id, article_id, count(*) AS terms, round(max(weight), 6) AS heaviest, round(sum(weight * weight), 6) AS norm FROM pr GROUP BY ALL")
def tfidf_profiles(spark, sf):
    return similarity.similarity_profiles(_candidates(spark, sf)).groupBy("edition_id", "article_id").agg(F.count("*").alias("terms"), F.round(F.max("weight"), 6).alias("heaviest"), F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("norm"))


def _pairs(spark, sf):
    rows = similarity.term_rows(_candidates(spark, sf), ("final_score", "published_at"))
    return rows, similarity.similar_among(rows, F.col("final_score") >= THRESHOLD)


@query(_TFIDF + "SELECT x.edition_id, x.article_id AS a, y.article_id AS b, round(sum(x.weight * y.weight), 6) AS cosine FROM pr x JOIN pr y ON x.edition_id = y.edition_id AND x.term = y.term AND x.article_id < y.article_id JOIN c cx ON cx.edition_id = x.edition_id AND cx.article_id = x.article_id AND cx.final_score >= 62 JOIN c cy ON cy.edition_id = y.edition_id AND cy.article_id = y.article_id AND cy.final_score >= 62 GROUP BY 1, 2, 3 HAVING round(sum(x.weight * y.weight), 9) >= 0.21")
def similar_pairs(spark, sf):
    return _pairs(spark, sf)[1]


@query()
def similar_event_collapse(spark, sf):
    order = [(-F.col("final_score")).asc_nulls_first(), F.col("published_at").cast("timestamp").asc_nulls_first(), F.col("article_id"), F.col("edition_id")]
    ranked = pool.positions(T.ranked(spark, sf).select("edition_id", "article_id", "source_id", "final_score", "published_at"), order, "n")
    # Texts are packed as they are read: the choice of the latest row and the join move terms only.
    saved = T.saved_articles(spark, sf, text=True).withColumn("told", F.col("text").isNotNull())
    packed = T.latest_articles(similarity.packed_terms(saved, ("article_id", "retrieved_at", "content_hash", "told")), ["told", "n_words", "terms", "tf"]).where("told")
    rows = similarity.term_rows(ranked.join(packed, "article_id"), ("final_score", "n"))
    return similarity.fold_similar(rows, F.col("final_score").isNotNull(), F.col("final_score") >= THRESHOLD, "n")


# -- line-ups ------------------------------------------------------------------------------


def _seated(spark, sf):
    return seating.seat_editions(T.ranked(spark, sf), POLICY)


@query()
def seat_edition(spark, sf):
    return _seated(spark, sf).where("position IS NOT NULL").select("edition_id", "article_id", "outcome", "position", "steps")


@query()
def seat_rejections(spark, sf):
    return seating.rejection_counts(_seated(spark, sf))


@query()
def coverage_floors(spark, sf):
    from dataclasses import replace

    policy = replace(POLICY, floors=(("own_beat", OWN_BEAT, 4),))
    return seating.seat_editions(T.ranked(spark, sf), policy).where("position IS NOT NULL").select("edition_id", "article_id", "outcome", "position")


@query()
def floor_cost(spark, sf):
    from dataclasses import replace

    return seating.floor_cost(T.ranked(spark, sf), replace(POLICY, floors=(("own_beat", OWN_BEAT, 4),)))


_SEATS = f"""WITH RECURSIVE {SQL_RANKED}, c AS (SELECT edition_id, article_id, coalesce(source_id, '') AS source_id, category, row_number() OVER (PARTITION BY edition_id ORDER BY final_score DESC, published_at ASC NULLS LAST, article_id) AS r
 FROM rk WHERE final_score >= 62 AND category IS NOT NULL AND category NOT IN ('other', '')),
lim AS (SELECT * FROM (VALUES ('youtube_platform', 4), ('youtube_monetization', 4), ('kids_content', 4), ('ai_video', 3), ('ai_models', 3), ('ai_business', 3)) v(category, cap)),
k AS MATERIALIZED (SELECT c.*, coalesce(lim.cap, 10) AS cap FROM c LEFT JOIN lim USING (category)),
w AS (SELECT DISTINCT edition_id, CAST(step AS INT) AS step, 0::BIGINT AS r, []::STRUCT(a VARCHAR, c VARCHAR, s VARCHAR)[] AS seated, FALSE AS rationed FROM k, range(0, 9) t(step) UNION ALL
 SELECT w.edition_id, w.step, k.r, CASE WHEN ok THEN list_append(w.seated, {{'a': k.article_id, 'c': k.category, 's': k.source_id}}) ELSE w.seated END, w.rationed OR NOT ok
 FROM w JOIN k ON k.edition_id = w.edition_id AND k.r = w.r + 1, LATERAL (SELECT len(w.seated) < 10 AND len(list_filter(w.seated, lambda x: x.c = k.category)) < least(k.cap + w.step, 10)
  AND (k.source_id = '' OR len(list_filter(w.seated, lambda x: x.s = k.source_id)) < least(2 + w.step, 10)) AS ok) o),
f AS (SELECT edition_id, step, max_by(seated, r) AS seated, max_by(rationed, r) AS rationed FROM w GROUP BY ALL),
g AS (SELECT edition_id, min(step) AS steps FROM f WHERE len(seated) >= 6 OR NOT rationed OR step = 8 GROUP BY 1),
s AS (SELECT g.edition_id, g.steps, unnest(f.seated) AS x FROM g JOIN f ON f.edition_id = g.edition_id AND f.step = g.steps)
SELECT s.edition_id, s.x.a AS article_id, 'earned' AS outcome, CAST(row_number() OVER (PARTITION BY s.edition_id ORDER BY k.r) AS INT) AS position, s.steps FROM s JOIN k ON k.edition_id = s.edition_id AND k.article_id = s.x.a"""


@query()
def edition_records(spark, sf):
    """The seated line-ups as nested JSON records."""
    from quillstream.plans.edition import build_editions, edition_json

    texts = T.articles(spark, sf).select("article_id", "title", "canonical_url")
    seats = _seated(spark, sf).where("position IS NOT NULL").select("edition_id", "article_id", "position")
    items = seats.join(T.ranked(spark, sf), ["edition_id", "article_id"]).join(texts, "article_id", "left").withColumn("summary", F.lit(None).cast("string"))
    return edition_json(build_editions(items, tuple(POLICY.section_limits)))


@query(f"WITH {SQL_ARTICLES}, k AS (SELECT DISTINCT record_id, canonical_url FROM incoming_articles WHERE canonical_url IS NOT NULL) SELECT k.record_id, a.article_id IS NOT NULL AS known FROM k LEFT JOIN (SELECT canonical_url, min(article_id) AS article_id FROM art GROUP BY 1) a USING (canonical_url)")
def known_links(spark, sf):
    known = T.articles(spark, sf).select("canonical_url").where("canonical_url IS NOT NULL").distinct().withColumn("known", F.lit(True))
    rows = T.table(spark, sf, "incoming_articles").select("record_id", "canonical_url").where("canonical_url IS NOT NULL").distinct()
    return rows.join(known, "canonical_url", "left").select("record_id", F.coalesce("known", F.lit(False)).alias("known"))


# -- fidelity ---------------------------------------------------------------------------------


@query()
def entity_violations(spark, sf):
    """Summary and key facts of every assessment against source name, title and text of its article."""
    fields = F.array(F.struct(F.lit("summary").alias("field"), F.col("summary").alias("text")), F.struct(F.lit("key_facts").alias("field"), F.array_join("key_facts", "\n").alias("text")))
    prose = T.assessments(spark, sf).where("article_id IS NOT NULL").select("cache_key", "article_id", F.inline(fields)).where("text IS NOT NULL")
    names = T.table(spark, sf, "sources").select(F.col("id").alias("source_id"), "name")
    sources = T.articles(spark, sf, text=True).where("text IS NOT NULL").join(names, "source_id", "left").select("article_id", F.concat_ws("\n", "name", "title", "text").alias("text"))
    return fidelity.unsupported_entities(prose, sources, by=("cache_key",))


@query(f"WITH {SQL_ARTICLES} SELECT article_id, 'summary' AS field, 'QuxBot7' AS token FROM txt WHERE text IS NOT NULL")
def planted_entities(spark, sf):
    """A sentence about every article that names what its title names and one thing that no text does."""
    sources = T.articles(spark, sf, text=True).where("text IS NOT NULL").select("article_id", F.concat_ws("\n", "title", "text").alias("text"), "title")
    prose = sources.select("article_id", F.lit("summary").alias("field"), F.concat_ws(" ", F.lit("News of"), "title", F.lit("with QuxBot7, and again QUXBOT7.")).alias("text"))
    return fidelity.unsupported_entities(prose, sources.select("article_id", "text")).select("article_id", "field", "token")


# -- dimension queries ----------------------------------------------------------------------------


@query("SELECT id, name, priority, row_number() OVER (ORDER BY priority DESC, id) AS place FROM sources WHERE enabled")
def enabled_sources(spark, sf):
    # One row per configured source: the window is bounded by the configuration.
    return T.table(spark, sf, "sources").where("enabled").select("id", "name", "priority", F.row_number().over(Window.orderBy(F.col("priority").desc(), "id")).alias("place"))


@query(f"WITH {SQL_ARTICLES} SELECT s.id AS source_id, count(a.article_id) AS articles, count(DISTINCT a.content_hash) AS texts FROM sources s LEFT JOIN art a ON a.source_id = s.id GROUP BY s.id")
def source_article_counts(spark, sf):
    s = T.table(spark, sf, "sources").select(F.col("id").alias("source_id"))
    n = T.articles(spark, sf).groupBy("source_id").agg(F.count("*").alias("articles"), F.countDistinct("content_hash").alias("texts"))
    return s.join(n, "source_id", "left").select("source_id", F.coalesce("articles", F.lit(0)).alias("articles"), F.coalesce("texts", F.lit(0)).alias("texts"))


@query("SELECT content_hash, min_by(article_id, (first_seen_at, article_id)) AS article_id FROM articles WHERE content_hash IS NOT NULL AND article_id IS NOT NULL GROUP BY content_hash")
def first_by_hash(spark, sf):
    rows = T.table(spark, sf, "articles").where("content_hash IS NOT NULL AND article_id IS NOT NULL")
    return rows.groupBy("content_hash").agg(F.min_by("article_id", F.struct("first_seen_at", "article_id")).alias("article_id"))


# -- whole line-ups --------------------------------------------------------------------------


def _lineups(spark, sf, policy=POLICY):
    """Candidates of each edition with what earlier issues printed, the event of their latest assessment, title and text."""
    issue = _issue()
    texts = T.articles(spark, sf, text=True).select("article_id", "title", "text")
    by_id = pool.published_keys(_items(spark, sf))[0].select("article_id", F.col("issue").alias("_first"))
    events = T.assessments(spark, sf).where("article_id IS NOT NULL").groupBy("article_id").agg(F.max_by(F.struct("event_subject", "event_object"), F.struct("prompt_version", "created_at", "cache_key")).alias("e"))
    keyed = events.select("article_id", text.event_key(F.col("e.event_subject"), F.col("e.event_object")).alias("event_key"))
    rows = T.ranked(spark, sf).join(texts, "article_id", "left").join(by_id, "article_id", "left").join(keyed, "article_id", "left")
    rows = rows.withColumn("printed_in", F.when(F.col("_first") < issue, F.col("_first")))
    return selection.select_lineups(rows, policy)


@query()
def select_editions(spark, sf):
    return _lineups(spark, sf)


@query()
def lineup_summary(spark, sf):
    # The ranked rows are all candidates; the columns joined to them for the line-ups aren't needed.
    return selection.lineup_summary(T.ranked(spark, sf), _lineups(spark, sf), POLICY)


@query(f"WITH {SQL_RANKED} SELECT edition_id, count(*) AS candidates, count(*) FILTER (final_score >= 62 AND category IS NOT NULL AND category NOT IN ('other', '')) AS above_threshold FROM rk GROUP BY 1")
def above_threshold(spark, sf):
    rows = T.ranked(spark, sf)
    return selection.lineup_summary(rows, _seated(spark, sf), POLICY).select("edition_id", "candidates", "above_threshold")


# -- assessments and edited texts ----------------------------------------------------------------

_J = "json_extract_string(payload, '$.assessment.{}')"
_FULL = f"""full_ AS (SELECT cache_key, topic_relevance, business_impact, novelty, actionability, CAST({_J.format("confidence")} AS DOUBLE) AS confidence, summary, {_J.format("why_it_matters")} AS why_it_matters, {_J.format("event_action")} AS event_action, {_J.format("event_date")} AS event_date, event_subject, event_object,
 CASE WHEN json_type(payload, '$.assessment.key_facts') = 'ARRAY' THEN from_json(json_extract(payload, '$.assessment.key_facts'), '["VARCHAR"]') END AS key_facts, content_hash, prompt_version, schema_version, model FROM ass)"""


@query(f"WITH {SQL_ASSESSMENTS}, {_FULL} SELECT cache_key, CASE WHEN NOT coalesce(topic_relevance BETWEEN 0 AND 5, FALSE) THEN 'topic_relevance' WHEN NOT coalesce(business_impact BETWEEN 0 AND 5, FALSE) THEN 'business_impact' WHEN NOT coalesce(novelty BETWEEN 0 AND 5, FALSE) THEN 'novelty' WHEN NOT coalesce(actionability BETWEEN 0 AND 5, FALSE) THEN 'actionability' WHEN NOT coalesce(confidence BETWEEN 0 AND 1, FALSE) THEN 'confidence' WHEN coalesce(trim(summary), '') = '' THEN 'summary' WHEN coalesce(trim(why_it_matters), '') = '' THEN 'why_it_matters' END AS problem FROM full_")
def rubric_check(spark, sf):
    return T.assessments(spark, sf).select("cache_key", editorial.rubric_problem().alias("problem"))


@query(f"WITH {SQL_ASSESSMENTS}, {_FULL} SELECT cache_key, array_to_string(list_slice(list_filter(list_transform(key_facts, lambda x: trim(x)), lambda x: x IS NOT NULL AND x <> ''), 1, 8), ' / ') AS facts FROM full_ WHERE key_facts IS NOT NULL")
def assessment_facts(spark, sf):
    rows = T.assessments(spark, sf).where("key_facts IS NOT NULL")
    return rows.select("cache_key", F.array_join(text.trimmed_facts(F.col("key_facts")), " / ").alias("facts"))


@query(f"WITH {SQL_ASSESSMENTS}, {_FULL} SELECT cache_key, CASE WHEN event_subject <> '' AND event_action <> '' AND event_object <> '' THEN lower(trim(event_subject)) || '|' || lower(trim(event_action)) || '|' || lower(trim(event_object)) || '|' || lower(trim(coalesce(event_date, ''))) END AS fingerprint, content_hash || ':' || prompt_version || ':' || schema_version || ':' || model AS key FROM full_")
def event_fingerprints(spark, sf):
    c = F.col
    return T.assessments(spark, sf).select(
        "cache_key", text.event_fingerprint(c("event_subject"), c("event_action"), c("event_object"), c("event_date")).alias("fingerprint"), text.cache_key(c("content_hash"), c("prompt_version"), c("schema_version"), c("model")).alias("key")
    )


@query(f"WITH {SQL_ASSESSMENTS}, {_FULL}, x AS (SELECT cache_key, trim(regexp_replace(why_it_matters, '\\s+', ' ', 'g')) AS t FROM full_) SELECT cache_key, CASE WHEN t <> '' AND length(t) <= 100 AND NOT regexp_matches(t, 'https?://|<[a-z/][^>]*>|\\]\\(', 'i') THEN t END AS clean FROM x")
def editorial_texts(spark, sf):
    return T.assessments(spark, sf).select("cache_key", text.clean_editorial_text(F.col("why_it_matters"), 100).alias("clean"))


@query(f"WITH {SQL_RANKED}, {SQL_ARTICLES}, e AS (SELECT edition_id, article_id, row_number() OVER (PARTITION BY edition_id ORDER BY article_id) AS position FROM rk), t AS (SELECT e.edition_id, e.article_id, trim(regexp_replace(a.title, '\\s+', ' ', 'g')) AS h FROM e JOIN art a USING (article_id)) SELECT edition_id, article_id, h AS headline FROM t WHERE h <> '' AND length(h) <= 140 AND NOT regexp_matches(h, 'https?://|<[a-z/][^>]*>|\\]\\(', 'i')")
def usable_polish(spark, sf):
    """The titles of candidates as edited texts, every row twice, the second time with other words."""
    items = T.ranked(spark, sf).select("edition_id", "article_id")
    titles = items.join(T.articles(spark, sf).select("article_id", "title"), "article_id")
    first = titles.select("edition_id", F.lit(1).alias("position"), "article_id", F.col("title").alias("headline"), F.lit("see https://e.example").alias("why_it_matters"))
    again = first.withColumn("position", F.lit(2)).withColumn("headline", F.lit("repeat"))
    stray = first.limit(1).withColumn("article_id", F.lit("unknown"))
    return editorial.usable_polish(first.unionByName(again).unionByName(stray), items).select("edition_id", "article_id", "headline")


# -- titles, dates, sites and paths ----------------------------------------------------------------------

_MONTHS = "['" + "','".join(dates.MONTHS) + "']"


@query(f"WITH {SQL_ARTICLES} SELECT article_id, day(u) || ' ' || {_MONTHS}[month(u)] || ' ' || year(u) AS printed, day(v) || ' ' || {_MONTHS}[month(v)] || ' ' || year(v) AS until, 'Semana ' || CAST(strftime(v, '%V') AS INT) AS week FROM (SELECT article_id, published_at AT TIME ZONE 'UTC' AS u, (published_at AT TIME ZONE 'UTC') - INTERVAL 1 MICROSECOND AS v FROM art)")
def issue_dates(spark, sf):
    t = F.col("published_at").cast("timestamp")
    return T.articles(spark, sf).select("article_id", dates.issue_date(t).alias("printed"), dates.issue_date_end(t).alias("until"), dates.issue_week_text(dates.issue_label(t)).alias("week"))


@query(f"WITH {SQL_ARTICLES}, h AS (SELECT article_id, regexp_replace(lower(regexp_extract(canonical_url, '^[^:/?#]+://(?:[^@/?#]*@)?([^:/?#]*)', 1)), '^www\\.', '') AS h FROM art WHERE canonical_url IS NOT NULL), s AS (SELECT article_id, array_to_string(string_split(h, '.')[-2:], '.') AS s FROM h) SELECT article_id, CASE WHEN s = 'twitter.com' THEN 'x.com' ELSE s END AS site FROM s")
def article_sites(spark, sf):
    return T.articles(spark, sf).where("canonical_url IS NOT NULL").select("article_id", ingest.site_of(F.col("canonical_url")).alias("site"))


@query("SELECT record_id, CASE WHEN NOT starts_with(lower(canonical_url), 'https://') THEN 'not https' WHEN regexp_matches(lower(canonical_url), '^https://([^@/?#]*@)?([^:/?#]*\\.)?harbor') THEN 'listed' ELSE 'ok' END AS verdict FROM incoming_articles WHERE canonical_url IS NOT NULL AND regexp_matches(lower(canonical_url), '^https?://[^/?#]')")
def submitted_urls(spark, sf):
    rows = T.table(spark, sf, "incoming_articles").where(F.col("canonical_url").isNotNull() & urls.is_public_url(F.col("canonical_url")))
    listed = transfer.host_of(urls.canonicalize_url(F.col("canonical_url"))).rlike(r"(^|\.)harbor")
    problem = ingest.submitted_url_problem(F.col("canonical_url"), ("blocked.invalid",))
    return rows.select("record_id", F.coalesce(problem, F.when(listed, "listed"), F.lit("ok")).alias("verdict"))


# -- ingest --------------------------------------------------------------------------------------------------


@query("WITH r AS (SELECT source_id, json_valid(payload) AND json_extract_string(payload, '$.clean_text') IS NOT NULL AS ok FROM incoming_articles), n AS (SELECT source_id, count(*) AS found, count(*) FILTER (ok) AS ingested FROM r GROUP BY 1) SELECT s.id AS source_id, coalesce(found, 0) AS found, coalesce(ingested, 0) AS ingested, coalesce(found, 0) - coalesce(ingested, 0) AS failed, CASE WHEN coalesce(found, 0) = 0 THEN 'empty' WHEN ingested < found THEN 'partial' ELSE 'ok' END AS status FROM sources s LEFT JOIN n ON n.source_id = s.id WHERE s.enabled")
def source_outcomes(spark, sf):
    parsed = F.from_json("payload", "clean_text string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    ok = F.coalesce(parsed["_bad"].isNull() & parsed["clean_text"].isNotNull(), F.lit(False))
    rows = T.table(spark, sf, "incoming_articles").select("source_id", F.when(~ok, "payload").alias("problem"))
    return ingest.source_outcomes(T.table(spark, sf, "sources"), rows)


@query(f"WITH {SQL_ARTICLES}, {SQL_RANKED} SELECT DISTINCT r.edition_id, r.article_id, CASE WHEN a.article_id IS NULL THEN 'article' ELSE 'source' END AS broken FROM rk r LEFT JOIN art a ON a.article_id = r.article_id LEFT JOIN sources s ON s.id = a.source_id WHERE a.article_id IS NULL OR s.id IS NULL")
def traceability(spark, sf):
    items = T.ranked(spark, sf)
    return ingest.traceability(items, items, T.articles(spark, sf), T.table(spark, sf, "sources"))


@query(f"WITH {SQL_ARTICLES}, u AS (SELECT DISTINCT record_id, canonical_url FROM incoming_articles WHERE canonical_url IS NOT NULL), a AS (SELECT canonical_url, max_by(article_id, (retrieved_at, article_id)) AS article_id FROM art WHERE canonical_url IS NOT NULL GROUP BY 1) SELECT record_id, a.article_id FROM u JOIN a USING (canonical_url) WHERE canonical_url IN (SELECT canonical_url FROM art GROUP BY 1) AND regexp_matches(canonical_url, '^https://[a-z.-]+/[a-z0-9/-]*[a-z0-9]$') AND NOT regexp_matches(canonical_url, '^https://www')")
def matched_urls(spark, sf):
    plain = F.col("url").rlike(r"^https://[a-z.-]+/[a-z0-9/-]*[a-z0-9]$") & ~F.col("url").rlike("^https://www")
    proposed = T.table(spark, sf, "incoming_articles").where("canonical_url IS NOT NULL").select("record_id", F.col("canonical_url").alias("url")).distinct()
    rows = T.articles(spark, sf)
    exact = rows.where(F.col("canonical_url").rlike(r"^https://[a-z.-]+/[a-z0-9/-]*[a-z0-9]$") & ~F.col("canonical_url").rlike("^https://www"))
    found = ingest.match_by_url(proposed, exact.withColumn("origin_url", F.lit(None).cast("string")))
    return found.where(plain & F.col("article_id").isNotNull()).select("record_id", "article_id")


@query(f"WITH {SQL_RANKED} SELECT edition_id, epoch_us(max(published_at)) AS started FROM rk GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 10")
def latest_runs(spark, sf):
    runs = T.ranked(spark, sf).groupBy("edition_id").agg(F.max(F.unix_micros(F.col("published_at").cast("timestamp"))).alias("started"))
    return ingest.latest_runs(runs, 10, "started", "edition_id")


@query(f"WITH {SQL_ARTICLES} SELECT article_id, row_number() OVER (ORDER BY published_at NULLS FIRST, article_id) AS place FROM art")
def recalled_order(spark, sf):
    rows = T.articles(spark, sf).select("article_id", "published_at")
    return pool.positions(rows, [F.col("published_at").asc_nulls_first(), F.col("article_id")], "place").select("article_id", "place")


@query(f"WITH {SQL_ARTICLES}, o AS (SELECT article_id, source_id, row_number() OVER (ORDER BY published_at NULLS FIRST, article_id) AS place FROM art WHERE source_id IS DISTINCT FROM (SELECT min(id) FROM sources)) SELECT article_id, 0 AS batch FROM art WHERE source_id = (SELECT min(id) FROM sources) UNION ALL SELECT article_id, CAST((place - 1) // 50 + 1 AS INT) FROM o")
def reserved_batches(spark, sf):
    source = T.table(spark, sf, "sources").agg(F.min("id")).first()[0]
    rows = T.articles(spark, sf).select("article_id", "source_id", "published_at")
    return pool.reserved_first(rows, source, [F.col("published_at").asc_nulls_first(), F.col("article_id")], 50).select("article_id", "batch")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql) | {
        "seat_edition": _SEATS,
        "dedupe_articles": _DEDUPE + "SELECT article_id, kept, reason, CASE WHEN NOT kept THEN (SELECT min(o.article_id) FROM w o JOIN k ok ON o.article_id = ok.article_id JOIN k me ON me.article_id = w.article_id WHERE o.kept AND CASE w.reason WHEN 'url' THEN ok.uk = me.uk WHEN 'content' THEN ok.hk = me.hk ELSE ok.tk = me.tk END) END AS survivor FROM w WHERE r > 0",
        "dedupe_reasons": _DEDUPE + "SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM w WHERE r > 0 GROUP BY 1",
    }
