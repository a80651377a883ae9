"""Core queries over the catalog tables, each with the SQL that checks it. Every query runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marlstone.functions.text import embedding_text, plain_words, source_key
from marlstone.functions.urls import canonical_key, owner_repo, stable_id, subtree_hint
from marlstone.operators import incremental as inc
from marlstone.operators import merge, stats
from marlstone.operators import vectors as vec
from marlstone.session import table
from marlstone.sinks import writers
from marlstone.sources import documents as docs_

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

KEY = r"regexp_replace(rtrim(lower(nullif({}, '')), '/'), '\.git$', '')"
OWN = KEY.format("coalesce(nullif(raw_metadata.skill_md_url, ''), repo_url)")


def query(sql: str | None = None):
    """Registers a query and, where SQL can express it, its check."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def skills(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "skillsmp")


def flat(spark: SparkSession, d: str) -> DataFrame:
    """skillsmp with its metadata as columns, its key and its order."""
    s = skills(spark, d)
    m = [F.col(f"raw_metadata.{c}") for c in ("stars", "pushed_at", "default_branch", "skill_md_url", "platforms", "topics")]
    own = merge.dedup_key(F.col("repo_url"), F.col("raw_metadata.skill_md_url"))
    return s.select("rec_id", F.col("rec_id").alias("ord"), "repo_url", "name", "description", "source", "load_no", *m, own.alias("key"))


def merged(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_records(flat(spark, d))


FLAT = f"""flat AS (SELECT rec_id, repo_url, name, description, source, load_no, raw_metadata.stars AS stars, raw_metadata.pushed_at AS pushed_at,
 raw_metadata.skill_md_url AS skill_md_url, raw_metadata.platforms AS platforms, raw_metadata.topics AS topics, {OWN} AS key FROM skillsmp)"""
MERGED = f"""{FLAT}, keyed AS (SELECT * FROM flat WHERE key IS NOT NULL),
one AS (SELECT key, arg_min({KEY.format('repo_url')}, rec_id) AS first_repo, count(*) AS n_records,
  coalesce(arg_min(name, rec_id) FILTER (WHERE name <> ''), '') AS name,
  coalesce(arg_max(description, length(description) * 1000000000000::HUGEINT - rec_id) FILTER (WHERE description <> ''), '') AS description,
  greatest(0, coalesce(max(stars), 0)) AS stars, coalesce(max(pushed_at) FILTER (WHERE pushed_at <> ''), '') AS last_updated,
  coalesce(arg_min(skill_md_url, rec_id) FILTER (WHERE skill_md_url <> ''), '') AS skill_md_url FROM keyed GROUP BY key),
srcs AS (SELECT key, list(source ORDER BY o) AS source FROM (SELECT key, source, min(rec_id) AS o FROM keyed WHERE source <> '' GROUP BY ALL) GROUP BY key),
cats AS (SELECT key, list(DISTINCT c ORDER BY c) AS categories FROM (SELECT key, unnest(topics) AS c FROM keyed) WHERE c <> '' GROUP BY key),
plats AS (SELECT key, list(DISTINCT p ORDER BY p) AS platforms FROM (SELECT key, unnest(platforms) AS p FROM keyed) WHERE p <> '' GROUP BY key),
merged AS (SELECT one.*, sha256(one.key) AS id, coalesce(source, []) AS source, coalesce(categories, []) AS categories, coalesce(platforms, []) AS platforms
  FROM one LEFT JOIN srcs USING (key) LEFT JOIN cats USING (key) LEFT JOIN plats USING (key))"""


# --- addresses and identifiers ----------------------------------------------------------------------


@query(f"SELECT rec_id, {KEY.format('repo_url')} AS canonical FROM skillsmp")
def canonical_keys(spark, d):
    """PJ1, FN1-FN4"""
    return skills(spark, d).select("rec_id", canonical_key(F.col("repo_url")).alias("canonical"))


@query(
    f"""SELECT rec_id, CASE WHEN contains(k, '/tinpelican/') THEN replace(k, '/tinpelican/', '/duskgrove/') WHEN contains(k, '/gravelnote/') THEN replace(k, '/gravelnote/', '/duskgrove/') ELSE k END AS canonical
 FROM (SELECT rec_id, {KEY.format('repo_url')} AS k FROM skillsmp)"""
)
def canonical_keys_renamed(spark, d):
    """PJ1 with ordered renames"""
    return skills(spark, d).select("rec_id", canonical_key(F.col("repo_url"), [("/tinpelican/", "/duskgrove/"), ("/gravelnote/", "/duskgrove/")]).alias("canonical"))


@query(f"SELECT rec_id, sha256({OWN}) AS id FROM skillsmp")
def stable_ids(spark, d):
    """PJ2, PJ3, FN8"""
    return flat(spark, d).select("rec_id", stable_id(F.col("key")).alias("id"))


@query(
    r"""SELECT rec_id, CASE WHEN r <> '' THEN o || '/' || r END AS repo FROM (SELECT rec_id, regexp_extract(u, p, 1) AS o, regexp_replace(regexp_extract(u, p, 2), '\.git$', '') AS r
 FROM (SELECT rec_id, lower(coalesce(repo_url, '')) AS u, '^\s*(?:https?://)?(?:www\.)?forge\.example/+([^/?#\s]+)/+([^/?#\s]+)' AS p FROM skillsmp))"""
)
def owner_repos(spark, d):
    """PJ4-PJ6, FN7"""
    return skills(spark, d).select("rec_id", owner_repo(F.col("repo_url"), "forge.example").alias("repo"))


@query("SELECT doc_id, nullif(regexp_extract(repo_url || '/tree/main/' || path, '/tree/[^/]+/(.+)', 1), '') AS hint FROM documents")
def subtree_hints(spark, d):
    """PJ7, SC32"""
    return table(spark, d, "documents").select("doc_id", subtree_hint(F.concat(F.col("repo_url"), F.lit("/tree/main/"), F.col("path"))).alias("hint"))


@query("SELECT doc_id, coalesce(nullif(list_extract(string_split(path, '/'), -2), ''), list_extract(string_split(repo_url, '/'), -1)) AS name FROM documents")
def parent_names(spark, d):
    """PJ12, FN2"""
    return table(spark, d, "documents").select("doc_id", docs_.parent_name(F.col("path"), F.col("repo_url")).alias("name"))


# --- merge, filter, texts ----------------------------------------------------------------------------


@query(
    f"""WITH {MERGED} SELECT id, first_repo AS repo_url, name, description, stars, last_updated, skill_md_url, n_records, array_to_string(source, '|') AS sources,
 array_to_string(categories, '|') AS categories, array_to_string(platforms, '|') AS platforms FROM merged"""
)
def merge_records(spark, d):
    """AG1, AG2, ST1, FN18"""
    j = lambda c: F.array_join(c, "|")
    return merged(spark, d).select("id", "repo_url", "name", "description", "stars", "last_updated", "skill_md_url", "n_records", j("source").alias("sources"), j("categories").alias("categories"), j("platforms").alias("platforms"))


@query(
    """WITH h AS (SELECT regexp_replace(rtrim(lower(nullif(coalesce(nullif(raw_metadata.skill_md_url, ''), repo_url), '')), '/'), '\\.git$', '') AS key, hub_id, raw_metadata.rank AS rank, raw_metadata.overall_score AS score FROM skillhub)
 SELECT sha256(key) AS id, arg_max(rank, hub_id) FILTER (WHERE rank IS NOT NULL) AS rank, round(arg_max(score, hub_id) FILTER (WHERE score IS NOT NULL), 6) AS score FROM h WHERE key IS NOT NULL GROUP BY key"""
)
def merge_last_wins(spark, d):
    """AG2: last non-null rank and score; an empty rank counts as a value"""
    h = table(spark, d, "skillhub")
    key = merge.dedup_key(F.col("repo_url"), F.col("raw_metadata.skill_md_url"))
    r = h.select(key.alias("key"), F.col("hub_id").alias("ord"), "repo_url", "name", "description", "source", F.col("raw_metadata.rank").alias("rank"), F.col("raw_metadata.overall_score").alias("score"))
    return merge.merge_records(r).select("id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {MERGED} SELECT id, stars FROM merged WHERE description <> '' AND stars >= 10")
def quality_filter(spark, d):
    """PR1"""
    return merged(spark, d).where(merge.drop_reason(F.col("description"), F.col("stars")).isNull()).select("id", "stars")


@query(
    f"""WITH {MERGED}, r AS (SELECT CASE WHEN description = '' THEN 'no_description' WHEN stars = 0 THEN 'zero_stars' WHEN stars < 10 THEN 'low_stars' END AS reason,
 unnest(CASE WHEN len(source) > 0 THEN source ELSE ['unknown'] END) AS source FROM merged) SELECT reason, source, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY ALL"""
)
def drop_reasons(spark, d):
    """PR2, AG3"""
    return merge.drop_counts(merged(spark, d))


@query(
    f"""WITH {MERGED} SELECT id, concat_ws(' ', name || '. ' || description, CASE WHEN len(categories) > 0 THEN 'Categories: ' || array_to_string(categories, ', ') || '.' END,
 CASE WHEN len(platforms) > 0 THEN 'Platforms: ' || array_to_string(platforms, ', ') || '.' END) AS embedding_text FROM merged WHERE name <> '' AND description <> ''"""
)
def embedding_texts(spark, d):
    """PJ8"""
    m = merged(spark, d).where("name <> '' and description <> ''")
    return m.select("id", embedding_text(F.col("name"), F.col("description"), F.col("categories"), F.col("platforms"), F.col("triggers")).alias("embedding_text"))


@query(
    f"""WITH {MERGED}, c AS (SELECT id, CASE WHEN list_has_any(source, ['skillsmp', 'marketplace', 'topic']) THEN 'assistant=add ' || name END AS a,
 CASE WHEN list_contains(platforms, 'codex') THEN 'codex=copy' END AS b, CASE WHEN list_contains(source, 'clawhub') THEN 'openclaw=fetch ' || name END AS o FROM merged)
 SELECT id, concat_ws(';', a, b, o) AS commands FROM c"""
)
def command_maps(spark, d):
    """PJ9, FN19"""
    t = {s: ("assistant", "add {name}") for s in ("skillsmp", "marketplace", "topic")} | {"clawhub": ("openclaw", "fetch {name}")}
    m = merge.command_map(F.col("source"), F.col("name"), F.col("platforms"), t, {"codex": "copy"})
    return merged(spark, d).select("id", F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("commands"))


@query("SELECT rec_id, array_to_string(CASE WHEN raw_metadata.platforms IS NOT NULL THEN list_filter(raw_metadata.platforms, lambda p: p <> '') WHEN source = 'clawhub' THEN ['openclaw'] ELSE ['assistant'] END, '|') AS platforms FROM skillsmp")
def inferred_platforms(spark, d):
    """PJ10, PJ11"""
    s = flat(spark, d)
    return s.select("rec_id", F.array_join(merge.infer_platforms(F.col("platforms"), F.lit(False), F.col("source"), {"clawhub": "openclaw"}, "assistant"), "|").alias("platforms"))


@query(f"WITH {MERGED} SELECT id FROM merged WHERE list_has_any(platforms, ['codex', 'openclaw']) AND list_has_any(source, ['skillsmp', 'topic']) AND stars >= 10")
def attribute_filter(spark, d):
    """PR4, ST4"""
    return merged(spark, d).where(vec.attribute_filter(["codex", "openclaw"], ["skillsmp", "topic"], 10)).select("id")


# --- reports -----------------------------------------------------------------------------------------

SRC = r"regexp_replace(lower(coalesce(source, '')), '[^\p{L}\p{N}]+', '', 'g')"


@query(
    f"""WITH s AS (SELECT {SRC} AS src, coalesce(raw_metadata.stars, 0) AS v, trim(coalesce(description, '')) = '' AS e FROM skillsmp),
 g AS (SELECT src, count(*) AS total, count(*) FILTER (WHERE e) AS no_description, count(*) FILTER (WHERE v = 0) AS zero_stars, list(v ORDER BY v) AS l FROM s GROUP BY src)
 SELECT src AS source, total, no_description, zero_stars, CAST(floor((l[CAST(floor((total - 1) / 2) AS BIGINT) + 1] + l[CAST(floor(total / 2) AS BIGINT) + 1]) / 2) AS BIGINT) AS median,
 l[CAST(least(floor(total * 95 / 100), total - 1) AS BIGINT) + 1] AS p95, round(100 * no_description / total, 6) AS pct_no_description, round(100 * zero_stars / total, 6) AS pct_zero_stars FROM g"""
)
def source_stats(spark, d):
    """AG4-AG6, SK13"""
    s = skills(spark, d).select(source_key(F.col("source")).alias("source"), F.col("raw_metadata.stars").alias("stars"), "description")
    return stats.source_stats(s, "source", "stars", "description")


@query(
    f"""WITH s AS (SELECT {SRC} AS source, coalesce(raw_metadata.stars, 0) AS v, trim(coalesce(description, '')) = '' AS e FROM skillsmp)
 SELECT source, round(100 * avg(e::INT), 6) AS pct_no_description, round(100 * avg((v = 0)::INT), 6) AS pct_zero_stars FROM s GROUP BY source HAVING avg(e::INT) > 0.05 OR avg((v = 0)::INT) > 0.15"""
)
def source_warnings(spark, d):
    """PR11"""
    return stats.warnings(source_stats(spark, d)).select("source", "pct_no_description", "pct_zero_stars")


def _case(edges, v: str) -> str:
    return "CASE " + " ".join(f"WHEN {v} >= {lo}" + ("" if hi is None else f" AND {v} <= {hi}") + f" THEN '{label}'" for label, lo, hi in edges) + " END"


@query(f"WITH {MERGED} SELECT {_case(stats.DOC_BUCKETS, 'stars')} AS bucket, count(*) AS n FROM merged GROUP BY 1")
def histogram_docs(spark, d):
    """PR10, AG7, CT14"""
    return stats.histogram(merged(spark, d), F.col("stars"), stats.DOC_BUCKETS)


@query(f"SELECT {SRC} AS source, {_case(stats.REPORT_BUCKETS, 'v')} AS bucket, count(*) AS n FROM (SELECT source, coalesce(raw_metadata.stars, 0) AS v FROM skillsmp) WHERE v >= 0 GROUP BY ALL")
def histogram_report(spark, d):
    """PR10, AG8"""
    s = skills(spark, d).select(source_key(F.col("source")).alias("source"), F.coalesce(F.col("raw_metadata.stars"), F.lit(0)).alias("v"))
    return stats.histogram(s, F.col("v"), stats.REPORT_BUCKETS, ["source"])


@query(f"WITH {MERGED} SELECT unnest(source) AS source, count(*) AS n FROM merged GROUP BY 1")
def membership_counts(spark, d):
    """AG7, CT9"""
    return stats.memberships(merged(spark, d), F.col("source"), "source")


@query(f"SELECT {SRC} AS source, load_no, count(*) AS n, count(*) FILTER (WHERE raw_metadata.stars = 0) AS zero FROM skillsmp GROUP BY ROLLUP ({SRC}, load_no)")
def totals_rollup(spark, d):
    """AG8"""
    s = skills(spark, d).select(source_key(F.col("source")).alias("source"), "load_no", F.col("raw_metadata.stars").alias("v"))
    return s.rollup("source", "load_no").agg(F.count("*").alias("n"), F.count_if(F.col("v") == 0).alias("zero"))


@query(
    """WITH l AS (SELECT max(load_no) AS m FROM skillsmp), c AS (SELECT count(*) FILTER (WHERE load_no = m) AS current, count(*) FILTER (WHERE load_no = m - 1) AS previous FROM skillsmp, l)
 SELECT current, previous, round((previous - current) / greatest(previous, 1), 6) AS drop_share, (previous - current) / greatest(previous, 1) <= 0.1 AS passed FROM c"""
)
def regression_gate(spark, d):
    """AG9, CT8"""
    s = skills(spark, d)
    last = s.agg(F.max("load_no")).collect()[0][0] or 0
    r = s.agg(F.count_if(F.col("load_no") == last).alias("c"), F.count_if(F.col("load_no") == last - 1).alias("p")).collect()[0]
    ok, drop = stats.regression_gate(r.c, r.p, 0.1)
    return spark.createDataFrame([(r.c, r.p, round(drop, 6), ok)], "current bigint, previous bigint, drop_share double, passed boolean")


@query(
    """SELECT class, count(*) AS n FROM (SELECT CASE WHEN load_no % 7 = 3 THEN 'conditional' WHEN contains(u, 'raw=1') THEN 'raw' WHEN contains(u, '/graphql') THEN 'graphql' WHEN contains(u, '/skills/') THEN 'search' ELSE 'rest' END AS class
 FROM (SELECT load_no, coalesce(raw_metadata.skill_md_url, repo_url, '') AS u FROM skillsmp)) GROUP BY class"""
)
def request_classes(spark, d):
    """PR13, AG10, CT13: addresses stand for requests, the load number for the status"""
    s = skills(spark, d).select(F.coalesce("raw_metadata.skill_md_url", "repo_url", F.lit("")).alias("u"), F.when(F.col("load_no") % 7 == 3, 304).otherwise(200).alias("status"))
    return s.select(stats.request_class(F.col("u"), F.col("status"), "raw=1", search_path="/skills/").alias("class")).groupBy("class").agg(F.count("*").alias("n"))


@query("SELECT max('index-' || date) AS latest FROM release_log")
def latest_tag(spark, d):
    """AG14"""
    return stats.latest_with_prefix(table(spark, d, "release_log").select(F.concat(F.lit("index-"), "date").alias("tag")), "tag", "index-")


@query("SELECT date, CASE WHEN regexp_matches(replace(t, '-', ''), '^[0-9]{8}$') THEN coalesce(try_cast(t AS DATE) > DATE '2025-06-30', true) ELSE true END AS stale FROM (SELECT DISTINCT date, date AS t FROM release_log)")
def update_needed(spark, d):
    """PR6, FN17"""
    r = table(spark, d, "release_log").select("date").distinct()
    return r.select("date", stats.needs_update(F.lit("2025-06-30"), F.concat(F.lit("index-"), "date")).alias("stale"))


@query("""SELECT rec_id, CASE WHEN s >= 10000 THEN (s // 1000) || 'k' WHEN s >= 1000 THEN (t // 10) || '.' || (t % 10) || 'k' ELSE CAST(s AS VARCHAR) END AS label
 FROM (SELECT rec_id, s, s // 100 + CASE WHEN s % 100 > 50 OR s % 100 = 50 AND (s // 100) % 2 = 1 THEN 1 ELSE 0 END AS t FROM (SELECT rec_id, raw_metadata.stars AS s FROM skillsmp))""")
def star_labels(spark, d):
    """FN15, FN16: every record; tenths of thousands are rounded half to even"""
    return flat(spark, d).select("rec_id", stats.short_stars(F.col("stars")).alias("label"))


@query(f"WITH {MERGED}, h AS (SELECT {_case(stats.DOC_BUCKETS, 'stars')} AS bucket, count(*) AS n FROM merged GROUP BY 1) SELECT bucket, rpad(repeat('█', CAST(greatest(1, round_even(100.0 * n / sum(n) OVER () / 100 * 20, 0)) AS INT)), 20, '░') AS bar FROM h")
def bars(spark, d):
    """FN14"""
    h = histogram_docs(spark, d).withColumn("total", F.sum("n").over(W.partitionBy(F.lit(0))))  # one row a bucket
    return h.select("bucket", stats.bar(100.0 * F.col("n") / F.col("total")).alias("bar"))


@query(
    f"""WITH {MERGED}, h AS (SELECT {_case(stats.DOC_BUCKETS, 'stars')} AS bucket, count(*) AS n FROM merged GROUP BY 1), s AS (SELECT *, 100.0 * n / sum(n) OVER () AS p FROM h)
 SELECT CAST(list_position({[e[0] for e in stats.DOC_BUCKETS]}, bucket) - 1 AS INT) AS place, '| ' || bucket || ' | ' || format('{{:,}}', n) || ' | ' || rpad(repeat('█', CAST(greatest(1, round_even(p / 5, 0)) AS INT)), 20, '░') || ' ' || CAST(CAST(round_even(p, 0) AS INT) AS VARCHAR) || '% |' AS line FROM s
 UNION ALL SELECT {len(stats.DOC_BUCKETS)}, '| **Total** | **' || format('{{:,}}', CAST(sum(n) AS BIGINT)) || '** | |' FROM h"""
)
def distribution_lines(spark, d):
    """CT14, FN14, FN16: the star histogram as the lines of a table"""
    return writers.distribution_lines(histogram_docs(spark, d), stats.DOC_BUCKETS)


@query("SELECT format('{:,}', count(*) // 500 * 500) || '+' AS quoted FROM skillsmp")
def quoted_count(spark, d):
    """CT14, FN13"""
    return skills(spark, d).agg(F.count("*").alias("n")).select(writers.rounded_count(F.col("n")).alias("quoted"))


# --- increments --------------------------------------------------------------------------------------


@query("SELECT hub_id FROM skillhub h WHERE NOT EXISTS (SELECT 1 FROM skillsmp s WHERE s.repo_url = h.repo_url)")
def new_rows_anti(spark, d):
    """JN4, SC11, ST3"""
    return inc.new_rows(table(spark, d, "skillhub"), skills(spark, d), "repo_url").select("hub_id")


@query(
    """WITH c AS (SELECT repo_url AS k, arg_max_null(description, rec_id) AS t, max(rec_id) AS v FROM skillsmp WHERE load_no <= 3 AND repo_url IS NOT NULL GROUP BY repo_url)
 SELECT rec_id, coalesce(c.t = s.description AND s.repo_url <> '', false) AS hit, CASE WHEN c.t = s.description AND s.repo_url <> '' THEN c.v END AS cached FROM skillsmp s LEFT JOIN c ON c.k = s.repo_url"""
)
def cache_split(spark, d):
    """JN3, SC17, CT5; a null cached text is no hit"""
    s = skills(spark, d)
    cache = s.where("load_no <= 3").select("repo_url", "description", F.col("rec_id").alias("cached"), F.col("rec_id").alias("ord"))
    return inc.split_by_cache(s.select("rec_id", "repo_url", "description"), cache, "repo_url", "description", "cached").select("rec_id", "hit", "cached")


@query(
    r"""WITH s AS (SELECT rec_id, raw_metadata.stars AS stars, raw_metadata.pushed_at AS pushed_at, raw_metadata.default_branch AS b, CASE WHEN r <> '' THEN o || '/' || r END AS repo FROM (SELECT *, regexp_extract(u, p, 1) AS o, regexp_replace(regexp_extract(u, p, 2), '\.git$', '') AS r
 FROM (SELECT *, lower(coalesce(repo_url, '')) AS u, '^\s*(?:https?://)?(?:www\.)?forge\.example/+([^/?#\s]+)/+([^/?#\s]+)' AS p FROM skillsmp))),
 j AS (SELECT s.*, m.repo AS mr, m.stargazers_count AS ms, m.pushed_at AS mp, m.default_branch AS mb, coalesce(s.stars, 0) = 0 AND m.repo IS NOT NULL AS f FROM s LEFT JOIN repo_meta m ON m.repo = s.repo)
 SELECT rec_id, CASE WHEN f THEN coalesce(ms, stars) ELSE stars END AS stars, CASE WHEN f THEN coalesce(mp, pushed_at) ELSE pushed_at END AS pushed_at,
 CASE WHEN f THEN coalesce(nullif(b, ''), mb) ELSE b END AS default_branch, f AND coalesce(ms > 0, false) AS updated FROM j"""
)
def backfill(spark, d):
    """JN5, PR5, SC24, SC25, CT4"""
    s = flat(spark, d).withColumn("repo", owner_repo(F.col("repo_url"), "forge.example"))
    return inc.backfill_stars(s, table(spark, d, "repo_meta")).select("rec_id", "stars", "pushed_at", "default_branch", "updated")


@query(
    r"""WITH s AS (SELECT rec_id, description, CASE WHEN r <> '' THEN o || '/' || r END AS repo FROM (SELECT *, regexp_extract(u, p, 1) AS o, regexp_replace(regexp_extract(u, p, 2), '\.git$', '') AS r
 FROM (SELECT *, lower(coalesce(repo_url, '')) AS u, '^\s*(?:https?://)?(?:www\.)?forge\.example/+([^/?#\s]+)/+([^/?#\s]+)' AS p FROM skillsmp)))
 SELECT rec_id, coalesce(nullif(s.description, ''), nullif(m.description, ''), s.description) AS description FROM s LEFT JOIN repo_meta m ON m.repo = s.repo"""
)
def backfill_description(spark, d):
    """JN6"""
    s = flat(spark, d).withColumn("repo", owner_repo(F.col("repo_url"), "forge.example"))
    m = table(spark, d, "repo_meta").select("repo", F.col("description").alias("meta_description"))
    return inc.backfill_descriptions(s.join(m, "repo", "left"), F.lit(None).cast("string"), F.col("meta_description")).select("rec_id", "description")


@query("WITH d AS (SELECT date, max(skill_count) AS skill_count FROM release_log WHERE date IS NOT NULL GROUP BY date) SELECT date, skill_count, skill_count - last_value(skill_count IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS delta FROM d")
def release_delta(spark, d):
    """WN1, WN2, TK6"""
    return inc.release_deltas(table(spark, d, "release_log"))


@query("WITH l AS (SELECT max(load_no) AS m FROM skillsmp), n AS (SELECT repo_url, max(rec_id) AS rec_id FROM skillsmp, l WHERE load_no = m AND repo_url IS NOT NULL GROUP BY repo_url) SELECT repo_url, rec_id FROM (SELECT repo_url, max(rec_id) AS rec_id FROM skillsmp, l WHERE load_no < m AND repo_url IS NOT NULL GROUP BY repo_url) o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.repo_url = o.repo_url) UNION ALL SELECT * FROM n")
def upsert_latest(spark, d):
    """ST5"""
    s = skills(spark, d).where("repo_url is not null").select("repo_url", "rec_id", "load_no")
    last = s.agg(F.max("load_no")).collect()[0][0] or 0
    per = lambda df: inc.latest_per_key(df.select("repo_url", "rec_id"), "repo_url", ["rec_id"])
    return inc.upsert(per(s.where(F.col("load_no") < last)), per(s.where(F.col("load_no") == last)), "repo_url")


@query("SELECT repo_url, arg_min(rec_id, rec_id) AS rec_id, arg_min(name, rec_id) AS name FROM (SELECT repo_url, rec_id, coalesce(name, '') AS name FROM skillsmp) WHERE repo_url IS NOT NULL GROUP BY repo_url")
def first_rows(spark, d):
    """WN4, AG11, SC36"""
    s = skills(spark, d).where("repo_url is not null").select("repo_url", "rec_id", F.coalesce("name", F.lit("")).alias("name"))
    return inc.first_per_key(s, "repo_url", ["rec_id"])


@query("SELECT rec_id, row_number() OVER (ORDER BY rec_id) - 1 AS row_no, (row_number() OVER (ORDER BY rec_id) - 1) // 128 AS batch_no FROM skillsmp")
def batch_numbers(spark, d):
    """WN5, WN6"""
    return inc.numbered(skills(spark, d).select("rec_id"), "rec_id", 128).select("rec_id", F.col("row_no").cast("bigint").alias("row_no"), F.col("batch_no").cast("bigint").alias("batch_no"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_click FROM events")
def carried_forward(spark, d):
    """WN3 on events"""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.struct("ts", "event_id").alias("o"))
    return inc.carry_forward(e, "user_id", "o", F.when(F.col("event_type") == "click", F.col("event_id")), "last_click").select("event_id", "last_click")


@query("SELECT r_name || '|' || n_name AS shard FROM region CROSS JOIN nation")
def shard_names(spark, d):
    """JN10: a fixed grid of two small fixed tables"""
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    return r.select("r_name").crossJoin(n.select("n_name")).select(F.concat_ws("|", "r_name", "n_name").alias("shard"))


@query("SELECT l_returnflag, CAST(floor(l_quantity / 10) AS BIGINT) AS size_bucket, count(*) AS total, count(*) < 950 AS exhausted FROM lineitem GROUP BY ALL")
def shard_overflow(spark, d):
    """PR12"""
    from marlstone.sources.recorded import exhausted

    g = table(spark, d, "lineitem").groupBy("l_returnflag", F.floor(F.col("l_quantity") / 10).alias("size_bucket")).agg(F.count("*").alias("total"))
    return g.withColumn("exhausted", exhausted(F.col("total")))


@query(
    r"""WITH s AS (SELECT DISTINCT repo_url AS repo, coalesce(name, '') AS name FROM skillsmp WHERE repo_url IS NOT NULL), p AS (SELECT DISTINCT repo_url AS repo, path FROM documents WHERE repo_url IS NOT NULL AND path IS NOT NULL),
 j AS (SELECT s.repo, s.name, p.path, regexp_replace(lower(s.name), '[^a-z0-9]', '', 'g') AS n, regexp_replace(lower(coalesce(list_extract(string_split(p.path, '/'), -2), '')), '[^a-z0-9]', '', 'g') AS f FROM s JOIN p USING (repo))
 SELECT repo, name, coalesce(min(path) FILTER (WHERE contains(n, f) OR contains(f, n)), min(path)) AS path FROM j GROUP BY repo, name"""
)
def matched_paths(spark, d):
    """JN9, FN6"""
    s = skills(spark, d).where("repo_url is not null").select(F.col("repo_url").alias("repo"), F.coalesce("name", F.lit("")).alias("name")).distinct()
    p = table(spark, d, "documents").where("repo_url is not null and path is not null").select(F.col("repo_url").alias("repo"), "path").distinct().withColumn("pos", F.col("path"))
    return inc.match_by_name(s, p, "repo").select("repo", "name", "path")


# --- texts -------------------------------------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, d):
    """FN10"""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("""SELECT doc_id, array_to_string(regexp_extract_all(coalesce(text, ''), '<a\\s[^<>]*href="([^"]*)"', 1), ' ') AS links FROM documents""")
def html_links(spark, d):
    """FN20, FN5"""
    return table(spark, d, "documents").select("doc_id", F.array_join(docs_.html_links(F.coalesce("text", F.lit(""))), " ").alias("links"))


@query("SELECT doc_id, regexp_replace(text, '<!--[^>]*-->', '<!-- removed -->', 'g') AS text FROM documents")
def comment_rewrite(spark, d):
    """SK12, FN5"""
    return table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "<!--[^>]*-->", "<!-- removed -->").alias("text"))


@query("SELECT doc_id, coalesce(contains(text, '---') OR length(text) > 200, false) AS ok FROM documents")
def document_like(spark, d):
    """PR7"""
    return table(spark, d, "documents").select("doc_id", docs_.looks_like_document(F.col("text")).alias("ok"))


@query()
def frontmatter_fields(spark, d):
    """FN11"""
    t = table(spark, d, "documents").select("doc_id", docs_.frontmatter_json("text").alias("meta"))
    return t.select("doc_id", F.get_json_object("meta", "$.name").alias("name"), F.get_json_object("meta", "$.description").alias("description"), F.size(F.from_json(F.get_json_object("meta", "$.triggers"), "array<string>")).alias("n_triggers"))


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS s, unnest(range(len(string_split(t, chr(10))))) AS line FROM (SELECT doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS t FROM documents WHERE text IS NOT NULL)),
 h AS (SELECT *, nullif(trim(regexp_extract(s, '^##\s+([^\r\n]+)$', 1)), '') AS head, '^\s*[-*]\s+\[([^\]]+)\]\((https?://[^)\s]+)\)\s*(?:[—–:-]+\s*(.*))?$' AS p FROM l),
 c AS (SELECT *, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS category FROM h)
 SELECT doc_id, CAST(line AS INT) AS line, category, regexp_extract(s, p, 1) AS name, regexp_extract(s, p, 2) AS url, trim(regexp_extract(s, p, 3)) AS description FROM c WHERE regexp_matches(s, p)"""
)
def link_lists(spark, d):
    """WN3, SC28, SC33"""
    return docs_.link_list(table(spark, d, "documents"), "doc_id", "text")


@query()
def html_pages(spark, d):
    """FN20, SC34"""
    t = table(spark, d, "documents").select("doc_id", docs_.html_parts("text").alias("h"))
    return t.select("doc_id", F.size("h.links").alias("n_links"), F.length("h.text").alias("n_text"))


@query("SELECT rec_id, sha256(array_to_string(list_filter(string_split(regexp_replace(lower(coalesce(source, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> ''), '-')) AS h FROM skillsmp")
def squashed_hash(spark, d):
    """FN2, FN6, FN8"""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce("source", F.lit(""))), "[^a-z0-9]+", " "), " "), lambda x: x != "")
    return skills(spark, d).select("rec_id", F.sha2(F.array_join(words, "-").cast("binary"), 256).alias("h"))


# --- vectors -----------------------------------------------------------------------------------------

Q = "q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 50 = 0)"
DOT = "CAST(list_dot_product(CAST(qe AS DOUBLE[]), CAST({} AS DOUBLE[])) AS DOUBLE)"
RANKED = "(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)"


def _vectors(spark, d) -> tuple[DataFrame, DataFrame]:
    """All vectors, and the stated queries: every row whose id is divisible by 50."""
    v = table(spark, d, "embeddings")
    return v, v.where("vec_id % 50 = 0")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm FROM embeddings")
def l2_norms(spark, d):
    """TK1, FN22"""
    return table(spark, d, "embeddings").select("vec_id", F.round(vec.l2_norm(F.col("embedding")), 6).alias("norm"))


@query(f"WITH {Q}, s AS (SELECT query_id, vec_id AS id, round({DOT.format('embedding')}, 6) AS score FROM embeddings, q) SELECT query_id, id, score, rank FROM {RANKED} WHERE rank <= 10")
def topk_flat(spark, d):
    """TK4, JN12"""
    v, q = _vectors(spark, d)
    return vec.exact_top_k(v, q, 10)


@query(
    f"""WITH {Q}, s AS (SELECT query_id, vec_id AS id, label, round({DOT.format('embedding')}, 6) AS score FROM embeddings, q),
 t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM {RANKED} WHERE rank <= 30 AND label % 2 = 0)
 SELECT query_id, id, label, greatest(0, least(1, score)) AS sim_score, place FROM t WHERE place <= 15"""
)
def topk_postfilter(spark, d):
    """TK5, TK7, PJ15, JN1"""
    v, q = _vectors(spark, d)
    rows = v.select(F.col("vec_id").alias("id"), "label")
    return vec.search(vec.exact_top_k(v, q, 30), rows, F.col("label") % 2 == 0, 5).select("query_id", "id", "label", "sim_score", "place")


@query("SELECT CAST(i - 1 AS INT) AS dim, CAST(min(x) AS DOUBLE) AS lo, CAST(max(x) AS DOUBLE) AS hi FROM (SELECT unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY i")
def sq8_ranges(spark, d):
    """AG13"""
    return vec.ranges(table(spark, d, "embeddings"))


@query(
    f"""WITH {Q}, u AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), r AS (SELECT i, min(x) AS lo, max(x) - min(x) AS span FROM u GROUP BY i),
 c AS (SELECT vec_id, list(lo + (least(255, greatest(0, floor(255 * (x - lo) / span))) + 0.5) / 255 * span ORDER BY u.i) AS e FROM u JOIN r ON r.i = u.i GROUP BY vec_id),
 s AS (SELECT query_id, vec_id AS id, round({DOT.format('e')}, 6) AS score FROM c, q) SELECT query_id, id, score, rank FROM {RANKED} WHERE rank <= 10"""
)
def topk_sq8(spark, d):
    """TK2"""
    v, q = _vectors(spark, d)
    return vec.VectorIndex.build(v, lists=1).search(q, 10)


@query()
def topk_ivf(spark, d):
    """TK3: the lists of a large catalog's index, and as many of them probed as it needs"""
    v, q = _vectors(spark, d)
    return vec.VectorIndex.build(v, lists=vec.IVF_LISTS).search(q, 10)


@query()
def recall_ivf(spark, d):
    """AG12: recall of the inverted lists against brute force"""
    v, q = _vectors(spark, d)
    return vec.recall_at_k(topk_ivf(spark, d), vec.exact_top_k(v, q, 10), 10)


@query(f"WITH {Q}, s AS (SELECT query_id, vec_id AS id, round({DOT.format('embedding')}, 6) AS score FROM embeddings, q) SELECT round(avg((id = query_id)::INT), 6) AS recall FROM {RANKED} WHERE rank = 1")
def recall_self(spark, d):
    """AG12, JN11"""
    v, q = _vectors(spark, d)
    top = vec.exact_top_k(v, q, 1)
    truth = q.select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("id"), F.lit(1).alias("rank"))
    return vec.recall_at_k(top, truth, 1)


@query(
    f"""WITH {Q}, s AS (SELECT query_id, vec_id AS id, label, round({DOT.format('embedding')}, 6) AS score FROM embeddings, q)
 SELECT query_id, rank, id, label, score FROM {RANKED} WHERE rank <= 3"""
)
def result_items(spark, d):
    """SK10, PJ14: hits as JSON, read back"""
    v, q = _vectors(spark, d)
    hits = vec.exact_top_k(v, q, 3).join(v.select(F.col("vec_id").alias("id"), "label"), "id")
    text = hits.select(writers.result_json(hits, ["query_id", "rank", "id", "label", "score"]).alias("j"))
    return text.select(F.from_json("j", "query_id bigint, rank int, id bigint, label int, score double").alias("r")).select("r.*")


# --- round trips through files -------------------------------------------------------------------------


def _raw(spark, d) -> DataFrame:
    return skills(spark, d).select("repo_url", "name", "description", "source", "raw_metadata", F.when(F.col("load_no") == 2, F.lit(True)).alias("tombstone"))


@query("SELECT repo_url, name, description, source, raw_metadata.stars AS stars FROM skillsmp WHERE load_no <> 2 AND length(repo_url) > 0")
def jsonl_roundtrip(spark, d):
    """SC1, SK1, PR3, SM5: written as lines and scanned tolerantly; the second load as tombstones"""
    from marlstone.session import shared_folder
    from marlstone.sources.jsonl import scan_records

    path = shared_folder(spark, "jsonl")
    writers.write_records(_raw(spark, d), path)
    return scan_records(spark, [path, f"{path}-missing"]).select("repo_url", "name", "description", "source", F.col("raw_metadata.stars").alias("stars"))


@query("SELECT coalesce(nullif(raw_metadata.skill_md_url, ''), repo_url) AS key, count(*) AS n FROM skillsmp WHERE coalesce(nullif(raw_metadata.skill_md_url, ''), repo_url) <> '' GROUP BY 1")
def resume_keys(spark, d):
    """SC5, SC7"""
    s = skills(spark, d).select(F.coalesce(F.nullif(F.col("raw_metadata.skill_md_url"), F.lit("")), "repo_url").alias("key"))
    return s.where("key <> ''").groupBy("key").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT repo_url FROM skillsmp WHERE repo_url <> ''")
def known_urls(spark, d):
    """SC4, SC6, SC8"""
    from marlstone.sources.jsonl import known_values

    return known_values(skills(spark, d), "repo_url")


@query("SELECT doc_id, trim(regexp_replace(lower(coalesce(source, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS words FROM documents")
def normal_words(spark, d):
    """FN1, FN5"""
    return table(spark, d, "documents").select("doc_id", F.trim(plain_words(F.coalesce("source", F.lit("")))).alias("words"))


@query("SELECT event_type, user_id, count(*) AS n FROM (SELECT DISTINCT event_id, event_type, user_id FROM events) GROUP BY ALL")
def incremental_stream(spark, d):
    """SM1, SM3: events as a stream, appended once each, then counted"""
    from marlstone.session import shared_folder
    from marlstone.streaming.append import append_unseen, read_appended

    base = shared_folder(spark, "stream")
    e = table(spark, d, "events")
    e.write.parquet(f"{base}/in")
    append_unseen(spark.readStream.schema(e.schema).parquet(f"{base}/in"), f"{base}/out", "event_id", f"{base}/ckpt").awaitTermination()
    return read_appended(spark, f"{base}/out").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))


