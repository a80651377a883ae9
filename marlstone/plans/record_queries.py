"""Queries over files, states and raw records, each with the SQL that checks it: what is written is read back by the reader that the engine has for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.urls import owner_repo
from marlstone.operators import crawl
from marlstone.operators import incremental as inc
from marlstone.operators.stats import needs_update
from marlstone.plans import pipeline
from marlstone.session import shared_folder, table
from marlstone.sinks import writers
from marlstone.sources import documents as docs_
from marlstone.sources import jsonl

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
HOST = "forge.example"
REPO = r"lower(coalesce(repo_url, '')) AS u, '^\s*(?:https?://)?(?:www\.)?forge\.example/+([^/?#\s]+)/+([^/?#\s]+)' AS p"
OWNED = rf"(SELECT *, CASE WHEN r <> '' THEN o || '/' || r END AS repo FROM (SELECT *, regexp_extract(u, p, 1) AS o, regexp_replace(regexp_extract(u, p, 2), '\.git$', '') AS r FROM (SELECT *, {REPO} FROM {{}})))"


def query(sql: str | None = None):
    """Registers a query and, where SQL can express it, its check."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _renamed(spark, folder: str, into: str, stem: str) -> None:
    """Moves the part files of a written folder to `into` as `stem`-0.jsonl and so on."""
    P = spark._jvm.org.apache.hadoop.fs.Path
    fs = P(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(P(into))
    for i, s in enumerate(x for x in fs.listStatus(P(folder)) if x.getPath().getName().endswith(".json")):
        fs.rename(s.getPath(), P(f"{into}/{stem}-{i}.jsonl"))


# --- files ---------------------------------------------------------------------------------------------


@query("SELECT rec_id, repo_url, name, load_no FROM skillsmp")
def strict_lines(spark, d):
    """SC2: lines that must all be readable"""
    path = shared_folder(spark, "lines")
    writers.write_records(table(spark, d, "skillsmp").select("rec_id", "repo_url", "name", "load_no"), path)
    return jsonl.scan_strict(spark, path, "rec_id bigint, repo_url string, name string, load_no int")


@query("SELECT rec_id, coalesce(nullif(source, ''), CASE WHEN load_no < 4 THEN 'early' ELSE 'late' END) AS source FROM skillsmp")
def folder_lines(spark, d):
    """SC3: all files of a folder; a record without source is of its file's"""
    s, base = table(spark, d, "skillsmp").select("rec_id", "source", "load_no"), shared_folder(spark, "folder")
    for stem, rows in (("early", s.where("load_no < 4")), ("late", s.where("load_no >= 4"))):
        writers.write_records(rows.drop("load_no"), f"{base}/{stem}")
        _renamed(spark, f"{base}/{stem}", f"{base}/all", stem)
    got = jsonl.scan_folder(spark, f"{base}/all", "rec_id bigint, source string, tombstone boolean")
    return got.select("rec_id", F.regexp_replace("source", r"^(early|late)-\d+$", "$1").alias("source"))


@query("SELECT date AS key, max(skill_count) AS skill_count, max(npm_version) AS npm_version FROM release_log WHERE date IS NOT NULL GROUP BY date")
def object_cache(spark, d):
    """SC9, SC10: one JSON object with an entry a release"""
    path = shared_folder(spark, "cache")
    r = table(spark, d, "release_log").where("date is not null").groupBy("date").agg(F.max("skill_count").alias("skill_count"), F.max("npm_version").alias("npm_version"))
    one = r.agg(F.map_from_entries(F.collect_list(F.struct("date", F.struct("skill_count", "npm_version")))).alias("m"))  # release_log is a few hundred rows and doesn't grow
    one.select(F.to_json("m").alias("value")).write.text(path)
    return jsonl.read_object_cache(spark, path, "struct<skill_count:bigint,npm_version:string>").select("key", "value.skill_count", "value.npm_version")


@query("""WITH r AS (SELECT max(date) AS d, max(skill_count) AS n, max(embed_model) AS m, max(index_sha256) AS h FROM release_log)
 SELECT 'date' AS key, d AS value FROM r UNION ALL SELECT 'skill_count', CAST(n AS VARCHAR) FROM r UNION ALL SELECT 'embed_model', m FROM r UNION ALL SELECT 'index_sha256', h FROM r UNION ALL SELECT 'metadata_sha256', h FROM r""")
def manifest_entries(spark, d):
    """SC14, SK16: a manifest, written and read with its required keys"""
    path = shared_folder(spark, "manifest")
    r = table(spark, d, "release_log").agg(F.max("date"), F.max("skill_count"), F.max("embed_model"), F.max("index_sha256")).collect()[0]
    spark.createDataFrame([(line,) for line in writers.manifest_line(r[0], r[1], r[2], r[3], r[3]).splitlines()], "value string").coalesce(1).write.text(path)
    got = jsonl.read_manifest(spark, path, ("date", "skill_count", "embed_model"))
    return spark.createDataFrame(sorted(got.items()), "key string, value string")


@query("SELECT date, skill_count, embed_model, npm_version, coalesce(sources['topic'], 0) AS n_topic FROM release_log")
def release_lines(spark, d):
    """SC15: the release log as strict lines"""
    path, r = shared_folder(spark, "log"), table(spark, d, "release_log")
    writers.write_records(r, path)
    got = jsonl.scan_strict(spark, path, "date string, skill_count bigint, embed_model string, npm_version string, sources map<string,bigint>")
    return got.select("date", "skill_count", "embed_model", "npm_version", F.coalesce(F.try_element_at("sources", F.lit("topic")), F.lit(0)).alias("n_topic"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, CAST((row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1) // 128 AS INT) AS batch_idx, length(coalesce(text, '')) AS n FROM documents")
def resumed_embedding(spark, d):
    """SC16, SK5, SM2, CT5: a run that breaks off after the first batches and is taken up again; the stand-in model gives the length of a text"""
    path, rows = shared_folder(spark, "progress"), table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")

    def lengths(texts):
        import numpy as np

        return np.array([[len(t)] for t in texts], np.float32)

    whole = pipeline.embed_resumable(rows, lengths, path, text="text")
    # all but the first batches are lost
    kept = jsonl.read_progress(spark, path).where("batch_idx < 2").select("batch_idx", "record_ids", F.base64("vectors").alias("vectors_b64"))
    writers.write_records(kept.withColumn("vectors_b64", F.regexp_replace("vectors_b64", r"\s", "")), f"{path}-kept")
    again = pipeline.embed_resumable(rows, lengths, f"{path}-kept", text="text")
    return again.join(whole.select("id"), "id").select("id", "batch_idx", F.col("embedding")[0].cast("bigint").alias("n"))


@query("SELECT CAST(m AS BIGINT) AS min_rows, count(*) >= m AS passed FROM skillsmp, (VALUES (0), (1), (200), (1000000000)) t(m) GROUP BY m")
def gated_writes(spark, d):
    """SK2, CT17: written only with enough rows"""
    path, s, out = shared_folder(spark, "gate"), table(spark, d, "skillsmp").select("rec_id"), []
    for m in (0, 1, 200, 1_000_000_000):
        try:
            writers.write_gated(s, f"{path}/{m}", m)
        except jsonl.QualityGateError:
            pass
        out.append((m, jsonl.exists(spark, f"{path}/{m}")))
    return spark.createDataFrame(out, "min_rows bigint, passed boolean")


# --- exclusion, states ------------------------------------------------------------------------------------


@query("SELECT hub_id FROM skillhub h WHERE NOT EXISTS (SELECT 1 FROM skillsmp s WHERE s.load_no = 1 AND s.repo_url = h.repo_url)")
def unrejected_rows(spark, d):
    """JN7, SK9: what a filter cache of rejected addresses leaves"""
    path = shared_folder(spark, "rejected")
    pipeline.add_filtered(spark, path, table(spark, d, "skillsmp").where("load_no = 1 and repo_url is not null").select(F.col("repo_url").alias("url")), "low_stars")
    cache = spark.read.schema("url string, reason string").json(path).select(F.col("url").alias("repo_url"))
    return inc.exclude_seen(table(spark, d, "skillhub"), cache, "repo_url").select("hub_id")


@query("""WITH d AS (SELECT doc_id, repo_url, repo_url || '#' || path AS k, lang FROM documents), o AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM d x WHERE x.lang = 'en' AND x.k = d.k)),
 one AS (SELECT repo_url FROM o GROUP BY repo_url HAVING count(*) = 1) SELECT doc_id FROM o WHERE NOT EXISTS (SELECT 1 FROM one JOIN skillsmp s USING (repo_url) WHERE one.repo_url = o.repo_url)""")
def unresumed_rows(spark, d):
    """JN8: documents that an earlier run (those declared English) has are left out, those of known repositories with one document as well"""
    t = table(spark, d, "documents").select("doc_id", "repo_url", F.concat_ws("#", "repo_url", "path").alias("k"), "lang")
    return inc.exclude_seen(t, t.where("lang = 'en'"), "k", table(spark, d, "skillsmp").where("repo_url is not null").select("repo_url"), "repo_url").select("doc_id")


@query("""WITH a AS (SELECT l_returnflag || l_linestatus || '-' || l_linenumber AS shard, count(*) FILTER (WHERE l_shipdate < DATE '1996-01-01') AS x, count(*) FILTER (WHERE l_shipdate >= DATE '1996-01-01') AS y FROM lineitem GROUP BY 1),
 b AS (SELECT *, x > 0 AND x < 950 AS done FROM a) SELECT shard, x + CASE WHEN y > 0 AND NOT done THEN y ELSE 0 END AS fetched, CAST((x > 0)::INT + (y > 0 AND NOT done)::INT AS INT) AS runs,
 CASE WHEN y > 0 AND NOT done THEN y < 950 ELSE done END AS exhausted FROM b""")
def shard_states(spark, d):
    """SM4: the shards of two runs; those that the first exhausts aren't asked again"""
    line = table(spark, d, "lineitem").select(F.concat_ws("-", F.concat("l_returnflag", "l_linestatus"), "l_linenumber").alias("shard"), (F.col("l_shipdate") < F.lit("1996-01-01").cast("date")).alias("first"))
    runs = [line.where(c).groupBy("shard").agg(F.count("*").alias("n")) for c in (F.col("first"), ~F.col("first"))]
    return crawl.advance_shards(crawl.advance_shards(None, runs[0]), runs[1])


@query("""SELECT date, CASE WHEN date <= '2025-06-30' THEN 'up_to_date' WHEN npm_version IS NULL THEN 'update_available' WHEN h = g THEN 'updated' ELSE 'error' END AS status
 FROM (SELECT DISTINCT date, npm_version, lower(index_sha256) AS h, CASE WHEN embed_model LIKE '%0.6b' THEN index_sha256 END AS g FROM release_log WHERE date IS NOT NULL)""")
def update_states(spark, d):
    """CT10, PR6, AG15: each release against an installed index of 2025-06-30; releases with a package are installed, the smaller model's files are the right ones"""
    r = table(spark, d, "release_log").where("date is not null").select("date", "npm_version", "index_sha256", F.when(F.col("embed_model").endswith("0.6b"), F.upper("index_sha256")).alias("got")).distinct()
    stale = needs_update(F.lit("2025-06-30"), F.concat(F.lit("index-"), "date"))
    return r.select("date", crawl.update_status(stale, F.col("npm_version").isNotNull(), F.col("index_sha256"), F.col("got"), F.lit(False)).alias("status"))


# --- raw records --------------------------------------------------------------------------------------------


@query(f"SELECT hub_id, repo_url, coalesce(name, '') AS name, coalesce(description, '') AS description, raw_metadata.stars AS stars, raw_metadata.rank AS rank, repo AS path FROM {OWNED.format('skillhub')} WHERE repo IS NOT NULL")
def raw_records(spark, d):
    """PJ11: a connector's rows in the common form; rows without repository are dropped"""
    h = table(spark, d, "skillhub")
    repo = owner_repo(F.col("repo_url"), HOST)
    meta = {"stars": F.col("raw_metadata.stars"), "rank": F.col("raw_metadata.rank"), "path": repo}
    got = crawl.raw_record(h, "skillhub", F.col("repo_url"), F.col("name"), F.col("description"), meta, repo, ("hub_id",))
    return got.select("hub_id", "repo_url", "name", "description", "raw_metadata.*")


@query("SELECT rec_id, repo_url, 'skillsmp' AS source, true AS tombstone, CAST(load_no AS VARCHAR) AS deleted_at FROM skillsmp WHERE load_no = 2")
def tombstone_rows(spark, d):
    """PJ13, SM5: the second load as deletions"""
    return crawl.tombstones(table(spark, d, "skillsmp").where("load_no = 2"), "skillsmp", F.col("load_no").cast("string"), ("rec_id",))


@query(f"SELECT rec_id, coalesce(o = 'duskgrove' AND repo IS NOT NULL, false) AS official, coalesce(repo = 'lanternworks/skill-quarry', false) AS vetted FROM {OWNED.format('skillsmp')}")
def owner_flags(spark, d):
    """PR8, PR9"""
    url = F.col("repo_url")
    return table(spark, d, "skillsmp").select("rec_id", crawl.owner_flag(url, HOST, "duskgrove").alias("official"), crawl.repo_flag(url, HOST, "lanternworks/skill-quarry").alias("vetted"))


@query("""WITH s AS (SELECT DISTINCT repo_url AS repo, list_extract(string_split(repo_url, '/'), -1) AS name FROM documents WHERE repo_url IS NOT NULL),
 c AS (SELECT repo, unnest(['SKILL.md', 'SKILL.md', 'skills/' || name || '/SKILL.md', 'skills/' || name || '/SKILL.md', name || '/SKILL.md', name || '/SKILL.md', 'skill/SKILL.md', 'skill/SKILL.md', 'docs/SKILL.md', 'docs/SKILL.md']) AS path, unnest(range(1, 11)) AS pos FROM s),
 h AS (SELECT c.repo, min(pos) AS pos FROM c JOIN documents d ON d.repo_url = c.repo AND d.path = c.path WHERE contains(d.text, '---') OR length(d.text) > 200 GROUP BY c.repo)
 SELECT c.repo, CASE WHEN h.pos % 2 = 1 THEN 'main' WHEN h.pos IS NOT NULL THEN 'master' END AS branch, max(c.path) FILTER (WHERE c.pos = h.pos) AS path, coalesce(h.pos, 10) AS tried FROM c LEFT JOIN h ON h.repo = c.repo GROUP BY c.repo, h.pos""")
def first_documents(spark, d):
    """SC26, SC39, PR7: where each repository's document is found first"""
    t = table(spark, d, "documents").where("repo_url is not null")
    repos = t.select(F.col("repo_url").alias("repo")).distinct().withColumn("candidates", crawl.candidate_paths(F.element_at(F.split("repo", "/"), -1)))
    return crawl.first_document(repos, t.select(F.col("repo_url").alias("repo"), "path", "text"), docs_.looks_like_document(F.col("text")))


# --- functions ------------------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(text) AS h FROM documents")
def base64_texts(spark, d):
    """FN9: contents as base64 with line breaks, and back"""
    return table(spark, d, "documents").select("doc_id", F.md5(docs_.decode_base64(F.base64(F.col("text").cast("binary")))).alias("h"))


@query("""SELECT doc_id, CASE WHEN n >= 3 THEN array_to_string(l[1:n - 2], '/') || '/shared/x.md' WHEN n = 2 THEN 'shared/x.md' ELSE '../shared/x.md' END AS target FROM (SELECT doc_id, string_split(path, '/') AS l, len(string_split(path, '/')) AS n FROM documents WHERE path IS NOT NULL)""")
def joined_paths(spark, d):
    """FN21: the target of a link that is seen from each document"""
    return table(spark, d, "documents").where("path is not null").select("doc_id", docs_.join_path(F.col("path"), F.lit("../shared/./x.md")).alias("target"))


@query("SELECT date, abs(skill_count) AS n, nullif(regexp_extract(lower(index_sha256), '[0-9a-f]{64}'), '') AS sha256 FROM release_log")
def parsed_releases(spark, d):
    """FN23, SC38: counts (their digits, without sign) and hashes out of release texts"""
    said = F.concat(F.lit("Release with "), F.format_number("skill_count", 0), F.lit(" skills"))
    hashed = F.concat(F.lit("sha256: "), F.upper("index_sha256"), F.lit(" index.tar"))
    return table(spark, d, "release_log").select("date", pipeline.parse_count(said).alias("n"), pipeline.parse_sha256(hashed).alias("sha256"))
