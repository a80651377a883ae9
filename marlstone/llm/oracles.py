"""SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from marlstone.functions.text import STOCK_PHRASES

_QUOTED = ", ".join(f"'{p}'" for p in STOCK_PHRASES)

ADDRESSED = r"""a0 AS (SELECT *, lower(regexp_replace(CASE WHEN regexp_matches(raw_metadata.skill_md_url, '\S') THEN raw_metadata.skill_md_url ELSE repo_url END, '^\s+|\s+$', '', 'g')) AS u FROM skillsmp),
a1 AS (SELECT * REPLACE (regexp_replace(regexp_replace(regexp_replace(u, '^[a-z][a-z0-9+.\-]*:/+', ''), '^[^/@?#]*@([^/:]+):/*', '\1/'), '[?#].*$', '', 's') AS u) FROM a0),
a2 AS (SELECT * REPLACE (rtrim(regexp_replace(regexp_replace(url_decode(u), '^(?:www\.)?([^/:]+)(?::(?:443|80|22))?(/|$)', '\1\2'), '/+', '/', 'g'), '/') AS u) FROM a1),
a3 AS (SELECT * REPLACE (nullif(regexp_replace(u, '^([^/]+/[^/]+/[^/]+?)(?:\.git)+(/|$)', '\1\2'), '') AS u), split_part(u, '/', 2) AS owner FROM a2),
addressed AS (SELECT a3.*, CASE WHEN r1.new_owner IS NULL THEN u ELSE regexp_replace(u, '^([^/]+)/[^/]+', '\1/' || coalesce(r2.new_owner, r1.new_owner)) END AS address,
 CASE WHEN regexp_full_match(raw_metadata.pushed_at, '[0-9]{10}') THEN try_cast(raw_metadata.pushed_at AS BIGINT) // 86400
  WHEN regexp_full_match(raw_metadata.pushed_at, '[0-9]{8}') THEN date_diff('day', DATE '1970-01-01', CAST(try_strptime(raw_metadata.pushed_at, '%Y%m%d') AS DATE))
  WHEN regexp_full_match(raw_metadata.pushed_at, '[0-9]{2} [A-Z][a-z]{2} [0-9]{4}') THEN date_diff('day', DATE '1970-01-01', CAST(try_strptime(raw_metadata.pushed_at, '%d %b %Y') AS DATE))
  ELSE date_diff('day', DATE '1970-01-01', CAST(try_cast(regexp_replace(replace(raw_metadata.pushed_at, '/', '-'), '(Z|[+-][0-9]{2}:[0-9]{2})$', '') AS TIMESTAMP)
   - to_minutes(CASE WHEN regexp_matches(raw_metadata.pushed_at, 'T.*[+-][0-9]{2}:[0-9]{2}$') THEN (CASE WHEN regexp_matches(raw_metadata.pushed_at, '-[0-9]{2}:[0-9]{2}$') THEN -1 ELSE 1 END)
    * (60 * try_cast(left(right(raw_metadata.pushed_at, 5), 2) AS INT) + try_cast(right(raw_metadata.pushed_at, 2) AS INT)) ELSE 0 END) AS DATE)) END AS day
 FROM a3 LEFT JOIN owner_rename r1 ON r1.old_owner = a3.owner LEFT JOIN owner_rename r2 ON r2.old_owner = r1.new_owner)"""

P1_FOUND = f"""WITH {ADDRESSED}, ranked AS (SELECT rec_id, address, count(*) OVER g AS n, min(rec_id) OVER g AS first_rec_id,
 row_number() OVER (PARTITION BY address ORDER BY NOT (coalesce(w, '') <> '' AND w NOT IN ({_QUOTED})), coalesce(trust_rank, 1000), day DESC NULLS LAST, coalesce(length(description), 0) DESC, rec_id) AS place
 FROM (SELECT *, trim(regexp_replace(lower(description), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS w FROM addressed) a
 LEFT JOIN (SELECT regexp_replace(lower(source), '[^a-z0-9]', '', 'g') AS s, min(trust_rank) AS trust_rank FROM source_registry GROUP BY 1) r ON r.s = regexp_replace(lower(a.source), '[^a-z0-9]', '', 'g')
 WHERE address IS NOT NULL WINDOW g AS (PARTITION BY address))
SELECT first_rec_id, rec_id AS best_rec_id FROM ranked WHERE place = 1 AND n > 1"""

# every pair of word sets whose sizes allow the threshold is compared
PAIRS = r"""words AS (SELECT rec_id, list_distinct(regexp_extract_all(lower(description), '[\p{L}\p{N}]+')) AS d, list_distinct(regexp_extract_all(lower(coalesce(name, '') || ' ' || description), '[\p{L}\p{N}]+')) AS s FROM skillsmp),
sets AS (SELECT rec_id, s, len(s) AS n FROM words WHERE len(d) >= 12),
pairs AS (SELECT a, b FROM (SELECT x.rec_id AS a, y.rec_id AS b, x.n + y.n AS t, len(list_intersect(x.s, y.s)) AS i FROM sets x JOIN sets y ON x.rec_id < y.rec_id AND x.n * 10 >= y.n * 7 AND y.n * 10 >= x.n * 7) WHERE 10 * i >= 7 * (t - i))"""

P5_FOUND = f"WITH {PAIRS} SELECT a AS rec_id_a, b AS rec_id_b FROM pairs"

P6_FOUND = f"""WITH {ADDRESSED}, {PAIRS}, r AS (SELECT rec_id, load_no, address, coalesce(day, -1000000000) AS day FROM addressed),
before AS (SELECT x.rec_id, min(y.rec_id) AS prior FROM r x JOIN r y ON y.address = x.address AND y.load_no < x.load_no GROUP BY x.rec_id, x.day HAVING x.day <= max(y.day)),
bothways AS (SELECT a AS p, b AS q FROM pairs UNION ALL SELECT b, a FROM pairs),
near AS (SELECT x.rec_id, min(y.rec_id) AS prior FROM bothways JOIN r x ON x.rec_id = p JOIN r y ON y.rec_id = q WHERE y.load_no < x.load_no AND (x.address IS NULL OR y.address IS NULL OR x.address <> y.address) GROUP BY x.rec_id)
SELECT min(prior) AS prior_rec_id, rec_id FROM (SELECT * FROM before UNION ALL SELECT * FROM near) GROUP BY rec_id"""

# the same chain of steps over skillhub
HUB = ADDRESSED.replace("FROM skillsmp", "FROM skillhub").replace("a0", "h0").replace("a1", "h1").replace("a2", "h2").replace("a3", "h3").replace("addressed AS", "hub AS")
_SHARE = "CASE WHEN {0} IS NOT NULL THEN (rank() OVER (PARTITION BY {1} ORDER BY {0} NULLS LAST) - 1 + count(*) OVER (PARTITION BY {1}, {0}) / 2) / count({0}) OVER (PARTITION BY {1}) END AS {0}"

# mean ranks by windows, the first component by power iteration
P4_RANKING = f"""WITH RECURSIVE {ADDRESSED}, {HUB},
plain AS (SELECT *, regexp_replace(regexp_replace(lower(raw_metadata.rank), 'rank|grade|tier|class|level', '', 'g'), '[^a-z0-9+-]', '', 'g') AS w FROM hub),
graded AS (SELECT *, upper(regexp_extract(w, '^([a-z])[+-]?$', 1)) AS g FROM plain),
items AS (SELECT DISTINCT * FROM (SELECT address, load_no AS load, CASE WHEN raw_metadata.overall_score > 0 THEN raw_metadata.overall_score END AS overall,
  CASE WHEN g <> '' AND strpos('SABCDF', g) > 0 AND NOT contains(raw_metadata.rank, '/') THEN 7 - strpos('SABCDF', g) END AS grade, CASE WHEN raw_metadata.stars >= 0 THEN raw_metadata.stars END AS stars FROM graded
  UNION ALL SELECT address, NULL, NULL, NULL, CASE WHEN raw_metadata.stars >= 0 THEN raw_metadata.stars END FROM addressed) WHERE address IS NOT NULL),
shares AS (SELECT address, {_SHARE.format('overall', 'load')}, {_SHARE.format('grade', '1')}, {_SHARE.format('stars', '1')} FROM items),
per AS (SELECT address, avg(overall) AS o, avg(grade) AS g, avg(stars) AS s FROM shares GROUP BY address),
c AS (SELECT coalesce(corr(o, g), 0) AS og, coalesce(corr(o, s), 0) AS os, coalesce(corr(g, s), 0) AS gs FROM per),
steps(i, x, y, z) AS (SELECT 0, 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT i, a / n, b / n, d / n FROM (SELECT i, a, b, d, sqrt(a * a + b * b + d * d) AS n FROM (SELECT i + 1 AS i, x + og * y + os * z AS a, og * x + y + gs * z AS b, os * x + gs * y + z AS d FROM steps, c WHERE i < 400))),
w AS (SELECT greatest(x, 0) AS x, greatest(y, 0) AS y, greatest(z, 0) AS z FROM steps WHERE i = 400),
sums AS (SELECT address, (o IS NOT NULL)::INT + (g IS NOT NULL)::INT + (s IS NOT NULL)::INT AS n_scores, coalesce(o - 0.5, 0) * x + coalesce(g - 0.5, 0) * y + coalesce(s - 0.5, 0) * z AS t,
  CASE WHEN o IS NULL THEN 0 ELSE x * x END + CASE WHEN g IS NULL THEN 0 ELSE y * y END + CASE WHEN s IS NULL THEN 0 ELSE z * z END AS v FROM per, w),
projected AS (SELECT address, n_scores, CASE WHEN v > 0 THEN round(t / sqrt(v), 9) END AS p FROM sums)
SELECT address, CASE WHEN p IS NULL THEN count(p) OVER () + 1 ELSE rank() OVER (ORDER BY p DESC NULLS LAST) END AS rank, round(p, 6) AS projection, n_scores FROM projected"""

# components by following links from every class
P5_GROUPS = f"""WITH RECURSIVE {PAIRS}, keyed AS (SELECT rec_id, min(rec_id) OVER (PARTITION BY list_sort(s)) AS class_id FROM sets),
links AS (SELECT DISTINCT x.class_id AS u, y.class_id AS v FROM pairs JOIN keyed x ON x.rec_id = a JOIN keyed y ON y.rec_id = b WHERE x.class_id <> y.class_id),
both_ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach(u, v) AS (SELECT DISTINCT class_id, class_id FROM keyed UNION SELECT reach.u, both_ways.v FROM reach JOIN both_ways ON both_ways.u = reach.v),
groups AS (SELECT u, min(v) AS group_id FROM reach GROUP BY u), degrees AS (SELECT u, count(*) AS n_links FROM both_ways GROUP BY u)
SELECT rec_id, class_id, group_id, coalesce(n_links, 0) AS n_links FROM keyed JOIN groups g ON g.u = class_id LEFT JOIN degrees d ON d.u = class_id"""

# what has to hold of any right result, whatever the vocabulary
P7_DECODED = "SELECT doc_id, md5(coalesce(text, '')) AS h FROM documents"
P8_CHECKED = "SELECT spec_id, (SELECT count(*) FROM documents) AS items, 0 AS lost_tokens, 0 AS overfull, 0 AS cut_needlessly, 0 AS broken_parts FROM pack_specs WHERE capacity > 0 AND tokenizer IS NOT NULL"

ORACLES = {"p4_ranking": P4_RANKING, "p5_groups": P5_GROUPS, "p7_decoded": P7_DECODED, "p8_checked": P8_CHECKED, "p1_found": P1_FOUND, "p5_found": P5_FOUND, "p6_found": P6_FOUND}
