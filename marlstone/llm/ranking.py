"""One ranking from several differently-scaled scores (problem 4).

Method: first principal component of rank-transformed scores. Each score becomes its mean rank as a share; the correlation matrix
is summed up in one distributed pass, over the rows that have both scores; the loadings of the first component are turned so that they agree with
the declared directions; items are sorted by their projection. A score that still has a loading against its direction takes no part: the
result is then the component without it, and its loading is returned as 0.

A score whose scale differs between loads is ranked within its load. No score rules: after the rank transform all have
the same range, and the loadings depend on agreement only.

Defined cases: a missing score takes the middle, 0, and the projection is over the loadings of the scores an item has; an item without any
score comes last, with projection null; ties share a rank and are listed by key; several ratings of an item are averaged, repeated rows count once; an
empty table gives an empty result; a constant or absent score gets loading 0; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.urls import record_address
from marlstone.operators.ranking import average_ranks
from marlstone.session import shared_table

# Grades, best first.
GRADES = "SABCDF"


def grade_value(c):
    """6 for S down to 1 for F; null for what holds no grade. Case, brackets, words like `grade` and signs are ignored."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(c), "rank|grade|tier|class|level", ""), "[^a-z0-9+-]", "")
    g = F.upper(F.regexp_extract(plain, "^([a-z])[+-]?$", 1))
    at = F.instr(F.lit(GRADES), g)
    return F.when((g != "") & (at > 0) & ~F.coalesce(c, F.lit("")).contains("/"), F.lit(len(GRADES) + 1) - at).cast("double")


def first_component(items: DataFrame, scores: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(loadings, correlations) of columns in `scores`, whose values say whether more is better (1) or worse (-1)."""
    names = list(scores)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    both = lambda a, b, x: F.sum(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), x))
    sums = []
    for a, b in pairs:
        x, y = F.col(a), F.col(b)
        sums += [both(a, b, F.lit(1.0)), both(a, b, x), both(a, b, y), both(a, b, x * x), both(a, b, y * y), both(a, b, x * y)]
    got = items.agg(*[F.coalesce(s, F.lit(0.0)).alias(f"s{i}") for i, s in enumerate(sums)]).collect()[0]
    corr = np.eye(len(names))
    for k, (a, b) in enumerate(pairs):
        n, sx, sy, sxx, syy, sxy = got[6 * k : 6 * k + 6]
        i, j = names.index(a), names.index(b)
        vx, vy = (n * sxx - sx * sx, n * syy - sy * sy) if n else (0, 0)
        corr[i, j] = corr[j, i] = (n * sxy - sx * sy) / (vx * vy) ** 0.5 if vx > 1e-12 and vy > 1e-12 else 0.0
    value, vector = np.linalg.eigh(corr)
    load = vector[:, -1]
    load[np.diag(corr) == 0] = 0
    want = np.array([scores[x] for x in names], float)
    if load @ want < 0:
        load = -load
    # a loading against its declared direction would reward the opposite of what was asked for
    return np.where(load * want > 0, load, 0.0), corr


def combine(items: DataFrame, key: str, scores: dict[str, int], within: dict[str, str] | None = None) -> tuple[DataFrame, dict[str, float]]:
    """((key, rank, projection, n_scores), loadings): one row a key, the best with rank 1.

    `items` may hold several rows a key. `within` names, for a score, the column inside whose values it is ranked.
    """
    within = within or {}
    long = shared_table(items.where(F.col(key).isNotNull()).distinct(), "scores")
    parts = []
    for s in scores:
        by = [within[s]] if s in within else []
        r = average_ranks(long, s, by)  # long is a written table, so it is counted from its files' footers
        parts.append(long.select(key, *by, s).join(r, [*by, s]).select(key, F.lit(s).alias("score"), "share"))
    ranked = parts[0]
    for p in parts[1:]:
        ranked = ranked.unionByName(p)
    mean = ranked.groupBy(key).agg(*[F.avg(F.when(F.col("score") == s, F.col("share"))).alias(s) for s in scores])
    per = shared_table(long.select(key).distinct().join(mean, key, "left"), "ranks")
    load, _ = first_component(per, scores)
    sums, weight, count = F.lit(0.0), F.lit(0.0), F.lit(0)
    for s, w in zip(scores, load):
        sums = sums + F.coalesce(F.col(s) - 0.5, F.lit(0.0)) * float(w)
        weight = weight + F.when(F.col(s).isNotNull(), float(w) ** 2).otherwise(0.0)
        count = count + F.col(s).isNotNull().cast("int")
    out = per.select(key, F.when(weight > 0, F.round(sums / F.sqrt(weight), 9)).alias("projection"), count.alias("n_scores"))
    known = out.where("projection is not null")
    rest = known.count() + 1
    got = out.join(average_ranks(known, "projection").select("projection", (F.col("above") + 1).alias("rank")), "projection", "left")
    return got.select(key, F.coalesce("rank", F.lit(rest)).alias("rank"), "projection", "n_scores"), dict(zip(scores, map(float, load)))


SCORES = {"overall": 1, "grade": 1, "stars": 1}


def skill_scores(hub: DataFrame, skills: DataFrame, renames: DataFrame) -> DataFrame:
    """(address, load, overall, grade, stars) of the rows of both tables; unrated and impossible values are null."""
    stars = F.when(F.col("raw_metadata.stars") >= 0, F.col("raw_metadata.stars")).cast("double")
    rated = record_address(hub, renames).select("address", F.col("load_no").alias("load"), F.when(F.col("raw_metadata.overall_score") > 0, F.col("raw_metadata.overall_score")).alias("overall"), grade_value(F.col("raw_metadata.rank")).alias("grade"), stars.alias("stars"))
    none = F.lit(None).cast("double")
    known = record_address(skills, renames).select("address", F.lit(None).cast("int").alias("load"), none.alias("overall"), none.alias("grade"), stars.alias("stars"))
    return rated.unionByName(known)


def skill_ranking(hub: DataFrame, skills: DataFrame, renames: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """One ranking of the skills of both tables, by address. Overall scores are ranked within their load, since loads differ in scale."""
    return combine(skill_scores(hub, skills, renames), "address", SCORES, within={"overall": "load"})
