"""Addresses: tolerant canonical form, catalog keys, URL parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.core import let
from marlstone.session import forget, shared_table, small_rows

#: Renames of at most this many rows are read to the driver once and folded into the plan;
#: longer lists are resolved and joined as tables.
RENAME_LITERAL_ROWS = 256

_PLAIN = r"^https://[a-z0-9-]++(?:\.[a-z0-9-]++)+/[a-z0-9_-][a-z0-9_.-]*+(?:/(?!\.(?:/|\z))[a-z0-9_.-]++)*\z"
_EDGE = r"^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$"


def is_blank(c: Column) -> Column:
    """True for null and for texts of white space and invisible characters only."""
    return F.coalesce(c.rlike(r"^[\s\p{Z}\p{C}]*$"), F.lit(True))


def spelled_address(c: Column) -> Column:
    """One spelling for all ways to write an address, `host/owner/repo/...`; null for null or blank.

    Ignored: case, scheme, credentials, `www.`, default ports, scp form, query and fragment,
    percent encoding, doubled, dotted and trailing slashes, a `.git` end of the repository,
    white space and invisible characters around. Branches and inner paths are kept.
    """

    def decoded(s: Column) -> Column:
        plain = F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)
        return F.when(s.contains("%"), F.lower(F.regexp_replace(plain, _EDGE, ""))).otherwise(F.regexp_replace(s, _EDGE, ""))

    def step_by_step(s: Column) -> Column:
        s = F.regexp_replace(s, _EDGE, "")
        s = F.regexp_replace(s, r"^[a-z][a-z0-9+.\-]*:/+", "")
        s = F.regexp_replace(s, r"^[^/@?#]*@([^/:]+)(?::(?!\d+(?:/|$))/*)?", "$1/")
        s = F.regexp_replace(s, r"[?#][\s\S]*$", "")
        s = let(s, decoded)
        s = F.regexp_replace(s, r"^(?:www\.)?([^/:]+)(?::(?:443|80|22))?(?=/|$)", "$1")
        s = F.regexp_replace(s, r"(?:/\.(?=/|$)|/(?=/))", "")
        s = F.regexp_replace(s, r"/+$", "")
        return F.nullif(F.regexp_replace(s, r"^([^/]+/[^/]+/[^/]+?)(?:\.git)+(?=/|$)", "$1"), F.lit(""))

    # most addresses need nothing but the scheme taken off, which one look shows
    return let(F.lower(c), lambda s: F.when(~s.contains(".git") & ~s.startswith("https://www.") & s.rlike(_PLAIN), F.substring(s, 9, 1 << 30)).otherwise(step_by_step(s)))


def close_renames(pairs: dict[str, str]) -> dict[str, str]:
    """Each old name with the last name it leads to. Names on a circle get its least member."""
    out = {}
    for old in pairs:
        seen, at = [old], pairs[old]
        while at in pairs and at not in seen:
            seen.append(at)
            at = pairs[at]
        out[old] = min(seen[seen.index(at):]) if at in seen else at
    return {k: v for k, v in out.items() if k != v}


def _closed_table(renames: DataFrame) -> DataFrame:
    """The same for a long list, by doubling pointers; `low` is the least name that was passed on the way.

    Once a pointer has gone further than there are names, it can only still move on a circle, all names of which lie on its next way.
    """
    step = shared_table(renames.groupBy("old").agg(F.min("new").alias("new")).select("old", "new", F.col("new").alias("low")), "renames")
    for _ in range(step.count().bit_length() + 1):
        hop = step.select(F.col("old").alias("new"), F.col("new").alias("to"), F.col("low").alias("_low"))
        both = step.join(hop, "new", "left")
        nxt = shared_table(both.select("old", F.coalesce("to", "new").alias("new"), F.least("low", F.coalesce("_low", "low")).alias("low"), F.col("to").isNotNull().alias("moved")), "renames")
        forget(step)
        step = nxt
        if nxt.where("moved").limit(1).count() == 0:
            return nxt.select("old", "new")
    circle = step.select(F.col("old").alias("new"), F.col("low").alias("_low"))
    return step.join(circle, "new", "left").select("old", F.coalesce("_low", "new").alias("new"))


def with_address(df: DataFrame, raw: Column, renames: DataFrame | None = None, out: str = "address") -> DataFrame:
    """Adds `out`: the spelled address of `raw`, with the owner (second segment) renamed.

    `renames` has old_owner and new_owner; chains are followed, nulls and blanks in it are ignored.
    """
    spelled = spelled_address(raw)
    if renames is None:
        return df.withColumn(out, spelled)
    r = renames.select(F.lower(F.trim("old_owner")).alias("old"), F.lower(F.trim("new_owner")).alias("new")).where("old <> '' and new <> ''")

    def owner(at: Column) -> Column:
        return F.when(at.contains("/"), F.substring_index(F.substring_index(at, "/", 2), "/", -1))

    def swapped(at: Column, new: Column) -> Column:
        rest = F.regexp_extract(at, r"^[^/]+/[^/]+(.*)$", 1)
        return F.when(new.isNull(), at).otherwise(F.concat(F.substring_index(at, "/", 1), F.lit("/"), new, rest))

    rows = small_rows(r.distinct(), RENAME_LITERAL_ROWS)
    if rows is not None:
        pairs: dict[str, str] = {}
        for x in sorted(rows):
            pairs.setdefault(x.old, x.new)
        closed = close_renames(pairs)
        if not closed:
            return df.withColumn(out, spelled)
        # a literal map is scanned for each row, which is fine at this length
        m = F.create_map(*[F.lit(x) for kv in sorted(closed.items()) for x in kv])
        return df.withColumn(out, let(spelled, lambda at: let(F.try_element_at(m, owner(at)), lambda new: swapped(at, new))))
    closed = _closed_table(r).select(F.col("old").alias("_ren_old"), F.col("new").alias("_ren_new"))
    plain = df.withColumn(out, spelled).withColumn("_ren_owner", owner(F.col(out)))
    return plain.join(closed, F.col("_ren_owner") == F.col("_ren_old"), "left").withColumn(out, swapped(F.col(out), F.col("_ren_new"))).drop("_ren_owner", "_ren_old", "_ren_new")


def record_address(df: DataFrame, renames: DataFrame | None = None, out: str = "address") -> DataFrame:
    """Adds the address of a crawled record: raw_metadata.skill_md_url unless blank, else repo_url."""
    own = F.col("raw_metadata.skill_md_url")
    return with_address(df, F.when(~is_blank(own), own).otherwise(F.col("repo_url")), renames, out)


# --- catalog keys: the plain form that identifiers are made of -------------------------------------


def canonical_key(c: Column, renames: list[tuple[str, str]] = ()) -> Column:
    """Lower case, all trailing slashes off, one `.git` off, then the first matching rename.

    A rename is matched as a substring, replaced once, and ends the search. A slash that
    comes to the end through the removal of `.git` stays. Null and empty give null.
    """
    k = F.regexp_replace(F.rtrim(F.lower(c), F.lit("/")), r"\.git\z", "")
    out = k
    for old, new in reversed(list(renames)):
        at = F.locate(old, k)
        once = F.concat(F.substring(k, F.lit(1), at - 1), F.lit(new), F.substring(k, at + len(old), F.length(k)))
        out = F.when(k.contains(old), once).otherwise(out)
    return F.when(F.length(c) > 0, out)


def stable_id(key: Column) -> Column:
    """SHA-256 of the UTF-8 key, in hex."""
    return F.sha2(key.cast("binary"), 256)


def owner_repo(c: Column, host: str) -> Column:
    """`owner/repo`, lower case, of an address on exactly `host` (or www.host); null otherwise."""
    m = r"^\s*(?i:https?://)?(?i:www\.)?(?i:" + host.replace(".", r"\.") + r")/+([^/?#\s]+)/+([^/?#\s]+)"
    repo = F.regexp_replace(F.lower(F.regexp_extract(c, m, 2)), r"\.git$", "")
    return F.when(repo != "", F.concat_ws("/", F.lower(F.regexp_extract(c, m, 1)), repo))


def subtree_hint(c: Column) -> Column:
    """What follows `/tree/<branch>/` in an address; null if there is none."""
    return F.nullif(F.regexp_extract(c, r"/tree/[^/]+/(.+)", 1), F.lit(""))
