"""Parts of documents: front matter, link lists, HTML, recorded trees and contents (SC22, SC26, SC33-SC35, SC39, FN9, FN11, FN12, FN20, FN21, PJ12, PR7, WN3)."""

from __future__ import annotations

import html.parser
import json
import posixpath
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

_COMMENT = re.compile(r"<!--.*?-->", re.S)


def _front(text: str | None, strict: bool) -> tuple[dict, str]:
    import yaml

    if text is None:
        return {}, ""
    if not strict:
        text = _COMMENT.sub("", text).lstrip()
    m = re.match(r"---[ \t]*\r?\n(.*?)\n---[ \t]*(?:\r?\n|\Z)" if strict else r"---\s*\n(.*?)\n---\s*(?:\n|\Z)", text, re.S)
    if not m:
        return {}, text
    try:
        got = yaml.safe_load(m[1])
    except yaml.YAMLError:
        if strict:
            raise
        return {}, text
    return (got if isinstance(got, dict) else {}), text[m.end() :]


@F.pandas_udf(T.StringType())
def frontmatter_json(text: pd.Series) -> pd.Series:
    """The front matter of a document as a JSON object; `{}` without one or where it can't be read (FN11)."""
    return text.map(lambda t: json.dumps(_front(t, False)[0], default=str, ensure_ascii=False))


@F.pandas_udf(T.StructType([T.StructField("meta", T.StringType()), T.StructField("body", T.StringType())]))
def frontmatter_and_body(text: pd.Series) -> pd.DataFrame:
    """Front matter as JSON and the text after it; unreadable YAML raises (FN12)."""
    got = [_front(t, True) for t in text]
    return pd.DataFrame({"meta": [json.dumps(m, default=str, ensure_ascii=False) for m, _ in got], "body": [b for _, b in got]})


_LINK = T.StructType([T.StructField("href", T.StringType()), T.StructField("text", T.StringType())])
_PARTS = T.StructType([T.StructField("title", T.StringType()), T.StructField("meta", T.MapType(T.StringType(), T.StringType())), T.StructField("links", T.ArrayType(_LINK)), T.StructField("text", T.StringType())])


class _Page(html.parser.HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.links, self.meta, self.title, self.text, self._stack, self._href, self._words = [], {}, "", [], [], None, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        self._stack.append(tag)
        if tag == "meta" and (name := a.get("name") or a.get("property")):
            self.meta[name] = a.get("content", "")
        if tag == "a" and "href" in a:
            self._href, self._words = a["href"], []

    def handle_endtag(self, tag: str) -> None:
        if tag in self._stack:
            while self._stack.pop() != tag:
                pass
        if tag == "a" and self._href is not None:
            self.links.append({"href": self._href, "text": " ".join("".join(self._words).split())})
            self._href = None

    def handle_data(self, data: str) -> None:
        if "title" in self._stack:
            self.title += data
        elif not {"script", "style"} & {*self._stack}:
            self.text.append(data)
        if self._href is not None:
            self._words.append(data)


@F.pandas_udf(_PARTS)
def html_parts(page: pd.Series) -> pd.DataFrame:
    """Title, meta tags, links and visible text of a page (FN20, SC34); null gives empty parts."""
    rows = []
    for t in page:
        p = _Page()
        p.feed(t or "")
        p.close()
        rows.append((p.title.strip(), p.meta, p.links, " ".join(" ".join(p.text).split())))
    return pd.DataFrame(rows, columns=["title", "meta", "links", "text"])


def html_links(text: Column) -> Column:
    """The href values of the anchors of a text, in order, without a UDF."""
    return F.regexp_extract_all(text, F.lit(r'<a\s[^<>]*href="([^"]*)"'), F.lit(1))


def decode_base64(c: Column) -> Column:
    """Base64 with line breaks to text; invalid bytes become U+FFFD (FN9)."""
    return F.decode(F.unbase64(F.regexp_replace(c, r"\s", "")), "UTF-8")


@F.pandas_udf(T.StringType())
def join_path(base: pd.Series, target: pd.Series) -> pd.Series:
    """The normalised path of `target` seen from the folder of `base` (FN21)."""
    return pd.Series([None if b is None or t is None else posixpath.normpath(posixpath.join(posixpath.dirname(b), t.strip())) for b, t in zip(base, target)])


def link_list(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id_col, line, category, name, url, description): the list links of documents with the heading above them (WN3, SC33)."""
    lines = docs.select(id_col, F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")).alias("line", "t"))
    heading = F.nullif(F.trim(F.regexp_extract("t", r"^##\s+(.+)$", 1)), F.lit(""))
    item = r"^\s*[-*]\s+\[([^\]]+)\]\((https?://[^)\s]+)\)\s*(?:[—–:-]+\s*(.*))?$"
    kept = lines.where(F.col("t").rlike(r"^##\s+") | F.col("t").rlike(item))
    w = W.partitionBy(id_col).orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    got = kept.withColumn("category", F.coalesce(F.last(heading, ignorenulls=True).over(w), F.lit(""))).where(F.col("t").rlike(item))
    part = lambda i: F.regexp_extract("t", item, i)
    return got.select(id_col, "line", "category", part(1).alias("name"), part(2).alias("url"), F.trim(part(3)).alias("description"))


def looks_like_document(content: Column) -> Column:
    """True with front matter marks or more than 200 characters (PR7)."""
    return F.coalesce(content.contains("---") | (F.length(content) > 200), F.lit(False))


def document_paths(trees: DataFrame, name: str = "SKILL.md") -> DataFrame:
    """(repo, path, sha) of tree maps: the blobs whose path ends with `name` (SC22, SC23)."""
    return trees.select("repo", F.explode("paths").alias("path", "sha")).where(F.col("path").endswith(name))


def first_found(candidates: DataFrame, contents: DataFrame, key: str, url: str = "url") -> DataFrame:
    """(key, url, content): of each key's candidate addresses, in their order, the first that has content (SC26, SC39)."""
    each = candidates.select(key, F.posexplode(url + "s").alias("pos", url))
    got = each.join(contents.select(url, "content").where("content is not null"), url)
    return got.groupBy(key).agg(F.min_by(F.struct(url, "content"), "pos").alias("r")).select(key, "r.*")


def parent_name(path: Column, repo: Column) -> Column:
    """The folder that holds a document, else the repository's name (PJ12)."""
    return F.coalesce(F.nullif(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit("")), F.element_at(F.split(repo, "/"), -1))


def allowed(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """(url, allowed): the longest rule whose prefix a path has decides; without one it is allowed (SC35). `rules` has host, prefix, allow.

    Joined on the host, so that only a host's own rules are compared.
    """
    u = urls.select("url", F.expr("try_parse_url(url, 'HOST')").alias("host"), F.coalesce(F.expr("try_parse_url(url, 'PATH')"), F.lit("/")).alias("path"))
    hit = u.join(rules, "host", "left").withColumn("len", F.when(F.col("path").startswith(F.col("prefix")), F.length("prefix")))
    return hit.groupBy("url").agg(F.coalesce(F.max_by("allow", "len"), F.lit(True)).alias("allowed"))
