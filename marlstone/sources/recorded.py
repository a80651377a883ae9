"""Recorded service responses as a data source (SC18-SC21, SC29-SC31, JN10, PR12).

Live crawling isn't part of the engine; a connector's responses are recorded as JSON pages and read with the semantics of the live calls: one
input partition a shard, pages in order until a page is empty, the stated total or the limit is reached, items distinct within a shard.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: A search service returns no more than 1000 items; a shard with this many was not exhausted.
OVERFLOW = 950


def _files(path: str):
    """The file system of a folder that all executors reach, and the folder in it; a path without scheme is a mounted one."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(path) if "://" in path else (LocalFileSystem(), path)


class _Shard(InputPartition):
    def __init__(self, name: str) -> None:
        super().__init__(name)
        self.name = name


class RecordedSearch(DataSource):
    """`path` is a folder with one JSON file a shard: {"pages": [{"total_count": n, "items": [{"id": ..., "repo": ...}]}]}.

    Options: path, per_page (30), limit a shard (none), shards (comma-separated names; all).
    """

    @classmethod
    def name(cls) -> str:
        return "recorded_search"

    def schema(self) -> str:
        return "shard string, position int, item_id bigint, repo string, item string, total_count bigint"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.per_page = options["path"], int(options.get("per_page", 30))
        self.limit = int(options["limit"]) if "limit" in options else None
        self.shards = [s for s in options.get("shards", "").split(",") if s]

    def partitions(self) -> list[InputPartition]:
        from pyarrow.fs import FileSelector

        if self.shards:
            return [_Shard(n) for n in self.shards]
        files, folder = _files(self.path)
        return [_Shard(n) for n in sorted(f.base_name[:-5] for f in files.get_file_info(FileSelector(folder)) if f.is_file and f.base_name.endswith(".json"))]

    def read(self, partition) -> Iterator[tuple]:
        files, folder = _files(self.path)
        file = f"{folder.rstrip('/')}/{partition.name}.json"
        if not files.get_file_info(file).is_file:
            return
        with files.open_input_stream(file) as f:
            pages = json.loads(f.read()).get("pages", [])
        seen, n, total = set(), 0, None
        for number, page in enumerate(pages, 1):
            total = page.get("total_count", 0) if total is None else total
            items = page.get("items", [])
            for item in items:
                if item.get("id") in seen:
                    continue
                seen.add(item.get("id"))
                if self.limit is not None and n >= self.limit:
                    return
                yield partition.name, n, item.get("id"), item.get("repo"), json.dumps(item, ensure_ascii=False), total
                n += 1
            if not items or number * self.per_page >= total:
                return


def shard_grid(axes: dict[str, list[str]]) -> list[str]:
    """The names of all combinations of shard bounds, a fixed small grid (JN10)."""
    out = [""]
    for name, values in axes.items():
        out = [f"{a}{'|' if a else ''}{name}:{v}" for a in out for v in values]
    return out


def exhausted(counts: Column, overflow: int = OVERFLOW) -> Column:
    """True for a shard that gave fewer items than the service could have cut off (PR12)."""
    return counts < overflow


def discover(parts: list[DataFrame], key: str, limit: int | None = None) -> DataFrame:
    """The distinct keys of several discoveries in the order of their first appearance (SC29-SC31, ST2); `limit` is the feature's own."""
    all_ = None
    for i, p in enumerate(parts):
        one = p.select(F.col(key), F.struct(F.lit(i).alias("part"), F.col("shard"), F.col("position")).alias("_o"))
        all_ = one if all_ is None else all_.unionByName(one)
    first = all_.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("_o").alias("_o"))
    if limit is not None:
        first = first.orderBy("_o").limit(limit)
    return first.orderBy("_o").select(key)
