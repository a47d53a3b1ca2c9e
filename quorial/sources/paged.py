"""A paged source of records, read by Spark tasks: a web service or a folder of pages."""

from __future__ import annotations

import gzip
import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .readers import clean


class Pages(InputPartition):
    """Some pages of a fiscal year, one after another."""

    def __init__(self, year: int, first: int, last: int):
        self.year, self.first, self.last = year, first, last


class PagedSource(DataSource):
    """``fiscal_year, page, record`` (a record as JSON) of every page of every year.

    Options: ``url`` (asked by POST with the year's dates, page and limit; answers have a
    list under ``results``) or ``path`` (a folder that all executors see, with the lines of
    the files under ``fiscal_year=Y/page=P``, of which ``.gz`` are unpacked); ``years`` as ``2018-2024`` or a list with
    commas; ``max_pages`` a year (10), ``limit`` records a page (100), ``pages_per_task``
    (1), ``pause`` in seconds between a task's requests (0), ``tries`` (3), ``body`` (JSON
    that goes with each request) and ``pushdown``.

    A year ends at its first empty page, so a task asks for the page before its first
    before it reads.  A page that fails after all tries fails the task, and Spark runs it
    again.  With ``pushdown`` filters on ``fiscal_year`` choose years before anything is
    asked; Spark wants ``spark.sql.python.filterPushdown.enabled`` for that.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "fiscal_year int, page int, record string"

    def reader(self, schema) -> DataSourceReader:
        kind = FilteringReader if self.options.get("pushdown", "false").lower() == "true" else PagedReader
        return kind(dict(self.options))


def years_of(text: str) -> list[int]:
    out: list[int] = []
    for part in text.split(","):
        first, _, last = part.strip().partition("-")
        out += range(int(first), int(last or first) + 1)
    return out


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        low = {k.lower(): v for k, v in options.items()}
        if ("url" in low) == ("path" in low):
            raise ValueError("give either url or path")
        self.url, self.path, self.years = low.get("url"), low.get("path"), years_of(low["years"])
        self.max_pages, self.limit, self.run = int(low.get("max_pages", 10)), int(low.get("limit", 100)), int(low.get("pages_per_task", 1))
        self.pause, self.tries, self.body = float(low.get("pause", 0)), int(low.get("tries", 3)), json.loads(low.get("body", "{}"))

    def partitions(self) -> list[Pages]:
        return [Pages(y, p, min(p + self.run - 1, self.max_pages)) for y in self.years for p in range(1, self.max_pages + 1, self.run)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        if partition.first > 1 and not self.page(partition.year, partition.first - 1):
            return
        for p in range(partition.first, partition.last + 1):
            records = self.page(partition.year, p)
            if not records:
                return
            yield from ((partition.year, p, r) for r in records)
            time.sleep(self.pause)

    def page(self, year: int, page: int) -> list[str]:
        return self.asked(year, page) if self.url else self.lines(year, page)

    def lines(self, year: int, page: int) -> list[str]:
        folder = f"{self.path.removeprefix('file://')}/fiscal_year={year}/page={page}"
        if not os.path.isdir(folder):
            return []
        names = sorted(n for n in os.listdir(folder) if n[0] not in "._")
        out: list[str] = []
        for n in names:
            with (gzip.open if n.endswith(".gz") else open)(f"{folder}/{n}", "rt", encoding="utf-8") as f:
                out += [x for x in f.read().split("\n") if x.strip()]
        return out

    def asked(self, year: int, page: int) -> list[str]:
        body = self.body | {"page": page, "limit": self.limit}
        body["filters"] = body.get("filters", {}) | {"time_period": [{"start_date": f"{year - 1}-10-01", "end_date": f"{year}-09-30"}]}
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        for left in range(self.tries - 1, -1, -1):
            try:
                with urllib.request.urlopen(request, timeout=60) as answer:
                    return [json.dumps(r) for r in json.load(answer).get("results") or []]
            except (urllib.error.URLError, TimeoutError, json.JSONDecodeError):
                if not left:
                    raise
                time.sleep(self.pause)
        return []


class FilteringReader(PagedReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        tests = {EqualTo: lambda y, v: y == v, In: lambda y, v: y in v, GreaterThan: lambda y, v: y > v, GreaterThanOrEqual: lambda y, v: y >= v, LessThan: lambda y, v: y < v, LessThanOrEqual: lambda y, v: y <= v}
        for f in filters:
            if type(f) in tests and f.attribute == ("fiscal_year",):
                self.years = [y for y in self.years if tests[type(f)](y, f.value)]
            else:
                yield f


def read_paged(spark: SparkSession, schema: str, **options: str) -> DataFrame:
    """The records of a paged source with ``fiscal_year, page`` and the typed columns of
    ``schema``; fields that a record lacks are null."""
    spark.dataSource.register(PagedSource)
    rows = spark.read.format("paged").options(**options).load()
    return clean(rows.select("fiscal_year", "page", F.from_json("record", schema).alias("r")).select("fiscal_year", "page", "r.*"))


def write_pages(df: DataFrame, path: str, year: str, key: list[str], limit: int) -> None:
    """``df`` as a folder of pages of about ``limit`` records, dealt by a hash of ``key``:
    a page and its number of rows don't depend on others, so nothing is put in order.  Rows
    are moved to their page's task before they are made JSON, and pages are gzip files."""
    counts = df.groupBy(F.col(year).alias("_y")).agg(F.ceil(F.count("*") / limit).cast("int").alias("_pages"))
    joined = df.join(counts, F.col(year) == F.col("_y"))
    page = F.pmod(F.xxhash64(*key), F.col("_pages")) + 1
    dealt = joined.select(F.struct(*df.columns).alias("_row"), F.col(year).alias("fiscal_year"), page.cast("int").alias("page")).repartition("fiscal_year", "page")
    lines = dealt.select("fiscal_year", "page", F.to_json("_row").alias("value"))
    lines.write.partitionBy("fiscal_year", "page").text(path, compression="gzip")
