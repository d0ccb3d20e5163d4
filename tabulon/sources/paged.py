"""Paged searches as a data source: pages are planned from hit counts and read by tasks, a failed page is a row.

``fetch`` is a plain function of a request (keyword, filters, start, rows) that
returns ``{"hitCount": n, "oppHits": [...]}``; how it gets there is its own
matter, so the same source reads an API, files or a test's dictionary. It runs
in the tasks and has to be picklable. One request a keyword, for its hit count,
is made while planning; a keyword whose count fails gets one page, whose row
then has the error. Equality filters on ``keyword`` prune keywords before any
request; those on ``filters`` named columns go into the requests.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

#: Fixed value: rows of one request.
PAGE = 100
SCHEMA = "keyword string, page int, nth int, ok boolean, error string, status string, hit string"

Fetch = Callable[[dict], dict]


@dataclass
class Page(InputPartition):
    keyword: str
    page: int
    start: int
    rows: int
    filters: dict = field(default_factory=dict)

    def request(self) -> dict:
        return {"keyword": self.keyword, "startRecordNum": self.start, "rows": self.rows, **self.filters}


class PagedReader(DataSourceReader):
    def __init__(self, fetch: Fetch, keywords: Sequence[str], page: int, most: int | None, attempts: int):
        self.fetch, self.keywords, self.page, self.most, self.attempts, self.filters = fetch, list(keywords), page, most, attempts, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("keyword",):
                self.keywords = [k for k in self.keywords if k == f.value]
            elif isinstance(f, EqualTo) and f.attribute == ("status",):
                self.filters["oppStatuses"] = f.value
                yield f  # an API may take it as a wish only
            else:
                yield f

    def _ask(self, request: dict) -> dict:
        for left in range(self.attempts, 0, -1):
            try:
                return self.fetch(request)
            except Exception:
                if left == 1:
                    raise
        raise ValueError("attempts")

    def partitions(self) -> Sequence[Page]:
        pages = []
        for keyword in self.keywords:
            try:
                total = int(self._ask({"keyword": keyword, "startRecordNum": 0, "rows": 1, **self.filters}).get("hitCount") or 0)
            except Exception:  # noqa: BLE001 - the page's own row will tell
                total = 1
            total = total if self.most is None else min(total, self.most)
            pages += [Page(keyword, i, start, min(self.page, total - start), dict(self.filters)) for i, start in enumerate(range(0, total, self.page))]
        return pages

    def read(self, page: Page) -> Iterator[tuple]:
        try:
            hits = self._ask(page.request()).get("oppHits") or []
        except Exception as e:  # noqa: BLE001 - a page's failure is a result
            yield (page.keyword, page.page, None, False, f"{type(e).__name__}: {e}"[:500], None, None)
            return
        for i, hit in enumerate(hits):
            yield (page.keyword, page.page, i, True, None, hit.get("oppStatus"), json.dumps(hit))


def search_pages(spark: SparkSession, fetch: Fetch, keywords: Sequence[str], page: int = PAGE, most: int | None = None, attempts: int = 1, name: str = "paged_search") -> DataFrame:
    """All hits of ``keywords``: one row a hit, or one a failed page (``ok`` false, with its error).

    ``most`` bounds the hits of a keyword, as a caller's own limit.
    """
    words = list(dict.fromkeys(keywords))

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return PagedReader(fetch, words, page, most, attempts)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Paged)
    return spark.read.format(name).load()


def stubs(hits: DataFrame, keywords: Sequence[str], id_path: str = "$.id") -> DataFrame:
    """(id, hit, matched_terms): each id once, with its first hit and the keywords that found it, in their order."""
    order = F.array_position(F.array(*map(F.lit, keywords)), F.col("keyword"))
    rows = hits.where("ok").select(F.get_json_object("hit", id_path).alias("id"), F.struct(order.alias("at"), "page", "nth").alias("place"), "keyword", "hit").where("id is not null and id <> ''")
    per_word = rows.groupBy("id", "keyword").agg(F.min(F.struct("place", "hit")).alias("first"))  # at most one row a keyword remains
    terms = F.transform(F.array_sort(F.collect_list(F.struct("first.place", "keyword"))), lambda x: x["keyword"])
    return per_word.groupBy("id").agg(F.min("first")["hit"].alias("hit"), terms.alias("matched_terms"))


def failed_pages(hits: DataFrame) -> DataFrame:
    return hits.where("not ok").select("keyword", "page", "error")
