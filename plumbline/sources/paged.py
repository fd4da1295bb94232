"""Pages of a service as a streaming source: cursors are offsets, so a stopped pull goes on from its checkpoint.

Pages follow one another by cursor, newest first, so one reader fetches them;
the rows of a batch, some pages each, are then as distributed as any other.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

#: Seconds between tries of a throttled page, at least and at most, and after which a page is given up.
THROTTLED, GIVEN_UP = (30.0, 600.0), 3600.0
#: Seconds after which an empty page or a repeated cursor is asked for again before it is believed.
SOFT_WAITS = (30.0, 60.0, 120.0, 300.0, 600.0)
PAGES_A_BATCH = 20


class Unavailable(RuntimeError):
    """A page could not be fetched in time."""


def retried(ask: Callable[[str], tuple[int, float | None, dict]], wait: Callable[[float], None] = time.sleep) -> Callable[[str], dict]:
    """A function of the cursor that gives a page, from one that gives (status, seconds to wait, page).

    Throttling (429) is waited out for what the service asks and, from try to
    try, twice as long; failures of the service or the line are tried again
    after growing pauses. Other statuses, and an hour of waiting, raise.
    """

    def fetch(cursor: str) -> dict:
        waited, tries = 0.0, 0
        while True:
            try:
                status, pause, page = ask(cursor)
            except OSError:
                status, pause, page = 0, None, {}
            if status == 200:
                return page
            if status and status != 429 and status < 500:
                raise Unavailable(f"status {status}")
            low, high = THROTTLED
            seconds = max(pause or 0.0, min(high, low * 2**tries)) if status == 429 else min(60.0, 2.0**tries)
            if waited + seconds > GIVEN_UP:
                raise Unavailable(f"no page after {waited:.0f} s, last status {status}")
            wait(seconds)
            waited, tries = waited + seconds, tries + 1

    return fetch


def next_page(fetch: Callable[[str], dict], cursor: str, seen: set[str], wait: Callable[[float], None]) -> dict | None:
    """The page at ``cursor``; None once an empty page or a cursor that was seen before has been given at every try."""
    for pause in (*SOFT_WAITS, None):
        page = fetch(cursor)
        if page.get("rows") and page.get("cursor") not in seen and page.get("cursor") != cursor:
            return page
        if pause is not None:
            wait(pause)
    return None


def paged_source(name: str, fetch: Callable[[str], dict], schema: StructType, time_field: str, oldest: int, wait: Callable[[float], None] = time.sleep, first: str = "*") -> type[DataSource]:
    """A source to register with ``spark.dataSource.register``: rows of the pages until one is older than ``oldest`` seconds.

    ``fetch(cursor)`` gives {"rows": [...], "cursor": next}. Offsets hold the
    cursor, the pages and rows so far, and why the pull ended.
    """
    names = schema.fieldNames()

    class Reader(SimpleDataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"cursor": first, "pages": 0, "stored": 0, "end": ""}

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            rows, at = [], dict(start)
            seen = {at["cursor"]}
            for _ in range(PAGES_A_BATCH):
                if at["end"]:
                    break
                page = next_page(fetch, at["cursor"], seen - {at["cursor"]}, wait)
                if page is None:
                    at["end"] = "no more pages"
                    break
                kept = [tuple(r.get(n) for n in names) for r in page["rows"] if r[time_field] >= oldest]
                rows += kept
                seen.add(page["cursor"])
                ended = min(r[time_field] for r in page["rows"]) < oldest
                at = {"cursor": page["cursor"], "pages": at["pages"] + 1, "stored": at["stored"] + len(kept), "end": "window start" if ended else ""}
            return iter(rows), at

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
            """The rows of a batch again, after a failure: the same pages, up to the same cursor."""
            at = dict(start)
            while at["pages"] < end["pages"]:
                page = next_page(fetch, at["cursor"], set(), wait)
                if page is None:
                    return
                yield from (tuple(r.get(n) for n in names) for r in page["rows"] if r[time_field] >= oldest)
                at = {"cursor": page["cursor"], "pages": at["pages"] + 1}

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> StructType:
            return schema

        def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
            return Reader()

    return Pages
