"""Data sources in Python: workbook sheets and cursor-paged records; guards for uploads."""

from __future__ import annotations

import csv
import io
import re
import time
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

ZIP_MAGIC = b"PK\x03\x04"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


@dataclass(frozen=True)
class Limits:
    """Bounds of an upload."""

    size: int = 50 << 20
    expanded: int = 200 << 20
    rows: int = 200_000


class TooLarge(ValueError):
    pass


def is_workbook(data: bytes) -> bool:
    return data[:4] == ZIP_MAGIC


def check_expanded(data: bytes, most: int) -> None:
    """Inflates every part, stopping at ``most`` bytes; declared sizes are not trusted."""
    total = 0
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in z.namelist():
            with z.open(name) as part:
                while chunk := part.read(1 << 20):
                    total += len(chunk)
                    if total > most:
                        raise TooLarge(f"more than {most} bytes when expanded")


def sheet_rows(data: bytes) -> Iterator[list[str | None]]:
    """Cells of a workbook's first sheet as text."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(MAIN + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        sheet = sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))[0]
        for row in ElementTree.fromstring(z.read(sheet)).iter(MAIN + "row"):
            cells: dict[int, str | None] = {}
            for k, c in enumerate(row):
                at = k
                if ref := re.match("[A-Z]+", c.get("r", "")):
                    at = 0
                    for letter in ref[0]:
                        at = at * 26 + ord(letter) - 64
                    at -= 1
                value = c.find(MAIN + "v")
                text = value.text if value is not None else "".join(t.text or "" for t in c.iter(MAIN + "t")) or None
                cells[at] = shared[int(text)] if c.get("t") == "s" and text is not None else text
            yield [cells.get(k) for k in range(max(cells, default=-1) + 1)]


class WorkbookSource(DataSource):
    """``spark.read.format("workbook").option("bytes_hex", ...)``: a bounded upload's first sheet, all columns as text."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _data(self) -> bytes:
        data = bytes.fromhex(self.options["bytes_hex"])
        if len(data) > Limits().size:
            raise TooLarge("workbook is too large")
        check_expanded(data, int(self.options.get("expanded", Limits().expanded)))
        return data

    def schema(self) -> StructType:
        return StructType([StructField(h or f"column{k}", StringType()) for k, h in enumerate(next(sheet_rows(self._data())))])

    def reader(self, schema: StructType) -> DataSourceReader:
        return WorkbookReader(self._data(), len(schema))


class WorkbookReader(DataSourceReader):
    def __init__(self, data: bytes, width: int):
        self.data, self.width = data, width

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        rows = sheet_rows(self.data)
        next(rows)
        for row in rows:
            yield tuple((row + [None] * self.width)[: self.width])


def read_upload(spark: SparkSession, data: bytes, limits: Limits = Limits()) -> DataFrame:
    """A CSV or workbook upload as a table; the kind is told by its first bytes. Too large an upload raises."""
    if len(data) > limits.size:
        raise TooLarge(f"more than {limits.size} bytes")
    if is_workbook(data):
        spark.dataSource.register(WorkbookSource)
        df = spark.read.format("workbook").options(bytes_hex=data.hex(), expanded=limits.expanded).load()
    else:
        records = []
        for row in csv.reader(io.StringIO(data.decode("utf-8-sig"), newline="")):  # bounded by limits.size
            out = io.StringIO()
            csv.writer(out, lineterminator="").writerow(row)
            records.append(out.getvalue())
        df = spark.read.options(header=True, inferSchema=True, escape='"').csv(spark.sparkContext.parallelize(records, 1))
    if df.limit(limits.rows + 1).count() > limits.rows:
        raise TooLarge(f"more than {limits.rows} rows")
    return df


def preview(df: DataFrame, n: int = 10) -> dict:
    """Columns, rows, the first ``n`` rows and a guess of each numeric column's scale, from one aggregate."""
    numeric = [c for c, t in df.dtypes if t in ("int", "bigint", "double", "float", "boolean")]
    value = {c: F.col(c).cast("double") for c in numeric}
    row = df.agg(F.count("*").alias("_n"), *[F.struct(F.min(v).alias("a"), F.max(v).alias("b"), F.bool_and(v.isin(0.0, 1.0)).alias("bits")).alias(c) for c, v in value.items()]).first()
    scale = lambda s: None if s.a is None else "binary" if s.bits else "1-5" if s.a >= 1 and s.b <= 5 else "1-10" if s.a >= 1 and s.b <= 10 else None
    return {"columns": df.columns, "rows": row["_n"], "first": [r.asDict() for r in df.limit(n).collect()], "scales": {c: scale(row[c]) for c in numeric}}


@dataclass
class PullState:
    """Where a pull of pages stands; enough to resume it."""

    cursor: str = "*"
    pages: int = 0
    stored: int = 0
    end: str | None = None


def pages(fetch: Callable[[str], tuple[list[dict], str]], state: PullState, oldest: int, wait: Callable[[float], None] = time.sleep, waits: tuple[float, ...] = (30, 60, 120, 300, 600)) -> Iterator[list[dict]]:
    """Pages from ``fetch(cursor)``, newest first, until one lies before ``oldest``.

    An empty page or a repeated cursor may be a soft limit: it is asked for again
    after each of ``waits`` before it is believed. ``state`` is current after
    each page, so a stopped pull goes on from there.
    """
    seen: set[str] = set()
    while state.end is None:
        tries = iter(waits)
        while True:
            rows, following = fetch(state.cursor)
            if rows and following not in seen and following != state.cursor:
                break
            pause = next(tries, None)
            if pause is None:
                state.end = "no more pages"
                return
            wait(pause)
        seen.add(state.cursor)
        kept = [r for r in rows if r["timestamp_created"] >= oldest]
        state.cursor, state.pages, state.stored = following, state.pages + 1, state.stored + len(kept)
        if min(r["timestamp_created"] for r in rows) < oldest:
            state.end = "window start"
        yield kept


RECORD = "recommendationid string, author struct<steamid: string, num_reviews: int, playtime_at_review: bigint>, review string, timestamp_created bigint, timestamp_updated bigint, voted_up boolean, language string, steam_purchase boolean, received_for_free boolean, votes_up int"


def records_to_reviews(raw: DataFrame, salt: str) -> DataFrame:
    """Reviews of JSON records (column ``value``): authors hashed at the boundary, the rest of the account dropped."""
    from plumbline.functions.text import clean_text
    from plumbline.sources.reviews import author_hash

    r = raw.select(F.from_json("value", RECORD).alias("r")).select("r.*")
    # Names of the source's languages.
    langs = F.create_map(*[F.lit(x) for x in ("english", "en", "german", "de", "french", "fr", "spanish", "es", "latam", "es", "schinese", "zh", "russian", "ru", "brazilian", "pt")])
    meta = F.to_json(F.struct("votes_up", "steam_purchase", "received_for_free", F.col("author.num_reviews").alias("author_num_reviews"), F.col("author.playtime_at_review").alias("author_playtime_at_review")))
    return r.select(
        F.col("recommendationid").alias("ext_id"), author_hash(F.col("author.steamid"), salt).alias("author_hash"), clean_text(F.col("review")).alias("text"),
        F.col("voted_up").cast("double").alias("rating_raw"), F.col("voted_up").cast("double").alias("rating_norm"),
        F.timestamp_seconds("timestamp_created").cast("timestamp_ntz").alias("created_at"), F.timestamp_seconds("timestamp_updated").cast("timestamp_ntz").alias("updated_at"),
        F.try_element_at(langs, F.col("language")).alias("lang"), meta.alias("meta"),
    )
