"""Remote listings and quotes as Python Data Sources: pages in parallel, unchanged ones not read again, filters pushed to the source.

A transport stands for the remote side. ``Folder`` serves files from a folder that all executors share, with a page's digest as its entity tag; one for a web service needs the same two methods.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
LISTING = "page int, position int, doc_id string, title string"
QUOTES = "symbol string, date date, open double, high double, low double, close double, adj_close double, volume long"


def local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


class Folder:
    """Pages ``page=N/*`` of JSON: {"total": rows on all pages, "data": [[doc_id, title], ...]}."""

    def __init__(self, path: str):
        self.path = local(path)

    def pages(self) -> list[int]:
        return sorted(int(d.split("=")[1]) for d in os.listdir(self.path) if d.startswith("page="))

    def get(self, page: int, known: str | None = None) -> tuple[str, dict | None]:
        """(entity tag, the page); no page if it is as ``known``."""
        folder = f"{self.path}/page={page}"
        names = sorted(n for n in os.listdir(folder) if not n.startswith((".", "_")))
        body = b"".join(open(f"{folder}/{n}", "rb").read() for n in names)
        tag = hashlib.sha256(body).hexdigest()
        return tag, None if tag == known else json.loads(body)


@dataclass
class Page(InputPartition):
    page: int
    tag: str | None = None


def _rows(folder: Folder, part: Page) -> Iterator[tuple]:
    _, found = folder.get(part.page, None)
    for k, (doc_id, title) in enumerate(found["data"]):
        yield part.page, k, doc_id, title


class ListingReader(DataSourceReader):
    def __init__(self, path: str):
        self.folder = Folder(path)

    def partitions(self) -> list[Page]:
        return [Page(p) for p in self.folder.pages()] or [Page(-1)]

    def read(self, partition: Page) -> Iterator[tuple]:
        return iter(()) if partition.page < 0 else _rows(self.folder, partition)


class ListingStream(DataSourceStreamReader):
    """Offsets are the entity tags of all pages, so that a batch has just the pages that are new or have changed since the last."""

    def __init__(self, path: str):
        self.folder = Folder(path)

    def initialOffset(self) -> dict:
        return {"tags": {}}

    def latestOffset(self) -> dict:
        return {"tags": {str(p): self.folder.get(p)[0] for p in self.folder.pages()}}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        changed = [Page(int(p), tag) for p, tag in end["tags"].items() if start["tags"].get(p) != tag]
        return changed or [Page(-1)]

    def read(self, partition: Page) -> Iterator[tuple]:
        return iter(()) if partition.page < 0 else _rows(self.folder, partition)

    def commit(self, end: dict) -> None:
        pass


class Listing(DataSource):
    """``spark.read.format("paged_listing").load(path)``, or readStream."""

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options["path"])

    def streamReader(self, schema) -> ListingStream:
        return ListingStream(self.options["path"])


@dataclass
class Symbol(InputPartition):
    symbol: str
    low: dt.date | None
    high: dt.date | None


class QuoteReader(DataSourceReader):
    """A request for each symbol; the filters that the source understands (symbols, a range of dates) don't come back to Spark."""

    def __init__(self, path: str):
        self.path = local(path)
        self.symbols: set[str] | None = None
        self.low: dt.date | None = None
        self.high: dt.date | None = None

    def pushFilters(self, filters):
        day = dt.timedelta(days=1)
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("symbol",) and isinstance(f, EqualTo | In):
                some = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.symbols = some if self.symbols is None else self.symbols & some
            elif column == ("date",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    low = f.value + day if isinstance(f, GreaterThan) else f.value
                    self.low = max(self.low or low, low)
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    high = f.value - day if isinstance(f, LessThan) else f.value
                    self.high = min(self.high or high, high)
            else:
                yield f

    def partitions(self) -> list[Symbol]:
        known = {d.split("=")[1] for d in os.listdir(self.path) if d.startswith("symbol=")}
        wanted = known if self.symbols is None else known & self.symbols
        return [Symbol(s, self.low, self.high) for s in sorted(wanted)] or [Symbol("", None, None)]

    def read(self, partition: Symbol) -> Iterator[pa.RecordBatch]:
        if not partition.symbol:
            return
        found = pads.dataset(f"{self.path}/symbol={partition.symbol}", format="parquet")
        keep = None
        for bound, make in ((partition.low, lambda x: pads.field("date") >= x), (partition.high, lambda x: pads.field("date") <= x)):
            if bound is not None:
                keep = make(pa.scalar(bound)) if keep is None else keep & make(pa.scalar(bound))
        for b in found.to_batches(columns=["date", "open", "high", "low", "close", "adj_close", "volume"], filter=keep):
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(partition.symbol), b.num_rows), *b.columns], names=["symbol", *b.schema.names])


class Quotes(DataSource):
    """``spark.read.format("quotes").load(path)``: files by symbol."""

    @classmethod
    def name(cls) -> str:
        return "quotes"

    def schema(self) -> str:
        return QUOTES

    def reader(self, schema) -> QuoteReader:
        return QuoteReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Listing)
    spark.dataSource.register(Quotes)


def publish_listing(rows: DataFrame, path: str, size: int = 100) -> None:
    """``rows`` (n from 0 without gaps, doc_id, title) as pages of ``size`` rows."""
    paged = rows.withColumn("page", (F.col("n") / size).cast("int"))
    total = rows.count()
    data = F.transform(F.sort_array(F.collect_list(F.struct("n", "doc_id", "title"))), lambda x: F.array(x["doc_id"], x["title"]))
    body = paged.groupBy("page").agg(data.alias("data")).select("page", F.to_json(F.struct(F.lit(total).alias("total"), "data")).alias("value"))
    body.repartition("page").write.mode("overwrite").partitionBy("page").text(path)


def publish_quotes(prices: DataFrame, path: str) -> None:
    prices.select("symbol", "date", "open", "high", "low", "close", "adj_close", F.col("volume").cast("long").alias("volume")).repartition("symbol").write.mode("overwrite").partitionBy("symbol").parquet(path)


def listing(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("paged_listing").load(path)


def quotes(spark: SparkSession, path: str) -> DataFrame:
    """Filters on symbol and date are asked of the source: the session's switch for that is turned on."""
    register(spark)
    spark.conf.set(PUSHDOWN, "true")
    return spark.read.format("quotes").load(path)


def follow(spark: SparkSession, path: str, table: str, checkpoint: str) -> int:
    """Pages that are new or have changed since the last call, appended to ``table``; how many rows they had."""
    register(spark)
    query = spark.readStream.format("paged_listing").load(path).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)
