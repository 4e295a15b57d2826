"""A data source that fetches: rows of answers, a row for each requested URL.

    requested(items, path)                                         # items: (url[, mirrors])
    fetched(spark, path, answers=recorded)

Requests are written once, each URL once, dealt by their host, so that all requests of a host are asked one after the
other in one task, in order of host and URL. A filter on `host` or `url` is pushed into the source: only the tasks of those
hosts run, and only those URLs are asked. What answers is a connector by its dotted name (`module:attribute`, an object or
a class of connectors.Connector), or a table of recorded answers (url, status, body, content_type), which Spark puts to their
requests first: a task reads the answers of its own requests alone, and each once.

A request's mirrors are asked in their order, and only as long as none before has answered. Failures that may pass are
tried again; a request that gets no answer keeps its row with an error.
"""

from __future__ import annotations

import importlib
import time
import zlib
from collections.abc import Iterable, Iterator
from functools import partial
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from loomtext.plans.document_files import opened
from loomtext.runtime import scratch, ship
from loomtext.sources import connectors

SCHEMA = "url string, host string, status int, content binary, content_type string, answered_by string, asked int, error_type string, error_message string"
#: Tasks that requests are dealt to by their host; rows of a batch.
BUCKETS, ROWS = 64, 256
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _host(url: str) -> str:
    try:
        return (urlsplit(url).hostname or "").lower()
    except ValueError:
        return ""


def requested(items: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write requests (url[, mirrors: array of URLs]) for the source: each URL once, with its mirrors; null URLs are left out."""
    mirrors = F.col("mirrors") if "mirrors" in items.columns else F.lit(None)
    host = F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")))
    rows = items.where("url IS NOT NULL").select("url", mirrors.cast("array<string>").alias("mirrors"))
    once = rows.groupBy("url").agg(F.max("mirrors").alias("mirrors")).withColumn("host", host)
    once = once.withColumn("bucket", F.pmod(F.crc32(F.col("host").cast("binary")), F.lit(buckets)).cast("int"))
    once.repartition(buckets, "bucket").sortWithinPartitions("bucket", "host", "url").write.partitionBy("bucket").parquet(path)


def recorded(spark: SparkSession, requests: str, answers: str) -> str:
    """A table of requests as requested() writes them, each with the recorded answers to its URL and its mirrors."""
    asked = spark.read.parquet(requests)
    urls = F.concat(F.array("url"), F.coalesce("mirrors", F.array().cast("array<string>")))
    keys = asked.select("bucket", "host", "url", F.explode(F.array_distinct(urls)).alias("at"))
    answer = F.struct(F.col("url").alias("at"), "status", F.coalesce("body", F.lit(b"")).alias("body"), F.coalesce("content_type", F.lit("")).alias("content_type"))
    told = spark.read.parquet(answers).groupBy(F.col("url").alias("at")).agg(F.max(answer).alias("a"))
    of_url = keys.join(told, "at").groupBy("url").agg(F.collect_list("a").alias("recorded"))
    rows = asked.join(of_url, "url", "left").select("url", "mirrors", "host", "recorded", "bucket")
    path = scratch(spark, "recorded")
    rows.repartitionByRange("bucket", "host", "url").sortWithinPartitions("bucket", "host", "url").write.partitionBy("bucket").parquet(path)
    return path


class Fetched(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fetched"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        if "requests" not in self.options or ("answers" in self.options) == ("connector" in self.options):
            raise ValueError("give requests, and either answers or a connector")
        return FetchReader(dict(self.options))


class FetchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        # Answers: the table that recorded() has made of the requests.
        self.requests, self.answers, self.connector = options.get("answers", options["requests"]).rstrip("/"), options.get("answers"), options.get("connector")
        self.retries, self.backoff = int(options.get("retries", "3")), float(options.get("backoff", "2.0"))
        self.buckets = int(options.get("buckets", str(BUCKETS)))
        self.hosts: set[str] | None = None
        self.urls: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take equalities of host and url; Spark applies them again to what comes back only where they are not taken."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute in (("host",), ("url",)):
                name = f"{f.attribute[0]}s"
                setattr(self, name, values if getattr(self, name) is None else getattr(self, name) & values)
            else:
                yield f

    def _wanted_hosts(self) -> set[str] | None:
        of_urls = None if self.urls is None else {_host(u) for u in self.urls}
        return of_urls if self.hosts is None else self.hosts if of_urls is None else self.hosts & of_urls

    def partitions(self) -> list[InputPartition]:
        hosts = self._wanted_hosts()
        chosen = range(self.buckets) if hosts is None else sorted({zlib.crc32(h.encode()) % self.buckets for h in hosts})
        return [InputPartition(b) for b in chosen]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # filters that leave no host
            return
        store, root = opened(self.requests)
        folder = f"{root}/bucket={partition.value}"
        if store.get_file_info(folder).type.name == "NotFound":
            return
        table = ds.dataset(folder, filesystem=store, format="parquet")
        keep = [ds.field("host").isin(sorted(self.hosts))] if self.hosts is not None else []
        keep += [ds.field("url").isin(sorted(self.urls))] if self.urls is not None else []
        for batch in table.to_batches(columns=["url", "mirrors", "host", *(["recorded"] if self.answers else [])], filter=keep[0] & keep[1] if len(keep) > 1 else keep[0] if keep else None, batch_size=ROWS):
            rows = batch.to_pylist()
            if not rows:
                continue
            connector = None if self.answers else _named(self.connector)
            told = [self._asked(connector or _recorded(r["recorded"]), r["url"], r["host"], [r["url"], *(r["mirrors"] or [])]) for r in rows]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.binary(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*told), kinds)], names=[c.split(" ")[0] for c in SCHEMA.split(", ")])

    def _asked(self, connector: connectors.Connector, url: str, host: str, candidates: list[str]) -> tuple:
        pause = (lambda s: None) if self.answers else time.sleep
        fault, asked = "", 0
        for candidate in candidates:
            asked += 1
            try:
                a = connectors.with_retries(partial(connectors.got, connector, candidate), self.retries, self.backoff, sleep=pause)
                return url, host, a.status, a.body, a.content_type, candidate, asked, None, None
            except connectors.Fatal as e:
                fault = str(e)
        return url, host, None, None, None, None, asked, "NetworkError", fault


def _recorded(answers: list[dict] | None) -> connectors.Recorded:
    """The recorded answers to a request and its mirrors."""
    return connectors.Recorded({a["at"]: connectors.Answer(a["status"], a["body"], a["content_type"]) for a in answers or []})


def _named(name: str) -> connectors.Connector:
    module, _, attribute = name.partition(":")
    found = getattr(importlib.import_module(module), attribute)
    return found() if isinstance(found, type) else found


def fetched(spark: SparkSession, requests: str, answers: str | None = None, connector: str | None = None, **options) -> DataFrame:
    """The answers to requests written by requested(); filters on host and url are pushed into the source."""
    ship(spark)
    spark.conf.set(_PUSHDOWN, "true")
    spark.dataSource.register(Fetched)
    reader = spark.read.format("fetched").option("requests", requests)
    if answers is not None and connector is None:
        answers = recorded(spark, requests, answers)
    for name, value in {"answers": answers, "connector": connector, **options}.items():
        reader = reader if value is None else reader.option(name, str(value))
    return reader.load()
