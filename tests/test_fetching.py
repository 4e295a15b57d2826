"""The fetching data source over recorded answers, and the HTTP connector against a server of this machine."""

import gzip
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from loomtext.sources import connectors, fetch_source

CALLS: list[str] = []


class Tells:
    """Answers with the URL; hosts that begin with `no` have nothing, those with `busy` fail for now."""

    def get(self, url):
        return connectors.Answer(404 if "//no" in url else 503 if "//busy" in url else 200, url.encode(), "text/plain")


def items(spark):
    rows = [("http://a.org/1", None), ("http://a.org/1", None), ("http://A.org/2", []), ("http://no.org/x", ["http://no2.org/x", "http://m.org/x", "http://never.org/x"]), ("http://busy.org/", ["http://no3.org/"]), (None, None), ("not a url", None), ("http://b.org/1", ["http://m.org/b"])]
    return spark.createDataFrame(rows, "url string, mirrors array<string>")


def test_answers_mirrors_and_errors(spark, tmp_path):
    path = str(tmp_path / "requests")
    fetch_source.requested(items(spark), path)
    got = {r["url"]: r for r in fetch_source.fetched(spark, path, connector="tests.test_fetching:Tells", backoff=0).collect()}
    assert len(got) == 6 and got["http://a.org/1"]["asked"] == 1
    assert got["http://A.org/2"]["host"] == "a.org" and bytes(got["http://A.org/2"]["content"]) == b"http://A.org/2"
    r = got["http://no.org/x"]
    assert (r["answered_by"], r["asked"], r["error_type"]) == ("http://m.org/x", 3, None)
    assert (got["http://busy.org/"]["asked"], got["http://busy.org/"]["error_type"], got["http://busy.org/"]["error_message"]) == (2, "NetworkError", "HTTP 404")
    assert got["http://b.org/1"]["answered_by"] == "http://b.org/1"


def test_filters_reach_the_source(spark, tmp_path):
    path, answers = str(tmp_path / "requests"), str(tmp_path / "answers")
    fetch_source.requested(items(spark), path)
    recorded = [("http://a.org/1", 200, bytearray(b"one"), "text/html"), ("http://b.org/1", 200, bytearray(b"b"), None)]
    spark.createDataFrame(recorded, "url string, status int, body binary, content_type string").write.parquet(answers)
    whole = fetch_source.fetched(spark, path, answers)
    one = whole.where("host = 'a.org'")
    assert {r["url"]: r["error_message"] for r in one.collect()} == {"http://a.org/1": None, "http://A.org/2": "HTTP 404"}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "Filter (" not in plan and one.rdd.getNumPartitions() == 1  # the source has taken it
    assert "Filter (" in whole.where("asked > 1")._jdf.queryExecution().executedPlan().toString() and whole.rdd.getNumPartitions() == fetch_source.BUCKETS
    assert [bytes(r["content"]) for r in whole.where(F.col("url").isin("http://b.org/1", "http://c.org/1")).collect()] == [b"b"]
    assert whole.where("host = 'a.org' AND url = 'http://b.org/1'").collect() == []
    assert whole.where("host = 'a.org' AND asked > 5").collect() == []
    reader = fetch_source.FetchReader({"requests": path, "answers": answers})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    left = list(reader.pushFilters([EqualTo(("host",), "a.org"), In(("url",), ("http://a.org/1",)), GreaterThan(("asked",), 1)]))
    assert left == [GreaterThan(("asked",), 1)] and len(reader.partitions()) == 1
    with pytest.raises(Exception, match="either answers or a connector"):
        fetch_source.fetched(spark, path).collect()


def test_a_task_reads_the_answers_of_its_requests_alone(spark, tmp_path, monkeypatch):
    """Recorded answers are put to their requests by Spark: a task opens one folder, once, however many batches it asks."""
    path, answers, opened = str(tmp_path / "requests"), str(tmp_path / "answers"), []
    urls = spark.range(600).select(F.concat(F.lit("http://a.org/"), F.col("id").cast("string")).alias("url"), F.array(F.concat(F.lit("http://m.org/"), F.col("id").cast("string"))).alias("mirrors"))
    fetch_source.requested(urls, path)
    at = F.when(F.rand(1) < 0.5, F.col("url")).otherwise(F.col("mirrors")[0])
    urls.select(at.alias("url"), F.lit(200).alias("status"), F.encode(F.lit("x"), "utf-8").alias("body"), F.lit("t").alias("content_type")).write.parquet(answers)
    whole = fetch_source.fetched(spark, path, answers)
    assert whole.where("asked IN (1, 2) AND content = X'78'").count() == 600 == whole.count()
    real = fetch_source.ds.dataset
    monkeypatch.setattr(fetch_source.ds, "dataset", lambda *a, **k: opened.append(a) or real(*a, **k))
    reader = fetch_source.FetchReader({"requests": path, "answers": fetch_source.recorded(spark, path, answers)})
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 600 and len(opened) == 1


def test_no_requests(spark, tmp_path):
    path = str(tmp_path / "requests")
    fetch_source.requested(items(spark).where("false"), path)
    assert fetch_source.fetched(spark, path, connector="tests.test_fetching:Tells").collect() == []


class Handler(BaseHTTPRequestHandler):
    def do_GET(self):
        CALLS.append(self.headers["User-Agent"] + "|" + self.headers["Accept"])
        status = int(self.path.strip("/").partition("?")[0] or 200)
        self.send_response(status)
        if status == 429:
            self.send_header("Retry-After", "7")
        body = gzip.compress("é text".encode("latin-1")) if "zip" in self.path else b"plain"
        if "zip" in self.path:
            self.send_header("Content-Encoding", "gzip")
        self.send_header("Content-Type", "text/html; charset=latin-1")
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


def test_http_connector():
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    web = connectors.Http("pdf", timeout=5)
    assert connectors.decoded(web.get(f"{at}/200?zip")) == "é text" and web.get(f"{at}/200").body == b"plain"
    assert CALLS[0].endswith("application/pdf,*/*") and CALLS[0].split("|")[0] in connectors.AGENTS
    assert (web.get(f"{at}/429").status, web.get(f"{at}/429").after, web.get(f"{at}/404").status) == (429, 7.0, 404)
    assert web.get("file:///etc/passwd").status == 400
    waits = []
    with pytest.raises(connectors.Fatal):
        connectors.with_retries(lambda: connectors.got(web, f"{at}/429"), 2, sleep=waits.append)
    assert waits == [7.0]
    server.shutdown()
    server.server_close()
    with pytest.raises(ConnectionError):
        web.get(f"{at}/200")
    with pytest.raises(connectors.Retry):
        connectors.got(web, f"{at}/200")
