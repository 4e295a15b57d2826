"""Queries of runs: limits on calls, budgets, tables kept up by streams, redirects, reading order and models' answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.operators import budgets, redirects
from loomtext.plans import pipelines
from loomtext.plans.config import load
from loomtext.queries import _table, query
from loomtext.queries_documents import _ARTICLE, _md5, _references, _streamed
from loomtext.runtime import scratch, ship, stored
from loomtext.sources import connectors, fetch_source, web
from loomtext.streaming import ingest, ledger, limits

#: Microseconds in a day, and of the window and the margin of the queries below.
_DAY, _WINDOW, _MARGIN = 86_400_000_000, 2 * 86_400_000_000, 100_000


@query(f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, CAST(round(value) AS BIGINT) AS n FROM events WHERE epoch_us(ts) // 1000 < (SELECT max(epoch_us(ts)) // 1000 - 3600000 FROM events)),
 f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM e WHERE n <= 240),
 c AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY i) AS s FROM f),
 k AS (SELECT a.user_id, a.event_id, a.i, a.t, greatest(coalesce(max(b.i), 0), any_value(a.i) - 4) AS k FROM c a LEFT JOIN c b ON b.user_id = a.user_id AND b.i < a.i AND b.s - b.n < a.s - 240 GROUP BY a.user_id, a.event_id, a.i, a.t),
 r AS (SELECT user_id, event_id, i, t AS a, [t] AS log FROM k WHERE i = 1
   UNION ALL
   SELECT user_id, event_id, i, a, list_append(log, a) FROM (
    SELECT user_id, event_id, i, log, CASE WHEN k > 0 AND log[k] > now - {_WINDOW} THEN log[k] + {_WINDOW + _MARGIN} ELSE now END AS a FROM (
     SELECT k.user_id, k.event_id, k.i, k.k, r.log, greatest(k.t, r.a) AS now FROM r JOIN k ON k.user_id = r.user_id AND k.i = r.i + 1)))
SELECT e.user_id, e.event_id, r.a AS admitted FROM e LEFT JOIN r USING (user_id, event_id)
""")
def stream_admission(spark, sf_dir):
    """Events as calls of their users: 240 tokens and four calls within two days, told as the watermark passes them."""
    ship(spark)
    e = _table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.round("value").cast("bigint").alias("tokens"))
    plan = lambda s: limits.admissions(s, "user_id", "event_id", "ts", "tokens", tpm=300, rpm=5, threshold=0.8, window=2 * 86400, late="1 hour")
    return _streamed(spark, e, plan, "admission").select(F.col("key").alias("user_id"), F.col("call").alias("event_id"), "admitted")


@query(f"""
WITH RECURSIVE f AS (SELECT event_id, epoch_us(ts) AS t, CAST(round(value) AS BIGINT) AS n, row_number() OVER (ORDER BY epoch_us(ts), event_id) AS i FROM events WHERE round(value) <= 400),
 c AS (SELECT *, sum(n) OVER (ORDER BY i) AS s FROM f),
 b AS (SELECT *, list(s - n) OVER (ORDER BY i ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS before FROM c),
 k AS (SELECT event_id, i, t, greatest(i - 12, i - 1 - len(before) + len(list_filter(coalesce(before, []), lambda x: x < s - 400))) AS k FROM b),
 r AS (SELECT event_id, i, t AS a, [t] AS log FROM k WHERE i = 1
   UNION ALL
   SELECT event_id, i, a, list_append(log[-12:], a) FROM (
    SELECT k.event_id, k.i, r.log, greatest(k.t, r.a, CASE WHEN k.k > 0 THEN r.log[len(r.log) - (r.i - k.k)] + {_DAY // 24} END) AS a FROM r JOIN k ON k.i = r.i + 1))
SELECT e.event_id, r.a AS admitted FROM events e LEFT JOIN r USING (event_id)
""")
def budget_admission(spark, sf_dir):
    """All events under one budget: 400 tokens and twelve calls within an hour, in blocks of many tasks."""
    e = _table(spark, sf_dir, "events").select("event_id", "ts", F.round("value").cast("bigint").alias("tokens"))
    return budgets.shared_budget(e, "ts", "tokens", ["event_id"], 400, 12, 3600.0, block=1 << 10).select("event_id", "admitted")


@query("""
WITH c AS (SELECT conv_id AS doc_id, turn AS version, text FROM conversations), m AS (SELECT doc_id, max(version) AS version FROM c GROUP BY doc_id)
SELECT doc_id, version, md5(text) AS text_md5 FROM c JOIN m USING (doc_id, version) WHERE version % 5 <> 4
""")
def stream_upsert(spark, sf_dir):
    """Turns as versions of their conversation, in files of which each is a batch. The run dies behind its second batch,
    before Spark has noted it, and is begun again; a version of 4 or 9 deletes its key."""
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("version"), "text")
    _, path = stored(turns.repartition(5, "version"), "turns")
    out, log = scratch(spark, "latest"), scratch(spark, "latest-log")
    table = ledger.LatestTable(spark, out, turns.schema, ("doc_id",), "version", "version % 5 = 4", buckets=8)
    stream = lambda: ingest.arriving(spark, path, turns.schema, files_per_trigger=1)

    def dies(batch, number):
        table.upsert(batch, number)
        if number == 1:
            raise RuntimeError("lost behind the ledger entry")

    first = stream().writeStream.foreachBatch(dies).option("checkpointLocation", log).trigger(availableNow=True).start()
    try:
        first.awaitTermination()
    except Exception as e:
        if "lost behind the ledger entry" not in str(e):
            raise
    table.follow(stream(), log).awaitTermination()
    return table.read().select("doc_id", "version", _md5(F.col("text")).alias("text_md5"))


# Chains of fifty URLs; each seventh is a cycle, and each seventh behind it leads into that cycle.
_TARGET = "CASE WHEN doc_id % 50 < 49 THEN 'u' || (doc_id + 1) WHEN doc_id // 50 % 7 = 3 THEN 'u' || (doc_id - 49) WHEN doc_id // 50 % 7 = 4 THEN 'u' || (doc_id - 70) ELSE 'http://full/' || doc_id END"


@query(f"""
WITH RECURSIVE e AS (SELECT 'u' || doc_id AS url, {_TARGET} AS target FROM documents),
 w AS (SELECT url, target AS cur, 1 AS hops FROM e UNION ALL SELECT w.url, e.target, hops + 1 FROM w JOIN e ON e.url = w.cur WHERE hops < 200),
 f AS (SELECT url, cur, hops FROM w WHERE cur NOT IN (SELECT url FROM e))
SELECT e.url, f.cur AS final, CAST(f.hops AS BIGINT) AS hops, f.url IS NULL AS cyclic FROM e LEFT JOIN f ON f.url = e.url
""")
def redirect_chains(spark, sf_dir):
    """Documents as redirects of up to fifty hops, some into cycles, followed by doubling."""
    k = F.col("doc_id")
    turn = F.floor(k / 50) % 7
    target = F.when(k % 50 < 49, k + 1).when(turn == 3, k - 49).when(turn == 4, k - 70)
    named = F.coalesce(F.concat(F.lit("u"), target.cast("string")), F.concat(F.lit("http://full/"), k.cast("string")))
    rows = _table(spark, sf_dir, "documents").select(F.concat(F.lit("u"), k.cast("string")).alias("url"), named.alias("target"))
    return redirects.followed(rows)


#: Words of a line, lines of a column, and how a page of the query below is laid out.
_WORDS, _LINES = 6, 40


@query(f"""
WITH d AS (SELECT doc_id, string_split(text, ' ') AS ws, 2 + doc_id % 2 AS columns FROM documents WHERE text IS NOT NULL),
 l AS (SELECT doc_id, columns, i, array_to_string(ws[i * {_WORDS} + 1:i * {_WORDS} + {_WORDS}], ' ') AS line FROM (SELECT *, unnest(range(0, (len(ws) + {_WORDS - 1}) // {_WORDS})) AS i FROM d)),
 p AS (SELECT doc_id, i // (columns * {_LINES}) AS page, string_agg(line, chr(10) ORDER BY i) AS body FROM l GROUP BY ALL)
SELECT doc_id, md5(string_agg('Page ' || page || chr(10) || body, chr(10) ORDER BY page)) AS text_md5 FROM p GROUP BY doc_id
""")
def reading_order(spark, sf_dir):
    """Whole documents set in two or three columns below a page's head, as spans in no order, read back in order."""
    d = _table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.split("text", " ").alias("ws"), (2 + F.col("doc_id") % 2).alias("columns"))
    lines = F.transform(F.sequence(F.lit(0), F.floor((F.size("ws") - 1) / _WORDS).cast("int")), lambda i: F.array_join(F.slice("ws", i * _WORDS + 1, F.lit(_WORDS)), " "))
    rows = d.select("doc_id", "columns", F.posexplode(lines).alias("i", "text"))
    page, column, line = F.floor(F.col("i") / (F.col("columns") * _LINES)), F.floor(F.col("i") / _LINES) % F.col("columns"), F.col("i") % _LINES
    box = lambda x0, y0, x1, y1: [x.cast("double").alias(c) for x, c in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"))]
    spans = rows.select("doc_id", page.alias("page"), *box(column * 200, 50 + line * 12, column * 200 + 180, 60 + line * 12), "text")
    heads = rows.where(F.col("i") % (F.col("columns") * _LINES) == 0).select("doc_id", page.alias("page"), *box(F.lit(0), F.lit(10), F.col("columns") * 200 - 20, F.lit(30)), F.concat(F.lit("Page "), page.cast("string")).alias("text"))
    return pipelines.paper_texts(spans.unionByName(heads), load()).select("doc_id", _md5(F.col("text")).alias("text_md5"))


class _Counting:
    """A recorded model that answers with the length of what it is asked, and fails at what holds a sign."""

    def complete(self, system, user, image=None, media_type=None):
        return ("overloaded" if "$" in user else f"{system} {len(user)}"), len(user), 5


@query("""
SELECT doc_id, CASE WHEN NOT contains(text, '$') THEN 'Count. ' || length(text) END AS answer, CASE WHEN contains(text, '$') THEN 'error pattern: overloaded' END AS error_message FROM documents
""")
def model_answers(spark, sf_dir):
    """Each whole document as a question; equal ones are asked once, eight at a time in each task."""
    work = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("message"))
    many = {"tokens": 1 << 60, "requests": 1 << 60}
    return connectors.answered(work, _Counting(), "Count.", limits=many)


_FRAME = "'All that is on these pages belongs to ' || host || ' and its friends, who ask all readers to write to them.'"


@query(f"""
WITH {_ARTICLE}, h AS (SELECT page_id, head, ps, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM a),
 b AS (SELECT page_id, host, [struct_pack(k := 'p', t := 'Home of ' || host, l := length('Home of ' || host)), struct_pack(k := 'p', t := 'Read more', l := 9), struct_pack(k := 'head', t := head, l := 0)]
   || list_transform(ps, lambda x: struct_pack(k := 'p', t := x, l := 0)) || [struct_pack(k := 'p', t := {_FRAME}, l := 0), struct_pack(k := 'p', t := 'About us', l := 8)] AS bs FROM h),
 e AS (SELECT page_id, host, i, bs[i].k AS k, bs[i].t AS t, bs[i].l AS l FROM (SELECT *, unnest(range(1, len(bs) + 1)) AS i FROM b) WHERE bs[i].t <> ''),
 c AS (SELECT host, t FROM (SELECT host, t, count(DISTINCT page_id) AS n FROM e GROUP BY ALL) JOIN (SELECT host, count(*) AS pages FROM h GROUP BY host) USING (host) WHERE n >= 3 AND n >= 0.05 * pages),
 v AS (SELECT e.*, c.t IS NOT NULL AS framed FROM e LEFT JOIN c ON c.host = e.host AND c.t = e.t),
 tries AS (SELECT page_id, i, k, t, l, 1 AS try FROM v WHERE NOT framed UNION ALL SELECT page_id, i, k, t, l, 2 FROM v),
 s AS (SELECT *, sum(length(t) - 3 * l - CASE WHEN k = 'p' THEN 20 ELSE 0 END) OVER (PARTITION BY page_id, try ORDER BY i) AS p, row_number() OVER (PARTITION BY page_id, try ORDER BY i) AS n FROM tries),
 z AS (SELECT page_id, try, n, p FROM s UNION ALL SELECT DISTINCT page_id, try, 0, 0 FROM s),
 m AS (SELECT x.page_id, x.try, x.n, arg_max(struct_pack(s := y.n, g := x.p - y.p), [-y.p, y.n]) AS f FROM z x JOIN z y ON y.page_id = x.page_id AND y.try = x.try AND y.n < x.n GROUP BY x.page_id, x.try, x.n, x.p),
 r AS (SELECT page_id, try, arg_max(struct_pack(a := f.s + 1, b := n), [f.g, -n]) AS w FROM m WHERE f.g > 0 GROUP BY ALL), best AS (SELECT page_id, min(try) AS try FROM r GROUP BY ALL),
 o AS (SELECT s.page_id, s.n, s.k, s.t FROM s JOIN best USING (page_id, try) JOIN r USING (page_id, try) WHERE s.n BETWEEN r.w.a AND r.w.b)
SELECT page_id AS doc_id, coalesce(max(t) FILTER (k = 'head' AND n < last), '') AS heading, md5(coalesce(string_agg(t, chr(10) || chr(10) ORDER BY n) FILTER (k = 'p'), string_agg(t, chr(10) ORDER BY n))) AS body_md5 FROM (SELECT *, max(n) OVER (PARTITION BY page_id) AS last FROM o) GROUP BY page_id
""")
def page_density(spark, sf_dir):
    """Pages whose article is in no element of its own, between links and a frame that all pages of a host have: a head and
    long paragraphs are found by density."""
    ship(spark)
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    own = _references(web.article_html())
    html = F.concat(
        F.lit('<html><body><ul><li><a href="/">Home of '), host, F.lit('</a></li><li><a href="/m">Read more</a></li></ul>'), own, F.lit("<p>All that is on these pages belongs to "), host,
        F.lit(' and its friends, who ask all readers to write to them.</p><div><a href="/a">About us</a></div></body></html>'),
    )
    found = web.articles(_table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url", html.alias("html")), density=True)
    first = F.col("sections")[0]
    return found.select("doc_id", first["heading"].alias("heading"), _md5(first["body"]).alias("body_md5"))


@query("""
WITH h AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/:]+)', 1) AS host, encode(html) AS body FROM pages), u AS (SELECT url, host, min(page_id) AS page_id FROM h GROUP BY ALL),
 top AS (SELECT host FROM u GROUP BY host ORDER BY count(*) DESC, host LIMIT 5), a AS (SELECT url, arg_min(body, page_id) AS body FROM h GROUP BY url)
SELECT u.url, CASE WHEN page_id % 10 = 9 THEN NULL ELSE md5(CASE WHEN page_id % 5 = 3 THEN encode('mirror ' || u.url) ELSE body END) END AS md5,
 CAST(CASE WHEN page_id % 10 = 9 THEN 3 WHEN page_id % 5 = 3 THEN 2 ELSE 1 END AS INTEGER) AS asked, CASE WHEN page_id % 10 = 9 THEN 'NetworkError' END AS error_type FROM u JOIN a USING (url) WHERE host IN (SELECT host FROM top)
""")
def fetched_pages(spark, sf_dir):
    """Pages as recorded answers of their hosts; every fifth is had from its first mirror alone, some from none. The five
    largest hosts are asked for, by a filter that the source takes."""
    pages = _table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^https?://([^/:]+)", 1)
    urls = pages.groupBy("url").agg(F.min("page_id").alias("page_id"), F.min_by("html", "page_id").alias("html")).withColumn("host", host)
    mirror = lambda n: F.concat(F.lit(f"http://mirror{n}.org/"), F.md5(F.col("url").cast("binary")))
    body = F.lit("text/html").alias("content_type")
    there, at_mirror = F.col("page_id") % 5 != 3, (F.col("page_id") % 5 == 3) & (F.col("page_id") % 10 != 9)
    own = urls.where(there & (F.col("page_id") % 10 != 9)).select("url", F.lit(200).alias("status"), F.col("html").cast("binary").alias("body"), body)
    other = urls.where(at_mirror).select(mirror(1).alias("url"), F.lit(200).alias("status"), F.concat(F.lit("mirror "), "url").cast("binary").alias("body"), body)
    failing = urls.where("page_id % 5 = 3").select("url", F.lit(503).alias("status"), F.lit(None).cast("binary").alias("body"), body)
    answers, requests = scratch(spark, "answers"), scratch(spark, "requests")
    own.unionByName(other).unionByName(failing).write.parquet(answers)
    fetch_source.requested(urls.select("url", F.array(mirror(1), mirror(2)).alias("mirrors")), requests)
    top = [r["host"] for r in urls.groupBy("host").count().orderBy(F.desc("count"), "host").limit(5).collect()]
    got = fetch_source.fetched(spark, requests, answers).where(F.col("host").isin(*top))
    return got.select("url", F.md5("content").alias("md5"), "asked", "error_type")
