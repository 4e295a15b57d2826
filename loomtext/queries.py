"""Queries of the engine's own operators, each with the SQL that tells the same.

Every query reads whole tables. Small inline tables add the branches that the driver's tables do not reach.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext import patterns as P
from loomtext.functions import dates as D
from loomtext.functions import text as T
from loomtext.functions import urls as U
from loomtext.operators import cues as C
from loomtext.operators import relational as R
from loomtext.operators import sections as S
from loomtext.plans import render
from loomtext.runtime import ship
from loomtext.sources import structured, threads, web

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    def one(x):
        return "NULL" if x is None else str(x) if not isinstance(x, str) else "r'" + x + "'" if "'" not in x else 'r"' + x + '"'

    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)} AS t({names})")


def _duck_values(rows: list[tuple], names: str) -> str:
    one = lambda x: "NULL" if x is None else str(x) if not isinstance(x, str) else "'" + x.replace("'", "''") + "'"
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({names}))"


WS2 = P.WS_RE2
_ARTICLE = "regexp_extract(html, '(?s)<article>(.*)</article>', 1)"


def _duck_plain(x: str) -> str:
    x = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return f"trim(regexp_replace({x}, '{WS2}+', ' ', 'g'), ' ')"


def _duck_words(x: str) -> str:
    return f"CAST(len(list_filter(regexp_split_to_array({x}, '{WS2}+'), lambda t: t <> '')) AS BIGINT)"


@query(f"""
SELECT regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, count(*) AS pages, CAST(sum({_duck_words(_duck_plain(_ARTICLE))}) AS BIGINT) AS words,
       CAST(max({_duck_words(_duck_plain(_ARTICLE))}) AS BIGINT) AS most_words
FROM pages GROUP BY 1
""")
def page_word_stats(spark, sf_dir):
    rows = _table(spark, sf_dir, "pages").select(web.page_language().alias("lang"), T.word_count(web.plain_text(web.article_html())).alias("n"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("words"), F.max("n").alias("most_words"))


@query(f"""
SELECT page_id, regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '^{WS2}+|{WS2}+$', '', 'g') AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM pages
""")
def page_title_lang(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", web.page_title().alias("title"), web.page_language().alias("lang"))


@query(f"""
WITH x AS (SELECT page_id, regexp_extract_all({_ARTICLE}, '(?s)<p>(.*?)</p>', 1) AS ps FROM pages)
SELECT page_id, CAST(i - 1 AS BIGINT) AS seq, {_duck_plain('ps[i]')} AS text FROM x, LATERAL (SELECT unnest(range(1, len(ps) + 1)) AS i)
""")
def page_paragraphs(spark, sf_dir):
    return web.page_paragraphs(_table(spark, sf_dir, "pages"))


@query("""
WITH x AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hs FROM pages)
SELECT page_id, CAST(i - 1 AS BIGINT) AS seq, hs[i] AS href FROM x, LATERAL (SELECT unnest(range(1, len(hs) + 1)) AS i)
""")
def link_extract(spark, sf_dir):
    return web.page_links(_table(spark, sf_dir, "pages"))


URLS = [(u,) for u in (
    "https://www.YouTube.com/watch?v=1", "https://youtu.be/x", "https://youtube.com/@me", "https://arxiv.org/abs/2301.00001v2", "http://a.org/x.pdf", "http://a.org/x.pdf?x=1", "https://x.com/a/status/12?t=1&s=2",
    "https://nitter.net/a/status/7", "https://netflix.com/a/status/3", "https://podcasts.apple.com/x", "https://open.spotify.com/show/1", "https://a.org/rss", "https://a.org/feed", "https://a.org/feed/podcast", "https://a.org/series.xml",
    " HTTPS://MOBILE.TWITTER.COM/b/status/99?ref_src=abc ", "plain text", "",
)]


def _duck_any(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in parts) + ")"


_CLASSIFIED = f"""
WITH u AS (SELECT url FROM pages UNION ALL SELECT url FROM {_duck_values(URLS, 'url')}), l AS (SELECT url, trim(lower(url), ' ') AS x FROM u),
 c AS (SELECT url, CASE WHEN {_duck_any('x', P.VIDEO)} THEN 'youtube' WHEN {_duck_any('x', P.PAPER)} OR ends_with(x, '.pdf') THEN 'pdf' WHEN {_duck_any('x', P.POST_HOSTS)} AND contains(x, '/status/') THEN 'twitter'
  WHEN {_duck_any('x', P.PODCAST)} OR {_duck_any('x', P.FEED_STRONG)} OR ({_duck_any('x', P.FEED_WEAK)} AND {_duck_any('x', P.FEED_WORDS)}) THEN 'podcast' ELSE 'article' END AS content_type FROM l)
"""


@query(f"{_CLASSIFIED} SELECT url, content_type, count(*) AS n FROM c GROUP BY url, content_type")
def url_classify(spark, sf_dir):
    rows = _table(spark, sf_dir, "pages").select("url").unionByName(_values(spark, URLS, "url"))
    return rows.select("url", U.classify_url("url").alias("content_type")).groupBy("url", "content_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH u AS (SELECT url FROM {_duck_values(URLS, 'url')} UNION ALL SELECT url FROM pages)
SELECT url, regexp_replace(regexp_replace(url, '(?i)^https?://(?:www\\.)?(?:(?:mobile\\.)?twitter\\.com|x\\.com|nitter\\.[^/]+)/', 'https://x.com/'), '[?&](?:t|s|ref_src|ref_url|src)=[^&#]*', '', 'g') AS canonical,
  nullif(regexp_extract(url, '{P.PAPER_ID}', 1), '') AS paper_id, nullif(regexp_extract(url, '/status/([0-9]+)', 1), '') AS post_id FROM u
""")
def url_normalise(spark, sf_dir):
    rows = _values(spark, URLS, "url").unionByName(_table(spark, sf_dir, "pages").select("url"))
    return rows.select("url", U.canonical_post_url("url").alias("canonical"), U.paper_id("url").alias("paper_id"), U.post_id("url").alias("post_id"))


@query(f"SELECT page_id, {_duck_plain('html')} AS text, CAST(length({_duck_plain('html')}) AS BIGINT) AS n FROM pages")
def tag_strip_clean(spark, sf_dir):
    rows = _table(spark, sf_dir, "pages").select("page_id", web.plain_text("html").alias("text"))
    return rows.withColumn("n", F.length("text").cast("bigint"))


@query("SELECT doc_id, greatest(1, CAST(floor(length(text) / 4) AS BIGINT)) AS tokens, greatest(1, CAST(floor(length(text) / 1.5) AS BIGINT)) AS tokens_cjk FROM documents")
def doc_token_estimate(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens("text").alias("tokens"), T.estimate_tokens("text", True).alias("tokens_cjk"))


CJK = [(-1, "漢字かな"), (-2, "abc 漢字"), (-3, "ab 漢"), (-4, "abcdefg 漢漢漢"), (-5, "  "), (-6, "한국어 text")]


@query(f"""
WITH d AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM {_duck_values(CJK, 'doc_id, text')}),
 c AS (SELECT doc_id, length(regexp_replace(text, '[^\\x{{4E00}}-\\x{{9FFF}}\\x{{3400}}-\\x{{4DBF}}\\x{{3000}}-\\x{{303F}}\\x{{FF00}}-\\x{{FFEF}}\\x{{3040}}-\\x{{309F}}\\x{{30A0}}-\\x{{30FF}}\\x{{AC00}}-\\x{{D7AF}}]', '', 'g')) AS k, length(regexp_replace(text, '{WS2}', '', 'g')) AS n FROM d)
SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(n > 0 AND k / n > 0.3, false) AS cjk FROM c
""")
def doc_language_cjk(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(_values(spark, CJK, "doc_id, text"))
    return rows.select(F.col("doc_id").cast("bigint"), T.is_cjk_dominant("text").alias("cjk"))


@query(f"SELECT doc_id, {_duck_words('text')} AS words FROM documents")
def doc_word_count(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.word_count("text").alias("words"))


MATH = [(-1, "a → b"), (-2, r"\frac{1}{2}"), (-3, r"\fraction"), (-4, "as in (12) "), (-5, "(12) as"), (-6, "∑ x")]


@query(f"""
WITH d AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM {_duck_values(MATH, 'doc_id, text')})
SELECT CAST(doc_id AS BIGINT) AS doc_id, regexp_matches(text, '{P.MATH}') AS has_math FROM d
""")
def doc_math_flag(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(_values(spark, MATH, "doc_id, text"))
    return rows.select(F.col("doc_id").cast("bigint"), T.has_math("text").alias("has_math"))


@query("""
WITH l AS (SELECT conv_id, turn, string_split(text, chr(10)) AS lines, lag(string_split(text, chr(10))) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
 f AS (SELECT conv_id, turn, list_aggregate(list_filter(lines, lambda x: NOT list_contains(coalesce(before, []), x)), 'string_agg', ' ') AS text FROM l)
SELECT conv_id, turn, text FROM f WHERE text <> ''
""")
def line_dedup(spark, sf_dir):
    cues = _table(spark, sf_dir, "conversations").select(F.col("conv_id"), F.col("turn").alias("seq"), "text")
    return C.drop_rolling_lines(cues, "conv_id").select("conv_id", F.col("seq").alias("turn"), "text")


def _event_cues(spark, sf_dir) -> DataFrame:
    """Events as cues of their users: a cue a second long, whose text ends a sentence at views."""
    e = _table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    text = F.concat("event_type", F.when(F.col("event_type") == "view", ".").otherwise(""))
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("doc_id"), seq.cast("bigint").alias("seq"), at.alias("start_seconds"), (at + 1).alias("end_seconds"), text.alias("text"))


_CUES = """e AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + 1 AS t,
  event_type || CASE WHEN event_type = 'view' THEN '.' ELSE '' END AS text FROM events)"""


@query(f"""
WITH {_CUES}, g AS (SELECT *, coalesce(CAST(s - lag(t) OVER w > 43200 AS INT), 0) AS gap, CAST(regexp_matches(text, '[.!?]$') AS INT) AS fin FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
 h AS (SELECT *, sum(gap) OVER (PARTITION BY doc_id ORDER BY seq) AS seg FROM g),
 p AS (SELECT *, coalesce(sum(fin) OVER (PARTITION BY doc_id, seg ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 6 AS para FROM h)
SELECT doc_id, CAST(seg AS BIGINT) AS seg, CAST(para AS BIGINT) AS para, string_agg(text, ' ' ORDER BY seq) AS text, count(*) AS n_cues FROM p GROUP BY ALL
""")
def paragraph_assembly(spark, sf_dir):
    return C.paragraphs(_event_cues(spark, sf_dir), gap=43200.0).select("doc_id", F.col("seg").cast("bigint"), F.col("para").cast("bigint"), "text", "n_cues")


@query(f"""
WITH {_CUES}, c AS (SELECT doc_id, lo AS since, row_number() OVER (PARTITION BY doc_id ORDER BY lo) - 1 AS idx FROM (SELECT doc_id, min(s) AS lo FROM e GROUP BY doc_id, floor(e.s / 259200))),
 f AS (SELECT doc_id, CASE WHEN idx = 0 THEN -1e18 ELSE since END AS since, idx FROM c)
SELECT e.doc_id, e.seq, CAST(f.idx AS INTEGER) AS chapter_idx FROM e ASOF LEFT JOIN f ON e.doc_id = f.doc_id AND e.s >= f.since
""")
def chapter_align(spark, sf_dir):
    cues = _event_cues(spark, sf_dir)
    first = cues.groupBy("doc_id", F.floor(F.col("start_seconds") / 259200)).agg(F.min("start_seconds").alias("start_seconds"))
    chapters = first.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("start_seconds")) - 1).alias("idx"), F.lit("").alias("title"), "start_seconds", F.col("start_seconds").alias("end_seconds"))
    return C.align_to_chapters(cues, chapters).select("doc_id", "seq", "chapter_idx")


@query("""
SELECT event_id, user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) AS used, count(*) OVER w AS requests FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW)
""")
def rate_window(spark, sf_dir):
    e = _table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    return R.usage_window(e, "ts", "cents", 3600.0, ("user_id",)).select("event_id", "user_id", "used", "requests")


LINES = [(-1, "INTRODUCTION\nsome text\nNext part:\nmore\n\nAB\nABC 1\n"), (-2, "no heading\nat all"), (-3, "Title::\n"), (-4, "x:\ny")]


def _duck_cut(heading: str, docs: str) -> str:
    return f"""WITH d AS ({docs}), l AS (SELECT doc_id, i AS pos, ls[i] AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS ls FROM d), LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i)),
 h AS (SELECT *, {heading} AS head FROM l), s AS (SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS seq FROM h)"""


_STRIP = lambda x: f"regexp_replace({x}, '^{WS2}+|{WS2}+$', '', 'g')"


@query(f"""
{_duck_cut(f"regexp_matches({_STRIP('line')}, '^[A-Z][A-Z0-9 :,.\\-]{{2,}}$') OR regexp_matches({_STRIP('line')}, '^[^\\n]{{3,60}}:$')", f"SELECT doc_id, text FROM documents UNION ALL SELECT * FROM {_duck_values(LINES, 'doc_id, text')}")},
 b AS (SELECT doc_id, seq, coalesce(max(CASE WHEN head THEN regexp_replace({_STRIP('line')}, ':+$', '') END), '') AS heading, coalesce(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY pos), '') AS body FROM s GROUP BY doc_id, seq)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(seq AS BIGINT) AS seq, heading, md5({_STRIP('body')}) AS body_md5 FROM b WHERE heading <> '' OR {_STRIP('body')} <> ''
""")
def txt_headings(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    more = spark.createDataFrame(LINES, "doc_id bigint, text string")
    return S.text_sections(docs.unionByName(more)).select("doc_id", F.col("seq").cast("bigint"), "heading", F.md5(F.col("body").cast("binary")).alias("body_md5"))


def _markdown_docs(spark, sf_dir) -> DataFrame:
    """Documents with every third line, of those after the first, made a heading."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 1, F.concat(F.repeat(F.lit("#"), (i % 4 + 1).cast("int")), F.lit(" "), F.left(x, F.lit(30)))).otherwise(x))
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))


_MD = """SELECT doc_id, list_aggregate(list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN (i - 1) % 3 = 1 THEN repeat('#', CAST((i - 1) % 4 + 1 AS BIGINT)) || ' ' || left(ls[i], 30) ELSE ls[i] END), 'string_agg', chr(10)) AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)"""
_BODY = lambda x: f"regexp_replace({_STRIP(x)}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


@query(f"""
{_duck_cut("regexp_matches(line, '^#{1,6}\\s+[^\\n]+$')", _MD)},
 b AS (SELECT doc_id, seq, coalesce(max(CASE WHEN head THEN {_STRIP("regexp_extract(line, '^#{1,6}\\s+([^\\n]+)$', 1)")} END), '') AS heading, coalesce(max(CASE WHEN head THEN length(regexp_extract(line, '^(#{{1,6}})', 1)) END), 2) AS level,
   coalesce(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY pos), '') AS body FROM s GROUP BY doc_id, seq),
 k AS (SELECT *, min(CASE WHEN heading <> '' THEN level END) OVER (PARTITION BY doc_id) AS least FROM b WHERE heading <> '' OR {_STRIP('body')} <> '')
SELECT doc_id, CAST(seq AS BIGINT) AS seq, heading, CAST(CASE WHEN heading <> '' AND least = 1 THEN level + 1 ELSE level END AS INTEGER) AS level, md5({_BODY('body')}) AS body_md5 FROM k
""")
def md_sections(spark, sf_dir):
    return S.markdown_sections(_markdown_docs(spark, sf_dir), pdf_cleanup=False).select("doc_id", F.col("seq").cast("bigint"), "heading", "level", F.md5(F.col("body").cast("binary")).alias("body_md5"))


def _named_sections(spark, sf_dir) -> DataFrame:
    """Lines of documents as sections, some headed as an abstract or references."""
    name = lambda i: F.when(i == 1, "Abstract").when((i == 4) & (F.col("doc_id") % 2 == 0), "REFERENCES").when(i == 6, "works  Cited").otherwise(F.concat(F.lit("Part "), i.cast("string")))
    made = lambda x, i: F.struct(i.cast("bigint").alias("seq"), name(i).alias("heading"), F.lit(2).alias("level"), x.alias("body"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", "\n"), made).alias("sections"))


_NAMED = """n AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS seq, CASE WHEN i = 2 THEN 'Abstract' WHEN i = 5 AND doc_id % 2 = 0 THEN 'REFERENCES' WHEN i = 7 THEN 'works  Cited' ELSE 'Part ' || (i - 1) END AS heading, ls[i] AS body
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i))"""


@query(f"""
WITH {_NAMED}, c AS (SELECT *, min(CASE WHEN regexp_matches(heading, '(?i)^(?:references|bibliography|works\\s+cited|cited\\s+works)$') THEN seq END) OVER (PARTITION BY doc_id) AS cut FROM n)
SELECT doc_id, count(*) AS sections, CAST(max(seq) AS BIGINT) AS last_seq FROM c WHERE cut IS NULL OR seq < cut GROUP BY doc_id
""")
def refs_cut(spark, sf_dir):
    rows = _named_sections(spark, sf_dir).select("doc_id", S.without_references("sections").alias("s")).where(F.size("s") > 0)
    return rows.select("doc_id", F.size("s").cast("bigint").alias("sections"), F.element_at("s", -1)["seq"].alias("last_seq"))


@query(f"""
WITH {_NAMED}, a AS (SELECT *, min(CASE WHEN lower(heading) = 'abstract' THEN seq END) OVER (PARTITION BY doc_id) AS place FROM n),
 b AS (SELECT *, coalesce(max(CASE WHEN seq = place THEN body END) OVER (PARTITION BY doc_id), '') AS abstract FROM a)
SELECT doc_id, md5(abstract) AS abstract_md5, count(*) AS sections FROM b WHERE place IS NULL OR seq <> place GROUP BY doc_id, abstract
""")
def abstract_extract(spark, sf_dir):
    rows = _named_sections(spark, sf_dir).select("doc_id", F.md5(S.abstract("sections").cast("binary")).alias("abstract_md5"), F.size(S.without_abstract("sections")).cast("bigint").alias("sections"))
    return rows.where("sections > 0")


SLUGS = [(-1, "Of ﬁne Ⅳ parts"), (-2, "ＡＢＣ_１２  x"), (-3, "--__--"), (-4, "½ pound"), (-5, "Ünïcode — dash"), (-6, "a" * 79 + "- b")]


def _duck_nfkc(x: str) -> str:
    """Compatibility forms of SLUGS put in full, which is all that normal form KC changes in these texts."""
    for old, new in (("ﬁ", "fi"), ("Ⅳ", "IV"), ("ＡＢＣ", "ABC"), ("１２", "12"), ("½", "1⁄2")):
        x = f"replace({x}, '{old}', '{new}')"
    return x


@query(f"""
WITH t AS (SELECT doc_id, string_split(text, chr(10))[1] AS s FROM documents UNION ALL SELECT * FROM {_duck_values(SLUGS, 'doc_id, s')}), a AS (SELECT doc_id, lower({_duck_nfkc('s')}) AS s FROM t),
 b AS (SELECT doc_id, regexp_replace(regexp_replace(s, '(?:{WS2}|_)+', '-', 'g'), '[^\\p{{L}}\\p{{N}}_\\-]', '', 'g') AS s FROM a),
 c AS (SELECT doc_id, regexp_replace(left(regexp_replace(regexp_replace(s, '-{{2,}}', '-', 'g'), '^-+|-+$', '', 'g'), 80), '-+$', '') AS s FROM b)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug FROM c
""")
def slug(spark, sf_dir):
    ship(spark)
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n")[0].alias("s")).unionByName(_values(spark, SLUGS, "doc_id, s"))
    return rows.select(F.col("doc_id").cast("bigint"), T.slugify("s").alias("slug"))


@query("""
WITH t AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations), h AS (SELECT id, text, replace(left(text, 80), chr(10), ' ') AS head FROM t)
SELECT id, CASE WHEN length(text) <= 80 THEN head ELSE regexp_replace(head, '^((?s).*) [^ ]*$', '\\1') || '...' END AS title FROM h
""")
def title_make(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    turns = _table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), "text")
    return docs.unionByName(turns).select("id", T.make_title("text").alias("title"))


DATES = [(x,) for x in ("2024-05-06", "2024-05-06T07:08:09", "2024/5/6", "6 May 2024", "May 6, 2024", "2024-05-06T07:08:09+02:00", "yesterday", "a long text that is no date", "", "20240506", "D:20240506101112")]


@query(f"""
WITH d AS (SELECT raw FROM {_duck_values(DATES, 'raw')} UNION ALL SELECT unnest([strftime(ts, '%Y-%m-%dT%H:%M:%S'), strftime(ts, '%Y/%m/%d'), strftime(ts, '%-d %B %Y'), strftime(ts, '%B %-d, %Y')]) FROM events)
SELECT raw, coalesce(CASE WHEN regexp_matches(raw, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN raw END, strftime(coalesce(try_strptime(raw, '%Y-%m-%dT%H:%M:%S'), try_strptime(raw, '%Y/%m/%d'), try_strptime(raw, '%d %B %Y'), try_strptime(raw, '%B %d, %Y')), '%Y-%m-%d'),
   CASE WHEN length(raw) >= 10 THEN left(raw, 10) END, 'unknown') AS day,
 CASE WHEN length(raw) = 8 THEN left(raw, 4) || '-' || substr(raw, 5, 2) || '-' || substr(raw, 7, 2) ELSE coalesce(nullif(raw, ''), 'unknown') END AS upload_day,
 CASE WHEN regexp_matches(raw, '^(?:D:)?[0-9]{{8}}') THEN regexp_replace(raw, '^(?:D:)?([0-9]{{4}})([0-9]{{2}})([0-9]{{2}})(?s).*$', '\\1-\\2-\\3') ELSE 'unknown' END AS pdf_day, count(*) AS n
FROM d GROUP BY ALL
""")
def date_normalise(spark, sf_dir):
    forms = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "d MMMM yyyy", "MMMM d, yyyy")
    made = _table(spark, sf_dir, "events").select(F.explode(F.array(*(F.date_format("ts", f) for f in forms))).alias("raw"))
    rows = _values(spark, DATES, "raw").unionByName(made).groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("raw", D.normalise_date("raw").alias("day"), D.upload_date("raw").alias("upload_day"), D.pdf_date("raw").alias("pdf_day"), "n")


@query("""
WITH s AS (SELECT event_id, CAST(floor(value * 37) AS BIGINT) AS s FROM events)
SELECT event_id, s AS seconds, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') ELSE CAST(s // 60 AS VARCHAR) END || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS shown, s AS read_back FROM s
""")
def duration_format(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", F.floor(F.col("value") * 37).cast("bigint").alias("seconds")).withColumn("shown", D.format_duration("seconds"))
    return rows.withColumn("read_back", D.feed_duration("shown"))


@query("""
SELECT d.doc_id, '---' || chr(10) || 'title: "' || replace(replace(text, '\\', '\\\\'), '"', '\\"') || '"' || chr(10) || coalesce('language: "' || lang || '"' || chr(10), '') || coalesce('quality: ' || quality || chr(10), '')
  || 'polished: false' || chr(10) || '---' AS markdown FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def frontmatter_render(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").join(_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.select("doc_id", render.front_matter({"title": F.col("text"), "language": F.col("lang"), "quality": F.col("quality"), "polished": F.lit("false")}, ("quality", "polished")).alias("markdown"))


@query("SELECT user_id, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 5")
def topn_per_doc(spark, sf_dir):
    return R.first_n(_table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value"), 5, "user_id", F.col("value").desc(), "event_id")


@query("SELECT min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents GROUP BY text")
def ordered_distinct(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))
    return R.ordered_distinct(rows, "text_md5", pos="doc_id").select("doc_id", "text_md5")


@query("""
WITH t AS (SELECT conv_id, turn, text FROM conversations WHERE text <> ''), b AS (SELECT conv_id, count(*) AS n, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS body FROM t GROUP BY conv_id)
SELECT conv_id, n > 1 AS is_thread, CAST(n AS INTEGER) AS thread_length, """+_duck_words("body")+""" AS words, CASE WHEN length(body) <= 80 THEN replace(left(body, 80), chr(10), ' ') ELSE regexp_replace(replace(left(body, 80), chr(10), ' '), '^((?s).*) [^ ]*$', '\\1') || '...' END AS title FROM b
""")
def thread_stats(spark, sf_dir):
    """Conversations as threads, a turn a post."""
    rows = _table(spark, sf_dir, "conversations").where("text <> ''")
    posts = F.array_sort(F.collect_list(F.struct(F.col("turn").alias("seq"), F.lit("").alias("heading"), F.lit(2).alias("level"), F.col("text").alias("body"))))
    is_thread, length, words, title = threads.thread_stats("s")
    return rows.groupBy("conv_id").agg(posts.alias("s")).select("conv_id", is_thread.alias("is_thread"), length.alias("thread_length"), words.alias("words"), title.alias("title"))


@query(f"{_CLASSIFIED} SELECT content_type, count(*) AS n FROM c GROUP BY content_type")
def type_counts(spark, sf_dir):
    items = _table(spark, sf_dir, "pages").select("url").unionByName(_values(spark, URLS, "url"))
    return R.type_counts(R.routed(items.withColumn("pos", F.lit(0))))


@query("""
SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY event_type
""")
def json_props(spark, sf_dir):
    """Properties as lines of a tool's answer, one for each event."""
    rows = structured.ndjson(_table(spark, sf_dir, "events").select(F.col("event_type").alias("doc_id"), "props"), "k bigint", "props")
    return rows.groupBy(F.col("doc_id").alias("event_type")).agg(F.sum("x.k").alias("total"), F.count(F.lit(1)).alias("n"))


from loomtext import queries_documents, queries_formats  # noqa: E402, F401  they add theirs
