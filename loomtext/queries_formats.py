"""Queries of readers: texts of a format are written from whole tables, the engine reads them, and SQL tells from the same
tables what must come out, without the format between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import cues as C
from loomtext.operators import relational as R
from loomtext.operators import sections as S
from loomtext.queries import _STRIP, WS2, _duck_values, _duck_words, _table, _values, query
from loomtext.runtime import ship
from loomtext.sources import structured, subtitles, threads

_TURNS = "t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"
_duck_title = lambda x: f"CASE WHEN length({x}) <= 80 THEN replace(left({x}, 80), chr(10), ' ') ELSE regexp_replace(replace(left({x}, 80), chr(10), ' '), '^((?s).*) [^ ]*$', '\\1') || '...' END"


def _joined(turns: DataFrame, piece: Column, sep: str, keep: Column | None = None) -> DataFrame:
    """Rows (doc_id, text): a piece of text of each turn of a conversation, in order. `i` counts turns from 0."""
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("all"))
    rows = rows.select(F.col("conv_id").alias("doc_id"), F.posexplode("all").alias("i", "x")).select("doc_id", "i", "x.*")
    return rows.withColumn("piece", piece).where(F.lit(True) if keep is None else keep).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "piece"))), lambda x: x["piece"]), sep).alias("text"))


def _pad(x: Column, n: int) -> Column:
    """A whole number with at least n digits; lpad alone would cut longer ones."""
    digits = F.floor(x).cast("bigint").cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(n)), F.lit("0"))


def _stamp(ms: Column, dot) -> Column:
    return F.concat(_pad(ms / 3600000, 2), F.lit(":"), _pad(ms / 60000 % 60, 2), F.lit(":"), _pad(ms / 1000 % 60, 2), dot, _pad(ms % 1000, 3))


@query(f"""
WITH {_TURNS} SELECT conv_id AS doc_id, CAST(i + CASE WHEN conv_id % 3 = 1 THEN 0 ELSE 2 END AS BIGINT) AS seq, (i * 1799250 + 500) / 1000.0 AS start_seconds, (i * 1799250 + 2750) / 1000.0 AS end_seconds,
 {_STRIP("text || ' & ''x'''")} AS text FROM t
""")
def subtitle_cues(spark, sf_dir):
    """Conversations as WebVTT, SubRip and files of another suffix: headers, notes, tags, word stamps, entities, cues without
    hours."""
    ship(spark)
    vtt = F.col("doc_id") % 3 != 1
    ms = F.col("i") * 1799250
    dot = F.when(vtt, ".").otherwise(",")
    word = F.when(vtt, "<00:00:01.000>").otherwise("")
    block = F.concat(F.when(vtt, "").otherwise(F.concat((F.col("i") + 1).cast("string"), F.lit("\n"))), _stamp(ms + 500, dot), F.lit(" --> "), _stamp(ms + 2750, dot), F.lit("\n<i>"), "text", F.lit("</i>"), word, F.lit(" &amp; &#39;x&#39;"))
    rows = _joined(_table(spark, sf_dir, "conversations"), block, "\n\n\n")
    head = F.when(vtt, "WEBVTT\r\nKind: captions\n\nNOTE 00:00:00.000 --> 00:00:01.000\n\n").otherwise("")
    path = F.when(F.col("doc_id") % 3 == 0, "a.vtt").when(F.col("doc_id") % 3 == 1, "b.SRT").otherwise("c.sub")
    made = rows.select("doc_id", path.alias("path"), F.concat(head, "text", F.lit("\n\n00:01.000 --> 00:02.000\nno hours")).alias("text"))
    return subtitles.parse_subtitles(made)


_CLEAN = f"regexp_replace(text, '[ \\t]+', ' ', 'g')"


@query(f"""
WITH d AS (SELECT conv_id, turn, CASE turn % 4 WHEN 1 THEN '  ' || replace(text, ' ', chr(9) || ' ') WHEN 2 THEN ' ' || chr(9) || chr(10) || ' ' WHEN 3 THEN replace(text, chr(10), ' ' || chr(10) || '  ') ELSE text END AS text FROM conversations),
 l AS (SELECT conv_id, turn, list_aggregate(list_transform(string_split({_CLEAN}, chr(10)), lambda x: {_STRIP('x')}), 'string_agg', chr(10)) AS text FROM d)
SELECT conv_id AS doc_id, turn AS seq, {_STRIP('text')} AS text FROM l WHERE {_STRIP('text')} <> ''
""")
def cue_cleaning(spark, sf_dir):
    turn, text = F.col("turn") % 4, F.col("text")
    dirty = F.when(turn == 1, F.concat(F.lit("  "), F.replace(text, F.lit(" "), F.lit("\t ")))).when(turn == 2, " \t\n ").when(turn == 3, F.replace(text, F.lit("\n"), F.lit(" \n  "))).otherwise(text)
    return C.clean_cues(_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), dirty.alias("text")))


_CJK_TEXT = "CASE WHEN user_id % 3 = 0 THEN CASE WHEN event_type = 'view' THEN '見る。' ELSE '漢字' END WHEN user_id % 3 = 1 AND event_id % 3 = 0 THEN 'abc漢' ELSE event_type || CASE WHEN event_type = 'view' THEN '?' ELSE '' END END"
_SPACE_RATIO = f"length(regexp_replace(string_agg(text, ' ') FILTER (seq <= 50), '[^\\x{{4E00}}-\\x{{9FFF}}\\x{{3000}}-\\x{{303F}}\\x{{3040}}-\\x{{309F}}]', '', 'g')) / length(regexp_replace(string_agg(text, ' ') FILTER (seq <= 50), '{WS2}', '', 'g'))"


@query(f"""
WITH e AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, epoch_us(ts) / 1e6 AS s, {_CJK_TEXT} AS text FROM events),
 j AS (SELECT doc_id, {_SPACE_RATIO} > 0.3 AS cjk FROM e GROUP BY doc_id),
 g AS (SELECT *, coalesce(CAST(s - (lag(s) OVER w + 1) > 43200 AS INT), 0) AS gap, CAST(regexp_matches(text, '[.!?。]$') AS INT) AS fin FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
 h AS (SELECT *, sum(gap) OVER (PARTITION BY doc_id ORDER BY seq) AS seg FROM g),
 p AS (SELECT *, coalesce(sum(fin) OVER (PARTITION BY doc_id, seg ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 6 AS para FROM h),
 t AS (SELECT doc_id, seg, para, CASE WHEN any_value(cjk) THEN string_agg(text, '' ORDER BY seq) ELSE string_agg(text, ' ' ORDER BY seq) END AS text FROM p JOIN j USING (doc_id) GROUP BY doc_id, seg, para)
SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY seg, para) AS body FROM t GROUP BY doc_id
""")
def transcript_text(spark, sf_dir):
    """Events as cues, some of them CJK: paragraphs joined with or without spaces by the first 50 of each document."""
    e = _table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    view = F.col("event_type") == "view"
    text = F.when(F.col("user_id") % 3 == 0, F.when(view, "見る。").otherwise("漢字")).when((F.col("user_id") % 3 == 1) & (F.col("event_id") % 3 == 0), "abc漢").otherwise(F.concat("event_type", F.when(view, "?").otherwise("")))
    cues = e.select(F.col("user_id").alias("doc_id"), seq.cast("bigint").alias("seq"), at.alias("start_seconds"), (at + 1).alias("end_seconds"), text.alias("text"))
    return C.cues_to_text(cues, gap=43200.0)


#: Languages of a video's manual and automatic tracks, and the declared one, by customer modulo their numbers.
MANUAL = [None, "de en-US fr", "live_chat", "it es", "en", "ja-JP ja", "zh-Hans zh"]
AUTOMATIC = ["en live_chat", "fr en en-GB", None, "pt-BR pt", "nl sv"]
DECLARED = ["en", None, "pt", "", "ja", "zh"]
_duck_nulls = lambda xs: "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in xs) + "]"


@query(f"""
WITH c AS (SELECT c_custkey AS doc_id, {_duck_nulls(DECLARED)}[c_custkey % {len(DECLARED)} + 1] AS declared, {_duck_nulls(MANUAL)}[c_custkey % {len(MANUAL)} + 1] AS m, {_duck_nulls(AUTOMATIC)}[c_custkey % {len(AUTOMATIC)} + 1] AS a FROM customer),
 r AS (SELECT doc_id, declared, 'm' AS kind, m AS langs FROM c WHERE m IS NOT NULL UNION ALL SELECT doc_id, declared, 'a', a FROM c WHERE a IS NOT NULL), k AS (SELECT doc_id, declared, kind = 'a' AS auto, unnest(string_split(langs, ' ')) AS lang, generate_subscripts(string_split(langs, ' '), 1) AS pos FROM r),
 f AS (SELECT * FROM k WHERE lang <> 'live_chat'), how AS (SELECT unnest(['', 'auto', 'en', 'pt']) AS how),
 o AS (SELECT doc_id, how, lang, auto, row_number() OVER (PARTITION BY doc_id, how ORDER BY CASE WHEN how = 'auto' THEN NOT auto ELSE auto END,
   CASE WHEN lang = CASE WHEN how IN ('en', 'pt') THEN how ELSE declared END THEN 0 WHEN starts_with(lang, CASE WHEN how IN ('en', 'pt') THEN how ELSE declared END) THEN 1 ELSE 2 END, pos) AS r,
   CASE WHEN how IN ('en', 'pt') THEN starts_with(lang, how) ELSE true END AS fits FROM f, how),
 b AS (SELECT doc_id, how, lang, auto FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, how ORDER BY r) AS z FROM o WHERE fits) WHERE z = 1)
SELECT d.doc_id, d.how, b.lang, b.auto AS is_auto, CASE WHEN b.lang IS NULL THEN 'NoSubtitlesError' END AS error_type FROM (SELECT DISTINCT k.doc_id, how.how FROM k, how) d LEFT JOIN b ON b.doc_id = d.doc_id AND b.how = d.how
""")
def track_select(spark, sf_dir):
    """Subtitle maps of each customer's metadata, by preference of manual or automatic tracks and by two forced languages."""
    of = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("c_custkey") % len(xs) + 1).cast("int"))
    one = lambda xs: F.coalesce(F.concat(F.lit("{"), F.array_join(F.transform(F.split(of(xs), " "), lambda x: F.concat(F.lit('"'), x, F.lit('": []'))), ", "), F.lit("}")), F.lit("null"))
    told = F.concat(F.lit('{"language": '), F.coalesce(F.concat(F.lit('"'), of(DECLARED), F.lit('"')), F.lit("null")), F.lit(', "subtitles": '), one(MANUAL), F.lit(', "automatic_captions": '), one(AUTOMATIC), F.lit("}"))
    rows = _table(spark, sf_dir, "customer").where(of(MANUAL).isNotNull() | of(AUTOMATIC).isNotNull()).select(F.col("c_custkey").alias("doc_id"), told.alias("json"))
    tracks = structured.tracks_of(rows)
    hows = {"": {}, "auto": {"prefer_auto": True}, "en": {"forced": "en"}, "pt": {"forced": "pt"}}
    parts = [C.select_track(tracks, **how).select("doc_id", F.lit(name).alias("how"), "lang", "is_auto", "error_type") for name, how in hows.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _json(**fields) -> Column:
    """A JSON object of columns; null columns are left out."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())))


@query("""
SELECT doc_id, 'v' || doc_id AS video_id, CASE doc_id % 4 WHEN 0 THEN 'Untitled' WHEN 1 THEN NULL ELSE text END AS title, CASE WHEN doc_id % 3 = 0 THEN 'http://w/' || doc_id WHEN doc_id % 3 = 1 THEN 'http://o/' || doc_id ELSE '' END AS url,
 CASE WHEN doc_id % 5 = 0 THEN 'Unknown' WHEN doc_id % 5 = 1 THEN 'Up' ELSE source END AS channel, CASE WHEN doc_id % 7 = 0 THEN 'unknown' ELSE '2024-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-05' END AS publish_date, CAST(n_chars AS INTEGER) AS duration,
 CASE WHEN n_chars >= 3600 THEN (n_chars // 3600) || ':' || lpad(CAST(n_chars // 60 % 60 AS VARCHAR), 2, '0') ELSE CAST(n_chars // 60 AS VARCHAR) END || ':' || lpad(CAST(n_chars % 60 AS VARCHAR), 2, '0') AS duration_text, lang AS language, CAST(CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END AS BIGINT) AS chapters
FROM documents
""")
def video_info(spark, sf_dir):
    """Documents as a video tool's metadata, with keys missing, null and present."""
    k = F.col("doc_id")
    pair = lambda name, value: F.concat(F.lit(f'"{name}": '), value)
    text = lambda c: F.substring(F.to_json(F.array(c)), 2, 1 << 20)
    quoted = lambda c: F.regexp_replace(text(c), r"\]\z", "")
    fields = F.array(
        pair("id", quoted(F.concat(F.lit("v"), k.cast("string")))), F.when(k % 4 == 1, '"title": null').when(k % 4 > 1, pair("title", quoted(F.col("text")))),
        F.when(k % 3 == 0, pair("webpage_url", quoted(F.concat(F.lit("http://w/"), k.cast("string"))))), F.when(k % 3 < 2, pair("original_url", quoted(F.concat(F.lit("http://o/"), k.cast("string"))))),
        F.when(k % 5 > 1, pair("channel", quoted("source"))), F.when(k % 5 == 1, F.lit('"uploader": "Up"')), F.when(k % 7 != 0, pair("upload_date", quoted(F.concat(F.lit("2024"), _pad(k % 12 + 1, 2), F.lit("05"))))),
        pair("duration", F.concat(F.col("n_chars").cast("string"), F.lit(".7"))), pair("language", quoted("lang")), F.when(k % 2 == 0, '"chapters": [{"title": "a", "start_time": 0, "end_time": 1}, {"title": "b", "start_time": 1.5, "end_time": 2}]').when(k % 4 == 1, '"chapters": null'),
    )
    made = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("{"), F.array_join(F.filter(fields, lambda x: x.isNotNull()), ", "), F.lit("}")).alias("json"))
    return structured.video_info(made).select("doc_id", "video_id", "title", "url", "channel", "publish_date", "duration", "duration_text", "language", F.size("chapters").cast("bigint").alias("chapters"))


_XML = lambda x: F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


@query(f"""
WITH {_TURNS} SELECT conv_id AS doc_id, CAST(i AS INTEGER) AS pos, CASE WHEN i = 4 THEN 'Untitled Episode' ELSE {_STRIP("text")} || ' & <' || i || '>' END AS title, CASE WHEN conv_id % 4 = 0 THEN 'Unknown Podcast' ELSE 'Show ' || conv_id END AS show_name, CASE WHEN i % 2 = 0 THEN CAST(i + 1 AS VARCHAR) END AS episode_number,
 CASE WHEN i % 3 = 0 THEN 'http://page/' || conv_id || '/' || i ELSE 'http://a/' || conv_id || '/' || i || CASE WHEN i = 2 THEN '.ogg' ELSE '.mp3' END END AS url, 'http://a/' || conv_id || '/' || i || CASE WHEN i = 2 THEN '.ogg' ELSE '.mp3' END AS audio_url,
 CASE WHEN i = 0 THEN '2024-05-07' WHEN i = 5 THEN 'unknown' ELSE '2024-05-0' || (i + 1) END AS publish_date, CAST(CASE WHEN i = 0 THEN 3723 WHEN i = 2 THEN 90 WHEN i = 4 THEN 59 ELSE 0 END AS BIGINT) AS duration, CASE WHEN conv_id % 5 > 0 THEN 'fr' END AS language
FROM t WHERE i < 6 AND i <> 3
""")
def feed_episodes(spark, sf_dir):
    """Conversations as RSS feeds: the first six items, of which the fourth has no audio; audio by type, suffix and link."""
    i, k = F.col("i"), F.col("doc_id").cast("string")
    at = F.concat(F.lit("http://a/"), k, F.lit("/"), i.cast("string"), F.when(i == 2, ".ogg").otherwise(".mp3"))
    audio = F.when(i == 3, F.concat(F.lit('<enclosure url="'), at, F.lit('.pdf" type="application/pdf"/>'))).when(i == 1, F.concat(F.lit('<link rel="x" type="audio/mpeg" href="'), at, F.lit('"/>'))).when(i == 2, F.concat(F.lit('<enclosure url="'), at, F.lit('" type=""/>'))).otherwise(F.concat(F.lit('<enclosure url="http://no" type="text/html"/><enclosure type="audio/mpeg" url="'), at, F.lit('"/>')))
    date = F.when(i == 0, "Mon, 06 May 2024 23:30:00 -0500").when(i == 5, "soon").otherwise(F.concat(F.lit("Tue, 0"), (i + 1).cast("string"), F.lit(" May 2024 10:00:00 GMT")))
    item = F.concat(
        F.lit("<item>"), F.when(i == 4, "").otherwise(F.concat(F.lit("<title> "), _XML(T.strip("text")), F.lit(" &amp; &lt;"), i.cast("string"), F.lit("&gt; </title>"))), audio, F.when(i % 3 == 0, F.concat(F.lit("<link>http://page/"), k, F.lit("/"), i.cast("string"), F.lit("</link>"))).otherwise(""),
        F.lit("<pubDate>"), date, F.lit("</pubDate>"), F.when(i == 0, "<itunes:duration>1:02:03</itunes:duration>").when(i == 2, "<itunes:duration>1:30</itunes:duration>").when(i == 4, "<duration>59.9</duration>").otherwise(""), F.when(i % 2 == 0, F.concat(F.lit("<itunes:episode>"), (i + 1).cast("string"), F.lit("</itunes:episode>"))).otherwise(""), F.lit("</item>"),
    )
    rows = _joined(_table(spark, sf_dir, "conversations"), item, "\n")
    title = F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("<title>Show "), k, F.lit("</title>")))
    xml = F.concat(F.lit('<?xml version="1.0"?><rss><channel>'), title, F.when(F.col("doc_id") % 5 > 0, "<language>fr</language>").otherwise(""), "text", F.lit("</channel></rss>"))
    return structured.feed_episodes(rows.select("doc_id", xml.alias("xml")), 6).drop("description")


@query(f"""
WITH {_TURNS}, l AS (SELECT conv_id, i, text, role FROM t WHERE i % 3 <> 2), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS r FROM l)
SELECT 'http://tool/' || conv_id AS doc_id, CAST(r AS INTEGER) AS pos, CASE WHEN i % 2 = 0 THEN text ELSE 'Untitled Episode' END AS title, CASE WHEN i = 0 THEN 'series' WHEN i = 1 THEN 'album' WHEN i = 3 THEN 'channel' ELSE 'Unknown Podcast' END AS show_name,
  CASE WHEN i % 2 = 1 THEN CAST(i AS VARCHAR) END AS episode_number, 'http://e/' || i AS audio_url, CASE WHEN i = 1 THEN '2024-02-03' ELSE 'unknown' END AS publish_date, CAST(i * 60 AS BIGINT) AS duration, role AS language FROM r WHERE r < 3 AND conv_id % 3 = 1
UNION ALL SELECT 'http://tool/' || conv_id, 0, 'Episode', 'Podcast', NULL, 'http://tool/' || conv_id, 'unknown', 0, NULL FROM (SELECT DISTINCT conv_id FROM t) WHERE conv_id % 3 = 2
UNION ALL SELECT 'http://tool/' || conv_id, 0, 'Only', 'Feed', NULL, 'http://a/x.mp3', '2024-05-06', 61, NULL FROM (SELECT DISTINCT conv_id FROM t) WHERE conv_id % 3 = 0
""")
def feed_resolver(spark, sf_dir):
    """Feeds that are RSS, a video tool's lines (some of which are broken), or neither."""
    turns = _table(spark, sf_dir, "conversations")
    i = F.col("i")
    line = F.when(i % 3 == 2, F.when(i == 2, "{broken").otherwise("")).otherwise(_json(
        title=F.when(i % 2 == 0, F.col("text")), series=F.when(i == 0, "series"), album=F.when(i < 2, "album"), channel=F.when(i < 4, "channel"), episode_number=F.when(i % 2 == 1, i), url=F.when(i % 2 == 0, F.concat(F.lit("http://e/"), i.cast("string"))),
        webpage_url=F.concat(F.lit("http://e/"), i.cast("string")), upload_date=F.when(i == 1, "20240203"), duration=i * 60 + 0.5, language=F.col("role"),
    ))
    url = F.concat(F.lit("http://tool/"), F.col("doc_id").cast("string"))
    lines = _joined(turns, line, "\n").withColumn("kind", F.col("doc_id") % 3).withColumn("doc_id", url)
    rss = "<rss><channel><title>Feed</title><item><title>Only</title><enclosure url='http://a/x.mp3'/><pubDate>06 May 2024 01:00 GMT</pubDate><duration>1:01</duration></item></channel></rss>"
    feeds = lines.select("doc_id", F.when(F.col("kind") == 0, rss).otherwise("<html>none").alias("xml"))
    tool = lines.where("kind < 2").select("doc_id", "text")
    return structured.resolved_feeds(lines.select("doc_id"), feeds, tool, 3).select("doc_id", "pos", "title", "show_name", "episode_number", "audio_url", "publish_date", "duration", "language")


@query(f"""
WITH {_TURNS}, e AS (SELECT conv_id, i, CASE WHEN role = 'user' THEN 'http://v?watch=' || (conv_id % 5) || i ELSE 'https://www.youtube.com/watch?v=' || i || 'x' END AS url FROM t WHERE i % 4 <> 3),
 a AS (SELECT conv_id, i, url FROM e WHERE conv_id % 2 = 0 UNION ALL SELECT DISTINCT conv_id, 0, 'https://y/playlist?l=' || conv_id FROM t WHERE conv_id % 2 = 1)
SELECT url, CAST(arg_min(conv_id, [conv_id, i]) AS INTEGER) AS item, CAST(arg_min(i, [conv_id, i]) AS INTEGER) AS n FROM a GROUP BY url
""")
def playlist_expand(spark, sf_dir):
    """Conversations as playlists whose entries are lines of a tool; those of odd conversations can't be had and stay."""
    i = F.col("i")
    line = F.when(i % 4 == 3, '{"id": "none"}').otherwise(_json(id=F.concat(i.cast("string"), F.lit("x")), url=F.when(F.col("role") == "user", F.concat(F.lit("http://v?watch="), (F.col("doc_id") % 5).cast("string"), i.cast("string"))), webpage_url=F.lit("http://short")))
    lists = _joined(_table(spark, sf_dir, "conversations"), line, "\n").withColumn("url", F.concat(F.lit("https://y/playlist?l="), F.col("doc_id").cast("string")))
    entries = structured.playlist_entries(lists.where("doc_id % 2 = 0").select(F.col("url").alias("doc_id"), "text"))
    found = R.expanded(lists.select(F.col("doc_id").cast("int").alias("pos"), "url"), entries)
    return found.select("url", F.col("pos.pos").alias("item"), F.col("pos.n").alias("n"))


@query(f"""
SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN 'Untitled' ELSE {_STRIP(f"regexp_replace(text, '{WS2}+', ' ', 'g')")} || ' & more' END AS title, CASE WHEN doc_id % 6 = 5 THEN '' ELSE {_STRIP(f"regexp_replace(text, '{WS2}+', ' ', 'g')")} END AS abstract_head, CASE WHEN doc_id % 6 = 5 THEN 'unknown' ELSE '2024-03-04' END AS publish_date,
 CASE WHEN doc_id % 6 = 5 THEN '' ELSE 'A. ' || source || ';' || lang END AS authors, CASE WHEN doc_id % 6 = 5 THEN '' ELSE 'cs.CL;' || lang END AS categories, CASE WHEN doc_id % 2 = 0 AND doc_id % 6 <> 5 THEN '10.1/' || doc_id END AS doi, CASE WHEN doc_id % 6 = 5 THEN 'ArxivAPIError' END AS error_type FROM documents
""")
def atom_papers(spark, sf_dir):
    """Documents as Atom answers, every sixth an error."""
    k = F.col("doc_id")
    broken = F.replace(_XML("text"), F.lit(" "), F.lit(" \n  "))
    good = F.concat(
        F.lit("<id>http://arxiv.org/abs/1</id><title> "), broken, F.lit("\n &amp;  more</title><author><name>A. "), "source", F.lit("</name></author><author><name>"), "lang", F.lit("</name></author><summary> "), _XML("text"), F.lit(" </summary><published>2024-03-04T05:06:07Z</published><category term=\"cs.CL\"/><category term=\""),
        "lang", F.lit('"/>'), F.when(k % 2 == 0, F.concat(F.lit("<arxiv:doi>10.1/"), k.cast("string"), F.lit("</arxiv:doi>"))).otherwise(""),
    )
    xml = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><title>query</title><entry>'), F.when(k % 6 == 5, "<id>http://arxiv.org/api/errors#x</id>").otherwise(good), F.lit("</entry><entry><title>second</title></entry></feed>"))
    rows = structured.papers(_table(spark, sf_dir, "documents").select("doc_id", xml.alias("xml")))
    return rows.select("doc_id", "title", F.col("abstract").alias("abstract_head"), "publish_date", F.array_join("authors", ";").alias("authors"), F.array_join("categories", ";").alias("categories"), "doi", "error_type")


@query("""
SELECT 'n' || c_custkey AS name, c_name AS value, CASE WHEN c_custkey % 4 = 0 THEN 'api.x.com' ELSE '.x.com' END AS domain, '/' || c_nationkey AS path, c_custkey % 2 = 0 AS secure, c_custkey % 3 = 0 AS http_only FROM customer WHERE c_custkey % 5 <> 1 AND c_custkey % 7 <> 0 AND c_custkey % 4 <> 0
""")
def cookie_lines(spark, sf_dir):
    """Customers as lines of a cookie file, some of them comments, of other domains or too short."""
    k = F.col("c_custkey")
    line = F.concat_ws("\t", F.when(k % 4 == 0, "api.x.org").otherwise(".x.com"), F.lit("TRUE"), F.concat(F.lit("/"), F.col("c_nationkey").cast("string")), F.when(k % 2 == 0, "True").otherwise("FALSE"), F.lit("0"), F.concat(F.lit("n"), k.cast("string")), F.when(k % 7 != 0, F.col("c_name")))
    return structured.cookies(_table(spark, sf_dir, "customer").select(F.concat(F.when(k % 5 == 1, "# ").when(k % 3 == 0, "#HttpOnly_").otherwise(""), line).alias("value")))


_PLAIN = "t AS (SELECT conv_id, turn, conv_id * 10 + turn AS doc_id, text, role, (conv_id + turn) % 9 AS k FROM conversations)"


@query(f"""
WITH {_PLAIN}, p AS (SELECT *, CASE WHEN k = 1 THEN text || ' and the rest of a long note' WHEN k = 8 THEN text || ' as rendered' WHEN k = 6 THEN 'https://t.co/a' || doc_id || '  https://b.c/d' WHEN k = 7 THEN text || ' https://t.co/zz' ELSE text END AS own FROM t),
 s AS (SELECT doc_id, k, role, own, CASE WHEN k IN (3, 4) THEN 'Title ' || doc_id WHEN k = 6 THEN 'Linked' ELSE own END AS base, CASE WHEN k = 3 THEN text WHEN k = 4 THEN 'Body ' || doc_id || chr(10) || chr(10) || 'more' WHEN k = 6 THEN 'page of ' || doc_id ELSE own END AS body FROM p)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CASE WHEN k IN (5) THEN '' ELSE '@' || role END AS author, CASE WHEN k = 5 THEN '' WHEN k = 0 THEN role ELSE 'Name' END AS author_name, CASE WHEN k = 5 THEN 'unknown' WHEN k = 2 THEN 'unknown' ELSE '2024-05-06' END AS publish_date,
 CASE WHEN k = 5 THEN '' ELSE {_duck_title('base')} END AS title, CASE WHEN k = 5 THEN '' WHEN k = 3 THEN 'Title ' || doc_id || ';' || body || ';Note;This is an X Article preview. Export cookies from Chrome and use --cookies cookies.txt for full content.' WHEN k = 4 THEN 'Head;Body ' || doc_id || ';;more' ELSE ';' || body END AS sections,
 CASE WHEN k = 5 THEN 0 ELSE {_duck_words('body')} END AS word_count, CASE WHEN k IN (3, 4) THEN 'x_article' WHEN k IN (1, 8) THEN 'note_tweet' ELSE 'tweet' END AS tweet_subtype, CASE WHEN k = 5 THEN 'Tweet deleted or unavailable: gone' END AS error_message,
 CASE WHEN k = 0 THEN 'u1,u3' ELSE '' END AS photos, k = 6 AS link_only, k <> 5 AND {_duck_words('own')} < 50 AND k IN (6, 7) AS maybe_cut FROM s
""")
def syndication_posts(spark, sf_dir):
    """Turns as answers of the syndication service, one branch by each of nine kinds: photos, long and short notes, previews
    and full articles, deleted posts, links alone with the page they lead to, cut texts, notes that a browser rendered."""
    rows = _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 10 + F.col("turn")).alias("doc_id"), "text", "role", ((F.col("conv_id") + F.col("turn")) % 9).alias("k"))
    k, key = F.col("k"), F.col("doc_id").cast("string")
    note = lambda t: F.struct(F.struct(F.struct(t.alias("text")).alias("result")).alias("note_tweet_results"))
    text = F.when(k == 6, F.concat(F.lit("https://t.co/a"), key, F.lit("  https://b.c/d"))).when(k == 7, F.concat("text", F.lit(" https://t.co/zz"))).otherwise(F.col("text"))
    post = _json(
        __typename=F.lit("Tweet"), user=F.struct(F.col("role").alias("screen_name"), F.when(k != 0, "Name").alias("name")), created_at=F.when(k == 2, "last May").otherwise("2024-05-06T23:59:59.000Z"), text=text,
        note_tweet=F.when(k == 1, note(F.concat("text", F.lit(" and the rest of a long note")))).when(k == 2, note(F.lit("x"))), noteTweet=F.when(k == 8, F.struct(F.lit("9").alias("id"))),
        article=F.when(k.isin(3, 4), F.struct(F.concat(F.lit("Title "), key).alias("title"), F.col("text").alias("preview_text"), F.lit("9").alias("rest_id"))),
        mediaDetails=F.when(k == 0, F.array(*(F.struct(F.lit(t).alias("type"), F.lit(u).alias("media_url_https")) for t, u in (("photo", "u1"), ("video", "u2"), ("photo", "u3"))))),
    )
    answers = rows.select("doc_id", F.concat(F.lit("https://x.com/a/status/"), key).alias("url"), F.when(k == 5, '{"__typename": "TweetTombstone", "tombstone": {"text": {"text": "gone"}}}').otherwise(post).alias("json"))
    section = lambda i, h, b: F.struct(F.lit(i).cast("bigint").alias("seq"), h.alias("heading"), F.lit(2).alias("level"), b.alias("body"))
    rendered = rows.where("k IN (4, 8)").select("doc_id", F.lit("T").alias("title"), F.when(k == 8, F.concat("text", F.lit(" as rendered"))).alias("note"), F.when(k == 4, F.array(section(0, F.lit("Head"), F.concat(F.lit("Body "), key)), section(1, F.lit(""), F.lit("more")))).alias("sections"))
    linked = rows.where("k = 6").select("doc_id", F.lit("Linked").alias("title"), F.array(section(0, F.lit(""), F.concat(F.lit("page of "), key))).alias("sections"))
    found = structured.posts(answers, rendered, linked)
    flat = F.array_join(F.flatten(F.transform("sections", lambda s: F.array(s["heading"], s["body"]))), ";")
    return found.select("doc_id", "author", "author_name", "publish_date", "title", flat.alias("sections"), "word_count", "tweet_subtype", "error_message", F.array_join("photos", ",").alias("photos"), (F.col("link_only") & (F.col("sections") != F.array().cast(structured.SECTIONS))).alias("link_only"), "maybe_cut")


@query(f"""
WITH {_PLAIN}, p AS (SELECT *, replace({_STRIP("text")}, chr(10), ' ') || chr(10) || 'bold & more' || chr(10) || 'end' AS body FROM t)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CASE WHEN k = 0 THEN '' ELSE '@' || role END AS author, 'Name' AS author_name, CASE WHEN k = 1 THEN 'unknown' ELSE '2024-12-0' || (k + 1) END AS publish_date, {_duck_title('body')} AS title, body, {_duck_words('body')} AS word_count FROM p
""")
def oembed_posts(spark, sf_dir):
    """Turns as oEmbed answers with tags, entities and line breaks in the quoted paragraph."""
    ship(spark)
    rows = _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 10 + F.col("turn")).alias("doc_id"), "text", "role", ((F.col("conv_id") + F.col("turn")) % 9).alias("k"))
    k = F.col("k")
    said = F.replace(T.strip("text"), F.lit("\n"), F.lit(" "))
    html = F.concat(F.lit('<blockquote class="t"><p lang="en" dir="ltr">'), said, F.lit(' <b>bold &amp; more</b><br>end</p>&mdash; N <a href="a">no date</a> <a href="u">'), F.when(k == 1, "some day").otherwise(F.concat(F.lit("December "), (k + 1).cast("string"), F.lit(", 2024"))), F.lit("</a></blockquote><script></script>"))
    answers = rows.select("doc_id", F.lit("https://x.com/a/status/1").alias("url"), _json(author_name=F.lit("Name"), author_url=F.when(k == 0, "https://x.com/q").otherwise(F.concat(F.lit("https://twitter.com/"), "role")), html=html).alias("json"))
    found = structured.embedded_posts(answers)
    return found.select("doc_id", "author", "author_name", "publish_date", "title", F.col("sections")[0]["body"].alias("body"), "word_count")


@query(f"""
WITH {_TURNS}, p AS (SELECT conv_id, i, n, CASE WHEN i = 1 AND n > 2 THEN '' ELSE list_aggregate(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP('x')}), lambda x: x <> ''), 'string_agg', chr(10)) || chr(10) || 'tail &' END AS body FROM t),
 s AS (SELECT conv_id, count(*) FILTER (body <> '') AS len, string_agg(CASE WHEN n > 1 THEN '@h' || conv_id || ' (' || (i + 1) || '/' || n || ')' ELSE '' END, ';' ORDER BY i) FILTER (body <> '') AS headings, string_agg(body, chr(10) || chr(10) ORDER BY i) FILTER (body <> '') AS body FROM p GROUP BY conv_id)
SELECT conv_id AS doc_id, '@h' || conv_id AS author, 'h' || conv_id AS author_name, CASE WHEN conv_id % 2 = 0 THEN '2024-05-06' ELSE 'long ago' END AS publish_date, {_duck_title('body')} AS title, headings, md5(body) AS body_md5, {_duck_words('body')} AS word_count, len > 1 AS is_thread, CAST(len AS INTEGER) AS thread_length FROM s
""")
def mirror_threads(spark, sf_dir):
    """Conversations as a mirror's pages: threads with a blank post, replies beside them, tags and line breaks."""
    ship(spark)
    i, k = F.col("i"), F.col("doc_id").cast("string")
    turns = _table(spark, sf_dir, "conversations").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))
    turns = turns.withColumn("role", F.col("n").cast("string"))
    text = F.when((i == 1) & (F.col("role").cast("int") > 2), " <b> </b>").otherwise(F.concat(F.replace("text", F.lit("\n"), F.lit("<br>\n")), F.lit("<i>tail &amp;</i>")))
    item = F.concat(F.lit('<div class="timeline-item"><div class="tweet-body"><div class="tweet-content media-body" dir="auto">'), text, F.lit("</div></div></div>"))
    rows = _joined(turns, item, "")
    date = F.when(F.col("doc_id") % 2 == 0, "May 6, 2024 · 7:08 AM UTC").otherwise(" long ago ")
    head = F.concat(F.lit('<div class="main-tweet"><div class="tweet-header"><a class="username" href="/h'), k, F.lit('">@h'), k, F.lit('</a><span class="tweet-date"><a title="'), date, F.lit('">x</a></span></div></div>'))
    html = F.concat(F.lit("<html><body>"), head, F.lit('<div class="main-thread">'), "text", F.lit('</div><div class="replies"><div class="timeline-item"><div class="tweet-content">a reply</div></div></div></body></html>'))
    found = threads.threads(rows.select("doc_id", F.lit("https://x.com/a/status/1").alias("url"), html.alias("html")))
    return found.select("doc_id", "author", "author_name", "publish_date", "title", F.array_join(F.transform("sections", lambda s: s["heading"]), ";").alias("headings"), F.md5(S.body_text("sections", False).cast("binary")).alias("body_md5"), "word_count", "is_thread", "thread_length")


@query(f"""
WITH {_TURNS}, b AS (SELECT conv_id, i, (conv_id + turn) % 7 AS k, text FROM t), v AS (SELECT * FROM b WHERE k <> 6),
 g AS (SELECT *, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) OVER w AS sec, sum(CASE WHEN k IN (1, 2, 3, 5) THEN 0 ELSE 1 END) OVER w AS isle FROM v WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
 c AS (SELECT *, sum(CASE WHEN k IN (1, 2, 5) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, isle ORDER BY i) AS num FROM g),
 l AS (SELECT conv_id, i, sec, k, text, CASE WHEN k = 0 THEN NULL WHEN k IN (1, 2, 5) THEN num || '. ' || {_STRIP('text')} WHEN k = 3 THEN '<!--IMG:' || left(sha256(conv_id || '|' || i), 32) || '-->' ELSE '• ' || {_STRIP('text')} END AS line FROM c)
SELECT conv_id AS doc_id, CAST(sec AS BIGINT) AS seq, coalesce(max(CASE WHEN k = 0 THEN {_STRIP('text')} END), '') AS heading, CAST(coalesce(max(CASE WHEN k = 0 THEN 2 END), 2) AS INTEGER) AS level, coalesce(string_agg(line, chr(10) || chr(10) ORDER BY i), '') AS body FROM l GROUP BY conv_id, sec
""")
def draft_blocks(spark, sf_dir):
    """Turns as recorded nodes of an article's page: headings, numbered and plain items, pictures, blanks; images small on
    both sides, data URIs and vector graphics are dropped."""
    i, k = F.col("i"), (F.col("doc_id") + F.col("turn")) % 7
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("all"))
    rows = turns.select(F.col("conv_id").alias("doc_id"), F.posexplode("all").alias("i", "x")).select("doc_id", "i", "x.*")
    cls = F.when(k == 0, "longform-header-two").when(k.isin(1, 2, 5), "longform-ordered-list-item").when(k == 4, "longform-unordered-list-item").otherwise("")
    node = rows.select("doc_id", i.alias("pos"), F.when(k == 3, "img").otherwise("block").alias("type"), cls.alias("cls"), F.when(k == 6, " ").otherwise(F.col("text")).alias("text"), F.when(k == 3, "http://a/b.png").otherwise("").alias("src"), F.lit(30).alias("width"), F.lit(60).alias("height"))
    bad = rows.where(k == 3).select("doc_id", (i + 1000).alias("pos"), F.lit("img").alias("type"), F.lit("").alias("cls"), F.lit("").alias("text"), F.element_at(F.array(F.lit("data:x"), F.lit("a.svg"), F.lit("http://small.png")), (i % 3 + 1).cast("int")).alias("src"), F.lit(30).alias("width"), F.lit(30).alias("height"))
    found = structured.block_sections(structured.dom_items(node.unionByName(bad)))
    return found.select("doc_id", F.col("seq").cast("bigint").alias("seq"), "heading", F.col("level").cast("int").alias("level"), "body")
