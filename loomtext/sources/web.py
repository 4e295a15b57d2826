"""HTML pages to articles: metadata, sections and images, without any HTML library but the standard one."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import partial
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.dates import normalise_date
from loomtext.functions.text import strip
from loomtext.operators import sections as S
from loomtext.runtime import stored, trim

# Elements that hold no article text, that end a paragraph, and that never have content.
SKIPPED = {"script", "style", "nav", "footer", "header", "aside", "form", "noscript", "svg", "button", "template"}
BLOCKS = {"p", "div", "section", "article", "li", "td", "th", "blockquote", "pre", "main", "ul", "ol", "table", "tr", "figure", "dd", "dt"}
VOID = {"br", "img", "hr", "meta", "link", "input", "source", "wbr", "area", "base", "col", "embed", "track"}
ADS = re.compile(r"\b(?:ad|ads|advert|sidebar|promo|cookie|banner|share|related)\b", re.I)


class _Page(HTMLParser):
    """Walks a page once: items are (kind, level, text) in document order, for the whole body and within containers."""

    def __init__(self, tables: bool = True):
        super().__init__(convert_charrefs=True)
        self.skipped = SKIPPED if tables else SKIPPED | {"table"}
        self.meta: dict[str, str] = {}
        self.lang = self.title = ""
        self.items: list[tuple[str, int, str]] = []
        self.images: list[dict] = []
        self.skip: list[str] = []
        self.open: list[tuple[str, str]] = []
        self.container = 0
        self.spans: list[tuple[int, int, int]] = []  # rank, first item, end
        self.starts: list[tuple[int, int, int]] = []  # depth, rank, first item
        self.text: list[str] = []
        self.links: list[int] = []  # of each item, characters of its text that are links
        self.linked = self.anchor = 0
        self.heading = 0
        self.in_title = False
        self.last_text = ""

    def flush(self):
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append(("head" if self.heading else "p", self.heading, text))
            self.links.append(min(self.linked, len(text)))
        self.linked = 0

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.lang = a.get("lang", "")
        if tag == "meta":
            self.meta.setdefault((a.get("name") or a.get("property") or "").lower(), a.get("content", ""))
        if self.skip:
            if tag not in VOID:
                self.skip.append(tag)
            return
        if tag == "title":
            self.in_title = True
        if tag in self.skipped or ADS.search(a.get("class", "") + " " + a.get("id", "")):
            self.flush()
            if tag not in VOID:
                self.skip.append(tag)
            return
        if tag == "img":
            self.flush()
            self.images.append({"at": len(self.items), "src": a.get("data-src") or a.get("src", ""), "width": a.get("width", ""), "height": a.get("height", ""), "alt_text": a.get("alt", ""), "anchor_text": self.last_text[-80:]})
        if tag == "a":
            self.anchor += 1
        if tag == "br":
            self.text.append("\n")
        if tag in BLOCKS or re.fullmatch("h[1-6]", tag):
            self.flush()
            self.heading = int(tag[1]) if tag[0] == "h" and len(tag) == 2 else 0
        if tag not in VOID:
            self.open.append((tag, a.get("role", "")))
            rank = 0 if tag == "article" else 1 if tag == "main" or a.get("role") == "main" else None
            if rank is not None:
                self.starts.append((len(self.open), rank, len(self.items)))

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.skip:
                del self.skip[len(self.skip) - 1 - self.skip[::-1].index(tag) :]
            return
        if tag == "title":
            self.in_title = False
        if tag == "a":
            self.anchor = max(0, self.anchor - 1)
        if tag in BLOCKS or re.fullmatch("h[1-6]", tag):
            self.flush()
            self.heading = 0
        names = [t for t, _ in self.open]
        if tag in names:
            del self.open[len(names) - 1 - names[::-1].index(tag) :]
            while self.starts and self.starts[-1][0] > len(self.open):
                _, rank, first = self.starts.pop()
                self.spans.append((rank, first, len(self.items)))

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip:
            self.text.append(data)
            if self.anchor:
                self.linked += len(" ".join(data.split()))
            if data.strip():
                self.last_text = data.strip()

    def finish(self):
        self.flush()
        self.spans += [(rank, first, len(self.items)) for _, rank, first in self.starts]
        best = min(self.spans, key=lambda s: (s[0], s[1] - s[2]), default=(9, 0, len(self.items)))
        if best[2] <= best[1]:
            return self.items
        self.images = [i for i in self.images if best[1] <= i["at"] <= best[2]]
        return self.items[best[1] : best[2]]


def read_page(html: str, tables: bool = True) -> dict:
    """Metadata, sections and images of a page, with or without the text of tables. Sections without paragraphs are dropped; where that leaves none, all text
    of the page is one. Images are those of the element that the text is taken from."""
    page = _Page(tables)
    page.feed(html or "")
    page.close()
    items = page.finish()
    first = lambda *names: next((page.meta[n] for n in names if page.meta.get(n)), "")
    sections, heading, level, body = [], "", 2, []
    for kind, depth, text in [*items, ("head", 2, "")]:
        if kind == "p":
            body.append(text)
            continue
        if body:
            sections.append({"seq": len(sections), "heading": heading, "level": level, "body": "\n\n".join(body)})
        heading, level, body = text, depth, []
    if not sections and (plain := "\n".join(text for _, _, text in page.items)):
        sections.append({"seq": 0, "heading": "", "level": 2, "body": plain})
    return {
        "title": first("og:title") or " ".join(page.title.split()), "author": first("author", "article:author"), "site_name": first("og:site_name"), "raw_date": first("article:published_time", "date", "dc.date"),
        "description": first("description", "og:description"), "language": page.lang, "sections": sections, "images": page.images,
        # Of pages without an element for their article, all that could be it.
        "blocks": None if any(end > start for _, start, end in page.spans) else [{"kind": k, "level": n, "text": t, "links": links} for (k, n, t), links in zip(page.items, page.links)],
    }


PAGE = "title string, author string, site_name string, raw_date string, description string, language string, sections array<struct<seq:bigint,heading:string,level:int,body:string>>, images array<struct<src:string,width:string,height:string,alt_text:string,anchor_text:string>>, blocks array<struct<kind:string,level:int,text:string,links:int>>"
#: Bytes of texts that a worker reads at a time: what they become takes some times as much until it is given back.
READ_BYTES = 256 << 10


def _list(**fields: pa.DataType) -> pa.DataType:
    return pa.list_(pa.struct(list(fields.items())))


_ARROW_SECTIONS = _list(seq=pa.int64(), heading=pa.string(), level=pa.int32(), body=pa.string())
_ARROW_PAGE = {
    **dict.fromkeys(("title", "author", "site_name", "raw_date", "description", "language"), pa.string()), "sections": _ARROW_SECTIONS,
    "images": _list(**dict.fromkeys(("src", "width", "height", "alt_text", "anchor_text"), pa.string())), "blocks": _list(kind=pa.string(), level=pa.int32(), text=pa.string(), links=pa.int32()),
}


def _each(read: Callable[[str], dict], kinds: dict[str, pa.DataType], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose last column is a text, with what `read` makes of it in its place, READ_BYTES at a time."""
    for batch in batches:
        keys, texts = batch.columns[:-1], batch.column(batch.num_columns - 1)
        first, size, found = 0, 0, []
        for i in range(len(texts)):
            text = texts[i].as_py()
            found.append(read(text))
            size += len(text or "")
            if size >= READ_BYTES or i + 1 == len(texts):
                made = [pa.array([x[name] for x in found], kind) for name, kind in kinds.items()]
                yield pa.RecordBatch.from_arrays([*(k.slice(first, len(found)) for k in keys), *made], names=[*batch.schema.names[:-1], *kinds])
                first, size, found = i + 1, 0, []
    trim()


def articles(pages: DataFrame, min_content_length: int = 100, density: bool = False, tables: bool = True) -> DataFrame:
    """Pages (doc_id, url, html) as documents with sections; too short ones carry an error and stay. With density, the text
    of pages that have no element for it is told by dense_sections(); otherwise it is all text."""
    if not density:
        return _articles(_parsed(pages, tables).drop("blocks"), min_content_length)
    # Of most pages the markup tells that they have such an element: they are parsed once, and their texts stay where they are.
    marked = F.coalesce(F.col("html").rlike(_CONTAINER), F.lit(False))
    other = _parsed(pages.where(~marked), tables)
    rows = dense_sections(_parsed(pages.where(marked), tables)).unionByName(dense_sections(other, frames(other)))
    return _articles(rows.drop("blocks"), min_content_length)


def _parsed(pages: DataFrame, tables: bool) -> DataFrame:
    rows = pages.select("doc_id", "url", "html")
    return rows.mapInArrow(partial(_each, partial(read_page, tables=tables), _ARROW_PAGE), f"{_typed(rows, 'doc_id', 'url')}, {PAGE}")


def _typed(rows: DataFrame, *names: str) -> str:
    return ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)


# Article text by density ------------------------------------------------------------------------------------------------

#: What a character of a link and a paragraph itself cost; pages of a host that have the same block, at least, and as a share of
#: those pages, for it to be taken for a part of the host's frame.
LINK_COST, BLOCK_COST, REPEATS, REPEAT_SHARE = 3, 20, 3, 0.05
_CONTAINER = r"(?i)<(?:article|main)\b|\brole\s*=\s*[\"']?main\b"
_SECTIONS = "array<struct<seq:bigint,heading:string,level:int,body:string>>"


def best_run(blocks) -> Column:
    """The run of blocks of the greatest sum of scores, a block's being its characters less what its links and, but
    for headings, itself cost: of equal ones that which ends first, and of those the shortest. Empty where no block scores more than 0. One fold."""
    scored = F.transform(blocks, lambda b, i: F.struct(i.alias("i"), (F.length(b["text"]) - LINK_COST * b["links"] - F.when(b["kind"] == "p", BLOCK_COST).otherwise(0)).alias("score")))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("since"), F.lit(0).alias("best"), F.lit(0).alias("first"), F.lit(-1).alias("last"))

    def step(s: Column, b: Column) -> Column:
        fresh = s["sum"] <= 0
        now, since = F.when(fresh, b["score"]).otherwise(s["sum"] + b["score"]), F.when(fresh, b["i"]).otherwise(s["since"])
        better = now > s["best"]
        keep = lambda new, old: F.when(better, new).otherwise(s[old]).alias(old)
        return F.struct(now.alias("sum"), since.alias("since"), keep(now, "best"), keep(since, "first"), keep(b["i"], "last"))

    return S.let(F.aggregate(scored, start, step), lambda s: F.slice(blocks, s["first"] + 1, s["last"] - s["first"] + 1))


def sections_of_blocks(blocks) -> Column:
    """Blocks as sections: a heading opens one, and those without paragraphs are dropped; without any, all text is one."""
    close = lambda s: F.when(F.size(s["body"]) > 0, F.array(F.struct(F.size(s["done"]).cast("bigint").alias("seq"), s["heading"].alias("heading"), s["level"].alias("level"), F.array_join(s["body"], "\n\n").alias("body"))).cast(_SECTIONS)).otherwise(F.array().cast(_SECTIONS))
    start = F.struct(F.array().cast(_SECTIONS).alias("done"), F.lit("").alias("heading"), F.lit(2).alias("level"), F.array().cast("array<string>").alias("body"))

    def step(s: Column, b: Column) -> Column:
        head = b["kind"] == "head"
        return F.struct(
            F.when(head, F.concat(s["done"], close(s))).otherwise(s["done"]).alias("done"), F.when(head, b["text"]).otherwise(s["heading"]).alias("heading"),
            F.when(head, b["level"]).otherwise(s["level"]).alias("level"), F.when(head, F.array().cast("array<string>")).otherwise(F.concat(s["body"], F.array(b["text"]))).alias("body"),
        )

    plain = F.array(F.struct(F.lit(0).cast("bigint").alias("seq"), F.lit("").alias("heading"), F.lit(2).alias("level"), F.array_join(F.transform(blocks, lambda b: b["text"]), "\n").alias("body"))).cast(_SECTIONS)
    made = F.aggregate(blocks, start, step, lambda s: F.concat(s["done"], close(s)))
    return S.let(made, lambda m: F.when(F.size(m) > 0, m).when(F.size(blocks) > 0, plain).otherwise(m))


def frames(rows: DataFrame, repeats: int = REPEATS, share: float = REPEAT_SHARE) -> DataFrame:
    """Of pages (doc_id, url, blocks), the places (doc_id, framed: array of numbers from 0) of blocks that belong to their
    host's frame: equal blocks on many of its pages. Texts stay where they are; hashes are stored, and counted by host
    before they move."""
    host = F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")))
    hashes = F.transform("blocks", lambda b: F.xxhash64(b["text"]))
    pages, _ = stored(rows.where("size(blocks) > 0").select("doc_id", host.alias("host"), hashes.alias("hashes")), "blocks")
    of_host = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    seen = pages.select("host", F.explode(F.array_distinct("hashes")).alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= repeats)
    common = seen.join(of_host, "host").where(F.col("n") >= share * F.col("pages")).select("host", "hash")
    places = pages.select("doc_id", "host", F.posexplode("hashes").alias("at", "hash"))
    return places.join(common, ["host", "hash"]).groupBy("doc_id").agg(F.collect_set("at").alias("framed"))


def dense_sections(rows: DataFrame, framed: DataFrame | None = None) -> DataFrame:
    """Pages (doc_id, url, sections, blocks, ...) with the sections of those that have blocks told by density: their host's
    frame goes, and of the rest the best run stays. Where that leaves nothing, the best run of all blocks does, or all."""
    rows = rows.withColumn("framed", F.lit(None).cast("array<int>")) if framed is None else rows.join(framed, "doc_id", "left")
    kept = F.filter("blocks", lambda b, i: ~F.coalesce(F.array_contains("framed", i), F.lit(False)))
    first = lambda *runs: F.coalesce(*(F.when(F.size(r) > 0, r) for r in runs), F.col("blocks"))
    rows = rows.withColumn("blocks", F.when(F.col("blocks").isNotNull(), first(best_run(kept), best_run(F.col("blocks")))))
    return rows.withColumn("sections", F.when(F.col("blocks").isNotNull(), sections_of_blocks(F.col("blocks"))).otherwise(F.col("sections"))).drop("framed")


def _articles(rows: DataFrame, min_content_length: int) -> DataFrame:
    rows = rows.withColumn("word_count", S.words("sections", True)).withColumn("publish_date", normalise_date(F.nullif("raw_date", F.lit(""))))
    rows = rows.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), S.first_heading("sections")))
    short, none = F.col("word_count") < max(1, min_content_length // 5), F.size("sections") == 0
    message = F.when(none, "no content found").when(short, F.concat(F.lit("too little content ("), F.col("word_count").cast("string"), F.lit(" words)")))
    return rows.drop("raw_date").withColumn("error_type", F.when(none | short, "ContentExtractionError")).withColumn("error_message", message)


def read_extracted(xml: str, images: bool = False) -> dict:
    """Sections of an extractor's XML, in document order: `head` opens one (its level is the first number of `rend`, its
    heading the text before any child), `p` adds all its text, `graphic` a marker and an image if asked for."""
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return {"sections": [], "images": []}
    sections, found, heading, level, body = [], [], "", 2, []
    for e in [*root.iter(), None]:
        name = "" if e is None else e.tag.rpartition("}")[2]
        if e is None or name == "head":
            if body:
                sections.append({"seq": len(sections), "heading": heading, "level": level, "body": "\n\n".join(body)})
            if e is not None:
                number = re.search("[0-9]+", e.get("rend", "h2"))
                heading, level, body = (e.text or "").strip(), int(number.group()) if number else 2, []
        elif name == "p":
            if text := "".join(e.itertext()).strip():
                body.append(text)
        elif name == "graphic" and images and e.get("src", "").startswith("http"):
            mark = f"<!--IMG:{hashlib.sha256(f'{xml}|{len(found)}'.encode()).hexdigest()[:32]}-->"
            found.append({"src": e.get("src"), "alt_text": e.get("title") or e.get("alt") or "", "position_marker": mark})
            body.append(mark)
    return {"sections": sections, "images": found}


EXTRACTED = "sections array<struct<seq:bigint,heading:string,level:int,body:string>>, images array<struct<src:string,alt_text:string,position_marker:string>>"
_ARROW_EXTRACTED = {"sections": _ARROW_SECTIONS, "images": _list(src=pa.string(), alt_text=pa.string(), position_marker=pa.string())}


def extracted(rows: DataFrame, images: bool = False) -> DataFrame:
    """An extractor's XML (doc_id, xml) with its sections and images."""
    rows = rows.select("doc_id", "xml")
    return rows.mapInArrow(partial(_each, partial(read_extracted, images=images), _ARROW_EXTRACTED), f"{_typed(rows, 'doc_id')}, {EXTRACTED}")


def sections_of(articles: DataFrame) -> DataFrame:
    return S.exploded(articles, F.col("sections"))


def images_of(articles: DataFrame, least_side: int = 50) -> DataFrame:
    """Images worth fetching: no data URIs or vector graphics, no small sides, and an anchor that a section holds. Their
    alt_text becomes the anchor, by which descriptions are placed."""
    rows = articles.select("doc_id", "sections", F.posexplode("images").alias("seq", "i")).select("doc_id", "sections", "seq", "i.*")
    side = lambda c: F.col(c).try_cast("int")
    small = F.coalesce((side("width") > 0) & (side("width") < least_side), F.lit(False)) | F.coalesce((side("height") > 0) & (side("height") < least_side), F.lit(False))
    held = F.exists("sections", lambda s: F.contains(s["body"], F.col("anchor_text")))
    rows = rows.withColumn("alt_text", F.col("anchor_text")).where("src <> ''")
    return rows.where(~F.startswith("src", F.lit("data:")) & ~F.lower(F.split_part("src", F.lit("?"), F.lit(1))).endswith(".svg") & ~small & held & (F.col("anchor_text") != "")).drop("sections")


def images_with_bytes(images: DataFrame, fetched: DataFrame, least_bytes: int = 5000) -> DataFrame:
    """Images with what was fetched for them (src, image_bytes), small files dropped; the format by the URL."""
    rows = images.join(fetched, "src").where(F.length("image_bytes") >= least_bytes)
    return rows.withColumn("format", F.when(F.lower("src").rlike(r"\.jpe?g"), "jpeg").otherwise("png")).withColumn("source_label", F.lit("Article image"))


# Native forms for pages whose markup is regular: no Python, so that scans, filters and counts stay in generated code.
def article_html(html: str = "html") -> Column:
    return F.regexp_extract(F.col(html), r"(?s)<article>(.*)</article>", 1)


def plain_text(html) -> Column:
    """Without tags, white space collapsed, the commonest entities read."""
    s = F.regexp_replace(F.col(html) if isinstance(html, str) else html, "<[^>]*>", " ")
    for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        s = F.replace(s, F.lit(name), F.lit(char))
    return strip(F.regexp_replace(s, r"(?U)[\s\x1c-\x1f]+", " "))


def page_title(html: str = "html") -> Column:
    return strip(F.regexp_extract(F.col(html), r"(?s)<title>(.*?)</title>", 1))


def page_language(html: str = "html") -> Column:
    return F.regexp_extract(F.col(html), r'<html lang="([^"]*)"', 1)


def page_paragraphs(pages: DataFrame) -> DataFrame:
    """Rows (page_id, seq, text) of the paragraphs of each page's article."""
    found = F.regexp_extract_all(article_html(), F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("seq", "p")).select("page_id", F.col("seq").cast("bigint"), plain_text("p").alias("text"))


def page_links(pages: DataFrame) -> DataFrame:
    """Rows (page_id, seq, href) of all links of each page, in order."""
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("seq", "href")).select("page_id", F.col("seq").cast("bigint"), "href")
