"""Scans of files by suffix: text natively, others through their readers, one branch of the plan each."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext import patterns as P
from loomtext.functions.text import col, universal_newlines
from loomtext.operators import sections as S
from loomtext.sources import office

TEXT = (".md", ".txt")


def listing(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows (path, modified, length) without contents: the scan reads none of them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_replace("path", "^file:(?://)?", "").alias("path"), F.col("modificationTime").alias("modified"), "length")


def scan(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows (doc_id, path, content, modified); doc_id is the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("doc_id"), "path", "content", F.col("modificationTime").alias("modified"))


def suffix(path="path") -> Column:
    return F.lower(F.regexp_extract(col(path), r"(\.[^./\\]+)\z", 1))


def stem(path="path") -> Column:
    return F.regexp_extract(col(path), r"([^/\\]*?)(?:\.[^./\\]*)?\z", 1)


def file_uri(path="path") -> Column:
    """The path as a file URI, percent-encoded but for slashes and unreserved characters; one that is a URI stays."""
    coded = F.url_encode(col(path))
    for code, char in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(code), F.lit(char))
    return F.when(col(path).rlike("^[A-Za-z][A-Za-z0-9+.-]+:/"), col(path)).otherwise(F.concat(F.lit("file://"), coded))


def file_date(modified="modified") -> Column:
    return F.date_format(col(modified), "yyyy-MM-dd")


def decoded(content="content") -> Column:
    """Bytes as UTF-8 with line ends made one; bytes that are none become replacement characters."""
    return universal_newlines(F.make_valid_utf8(col(content).cast("string")))


def _plain(head: str) -> dict:
    """Lines `key: value`, the last of equal keys, for where no YAML reader is installed."""
    found = (re.match(r"([A-Za-z_][\w-]*):[ \t]*(.*?)[ \t]*\Z", line) for line in head.split("\n"))
    return {m[1]: re.sub(r"\A([\"'])(.*?)\1(?:\s+#.*)?\Z", r"\2", m[2]) if m[2][:1] in "\"'" else re.sub(r"\s+#.*\Z", "", m[2]) for m in found if m and m[2]}


def read_meta(head: str | None) -> dict[str, str]:
    """A front matter's keys with their values as text; nothing where it is no mapping. Null values are empty."""
    try:
        import yaml

        found = yaml.safe_load(head or "")
    except ImportError:
        found = _plain(head or "")
    except Exception:  # whatever a broken head raises
        found = {}
    return {str(k): "" if v is None else str(v) for k, v in found.items()} if isinstance(found, dict) else {}


def _meta(head: pd.Series) -> pd.Series:
    return head.map(read_meta)


def front_matter(docs: DataFrame) -> DataFrame:
    """Markdown texts with meta (map of what stands between the first two `---`, read as YAML) and the rest as text."""
    whole = universal_newlines("text")
    rows = docs.withColumn("parts_", F.split(whole, "---", 3))
    has = F.startswith(whole, F.lit("---")) & (F.size("parts_") == 3)
    rows = rows.withColumn("head_", F.when(has, F.col("parts_")[1])).withColumn("meta", F.pandas_udf(_meta, "map<string,string>")("head_"))
    return rows.withColumn("text", F.when(has, F.col("parts_")[2]).otherwise(whole)).drop("parts_", "head_")


def markdown_documents(files: DataFrame) -> DataFrame:
    """Markdown files (doc_id, path, content, modified) as documents; without any section, the text is one."""
    rows = front_matter(files.select("doc_id", "path", "modified", decoded().alias("text")))
    get = lambda *names: F.coalesce(*(F.try_element_at("meta", F.lit(n)) for n in names))
    rows = rows.select("*", S.markdown("text", False).alias("found"))
    sections = F.when(F.size("found") > 0, F.col("found")).otherwise(S.whole(F.lit("")))
    return _document(rows.withColumn("sections", sections), get("title"), get("author"), get("date"), get("language", "lang"), get("description"))


def text_documents(files: DataFrame, detect_headings: bool = True) -> DataFrame:
    rows = files.select("doc_id", "path", "modified", decoded().alias("text")).select("*", (S.plain("text") if detect_headings else S.whole("text")).alias("found"))
    return _document(rows.withColumn("sections", F.when(F.size("found") > 0, F.col("found")).otherwise(S.whole("text"))))


def _document(rows: DataFrame, title: Column | None = None, author: Column | None = None, date: Column | None = None, language: Column | None = None, description: Column | None = None) -> DataFrame:
    """What all files become. Title: the file's own, else the first heading, else the stem; date: its own, else the file's."""
    text = lambda x: F.coalesce(F.lit(None).cast("string") if x is None else x, F.lit(""))
    null = F.lit(None).cast("string")
    error = F.col("error_message") if "error_message" in rows.columns else null
    return rows.select(
        "doc_id", F.coalesce(F.nullif(text(title), F.lit("")), S.first_heading("sections", stem())).alias("title"), file_uri().alias("url"), text(author).alias("author"), F.lit("").alias("site_name"),
        F.coalesce(F.nullif(text(date), F.lit("")), file_date()).alias("publish_date"), (null if language is None else F.nullif(language, F.lit(""))).alias("language"), text(description).alias("description"),
        "sections", S.words("sections", True).alias("word_count"), F.when(error.isNotNull(), "LocalFileError").alias("error_type"), error.alias("error_message"),
    )


def local_documents(files: DataFrame, detect_headings: bool = True, tables: bool = True, notes: bool = True, min_content_length: int = 0) -> DataFrame:
    """Files (doc_id, path, content, modified) of all kinds as documents, one branch by suffix. What can't be read stays as a
    row that says why, and so do web pages of fewer than a fifth of min_content_length words."""
    kind = files.withColumn("suffix", suffix())
    other = office.read_files(kind.where(~F.col("suffix").isin(*TEXT)).drop("suffix"), tables, notes)
    if min_content_length:
        little = suffix().isin(".html", ".htm", ".mhtml", ".mht") & (S.words("sections", True) < max(1, min_content_length // 5))
        other = other.withColumn("error", F.coalesce("error", F.when(little, "LocalFileError: too little content")))
    numbered = F.transform("sections", lambda s, i: F.struct(i.cast("bigint").alias("seq"), s["heading"].alias("heading"), s["level"].alias("level"), s["body"].alias("body")))
    other = other.withColumn("sections", numbered).withColumn("error_message", F.col("error"))
    other = _document(other, F.col("own_title"), F.col("author"), F.col("publish_date"), F.col("language"), F.col("description"))
    branch = lambda s: kind.where(F.col("suffix") == s)
    return markdown_documents(branch(".md")).unionByName(text_documents(branch(".txt"), detect_headings)).unionByName(other)


def local_sections(files: DataFrame, detect_headings: bool = True) -> DataFrame:
    """Rows (doc_id, seq, heading, level, body) of files of all kinds; those that can't be read give none."""
    if "modified" not in files.columns:
        files = files.withColumn("modified", F.lit(None).cast("timestamp"))
    return S.exploded(local_documents(files, detect_headings).where("error_type IS NULL"), F.col("sections"))


def image_files(files: DataFrame) -> DataFrame:
    """Pictures among scanned files, as images of the folder that they are in: (folder, name, format, image_bytes)."""
    rows = files.withColumn("format", F.substring(suffix(), 2, 10)).where(F.col("format").isin(*P.IMAGE_FORMATS))
    return rows.select(F.regexp_extract("path", r"^(.*)/[^/]*\z", 1).alias("folder"), F.regexp_extract("path", r"([^/]*)\z", 1).alias("name"), "format", F.col("content").alias("image_bytes"))
