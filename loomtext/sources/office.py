"""Binary and archive files to sections, one file at a time, with the standard library.

Each reader gives rows (heading, level, body) and metadata; `read_files` runs them over a table (doc_id, path, content)
in Arrow-sized batches. A file that can't be read gives one row with an error, and no other file is lost.
"""

from __future__ import annotations

import csv
import email
import email.policy
import io
import json
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.sources.web import read_page

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
S = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def table_text(rows: list[list[str]]) -> str:
    """Cells joined by bars, with a rule after the first row."""
    lines = [" | ".join(r) for r in rows]
    return "\n".join([*lines[:1], " | ".join("---" for _ in rows[0]), *lines[1:]]) if rows else ""


def _core(z: zipfile.ZipFile) -> dict:
    if "docProps/core.xml" not in z.namelist():
        return {}
    tags = {e.tag.rpartition("}")[2]: (e.text or "").strip() for e in ElementTree.fromstring(z.read("docProps/core.xml")).iter()}
    return {"title": tags.get("title", ""), "author": tags.get("creator", ""), "publish_date": (tags.get("created") or tags.get("modified") or "")[:10]}


def read_docx(data: bytes, with_tables: bool = True) -> dict:
    """Paragraph styles named heading open sections; tables follow all text, each as a section of its own."""
    z = zipfile.ZipFile(io.BytesIO(data))
    body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    out, heading, level, held, tables = [], "", 2, [], []

    def flush():
        if heading or held:
            out.append((heading, level, "\n\n".join(held)))

    for e in body if body is not None else ():
        if e.tag == f"{W}tbl":
            tables.append(table_text([["".join(t.text or "" for t in c.iter(f"{W}t")).strip() for c in r.iter(f"{W}tc")] for r in e.iter(f"{W}tr")]))
        if e.tag != f"{W}p":
            continue
        text = "".join(t.text or "" for t in e.iter(f"{W}t")).strip()
        style = e.find(f"{W}pPr/{W}pStyle")
        name = (style.get(f"{W}val") or "").lower() if style is not None else ""
        if name.startswith("heading"):
            flush()
            number = re.search("[0-9]+", name)
            heading, level, held = text, int(number.group()) if number else 2, []
        elif text:
            held.append(text)
    flush()
    return _core(z) | {"sections": out + [("", 2, t) for t in tables if t and with_tables]}


def read_pptx(data: bytes, tables: bool = True, notes: bool = True) -> dict:
    """A section per slide, with bullets by level, tables and quoted notes; empty slides without title are skipped."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide[0-9]+\.xml", n)), key=lambda n: int(re.search("[0-9]+", n).group()))
    out = []
    for number, name in enumerate(names, 1):
        title, lines = "", []
        root = ElementTree.fromstring(z.read(name))
        for shape in root.iter():
            if shape.tag == f"{S}sp":
                kind = shape.find(f".//{S}ph")
                paragraphs = [("".join(t.text or "" for t in p.iter(f"{A}t")).strip(), int((p.find(f"{A}pPr").get("lvl") or 0) if p.find(f"{A}pPr") is not None else 0)) for p in shape.iter(f"{A}p")]
                if kind is not None and kind.get("type") in ("title", "ctrTitle"):
                    title = " ".join(t for t, _ in paragraphs if t)
                else:
                    lines += ["  " * lvl + "- " + t for t, lvl in paragraphs if t]
            elif shape.tag == f"{A}tbl" and tables:
                lines.append(table_text([["".join(t.text or "" for t in c.iter(f"{A}t")).strip() for c in r.iter(f"{A}tc")] for r in shape.iter(f"{A}tr")]))
        at = f"ppt/notesSlides/notesSlide{number}.xml"
        if notes and at in z.namelist():
            text = "\n".join(filter(None, ("".join(t.text or "" for t in p.iter(f"{A}t")).strip() for p in ElementTree.fromstring(z.read(at)).iter(f"{A}p"))))
            if text:
                lines.append("> **Speaker Notes:** " + text.replace("\n", "\n> "))
        if title or lines:
            out.append((title or f"Slide {number}", 2, "\n".join(lines)))
    return _core(z) | {"sections": out}


def read_mhtml(data: bytes) -> dict:
    """The first text/html part that isn't blank; the subject is the title if there is one."""
    message = email.message_from_bytes(data, policy=email.policy.default)
    for part in message.walk():
        if part.get_content_type() == "text/html":
            raw = part.get_payload(decode=True) or b""
            try:
                html = raw.decode(part.get_content_charset() or "utf-8", "replace")
            except LookupError:
                html = raw.decode("utf-8", "replace")
            if html.strip():
                page = read_html(html.encode())
                return page | {"title": str(message["subject"] or "").strip() or page["title"]}
    raise ValueError("no HTML part")


def read_html(data: bytes) -> dict:
    page = read_page(data.decode("utf-8", "replace"))
    return {k: page[k] for k in ("title", "author", "description", "language")} | {"publish_date": page["raw_date"][:10], "sections": [(s["heading"], s["level"], s["body"]) for s in page["sections"]]}


def read_xlsx(data: bytes) -> dict:
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = [("".join(t.text or "" for t in e.iter(f"{X}t"))) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    rels = {}
    if "xl/_rels/workbook.xml.rels" in z.namelist():
        rels = {e.get("Id"): "xl/" + e.get("Target", "").removeprefix("/xl/") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for i, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{X}sheet"), 1):
        name, path = sheet.get("name"), rels.get(sheet.get(f"{REL}id"), f"xl/worksheets/sheet{i}.xml")
        if path not in z.namelist():
            continue
        rows = []
        for r in ElementTree.fromstring(z.read(path)).iter(f"{X}row"):
            values = []
            for c in r.iter(f"{X}c"):
                v, inline = c.find(f"{X}v"), "".join(t.text or "" for t in c.iter(f"{X}t"))
                values.append(shared[int(v.text)] if c.get("t") == "s" and v is not None else v.text if v is not None else inline)
            rows.append(values)
        if rows:
            out.append((name or f"Sheet {i}", 2, table_text(rows)))
    return {"sections": out}


def read_epub(data: bytes) -> dict:
    """Chapters in the order of the package's spine."""
    z = zipfile.ZipFile(io.BytesIO(data))
    at = next(e.get("full-path") for e in ElementTree.fromstring(z.read("META-INF/container.xml")).iter() if e.tag.endswith("rootfile"))
    package = ElementTree.fromstring(z.read(at))
    tag = lambda name: [e for e in package.iter() if e.tag.rpartition("}")[2] == name]
    files = {e.get("id"): e.get("href") for e in tag("item")}
    base = at.rpartition("/")[0]
    sections = []
    for ref in tag("itemref"):
        path = "/".join(filter(None, (base, files.get(ref.get("idref"), ""))))
        if path in z.namelist():
            sections += read_html(z.read(path))["sections"]
    text = lambda name: next(((e.text or "").strip() for e in tag(name)), "")
    return {"title": text("title"), "author": text("creator"), "language": text("language"), "publish_date": text("date")[:10], "sections": sections}


def read_zip(data: bytes) -> dict:
    """Each member that can be read, under its name."""
    sections = []
    z = zipfile.ZipFile(io.BytesIO(data))
    for name in z.namelist():
        reader = READERS.get("." + name.rpartition(".")[2].lower())
        if reader and reader is not read_zip:
            for heading, level, body in reader(z.read(name))["sections"]:
                sections.append((f"{name}: {heading}" if heading else name, level, body))
    return {"sections": sections}


def read_csv(data: bytes) -> dict:
    return {"sections": [("", 2, table_text(list(csv.reader(io.StringIO(data.decode("utf-8-sig", "replace"))))))]}


def read_json(data: bytes) -> dict:
    return {"sections": [("", 2, "```json\n" + json.dumps(json.loads(data), ensure_ascii=False, indent=2) + "\n```")]}


def read_xml(data: bytes) -> dict:
    lines = [f"{e.tag.rpartition('}')[2]}: {e.text.strip()}" for e in ElementTree.fromstring(data).iter() if e.text and e.text.strip()]
    return {"sections": [("", 2, "\n".join(lines))]}


def rejected(data: bytes) -> dict:
    raise ValueError("this old binary format isn't supported; save it in the newer one")


READERS = {
    ".docx": read_docx, ".pptx": read_pptx, ".mhtml": read_mhtml, ".mht": read_mhtml, ".html": read_html, ".htm": read_html, ".xlsx": read_xlsx, ".epub": read_epub, ".zip": read_zip,
    ".csv": read_csv, ".json": read_json, ".xml": read_xml, ".ppt": rejected, ".doc": rejected, ".xls": rejected, ".msg": rejected,
}

SCHEMA = "struct<title:string,author:string,publish_date:string,description:string,language:string,sections:array<struct<heading:string,level:int,body:string>>,error:string>"


def read_file(path: str, data: bytes, tables: bool = True, notes: bool = True) -> dict:
    """A file by its suffix, with or without the tables of documents and slides and the notes of slides."""
    suffix = "." + path.rpartition(".")[2].lower()
    empty = {"title": "", "author": "", "publish_date": "", "description": "", "language": "", "sections": [], "error": None}
    if suffix not in READERS:
        return empty | {"error": f"LocalFileError: {suffix} isn't supported"}
    try:
        more = {".docx": (tables,), ".pptx": (tables, notes)}.get(suffix, ())
        found = READERS[suffix](bytes(data or b""), *more)
    except Exception as e:  # any broken file: its row says so
        return empty | {"error": f"LocalFileError: {e}"}
    sections = [{"heading": h, "level": level, "body": b} for h, level, b in found["sections"]]
    return empty | found | {"sections": sections} | ({} if sections else {"error": "LocalFileError: no content"})


def _read(tables: bool, notes: bool, path: pd.Series, content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_file(p or "", c, tables, notes) for p, c in zip(path, content, strict=True)], columns=["title", "author", "publish_date", "description", "language", "sections", "error"])


def read_files(files: DataFrame, tables: bool = True, notes: bool = True) -> DataFrame:
    """Files (doc_id, path, content, columns beside) as documents: title falls back to the first heading, then to the file's
    stem; own_title is what the file itself says."""
    keep = [c for c in files.columns if c in ("doc_id", "path", "modified")]

    def read(path: pd.Series, content: pd.Series) -> pd.DataFrame:
        return _read(tables, notes, path, content)

    rows = files.withColumn("f", F.pandas_udf(read, SCHEMA)("path", "content")).select(*keep, "f.*")
    first = F.get(F.filter(F.transform("sections", lambda s: s["heading"]), lambda h: h != ""), 0)
    stem = F.regexp_extract("path", r"([^/\\]*?)(?:\.[^./\\]*)?\z", 1)
    own = F.col("title")
    return rows.withColumn("own_title", own).withColumn("title", F.coalesce(F.nullif("title", F.lit("")), first, stem)).withColumn("error_type", F.when(F.col("error").isNotNull(), "LocalFileError"))
