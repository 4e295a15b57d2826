"""Images of documents: rows (doc_id, seq, image_bytes, format, source_label, position_marker, width, height, alt_text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext import patterns as P
from loomtext.functions.text import col
from loomtext.operators import sections as S

UNAVAILABLE = "\n\n*[Image description unavailable]*\n\n"


def marker(doc: str = "doc_id", seq: str = "seq") -> Column:
    """A marker that is the same each time it is computed."""
    return F.concat(F.lit("<!--IMG:"), F.left(F.sha2(F.concat_ws("|", F.col(doc).cast("string"), F.col(seq).cast("string")), 256), F.lit(32)), F.lit("-->"))


def media_type(form) -> Column:
    table = F.create_map(*[F.lit(x) for pair in P.IMAGE_FORMATS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(col(form))), F.lit("image/png"))


def is_big(least_side: int = 50, least_bytes: int = 5000, size: Column | None = None) -> Column:
    """Whether an image isn't known to be small; a side of 0 is unknown. `size`: its bytes, if they are not at hand."""
    bytes_of = F.length("image_bytes") if size is None else size
    return ~(F.col("width").between(1, least_side - 1) | F.col("height").between(1, least_side - 1)) & (bytes_of >= least_bytes)


def worth_describing(images: DataFrame, cap: int = 20, least_side: int = 50, least_bytes: int = 5000) -> DataFrame:
    """Images that aren't known to be small, the first `cap` of each document."""
    big = is_big(least_side, least_bytes)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq"))
    return images.where(big).withColumn("place", place).where(F.col("place") <= cap).drop("place")


def replace_markers(sections: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Bodies with markers replaced by descriptions (position_marker, description), or by a note where there is none."""
    kept = F.regexp_extract_all("body", F.lit(f"({P.MARKER})"), F.lit(1))
    rows = sections.select("doc_id", "seq", F.posexplode_outer(kept).alias("at", "position_marker")).join(descriptions, "position_marker", "left")
    text = F.coalesce(F.concat(F.lit("\n\n*Image:*\n\n"), "description", F.lit("\n\n")), F.lit(UNAVAILABLE))
    found = rows.where("at IS NOT NULL").withColumn("text", text).groupBy("doc_id", "seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]).alias("texts"))
    pieces = F.split("body", P.MARKER, -1)
    whole = F.array_join(F.transform(pieces, lambda p, i: F.concat(F.when(i > 0, F.get("texts", i - 1)).otherwise(""), p)), "")
    return sections.join(found, ["doc_id", "seq"], "left").withColumn("body", F.when(F.col("texts").isNull(), F.col("body")).otherwise(whole)).drop("texts")


def with_descriptions(docs: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Documents (doc_id, sections, ...) with the markers in their sections replaced by descriptions (doc_id,
    position_marker, description), or by a note where there is none. Only descriptions are grouped."""
    told = descriptions.where("description IS NOT NULL").groupBy("doc_id").agg(F.map_from_entries(F.collect_set(F.struct("position_marker", "description"))).alias("told_"))
    said = lambda m: F.coalesce(F.concat(F.lit("\n\n*Image:*\n\n"), F.try_element_at("told_", m), F.lit("\n\n")), F.lit(UNAVAILABLE))

    def body(text: Column) -> Column:
        marks = F.regexp_extract_all(text, F.lit(f"({P.MARKER})"), F.lit(1))
        return S.let(marks, lambda ms: F.array_join(F.transform(F.split(text, P.MARKER, -1), lambda part, i: F.concat(F.when(i > 0, said(F.get(ms, i - 1))).otherwise(""), part)), ""))

    made = lambda s: F.struct(s["seq"].alias("seq"), s["heading"].alias("heading"), s["level"].alias("level"), F.when(F.contains(s["body"], F.lit("<!--IMG:")), body(s["body"])).otherwise(s["body"]).alias("body"))
    return docs.join(told, "doc_id", "left").withColumn("sections", F.transform("sections", made)).drop("told_")


def markdown_images(docs: DataFrame, files: DataFrame, least_bytes: int = 100) -> tuple[DataFrame, DataFrame]:
    """(texts, images): Markdown texts (doc_id, text) with references to pictures that a listing (doc_id, ref, image_bytes)
    has replaced by markers, all other references dropped, and the pictures, numbered as figures."""
    ref = r"!\[([^\n]*?)\]\(([^\n]*?)\)"
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(ref), F.lit(1)).alias("alt"), F.regexp_extract_all("text", F.lit(ref), F.lit(2)).alias("ref"))
    refs = docs.select("doc_id", F.posexplode(both).alias("seq", "r")).select("doc_id", "seq", F.col("r.alt").alias("alt_text"), F.col("r.ref").alias("ref"))
    name = F.regexp_extract("ref", r"([^/]*)\z", 1)
    listed = files.where(F.length("image_bytes") >= least_bytes)
    found = refs.where(~F.startswith("ref", F.lit("data:"))).join(listed.withColumnRenamed("ref", "file"), "doc_id").where((F.col("ref") == F.col("file")) | (name == F.regexp_extract("file", r"([^/]*)\z", 1)))
    # The file of that very path before one of that name elsewhere.
    best = Window.partitionBy("doc_id", "seq").orderBy((F.col("ref") != F.col("file")).cast("int"), "file")
    found = found.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place").withColumn("position_marker", marker())
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq"))
    suffix = F.lower(F.regexp_extract("file", r"\.([A-Za-z]+)\z", 1))
    images = found.select("doc_id", "seq", "image_bytes", F.when(suffix.isin("png", "jpeg", "jpg"), suffix).otherwise("png").alias("format"), F.concat(F.lit("PDF figure "), number.cast("string")).alias("source_label"), "position_marker", "alt_text")
    marks = found.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("seq", "position_marker"))).alias("marks"))
    rows = docs.join(marks, "doc_id", "left")
    mark = lambda i: F.when(i > 0, F.coalesce(F.try_element_at("marks", i - 1), F.lit(""))).otherwise("")
    text = F.array_join(F.transform(F.split("text", ref, -1), lambda part, i: F.concat(mark(i), part)), "")
    return rows.withColumn("text", text).drop("marks"), images
