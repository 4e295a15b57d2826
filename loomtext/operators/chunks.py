"""Long texts cut for a language model, and its answers put together again."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext import patterns as P
from loomtext.functions.text import col, is_cjk_dominant, strip
from loomtext.operators import sections as S


def split_at_punctuation(text: str, size: int, overlap: int = 200) -> list[dict]:
    """Pieces of about `size` characters, each cut after the last sentence end, else clause end, else space, near it.

    Cuts do not depend on the overlap: each piece but the first is then widened to the left by so many characters."""
    cuts = [0]
    while (end := cuts[-1] + size) < len(text):
        low = max(cuts[-1], end - P.CHUNK_LOOK_BACK)
        # The last place of any of a tier's marks in (low, end], found by searches from the right.
        found = (max(text.rfind(mark, low + 1, end + 1) for mark in tier) for tier in P.CHUNK_TIERS)
        cuts.append(next((i + 1 for i in found if i >= 0), end))
    cuts.append(len(text))
    return [{"overlap": min(overlap, a), "chunk": text[a - min(overlap, a) : b]} for a, b in zip(cuts, cuts[1:], strict=False)]


PIECES = "array<struct<overlap:int,chunk:string>>"


def _split(overlap: int):
    def pieces(text: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([split_at_punctuation(t or "", int(n), overlap) for t, n in zip(text, size, strict=True)])

    return F.pandas_udf(pieces, PIECES)


def chunk_size(text, size: int = 1000, cjk_size: int = 500) -> Column:
    """Smaller for texts whose first 500 characters are CJK."""
    return F.when(is_cjk_dominant(F.left(col(text), F.lit(500))), cjk_size).otherwise(size)


def chunk_text(docs: DataFrame, size: int = 1000, cjk_size: int = 500, context: float = 0.1, overlap: int = 0, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows (by, chunk_no, overlap, chunk, context): pieces, smaller for CJK, each with the tail of the one before."""
    rows = docs.select(*by, "text", chunk_size("text", size, cjk_size).alias("size"))
    rows = rows.select(*by, "size", _split(overlap)("text", "size").alias("pieces"))
    tail = F.floor(F.col("size") * context).cast("int")
    told = F.transform("pieces", lambda p, i: F.struct(i.alias("chunk_no"), p["overlap"].alias("overlap"), p["chunk"].alias("chunk"), F.when(i > 0, F.right(F.get("pieces", i - 1)["chunk"], tail)).otherwise("").alias("context")))
    return rows.select(*by, F.explode(told).alias("c")).select(*by, "c.*")


def merge_answers(chunks: DataFrame, answers: DataFrame, whole: bool = True, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows (by, text): answers (by, chunk_no, answer) in place of chunks. With `whole`, one missing answer keeps all of
    the original; else only its own chunk."""
    rows = chunks.join(answers, [*by, "chunk_no"], "left")
    every = F.bool_and(F.col("answer").isNotNull()).over(Window.partitionBy(*by))
    part = F.when(every, F.col("answer")).otherwise(F.col("chunk")) if whole else F.coalesce("answer", "chunk")
    joined = F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "part"))), lambda x: x["part"])
    return rows.withColumn("part", part).groupBy(*by).agg(F.array_join(joined, "\n\n").alias("text"))


def split_front_matter(markdown) -> Column:
    """(head, body) of a document: what stands between the first two `---` and after them; a null head if there is none."""
    parts = F.split(col(markdown), "---", 3)
    has = (F.size(parts) == 3) & (strip(parts[0]) == "")
    return F.struct(F.when(has, parts[1]).alias("head"), F.when(has, parts[2]).otherwise(col(markdown)).alias("body"))


def polish_work(docs: DataFrame, size: int = 1000, cjk_size: int = 500, context: float = 0.1) -> DataFrame:
    """Rows (doc_id, section, chunk_no, chunk, context) that a language model is asked for, of documents (doc_id, markdown).

    A body with `## ` lines is cut by section, one without is one section -1 of the paragraphs after its preamble (lines
    that begin with #, >, * or <). The context is the end of the chunk before, across sections."""
    rows = docs.select("doc_id", split_front_matter("markdown").alias("m"))
    rows = rows.select("doc_id", F.col("m.body").alias("body"), F.regexp_replace(S._cut("m.body", lambda x: F.startswith(x, F.lit("## ")), lambda x: x)[0]["body"], r"\s+\z", "").alias("preamble"), S.polish("m.body").alias("sections"))
    flat = F.size("sections") == 1
    basis = F.when(flat, flat_parts("preamble")["text"]).otherwise(F.col("body"))
    rows = rows.withColumn("size", chunk_size(basis, size, cjk_size))
    one = F.array(F.struct(F.lit(-1).cast("bigint").alias("section"), flat_parts("preamble")["text"].alias("text")))
    many = F.transform(F.filter("sections", lambda s: (s["seq"] > 0) & (s["body"] != "")), lambda s: F.struct((s["seq"] - 1).alias("section"), s["body"].alias("text")))
    rows = rows.select("doc_id", "size", F.explode(F.when(flat, one).otherwise(many)).alias("s"))
    rows = rows.select("doc_id", "size", "s.section", F.col("s.text").alias("text")).select("doc_id", "size", "section", _split(0)("text", "size").alias("pieces"))
    rows = rows.select("doc_id", "size", "section", F.posexplode("pieces").alias("chunk_no", "p")).select("doc_id", "size", "section", "chunk_no", F.col("p.chunk").alias("chunk"))
    before = F.lag("chunk").over(Window.partitionBy("doc_id").orderBy("section", "chunk_no"))
    return rows.withColumn("context", F.coalesce(F.right(before, F.floor(F.col("size") * context).cast("int")), F.lit(""))).drop("size")


def flat_parts(text) -> Column:
    """(preamble, text) of a body without sections: its paragraphs up to the first that is neither heading, quote, list nor
    tag, and from there on."""
    paragraphs = F.filter(F.split(col(text), "\n\n"), lambda p: strip(p) != "")
    first = lambda ps: F.coalesce(F.array_position(F.transform(ps, lambda p: strip(p).rlike(r"^[#>*<]")), False).cast("int"), F.lit(0))
    parts = lambda ps, k: F.struct(F.array_join(F.when(k > 0, F.slice(ps, F.lit(1), k - 1)).otherwise(ps), "\n\n").alias("preamble"), F.array_join(F.when(k > 0, F.slice(ps, k, F.size(ps))).otherwise(F.slice(ps, 1, 0)), "\n\n").alias("text"))
    return S.let(paragraphs, lambda ps: S.let(first(ps), lambda k: parts(ps, k)))


def polished(docs: DataFrame, work: DataFrame, answers: DataFrame) -> DataFrame:
    """Documents (doc_id, markdown) with answers (doc_id, section, chunk_no, answer) to `work` put in, front matter marked.

    A section of which any answer is missing stays as it was; without sections each chunk stands for itself."""
    rows = work.join(answers, ["doc_id", "section", "chunk_no"], "left")
    parts = F.array_sort(F.collect_list(F.struct("chunk_no", F.when(F.col("section") < 0, F.coalesce("answer", "chunk")).otherwise(F.col("answer")).alias("a"))))
    told = rows.groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("asked"), parts.alias("parts"))
    told = told.where(F.forall("parts", lambda p: p["a"].isNotNull())).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("section", F.array_join(F.transform("parts", lambda p: p["a"]), "\n\n")))).alias("told"))
    d = docs.select("doc_id", "markdown", split_front_matter("markdown").alias("m")).select("doc_id", "m.head", "m.body")
    raw = S._cut("body", lambda x: F.startswith(x, F.lit("## ")), lambda x: x)
    d = d.withColumn("sections", raw).join(told, "doc_id", "left")
    said = lambda k: F.try_element_at(F.col("told"), k)
    pieces = F.transform("sections", lambda s: F.when(s["seq"] == 0, s["body"]).when(said(s["seq"] - 1).isNotNull(), F.concat(s["heading"], F.lit("\n\n"), said(s["seq"] - 1))).otherwise(F.concat(s["heading"], F.lit("\n"), s["body"])))
    flat = S.let(flat_parts(F.regexp_replace("body", r"\s+\z", "")), lambda p: F.concat(F.when(p["preamble"] != "", F.concat(p["preamble"], F.lit("\n\n"))).otherwise(""), F.coalesce(said(F.lit(-1).cast("bigint")), p["text"])))
    body = F.when(F.size("sections") == 1, flat).otherwise(F.array_join(pieces, "\n\n"))
    head = F.concat(F.lit("---"), F.replace("head", F.lit("polished: false"), F.lit("polished: true")), F.lit("---\n\n"))
    return d.select("doc_id", F.when(F.col("head").isNull(), body).otherwise(F.concat(head, F.regexp_replace(body, r"^(?U)[\s\x1c-\x1f]+", ""))).alias("markdown"))
