"""A training corpus from raw documents, in five stages of the llm subpackage, each written and read again.

Language ID drops documents in no language that was learned, the n-gram Jaccard join keeps one document of each group, personal
data is replaced by its kind, sources are mixed to target weights, and what is left is encoded by byte-level BPE.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import byte_bpe, ngram_join, pfair_mix, pii, ppm
from loomtext.runtime import drop_path, scratch_paths, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Shingles of five words and a similarity of 0.8, as for any near-duplicate stage.
WORDS, NUM, DEN = 5, 80, 100


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found, with it as lang, row by row. Those without a letter go (null and empty texts among
    them), and those whose best code is far longer than those of labelled documents that were held out of training. Of
    languages with equally short codes the first in order is told. Without any labelled text no document is kept."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = ppm.train(docs.where(~held))
    bound = ppm.far_bound(ppm.coded(docs.where(held & F.col("lang").isNotNull()).select("doc_id", "text"), model))
    found = ppm.coded(docs.select(*COLUMNS), model).where("lang_pred != 'und'").where(~ppm.is_far(bound))
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents one row: that of the smallest doc_id, null last, of its texts that of the
    least hash, and of rows alike in both the least in other columns. Rows without a word, null and empty texts among
    them, are in no group and stay, each."""
    rows = ngram_join.similar_rows(docs, n=WORDS, num=NUM, den=DEN).where("root IS NOT NULL")
    ids, path = stored(rows.groupBy("root", "doc_id", "mark").agg(F.count(F.lit(1)).alias("times")), "row-ids")
    one = ids.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("one")).select("root", F.col("one.doc_id").alias("one_id"), F.col("one.mark").alias("one_mark"))
    ids = ids.join(one, "root").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("one_id")) & (F.col("mark") == F.col("one_mark")))
    # Repeated rows of a kept one go as well. Rows of groups are told from the rest where they are read; they alone are moved.
    told, _ = stored(ids.where("NOT kept OR times > 1").select(F.col("doc_id").alias("told_id"), F.col("mark").alias("told_mark"), "kept", ngram_join.row_id(F.col("doc_id"), F.col("mark")).alias("id")), "duplicates")
    drop_path(spark, path)
    sieve = ngram_join.Sieve(told, "id")
    docs = docs.select(*COLUMNS)
    own = ngram_join.row_id(F.col("doc_id"), F.xxhash64("text"))
    some, _ = stored(sieve.inside(docs, own).withColumn("mark", F.xxhash64("text")), "of-groups")
    some = some.join(told, F.col("doc_id").eqNullSafe(F.col("told_id")) & (F.col("mark") == F.col("told_mark")), "left")
    once = some.where("kept").groupBy("doc_id", "mark").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return sieve.outside(docs, own).unionByName(some.where("kept IS NULL").select(*COLUMNS)).unionByName(once)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; spans that overlap are one. Null texts become empty."""
    found = pii.find_spans(docs, pii.train(docs), keep=("lang", "source"))
    clean = found.select("doc_id", pii.redacted().alias("text"), "lang", "source")
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document at least once, those of sources below their weight again. A null source is a source; rows of
    one source come in the order of their keys' hashes, ties by key, so that repeated rows are each taken."""
    return pfair_mix.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's ids, and the digest of the bytes that they decode to; a null text has none."""
    how = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = byte_bpe.round_trip(docs, *how)
    return rows.select("doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixed), ("tokens", tokens)]

#: Language ID and the span classifier can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each stored but the last. When one is stored, its input and what it has made on the way are dropped."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch_paths() as made:
            docs, path = stored(stage(spark, docs, sf_dir), name)
        for old in [p for p in made if p != path] + ([before] if before else []):
            drop_path(spark, old)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
