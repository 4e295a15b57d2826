"""The queries of this subpackage: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import arc_warc, byte_bpe, chat_format, filter_audit, filtering_lloyd, licenses, ngram_join, pfair_mix, pii, ppm, repair_tokens, tiff, winnow
from loomtext.runtime import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    keys = arc_warc.page_keys(pages)
    records = arc_warc.arc_to_warc(arc_warc.pages_to_arc(pages))
    path = scratch(spark, "warc")
    arc_warc.write_warc(arc_warc.with_revisits(records, keys), path, file_records=arc_warc.records_of(keys))
    return arc_warc.read_warcs(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
     d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
     f AS (SELECT h, min(page_id) AS first, count(*) AS n FROM d GROUP BY h),
     bits AS (SELECT page_id, d.n AS size, first, d.h FROM d JOIN f USING (h))
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(((('0x' || substr(h, CAST(i * 5 // 4 AS BIGINT) + 1, 2))::BIGINT >> (3 - i * 5 % 4)) & 31) AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM bits
"""


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op2_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_counts(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edits(table(spark, sf_dir, "documents"), parts_of(spark))


def op4_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair_mix.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op5_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "shards")
    repair_tokens.write_shards(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), 2, parts_of(spark))
    return repair_tokens.starts(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_digests(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_spans(docs, pii.train(docs))
    of_kind = lambda spans, i: F.size(F.filter(spans, lambda s: s["kind"] == i)).cast("bigint")
    counts = [of_kind("base", i).alias(f"n_{name}") for i, name in enumerate(pii.KINDS[: pii.BASE])]
    more = [of_kind("spans", i).alias(f"n_{name}") for i, name in list(enumerate(pii.KINDS))[pii.BASE :]]
    return found.select("doc_id", *counts, F.sha2(pii.written("base").cast("binary"), 256).alias("base_sha256"), pii.written("spans").alias("spans"), *more, F.size("spans").cast("bigint").alias("n_spans"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    best = F.array_max(F.transform("matches", lambda m: F.struct(m["dice"].alias("dice"), (-m["start_word"]).alias("first"), m["license"].alias("license"))))
    listed = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start_word"].cast("string"), m["end_word"].cast("string"), F.format_number(m["dice"], 4))), ",")
    return found.select("doc_id", F.size("matches").cast("bigint").alias("n_matches"), best["license"].alias("license"), best["dice"].alias("dice"), listed.alias("matches"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    how = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = byte_bpe.round_trip(table(spark, sf_dir, "documents"), *how)
    return rows.select("doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def op10_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = ppm.train(docs.where(~F.coalesce(held_out(), F.lit(False))))
    found = ppm.predict(docs, model)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_filtering_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtering_lloyd.compress(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", F.col("lost_good").alias("good_lost"), F.col("lost_toxic").alias("toxic_lost"), "shapley")


def op13_chat_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, i, role, chat_format.PLANTED) for i, role in enumerate(("user", "assistant"))], "conv_id bigint, turn bigint, role string, text string")
    path = scratch(spark, "chats")
    chat_format.write_chats(chats.unionByName(more), path)
    return chat_format.digests(spark, path).withColumnRenamed("conv", "conv_id")


QUERIES = {
    "op1_arc_to_warc": op1_arc_to_warc,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op2_ngram_jaccard_links": op2_ngram_jaccard_links,
    "op3_winnowing": op3_winnowing,
    "op4_pfair_mix": op4_pfair_mix,
    "op5_repair_tokens": op5_repair_tokens,
    "op6_tiff_pages": op6_tiff_pages,
    "op7_pii": op7_pii,
    "op8_license_scan": op8_license_scan,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_ppm_language": op10_ppm_language,
    "op11_filtering_lloyd": op11_filtering_lloyd,
    "op12_filter_audit": op12_filter_audit,
    "op13_chat_prefixes": op13_chat_prefixes,
}
ORACLES = {"op1_arc_to_warc": OP1_SQL, "op4_pfair_mix": pfair_mix.sql(), "op12_filter_audit": filter_audit.SQL, "op13_chat_prefixes": chat_format.SQL}
