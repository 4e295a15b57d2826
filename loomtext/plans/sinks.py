"""Output folders, files and batch copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext import patterns as P
from loomtext.functions.text import slugify
from loomtext.plans.document_files import BATCH_FOLDER, COLUMNS, DocumentFiles, documents_below
from loomtext.runtime import exists, ship


def folder(title: str = "title", date: str = "publish_date", stamp: str = "", max_length: int = 80) -> Column:
    """DATE_slug_STAMP; the stamp is a parameter, so that a plan run twice gives the same."""
    return F.concat_ws("_", F.col(date), slugify(title, max_length), F.lit(stamp) if stamp else F.lit(None).cast("string"))


def unique_paths(df: DataFrame, base: str = "folder", pos: str = "pos") -> DataFrame:
    """Equal paths get -2, -3 and so on, by position."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(pos))
    return df.withColumn("path", F.when(n == 1, F.col(base)).otherwise(F.concat_ws("-", base, n.cast("string"))))


def basename() -> Column:
    """A document's file name by its content_type."""
    names = {"youtube": "transcript", "podcast": "podcast", "pdf": "paper", "twitter": "tweet", "article": "article", "local_file": "document"}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("content_type"))


def _new(df: DataFrame, out: str, key: str) -> DataFrame:
    """Rows whose keys the table does not hold yet."""
    spark = df.sparkSession
    if not exists(spark, out):
        return df
    return df.join(spark.read.parquet(out).select(key).distinct(), key, "left_anti")


def write_documents(df: DataFrame, out: str, overwrite: bool = False) -> None:
    """Rows (path, markdown) added to a table of documents; those whose path is there are skipped, or all is written anew."""
    rows = df.select("path", "markdown")
    (rows if overwrite else _new(rows, out, "path")).write.mode("overwrite" if overwrite else "append").parquet(out)


def _tasks(spark: SparkSession) -> int:
    """Tasks that write or read files: small ones, as what they do waits for the store."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def write_files(df: DataFrame, out: str, overwrite: bool = False, copies: bool = False) -> None:
    """Rows (path, basename, markdown) as files <out>/<path>/<basename>.md, one for each document. Documents that are there
    are left as they are, or replaced each for itself; copies: also as <out>/batch-process/<path>.md.

    Rows are dealt by path, so that all tasks write, however few files or row groups the documents come from."""
    spark = df.sparkSession
    ship(spark)
    spark.dataSource.register(DocumentFiles)
    df.select(*COLUMNS).repartition(_tasks(spark), "path").write.format("document_files").option("copies", str(copies).lower()).mode("overwrite" if overwrite else "append").save(out)


def read_files(spark: SparkSession, out: str) -> DataFrame:
    """Rows (folder, name, markdown) of the Markdown files below a folder; the folder is relative to it, and empty for its own."""
    ship(spark)
    return documents_below(spark, out, _tasks(spark))


def with_raw(df: DataFrame, polished: DataFrame) -> DataFrame:
    """Rows (doc_id, path, content_type, markdown) as files (path, basename, markdown): the polished text (doc_id, markdown)
    where there is one, and for transcripts and podcasts the raw one beside it, as `*.unpolished`."""
    rows = df.join(polished.select("doc_id", F.col("markdown").alias("better")), "doc_id", "left").withColumn("basename", basename())
    raw = rows.where(F.col("content_type").isin("youtube", "podcast")).select("path", F.concat("basename", F.lit(".unpolished")).alias("basename"), "markdown")
    return rows.select("path", "basename", F.coalesce("better", "markdown").alias("markdown")).unionByName(raw)


def detect_basenames(files: DataFrame) -> DataFrame:
    """Of rows (folder, name), each folder's basename by precedence, by the document or its raw form; transcript where none
    is known."""
    own = F.regexp_replace("name", r"(?:\.unpolished)?\.md\z", "")
    order = F.array_position(F.array(*map(F.lit, P.BASENAMES)), own)
    rows = files.where(~F.col("folder").isin(*P.SKIPPED_FOLDERS)).withColumn("own", own).withColumn("rank", F.when(order > 0, order))
    return rows.groupBy("folder").agg(F.coalesce(F.min_by("own", "rank"), F.lit("transcript")).alias("basename")).orderBy("folder")


def batch_copies(done: DataFrame) -> DataFrame:
    """Rows of backfill() as files (path, basename, markdown) of the batch folder, one for each folder, named as it."""
    return done.where("file IS NOT NULL").select(F.lit(BATCH_FOLDER).alias("path"), F.col("folder").alias("basename"), "markdown")


def backfill(files: DataFrame) -> DataFrame:
    """Of files (folder, name, markdown), each folder's copy (folder, basename, file, markdown), in order of folders; file is
    null where the folder has no file of that name."""
    kept = files.where(~F.col("folder").isin(*P.SKIPPED_FOLDERS))
    named = detect_basenames(files)
    own = kept.select("folder", F.regexp_replace("name", r"\.md\z", "").alias("basename"), "markdown")
    rows = named.join(own, ["folder", "basename"], "left")
    return rows.select("folder", "basename", F.when(F.col("markdown").isNotNull(), F.concat(F.lit("batch-process/"), "folder", F.lit(".md"))).alias("file"), "markdown").orderBy("folder")


def with_polish(df: DataFrame, polished: DataFrame) -> DataFrame:
    """markdown replaced by polished text (doc_id, polished_body) where there is one, and marked so."""
    rows = df.join(polished, "doc_id", "left")
    head = F.regexp_extract("markdown", r"(?s)^(---\n.*?\n---)", 1)
    better = F.concat(F.replace(head, F.lit("polished: false"), F.lit("polished: true")), F.lit("\n\n"), "polished_body", F.lit("\n"))
    return rows.withColumn("unpolished", F.col("markdown")).withColumn("markdown", F.coalesce(better, "markdown")).drop("polished_body")
