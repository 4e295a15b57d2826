"""A table of the latest row of each key, kept up by a stream, and safe when batches are tried again.

    <out>/data/v=<batch>/bucket=<b>/...   rows of a bucket of keys as of that batch, deleted ones included
    <out>/ledger/<batch>.json             which buckets that batch has written

A batch merges its rows into the buckets that its keys hash to, and only these are written anew, to a folder of the batch.
The ledger entry comes last, by renaming a finished file, and makes the batch count. A batch whose entry is there is
skipped, so that a replay after a crash adds nothing; one that crashed before its entry writes its own folder again.
Readers take of each bucket the newest version that the ledger names, so they never see half a batch. `vacuum` deletes
versions that nothing names.

Of rows with equal keys and versions the greatest by all columns is kept, so that results do not depend on how rows were
dealt into batches. Rows with an older version than the one that is there change nothing. Null keys are a key; rows with a
null version give way to any other. A row for which `deleted` holds removes its key from what readers see; it stays in its
bucket, so that an older row that comes later does not bring the key back.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomtext.runtime import drop_path

#: Buckets of a table. A batch reads and writes those that its keys fall in.
BUCKETS = 64


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


@dataclass(frozen=True)
class LatestTable:
    """The table at `out` with rows of `schema`, of which `keys` tell what a row is about and `version` which is newer."""

    spark: SparkSession
    out: str
    schema: StructType
    keys: tuple[str, ...]
    version: str
    deleted: str | None = None
    buckets: int = BUCKETS

    # --- ledger ---

    def entries(self) -> dict[int, list[int]]:
        """The buckets that each counted batch has written, by batch."""
        fs, at = _file_system(self.spark, f"{self.out}/ledger")
        if not fs.exists(at):
            return {}
        found = {}
        for status in fs.listStatus(at):
            name = status.getPath().getName()
            if name.endswith(".json"):
                stream = fs.open(status.getPath())
                try:
                    found[int(name[:-5])] = json.loads(bytes(stream.readAllBytes()).decode())
                finally:
                    stream.close()
        return dict(sorted(found.items()))

    def _enter(self, batch: int, buckets: list[int]) -> None:
        fs, folder = _file_system(self.spark, f"{self.out}/ledger")
        fs.mkdirs(folder)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        staged, final = path(f"{self.out}/ledger/.{batch}.tmp"), path(f"{self.out}/ledger/{batch}.json")
        stream = fs.create(staged, True)
        stream.write(json.dumps(buckets).encode())
        stream.close()
        if not fs.rename(staged, final) and not fs.exists(final):
            raise OSError(f"the ledger entry of batch {batch} could not be made")

    def versions(self) -> dict[int, int]:
        """The batch that wrote each bucket last."""
        return {b: batch for batch, buckets in self.entries().items() for b in buckets}

    # --- rows ---

    def _rows(self, versions: dict[int, int]) -> DataFrame:
        columns = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema), "bucket_ int"])
        paths = [f"{self.out}/data/v={v}/bucket={b}" for b, v in sorted(versions.items())]
        return self.spark.read.schema(columns).parquet(*paths) if paths else self.spark.createDataFrame([], columns)

    def _latest(self, rows: DataFrame) -> DataFrame:
        """Of each key the row of the greatest version, then the greatest by all columns; combined before it is shuffled."""
        others = [c for c in rows.columns if c not in self.keys]
        order = F.struct(F.col(self.version).isNotNull(), self.version, *[c for c in others if c != self.version])
        best = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*others), order).alias("r"))
        return best.select(*self.keys, "r.*").select(rows.columns)

    def read(self) -> DataFrame:
        """The latest row of each key."""
        rows = self._rows(self.versions()).drop("bucket_")
        return rows.where(~F.coalesce(F.expr(self.deleted), F.lit(False))) if self.deleted else rows

    def upsert(self, rows: DataFrame, batch: int) -> bool:
        """Merge a batch; False if it has been counted before."""
        entries = self.entries()
        if batch in entries:
            return False
        names = [f.name for f in self.schema]
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        new = self._latest(rows.select(*names).withColumn("bucket_", bucket)).persist()
        try:
            touched = sorted(r["bucket_"] for r in new.select("bucket_").distinct().collect())  # `buckets` rows at most
            if touched:
                current = {b: v for b, v in self.versions().items() if b in set(touched)}
                merged = self._latest(new.unionByName(self._rows(current))) if current else new
                path = f"{self.out}/data/v={batch}"
                drop_path(self.spark, path)
                merged.withColumn("bucket", F.col("bucket_")).write.partitionBy("bucket").parquet(path)
            self._enter(batch, touched)
        finally:
            new.unpersist()
        return True

    def vacuum(self) -> int:
        """Delete the versions of buckets that no reader takes any more; how many. Not while a reader may still hold them."""
        entries, kept = self.entries(), {(v, b) for b, v in self.versions().items()}
        old = [(batch, b) for batch, buckets in entries.items() for b in buckets if (batch, b) not in kept]
        for batch, b in old:
            drop_path(self.spark, f"{self.out}/data/v={batch}/bucket={b}")
        return len(old)

    def follow(self, stream: DataFrame, checkpoint: str, plan: Callable[[DataFrame], DataFrame] = lambda rows: rows, **trigger):
        """A running query that merges each batch of the stream, put through a batch plan first. What a batch is written to
        and counted by is its number, so `checkpoint` belongs to this table alone."""

        def each(batch: DataFrame, number: int) -> None:
            self.upsert(plan(batch), number)

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
