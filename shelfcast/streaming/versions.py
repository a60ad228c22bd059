"""A keyed table that batches renew in part: versions by batch, and only the buckets that a batch touches are written."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import exists


class VersionedTable:
    """Rows in hash buckets of their key under ``root``.

    A batch writes its buckets under its own number, then a manifest that names the version of every bucket. A reader
    takes the newest manifest before its batch, so a batch that is run again reads what it read before and
    replaces what it wrote, and a version without a manifest is never seen.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, key: Sequence[str], buckets: int = 64):
        self.spark, self.root, self.schema, self.key, self.buckets = spark, root, schema, list(key), buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets that hold keys of ``rows``: as many numbers as there are buckets at most."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def versions(self, folder: str = "manifest") -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [f.getPath().getName().removeprefix("version=") for f in fs.listStatus(path)]
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, before: int) -> dict[int, int]:
        """Bucket to version, as of the newest finished batch before ``before``."""
        for v in reversed([v for v in self.versions() if v < before]):
            if exists(self.spark, f"{self.root}/manifest/{v}/_SUCCESS"):
                return {r["bucket"]: r["version"] for r in self.spark.read.schema("bucket int, version bigint").parquet(f"{self.root}/manifest/{v}").collect()}
        return {}

    def read(self, before: int, only: Iterable[int] | None = None) -> DataFrame:
        """The rows as of before a batch; ``only`` prunes to some buckets."""
        known = self.manifest(before)
        if only is not None:
            known = {b: known[b] for b in only if b in known}
        if not known:
            return self.spark.createDataFrame([], self.schema)
        at = F.create_map(*[F.lit(x) for b, v in known.items() for x in (b, v)])
        whole = self.spark.read.schema(f"{self.schema}, version bigint, bucket int").parquet(f"{self.root}/data")
        pruned = whole.where(F.col("bucket").isin(list(known)) & F.col("version").isin(sorted(set(known.values()))))
        return pruned.where(F.try_element_at(at, F.col("bucket")) == F.col("version")).drop("version", "bucket")

    def write(self, version: int, rows: DataFrame, touched: Sequence[int]) -> None:
        """All rows of the touched buckets; the other buckets stay as they were before this version. A large bucket is written by several tasks."""
        known = self.manifest(version) | {b: version for b in touched}
        (rows.withColumn("bucket", self.bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket")
         .parquet(f"{self.root}/data/version={version}"))
        rows_of = self.spark.createDataFrame(sorted(known.items()), "bucket int, version bigint")
        rows_of.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/{version}")

    def vacuum(self, keep: int) -> list[int]:
        """Delete data that no manifest from version ``keep`` on names, nor the one before it (batch ``keep`` may be run again)."""
        manifests = self.versions()
        older = [v for v in manifests if v < keep]
        live = set()
        for v in [*older[-1:], *[v for v in manifests if v >= keep]]:
            live |= set(self.manifest(v + 1).values())
        gone = [v for v in self.versions("data") if v not in live and v < keep]
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for folder, dead in (("data/version=", gone), ("manifest/", older[:-1])):
            for v in dead:
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}{v}"), True)
        return gone
