"""Tables that are kept by the hash of a key: appended batch by batch, and read for given keys only.

A table is a folder of segments, one for each batch and one for each compaction (``segment=first-last``). Within a segment
rows lie in folders by ranges of the key's hash (``bucket``), sorted by it, in small row groups with a Bloom filter. So a
lookup lists the segments, reads the folders of its keys' buckets, and of those, if its keys are few, the row groups that
can hold their hashes. A row replaces the earlier ones of its identity; one that is not ``live`` takes them away.

A segment counts once it is whole (Spark's ``_SUCCESS`` file), and one that another covers is left out, so a batch or a
compaction that fails half-way or runs again does no harm.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import materialize

#: Ranges of the hash, as a power of two; every lookup tells the driver the ranges of its keys, at most so many.
BUCKET_BITS = 6
#: Hashes that a lookup hands to the scan; with more, only buckets are pruned, and the join does the rest.
PUSHED_HASHES = 256
ROW_GROUP_BYTES = 4 << 20

_OWN = ["_hash", "_batch", "_live"]


@dataclass(frozen=True)
class KeyedTable:
    """``columns``: DDL by column; ``keys``: what is looked up; ``identity``: with the keys, what a row replaces."""

    folder: str
    columns: dict[str, str]
    keys: tuple[str, ...]
    identity: tuple[str, ...] = ()
    bucket_bits: int = BUCKET_BITS
    row_group_bytes: int = ROW_GROUP_BYTES

    @property
    def schema(self) -> str:
        return ", ".join([*[f"{k} {t}" for k, t in self.columns.items()], "_hash long, _batch long, _live boolean, segment string, bucket int"])

    def _hash(self) -> Column:
        return F.xxhash64(*[F.col(k).cast(self.columns[k]) for k in self.keys])

    def _bucket(self) -> Column:
        return F.shiftrightunsigned("_hash", 64 - self.bucket_bits).cast("int")

    def segments(self, spark: SparkSession, before: int | None = None) -> list[tuple[int, int]]:
        """(first, last) batch of the whole segments that no other covers, of batches below ``before``."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        found = []
        for s in files.listStatus(path):
            ends = re.fullmatch(r"segment=(\d+)-(\d+)", s.getPath().getName())
            if ends and files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
                found.append((int(ends[1]), int(ends[2])))
        found = [s for s in found if before is None or s[1] < before]
        return sorted(s for s in found if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in found))

    def _write(self, rows: DataFrame, first: int, last: int) -> None:
        # Rebalancing splits a bucket of many rows among tasks and puts small ones together.
        placed = rows.withColumn("_hash", self._hash()).withColumn("bucket", self._bucket()).hint("rebalance", "bucket").sortWithinPartitions("bucket", "_hash")
        options = {"parquet.block.size": self.row_group_bytes, "parquet.bloom.filter.enabled#_hash": "true", "parquet.bloom.filter.expected.ndv#_hash": "100000"}
        placed.select(*self.columns, *_OWN, "bucket").write.mode("overwrite").options(**options).partitionBy("bucket").parquet(f"{self.folder}/segment={first}-{last}")

    def append(self, rows: DataFrame, batch: int) -> None:
        """A batch's rows; ``live`` (true where the column is absent) is false for those that are taken away.

        A batch has one row for each key and identity at most. One that is appended again replaces itself.
        """
        live = F.coalesce(F.col("live"), F.lit(True)) if "live" in rows.columns else F.lit(True)
        self._write(rows.select(*[F.col(c).cast(t).alias(c) for c, t in self.columns.items()], F.lit(batch).cast("long").alias("_batch"), live.alias("_live")), batch, batch)

    def _scan(self, spark: SparkSession, before: int | None) -> DataFrame:
        segments = self.segments(spark, before)
        if not segments:
            return spark.createDataFrame([], self.schema)
        paths = [f"{self.folder}/segment={a}-{b}" for a, b in segments]
        return spark.read.schema(self.schema).option("basePath", self.folder).parquet(*paths)

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.columns if c not in (*self.keys, *self.identity)]
        newest = rows.groupBy(*self.keys, *self.identity).agg(F.max_by(F.struct("_hash", "_live", "_batch", *rest), "_batch").alias("r"))
        return newest.select(*self.keys, *self.identity, "r.*")

    def pruned(self, wanted: DataFrame, before: int | None = None) -> DataFrame:
        """The scan that a lookup of the keys in ``wanted`` makes: their rows, and maybe others of their buckets."""
        spark = wanted.sparkSession
        keys = wanted.select(*self.keys).distinct().withColumn("_hash", self._hash())
        buckets = keys.agg(F.collect_set(self._bucket())).first()[0]
        rows = self._scan(spark, before).where(F.col("bucket").isin(sorted(buckets)))
        some = [F.col("_hash") == r._hash for r in keys.select("_hash").distinct().limit(PUSHED_HASHES + 1).collect()]
        if 0 < len(some) <= PUSHED_HASHES:
            # A balanced tree of equalities, which the scan checks against statistics, dictionaries and Bloom filters.
            while len(some) > 1:
                some = [reduce(Column.__or__, some[i : i + 2]) for i in range(0, len(some), 2)]
            rows = rows.where(some[0])
        return rows

    def lookup(self, wanted: DataFrame, before: int | None = None) -> DataFrame:
        """The newest live rows of the keys in ``wanted`` (which is read three times), from batches below ``before``.

        A null in a key is a value like others.
        """
        keys = wanted.select(*[F.col(k).alias(f"_{k}") for k in self.keys]).distinct()
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys])
        rows = self.pruned(wanted, before).join(keys, same, "left_semi")
        return self._newest(rows).where("_live").select(*self.columns)

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """All newest live rows."""
        return self._newest(self._scan(spark, before)).where("_live").select(*self.columns)

    def compact(self, spark: SparkSession, before: int | None = None) -> None:
        """One segment in place of those there are: the newest live rows. The old ones stay until ``clean``."""
        segments = self.segments(spark, before)
        if len(segments) > 1:
            rows = materialize(self._newest(self._scan(spark, before)).where("_live").select(*self.columns, "_batch", "_live"), "compacted")
            self._write(rows, segments[0][0], segments[-1][1])

    def clean(self, spark: SparkSession) -> None:
        """Delete the segments that another covers; only when no lookup that began before the compaction runs."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        whole = self.segments(spark)
        for s in list(files.listStatus(path)) if whole else []:
            ends = re.fullmatch(r"segment=(\d+)-(\d+)", s.getPath().getName())
            if ends and any((a, b) != (int(ends[1]), int(ends[2])) and a <= int(ends[1]) and int(ends[2]) <= b for a, b in whole):
                files.delete(s.getPath(), True)
