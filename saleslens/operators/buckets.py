"""A keyed table kept in buckets and versions, merged by changed buckets only.

Rows lie in ``buckets`` folders by a hash of their key. A manifest lists, for every version, which folder
holds each bucket. A merge reads the buckets that its keys fall into, writes them into a folder of the new version and
takes away those whose content is as before, then writes the manifest, and then a row in the table of versions, which is what
makes the version exist. Files of other buckets are not touched, earlier versions stay readable, and a failed merge leaves
folders that no version names. One merge runs at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from saleslens.session import delete, durable

_BUCKET = "_bucket"
MANIFEST = "version int, batch string, bucket int, holds int, n_rows long, digest string"


@dataclass(frozen=True)
class Store:
    """A folder with the table; ``key`` and ``buckets`` are fixed when it is created."""

    spark: SparkSession
    folder: str
    key: str
    buckets: int

    def bucket(self, key: str | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(key or self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def manifest(self, version: int | None = None) -> DataFrame:
        """(version, batch, bucket, holds, n_rows, digest) of one version, the last one by default; a row per bucket with rows."""
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest/{self.latest() if version is None else version}")

    def versions(self) -> list[tuple[int, str]]:
        """Number and batch of every version, in order. Names of batches are what makes a repeated one known."""
        heads = self.spark.read.schema("version int, batch string").parquet(f"{self.folder}/versions")
        return sorted((r["version"], r["batch"]) for r in heads.collect())  # a row per version

    def latest(self) -> int:
        return self.versions()[-1][0]

    def read(self, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets."""
        wanted = None if buckets is None else set(buckets)
        held = self.manifest(version).where("n_rows > 0").collect()  # a row per bucket
        paths = [f"{self.folder}/rows/{r['holds']}/{_BUCKET}={r['bucket']}" for r in held if wanted is None or r["bucket"] in wanted]
        empty = self.spark.read.parquet(f"{self.folder}/empty")
        return self.spark.read.schema(empty.schema).parquet(*paths) if paths else empty

    def merge(self, new: DataFrame, update: Callable[[DataFrame, DataFrame], DataFrame], batch: str, key: str | None = None) -> int:
        """Apply ``update(old, new)`` to the buckets that ``new`` has keys in; returns the version that holds the outcome.

        ``update`` gives the new content of what it gets, for the keys it gets. ``key`` names the key in ``new``, if it
        differs. A batch that has been merged before changes nothing, and neither does one that leaves all rows
        as they are. A row without a key is an error, and nothing is merged.
        """
        for version, name in self.versions():
            if name == batch:
                return version
        before = self.latest()
        new = durable(new)
        if new.where(F.col(key or self.key).isNull()).head(1):
            raise ValueError("a row has no key")
        touched = [r[0] for r in new.select(self.bucket(key)).distinct().collect()]  # at most one for each bucket
        if not touched:
            return before
        return self._write(update(self.read(before, touched), new), before + 1, batch, self.manifest(before), touched)

    def _write(self, rows: DataFrame, version: int, batch: str, before: DataFrame | None, touched: list[int]) -> int:
        columns, place = rows.columns, f"{self.folder}/rows/{version}"
        rows.withColumn(_BUCKET, self.bucket()).write.mode("overwrite").partitionBy(_BUCKET).parquet(place)
        written = self.spark.read.schema(StructType([*rows.schema.fields, StructField(_BUCKET, IntegerType())])).parquet(place)
        digest = F.sum(F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))]).cast("decimal(38,0)")).cast("string")
        found = {r[_BUCKET]: (r["n"], r["d"]) for r in written.groupBy(_BUCKET).agg(F.count("*").alias("n"), digest.alias("d")).collect()}
        if not set(found) <= set(touched):
            raise ValueError("the update gave rows of keys that were not to change")
        held = {r["bucket"]: (r["holds"], r["n_rows"], r["digest"]) for r in before.collect()} if before is not None else {}
        changed = [b for b in touched if found.get(b, (0, None)) != held.get(b, (0, 0, None))[1:]]
        for b in set(found) - set(changed):
            delete(self.spark, f"{place}/{_BUCKET}={b}")  # as it was; the folder it is in stays
        for b in changed:
            n, d = found.get(b, (0, None))
            held[b] = (version, n, d)
        self._say(version, batch, held)
        return version

    def _say(self, version: int, batch: str, held: dict[int, tuple]) -> None:
        listed = [(version, batch, b, holds, n, d) for b, (holds, n, d) in sorted(held.items())]
        self.spark.createDataFrame(listed, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/{version}")
        self.spark.createDataFrame([(version, batch)], "version int, batch string").coalesce(1).write.mode("append").parquet(f"{self.folder}/versions")


def create(rows: DataFrame, folder: str, key: str, buckets: int = 64) -> Store:
    """Write a table as version 0 of a store. Choose the number of buckets so that one is some 100 MB at the size expected."""
    store = Store(rows.sparkSession, folder, key, buckets)
    rows.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{folder}/empty")
    store._write(rows, 0, "", None, list(range(buckets)))
    return store
