"""The result store: merge, lifecycle, overrides and reads as joins, and a folder that keeps versions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievelake.operators.board import dedup_newest, file_key
from sievelake.sources import commits


def merge_results(store: DataFrame, batch: DataFrame, now) -> DataFrame:
    """The store after a batch: a row of the batch takes the place of the one with its file name, without case, or its id; others are added.

    Kept from the replaced row: id and created_at; rows come back undeleted. The batch has one row for each file. All columns of the store are returned.
    """
    cols = store.columns
    new = batch.withColumn("_key", file_key())
    old = store.withColumn("_key", file_key())
    by_key = old.select("_key", F.col("id").alias("_old"), F.col("created_at").alias("_made")).join(new.select("_key"), "_key", "left_semi")
    by_id = old.join(new.select("_key"), "_key", "left_anti").select(F.col("id").alias("_id"), F.col("created_at").alias("_made_id"))
    met = new.join(by_key, "_key", "left").join(by_id, F.col("_old").isNull() & (F.col("id") == F.col("_id")), "left")
    stamp = F.lit(now).cast("timestamp")
    fresh = met.withColumns({
        "created_at": F.coalesce("_made", "_made_id", "created_at", stamp), "updated_at": stamp, "is_deleted": F.lit(False), "id": F.coalesce("_old", "id"),
    })
    gone = fresh.select("id").distinct()
    return old.join(gone, "id", "left_anti").select(cols).unionByName(fresh.select(cols))


def set_deleted(store: DataFrame, ids: DataFrame | None, deleted: bool) -> DataFrame:
    """Flag rows of ids (None: all) as deleted or not."""
    if ids is None:
        return store.withColumn("is_deleted", F.lit(deleted))
    marked = store.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    return marked.withColumn("is_deleted", F.when(F.col("_hit"), F.lit(deleted)).otherwise(F.col("is_deleted"))).select(store.columns)


def soft_delete(store: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    return set_deleted(store, ids, True)


def restore(store: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    return set_deleted(store, ids, False)


def delete_permanently(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select("id").distinct(), "id", "left_anti")


def purge(store: DataFrame) -> DataFrame:
    """Without the rows flagged as deleted."""
    return store.where(~F.col("is_deleted"))


def load_results(store: DataFrame, include_deleted: bool = False, limit: int | None = None) -> DataFrame:
    """Newest row of each file, defaults filled. limit, if any, is applied before the dedup, newest first."""
    rows = store if include_deleted else purge(store)
    if limit is not None:
        rows = rows.orderBy(F.desc("updated_at"), F.desc("created_at"), "id").limit(limit)
    return dedup_newest(rows).fillna({"candidate_name": "Candidate", "role": "", "overall_score": 0})


def apply_overrides(results: DataFrame, overrides: DataFrame) -> DataFrame:
    """Manual scores of 0 to 100 and notes laid over results; a column override_error tells of rejected scores."""
    ok = F.col("_manual").between(0, 100)
    new = overrides.select("id", F.col("manual_score").cast("double").alias("_manual"), F.col("officer_notes").alias("_notes"))
    met = results.join(new, "id", "left")
    out = met.withColumn("override_error", F.when(F.col("_manual").isNotNull() & ~ok, "manual score outside 0 to 100"))
    out = out.withColumn("manual_score", F.when(ok, F.col("_manual")).otherwise(F.col("manual_score"))).withColumn("officer_notes", F.coalesce("_notes", "officer_notes"))
    return out.drop("_manual", "_notes")


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class ResultStore:
    """A store in a folder, changed by copying: rows lie in buckets by their file key, and a change rewrites the buckets that it touches and no others.

    A version is a manifest: for each bucket the folder that holds it. Manifests are committed under their number, which only one writer can take; a writer
    that comes second looks at what the first one changed, keeps its own buckets if they are others, and else merges again. Readers see whole versions, old
    ones too until they are swept. What reaches the driver are bucket numbers and manifests, both bounded by the number of buckets.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, tries: int = 5):
        self.spark, self.path, self.buckets, self.tries = spark, path.rstrip("/"), buckets, tries
        self.before_commit: Callable[[int], None] = lambda version: None  #: for tests: called with the number that is about to be taken

    def create(self, rows: DataFrame) -> int:
        """The first version."""
        commits.commit(self.spark, self._manifest(0), {"schema": rows.schema.jsonValue(), "buckets": self._write(rows)})
        return 0

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifests/{version:012d}"

    def versions(self) -> list[int]:
        return [int(n) for n in commits.committed(self.spark, f"{self.path}/manifests")]

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Rows as new folders of their buckets: bucket to folder, for the buckets that hold rows."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", bucket_of(file_key(), self.buckets)).repartition(F.col("_bucket")).write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        names = [n for n in commits.folders(self.spark, f"{self.path}/{folder}") if n.startswith("_bucket=")]
        return {n.split("=")[1]: f"{folder}/{n}" for n in names}

    def _rows(self, manifest: dict, buckets: Iterable[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        places = [f"{self.path}/{p}" for b, p in sorted(manifest["buckets"].items()) if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is given."""
        return self._rows(commits.content(self.spark, self._manifest(max(self.versions()) if version is None else version)))

    def _touched(self, manifest: dict, batch: DataFrame) -> set[str]:
        """The buckets of a batch's file keys, if it has any, and of the stored rows with its ids. Reads no more than two columns."""
        own = batch.select(bucket_of(file_key(), self.buckets).alias("b")) if "file_name" in batch.columns else None
        stored = self._rows(manifest).join(batch.select("id").distinct(), "id", "left_semi").select(bucket_of(file_key(), self.buckets).alias("b"))
        return {str(r["b"]) for r in (own.union(stored) if own is not None else stored).distinct().collect()}

    def change(self, batch: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Replace the rows of the touched buckets by apply(their rows, batch) and commit. Returns the new version."""
        version = max(self.versions())
        made: dict[str, str] | None = None
        touched: set[str] = set()
        for _ in range(self.tries):
            manifest = commits.content(self.spark, self._manifest(version))
            if made is None:
                touched = self._touched(manifest, batch)
                if not touched:
                    return version
                made = self._write(apply(self._rows(manifest, touched), batch))
            buckets = {b: p for b, p in manifest["buckets"].items() if b not in touched} | made
            try:
                self.before_commit(version + 1)
                commits.commit(self.spark, self._manifest(version + 1), {"schema": manifest["schema"], "buckets": buckets})
                return version + 1
            except commits.AlreadyCommitted:
                newest = max(self.versions())
                now = commits.content(self.spark, self._manifest(newest))["buckets"]
                changed = {b for b in {*now, *manifest["buckets"]} if now.get(b) != manifest["buckets"].get(b)}
                if changed & touched or self._touched(commits.content(self.spark, self._manifest(newest)), batch) != touched:
                    for p in {p.split("/_bucket=")[0] for p in made.values()}:
                        commits.remove(self.spark, f"{self.path}/{p}")
                    made = None
                version = newest
        raise commits.AlreadyCommitted(f"{self.path}: other writers were faster {self.tries} times")

    def merge(self, batch: DataFrame, now) -> int:
        """merge_results() into the store."""
        return self.change(batch, lambda rows, new: merge_results(rows, new, now))

    def delete(self, ids: DataFrame, deleted: bool = True) -> int:
        """Flag rows as deleted, or not."""
        return self.change(ids, lambda rows, new: set_deleted(rows, new, deleted))

    def drop(self, ids: DataFrame) -> int:
        """Delete rows for good."""
        return self.change(ids, delete_permanently)

    def sweep(self, keep: int = 1) -> None:
        """Forget all but the newest versions, and delete the folders that none of those reads. Not while others write."""
        versions = self.versions()
        used = {p.split("/")[1] for v in versions[-keep:] for p in commits.content(self.spark, self._manifest(v))["buckets"].values()}
        for v in versions[:-keep]:
            commits.remove(self.spark, self._manifest(v))
        for name in commits.folders(self.spark, f"{self.path}/data"):
            if name not in used:
                commits.remove(self.spark, f"{self.path}/data/{name}")
