"""A sink whose batches are there whole or not at all, and once, however often a stream is restarted."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievelake.sources import commits


class LedgerSink:
    """Writes each batch of a stream to a folder of its own and then commits it to a ledger under the batch's number.

    A batch that is run again after a failure finds its number in the ledger and does nothing, or writes a new folder; folders that were never committed are
    not read. Rows of one key merge when read: the row of the latest batch stands.
    """

    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.before_commit: Callable[[int], None] = lambda batch_id: None  #: for tests: called between write and commit

    def _entry(self, batch_id: int) -> str:
        return f"{self.path}/ledger/{batch_id:012d}"

    def put(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch."""
        spark = batch.sparkSession
        if f"{batch_id:012d}" in commits.committed(spark, f"{self.path}/ledger"):
            return
        folder = f"data/{batch_id:012d}-{uuid.uuid4().hex}"
        batch.write.parquet(f"{self.path}/{folder}")
        self.before_commit(batch_id)
        try:
            commits.commit(spark, self._entry(batch_id), {"schema": batch.schema.jsonValue(), "folders": {str(batch_id): folder}})
        except commits.AlreadyCommitted:
            commits.remove(spark, f"{self.path}/{folder}")

    def read(self, spark: SparkSession) -> DataFrame | None:
        """All committed rows, with the number of their batch as batch_id; None if there is no commit yet."""
        entries = [commits.content(spark, f"{self.path}/ledger/{n}") for n in commits.committed(spark, f"{self.path}/ledger")]  # one for each batch
        if not entries:
            return None
        places = [f"{self.path}/{p}" for e in entries for p in e["folders"].values()]
        number = F.regexp_extract(F.input_file_name(), "/data/([0-9]+)-", 1).cast("long")
        return spark.read.schema(StructType.fromJson(entries[0]["schema"])).parquet(*places).withColumn("batch_id", number)

    def latest(self, spark: SparkSession, key: str) -> DataFrame | None:
        """The row of the latest batch for each key."""
        rows = self.read(spark)
        if rows is None:
            return None
        return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc("batch_id")))).where("_n = 1").drop("_n", "batch_id")

    def sweep(self, spark: SparkSession) -> int:
        """Delete the folders that no commit names: attempts that failed. Not while the stream runs. Returns how many there were."""
        used = {p.split("/")[-1] for n in commits.committed(spark, f"{self.path}/ledger") for p in commits.content(spark, f"{self.path}/ledger/{n}")["folders"].values()}
        lost = [n for n in commits.folders(spark, f"{self.path}/data") if n not in used]
        for n in lost:
            commits.remove(spark, f"{self.path}/data/{n}")
        return len(lost)


def run_into(stream: DataFrame, sink: LedgerSink, checkpoint: str, mode: str = "append", transform: Callable[[DataFrame], DataFrame] = lambda b: b):
    """Work off what is there, each batch through transform into the sink, and stop; goes on where the last run ended. Returns the finished query."""
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda b, i: sink.put(transform(b), i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
