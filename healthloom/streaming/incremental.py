"""Incremental work as Structured Streaming: each micro-batch is linked, or tabulated, and appended."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import mpi, tabulation
from ..plans.linkage import Pass
from ..plans.tables import TableSpec
from ..sources import readers, writers


def link_stream(records: DataFrame, folder: str, passes: list[Pass], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Links each micro-batch of records against the index in folder, then appends it there.

    A batch is linked once: its result is written under the batch's number before any table grows, and read from there when the
    batch is run again after a failure. Rows have hashed ids; a batch run again adds those that are not there yet to each table
    by itself, so a run that ended between two tables, or within one, loses nothing and adds nothing twice.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def one(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        known = readers.index_tables(spark, folder)
        staged = f"{folder}/_linked/{stream}/{n}"
        again = readers.exists(spark, f"{staged}/_SUCCESS")
        if not again:
            fresh = batch.dropDuplicates(["patient_id"]).join(known["patient"].select("patient_id"), "patient_id", "left_anti")
            mpi.link(fresh, known, passes).write.mode("overwrite").parquet(staged)
        writers.append_index(mpi.rows_to_insert(spark.read.parquet(staged)), folder, known if again else None)

    writer = records.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def tabulate_stream(spark: SparkSession, landing: str, table: TableSpec, out: str, checkpoint: str) -> StreamingQuery:
    """Bundles that land in a folder, one a file, tabulated and appended as they come; references are those within a batch."""
    files = spark.readStream.text(landing, wholetext=True)

    def one(batch: DataFrame, n: int) -> None:
        found = batch.selectExpr(f"concat('{n}-', uuid()) AS bundle_id", "try_parse_json(value) AS bundle")
        rows = tabulation.explode_bundles(found)
        writers.write_table(tabulation.drop_invalid(tabulation.tabulate(rows, table), table), out, "parquet")

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
