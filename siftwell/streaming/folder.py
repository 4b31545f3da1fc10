"""Files of a folder loaded as they arrive, each content once, by the same plan as the batch load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftwell.plans.load import Result, prepare, run_load
from siftwell.plans.store import Store


FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def watch_folder(
    spark: SparkSession, store: Store, definition: dict, checkpoint: str, parameters: dict | None = None,
    available_now: bool = True, unit: str = "auto", on_result=None, force: bool = False,
) -> StreamingQuery:
    """Start the incremental load.

    The file source's checkpoint remembers paths, the run log remembers contents. A batch is published under the name
    of its stream and its number; one that is repeated after a failure finds itself in the store's log and adds nothing.
    `force` loads contents that were loaded before, under other names, again.
    The stream itself only carries the names of the new files, not a byte of their content; the load
    plan reads the rows.
    """
    prepare(store)
    arrivals = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", definition["patron"])
        .load(definition["carpeta"]).select(F.col("path").alias("file")))

    def load(batch: DataFrame, batch_id: int) -> None:
        names = [r["file"] for r in batch.distinct().collect()]  # file names, not rows
        if names:
            results: list[Result] = run_load(batch.sparkSession, store, {**definition, "carpeta": names, "patron": "*"}, parameters, force=force, unit=unit, origin=f"{checkpoint} {batch_id}")
            if on_result:
                on_result(batch_id, results)

    writer = arrivals.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()
