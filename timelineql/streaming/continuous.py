"""Standing queries over a stream of events: each micro-batch is added to a log, and the persons it touched are asked anew.

A timeline query may look back and forth over all of a person's events, so its answer can only be kept by re-reading the persons whose events have come.
The log is partitioned by a hash of the person: a batch reads only the folders of its own persons' hashes, and of those only its persons, by a semi join
(broadcast while they are few by Spark's own size check). A batch of few persons so reads a small part of the log, however long the log is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..result import Result
from ..sources.eventlog import EventLog

BUCKETS = 256
BUCKET, BATCH = "__bucket", "__batch"


def standing_query(stream: DataFrame, expr: str, log_path: str, sink: Callable[[DataFrame, int], None], config: Config, checkpoint: str, *, available_now: bool = False, buckets: int = BUCKETS) -> StreamingQuery:
    """Starts the query. sink gets (pid, match) of all persons in the batch, and the batch's number. A batch that is replayed after a failure overwrites its own part
    of the log, so events count once. buckets is fixed for the life of a log; events of null ids are kept in the log, and are of no person."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kept = T.StructType([*batch.schema.fields, T.StructField(BUCKET, T.IntegerType()), T.StructField(BATCH, T.LongType())])
        bucket = F.pmod(F.xxhash64(F.col(f"`{config.pid}`")), F.lit(buckets)).cast("int")
        parts = batch.withColumn(BUCKET, bucket).withColumn(BATCH, F.lit(number).cast("long")).repartition(BUCKET)
        parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET, BATCH).parquet(log_path)
        log = spark.read.schema(kept).parquet(log_path)
        mine = log.where(F.col(BATCH) == number).select(config.pid, BUCKET).distinct()
        read = [r[0] for r in mine.select(BUCKET).distinct().collect()]  # at most as many as there are buckets
        history = log.where(F.col(BUCKET).isin(read)).join(mine.select(config.pid), config.pid, "left_semi").select(*batch.columns)
        sink(Result(EventLog(history, config), expr).persons, number)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
