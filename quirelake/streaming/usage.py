"""Usage logs as streams: totals that follow a log as it grows, and totals by the hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quirelake.operators import jobs

SUMS = ("request_count", "successful_requests", "failed_requests", "input_tokens", "output_tokens", "estimated_cost_usd")
TOTALS = "model string, request_count bigint, successful_requests bigint, failed_requests bigint, input_tokens bigint, output_tokens bigint, estimated_cost_usd double"


def usage_stream(spark: SparkSession, log: str, files_per_batch: int = 1000) -> DataFrame:
    """The events of a usage log's files, as they come in."""
    return jobs.read_usage(spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).text(log))


def _versions(spark: SparkSession, totals: str) -> dict[int, str]:
    """Complete totals by the batch that wrote them; there are two or three."""
    root = spark._jvm.org.apache.hadoop.fs.Path(totals)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return {}
    names = [s.getPath().getName() for s in system.listStatus(root)]
    done = [n for n in names if n.startswith("batch-") and system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{totals}/{n}/_SUCCESS"))]
    return {int(n.removeprefix("batch-")): f"{totals}/{n}" for n in done}


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def merge_batch(events: DataFrame, number: int, totals: str) -> None:
    """Writes the totals up to batch `number`: those before it and the batch's events, a row a model.

    They are a folder of their own, made from the last complete one of an earlier batch, which stays until the next
    batch is done. So a batch that runs again after a failure replaces what it wrote and counts once.
    """
    spark = events.sparkSession
    before = {n: path for n, path in _versions(spark, totals).items() if n < number}
    new = jobs.usage_by_model(events).where("level = 0").drop("level")
    if before:
        new = new.unionByName(spark.read.schema(TOTALS).parquet(before[max(before)]))
    merged = new.groupBy("model").agg(*[F.sum(c).alias(c) for c in SUMS])
    merged.write.mode("overwrite").parquet(f"{totals}/batch-{number}")
    for n, path in before.items():
        if n < max(before):
            _delete(spark, path)


def follow_usage(events: DataFrame, totals: str, checkpoint: str, prices: DataFrame | None = None, every: str | None = None) -> StreamingQuery:
    """Keeps `totals` up to date with a stream of usage_stream(); with `prices` events cost what these say, else what they say themselves.

    No event is late: totals have no windows, so nothing is kept as state and nothing dropped. Runs through what is
    there and ends, or goes on at intervals of `every`. The checkpoint says which files have been counted.
    """

    def merge(batch: DataFrame, number: int) -> None:
        merge_batch(batch if prices is None else jobs.cost(batch, prices), number, totals)

    writer = events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def usage_so_far(spark: SparkSession, totals: str) -> DataFrame:
    """jobs.usage_by_model() of all events counted so far; no rows without any."""
    known = _versions(spark, totals)
    rows = spark.read.schema(TOTALS).parquet(known[max(known)]) if known else spark.createDataFrame([], TOTALS)
    sums = [F.sum(c).alias(c) for c in SUMS]
    return rows.groupingSets([("model",), ()], "model").agg(F.grouping("model").cast("int").alias("level"), *sums)


def usage_by_hour(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(hour, model, requests, tokens) of events with a readable timestamp, a table's or a stream's.

    Of a stream an hour is told once events `late` after its end have come; events of hours told already are left out then,
    and what is kept as state is the open hours. A table's hours are all told.
    """
    timed = events.withColumn("__at", F.try_to_timestamp("timestamp")).where("__at IS NOT NULL").withWatermark("__at", late)
    sums = timed.groupBy(F.window("__at", "1 hour").alias("__hour"), "model").agg(
        F.count(F.lit(1)).alias("request_count"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")
    )
    return sums.select(F.col("__hour.start").alias("hour"), "model", "request_count", "input_tokens", "output_tokens")
