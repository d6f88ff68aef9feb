from pyspark.sql import functions as F

from quirelake.operators import jobs
from quirelake.sources import sinks
from quirelake.streaming import usage

PRICES = [("a", "1", "2"), ("b", "3", "x")]


def events(spark, start, end):
    return spark.range(start, end).select(
        F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 600), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit(None)), (F.col("id") % 3 + 1).cast("int")).alias("model"),
        F.when(F.col("id") % 5 == 0, "failed").otherwise("success").alias("status"),
        (F.col("id") * 7).alias("input_tokens"),
        F.col("id").alias("output_tokens"),
    )


def rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def test_totals_follow_a_log_over_batches_and_restarts(spark, tmp_path):
    log, totals, state = (f"file://{tmp_path}/{x}" for x in ("log", "totals", "state"))
    prices = spark.createDataFrame(PRICES, "model string, input_per_1m string, output_per_1m string")
    assert usage.usage_so_far(spark, totals).count() == 0
    for start, end in ((0, 40), (40, 90), (90, 100)):
        sinks.append_usage(events(spark, start, end), log)
        usage.follow_usage(usage.usage_stream(spark, log, files_per_batch=3), totals, state, prices).awaitTermination()
        want = jobs.usage_by_model(jobs.cost(jobs.read_usage(spark.read.text(log)), prices))
        assert usage.usage_so_far(spark, totals).columns == want.columns and rows(usage.usage_so_far(spark, totals)) == rows(want)
    usage.follow_usage(usage.usage_stream(spark, log), totals, state, prices).awaitTermination()  # nothing new
    assert rows(usage.usage_so_far(spark, totals)) == rows(want)
    assert len(usage._versions(spark, totals)) == 2


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    totals = f"file://{tmp_path}/totals"
    first, second = (sinks.usage_lines(events(spark, *x)) for x in ((0, 10), (10, 30)))
    usage.merge_batch(jobs.read_usage(first), 0, totals)
    usage.merge_batch(jobs.read_usage(second), 1, totals)
    (tmp_path / "totals/batch-1/_SUCCESS").unlink()  # as if it had been lost half way
    assert rows(usage.usage_so_far(spark, totals)) == rows(jobs.usage_by_model(jobs.read_usage(first)))
    usage.merge_batch(jobs.read_usage(second), 1, totals)
    usage.merge_batch(jobs.read_usage(second), 1, totals)
    assert rows(usage.usage_so_far(spark, totals)) == rows(jobs.usage_by_model(jobs.read_usage(first.union(second))))


def test_hours_of_a_stream_are_those_of_the_table(spark, tmp_path):
    log, out = f"file://{tmp_path}/log", f"file://{tmp_path}/hours"
    for start, end in ((0, 50), (50, 100)):
        sinks.append_usage(events(spark, start, end).coalesce(1), log)
    sinks.append_usage(events(spark, 2000, 2001).withColumn("model", F.lit("end")).unionByName(events(spark, 0, 1).withColumn("timestamp", F.lit("soon"))).coalesce(1), log)
    stream = usage.usage_by_hour(usage.usage_stream(spark, log, files_per_batch=1))
    stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    want = usage.usage_by_hour(jobs.read_usage(spark.read.text(log))).where("model <> 'end'")
    assert rows(spark.read.parquet(out)) == rows(want) and want.count() > 30
