"""Job manifests and model usage: last write wins, resumable work, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions.text import strip


def upsert(items: DataFrame) -> DataFrame:
    """One row a (playlist_title, url): the last write, in the place of the first."""
    values = [c for c in items.columns if c not in ("playlist_title", "url", "seq")]
    last = F.max_by(F.struct(*values), "seq")
    return items.groupBy("playlist_title", "url").agg(F.min("seq").alias("position"), last.alias("__last")).select("playlist_title", "url", "position", *[F.col(f"__last.{c}") for c in values])


def still_to_do(videos: DataFrame, manifest: DataFrame, resume: bool = True) -> DataFrame:
    """Videos without a done row in the manifest; all of them where nothing is resumed."""
    if not resume:
        return videos
    return videos.join(manifest.where("status = 'done'").select("url").distinct(), "url", "left_anti")


def without_output(work: DataFrame, outputs: DataFrame, overwrite: bool = False) -> DataFrame:
    """Work whose output path isn't there yet."""
    return work if overwrite else work.join(outputs.select("output_path").distinct(), "output_path", "left_anti")


def manifest_summary(items: DataFrame, *keys: str) -> DataFrame:
    kept = F.count_if(F.coalesce("kept", F.lit(False)))
    sums = [F.count_if(F.col("status") == s).alias(s) for s in ("done", "failed")]
    return items.groupBy(*keys).agg(*sums, kept.alias("kept"))


def dry_run(videos: DataFrame, limit: int | None = None) -> DataFrame:
    """Manifest rows of a run that does nothing: the first `limit` videos in playlist order."""
    chosen = videos.orderBy("position").limit(limit) if limit is not None else videos
    return chosen.select("url", "title", F.lit("dry-run").alias("status"), F.lit(True).alias("kept"))


def isolate(results: DataFrame) -> DataFrame:
    """Manifest rows of adapter results (url, title, output_path, error, model_used): a failure is a row, never an exception."""
    failed = F.col("error").isNotNull()
    return results.withColumns({"status": F.when(failed, "failed").otherwise("done"), "output_path": F.when(~failed, F.col("output_path")), "kept": ~failed})


def cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds `estimated_cost_usd` at the model's prices a million tokens, to 8 places; null without a valid price."""
    known = prices.select(F.col("model").alias("__m"), F.col("input_per_1m").try_cast("double").alias("__in"), F.col("output_per_1m").try_cast("double").alias("__out"))
    total = F.col("input_tokens") / 1_000_000 * F.col("__in") + F.col("output_tokens") / 1_000_000 * F.col("__out")
    return usage.join(known, F.col("model") == F.col("__m"), "left").withColumn("estimated_cost_usd", F.bround(total, 8)).drop("__m", "__in", "__out")


def budget_usd(setting: Column) -> Column:
    """A positive number, or null."""
    value = strip(setting).try_cast("double")
    return F.when(value > 0, value)


def _sums() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("request_count"),
        F.count_if(F.col("status") == "success").alias("successful_requests"),
        F.count_if(F.col("status") == "failed").alias("failed_requests"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.sum("estimated_cost_usd").alias("estimated_cost_usd"),
    ]


def usage_by_model(usage: DataFrame) -> DataFrame:
    """Per model and, with a null model and `level` 1, over all: requests, tokens and cost, in one pass."""
    return usage.groupingSets([("model",), ()], "model").agg(F.grouping("model").cast("int").alias("level"), *_sums())


def usage_summary(usage: DataFrame, budget: Column) -> DataFrame:
    """One row: counts, tokens, cost, budget and, where both are known, what remains of it."""
    summed = usage.agg(*_sums()).withColumn("budget_usd", budget)
    return summed.withColumn("budget_remaining_usd", F.bround(F.col("budget_usd") - F.col("estimated_cost_usd"), 8))


def read_usage(raw: DataFrame) -> DataFrame:
    """Usage events of JSON lines, with defaults for what a line lacks; blank lines are none."""
    schema = "timestamp string, model string, operation string, input_tokens bigint, output_tokens bigint, max_output_tokens bigint, status string, estimated_cost_usd double, error string"
    parsed = raw.where(strip(F.col("value")) != "").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("e")).select("e.*")
    unknown = {c: F.coalesce(c, F.lit("unknown")) for c in ("model", "operation", "status")}
    return parsed.withColumns(unknown | {c: F.coalesce(c, F.lit(0)) for c in ("input_tokens", "output_tokens")})
