"""Commands over whole runs: python -m quirelake COMMAND ...; engines and models are given as module:function."""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions.text import safe_slug
from quirelake.operators import flows, jobs
from quirelake.sources import files, sinks
from quirelake.sources import file_per_row as fpr
from quirelake.sources.staging import staged


def named(place: str) -> Callable:
    """The function that `module:function` names."""
    module, _, function = place.partition(":")
    return getattr(importlib.import_module(module), function)


def documents(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Notes and transcriptions of a folder's files, a file each; engines are tried in the order in which they are given."""
    engines = {name: named(place) for name, _, place in (e.partition("=") for e in args.engine)}
    found = files.read_files(spark, args.folder, args.pattern)
    rows = found.select(
        F.col("path").alias("doc_id"), files.stem(F.col("path")).alias("title"), F.substring_index("path", "/", -1).alias("source_file"), "content", F.array(*map(F.lit, engines)).alias("fallback_order")
    )
    made = staged(flows.run_files(rows, engines, named(args.model), args.instructions, args.deep_limit, args.chunk_limit).withColumn("slug", safe_slug(files.stem(F.col("doc_id")), "document")), "notes")
    fpr.write_files(made, args.out, F.concat("slug", F.lit(".md")), F.col("summary"))
    fpr.write_files(made, args.out, F.concat("slug", F.lit(".transcription.md")), F.col("transcription"))
    return made.groupBy("status").agg(F.count(F.lit(1)).alias("files"))


def videos(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Notes of (url, title, slug, subtitles) rows in JSON lines, and the playlist's manifest; what it has as done isn't done again."""
    rows = spark.read.schema("url string, title string, slug string, subtitles string").json(args.rows)
    place = F.concat(safe_slug(F.concat(F.lit("playlist-"), F.lit(args.playlist)), "playlist"), F.lit("_manifest.json"))
    (wanted,) = spark.range(1).select(place).first()
    before = None
    try:
        before = staged(fpr.load_manifests(spark, f"{args.out.rstrip('/')}/jobs").where(F.col("playlist_title") == args.playlist), "manifest")
    except Exception as missing:  # the first run has no manifest yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    made = staged(flows.run_videos(rows, named(args.model), args.instructions, args.simple_limit, before), "notes")
    fpr.write_files(made, args.out, F.col("output_path"), F.col("summary"))
    fields = [f.split()[0] for f in fpr.VIDEO.split(", ")]
    kept = made.select(*fields, F.lit(1).alias("seq"))
    if before is not None:
        kept = before.select(*fields, F.lit(0).alias("seq")).unionByName(kept)
    latest = kept.groupBy("url").agg(F.max_by(F.struct(*fields[1:]), "seq").alias("v")).select("url", "v.*")
    items = latest.join(rows.select("url", F.monotonically_increasing_id().alias("position")).groupBy("url").agg(F.min("position").alias("position")), "url", "left").withColumn("playlist_title", F.lit(args.playlist))
    fpr.write_files(sinks.manifest_documents(items), f"{args.out.rstrip('/')}/jobs", F.lit(wanted), sinks.sorted_json(F.col("manifest")))
    return jobs.manifest_summary(latest)


def usage(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Requests, tokens and cost of a usage log, and what is left of a budget."""
    return jobs.usage_summary(jobs.read_usage(spark.read.text(args.log)), jobs.budget_usd(F.lit(args.budget)))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quirelake")
    commands = top.add_subparsers(required=True)

    def command(name: str, run: Callable, *places: str) -> argparse.ArgumentParser:
        made = commands.add_parser(name, help=run.__doc__)
        made.set_defaults(run=run)
        for place in places:
            made.add_argument(place)
        return made

    docs = command("documents", documents, "folder", "out")
    docs.add_argument("--pattern", default="*.pdf")
    docs.add_argument("--engine", action="append", required=True, metavar="NAME=MODULE:FUNCTION")
    docs.add_argument("--deep-limit", type=int, default=160_000)
    docs.add_argument("--chunk-limit", type=int, default=100_000)
    vids = command("videos", videos, "rows", "out")
    vids.add_argument("--playlist", required=True)
    vids.add_argument("--simple-limit", type=int, default=100_000)
    for with_model in (docs, vids):
        with_model.add_argument("--model", required=True, metavar="MODULE:FUNCTION")
        with_model.add_argument("--instructions", default="")
    command("usage", usage, "log").add_argument("--budget", default="")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    """Runs a command and shows what it did."""
    args = parser().parse_args(arguments)
    done = args.run(spark or SparkSession.builder.appName("quirelake").getOrCreate(), args)
    done.show(truncate=False)
    return done


if __name__ == "__main__":
    main()
