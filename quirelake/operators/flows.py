"""Composed runs: a document from its pages to notes and reviewed elements, a video from its subtitles to a note.

What calls a model or a reader is passed in; every run is one DataFrame for all documents, a failure a row of it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions.text import count_tokens, safe_slug, strip
from quirelake.operators import chunks, detection, jobs, lines, validation
from quirelake.sources import sinks
from quirelake.sources.adapters import call_model, extract_lazily, review_in_order
from quirelake.sources.staging import staged

Model = Callable[[str, str, str], str]
#: Fields of an element that its review is put in order by and its status decided by.
DECIDING = ("doc_id", "page_index", "ordinal", "element_type", "status", "alerts", "has_rows")


def summarize_videos(videos: DataFrame, model: Model, instructions: str, simple_limit: int) -> DataFrame:
    """Adds `summary` (a note with front matter), `model_used` and `error` to (title, url, transcript, ...) rows: one call a video."""
    chosen = chunks.route_video(count_tokens(F.col("transcript")), F.lit(simple_limit))
    asked = call_model(videos.withColumn("text", F.col("transcript")).withColumn("model", chosen), model, instructions)
    note = F.concat(sinks.summary_front_matter(F.col("title"), F.col("url"), "video"), F.lit("\n"), strip(F.col("answer")), F.lit("\n"))
    good = F.col("error").isNull()
    return asked.withColumn("summary", F.when(good, note)).withColumn("model_used", F.when(good, F.col("model"))).drop("text", "model", "answer", "calls")


def run_videos(
    videos: DataFrame, model: Model, instructions: str, simple_limit: int,
    manifest: DataFrame | None = None, outputs: DataFrame | None = None, overwrite: bool = False,
) -> DataFrame:
    """Manifest rows (url, title, status, output_path, kept, error, model_used) and `summary` of (url, title, slug, subtitles) rows.

    Videos that `manifest` has as done are left out; where `outputs` has the note already it is taken as it is.
    Null subtitles are a failure of that video alone.
    """
    todo = jobs.still_to_do(videos, manifest) if manifest is not None else videos
    todo = todo.withColumn("output_path", F.concat(F.lit("output/videos/"), "slug", F.lit(".md")))
    new = todo if outputs is None else jobs.without_output(todo, outputs, overwrite)
    texts = lines.with_subtitle_text(new, "subtitles", "transcript")
    made = summarize_videos(texts.where("transcript IS NOT NULL"), model, instructions, simple_limit)
    lost = texts.where("transcript IS NULL").withColumns({"summary": F.lit(None).cast("string"), "model_used": F.lit(None).cast("string"), "error": F.lit("no subtitles")})
    fields = ["url", "title", "status", "output_path", "kept", "error", "model_used", "summary"]
    done = jobs.isolate(made.unionByName(lost)).select(fields)
    if outputs is None or overwrite:
        return done
    there = todo.join(outputs.select("output_path").distinct(), "output_path", "left_semi")
    nothing = F.lit(None).cast("string")
    kept = there.select("url", "title", F.lit("done").alias("status"), "output_path", F.lit(True).alias("kept"), *[nothing.alias(c) for c in ("error", "model_used", "summary")])
    return done.unionByName(kept)


def playlist_jobs(results: DataFrame, playlist: Column) -> DataFrame:
    """(playlist_title, manifest_path, done, failed, kept) of run_videos() rows with their playlist."""
    named = results.withColumn("playlist_title", playlist)
    path = F.concat(F.lit("cache/jobs/"), safe_slug(F.concat(F.lit("playlist-"), "playlist_title"), "playlist"), F.lit("_manifest.json"))
    return jobs.manifest_summary(named, "playlist_title").select("playlist_title", path.alias("manifest_path"), "done", "failed", "kept")


def summarize_texts(docs: DataFrame, model: Model, instructions: str, deep_limit: int, chunk_limit: int) -> DataFrame:
    """(doc_id, answer, model_used, error) of (doc_id, text) rows: one call within the limit, else one a chunk and one over all answers.

    A chunk's call names its part; a document fails with its first failing call.
    """
    sized = docs.select("doc_id", "text", count_tokens(F.col("text")).alias("n"))
    nothing = F.lit(None).cast("string")
    single = sized.where(F.col("n") <= deep_limit).select("doc_id", "text", F.lit("pdf_deep").alias("model"))
    single = call_model(single, model, instructions).select("doc_id", "answer", F.col("model").alias("model_used"), "error")
    parts = chunks.chunked(sized.where(F.col("n") > deep_limit), chunk_limit)
    of = F.count(F.lit(1)).over(Window.partitionBy("doc_id")).cast("string")
    told = F.concat(F.lit("PARTIE "), (F.col("index") + 1).cast("string"), F.lit("/"), of, F.lit("\n\n"), "text")
    each = call_model(parts.select("doc_id", "index", told.alias("text"), F.lit("pdf_chunk").alias("model")), model, instructions)
    answers = F.transform(F.array_sort(F.collect_list(F.struct("index", "answer"))), lambda a: a["answer"])
    gathered = each.groupBy("doc_id").agg(F.array_join(answers, "\n\n---\n\n").alias("text"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("index"))).alias("__error"))
    last = call_model(gathered.where("__error IS NULL").select("doc_id", "text", F.lit("pdf_final_synthesis").alias("model")), model, instructions)
    merged = last.select("doc_id", "answer", F.lit("pdf_chunk + pdf_final_synthesis").alias("model_used"), "error")
    failed = gathered.where("__error IS NOT NULL").select("doc_id", nothing.alias("answer"), nothing.alias("model_used"), F.col("__error").alias("error"))
    return single.unionByName(merged).unionByName(failed)


def run_documents(docs: DataFrame, model: Model, instructions: str, deep_limit: int, chunk_limit: int) -> DataFrame:
    """(doc_id, status, transcription, summary, export, error) of (doc_id, title, source_file, markdown) rows, one a document.

    `unusable` where the extracted text doesn't do, `summary_unavailable` where a call failed: then the transcription stays,
    the summary says so and nothing is exported. Otherwise `done`. Texts are cleaned once, into a staged table that the calls
    and the transcriptions read.
    """
    fine = F.coalesce(lines.is_usable_markdown(F.col("markdown")), F.lit(False))
    usable = docs.select("doc_id", "title", "source_file", F.when(fine, F.col("markdown")).alias("markdown"))
    clean = staged(usable.select("doc_id", "title", "source_file", lines.clean_markdown(F.col("markdown")).alias("clean")), "clean")
    texts = clean.where("clean IS NOT NULL").select("doc_id", F.col("clean").alias("text"))
    rows = clean.join(summarize_texts(texts, model, instructions, deep_limit, chunk_limit), "doc_id", "left")
    title, source, there = F.col("title"), F.col("source_file"), F.col("clean").isNotNull()
    slug = safe_slug(title, "document")
    paths = [F.concat(F.lit("output/pdfs/"), slug, F.lit(end)) for end in (".transcription.md", ".error.json")]
    good = there & F.col("error").isNull()
    note = F.concat(sinks.summary_front_matter(title, source, "pdf"), F.lit("\n"), strip(F.col("answer")), F.lit("\n"))
    summary = F.when(good, note).when(there, sinks.unavailable_markdown(title, source, *paths))
    status = F.when(~there, "unusable").when(good, "done").otherwise("summary_unavailable")
    made = rows.select("doc_id", status.alias("status"), F.when(there, sinks.transcription_markdown(title, source, F.col("clean"))).alias("transcription"), summary.alias("summary"), "error")
    return made.withColumn("export", F.when(F.col("status") == "done", sinks.without_model_lines(F.col("summary"))))


def run_files(files: DataFrame, engines: dict[str, Callable[[bytes], str]], model: Model, instructions: str, deep_limit: int, chunk_limit: int) -> DataFrame:
    """run_documents() from the files' bytes: (doc_id, title, source_file, content, fallback_order) rows, with `engine` and `attempts`.

    Extraction stops at a file's first usable text and is staged, so no engine runs twice for a file. One call takes any
    number of files: a batch is the table.
    """
    extracted = staged(extract_lazily(files, engines).drop("content"), "extracted")
    return run_documents(extracted, model, instructions, deep_limit, chunk_limit).join(extracted.select("doc_id", "engine", "attempts"), "doc_id")


def run_evidence(blocks: DataFrame, pages: DataFrame, reviewer: Callable[[dict], dict], budget: int = validation.BUDGET, reads: Sequence[str] | None = None) -> DataFrame:
    """Every detected element after its checks and review, with `status_after` and what validation.settled() says of it.

    `reviewer` is called for elements by page and place, at most `budget` times a document and never after a quota error of
    that document (see adapters.review_in_order). `reads` names the fields that it looks at: of an element these and what
    decides its status are dealt by document and kept, without `reads` all.
    """
    found = detection.link_previous_page(detection.detect_elements(blocks, pages))
    checked = validation.with_checks(found.withColumn("has_formula", F.lit(False))).drop("has_formula").withColumn("has_rows", F.col("columns").isNotNull())
    if reads is not None:
        checked = checked.select(*[c for c in checked.columns if c in {*DECIDING, *reads}])
    seen = review_in_order(checked, reviewer, budget)
    answered = F.col("attempted") & F.col("error").isNull()
    return validation.settled(seen.withColumn("reviewed_status", F.when(answered, validation.status_after_review(seen))))
