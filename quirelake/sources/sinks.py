"""What is written: Markdown notes, sidecars, quality reports, packets; as columns, for any writer."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.functions.text import safe_slug, strip

# Fixed values that results depend on.
UNKNOWN = "non précisé"
REVIEW_INSTRUCTION = "Look at the files of this packet, say in a review file of its own what differs from the transcription or can be read in more than one way, and leave the transcription as it is."


def single_quoted(value: Column) -> Column:
    return F.replace(value, F.lit('"'), F.lit("'"))


def escaped(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def _front(*lines: Column | str) -> Column:
    return F.concat(*[part for line in ("---", *lines, "---") for part in (F.lit(line) if isinstance(line, str) else line, F.lit("\n"))])


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'{name}: "'), value, F.lit('"'))


def transcription_markdown(title: Column, source_file: Column, cleaned: Column) -> Column:
    head = _front(_field("title", single_quoted(title)), _field("source_file", single_quoted(source_file)), "artifact_type: technical_pdf_transcription", "status: extracted_to_review")
    return F.concat(head, F.lit("\n"), strip(cleaned), F.lit("\n"))


def summary_front_matter(title: Column, source: Column, kind: str) -> Column:
    """Front matter of a summary; kind is video or pdf."""
    if kind == "video":
        lines = (_field("url", escaped(source)), *[f'{k}: "{UNKNOWN}"' for k in ("content_value", "technical_level", "bullshit_risk")])
        tags: tuple[str, ...] = ("  - video",)
    else:
        lines = (_field("source_file", escaped(source)), *[f'{k}: "{UNKNOWN}"' for k in ("domain", "technical_level", "content_value", "bullshit_risk")])
        tags = ("  - pdf", "  - livre")
    origin = "youtube" if kind == "video" else "pdf"
    return _front(_field("title", escaped(title)), f'source_type: "{origin}"', *lines, "graphipy_ready: true", "tags:", *tags)


def without_model_lines(markdown: Column) -> Column:
    return F.regexp_replace(markdown, r"(?m)^model_used:.*\n", "")


def unavailable_markdown(title: Column, source_file: Column, transcription: Column, report: Column) -> Column:
    """The note that stands in for a summary that couldn't be made."""
    head = _front(_field("title", single_quoted(title)), _field("source_file", single_quoted(source_file)), "artifact_type: technical_pdf_summary", "status: summary_unavailable")
    said = F.lit("\n# Synthèse distante indisponible\n\n")
    return F.concat(head, said, F.lit("- Transcription : `"), transcription, F.lit("`\n- Rapport d'erreur : `"), report, F.lit("`\n"))


def error_report(error_type: Column, error: Column, transcription: Column, summary: Column) -> Column:
    message = F.substring(F.replace(error, F.lit("\x00"), F.lit("")), 1, 2000)
    fields = (F.lit("1.0").alias("schema_version"), F.lit("summary_unavailable").alias("status"), error_type.alias("error_type"), message.alias("error"), transcription.alias("transcription_path"), summary.alias("summary_path"))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def shell_quoted(value: Column) -> Column:
    """As the shell takes it literally; plain words stay bare."""
    plain = F.regexp_like(value, F.lit(r"^[A-Za-z0-9@%+=:,./_-]+$"))
    return F.when(plain, value).otherwise(F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))


def inspection_command(pdf_path: Column, page_number: Column, element_id: Column) -> Column:
    return F.concat(
        F.lit("./pdf-evidence inspect "), shell_quoted(pdf_path), F.lit(" --pdf-page "), page_number.cast("string"), F.lit(" --element-id "), shell_quoted(element_id), F.lit(" --dpi 450 --include-context --open-images")
    )


def sidecars(manifests: DataFrame, elements: DataFrame) -> DataFrame:
    """One row a document: its manifest and its elements in order, for a JSON writer."""
    values = [c for c in elements.columns if c not in ("document_id", "page_index", "ordinal")]
    order = ("page_index", "ordinal")
    nested = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*values).alias("e")))), lambda x: x["e"])
    grouped = elements.groupBy("document_id").agg(nested.alias("elements"))
    columns = [c for c in manifests.columns if c != "pages_analyzed"]
    return manifests.join(grouped, "document_id", "left").select(
        F.lit("2.0").alias("schema_version"), F.struct(*columns).alias("manifest"), "pages_analyzed", F.coalesce("elements", F.array().cast(dict(grouped.dtypes)["elements"])).alias("elements")
    )


def quality_reports(manifests: DataFrame, reviewed: DataFrame, budget: int) -> DataFrame:
    """One row a document of review_budget() elements: attempts, failures, circuit, statuses and what was deferred."""
    by_status = reviewed.groupBy("document_id", F.col("status_after").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    statuses = by_status.groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("status_counts"))
    failed = F.col("attempted") & F.col("error").isNotNull()
    sums = reviewed.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("elements_detected"),
        F.count_if("attempted").alias("gemini_review_attempts"),
        F.count_if(F.col("attempted") & ~failed).alias("gemini_successes"),
        F.count_if(failed).alias("gemini_failures"),
        F.bool_or("circuit_open").alias("gemini_circuit_open"),
        F.count_if(F.col("fallback_reason").isNotNull()).alias("fallback_requests"),
    )
    zero = ("elements_detected", "gemini_review_attempts", "gemini_successes", "gemini_failures", "fallback_requests")
    joined = manifests.join(sums, "document_id", "left").join(statuses, "document_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})
    return joined.withColumns(
        {
            "visual_review_budget": F.lit(budget),
            "visual_review_deferred": F.greatest(F.lit(0), F.col("elements_detected") - F.col("gemini_review_attempts")),
            "gemini_circuit_open": F.coalesce("gemini_circuit_open", F.lit(False)),
        }
    )


def resolved_paths(path: Column) -> Column:
    """Where a resolved sidecar and its verified Markdown go: beside the sidecar, never over it."""
    mark = r"\.sidecar\.json$"
    marked = F.regexp_like(path, F.lit(mark))
    base = F.when(marked, F.regexp_replace(path, mark, "")).otherwise(F.regexp_replace(path, r"\.[^./]*$", ""))
    side = F.when(marked, F.concat(base, F.lit(".resolved.sidecar.json"))).otherwise(F.concat(base, F.lit(".resolved.json")))
    return F.struct(side.alias("sidecar"), F.concat(base, F.lit(".verified.md")).alias("markdown"))


def is_inside(path: Column, folder: Column) -> Column:
    """Whether a normal path is the folder or below it; paths with parent steps are not."""
    return ((path == folder) | path.startswith(F.concat(F.rtrim(folder, F.lit("/")), F.lit("/")))) & ~F.regexp_like(path, F.lit(r"(^|/)\.\.(/|$)"))


def context_pages(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, element_id, page_index): the pages before and after an element that asks for its context, where they exist."""
    wanted = elements.where("include_context").select("doc_id", "element_id", F.explode(F.array(F.col("page_index") - 1, F.col("page_index") + 1)).alias("page_index"))
    return wanted.join(pages.select("doc_id", "page_index"), ["doc_id", "page_index"]).select("doc_id", "element_id", "page_index")


@F.pandas_udf(T.StringType())
def sorted_json(text: pd.Series) -> pd.Series:
    """A JSON text as it is stored: keys in order, two blanks a level, a line feed at the end; null for what isn't JSON."""

    def stored(t: str) -> str | None:
        try:
            return json.dumps(json.loads(t), ensure_ascii=False, indent=2, sort_keys=True) + "\n"
        except ValueError:
            return None

    return text.map(stored, na_action="ignore")


def write_json(rows: DataFrame, path: str, value: str = "value") -> None:
    """Writes JSON texts, each in its stored form, into part files; one appears only when the job commits. A file for each text: file_per_row."""
    rows.where(F.col(value).isNotNull()).select(F.rtrim(sorted_json(F.col(value)), F.lit("\n"))).write.mode("overwrite").text(path)  # the writer ends each with a line feed


def cached_path(source: Column, folder: str, suffix: str = ".md") -> Column:
    """Where the text of a source file is kept: in the folder, under the slug of its name."""
    name = F.regexp_replace(F.substring_index(source, "/", -1), r"\.[^.]*$", "")
    return F.concat(F.lit(folder.rstrip("/") + "/"), safe_slug(name, "document"), F.lit(suffix))


def manifest_documents(items: DataFrame) -> DataFrame:
    """(playlist_title, manifest) of jobs.upsert() rows: a playlist's rows in their places, as one JSON text to write."""
    values = [c for c in items.columns if c not in ("playlist_title", "position")]
    held = F.array_sort(F.collect_list(F.struct("position", F.struct(*values).alias("v"))))
    grouped = items.groupBy("playlist_title").agg(F.transform(held, lambda x: x["v"]).alias("videos"))
    return grouped.select("playlist_title", F.to_json(F.struct("playlist_title", "videos"), {"ignoreNullFields": "false"}).alias("manifest"))


def usage_lines(events: DataFrame) -> DataFrame:
    """(value): a JSON line for each usage event."""
    return events.select(F.to_json(F.struct(*events.columns), {"ignoreNullFields": "false"}).alias("value"))


def append_usage(events: DataFrame, path: str) -> None:
    """Adds events to a usage log."""
    usage_lines(events).write.mode("append").text(path)


def fallback_requests(elements: DataFrame) -> DataFrame:
    """(element_id, request) of (packet, pdf_path, pdf_page_number, element_id, status, fallback_reason) rows: what is handed on to a visual reviewer."""
    files = {"full_page": "full_page_original.png", "normalized_crop": "element_crop_normalized.png", "ocr": "ocr_text.txt", "candidate": "extraction_candidate.json"}
    request = F.struct(
        F.lit("1.0").alias("schema_version"),
        "element_id",
        F.col("fallback_reason").alias("reason"),
        F.col("status").alias("recommended_status"),
        F.struct(*[F.concat("packet", F.lit(f"/{name}")).alias(key) for key, name in files.items()]).alias("evidence_files"),
        inspection_command(F.col("pdf_path"), F.col("pdf_page_number"), F.col("element_id")).alias("inspection_command"),
        F.lit(REVIEW_INSTRUCTION).alias("codex_instruction"),
    )
    return elements.where("fallback_reason IS NOT NULL").select("element_id", F.to_json(request).alias("request"))
