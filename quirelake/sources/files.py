"""Files as DataFrames: manifests by hash, transcripts, URL lists, usage logs, words, selections of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions.text import safe_slug, strip

PIPELINE_VERSION = "pdf-evidence-v2"
WORD_FIELDS = ("level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text")


def _name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(_name(path), r"\.[^.]*$", "")


def read_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, length, modificationTime, content) of the files of a folder that match; sorted use is the caller's."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


def document_manifests(files: DataFrame) -> DataFrame:
    """Manifest rows of binary files: hash, size, time and an id of slug and hash."""
    digest = F.sha2("content", 256)
    return files.select(
        F.concat(safe_slug(stem(F.col("path")), "document"), F.lit("-"), F.substring(digest, 1, 12)).alias("document_id"),
        F.col("path").alias("source_file"),
        digest.alias("sha256"),
        F.col("length").alias("byte_size"),
        (F.unix_micros("modificationTime") * 1000).alias("modified_ns"),
        F.lit(PIPELINE_VERSION).alias("pipeline_version"),
    )


def url_list(lines: DataFrame) -> DataFrame:
    """(url) of text lines: trimmed, blank ones and comments left out."""
    url = strip(F.col("value"))
    return lines.select(url.alias("url")).where((F.col("url") != "") & ~F.col("url").startswith("#"))


def local_transcripts(files: DataFrame, limit: int | None = None) -> DataFrame:
    """(path, title) of transcript paths in order: text files that aren't originals or logs, without a language suffix."""
    name = _name(F.col("path"))
    kept = files.where(name.endswith(".txt") & ~name.endswith("-orig.txt") & (name != "yt-dlp.log"))
    named = kept.select("path", F.regexp_replace(stem(F.col("path")), r"\.en$", "").alias("title"))
    return named.orderBy("path").limit(limit) if limit is not None else named


def decode_text(content: Column) -> Column:
    """Bytes as text, undecodable ones left out."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """OCR words of tab-separated files, every field as text."""
    schema = ", ".join(f"`{f}` string" for f in WORD_FIELDS)
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").csv(path)


def playlist_videos(entries: DataFrame) -> DataFrame:
    """Videos of flat playlist entries (playlist, position, url, webpage_url, id, title): bare ids become watch links."""
    raw = F.coalesce(F.nullif(F.col("url"), F.lit("")), F.nullif(F.col("webpage_url"), F.lit("")))
    url = F.when(raw.startswith("http"), raw).otherwise(F.concat(F.lit("https://www.youtube.com/watch?v="), raw))
    rows = entries.withColumn("__url", url).where(F.col("__url").isNotNull())
    blank = F.lit("")
    video = F.coalesce(F.nullif(F.col("id"), blank), safe_slug(F.col("__url"), "video"))
    title = F.coalesce(F.nullif(F.col("title"), blank), F.nullif(F.col("id"), blank), F.lit("video"))
    return rows.select(
        F.coalesce(F.nullif(F.col("playlist"), blank), F.lit("playlist")).alias("playlist"),
        "position",
        F.coalesce(F.nullif(F.col("webpage_url"), blank), F.col("__url")).alias("url"),
        title.alias("title"),
        video.alias("video_id"),
        safe_slug(F.concat(title, F.lit("-"), video), "video").alias("slug"),
    )


def newest_subtitle(before: DataFrame, after: DataFrame) -> DataFrame:
    """(video, language, path) of subtitle files (video, language, path, mtime): the newest new one, English before French, else the newest there was."""
    new = after.join(before.select("video", "path"), ["video", "path"], "left_anti")
    rank = F.when(F.col("language") == "en", 0).when(F.col("language") == "fr", 1).otherwise(2)
    first = new.groupBy("video").agg(F.max_by(F.struct("language", "path"), F.struct((-rank).alias("r"), "mtime")).alias("n"))
    old = before.groupBy("video").agg(F.max_by(F.struct("language", "path"), "mtime").alias("o"))
    best = F.coalesce("n", "o")
    return first.join(old, "video", "full_outer").select("video", best["language"].alias("language"), best["path"].alias("path"))


def largest(files: DataFrame, *keys: str) -> DataFrame:
    """The path of the largest file of each group; of equal ones the last by path."""
    return files.groupBy(*keys).agg(F.max_by("path", F.struct("size", "path")).alias("path"))


def source_kind(source: Column, is_folder: Column) -> Column:
    """What a video source is: a local folder, a playlist or one video."""
    listed = F.contains(source, F.lit("playlist")) | F.contains(source, F.lit("list="))
    return F.when(is_folder, "local").when(listed, "playlist").otherwise("video")


def model_rows(spark: SparkSession, config: dict) -> DataFrame:
    """Model settings of a parsed configuration, with their types."""
    rows = [(n, str(m["model"]), int(m["max_input_tokens"]), int(m["max_output_tokens"]), float(m["temperature"])) for n, m in (config.get("models") or {}).items()]
    return spark.createDataFrame(rows, "name string, model string, max_input_tokens int, max_output_tokens int, temperature double")


def typed_models(raw: DataFrame) -> DataFrame:
    """Model settings given as text (name, model, max_input_tokens, max_output_tokens, temperature), with their types; null for what isn't a number."""
    numbers = {c: strip(F.col(c)).try_cast(t) for c, t in (("max_input_tokens", "int"), ("max_output_tokens", "int"), ("temperature", "double"))}
    return raw.withColumns(numbers)


def stale_files(files: DataFrame, days: int, now: Column | None = None) -> DataFrame:
    """Paths of files older than so many days, placeholders left out; deleting them is another step."""
    cutoff = (F.current_timestamp() if now is None else now) - F.make_dt_interval(F.lit(days))
    return files.where((F.col("modificationTime") < cutoff) & (_name(F.col("path")) != ".gitkeep")).select("path")


def video_info(entries: DataFrame) -> DataFrame:
    """(video_id, title, url, slug) of single videos (url, webpage_url, id, title)."""
    blank = F.lit("")
    video = F.coalesce(F.nullif(F.col("id"), blank), safe_slug(F.col("url"), "video"))
    title = F.coalesce(F.nullif(F.col("title"), blank), F.nullif(F.col("id"), blank), F.lit("video"))
    named = entries.select(video.alias("video_id"), title.alias("title"), F.coalesce(F.nullif(F.col("webpage_url"), blank), F.col("url")).alias("url"))
    return named.withColumn("slug", safe_slug(F.concat("title", F.lit("-"), "video_id"), "video"))
