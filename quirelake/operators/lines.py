"""Cleaning of page and subtitle texts, line by line, and what depends on a text's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions.patterns import is_cue
from quirelake.functions.text import inline_text, let, rstrip, split_lines, strip

# Fixed values that results depend on.
HEADER_LENGTH, HEADER_TIMES = 80, 4
MARKER = r"(?iU)^\s*(page\s+\d+|\d+\s*/\s*\d+)\s*$"
USABLE_LENGTH, BLOCK_LENGTH, BLOCKS = 200, 80, 3
OCR_BELOW = 120


def is_page_marker(line: Column) -> Column:
    """`Page 7` or `7 / 12` alone on a line."""
    return F.regexp_like(line, F.lit(MARKER))


def _lines_of(text: Column) -> Column:
    """The lines of a text: without white space at the end (`line`) and stripped (`s`)."""
    unified = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    source = let(unified, lambda t: F.when(F.contains(t, F.lit("\n" * 4)), F.regexp_replace(t, r"\n{4,}", "\n\n\n")).otherwise(t))
    return F.transform(split_lines(source), lambda x: F.struct(rstrip(x).alias("line"), strip(x).alias("s")))


def _header_lines(lines: Column) -> Column:
    """Running headers with the places they stand at (s, i), in order.

    Headers are short lines that a text repeats often enough; headings, tables and lists never are. In sorted order the
    lines of such a run have, within its length, one that many places further on that is equal.
    """
    placed = F.transform(lines, lambda x, i: F.struct(x["s"].alias("s"), i.alias("i")))
    short = F.filter(placed, lambda x: (x["s"] != "") & (F.char_length(x["s"]) <= HEADER_LENGTH) & ~F.regexp_like(x["s"], F.lit(r"^[#|*\-]")))

    def repeated(run: Column) -> Column:
        def at(place: Column) -> Column:
            return F.when(place >= 0, F.get(run, place)["s"])

        def often(x: Column, j: Column) -> Column:
            found = F.lit(False)
            for k in range(HEADER_TIMES):
                found = found | F.coalesce((at(j - k) == x["s"]) & (at(j - k + HEADER_TIMES - 1) == x["s"]), F.lit(False))
            return F.when(found, x)

        return F.when(F.size(run) >= HEADER_TIMES, F.array_compact(F.transform(run, often))).otherwise(F.slice(run, F.lit(1), F.lit(0)))

    return let(F.array_sort(short), repeated)


def running_headers(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, header): each text's running headers."""
    heads = _header_lines(_lines_of(F.col(f"`{text}`")))
    return docs.select("doc_id", F.explode(F.array_distinct(heads["s"])).alias("header")).distinct()


def clean_markdown(text: Column) -> Column:
    """A page text without running headers, page markers, repeated lines and runs of blank lines; null stays null.

    A line repeats where its stripped text is that of the last line before it that isn't blank. Each step is named once in
    the next (`let`), so the expression is as long wherever it is put: a filter on it costs one more evaluation. Lines
    are told apart by place, in time proportional to a text's lines but for one sort of the short ones.
    """

    def without(rows: Column, places: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(rows) - 1), places)
        return F.when((F.size(places) == 0) | (F.size(rows) == 0), rows).otherwise(F.transform(kept, lambda i: F.get(rows, i)))

    def first_of_each(rows: Column) -> Column:
        full = F.filter(F.transform(rows, lambda x, i: F.struct(i.alias("i"), x["s"].alias("s"))), lambda x: x["s"] != "")
        again = let(full, lambda f: F.array_compact(F.transform(f, lambda x, j: F.when((j > 0) & (F.get(f, F.greatest(j - 1, F.lit(0)))["s"] == x["s"]), x["i"]))))
        return let(again, lambda places: without(rows, places))

    def unmarked(rows: Column) -> Column:
        markers = F.array_compact(F.transform(rows, lambda x, i: F.when(is_page_marker(x["line"]), i)))
        return let(F.concat(_header_lines(rows)["i"], markers), lambda places: without(rows, places))

    lines = let(let(_lines_of(text), unmarked), first_of_each)
    body = strip(F.regexp_replace(F.array_join(lines["line"], "\n"), r"\n{3,}", "\n\n"))
    return let(body, lambda b: F.when(b == "", b).otherwise(F.concat(b, F.lit("\n"))))


def with_clean_markdown(docs: DataFrame, text: str = "text", clean: str = "clean") -> DataFrame:
    """Adds clean_markdown() of a text; every row is worked off by itself, whatever its id."""
    return docs.withColumn(clean, clean_markdown(F.col(f"`{text}`")))


def with_subtitle_text(docs: DataFrame, text: str = "text", clean: str = "clean") -> DataFrame:
    """Adds what is said in an SRT or WebVTT text: no cue numbers, timings, notes, tags or repeated lines."""
    lines = F.transform(split_lines(F.col(text)), strip)
    drop = r"(?U)^$|^\d+$|^(?i:WEBVTT)$|^(?:NOTE|STYLE|REGION)"
    said = F.filter(lines, lambda x: ~F.regexp_like(x, F.lit(drop)) & ~is_cue(x))
    # entities need Python, which takes whole columns: one text with its line breaks goes through it
    numbered = docs.withColumn("__said", F.array_join(F.transform(said, lambda x: F.regexp_replace(x, "<[^>]+>", "")), "\n"))
    from quirelake.functions.text import squeeze, unescape_entities

    plain = F.transform(F.split(unescape_entities(F.col("__said")), "\n"), lambda x: squeeze(strip(x)))
    staged = numbered.withColumn("__plain", F.filter(plain, lambda x: x != ""))
    shifted = F.concat(F.array(F.lit(None).cast("string")), "__plain")
    kept = F.array_compact(F.zip_with("__plain", F.slice(shifted, F.lit(1), F.size("__plain")), lambda x, b: F.when(b.isNull() | (x != b), x)))
    joined = F.array_join(kept, "\n")
    return staged.withColumn(clean, F.when(joined == "", F.lit("")).otherwise(F.concat(joined, F.lit("\n")))).drop("__said", "__plain")


def is_usable_markdown(text: Column) -> Column:
    """Long enough, and with a heading line or some long paragraphs."""
    body = strip(text)
    headings = F.exists(split_lines(body), lambda x: x.startswith("#"))
    paragraphs = F.size(F.filter(F.split(body, "\n\n"), lambda x: F.char_length(strip(x)) > BLOCK_LENGTH))
    return (F.char_length(body) >= USABLE_LENGTH) & (headings | (paragraphs >= BLOCKS))


def pages_needing_ocr(blocks: DataFrame, least: int = OCR_BELOW) -> DataFrame:
    """(doc_id, page_index, native_chars, needs_ocr): pages whose text blocks hold fewer characters than `least`."""
    texts = F.array_sort(F.collect_list(F.when(F.col("block_type") == 0, F.struct("block_ordinal", F.coalesce("text", F.lit("")).alias("t")))))
    joined = blocks.groupBy("doc_id", "page_index").agg(F.array_join(F.transform(texts, lambda b: b["t"]), "").alias("__text"))
    chars = F.char_length(strip(F.col("__text")))
    return joined.select("doc_id", "page_index", chars.alias("native_chars"), (chars < least).alias("needs_ocr"))


def plain_html(text: Column) -> Column:
    return inline_text(text)
