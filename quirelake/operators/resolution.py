"""Human corrections: applied beside what machines read, never over it, and rendered as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that results depend on.
APPROVE, KEEP_BLOCKED = "approve_corrected_structure", "keep_blocked"


def apply_reviews(elements: DataFrame, reviews: DataFrame) -> DataFrame:
    """Elements with valid reviews applied: history kept, an approval made canonical, anything else blocked.

    `elements` has document_sha256, element_id, status, data_digitized, canonical (struct or null) and
    review_history (array); `reviews` one row an element: review_id, decision, reviewed_at, structure,
    page_number, is_table and record (what the history keeps). A review whose id the history holds is refused:
    `refused` is true and nothing changes.
    """
    found = reviews.withColumnsRenamed({c: f"r_{c}" for c in reviews.columns if c not in ("document_sha256", "element_id")})
    rows = elements.join(found, ["document_sha256", "element_id"], "left")
    again = F.coalesce(F.exists("review_history", lambda h: h["review_id"] == F.col("r_review_id")), F.lit(False))
    new = F.col("r_review_id").isNotNull() & ~again
    approved = new & (F.col("r_decision") == APPROVE)
    canonical = F.struct(
        F.lit("human_verified").alias("status"),
        F.lit("explicit_human_review").alias("source"),
        F.col("r_review_id").alias("review_id"),
        F.col("r_reviewed_at").alias("reviewed_at"),
        F.col("r_structure").alias("structure"),
        F.col("r_page_number").alias("page_number"),
    )
    kept = F.when(new, F.when(approved, canonical)).otherwise(F.col("canonical"))
    return rows.withColumns(
        {
            "refused": F.col("r_review_id").isNotNull() & again,
            "review_history": F.when(new, F.array_append("review_history", F.col("r_record"))).otherwise(F.col("review_history")),
            "canonical": kept,
            "status": F.when(approved, "human_verified").when(new, "blocked").otherwise(F.col("status")),
            "data_digitized": F.when(approved, F.col("r_is_table")).otherwise(F.col("data_digitized")),
        }
    ).drop(*[c for c in rows.columns if c.startswith("r_")])


def is_quantitative_table(structure: Column) -> Column:
    """Whether a structure (JSON text) holds a table: a content item with data, or lists of columns and rows."""
    items = F.from_json(F.get_json_object(structure, "$.content"), "array<struct<type:string,data:string>>")
    has = F.coalesce(F.exists(items, lambda i: (i["type"] == "table") & i["data"].startswith("[")), F.lit(False))
    lists = [F.coalesce(F.get_json_object(structure, f"$.{k}").startswith("["), F.lit(False)) for k in ("columns", "rows")]
    return has | (lists[0] & lists[1])


def review_template(elements: DataFrame) -> DataFrame:
    """A review form for each element: pending, so it can't be applied, with the structure that was last read."""
    return elements.select(
        F.lit("1.0").alias("schema_version"),
        F.concat(F.lit("review-"), "element_id").alias("review_id"),
        "document_sha256",
        "element_id",
        F.struct(F.lit("human").alias("type"), F.lit("").alias("name")).alias("reviewer"),
        F.lit("pending").alias("decision"),
        F.coalesce("structure", F.lit("{}")).alias("corrected_structure"),
        F.when(F.col("review_path").isNotNull(), F.array("review_path")).otherwise(F.array().cast("array<string>")).alias("evidence_files"),
        F.lit("").alias("reviewed_at"),
    )


def markdown_cell(value: Column) -> Column:
    return F.replace(F.replace(F.coalesce(value, F.lit("None")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def markdown_table(headers: Column, rows: Column) -> Column:
    """A Markdown table of header and row arrays; short rows are filled up, long ones cut to the headers."""
    width = F.size(headers)

    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def fit(row: Column) -> Column:
        cells = F.transform(row, markdown_cell)
        return F.slice(F.concat(cells, F.array_repeat(F.lit(""), F.greatest(F.lit(0), width - F.size(row)))), F.lit(1), width)

    rule = F.array_repeat(F.lit("---"), width)
    return F.array_join(F.concat(F.array(line(F.transform(headers, markdown_cell)), line(rule)), F.transform(rows, lambda r: line(fit(r)))), "\n")


def render_structure(caption: Column, blocks: Column) -> Column:
    """Markdown of a structure: its caption, then text blocks and tables in order.

    `blocks` is an array of struct<type, text, headers array<string>, data array<array<string>>>.
    """
    head = F.when(F.coalesce(caption, F.lit("")) != "", F.array(F.concat(F.lit("**"), caption, F.lit("**\n")))).otherwise(F.array().cast("array<string>"))

    def one(b: Column) -> Column:
        text = F.when((b["type"] == "text_block") & (b["text"] != ""), F.concat(b["text"], F.lit("\n")))
        return text.when((b["type"] == "table") & (F.size(b["headers"]) > 0), F.concat(markdown_table(b["headers"], b["data"]), F.lit("\n")))

    return F.array_join(F.concat(head, F.array_compact(F.transform(blocks, one))), "\n")


def verified_markdown(elements: DataFrame) -> DataFrame:
    """(document_sha256, markdown): a document's verified elements in order, then those that stay out.

    `elements` has document_sha256, document_id, ordinal, element_id, element_type, status, canonical (review_id,
    page_number) and body (its rendered structure).
    """
    good = (F.col("status") == "human_verified") & F.col("canonical").isNotNull()
    section = F.concat_ws(
        "\n",
        F.concat(F.lit("## "), "element_id"),
        F.lit(""),
        F.concat(F.lit("- Page PDF : "), F.coalesce(F.col("canonical.page_number").cast("string"), F.lit("inconnue"))),
        F.concat(F.lit("- Type : `"), "element_type", F.lit("`")),
        F.concat(F.lit("- Revue : `"), F.col("canonical.review_id"), F.lit("`")),
        F.lit(""),
        F.col("body"),
    )
    out = F.concat(F.lit("- `"), "element_id", F.lit("` — `"), F.coalesce("status", F.lit("unknown")), F.lit("`"))
    marked = elements.withColumn("__section", F.when(good, section)).withColumn("__out", F.when(~good, out))

    def ordered(c: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("ordinal", c)))), lambda x: x[c])

    gathered = marked.groupBy("document_sha256").agg(F.first("document_id").alias("document_id"), ordered("__section").alias("s"), ordered("__out").alias("o"))
    head = F.concat(
        F.lit("# Extraction technique canonique vérifiée\n\n- Document : `"), "document_id", F.lit("`\n- SHA-256 : `"), "document_sha256", F.lit("`\n\n")
    )
    body = F.when(F.size("s") > 0, F.concat(F.array_join("s", "\n\n"), F.lit("\n"))).otherwise("Aucun élément n'a encore été validé humainement.\n")
    rest = F.when(F.size("o") > 0, F.concat(F.lit("\n## Éléments non canoniques\n\n"), F.array_join("o", "\n"), F.lit("\n"))).otherwise("")
    return gathered.select("document_sha256", F.concat(head, body, rest).alias("markdown"))


def fallback_decision(rows: DataFrame) -> DataFrame:
    """Adds evidence_opened, recommended_status and reason of a local visual fallback to (media_available, n_images, n_open) rows."""
    opened = F.col("media_available") & (F.col("n_images") == 2)
    return rows.withColumns(
        {
            "evidence_opened": opened,
            "recommended_status": F.when(opened & (F.col("n_open") == 0), "machine_reviewed").otherwise("human_review_required"),
            "reason": F.when(~opened, "codex_media_unavailable").when(F.col("n_open") > 0, "codex_visual_ambiguity_persists").otherwise("codex_visual_evidence_readable"),
        }
    )
