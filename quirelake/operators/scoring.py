"""Scores of extracted elements against hand-made references, and coverage of the regression cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions.folding import casefold
from quirelake.functions.text import canonical_number, flatten_parts, json_string, number_tokens

# Fixed values that results depend on.
TRUSTED = ("machine_verified", "machine_verified_with_visual_check", "machine_reviewed", "human_verified")
CONSERVATIVE = ("needs_visual_review", "human_review_required", "blocked", "unextractable", "image_only")
REGRESSION_CASES = {
    "G01": "native_text_clean",
    "G02": "scan_clean",
    "G03": "scan_skewed",
    "G04": "low_contrast",
    "G05": "rotated_table",
    "G06": "multi_level_headers",
    "G07": "signed_decimals",
    "G08": "fractions",
    "G09": "formulas",
    "G10": "payoff_diagram",
    "G11": "multi_series_chart",
    "G12": "external_annotations",
    "G13": "page_number_mismatch",
    "G14": "table_continued",
    "G15": "figure_caption_on_previous_page",
    "G16": "gemini_api_failure",
    "G17": "gemini_invalid_json",
    "G18": "gemini_ocr_disagreement",
    "G19": "codex_media_unavailable",
}


def ratio(part: Column, whole: Column) -> Column:
    return F.bround(F.try_divide(part.cast("double"), whole), 6)


def annotation_of(sidecars: DataFrame, annotations: DataFrame) -> DataFrame:
    """(document_id, path): each sidecar's annotation, the first by path of those with its hash."""
    found = annotations.where("source_sha256 <> ''").groupBy("source_sha256").agg(F.min("path").alias("path"))
    return sidecars.join(found, sidecars["sha256"] == found["source_sha256"], "left").select("document_id", "path")


def best_elements(cases: DataFrame, elements: DataFrame) -> DataFrame:
    """Cases with the element that each means, or none.

    Elements of the case's page; an exact id narrows them only where it is there; then type, numbers and text must
    agree where the case names them; the first in element order is taken. `cases` has source, case_id,
    pdf_page_number and want_id, want_type, want_figure, want_table, want_text; `elements` has source,
    pdf_page_number, element_ordinal, element_id, element_type, figure_number, table_number, raw_text, ...
    """
    asked = cases.withColumn("want_text", casefold(F.coalesce("want_text", F.lit(""))))
    pairs = asked.join(elements, ["source", "pdf_page_number"])
    same_id = F.coalesce(F.col("want_id") == F.col("element_id"), F.lit(False))
    exact = F.max(same_id.cast("int")).over(Window.partitionBy("source", "case_id")) == 1

    def wanted(name: str, column: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")).isin("") | F.coalesce(F.col(name) == F.col(column), F.lit(False))

    fits = wanted("want_type", "element_type") & wanted("want_figure", "figure_number") & wanted("want_table", "table_number")
    holds = F.contains(casefold(F.coalesce("raw_text", F.lit(""))), F.col("want_text"))
    chosen = pairs.withColumn("__exact", exact).where((~F.col("__exact") | same_id) & fits & holds)
    kept = [c for c in elements.columns if c not in ("source", "pdf_page_number")]
    best = chosen.groupBy("source", "case_id").agg(F.min_by(F.struct(*kept), "element_ordinal").alias("__e"))
    return cases.join(best, ["source", "case_id"], "left").select(*cases.columns, *[F.col(f"__e.{c}") for c in kept])


def is_correct(kind: Column, expected: Column, aliases: Column, content: Column, digitized: Column) -> Column:
    """Whether a matched element bears out an assertion; null for a kind that isn't known."""
    accepted = F.filter(F.transform(F.concat(F.array(expected), F.coalesce(aliases, F.array().cast("array<string>"))), canonical_number), lambda t: t != "")
    return (
        F.when(kind == "element_present", F.lit(True))
        .when(kind == "data_digitized", digitized.cast("string").eqNullSafe(expected))
        .when(kind == "text_contains", F.contains(casefold(content), casefold(expected)))
        .when(kind == "quantitative_token", F.arrays_overlap(accepted, number_tokens(content)))
    )


def assertion_outcomes(matched: DataFrame, assertions: DataFrame) -> DataFrame:
    """Assertions with `correct` and `classification`, of best_elements() with `content`, and assertions by case.

    A wrong value is dangerous where its element is trusted, or neither marked for review nor alerted.
    """
    rows = matched.join(assertions, ["source", "case_id"])
    right = F.coalesce(is_correct(F.col("kind"), F.col("expected"), F.col("aliases"), F.coalesce("content", F.lit("")), F.col("data_digitized")), F.lit(False))
    trusted = F.col("status").isin(*TRUSTED)
    careful = F.col("status").isin(*CONSERVATIVE) | (F.size(F.coalesce("alerts", F.array().cast("array<string>"))) > 0)
    missing = F.col("element_id").isNull()
    named = (
        F.when(missing, "missing_without_alert")
        .when(right & trusted, "correct_trusted")
        .when(right, "correct_but_unverified")
        .when(trusted | ~careful, "dangerous_accepted_without_alert")
        .otherwise("error_or_omission_alerted")
    )
    return rows.withColumn("correct", right & ~missing).withColumn("classification", named)


def case_statuses(matched: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(source, case_id, case_status): a case without assertions passes once its element is found."""
    seen = outcomes.groupBy("source", "case_id").agg(
        F.count_if(F.col("classification") == "dangerous_accepted_without_alert").alias("d"), F.count_if(F.col("classification") != "correct_trusted").alias("u")
    )
    status = (
        F.when(F.col("element_id").isNull(), "missing_critical_element")
        .when(F.coalesce("d", F.lit(0)) > 0, "fail")
        .when(F.coalesce("u", F.lit(0)) == 0, "pass")
        .otherwise("safe_but_incomplete")
    )
    return matched.join(seen, ["source", "case_id"], "left").select("source", "case_id", status.alias("case_status"))


def golden_report(matched: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row a source: totals, ratios and the status of its reference cases."""
    c = F.col("classification")
    sums = outcomes.groupBy("source").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("correct")).alias("right"),
        F.count_if(c == "correct_trusted").alias("trusted"),
        F.count_if((c == "dangerous_accepted_without_alert") & F.col("quantitative")).alias("dangerous"),
        F.count_if(c == "dangerous_accepted_without_alert").alias("unsafe"),
        F.count_if(c == "error_or_omission_alerted").alias("alerted"),
    )
    critical = F.col("element_id").isNull() & F.coalesce("critical", F.lit(True))
    cases = matched.groupBy("source").agg(F.count(F.lit(1)).alias("cases"), F.count_if(critical).alias("lost"))
    n = {k: F.coalesce(k, F.lit(0)) for k in ("total", "right", "trusted", "dangerous", "unsafe", "alerted", "lost")}
    status = F.when((n["unsafe"] > 0) | (n["lost"] > 0), "fail").when((n["total"] > n["right"]) | (n["trusted"] < n["total"]), "safe_but_incomplete").otherwise("pass")
    return cases.join(sums, "source", "left").select(
        "source",
        F.col("cases").alias("golden_cases_evaluated"),
        n["total"].alias("critical_assertions_total"),
        n["right"].alias("critical_assertions_correct"),
        (n["total"] - n["right"]).alias("critical_assertions_missing_or_wrong"),
        n["trusted"].alias("critical_assertions_trusted"),
        ratio(n["trusted"], n["total"]).alias("trusted_coverage"),
        n["dangerous"].alias("dangerous_quantitative_errors_accepted_without_alert"),
        ratio(n["dangerous"], n["total"]).alias("dangerous_acceptance_rate"),
        n["unsafe"].alias("unsafe_assertions_accepted_without_alert"),
        n["alerted"].alias("alerted_errors_or_omissions"),
        n["lost"].alias("critical_elements_missing_without_alert"),
        status.alias("dangerous_error_metric_status"),
    )


def with_not_applicable(sidecars: DataFrame, reports: DataFrame, reason: Column) -> DataFrame:
    """Every sidecar's report; one that has none says why in its status, with counts of 0 and no ratios."""
    joined = sidecars.select("source").join(reports, "source", "left")
    zero = ("golden_cases_evaluated", "critical_assertions_total", "critical_assertions_correct", "critical_assertions_missing_or_wrong", "critical_assertions_trusted", "alerted_errors_or_omissions", "critical_elements_missing_without_alert")
    filled = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})
    return filled.withColumn("dangerous_error_metric_status", F.coalesce("dangerous_error_metric_status", F.concat(F.lit("not_applicable_"), reason)))


def regression_errors(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(error, id) of every way in which observed cases miss the expected ones.

    `expected` has id, difficulty; `observed` has row_no, id, difficulty, status, tests. Of repeated ids the last row counts.
    """
    named = observed.where(F.col("id").isNotNull())
    last = named.groupBy("id").agg(F.max_by(F.struct("difficulty", "status", "tests"), "row_no").alias("o"), F.count(F.lit(1)).alias("n"))
    both = expected.withColumn("__e", F.lit(True)).withColumnRenamed("difficulty", "wanted").join(last, "id", "full_outer")
    seen, due = F.col("n").isNotNull(), F.coalesce("__e", F.lit(False))
    no_tests = F.coalesce(F.size("o.tests") < 1, F.lit(True)) | F.coalesce(F.exists("o.tests", lambda t: t.isNull()), F.lit(False))
    found = F.concat(
        F.when(F.col("n") > 1, F.array_repeat(F.lit("duplicate_case"), (F.col("n") - 1).cast("int"))).otherwise(F.array().cast("array<string>")),
        F.array_compact(
            F.array(
                F.when(due & ~seen, "missing_case"),
                F.when(due & seen & ~F.col("o.difficulty").eqNullSafe(F.col("wanted")), "difficulty_mismatch"),
                F.when(due & seen & ~F.col("o.status").eqNullSafe(F.lit("covered")), "not_covered"),
                F.when(due & seen & no_tests, "missing_tests"),
                F.when(~due, "unexpected_case"),
            )
        ),
    )
    invalid = observed.where(F.col("id").isNull()).select(F.lit("invalid_case_row").alias("error"), F.lit(None).cast("string").alias("id"))
    return both.select(F.explode(found).alias("error"), "id").unionByName(invalid)


def regression_report(expected: DataFrame, observed: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: cases expected, covered (no error names them), with real annotations, and pass or fail."""
    clean = expected.join(errors.select("id").distinct(), "id", "left_anti").agg(F.count(F.lit(1)).alias("cases_covered"))
    real = observed.where(F.col("id").isNotNull()).groupBy("id").agg(F.max_by("real_annotations", "row_no").alias("r"))
    sums = [
        expected.agg(F.count(F.lit(1)).alias("cases_expected")),
        real.agg(F.count_if(F.size("r") > 0).alias("real_cases")),
        errors.agg(F.count(F.lit(1)).alias("errors")),
    ]
    row = clean
    for one in sums:
        row = row.withColumn("__k", F.lit(1)).join(one.withColumn("__k", F.lit(1)), "__k").drop("__k")  # one row each
    return row.select(
        F.when(F.col("errors") == 0, "pass").otherwise("fail").alias("status"),
        "cases_expected",
        "cases_covered",
        ratio(F.col("cases_covered"), F.col("cases_expected")).alias("synthetic_regression_coverage"),
        "real_cases",
        ratio(F.col("real_cases"), F.col("cases_expected")).alias("real_source_coverage"),
        "errors",
    )


def status_counts(elements: DataFrame, attempts: Column | None = None) -> DataFrame:
    """(doc_id, statuses, elements, deferred): elements by status; those no review was tried on, all without `attempts`."""
    counts = elements.groupBy("doc_id", "status").agg(F.count(F.lit(1)).alias("n"), *([F.max(attempts).alias("tried")] if attempts is not None else []))
    total = F.sum("n")
    deferred = F.greatest(F.lit(0), total - F.max("tried")) if attempts is not None else total
    statuses = F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n"))))
    return counts.groupBy("doc_id").agg(statuses.alias("statuses"), total.alias("elements"), deferred.alias("deferred"))


def content_text(elements: DataFrame) -> Column:
    """What an element is scored by: of a human-verified one the canonical structure alone, else all that was read; never ids or page numbers.

    `elements` has status, canonical_structure, raw_text, candidate and visual_review, all but raw_text as JSON texts.
    """
    read = flatten_parts(json_string(F.col("raw_text")), F.col("candidate"), F.col("visual_review"))
    verified = (F.col("status") == "human_verified") & F.col("canonical_structure").isNotNull()
    return F.when(verified, flatten_parts(F.when(verified, F.col("canonical_structure")))).otherwise(read)
