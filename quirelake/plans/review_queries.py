"""Queries over checks, reviews, scores, corrections, jobs and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelake.operators import jobs, resolution, scoring, validation
from quirelake.plans.fixtures import duck, fixture
from quirelake.sources import files, sinks
from quirelake.sources.staging import fresh_folder
from quirelake.streaming import usage


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v4_failed_products(spark, sf_dir):
    rows = fixture(spark, sf_dir, "products")
    return rows.groupBy("l_orderkey").agg(F.sum(validation.failed_products(F.col("text"))).alias("failed"))


V4_SQL = f"""
WITH p AS ({duck("products")}) SELECT l_orderkey, sum((l_orderkey % 7 = 0 AND (q * d + 3) % 10 <> 0)::INT)::BIGINT AS failed FROM p GROUP BY 1"""


def _key():
    """What decides about an event: its value in hundredths and the number in its JSON."""
    return F.round(F.col("value") * 100).cast("long") * 100 + F.get_json_object("props", "$.k").cast("long")


_KEYED = "(SELECT *, round(value * 100)::BIGINT * 100 + (props->>'k')::BIGINT AS k FROM events)"


def _reviewed(spark, sf_dir):
    """An element and its review for each event."""
    e = _t(spark, sf_dir, "events").withColumn("k", _key())
    k = F.col("k")
    kind = F.element_at(F.array(*map(F.lit, ("table", "formula", "figure", "chart", "payoff_diagram"))), (k % 5 + 1).cast("int"))
    none = F.array().cast("array<string>")
    said = F.struct(F.when(k % 13 == 0, F.lit("Column 2")).otherwise(F.lit("cell")).alias("location"), F.lit("1,5").alias("ocr_value"), F.when(k % 11 == 0, F.lit("-1.5")).otherwise(F.lit("1.5")).alias("preferred_candidate"))
    return e.select(
        "event_id",
        "user_id",
        "k",
        kind.alias("element_type"),
        F.when(k % 17 == 0, "blocked").otherwise("needs_visual_review").alias("status"),
        F.when(k % 19 == 0, F.array(F.lit("scan_skew_detected"))).otherwise(none).alias("alerts"),
        (k % 23 != 0).alias("media_readable"),
        F.when(k % 29 == 0, F.lit("text")).otherwise(kind).alias("observed_type"),
        F.when(k % 31 == 0, "blocked").when(k % 37 == 0, "human_review_required").when(k % 41 == 0, "needs_visual_review").otherwise("machine_verified_with_visual_check").alias("recommended_status"),
        F.when(k % 7 == 0, F.array(said)).otherwise(F.array().cast("array<struct<location:string,ocr_value:string,preferred_candidate:string>>")).alias("disagreements"),
        (k % 43 == 0).cast("int").alias("n_ambiguous"),
        F.lit(0).alias("n_missing"),
        F.when(k % 3 == 0, F.lit(0.95)).when(k % 47 == 0, F.lit(0.9)).alias("numeric_confidence"),
        F.when(k % 2 == 0, F.lit(0.9)).when(k % 53 == 0, F.lit(0.89)).alias("structure_confidence"),
        F.lit(None).cast("double").alias("formula_confidence"),
        (k % 59 != 0).alias("has_rows"),
        (k % 61 != 0).alias("has_formula"),
    )


_STATUS = """CASE WHEN k % 17 = 0 THEN 'blocked' WHEN k % 23 = 0 THEN 'human_review_required' WHEN k % 29 = 0 OR k % 19 = 0 THEN 'needs_visual_review' WHEN k % 31 = 0 THEN 'blocked'
    WHEN k % 37 = 0 THEN 'human_review_required' WHEN k % 5 >= 2 THEN 'image_only' WHEN k % 7 = 0 AND (k % 13 = 0 OR k % 11 = 0) THEN 'blocked'
    WHEN k % 7 = 0 OR k % 43 = 0 OR k % 41 = 0 THEN 'needs_visual_review' WHEN k % 3 <> 0 AND k % 47 = 0 THEN 'needs_visual_review' WHEN k % 2 <> 0 AND k % 53 = 0 THEN 'needs_visual_review'
    WHEN k % 5 = 0 AND k % 59 = 0 THEN 'needs_visual_review' WHEN k % 5 = 1 AND k % 61 = 0 THEN 'needs_visual_review' ELSE 'machine_verified_with_visual_check' END"""


def v2_status_after_review(spark, sf_dir):
    rows = _reviewed(spark, sf_dir)
    return rows.select("event_id", validation.status_after_review(rows).alias("status_after"))


def v1_review_violations(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").withColumn("k", _key())
    k = F.col("k")
    odd = [
        (k % 7 == 1, '"media_readable":true', '"media_readable":"yes"'),
        (k % 7 == 2, '"observed_rotation":90', '"observed_rotation":45'),
        (k % 7 == 3, '"reason":"r"', '"why":"r"'),
        (k % 7 == 4, '"numeric":0.5', '"numeric":1.5'),
        (k % 7 == 5, '"missing_context":[],', ""),
        (k % 7 == 6, '"observed_type":"table"', '"observed_type":"poem"'),
    ]
    said = F.lit(
        '{"element_id":"p1","media_readable":true,"observed_type":"table","observed_rotation":90,"structure":{"rows":[[1]]},"disagreements":[{"location":"a","ocr_value":"1","visual_candidates":[],'
        '"preferred_candidate":"1","confidence":0.5,"reason":"r"}],"ambiguous_regions":[],"missing_context":[],"confidence":{"visual_readability":1,"table_structure":null,"numeric":0.5,"formula":null},"recommended_status":"blocked"}'
    )
    for when, old, new in odd:
        said = F.when(when, F.replace(said, F.lit(old), F.lit(new))).otherwise(said)
    found = validation.review_violations(said, F.when(k % 11 == 0, F.lit("p2")).otherwise(F.lit("p1")))
    return rows.select("event_id", F.array_join(found, ",").alias("violations"))


V1_SQL = f"""
SELECT event_id, concat_ws(',', CASE k % 7 WHEN 5 THEN 'missing_keys' END, CASE WHEN k % 11 = 0 THEN 'element_id' END,
       CASE k % 7 WHEN 1 THEN 'media_readable' WHEN 2 THEN 'observed_rotation' WHEN 3 THEN 'disagreement' WHEN 4 THEN 'confidence_range' WHEN 5 THEN 'missing_context' WHEN 6 THEN 'observed_type' END) AS violations FROM {_KEYED}"""


def _attempts(spark, sf_dir):
    rows = _reviewed(spark, sf_dir)
    k = F.col("k")
    error = F.when(k % 301 == 0, F.lit("RESOURCE_EXHAUSTED")).when(k % 10 == 3, F.lit("timeout"))
    return rows.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("ordinal"), F.when(k % 5 >= 2, "image_only").otherwise(F.col("status")).alias("status"), error.alias("error"), validation.status_after_review(rows).alias("reviewed_status"), (k % 6 == 0).alias("repaired"))


def v7_review_budget(spark, sf_dir):
    return validation.review_budget(_attempts(spark, sf_dir)).select("doc_id", "ordinal", "attempted", "circuit_open", "calls", "status_after", "fallback_reason")


_BUDGET = f"""
    a AS (SELECT user_id AS doc_id, event_id, k, CASE WHEN k % 301 = 0 THEN 'RESOURCE_EXHAUSTED' WHEN k % 10 = 3 THEN 'timeout' END AS error,
                 CASE WHEN k % 5 >= 2 THEN 'image_only' WHEN k % 17 = 0 THEN 'blocked' ELSE 'needs_visual_review' END AS status FROM {_KEYED}),
    b AS (SELECT *, {_STATUS} AS reviewed, row_number() OVER (PARTITION BY doc_id ORDER BY event_id) <= 40 AS inside FROM a),
    c AS (SELECT *, coalesce(max((inside AND k % 301 = 0)::INT) OVER (PARTITION BY doc_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS circuit_open FROM b),
    d AS (SELECT *, inside AND NOT circuit_open AS attempted FROM c),
    budget AS (SELECT doc_id, event_id AS ordinal, attempted, circuit_open, CASE WHEN NOT attempted THEN 0 WHEN k % 6 = 0 THEN 2 ELSE 1 END AS calls, error,
        CASE WHEN attempted AND error IS NOT NULL THEN 'human_review_required' WHEN attempted THEN reviewed WHEN status = 'image_only' THEN status ELSE 'human_review_required' END AS status_after,
        CASE WHEN attempted AND error IS NOT NULL THEN error WHEN attempted AND reviewed IN ('needs_visual_review', 'human_review_required', 'blocked') THEN 'visual_review_status:' || reviewed
             WHEN NOT attempted AND status <> 'image_only' THEN CASE WHEN circuit_open THEN 'gemini_visual_review_quota_exhausted' ELSE 'gemini_visual_review_budget_exhausted' END END AS fallback_reason FROM d)"""


def v3_checks(spark, sf_dir):
    return v3_checks_all(spark, sf_dir)


def v3_checks_all(spark, sf_dir):
    """The checks of every line; those from the third on are figures."""
    rows = fixture(spark, sf_dir, "products").distinct()
    kind = F.when(F.col("l_linenumber") == 1, "table").when(F.col("l_linenumber") == 2, "formula").otherwise("figure")
    table = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.array_repeat(F.lit("c"), F.when((F.col("l_orderkey") % 4 == 0) & (i == 2), 1).otherwise(2)))
    e = rows.select("l_orderkey", "l_linenumber", "d", kind.alias("element_type"), F.col("text").alias("raw_text"), F.lit(2).alias("columns"), table.alias("table"), F.lit("needs_visual_review").alias("status"), F.array(F.lit("x")).alias("alerts"), (F.col("l_orderkey") % 3 == 0).alias("has_formula"), "q")
    return validation.with_checks(e).select("l_orderkey", "l_linenumber", "q", "d", F.array_join("alerts", ",").alias("alerts"), "status")


V3_SQL = f"""
WITH p AS (SELECT DISTINCT * FROM ({duck("products")})),
c AS (SELECT *, l_orderkey % 7 = 0 AND (q * d + 3) % 10 <> 0 AS wrong, l_linenumber = 1 AND l_orderkey % 4 = 0 AS shifted, l_linenumber = 2 AND l_orderkey % 3 <> 0 AS unsure FROM p)
SELECT l_orderkey, l_linenumber, q, d, concat_ws(',', 'x', CASE WHEN wrong THEN 'arithmetic_check_failed' END, CASE WHEN shifted THEN 'column_shift_risk' END, CASE WHEN unsure THEN 'formula_structure_ambiguous' END) AS alerts,
       CASE WHEN wrong OR shifted THEN 'blocked' ELSE 'needs_visual_review' END AS status FROM c"""


def v8_unchanged(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    before = docs.select(F.col("doc_id").alias("document_id"), F.col("n_chars").alias("byte_size"), F.sha2("text", 256).alias("sha256"))
    later = docs.where("doc_id % 9 <> 0").withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    after = later.select(F.col("doc_id").alias("document_id"), F.col("n_chars").alias("byte_size"), F.sha2("text", 256).alias("sha256"))
    return validation.unchanged(before, after)


def v9_human_reviews(spark, sf_dir):
    k = F.col("n_chars")
    rows = _t(spark, sf_dir, "documents").select(
        "doc_id",
        F.lit("1.0").alias("schema_version"),
        F.concat(F.lit("r"), k.cast("string")).alias("review_id"),
        F.concat(F.lit("h"), (k % 50).cast("string")).alias("document_sha256"),
        F.struct(F.when(k % 5 == 0, "model").otherwise("human").alias("type"), F.when(k % 7 == 0, " ").otherwise("A").alias("name")).alias("reviewer"),
        F.when(k % 4 == 0, "pending").when(k % 4 == 1, "keep_blocked").otherwise("approve_corrected_structure").alias("decision"),
        (k % 6 != 0).alias("has_structure"),
        F.when(k % 8 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("e"))).alias("evidence_files"),
        F.when(k % 9 == 0, "soon").otherwise("2026-01-02T03:04:05Z").alias("reviewed_at"),
        F.concat(F.lit("h"), (k % 50).cast("string")).alias("sidecar_sha256"),
        F.when(k % 10 == 0, 2).otherwise(1).alias("n_elements"),
        F.lit(0).alias("missing_files"),
        F.when(k % 11 == 0, "other").when(k % 13 != 0, F.concat(F.lit("h"), (k % 50).cast("string"))).alias("source_sha256"),
        (k % 12 == 0).cast("int").alias("missing_fields"),
    )
    return rows.select("doc_id", F.array_join(validation.human_review_violations(rows), ",").alias("violations"))


V9_SQL = """
SELECT doc_id, concat_ws(',', CASE WHEN n_chars % 12 = 0 THEN 'missing_fields' END, CASE WHEN n_chars % 4 = 0 THEN 'decision' END, CASE WHEN n_chars % 5 = 0 THEN 'reviewer_type' END, CASE WHEN n_chars % 7 = 0 THEN 'reviewer_name' END, CASE WHEN n_chars % 10 = 0 THEN 'element_id' END,
       CASE WHEN n_chars % 4 >= 2 AND n_chars % 6 = 0 THEN 'corrected_structure' END, CASE WHEN n_chars % 9 = 0 THEN 'reviewed_at' END, CASE WHEN n_chars % 8 = 0 THEN 'evidence_files' END, CASE WHEN n_chars % 13 = 0 AND n_chars % 11 <> 0 THEN 'source_missing' END, CASE WHEN n_chars % 11 = 0 THEN 'source' END) AS violations FROM documents"""


def v10_context(spark, sf_dir):
    rows = _reviewed(spark, sf_dir).withColumn("alerts", F.when(F.col("k") % 6 == 0, F.array(F.lit("figure_caption_on_previous_page"))).otherwise(F.col("alerts")))
    return rows.groupBy("element_type").agg(F.count_if(validation.needs_neighbours(F.col("alerts"), F.col("k") % 50 == 0)).alias("n"))


def m1_upsert(spark, sf_dir):
    return jobs.upsert(fixture(spark, sf_dir, "updates"))


def m2_still_to_do(spark, sf_dir):
    manifest = jobs.upsert(fixture(spark, sf_dir, "updates"))
    videos = fixture(spark, sf_dir, "updates").select("url").distinct()
    return jobs.still_to_do(videos, manifest)


_UPSERT = f"u AS ({duck('updates')}), m AS (SELECT playlist_title, url, min(seq) AS position, arg_max(title, seq) AS title, arg_max(status, seq) AS status, arg_max(kept, seq) AS kept FROM u GROUP BY ALL)"


def m3_manifest_summary(spark, sf_dir):
    return jobs.manifest_summary(jobs.upsert(fixture(spark, sf_dir, "updates")), "playlist_title")


def m5_without_output(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    work = docs.select("doc_id", F.concat(F.lit("out/"), "source", F.lit("-"), (F.col("doc_id") % 40).cast("string"), F.lit(".md")).alias("output_path"))
    return jobs.without_output(work, work.where("doc_id % 5 = 0"))


def _prices(spark, sf_dir):
    return _t(spark, sf_dir, "nation").where("n_nationkey < 3").select(
        F.element_at(F.array(F.lit("click"), F.lit("view"), F.lit("purchase")), (F.col("n_nationkey") + 1).cast("int")).alias("model"), (F.col("n_nationkey") + 1).cast("string").alias("input_per_1m"), F.lit("3").alias("output_per_1m")
    )


def _priced(spark, sf_dir):
    return jobs.cost(fixture(spark, sf_dir, "usage"), _prices(spark, sf_dir))


_PRICED = f"""
    u AS (SELECT *, round_even(input_tokens / 1e6 * CASE model WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 END + output_tokens / 1e6 * CASE WHEN model IN ('click', 'view', 'purchase') THEN 3 END, 8) AS cost FROM ({duck("usage")})),
    sums AS (SELECT count(*) AS request_count, count(*) FILTER (WHERE status = 'success') AS successful_requests, count(*) FILTER (WHERE status = 'failed') AS failed_requests,
             sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(sum(cost), 4) AS estimated_cost_usd FROM u)"""


def u1_cost(spark, sf_dir):
    return _priced(spark, sf_dir).groupBy("model", "status").agg(F.count("estimated_cost_usd").alias("priced"), F.round(F.sum("estimated_cost_usd"), 5).alias("cost"))


def u2_usage_summary(spark, sf_dir):
    return jobs.usage_summary(_priced(spark, sf_dir), jobs.budget_usd(F.lit(" 100 "))).withColumns({c: F.round(c, 4) for c in ("estimated_cost_usd", "budget_remaining_usd")})


def u3_usage_by_model(spark, sf_dir):
    return jobs.usage_by_model(_priced(spark, sf_dir)).withColumn("estimated_cost_usd", F.round("estimated_cost_usd", 4))


U3_SQL = f"""WITH {_PRICED} SELECT model, grouping(model)::INT AS level, count(*) AS request_count, count(*) FILTER (WHERE status = 'success') AS successful_requests, count(*) FILTER (WHERE status = 'failed') AS failed_requests,
       sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(sum(cost), 4) AS estimated_cost_usd FROM u GROUP BY GROUPING SETS ((model), ())"""


def u3_usage_stream(spark, sf_dir):
    """Usage by model of a log that is followed: written and counted in two turns, the second from the first one's checkpoint."""
    log, totals, state = (fresh_folder(spark, x) for x in ("log", "totals", "state"))
    events = fixture(spark, sf_dir, "usage")
    for turn in ("status = 'success'", "status <> 'success'"):
        sinks.append_usage(events.where(turn), log)
        usage.follow_usage(usage.usage_stream(spark, log), totals, state, _prices(spark, sf_dir)).awaitTermination()
    return usage.usage_so_far(spark, totals).withColumn("estimated_cost_usd", F.round("estimated_cost_usd", 4))


def u4_budget_setting(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    said = F.element_at(F.array(F.lit("10"), F.lit(" 2.5 "), F.lit("0"), F.lit("-3"), F.lit("none"), F.lit("")), (F.col("event_id") % 6 + 1).cast("int"))
    return e.groupBy(jobs.budget_usd(said).alias("budget")).agg(F.count(F.lit(1)).alias("n"))


def _golden(spark, sf_dir):
    """A case for each order's page of an element, elements from line items, two assertions a case."""
    li = _t(spark, sf_dir, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber"])
    kind = F.when(F.col("l_linenumber") % 2 == 0, "table").otherwise("figure")
    status = F.element_at(F.array(F.lit("human_verified"), F.lit("blocked"), F.lit("draft")), (F.col("l_orderkey") % 3 + 1).cast("int"))
    elements = li.select(
        (F.col("l_orderkey") % 100).cast("string").alias("source"), F.col("l_orderkey").alias("pdf_page_number"), F.col("l_linenumber").alias("element_ordinal"),
        F.concat(F.lit("e"), F.col("l_linenumber").cast("string")).alias("element_id"), kind.alias("element_type"), F.lit(None).cast("string").alias("figure_number"), F.lit(None).cast("string").alias("table_number"),
        F.concat(F.lit("Row "), F.col("l_linenumber").cast("string")).alias("raw_text"), status.alias("status"), F.array().cast("array<string>").alias("alerts"), F.lit(False).alias("data_digitized"),
        F.concat(F.lit("row "), F.col("l_linenumber").cast("string"), F.lit(" holds +1,000 and 7")).alias("content"),
    )
    orders = _t(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    cases = orders.select(
        (k % 100).cast("string").alias("source"), F.concat(F.lit("c"), k.cast("string")).alias("case_id"), k.alias("pdf_page_number"), F.lit(True).alias("critical"),
        F.when(k % 2 == 0, F.lit("e3")).alias("want_id"), F.when(k % 5 == 0, F.lit("table")).alias("want_type"), F.lit(None).cast("string").alias("want_figure"), F.lit(None).cast("string").alias("want_table"),
        F.when(k % 7 == 0, F.lit("ROW 2")).alias("want_text"),
    )
    a = F.array(
        F.struct(F.lit("a1").alias("assertion_id"), F.lit("quantitative_token").alias("kind"), F.when(k % 4 == 0, "8").otherwise("1000").alias("expected"), F.array(F.lit("+1000")).alias("aliases"), F.lit(True).alias("quantitative")),
        F.struct(F.lit("a2").alias("assertion_id"), F.lit("text_contains").alias("kind"), F.when(k % 6 == 0, "nothing").otherwise("HOLDS").alias("expected"), F.array().cast("array<string>").alias("aliases"), F.lit(False).alias("quantitative")),
    )
    assertions = orders.select((k % 100).cast("string").alias("source"), F.concat(F.lit("c"), k.cast("string")).alias("case_id"), F.explode(a).alias("a")).select("source", "case_id", "a.*")
    return cases, elements, assertions


def e1_best_elements(spark, sf_dir):
    cases, elements, _ = _golden(spark, sf_dir)
    return scoring.best_elements(cases, elements).select("case_id", "element_id", "status")


_BEST = """
    el AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),
    ex AS (SELECT o_orderkey AS k, l_linenumber AS n, max((o_orderkey % 2 = 0 AND l_linenumber = 3)::INT) OVER (PARTITION BY o_orderkey) = 1 AS exact FROM orders JOIN el ON o_orderkey = l_orderkey),
    pick AS (SELECT k, min(n) AS n FROM ex WHERE (NOT exact OR n = 3) AND (k % 5 <> 0 OR n % 2 = 0) AND (k % 7 <> 0 OR n = 2) GROUP BY k),
    best AS (SELECT o_orderkey AS k, n, CASE WHEN n IS NOT NULL THEN CASE o_orderkey % 3 WHEN 0 THEN 'human_verified' WHEN 1 THEN 'blocked' ELSE 'draft' END END AS status FROM orders LEFT JOIN pick ON k = o_orderkey),
    outc AS (SELECT k, a, n IS NOT NULL AND CASE WHEN a = 1 THEN true ELSE k % 6 <> 0 END AS ok, n, status FROM best, (VALUES (1), (2)) t(a)),
    cls AS (SELECT *, CASE WHEN n IS NULL THEN 'missing_without_alert' WHEN ok AND status = 'human_verified' THEN 'correct_trusted' WHEN ok THEN 'correct_but_unverified' WHEN status = 'blocked' THEN 'error_or_omission_alerted'
            ELSE 'dangerous_accepted_without_alert' END AS c FROM outc)"""


def e2_assertions(spark, sf_dir):
    cases, elements, assertions = _golden(spark, sf_dir)
    done = scoring.assertion_outcomes(scoring.best_elements(cases, elements), assertions)
    return done.select("case_id", "assertion_id", "correct", "classification")


def e4_golden_report(spark, sf_dir):
    cases, elements, assertions = _golden(spark, sf_dir)
    matched = scoring.best_elements(cases, elements)
    return scoring.golden_report(matched, scoring.assertion_outcomes(matched, assertions))


E4_SQL = f"""
WITH {_BEST}, s AS (SELECT (k % 100)::VARCHAR AS source, count(*) AS total, count(*) FILTER (WHERE ok) AS good, count(*) FILTER (WHERE c = 'correct_trusted') AS trusted,
  count(*) FILTER (WHERE c = 'dangerous_accepted_without_alert' AND a = 1) AS dangerous, count(*) FILTER (WHERE c = 'dangerous_accepted_without_alert') AS unsafe, count(*) FILTER (WHERE c = 'error_or_omission_alerted') AS alerted,
  count(*) FILTER (WHERE n IS NULL) // 2 AS lost FROM cls GROUP BY 1)
SELECT source, total // 2 AS golden_cases_evaluated, total AS critical_assertions_total, good AS critical_assertions_correct, total - good AS critical_assertions_missing_or_wrong, trusted AS critical_assertions_trusted,
  round_even(trusted / total, 6) AS trusted_coverage, dangerous AS dangerous_quantitative_errors_accepted_without_alert, round_even(dangerous / total, 6) AS dangerous_acceptance_rate, unsafe AS unsafe_assertions_accepted_without_alert,
  alerted AS alerted_errors_or_omissions, lost AS critical_elements_missing_without_alert, CASE WHEN unsafe > 0 OR lost > 0 THEN 'fail' WHEN total > good OR trusted < total THEN 'safe_but_incomplete' ELSE 'pass' END AS dangerous_error_metric_status FROM s"""


def e5_case_statuses(spark, sf_dir):
    cases, elements, assertions = _golden(spark, sf_dir)
    matched = scoring.best_elements(cases, elements)
    return scoring.case_statuses(matched, scoring.assertion_outcomes(matched, assertions)).select("case_id", "case_status")


def _regression(spark, sf_dir):
    cases = _t(spark, sf_dir, "customer").select(F.col("c_name").alias("n_name"), F.col("c_custkey").alias("n_nationkey"))
    expected = cases.select(F.col("n_name").alias("id"), F.concat(F.lit("d"), (F.col("n_nationkey") % 4).cast("string")).alias("difficulty"))
    seen = cases.where("n_nationkey % 6 <> 5").select(
        F.col("n_nationkey").alias("row_no"),
        F.when(F.col("n_nationkey") % 8 == 7, F.concat("n_name", F.lit("?"))).otherwise(F.col("n_name")).alias("id"),
        F.concat(F.lit("d"), F.when(F.col("n_nationkey") % 24 == 4, 9).otherwise(F.col("n_nationkey") % 4).cast("string")).alias("difficulty"),
        F.when(F.col("n_nationkey") % 24 == 6, "planned").otherwise("covered").alias("status"),
        F.when(F.col("n_nationkey") % 24 == 9, F.array().cast("array<string>")).otherwise(F.array(F.lit("t"))).alias("tests"),
        F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("r"))).otherwise(F.array().cast("array<string>")).alias("real_annotations"),
    )
    twice = seen.where("row_no % 24 = 2").withColumn("row_no", F.col("row_no") + 1_000_000_000)
    return expected, seen.unionByName(twice)


def e6_regression_errors(spark, sf_dir):
    return scoring.regression_errors(*_regression(spark, sf_dir))


def e6_regression_report(spark, sf_dir):
    expected, observed = _regression(spark, sf_dir)
    return scoring.regression_report(expected, observed, scoring.regression_errors(expected, observed))


_REGRESSION = """
    n AS (SELECT *, n_nationkey % 6 = 5 AS gone, n_nationkey % 8 = 7 AS odd FROM (SELECT c_name AS n_name, c_custkey AS n_nationkey FROM customer)),
    errs AS (SELECT 'missing_case' AS error, n_name AS id FROM n WHERE gone OR odd UNION ALL SELECT 'unexpected_case', n_name || '?' FROM n WHERE odd AND NOT gone
             UNION ALL SELECT 'difficulty_mismatch', n_name FROM n WHERE n_nationkey % 24 = 4 UNION ALL SELECT 'not_covered', n_name FROM n WHERE n_nationkey % 24 = 6
             UNION ALL SELECT 'missing_tests', n_name FROM n WHERE n_nationkey % 24 = 9 UNION ALL SELECT 'duplicate_case', n_name FROM n WHERE n_nationkey % 24 = 2)"""


def e7_status_counts(spark, sf_dir):
    rows = _reviewed(spark, sf_dir).select(F.col("user_id").alias("doc_id"), "status")
    counts = scoring.status_counts(rows)
    return counts.select("doc_id", F.coalesce(F.element_at("statuses", F.lit("blocked")), F.lit(0)).alias("blocked"), "elements", "deferred")


def r1_apply_reviews(spark, sf_dir):
    k = F.col("doc_id")
    docs = _t(spark, sf_dir, "documents").select("doc_id")
    entry = F.struct(F.concat(F.lit("r"), k.cast("string")).alias("review_id"), F.lit("A").alias("by"))
    empty = F.array().cast("array<struct<review_id:string,by:string>>")
    canonical = "struct<status:string,source:string,review_id:string,reviewed_at:string,structure:string,page_number:int>"
    elements = docs.select(
        (k % 10).cast("string").alias("document_sha256"), k.cast("string").alias("element_id"), F.lit("blocked").alias("status"), F.lit(None).cast("boolean").alias("data_digitized"), F.lit(None).cast(canonical).alias("canonical"),
        F.when(k % 13 == 0, F.array(entry)).otherwise(empty).alias("review_history"),
    )
    labels = _t(spark, sf_dir, "labels")
    structure = F.when(k % 2 == 0, F.lit('{"columns":["a"],"rows":[["1"]]}')).otherwise(F.lit('{"caption":"c"}'))
    reviews = labels.select(
        (k % 10).cast("string").alias("document_sha256"), k.cast("string").alias("element_id"), F.concat(F.lit("r"), k.cast("string")).alias("review_id"),
        F.when(F.col("quality") == 1, resolution.APPROVE).otherwise(resolution.KEEP_BLOCKED).alias("decision"), F.lit("2026-01-01T00:00:00").alias("reviewed_at"), structure.alias("structure"), F.lit(3).alias("page_number"),
        resolution.is_quantitative_table(structure).alias("is_table"), entry.alias("record"),
    )
    done = resolution.apply_reviews(elements, reviews)
    return done.select("element_id", "status", "refused", F.coalesce("data_digitized", F.lit(False)).alias("digitized"), F.size("review_history").alias("history"), F.col("canonical.review_id").alias("canonical_review"))


R1_SQL = """
SELECT d.doc_id::VARCHAR AS element_id, CASE WHEN quality = 1 AND d.doc_id % 13 <> 0 THEN 'human_verified' ELSE 'blocked' END AS status, quality IS NOT NULL AND d.doc_id % 13 = 0 AS refused,
       coalesce(quality = 1 AND d.doc_id % 13 <> 0 AND d.doc_id % 2 = 0, false) AS digitized, CASE WHEN d.doc_id % 13 = 0 OR quality IS NOT NULL THEN 1 ELSE 0 END AS history,
       CASE WHEN quality = 1 AND d.doc_id % 13 <> 0 THEN 'r' || d.doc_id END AS canonical_review FROM documents d LEFT JOIN labels USING (doc_id)"""


def k11_markdown_tables(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    row = F.array(F.col("l_linenumber").cast("string"), F.concat("l_returnflag", F.lit("|"), "l_linestatus"), F.lit("extra"))
    cells = F.when(F.col("l_linenumber") % 2 == 0, F.slice(row, 1, 1)).otherwise(row)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", cells.alias("c")))), lambda r: r["c"])
    return li.groupBy("l_orderkey").agg(rows.alias("rows")).select("l_orderkey", resolution.markdown_table(F.array(F.lit("no"), F.lit("flags")), F.col("rows")).alias("markdown"))


K11_SQL = """
SELECT l_orderkey, '| no | flags |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || l_linenumber || ' | ' || CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE l_returnflag || '\\|' || l_linestatus END || ' |', chr(10)
       ORDER BY l_linenumber, l_partkey, l_suppkey) AS markdown FROM lineitem GROUP BY 1"""


def k3_front_matter(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    title = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, F.lit(' "x"')).otherwise(F.lit(" \\y")))
    return part.select("p_partkey", F.md5(sinks.summary_front_matter(title, F.col("p_type"), "pdf")).alias("front_md5"), sinks.shell_quoted(title).alias("quoted"))


K3_SQL = r"""
WITH a AS (SELECT p_partkey, p_type, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' "x"' ELSE ' \y' END AS t FROM part)
SELECT p_partkey, md5(concat_ws(chr(10), '---', 'title: "' || replace(replace(t, '\', '\\'), '"', '\"') || '"', 'source_type: "pdf"', 'source_file: "' || p_type || '"', 'domain: "non précisé"', 'technical_level: "non précisé"',
       'content_value: "non précisé"', 'bullshit_risk: "non précisé"', 'graphipy_ready: true', 'tags:', '  - pdf', '  - livre', '---', '')) AS front_md5, '''' || t || '''' AS quoted FROM a"""


def k6_quality_reports(spark, sf_dir):
    reviewed = validation.review_budget(_attempts(spark, sf_dir)).withColumn("document_id", F.col("doc_id"))
    manifests = reviewed.select("document_id").distinct()
    made = sinks.quality_reports(manifests, reviewed, validation.BUDGET)
    return made.select("document_id", "elements_detected", "gemini_review_attempts", "gemini_successes", "gemini_failures", "gemini_circuit_open", "fallback_requests", "visual_review_deferred")


K6_SQL = f"""
WITH {_BUDGET} SELECT doc_id AS document_id, count(*) AS elements_detected, count(*) FILTER (WHERE attempted) AS gemini_review_attempts, count(*) FILTER (WHERE attempted AND error IS NULL) AS gemini_successes,
  count(*) FILTER (WHERE attempted AND error IS NOT NULL) AS gemini_failures, bool_or(circuit_open) AS gemini_circuit_open, count(fallback_reason) AS fallback_requests, count(*) - count(*) FILTER (WHERE attempted) AS visual_review_deferred FROM budget GROUP BY 1"""


def k4_export_lines(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    text = F.concat(F.lit("a\nmodel_used: m\n"), "text", F.lit("\nmodel_used: n\nend"))
    return c.select("conv_id", "turn", F.md5(sinks.without_model_lines(text)).alias("text_md5"))


def s12_playlist_videos(spark, sf_dir):
    u = _t(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    rows = u.select(
        F.lit(None).cast("string").alias("playlist"), k.alias("position"), F.when(k % 3 == 0, F.lit("https://v.example/a")).when(k % 3 == 1, F.concat(F.lit("id"), k.cast("string"))).alias("url"),
        F.when(k % 4 == 0, F.lit("https://w.example/b")).alias("webpage_url"), F.concat(F.lit("i"), k.cast("string")).alias("id"), F.when(k % 5 == 0, F.lit("")).otherwise(F.col("s_name")).alias("title"),
    )
    return files.playlist_videos(rows)


S12_SQL = """
WITH a AS (SELECT s_suppkey AS position, CASE s_suppkey % 3 WHEN 0 THEN 'https://v.example/a' WHEN 1 THEN 'https://www.youtube.com/watch?v=id' || s_suppkey END AS u, CASE WHEN s_suppkey % 4 = 0 THEN 'https://w.example/b' END AS w,
           'i' || s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'i' || s_suppkey ELSE s_name END AS t FROM supplier)
SELECT 'playlist' AS playlist, position, coalesce(w, u) AS url, t AS title, id AS video_id, trim(lower(regexp_replace(t || '-' || id, '[^A-Za-z0-9]+', '-', 'g')), '-') AS slug FROM a WHERE coalesce(u, w) IS NOT NULL"""


def s22_manifests(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    raw = docs.select(F.concat(F.lit("/in/Le Fichier "), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), F.octet_length("text").cast("long").alias("length"), F.lit("2026-01-01").cast("timestamp").alias("modificationTime"), F.encode("text", "UTF-8").alias("content"))
    return files.document_manifests(raw).select("document_id", "source_file", "sha256", "byte_size")


def f5_largest(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return files.largest(docs.select("source", F.col("n_chars").alias("size"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path")), "source")


def s15_url_list(spark, sf_dir):
    c = _t(spark, sf_dir, "pages").select(F.when(F.col("page_id") % 4 == 0, F.concat(F.lit(" # "), "url")).when(F.col("page_id") % 9 == 1, F.lit("  ")).otherwise(F.concat(F.lit("\t"), "url", F.lit(" "))).alias("value"))
    return files.url_list(c)


def o5_source_kind(spark, sf_dir):
    p = _t(spark, sf_dir, "pages")
    return p.groupBy(files.source_kind(F.concat("url", F.when(F.col("page_id") % 3 == 0, F.lit("&list=x")).otherwise(F.lit(""))), F.col("page_id") % 5 == 0).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "v1_review_violations": (v1_review_violations, V1_SQL),
    "v2_status_after_review": (v2_status_after_review, f"SELECT event_id, {_STATUS} AS status_after FROM {_KEYED}"),
    "v3_checks_all": (v3_checks_all, V3_SQL),
    "v3_checks": (v3_checks, V3_SQL),
    "v4_failed_products": (v4_failed_products, V4_SQL),
    "v7_review_budget": (v7_review_budget, f"WITH {_BUDGET} SELECT doc_id, ordinal, attempted, circuit_open, calls, status_after, fallback_reason FROM budget"),
    "v8_unchanged": (v8_unchanged, "SELECT doc_id AS document_id, doc_id % 9 <> 0 AND doc_id % 4 <> 0 AS unchanged FROM documents"),
    "v9_human_reviews": (v9_human_reviews, V9_SQL),
    "v10_context": (
        v10_context,
        f"SELECT CASE k % 5 WHEN 0 THEN 'table' WHEN 1 THEN 'formula' WHEN 2 THEN 'figure' WHEN 3 THEN 'chart' ELSE 'payoff_diagram' END AS element_type, count(*) FILTER (WHERE k % 6 = 0 OR k % 50 = 0) AS n FROM {_KEYED} GROUP BY 1",
    ),
    "m1_upsert": (m1_upsert, f"WITH {_UPSERT} SELECT * FROM m"),
    "m2_still_to_do": (m2_still_to_do, f"WITH {_UPSERT} SELECT DISTINCT url FROM u WHERE url NOT IN (SELECT url FROM m WHERE status = 'done')"),
    "m3_manifest_summary": (m3_manifest_summary, f"WITH {_UPSERT} SELECT playlist_title, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE kept) AS kept FROM m GROUP BY 1"),
    "m5_without_output": (
        m5_without_output,
        "WITH w AS (SELECT doc_id, 'out/' || source || '-' || (doc_id % 40) || '.md' AS output_path FROM documents) SELECT * FROM w WHERE output_path NOT IN (SELECT output_path FROM w WHERE doc_id % 5 = 0)",
    ),
    "u1_cost": (u1_cost, f"WITH {_PRICED} SELECT model, status, count(cost) AS priced, round(sum(cost), 5) AS cost FROM u GROUP BY ALL"),
    "u2_usage_summary": (u2_usage_summary, f"WITH {_PRICED} SELECT *, 100.0::DOUBLE AS budget_usd, round(100 - (SELECT sum(cost) FROM u), 4) AS budget_remaining_usd FROM sums"),
    "u3_usage_by_model": (u3_usage_by_model, U3_SQL),
    "u3_usage_stream": (u3_usage_stream, U3_SQL),
    "u4_budget_setting": (u4_budget_setting, "SELECT CASE event_id % 6 WHEN 0 THEN 10.0 WHEN 1 THEN 2.5 END::DOUBLE AS budget, count(*) AS n FROM events GROUP BY 1"),
    "e1_best_elements": (e1_best_elements, f"WITH {_BEST} SELECT 'c' || k AS case_id, 'e' || n AS element_id, status FROM best"),
    "e2_assertions": (e2_assertions, f"WITH {_BEST} SELECT 'c' || k AS case_id, 'a' || a AS assertion_id, ok AS correct, c AS classification FROM cls"),
    "e4_golden_report": (e4_golden_report, E4_SQL),
    "e5_case_statuses": (
        e5_case_statuses,
        f"""WITH {_BEST} SELECT 'c' || k AS case_id, CASE WHEN bool_or(n IS NULL) THEN 'missing_critical_element' WHEN bool_or(c = 'dangerous_accepted_without_alert') THEN 'fail' WHEN bool_and(c = 'correct_trusted') THEN 'pass'
            ELSE 'safe_but_incomplete' END AS case_status FROM cls GROUP BY k""",
    ),
    "e6_regression_errors": (e6_regression_errors, f"WITH {_REGRESSION} SELECT error, id FROM errs"),
    "e6_regression_report": (
        e6_regression_report,
        f"""WITH {_REGRESSION}, c AS (SELECT count(*) AS x FROM n WHERE n_name NOT IN (SELECT id FROM errs)), r AS (SELECT count(*) FILTER (WHERE n_nationkey % 3 = 0 AND NOT gone) AS y FROM n)
            SELECT 'fail' AS status, z AS cases_expected, x AS cases_covered, round_even(x / z, 6) AS synthetic_regression_coverage, y AS real_cases, round_even(y / z, 6) AS real_source_coverage, (SELECT count(*) FROM errs) AS errors FROM c, r, (SELECT count(*) AS z FROM n)""",
    ),
    "e7_status_counts": (e7_status_counts, f"SELECT user_id AS doc_id, count(*) FILTER (WHERE k % 17 = 0) AS blocked, count(*) AS elements, count(*) AS deferred FROM {_KEYED} GROUP BY 1"),
    "r1_apply_reviews": (r1_apply_reviews, R1_SQL),
    "k3_front_matter": (k3_front_matter, K3_SQL),
    "k4_export_lines": (k4_export_lines, "SELECT conv_id, turn, md5('a' || chr(10) || text || chr(10) || 'end') AS text_md5 FROM conversations"),
    "k6_quality_reports": (k6_quality_reports, K6_SQL),
    "k11_markdown_tables": (k11_markdown_tables, K11_SQL),
    "s12_playlist_videos": (s12_playlist_videos, S12_SQL),
    "s15_url_list": (s15_url_list, "SELECT trim(url) AS url FROM pages WHERE page_id % 4 <> 0 AND page_id % 9 <> 1"),
    "s22_manifests": (
        s22_manifests,
        "SELECT 'le-fichier-' || doc_id || '-' || sha256(text)[1:12] AS document_id, '/in/Le Fichier ' || doc_id || '.pdf' AS source_file, sha256(text) AS sha256, strlen(text) AS byte_size FROM documents",
    ),
    "f5_largest": (f5_largest, "SELECT source, arg_max('f' || doc_id, (n_chars, 'f' || doc_id)) AS path FROM documents GROUP BY 1"),
    "o5_source_kind": (
        o5_source_kind,
        "SELECT CASE WHEN page_id % 5 = 0 THEN 'local' WHEN page_id % 3 = 0 OR url LIKE '%playlist%' OR url LIKE '%list=%' THEN 'playlist' ELSE 'video' END AS kind, count(*) AS n FROM pages GROUP BY 1",
    ),
}
