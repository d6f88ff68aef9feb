import re

import pytest
from pyspark.sql import functions as F

from quirelake.operators import detection, jobs, ocr_geometry, resolution, scoring, validation
from quirelake.sources import adapters, files, sinks

BLOCKS = "doc_id string, page_index int, block_ordinal int, block_type int, text string, x0 double, y0 double, x1 double, y1 double"
PAGES = "doc_id string, page_index int, width double, height double, rotation int, text_source string, text_confidence double, alerts array<string>, page_text string"


def detect(spark, pages):
    blocks = [("d", p, i, kind, text, *box) for p, rows in pages.items() for i, (kind, text, box) in enumerate(rows)]
    sheets = [("d", p, 600.0, 800.0, 0, "native", 1.0, [], "\n".join(t for _, t, _ in rows)) for p, rows in pages.items()]
    return detection.detect_elements(spark.createDataFrame(blocks, BLOCKS), spark.createDataFrame(sheets, PAGES))


def test_captions_tables_and_references(spark):
    box = (50.0, 100.0, 300.0, 120.0)
    page = [
        (0, "As shown in FIGURE 14.1 prices rise", box),
        (0, "FIGURE 13.1 shows volume", box),
        (0, "FIGURÉ 13.3 P&/(L) at expiry", (50.0, 300.0, 300.0, 320.0)),
        (0, "Figure 13.3 again", (60.0, 500.0, 300.0, 520.0)),
        (0, "a  b  c\n1  2  3\n-.5  3/4  x", (10.0, 20.0, 500.0, 60.0)),
        (0, "Delta = 0.5", (1.0, 1.0, 2.0, 2.0)),
        (0, "249", (280.0, 780.0, 300.0, 795.0)),
        (0, "43", (280.0, 400.0, 300.0, 410.0)),
    ]
    got = {r.element_id: r for r in detect(spark, {0: page}).collect()}
    assert set(got) == {"p000001-payoff-13-3", "p000001-figure-13-3", "p000001-table-03"}
    assert got["p000001-table-03"].columns == 3 and got["p000001-table-03"].table_confidence > 0.8
    assert got["p000001-payoff-13-3"].y1 == 492.0 and got["p000001-payoff-13-3"].status == "image_only"
    assert "printed_page_mapping_low_confidence" in got["p000001-table-03"].alerts


def test_duplicates_cover_and_cap(spark):
    same = [(0, f"Table 1.{i // 2}", (0.0, float(20 * i), 99.0, 20.0 * i + 9)) for i in range(4)]
    ids = sorted(r.element_id for r in detect(spark, {0: same}).collect())
    assert ids == ["p000001-table-1-0", "p000001-table-1-0-candidate-02", "p000001-table-1-1", "p000001-table-1-1-candidate-02"]
    many = [(0, f"x = {i}+1", (0.0, float(i), 9.0, float(i) + 1)) for i in range(31)]
    assert detect(spark, {0: many}).count() == 30
    assert detect(spark, {0: [(0, "This page intentionally left blank.", (0.0, 0.0, 1.0, 1.0))]}).count() == 0


def test_empty_page_links_to_the_one_before(spark):
    rows = detection.link_previous_page(detect(spark, {0: [(0, "Figure 2.1 a", (0.0, 0.0, 9.0, 9.0)), (0, "Fig. 2.2 b", (0.0, 90.0, 9.0, 99.0))], 1: [(0, "", (0.0, 0.0, 1.0, 1.0))], 2: [(0, " ", (0.0, 0.0, 1.0, 1.0))]}))
    got = {r.page_index: r for r in rows.where("page_index > 0").collect()}
    assert got[1].previous_page_caption_element_id == "p000001-figure-2-2" and got[2].previous_page_caption_element_id is None
    assert got[1].alerts == ["page_has_too_little_extractable_text", "figure_caption_on_previous_page"]


def test_printed_page_trust(spark):
    df = spark.createDataFrame([("7", 272), ("273", 272), ("43", 30), (None, 1)], "p string, i int")
    got = [round(r.o, 2) for r in df.select(detection.printed_page_confidence(F.col("p"), F.col("i")).alias("o")).collect()]
    assert got == [0.35, 0.98, 0.85, 0.0]


def test_words_to_lines_and_skew(spark):
    rows = [("d", 0, i, "5", "1", "1", "1", "1", str(i), str(x), str(100 + 4 * i), "40", "12", c, f"w{i}") for i, (x, c) in enumerate(((10, "98"), (100, "98"), (190, "-1"), (300, "x")))]
    rows.append(("d", 0, 9, "4", "1", "1", "1", "1", "9", "0", "0", "1", "1", "5", "no"))
    raw = spark.createDataFrame(rows, "doc_id string, page_index int, ordinal int, " + ", ".join(f"`{f}` string" for f in files.WORD_FIELDS))
    words = ocr_geometry.read_words(raw)
    block = ocr_geometry.text_blocks(words, 600.0, 800.0, 72).first()
    assert block.text == "w0\tw1\tw2\tw3" and (block.x0, block.x1, block.ocr_confidence) == (10.0, 340.0, 0.98)
    assert abs(ocr_geometry.skew(words).first().skew_degrees) >= 0.7
    images = spark.createDataFrame([("a", 3, bytearray([200, 10, 10, 0, 0, 0])), ("b", 1, bytearray([255])), ("c", 3, None)], "image_id string, channels int, data binary")
    assert {r.image_id: r.red_ratio for r in ocr_geometry.red_share_of_images(images).collect()} == {"a": 0.5, "b": 0.0, "c": 0.0}


@pytest.mark.parametrize("text, failed", [("+20 x .13 = +2.60", 0), ("-30 × .100 = -3.00", 0), ("-30 × .100 = +3.20", 1), ("2*3=6 and 2*3=7", 1), ("3 x 1,5 = 4.5", 0), ("", 0)])
def test_products(spark, text, failed):
    assert spark.range(1).select(validation.failed_products(F.lit(text)).alias("n")).first().n == failed


def test_quota_opens_the_circuit(spark):
    rows = [("d", 0, "blocked", "RESOURCE_EXHAUSTED", None, False), ("d", 1, "needs_visual_review", None, "machine_verified_with_visual_check", False), ("d", 2, "image_only", None, "image_only", False), ("e", 0, "blocked", None, "blocked", True)]
    df = spark.createDataFrame(rows, "doc_id string, ordinal int, status string, error string, reviewed_status string, repaired boolean")
    got = [(r.attempted, r.status_after, r.review_alert, r.calls) for r in validation.review_budget(df).orderBy("doc_id", "ordinal").collect()]
    assert got == [
        (True, "human_review_required", "gemini_visual_review_failed", 1),
        (False, "human_review_required", "gemini_visual_review_quota_exhausted", 0),
        (False, "image_only", None, 0),
        (True, "blocked", None, 2),
    ]
    held = validation.review_budget(df, preserve_block=True).where("doc_id = 'd' AND ordinal = 0").first()
    assert held.status_after == "blocked"
    assert validation.review_budget(df, budget=0).where("attempted").count() == 0


def test_usage_costs(spark):
    usage = spark.createDataFrame([("m", "success", 1000, 500), ("n", "failed", 1, 1)], "model string, status string, input_tokens long, output_tokens long")
    prices = spark.createDataFrame([("m", "1", "3"), ("n", "free", "0")], "model string, input_per_1m string, output_per_1m string")
    priced = jobs.cost(usage, prices)
    total = jobs.usage_summary(priced, jobs.budget_usd(F.lit("2"))).first()
    assert (total.estimated_cost_usd, total.budget_remaining_usd, total.request_count, total.successful_requests) == (0.0025, 1.9975, 2, 1)
    assert jobs.usage_summary(priced, jobs.budget_usd(F.lit("-1"))).first().budget_remaining_usd is None
    log = spark.createDataFrame([('{"model":"m","input_tokens":3}',), (" ",)], "value string")
    assert jobs.read_usage(log).select("model", "status", "output_tokens").collect() == [("m", "unknown", 0)]


def test_last_write_keeps_the_first_place(spark):
    rows = [("p", "u1", 1, "a", "failed"), ("p", "u2", 2, "b", "done"), ("p", "u1", 3, "c", "done")]
    got = jobs.upsert(spark.createDataFrame(rows, "playlist_title string, url string, seq long, title string, status string")).orderBy("position").collect()
    assert [(r.url, r.position, r.title) for r in got] == [("u1", 1, "c"), ("u2", 2, "b")]
    videos = spark.createDataFrame([("u1",), ("u3",)], "url string")
    assert [r.url for r in jobs.still_to_do(videos, spark.createDataFrame(got)).collect()] == ["u3"]


def test_regression_cases_are_all_expected(spark):
    expected = spark.createDataFrame(list(scoring.REGRESSION_CASES.items()), "id string, difficulty string")
    rows = [(i, k, v, "covered", ["t"], []) for i, (k, v) in enumerate(scoring.REGRESSION_CASES.items())]
    observed = spark.createDataFrame(rows, "row_no int, id string, difficulty string, status string, tests array<string>, real_annotations array<string>")
    assert scoring.regression_errors(expected, observed).count() == 0
    report = scoring.regression_report(expected, observed, scoring.regression_errors(expected, observed)).first()
    assert (report.status, report.cases_covered, report.synthetic_regression_coverage) == ("pass", 19, 1.0)
    worse = observed.where("id <> 'G02'")
    assert [tuple(r) for r in scoring.regression_errors(expected, worse).collect()] == [("missing_case", "G02")]


def test_markdown_of_tables_and_structures(spark):
    row = spark.range(1).select(
        resolution.markdown_table(F.array(F.lit("a"), F.lit("b")), F.array(F.array(F.lit("x|y")), F.array(F.lit("1"), F.lit("2\n3"), F.lit("4")))).alias("t"),
        resolution.is_quantitative_table(F.lit('{"content":[{"type":"table","data":[[1]]}]}')).alias("q"),
        resolution.is_quantitative_table(F.lit('{"columns":["a"]}')).alias("n"),
    ).first()
    assert row.t == "| a | b |\n| --- | --- |\n| x\\|y |  |\n| 1 | 2<br>3 |" and row.q and not row.n


def test_adapters_isolate_failures(spark):
    docs = spark.createDataFrame([("good", bytearray(b"p1\fp2\f")), ("bad", bytearray(b"!"))], "doc_id string, content binary")

    def decoder(content):
        if content == b"!":
            raise ValueError("broken")
        return [(t, 0) for t in content.decode().split("\f")]

    pages = adapters.decode_pages(docs, decoder)
    got = {r.doc_id: r.markdown for r in adapters.pages_as_markdown(pages).collect()}
    assert got == {"good": "# Page 1\n\np1\n\n# Page 2\n\np2", "bad": None}
    assert pages.where("error = 'ValueError: broken'").count() == 1

    def model(instructions, text, name):
        if text == "quota":
            raise RuntimeError("quota exceeded")
        if text == "down":
            raise OSError("down")
        return text.upper()

    rows = spark.createDataFrame([("ok", "m"), ("quota", "m"), ("down", "m")], "text string, model string")
    assert {r.text: (r.answer, r.calls) for r in adapters.call_model(rows, model, "").collect()} == {"ok": ("OK", 1), "quota": (None, 1), "down": (None, 3)}
    assert adapters.ocr_command(3, "eng", "a.pdf", "b.pdf")[-4:] == ["--pages", "1-3", "a.pdf", "b.pdf"]


def test_files_and_paths(spark, tmp_path):
    for name in ("b.en.txt", "a.txt", "a-orig.txt", "yt-dlp.log"):
        (tmp_path / name).write_text("x")
    found = files.local_transcripts(files.read_files(spark, str(tmp_path), "*"))
    assert sorted(r.title for r in found.collect()) == ["a", "b"]
    assert files.stale_files(files.read_files(spark, str(tmp_path), "*"), 1).count() == 0
    rows = spark.createDataFrame([("/x/a.sidecar.json",), ("/x/b.json",)], "p string").select(sinks.resolved_paths(F.col("p")).alias("r"))
    assert [r.r.sidecar for r in rows.collect()] == ["/x/a.resolved.sidecar.json", "/x/b.resolved.json"]
    inside = spark.range(1).select(*[sinks.is_inside(F.lit(p), F.lit("/out")).alias(f"c{i}") for i, p in enumerate(("/out/a", "/out", "/outer", "/out/../a"))]).first()
    assert list(inside) == [True, True, False, False]


def test_hints_and_checks_over_all_rows_and_whole_texts(spark):
    from __spark_entry__ import queries

    sf, run = "/root/testdata/sf0.001", queries()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    formula = re.compile(r"[∑∫√≈≤≥∞]|\b[a-zA-Z]\s*=\s*[-+*/()\w\s]+")
    assert {r.doc_id: r.hints for r in run["a3_formula_hints_all"](spark, sf).collect()} == {d.doc_id: len(formula.findall(d.text.replace(". ", " x = 3+2; "))) for d in docs}
    pages = {}
    for d in sorted(docs, key=lambda d: d.doc_id):
        pages.setdefault(f"{d.source}/{d.doc_id % 97}", []).append(d.text)
    got = {r.doc_id: r.extracted_chars for r in run["a5_complexity_whole"](spark, sf).collect()}
    assert max(map(len, pages.values())) <= 8 and got == {k: len("\n".join(t).strip(" \n")) for k, t in pages.items()}
    assert run["a7_engine_order_whole"](spark, sf).count() == len(pages)
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct().count()
    checked = run["v3_checks_all"](spark, sf)
    assert checked.select("l_orderkey", "l_linenumber").distinct().count() == lines
    for r in checked.where("l_linenumber > 3").collect():
        assert ("arithmetic_check_failed" in r.alerts) == (r.l_orderkey % 7 == 0 and (r.q * r.d + 3) % 10 != 0)


def test_covered_boxes_by_grid(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    n = 20_000
    at, side = rng.uniform(-50, 3000, (n, 2)), rng.choice([0.0, 0.5, 4.0, 32.0, 33.0, 250.0], (n, 2)) * rng.choice([1.0, 0.97], (n, 1))
    boxes = pd.DataFrame({"doc_id": "d", "page_index": 0, "ordinal": range(n), "element_type": rng.choice(["table", "figure", "chart", "formula"], n)})
    boxes["number"] = [f"1.{i}" if i % 2 else None for i in range(n)]
    boxes[["x0", "y0"]], boxes[["x1", "y1"]] = at, at + side
    boxes.loc[n - 40 :, "number"] = "wide"  # boxes over most of the page, too
    boxes.loc[n - 40 :, ["x0", "y0", "x1", "y1"]] = [0.0, 100.0, 2900.0, 900.0]
    boxes.loc[0, "x0"] = None
    rows = spark.createDataFrame(boxes.astype(object).where(boxes.notna(), None), "doc_id string, page_index int, ordinal int, element_type string, number string, x0 double, y0 double, x1 double, y1 double")
    got = {r.ordinal for r in detection.covered_elements(rows).collect()}
    family = boxes.element_type.map({"table": "t", "figure": "f", "chart": "f"})
    want = set()
    for f in ("t", "f"):
        outer = boxes[(family == f) & boxes.number.notna()][["x0", "y0", "x1", "y1"]].to_numpy()
        for i, x0, y0, x1, y1 in boxes[(family == f) & boxes.number.isna()][["ordinal", "x0", "y0", "x1", "y1"]].itertuples(index=False):
            wide = np.clip(np.minimum(x1, outer[:, 2]) - np.maximum(x0, outer[:, 0]), 0, None)
            high = np.clip(np.minimum(y1, outer[:, 3]) - np.maximum(y0, outer[:, 1]), 0, None)
            area = (x1 - x0) * (y1 - y0)
            if area > 0 and (wide * high / area >= 0.7).any():
                want.add(int(i))
    assert got == want and len(want) > 100
    assert detection.covered_elements(rows.limit(0)).count() == 0


def test_page_numbers_as_near_but_for_rounding_go_by_text(spark):
    page = [("d", 0, 0, 0, "99", 0.0, 0.0, 20.0, 10.0), ("d", 0, 1, 0, "137", 580.0, 0.0, 600.0, 10.0)]
    sheet = [("d", 0, 600.0, 800.0, 0, "native", 1.0, [], "")]
    got = detection.margin_numbers(spark.createDataFrame(page, BLOCKS), spark.createDataFrame(sheet, PAGES))
    assert [r.printed for r in got.collect()] == ["137"]


@pytest.mark.parametrize("value, plain", [("a&amp<p>b</p>", "a&ampb"), ("&lt;b&gt; &amp;copy; &#39;&#x41;", "<b> &copy; 'A"), ("&ampx; &nosuch; &", "&ampx; &nosuch; &")])
def test_references_without_a_semicolon_stay(spark, value, plain):
    from quirelake.functions.text import inline_text

    got = spark.createDataFrame([(value,)], "v string").select(inline_text(F.col("v"), closed=True).alias("o"), inline_text(F.col("v")).alias("html"))
    assert got.first().o == plain
    assert value[0] != "a" or got.first().html == "a&b"


def _planned(spark, column, **columns):
    frame = spark.createDataFrame([tuple(columns.values())], list(columns))
    return frame.select(column.alias("o"))._jdf.queryExecution().optimizedPlan().toString()


def test_what_is_parsed_is_parsed_once(spark):
    box = detection.intersect_page(detection.parse_bbox(F.col("t")), F.lit(300.0), F.lit(400.0))
    assert _planned(spark, box, t="1,2,3,4").count("split(") == 1
    assert _planned(spark, validation.review_violations(F.col("t"), F.lit("p1")), t="{}").lower().count("parse_json") <= 1
    assert _planned(spark, validation.failed_products(F.col("t")), t="2 x 3 = 6").count("regexp_extract_all(") == 1


@pytest.mark.parametrize(
    "text, failed",
    [("2 x .5 = 1 and 2*3=7", 1), ("−2 × 3,5 = -7.0", 0), ("0.3 x 0.3 = 0.1", 0), ("0.3 x 0.5 = 0.2", 0), ("0.31 x 0.5 = 0.1", 1), ("99999999 x 999999999 = 99999998900000001", 0), ("99999999 x 999999999 = 99999998900000002", 1),
     ("999999999999 x 999999999999 = 999999999998000000000001", 0), ("999999999999 x 999999999999 = 999999999998000000000000", 1), ("-0.000000001 x 1 = 0", 0), ("2 x 3 = 6.0000000000000001", 1), ("2 x 3 = 6.00000000000000001", 1)],
)
def test_products_short_and_long(spark, text, failed):
    from decimal import Decimal as D
    from decimal import localcontext

    a, b, c = (D(x.strip().replace("−", "-").replace(",", ".")) for x in re.split(r"[x×*=]", text.split(" and ")[-1]))
    with localcontext() as exact:
        exact.prec = 60
        assert (2 * abs(a * b - c) > D(1).scaleb(c.as_tuple().exponent)) == bool(failed) or " and " in text
    assert spark.createDataFrame([(text,)], "t string").select(validation.failed_products(F.col("t")).alias("o")).first().o == failed


def test_tables_are_looked_for_once_a_use(spark):
    seen = detection.with_table_candidate(spark.createDataFrame([("a  b\n1  2\n3  4",)], "text string")).where("columns IS NOT NULL")
    plan = seen.select("columns", "table", "table_confidence")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct(") <= 2  # where it is filtered, and where it is read
    assert (seen.first().columns, len(seen.first().table)) == (2, 3)


def _planned_exchanges(rows):
    return rows._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_elements_are_told_apart_where_their_pages_are(spark):
    """What is shuffled fills executors' disks: elements aren't dealt again, for links only captions and what may be linked to them."""
    cell = "a  b  c\n1  2  3\n-.5  3/4  x"
    rows = detect(spark, {0: [(0, "Figure 2.1 a", (0.0, 0.0, 9.0, 9.0)), (0, cell, (10.0, 20.0, 500.0, 60.0))], 1: [(0, "", (0.0, 0.0, 1.0, 1.0))]})
    assert _planned_exchanges(rows) == 0
    linked = detection.link_previous_page(rows).where("element_type = 'table'")
    assert linked.count() == 1 and _planned_exchanges(linked) <= 2


@pytest.mark.parametrize("most", [0, 7, 30, 31, 1000])
def test_pages_with_many_numbered_boxes_say_the_same(spark, monkeypatch, most):
    monkeypatch.setattr(detection, "CROWDED", most)
    monkeypatch.setattr(detection, "MOST_ELEMENTS", 60)
    cell = "a  b  c\n1  2  3\n-.5  3/4  x"
    pages = {}
    for p, n in ((0, 31), (1, 3), (2, 0), (3, 8)):
        captions = [(0, f"Table 1.{i // 2} sizes", (50.0, 24.0 * i + 10, 200.0, 24.0 * i + 14)) for i in range(n)]
        inside = [(0, cell, (20.0 + i % 3, 24.0 * i + 12, 300.0, 24.0 * i + 20 + 30 * (i % 2))) for i in range(31)]
        pages[p] = inside + captions + [(0, "y = a*x + 1", (20.0, 12.0, 300.0, 20.0)), inside[1]]
    got = detect(spark, pages).collect()
    # equal boxes of the last block and of captions that were repeated
    assert len({(r.page_index, r.ordinal) for r in got}) == len(got)
    boxes = {p: {i: r for i, r in enumerate(_boxes(rows))} for p, rows in pages.items()}
    want = set()
    for p, held in boxes.items():
        left = {i: b for i, b in held.items() if b[0] != "table" or b[1] or not any(o[0] == "table" and o[1] and _share(b, o) >= 0.7 for o in held.values())}
        seen = set()
        for i, b in sorted(left.items()):
            if (b[0], b[2:]) not in seen and len(want & {(p, j) for j in held}) < 60:
                seen.add((b[0], b[2:]))
                want.add((p, i))
    assert {(r.page_index, r.ordinal) for r in got} == want
    assert sum(r.element_id.endswith("-candidate-02") for r in got) == 15 + 1 + 4
    assert all(("duplicate_number_on_page" in r.alerts) == ("-candidate-" in r.element_id) for r in got)


def _boxes(blocks):
    """(element_type, number, box) of blocks in order of the page; captions reach down to the next one."""
    tops = [b[1] for _, t, b in blocks if t.startswith("Table")]
    for _, text, (x0, y0, x1, y1) in blocks:
        if text.startswith("Table"):
            below = [y for y in tops if y > y0 + 2]
            low = min(800, y0 + 440)
            yield "table", text.split()[1], 8.0, max(0.0, y0 - 8), 592.0, max(y1, min(low, max(y1, min(below) - 8)) if below else low)
        else:
            yield "formula" if "=" in text else "table", None, x0, y0, x1, y1


def _share(inner, outer):
    wide, high = (min(inner[4 + k], outer[4 + k]) - max(inner[2 + k], outer[2 + k]) for k in (0, 1))
    return max(0, wide) * max(0, high) / ((inner[4] - inner[2]) * (inner[5] - inner[3]))


def test_page_texts_stay_where_they_are_read(spark):
    blocks = spark.createDataFrame([("d", 0, 0, 0, "99", 0.0, 0.0, 20.0, 10.0)], BLOCKS)
    pages = spark.createDataFrame([("d", 0, 600.0, 800.0, 0, "native", 1.0, [], "7\nChapter 3 Options\n")] + [("d", 1, 600.0, 800.0, 0, "native", 1.0, [], "12\nprose")], PAGES)
    known = detection.page_identity(pages, blocks)
    assert [(r.printed_page_raw, r.pdf_page_number) for r in known.orderBy("page_index").collect()] == [("99", 1), ("12", 2)]

    def joins(node):
        here = [node.left().output().mkString(",")] if node.nodeName() == "Join" else []
        return here + [j for i in range(node.children().size()) for j in joins(node.children().apply(i))]

    plan = known.select("doc_id", "printed_page_raw", "chapter")._jdf.queryExecution().optimizedPlan()
    assert joins(plan) and not any("page_text" in j for j in joins(plan))


def test_blocks_that_are_left_out_before_are_no_elements(spark):
    texts = ["Figure 2-1 a", "FIGURE 14.1 shows volume", "  table\n3.1 sizes", "fig. 7", "a  b  c\n1  2  3\n-.5  3/4  x", "a  b\r1  2\r3  4", "y = a*x + 1", "σ", "x ≤ 3", "a=", "= b", "", " \n ", "249", "plain prose of a block", "one line  and  1  2  3", None, "Figures speak"]
    blocks = [("d", p, i, 0, t, 10.0, 30.0 * i, 300.0, 30.0 * i + 20) for p in range(2) for i, t in enumerate(texts)] + [("d", 0, len(texts), 1, "prose", 0.0, 0.0, 500.0, 500.0), ("d", 0, len(texts) + 1, None, "prose", 0.0, 0.0, 500.0, 500.0)]
    frame = spark.createDataFrame(blocks, BLOCKS)
    pages = spark.createDataFrame([("d", p, 600.0, 800.0, 0, "native", 1.0, [], "") for p in range(2)], PAGES)
    rows = detection.classify_blocks(frame, pages).withColumn("m", detection._matters(F.col("text"))).collect()
    left_out = {r.text for r in rows if r.block_type == 0 and not r.m}
    assert {"plain prose of a block", "249", "one line  and  1  2  3", "", None} <= left_out
    assert not any(r.element_type or r["__told"] for r in rows if r.block_type == 0 and not r.m)
    want = sorted((r.page_index, r.block_ordinal) for r in rows if r.element_type)
    assert len(want) > 10 and detection.detect_elements(frame, pages).count() <= len(want)
