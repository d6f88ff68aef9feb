import json
import random
import time

import pytest
from pyspark.sql import functions as F

from quirelake.functions import text as tx
from quirelake.operators import chunks, detection, flows, lines, validation
from quirelake.plans.source_queries import counting_model
from quirelake.sources import adapters, files, sinks
from quirelake.sources import file_per_row as fpr


def brute_clean(text):
    text = text.replace("\r\n", "\n")
    while "\n" * 4 in text:
        text = text.replace("\n" * 4, "\n" * 3)
    rows = [(x.rstrip(), x.strip()) for x in text.split("\n")]
    times = [s for _, s in rows]
    heads = {s for s in times if s and len(s) <= 80 and s[0] not in "#|*-" and times.count(s) >= 4}
    out, last = [], None
    for line, s in rows:
        marker = s.lower().replace("page ", "").replace(" ", "").replace("/", "")
        if s in heads or (s and marker.isdigit() and (s.lower().startswith("page ") or "/" in s)):
            continue
        if s and s == last:
            continue
        last = s or last
        out.append(line)
    body = "\n".join(out)
    while "\n\n\n" in body:
        body = body.replace("\n\n\n", "\n\n")
    body = body.strip()
    return body + "\n" if body else ""


def test_cleaning_keeps_rows_apart(spark):
    head = "Head\nfirst\nHead\nsecond\n Head \nthird\nHead\n"
    rows = [(1, head + "Page 3\nthird\n\n\n\n\n\nthird\nlast  "), (1, "Head\nother\r\nother"), (None, "no id\nno id"), (None, "7 / 12\nleft"), (2, None), (3, ""), (4, "x\n" * 5 + "- x\n" * 5)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, s string")
    got = sorted(((r.doc_id, r.clean) for r in lines.with_clean_markdown(docs).collect()), key=str)
    assert got == sorted(((i, None if t is None else brute_clean(t)) for i, t in rows), key=str)
    heads = {(r.doc_id, r.header) for r in lines.running_headers(docs).collect()}
    assert heads == {(1, "Head"), (4, "x")}


def test_a_filter_on_cleaned_text_ends(spark):
    text = "\n".join(f"line {i} of some words\nPage {i}\nHead" for i in range(300))
    cleaned = lines.with_clean_markdown(spark.createDataFrame([(i, text) for i in range(20)], "doc_id long, text string"))
    kept = cleaned.where((F.char_length("clean") > 10) & (chunks.count_tokens(F.col("clean")) < 10**6))
    assert {r.clean for r in kept.collect()} == {brute_clean(text)}
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(") < 4 * cleaned._jdf.queryExecution().optimizedPlan().toString().count("transform(")


def test_a_million_lines_in_one_text(spark):
    n = 1 << 20
    text = F.concat_ws("\n", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(F.lit("row "), F.floor(i / 4 * F.when(i % 2 == 0, 1).otherwise(0)).cast("string"))))
    row = lines.with_clean_markdown(spark.range(1).select(text.alias("text"))).where(F.char_length("clean") > 1).select(F.size(F.split("clean", "\n")).alias("n")).first()
    assert row.n == n // 4  # `row 0` is a header; of the others each comes twice, side by side, and the text ends with a line feed


def brute_pack(parts, limit):
    done, held = [], None
    for part in parts:
        if held is not None and max(1, len(f"{held}\n\n{part}") // 4) <= limit:
            held = f"{held}\n\n{part}"
        else:
            done, held = done + ([held] if held is not None else []), part
    return done + ([held] if held is not None else [])


def brute_chunks(text, limit):
    found, now = [], []
    for i, line in enumerate(text.splitlines()):
        if i and line.startswith("#"):
            found, now = [*found, now], []
        now.append(line)
    out, held, n = [], [], 0
    for part in filter(None, ("\n".join(lines_).strip() for lines_ in [*found, now])):
        own = max(1, len(part) // 4)
        if held and (n + own > limit or own > limit):
            out, held, n = [*out, "\n\n".join(held)], [], 0
        if own > limit:
            out += brute_pack([p.strip() for p in part.split("\n\n") if p.strip()], limit)
        else:
            held, n = [*held, part], n + own
    return out + (["\n\n".join(held)] if held else [])


@pytest.mark.parametrize("limit", [1, 5, 40, 10**6])
def test_chunks_by_brute_force(spark, limit):
    rng = random.Random(limit)
    piece = lambda: rng.choice(["# h", "word " * rng.randrange(60), "", "\n", " \n\n", "#", "x"])
    texts = ["\n".join(piece() for _ in range(rng.randrange(80))) for _ in range(60)] + ["", "\n\n", "# a\n\n" + "p\n\n" * 1500]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id int, t string")
    got = {r.doc_id: r for r in docs.select("doc_id", chunks.chunk_texts(F.col("t"), limit).alias("c"), chunks.split_long_section(F.col("t"), F.lit(limit)).alias("p")).collect()}
    assert got[len(texts)].c is None and got[len(texts)].p is None
    for i, text in enumerate(texts):
        assert got[i].c == brute_chunks(text, limit)
        assert got[i].p == brute_pack([p.strip() for p in text.split("\n\n") if p.strip()], limit)


@pytest.mark.parametrize("joint", ["\n\n", "\n# "])
def test_a_million_paragraphs_in_one_text(spark, joint):
    n = 1 << 20
    text = F.concat(F.lit("# a"), F.lit(joint), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.lit("para")), joint))
    row = spark.range(1).select(chunks.chunk_texts(text, 100).alias("c")).select(F.size("c").alias("n"), F.size(F.split(F.array_join("c", "\n"), "para")).alias("words")).first()
    assert row.words == n + 1 and row.n > n // 100


def test_engines_stop_at_the_first_usable_text(spark, tmp_path):
    calls = tmp_path / "calls"

    def engine(name, fails):
        def run(content):
            with calls.open("a") as log:
                log.write(f"{name} {content.decode()[:1]}\n")
            if content.decode()[0] in fails:
                raise ValueError(name)
            return "# T\n" + content.decode() * 50 if content.decode()[0] != "w" else "weak"

        return run

    engines = {"a": engine("a", "bc"), "b": engine("b", "c"), "c": engine("c", "c")}
    rows = [("ok text", ["a", "b", "c"]), ("b text", ["a", "b", "c"]), ("c text", ["a", "b", "c"]), ("weak", ["c", "a"]), ("x text", ["nobody", "b"]), ("n", []), (None, None)]
    files_ = spark.createDataFrame([(i, t, o, "clash") for i, (t, o) in enumerate(rows)], "doc_id int, t string, fallback_order array<string>, error string").withColumn("content", F.col("t").cast("binary"))
    got = {r.doc_id: (r.engine, [tuple(a) for a in r.attempts]) for r in adapters.extract_lazily(files_, engines).collect()}
    weak, bad = "unusable text", "ValueError: "
    assert got == {
        0: ("a", [("a", None)]), 1: ("b", [("a", bad + "a"), ("b", None)]), 2: (None, [(e, bad + e) for e in "abc"]), 3: (None, [("c", weak), ("a", weak)]),
        4: ("b", [("nobody", "KeyError: 'nobody'"), ("b", None)]), 5: (None, []), 6: (None, []),
    }
    assert sorted(calls.read_text().split("\n")[:-1]) == sorted(["a o", "a b", "b b", "a c", "b c", "c c", "c w", "a w", "b x"])


def test_usable_means_the_same_in_a_task(spark):
    texts = ["", "x" * 300, "#" + "x" * 199, "#" + "x" * 198, "\u2003# " + "y" * 200, "z\x0b#" + "y" * 200, "\n\n".join(["p" * 81] * 3), "\n\n".join(["p" * 80] * 3), "\n\n".join([" " + "p" * 81 + " "] * 2 + ["q" * 100])]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", lines.is_usable_markdown(F.col("t"))).collect()
    assert {r[0]: r[1] for r in got} == {t: adapters.usable(t) for t in texts}


@pytest.mark.parametrize("batch", [7, 10000])
def test_a_review_stops_at_its_budget_and_at_a_quota_error(spark, tmp_path, batch):
    calls = tmp_path / "calls"

    def reviewer(element):
        with calls.open("a") as log:
            log.write(f"{element['doc_id']} {element['ordinal']}\n")
        if element["doc_id"] == 2 and element["ordinal"] == 11:
            raise RuntimeError("Quota exceeded for today")
        if element["ordinal"] % 9 == 4:
            raise TimeoutError("slow")
        return {"media_readable": True, "observed_type": element["element_type"], "recommended_status": "machine_verified_with_visual_check", "disagreements": [], "n_ambiguous": 0, "n_missing": 0, "repaired": element["ordinal"] % 5 == 1}

    rows = [(d, i // 10, i, "table", "needs_visual_review" if i % 4 else "image_only", ["x"]) for d, n in ((1, 90), (2, 60), (3, 5), (None, 50)) for i in range(n)]
    elements = spark.createDataFrame(rows, "doc_id int, page_index int, ordinal int, element_type string, status string, alerts array<string>").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        seen = adapters.review_in_order(elements, reviewer, 40).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    made = [line.split() for line in calls.read_text().splitlines()]
    assert sorted(made) == sorted([[str(d), str(i)] for d, n in ((1, 40), (2, 12), (3, 5), (None, 40)) for i in range(n)])
    # the window form, told what each call would give, says the same
    told = elements.withColumns(
        {
            "error": F.when((F.col("doc_id") == 2) & (F.col("ordinal") == 11), "Quota exceeded for today").when(F.col("ordinal") % 9 == 4, "slow"),
            "repaired": F.col("ordinal") % 5 == 1, "reviewed_status": F.lit("machine_verified_with_visual_check"),
        }
    )
    window = {(r.doc_id, r.ordinal): (r.attempted, r.circuit_open, r.status_after, r.fallback_reason) for r in validation.review_budget(told).collect()}
    again = validation.settled(adapters.review_in_order(elements, reviewer, 40).withColumn("reviewed_status", F.lit("machine_verified_with_visual_check")))
    assert {(r.doc_id, r.ordinal): (r.attempted, r.circuit_open, r.status_after, r.fallback_reason) for r in again.collect()} == window
    assert all((r.observed_type == "table") == (r.attempted and r.error is None) for r in seen)


def test_files_to_notes_in_one_run(spark):
    body = "# T\n" + "many words here. " * 30
    rows = [(1, "One", "a.pdf", body, ["bad", "good"]), (2, "Two", "b.pdf", "short", ["bad", "good"]), (3, "Three", "c.pdf", None, ["good"])]
    files_ = spark.createDataFrame(rows, "doc_id long, title string, source_file string, t string, fallback_order array<string>").withColumn("content", F.col("t").cast("binary")).drop("t")

    def bad(content):
        raise RuntimeError("broken")

    got = {r.doc_id: r for r in flows.run_files(files_, {"bad": bad, "good": lambda content: content.decode()}, lambda told, text, model: "fine", "sum up", 800, 300).collect()}
    assert (got[1].status, got[1].engine, len(got[1].attempts)) == ("done", "good", 2) and got[1].summary.endswith("\nfine\n")
    assert (got[2].status, got[2].engine, got[2].attempts[1].error) == ("unusable", None, "unusable text")
    assert got[3].status == "unusable" and "AttributeError" in got[3].attempts[0].error


def test_white_space_of_any_script(spark):
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    texts = ["".join(blanks) + "a b" + "".join(reversed(blanks)), "​x", "", "".join(blanks)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.strip(F.col("t")), tx.rstrip(F.col("t"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {i: (t.strip(), t.rstrip()) for i, t in enumerate(texts)}
    ends = ["a\r\nb\rc\vd\fe\x1cf\x85g h", "one\n", "\n", "", "a\n\n"]
    split = spark.createDataFrame([(t,) for t in ends], "t string").select("t", tx.split_lines(F.col("t"))).collect()
    assert {r[0]: r[1] for r in split} == {t: t.splitlines() for t in ends}


def test_documents_end_to_end(spark):
    prose = "# Title\n" + "\n\n".join(f"Paragraph {i} says a thing or two about number {i}." for i in range(60))
    texts = {1: "short", 2: prose[:400], 3: prose, 4: None, 5: prose + "xx"}
    docs = spark.createDataFrame([(i, f'T "{i}"', "in/a.pdf", t) for i, t in texts.items()], "doc_id long, title string, source_file string, markdown string")
    got = {r.doc_id: r for r in flows.run_documents(docs, counting_model, "sum up", 200, 100).collect()}
    assert len(got) == len(texts) and got[1].status == got[4].status == "unusable" and got[1].summary is got[1].transcription is None
    cut = {r.doc_id: r.c for r in spark.createDataFrame([(i, brute_clean(t)) for i, t in texts.items() if t], "doc_id long, t string").select("doc_id", chunks.chunk_texts(F.col("t"), 100).alias("c")).collect()}
    for i in (2, 3, 5):
        clean = brute_clean(texts[i])
        calls = [clean] if len(clean) // 4 <= 200 else [f"PARTIE {k + 1}/{len(cut[i])}\n\n{c}" for k, c in enumerate(cut[i])]
        failed = [len(c) % 17 in (3, 5) for c in calls]
        if len(calls) > 1 and not any(failed):
            calls = ["\n\n---\n\n".join(f" pdf_chunk: {len(c)}\n" for c in calls)]
            failed = [len(calls[0]) % 17 in (3, 5)]
        assert got[i].status == ("summary_unavailable" if any(failed) else "done")
        assert got[i].transcription.endswith("\n\n" + clean) and (got[i].export is None) == any(failed)
        if not any(failed):
            assert got[i].summary.endswith(f": {len(calls[0])}\n") and got[i].summary.startswith(f'---\ntitle: "T \\"{i}\\""\n')


def test_sinks_write_and_read_again(spark, tmp_path):
    rows = spark.createDataFrame([('{"b":[1,{"z":null,"a":"é"}],"a":1}',)], "value string")
    sinks.write_json(rows.coalesce(1), f"file://{tmp_path}/json")
    (path,) = (tmp_path / "json").glob("part-*")
    assert path.read_text() == json.dumps(json.loads(rows.first()[0]), ensure_ascii=False, indent=2, sort_keys=True) + "\n"
    events = spark.createDataFrame([("m", 3, None)], "model string, input_tokens long, error string")
    for _ in range(2):
        sinks.append_usage(events, f"file://{tmp_path}/log")
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/log").collect()] == ['{"model":"m","input_tokens":3,"error":null}'] * 2
    (tmp_path / "a.pdf").write_bytes(b"x")
    assert files.read_files(spark, f"file://{tmp_path}", "*.pdf").count() == 1


def test_tokens_by_a_file(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path, texts = public.path("byte_bpe_50k.json"), ["", "two words", "é 漢字\n\n", "x" * 5000]
    docs = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    own = Tokenizer.from_file(path)
    assert {r[0]: r[1] for r in docs.select("t", tx.token_counter(path)(F.col("t"))).collect()} == {None: None} | {t: len(own.encode(t, add_special_tokens=False).ids) for t in texts}
    for file, way in ((path, "file"), ("/nowhere", "estimate")):
        assert {r[0]: r[1].way for r in docs.select("t", tx.counted_by(file)(F.col("t"))).collect()} == {None: None} | {t: way for t in texts}
    assert {r[0]: r[1] for r in docs.select("t", tx.token_counter("/nowhere")(F.col("t"))).collect()} == {None: None} | {t: max(1, len(t) // 4) for t in texts}


def test_a_caption_sees_the_next_one_further_down(spark):
    block = "doc_id long, page_index int, block_ordinal int, block_type int, text string, x0 double, y0 double, x1 double, y1 double"
    rows = [(1, 0, i, 0, f"Table {i} t", 10.0, y, 90.0, y + 5) for i, y in enumerate((100.0, 102.0, 102.5, 300.0))]
    blocks = spark.createDataFrame(rows, block)
    pages = spark.createDataFrame([(1, 0, 600.0, 800.0)], "doc_id long, page_index int, width double, height double")
    got = {r.block_ordinal: r.next_caption for r in detection.classify_blocks(blocks, pages).collect()}
    assert got == {0: 102.5, 1: 300.0, 2: 300.0, 3: None}


def test_choice_of_an_element(spark):
    elements = spark.createDataFrame([(1, 0, 1, "b"), (1, 0, 0, "a")], "doc_id long, page_index int, ordinal int, element_id string")
    asked = spark.createDataFrame([(1, 0, None), (1, 0, "b"), (1, 0, "c"), (1, 1, None)], "doc_id long, page_index int, wanted string")
    got = {(r.element_id, r.error) for r in detection.choose_elements(asked, elements).collect()}
    assert got == {("a", None), ("b", None), (None, "unknown element c; available: a, b"), (None, "no element on this page; give a box")}


def test_programs_and_paths(spark):
    rows = [(" a  --b ", True, "/p"), ("", True, "/p"), (None, False, "/p"), (None, None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string, m boolean, p string").select(adapters.ocr_prefix(F.col("s"), F.col("m"), F.col("p"))).collect()]
    assert got == [["a", "--b"], ["python", "-m", "ocrmypdf"], ["/p"], None]


def test_a_file_for_each_document(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    rows = spark.createDataFrame([(f"a/{i}.json", f'{{"b":{i},"a":"é"}}') for i in range(30)] + [("none.json", None), ("bad.json", "{")], "name string, value string").repartition(4)
    fpr.write_files(rows, root, F.col("name"), sinks.sorted_json(F.col("value")))
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file()) == sorted(f"a/{i}.json" for i in range(30))
    assert (tmp_path / "out/a/7.json").read_text() == '{\n  "a": "é",\n  "b": 7\n}\n' and not (tmp_path / "out/_attempts").exists()
    again = rows.where("name = 'a/7.json'")
    fpr.write_files(again, root, F.col("name"), F.lit(b"\x00new"))  # a rerun replaces
    assert (tmp_path / "out/a/7.json").read_bytes() == b"\x00new" and len(list((tmp_path / "out/a").iterdir())) == 30


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    root = f"file://{tmp_path}"
    (tmp_path / "kept.txt").write_text("before")
    good = spark.range(40).select(F.when(F.col("id") == 0, "kept.txt").otherwise(F.concat(F.col("id").cast("string"), F.lit(".txt"))).alias("name"), F.lit("new").alias("value")).repartition(4)
    for broken in (F.when(F.col("name") == "39.txt", "../out.txt").otherwise(F.col("name")), F.when(F.col("name") == "39.txt", "38.txt").otherwise(F.col("name")), F.when(F.col("name") == "39.txt", F.raise_error(F.lit("killed"))).otherwise(F.col("name"))):
        with pytest.raises(Exception):
            fpr.write_files(good, root, broken, F.col("value"))
        for _ in range(50):  # tasks that outlive their job clear up as they end
            if len(list(tmp_path.iterdir())) > 1:
                time.sleep(0.1)
        assert [p.name for p in tmp_path.iterdir()] == ["kept.txt"] and (tmp_path / "kept.txt").read_text() == "before"


def test_manifests_are_saved_and_a_run_goes_on_from_them(spark, tmp_path):
    videos = spark.createDataFrame([(f"u{i}", f"T{i}", f"t{i}", None if i % 3 == 0 else f"WEBVTT\n\nsaid {i}") for i in range(9)], "url string, title string, slug string, subtitles string")
    model = lambda told, text, name: f"note of {text.strip()}"
    first = flows.run_videos(videos, model, "sum up", 400).drop("summary")
    items = first.withColumns({"playlist_title": F.lit("Été"), "position": F.substring("url", 2, 3).cast("int")})
    fpr.save_manifests(sinks.manifest_documents(items), f"file://{tmp_path}/jobs")
    assert [p.name for p in (tmp_path / "jobs").iterdir()] == ["playlist-ete_manifest.json"]
    saved = fpr.load_manifests(spark, f"file://{tmp_path}/jobs")
    assert [(r.position, r.url, r.status) for r in saved.orderBy("position").collect()] == [(i, f"u{i}", "failed" if i % 3 == 0 else "done") for i in range(9)]
    found = videos.withColumn("subtitles", F.lit("WEBVTT\n\nfound"))
    assert {(r.url, r.status) for r in flows.run_videos(found, model, "sum up", 400, saved).collect()} == {(f"u{i}", "done") for i in (0, 3, 6)}


def test_batches_of_long_texts_are_worked_off_in_slices():
    import pyarrow as pa

    from quirelake.sources import adapters

    batch = pa.RecordBatch.from_pydict({"i": list(range(30)), "text": ["x" * (1 << 20)] * 30})
    slices = list(adapters._slices(iter([batch, batch.slice(0, 0)])))
    assert max(s.num_rows for s in slices) <= 4 and [i for s in slices for i in s.column(0).to_pylist()] == list(range(30))


def test_a_staged_table_leaves_no_shuffle_files(spark):
    """They pile up to many times the table, and the driver may not collect garbage for long."""
    from quirelake.sources.staging import staged

    def files():
        return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",").count("/shuffle_")

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = files(), spark.conf.get(setting)
    made = staged(spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count(), "small")
    for _ in range(50):
        if files() <= before[0]:
            break
        time.sleep(0.1)
    assert files() <= before[0] and spark.conf.get(setting) == before[1]
    assert sorted(r["count"] for r in made.collect()) == [142] + [143] * 6


def test_a_reviewer_is_given_the_fields_that_it_reads(spark):
    from quirelake.operators import flows

    blocks = [("d", p, i, 0, text, 10.0, 20.0 * i, 300.0, 20.0 * i + 9) for p in range(3) for i, text in enumerate(["Figure 2.1 a", "a  b  c\n1  2  3\n-.5  3/4  x", "y = a*x + 1", "2 x 3 = 7  1\n1  2  3"])]
    frame = spark.createDataFrame(blocks, "doc_id string, page_index int, block_ordinal int, block_type int, text string, x0 double, y0 double, x1 double, y1 double")
    sheets = [("d", p, 600.0, 800.0, 0, "native", 1.0, ["scan_skew_detected"] if p == 1 else [], "") for p in range(4)]
    pages = spark.createDataFrame(sheets, "doc_id string, page_index int, width double, height double, rotation int, text_source string, text_confidence double, alerts array<string>, page_text string")

    def reviewer(element):
        if element["ordinal"] == 2:
            raise TimeoutError(",".join(sorted(element)) if len(element) < 10 else "all")
        return {"media_readable": True, "observed_type": element["element_type"], "recommended_status": "machine_verified_with_visual_check", "disagreements": [], "n_ambiguous": 0, "n_missing": 0, "has_formula": True}

    whole = flows.run_evidence(frame, pages, reviewer, 9)
    some = flows.run_evidence(frame, pages, reviewer, 9, reads=("page_index", "ordinal", "element_type"))
    assert {"table", "raw_text"} <= set(whole.columns) and not {"table", "raw_text"} & set(some.columns)
    told = {r.error for r in some.collect()} - {None}
    assert told == {"alerts,doc_id,element_type,has_rows,ordinal,page_index,status"}

    def said(rows):
        return sorted(tuple(r) for r in rows.select("page_index", "ordinal", "status_after", "attempted", "calls", "circuit_open", F.coalesce("review_alert", F.lit(""))).collect())

    assert said(some) == said(whole) and len(said(whole)) > 9


def test_an_evidence_run_leaves_its_elements_only(spark):
    from pathlib import Path

    from quirelake.plans import flow_queries

    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "quirelake"
    before = set(shared.iterdir()) if shared.exists() else set()
    made = flow_queries.o6_evidence_run(spark, "/root/testdata/sf0.001")
    assert [p.name.split("-")[0] for p in set(shared.iterdir()) - before] == ["elements"]
    assert made.selectExpr("sum(n)").first()[0] > 1000
