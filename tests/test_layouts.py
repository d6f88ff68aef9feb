import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, IsNull, Not

from quirelake.sources import layouts


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("layouts")
    rng = random.Random(5)
    for d in range(12):
        path = root / ("deep" if d % 3 == 0 else ".") / f"d{d}.jsonl"
        path.parent.mkdir(exist_ok=True)
        with open(path, "w") as out:
            for p in range(d):
                blocks = [{"block_type": b % 2, "text": f"é{b}\n" * rng.randrange(4) if b else None, "x0": 0.0, "y0": 1.0 * b, "x1": 9.5, "y1": 2.0} for b in range(rng.randrange(5))]
                out.write(json.dumps({"page_index": p, "width": 600.0, "height": 800.0, "rotation": 90 * (p % 2), "blocks": blocks}, ensure_ascii=False) + "\n" * (1 + p % 2))
    (root / "_attempts").mkdir()
    (root / "_attempts" / "x.jsonl").write_text("not a page")
    (root / "notes.txt").write_text("not a page")
    return root


def _direct(root):
    out = []
    for path in root.rglob("*.jsonl"):
        if "_attempts" not in str(path):
            doc = str(path.relative_to(root)).removesuffix(".jsonl")
            out += [(doc, page) for page in map(json.loads, filter(str.strip, path.read_text().split("\n")))]
    return out


@pytest.mark.parametrize("size", [40, 700, 1 << 26])
def test_every_page_once_whatever_the_ranges(spark, folder, size):
    pages = layouts.read_pages(spark, f"file://{folder}", layouts.json_lines, ending=".jsonl", partition_bytes=size)
    blocks = layouts.read_blocks(spark, f"file://{folder}", layouts.json_lines, ending=".jsonl", partition_bytes=size)
    direct = _direct(folder)
    want = sorted((d, p["page_index"], p["rotation"], "\n".join(b["text"] or "" for b in p["blocks"])) for d, p in direct)
    assert sorted((r.doc_id, r.page_index, r.rotation, r.page_text) for r in pages.collect()) == want
    assert pages.rdd.getNumPartitions() == 1 or size < 1 << 26
    got = sorted((r.doc_id, r.page_index, r.block_ordinal, r.block_type, r.text or "", r.y0) for r in blocks.collect())
    assert got == sorted((d, p["page_index"], i, b["block_type"], b["text"] or "", b["y0"]) for d, p in direct for i, b in enumerate(p["blocks"]))
    counts = {r.doc_id: r.page_count for r in layouts.page_counts(layouts.read_pages(spark, f"file://{folder}", layouts.json_lines, ("doc_id",), ending=".jsonl")).collect()}
    assert counts == {("deep/" if d % 3 == 0 else "") + f"d{d}": d for d in range(1, 12)}


def test_filters_choose_files_and_pages(spark, folder):
    opened, decoded = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counting(stream, start, end, wanted):
        opened.add(1)
        for page in layouts.json_lines(stream, start, end, wanted):
            decoded.add(1)
            yield page

    rows = layouts.read_blocks(spark, f"file://{folder}", counting, ("doc_id", "page_index", "text"), ending=".jsonl")
    asked = rows.where(F.col("doc_id").isin("d7", "d8", "none") & (F.col("page_index") >= 5) & ~(F.col("page_index") == 6) & (F.length("text") > 1))
    got = sorted((r.doc_id, r.page_index, r.text) for r in asked.collect())
    assert got == sorted((d, p["page_index"], b["text"]) for d, p in _direct(folder) if d in ("d7", "d8") and p["page_index"] in (5, 7) for b in p["blocks"] if len(b["text"] or "") > 1)
    assert opened.value == 2 and decoded.value == 3
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "doc_id" not in plan.split("Filter")[1].split("\n")[0] and rows.columns == ["doc_id", "page_index", "text"]
    assert layouts.is_known(In(("doc_id",), ("a",))) and layouts.is_known(Not(EqualTo(("page_index",), 1)))
    assert not any(map(layouts.is_known, (In(("doc_id",), ("a", None)), IsNull(("doc_id",)), EqualTo(("text",), "a"))))


def test_files_are_written_and_read_back(spark, tmp_path):
    pages = spark.createDataFrame([("a", 0, 1.0, 2.0, 0, "native_pdf_text", 1.0), ("a", 1, 1.0, 2.0, 90, "ocr", 0.5), ("b", 3, 1.0, 2.0, 0, "x", None)],
                                  "doc_id string, page_index int, width double, height double, rotation int, text_source string, text_confidence double")
    blocks = spark.createDataFrame([("a", 1, 1, 0, "zwei", 0.0, 0.0, 1.0, 1.0), ("a", 1, 0, 1, None, 0.0, 0.0, 1.0, 1.0)], layouts.BLOCK)
    root = f"file://{tmp_path}/out"
    layouts.write_json_lines(pages, blocks, root)
    got = layouts.read_pages(spark, root, layouts.json_lines, ending=".jsonl").orderBy("doc_id", "page_index").collect()
    assert [(r.doc_id, r.page_index, r.rotation, r.text_source, r.text_confidence, r.page_text) for r in got] == [("a", 0, 0, "native_pdf_text", 1.0, ""), ("a", 1, 90, "ocr", 0.5, "\nzwei"), ("b", 3, 0, "x", 1.0, "")]
    assert [tuple(r) for r in layouts.read_blocks(spark, root, layouts.json_lines, ending=".jsonl").orderBy("block_ordinal").collect()] == [tuple(r) for r in blocks.orderBy("block_ordinal").collect()]


def test_bundles_hold_many_documents(spark, tmp_path):
    names = [f"d{d}" for d in range(40)] + ['q"u,o\\te', "é/\U0001f600", ""]
    pages = [(d, p, 1.5, 2.0, 90 * (p % 2), "ocr" if p else None, None if p == 1 else 0.5) for i, d in enumerate(names) for p in range(i % 4)]
    blocks = [(d, p, b, b % 2, None if b == 2 else f'{b}\r\n "é', 0.1 * b, -0.0, 1e300, None) for d, p, *_ in pages for b in reversed(range(p * 2))]
    page_rows = spark.createDataFrame(pages, "doc_id string, page_index int, width double, height double, rotation int, text_source string, text_confidence double")
    root = f"file://{tmp_path}/out"
    layouts.write_bundles(page_rows.repartition(3), spark.createDataFrame(blocks, layouts.BLOCK), root)
    assert len(list((tmp_path / "out").glob("*.txt"))) <= 4  # not a file for each of 43 documents
    texts = {(d, p): "\n".join(t or "" for _, t in sorted((b, t) for dd, pp, b, _, t, *_ in blocks if (dd, pp) == (d, p))) for d, p, *_ in pages}
    want = sorted((d, p, r, s or "native_pdf_text", 1.0 if c is None else c, texts[d, p]) for d, p, _, _, r, s, c in pages)
    opened = layouts.json_bundles

    def one_by_one(stream, start, end, wanted):
        yield from opened(stream, start, end, wanted)

    one_by_one.splittable = one_by_one.bundles = True
    for decoder in (opened, one_by_one):
        for size in (150, 1 << 26):
            got = layouts.read_pages(spark, root, decoder, ending=".txt", partition_bytes=size)
            assert sorted((r.doc_id, r.page_index, r.rotation, r.text_source, r.text_confidence, r.page_text) for r in got.collect()) == want
            rows = layouts.read_blocks(spark, root, decoder, ending=".txt", partition_bytes=size).collect()
            assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, blocks))


def test_filters_pass_over_other_documents_of_a_bundle(spark, tmp_path):
    decoded = spark.sparkContext.accumulator(0)

    def counting(stream, start, end, wanted):
        for page in layouts.json_bundles(stream, start, end, wanted):
            decoded.add(1)
            yield page

    counting.bundles = True
    pages = spark.range(30).selectExpr("id % 10 doc_id", "cast(id as int) page_index", "1D width", "1D height", "0 rotation", "'x' text_source", "1D text_confidence")
    layouts.write_bundles(pages, spark.createDataFrame([], layouts.BLOCK.replace("doc_id string", "doc_id long")), f"file://{tmp_path}/out")
    asked = F.col("doc_id").isin("3", "none") & (F.col("page_index") > 3)
    for decoder in (counting, layouts.json_bundles):
        got = layouts.read_pages(spark, f"file://{tmp_path}/out", decoder, ("doc_id", "page_index"), ending=".txt").where(asked)
        assert sorted(map(tuple, got.collect())) == [("3", 13), ("3", 23)]
    assert decoded.value == 2


def test_layout_queries_write_no_file_a_document(spark, monkeypatch):
    from quirelake.plans import layout_queries

    made = []
    monkeypatch.setattr(layout_queries, "fresh_folder", lambda s, label, f=layout_queries.fresh_folder: made.append(f(s, label)) or made[-1])
    sf_dir = "/root/testdata/sf0.001"
    rows = layout_queries.s8_page_texts(spark, sf_dir)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    documents = orders.select("o_custkey").distinct().count()
    assert rows.count() == orders.count() + documents
    assert len(spark.read.text(made[0]).inputFiles()) < min(20, documents)


def test_joins_leave_bundles_as_tables(spark, tmp_path):
    alone = spark.sparkContext.accumulator(0)

    def decoder(stream, start, end, wanted):
        alone.add(1)
        yield from layouts.json_bundles(stream, start, end, wanted)

    decoder.bundles, decoder.tables = True, layouts.json_bundles.tables
    pages = spark.range(6).selectExpr("if(id < 4, id % 2, null) doc_id", "cast(id as int) page_index", "1D width", "1D height", "0 rotation", "'x' text_source", "1D text_confidence")
    layouts.write_bundles(pages, spark.createDataFrame([], layouts.BLOCK.replace("doc_id string", "doc_id long")), f"file://{tmp_path}/out")
    read = layouts.read_pages(spark, f"file://{tmp_path}/out", decoder, ("doc_id", "page_index"), ending=".txt")
    got = read.join(layouts.page_counts(read.select("doc_id")), "doc_id")
    assert sorted(map(tuple, got.collect())) == [("0", 0, 2), ("0", 2, 2), ("1", 1, 2), ("1", 3, 2)]
    assert alone.value == 0
    assert read.where("doc_id IS NOT NULL AND doc_id <> '1'").count() == 2 and alone.value > 0
    assert sorted(r.page_index for r in read.where("doc_id IS NULL").collect()) == [4, 5]
