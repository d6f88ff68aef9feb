import random

import pytest
from pyspark.sql import functions as F

from quirelake.functions import text as tx
from quirelake.operators import chunks, complexity, lines


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("o")).first().o


@pytest.mark.parametrize("value", [None, "", " \t\n", " x ", "a\r\nb\x0bc\x0cd\x1ce\x85f g ", "end\n", "\n\n"])
def test_lines_and_strip_are_pythons(spark, value):
    assert one(spark, value, tx.split_lines) == (value.splitlines() if value is not None else None)
    assert one(spark, value, tx.strip) == (value.strip() if value is not None else None)


@pytest.mark.parametrize(
    "raw, value, sign, digits",
    [("-.0060", -0.006, "-", 4), (".0060", 0.006, None, 4), ("-3/4", -0.75, "-", 0), ("3/0", None, None, 0), ("−1,5", -1.5, "-", 1), ("1,120", 1.12, None, 3), ("+7", 7.0, "+", 0), ("n/a", None, None, 0)],
)
def test_cells(spark, raw, value, sign, digits):
    cell = one(spark, raw, tx.parse_cell)
    assert (cell.raw_ocr, cell.numeric_value, cell.sign, cell.decimal_digits) == (raw, value, sign, digits)
    assert cell.thousands_ambiguous == (raw == "1,120")


@pytest.mark.parametrize("text, tokens", [("-$50 and $-50", ["$50", "-50"]), ("1,000 or 1 000,5", ["1000", "1000.5"]), ("ends 0.", []), ("3/4", ["3", "4"]), ("−2,5", ["-2.5"]), ("a1 b", [])])
def test_number_tokens(spark, text, tokens):
    assert one(spark, text, tx.number_tokens) == tokens


@pytest.mark.parametrize("value, slug", [("Élan & Über_2", "elan-uber-2"), ("漢字", "item"), ("a" * 79 + "--b", "a" * 79), (" - ", "item")])
def test_slugs(spark, value, slug):
    assert one(spark, value, tx.safe_slug) == slug


def test_flattening_leaves_out_boxes_and_booleans():
    assert tx.flatten_json({"a": ["x", 1, True, None, {"bbox": [9], "b": 2.5}], "confidence": 3}) == "x\n1\n2.5"


def clean(spark, text):
    return lines.with_clean_markdown(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().clean


def test_markdown_is_cleaned(spark):
    assert clean(spark, "# T\r\nsame line \nPage 2\n\nsame line\n\n\n\n\n- item\n 3 / 9 \n") == "# T\nsame line\n\n- item\n"
    assert clean(spark, "Head\na\nHead\nb\n Head\nc\nHead \n# Head") == "a\nb\nc\n# Head\n"
    assert clean(spark, " \n\n") == "" and clean(spark, "") == "" and clean(spark, None) is None


def test_subtitles_are_said_text(spark):
    vtt = "WEBVTT\n\n00:01.000 --> 00:02.000\n<c>Hello &amp; you</c>\n\n00:02.000 --> 00:03.000\nHello  &amp; you\nNOTE x\n7\nnext\n"
    df = lines.with_subtitle_text(spark.createDataFrame([(vtt,), ("",), (None,)], "text string"))
    assert [r.clean for r in df.collect()][:2] == ["Hello & you\nnext\n", ""]


def test_sections_and_chunks(spark):
    text = "intro\n# one\nbody\n\n# two\n" + "\n\n".join("w" * 60 for _ in range(4))
    got = chunks.chunked(spark.createDataFrame([("d", text)], "doc_id string, text string"), 20).orderBy("index").collect()
    assert got[0].text == "intro\n\n# one\nbody" and [r["index"] for r in got] == list(range(len(got)))
    assert [r.token_count for r in got] == [max(1, len(r.text) // 4) for r in got]
    assert "\n\n".join(r.text for r in got[1:]) == text[text.index("# two") :]
    assert one(spark, "", lambda v: chunks.chunk_texts(v, 5)) == []


@pytest.mark.parametrize("tokens, route", [(100, "pdf_deep"), (101, "pdf_chunk")])
def test_routes_are_strict(spark, tokens, route):
    assert one(spark, tokens, lambda v: chunks.route_pdf(v, F.lit(100)), "int") == route


@pytest.mark.parametrize("pages, sample", [(0, []), (3, [0, 1, 2]), (8, list(range(8))), (100, [0, 1, 2, 25, 50, 75, 98, 99]), (9, [0, 1, 2, 4, 6, 7, 8])])
def test_sample_pages(spark, pages, sample):
    assert one(spark, pages, complexity.sample_indexes, "int") == sample


def test_engines(spark):
    there = F.create_map(*[F.lit(x) for e in ("ocrmypdf", "mineru", "text") for x in (e, True)])
    rows = spark.createDataFrame([(True, "high"), (False, "high"), (False, "medium"), (False, "low")], "s boolean, c string")
    got = [r.o for r in rows.select(complexity.engine_order(F.col("s"), F.col("c"), there).alias("o")).collect()]
    assert got == [["ocrmypdf", "mineru", "text"], ["mineru", "ocrmypdf", "text"], ["mineru", "text", "ocrmypdf"], ["text", "mineru", "ocrmypdf"]]
    none = rows.select(complexity.engine_order(F.col("s"), F.col("c"), F.create_map(F.lit("x"), F.lit(True))).alias("o")).first().o
    assert none == ["text"]


def test_every_code_point_folds(spark):
    import sys

    from quirelake.functions.folding import casefold

    every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    rows = [(i, "".join(every[i : i + 97])) for i in range(0, len(every), 97)] + [(-1, "Straße ΣΑΣ ς ŉ ﬃ İ"), (-2, ""), (-3, None), (-4, "PLAIN")]
    got = {r.i: r.folded for r in spark.createDataFrame(rows, "i int, t string").select("i", casefold(F.col("t")).alias("folded")).collect()}
    assert all(got[i] == (t and t.casefold()) if t else got[i] == t for i, t in rows)


def test_ascii_fold_of_every_code_point(spark):
    import sys
    import unicodedata

    every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    rows = [(i, "".join(every[i : i + 97])) for i in range(0, len(every), 97)] + [(-1, "Ångström ½ ㎏ ﬃ ⑽ 漢字 é"), (-2, ""), (-3, None), (-4, "Plain 1"), (-5, "한글")]
    folded = spark.createDataFrame(rows, "i int, t string").select("i", tx.ascii_fold(F.col("t")).alias("folded"))
    got = {r.i: r.folded for r in folded.collect()}
    assert all(got[i] == (t and unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()) for i, t in rows)
    assert "Python" not in folded._jdf.queryExecution().executedPlan().toString()


def test_providers_are_chosen_by_numbers_without_sorting(spark):
    names = [None, "", " Auto ", "auto", "a", "authors", "MISTRAL", "mistral2", "openai", "openai_compatible", "zz", "vllm", "é", "\U0001f600", "!"]
    keys = [None, " ", "k", "Your_API_key_here"]
    rng = random.Random(8)
    rows = [(s, rng.choice(names), rng.choice([*chunks.PROVIDERS, "other", None]), rng.choice(keys)) for s in range(300) for _ in range(rng.randrange(1, 6))] + [(None, "vllm", "gemini", "k")]
    chosen = chunks.choose_provider(spark.createDataFrame(rows, "setup int, explicit string, provider string, key string"))

    def brute(mine):
        explicit = max((e.strip().lower() for _, e, _, _ in mine if e is not None), default=None, key=lambda e: e.encode())
        if explicit not in (None, "", "auto"):
            return explicit if explicit in chunks.NAMED else None
        real = [p for _, _, p, k in mine if p in chunks.PROVIDERS and (k or "").strip() and (k or "").strip().lower() not in chunks.NO_KEYS]
        return min(real, key=chunks.PROVIDERS.index, default=chunks.PROVIDERS[0])

    got = {r.setup: r.provider for r in chosen.collect()}
    assert got == {s: brute([r for r in rows if r[0] == s]) for s in {r[0] for r in rows}}
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and chosen.schema.simpleString() == "struct<setup:int,provider:string>"
