"""Benchmark decontamination: one Aho-Corasick automaton over normalised test questions and answers."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm.common import free_name, map_texts, table, worker_cache, written

WIDTH = 10
#: Letters of all windows in one automaton, at most; a benchmark with more takes several, one after another.
AUTOMATON_LETTERS = 4 << 20

#: Bytes as they are compared: A-Z lower-cased, what isn't in a word a blank. Every byte keeps its place.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text: runs of ASCII letters and digits and of all that isn't ASCII, A-Z lower-cased."""
    return text.translate(NORMAL).split()


def _windows(words: list[bytes], width: int) -> set[bytes]:
    if not words:
        return set()
    return {b" ".join(words[i : i + width]) for i in range(max(len(words) - width, 0) + 1)}


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", texts: Sequence[str] = ("text",), width: int = WIDTH) -> DataFrame:
    """(window, item) rows, none twice: the windows of `width` words of each text of an item, or all its words if fewer."""

    def rows(found: list[bytes | None], part: pa.RecordBatch) -> list:
        return [[sorted(w.decode() for w in _windows(words_of(t or b""), width)) for t in found]]

    each = [
        map_texts(benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{t}`").alias("text")), ["item"], "text", "windows array<string>", rows)
        for t in texts
    ]
    every = each[0]
    for more in each[1:]:
        every = every.unionByName(more)
    return every.select("item", F.explode("windows").alias("window")).distinct()


def _automaton(patterns: list[tuple[str, list[str]]]):
    """Finds ` window ` in ` word word ... `, letters being UTF-8 bytes; gives the window's words and items."""
    import ahocorasick

    built = ahocorasick.Automaton()
    for window, items in patterns:
        built.add_word(" " + window.encode().decode("latin-1") + " ", (window.count(" ") + 1, items))
    built.make_automaton()
    return built


def _runs(text: bytes, built, runs: list[tuple[int, int]], items: list[str]) -> tuple[int, list[tuple[int, int]], list[str]]:
    """The text's words, the runs of hit ones (from, to) and the items that hit, those known before included."""
    words = words_of(text)
    hits = list(built.iter(" " + b" ".join(words).decode("latin-1") + " ")) if words else []
    if not hits:
        return len(words), runs, items
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    last = np.searchsorted(ends, [end for end, _ in hits])
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, last - np.array([k for _, (k, _) in hits]) + 1, 1)
    np.add.at(edges, last + 1, -1)
    for a, b in runs:
        edges[a] += 1
        edges[b] -= 1
    hit = np.concatenate([[0], np.cumsum(edges[:-1]) > 0, [0]]).astype(np.int8)
    turns = np.diff(hit)
    found = set(items).union(*{id(i): i for _, (_, i) in hits}.values())
    return len(words), list(zip(np.flatnonzero(turns == 1).tolist(), np.flatnonzero(turns == -1).tolist())), sorted(found)


def _spans(text: bytes, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """The runs as places in the original text, in characters."""
    if not runs:
        return []
    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(NORMAL))]
    out, at, chars = [], 0, 0
    for a, b in runs:
        start, end = places[a][0], places[b - 1][1]
        first = chars + len(text[at:start].decode())
        at, chars = end, first + len(text[start:end].decode())
        out.append({"start": first, "end": chars})
    return out


def find_leaks(docs: DataFrame, windows: DataFrame, text_col: str = "text", result: str = "__leaks", letters: int = AUTOMATON_LETTERS) -> DataFrame:
    """Every column of `docs` and a struct `result`: n_words, n_hit, spans (start, end: places of the runs of hit words in
    the text, in characters) and items (ids as strings, sorted).

    Words are normalised byte for byte, so a word's place in the normalised text is its place in the original. The text is
    scanned once by one automaton that every worker builds of the windows; `letters` bounds them, and a benchmark beyond
    it goes in equal shares, one pass over the texts each, whose runs and items add up. Windows of an item without an id
    hit words but name no item. A null or empty text has no words; an empty benchmark hits nothing. Rows are taken one by
    one, whatever their ids. No row is shuffled.
    """
    if result in docs.columns:
        raise ValueError(f"a column is named {result}; name another result")
    spark = docs.sparkSession
    known = written(windows.select("window", "item"), "windows")
    total = known.agg(F.sum(F.octet_length("window") + F.coalesce(F.octet_length("item"), F.lit(0)) + 2)).first()[0] or 0
    shares = max(1, -(-total // letters))
    marks, kept = free_name(docs, "__marks"), list(docs.columns)
    fields = "n_words:bigint,runs:array<struct<a:int,b:int>>,items:array<string>,spans:array<struct<start:int,end:int>>"
    rows = docs
    for share in range(shares):
        # at most `letters` of the benchmark, give or take what hashing leaves uneven
        of_share = known.where(F.pmod(F.xxhash64("window"), F.lit(shares)) == share)
        grouped = of_share.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
        patterns = spark.sparkContext.broadcast([(r.window, list(r.items)) for r in grouped.toLocalIterator()])
        rows = _pass(rows, kept, text_col, marks, fields, patterns, first=share == 0)
        if share < shares - 1:
            rows = written(rows, "leaks")
    found = F.col(marks)
    n_hit = F.aggregate(found["runs"], F.lit(0).cast("long"), lambda s, r: s + r["b"] - r["a"])
    made = F.struct(found["n_words"].alias("n_words"), n_hit.alias("n_hit"), found["spans"].alias("spans"), found["items"].alias("items"))
    return rows.select(*[F.col(f"`{c}`") for c in kept], made.alias(result))


def _pass(rows: DataFrame, kept: Sequence[str], text_col: str, marks: str, fields: str, patterns, first: bool) -> DataFrame:
    """One scan of the texts: `marks` with the runs and items of these windows and of those before."""
    key = f"leaks-{uuid.uuid4().hex}"
    carried = [*kept] if first else [*kept, marks]

    def scanned(texts: list[bytes | None], part: pa.RecordBatch) -> list:
        built = worker_cache(key, lambda: _automaton(patterns.value) if patterns.value else None)
        before = [None] * len(texts) if first else part.column(len(kept)).to_pylist()
        out = []
        for text, known in zip(texts, before):
            text = text or b""
            runs = [(r["a"], r["b"]) for r in known["runs"]] if known else []
            items = known["items"] if known else []
            n, runs, items = _runs(text, built, runs, items) if built is not None else (len(words_of(text)), runs, items)
            out.append({"n_words": n, "runs": [{"a": a, "b": b} for a, b in runs], "items": items, "spans": _spans(text, runs)})
        return [out]

    new = marks if first else f"{marks}_new"
    made = map_texts(rows, carried, text_col, f"`{new}` struct<{fields}>", scanned, cache=key)
    return made if first else made.drop(marks).withColumnRenamed(new, marks)


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    leaks = find_leaks(docs, benchmark_windows(table(spark, sf_dir, "benchmark"))).select("doc_id", "__leaks.*")
    return leaks.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"


OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_words("text")} AS w FROM documents), b AS (SELECT item_id::VARCHAR AS item_id, {_words("text")} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), {WIDTH}) AS k, array_to_string(w[p:p + least(len(w), {WIDTH}) - 1], ' ') AS win
            FROM b, unnest(generate_series(1, greatest(len(w) - {WIDTH}, 0) + 1)) AS u(p) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM windows),
seen AS (SELECT row, k, p, array_to_string(w[p:p + k - 1], ' ') AS win FROM d, ks, unnest(generate_series(1, len(w) - k + 1)) AS u(p)),
hits AS (SELECT row, p, seen.k, item_id FROM seen JOIN windows USING (win)),
hit_words AS (SELECT row, count(DISTINCT q) AS n FROM hits, unnest(generate_series(p, p + k - 1)) AS u(q) GROUP BY row),
items AS (SELECT row, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(hit_words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit_words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (row) LEFT JOIN items USING (row)
"""
