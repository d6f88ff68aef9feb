"""Quality rules: counted base rules and language-specific perplexity bands under a Kneser-Ney model."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import ngram_model
from quirelake.llm.common import map_texts, scratch, table, written

MIN_WORDS = 50
#: A document fails when more than so many percent of its words lie in repeated 3-word windows.
MAX_REPEATED = 50
#: Bands around the medians of bits a character, under the model's orders 1, 2 and 3, of a language's distinct texts, in
#: units of their interquartile range: text this much less or this much more predictable is rejected.
BANDS = ((5.0, 3.0), (4.5, 15.0), (8.0, 12.0))
#: The range counts as this many bits at least.
LEAST_SPREAD = 0.05

_SYMBOLS = np.zeros(256, np.uint8)
_SYMBOLS[list(b"#*$%&|<>")] = 1
_IN_WORD = np.ones(256, np.uint8)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = 0
_IN_WORD[0x80:0xC0] = 0  # continuation bytes: a code point counts once

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _repeated_words(words: list[bytes]) -> int:
    n = len(words)
    if n < 3:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) > 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, at, count = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = count[at] > 1
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= again
    return int(inside.sum())


def base_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    text = text or b""
    words = text.split()
    codes = np.frombuffer(text, np.uint8)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), int(_IN_WORD[codes].sum(dtype=np.int64)), int(_SYMBOLS[codes].sum(dtype=np.int64)), len(lines) - len(set(lines)), _repeated_words(words)


def _scores(docs: DataFrame, carry: list[str], text: str, model: DataFrame, sizes: dict[str, int], shard: int, columns: list) -> list[DataFrame]:
    """Tables of `columns` over the carried ones, the base counts and `__s1`, `__s2`, `__s3`, `__n`: ngram_model.log_sums() of each text.

    A pass over the rows of some languages has their models by broadcast, about `shard` entries; its rows are a table
    before the broadcast is destroyed. Where there are several passes, rows are dealt by pass once, so that each reads
    its own alone. A language that needs more than a shard has several passes, whose sums add up; the texts of that
    language are written between them. Rows of a language without a model go with the first pass.
    """
    lang, half = carry.index("__lang"), carry.index("__half")
    none = np.zeros(0, np.int64), np.zeros(0, np.float32)
    before = {"__s1": "__was1", "__s2": "__was2", "__s3": "__was3"}
    types = "__s1 double, __s2 double, __s3 double, __n double"

    def one(rows: DataFrame, part: DataFrame, again: bool, last: bool) -> DataFrame:
        known = rows.sparkSession.sparkContext.broadcast(ngram_model.load(part))
        kept = [*carry, *([] if last or text in carry else [text]), *(before.values() if again else [])]
        rows = rows.drop("__n").withColumnsRenamed(before) if again else rows

        def of(texts: list[bytes | None], batch: pa.RecordBatch) -> list:
            found = np.zeros((len(texts), 4))
            for key, at in ngram_model.by_model(batch, lang, half).items():
                found[at] = ngram_model.log_sums([texts[i] for i in at], *known.value.get(key, none))
            if again:
                found[:, :3] += np.column_stack([batch.column(kept.index(c)).to_numpy() for c in before.values()])
            base = [list(x) for x in zip(*map(base_counts, texts))] or [[]] * 5
            return [*(base if last else []), *found.T]

        made = map_texts(rows, kept, text, f"{BASE}, {types}" if last else types, of).drop(*before.values())
        made = written(made.select(*columns), "scored") if last else written(made, "partial")
        known.destroy()
        return made

    groups = ngram_model.passes(sizes, shard)
    if len(groups) > 1:
        numbers = F.create_map(*[F.lit(x) for k, (langs, _) in enumerate(groups) for name in langs for x in (name, k)])
        dealt = docs.withColumn("__pass", F.coalesce(F.try_element_at(numbers, F.col("__lang")), F.lit(0)))
        dealt = written(dealt.hint("rebalance", "__pass"), "passes", "__pass")
    found = []
    for k, (langs, parts) in enumerate(groups):
        rows, own = docs, model
        if len(groups) > 1:
            rows, own = dealt.where(F.col("__pass") == k).select(*docs.columns), model.where(F.col("__lang").isin(langs))
        for n in range(parts):
            rows = one(rows, own.where(F.pmod("slice", F.lit(parts)) == n), n > 0, n + 1 == parts)
        found.append(rows)
    return found


def _quartiles(scored: DataFrame) -> DataFrame:
    """(__lang, __half, __p0, __p1, __p2): the quartiles of `bits1` to `bits3` over the distinct texts that pass the base rules."""
    once = scored.where("not base_failed").groupBy("__lang", "__half", "__key").agg(*[F.first(f"bits{k}").alias(f"bits{k}") for k in ngram_model.ORDERS])
    quarters = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    return once.groupBy("__lang", "__half").agg(*[F.percentile_approx(f"bits{k}", quarters, F.lit(10_000)).alias(f"__p{k}") for k in ngram_model.ORDERS])


def quality_rules(
    docs: DataFrame, carry: Sequence[str], text_col: str = "text", lang_col: str = "lang", result: str = "__quality",
    shard: int = ngram_model.SHARD, slice_entries: int = ngram_model.SLICE,
) -> DataFrame:
    """The carried columns of every row and a struct `result`: base counts, base_failed, bits1, bits2, bits3 and kept.

    The rows of each language fall into halves by their text. All rows are counted, copies as often as they come up, in
    a model for the other half, so that no text is scored by a model that knows it; bits1 to bits3 are the bits a
    character under the model's orders. Each half's distinct texts set the bands of that half's rows, so groups of copies
    can't move them. A text is kept if it passes the base rules and all three bands: junk of one kind predicts itself
    at order 3 once a corpus has enough of it, but not at the lower orders, which see the whole language.

    A null language is one of its own, apart from an empty one; a null or empty text has no words and fails the base
    rules. Rows that repeat are judged each. Columns that aren't carried aren't read, carried ones may have any name
    but `result`. An empty table gives no rows.
    """
    if result in carry:
        raise ValueError(f"a carried column is named {result}; name another result")
    named = {c: f"c{i}" for i, c in enumerate(carry)}
    text = named.get(text_col, "__text")
    apart = [] if text_col in named else [F.col(f"`{text_col}`").alias(text)]
    raw, lang = F.col(f"`{text_col}`").cast("binary"), F.col(f"`{lang_col}`").cast("string")
    marks = [
        F.coalesce(F.concat(F.lit("="), lang), F.lit("")).alias("__lang"),
        F.pmod(F.xxhash64(F.coalesce(raw, F.lit(b""))), F.lit(2)).cast("int").alias("__half"),
        F.coalesce(F.md5(raw), F.lit("")).alias("__key"),
    ]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()], *apart, *marks)
    keys = [*named.values(), "__lang", "__half", "__key"]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    bits = [(-F.col(f"__s{k}") / F.col("__n")).alias(f"bits{k}") for k in ngram_model.ORDERS]
    base = [c.split()[0] for c in BASE.split(", ")]
    with scratch() as keep:
        counted = ngram_model.count_trigrams(docs.select(*marks[:2], raw.alias("__bytes")))
        model, sizes = ngram_model.write_model(ngram_model.model_entries(counted), slice_entries)
        scored = [keep(t) for t in _scores(rows, keys, text, model, sizes or {"": 0}, shard, [*keys, *base, failed.alias("base_failed"), *bits])]
    scored = reduce(DataFrame.unionByName, scored)

    bounds, inside = [], F.lit(True)
    for k, (below, above) in zip(ngram_model.ORDERS, BANDS):
        p = F.col(f"__p{k}")
        spread = F.greatest(p[2] - p[0], F.lit(LEAST_SPREAD))
        bounds += [(p[1] - below * spread).alias(f"__low{k}"), (p[1] + above * spread).alias(f"__high{k}")]
        inside &= F.col(f"bits{k}").between(F.col(f"__low{k}"), F.col(f"__high{k}"))
    bands = written(_quartiles(scored).select("__lang", "__half", *bounds), "bands")
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    judged = scored.join(bands, ["__lang", "__half"], "left")
    verdict = F.struct(*base, "base_failed", *[f"bits{k}" for k in ngram_model.ORDERS], kept.alias("kept"))
    made = judged.select(*named.values(), verdict.alias("__made"))
    return made.select(*[F.col(n).alias(c) for c, n in named.items()], F.col("__made").alias(result))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"), ["doc_id"])
    counts = [f"__quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")]
    return judged.select("doc_id", *counts, *[f"__quality.bits{k}" for k in ngram_model.ORDERS])
