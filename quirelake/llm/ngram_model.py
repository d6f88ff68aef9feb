"""Modified Kneser-Ney over code-point trigrams, counted by Spark and held in sorted hash arrays.

An n-gram's hash is its code points side by side, 21 bits each, so no two share one. Every text is scored by a model
that its own half of the texts is not counted in. A model has one kind of entry, a hash and a number of bits, and a
trigram's log probability is the sum of the entries that exist of: the floor, its three orders and their contexts.
So a model can be cut anywhere: what a part lacks counts nothing, and the parts' sums add up.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import let_go, slices, written

#: Bits of a code point; stands before and after a text (control characters of a text itself count as blanks).
WIDTH, EDGE = 21, 1
ONE, TWO = (1 << WIDTH) - 1, (1 << 2 * WIDTH) - 1
ORDERS = (1, 2, 3)
#: UTF-8 bytes of short texts, or positions of a long one, that are taken apart together.
CHUNK = 1 << 18
#: Distinct trigrams that a counting task holds before it sends their sums on.
HELD = 1 << 19
#: Entries of a model that are broadcast together, 12 bytes each. A language with more is scored in several passes.
SHARD = 1 << 21
#: Entries of a row of the model's table.
SLICE = 1 << 16
#: A code point table of a chunk's alphabet cubed is used up to this size; larger alphabets are sorted instead.
DENSE = 1 << 22
_BLANK = bytes([32] * 9 + list(range(9, 256)))


def _chunks(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about CHUNK bytes; a longer one is a run of its own."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text or b"") + 3
        if held and held + size > CHUNK:
            yield first, i
            first, held = i, 0
        held += size
    if first < len(texts):
        yield first, len(texts)


def hashes(points: np.ndarray) -> np.ndarray:
    """Hashes of [trigram, 3] code points."""
    p = points.astype(np.int64)
    return (p[:, 0] << 2 * WIDTH) | (p[:, 1] << WIDTH) | p[:, 2]


def grams(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For some positions at a time: hashes of their distinct trigrams, which of them each position has, and its text."""
    for begin, end in _chunks(texts):
        joined = b"".join([b"\1\1" + (t or b"").translate(_BLANK) + b"\1" for t in texts[begin:end]])
        points = np.frombuffer(joined.decode("utf-8", "replace").encode("utf-32-le"), "<u4")
        edges = np.flatnonzero(points == EDGE).reshape(-1, 3)
        for at in range(0, len(points) - 2, CHUNK):
            part = points[at : at + CHUNK + 2]
            seen = np.zeros(0x110000, bool)
            seen[part] = True
            alphabet = np.flatnonzero(seen)
            number = np.zeros(0x110000, np.int32)
            number[alphabet] = np.arange(len(alphabet), dtype=np.int32)
            n, local = len(alphabet), number[part].astype(np.int64)
            position = np.arange(at, at + len(part) - 2)
            text = np.searchsorted(edges[:, 0], position, "right") - 1
            inside = position < edges[text, 2] - 1  # a trigram ends at its text's last edge at the latest
            ids, text = ((local[:-2] * n + local[1:-1]) * n + local[2:])[inside], text[inside]
            if n**3 <= DENSE:
                there = np.zeros(n**3, bool)
                there[ids] = True
                distinct = np.flatnonzero(there)
                place = np.zeros(n**3, np.int32)
                place[distinct] = np.arange(len(distinct), dtype=np.int32)
                which = place[ids]
            else:
                distinct, which = np.unique(ids, return_inverse=True)
            yield hashes(np.column_stack([alphabet[distinct // (n * n)], alphabet[distinct // n % n], alphabet[distinct % n]])), which, text + begin


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
    return found, np.bincount(at, np.concatenate([n for _, n in parts]), len(found)).astype(np.int64)


def by_model(part: pa.RecordBatch, lang: int, half: int) -> dict[tuple[str, int], list[int]]:
    """The rows of each language and half."""
    rows: dict[tuple[str, int], list[int]] = {}
    for i, key in enumerate(zip(part.column(lang).to_pylist(), part.column(half).to_pylist())):
        rows.setdefault(key, []).append(i)
    return rows


def count_trigrams(texts: DataFrame) -> DataFrame:
    """(__lang, __half, h, v): how often each trigram comes up in (__lang, __half, __bytes) rows.

    Tasks send their sums, so a language that holds most rows reaches a reducer as a row a task.
    """

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}

        def sums(key: tuple[str, int]) -> pa.RecordBatch:
            h, n = _summed(held.pop(key))
            same = [pa.array([key[0]] * len(h), pa.string()), pa.array(np.full(len(h), key[1], np.int32))]
            return pa.RecordBatch.from_arrays([*same, pa.array(h), pa.array(n)], names=["__lang", "__half", "h", "v"])

        let_go()
        for part in slices(parts, 2):
            bodies = part.column(2).to_pylist()
            for key, rows in by_model(part, 0, 1).items():
                for found, which, _ in grams([bodies[i] for i in rows]):
                    held.setdefault(key, []).append((found, np.bincount(which, minlength=len(found))))
                    if sum(len(h) for h, _ in held[key]) > HELD:
                        held[key] = [_summed(held[key])]
                        if len(held[key][0][0]) > HELD // 2:
                            yield sums(key)
            while sum(len(h) for x in held.values() for h, _ in x) > 2 * HELD:  # many languages: the largest goes first
                yield sums(max(held, key=lambda k: sum(len(h) for h, _ in held[k])))
        for key in list(held):
            yield sums(key)

    found = texts.select("__lang", "__half", "__bytes").mapInArrow(count, "__lang string, __half int, h long, v long")
    return found.groupBy("__lang", "__half", "h").agg(F.sum("v").alias("v"))


def discounts(n: Column) -> list[Column]:
    """D1, D2 and D3+ from an array of the counts of counts 1 to 4; the usual values where a corpus is too small to tell."""
    few = F.exists(n, lambda x: x == 0)
    y = n[0] / (n[0] + 2 * n[1])
    raw = [F.lit(j) - (j + 1) * y * n[j] / n[j - 1] for j in (1, 2, 3)]
    return [F.when(few, F.lit(usual)).otherwise(F.least(F.greatest(d, F.lit(0.0)), F.lit(float(j)))) for j, d, usual in zip((1, 2, 3), raw, (0.5, 1.0, 1.5))]


def _log2(p: Column) -> Column:
    return F.log2(F.greatest(p, F.lit(1e-12)))


def model_entries(trigrams: DataFrame) -> DataFrame:
    """(__lang, __half, h, bits) entries of the models of count_trigrams() rows; `__half` is the half that a model scores.

    Above the trigrams' own counts an n-gram counts once for each code point that comes before it. Hashes of one, two
    and three code points never meet, as no code point is 0; a context has its hash's complement (the empty one ~0), the floor 0.
    """
    model = ["__lang", "__half"]
    level = written(trigrams.select("__lang", (1 - F.col("__half")).alias("__half"), "h", F.col("v").cast("double").alias("v")), "trigrams")
    levels = {3: level}
    for k, mask in ((2, TWO), (1, ONE)):
        level = written(level.groupBy(*model, F.col("h").bitwiseAND(F.lit(mask)).alias("h")).agg(F.count(F.lit(1)).cast("double").alias("v")), "grams")
        levels[k] = level
    entries, lower = [], None
    for k in ORDERS:
        of = levels[k].groupBy(*model).agg(F.array(*[F.count_if(F.col("v") == j).cast("double") for j in range(1, 5)]).alias("n"), F.count(F.lit(1)).alias("types"))
        d = discounts(F.col("n"))
        of = written(of.select(*model, *[x.alias(f"d{j}") for j, x in enumerate(d, 1)], (1 / (F.col("types") + 1)).alias("floor")), "numbers")
        v = F.col("v")
        taken = F.when(v == 1, F.col("d1")).when(v == 2, F.col("d2")).otherwise(F.col("d3"))
        context = F.shiftright("h", WIDTH)
        named = levels[k].join(of, model).select(*model, "h", "v", "floor", taken.alias("taken"), context.alias("c"))
        contexts = named.groupBy(*model, "c").agg(F.sum("v").alias("total"), (F.sum("taken") / F.sum("v")).alias("free"))
        joined = named.join(contexts, [*model, "c"])
        if k == 1:
            entries.append(of.select(*model, F.lit(0).cast("long").alias("h"), F.log2("floor").alias("bits")))
            below = F.col("floor")
        else:
            suffix = F.col("h").bitwiseAND(F.lit(ONE if k == 2 else TWO))
            joined = joined.withColumn("s", suffix).join(lower.select(*model, F.col("h").alias("s"), F.col("p").alias("below")), [*model, "s"])
            below = F.col("below")
        entries.append(contexts.select(*model, F.bitwise_not("c").alias("h"), _log2(F.col("free")).alias("bits")))
        p = (v - F.col("taken")) / F.col("total") + F.col("free") * below
        lower = joined.select(*model, "h", p.alias("p"), (_log2(p) - _log2(F.col("free")) - _log2(below)).alias("bits"))
        lower = lower if k == ORDERS[-1] else written(lower, "level")
        entries.append(lower.select(*model, "h", "bits"))
    return reduce(DataFrame.unionByName, entries)


def write_model(entries: DataFrame, slice_entries: int = SLICE) -> tuple[DataFrame, dict[str, int]]:
    """The model as a table of sorted hash arrays (__lang, __half, slice, hashes, bits), and the entries of each language.

    A slice holds about `slice_entries` entries, whatever the language. A row a language comes to the driver.
    """
    entries = written(entries, "entries")
    sizes = entries.groupBy("__lang").count()
    slices = sizes.select("__lang", F.ceil(F.col("count") / slice_entries).cast("int").alias("__slices"))
    dealt = entries.join(slices, "__lang").withColumn("slice", F.pmod(F.xxhash64("h"), F.col("__slices")).cast("int"))
    pairs = F.array_sort(F.collect_list(F.struct("h", F.col("bits").cast("float").alias("bits"))))
    arrays = dealt.groupBy("__lang", "__half", "slice").agg(pairs.alias("e"))
    model = written(arrays.select("__lang", "__half", "slice", F.col("e.h").alias("hashes"), F.col("e.bits").alias("bits")), "model")
    return model, {r["__lang"]: r["count"] for r in sizes.collect()}


def passes(sizes: dict[str, int], shard: int) -> list[tuple[list[str], int]]:
    """Languages that are scored together, and in how many parts: small ones share a pass, a large one has several."""
    out: list[tuple[list[str], int]] = []
    some, held = [], 0
    for lang in sorted(sizes):
        if sizes[lang] > shard:
            out.append(([lang], -(-sizes[lang] // shard)))
            continue
        if some and held + sizes[lang] > shard:
            out.append((some, 1))
            some, held = [], 0
        some.append(lang)
        held += sizes[lang]
    return out + ([(some, 1)] if some else [])


def load(model: DataFrame) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
    """Sorted hashes and bits of each model of some rows of write_model()'s table, at most about a SHARD."""
    got = model.toArrow()
    slices: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
    for i in range(got.num_rows):
        key = got.column("__lang")[i].as_py(), got.column("__half")[i].as_py()
        slices.setdefault(key, []).append((got.column("hashes")[i].values.to_numpy(), got.column("bits")[i].values.to_numpy()))
    out = {}
    for key, parts in slices.items():
        found = np.concatenate([h for h, _ in parts])
        order = np.argsort(found)
        out[key] = found[order], np.concatenate([b for _, b in parts])[order]
    return out


def log_sums(texts: list[bytes | None], known: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """[text, order]: what the entries add to the log2 probability of each text at orders 1 to 3; and, last, its trigrams."""

    def of(wanted: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        return np.where(known[at] == wanted, bits[at], np.float32(0)).astype(np.float64)

    out = np.zeros((len(texts), 4))
    for h, which, text in grams(texts):
        if len(known):
            first = of(h & ONE) + of(np.array([0, ~0])).sum()
            second = first + of(h & TWO) + of(~(h >> WIDTH & ONE))
            third = second + of(h) + of(~(h >> WIDTH))
        else:
            first = second = third = np.zeros(len(h))
        for k, value in enumerate((first, second, third)):
            out[:, k] += np.bincount(text, value[which], len(texts))
        out[:, 3] += np.bincount(text, minlength=len(texts))
    return out
