"""SimHash near-duplicates: a grid join over segment bit counts bounds the Hamming distance, then it is verified."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.llm.common import map_texts, scratch, table, written
from quirelake.llm.components import components

SHINGLE = 3
SEED = 42
#: Shingles hashed and counted at a time, so a very long text needs no more memory than this many.
CHUNK = 200_000
#: Bits of the six bands over the 32 two-bit segments. Two texts whose Manhattan distance over the segments' bit
#: counts is at most 3 have at least three bands without any difference, so they share a grid cell in one of the
#: 20 choices of three bands.
BANDS = (12, 12, 10, 10, 10, 10)
REACH = 3
#: Fingerprints of one cell that are compared in one task; a larger cell is cut into blocks of about this size.
BLOCK = 4096
_LOW = 0x5555555555555555


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _band_masks() -> list[int]:
    masks, at = [], 0
    for width in BANDS:
        masks.append(((1 << width) - 1) << at)
        at += width
    return masks


def fingerprint(text: bytes | None) -> int:
    """The 64-bit SimHash, as a signed number, of a text's 3-word shingles; 0 for a text without words."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - SHINGLE + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[:n].tolist(), ends[min(SHINGLE, len(words)) - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        hashes = [xxh64_intdigest(joined[s:e], SEED) for s, e in zip(first[at : at + CHUNK], last[at : at + CHUNK])]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return _signed(int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big"))


def fingerprints(docs: DataFrame, carry: list[str], text_col: str) -> DataFrame:
    """The carried columns and fp of every row."""

    def rows(texts: list[bytes | None], _: pa.RecordBatch) -> list:
        return [[fingerprint(t) for t in texts]]

    return map_texts(docs, carry, text_col, "fp long", rows)


def _grid(fps: DataFrame) -> DataFrame:
    """(cell, fp): each fingerprint in its unit grid cell under each choice of three bands.

    The embedding is the 32 segments' bit counts, held two bits a segment in one long.
    """
    masks = _band_masks()
    cells = [
        F.struct(F.lit(i).cast("byte").alias("choice"), F.col("__counts").bitwiseAND(F.lit(_signed(a | b | c))).alias("counts"))
        for i, (a, b, c) in enumerate(combinations(masks, 3))
    ]
    return fps.withColumn("__counts", _counts(F.col("fp"))).select("fp", F.explode(F.array(*cells)).alias("cell")).select("cell.choice", "cell.counts", "fp")


def _counts(x: Column) -> Column:
    """The embedding of a fingerprint: the bit count of each two-bit segment, in the segment's own two bits."""
    low, next_bit = F.lit(_LOW), F.shiftrightunsigned(x, 1)
    return F.shiftleft(x.bitwiseAND(next_bit).bitwiseAND(low), 1).bitwiseOR(x.bitwiseXOR(next_bit).bitwiseAND(low))


def _apart(x: Column, y: Column) -> Column:
    """Manhattan distance of two embeddings: 2 where a segment has 0 against 2, 1 where it has 1 against another."""
    low = F.lit(_LOW)
    ones = x.bitwiseXOR(y).bitwiseAND(low)
    twos = F.shiftrightunsigned(x.bitwiseXOR(y), 1).bitwiseAND(low).bitwiseAND(F.bitwise_not(ones))
    return F.bit_count(ones) + 2 * F.bit_count(twos)


def _manhattan(x: np.ndarray, y: np.uint64) -> np.ndarray:
    """Manhattan distance of the segments' bit counts of fingerprints."""
    low, one = np.uint64(_LOW), np.uint64(1)

    def counts(v: np.ndarray) -> np.ndarray:
        return ((v & (v >> one) & low) << one) | ((v ^ (v >> one)) & low)

    apart = counts(x) ^ counts(y)
    ones = apart & low
    twos = (apart >> one) & low & ~ones
    return np.bitwise_count(ones).astype(np.int16) + 2 * np.bitwise_count(twos).astype(np.int16)


def forest(members: np.ndarray, reach: int = REACH) -> list[tuple[int, int]]:
    """Links that join all members within `reach` of each other, directly or through others; at most one a member."""
    rest, links = np.unique(np.asarray(members, np.int64)).view(np.uint64), []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            maybe = np.flatnonzero(_manhattan(rest, x) <= reach)
            sure = maybe[np.bitwise_count(rest[maybe] ^ x) <= reach]
            if len(sure):
                near = rest[sure]
                links += [(_signed(int(x)), _signed(int(y))) for y in near]
                front += list(near)
                rest = np.delete(rest, sure)
    return links


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b) over distinct fingerprints: enough verified links to join all that are within reach of each other.

    In every cell the embedding's Manhattan distance, never above the Hamming distance, decides which pairs are
    compared exactly. A cell of two is decided from its smallest and largest member. A larger cell goes to the tasks as
    blocks, each pair of blocks to one, so that no task ever holds more than about two blocks of one cell; what
    comes out is a spanning forest, not the pairs.
    """
    grid = _grid(fps)
    cells = grid.groupBy("choice", "counts").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    cells = written(cells.where("n > 1"), "cells")
    bound, apart = _apart(_counts(F.col("a")), _counts(F.col("b"))), F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    two = cells.where((F.col("n") == 2) & (bound <= REACH)).where(apart <= REACH).select("a", "b")

    many = cells.where("n > 2").select("choice", "counts", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = (
        grid.join(many, ["choice", "counts"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .groupBy("choice", "counts", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
        .agg(F.collect_list("fp").alias("members"))
    )

    def joined(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            members = part.column(0)
            values, ends = members.values.to_numpy(), members.offsets.to_numpy()
            found = {(min(x, y), max(x, y)) for s, e in zip(ends[:-1], ends[1:]) if e - s > 1 for x, y in forest(values[s:e])}
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return two.unionByName(dealt.select("members").mapInArrow(joined, "a long, b long")).distinct()


def classes(docs: DataFrame, carry: list[str], text_col: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The carried columns and fp of every row; and (fp, root) of every fingerprint, equal for all that are linked.

    Equal fingerprints are one node however many rows carry them. Other columns aren't read.
    """
    with scratch() as keep:
        prints = keep(written(fingerprints(docs, carry, text_col), "prints"))
        nodes = written(prints.select("fp").distinct(), "nodes")
        roots = components(links(nodes, block), "a", "b")
        rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))
        return prints, keep(written(rooted, "rooted"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id_col, fp, component_id) for every row of `docs`; the component's id is its smallest document id.

    A null text and one without words have fingerprint 0 and are linked like any other. Rows that repeat come out as
    often as they went in. A null id is fingerprinted and linked, and is never the smallest; a component of null ids
    only has a null id. Other columns aren't read. An empty table gives no rows.
    """
    prints, rooted = classes(docs, [id_col], text_col, block)
    least = prints.groupBy("fp").agg(F.min(id_col).alias("least")).join(rooted, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.join(least, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select(id_col, "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Of each component of near_duplicates() one row: that with the smallest id, and of such by a hash of its columns.

    Rows without an id are compared like any other and stay only where a component has none with one. Rows that repeat
    an id and differ in their texts are documents of their own. Columns may have any name.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    at, body = names[id_col], names[text_col]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]).withColumn("__row", F.xxhash64(*names.values()))
    prints, rooted = classes(rows, [at, "__row"], body, block)
    first = F.min(F.struct(F.col(at).isNull().alias("none"), at, "__row"))
    heads = prints.groupBy("fp").agg(first.alias("head")).join(rooted, "fp").groupBy("root").agg(F.min("head").alias("head"))
    heads = written(heads.select(F.col(f"head.{at}").alias("__id"), F.col("head.__row").alias("__of")), "heads")
    kept = rows.join(heads, F.col(at).eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__of")), "left_semi")
    once = Window.partitionBy(F.coalesce(F.col(at), F.lit(0)), F.col(at).isNull(), "__row").orderBy("__row")
    return kept.withColumn("__n", F.row_number().over(once)).where("__n = 1").select(*[F.col(n).alias(c) for c, n in names.items()])


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
