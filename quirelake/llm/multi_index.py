"""Nearest neighbours by an inverted multi-index: two half codebooks, centroid pairs in heap order, exact reranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.llm.common import hash_sample, table, written

#: Vectors that the codebooks are fitted on, the first by the hash of their ids; every vector is indexed.
FIT_VECTORS = 16_384
FIT_ROUNDS = 12
#: Centroids of each half: so many at least, more with the root of the entries, as many as the fit has 64 vectors for.
CENTROIDS = 64
#: A query goes through cells until they hold the share of the index in which so many of the true neighbours of so
#: many trial entries lie. Vectors with structure need little of it, those without any (as in the test tables) a third or more.
RECALL, TRIALS = 0.97, 128
#: Entries and queries that meet in one task.
ENTRY_BLOCK, QUERY_BLOCK = 4096, 4096


def n_centroids(entries: int) -> int:
    return min(max(CENTROIDS, round(entries**0.5 / 2)), FIT_VECTORS // 64)


def _codebook(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids by Lloyd's rounds from a fixed start; fewer where there are fewer distinct vectors."""
    x = np.unique(x, axis=0)
    centroids = x[np.random.default_rng(9).permutation(len(x))[:k]].copy()
    for _ in range(FIT_ROUNDS):
        nearest = _nearest(x, centroids)
        for j in range(len(centroids)):
            if (own := nearest == j).any():
                centroids[j] = x[own].mean(axis=0)
    return centroids


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(axis=1)[None] - 2 * x @ centroids.T).argmin(axis=1)


def multi_sequence(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: float) -> list[int]:
    """Cells (i * len(second) + j) by rising first[i] + second[j] until they hold `wanted` entries.

    The heap holds the frontier of the grid of both sorted distance lists; a pair enters once its neighbours on
    both sides have been taken.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y, width = first[a].tolist(), second[b].tolist(), len(second)
    a, b = a.tolist(), b.tolist()
    heap, upto, held, cells = [(x[0] + y[0], 0, 0)], [0] * len(a), 0, []
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        upto[i] = j + 1
        cell = a[i] * width + b[j]
        if sizes[cell]:
            cells.append(cell)
            held += int(sizes[cell])
        if i + 1 < len(a) and upto[i + 1] == j:
            heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
        if j + 1 < width and (i == 0 or upto[i - 1] > j + 1):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
    return cells


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    if isinstance(column, pa.Array):
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.stack(column.to_numpy()).astype(np.float64)


def valid_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of rows that can be searched: an id, the commonest length, finite, not zero."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0.0))
    length = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (length["n"] if length else 0))


def share_for(index: DataFrame, books: list[np.ndarray], sizes: np.ndarray, total: int, k: int, recall: float) -> float:
    """The share of the index that holds `recall` of the true k nearest of TRIALS entries, the first by hash, when cells are taken by distance.

    The trials meet every entry, and each task keeps their k + 1 nearest only. A neighbour counts with what the cells
    before its own hold.
    """
    trial = np.array([r["vec"] for r in hash_sample(index.select("vec"), ["vec"], TRIALS, total).toLocalIterator()])
    width = len(books[1])

    def nearest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaps, cells = np.zeros((len(trial), 0)), np.zeros((len(trial), 0), np.int64)
        for part in parts:
            x = _matrix(part.column(0))
            cell = part.column(1).to_numpy() * width + part.column(2).to_numpy()
            gaps = np.concatenate([gaps, (x**2).sum(axis=1)[None] - 2 * trial @ x.T], axis=1)
            cells = np.concatenate([cells, np.broadcast_to(cell, (len(trial), len(x)))], axis=1)
            if gaps.shape[1] > k + 1:
                at = np.argpartition(gaps, k, axis=1)[:, : k + 1]
                gaps, cells = np.take_along_axis(gaps, at, 1), np.take_along_axis(cells, at, 1)
        names = np.repeat(np.arange(len(trial)), gaps.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(gaps.ravel()), pa.array(cells.ravel())], names=["q", "gap", "cell"])

    close = index.select("vec", "i", "j").mapInArrow(nearest, "q long, gap double, cell long")
    ranked = close.withColumn("__n", F.row_number().over(Window.partitionBy("q").orderBy("gap", "cell")))
    half, flat, needed = len(books[0][0]), sizes.ravel(), []
    ahead: dict[int, np.ndarray] = {}
    for row in ranked.where(F.col("__n").between(2, k + 1)).toLocalIterator():  # k rows a trial; the first is the entry itself
        if row["q"] not in ahead:
            v = trial[row["q"]]
            first, second = (((book - of) ** 2).sum(axis=1) for book, of in zip(books, (v[:half], v[half:])))
            order = np.argsort((first[:, None] + second[None]).ravel(), kind="stable")
            ahead[row["q"]] = np.empty(len(flat))
            ahead[row["q"]][order] = np.cumsum(flat[order]) - flat[order]
        needed.append((ahead[row["q"]][row["cell"]] + 1) / total)
    return float(np.quantile(needed, recall, method="higher")) if needed else 1.0


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, centroids: int | None = None, share: float | None = None, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query, other ids only, nearest first.

    `vectors` and `queries` have (id, vec), as valid_vectors() gives them. Vectors that are equal are one entry
    with its k + 1 smallest ids, which is all that can matter for the k nearest; ties go to smaller ids. Rows that
    repeat an id and vector count once. Fewer candidates give fewer rows, none give none. Where the cells hold fewer than
    k + 1 entries a query goes on through more.

    Cells are searched until they hold `share` of the index; without one, the share that trials show to hold `recall`
    of the true neighbours. A query is sent to the first-half centroids whose cells it has to search, with a bit for each of those cells, and
    is joined there with the entries; what a centroid has too many of, entries or queries, is dealt over blocks. So a
    query meets no entry of a centroid that it doesn't search, and only its best k + 1 of a block leave a task.
    """
    spark = vectors.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    ordered = Window.partitionBy("vec").orderBy("id")
    few = vectors.distinct().withColumn("__n", F.row_number().over(ordered)).where(F.col("__n") <= k + 1)
    entries = written(few.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")), "entries")
    total = entries.count()
    sample = [r["vec"] for r in hash_sample(entries.select("vec"), ["vec"], FIT_VECTORS, total).toLocalIterator()]
    if not sample:
        return none
    fit = np.array(sample)
    half = fit.shape[1] // 2
    books = [_codebook(part, centroids or n_centroids(total)) for part in (fit[:, :half], fit[:, half:])]
    width = len(books[1])

    def assign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = _matrix(part.column(0))
            i, j = (pa.array(_nearest(x[:, h], book).astype(np.int32)) for h, book in zip((slice(half), slice(half, None)), books))
            yield pa.RecordBatch.from_arrays([*part.columns, i, j], names=["vec", "ids", "i", "j"])

    index = written(entries.mapInArrow(assign, "vec array<double>, ids array<long>, i int, j int"), "index")
    sizes = np.zeros((len(books[0]), width), np.int64)
    for row in index.groupBy("i", "j").count().toLocalIterator():  # a row for each cell, at most centroids squared
        sizes[row["i"], row["j"]] = row["count"]
    if share is None:
        share = share_for(index, books, sizes, total, k, recall)

    def traverse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, vecs, to, probes = [], [], [], []
            for at, q in enumerate(_matrix(part.column(1))):
                gaps = [((book - of) ** 2).sum(axis=1) for book, of in zip(books, (q[:half], q[half:]))]
                bits = np.zeros(sizes.shape, bool)
                bits.flat[multi_sequence(*gaps, sizes.ravel(), max(share * total, k + 1))] = True
                for i in np.flatnonzero(bits.any(axis=1)).tolist():
                    ids.append(at)
                    to.append(i)
                    probes.append(np.packbits(bits[i]).tobytes())
            asked = part.take(pa.array(ids, pa.int64()))
            yield pa.RecordBatch.from_arrays([*asked.columns, pa.array(to, pa.int32()), pa.array(probes, pa.binary())], names=["id", "vec", "i", "probes"])

    asked = written(queries.distinct().mapInArrow(traverse, "id long, vec array<double>, i int, probes binary"), "asked")
    asking = np.zeros(len(sizes), np.int64)
    for row in asked.groupBy("i").count().toLocalIterator():  # a row a centroid
        asking[row["i"]] = row["count"]
    if not asking.any():
        return none

    def of_centroid(numbers: np.ndarray, most: int) -> Column:
        return F.element_at(F.array(*[F.lit(max(1, -(-int(n) // most))) for n in numbers]), F.col("i") + 1)

    blocks, rounds = of_centroid(sizes.sum(axis=1), ENTRY_BLOCK), of_centroid(asking, QUERY_BLOCK)
    all_of = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    dealt = index.withColumn("block", F.pmod(F.xxhash64("vec"), blocks).cast("int")).withColumn("round", all_of(rounds))
    rounded = asked.withColumn("round", F.pmod(F.xxhash64("id"), rounds).cast("int")).withColumn("block", all_of(blocks))

    def rerank(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(own) and len(asking):
            x, ids, cells = _matrix(own["vec"]), own["ids"].to_numpy(), own["j"].to_numpy()
            norms, least = (x**2).sum(axis=1), np.array([i[0] for i in ids])
            for q, v, probes in zip(asking["id"].tolist(), _matrix(asking["vec"]), asking["probes"]):
                at = np.flatnonzero(np.unpackbits(np.frombuffer(probes, np.uint8))[cells])
                if not len(at):
                    continue
                rough = norms[at] - 2 * x[at] @ v
                if len(at) > k + 1:
                    bound = np.partition(rough, k)[k]
                    at = at[rough <= bound + 1e-9 * (abs(bound) + 1 + v @ v)]
                exact = np.sqrt(((x[at] - v) ** 2).sum(axis=1))
                best = np.lexsort((least[at], exact))[: k + 1]
                found += [(q, list(ids[at[i]]), float(exact[i])) for i in best]
        return pd.DataFrame(found, columns=["query_id", "ids", "score"])

    by = ("i", "block", "round")
    near = dealt.groupBy(*by).cogroup(rounded.groupBy(*by)).applyInPandas(rerank, "query_id long, ids array<long>, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    each = near.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id").distinct()
    ranked = each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = written(valid_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vectors")
    return search(vectors, vectors.where("id % 100 = 0"))
