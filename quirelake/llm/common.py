"""What the operators of this folder share: tables, scratch tables, Arrow maps over texts and running totals."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII white space, as characters to trim.
BLANKS = " \t\n\x0b\f\r"

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; one of our own only where all run in one process."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="quirelake-")
    return _own_dirs[app]


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/quirelake/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, *by: str) -> DataFrame:
    """The rows as a table in the shared folder, in folders by the columns `by`: cuts lineage, survives lost executors and is computed once."""
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    if _open():
        _open()[-1].append(out)
    return out


_local = threading.local()


def _open() -> list[list[DataFrame]]:
    """What each scratch() that this thread is in holds."""
    if not hasattr(_local, "scratch"):
        _local.scratch = []
    return _local.scratch


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes what written() makes inside once it is left; all but the tables that are given to the function it yields."""
    held: list[DataFrame] = []
    _open().append(held)

    def keep(df: DataFrame) -> DataFrame:
        held[:] = [t for t in held if t is not df]
        if len(_open()) > 1:
            _open()[-2].append(df)
        return df

    try:
        yield keep
    finally:
        _open().pop()
        discard(*held)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in tables:
        spark, path = df.sparkSession, df.written_at
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores more as it takes to be none of the columns' (which match in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(parts: Iterator[pa.RecordBatch], text: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts, column number `text`, have about `most` bytes; at least one row each."""
    for part in parts:
        sizes = pc.fill_null(pc.binary_length(part.column(text).cast(pa.binary())), 0).to_numpy().astype("i8")
        held = sizes.cumsum()
        at = 0
        while at < len(sizes):
            before = int(held[at - 1]) if at else 0
            end = max(at + 1, int(held.searchsorted(before + most, "right")))
            yield part.slice(at, end - at)
            at = end


_held: dict[str, object] = {}


def worker_cache(key: str, make: Callable[[], object]):
    """What a Python worker keeps from task to task, made once: one thing at a time."""
    if key not in _held:
        let_go()
        _held[key] = make()
    return _held[key]


def let_go(but: str | None = None) -> None:
    """Workers are used again by other operators; what those before have kept goes."""
    for key in [k for k in _held if k != but]:
        del _held[key]


def map_texts(
    df: DataFrame,
    carry: Sequence[str],
    text: str,
    fields: str,
    rows: Callable[[list[bytes | None], pa.RecordBatch], Sequence],
    cache: str | None = None,
) -> DataFrame:
    """One row out per row in: the carried columns and `fields`, which `rows` makes from a batch's UTF-8 texts.

    Texts come as bytes; one that is carried anyway goes to Python once. A batch is worked off as it arrives, some
    texts at a time, so memory is that of one Arrow batch. `cache` is the key of the worker_cache() that `rows` uses.
    """
    made = T._parse_datatype_string(fields)
    carried = [df.schema[c] for c in carry]
    schema = T.StructType([*carried, *made.fields])
    new_types = to_arrow_schema(made)
    kept = len(carried)
    at = list(carry).index(text) if text in carry else kept

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(cache)
        for part in slices(parts, at):
            made_now = [pa.array(c, type=f.type) for c, f in zip(rows(part.column(at).cast(pa.binary()).to_pylist(), part), new_types)]
            fields = [part.schema.field(i) for i in range(kept)] + list(new_types)
            yield pa.RecordBatch.from_arrays([*part.columns[:kept], *made_now], schema=pa.schema(fields))

    apart = [] if text in carry else [F.col(f"`{text}`").cast("binary").alias("__text")]
    return df.select(*[F.col(f"`{c}`") for c in carry], *apart).mapInArrow(batches, schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash_sample(df: DataFrame, order: Sequence[str], most: int, rows: int) -> DataFrame:
    """The first `most` of `rows` rows by the hash of the columns `order`.

    A cut of the hash leaves about twice as many rows as are wanted before any are put in order, so that what is
    sorted doesn't grow with the table.
    """
    key = F.pmod(F.xxhash64(*order), F.lit(1 << 40))
    cut = int(min(1.0, (2 * most + 100) / max(rows, 1)) * (1 << 40))
    return df.withColumn("__key", key).where(F.col("__key") < F.lit(cut)).orderBy("__key", *order).limit(most).drop("__key")


def running_total(df: DataFrame, order: Sequence[Column], value: str, total: str) -> DataFrame:
    """Adds `total`: the sum of `value` over all rows before this one in the order, without one task seeing all rows.

    Rows are range-partitioned and summed within each partition as they stream by; the partitions' sums (one row
    a partition) are totalled in order and joined back. Rows that tie in the whole order may come in any order.
    """
    spark = df.sparkSession
    schema = T.StructType([*df.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__before", T.LongType())])
    at = df.columns.index(value)

    def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        here, so_far = TaskContext.get().partitionId(), 0
        for part in parts:
            values = part.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(values) + so_far
            before = ends - values
            so_far = int(ends[-1]) if len(ends) else so_far
            columns = [*part.columns, pa.array(np.full(len(values), here, np.int32)), pa.array(before)]
            fields = [*part.schema, pa.field("__part", pa.int32()), pa.field("__before", pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    dealt = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    summed = written(dealt.mapInArrow(sums, schema), "running")
    ends = summed.groupBy("__part").agg(F.max(F.col("__before") + F.col(value)).alias("__sum"))
    offsets = ends.select("__part", (F.sum("__sum").over(_before_part()) - F.col("__sum")).alias("__offset"))
    return (
        summed.join(F.broadcast(offsets), "__part")  # one row a partition
        .withColumn(total, F.col("__before") + F.col("__offset"))
        .drop("__part", "__before", "__offset")
    )


def _before_part():
    from pyspark.sql import Window

    return Window.orderBy("__part")
