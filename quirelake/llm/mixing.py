"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm.common import WORD, running_total, scratch, table, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"({WORD})")), F.lit(0)).cast("long")


def source_weights(sources: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """Adds `weight`: the weights in turn over the sources in code-point order, null last."""
    ranked = running_total(sources.withColumn("__one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], "__one", "__rank")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    return ranked.withColumn("weight", pick).drop("__one", "__rank")


def water_fill(sources: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Adds `target` to (source, source_size, weight): `share` of all sizes by weight, none above `max_epochs` times its size.

    Each round clamps the sources above their limit and shares what is left among the others by weight, until
    none is above; only the sums of a round come to the driver. A share above what the limits allow fills them all.
    """
    sources = sources.withColumn("__cap", F.col("source_size") * F.lit(float(max_epochs)))
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, clamped = 0.0, -1
    while True:
        over = F.col("__cap") <= F.lit(level) * F.col("weight") if clamped >= 0 else F.lit(False)
        held, n, free = sources.agg(
            F.coalesce(F.sum(F.when(over, F.col("__cap"))), F.lit(0.0)), F.count_if(over), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))
        ).first()
        if n == clamped or free <= 0:
            break
        clamped, level = n, max(level, (share * total - held) / free)
    filled = F.col("__cap") if free <= 0 else F.least("__cap", F.lit(level) * F.col("weight"))
    return sources.withColumn("target", filled.cast("double")).drop("__cap")


def row_order(id_col: Column, text: Column, seed: int = SEED) -> Column:
    """60 bits of a seeded hash of a row's id and text, by which the rows of a source are in order."""
    part = [F.coalesce(x, F.lit("null")) for x in (id_col.cast("string"), F.md5(text.cast("binary")))]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *part)), 1, 15), 16, 10).cast("long")


def mix_plan(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target, whole, cut, some) of each source of (source, size, __h) rows.

    A source's rows are all taken `whole` = floor(target / source_size) times, and once more in the order of __h until
    the rest of the target is met to within half a row: those below `cut`, and `some` of those at `cut`. Rows of one
    place (__h) are alike; they are one unit of the running totals, which no task makes alone. Rows of size 0 are in no unit.
    """
    with scratch() as keep:
        units = sized.groupBy("source", "__h").agg(F.sum("size").alias("__words"), F.max("size").alias("__each"))
        units = written(running_total(units, [F.col("source").asc_nulls_last(), F.col("__h")], "__words", "__at"), "units")
        sources = units.groupBy("source").agg(F.sum("__words").alias("source_size"), F.min("__at").alias("__begin"))
        targets = water_fill(source_weights(written(sources, "sources"), weights), share, max_epochs)
        epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
        targets = targets.withColumn("whole", epochs).withColumn("__need", F.col("target") - F.col("whole") * F.col("source_size"))
        named = targets.withColumnRenamed("source", "__s")
        before = F.col("__at") - F.col("__begin")
        last = units.where("__words > 0").join(named, F.col("source").eqNullSafe(F.col("__s"))).where((before <= F.col("__need")) & (before + F.col("__words") > F.col("__need")))
        some = F.ceil((F.col("__need") - before) / F.col("__each") - 0.5).cast("long")
        cut = last.groupBy("__s").agg(F.min(F.struct("__h", some.alias("some"))).alias("__cut"))
        found = targets.join(cut, F.col("source").eqNullSafe(F.col("__s")), "left")
        plan = found.select("source", "source_size", "target", "whole", F.col("__cut.__h").alias("cut"), F.coalesce("__cut.some", F.lit(0)).alias("some"))
        return keep(written(plan, "plan"))


def take(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds `source_size`, `target` and `times` (how often the mix holds the row) to rows with source, size and __h.

    What a row is due follows from its place and its source's line of the plan. Of rows that are alike and at the cut
    some are taken and others not: they are numbered by a running total of their own.
    """
    named = plan.withColumnRenamed("source", "__s")
    known = sized.join(named, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    at_cut = F.coalesce(F.col("__h") == F.col("cut"), F.lit(False)) & (F.col("size") > 0)
    extra = F.when(F.col("cut").isNull() | (F.col("__h") >= F.col("cut")), F.lit(0)).otherwise(F.lit(1)).cast("long")
    clear = known.where(~at_cut).withColumn("__extra", extra)
    alike = known.where(at_cut).withColumn("__one", F.lit(1).cast("long")).withColumn("__row", F.monotonically_increasing_id())
    alike = running_total(alike, [F.col("source").asc_nulls_last(), F.col("__row")], "__one", "__at")
    firsts = alike.groupBy("source").agg(F.min("__at").alias("__begin")).withColumnRenamed("source", "__s")
    alike = alike.join(firsts, F.col("source").eqNullSafe(F.col("__s"))).withColumn("__extra", (F.col("__at") - F.col("__begin") < F.col("some")).cast("long"))
    both = clear.unionByName(alike.drop("__one", "__row", "__at", "__begin", "__s"))
    times = F.when(F.col("size") > 0, F.col("whole") + F.col("__extra")).otherwise(F.lit(0))
    return both.withColumn("times", times).drop("__h", "whole", "cut", "some", "__extra")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """Every row of `docs`, its columns kept, as often as the mix holds it.

    Sizes are words; a null text has none and is never taken. Rows that repeat are rows of their own. A source
    without words has a target of 0. An empty table gives no rows. Columns may have any name. What is ordered and
    summed is numbers only: whole rows meet their source's line of the plan and stay where they are.
    """
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__packed"), "source", row_order(F.col("doc_id"), F.col("text")).alias("__h"), word_count(F.col("text")).alias("size"))
    plan = mix_plan(written(packed.drop("__packed"), "sizes"), **options)
    taken = take(packed, plan).where("times > 0")
    return taken.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("__packed.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = written(docs.select("doc_id", "source", row_order(F.col("doc_id"), F.col("text")).alias("__h"), word_count(F.col("text")).alias("size")), "sizes")
    mixed = take(sized, mix_plan(sized))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "source")


#: Water-filling in closed form: with sources by rising limit over weight, those before the first that isn't over are clamped.
OP2_SQL = """
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
           ('0x' || substr(md5('20:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(md5(text), 'null')), 1, 15))::BIGINT AS h
    FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM s),
c AS (SELECT *, 2.0 * source_size AS cap FROM w),
r AS (
    SELECT *, 1.5 * sum(source_size) OVER () AS total, row_number() OVER o AS k,
           coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held, sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
    FROM c WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)
), f AS (SELECT min(k) AS k FROM r WHERE cap > weight * (total - held) / free),
v AS (SELECT (SELECT (total - held) / free FROM r WHERE r.k = f.k) AS level FROM f),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM c, v),
n AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
o AS (
    SELECT d.*, source_size, target, whole, target - whole * source_size AS need,
           sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size AS before
    FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source
)
SELECT doc_id, size, source_size, target::DOUBLE AS target, size * (whole + CASE WHEN before + size / 2.0 < need THEN 1 ELSE 0 END) AS taken, source FROM o
"""
