"""Merkle dataset manifest: digest-to-children records, proofs of leaves by descending from the root."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.llm.common import partitions, table, written
from quirelake.llm.line_dedup import LOWER, UPPER

FAN = 16


def sealed(value: Column) -> Column:
    """A value as it goes into a leaf: `-` for null, else its UTF-8 length, a colon and itself."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    """SHA-256 (hex) of the values in turn."""
    return F.sha2(F.concat(*map(sealed, values)), 256)


def run_digest(children: Column) -> Column:
    return F.sha2(F.array_join(children, ""), 256)


@dataclass
class Manifest:
    """`leaves` (group, place, n, leaf and their row as the struct `carried`), `records` of each height of groups and of the top tree
    (digest, children), `groups` (group, rank, n, digest: their subroots) and the `root`, None where there are no leaves."""

    leaves: DataFrame
    records: list[DataFrame]
    top_records: list[DataFrame]
    groups: DataFrame
    root: str | None


def _placed(rows: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """Adds `place`, the row's number within its group from 0, and `n`, the group's rows.

    Rows are range-partitioned by group and order and numbered where they are; a group's rows in earlier partitions
    are counted from one line for each group in each partition, so a group of any size is never in one task.
    """
    keys = [F.col(group).asc_nulls_first(), *order]
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    numbered = written(dealt.withColumn("__at", F.monotonically_increasing_id()), "merkle-rows")
    numbered = numbered.withColumn("__part", F.shiftright("__at", 33))
    held = numbered.groupBy("__part", F.col(group).alias("__g")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    whole = Window.partitionBy("__g")
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("__rows").over(before), F.lit(0)) - F.col("__first")
    starts = held.select(F.col("__part").alias("__p"), "__g", shift.alias("__shift"), F.sum("__rows").over(whole).alias("n"))
    met = numbered.join(starts, (F.col("__part") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__g")))
    return met.withColumn("place", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__p", "__g", "__shift")


def _tree(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Records by height and (group, n, digest), the one node that is left of each group, of (group, place, n, digest) nodes."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    heights, done = [], nodes.where("n = 1").select("group", F.lit(1).cast("long").alias("n"), "digest")
    level = nodes.withColumn("of", F.col("n"))
    while most > 1:
        run = level.where("n > 1").groupBy("group", "of", "n", F.floor(F.col("place") / FAN).cast("long").alias("up"))
        children = F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda c: c["digest"])
        parents = run.agg(children.alias("children")).withColumn("digest", run_digest(F.col("children")))
        height = written(parents.select("group", "of", F.ceil(F.col("n") / FAN).alias("n"), F.col("up").alias("place"), "digest", "children"), "merkle-level")
        heights.append(height.select("digest", "children"))
        done = done.unionByName(height.where("n = 1").select("group", F.col("of").alias("n"), "digest"))
        level = height.drop("children")
        most = -(-most // FAN)
    return heights, done


def build_manifest(rows: DataFrame, group: str, order: Sequence[str], leaf: str = "leaf") -> Manifest:
    """The tree of (group, order columns, leaf, ...) rows; each leaf carries its row, whatever its columns are called.

    Per group (null is one), leaves ascend by the order columns, nulls first, then by digest, so that rows that tie come out
    alike; every 16 consecutive nodes become their parent until one is left. Groups in order (null first) likewise
    give the root. Records are tables in the shared folder, found by digest alone.
    """
    column = {c: F.col(f"`{c}`") for c in rows.columns}
    ordered = F.struct(*[column[c].alias(f"k{i}") for i, c in enumerate(order)], column[leaf].alias("leaf"))
    plain = rows.select(column[group].alias("group"), ordered.alias("__order"), column[leaf].alias("leaf"), F.struct(*column.values()).alias("carried"))
    leaves = written(_placed(plain, "group", [F.col("__order")]).drop("__order"), "merkle-leaves")
    records, subroots = _tree(leaves.select("group", "place", "n", F.col("leaf").alias("digest")))
    subroots = written(subroots, "merkle-subroots").withColumnRenamed("n", "leaves").withColumn("all", F.lit(0))
    groups = written(_placed(subroots, "all", [F.col("group").asc_nulls_first()]), "merkle-groups")
    top, root = _tree(groups.select(F.col("all").alias("group"), "place", "n", "digest"))
    found = root.select("digest").first()
    return Manifest(leaves, records, top, groups.select("group", F.col("place").alias("rank"), F.col("leaves").alias("n"), "digest"), found and found[0])


def _opened(parents: DataFrame, records: DataFrame) -> DataFrame:
    """Parents with the children that the store has for their digest."""
    return parents.join(records.dropDuplicates(["digest"]), "digest").drop("digest")


def _chosen(asked: DataFrame, opened: DataFrame) -> DataFrame:
    """For every asked (group, place, ...): the child that the last digit chooses, and the path with those it doesn't."""
    inside = opened.select(F.col("group").alias("__g"), F.col("place").alias("__up"), "children", "path", "subroot")
    met = asked.join(inside, F.col("group").eqNullSafe(F.col("__g")) & (F.shiftright("place", 4) == F.col("__up")))
    digit = F.pmod("place", F.lit(FAN)).cast("int")
    left, right = F.slice("children", F.lit(1), digit), F.slice("children", digit + 2, F.lit(FAN))
    segment = F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))
    return met.withColumns({"digest": F.get("children", digit), "path": F.array_append("path", segment)}).drop("__g", "__up", "children")


_PATH = "array<struct<left:string,right:string>>"


def prove(manifest: Manifest, requests: DataFrame, result: str = "__proof") -> DataFrame:
    """Adds the struct `result` to requests for leaves by (group, place): digest (the leaf found), subroot and path.

    A path holds, from the leaf's run up to the root, the digests left and right of the node that was come by. Requests
    descend from the root: the digits of the group's rank first, then of the place in the group, each choosing among the
    children that the record of a digest names. Requests that share the digits so far descend as one, so the root's
    record meets one row and not all of them; only at the last step every leaf has a row. Places that don't exist have no row.
    """
    if result in requests.columns:
        raise ValueError(f"a column is named {result}; name another result")
    requests = requests.select("group", "place", F.struct(*[F.col(f"`{c}`") for c in requests.columns]).alias("asked"))
    asked_groups = manifest.groups.join(requests.select(F.col("group").alias("__g")).distinct(), F.col("group").eqNullSafe(F.col("__g")), "left_semi")
    ranks = asked_groups.select(F.lit(0).alias("group"), F.col("rank").alias("place"))
    spark = requests.sparkSession
    nodes = spark.createDataFrame([(0, 0, manifest.root, [], None)], f"group int, place long, digest string, path {_PATH}, subroot string").where("digest IS NOT NULL")
    for k in reversed(range(len(manifest.top_records))):
        asked = ranks.select("group", F.shiftright("place", 4 * k).alias("place")).distinct()
        nodes = _chosen(asked, _opened(nodes, manifest.top_records[k]))
    entering = manifest.groups.select("group", "rank", "n").join(nodes.select(F.col("place").alias("rank"), "digest", "path"), "rank")
    height = F.when(F.col("n") > 1, F.char_length(F.hex(F.col("n") - 1))).otherwise(0)
    entering = written(entering.select("group", F.lit(0).cast("long").alias("place"), "digest", "path", F.col("digest").alias("subroot"), height.alias("height")), "merkle-entering")
    down = None
    for k in reversed(range(len(manifest.records))):
        new = entering.where(F.col("height") == k + 1).drop("height")
        parents = new if down is None else down.unionByName(new)
        opened = _opened(parents, manifest.records[k])
        asked = requests if k == 0 else requests.select("group", F.shiftright("place", 4 * k).alias("place")).distinct()
        down = _chosen(asked, opened)
        if k:
            down = written(down, "merkle-down")
    alone = entering.where("height = 0").select(F.col("group").alias("__g"), "digest", "path", "subroot")
    lone = requests.join(alone, F.col("group").eqNullSafe(F.col("__g")) & (F.col("place") == 0)).drop("__g")
    every = lone if down is None else down.unionByName(lone)
    return every.select("asked.*", F.struct("digest", "subroot", F.reverse("path").alias("path")).alias(result))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]), 256))


def path_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, from the leaf's up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text")
    struck = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rows = docs.select("doc_id", "source", leaf_digest(*rest, text).alias("leaf"), F.when(struck, leaf_digest(*rest, F.translate(text, UPPER, LOWER))).alias("tampered"))
    manifest = build_manifest(rows, "source", ["doc_id"])
    proofs = prove(manifest, manifest.leaves.select("group", "place", "carried.*")).select("doc_id", "tampered", "__proof.*")
    folded = fold(F.coalesce("tampered", "digest"), F.col("path"))
    made = proofs.select("doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(manifest.root).cast("string").alias("root"), path_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR) || ':' || {name}::VARCHAR, '-')"


def _level(name: str, before: str, group: str) -> str:
    """A level's nodes (g, n, r, h) from those before, which also get what lies left and right of them in their run."""
    run = f"PARTITION BY {group}, r // 16 ORDER BY r ROWS BETWEEN"
    return f"""
{name}_s AS (SELECT *, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft, coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt FROM {before}),
{name} AS (SELECT g, (n + 15) // 16 AS n, r // 16 AS r, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY r)) END AS h FROM {before} GROUP BY g, n, r // 16)"""


def _merkle_sql(heights: int, top_heights: int) -> str:
    """The tree of groups of up to 16^heights documents and up to 16^top_heights groups."""
    levels = ",".join(_level(f"l{k + 1}", f"l{k}", "g") for k in range(heights))
    tops = ",".join(_level(f"t{k + 1}", f"t{k}", "g") for k in range(top_heights))
    every = [(f"l{k + 1}_s", f"s{k}.g IS NOT DISTINCT FROM l0.g AND s{k}.r = l0.r // {16**k}") for k in range(heights)]
    every += [(f"t{k + 1}_s", f"s{heights + k}.r = t0.r // {16**k}") for k in range(top_heights)]
    joins = "\n".join(f"JOIN {name} s{i} ON {on}" for i, (name, on) in enumerate(every))
    sides = " || ".join(f"s{i}.lft || s{i}.rgt" for i in range(len(every)))
    folded = "".join(f",\nf{i + 1} AS (SELECT *, CASE WHEN n{i} = 1 THEN f ELSE sha256(lft{i} || f || rgt{i}) END AS nf FROM f{i})".replace("SELECT *,", "SELECT * EXCLUDE (f),").replace("AS nf", "AS f") for i in range(len(every)))
    columns = ", ".join(f"s{i}.n AS n{i}, s{i}.lft AS lft{i}, s{i}.rgt AS rgt{i}" for i in range(len(every)))
    fields = [_field(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = "list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda x, b: list_reduce(list_concat([xor(x, b)], [0,0,0,0,0,0,0,0]::BIGINT[]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))"
    return f"""
WITH leaf AS (SELECT doc_id, source AS g, sha256({" || ".join([*fields, _field("text")])}) AS h,
                     CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN sha256({" || ".join([*fields, _field(lowered)])}) END AS tampered FROM documents),
l0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS r, count(*) OVER (PARTITION BY g) AS n FROM leaf),{levels},
t0 AS (SELECT 0 AS g, g AS source, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM l{heights}),{tops},
f0 AS (SELECT l0.doc_id, l0.h AS leaf, t0.h AS subroot, (SELECT h FROM t{top_heights}) AS root, sha256({sides}) AS proof_sha256, coalesce(l0.tampered, l0.h) AS f, {columns}
       FROM l0 JOIN t0 ON t0.source IS NOT DISTINCT FROM l0.g
{joins}){folded}
SELECT doc_id, leaf, subroot, root, proof_sha256, f AS folded_root, f = root AS verified FROM f{len(every)}
"""


#: 16^5 documents of a source, 16^2 sources.
OP13_SQL = _merkle_sql(5, 2)
