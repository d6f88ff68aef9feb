"""Line deduplication: hash the normalised lines, count the documents of each hash, drop the repeated ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm.common import BLANKS, table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _marks(rows: DataFrame, min_chars: int) -> DataFrame:
    """(__d, __t, __pos, __h1, __h2): the hashed key of every line that is long enough, with the text and place it has."""
    lines = rows.select("__d", "__t", F.posexplode("__lines").alias("__pos", "__line"))
    keyed = lines.select("__d", "__t", "__pos", line_key(F.col("__line")).alias("__key")).where(F.char_length("__key") >= min_chars)
    return keyed.select("__d", "__t", "__pos", F.xxhash64("__key").alias("__h1"), F.xxhash64(F.lit(1), "__key").alias("__h2"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2, result: str = "__lines") -> DataFrame:
    """Every column of `docs` and a struct `result`: kept (the lines that stay, in order), n_lines and n_dropped.

    A key of at least `min_chars` code points that at least `min_docs` documents hold loses its lines everywhere
    but in the smallest id that holds it, where all of them stay. A null or empty text is one empty line. Rows
    that repeat an id count as one document. Rows with a null id count as no document of their own: they neither
    make a key repeated nor lose lines. Other columns pass through untouched, with any name but `result`. An empty
    table gives no rows.

    Lines are exploded with their place and hashed to 128 bits once; the hashes, not the lines, are shuffled to count the
    distinct documents of each. The few repeated hashes are a table of their own, so that a very common one only is
    a large partition of a join, which Spark splits. What comes back to a text is the places of its dropped lines.
    """
    if result in docs.columns:
        raise ValueError(f"a column is named {result}; name another result")
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col(f"`{id_col}`").alias("__d"), F.xxhash64(text).alias("__t"), F.split(text, "\n").alias("__lines"))
    with_id = rows.where("__d IS NOT NULL")
    marks = written(_marks(with_id, min_chars), "lines")
    counted = marks.groupBy("__h1", "__h2").agg(F.min("__d").alias("__first"), F.count_distinct("__d").alias("__docs"))
    repeated = written(counted.where(F.col("__docs") >= min_docs).drop("__docs"), "repeated")
    drops = marks.join(repeated, ["__h1", "__h2"]).where(F.col("__d") != F.col("__first")).groupBy("__d", "__t").agg(F.collect_set("__pos").alias("__drop"))
    met = with_id.join(drops, ["__d", "__t"], "left").unionByName(rows.where("__d IS NULL").withColumn("__drop", F.lit(None).cast("array<int>")))
    all_places = F.sequence(F.lit(0), F.size("__lines") - 1)
    placed = met.withColumn("__stay", F.when(F.col("__drop").isNotNull(), F.array_except(all_places, "__drop")))
    stays = F.when(F.col("__drop").isNull(), F.col("__lines")).otherwise(F.transform("__stay", lambda i: F.get(F.col("__lines"), i)))
    made = F.struct(
        F.array_join(stays, "\n").alias("kept"), F.size("__lines").cast("long").alias("n_lines"), F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped")
    )
    made_rows = placed.select(*names.values(), made.alias("__made"))
    return made_rows.select(*[F.col(n).alias(c) for c, n in names.items()], F.col("__made").alias(result))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "__lines.n_lines", "__lines.n_dropped", F.sha2("__lines.kept", 256).alias("kept_sha256"))


_KEY = r"""translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""

#: Shared with the pipeline's SQL: of a relation src(doc_id, text) the lines and what becomes of them.
LINES_SQL = f"""
    split AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                     generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM src),
    keyed AS (SELECT doc_id, line, pos, {_KEY} AS k FROM split),
    repeated AS (SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
    marked AS (SELECT keyed.*, coalesce(keyed.doc_id <> repeated.first_doc, false) AS dropped FROM keyed LEFT JOIN repeated USING (k))
"""

OP3_SQL = f"""
WITH src AS (SELECT doc_id, text FROM documents), {LINES_SQL}
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
