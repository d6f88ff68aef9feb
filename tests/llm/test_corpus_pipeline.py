import corpus_pipeline as cp
from pyspark.sql import functions as F

from quirelake.llm import packing, simhash


def test_stages_by_their_decisions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = docs.where("doc_id = 0").withColumn("doc_id", F.lit(5000).cast("long")).unionByName(docs.where("doc_id = 0"))
    docs = docs.unionByName(extra).unionByName(docs.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    good = cp.keep_good(spark, docs, "").cache()
    assert good.columns == docs.columns and good.exceptAll(docs).count() == 0 and 0.6 * docs.count() < good.count() < docs.count()
    lines = cp.drop_lines(spark, good, "").cache()
    assert lines.columns == docs.columns and lines.count() == good.count()
    held = lines.where("doc_id IS NOT NULL").select("doc_id", F.explode(F.split("text", "\n")).alias("x")).where("char_length(trim(x)) >= 10")
    assert held.groupBy(F.lower(F.trim("x"))).agg(F.count_distinct("doc_id").alias("n")).where("n > 1").count() == 0
    once = cp.drop_copies(spark, lines, "").cache()
    assert once.columns == docs.columns and once.exceptAll(lines).count() == 0
    groups = simhash.near_duplicates(lines).groupBy("component_id").agg(F.count("doc_id").alias("n"))
    with_id = once.where("doc_id IS NOT NULL")
    assert with_id.count() == with_id.select("doc_id").distinct().count() == groups.where("n > 0").count()
    assert groups.where("n > 0").join(with_id, F.col("doc_id") == F.col("component_id"), "left_anti").count() == 0
    mixed = cp.mix_sources(spark, once, "").cache()
    assert mixed.columns == docs.columns and mixed.exceptAll(once.unionAll(once)).count() == 0
    pieces = cp.pack(spark, mixed, "")
    encode = packing.Encoder(packing.default_tokenizer())
    total = sum(len(encode([r.text or ""])[0]) // 2 for r in mixed.select("text").collect())
    assert pieces.agg(F.sum("length")).first()[0] == total


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
    assert cp.pack(spark, docs, "").count() == 0


def test_stages_with_extra_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 40")
    odd = docs.withColumns({c: F.lit("mine") for c in ("kept", "bits", "__lines", "__quality", "fp", "times", "size", "target", "__h", "row_id", "ids")})
    for _, stage in cp.STAGES[:-1]:
        odd = stage(spark, odd, "")
        assert odd.columns[:5] == docs.columns and odd.where("kept = 'mine' AND __lines = 'mine' AND __h = 'mine'").count() == odd.count() > 0
    assert cp.pack(spark, odd, "").where("doc_id IS NULL").count() == 0
