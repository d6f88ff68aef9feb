"""Queries over sources, sinks and adapters: what is read and written, and what a caller's own reader or model is asked.

The readers and models here are stand-ins whose answers SQL can tell.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelake.functions import text as tx
from quirelake.operators import complexity, detection, jobs, resolution, scoring, validation
from quirelake.plans.fixtures import duck, fixture
from quirelake.plans.layout_queries import _ELEMENTS, _LAYOUT, _elements, _pages
from quirelake.plans.review_queries import _UPSERT
from quirelake.sources import adapters, files, sinks


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _slug(text: str, fallback: str) -> str:
    """safe_slug() of ASCII text, in SQL."""
    words = f"trim(lower(regexp_replace({text}, '[^A-Za-z0-9]+', '-', 'g')), '-')"
    return f"CASE WHEN trim(({words})[1:80], '-') = '' THEN '{fallback}' ELSE trim(({words})[1:80], '-') END"


def form_feed_pages(content: bytes) -> list[tuple[str, int]]:
    """A reader of documents whose pages are parted by form feeds."""
    return [(page, 0) for page in content.decode().split("\f")]


def s1_pdf_markdown(spark, sf_dir):
    content = F.encode(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\f")), "UTF-8")
    pages = adapters.decode_pages(_t(spark, sf_dir, "documents").select("doc_id", content.alias("content")), form_feed_pages)
    return adapters.pages_as_markdown(pages).select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("markdown").alias("markdown_md5"))


S1_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
SELECT doc_id, md5(string_agg('# Page ' || i || chr(10) || chr(10) || trim(line), chr(10) || chr(10) ORDER BY i) FILTER (WHERE trim(line) <> '')) AS markdown_md5 FROM l GROUP BY doc_id"""


def s2_cached_path(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    source = F.concat(F.lit("/in/"), "p_type", F.lit("/"), "p_name", F.lit(" no. "), F.col("p_partkey").cast("string"), F.lit(".pdf"))
    return part.select("p_partkey", sinks.cached_path(source, "cache/markdown/").alias("path"))


S2_SQL = f"SELECT p_partkey, 'cache/markdown/' || {_slug("p_name || ' no. ' || p_partkey", 'document')} || '.md' AS path FROM part"


def s4_ocr_prefix(spark, sf_dir):
    setting = F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit(" "), "c_name", F.lit("  --fast "))).when(F.col("c_mktsegment") == "MACHINERY", F.lit("  "))
    program = F.when(F.col("c_nationkey") < 12, F.concat(F.lit("/bin/ocr"), F.col("c_nationkey").cast("string")))
    prefix = adapters.ocr_prefix(setting, F.col("c_acctbal") > 5000, program)
    return _t(spark, sf_dir, "customer").select("c_custkey", F.array_join(prefix, " ").alias("prefix"))


S4_SQL = """
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name || ' --fast' WHEN c_acctbal > 5000 THEN 'python -m ocrmypdf' WHEN c_nationkey < 12 THEN '/bin/ocr' || c_nationkey END AS prefix FROM customer"""


def s14_video_info(spark, sf_dir):
    p = _t(spark, sf_dir, "pages")
    last = F.substring_index("url", "/", -1)
    long, name = F.contains("url", F.lit("?")), F.when(F.contains("url", F.lit("#")), F.lit("")).otherwise(last)
    entries = p.select("page_id", "url", F.when(long, F.concat("url", F.lit("&w=1"))).otherwise(F.lit("")).alias("webpage_url"), F.when(long, F.lit("")).otherwise(F.concat(F.lit("v"), last)).alias("id"), name.alias("title"))
    return files.video_info(entries)


S14_SQL = f"""
WITH e AS (SELECT url, url LIKE '%?%' AS long, url LIKE '%#%' AS marked, string_split(url, '/')[-1] AS last FROM pages WHERE url IS NOT NULL),
n AS (SELECT CASE WHEN long THEN {_slug('url', 'video')} ELSE 'v' || last END AS video_id, CASE WHEN NOT marked AND last <> '' THEN last WHEN NOT long THEN 'v' || last ELSE 'video' END AS title,
             CASE WHEN long THEN url || '&w=1' ELSE url END AS url FROM e)
SELECT video_id, title, url, {_slug("title || '-' || video_id", 'video')} AS slug FROM n"""


def s16_transcripts(spark, sf_dir):
    end = F.when(F.col("lang") == "en", ".en.txt").when(F.col("lang") == "fr", "-orig.txt").when(F.col("lang") == "de", ".md").otherwise(".txt")
    paths = _t(spark, sf_dir, "documents").select(F.concat(F.lit("/t/"), "source", F.lit("/x"), F.col("doc_id").cast("string"), end).alias("path"))
    return files.local_transcripts(paths)


S16_SQL = """
SELECT '/t/' || source || '/x' || doc_id || CASE lang WHEN 'en' THEN '.en.txt' ELSE '.txt' END AS path, 'x' || doc_id AS title FROM documents WHERE lang NOT IN ('fr', 'de')"""


def s17_folder(spark, sf_dir):
    """The files of the tables' own folder, by name and size."""
    found = files.read_files(spark, sf_dir, "*.parquet")
    return found.select(F.substring_index("path", "/", -1).alias("name"), "length").orderBy("name")


def s18_model_settings(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    raw = part.select(F.concat("p_name", F.lit("-"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_type").alias("model"), F.concat(F.lit(" "), (F.col("p_size") * 1000).cast("string")).alias("max_input_tokens"),
                      F.when(F.col("p_size") < 5, F.lit("many")).otherwise(F.col("p_size").cast("string")).alias("max_output_tokens"), F.lit("0.2").alias("temperature"))
    return files.typed_models(raw).withColumn("max_output_tokens", F.coalesce("max_output_tokens", F.lit(-1)))


S18_SQL = """
SELECT p_name || '-' || p_partkey AS name, p_type AS model, p_size * 1000 AS max_input_tokens, CASE WHEN p_size >= 5 THEN p_size ELSE -1 END AS max_output_tokens, 0.2::DOUBLE AS temperature FROM part"""


def _events(spark, sf_dir):
    rows = fixture(spark, sf_dir, "usage")
    lacking = {"model": F.when(F.col("model") != "view", F.col("model")), "output_tokens": F.when(F.col("status") != "failed", F.col("output_tokens"))}
    return rows.withColumns(lacking).withColumn("error", F.when(F.col("status") == "failed", F.lit('said "no"\nagain')))


def s19_read_usage(spark, sf_dir):
    """Usage events written as JSON lines and read again, by model."""
    written = sinks.usage_lines(_events(spark, sf_dir).drop("event_id"))
    known = jobs.read_usage(written.unionByName(written.select(F.lit(" ").alias("value")).distinct()))
    return known.groupBy("model", "operation").agg(F.count(F.lit(1)).alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.max("error").alias("error"))


S19_SQL = f"""
WITH u AS ({duck("usage")})
SELECT CASE WHEN model = 'view' THEN 'unknown' ELSE model END AS model, 'unknown' AS operation, count(*) AS n, sum(input_tokens)::BIGINT AS input_tokens,
       sum(CASE WHEN status <> 'failed' THEN output_tokens ELSE 0 END)::BIGINT AS output_tokens, max(CASE WHEN status = 'failed' THEN 'said "no"' || chr(10) || 'again' END) AS error FROM u GROUP BY 1"""


def s20_annotation_of(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    notes = docs.join(_t(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id")
    annotations = notes.select(F.concat(F.lit("golden/"), F.col("doc_id").cast("string"), F.lit(".json")).alias("path"), F.col("sha256").alias("source_sha256"))
    return scoring.annotation_of(docs.select(F.col("doc_id").alias("document_id"), "sha256"), annotations)


S20_SQL = """
SELECT d.doc_id AS document_id, a.path FROM documents d
LEFT JOIN (SELECT text, min('golden/' || doc_id || '.json') AS path FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY text) a USING (text)"""


def k1_sorted_json(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    inner = F.struct(F.col("o_orderpriority").alias("b"), F.array(F.col("o_custkey")).alias("a"))
    rows = o.select("o_orderkey", F.to_json(F.struct(F.col("o_orderstatus").alias("z"), inner.alias("é"), F.col("o_orderkey").alias("k"))).alias("json"))
    return rows.select("o_orderkey", F.md5(sinks.sorted_json(F.col("json"))).alias("json_md5"))


K1_SQL = """
SELECT o_orderkey, md5('{' || chr(10) || '  "k": ' || o_orderkey || ',' || chr(10) || '  "z": "' || o_orderstatus || '",' || chr(10) || '  "é": {' || chr(10) || '    "a": [' || chr(10)
       || '      ' || o_custkey || chr(10) || '    ],' || chr(10) || '    "b": "' || o_orderpriority || '"' || chr(10) || '  }' || chr(10) || '}' || chr(10)) AS json_md5 FROM orders"""


def k2_transcription(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    title = F.concat(F.lit('The "'), "source", F.lit('"'))
    return docs.select("doc_id", F.md5(sinks.transcription_markdown(title, F.concat(F.lit("in/"), "source"), F.concat(F.lit("\n "), "text", F.lit(" \n")))).alias("markdown_md5"))


K2_SQL = """
SELECT doc_id, md5('---' || chr(10) || 'title: "The ''' || source || '''"' || chr(10) || 'source_file: "in/' || source || '"' || chr(10) || 'artifact_type: technical_pdf_transcription' || chr(10)
       || 'status: extracted_to_review' || chr(10) || '---' || chr(10) || chr(10) || trim(text, ' ' || chr(10)) || chr(10)) AS markdown_md5 FROM documents"""


def k5_unavailable(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    said = F.concat("c_mktsegment", F.lit("\x00"), F.repeat(F.lit("x"), F.lit(2100)))
    note = sinks.unavailable_markdown(F.col("c_name"), F.lit("in.pdf"), F.lit("t.md"), F.lit("e.json"))
    report = sinks.error_report(F.lit("QuotaError"), said, F.lit("t.md"), F.lit("s.md"))
    return c.select("c_custkey", F.md5(note).alias("note_md5"), F.md5(report).alias("report_md5"))


K5_SQL = """
SELECT c_custkey, md5('---' || chr(10) || 'title: "' || c_name || '"' || chr(10) || 'source_file: "in.pdf"' || chr(10) || 'artifact_type: technical_pdf_summary' || chr(10) || 'status: summary_unavailable' || chr(10) || '---' || chr(10)
       || chr(10) || '# Synthèse distante indisponible' || chr(10) || chr(10) || '- Transcription : `t.md`' || chr(10) || '- Rapport d''erreur : `e.json`' || chr(10)) AS note_md5,
       md5('{"schema_version":"1.0","status":"summary_unavailable","error_type":"QuotaError","error":"' || (c_mktsegment || repeat('x', 2100))[1:2000] || '","transcription_path":"t.md","summary_path":"s.md"}') AS report_md5 FROM customer"""


def k8_fallback_requests(spark, sf_dir):
    li = fixture(spark, sf_dir, "numbered")
    rows = li.select(
        F.concat(F.lit("e"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("n").cast("string")).alias("element_id"), F.concat(F.lit("out/"), F.col("l_orderkey").cast("string")).alias("packet"),
        F.concat(F.lit("/in/file "), "l_linestatus", F.lit(".pdf")).alias("pdf_path"), F.col("n").alias("pdf_page_number"), F.lit("blocked").alias("status"), F.when(F.col("l_returnflag") != "N", F.concat(F.lit("flag "), "l_returnflag")).alias("fallback_reason"),
    )
    made = sinks.fallback_requests(rows)
    return made.select("element_id", F.md5("request").alias("request_md5"))


K8_SQL = f"""
WITH n AS ({duck("numbered")})
SELECT 'e' || l_orderkey || '-' || n AS element_id, md5('{{"schema_version":"1.0","element_id":"e' || l_orderkey || '-' || n || '","reason":"flag ' || l_returnflag || '","recommended_status":"blocked","evidence_files":{{"full_page":"out/' || l_orderkey
       || '/full_page_original.png","normalized_crop":"out/' || l_orderkey || '/element_crop_normalized.png","ocr":"out/' || l_orderkey || '/ocr_text.txt","candidate":"out/' || l_orderkey || '/extraction_candidate.json"}},"inspection_command":"./pdf-evidence inspect ''/in/file '
       || l_linestatus || '.pdf'' --pdf-page ' || n || ' --element-id e' || l_orderkey || '-' || n || ' --dpi 450 --include-context --open-images","codex_instruction":"{sinks.REVIEW_INSTRUCTION}"}}') AS request_md5
FROM n WHERE l_returnflag <> 'N'"""


def k9_fallback_decision(spark, sf_dir):
    li = fixture(spark, sf_dir, "numbered").select("l_orderkey", "n", (F.col("l_returnflag") != "N").alias("media_available"), F.when(F.col("l_linestatus") == "O", 2).otherwise(1).alias("n_images"), F.round(F.col("l_tax") * 100).cast("int").alias("n_open"))
    return resolution.fallback_decision(li).select("l_orderkey", "n", "evidence_opened", "recommended_status", "reason")


K9_SQL = f"""
WITH a AS (SELECT l_orderkey, n, l_returnflag <> 'N' AND l_linestatus = 'O' AS opened, round(l_tax * 100) > 0 AS unsure FROM ({duck("numbered")}))
SELECT l_orderkey, n, opened AS evidence_opened, CASE WHEN opened AND NOT unsure THEN 'machine_reviewed' ELSE 'human_review_required' END AS recommended_status,
       CASE WHEN NOT opened THEN 'codex_media_unavailable' WHEN unsure THEN 'codex_visual_ambiguity_persists' ELSE 'codex_visual_evidence_readable' END AS reason FROM a"""


def k10_verified_markdown(spark, sf_dir):
    li = fixture(spark, sf_dir, "numbered")
    good, n = F.col("l_returnflag") == "R", F.col("n").cast("string")
    canonical = F.when(good, F.struct(F.concat(F.lit("r"), n).alias("review_id"), F.when(F.col("l_linestatus") == "O", F.col("l_linenumber")).alias("page_number")))
    status = F.when(good, "human_verified").when(F.col("l_linestatus") == "O", "blocked")
    rows = li.select(F.col("l_orderkey").cast("string").alias("document_sha256"), F.concat(F.lit("d"), F.col("l_orderkey").cast("string")).alias("document_id"), F.col("n").alias("ordinal"), F.concat(F.lit("e"), n).alias("element_id"),
                     F.lit("table").alias("element_type"), status.alias("status"), canonical.alias("canonical"), F.concat(F.lit("v"), F.col("l_quantity").cast("int").cast("string")).alias("body"))
    return resolution.verified_markdown(rows).select(F.col("document_sha256").cast("long").alias("l_orderkey"), F.md5("markdown").alias("markdown_md5"))


K10_SQL = f"""
WITH n AS ({duck("numbered")}), a AS (
    SELECT l_orderkey, string_agg('## e' || n || chr(10) || chr(10) || '- Page PDF : ' || CASE WHEN l_linestatus = 'O' THEN l_linenumber::VARCHAR ELSE 'inconnue' END || chr(10) || '- Type : `table`' || chr(10) || '- Revue : `r' || n || '`' || chr(10) || chr(10) || 'v' || l_quantity::INT,
             chr(10) || chr(10) ORDER BY n) FILTER (WHERE l_returnflag = 'R') AS s,
           string_agg('- `e' || n || '` — `' || CASE WHEN l_linestatus = 'O' THEN 'blocked' ELSE 'unknown' END || '`', chr(10) ORDER BY n) FILTER (WHERE l_returnflag <> 'R') AS o FROM n GROUP BY 1)
SELECT l_orderkey, md5('# Extraction technique canonique vérifiée' || chr(10) || chr(10) || '- Document : `d' || l_orderkey || '`' || chr(10) || '- SHA-256 : `' || l_orderkey || '`' || chr(10) || chr(10)
       || coalesce(s || chr(10), 'Aucun élément n''a encore été validé humainement.' || chr(10)) || coalesce(chr(10) || '## Éléments non canoniques' || chr(10) || chr(10) || o || chr(10), '')) AS markdown_md5 FROM a"""


def k12_manifests(spark, sf_dir):
    """Manifests written as JSON and read again, a row a video in its place."""
    made = sinks.manifest_documents(jobs.upsert(fixture(spark, sf_dir, "updates")))
    videos = F.from_json("manifest", "playlist_title string, videos array<struct<url string, title string, status string, kept boolean>>")["videos"]
    return made.select("playlist_title", F.posexplode(videos).alias("place", "v")).select("playlist_title", "place", "v.*")


K12_SQL = f"WITH {_UPSERT} SELECT playlist_title, (row_number() OVER (PARTITION BY playlist_title ORDER BY position) - 1)::INT AS place, url, title, status, kept FROM m"


def k13_usage_lines(spark, sf_dir):
    return sinks.usage_lines(_events(spark, sf_dir)).select(F.md5("value").alias("line_md5"))


K13_SQL = f"""
WITH u AS ({duck("usage")}), p AS (SELECT *, status = 'failed' AS bad FROM u)
SELECT md5('{{"event_id":' || event_id || ',"model":' || CASE WHEN model = 'view' THEN 'null' ELSE '"' || model || '"' END || ',"status":"' || status || '","input_tokens":' || input_tokens || ',"output_tokens":' || CASE WHEN bad THEN 'null' ELSE output_tokens::VARCHAR END
       || ',"error":' || CASE WHEN bad THEN '"said \\"no\\"\\nagain"' ELSE 'null' END || '}}') AS line_md5 FROM p"""


def k14_stale_files(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    name = F.when(F.col("event_type") == "error", F.lit(".gitkeep")).otherwise(F.concat(F.col("event_id").cast("string"), F.lit(".txt")))
    rows = e.select(F.concat(F.lit("/work/"), F.when(F.col("event_type") == "view", "cache/../").when(F.col("event_type") == "click", "other/").otherwise("cache/"), name).alias("path"), F.col("ts").alias("modificationTime"))
    old = files.stale_files(rows, 10, F.lit("2024-01-25 00:00:00").cast("timestamp"))
    return old.select("path", sinks.is_inside(F.col("path"), F.lit("/work/cache")).alias("may_go"))


K14_SQL = """
SELECT '/work/' || CASE event_type WHEN 'view' THEN 'cache/../' WHEN 'click' THEN 'other/' ELSE 'cache/' END || event_id || '.txt' AS path, event_type NOT IN ('view', 'click') AS may_go
FROM events WHERE event_type <> 'error' AND ts < TIMESTAMP '2024-01-15 00:00:00'"""


def k15_paths(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    path = F.concat(F.lit("out/"), "p_type", F.lit("/"), "p_name", F.when(F.col("p_size") > 20, ".sidecar.json").when(F.col("p_size") > 10, ".v2.json").otherwise(""))
    return part.select("p_partkey", sinks.resolved_paths(path).alias("r")).select("p_partkey", "r.sidecar", "r.markdown")


K15_SQL = """
WITH a AS (SELECT p_partkey, 'out/' || p_type || '/' || p_name AS base, CASE WHEN p_size > 20 THEN '' WHEN p_size > 10 THEN '.v2' ELSE '' END AS mid, p_size > 20 AS side FROM part)
SELECT p_partkey, base || mid || CASE WHEN side THEN '.resolved.sidecar.json' ELSE '.resolved.json' END AS sidecar, base || mid || '.verified.md' AS markdown FROM a"""


def n5_decoded(spark, sf_dir):
    half = (F.char_length("text") / 2).cast("int")
    broken = F.concat(F.encode(F.substring("text", F.lit(1), half), "UTF-8"), F.unhex(F.lit("FFC3")), F.encode(F.substring("text", half + 1, F.char_length("text")), "UTF-8"))
    docs = _t(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.md5(files.decode_text(broken)).alias("text_md5"))


def n11_content_text(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    rows = o.select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", "human_verified").otherwise("blocked").alias("status"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit('{"rows":[["a",'), k, F.lit(']],"bbox":[1],"ok":true}'))).alias("canonical_structure"), F.concat("o_orderpriority", F.lit(' "q"')).alias("raw_text"),
        F.concat(F.lit('{"z":"x","a":['), c, F.lit('],"confidence":0.5}')).alias("candidate"), F.when(F.col("o_orderstatus") == "O", F.lit('{"note":"seen"}')).alias("visual_review"),
    )
    return rows.select("o_orderkey", scoring.content_text(rows).alias("content"))


N11_SQL = """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' THEN 'a' || chr(10) || o_orderkey
       ELSE o_orderpriority || ' "q"' || chr(10) || 'x' || chr(10) || o_custkey || CASE WHEN o_orderstatus = 'O' THEN chr(10) || 'seen' ELSE '' END END AS content FROM orders"""


def a8_engine_plan(spark, sf_dir):
    urgent, high, low = (F.count_if(F.col("o_orderpriority") == p).cast("int") for p in ("1-URGENT", "2-HIGH", "5-LOW"))
    o = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).cast("int").alias("page_count"), urgent.alias("image_count"), high.alias("table_hint_count"), low.alias("formula_hint_count"), F.floor(F.min("o_totalprice") / 100).cast("int").alias("avg_chars_per_page")
    )
    known = complexity.classify(o.withColumn("scanned_likely", (F.col("avg_chars_per_page") < 120) & (F.col("image_count") >= 2)))
    probes = F.create_map(F.lit("ocrmypdf"), F.lit(True), F.lit("gs"), F.col("page_count") > 8, F.lit("tesseract"), F.lit(True), F.lit("qpdf"), F.col("image_count") > 0, F.lit("mineru"), F.col("table_hint_count") > 1, F.lit("marker_single"), F.col("formula_hint_count") > 2)
    return complexity.engine_plan(known, probes).select("o_custkey", "complexity", "preferred_engine", F.array_join("fallback_order", ",").alias("engines"))


A8_SQL = """
WITH a AS (SELECT o_custkey, count(*)::INT AS p, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS i, count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS t, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS f,
                  floor(min(o_totalprice) / 100) AS c FROM orders GROUP BY 1),
b AS (SELECT *, c < 120 AND i >= 2 AS scanned FROM a),
s AS (SELECT *, 4 * scanned::INT + CASE WHEN p >= 150 THEN 2 WHEN p >= 60 THEN 1 ELSE 0 END + CASE WHEN i >= 8 THEN 2 WHEN i >= 3 THEN 1 ELSE 0 END + CASE WHEN t >= 10 THEN 2 WHEN t >= 3 THEN 1 ELSE 0 END
             + CASE WHEN f >= 5 THEN 2 WHEN f >= 1 THEN 1 ELSE 0 END + (c < 120 AND NOT scanned)::INT AS score FROM b),
k AS (SELECT *, CASE WHEN score >= 4 THEN 'high' WHEN score >= 2 THEN 'medium' ELSE 'low' END AS complexity FROM s),
e AS (SELECT *, list_filter(CASE WHEN scanned THEN ['ocrmypdf', 'mineru', 'marker', 'text'] WHEN complexity = 'high' THEN ['mineru', 'ocrmypdf', 'marker', 'text'] WHEN complexity = 'medium' THEN ['mineru', 'text', 'ocrmypdf', 'marker']
             ELSE ['text', 'mineru', 'ocrmypdf', 'marker'] END, lambda x: CASE x WHEN 'ocrmypdf' THEN p > 8 AND i > 0 WHEN 'mineru' THEN t > 1 WHEN 'marker' THEN f > 2 ELSE true END) AS l FROM k)
SELECT o_custkey, complexity, l[1] AS preferred_engine, array_to_string(l, ',') AS engines FROM e"""


def c1_tokenizer_tokens(spark, sf_dir):
    """Tokens of every text by a public tokenizer's file, and the way they were counted; there is no SQL for those."""
    import public_tokenizers

    counted = tx.counted_by(public_tokenizers.path("byte_bpe_50k.json"))(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", counted.alias("c")).select("doc_id", "c.tokens", "c.way")


def counting_model(instructions: str, text: str, model: str) -> str:
    """A model that says how long a text is, and fails for some lengths."""
    if len(text) % 17 == 3:
        raise RuntimeError("quota exceeded")
    if len(text) % 17 == 5:
        raise TimeoutError("too slow")
    return f" {model}: {len(text)}\n"


def l1_model_calls(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("lang").alias("model"))
    return adapters.call_model(rows, counting_model, "count").select("doc_id", F.trim("answer").alias("answer"), "error", "calls")


L1_SQL = """
SELECT doc_id, CASE WHEN length(text) % 17 NOT IN (3, 5) THEN lang || ': ' || length(text) || chr(10) END AS answer,
       CASE length(text) % 17 WHEN 3 THEN 'RuntimeError: quota exceeded' WHEN 5 THEN 'TimeoutError: too slow' END AS error, CASE length(text) % 17 WHEN 5 THEN 3 ELSE 1 END AS calls FROM documents"""


def reviewing_model(instructions: str, text: str, model: str) -> str:
    """A model whose first answer is no JSON for some texts, and for others neither answer is, or there is none."""
    if text == "MACHINERY":
        raise TimeoutError("too slow")
    if text == "AUTOMOBILE" or text == "BUILDING" and "\n" not in instructions:
        return "nothing"
    return '{"ok":1}'


def v6_reviews(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select(F.col("c_name").alias("element_id"), F.col("c_mktsegment").alias("text"), F.lit("m").alias("model"))
    return adapters.review_once_repaired(rows, reviewing_model, "look", lambda answer: None if answer.get("ok") else "not ok")


V6_SQL = """
SELECT c_name AS element_id, CASE WHEN c_mktsegment NOT IN ('MACHINERY', 'AUTOMOBILE') THEN '{"ok":1}' END AS review,
       CASE c_mktsegment WHEN 'MACHINERY' THEN 'TimeoutError: too slow' WHEN 'AUTOMOBILE' THEN 'invalid JSON: Expecting value: line 1 column 1 (char 0)' END AS error, c_mktsegment IN ('AUTOMOBILE', 'BUILDING') AS repaired FROM customer"""


def m4_isolated(spark, sf_dir):
    u = fixture(spark, sf_dir, "updates")
    rows = u.select("seq", "url", "title", F.concat(F.lit("out/"), "title").alias("output_path"), F.when(F.col("status") == "failed", F.concat(F.lit("no "), "title")).alias("error"), F.lit("m").alias("model_used"))
    return jobs.isolate(rows).select("seq", "url", "status", "output_path", "kept", "error")


M4_SQL = f"""
WITH u AS ({duck("updates")}) SELECT seq, url, CASE WHEN status = 'failed' THEN 'failed' ELSE 'done' END AS status, CASE WHEN status <> 'failed' THEN 'out/' || title END AS output_path, status <> 'failed' AS kept,
       CASE WHEN status = 'failed' THEN 'no ' || title END AS error FROM u"""


def m6_dry_run(spark, sf_dir):
    videos = jobs.upsert(fixture(spark, sf_dir, "updates"))
    return jobs.dry_run(videos, 25)


M6_SQL = f"WITH {_UPSERT} SELECT url, title, 'dry-run' AS status, true AS kept FROM m ORDER BY position LIMIT 25"


def r2_templates(spark, sf_dir):
    li = fixture(spark, sf_dir, "numbered")
    rows = li.select(F.col("l_orderkey").cast("string").alias("document_sha256"), F.concat(F.lit("e"), F.col("n").cast("string")).alias("element_id"), F.when(F.col("l_returnflag") != "A", F.concat(F.lit('{"q":'), F.col("l_quantity").cast("int").cast("string"), F.lit("}"))).alias("structure"),
                     F.when(F.col("l_linestatus") == "O", F.lit("packet/review.json")).alias("review_path"))
    made = resolution.review_template(rows)
    return made.select("document_sha256", "element_id", "review_id", "decision", "corrected_structure", F.array_join("evidence_files", ",").alias("evidence"), F.col("reviewer.type").alias("reviewer"))


R2_SQL = f"""
WITH n AS ({duck("numbered")})
SELECT l_orderkey::VARCHAR AS document_sha256, 'e' || n AS element_id, 'review-e' || n AS review_id, 'pending' AS decision, CASE WHEN l_returnflag <> 'A' THEN '{{"q":' || l_quantity::INT || '}}' ELSE '{{}}' END AS corrected_structure,
       CASE WHEN l_linestatus = 'O' THEN 'packet/review.json' ELSE '' END AS evidence, 'human' AS reviewer FROM n"""


def r3_quantitative(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    kind = F.substring("o_orderpriority", 1, 1)
    text = F.when(kind == "1", '{"content":[{"type":"text_block"},{"type":"table","data":[[1]]}]}').when(kind == "2", '{"content":[{"type":"table","data":"none"}]}').when(kind == "3", '{"columns":["a"],"rows":[[2]]}').when(kind == "4", '{"columns":["a"],"rows":2}').otherwise("{}")
    return o.groupBy("o_custkey").agg(F.count_if(resolution.is_quantitative_table(text)).alias("tables"), F.count(F.lit(1)).alias("n"))


R3_SQL = "SELECT o_custkey, count(*) FILTER (WHERE o_orderpriority[1] IN ('1', '3')) AS tables, count(*) AS n FROM orders GROUP BY 1"


def d14_chosen_elements(spark, sf_dir):
    pages = fixture(spark, sf_dir, "layout_all_pages")
    wanted = F.when(F.col("o_orderkey") % 3 == 0, F.format_string("p%06d-formula-01", F.col("page_index") + 1)).when(F.col("o_orderkey") % 3 == 1, F.lit("p0"))
    return detection.choose_elements(pages.select("doc_id", "page_index", wanted.alias("wanted")), _elements(spark, sf_dir))


D14_CHOSEN_SQL = f"""
WITH {_LAYOUT}, {_ELEMENTS},
ids AS (SELECT doc_id, page_index, list(element_id ORDER BY ordinal) AS ids FROM elements GROUP BY ALL),
a AS (SELECT p.doc_id, p.page_index, ids, CASE WHEN o_orderkey % 3 = 0 THEN printf('p%06d-formula-01', p.page_index + 1) WHEN o_orderkey % 3 = 1 THEN 'p0' END AS wanted FROM pages0 p LEFT JOIN ids USING (doc_id, page_index))
SELECT doc_id, page_index, CASE WHEN wanted IS NULL THEN ids[1] WHEN list_contains(ids, wanted) THEN wanted END AS element_id,
       CASE WHEN ids IS NULL THEN 'no element on this page; give a box' WHEN wanted IS NOT NULL AND NOT list_contains(ids, wanted) THEN 'unknown element ' || wanted || '; available: ' || array_to_string(ids, ', ') END AS error FROM a"""


def d14_manual_crops(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    asked = fixture(spark, sf_dir, "layout_blocks").select("doc_id", "page_index", "block_ordinal", F.concat_ws(",", F.col("x0").cast("int"), (F.col("y0") + 200).cast("int"), (F.col("x1") - 60).cast("int"), (F.col("y1") + 220).cast("int")).alias("box"))
    made = detection.manual_crops(asked, pages)
    return made.groupBy("doc_id", "page_index").agg(F.count("error").alias("errors"), F.count("bbox").alias("boxes"), F.sum("bbox.y1").alias("y1"), F.max("element_id").alias("element_id"))


D14_CROPS_SQL = f"""
WITH b AS ({duck("layout_blocks")}), c AS (SELECT doc_id, page_index, y0 + 200 < 800 AND x1 - 60 > x0 AS good, least(800, y1 + 220)::DOUBLE AS y1 FROM b)
SELECT doc_id, page_index, count(*) FILTER (WHERE NOT good) AS errors, count(*) FILTER (WHERE good) AS boxes, sum(y1) FILTER (WHERE good) AS y1, max(CASE WHEN good THEN printf('p%06d-manual-crop', page_index + 1) END) AS element_id FROM c GROUP BY ALL"""

QUERIES = {
    "s1_pdf_markdown": (s1_pdf_markdown, S1_SQL),
    "s2_cached_path": (s2_cached_path, S2_SQL),
    "s4_ocr_prefix": (s4_ocr_prefix, S4_SQL),
    "s14_video_info": (s14_video_info, S14_SQL),
    "s16_transcripts": (s16_transcripts, S16_SQL),
    "s17_folder": (s17_folder, None),
    "s18_model_settings": (s18_model_settings, S18_SQL),
    "s19_read_usage": (s19_read_usage, S19_SQL),
    "s20_annotation_of": (s20_annotation_of, S20_SQL),
    "k1_sorted_json": (k1_sorted_json, K1_SQL),
    "k2_transcription": (k2_transcription, K2_SQL),
    "k5_unavailable": (k5_unavailable, K5_SQL),
    "k8_fallback_requests": (k8_fallback_requests, K8_SQL),
    "k9_fallback_decision": (k9_fallback_decision, K9_SQL),
    "k10_verified_markdown": (k10_verified_markdown, K10_SQL),
    "k12_manifests": (k12_manifests, K12_SQL),
    "k13_usage_lines": (k13_usage_lines, K13_SQL),
    "k14_stale_files": (k14_stale_files, K14_SQL),
    "k15_paths": (k15_paths, K15_SQL),
    "n5_decoded": (n5_decoded, "SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL"),
    "n11_content_text": (n11_content_text, N11_SQL),
    "a8_engine_plan": (a8_engine_plan, A8_SQL),
    "c1_tokenizer_tokens": (c1_tokenizer_tokens, None),
    "l1_model_calls": (l1_model_calls, L1_SQL),
    "v6_reviews": (v6_reviews, V6_SQL),
    "m4_isolated": (m4_isolated, M4_SQL),
    "m6_dry_run": (m6_dry_run, M6_SQL),
    "r2_templates": (r2_templates, R2_SQL),
    "r3_quantitative": (r3_quantitative, R3_SQL),
    "d14_chosen_elements": (d14_chosen_elements, D14_CHOSEN_SQL),
    "d14_manual_crops": (d14_manual_crops, D14_CROPS_SQL),
}
