"""Queries over composed runs: documents to notes, videos to notes, pages to reviewed elements."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelake.operators import flows
from quirelake.plans.fixtures import duck, fixture
from quirelake.plans.layout_queries import _ELEMENTS, _LAYOUT, _blocks, _pages
from quirelake.plans.source_queries import counting_model
from quirelake.plans.text_queries import _CLEAN, CHUNK_LIMIT, DEEP_LIMIT, VIDEO_LIMIT, C4_SQL, N4_SQL
from quirelake.sources import sinks
from quirelake.sources.staging import discard, staged

_HEAD = {
    "video": ('source_type: "youtube"', 'url: "', ("content_value", "technical_level", "bullshit_risk"), ("video",)),
    "pdf": ('source_type: "pdf"', 'source_file: "', ("domain", "technical_level", "content_value", "bullshit_risk"), ("pdf", "livre")),
}


def _front(kind: str, title: str, source: str) -> str:
    """summary_front_matter() in SQL."""
    origin, field, unknown, tags = _HEAD[kind]
    after = "".join(f'{k}: "{sinks.UNKNOWN}"\n' for k in unknown) + "graphipy_ready: true\ntags:\n" + "".join(f"  - {t}\n" for t in tags) + "---\n"
    return f"'---\ntitle: \"' || {title} || '\"\n{origin}\n{field}' || {source} || '\"\n{after}'"


def _failure(length: str) -> str:
    return f"CASE {length} % 17 WHEN 3 THEN 'RuntimeError: quota exceeded' WHEN 5 THEN 'TimeoutError: too slow' END"


def _videos(spark, sf_dir):
    s = fixture(spark, sf_dir, "subtitles")
    key = F.col("doc_id").cast("string")
    url = F.concat(F.lit("https://v.example/"), key)
    return s.select("doc_id", url.alias("url"), F.concat(F.lit("Talk "), key).alias("title"), F.concat(F.lit("talk-"), key).alias("slug"), F.when(F.col("doc_id") % 11 != 0, F.col("text")).alias("subtitles"))


def o3_run_videos(spark, sf_dir):
    videos = _videos(spark, sf_dir)
    outputs = videos.where("doc_id % 7 = 0").select(F.concat(F.lit("output/videos/"), "slug", F.lit(".md")).alias("output_path"))
    manifest = videos.where("doc_id % 13 = 0").select("url", F.when(F.col("doc_id") % 2 == 0, "done").otherwise("failed").alias("status"))
    made = flows.run_videos(videos.drop("doc_id"), counting_model, "sum up", VIDEO_LIMIT, manifest, outputs)
    return made.select("url", "title", "status", "output_path", "kept", "error", "model_used", F.md5("summary").alias("summary_md5"))


_VIDEOS = f"""
    said AS ({N4_SQL}), v AS (SELECT s.doc_id, 'https://v.example/' || s.doc_id AS url, 'Talk ' || s.doc_id AS title, s.doc_id % 7 = 0 AS there, s.doc_id % 11 = 0 AS lost, coalesce(clean, '') AS t FROM ({duck("subtitles")}) s LEFT JOIN said USING (doc_id)
                                WHERE NOT (s.doc_id % 13 = 0 AND s.doc_id % 2 = 0)),
    w AS (SELECT *, CASE WHEN greatest(1, length(t) // 4) > {VIDEO_LIMIT} THEN 'video_dense' ELSE 'video_simple' END AS model, CASE WHEN lost THEN 'no subtitles' ELSE {_failure("length(t)")} END AS failure FROM v),
    videos AS (SELECT doc_id, url, title, CASE WHEN there OR failure IS NULL THEN 'done' ELSE 'failed' END AS status, CASE WHEN there OR failure IS NULL THEN 'output/videos/talk-' || doc_id || '.md' END AS output_path, there OR failure IS NULL AS kept,
               CASE WHEN NOT there THEN failure END AS error, CASE WHEN NOT there AND failure IS NULL THEN model END AS model_used,
               CASE WHEN NOT there AND failure IS NULL THEN md5({_front("video", "title", "url")} || chr(10) || model || ': ' || length(t) || chr(10)) END AS summary_md5 FROM w)"""


def o4_playlist_jobs(spark, sf_dir):
    videos = _videos(spark, sf_dir)
    made = flows.run_videos(videos.drop("doc_id"), counting_model, "sum up", VIDEO_LIMIT)
    return flows.playlist_jobs(made, F.concat(F.lit("Liste n° "), F.substring("title", -1, 1)))


O4_SQL = f"""
WITH said AS ({N4_SQL}), v AS (SELECT s.doc_id, s.doc_id % 11 = 0 AS lost, length(coalesce(clean, '')) % 17 IN (3, 5) AS failed FROM ({duck("subtitles")}) s LEFT JOIN said USING (doc_id))
SELECT 'Liste n° ' || doc_id % 10 AS playlist_title, 'cache/jobs/playlist-liste-n-' || doc_id % 10 || '_manifest.json' AS manifest_path, count(*) FILTER (WHERE NOT lost AND NOT failed) AS done, count(*) FILTER (WHERE lost OR failed) AS failed,
       count(*) FILTER (WHERE NOT lost AND NOT failed) AS kept FROM v GROUP BY doc_id % 10"""


def layout_engine(content: bytes) -> str:
    """An engine that fails for some files and finds nothing in others."""
    text = content.decode()
    if len(text) % 3 == 0:
        raise RuntimeError("no layout")
    return "" if len(text) % 3 == 1 else text


def text_engine(content: bytes) -> str:
    return content.decode()


def o1_run_documents(spark, sf_dir):
    """Files to notes; those of parts' names have too little text."""
    files = fixture(spark, sf_dir, "extracted").select(
        "doc_id", F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), F.lit("in/a.pdf").alias("source_file"),
        F.col("text").cast("binary").alias("content"), F.array(F.lit("layout"), F.lit("text")).alias("fallback_order"),
    )
    made = flows.run_files(files, {"layout": layout_engine, "text": text_engine}, counting_model, "sum up", DEEP_LIMIT, CHUNK_LIMIT)
    return made.select(
        "doc_id", "status", F.char_length("transcription").alias("transcription_chars"), F.md5("summary").alias("summary_md5"), F.md5("export").alias("export_md5"), "error", "engine",
        F.size("attempts").alias("attempts"), F.get(F.col("attempts.error"), F.lit(0)).alias("first_error"),
    )


_O1_CLEAN = _CLEAN.replace(duck("markdown"), f"SELECT doc_id, '' AS lang, text FROM ({duck('extracted')}) WHERE doc_id >= 0 AND length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 200")
_O1_CHUNKS = C4_SQL.replace(duck("sectioned"), f"SELECT doc_id, lang, clean AS text FROM clean WHERE greatest(1, length(clean) // 4) > {DEEP_LIMIT}").replace("md5(body) AS text_md5", "body")
O1_SQL = f"""
WITH {_O1_CLEAN},
chunks AS ({_O1_CHUNKS}),
asked AS (SELECT doc_id, index, 'PARTIE ' || (index + 1) || '/' || count(*) OVER (PARTITION BY doc_id) || chr(10) || chr(10) || body AS t FROM chunks),
gathered AS (SELECT doc_id, string_agg(' pdf_chunk: ' || length(t) || chr(10), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY index) AS t, min_by({_failure("length(t)")}, index) FILTER (WHERE length(t) % 17 IN (3, 5)) AS failed FROM asked GROUP BY doc_id),
calls AS (SELECT doc_id, 'pdf_deep' AS model, length(clean) AS n, {_failure("length(clean)")} AS error FROM clean WHERE greatest(1, length(clean) // 4) <= {DEEP_LIMIT}
          UNION ALL SELECT doc_id, 'pdf_final_synthesis', length(t), coalesce(failed, {_failure("length(t)")}) FROM gathered),
f AS (SELECT doc_id, text, length(text) AS n FROM ({duck("extracted")})),
made AS (SELECT f.doc_id, clean, error, CASE WHEN clean IS NOT NULL AND error IS NULL THEN {_front("pdf", "'Doc ' || f.doc_id", "'in/a.pdf'")} || chr(10) || model || ': ' || calls.n || chr(10) END AS note,
                CASE WHEN clean IS NOT NULL AND error IS NOT NULL THEN '---' || chr(10) || 'title: "Doc ' || f.doc_id || '"' || chr(10) || 'source_file: "in/a.pdf"' || chr(10) || 'artifact_type: technical_pdf_summary' || chr(10) || 'status: summary_unavailable' || chr(10) || '---' || chr(10)
                     || chr(10) || '# Synthèse distante indisponible' || chr(10) || chr(10) || '- Transcription : `output/pdfs/doc-' || f.doc_id || '.transcription.md`' || chr(10) || '- Rapport d''erreur : `output/pdfs/doc-' || f.doc_id || '.error.json`' || chr(10) END AS sorry,
                CASE WHEN clean IS NULL THEN NULL WHEN f.n % 3 = 2 THEN 'layout' ELSE 'text' END AS engine, CASE WHEN clean IS NOT NULL AND f.n % 3 = 2 THEN 1 ELSE 2 END AS attempts,
                CASE WHEN f.n % 3 = 0 THEN 'RuntimeError: no layout' WHEN clean IS NULL OR f.n % 3 = 1 THEN 'unusable text' END AS first_error
         FROM f LEFT JOIN clean USING (doc_id) LEFT JOIN calls USING (doc_id))
SELECT doc_id, CASE WHEN clean IS NULL THEN 'unusable' WHEN error IS NULL THEN 'done' ELSE 'summary_unavailable' END AS status,
       (length(regexp_replace(clean, '^\\s+|\\s+$', '', 'g')) + length('---' || chr(10) || 'title: "Doc ' || doc_id || '"' || chr(10) || 'source_file: "in/a.pdf"' || chr(10) || 'artifact_type: technical_pdf_transcription' || chr(10) || 'status: extracted_to_review' || chr(10) || '---' || chr(10)) + 2)::INT AS transcription_chars,
       md5(coalesce(note, sorry)) AS summary_md5, md5(note) AS export_md5, error, engine, attempts, first_error FROM made"""


def o6_evidence_run(spark, sf_dir):
    """Detected elements after checks, review, budget and quota stop, by document and status."""
    blocks = staged(_blocks(spark, sf_dir), "blocks")
    pages = staged(_pages(spark, sf_dir, blocks), "pages")
    made = flows.run_evidence(blocks, pages, reviewed_elements, reads=("page_index", "ordinal", "element_type"))
    discard(blocks, pages)  # elements are a table of their own by now
    return made.groupBy("doc_id", F.col("status_after").alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("attempted").alias("attempted"), F.sum("calls").alias("calls"), F.count_if("circuit_open").alias("after_stop"), F.count("fallback_reason").alias("handed_on")
    )


class _Failed(Exception):
    """A review that failed, after a second call or not."""

    def __init__(self, said: str, repaired: bool):
        super().__init__(said)
        self.repaired = repaired


def reviewed_elements(element: dict) -> dict:
    """A reviewer that reads most elements right, is unsure of some and fails for others."""
    p, k = element["page_index"], element["ordinal"]
    repaired = k % 3 == 2
    if p == 7 and k == 1:
        raise _Failed("RESOURCE_EXHAUSTED", repaired)
    if k % 6 == 5:
        raise _Failed("timeout", repaired)
    return {
        "media_readable": k % 5 != 4,
        "observed_type": element["element_type"],
        "recommended_status": "human_review_required" if k % 4 == 3 else "machine_verified_with_visual_check",
        "disagreements": [],
        "n_ambiguous": 0,
        "n_missing": 0,
        "numeric_confidence": 0.97,
        "structure_confidence": 0.95,
        "formula_confidence": 0.95,
        "has_formula": True,
        "repaired": repaired,
    }


O6_SQL = f"""
WITH {_LAYOUT}, {_ELEMENTS},
prev AS (SELECT doc_id, page_index + 1 AS page_index, true AS linked FROM elements WHERE family = 'figure' AND number IS NOT NULL GROUP BY ALL),
e AS (SELECT e.*, e.ordinal AS k, coalesce(linked, false) AND family = 'figure' AND number IS NULL AND little AS pointed, b.text LIKE 'strike%' AS has_rows FROM elements e LEFT JOIN prev USING (doc_id, page_index)
      LEFT JOIN (SELECT doc_id, page_index, text, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY block_ordinal) - 1 AS ordinal FROM classified) b USING (doc_id, page_index, ordinal)),
f AS (SELECT *, CASE WHEN page_index = 7 AND k = 1 THEN 'RESOURCE_EXHAUSTED' WHEN k % 6 = 5 THEN 'timeout' END AS error,
             CASE WHEN k % 5 = 4 THEN 'human_review_required' WHEN alerts LIKE '%scan_skew%' OR alerts LIKE '%continued%' OR pointed THEN 'needs_visual_review' WHEN k % 4 = 3 THEN 'human_review_required' WHEN family = 'figure' THEN 'image_only'
                  WHEN element_type = 'table' AND NOT coalesce(has_rows, false) THEN 'needs_visual_review' ELSE 'machine_verified_with_visual_check' END AS reviewed,
             row_number() OVER (PARTITION BY doc_id ORDER BY page_index, k) <= 40 AS inside FROM e),
g AS (SELECT *, coalesce(max((inside AND error = 'RESOURCE_EXHAUSTED')::INT) OVER (PARTITION BY doc_id ORDER BY page_index, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS stopped FROM f),
h AS (SELECT *, inside AND NOT stopped AS attempted, status = 'image_only' AS image FROM g),
i AS (SELECT *, CASE WHEN attempted AND error IS NOT NULL THEN 'human_review_required' WHEN attempted THEN reviewed WHEN image THEN status ELSE 'human_review_required' END AS after,
             CASE WHEN attempted AND error IS NOT NULL THEN true WHEN attempted THEN reviewed IN ('needs_visual_review', 'human_review_required', 'blocked') ELSE NOT image END AS handed FROM h)
SELECT doc_id, after AS status, count(*) AS n, count(*) FILTER (WHERE attempted) AS attempted, sum(CASE WHEN NOT attempted THEN 0 WHEN k % 3 = 2 THEN 2 ELSE 1 END)::BIGINT AS calls, count(*) FILTER (WHERE stopped) AS after_stop,
       count(*) FILTER (WHERE handed) AS handed_on FROM i GROUP BY 1, 2"""

QUERIES = {
    "o1_run_documents": (o1_run_documents, O1_SQL),
    "o3_run_videos": (o3_run_videos, f"WITH {_VIDEOS} SELECT * EXCLUDE (doc_id) FROM videos"),
    "o4_playlist_jobs": (o4_playlist_jobs, O4_SQL),
    "o6_evidence_run": (o6_evidence_run, O6_SQL),
}
