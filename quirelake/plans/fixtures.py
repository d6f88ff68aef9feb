"""Inputs of the document operators, derived from the given tables by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("documents", "pages", "conversations", "labels", "events", "lineitem", "orders", "part", "customer", "nation", "supplier", "embeddings", "benchmark")

SQL = {
    # page texts with page markers, runs of blank lines, repeated lines and, in every third, a running header
    "markdown": """
        SELECT doc_id, lang, source,
               CASE WHEN doc_id % 3 = 0 THEN 'Head ' || CAST(doc_id % 7 AS STRING) || chr(10) || 'Page 1' || chr(10) || '- Head' || chr(10)
                    || '  Head ' || CAST(doc_id % 7 AS STRING) || ' ' || chr(10) || 'x' || chr(10) || 'Head ' || CAST(doc_id % 7 AS STRING) || chr(13) || chr(10)
                    || 'Head ' || CAST(doc_id % 7 AS STRING) || chr(10) ELSE '' END
               || text || chr(10) || 'PAGE  12' || chr(10) || chr(10) || chr(10) || chr(10) || chr(10) || chr(10) || 'kept ' || chr(10) || ' 3 / 7 ' || chr(10)
               || chr(10) || 'kept' || chr(10) || text AS text
        FROM {documents}""",
    # what is in the files of documents, under a heading, and in those of parts, which is little
    "extracted": """
        SELECT doc_id, '# T' || chr(10) || text AS text FROM ({markdown}) UNION ALL SELECT -1 - p_partkey, p_name FROM {part}""",
    # the same prose as sections: every fifth line a heading, blank lines between lines
    "sectioned": """
        SELECT doc_id, lang, '# A' || chr(10) || replace(replace(text, '. ', '.' || chr(10) || chr(10)), ',', chr(10) || '## B') AS text FROM {documents}""",
    "subtitles": """
        SELECT conv_id * 1000 + turn AS doc_id,
               'WEBVTT' || chr(10) || chr(10) || '1' || chr(10) || '00:00:01,000 --> 00:00:02,000' || chr(10) || '<i>' || text || '</i>' || chr(10) || chr(10)
               || '2' || chr(10) || '00:02.500 --> 00:03.000' || chr(10) || text || chr(10) || 'NOTE internal' || chr(10) || 'a  &amp;  b' AS text
        FROM {conversations}""",
    # a page for each order, its customer being the document
    "layout_pages": """
        SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS page_index, o_orderkey,
               CAST(600 AS DOUBLE) AS width, CAST(800 AS DOUBLE) AS height, 0 AS rotation, 'native_pdf_text' AS text_source, CAST(1.0 AS DOUBLE) AS text_confidence
        FROM {orders}""",
    # and, after its last page, an empty one
    "layout_all_pages": """
        SELECT doc_id, page_index, o_orderkey, width, height, rotation, text_source, text_confidence FROM ({layout_pages})
        UNION ALL SELECT o_custkey, CAST(count(*) AS INT), CAST(NULL AS BIGINT), CAST(600 AS DOUBLE), CAST(800 AS DOUBLE), 0, 'native_pdf_text', CAST(1.0 AS DOUBLE) FROM {orders} GROUP BY o_custkey""",
    "numbered": """
        SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM {lineitem}""",
    # a block for each line item, of nine kinds
    "layout_blocks": """
        SELECT p.doc_id, p.page_index, CAST(l.n - 1 AS INT) AS block_ordinal,
               CASE WHEN (l.l_orderkey * 7 + l.n * 3) % 9 = 6 THEN 1 ELSE 0 END AS block_type,
               CASE (l.l_orderkey * 7 + l.n * 3) % 9
                    WHEN 0 THEN 'Table ' || CAST(l.l_partkey % 9 AS STRING) || '.' || CAST(l.l_suppkey % 3 AS STRING) || CASE WHEN l.l_suppkey % 2 = 0 THEN ' (continued)' ELSE ' sizes' END
                    WHEN 1 THEN 'FIGURE 14.1 shows volume'
                    WHEN 2 THEN 'Fig. ' || CAST(l.l_partkey % 5 AS STRING) || ' Profit and loss at expiry'
                    WHEN 3 THEN 'Figure ' || CAST(l.l_partkey % 4 AS STRING) || '-2 delta vs. time'
                    WHEN 4 THEN 'strike  bid  ask' || chr(10) || CAST(CAST(l.l_quantity AS INT) AS STRING) || '  1,120  -.5' || chr(10) || '3/4  +7  0'
                    WHEN 5 THEN 'y = a*x + ' || CAST(l.n AS STRING)
                    WHEN 6 THEN ''
                    WHEN 7 THEN CAST(l.l_partkey % 300 AS STRING)
                    ELSE 'plain prose of a block' END AS text,
               CAST((l.l_partkey % 300) AS DOUBLE) AS x0, CAST((l.l_suppkey * 37 + l.n * 90) % 700 AS DOUBLE) AS y0,
               CAST((l.l_partkey % 300) + 60 + l.n * 40 AS DOUBLE) AS x1, CAST((l.l_suppkey * 37 + l.n * 90) % 700 + 30 + l.n * 10 AS DOUBLE) AS y1
        FROM ({numbered}) l JOIN ({layout_pages}) p ON l.l_orderkey = p.o_orderkey""",
    # a word for each line item: the order is the page, sloping lines of ten
    "ocr_words": """
        SELECT CAST(l_orderkey AS STRING) AS doc_id, 0 AS page_index, n AS ordinal,
               CASE WHEN n % 7 = 0 THEN '4' ELSE '5' END AS level, '1' AS page_num, CAST(l_orderkey % 2 AS STRING) AS block_num, '1' AS par_num,
               CASE WHEN n > 5 THEN '2' ELSE 'x' END AS line_num, CAST(n AS STRING) AS word_num,
               CAST(n * 90 + l_partkey % 40 AS STRING) AS "left", CAST(100 + n * (l_suppkey % 5) AS STRING) AS top,
               CAST(40 + l_partkey % 30 AS STRING) AS width, CAST(10 + l_suppkey % 4 AS STRING) AS height,
               CASE WHEN n = 3 THEN '-1' WHEN n = 4 THEN 'n/a' ELSE CAST(50 + l_partkey % 50 AS STRING) END AS conf,
               CASE WHEN n = 6 THEN '  ' ELSE ' w' || CAST(l_partkey AS STRING) END AS text
        FROM ({numbered})""",
    "usage": """
        SELECT event_id, event_type AS model, CASE WHEN user_id % 11 = 0 THEN 'failed' WHEN user_id % 13 = 0 THEN 'other' ELSE 'success' END AS status,
               CAST(event_id % 5000 AS BIGINT) AS input_tokens, CAST(user_id * 3 AS BIGINT) AS output_tokens
        FROM {events}""",
    "updates": """
        SELECT 'list ' || CAST(user_id % 3 AS STRING) AS playlist_title, event_id AS seq, 'https://v.example/' || CAST(user_id AS STRING) AS url, 'T' || CAST(event_id % 9 AS STRING) AS title,
               CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 4 = 0 THEN 'pending' ELSE 'done' END AS status, event_id % 2 = 0 AS kept
        FROM {events}""",
    "products": """
        SELECT l_orderkey, l_linenumber,
               'line: ' || CAST(CAST(l_quantity AS INT) AS STRING) || ' x .' || CAST(10 + l_partkey % 80 AS STRING) || ' = '
               || CAST(CAST(CAST(l_quantity AS INT) * (10 + l_partkey % 80) + CASE WHEN l_orderkey % 7 = 0 THEN 3 ELSE 0 END AS INT) / 100 AS STRING) AS text,
               CAST(l_quantity AS INT) AS q, CAST(10 + l_partkey % 80 AS INT) AS d
        FROM {lineitem}""",
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = _nested(name)
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text.replace('"left"', "`left`"), **used)


def _nested(name: str) -> str:
    text = SQL[name]
    while any(f"{{{other}}}" in text for other in SQL):
        for other in SQL:
            text = text.replace(f"{{{other}}}", SQL[other])
    return text


def duck(name: str) -> str:
    """The fixture as DuckDB SQL over the registered views."""
    return _nested(name).format(**{t: t for t in TABLES})
