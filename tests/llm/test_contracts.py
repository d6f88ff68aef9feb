"""The registered queries: columns, types and what their contracts say of every row, on the smallest tables."""

import hashlib
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quirelake.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SHAPES = {
    "op1_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op2_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op3_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op4_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op5_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op6_chat": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op7_line_crf": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op9_multi_index": "query_id bigint, rank int, vec_id bigint, score double",
    "op10_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op11_phrases": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    "op12_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op13_merkle": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
}


@pytest.fixture(scope="module")
def rows(spark):
    """The rows of a query, run once."""
    known = {}

    def of(name):
        if name not in known:
            df = QUERIES[name](spark, SF)
            known[name] = df.dtypes, df.collect()
        return known[name]

    return of


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_columns_and_types(rows, name):
    types, got = rows(name)
    expected = [tuple(c.split()) for c in SHAPES[name].split(", ")]
    assert [t for t in types if t[0] in dict(expected)] == expected and len(got) > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_by_sql(rows, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "conversations", "benchmark"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = db.sql(ORACLES[name])
    names = [c.split()[0] for c in SHAPES[name].split(", ")]
    expected = sorted(([r[found.columns.index(c)] for c in names] for r in found.fetchall()), key=str)
    assert sorted(([r[c] for c in names] for r in rows(name)[1]), key=str) == expected


@pytest.mark.parametrize("name", ["op1_quality_rules", "op2_mixing", "op3_line_dedup", "op4_simhash", "op7_line_crf", "op10_language_id"])
def test_a_row_for_each_document(rows, docs, name):
    assert sorted(r.doc_id for r in rows(name)[1]) == sorted(docs)


def test_quality_base_counts(rows, docs):
    for r in rows("op1_quality_rules")[1]:
        text = docs[r.doc_id].text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        assert r.n_words == len(w) and r.word_chars == sum(map(len, w)) and r.n_symbols == sum(c in "#*$%&|<>" for c in text)
        assert r.base_failed == (len(w) < 50 or 100 * r.n_repeat_words > 50 * len(w)) and not (r.kept and r.base_failed)


def test_simhash_components(rows):
    got = rows("op4_simhash")[1]
    prints = {r.doc_id: int(r.fingerprint, 16) for r in got}
    root = {d: d for d in prints}
    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = root[a], root[b]
                root = {d: min(x, y) if r in (x, y) else r for d, r in root.items()}
    assert {r.doc_id: r.component_id for r in got} == root and all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in got)


def test_scores_and_folds(rows):
    for name in ("op7_line_crf", "op10_language_id"):
        for r in rows(name)[1]:
            assert 0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert all(r.predicted == int(r.score >= 0.7) for r in rows("op7_line_crf")[1])


def test_packing_covers_every_id(rows, docs):
    by_doc, by_sequence = {}, {}
    for r in rows("op8_packing")[1]:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(docs)
    for pieces in by_doc.values():
        end = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == end
            end += r.length
        assert end == pieces[0].doc_tokens
    for s, pieces in by_sequence.items():
        end = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end == 1024 or s == max(by_sequence) and end < 1024


def test_nearest_are_ranked(rows, spark):
    ids = [r[0] for r in spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 100 = 0").select("vec_id").collect()]
    by_query = {}
    for r in rows("op9_multi_index")[1]:
        by_query.setdefault(r.query_id, []).append(r)
    assert set(by_query) <= set(ids) and by_query
    for q, found in by_query.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, len(found) + 1)) and len(found) == 10
        assert [(r.score, r.vec_id) for r in found] == sorted((r.score, r.vec_id) for r in found) and q not in [r.vec_id for r in found]


def test_escaped_conversation(rows):
    (probe,) = [r for r in rows("op6_chat")[1] if r.conv_id == -7]
    said = r"\### Assistant: </turn> ok"
    assert probe.n_turns == 2 and probe.loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and probe.loss_chars == len(said)
