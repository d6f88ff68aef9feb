import hashlib
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirelake.llm import chat, common, multi_index, warc
from quirelake.llm.common import fresh_dir


def test_scratch_tables_go(spark):
    def there(df):
        return os.path.exists(df.written_at.removeprefix("file:").replace("///", "/").replace("//", "/"))

    with common.scratch() as keep_all:
        with common.scratch() as keep:
            a, b = (common.written(spark.range(3), "t") for _ in range(2))
            keep(b)
        assert not there(a) and there(b)
        c = keep_all(common.written(b, "t"))
    assert not there(b) and there(c) and c.count() == 3


def raw_headers(folder):
    """The headers of all records in a folder's bundles, read frame after frame by another library call."""
    import glob

    import zstandard

    heads = []
    for path in glob.glob(folder.removeprefix("file://") + "/*.warc.zst"):
        with open(path, "rb") as f:
            data = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            heads.append(dict(line.decode().split(": ", 1) for line in head.split(b"\r\n")[1:]))
            data = rest[int(heads[-1]["Content-Length"]) + 4 :]
    return heads


def test_a_task_that_runs_again_leaves_the_index_right(spark):
    rows = spark.createDataFrame([(i, "u", f"{i}" * 2000) for i in range(50)], "page_id long, url string, html string")
    folder = fresh_dir(spark, "warc")
    marked = warc.mark_revisits(rows)
    first = warc.write_archives(marked.where("page_id >= 0"), folder, "one")  # as an attempt that Spark doesn't commit
    again = warc.write_archives(marked.orderBy(F.desc("page_id")), folder, "two")
    assert first.select("bundle").intersect(again.select("bundle")).count() == 0
    assert {(r.page_id, bytes(r.payload).decode()) for r in warc.read_records(again, folder).collect()} == {(i, f"{i}" * 2000) for i in range(50)}


def test_archives_round_trip(spark):
    big = "<p>é</p>" * 400
    rows = [(1, "http://a/ b\r\nc", big), (2, None, big), (5, "http://a", big), (3, "u", None), (4, "u", ""), (6, "u", "small"), (7, "u", "small"), (None, "u", big), (5, "http://a", big)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    folder = fresh_dir(spark, "warc")
    index = warc.write_archives(warc.mark_revisits(pages), folder)
    got = sorted(((r.page_id, r.type, r.payload_bytes, r.payload_digest, r.refers_to) for r in warc.read_records(index, folder).collect()), key=str)
    n, sha = len(big.encode()), hashlib.sha1(big.encode()).hexdigest()
    none, small = hashlib.sha1(b"").hexdigest(), hashlib.sha1(b"small").hexdigest()
    expected = [(i, "revisit", n, sha, 5) for i in (1, 2, None)] + [(5, "response", n, sha, None)] * 2 + [(i, "response", 0, none, None) for i in (3, 4)] + [(i, "response", 5, small, None) for i in (6, 7)]
    assert got == sorted(expected, key=str)
    some = warc.read_records(index.where("page_id = 6"), folder).collect()
    assert [bytes(r.payload) for r in some] == [b"small"]
    known = {r.record_id: r for r in warc.read_records(index, folder).collect()}
    assert len(known) == len(rows) - 1 and index.count() == len(rows)  # page 5 comes twice, with one payload
    heads = raw_headers(folder)
    revisits = [h["WARC-Refers-To"][1:-1] for h in heads if h["WARC-Type"] == "revisit"]
    assert len(heads) == len(rows) and len(revisits) == 3 and all(known[r].type == "response" and bytes(known[r].payload) == big.encode() for r in revisits)
    assert warc.write_archives(warc.mark_revisits(pages.where("false")), fresh_dir(spark, "warc")).count() == 0


def test_seek_table_names_independent_frames(spark, tmp_path):
    import zstandard

    import pyarrow.fs as pafs

    bundle = warc._Bundle(f"file://{tmp_path}", "b")
    for i in range(40):
        own, record = warc.record(i, "u", bytes([65 + i % 26]) * 100_000, None, False)
        bundle.add(own, i, record)
    rows = bundle.close()
    data = (tmp_path / bundle.name).read_bytes()
    with pafs.LocalFileSystem().open_input_file(str(tmp_path / bundle.name)) as f:
        frames = warc.read_seek_table(f)
    assert len(frames) > 2 and len(frames) == 1 + max(r[3] for r in rows)
    at = 0
    for k, (packed, plain) in enumerate(frames):
        whole = zstandard.ZstdDecompressor().decompress(data[at : at + packed])
        assert len(whole) == plain
        for own, page, _, frame, offset, size in rows:
            if frame == k:
                assert warc.parse(whole[offset : offset + size])[0]["WARC-Record-ID"] == f"<{own}>" and own.startswith(f"urn:page:{page}:")
        at += packed


def test_trees_are_ranked_and_formatted(spark):
    tree = [("r", None, 1.0), ("a", "r", 5.0), ("b", "r", 2.0), ("a1", "a", 0.0), ("b1", "b", 9.0), ("b2", "b1", None), ("lost", "gone", 1.0)]
    nodes = spark.createDataFrame(tree, "node string, parent string, score double")
    found = chat.paths(nodes)
    by_leaf = {}
    for r in found.collect():
        by_leaf.setdefault(r.leaf, []).append((r.depth, r.node, r.score))
    assert {k: [n for _, n, _ in sorted(v)] for k, v in by_leaf.items()} == {"a1": ["a1", "a", "r"], "b2": ["b2", "b1", "b", "r"], "lost": ["lost"]}
    trees = nodes.select("node", F.lit("t").alias("tree"))
    said = [("r", "user", "q"), ("b", "assistant", "\\### Assistant: </turn> ok"), ("b1", "user", None), ("b2", "assistant", "done\\b")]
    best = chat.best_leaves(nodes.where("node <> 'lost'"), trees)
    out = chat.format_paths(chat.paths(nodes, best), spark.createDataFrame(said, "node string, role string, text string"))
    row = out.select("leaf", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_masked(F.col("formatted"), F.col("mask")).alias("masked"), "formatted").first()
    assert row.leaf == "b2"
    assert [(t.role, t.text) for t in row.turns] == [("user", "q"), ("assistant", said[1][2]), ("user", ""), ("assistant", "done\\b")]
    assert row.masked == [said[1][2], "done\\b"] and row.formatted.count("</turn>") == 4


def brute_paths(rows):
    parent, score = {n: p for n, p, _ in rows}, {n: s or 0.0 for n, _, s in rows}
    out = {}
    for leaf in set(parent) - {p for p in parent.values()}:
        path, node = [], leaf
        while node in parent and node not in path:
            path.append(node)
            node = parent[node]
        if node not in parent:  # else it goes round
            out[leaf] = (sum(score[n] for n in path), path)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_trees_with_cycles_by_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, None if i == 0 else int(rng.integers(-1, i)), float(rng.integers(4)) if i % 5 else None) for i in range(60)]
    rows += [(100, 101, 1.0), (101, 102, 1.0), (102, 100, 1.0), (103, 101, 1.0), (104, 103, 1.0), (105, 105, 1.0)]  # a ring, what hangs on it, a loop
    rows += [(200 + i, 199 + i if i else None, 1.0) for i in range(70)]
    nodes = spark.createDataFrame(rows, "node long, parent long, score double")
    want = brute_paths(rows)
    found = {}
    for r in chat.paths(nodes).collect():
        found.setdefault(r.leaf, (r.score, []))[1].append((r.depth, r.node))
    assert {k: (s, [n for _, n in sorted(p)]) for k, (s, p) in found.items()} == want
    trees = nodes.select("node", (F.col("node") % 2).alias("tree"))
    best = {(r.tree, r["rank"]): r.leaf for r in chat.best_leaves(nodes, trees, 3).collect()}
    for tree in (0, 1):
        order = sorted((-s, leaf) for leaf, (s, _) in want.items() if leaf % 2 == tree)[:3]
        assert [best[tree, k + 1] for k in range(len(order))] == [leaf for _, leaf in order]


def test_only_rings_and_repeated_nodes(spark):
    ring = spark.createDataFrame([(3, 4, 1.0), (4, 3, 1.0)], "node long, parent long, score double")
    assert chat.paths(ring).count() == 0
    with pytest.raises(ValueError):
        chat.climbs(ring.union(ring))


def test_conversations_with_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (1, None, "assistant", ""), (None, 0, "assistant", "y" * 50_000), (2, 0, "user", "a\n</turn>\n### user: b")]
    rows += [(3, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(70)]
    made = chat.format_conversations(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, node int"))
    got = {r.conv_id: r for r in made.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_masked(F.col("formatted"), F.col("mask")).alias("masked")).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("assistant", ""), ("user", ""), ("", "x"), ("", "x")]
    assert got[None].masked == ["y" * 50_000] and got[2].turns[0].text == rows[5][3]
    assert [t.text for t in got[3].turns] == [f"t{i}" for i in range(70)] and got[3].masked == [f"t{i}" for i in range(1, 70, 2)]
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_multi_sequence_takes_pairs_in_order():
    rng = np.random.default_rng(5)
    a, b = rng.random(6), rng.random(7)
    cells = multi_index.multi_sequence(a, b, np.ones(42, int), 42)
    sums = [a[c // 7] + b[c % 7] for c in cells]
    assert sorted(cells) == list(range(42)) and sums == sorted(sums)


@pytest.mark.parametrize("share, least", [(1.0, 1.0), (0.5, 0.9)])
def test_search_by_brute_force(spark, monkeypatch, share, least):
    monkeypatch.setattr(multi_index, "ENTRY_BLOCK", 20)
    monkeypatch.setattr(multi_index, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 16)).astype("f4")
    x[100:140] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, [1.0]), (None, [1.0] * 16), (100, x[100].tolist())]
    vectors = multi_index.valid_vectors(spark.createDataFrame(rows + odd, "v long, e array<float>"), "v", "e")
    assert vectors.count() == 601
    got = multi_index.search(vectors, vectors.where("id % 20 = 0"), centroids=16, share=share).toPandas()
    hits = 0
    for q in range(0, 600, 20):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        true = [i for i in np.lexsort((np.arange(600), d)) if i != q][:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11)) and np.allclose(mine.score, d[mine.vec_id])
        assert mine.score.is_monotonic_increasing
        hits += len(set(true) & set(mine.vec_id))
        if share == 1.0:
            assert mine.vec_id.tolist() == true
    assert hits / 300 >= least
    monkeypatch.undo()
    few = multi_index.search(vectors.where("id < 4"), vectors.where("id = 0"))
    assert few.count() == 3 and multi_index.search(vectors.where("false"), vectors).count() == 0


@pytest.mark.parametrize("n", [500, 20_000])
def test_recall_through_the_index(spark, n):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype("f4")
    vectors = multi_index.valid_vectors(spark.createDataFrame(pa.table({"v": np.arange(n), "e": list(x)})), "v", "e")
    step = n // 25
    got = multi_index.search(vectors, vectors.where(F.col("id") % step == 0)).toPandas()
    hits = 0
    for q in range(0, n, step):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        true = [i for i in np.lexsort((np.arange(n), d)) if i != q][:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert len(mine) == 10 and np.allclose(mine.score, d[mine.vec_id], rtol=1e-12)
        hits += len(set(true) & set(mine.vec_id))
    assert 0.9 <= hits / 250 < 1  # less than all: not every entry was searched


def test_vectors_with_structure_need_little_of_the_index(spark):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(60, 32))[rng.integers(0, 60, 6000)] * 4 + rng.normal(size=(6000, 32)) * 0.3).astype("f4")
    vectors = multi_index.valid_vectors(spark.createDataFrame(pa.table({"v": np.arange(6000), "e": list(x)})), "v", "e")
    shares, found = [], multi_index.share_for
    multi_index.share_for = lambda *a: shares.append(found(*a)) or shares[-1]
    try:
        got = multi_index.search(vectors, vectors.where("id % 200 = 0")).toPandas()
    finally:
        multi_index.share_for = found
    hits = 0
    for q in range(0, 6000, 200):
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1)
        hits += len(set(np.argsort(d, kind="stable")[1:11]) & set(got[got.query_id == q].vec_id))
    assert hits / 300 >= 0.9 and shares[0] < 0.1
