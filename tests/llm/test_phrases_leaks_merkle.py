"""Phrases, leaks and Merkle proofs against brute force, with nulls, empties, repeats, ties and clashing columns."""

import hashlib
import random
import re
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.llm import decontaminate, merkle, phrases
from quirelake.llm.fm_index import FmIndex

# ---- phrases


@pytest.mark.parametrize("seed", range(6))
def test_fm_index_finds_every_gram_with_its_count(seed):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, (2, 3, 6, 40)[seed % 4], (0, 1, 50, 400, 2000, 7)[seed])
    want = {k: Counter(tuple(ids[i : i + k].tolist()) for i in range(len(ids) - k + 1) if 0 not in ids[i : i + k]) for k in range(1, 6)}
    for k, grams in enumerate(FmIndex(ids, 5).grams(1, 5), 1):
        assert dict(zip(map(tuple, grams.words.tolist()), grams.count.tolist())) == dict(want[k])


def brute_phrases(rows, least, most=2000):
    total, found = Counter(), Counter()
    for text, lang in rows:
        lowered = (text or "").encode().lower().decode()
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall(r"[^ \t]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, 6):
                found.update((lang or "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    often = {g: n for g, n in found.items() if n >= least}
    out = []
    for (lang, words), a in often.items():
        inside = any(g[0] == lang and len(g[1]) > len(words) and n >= a and any(g[1][i : i + len(words)] == words for i in range(len(g[1]))) for g, n in often.items())
        if len(words) > 1 and not inside:
            cuts = [(1000 * a * total[lang] // (often[lang, words[:k]] * often[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            out.append((lang, " ".join(words), a, often[lang, words[:k]], often[lang, words[k:]], total[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        best = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:most]
        ranked += [(lang, i, *r[1:]) for i, r in enumerate(best, 1)]
    return sorted(ranked)


@pytest.mark.parametrize("least, most, shard_words", [(3, 2000, 40), (2, 5, 1 << 20), (6, 2000, 1)])
def test_phrases_by_brute_force(spark, least, most, shard_words):
    rng = random.Random(least)
    words = ["the", "The", "Éa", "éa", "b", "c_d", "x\xa0y", "\x1cq", "日本"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ", ", "\n", ".", " ;; "]) for _ in range(rng.randrange(60))) for _ in range(40)]
    rows = [(t, rng.choice(["en", "fr", None, "und"])) for t in texts] + [(None, "en"), ("", None), ("a " * 300, "de"), (texts[0], "en"), (texts[0], "en")]
    docs = spark.createDataFrame(rows, "text string, lang string").withColumns({"n": F.lit(1), "shard": F.lit("x"), "words": F.lit(None)}).repartition(3)
    got = phrases.collocations(*phrases.phrase_counts(docs, least=least, shard_words=shard_words), most=most)
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, least, most)


def test_sides_are_the_most_frequent_longer_phrases(spark):
    docs = spark.createDataFrame([("a b c. a b d. a b c. z a b",)], "text string").withColumn("lang", F.lit("en"))
    rows = {tuple(r.words): (r.a, r.left, r.right) for r in phrases.phrase_counts(docs, least=1)[0].collect()}
    assert rows["a", "b"] == (4, 1, 2) and rows["c",] == (2, 2, 0) and rows["z", "a", "b"] == (1, 0, 0)


def test_scores_are_exact_beyond_64_bits(spark):
    n, x, y, a = 123_456_789_012_345, 98_765_432_101, 87_654_321_098, 86_420_864_209
    counts = spark.createDataFrame([("en", ["x"], x, 0, 0), ("en", ["y"], y, 0, 0), ("en", ["x", "y"], a, 0, 0)], "lang string, words array<string>, a long, left long, right long")
    row = phrases.collocations(counts, spark.createDataFrame([("en", n)], "lang string, n long")).first()
    assert row.score == 1000 * a * n // (x * y) and Decimal(row.a) * row.n > 1 << 63


def test_no_phrases_of_no_texts(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(*phrases.phrase_counts(docs)).count() == 0


# ---- leaks

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute_leaks(texts, items, width=10):
    out = []
    lower = lambda t: (t or "").encode().lower().decode()
    asked = [(i, re.findall(WORD, lower(t))) for i, t in items]
    for text in texts:
        spans = [m.span() for m in re.finditer(WORD, lower(text))]
        words = [lower(text)[a:b] for a, b in spans]
        hit, found = set(), set()
        for item, w in asked:
            k = min(width, len(w))
            for s in range(len(w) - k + 1) if w else ():
                for p in range(len(words) - k + 1):
                    if words[p : p + k] == w[s : s + k]:
                        hit |= set(range(p, p + k))
                        found |= {item} - {None}
        edges = sorted(hit)
        runs = [(a, next(e for e in edges if e >= a and e + 1 not in hit)) for a in edges if a - 1 not in hit]
        out.append((len(words), len(hit), [(spans[a][0], spans[b][1]) for a, b in runs], sorted(map(str, found))))
    return out


@pytest.mark.parametrize("letters", [1 << 20, 150])
def test_leaks_by_brute_force(spark, letters):
    rng = random.Random(7)
    vocabulary = ["a", "B", "é9", "Über", "日", "x1"]
    said = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "\n", " - ", "_", "\x7f"]) for _ in range(n))
    items = [(1, said(12)), (2, said(30)), (10, "a B"), (11, ""), (None, "x1 x1 x1"), (3, None), (2, said(11)), (4, "日 日 é9"), (5, said(10))]
    texts = [said(rng.randrange(120)) for _ in range(20)] + [None, "", "??", items[1][1].upper(), "ß " + items[0][1] + items[1][1], "a B" * 500, items[8][1], items[8][1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumns({"items": F.lit(1), "runs": F.lit("q"), "__marks": F.lit(2), "windows": F.lit(3)})
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = decontaminate.find_leaks(docs, decontaminate.benchmark_windows(bench), letters=letters)
    assert got.columns == [*docs.columns, "__leaks"]
    found = [(r[0].n_words, r[0].n_hit, [tuple(s) for s in r[0].spans], list(r[0]["items"])) for r in got.orderBy("doc_id").select("__leaks").collect()]
    assert found == brute_leaks(texts, items)


def test_no_benchmark_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id int, text string")
    empty = spark.createDataFrame([], "item_id int, text string")
    assert decontaminate.find_leaks(docs, decontaminate.benchmark_windows(empty)).first()["__leaks"].n_hit == 0
    assert decontaminate.find_leaks(docs.limit(0), decontaminate.benchmark_windows(empty)).count() == 0
    with pytest.raises(ValueError):
        decontaminate.find_leaks(docs.withColumn("__leaks", F.lit(1)), decontaminate.benchmark_windows(empty))


def test_answers_are_windows_too(spark):
    bench = spark.createDataFrame([(1, "what is it", "the answer")], "id int, q string, a string")
    docs = spark.createDataFrame([("it is THE answer.",)], "text string")
    leaks = decontaminate.find_leaks(docs, decontaminate.benchmark_windows(bench, "id", ("q", "a"))).first()["__leaks"]
    assert (leaks.n_hit, [tuple(s) for s in leaks.spans]) == (2, [(6, 16)])


# ---- Merkle proofs

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_level(nodes):
    return [H(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]


def brute_proof(nodes, at):
    siblings = []
    while len(nodes) > 1:
        run = nodes[at // 16 * 16 : at // 16 * 16 + 16]
        siblings += run[: at % 16] + run[at % 16 + 1 :]
        nodes, at = brute_level(nodes), at // 16
    return nodes[0], siblings


def brute_merkle(rows):
    """(doc_id, leaf, subroot, root, proof) of (doc_id, source) rows."""
    sealed = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    first = lambda v: (v is not None, str(v or "").encode())
    groups = {}
    for doc_id, source in rows:
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, H(sealed(doc_id), sealed(source)), doc_id))
    order = sorted(groups, key=first)
    leaves = {g: sorted(groups[g], key=lambda r: r[:3]) for g in order}
    subroots = [brute_proof([r[2] for r in leaves[g]], 0)[0] for g in order]
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(leaves[g]):
            subroot, own = brute_proof([x[2] for x in leaves[g]], i)
            root, above = brute_proof(subroots, k)
            out.append((r[3], r[2], subroot, root, H(*own, *above)))
    return sorted(out, key=str)


def proofs_of(rows, keep=None):
    leaves = rows.select("doc_id", "source", merkle.leaf_digest(F.col("doc_id"), F.col("source")).alias("leaf"), F.lit("x").alias("place"), F.lit(1).alias("n"), F.lit(2).alias("group"))
    manifest = merkle.build_manifest(leaves, "source", ["doc_id"])
    asked = manifest.leaves.select("group", "place", "carried.doc_id", "leaf", F.lit(0).alias("path"), F.lit(0).alias("digest"))
    got = merkle.prove(manifest, asked if keep is None else asked.where(keep)).select("doc_id", "leaf", "__proof.*")
    folded = merkle.fold(F.col("leaf"), F.col("path"))
    return manifest, got.select("doc_id", "digest", "subroot", F.lit(manifest.root).alias("root"), merkle.path_digest(F.col("path")).alias("proof"), (folded == F.lit(manifest.root)).alias("ok"), (F.col("leaf") == F.col("digest")).alias("same"))


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 17, "b": 1, None: 300}, {f"s{i}": 1 + i % 3 for i in range(20)}, {"": 16, "é": 256, "z": 257}])
def test_proofs_by_brute_force(spark, sizes):
    rows = [(k * 1000 + i * 7 % 1000, source) for k, (source, n) in enumerate(sizes.items()) for i in range(n)] + [(None, next(iter(sizes)))]
    rows += rows[:2]  # repeated rows tie
    docs = spark.createDataFrame(rows, "doc_id long, source string").repartition(3)
    _, got = proofs_of(docs)
    found = got.collect()
    assert all(r.ok and r.same for r in found)
    assert sorted((tuple(r)[:5] for r in found), key=str) == brute_merkle(rows)


def test_some_leaves_are_asked_for(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    _, got = proofs_of(docs, F.col("doc_id") % 50 == 3)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == [r for r in brute_merkle(rows) if r[0] % 50 == 3]


def test_no_leaves(spark):
    manifest, got = proofs_of(spark.createDataFrame([], "doc_id long, source string"))
    assert manifest.root is None and got.count() == 0


def test_a_tampered_leaf_does_not_fold_to_the_root(spark):
    manifest, _ = proofs_of(spark.createDataFrame([(i, "a") for i in range(40)], "doc_id long, source string"))
    got = merkle.prove(manifest, manifest.leaves.select("group", "place", "leaf"))
    folded = merkle.fold(F.sha2("leaf", 256), F.col("__proof.path"))
    assert got.where(folded == F.lit(manifest.root)).count() == 0
