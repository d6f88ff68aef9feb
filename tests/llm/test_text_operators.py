import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.llm import language_id, line_crf, line_dedup, mixing, ngram_model, packing, quality_rules, simhash
from quirelake.llm.common import running_total
from quirelake.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, fp string, times int"
LONG = "Lang repeated clause " * 20_000
LINE = "A shared line of text"


def edge_rows():
    rows = [
        (1, None, "en", "a"), (2, "", None, None), (3, " \t\n\x0b\n", "en", "a"), (4, LONG, "en", "b"),
        (5, f"{LINE}\nown five\n  a SHARED line of text \nend", "en", "b"), (6, f"x\n{LINE.upper()}\n", "fr", "b"),
        (7, "one two three four five six", "fr", None), (7, "one two three four five six", "fr", None),
        (None, f"{LINE}\nno id", "en", "a"), (9, "Éa b c d\nshort\nshort", "en", "c"), (10, "### $$ 漢字\r\n" + LINE, "de", "c"),
    ]
    return [(*r, 0, "clash", "clash", 9) for r in rows]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def prose(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_running_total_follows_the_order(spark):
    values = [(i, (i * 7919) % 101) for i in range(500)]
    df = spark.createDataFrame(values, "k long, v long").repartition(7)
    got = {r.k: r.t for r in running_total(df, [F.col("k").desc()], "v", "t").collect()}
    total = 0
    for k, v in sorted(values, reverse=True):
        assert got[k] == total
        total += v


def test_line_dedup_by_brute_force(edge, empty):
    holders = defaultdict(set)
    blanks = " \t\n\x0b\x0c\r"
    up = {c: c + 32 for c in range(65, 91)}
    key = lambda x: x.strip(blanks).translate(up)
    for r in edge_rows():
        for x in (r[1] or "").split("\n"):
            if r[0] is not None and len(key(x)) >= 10:
                holders[key(x)].add(r[0])
    expected = []
    for r in edge_rows():
        lines = (r[1] or "").split("\n")
        stay = [x for x in lines if r[0] is None or len(holders[key(x)]) < 2 or len(key(x)) < 10 or r[0] == min(holders[key(x)])]
        expected.append((r[0], "\n".join(stay), len(lines), len(lines) - len(stay)))
    clash = edge.withColumns({c: F.lit("mine") for c in ("kept", "__d", "__h1", "c0", "pos")})
    rows = line_dedup.dedup_lines(clash)
    assert rows.columns == [*clash.columns, "__lines"] and rows.where("kept = 'mine' AND __d = 'mine' AND c0 = 'mine'").count() == len(expected)
    got = [(r.doc_id, *r["__lines"]) for r in rows.collect()]
    assert Counter(got) == Counter(expected)
    assert sum(r[3] for r in got) == 2
    assert line_dedup.dedup_lines(empty).count() == 0


def test_lines_of_one_id_with_two_texts_and_of_three_documents(spark):
    rows = [(1, "first shared\nonly here 1"), (1, "second text\nfirst shared"), (2, "first shared\nsecond text\nown line two"), (3, "first shared\nfirst shared\nshort")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r["__lines"].kept, r["__lines"].n_dropped) for r in line_dedup.dedup_lines(docs).collect())
    assert got == Counter([(1, rows[0][1], 0), (1, rows[1][1], 0), (2, "own line two", 2), (3, "short", 2)])
    thrice = Counter((r.doc_id, r["__lines"].kept) for r in line_dedup.dedup_lines(docs, min_docs=3).collect())
    assert thrice == Counter([(1, rows[0][1]), (1, rows[1][1]), (2, "second text\nown line two"), (3, "short")])


def test_a_text_of_a_million_lines(spark):
    many = "\n".join(f"line number {i}" for i in range(1_000_000))
    odd = "\n".join(f"LINE NUMBER {i}" if i % 2 else "kept" for i in range(1_000_000))
    docs = spark.createDataFrame([(5, many), (6, odd)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).select("doc_id", "__lines.n_lines", "__lines.n_dropped", F.sha2("__lines.kept", 256).alias("h")).collect()}
    assert time.time() - began < 90
    assert got[5].n_dropped == 0 and got[5].h == hashlib.sha256(many.encode()).hexdigest()
    assert got[6].n_dropped == 500_000 and got[6].h == hashlib.sha256("\n".join(["kept"] * 500_000).encode()).hexdigest()


def test_fingerprints_by_definition():
    import xxhash

    for text in ("", None, "one", "One two", "a b c d e f g a b c", LONG[:3000]):
        w = [x.lower() for x in words(text)]
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
        expected = sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles)) if shingles else 0
        assert simhash.fingerprint(text.encode() if text is not None else None) & (1 << 64) - 1 == expected


def brute_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    expected = brute_components(pairs, {n for p in pairs for n in p})
    assert all(got.get(n, n) == r for n, r in expected.items())


@pytest.mark.parametrize("block", [4096, 5])
def test_links_join_what_is_within_reach(spark, block):
    rng = random.Random(1)
    prints = {0}
    for _ in range(12):
        base = rng.getrandbits(64)
        prints |= {base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 5))) for _ in range(25)}
    prints = sorted(prints)
    signed = [simhash._signed(p) for p in prints]
    found = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), block).collect()]
    near = [(simhash._signed(a), simhash._signed(b)) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 3]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in found)
    assert brute_components(found, signed) == brute_components(near, signed)


def test_near_duplicates_of_edge_rows(edge, empty):
    got = simhash.near_duplicates(edge).collect()
    assert len(got) == len(edge_rows())
    by_id = {r.doc_id: r.component_id for r in got}
    assert by_id[1] == by_id[2] == by_id[3] == 1 and by_id[7] == 7 and None in by_id
    assert simhash.near_duplicates(empty).count() == 0


def test_the_embedding_bounds_the_distance(spark):
    rng = np.random.default_rng(11)
    x = rng.integers(0, 1 << 63, 500, np.uint64)
    y = x ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)) ^ (np.uint64(3) << rng.integers(0, 63, 500).astype(np.uint64))
    ones = lambda v: np.array([[(int(a) >> i & 3).bit_count() for i in range(0, 64, 2)] for a in v])
    expected = np.abs(ones(x) - ones(y)).sum(axis=1)
    assert np.concatenate([simhash._manhattan(x[i : i + 1], y[i]) for i in range(500)]).tolist() == expected.tolist()
    assert (expected <= np.bitwise_count(x ^ y)).all()
    pairs = spark.createDataFrame([(simhash._signed(int(a)), simhash._signed(int(b))) for a, b in zip(x, y)], "a long, b long")
    assert [r[0] for r in pairs.select(simhash._apart(simhash._counts(F.col("a")), simhash._counts(F.col("b")))).collect()] == expected.tolist()


def test_one_of_each_component(spark):
    a, b = "one two three four five six seven", "quite another text with other words in it"
    rows = [(3, a, "x"), (5, a, "y"), (None, a, "z"), (5, b, "x"), (5, b, "x"), (None, "some third text nobody else has here", "x"), (None, "some third text nobody else has here", "w"), (7, None, "x"), (8, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.text) for r in simhash.one_of_each(docs).collect()), key=str)
    assert got == sorted([(3, a), (5, b), (None, rows[5][1]), (7, None)], key=str)


def test_water_filling_and_mix(spark, edge, empty, prose):
    sizes = {"a": 100, "b": 1000, "c": 10, "d": 5000, None: 400}
    weights = dict(zip(["a", "b", "c", "d", None], (5, 2, 1, 5, 2)))
    sources = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r for r in mixing.water_fill(mixing.source_weights(sources)).collect()}
    assert {s: r.weight for s, r in got.items()} == weights
    left, target = 1.5 * sum(sizes.values()), {}
    while True:
        level = left / sum(w for s, w in weights.items() if s not in target)
        over = [s for s in sizes if s not in target and level * weights[s] > 2 * sizes[s]]
        if not over:
            break
        target |= {s: 2 * sizes[s] for s in over}
        left = 1.5 * sum(sizes.values()) - sum(target.values())
    target |= {s: level * weights[s] for s in sizes if s not in target}
    assert all(math.isclose(got[s].target, t) for s, t in target.items())

    rows = prose.select("doc_id", "source", mixing.row_order(F.col("doc_id"), F.col("text")).alias("__h"), mixing.word_count(F.col("text")).alias("size"))
    first, again = (mixing.take(x, mixing.mix_plan(x)).toPandas() for x in (rows, rows.repartition(5)))
    assert dict(zip(first.doc_id, first.times)) == dict(zip(again.doc_id, again.times))
    first["taken"] = first["size"] * first.times
    sums = first.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    assert ((sums.taken - sums.target).abs() <= sums.most / 2 + 1).all() and first.times.max() <= 2

    alike = [(1, "one two three", "s")] * 97 + [(2, "four", "s"), (3, None, "s"), (4, "x y", "t")]
    same = spark.createDataFrame(alike, "doc_id long, text string, source string")
    counts = {r.doc_id: r["count"] for r in mixing.mix_documents(same, share=0.5).groupBy("doc_id").count().collect()}
    assert abs(3 * counts[1] + counts.get(2, 0) - (0.5 * 294 - 4)) <= 1.5 and 3 not in counts and counts[4] == 2

    clash = edge.withColumns({c: F.lit("mine") for c in ("__h", "times", "target", "cut", "some", "whole", "__packed")})
    mixed = mixing.mix_documents(clash)
    assert mixed.columns == clash.columns
    assert mixed.where("text IS NULL").count() == 0 and mixed.where("size = 'clash'").count() == mixed.count() > 0
    assert mixing.mix_documents(empty).count() == 0


def unpacked(pieces, rows, tokenizer):
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    expected = defaultdict(Counter)
    for r in rows:
        ids = np.array(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4")
        expected[r[0]][len(ids)] += 1
        for p in by_doc[r[0]]:
            assert p.doc_tokens == len(ids)
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
    for doc, sizes in expected.items():
        (n, copies), = sizes.items()
        held = Counter(i for p in by_doc[doc] for i in range(p.start, p.start + p.length))
        assert held == Counter({i: copies for i in range(n)})
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for s, parts in sequences.items():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end == 1024 or (s == max(sequences) and end < 1024)


def test_packing_round_trip(edge, empty):
    from tokenizers import Tokenizer

    pieces = packing.pack_documents(edge).collect()
    unpacked(pieces, edge_rows(), Tokenizer.from_file(packing.default_tokenizer()))
    assert packing.pack_documents(empty).count() == 0


def test_windows_hold_the_mix(spark):
    rows = [(i, "a" if i % 4 else ("b" if i % 8 else "c"), 37 + i * 13 % 900) for i in range(2000)]
    df = spark.createDataFrame(rows, "row_id long, source string, doc_tokens long")
    got = packing.plan_pieces(df).join(df.select("row_id", "source"), "row_id").toPandas()
    total = sum(r[2] for r in rows)
    share = {s: sum(r[2] for r in rows if r[1] == s) / total for s in "abc"}
    held = got.assign(w=got.sequence_id // 16).pivot_table(index="w", columns="source", values="length", aggfunc="sum").iloc[:-1]
    longest = max(r[2] for r in rows)
    assert all((held[s] - share[s] * packing.WINDOW).abs().max() <= 2 * longest for s in "abc")
    upto = held.cumsum()
    assert all((upto[s] - share[s] * packing.WINDOW * (upto.index + 1)).abs().max() <= 2 * longest for s in "abc")  # deficits don't add up
    assert len(got) <= len(rows) + got.sequence_id.max()
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "source string, weight double")
    even = packing.plan_pieces(df, weights).join(df.select("row_id", "source"), "row_id").toPandas()
    assert even.length.sum() == total
    start = even[even.sequence_id < 16].groupby("source").length.sum()
    assert (start - packing.WINDOW / 3).abs().max() <= 2 * longest


def test_encoder_gives_the_tokenizers_ids():
    encode = packing.Encoder(packing.default_tokenizer())
    odd = ["", " ", "a  b", "x\n\ny", " lead", "trail ", "\n", "\na", "a\n", "a \nb", "a\n b\n \nc", "<|endoftext|> x", "a\tb c", "don't we'll 5²", "漢字 テスト", " x  y", "\r\n q", "'s 't"]
    for text in odd + odd:
        ids = encode.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode([text])[0], encode.type).tolist() == [*ids, 0], text


def test_base_counts_by_definition():
    for r in edge_rows()[:3] + edge_rows()[4:]:
        text = r[1] or ""
        w = words(text)
        windows = Counter(zip(w, w[1:], w[2:]))
        inside = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if words(x)]
        expected = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))
        assert quality_rules.base_counts(r[1].encode() if r[1] is not None else None) == expected


class Brute:
    """Modified Kneser-Ney by definition, over the trigrams of some texts."""

    def __init__(self, texts):
        top = Counter(g for t in texts for g in self.trigrams(t))
        pairs = Counter(g[1:] for g in top)
        self.levels = {3: top, 2: pairs, 1: Counter(g[1:] for g in pairs)}
        self.d, self.after = {}, {}
        for k, level in self.levels.items():
            n1, n2, n3, n4 = (sum(v == j for v in level.values()) for j in (1, 2, 3, 4))
            self.d[k] = [0, 0.5, 1.0, 1.5]
            if n1 and n2 and n3 and n4:
                y = n1 / (n1 + 2 * n2)
                self.d[k] = [0, *(min(max(j - (j + 1) * y * b / a, 0), j) for j, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))]
            self.after[k] = defaultdict(dict)
            for g, v in level.items():
                self.after[k][g[:-1]][g] = v

    @staticmethod
    def trigrams(text):
        points = [1, 1, *(32 if ord(c) < 9 else ord(c) for c in text or ""), 1]
        return [tuple(points[i : i + 3]) for i in range(len(points) - 2)]

    def p(self, g):
        if not g:
            return 1 / (len(self.levels[1]) + 1)
        k, seen = len(g), self.after[len(g)].get(g[:-1])
        if not seen:
            return self.p(g[1:])
        v = seen.get(g, 0)
        free = sum(self.d[k][min(x, 3)] for x in seen.values())
        return (v - self.d[k][min(v, 3)] + free * self.p(g[1:])) / sum(seen.values())

    def bits(self, text, order):
        own = self.trigrams(text)
        return -sum(math.log2(max(self.p(g[3 - order :]), 1e-12)) for g in own) / len(own)


def test_kneser_ney_sums_to_one(spark):
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("abcde. "), 4000))
    counted = ngram_model.count_trigrams(spark.createDataFrame([("x", 0, text.encode())], "__lang string, __half int, __bytes binary"))
    hashes, bits = ngram_model.load(ngram_model.write_model(ngram_model.model_entries(counted))[0])["x", 1]
    assert (np.diff(hashes) > 0).all()
    known = dict(zip(hashes.tolist(), bits.tolist()))
    for a, b in (("a", "b"), (".", "q"), ("q", "q"), (" ", "a")):
        total = 0.0
        for c in [1, *map(ord, "abcde. ")] + [0x10FFFF]:  # the last stands for all that was never seen
            h = ngram_model.hashes(np.array([[ord(a), ord(b), c]], "u4"))[0]
            one, two = h & ngram_model.ONE, h & ngram_model.TWO
            parts = [0, ~0, one, two, ~(h >> 21 & ngram_model.ONE), h, ~(h >> 21)]
            total += 2 ** sum(known.get(int(x), 0) for x in parts)
        assert math.isclose(total, 1, abs_tol=1e-4)


@pytest.mark.parametrize("shard, slice_entries", [(1 << 21, 1 << 16), (40, 8)])
def test_bits_and_verdicts_by_brute_force(spark, edge, shard, slice_entries):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(9000 + i, t, lang) for i, (t, lang) in enumerate([("漢字 and 仮名", "ja"), ("", "ja"), ("zz\x01zz 🙂", "ja"), ("left", ""), ("left", None), (None, None)])], "doc_id long, text string, lang string")
    some = rows.where("doc_id < 12") if shard < 100 else rows
    docs = some.unionByName(odd).unionByName(rows.where("doc_id = 3").withColumn("doc_id", F.lit(9900).cast("long")))
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, ["doc_id"], shard=shard, slice_entries=slice_entries).select("doc_id", "__quality.*").collect()}
    half = F.pmod(F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b""))), F.lit(2))
    want = docs.select("doc_id", "text", "lang", half.alias("half")).collect()
    assert len(got) == len(want)
    models = {key: Brute([r.text for r in want if (r.lang, 1 - r.half) == key]) for key in {(r.lang, r.half) for r in want}}
    bits = {r.doc_id: [models[r.lang, r.half].bits(r.text, k) for k in (1, 2, 3)] for r in want}
    for r in want:
        assert np.allclose([got[r.doc_id][f"bits{k}"] for k in (1, 2, 3)], bits[r.doc_id], rtol=1e-5), r
    for r in want:
        inside = not got[r.doc_id].base_failed
        for k, (below, above) in enumerate(quality_rules.BANDS):
            own = {x.text: bits[x.doc_id][k] for x in want if (x.lang, x.half) == (r.lang, r.half) and not got[x.doc_id].base_failed}
            if inside:
                low, mid, high = (sorted(own.values())[max(0, math.ceil(q * len(own)) - 1)] for q in (0.25, 0.5, 0.75))
                inside &= mid - below * max(high - low, 0.05) <= bits[r.doc_id][k] <= mid + above * max(high - low, 0.05)
        assert got[r.doc_id].kept == inside


def test_quality_rules_keep_prose_and_drop_junk(spark, edge, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = quality_rules.quality_rules(docs, ["doc_id"]).select("doc_id", "__quality.*").join(labels, "doc_id")
    rows = judged.where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    share = {r.quality: r.k for r in rows}
    assert share[1] > 0.95 and share[0] < 0.1
    clash = edge.withColumns({c: F.lit("mine") for c in ("bits", "kept", "n_words", "__lang", "__n", "c0", "base_failed")})
    got = quality_rules.quality_rules(clash, clash.columns)
    assert got.columns == [*clash.columns, "__quality"] and got.where("kept = 'mine' AND c0 = 'mine' AND __lang = 'mine'").count() == len(edge_rows())
    assert got.where("doc_id = 4 AND __quality.kept").count() == 0
    assert quality_rules.quality_rules(empty, ["doc_id"]).count() == 0


@pytest.mark.parametrize("lang", ["fr", "en"])
def test_copies_set_no_quality_band(spark, lang):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    good = docs.join(labels.where("quality = 1"), "doc_id").where((F.col("lang") == lang) & (F.length("text") > 1000)).orderBy("doc_id").limit(1)
    copies = good.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(500)))).withColumn("doc_id", -F.col("n")).select(*docs.columns)
    judged = quality_rules.quality_rules(docs.unionByName(copies), ["doc_id"]).select("doc_id", "__quality.*")
    judged = judged.where("not base_failed").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    share = {r.quality: r.k for r in judged.where(F.col("lang") == lang).groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[1] > 0.95 and share.get(0, 0) < 0.1


def test_no_code_points_share_an_entry():
    text = "".join(map(chr, range(0x4E00, 0x4E00 + 300))) + "0123456789"
    (hashes, which, owner), = ngram_model.grams([text.encode()])
    assert len(np.unique(hashes & ngram_model.ONE)) == 311 and len(which) == len(owner) == 311


def test_texts_are_cut_anywhere(monkeypatch):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcé漢 "), n)).encode() for n in (0, 5, 300, 1, 90)] + [None]
    whole = Counter()
    for h, which, owner in ngram_model.grams(texts):
        whole.update(zip(owner.tolist(), h[which].tolist()))
    for chunk, dense in ((7, 1 << 22), (64, 0)):
        monkeypatch.setattr(ngram_model, "CHUNK", chunk)
        monkeypatch.setattr(ngram_model, "DENSE", dense)
        again = Counter()
        for h, which, owner in ngram_model.grams(texts):
            again.update(zip(owner.tolist(), h[which].tolist()))
        assert again == whole and sum(whole.values()) == sum(len((t or b"").decode()) + 1 for t in texts)


def test_sources_without_a_weight_are_packed_last(spark):
    rows = spark.createDataFrame([(i, "abcd"[i % 4] if i % 5 else None, 10 + i) for i in range(40)], "row_id long, source string, doc_tokens long")
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", None), ("d", 0.0)], "source string, weight double")
    pieces = packing.plan_pieces(rows, weights, sequence=16, window=64).join(rows, "row_id").collect()
    got, last = Counter(), {}
    for r in pieces:
        got[r.row_id] += r.length
        last.setdefault(r.source in ("a", "b"), []).append(r.sequence_id * 16 + r.offset)
    assert got == {i: 10 + i for i in range(40)} and max(last[True]) < min(last[False])


def segmentations(word, p):
    if not word:
        return 1.0
    return sum(p.get(word[:n], 0.0) * segmentations(word[n:], p) for n in range(1, len(word) + 1))


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "aba", "▁ab"]
    lattice = language_id.Lattice(pieces)
    p = np.column_stack([np.linspace(0.05, 0.2, 9), np.linspace(0.2, 0.05, 9)])
    p[lattice.unknown] = language_id.UNKNOWN
    got = lattice.log_probabilities(["abab", "a", "bbabaab"], p)
    for i, word in enumerate(["abab", "a", "bbabaab"]):
        for k in range(2):
            assert math.isclose(got[i, k], math.log(segmentations("▁" + word, dict(zip(pieces, p[:, k])))), rel_tol=1e-6)


def all_segmentations(word, pieces):
    if not word:
        return [[]]
    return [[word[:n], *rest] for n in range(1, len(word) + 1) if word[:n] in pieces for rest in all_segmentations(word[n:], pieces)]


def test_fit_by_enumeration():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "aba", "▁ab"]
    lattice, counts = language_id.Lattice(pieces), {"abab": 3.0, "ba": 2.0, "aab": 5.0}
    got = lattice.fit(list(counts), np.array([[v] for v in counts.values()]), rounds=2)[:, 0]
    p = dict.fromkeys(pieces, 1 / 9)
    for _ in range(2):
        used = Counter()
        for word, n in counts.items():
            ways = {tuple(x): math.prod(p[y] for y in x) for x in all_segmentations("▁" + word, p)}
            for way, weight in ways.items():
                used.update({y: 0 for y in way})
                for y in way:
                    used[y] += n * weight / sum(ways.values())
        p = {x: max(used[x] / sum(used.values()), language_id.LEAST) for x in pieces}
    assert np.allclose(got[:-1], [p[x] for x in pieces], rtol=1e-9)


def test_words_of_any_length_and_script():
    assert language_id.words_of("½² Ⅷ 12 _") == [] and language_id.words_of("x² Été-a_b") == ["x", "été", "a", "b"]
    assert language_id.words_of("हिन्दी भाषा") == ["हिन्दी", "भाषा"]
    pieces = ["▁", "a", "b", "ab", "ba", "aba"]
    lattice = language_id.Lattice(pieces)
    p = np.array([[0.1, 0.3], [0.2, 0.01], [0.1, 0.2], [0.3, 0.1], [0.2, 0.2], [0.1, 0.19], [language_id.UNKNOWN] * 2])
    rng = np.random.default_rng(1)
    words_ = ["".join(rng.choice(list("abq"), n)) for n in (3000, 700, 90, 2)]
    got = lattice.log_probabilities(words_, p)
    for i, word in enumerate(words_):
        for k in range(2):
            known, logs = dict(zip(pieces, np.log(p[:, k]))), [0.0]
            text = "▁" + word
            for e in range(1, len(text) + 1):
                ways = [logs[s] + (known[text[s:e]] if text[s:e] in known else math.log(language_id.UNKNOWN)) for s in range(max(0, e - 3), e) if text[s:e] in known or (e - s == 1)]
                logs.append(max(ways) + math.log(sum(math.exp(w - max(ways)) for w in ways)))
            assert math.isclose(got[i, k], logs[-1], rel_tol=1e-9)


def test_languages_are_told_apart(prose, edge, empty):
    path = language_id.default_vocabulary()
    learned = prose.where(~language_id.held_out("doc_id")).select(F.col("doc_id").alias("id"), "text", "lang")
    languages, p = language_id.fit_languages(learned, path, fit_docs=30)
    held = language_id.identify(prose.where(language_id.held_out("doc_id")), languages, p, ["doc_id", "lang"], "text", path).toPandas()
    assert (held.lang == held.lang_pred).mean() > 0.95 and held.score.between(0, 1).all()
    odd = {r.doc_id: r for r in language_id.identify(edge, languages, p, ["doc_id"], "text", path).collect()}
    assert odd[1].lang_pred == odd[2].lang_pred == odd[3].lang_pred == "und" and odd[4].lang_pred in languages
    assert language_id.identify(empty, languages, p, ["doc_id"], "text", path).count() == 0
    few = language_id.fit_languages(learned, path, fit_docs=30)
    assert few[0] == languages and (few[1] == p).all()
    none, nothing = language_id.fit_languages(learned.where("false"), path)
    assert none == [] and language_id.identify(edge, none, nothing, ["doc_id"], "text", path).where("lang_pred <> 'und'").count() == 0


def brute_marginal(scores, moves):
    n, total, good = len(scores), 0.0, np.zeros(len(scores))
    for labels in np.ndindex(*[2] * n):
        w = math.exp(sum(scores[i, y] for i, y in enumerate(labels)) + sum(moves[a, b] for a, b in zip(labels, labels[1:])))
        total += w
        good += w * np.array(labels)
    return good / total


def test_marginals_by_enumeration():
    rng = np.random.default_rng(2)
    counts = np.array([3, 1, 5])
    scores, moves = rng.normal(size=(9, 2)), rng.normal(size=(2, 2))
    good, pairs = line_crf.marginals(scores, counts, moves)
    assert pairs.shape == (6, 2, 2) and np.allclose(pairs.sum(axis=(1, 2)), 1)
    assert (line_crf.marginals(scores, counts, moves, False)[0] == good).all()
    parts = np.split(np.arange(9), np.cumsum(counts)[:-1])
    assert np.allclose(good, np.concatenate([brute_marginal(scores[i], moves) for i in parts]))


def test_lines_in_blocks_of_any_size(monkeypatch):
    texts = [b"", b"One line here\n\nANOTHER! ### 12", b"x\n" * 40, "é à\nlong ".encode() * 9, b"a"]
    lines, counts = line_crf.split_lines(texts)
    (_, whole), = line_crf.line_features(lines, counts)
    own = line_crf.own_features(lines)
    at = np.cumsum(counts) - counts
    for i in range(len(lines)):
        before, after = i not in at, i + 1 < len(lines) and i + 1 not in at
        expected = [own[i], own[i - 1] if before else own[i] * 0, own[i + 1] if after else own[i] * 0, [not before, not after, 1]]
        assert np.allclose(whole[i], np.concatenate(expected))
    for size in (1, 2, 7, len(lines)):
        monkeypatch.setattr(line_crf, "LINES", size)
        assert np.array_equal(np.concatenate([f for _, f in line_crf.line_features(lines, counts)]), whole)


def test_a_text_of_very_many_lines_is_scored_whole():
    rng = np.random.default_rng(5)
    field = line_crf.LineField(rng.normal(size=line_crf.FEATURES) / 9, rng.normal(size=(2, 2)), 3.0, -1.0)
    some = ["a quiet line", "### !!! |", "", "UPPER 12 12 12"]
    short = "\n".join(some[i % 4] for i in range(4000)).encode()
    many = "\n".join(some[i % 4] for i in range(100_000)).encode()
    a, b = field.score([short, many])
    assert math.isclose(a, b, rel_tol=1e-3) and 0 < a < 1


def test_line_field_on_held_out_labels(spark, edge, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    field = line_crf.learn(docs, labels, fit_docs=600)
    held = labels.where(language_id.held_out("doc_id"))
    got = line_crf.classify(docs.join(held, "doc_id"), field, ["doc_id", "quality"], "text").toPandas()
    assert ((got.score >= 0.7).astype(int) == got.quality).mean() > 0.97
    odd = line_crf.classify(edge, field, ["doc_id"], "text").collect()
    assert len(odd) == len(edge_rows()) and all(0 <= r.score <= 1 for r in odd)
    assert line_crf.classify(empty, field, ["doc_id"], "text").count() == 0
    blank = line_crf.learn(docs, labels.where("false"))
    assert {r.score for r in line_crf.classify(edge, blank, ["doc_id"], "text").collect()} == {0.5}


def test_kept_text_hash(edge):
    row = line_dedup.dedup_lines(edge).where("doc_id = 6").select(F.sha2("__lines.kept", 256)).first()
    assert row[0] == hashlib.sha256(b"x\n").hexdigest()


def test_words_of_a_fit_are_the_most_frequent(spark, monkeypatch):
    rows = [(i, f"common w{i} " + "b b a a c ", lang) for i, lang in enumerate(["x", "x", "y", "y", "y"])]
    docs = spark.createDataFrame(rows, "id long, text string, lang string")
    seen = {}
    monkeypatch.setattr(language_id.Lattice, "fit", lambda self, words, counts, rounds=3: seen.update(zip(words, counts.tolist())))
    monkeypatch.setattr(language_id, "FIT_WORDS", 3)
    language_id.fit_languages(docs, language_id.default_vocabulary())
    assert seen == {"a": [4.0, 6.0], "b": [4.0, 6.0], "c": [2.0, 3.0]}
    seen.clear()
    monkeypatch.setattr(language_id, "FIT_PAIRS", 8)
    language_id.fit_languages(docs, language_id.default_vocabulary())
    assert seen == {"a": [4.0, 6.0], "b": [4.0, 6.0]}


def test_windows_hold_the_target_mixture(spark):
    rows = spark.range(3000).selectExpr("id AS row_id", "IF(id % 10 = 0, 'a', IF(id % 10 = 1, 'b', 'c')) AS source", "CAST(5 + id % 7 AS LONG) AS doc_tokens")
    weights = spark.createDataFrame([("a", 5.0), ("b", 2.0), ("c", 1.0)], "source string, weight double")
    pieces = packing.plan_pieces(rows, weights, sequence=64, window=512).join(rows, "row_id").collect()
    held = {}
    for p in pieces:
        held.setdefault(p.sequence_id // 8, {}).setdefault(p.source, []).append(p.length)
    for w in range(4):  # all sources still have documents
        sums = {s: sum(n) for s, n in held[w].items()}
        assert all(abs(sums[s] - 512 * share / 8) <= 24 for s, share in (("a", 5), ("b", 2), ("c", 1)))


def test_languages_in_passes_score_as_in_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.unionByName(docs.limit(1).selectExpr("doc_id", "'' AS text", "source", "'none' AS lang", "n_chars"), allowMissingColumns=True).select("doc_id", "text", "lang")
    one, many = (sorted(map(repr, quality_rules.quality_rules(docs, ["doc_id"], shard=s, slice_entries=400).collect())) for s in (1 << 30, 3000))
    assert len(one) == docs.count() and one == many
