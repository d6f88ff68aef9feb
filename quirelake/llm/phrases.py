"""Phrase collocation mining: an FM-index over word ids for each shard, n-gram counts summed over the shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.llm.common import discard, let_go, partitions, table, written
from quirelake.llm.fm_index import FmIndex

LONGEST, LEAST, MOST = 5, 100, 2000
#: A shard is closed once it holds so many words (and is never cut inside a piece).
SHARD_WORDS = 3 << 19
#: Parts in which a language's phrases are ranked before the best of each are ranked together.
RANK_PARTS = 64

#: Bytes as they are read: A-Z lower-cased, [.,;:!?\\x0A-\\x0D] a line feed, tabs blanks.
_READ = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


class _Ids(dict):
    """Word to id, new words numbered as they come; 0 is the end of a piece, -1 nothing."""

    def __init__(self, taken: list):
        super().__init__({b"\n": 0, b"": -1})
        self.taken = taken

    def __missing__(self, word: bytes) -> int:
        self.taken.append((self, word))
        self[word] = len(self.taken)
        return len(self.taken)


class _Shard:
    def __init__(self):
        self.taken: list[tuple[_Ids, bytes]] = []
        self.by_lang: dict[str, _Ids] = {}
        self.parts: list[np.ndarray] = []
        self.words = 0

    def add(self, lang: str, pieces: bytes) -> None:
        ids = self.by_lang.setdefault(lang, _Ids(self.taken))
        tokens = pieces.replace(b"\n", b" \n ").split(b" ")
        coded = np.fromiter(map(ids.__getitem__, tokens), np.int32, len(tokens))
        self.parts.append(np.append(coded[coded >= 0], np.int32(0)))
        self.words += len(self.parts[-1])

    def row(self, shard: int) -> dict:
        names = {id(ids): lang for lang, ids in self.by_lang.items()}
        text = np.concatenate(self.parts)
        text = _closed_up(text)
        counts = np.bincount(text, minlength=len(self.taken) + 1)[1:]
        vocabulary = [{"lang": names[id(ids)], "word": word.decode(), "n": n} for (ids, word), n in zip(self.taken, counts.tolist())]
        return {"shard": shard, "seq": _pack(text.astype(np.int32)), "vocabulary": vocabulary}


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _unpack(packed: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), kind)


def _blocks(text: bytes, size: int = 1 << 22) -> Iterator[bytes]:
    """The text in blocks that end where pieces do."""
    at = 0
    while at < len(text):
        end = text.find(b"\n", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def _shards(docs: DataFrame, text_col: str, lang_col: str, shard_words: int) -> DataFrame:
    """(shard, seq, vocabulary): a row a shard, each of the texts that a task reads one after another."""
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und"))
    rows = docs.select(lang.alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    schema = "shard long, seq binary, vocabulary array<struct<lang:string,word:string,n:bigint>>"
    arrow = pa.schema([("shard", pa.int64()), ("seq", pa.binary()), ("vocabulary", pa.list_(pa.struct([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])))])

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        let_go()
        number, held = TaskContext.get().partitionId() << 12, _Shard()
        for part in parts:
            for of, text in zip(part.column(0).to_pylist(), part.column(1)):
                for block in _blocks(text.as_py().translate(_READ)):
                    held.add(of, block)
                    if held.words >= shard_words:
                        yield pa.RecordBatch.from_pylist([held.row(number)], schema=arrow)
                        number, held = number + 1, _Shard()
        if held.words:
            yield pa.RecordBatch.from_pylist([held.row(number)], schema=arrow)

    return written(rows.mapInArrow(read, schema), "phrase-shards")


def _frequent(rows: DataFrame, key: list[str], least: int) -> DataFrame:
    """Rows (key, shard, n, ...) of keys whose n over all shards add up to `least`, with that `total`.

    A key has one row a shard at most, so no window is larger than the number of shards.
    """
    return rows.withColumn("total", F.sum("n").over(Window.partitionBy(*key))).where(F.col("total") >= least)


def _shuffled(seq: np.ndarray, words: list[np.ndarray], n: np.ndarray, shard: int, buckets: int) -> pa.Table:
    """A shard's text (bucket null) and its n-grams with their counts in pieces by a hash of their words, all packed."""
    mixed = np.zeros(len(n), np.uint64)
    for w in words:
        mixed = (mixed ^ w.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    bucket = (mixed % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    heads = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    pieces = [[_pack(part) for part in np.split(v.astype(np.int64)[order], heads[1:])] if len(heads) else [] for v in (*words, n)]
    columns = {"shard": pa.array([shard] * (len(heads) + 1), pa.int64()), "bucket": pa.array([None, *bucket[order][heads].tolist()], pa.int32())}
    columns["seq"] = pa.array([_pack(seq.astype(np.int64)), *[None] * len(heads)], pa.binary())
    names = [f"w{i + 1}" for i in range(len(words))] + ["n"]
    return pa.table(columns | {c: pa.array([None, *v], pa.binary()) for c, v in zip(names, pieces)})


def _columns(size: int) -> dict[str, pa.DataType]:
    return {"shard": pa.int64(), "bucket": pa.int32(), "seq": pa.binary(), **{f"w{i + 1}": pa.binary() for i in range(size)}, "n": pa.binary()}


def _ddl(columns: dict[str, pa.DataType]) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"{c} {kinds[t]}" for c, t in columns.items())


def _none(columns: dict[str, pa.DataType]) -> pa.Table:
    return pa.table({c: pa.array([], t) for c, t in columns.items()})


def _joined(column: pa.ChunkedArray) -> np.ndarray:
    """What packed values hold, one after the other."""
    return np.concatenate([np.zeros(0, np.int64), *(_unpack(v, np.int64) for v in column.to_pylist())])


def _buckets(rows: DataFrame) -> int:
    """A bucket is what one step of one task sums up; some for each partition."""
    return 8 * partitions(rows.sparkSession)


def _closed_up(text: np.ndarray) -> np.ndarray:
    """The text with one 0 where several follow each other."""
    return text[(text > 0) | (np.append(1, text[:-1]) > 0)]


def _count_pairs(shards: DataFrame, words: DataFrame) -> DataFrame:
    """_shuffled() rows: each shard's text in global ids without rare words, and its pairs."""
    columns, buckets = _columns(2), _buckets(shards)

    def count(key: tuple, shard: pa.Table, known: pa.Table) -> pa.Table:
        if not shard.num_rows or not known.num_rows:
            return _none(columns)
        text = _unpack(shard.column("seq")[0].as_py(), np.int32)
        local, ids = known.column("local").to_numpy(), known.column("id").to_numpy()
        # frequent words are numbered anew in the order of their local ids, all others are 0
        anew = np.zeros(int(max(text.max(initial=0), local.max())) + 1, np.int32)
        anew[np.sort(local)] = np.arange(1, len(local) + 1)
        kept, names = _closed_up(anew[text]), np.append(0, ids[np.argsort(local)])
        (pairs,) = FmIndex(kept, 2).grams(2, 2)
        return _shuffled(names[kept], [names[pairs.words[:, 0]], names[pairs.words[:, 1]]], pairs.count, key[0].as_py(), buckets)

    return written(shards.groupBy("shard").cogroup(words.groupBy("shard")).applyInArrow(count, _ddl(columns)), "phrase-pairs")


def _often(grams: DataFrame, size: int, least: int, by_shard: bool) -> DataFrame:
    """(shard, w1, ..., n), packed: the n-grams whose counts over all shards add up to `least`, with their sums (shard null) and, if asked, for each shard its own."""
    names = [f"w{i + 1}" for i in range(size)]
    columns = {"shard": pa.int64(), **{c: pa.binary() for c in [*names, "n"]}}

    def total(key: tuple, pieces: pa.Table) -> pa.Table:
        words, n = [_joined(pieces.column(c)) for c in names], _joined(pieces.column("n"))
        sizes = [len(_unpack(v, np.int64)) for v in pieces.column("n").to_pylist()]
        shard = np.repeat(pieces.column("shard").to_numpy(), sizes)
        order = np.lexsort(words[::-1])
        words, n, shard = [w[order] for w in words], n[order], shard[order]
        heads = np.flatnonzero(np.any([np.diff(w, prepend=-1) != 0 for w in words], axis=0))
        sums = np.add.reduceat(n, heads)
        frequent = sums >= least
        out = [(None, [w[heads[frequent]] for w in words], sums[frequent])]
        if by_shard and frequent.any():
            mine = np.repeat(frequent, np.diff(np.append(heads, len(n))))
            order = np.argsort(shard[mine], kind="stable")
            cuts = np.flatnonzero(np.diff(shard[mine][order])) + 1
            parts = zip(np.split(shard[mine][order], cuts), zip(*[np.split(w[mine][order], cuts) for w in words]))
            out += [(int(of[0]), list(w), np.zeros(0)) for of, w in parts]
        return pa.table({"shard": pa.array([of for of, _, _ in out], pa.int64()), **{c: pa.array([_pack(w[i]) for _, w, _ in out], pa.binary()) for i, c in enumerate(names)}, "n": pa.array([_pack(v.astype(np.int64)) for _, _, v in out], pa.binary())})

    return written(grams.where("bucket IS NOT NULL").select("bucket", "shard", *names, "n").groupBy("bucket").applyInArrow(total, _ddl(columns)), f"phrase-often-{size}")


def _chains(text: np.ndarray, frequent: np.ndarray, size: int) -> np.ndarray:
    """The stretches of a text all of whose n-grams of `size` words are frequent, those of `size` + 1 words and more; 0 ends each.

    `frequent` tells it of the n-gram from each place. Stretches may share the words at their ends.
    """
    edges = np.diff(np.concatenate([[0], frequent.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    first, last = first[last - first > 1], last[last - first > 1]
    sizes = last - first + size  # words and the 0
    begin = np.cumsum(sizes) - sizes
    places = np.arange(int(sizes.sum())) + np.repeat(first - begin, sizes)
    out = np.append(text, 0)[np.minimum(places, len(text))]
    out[begin + sizes - 1] = 0
    return out


def _extended(shards: DataFrame, often: DataFrame, size: int, longest: int) -> DataFrame:
    """The shards' n-grams of more than `size` and up to `longest` words all of whose parts of `size` words are among their `often`.

    _shuffled() rows, `seq` being what is left of the text; words that a gram doesn't have are 0.
    """
    given, columns, buckets = [f"w{i + 1}" for i in range(size)], _columns(longest), _buckets(shards)

    def count(key: tuple, shard: pa.Table, known: pa.Table) -> pa.Table:
        if not shard.num_rows or not known.num_rows:
            return _none(columns)
        words, text = np.unique(np.append(_unpack(shard.column("seq")[0].as_py(), np.int64), 0), return_inverse=True)  # 0 is the least
        here = max(len(text) - size, 0)
        # grams by number: of those of one word the word's, of longer ones that of (all but the last, the last) among all pairs of numbers
        mine, theirs = text[:here], np.searchsorted(words, _joined(known.column("w1")))
        for i in range(1, size):
            more = np.searchsorted(words, _joined(known.column(f"w{i + 1}")))
            both = np.concatenate([mine * len(words) + text[i : here + i], theirs * len(words) + more])
            both = np.unique(both, return_inverse=True)[1]
            mine, theirs = both[:here], both[here:]
        listed = np.zeros(int(max(mine.max(initial=0), theirs.max(initial=0))) + 1, bool)
        listed[theirs] = True
        left = _chains(text, listed[mine], size)
        grams = list(FmIndex(left, longest).grams(size + 1, longest))
        full = np.zeros((sum(len(g.count) for g in grams), longest), np.int64)
        at = 0
        for g in grams:
            full[at : at + len(g.count), : g.words.shape[1]] = words[g.words]
            at += len(g.count)
        return _shuffled(words[left], list(full.T), np.concatenate([g.count for g in grams]), key[0].as_py(), buckets)

    texts, known = shards.where("bucket IS NULL").select("shard", "seq"), often.where("shard IS NOT NULL").select("shard", *given)
    return written(texts.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(count, _ddl(columns)), "phrase-grams")


def _summed(often: DataFrame, size: int) -> DataFrame:
    """(gram, a): the frequent n-grams, as arrays of ids, and their counts, a row each."""
    names = [f"w{i + 1}" for i in range(size)]

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for packed in zip(*(part.column(i).to_pylist() for i in range(size + 1))):
                *words, n = (_unpack(x, np.int64) for x in packed)
                yield pa.RecordBatch.from_arrays([*(pa.array(w) for w in words), pa.array(n)], names=[*names, "a"])

    plain = often.where("shard IS NULL").select(*names, "n").mapInArrow(rows, ", ".join(f"{c} long" for c in [*names, "a"]))
    return plain.select(F.filter(F.array(*names), lambda w: w > 0).alias("gram"), "a")


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, words, a, left, right) for phrases of 1 to `longest` words found `least` times or more, and (lang, n).

    A text without A-Z in capitals is split at [.,;:!?] and line ends into pieces and these at blanks and tabs into words; a
    null text is empty, a null language `und`. `a` counts all occurrences within pieces; `left` and `right` are the largest
    count of a phrase that is one word longer on that side (0: none that is frequent). n counts all words of a language.

    Each task indexes the texts it reads in shards. Words are summed over the shards first, then pairs of frequent words,
    triples of frequent pairs, and longer phrases of frequent triples (no phrase is more frequent than its parts, so none
    is lost); shards send each n-gram once, with its count, and get back their own frequent ones. Texts are read once.
    """
    shards = _shards(docs, text_col, lang_col, shard_words)
    words = shards.select("shard", F.posexplode("vocabulary").alias("at", "v")).select("shard", (F.col("at") + 1).cast("long").alias("local"), "v.lang", "v.word", "v.n")
    totals = written(words.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    # the place of a word in the first shard that has it is its global id
    place = F.col("shard") * F.lit(1 << 31) + F.col("local")
    frequent = _frequent(words, ["lang", "word"], least).withColumn("id", F.min(place).over(Window.partitionBy("lang", "word")))
    known = written(frequent.select("shard", "local", "id", "total", F.when(F.col("id") == place, F.struct("lang", "word")).alias("named")), "phrase-words")
    names_of = written(known.where("named IS NOT NULL").select("id", "named.*", "total"), "phrase-names")
    pairs = _count_pairs(shards.select("shard", "seq"), known.select("shard", "local", "id"))
    discard(shards, known)
    found = [names_of.select(F.array("word").alias("words"), "lang", F.col("total").alias("a"))]
    held, often = pairs, None
    for size in range(2, min(longest, 4) + 1):
        length = size if size < 4 else longest  # from triples on, all longer phrases at once
        if size > 2:
            before, held = held, _extended(held, often, size - 1, length)
            discard(before, often)
        often = _often(held, length, least, by_shard=length < longest)
        found.append(_spelled(_summed(often, length), names_of))
    phrases = found[0].select("lang", "words", "a")
    for more in found[1:]:
        phrases = phrases.unionByName(more)
    phrases = written(phrases, "phrases")
    discard(held, names_of, *([often] if often is not None else []))
    return _with_sides(phrases), totals


def _spelled(grams: DataFrame, names: DataFrame) -> DataFrame:
    """(lang, words, a) of (gram, a) rows: ids by what they stand for."""
    met = grams.select("gram", "a", F.posexplode("gram").alias("at", "id")).join(names.drop("total"), "id")
    spelled = F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"])
    many = met.groupBy("gram").agg(F.max("a").alias("a"), F.max("lang").alias("lang"), spelled.alias("words"))
    return written(many.select("lang", "words", "a"), "phrase-spelled")


def _with_sides(phrases: DataFrame) -> DataFrame:
    size = F.size("words")
    longer = phrases.where(size > 1)
    right = longer.groupBy("lang", F.slice("words", F.lit(1), size - 1).alias("words")).agg(F.max("a").alias("right"))
    left = longer.groupBy("lang", F.slice("words", F.lit(2), size - 1).alias("words")).agg(F.max("a").alias("left"))
    met = phrases.join(left, ["lang", "words"], "left").join(right, ["lang", "words"], "left")
    return met.select("lang", "words", "a", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("left", "right")])


def collocations(counts: DataFrame, totals: DataFrame, longest: int = LONGEST, most: int = MOST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `most` best phrases of 2 words and more.

    The score is that of the phrase's weakest cut in two parts, floor(1000 a n / (l r)); of equal ones the first cut counts.
    A phrase that a longer one of equal count holds is left out: then one that is one word longer has that count too, so
    its sides tell. Products are decimals of 38 digits. Equal scores go by a, then by the phrase's bytes.
    """
    known = written(counts, "phrase-counts")
    long = known.where((F.size("words") > 1) & (F.greatest("left", "right") < F.col("a")))
    parts = known.select(F.col("lang").alias("__lang"), F.col("words").alias("__words"), F.col("a").alias("__n"))
    cuts = long.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.slice("words", F.lit(1), F.col("k")), "rest": F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))})
    for side, name in (("first", "l"), ("rest", "r")):
        met = cuts.join(parts, (F.col("lang") == F.col("__lang")) & (F.col(side) == F.col("__words")))
        cuts = met.withColumn(name, F.col("__n")).drop("__lang", "__words", "__n", side)
    exact = "CAST(1000 * CAST(a AS DECIMAL(18,0)) AS DECIMAL(20,0)) * CAST(n AS DECIMAL(17,0)) div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))"
    weakest = cuts.join(totals, "lang").withColumn("score", F.expr(exact)).groupBy("lang", "words").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("c")).select("lang", F.array_join("words", " ").alias("phrase"), "c.*")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    best = weakest.withColumn("__part", part).withColumn("__rank", F.row_number().over(Window.partitionBy("lang", "__part").orderBy(*order))).where(F.col("__rank") <= most)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(*phrase_counts(table(spark, sf_dir, "documents").select("text", "lang")))


_GRAMS = " UNION ALL ".join(f"SELECT lang, array_to_string(w[p:p + {k - 1}], ' ') AS phrase, {k} AS k FROM pieces, unnest(generate_series(1, len(w) - {k - 1})) AS u(p)" for k in range(1, LONGEST + 1))

OP11_SQL = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
cut AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
pieces AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM cut),
n AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
f AS (SELECT lang, phrase, k, count(*) AS a FROM ({_GRAMS}) GROUP BY ALL HAVING count(*) >= {LEAST}),
p AS (SELECT *, string_split(phrase, ' ') AS w FROM f),
held AS (SELECT DISTINCT s.lang, s.phrase FROM p s JOIN p b ON s.lang = b.lang AND b.k > s.k AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * b.a >= 100 * s.a),
cuts AS (SELECT p.lang, p.phrase, p.a, x.a AS l, y.a AS r, n.n, c AS k, ((1000 * p.a::HUGEINT * n.n::HUGEINT) // (x.a::HUGEINT * y.a::HUGEINT))::BIGINT AS score
         FROM p, unnest(generate_series(1, k - 1)) AS u(c) JOIN f x ON x.lang = p.lang AND x.phrase = array_to_string(p.w[1:c], ' ') JOIN f y ON y.lang = p.lang AND y.phrase = array_to_string(p.w[c + 1:], ' ') JOIN n ON n.lang = p.lang),
best AS (SELECT * FROM cuts WHERE (lang, phrase) NOT IN (SELECT (lang, phrase) FROM held) QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score FROM best
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {MOST}
"""
