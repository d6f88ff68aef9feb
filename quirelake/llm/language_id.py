"""Language identification by unigram pieces: a word's probability is summed over all its segmentations."""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.llm.common import map_texts, table, worker_cache, written

#: Documents of each language, the first by the hash of their ids, that the piece probabilities are fitted on.
FIT_DOCS = 400
FIT_ROUNDS = 3
#: What a character counts that no piece of the vocabulary covers, and what each piece has at least.
UNKNOWN, LEAST = 1e-9, 1e-8
#: Letters of a piece of a longer word that the fit sees; scoring takes words as they are.
FIT_LETTERS = 100
#: Words of a language that the fit takes, the most frequent of those documents, and word and language pairs in all.
FIT_WORDS, FIT_PAIRS = 50_000, 40_000_000
#: Sums are brought back to about 1 after so many letters, which keeps those of any word within a double's range.
RESCALE = 8
#: Letters of the words that a worker remembers; beyond that it begins anew.
REMEMBERED = 6_000_000
#: Words, and letters of the longest times words, whose segmentations are laid out at a time.
GROUP, CELLS = 4000, 120_000
START = "▁"


#: Up to U+02FF \w takes letters, digits, _ and these numerals, and there are no marks: there it finds words, if it meets none of
#: these and nothing from further on.
_WORDS, _ODD = re.compile(r"[^\W\d_]+"), re.compile("[²³¹¼½¾\u0300-\U0010ffff]")


def words_of(text: str) -> list[str]:
    """The lower-cased words: a letter (category L) and the letters and marks (M) that follow it."""
    text = text.lower()
    if _ODD.search(text) is None:
        return _WORDS.findall(text)
    import regex

    return regex.findall(r"\p{L}[\p{L}\p{M}]*", text)


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model that text can hold, in order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def runs(lengths: list[int]) -> list[tuple[int, int]]:
    """Runs of words of rising lengths that are laid out together."""
    out, first = [], 0
    for i, n in enumerate(lengths):
        if i > first and (i - first == GROUP or (i - first + 1) * (n + 2) > CELLS):
            out.append((first, i))
            first = i
    return out + [(first, len(lengths))] if lengths else out


class Lattice:
    """The segmentations of words into pieces, as edges (word, start, end, piece); words start with START."""

    def __init__(self, pieces: list[str]):
        self.number = {p: i for i, p in enumerate(pieces)}
        self.prefixes = {p[:n]: -1 for p in pieces for n in range(1, len(p))} | self.number
        self.unknown = len(pieces)
        self.reach = max(map(len, pieces), default=1)

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Edges by end and word, and the words' lengths."""
        get, out, add = self.prefixes.get, [], None
        add = out.append
        unknown = self.unknown
        for w, word in enumerate(words):
            text = START + word
            n = len(text)
            for s in range(n):
                e = s + 1
                piece = get(text[s:e])
                if piece is None or piece < 0:
                    add((w, s, e, unknown))
                while piece is not None:
                    if piece >= 0:
                        add((w, s, e, piece))
                    e += 1
                    if e > n:
                        break
                    piece = get(text[s:e])
        edges = np.array(out, np.int32).reshape(-1, 4)
        edges = edges[np.lexsort((edges[:, 0], edges[:, 2]))]
        return edges, np.array([len(w) + 1 for w in words])

    @staticmethod
    def forward(edges: np.ndarray, lengths: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over all segmentations of each prefix, [word, characters, language], and logarithms to add to them.

        p: [piece, language]. Every RESCALE characters a word's sums so far are divided by the newest one; the logarithm
        of what they were divided by holds for the word's later prefixes, its whole among them.
        """
        sums = np.zeros((len(lengths), int(lengths.max(initial=0)) + 1, p.shape[1]))
        logs = np.zeros((len(lengths), p.shape[1]))
        sums[:, 0] = 1
        reach = int((edges[:, 2] - edges[:, 1]).max(initial=1))
        bounds = np.searchsorted(edges[:, 2], np.arange(sums.shape[1] + 1))
        for end in range(1, sums.shape[1]):
            w, s, _, piece = edges[bounds[end] : bounds[end + 1]].T
            if len(w):
                first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                sums[w[first], end] = np.add.reduceat(sums[w, s] * p[piece], first)
                if end % RESCALE == 0:
                    on = w[first]
                    by = sums[on, end]
                    sums[on, max(0, end - reach) : end + 1] /= by[:, None]
                    logs[on] += np.log(by)
        return sums, logs

    def log_probabilities(self, words: list[str], p: np.ndarray) -> np.ndarray:
        if not words:
            return np.zeros((0, p.shape[1]))
        edges, lengths = self.edges(words)
        sums, logs = self.forward(edges, lengths, p)
        return np.log(sums[np.arange(len(words)), lengths]) + logs

    def _expected(self, edges: np.ndarray, lengths: np.ndarray, counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """How often each piece is used in words that come up `counts` times, by forward sums and the shares of edges.

        Going back from a word's end, what a prefix is used is divided among the edges that reach it by their parts of its sum.
        """
        own, last = np.zeros((len(edges), p.shape[1])), int(lengths.max(initial=0))
        sums = np.zeros((len(lengths), last + 1, p.shape[1]))
        sums[:, 0] = 1
        bounds = np.searchsorted(edges[:, 2], np.arange(last + 2))
        for end in range(1, last + 1):
            w, s, _, piece = edges[bounds[end] : bounds[end + 1]].T
            if len(w):
                first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                parts = sums[w, s] * p[piece]
                whole = np.add.reduceat(parts, first)
                own[bounds[end] : bounds[end + 1]] = parts / np.repeat(whole, np.diff(np.r_[first, len(w)]), axis=0)
                # the newest sum counts as 1 for shares; the earlier ones that a piece can still reach go down with it
                low = max(0, end - self.reach)
                sums[w[first], low:end] /= whole[:, None]
                sums[w[first], end] = 1
        used = np.zeros((len(lengths), last + 1, p.shape[1]))
        used[np.arange(len(lengths)), lengths] = counts
        for end in range(last, 0, -1):
            at = slice(bounds[end], bounds[end + 1])
            w, s, _, _ = edges[at].T
            if len(w):
                own[at] *= used[w, end]
                np.add.at(used, (w, s), own[at])
        piece = edges[:, 3]
        return np.stack([np.bincount(piece, own[:, k], len(p)) for k in range(p.shape[1])], axis=1)

    def fit(self, words: list[str], counts: np.ndarray, rounds: int = FIT_ROUNDS) -> np.ndarray:
        """Piece probabilities by expectation maximisation; counts: [word, language]. Every piece keeps LEAST.

        Words go through by length, some thousand at a time, so memory stays that of one such group.
        """
        n = self.unknown + 1
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        groups = [order[a:b] for a, b in runs([len(words[i]) for i in order])]
        p = np.full((n, counts.shape[1]), 1.0 / n)
        for _ in range(rounds):
            expected = np.zeros_like(p)
            for group in groups:
                expected += self._expected(*self.edges([words[i] for i in group]), counts[group], p)
            expected[self.unknown] = 0
            p = np.maximum(expected / np.maximum(expected.sum(axis=0), 1e-300), LEAST)
            p[self.unknown] = UNKNOWN
        return p


class Identifier:
    """Log probabilities of texts by language. The words that come up again are remembered, up to a limit."""

    def __init__(self, vocabulary_path: str, p: np.ndarray):
        self.lattice, self.p = Lattice(vocabulary(vocabulary_path)), p
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.table, self.held = np.zeros((1024, self.p.shape[1])), 0

    def learn(self, words: list[str]) -> None:
        words.sort(key=len)
        for a, b in runs([len(w) for w in words]):
            part, n = words[a:b], len(self.known)
            logs = self.lattice.log_probabilities(part, self.p)
            while len(self.table) < n + len(part):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[n : n + len(part)] = logs
            self.known.update(zip(part, range(n, n + len(part))))
            self.held += sum(map(len, part))

    def __call__(self, texts: list[str]) -> np.ndarray:
        """[text, language]; texts without a letter have nan."""
        out = np.full((len(texts), self.p.shape[1]), np.nan)
        group, held = [], 0
        for i, text in enumerate(texts):
            words = words_of(text)
            group.append((i, words))
            held += len(words)
            if held > 200_000 or i + 1 == len(texts):
                if self.held > REMEMBERED:
                    self.clear()
                known = self.known
                self.learn([w for w in dict.fromkeys(w for _, words in group for w in words) if w not in known])
                for j, words in group:
                    if words:
                        out[j] = self.table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(axis=0)
                group, held = [], 0
        return out


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2, F.lit(False))


def fit_languages(docs: DataFrame, vocabulary_path: str, fit_docs: int = FIT_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages in order and their piece probabilities, from (id, text, lang) rows: at most `fit_docs` of each language.

    The words of the chosen documents are counted by Spark, each task's first. At most FIT_WORDS of a language reach the
    driver, and fewer where so many languages' words would make more than FIT_PAIRS pairs; words as frequent go by their
    order. Besides, a row a language does.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    size = 1 << 40
    counts = known.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(2.0 * fit_docs + 100) / F.count(F.lit(1))).alias("part"))
    cut = written(counts.select(F.col("lang").alias("of"), (F.col("part") * size).cast("long").alias("cut")), "cuts")
    near = known.withColumn("key", F.pmod(F.xxhash64("id", "text"), F.lit(size))).join(cut, F.col("lang") == F.col("of")).where(F.col("key") < F.col("cut"))
    first = Window.partitionBy("lang").orderBy("key", "id")
    chosen = near.withColumn("n", F.row_number().over(first)).where(F.col("n") <= fit_docs)

    def words(parts):
        for part in parts:
            n = Counter((lang, w[i : i + FIT_LETTERS]) for lang, text in zip(part["lang"], part["text"]) for w in words_of(text) for i in range(0, len(w), FIT_LETTERS))
            yield pd.DataFrame([(*key, times) for key, times in n.items()], columns=["lang", "word", "n"])

    each = min(FIT_WORDS, max(1, FIT_PAIRS // max(1, cut.count()) ** 2))
    met = chosen.select("lang", "text").mapInPandas(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("count"))
    frequent = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    counted = met.withColumn("place", F.row_number().over(frequent)).where(F.col("place") <= each).drop("place").toPandas()
    if counted.empty:
        return [], np.zeros((0, 0))
    languages = sorted(counted["lang"].unique())
    table_ = counted.pivot_table(index="word", columns="lang", values="count", fill_value=0).reindex(columns=languages).sort_index()
    return languages, Lattice(vocabulary(vocabulary_path)).fit(list(table_.index), table_.to_numpy(float))


def identify(docs: DataFrame, languages: list[str], p: np.ndarray, carry: list[str], text_col: str, vocabulary_path: str) -> DataFrame:
    """The carried columns, `lang_pred` and `score`: the likeliest language of each whole text and its posterior.

    A null text and one without a letter is `und` with score 0; so is every text where no language was learned.
    Ties go to the first language in order. Rows that repeat are judged each; columns not carried aren't read.
    """

    key = uuid.uuid4().hex

    def rows(texts: list[bytes | None], _: pa.RecordBatch) -> list:
        if not languages:
            return [["und"] * len(texts), [0.0] * len(texts)]
        identifier = worker_cache(key, lambda: Identifier(vocabulary_path, p))
        logs = identifier([(t or b"").decode("utf-8", "replace") for t in texts])
        none = np.isnan(logs[:, 0])
        logs[none] = 0
        best = logs.argmax(axis=1)
        share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        return [["und" if n else languages[b] for n, b in zip(none, best)], np.where(none, 0.0, share)]

    return map_texts(docs, carry, text_col, "lang_pred string, score double", rows, key)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = default_vocabulary()
    learned = docs.where(~held_out("doc_id")).select(F.col("doc_id").alias("id"), "text", "lang")
    languages, p = fit_languages(learned, path)
    named = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return identify(named, languages, p, ["doc_id", "held_out"], "text", path)
