"""Document quality from a linear-chain conditional random field that labels every line good or bad."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.llm.common import hash_sample, map_texts, table, written
from quirelake.llm.language_id import held_out

#: Labelled documents that the field is fitted on, the first by the hash of their ids, and UTF-8 bytes of all their
#: texts: a document that would go beyond that is left out of the fit.
FIT_DOCS, FIT_BYTES = 3000, 24 << 20
FIT_ROUNDS = 150
#: Lines whose features are worked out together, of one text or several.
LINES = 20_000

#: Shares of a line's characters by class: upper case, symbols, marks, digits, bars and brackets, blanks.
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = 1
_CLASS[list(b"#*$%&@=+_^~\\`")] = 2
_CLASS[list(b"!?")] = 3
_CLASS[48:58] = 4
_CLASS[list(b"|<>{}[]")] = 5
_CLASS[[9, 11, 12, 13, 32]] = 6
_CLASS[list(b".,;:'\"()-/")] = 7
CLASSES = 8
#: Of one line: the shares of classes 1 to 7, square roots of those of 1 to 5, log length, words' mean length, share of words equal to
#: the one before, share of words met before in the line, whether it has no word.
OWN = 7 + 5 + 5
FEATURES = 3 * OWN + 3


def own_features(lines: list[bytes]) -> np.ndarray:
    """The OWN features of each line."""
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = np.frombuffer(b"".join(lines), np.uint8)
    shares = np.zeros((len(lines), CLASSES))
    ends = np.cumsum(lengths)
    for at in range(0, len(lines), 4096):
        begin, end = (ends[at - 1] if at else 0), ends[min(at + 4096, len(lines)) - 1]
        n = min(4096, len(lines) - at)
        row = np.repeat(np.arange(n), lengths[at : at + n]) * CLASSES
        shares[at : at + n] = np.bincount(row + _CLASS[codes[begin:end]], minlength=n * CLASSES).reshape(n, CLASSES)
    shares /= np.maximum(lengths, 1)[:, None]
    words = np.zeros((len(lines), 3))
    for i, line in enumerate(lines):
        own = line.split()
        if n := len(own):
            words[i] = n, sum(map(bytes.__eq__, own[1:], own)) / n, 1 - len(set(own)) / n
    return np.column_stack(
        [shares[:, 1:], np.sqrt(shares[:, 1:6]), np.log1p(lengths) / 8, lengths / np.maximum(words[:, 0], 1) / 16, words[:, 1], words[:, 2], words[:, 0] == 0]
    )


def split_lines(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All lines of the texts, and the number of each text's."""
    split = [text.split(b"\n") for text in texts]
    return [line for own in split for line in own], np.array([len(own) for own in split], np.int64)


def line_features(lines: list[bytes], counts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For LINES lines at a time: the first one, and their features with those of both neighbours in the same text."""
    first = np.zeros(len(lines) + 1, bool)
    first[np.cumsum(counts) - counts] = True
    first[-1] = True
    for at in range(0, len(lines), LINES):
        end = min(at + LINES, len(lines))
        low, high = max(0, at - 1), min(len(lines), end + 1)
        around = own_features(lines[low:high])
        own, opens, closes = around[at - low : end - low], first[at:end], first[at + 1 : end + 1]
        before, after = np.zeros_like(own), np.zeros_like(own)
        before[low - at + 1 if low == at else 0 :] = around[: end - low - 1]
        after[: high - at - 1] = around[at - low + 1 :]
        before[opens], after[closes] = 0, 0
        yield at, np.column_stack([own, before, after, opens, closes, np.ones(end - at)])


def _steps(counts: np.ndarray):
    """Texts by falling number of lines, where each starts, and how many have a line at each step."""
    order = np.argsort(-counts, kind="stable")
    starts = (np.cumsum(counts) - counts)[order]
    alive = np.searchsorted(-counts[order], -np.arange(int(counts.max(initial=0))), side="left")
    return starts, alive


def marginals(scores: np.ndarray, counts: np.ndarray, moves: np.ndarray, with_pairs: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Forward-backward over all texts at once: P(good) of each line and, if asked for, pair marginals of each step.

    scores: [line, 2]; moves: [2, 2], from bad or good to bad or good. Everything is in logarithms.
    """
    starts, alive = _steps(counts)
    ahead, back = np.zeros_like(scores), np.zeros_like(scores)
    for t, n in enumerate(alive):
        at = starts[:n] + t
        if t == 0:
            ahead[at] = scores[at]
        else:
            was = ahead[at - 1][:, :, None] + moves[None]
            ahead[at] = np.logaddexp(was[:, 0], was[:, 1]) + scores[at]
    for t in range(len(alive) - 2, -1, -1):
        at = starts[: alive[t + 1]] + t
        to = (back[at + 1] + scores[at + 1])[:, None, :] + moves[None]
        back[at] = np.logaddexp(to[:, :, 0], to[:, :, 1])
    last = np.cumsum(counts) - 1
    z = np.logaddexp(ahead[last, 0], ahead[last, 1])
    whole = np.repeat(z, counts)
    good = np.exp(np.clip(ahead[:, 1] + back[:, 1] - whole, -700, 0))
    if not with_pairs:
        return good, None
    inner = np.ones(len(scores), bool)
    inner[last] = False
    at = np.flatnonzero(inner)
    pairs = np.exp(np.clip(ahead[at][:, :, None] + moves[None] + (scores[at + 1] + back[at + 1])[:, None, :] - whole[at][:, None, None], -700, 0))
    return good, pairs


class LineField:
    """Weights of the field and of the logistic curve from a document's weighted mean to its score."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, slope: float, offset: float):
        self.weights, self.moves, self.slope, self.offset = weights, moves, slope, offset

    def means(self, texts: list[bytes]) -> np.ndarray:
        """Each text's share of good characters: its lines' marginals, weighted with their lengths."""
        lines, counts = split_lines(texts)
        scores = np.zeros((len(lines), 2))
        for at, features in line_features(lines, counts):
            scores[at : at + len(features), 1] = features @ self.weights
        good, _ = marginals(scores, counts, self.moves, False)
        first, heavy = np.cumsum(counts) - counts, np.fromiter(map(len, lines), np.int64, len(lines)) + 1e-6
        return np.add.reduceat(good * heavy, first) / np.add.reduceat(heavy, first)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Scores of texts, worked off in groups of about 2 * LINES lines; of a longer text only the scores of its lines are held."""
        out, group, held = [], [], 0
        for text in texts:
            group.append(text)
            held += text.count(b"\n") + 1
            if held >= 2 * LINES:
                out.append(self.means(group))
                group, held = [], 0
        if group:
            out.append(self.means(group))
        means = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-(self.slope * means + self.offset)))


def fit_field(texts: list[bytes], labels: np.ndarray, rounds: int = FIT_ROUNDS) -> LineField:
    """Maximum likelihood of the line labels by Adam steps; every line starts with its document's label.

    Half way, the lines of bad documents that the field itself holds to be good are relabelled, all but each such
    document's worst line, as a bad document often has good lines too.
    """
    if not len(texts) or len(set(labels.tolist())) < 2:
        return LineField(np.zeros(FEATURES), np.zeros((2, 2)), 0.0, 2.0 if len(labels) and labels[0] else (-2.0 if len(labels) else 0.0))
    lines, counts = split_lines(texts)
    features = np.concatenate([f for _, f in line_features(lines, counts)])
    doc = np.repeat(np.arange(len(texts)), counts)
    y = labels[doc].astype(float)
    last = np.cumsum(counts) - 1
    inner = np.ones(len(y), bool)
    inner[last] = False
    at = np.flatnonzero(inner)
    heavy = (1 / counts)[doc]  # documents count alike
    heavy = heavy * np.where(labels[doc] == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    theta, mean, square = np.zeros(FEATURES + 4), np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)
    for step in range(1, rounds + 1):
        scores = np.zeros((len(y), 2))
        scores[:, 1] = features @ theta[:FEATURES]
        good, pairs = marginals(scores, counts, theta[FEATURES:].reshape(2, 2))
        if step == rounds // 2:
            worst = np.full(len(texts), np.inf)
            np.minimum.at(worst, doc, good)
            y = np.where((labels[doc] == 0) & (good > 0.5) & (good > worst[doc]), 1.0, y)
        seen = np.zeros((len(at), 4))
        seen[np.arange(len(at)), (2 * y[at] + y[at + 1]).astype(int)] = 1
        gradient = np.concatenate([features.T @ (heavy * (y - good)), (heavy[at][:, None] * (seen - pairs.reshape(-1, 4))).sum(axis=0)]) - 1e-5 * theta
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        theta = theta + 0.15 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    field = LineField(theta[:FEATURES], theta[FEATURES:].reshape(2, 2), 1.0, 0.0)
    x = np.column_stack([field.means(texts), np.ones(len(texts))])
    ab = np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-(x @ ab)))
        ab += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), x.T @ (labels - p) - 1e-2 * ab)
    return LineField(field.weights, field.moves, float(ab[0]), float(ab[1]))


def learn(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> LineField:
    """The field of at most `fit_docs` labelled (doc_id, text) rows, whole texts, by the hash of their ids."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.where(~held_out("doc_id"))
    chosen = hash_sample(known, ["doc_id"], fit_docs, known.count())
    sizes = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("size")).join(F.broadcast(chosen), "doc_id")  # at most fit_docs rows
    sizes = sizes.groupBy("doc_id", "quality").agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fits = written(sizes.withColumn("upto", upto).where(F.col("upto") <= FIT_BYTES).select("doc_id", "quality"), "fit")
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(fits), "doc_id")  # the same rows, or fewer
    got = rows.select("text", "quality").toPandas()
    return fit_field([bytes(t) if t is not None else b"" for t in got["text"]], got["quality"].to_numpy())


def classify(docs: DataFrame, field: LineField, carry: list[str], text_col: str) -> DataFrame:
    """The carried columns and `score`, between 0 and 1, of every row's whole text.

    A null text is empty; an empty text is one line without a word. Rows that repeat are scored each; columns
    not carried aren't read. Where no labels were learned every score is 0.5.
    """

    def rows(texts: list[bytes | None], _: pa.RecordBatch) -> list:
        return [field.score([t or b"" for t in texts])]

    return map_texts(docs, carry, text_col, "score double", rows)


def op7_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = learn(docs, table(spark, sf_dir, "labels"))
    named = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return classify(named, field, ["doc_id", "held_out"], "text").withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
