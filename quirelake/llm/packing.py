"""Mixture-controlled packing: source queues are served in proportion, window by window, and fill fixed sequences."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm.common import map_texts, running_total, table, worker_cache, written
from quirelake.llm.mixing import source_weights

SEQUENCE = 1024
#: A window of the deficit round-robin, in tokens: each holds the sources in their target proportions.
WINDOW = 16 * SEQUENCE
SEED = 8
END = 0
#: Characters of the words whose ids a worker remembers at most, about 12 bytes of memory each.
REMEMBERED = 4_000_000


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable Latin ones as they are, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _word_encoder(path: str, tokenizer):
    """The file's merges in tiktoken, whose calls for single words cost less; None unless its ids are the tokenizer's."""
    import json

    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    letters, added = _byte_letters(), {t["content"] for t in told.get("added_tokens", [])}
    try:
        ranks = {bytes(letters[c] for c in piece): i for piece, i in told["model"]["vocab"].items() if piece not in added}
        words = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    except (KeyError, TypeError, ValueError):
        return None
    probe = " The words, in übergroße Zahl: 1234 &&& isn't être\n\n  señor\t…’ 漢字 🙂 naïve-ish (THE) don't."
    return words if words.encode_ordinary(probe) == tokenizer.encode(probe, add_special_tokens=False).ids else None


class Encoder:
    """Ids of whole texts by a tokenizers file. The ids of words that come up again are remembered, up to a limit."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.type, self.code = ("<u2", "H") if small else ("<u4", "I")
        self.words = _word_encoder(path, self.tokenizer)
        feed = self.words.encode_ordinary("\n") if self.words else []
        self.feed = feed[0] if len(feed) == 1 else None
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _encode(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, pieces: list[str]) -> bool:
        """Remembers the ids of words with what parts them from the last one; False where they can't stand alone."""
        if any(not (w := p.removeprefix("\n")) or w[0].isspace() or w[-1].isspace() for p in pieces):
            return False
        ids = np.array(self.words.encode_ordinary("".join(p if p[0] == "\n" else "\n " + p for p in pieces)), self.type)
        starts = np.flatnonzero(ids == self.feed)
        if len(starts) != len(pieces):
            return False
        self.held += sum(map(len, pieces))
        width, blob = ids.itemsize, ids.tobytes()
        bounds = (starts * width).tolist() + [len(blob)]
        for piece, start, end in zip(pieces, bounds, bounds[1:]):
            self.known[piece] = blob[start if piece[0] == "\n" else start + width : end]
        return True

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text and the end id, as bytes of `type`.

        A text goes to its words at single spaces and line feeds, where the tokenizer starts anew. One with wider
        gaps, or white space at an end, is encoded whole, and so is one that may name a special token.
        """
        end, get, width = array(self.code, [END]).tobytes(), self.known.get, np.dtype(self.type).itemsize
        out: list[bytes] = []
        for text in texts:
            if self.held > REMEMBERED:
                self.known.clear()
                self.held = 0
            if self.feed is None or not text or "<|" in text:
                out.append(self._encode(text) + end)
                continue
            pieces = f"\n{text}".replace("\n", " \n").split(" ")[1:]
            ids = list(map(get, pieces))
            if None in ids:
                if not self._learn(list(dict.fromkeys(p for p, i in zip(pieces, ids) if i is None))):
                    out.append(self._encode(text) + end)
                    continue
                ids = [get(p) if i is None else i for p, i in zip(pieces, ids)]
            out.append(b"".join(ids)[width:] + end)
        return out


def encoder(path: str) -> Encoder:
    """One encoder a Python worker and tokenizer file."""
    return worker_cache(f"encoder {path}", lambda: Encoder(path))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, carry: list[str], text_col: str, tokenizer: str) -> DataFrame:
    """The carried columns with `ids` (bytes) and `doc_tokens` for every row; a null text is empty."""

    def rows(texts: list[bytes | None], _: pa.RecordBatch) -> list:
        encode = encoder(tokenizer)
        ids = encode([(t or b"").decode("utf-8", "replace") for t in texts])
        width = np.dtype(encode.type).itemsize
        return [ids, [len(x) // width for x in ids]]

    return map_texts(docs, carry, text_col, "ids binary, doc_tokens long", rows, f"encoder {tokenizer}")


def plan_pieces(rows: DataFrame, weights: DataFrame | None = None, sequence: int = SEQUENCE, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(row_id, start, length, sequence_id, offset) over rows of (row_id, source, doc_tokens).

    Every source is a queue of its documents in seeded hash order. In each window a source is granted
    window * weight / sum of weights tokens more, and sends whole documents while its deficit (what it was granted and
    has not sent) covers the next one; the rest of the deficit is carried to its next window. So a document leaves in
    the first window by whose end its source was granted all up to the document's end, which follows from the document's
    place in its queue, wherever its rows lie. `weights` has (source, weight); without it sources weigh
    as much as they hold, and all run out in the last window. A source that runs out leaves later windows to the
    others, in their proportions. Sources without a positive weight follow when the weighted ones have run out, and
    weigh as much as they hold among themselves. The windows follow one another without a gap and documents are cut only
    where a sequence of `sequence` tokens ends, so only the last sequence needs padding.
    """
    order = F.xxhash64(F.lit(seed), "row_id")
    queued = running_total(
        rows.select("row_id", "source", "doc_tokens", order.alias("__h")), [F.col("source").asc_nulls_first(), F.col("__h"), F.col("row_id")], "doc_tokens", "__at"
    )
    queued = written(queued, "queued")
    sources = queued.groupBy("source").agg(F.sum("doc_tokens").alias("__tokens"), F.min("__at").alias("__begin"))
    if weights is None:
        sources = sources.withColumn("__weight", F.col("__tokens").cast("double"))
    else:
        named = weights.select(F.col("source").alias("__w"), F.col("weight").cast("double").alias("__weight"))
        sources = sources.join(named, F.col("source").eqNullSafe(F.col("__w")), "left").drop("__w")
    late = ~F.coalesce((F.col("__weight") > 0) & ~F.isnan("__weight"), F.lit(False))
    sources = sources.withColumn("__late", late).withColumn("__weight", F.when(F.col("__late"), F.col("__tokens").cast("double")).otherwise(F.col("__weight")))
    totals = {x["__late"]: x["__total"] for x in sources.groupBy("__late").agg(F.sum("__weight").alias("__total")).collect()}
    total = F.when(F.col("__late"), F.lit(float(totals.get(True) or 1.0))).otherwise(F.lit(float(totals.get(False) or 1.0)))
    sources = sources.withColumn("__due", F.col("__weight") * float(window) / total)
    shift = 0
    if totals.get(True):
        shift = sources.where("NOT __late").agg(F.max(F.floor(F.col("__tokens") / F.col("__due")) + 2)).first()[0] or 0
    after = F.when(F.col("__late"), F.lit(int(shift))).otherwise(F.lit(0))
    sources = written(sources.select(F.col("source").alias("__s"), "__begin", "__due", after.cast("long").alias("__after")), "sources")
    placed = queued.join(sources, F.col("source").eqNullSafe(F.col("__s"))).withColumn("__x", F.col("__at") - F.col("__begin"))

    window_of = F.greatest(F.ceil((F.col("__x") + F.col("doc_tokens")) / F.col("__due") - 1e-9) - 1, F.lit(0)) + F.col("__after")
    sent = placed.withColumn("__w", window_of).select("row_id", "source", "__w", "__at", "doc_tokens")
    stream = running_total(sent, [F.col("__w"), F.col("source").asc_nulls_first(), F.col("__at")], "doc_tokens", "__pos")
    from_, to = F.floor(F.col("__pos") / sequence), F.floor((F.col("__pos") + F.col("doc_tokens") - 1) / sequence)
    s = F.col("sequence_id")
    begin, stop = F.greatest(F.col("__pos"), s * sequence), F.least(F.col("__pos") + F.col("doc_tokens"), (s + 1) * sequence)
    return stream.withColumn("sequence_id", F.explode(F.sequence(from_, to))).select(
        "row_id",
        (begin - F.col("__pos")).alias("start"),
        (stop - begin).alias("length"),
        "sequence_id",
        (begin - s * sequence).alias("offset"),
    )


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: DataFrame | None = None
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): every id of every row in one piece.

    A null or empty text has the end id alone. Rows that repeat are packed each; a null source is a queue of its
    own. Neighbouring pieces of one row that meet in a sequence stay apart. Other columns aren't read. An empty
    table gives no rows. Texts are encoded once; what is ordered and summed is numbers only, and ids meet their
    cuts by row.
    """
    tokenizer = tokenizer or default_tokenizer()
    kept = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{text_col}`").alias("__body"))
    encoded = written(encode_documents(kept, ["doc_id", "source"], "__body", tokenizer).withColumn("row_id", F.monotonically_increasing_id()), "encoded")
    pieces = plan_pieces(encoded.select("row_id", "source", "doc_tokens"), weights)
    by_row = pieces.groupBy("row_id").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("cuts"))
    width = 2 if encoder(tokenizer).type == "<u2" else 4

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc, kind = zlib.crc32, "<u2" if width == 2 else "<u4"
        for part in parts:
            doc, ids, tokens, cuts = part.columns
            ends = cuts.offsets.to_numpy()
            at = [c.to_numpy() for c in cuts.values.flatten()]
            sums = np.empty(len(at[0]), np.int64)
            for i, (s, e) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                if e > s:
                    wide = np.frombuffer(ids[i].as_buffer(), kind).astype("<u4")
                    sums[s:e] = [crc(wide[a : a + n]) for a, n in zip(at[0][s:e].tolist(), at[1][s:e].tolist())]
            row = np.repeat(np.arange(len(doc)), np.diff(ends))
            columns = [doc.take(pa.array(row)), at[0], at[1], sums, tokens.take(pa.array(row)), at[2], at[3]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = dict(encoded.dtypes)["doc_id"]
    met = encoded.join(by_row, "row_id").select("doc_id", "ids", "doc_tokens", "cuts")
    return met.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources weigh as they do in mixing, whatever they hold."""
    docs = table(spark, sf_dir, "documents")
    weights = source_weights(written(docs.select("source").distinct(), "sources"))
    return pack_documents(docs, weights=written(weights, "weights"))
