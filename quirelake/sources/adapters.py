"""Edges that Spark has no reader for: page decoding, OCR, model calls. Each is a callable run inside mapInArrow or mapInPandas.

None of them is implemented here against a real service; tests pass fakes. A failure becomes a row with an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quirelake.functions.text import QUOTA_MARKS, strip
from quirelake.operators.lines import BLOCK_LENGTH, BLOCKS, USABLE_LENGTH

#: Bytes of an Arrow batch that are worked off together.
SLICE = 4 << 20

PAGES = "doc_id string, page_index int, text string, images int, error string"


class Decoder(Protocol):
    """Pages of one document's bytes: (text, number of images) each."""

    def __call__(self, content: bytes) -> list[tuple[str, int]]: ...


class Model(Protocol):
    """One model call: instructions and text in, text out; raises on failure."""

    def __call__(self, instructions: str, text: str, model: str) -> str: ...


def decode_pages(files: DataFrame, decoder: Decoder, max_pages: int | None = None) -> DataFrame:
    """A row for each page of (doc_id, content) rows; a document that can't be decoded has one row with the error."""

    schema = T._parse_datatype_string(PAGES)
    types = to_arrow_schema(schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(parts):
            rows = []
            for doc, content in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                try:
                    rows += [(doc, i, text, images, None) for i, (text, images) in enumerate(decoder(bytes(content))[:max_pages])]
                except Exception as error:
                    rows.append((doc, None, None, None, f"{type(error).__name__}: {error}"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), types)], schema=types)

    return files.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInArrow(run, schema)


def pages_as_markdown(pages: DataFrame) -> DataFrame:
    """(doc_id, markdown): non-blank pages under headings of their numbers; null where a document has none."""
    body = strip(F.coalesce("text", F.lit("")))
    part = F.when(body != "", F.struct("page_index", F.concat(F.lit("# Page "), F.col("page_index") + 1, F.lit("\n\n"), body).alias("m")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["m"]), "\n\n")
    return pages.groupBy("doc_id").agg(joined.alias("m")).select("doc_id", F.when(F.col("m") != "", F.col("m")).alias("markdown"))


def call_model(rows: DataFrame, model: Callable[[str, str, str], str], instructions: str) -> DataFrame:
    """Adds `answer`, `error` and `calls` to rows with `text` and `model`; up to three tries, none after a quota error."""
    added = [T.StructField("answer", T.StringType()), T.StructField("error", T.StringType()), T.StructField("calls", T.IntegerType())]
    texts, names = rows.columns.index("text"), rows.columns.index("model")

    def one(text: str | None, name: str | None) -> tuple[str | None, str | None, int]:
        answer, error, calls = None, None, 0
        while answer is None and calls < 3 and not (error and "quota" in error.lower()):
            calls += 1
            try:
                answer, error = model(instructions, text, name), None
            except Exception as failure:
                error = f"{type(failure).__name__}: {failure}"
        return answer, error, calls

    return _with_fields(rows, T.StructType(added), lambda: lambda part: [one(t, n) for t, n in zip(part.column(texts).to_pylist(), part.column(names).to_pylist())])


def usable(text: str) -> bool:
    """lines.is_usable_markdown() of one text, for what decides inside a task."""
    body = text.strip()
    headings = any(line.startswith("#") for line in body.splitlines())
    return len(body) >= USABLE_LENGTH and (headings or sum(len(part.strip()) > BLOCK_LENGTH for part in body.split("\n\n")) >= BLOCKS)


def extract_lazily(files: DataFrame, engines: dict[str, Callable[[bytes], str]], order: str = "fallback_order") -> DataFrame:
    """Adds `markdown`, `engine` and `attempts` (engine, error) to rows with `content` and an array `order` of engines' names.

    Engines are tried in their order inside the task, and no further one is started once a text is usable. A failure, a
    name that no engine has and a text that isn't usable are attempts with an error; where none does, markdown and
    engine are null and the last attempt says why.
    """
    added = T._parse_datatype_string("markdown string, engine string, attempts array<struct<engine:string,error:string>>")
    content, names = files.columns.index("content"), files.columns.index(order)

    def one(data: bytes | None, wanted: list[str] | None) -> tuple:
        attempts = []
        for name in wanted or []:
            try:
                text = engines[name](data)
                error = None if text is not None and usable(text) else "unusable text"
            except Exception as failure:
                text, error = None, f"{type(failure).__name__}: {failure}"
            attempts.append({"engine": name, "error": error})
            if error is None:
                return text, name, attempts
        return None, None, attempts

    return _with_fields(files, added, lambda: lambda part: [one(c, w) for c, w in zip(part.column(content).to_pylist(), part.column(names).to_pylist())])


def _slices(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows that have some SLICE bytes on average, so that a task holds few of them as Python values."""
    for part in parts:
        step = max(1, part.num_rows * SLICE // max(1, part.nbytes))
        for at in range(0, part.num_rows, step):
            yield part.slice(at, step)


def _with_fields(rows: DataFrame, added: T.StructType, make: Callable[[], Callable[[pa.RecordBatch], list[tuple]]]) -> DataFrame:
    """Rows with the fields that a function of Arrow batches gives (a tuple a row); `make` makes one for each partition, so it may keep state."""
    types = to_arrow_schema(added)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for part in _slices(parts):
            made = of(part)
            arrays = [pa.array([m[i] for m in made], f.type) for i, f in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*part.columns, *arrays], schema=pa.schema([*part.schema, *types]))

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *added.fields]))


#: What a visual review says of an element.
REVIEW = (
    "media_readable boolean, observed_type string, recommended_status string, disagreements array<struct<location:string,ocr_value:string,preferred_candidate:string>>, "
    "n_ambiguous int, n_missing int, numeric_confidence double, structure_confidence double, formula_confidence double, has_formula boolean"
)


def review_in_order(elements: DataFrame, reviewer: Callable[[dict], dict], budget: int, order: tuple[str, ...] = ("page_index", "ordinal"), fields: str = REVIEW) -> DataFrame:
    """Elements with what `reviewer` says of them (`fields`), `error`, `repaired`, `attempted` and `circuit_open`.

    A document's elements come to one task in their order, which holds no more of them than an Arrow batch: it counts the
    document's attempts and remembers a quota error from batch to batch, so no call is made beyond `budget` nor
    after that error. A reviewer takes an element as a dict; what it raises is the element's error (its attribute
    `repaired` tells of a second call). It may say `repaired` itself. Fields of elements that weren't tried are null.
    """
    said = T._parse_datatype_string(fields)
    added = T.StructType([*said.fields, *T._parse_datatype_string("error string, repaired boolean, attempted boolean, circuit_open boolean").fields])
    elements = elements.drop(*added.names)  # a review's values take the place of those before
    document = elements.columns.index("doc_id")

    def make() -> Callable[[pa.RecordBatch], list[tuple]]:
        now, tried, opened = object(), 0, False

        def review(part: pa.RecordBatch) -> list[tuple]:
            nonlocal now, tried, opened
            out, held = [], None
            for i, doc in enumerate(part.column(document).to_pylist()):
                if doc != now:
                    now, tried, opened = doc, 0, False
                answer, error, repaired = {}, None, False
                attempted, was_open = tried < budget and not opened, opened
                if attempted:
                    tried += 1
                    try:
                        held = held or part.to_pylist()
                        answer = reviewer(held[i])
                        repaired = bool(answer.get("repaired", False))
                    except Exception as failure:
                        error, repaired = str(failure), bool(getattr(failure, "repaired", False))
                        opened = any(mark in error.lower() for mark in QUOTA_MARKS)
                out.append((*(answer.get(f.name) for f in said.fields), error, repaired, attempted, was_open))
            return out

        return review

    dealt = elements.repartition("doc_id").sortWithinPartitions("doc_id", *order)
    return _with_fields(dealt, added, make)


def review_once_repaired(rows: DataFrame, model: Callable[[str, str, str], str], instructions: str, valid: Callable[[dict], str | None]) -> DataFrame:
    """(element_id, review, error, repaired) of (element_id, text, model) rows: an invalid answer is asked for once more, with what was wrong."""
    import json

    def once(told: str, text: str, name: str) -> tuple[str | None, str | None]:
        try:
            answer = model(told, text, name)
            wrong = valid(json.loads(answer))
            return (None, wrong) if wrong else (answer, None)
        except json.JSONDecodeError as error:
            return None, f"invalid JSON: {error}"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for element, text, name in zip(part["element_id"], part["text"], part["model"]):
                try:
                    review, wrong = once(instructions, text, name)
                    repaired = wrong is not None
                    if repaired:
                        review, wrong = once(f"{instructions}\n{wrong}", text, name)
                    out.append((element, review, wrong, repaired))
                except Exception as error:
                    out.append((element, None, f"{type(error).__name__}: {error}", False))
            yield pd.DataFrame(out, columns=["element_id", "review", "error", "repaired"])

    return rows.select("element_id", "text", "model").mapInPandas(run, "element_id string, review string, error string, repaired boolean")


def ocr_command(max_pages: int | None, language: str, source: str, target: str) -> list[str]:
    """Arguments of the OCR program for a file."""
    pages = [] if max_pages is None else ["--pages", f"1-{max_pages}"]
    return ["--rotate-pages", "--deskew", "--skip-text", "--jobs", "2", "-l", language, *pages, source, target]


def ocr_prefix(setting: Column, has_module: Column, program: Column) -> Column:
    """How the OCR program is called: the setting's words, else as a module, else the program's path; null where there is none."""
    own = F.filter(F.split(F.coalesce(setting, F.lit("")), r"\s+"), lambda w: w != "")
    module = F.array(*map(F.lit, ("python", "-m", "ocrmypdf")))
    return F.when(F.size(own) > 0, own).when(F.coalesce(has_module, F.lit(False)), module).when(program.isNotNull(), F.array(program))
