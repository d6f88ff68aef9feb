"""Pages and blocks of document files as a Spark data source; decoding is an injected callable.

A decoder is called as decoder(stream, start, end, wanted): `stream` is the open binary file, `wanted(page_index)` says
whether a page is asked for, so that others needn't be decoded. It yields a dict a page, in any order: page_index, width,
height, rotation, blocks (dicts of block_type, text, x0, y0, x1, y1 in reading order), and maybe text_source,
text_confidence and page_text. A decoder with a true attribute `splittable` gets long files in ranges of bytes and yields
the pages that begin in start <= place < end; others get each file whole. One with a true attribute `bundles` reads files that
hold pages of many documents: its pages have a doc_id, and it calls `wanted(page_index, doc_id)`. A decoder may also have an
attribute `tables`, called as tables(stream, start, end, fields) where no page is left out for its id: it yields Arrow tables of
the same pages with at least those fields, a block's being named `blocks.text` and so on.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, Not,
)
from pyspark.sql.types import StructType

Decoder = Callable[[object, int, int, Callable[..., bool]], Iterator[dict]]

PAGE = "doc_id string, page_index int, width double, height double, rotation int, text_source string, text_confidence double, page_text string"
BLOCK = "doc_id string, page_index int, block_ordinal int, block_type int, text string, x0 double, y0 double, x1 double, y1 double"
#: What a task reads, and what opening a file counts for, in bytes.
PARTITION_BYTES, OPEN_BYTES = 128 << 20, 4 << 20
#: Rows and characters of text after which an Arrow batch leaves the reader, and bytes of JSON that become one table.
BATCH_ROWS, BATCH_CHARS, TABLE_BYTES = 10_000, 4 << 20, 8 << 20
#: What a page has that doesn't say otherwise.
DEFAULTS = {"rotation": 0, "text_source": "native_pdf_text", "text_confidence": 1.0}

_COMPARE = {
    EqualTo: lambda a, b: a == b,
    In: lambda a, b: a in b,
    GreaterThan: lambda a, b: a > b,
    GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b,
}


def holds(test: Filter, value) -> bool:
    """Whether a value passes a filter that is_known() takes; a null one only where nulls are asked for."""
    if isinstance(test, Not):
        return (value is not None or isinstance(test.child, IsNotNull)) and not holds(test.child, value)
    return value is not None and (isinstance(test, IsNotNull) or _COMPARE[type(test)](value, test.value))


def is_known(test: Filter) -> bool:
    """Comparisons of a document's or page's id with values, none of them null, and their opposites."""
    if isinstance(test, Not):
        return is_known(test.child)
    if isinstance(test, IsNotNull):
        return test.attribute in (("doc_id",), ("page_index",))
    if type(test) not in _COMPARE or test.attribute not in (("doc_id",), ("page_index",)):
        return False
    return None not in (test.value if isinstance(test, In) else (test.value,))


def _arrow_types() -> dict:
    import pyarrow as pa

    return {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}


@dataclass
class Pieces(InputPartition):
    """(document, path, first byte, byte after the last) of what a task reads."""

    pieces: tuple[tuple[str, str, int, int], ...]


class LayoutReader(DataSourceReader):
    """Partitions are planned by bytes; filters on ids choose files and pages before anything is opened or decoded."""

    def __init__(self, schema: StructType, options: dict, decoder: Decoder, blocks: bool):
        self.columns, self.blocks, self.decoder = schema.names, blocks, decoder
        self.kinds = [f.dataType.simpleString() for f in schema.fields]
        self.bundles = getattr(decoder, "bundles", False)
        self.root, self.ending = options["path"], options.get("ending", "")
        self.partition_bytes = int(options.get("partition_bytes", 0))
        self.parallelism = int(options.get("parallelism", 1))
        self.tests: dict[str, list[Filter]] = {"doc_id": [], "page_index": []}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for test in filters:
            if is_known(test):
                inner = test
                while isinstance(inner, Not):
                    inner = inner.child
                self.tests[inner.attribute[0]].append(test)
            else:
                yield test

    def partitions(self) -> list[Pieces]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.root)
        top = base.rstrip("/") + "/"
        files = []
        for found in system.get_file_info(fs.FileSelector(base, recursive=True)):
            doc = found.path[len(top) :].removesuffix(self.ending)
            hidden = any(part.startswith(("_", ".")) for part in doc.split("/"))
            if found.type != fs.FileType.File or hidden or not found.path.endswith(self.ending) or not (self.bundles or self._asked("doc_id", doc)):
                continue
            files.append((doc, found.path, found.size))
        # as Spark plans its own files: partitions for all cores, none above the limit
        share = sum(size + OPEN_BYTES for _, _, size in files) // self.parallelism
        most = self.partition_bytes or min(PARTITION_BYTES, max(OPEN_BYTES, share))
        opening, splittable = min(OPEN_BYTES, most), getattr(self.decoder, "splittable", False)
        pieces = []
        for doc, path, size in files:
            step = most if splittable else max(1, size)
            pieces += [(doc, path, at, min(at + step, size)) for at in range(0, size, step)]
        # the longest first, so that the short ones fill what is left
        planned, now, held = [], [], 0
        for piece in sorted(pieces, key=lambda p: (p[2] - p[3], p)):
            size = piece[3] - piece[2] + opening
            if now and held + size > most + opening:
                planned.append(Pieces(tuple(now)))
                now, held = [], 0
            now.append(piece)
            held += size
        return planned + [Pieces(tuple(now))]

    def _asked(self, column: str, value) -> bool:
        return all(holds(t, value) for t in self.tests[column])

    def read(self, partition: Pieces) -> Iterator:
        """Arrow batches: rows one by one would each be checked and turned over in Python again."""
        from pyarrow import fs

        def wanted(page: int, doc: str | None = None) -> bool:
            return self._asked("page_index", page) and (not self.bundles or self._asked("doc_id", doc))

        system, _ = fs.FileSystem.from_uri(self.root)
        # a join asks for ids that aren't null, which a table can be asked as a whole
        chosen = any(not isinstance(t, IsNotNull) for tests in self.tests.values() for t in tests)
        tables = None if chosen else getattr(self.decoder, "tables", None)
        for doc, path, start, end in partition.pieces:
            with io.BufferedReader(system.open_input_file(path), 1 << 20) as stream:
                if tables is not None:
                    for table in tables(stream, start, end, self._fields()):
                        yield from self._table_rows(table if self.bundles else table.append_column("doc_id", [[doc] * len(table)])).to_batches(BATCH_ROWS)
                else:
                    yield from self._rows((page.get("doc_id") if self.bundles else doc, page) for page in self.decoder(stream, start, end, wanted))

    def _rows(self, pages: Iterator[tuple[str, dict]]) -> Iterator:
        sized = [i for i, c in enumerate(self.columns) if c in ("text", "page_text")]
        held: list[list] = [[] for _ in self.columns]
        chars = 0
        for doc, page in pages:
            if not self._asked("page_index", page["page_index"]) or (self.bundles and not self._asked("doc_id", doc)):
                continue
            for values in self._values(doc, page):
                for before, more in zip(held, values, strict=True):
                    before += more
                chars += sum(len(v) for i in sized for v in values[i] if isinstance(v, str))
                if len(held[0]) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield self._batch(held)
                    held, chars = [[] for _ in self.columns], 0
        if held[0]:
            yield self._batch(held)

    def _fields(self) -> set[str]:
        fields = {"doc_id", "page_index", *(() if self.blocks else self.columns)}
        if self.blocks:
            return fields | {f"blocks.{c}" for c in (*self.columns, "block_type")}
        return fields | ({"blocks.text"} if "page_text" in self.columns else set())

    def _table_rows(self, pages):
        """The rows of a table of pages: what _rows() gives of them one by one."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for column in (c for c, tests in self.tests.items() if tests):
            pages = pages.filter(pages[column].is_valid())
        if self.blocks or "page_text" in self.columns:
            lists = pages["blocks"].combine_chunks()
            flat = lists.flatten()
        if self.blocks:
            parents = pc.list_parent_indices(lists)
            of = parents.to_numpy()
            made = {c: flat.field(c) for c in self.columns if c in flat.type.names}
            made |= {c: pages[c].take(parents) for c in self.columns if c in ("doc_id", "page_index")}
            if "block_ordinal" in self.columns:
                made["block_ordinal"] = pa.array((np.arange(len(of)) - np.searchsorted(of, of)).astype("int32"))
        else:
            made = {c: pages[c].fill_null(DEFAULTS[c]) if c in DEFAULTS else pages[c] for c in self.columns if c in pages.column_names}
            if "page_text" in self.columns:
                ends = np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy())
                offsets = pa.array(np.concatenate([[0], ends]).astype("int32"))
                joined = pc.binary_join(pa.ListArray.from_arrays(offsets, flat.field("text").fill_null("")), "\n")
                made["page_text"] = pc.coalesce(made["page_text"].combine_chunks(), joined) if "page_text" in made else joined
        return pa.table([made[c] for c in self.columns], names=self.columns)

    def _values(self, doc: str, page: dict) -> Iterator[list[list]]:
        """A page's row, or its blocks' rows, as a list for each column; many blocks in several parts."""
        blocks = page.get("blocks") or []
        if not self.blocks:
            row = {**DEFAULTS, **page, "doc_id": doc}
            if "page_text" in self.columns and row.get("page_text") is None:
                row["page_text"] = "\n".join(b.get("text") or "" for b in blocks)
            yield [[row.get(c)] for c in self.columns]
            return
        for at in range(0, len(blocks), BATCH_ROWS):
            part = blocks[at : at + BATCH_ROWS]
            given = {"doc_id": doc, "page_index": page["page_index"]}
            yield [[b.get(c, i) for i, b in enumerate(part, at)] if c == "block_ordinal" else [b.get(c, given.get(c)) for b in part] for c in self.columns]

    def _batch(self, held: list[list]):
        import pyarrow as pa

        def column(values: list, kind: str):
            try:
                return pa.array(values, _arrow_types()[kind])
            except (pa.ArrowTypeError, pa.ArrowInvalid):
                if kind != "string":
                    raise
                return pa.array([v if v is None else str(v) for v in values], pa.string())

        return pa.RecordBatch.from_arrays([column(v, k) for v, k in zip(held, self.kinds, strict=True)], names=self.columns)


def _read(spark: SparkSession, folder: str, decoder: Decoder, blocks: bool, columns: tuple[str, ...] | None, **options: object) -> DataFrame:
    class Layouts(DataSource):
        @classmethod
        def name(cls) -> str:
            return "page_blocks" if blocks else "pages"

        def schema(self) -> str:
            return BLOCK if blocks else PAGE

        def reader(self, schema: StructType) -> LayoutReader:
            return LayoutReader(schema, dict(self.options), decoder, blocks)

    # off by default, and a reader that takes filters fails without it
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Layouts)
    whole = StructType.fromDDL(BLOCK if blocks else PAGE)
    asked = StructType([whole[c] for c in columns]) if columns else whole
    planned = {"parallelism": spark.sparkContext.defaultParallelism, **options}
    return spark.read.format(Layouts.name()).schema(asked).options(**planned).load(folder)


def read_pages(spark: SparkSession, folder: str, decoder: Decoder, columns: tuple[str, ...] | None = None, **options: object) -> DataFrame:
    """A row a page of the folder's files, with the columns of PAGE or those asked for; only these leave the reader.

    doc_id is a file's path below the folder, without the option `ending`; files that end otherwise, and hidden ones, are
    left out; where files are bundles, documents name themselves. Without a text of its own a page's is that of its blocks,
    by line. An empty file has no pages.
    """
    return _read(spark, folder, decoder, False, columns, **options)


def read_blocks(spark: SparkSession, folder: str, decoder: Decoder, columns: tuple[str, ...] | None = None, **options: object) -> DataFrame:
    """A row a block, with the columns of BLOCK or those asked for; see read_pages()."""
    return _read(spark, folder, decoder, True, columns, **options)


def page_counts(pages: DataFrame) -> DataFrame:
    """(doc_id, page_count); give it read_pages() of doc_id alone."""
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count"))


def _begin(stream, start: int) -> int:
    """Goes to the first line that begins at `start` or after it."""
    at = max(0, start - 1)
    stream.seek(at)
    return at + len(stream.readline()) if start else at


def _lines(stream, start: int, end: int) -> Iterator[bytes]:
    at = _begin(stream, start)
    while at < end and (line := stream.readline()):
        at += len(line)
        if line.strip():
            yield line


def json_lines(stream, start: int, end: int, wanted: Callable[[int], bool]) -> Iterator[dict]:
    """Decodes a page a line, each begun by `{"page_index":N,`: lines of pages that aren't wanted are passed over unread."""
    for line in _lines(stream, start, end):
        head = line[:40].partition(b":")[2].partition(b",")[0].strip()
        if not (head.isdigit() and not wanted(int(head))):
            yield json.loads(line)


json_lines.splittable = True

_BUNDLE_HEAD = re.compile(rb'\{"page_index":(\d+),"doc_id":("(?:[^"\\]|\\.)*")')


def json_bundles(stream, start: int, end: int, wanted: Callable[[int, str], bool]) -> Iterator[dict]:
    """Decodes write_bundles(): as json_lines(), but each line is begun by `{"page_index":N,"doc_id":"...",`."""
    for line in _lines(stream, start, end):
        head = _BUNDLE_HEAD.match(line)
        if not (head and not wanted(int(head[1]), json.loads(head[2]))):
            yield json.loads(line)


def _json_tables(stream, start: int, end: int, fields: set[str]) -> Iterator:
    """Tables of the pages that json_bundles() yields, some megabytes of lines each."""
    import pyarrow as pa
    from pyarrow import json as arrow_json

    types = _arrow_types()
    page = {name: types[kind] for name, kind in (f.split() for f in PAGE.split(", "))}
    block = [(name, types[kind]) for name, kind in (f.split() for f in BLOCK.split(", ")) if name not in page and f"blocks.{name}" in fields]
    schema = pa.schema([(name, kind) for name, kind in page.items() if name in fields] + [("blocks", pa.list_(pa.struct(block)))] * bool(block))
    parse = arrow_json.ParseOptions(explicit_schema=schema, unexpected_field_behavior="ignore")
    at = _begin(stream, start)
    while at < end and (lines := stream.read(min(TABLE_BYTES, end - at))):
        if not lines.endswith(b"\n"):
            lines += stream.readline()
        at += len(lines)
        if lines.strip():
            yield arrow_json.read_json(io.BytesIO(lines), arrow_json.ReadOptions(use_threads=False, block_size=len(lines) + 1), parse)


json_bundles.splittable = json_bundles.bundles = True
json_bundles.tables = _json_tables


def _page_lines(pages: DataFrame, blocks: DataFrame, *head: str) -> DataFrame:
    """(doc_id, page_index, line) of page and block rows: a page with its blocks as JSON, fields `head` before the others."""
    block = F.struct("block_ordinal", "block_type", "text", "x0", "y0", "x1", "y1")
    held = blocks.groupBy("doc_id", "page_index").agg(F.sort_array(F.collect_list(block)).alias("blocks"))
    inner = F.transform("blocks", lambda b: b.dropFields("block_ordinal"))
    page = F.struct(*head, "width", "height", "rotation", "text_source", "text_confidence", inner.alias("blocks"))
    return pages.join(held, ["doc_id", "page_index"], "left").select("doc_id", "page_index", F.to_json(page).alias("line"))


def write_bundles(pages: DataFrame, blocks: DataFrame, folder: str) -> None:
    """Files `*.txt` of page and block rows, a page a line whatever its document, which json_bundles() decodes.

    As many files as tasks write, so many small documents cost no file each, and a long one isn't joined in one task.
    """
    named = pages.withColumn("doc_id", F.col("doc_id").cast("string")), blocks.withColumn("doc_id", F.col("doc_id").cast("string"))
    _page_lines(*named, "page_index", "doc_id").select("line").write.text(folder)


def write_json_lines(pages: DataFrame, blocks: DataFrame, folder: str) -> None:
    """A file `<doc_id>.jsonl` a document of page and block rows, which json_lines() decodes; documents' ids name files.

    A document's pages are joined within one task, as they are in one file. For many small documents there is write_bundles().
    """
    from quirelake.sources.file_per_row import write_files

    lines = _page_lines(pages, blocks, "page_index").select("doc_id", F.struct("page_index", "line").alias("p"))
    text = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["line"]), "\n"), F.lit("\n"))
    write_files(lines.groupBy("doc_id").agg(text.alias("text")), folder, F.concat(F.col("doc_id").cast("string"), F.lit(".jsonl")), F.col("text"))
