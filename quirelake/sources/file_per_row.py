"""A Spark data source that writes a file for each row: a job's files appear when it commits, and not before."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Where attempts write, beside the files that are there already.
ATTEMPTS = "_attempts"
#: Stands in a job's folder until it is over; tasks that outlive their job see that it has gone.
OPEN = "_open"


@dataclass
class Attempt(WriterCommitMessage):
    folder: str


class FileWriter(DataSourceWriter):
    """Each task writes into a folder of its own attempt; the commit moves what the tasks that count have written.

    A file that is there already is replaced by one move. What killed or repeated attempts have left goes with the job's
    folder, at its commit as at its end without one. A name that comes twice, or that leads out of the folder, fails the job.
    """

    def __init__(self, root: str):
        self.root = root
        self.job = uuid.uuid4().hex
        system, _, job = self._place()
        system.create_dir(job, recursive=True)
        with system.open_output_stream(f"{job}/{OPEN}"):
            pass

    def _place(self):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.root)
        return system, base.rstrip("/"), f"{base.rstrip('/')}/{ATTEMPTS}/{self.job}"

    def write(self, iterator: Iterator) -> Attempt:
        from pyspark import TaskContext

        from pyarrow import fs

        system, _, job = self._place()
        task = TaskContext.get()
        folder = f"{task.partitionId()}-{task.taskAttemptId()}"
        named: set[str] = set()
        try:
            for name, value in iterator:
                parts = name.split("/")
                if not all(parts) or ".." in parts or "." in parts or parts[0] == ATTEMPTS or name in named:
                    raise ValueError(f"not a file's name, or one that comes twice: {name}")
                named.add(name)
                path = f"{job}/{folder}/{name}"
                system.create_dir(path.rpartition("/")[0], recursive=True)
                with system.open_output_stream(path) as out:
                    out.write(value if isinstance(value, (bytes, bytearray)) else value.encode())
            if system.get_file_info(f"{job}/{OPEN}").type == fs.FileType.NotFound:
                raise RuntimeError("the job is over")
        except BaseException:
            if system.get_file_info(f"{job}/{OPEN}").type == fs.FileType.NotFound:
                self._clear()  # the abort came before this task's last file
            elif named:
                system.delete_dir_contents(f"{job}/{folder}", missing_dir_ok=True)
            raise
        return Attempt(folder)

    def commit(self, messages: list[Attempt | None]) -> None:
        from pyarrow import fs

        system, base, job = self._place()
        moves: dict[str, str] = {}
        for folder in {m.folder for m in messages if m is not None}:
            top = f"{job}/{folder}"
            if system.get_file_info(top).type == fs.FileType.NotFound:
                continue  # a task without rows
            for found in system.get_file_info(fs.FileSelector(top, recursive=True)):
                if found.type == fs.FileType.File:
                    name = found.path[len(top) + 1 :]
                    if name in moves:
                        self.abort(messages)
                        raise ValueError(f"two rows for one file: {name}")
                    moves[name] = found.path
        for name, source in moves.items():
            system.create_dir(f"{base}/{name}".rpartition("/")[0], recursive=True)
            system.move(source, f"{base}/{name}")
        self._clear()

    def abort(self, messages: list[Attempt | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        system, base, job = self._place()
        if system.get_file_info(job).type != fs.FileType.NotFound:
            system.delete_dir(job)
        attempts = f"{base}/{ATTEMPTS}"
        if system.get_file_info(attempts).type != fs.FileType.NotFound and not system.get_file_info(fs.FileSelector(attempts)):
            system.delete_dir(attempts)


class FilePerRow(DataSource):
    """Writes (name, value) rows as files under the path."""

    @classmethod
    def name(cls) -> str:
        return "file_per_row"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"])


def write_files(rows: DataFrame, root: str, name: Column, value: Column) -> None:
    """A file `name` (a relative path) under `root` for each row, holding `value`, a text or bytes; rows without a value have none.

    All files of the call appear together once every task is done; one that is there already is replaced.
    """
    spark = rows.sparkSession
    spark.dataSource.register(FilePerRow)
    rows.select(name.alias("name"), value.alias("value")).where("value IS NOT NULL").write.format("file_per_row").mode("append").save(root)


#: A manifest's rows, as they are saved.
VIDEO = "url string, title string, status string, output_path string, kept boolean, error string, model_used string"


def save_manifests(manifests: DataFrame, root: str) -> None:
    """A file for each (playlist_title, manifest) row, under the slug of its title."""
    from quirelake.functions.text import safe_slug
    from quirelake.sources.sinks import sorted_json

    slug = safe_slug(F.concat(F.lit("playlist-"), "playlist_title"), "playlist")
    write_files(manifests, root, F.concat(slug, F.lit("_manifest.json")), sorted_json(F.col("manifest")))


def load_manifests(spark: SparkSession, root: str, video: str = VIDEO) -> DataFrame:
    """(playlist_title, position, ...) rows of saved manifests; files that hold no such JSON have none."""
    texts = spark.read.option("pathGlobFilter", "*_manifest.json").text(root, wholetext=True)
    parsed = texts.select(F.from_json("value", f"playlist_title string, videos array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in video.split(','))}>>").alias("m"))
    return parsed.select("m.playlist_title", F.posexplode("m.videos").alias("position", "v")).select("playlist_title", "position", "v.*")
