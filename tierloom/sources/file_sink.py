"""Documents written as files of their own names, by a Python data source.

Spark's own writers choose file names; a corpus needs the names of its documents. A task writes its files into a folder of its
attempt, and only what the driver commits moves to its place, so that a task that dies or is run twice leaves nothing half
written among the documents. Folders, not files, are moved and told to the driver: one for each task.

Paths are those that pyarrow's file systems know (local and file:, hdfs:, s3:, gs:), shared by driver and executors.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "tierloom_files"
_STAGED = "_staged-"


def _place(path: str):
    """File system and path of a URI or of a plain local path."""
    from pyarrow import fs

    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:/", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: its folder, files and bytes."""

    folder: str
    files: int
    bytes: int


class FileWriter(DataSourceWriter):
    """Writes rows of name and content; overwriting replaces all former files once the new ones are complete."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.token = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        """One task's files, in a folder that no other attempt shares."""
        system, path = _place(self.path)
        folder = f"{path}/{_STAGED}{self.token}/{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=True)
        files = size = 0
        for row in iterator:
            name, content = row["name"], row["content"]
            if not name or "/" in name or name.startswith(("_", ".")):
                raise ValueError(f"no name for a file: {name!r}")
            if system.get_file_info(f"{folder}/{name}").type.name != "NotFound":
                raise ValueError(f"two files of one name: {name!r}")
            with system.open_output_stream(f"{folder}/{name}", compression=None) as out:
                out.write(content or b"")
            files, size = files + 1, size + len(content or b"")
        return Written(folder, files, size)

    def _old(self, system, path: str) -> list:
        from pyarrow import fs

        return [f for f in system.get_file_info(fs.FileSelector(path)) if not f.base_name.startswith(_STAGED)]

    def commit(self, messages: list[Written | None]) -> None:
        """Move the tasks' folders to their place; former ones go last when they are to be replaced."""
        system, path = _place(self.path)
        system.create_dir(path, recursive=True)
        old = self._old(system, path) if self.overwrite else []
        for m in messages:
            if m is not None and m.files:
                system.move(m.folder, f"{path}/part-{m.folder.rsplit('/', 1)[-1]}")
        for f in old:
            (system.delete_dir if f.type.name == "Directory" else system.delete_file)(f.path)
        self._drop_staged(system, path)
        with system.open_output_stream(f"{path}/_SUCCESS", compression=None):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        """Remove what was staged; former files stay."""
        self._drop_staged(*_place(self.path))

    def _drop_staged(self, system, path: str) -> None:
        staged = f"{path}/{_STAGED}{self.token}"
        if system.get_file_info(staged).type.name == "Directory":
            system.delete_dir(staged)


class FileSink(DataSource):
    """Rows of (name string, content binary) as files."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if [(f.name, f.dataType.simpleString()) for f in schema] != [("name", "string"), ("content", "binary")]:
            raise ValueError("rows need name (string) and content (binary)")
        return FileWriter(self.options["path"], overwrite)


def write_files(files: DataFrame, path: str, append: bool = False) -> None:
    """Write rows of name and content below a folder, one file each; a name is unique within a task.

    Files stand in one folder for each task; readers look below all of them. Where two tasks hold one name, both files stand.
    """
    spark = files.sparkSession
    spark.dataSource.register(FileSink)
    files.select("name", "content").write.format(FORMAT).mode("append" if append else "overwrite").save(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The files of ``write_files`` again, by any path that Spark knows; its reader passes over files without a byte."""
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "content")
